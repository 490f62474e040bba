"""Queries over the synthetic tables, one for each operator, and their SQL where
SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, language_id, line_dedup, media, neighbours, ngram_jaccard, pii, quality, ranked_search, sentencepiece_codec, suffix_dedup, url_filter
from ._base import table

#: The tokenizer file, a parameter of the encoding queries.
TOKENIZER = "piece_bpe_32k.model"


def tokenizer_model(name: str = TOKENIZER) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def crc_slot(id_, n: int):
    """crc32 of the id as text, modulo n."""
    id_ = F.col(id_) if isinstance(id_, str) else id_
    return F.crc32(id_.cast("string")) % n


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.run(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_model(), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(sentencepiece_codec.ids_text(), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines.n_lines").alias("n_lines"), F.col("lines.n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.blocklist(spark)).select("page_id", "host", "path", "rule", "verdict")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.components(table(spark, sf_dir, "documents"), words=4, percent=85, links=True)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels, learn = table(spark, sf_dir, "labels"), lambda i: crc_slot(i, 5) != 0
    model = quality.fit(quality.sample(docs, labels, learn), quality.share(labels, learn))
    return quality.score(docs, model).select("doc_id", F.coalesce(crc_slot("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.to_media(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.sample(docs, crc_slot("doc_id", 4) != 2))
    return language_id.identify(docs, model).select("doc_id", F.coalesce(crc_slot("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_pii, op2_sentencepiece, op3_line_dedup, op4_url_filter, op5_ngram_jaccard, op6_decontaminate, op7_quality, op8_media, op9_language_id, op10_suffix_dedup)
    return {f.__name__: f for f in (*first, op11_hard_negatives, op12_nearest_neighbours, op13_ranked_search)}


#: Base kinds only: look-behinds, which the other kinds need, are not in this SQL's
#: patterns. The synthetic texts hold no span of another kind.
OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (SELECT * FROM (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 90, '(?i)\b(?:mail|e-mail|email|contact|write)\b'),
  (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 60, '(?i)\b(?:ip|host|server|address|login)\b'),
  (3, 'card', '[0-9](?:[ -]?[0-9])+', 80, '(?i)\b(?:card|credit|debit|visa|pay|paid)\b'),
  (4, 'phone', '\+[0-9][ ().0-9-]+[0-9]', 70, '(?i)\b(?:phone|call|tel|mobile|fax|whatsapp)\b')) k(o, kind, p, score, context)),
f AS (SELECT doc_id, t, o, kind, score, context,
      CASE o WHEN 1 THEN regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 2 THEN regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
             WHEN 3 THEN regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+') ELSE regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]') END AS m,
      CASE o WHEN 1 THEN string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 2 THEN string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
             WHEN 3 THEN string_split_regex(t, '[0-9](?:[ -]?[0-9])+') ELSE string_split_regex(t, '\+[0-9][ ().0-9-]+[0-9]') END AS p FROM t, kinds),
u AS (SELECT doc_id, t, o, kind, score, context, p, unnest(m) AS m, generate_subscripts(m, 1) AS i, m AS every FROM f WHERE len(m) > 0),
s AS (SELECT doc_id, t, o, kind, score, context, m, p[i + 1] AS after,
      CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(every[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM u),
ok AS (SELECT *, a + length(m) AS e FROM s WHERE CASE o WHEN 1 THEN true
      WHEN 2 THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0
      WHEN 3 THEN length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse(d), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) ELSE (CAST(x AS INT) * 2) % 10 + CAST(x AS INT) // 5 END)) % 10 = 0
      ELSE length(d) BETWEEN 8 AND 15 END),
g AS (SELECT *, least(100, score + CASE WHEN regexp_matches(right(left(t, a), 40) || ' ' || left(after, 40), context) THEN 35 ELSE 0 END) AS points FROM ok),
r AS (SELECT doc_id, count(*) FILTER (WHERE o = 1) AS n_email, count(*) FILTER (WHERE o = 2) AS n_ip, count(*) FILTER (WHERE o = 3) AS n_card, count(*) FILTER (WHERE o = 4) AS n_phone,
      string_agg(kind || ':' || a || ':' || e, ',' ORDER BY o, a) AS spans, string_agg(CAST(points AS VARCHAR), ',' ORDER BY o, a) AS scores FROM g GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, 0 AS n_iban, 0 AS n_ssn,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN r ON r.doc_id = t.doc_id
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(g.docs >= 3 AND k.doc_id < g.last, false) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
families AS (SELECT unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS family),
endings AS (SELECT unnest(['example.com', 'example.net', 'example.org']) AS ending),
numbers AS (SELECT unnest(range(0, 401)) AS n),
list AS (SELECT family || CASE WHEN n > 0 THEN '-' || n ELSE '' END || '.' || ending AS name FROM families, endings, numbers),
named AS (SELECT DISTINCT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h),
bad AS (SELECT DISTINCT host FROM named JOIN list ON list.name = array_to_string(string_split(host, '.')[i:], '.'))
SELECT page_id, r.host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
    WHEN bad.host IS NOT NULL THEN 'block'
    ELSE 'allow' END AS verdict
FROM r LEFT JOIN bad ON bad.host = r.host
"""

OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v, c = x.n AND c = y.n AS same FROM met JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, least(documents.doc_id, coalesce(o.least, documents.doc_id)) AS class_id, coalesce(o.n_links, 0) AS n_links
FROM documents JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
LEFT JOIN (SELECT u, count(*) AS n_links, min(v) FILTER (WHERE same) AS least FROM links GROUP BY u) o ON o.u = documents.doc_id
"""

OP6_SQL = r"""
WITH fold AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM item WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM win),
sizes AS (SELECT DISTINCT k FROM grams),
place AS (SELECT id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM fold, sizes WHERE len(w) >= k),
met AS (SELECT a.id, a.i, a.k, g.item_id FROM (SELECT id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM place) a JOIN grams g ON a.k = g.k AND a.g = g.g),
hit AS (SELECT id, count(DISTINCT pos) AS n FROM (SELECT id, unnest(range(i, i + k)) AS pos FROM met) GROUP BY id),
own AS (SELECT id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY id)
SELECT fold.id AS doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items,
       sha256(coalesce(own.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM fold LEFT JOIN hit ON hit.id = fold.id LEFT JOIN own ON own.id = fold.id
"""


OP10_SQL = r"""
WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM b WHERE n >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM late),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM runs
         UNION ALL SELECT b.doc_id, coalesce(max(e), 0), any_value(n) FROM b LEFT JOIN runs ON runs.doc_id = b.doc_id GROUP BY b.doc_id),
kept AS (SELECT b.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS h FROM gaps JOIN b ON b.doc_id = gaps.doc_id GROUP BY b.doc_id),
gone AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN gone ON gone.doc_id = b.doc_id
"""


OP11_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM held GROUP BY term),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, item.term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM item JOIN df ON df.term = item.term, c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN held ON held.term = q.term, c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_ngram_jaccard": OP5_SQL, "op6_decontaminate": OP6_SQL, "op10_suffix_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_ranked_search": OP13_SQL}
