"""Queries of the document-processing operators over the synthetic tables, and the
SQL they are held against.

Stand-ins: a source of documents is a book and a document a segment; a page is a
book's document and its url the path; a user turn and the assistant turn after it
are a segment and its translation; part names are nominated terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import index_pages as I
from .functions import text as T
from .operators import glossary as glossaries
from .operators import integrity, panel, probe, state, terms
from .plans import batching, blocks
from .sources import epub, trees
from .streaming import resume
from .tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- plans

PLAN_CHARS, PLAN_SEGMENTS = 18_000, 25

PLAN_SQL = f"""
WITH RECURSIVE r AS (SELECT source AS book, doc_id AS ord, CAST(length(coalesce(text, '')) AS BIGINT) AS chars,
                            row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
p AS (SELECT book, ord, chars, n, chars AS total, CAST(1 AS BIGINT) AS held, CAST(0 AS BIGINT) AS batch_id FROM r WHERE n = 1
      UNION ALL
      SELECT r.book, r.ord, r.chars, r.n,
             CASE WHEN p.total + 6 + r.chars > {PLAN_CHARS} OR p.held >= {PLAN_SEGMENTS} THEN r.chars ELSE p.total + 6 + r.chars END,
             CASE WHEN p.total + 6 + r.chars > {PLAN_CHARS} OR p.held >= {PLAN_SEGMENTS} THEN 1 ELSE p.held + 1 END,
             CASE WHEN p.total + 6 + r.chars > {PLAN_CHARS} OR p.held >= {PLAN_SEGMENTS} THEN p.batch_id + 1 ELSE p.batch_id END
      FROM p JOIN r ON r.book = p.book AND r.n = p.n + 1)
"""


@query(PLAN_SQL + "SELECT book, ord, chars, batch_id FROM p")
def batch_plan(spark, sf_dir):
    return batching.plan_batches(table(spark, sf_dir, "documents"), "source", "doc_id", "text", PLAN_CHARS, 6, PLAN_SEGMENTS)


@query(PLAN_SQL + "SELECT book, batch_id, count(*) AS segments, CAST(sum(chars) + (count(*) - 1) * 6 AS BIGINT) AS chars, min(ord) AS first_ord, max(ord) AS last_ord FROM p GROUP BY ALL")
def batch_summary(spark, sf_dir):
    return batching.batch_summary(batch_plan(spark, sf_dir), 6)


@query("""
WITH RECURSIVE k AS (SELECT p_brand AS book, p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name), '-', ' '), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS key FROM part),
h AS (SELECT book, min(p_partkey) AS ord, split_part(regexp_replace(key, '^(the|a|an) ', ''), ' ', 1) AS head, CAST(sum(length(key) + 2) AS BIGINT) AS size FROM k GROUP BY book, head),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ord) AS n FROM h),
p AS (SELECT *, size AS total, CAST(0 AS BIGINT) AS chunk_id FROM r WHERE n = 1
      UNION ALL SELECT r.*, CASE WHEN p.total + r.size > 100000 THEN r.size ELSE p.total + r.size END, CASE WHEN p.total + r.size > 100000 THEN p.chunk_id + 1 ELSE p.chunk_id END
      FROM p JOIN r ON r.book = p.book AND r.n = p.n + 1)
SELECT book, ord, head, size, chunk_id FROM p
""")
def head_word_chunks(spark, sf_dir):
    key = T.term_key(F.col("p_name"))
    full = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower("p_name"), F.lit("-"), F.lit(" ")), "[^a-z0-9 ]", ""), " +", " "))
    groups = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), "p_partkey", F.substring_index(key, " ", 1).alias("head"), F.length(full).alias("n"))
    return batching.head_word_chunks(groups.groupBy("book", "head").agg(F.min("p_partkey").alias("ord"), F.sum(F.col("n") + 2).cast("bigint").alias("size")), 100_000)


# ---------------------------------------------------------------- state


@query("SELECT doc_id, source, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def pending_segments(spark, sf_dir):
    return state.pending(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def resume_left_join(spark, sf_dir):
    return state.restored(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') USING (o_orderkey)")
def unknown_state(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.unknown_state(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), returned, "o_orderkey")


@query("SELECT CAST(sum(length(text)) AS BIGINT) AS all_chars, CAST(coalesce(sum(length(text)) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)), 0) AS BIGINT) AS remaining_chars FROM documents")
def total_chars(spark, sf_dir):
    docs = state.restored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("done")).distinct(), "doc_id")
    return docs.agg(F.sum(F.length("text")).cast("bigint").alias("all_chars"), F.coalesce(F.sum(F.when(F.col("done").isNull(), F.length("text"))), F.lit(0)).cast("bigint").alias("remaining_chars"))


@query("SELECT md5(text) AS text_md5, count(*) AS times FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return state.duplicates(table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


@query("""
WITH a AS (SELECT user_id, event_type, value, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_type, event_id FROM a WHERE r = 1
""")
def state_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("version"))
    old, new = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    return state.upsert(old, new, "user_id", "version").drop("version")


IDENTITY_FIELDS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query(f"""
WITH a AS (SELECT o_custkey AS run, arg_min((o_custkey, o_orderstatus, o_orderpriority), o_orderkey) AS s, arg_max((o_custkey, o_orderstatus, o_orderpriority), o_orderkey) AS e FROM orders GROUP BY o_custkey),
f AS (SELECT run, unnest({IDENTITY_FIELDS}) AS field, unnest([CAST(s[1] AS VARCHAR), CAST(s[2] AS VARCHAR), CAST(s[3] AS VARCHAR)]) AS stored, unnest([CAST(e[1] AS VARCHAR), CAST(e[2] AS VARCHAR), CAST(e[3] AS VARCHAR)]) AS expected FROM a)
SELECT run, field, stored, expected, field = 'o_orderstatus' AS hard FROM f WHERE stored IS DISTINCT FROM expected""")
def identity_diff(spark, sf_dir):
    """Each customer's first order against the last: which fields differ."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", *IDENTITY_FIELDS)
    side = lambda pick: rows.groupBy("run").agg(pick(F.struct(*IDENTITY_FIELDS), F.col("o_orderkey")).alias("x")).select("run", "x.*")
    return state.identity_diff(side(F.min_by), side(F.max_by), ["o_orderstatus"], "run")


@query("""
WITH e AS (SELECT conv_id, max(turn) AS n FROM conversations WHERE turn > 0 GROUP BY conv_id),
w AS (SELECT conv_id, unnest(range(1, n + 1)) AS turn FROM e),
g AS (SELECT conv_id, turn, count(*) AS times FROM conversations WHERE role <> 'system' GROUP BY ALL),
b AS (SELECT coalesce(w.conv_id, g.conv_id) AS conv_id, w.turn AS wanted, g.times FROM w FULL JOIN g ON w.conv_id = g.conv_id AND w.turn = g.turn)
SELECT conv_id, count(*) FILTER (WHERE times IS NULL) AS missing, count(*) FILTER (WHERE wanted IS NULL) AS extra, count(*) FILTER (WHERE times > 1) AS repeated FROM b GROUP BY conv_id
""")
def reply_id_check(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    expected = turns.filter("turn > 0").groupBy("conv_id").agg(F.max("turn").alias("n"))
    return state.reply_ids(expected, turns.filter("role <> 'system'"), "conv_id", "turn")


@query("SELECT user_id, CASE WHEN count(*) = count(v) THEN CAST(sum(v) AS BIGINT) END AS tokens FROM (SELECT user_id, CASE WHEN event_type <> 'error' AND event_id % 50 <> 0 THEN event_id END AS v FROM events) GROUP BY user_id")
def strict_token_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.when((F.col("event_type") != "error") & (F.col("event_id") % 50 != 0), F.col("event_id")).alias("v"))
    return rows.groupBy("user_id").agg(state.strict_sum(F.col("v")).alias("tokens"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS models FROM events GROUP BY user_id")
def distinct_models(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(state.distinct_sorted("event_type"), ",").alias("models"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'running' WHEN event_id % 5 = 0 THEN 'finished' WHEN event_id % 5 = 1 THEN 'stopped' WHEN event_id % 5 = 2 THEN 'failed' ELSE 'ended' END AS state FROM events")
def run_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, 0).when(F.col("event_id") % 5 == 1, -2).when(F.col("event_id") % 5 == 2, 1).alias("code"))
    return rows.select("event_id", state.run_state(F.col("code"), F.lit(None), F.col("event_id") % 7 == 0).alias("state"))


SAMPLED = 5


@query(f"""
WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM documents),
k AS (SELECT *, (c * 3) // {SAMPLED} AS x, (c * 4) // {SAMPLED} AS y FROM n),
p AS (SELECT *, CASE WHEN x IN (0, c // 2, c - 1) THEN x + 1 ELSE x END AS p3 FROM k),
q AS (SELECT *, CASE WHEN p3 < c AND p3 NOT IN (0, c // 2, c - 1) THEN p3 END AS q3 FROM p),
r AS (SELECT *, CASE WHEN q3 IS NOT NULL THEN CASE WHEN y IN (0, c // 2, c - 1, q3) THEN y + 1 ELSE y END END AS p4 FROM q),
t AS (SELECT *, CASE WHEN p4 < c AND p4 NOT IN (0, c // 2, c - 1, q3) THEN p4 END AS q4 FROM r)
SELECT source, doc_id FROM t WHERE c <= {SAMPLED} OR i IN (0, c // 2, c - 1) OR i = q3 OR i = q4
""")
def head_mid_tail_sample(spark, sf_dir):
    return state.head_middle_tail(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", SAMPLED)


@query(r"""SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 10 + doc_id % 50 WHEN 1 THEN doc_id % 7 WHEN 2 THEN 3 ELSE TRY_CAST(coalesce(nullif(regexp_extract(text, '"retryDelay":\s*"(\d+)s"', 1), ''), nullif(regexp_extract(text, '(?i)retry after (\d+)', 1), '')) AS BIGINT) END AS BIGINT) AS seconds FROM documents""")
def retry_after(spark, sf_dir):
    n, s = F.col("doc_id"), lambda x: x.cast("string")
    message = (
        F.when(n % 4 == 0, F.concat(F.lit('{"error": {"retryDelay": "'), s(10 + n % 50), F.lit('s"}} retry after 99')))
        .when(n % 4 == 1, F.concat(F.lit("Quota is used up. Please Retry After "), s(n % 7), F.lit(" seconds")))
        .when(n % 4 == 2, F.lit("retry in 5s, or retry after 3.5 s"))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.retry_after(message).alias("seconds"))


# ---------------------------------------------------------------- probe


def turn_pairs(spark, sf_dir) -> DataFrame:
    """Each user turn with the turn after it, when that is the assistant's."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("source"), F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("target"))
    return rows.filter("role = 'user' and next = 'assistant'").select("conv_id", "turn", "source", "target")


PAIRS_SQL = """WITH l AS (SELECT conv_id, turn, role, text AS source, lead(role) OVER w AS next, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, coalesce(source, '') AS source, coalesce(target, '') AS target FROM l WHERE role = 'user' AND next = 'assistant')
"""
PROBE_SQL = PAIRS_SQL + """, s AS (SELECT *, regexp_replace(target, '^\\s+|\\s+$', '', 'g') AS t FROM pairs),
m AS (SELECT *, length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS cjk, greatest(length(t) - length(regexp_replace(t, '[^A-Za-z]', '', 'g')), 1) AS base FROM s),
checks AS (
  SELECT conv_id, turn, source, target, 'empty_output' AS "check" FROM m WHERE t = ''
  UNION ALL SELECT conv_id, turn, source, target, 'length_ratio' FROM m WHERE t <> '' AND length(source) >= 20 AND (length(target) / length(source) < 0.15 OR length(target) / length(source) > 2.0)
  UNION ALL SELECT conv_id, turn, source, target, 'cjk_density' FROM m WHERE t <> '' AND length(source) >= 40 AND cjk / base < 0.30
    AND NOT regexp_matches(source, '(?i)https?://|www\\.|\\.com\\b|\\.org\\b|\\.net\\b|\\.co\\.\\w{2}\\b|@\\w|©|ISBN\\b|First\\s+published\\b'))
"""


@query(PROBE_SQL + """SELECT conv_id, turn, "check", CASE WHEN length(source) > 120 THEN left(source, 120) || '...' ELSE source END AS source_excerpt, CASE WHEN length(target) > 120 THEN left(target, 120) || '...' ELSE target END AS target_excerpt FROM checks""")
def sanity_probe(spark, sf_dir):
    return probe.sanity_warnings(turn_pairs(spark, sf_dir)).drop("source", "target", "detail")


@query(PROBE_SQL + """SELECT "check", count(*) AS warnings, count(DISTINCT conv_id) AS conversations FROM checks GROUP BY 1""")
def sanity_summary(spark, sf_dir):
    return probe.sanity_warnings(turn_pairs(spark, sf_dir)).groupBy("check").agg(F.count("*").alias("warnings"), F.countDistinct("conv_id").alias("conversations"))


@query("""
WITH d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS cjk, greatest(length(t) - length(regexp_replace(t, '[^A-Za-z]', '', 'g')), 1) AS base FROM d
""")
def cjk_density(spark, sf_dir):
    stripped = F.regexp_replace("text", r"^\s+|\s+$", "")
    base = F.greatest(F.length(stripped) - F.length(F.regexp_replace(stripped, "[^A-Za-z]", "")), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", T.cjk_count(stripped).cast("bigint").alias("cjk"), base.cast("bigint").alias("base"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS excerpt FROM documents")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


# ---------------------------------------------------------------- pages


@query("SELECT page_id, trim(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS plain FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


LINES_SQL = """WITH l AS (SELECT page_id, regexp_replace(unnest(string_split(regexp_replace(html, '<[^>]+>', chr(10), 'g'), chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM pages)"""


@query(LINES_SQL + " SELECT page_id, line FROM l WHERE line <> ''")
def candidate_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.candidate_lines(F.col("html"))).alias("line"))


#: Each document as a page: odd lines are paragraphs, even ones items of a list that hold
#: a paragraph and bold text. Of every fourth document the page is not well-formed.
PAGE_SQL = """WITH t AS (SELECT doc_id, string_split(replace(replace(replace(regexp_replace(text, '[^\\x20-\\x7E\\xA0-\\x{D7FF}\\n]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
plain AS (SELECT doc_id, generate_subscripts(l, 1) AS i, trim(regexp_replace(unnest(l), '[\\s\\xA0]+', ' ', 'g')) AS x FROM t),
line AS (SELECT doc_id, i, replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS own, x FROM plain WHERE x <> ''),
"""


def document_pages(spark, sf_dir) -> DataFrame:
    blocks.small_batches(spark)
    clean = F.regexp_replace("text", r"[^\x20-\x7E\x{A0}-\x{D7FF}\n]", "")
    escaped = F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    boxed = lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("<p>"), x, F.lit("</p>"))).otherwise(F.concat(F.lit("<ul><li><p>"), x, F.lit("</p><b>!</b></li></ul>")))
    end = F.when(F.col("doc_id") % 4 == 0, "<br></body>").otherwise("</body>")
    page = F.concat(F.lit("<body><h4>no line</h4>"), F.array_join(F.transform(F.split(escaped, "\n", -1), boxed), ""), end)
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", page.alias("html"))


@query(PAGE_SQL + """w AS (SELECT doc_id, own AS line FROM line WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, trim(coalesce(x, '') || '!') FROM (SELECT plain.doc_id, plain.i, line.own AS x FROM plain LEFT JOIN line ON line.doc_id = plain.doc_id AND line.i = plain.i) WHERE i % 2 = 0 AND doc_id % 4 <> 0
  UNION ALL SELECT doc_id, x FROM line WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, '!' FROM plain WHERE i % 2 = 0 AND doc_id % 4 = 0 UNION ALL SELECT DISTINCT doc_id, 'no line' FROM plain WHERE doc_id % 4 = 0)
SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM w GROUP BY doc_id""")
def tag_lines(spark, sf_dir):
    lines = document_pages(spark, sf_dir).select("doc_id", F.explode(trees.page_lines(F.col("html"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length(T.collapse(F.regexp_replace("line", "\u00a0", " ")))).alias("chars"))


@query(PAGE_SQL + """n AS (SELECT doc_id, i FROM plain WHERE i % 2 = 0 AND doc_id % 4 <> 0)
SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(coalesce(own, ''))) AS BIGINT) AS chars FROM n LEFT JOIN line USING (doc_id, i) GROUP BY doc_id""")
def list_paragraphs(spark, sf_dir):
    """Paragraphs inside list items: nodes that lie in others, by a join of intervals."""
    nodes = trees.nodes(document_pages(spark, sf_dir), "doc_id", "html")
    outer, inner = nodes.filter("tag = 'li'").alias("o"), nodes.filter("tag = 'p'").alias("i")
    both = outer.join(inner, trees.inside("o", "i", "doc_id"))
    return both.groupBy(F.col("o.doc_id").alias("doc_id")).agg(F.count("*").alias("paragraphs"), F.sum(F.length("i.text")).alias("chars"))


ENTRY = r"[A-Za-z0-9].{1,160},\s*(?:\d{1,4}(?:[-–]\d{1,4})?|[♣♦•·*†‡§¶])(?:\s*,\s*(?:\d{1,4}(?:[-–]\d{1,4})?|[♣♦•·*†‡§¶]))*"
SCORE_SQL = f"""WITH s AS (SELECT page_id, url,
  CASE WHEN regexp_matches(lower(url), '(?:^|/)(?:index|glossary|idx|ix\\d+)') THEN 25 ELSE 0 END
  + CASE WHEN regexp_matches(html, '(?i)(?:epub:|data-)type="(?:index|glossary)"|role="doc-index"') THEN 40 ELSE 0 END
  + CASE WHEN regexp_matches(html, '(?i)class="[^"]*\\b(?:index|glossary|idx|searchable-terms)\\b[^"]*"') THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(html, '(?i)id="(?:index|glossary)[-_a-z0-9]*"') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(html, '(?i)<h[1-6][^>]*>\\s*(?:index|glossary|searchable terms|terminology)\\s*</h[1-6]>') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '(?i){ENTRY}') THEN 20 ELSE 0 END AS total FROM pages)
"""


@query(SCORE_SQL + "SELECT page_id, total, total >= 35 AS strong FROM s")
def index_signal_score(spark, sf_dir):
    total, _ = I.score(F.col("url"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", total.cast("int").alias("total")).withColumn("strong", F.col("total") >= I.STRONG)


@query(SCORE_SQL + "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, arg_max(page_id, (total, -page_id)) AS page_id, max(total) AS total FROM s GROUP BY 1")
def best_index_doc(spark, sf_dir):
    total, _ = I.score(F.col("url"), F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), total.cast("int").alias("total"))
    return rows.groupBy("host").agg(F.max_by("page_id", F.struct("total", -F.col("page_id"))).alias("page_id"), F.max("total").alias("total"))


@query(f"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS line FROM documents),
e AS (SELECT doc_id, line <> '' AND length(line) BETWEEN 4 AND 180 AND len(string_split(line, ' ')) <= 16 AND regexp_matches(line, '^{ENTRY}$') AS hit FROM l WHERE line <> '')
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE hit) AS entries FROM e GROUP BY doc_id""")
def index_like_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(T.collapse(F.col("line")) != "")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(I.is_entry(F.col("line"))).alias("entries"))


@query("SELECT page_id, regexp_matches(lower(url), 'index|idx|glossary') AS index_path, regexp_matches(lower(regexp_extract(url, '[^/]*$')), 'toc|contents') AS toc_name, regexp_matches(lower(left(html, 500)), '\\[ a \\]\\[ b \\]') AS alphabet_bar FROM pages")
def page_path_hints(spark, sf_dir):
    url, html = F.col("url"), F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", I.is_index_path(url).alias("index_path"), I.is_toc_name(url).alias("toc_name"), I.has_alphabet_bar(html).alias("alphabet_bar"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages), p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS href FROM pages)
SELECT href, count(*) AS links FROM h WHERE href NOT IN (SELECT href FROM p) GROUP BY href""")
def broken_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = integrity.hrefs(pages, "page_id", "html").groupBy("href").agg(F.count("*").alias("links"))
    return integrity.missing(links, pages.select(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("href")), "href")


@query("""SELECT DISTINCT l_partkey AS asset FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0)""")
def missing_assets(spark, sf_dir):
    """Parts that line items name, against the parts on stock."""
    named = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset")).distinct()
    return integrity.missing(named, table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("asset")), "asset")


@query()
def block_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(epub.page_segments("html")).alias("s"))
    return rows.select("page_id", "s.idx", "s.tag_name", "s.text")


# ---------------------------------------------------------------- terms


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS c FROM documents)
SELECT doc_id, CASE WHEN i <= greatest(1, c // 10) THEN 'front' WHEN i > c - greatest(1, c // 10) THEN 'back' ELSE 'body' END AS label,
       CASE WHEN i <= greatest(1, c // 10) THEN 1.5::DOUBLE WHEN i > c - greatest(1, c // 10) THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM n""")
def position_label(spark, sf_dir):
    return terms.position_labels(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").drop("source")


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in terms.STOPWORDS) + ")"
TITLE_SQL = f"""WITH w AS (SELECT DISTINCT doc_id, source, trim(unnest(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')), '.,;:!?"()[]{{}}') AS term FROM documents),
t AS (SELECT * FROM w WHERE regexp_matches(term, '^[A-Z][a-z]+$') AND lower(term) NOT IN {STOP_SQL})
"""


@query(TITLE_SQL + "SELECT term, count(*) AS frequency, count(DISTINCT source) AS sources FROM t GROUP BY term ORDER BY count(*) DESC, term LIMIT 300")
def local_candidates_single(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.explode(terms.title_words(F.col("text"))).alias("term"))
    out = rows.groupBy("term").agg(F.count("*").alias("frequency"), F.countDistinct("source").alias("sources"))
    return out.orderBy(F.desc("frequency"), "term").limit(300)  # the feature: the 300 best


@query()
def local_candidates_full(spark, sf_dir):
    blocks = terms.position_labels(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "doc_id")
    return terms.rank_candidates(blocks, terms.phrases("text")).withColumn("sources", F.array_join("sources", ","))


@query("SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(p_name), '-', ' '), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), '^(the|a|an) ', '') AS term_key FROM part")
def term_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.term_key(F.col("p_name")).alias("term_key"))


def nominations(spark, sf_dir) -> DataFrame:
    """Three vendors nominate the title-case words of their documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(terms.title_words(F.col("text"))).alias("term"))
    vendor = (F.col("doc_id") % 3).cast("int")
    return rows.select(F.concat(F.lit("v"), vendor.cast("string")).alias("vendor"), vendor.alias("vendor_ord"), F.struct("doc_id", "term").alias("entry_ord"), "term", F.concat(F.lower("term"), F.lit("-"), (F.col("doc_id") % 5).cast("string")).alias("translation"), F.lit("high").alias("priority"))


MERGE_SQL = TITLE_SQL + """, n AS (SELECT doc_id % 3 AS vendor, doc_id, term, lower(term) AS key FROM t),
g AS (SELECT key, arg_min(term, (vendor, doc_id, term)) AS term, count(DISTINCT vendor) AS n_vendors, min((vendor, doc_id, term)) AS first FROM n GROUP BY key)
"""


@query(MERGE_SQL + "SELECT row_number() OVER (ORDER BY n_vendors DESC, first) AS id, key, term, n_vendors FROM g")
def merge_nominations(spark, sf_dir):
    return panel.merge_nominations(nominations(spark, sf_dir))


@query(MERGE_SQL + "SELECT key, term, n_vendors FROM g ORDER BY n_vendors DESC, key LIMIT 100")
def glossary_cap(spark, sf_dir):
    entries = panel.merge_nominations(nominations(spark, sf_dir)).withColumns({"tier": F.lit("preferred"), "priority": F.lit("high")})
    return terms.glossary_cap(entries, 100).select("key", "term", "n_vendors")  # the feature: a cap of 100 terms


GLOSSARY = [("the", "the/The", ["that"], None), ("and", "and", ["ing", "an"], None), ("est", "est", None, None), ("der", "die", ["das"], None), ("of the", "of", ["the"], None), ("que", "que", [], None)]


def glossary(spark) -> DataFrame:
    rows = [(*entry, i) for i, entry in enumerate(GLOSSARY)]
    return spark.createDataFrame(rows, "term string, suggested_translation string, alternatives array<string>, tier string, ord long")


@query(PAIRS_SQL + """, g(term, o) AS (VALUES ('the', ['the/The', 'that', 'The', 'the']), ('and', ['and', 'ing', 'an']), ('est', ['est']), ('der', ['das', 'die']), ('of the', ['the', 'of']), ('que', ['que'])),
h AS (SELECT g.term, g.o, p.target FROM pairs p JOIN g ON regexp_matches(p.source, '(?i)(^|[^\\p{L}\\p{N}_])' || replace(g.term, ' ', '\\s+') || '([^\\p{L}\\p{N}_]|$)')),
u AS (SELECT term, CASE WHEN len(o) > 0 THEN strpos(target, o[1]) > 0 END AS a, o, target FROM h),
x AS (SELECT term, len(list_filter(o, lambda z: strpos(target, z) > 0)) = 0 AS none FROM u)
SELECT g.term, count(x.none) AS segments, count(*) FILTER (WHERE x.none) AS missing FROM g LEFT JOIN x USING (term) GROUP BY g.term""")
def term_usage(spark, sf_dir):
    return terms.term_usage(turn_pairs(spark, sf_dir), glossary(spark)).select("term", "segments", "missing")


USAGE_SQL = PAIRS_SQL + """, g(ord, term, translation, parts, o) AS (VALUES
  (0, 'the', 'the/The', ['the', 'The', 'that'], ['the/The', 'that', 'The', 'the']), (1, 'and', 'and', ['and', 'ing', 'an'], ['and', 'ing', 'an', NULL]), (2, 'est', 'est', ['est'], ['est', NULL, NULL, NULL]),
  (3, 'der', 'die', ['die', 'das'], ['das', 'die', NULL, NULL]), (4, 'of the', 'of', ['of', 'the'], ['the', 'of', NULL, NULL]), (5, 'que', 'que', ['que'], ['que', NULL, NULL, NULL])),
h AS (SELECT g.term, g.o, coalesce(p.target, '') AS r0 FROM pairs p JOIN g ON regexp_matches(p.source, '(?i)(^|[^\\p{L}\\p{N}_])' || replace(g.term, ' ', '\\s+') || '([^\\p{L}\\p{N}_]|$)')),
r AS (SELECT *, replace(r2, coalesce(o[3], chr(1)), '') AS r3 FROM (SELECT *, replace(r1, coalesce(o[2], chr(1)), '') AS r2 FROM (SELECT *, replace(r0, o[1], '') AS r1 FROM h))),
u AS (SELECT term, list_filter([CASE WHEN strpos(r0, o[1]) > 0 THEN o[1] END, CASE WHEN strpos(r1, o[2]) > 0 THEN o[2] END, CASE WHEN strpos(r2, o[3]) > 0 THEN o[3] END, CASE WHEN strpos(r3, o[4]) > 0 THEN o[4] END], lambda x: x IS NOT NULL) AS used FROM r),
n AS (SELECT term, opt, count(*) AS n FROM (SELECT term, unnest(used) AS opt FROM u) GROUP BY ALL),
s AS (SELECT term, count(*) AS segments, count(*) FILTER (WHERE len(used) = 0) AS missing FROM u GROUP BY term),
shown AS (SELECT ord, term, unnest(parts) AS opt, generate_subscripts(parts, 1) AS i FROM g UNION ALL SELECT ord, g.term, translation, 99 FROM g JOIN n ON n.term = g.term AND n.opt = translation WHERE NOT list_contains(parts, translation)),
c AS (SELECT shown.term, '{' || string_agg('"' || shown.opt || '":' || coalesce(n.n, 0), ',' ORDER BY i) || '}' AS option_counts, count(n.n) AS used FROM shown LEFT JOIN n ON n.term = shown.term AND n.opt = shown.opt GROUP BY shown.term),
w AS (SELECT ord, g.term, translation, coalesce(segments, 0) AS segments, option_counts, coalesce(missing, 0) AS missing, coalesce(missing, 0) = 0 AND c.used <= 1 AS consistent FROM g JOIN c USING (term) LEFT JOIN s USING (term))
"""


@query(USAGE_SQL + "SELECT row_number() OVER (ORDER BY consistent, ord) AS place, term, translation, segments, option_counts, missing, consistent FROM w")
def term_usage_options(spark, sf_dir):
    """In the order of the report: inconsistent terms first, each group in the glossary's order."""
    out = terms.term_usage(turn_pairs(spark, sf_dir), glossary(spark)).withColumn("option_counts", F.to_json("option_counts"))
    return out.select(F.row_number().over(W.orderBy("consistent", "ord")).cast("bigint").alias("place"), "term", "translation", "segments", "option_counts", "missing", "consistent")  # a glossary's few rows


@query(USAGE_SQL + """SELECT '{"summary":{"terms":' || count(*) || ',"inconsistent":' || count(*) FILTER (WHERE NOT consistent) || '},"terms":[' || string_agg('{"term":"' || term || '","translation":"' || translation || '","segments":' || segments || ',"option_counts":' || option_counts || ',"missing":' || missing || ',"consistent":' || consistent || '}', ',' ORDER BY consistent, ord) || ']}' AS json FROM w""")
def usage_report(spark, sf_dir):
    return glossaries.usage_report(terms.term_usage(turn_pairs(spark, sf_dir), glossary(spark)))


PAIR_WORDS = """w AS (SELECT *, string_split_regex(trim(text), '\\s+') AS w FROM {table}),
p AS (SELECT *, lower(regexp_extract(w[i], '[\\p{{L}}\\p{{N}}_]+$')) AS a, lower(regexp_extract(w[i + 1], '^[\\p{{L}}\\p{{N}}_]+')) AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w))"""


@query(f"""WITH t AS (WITH {PAIR_WORDS.format(table="conversations")} SELECT DISTINCT a || ' ' || b AS term FROM p WHERE a <> '' AND b <> ''),
d AS (WITH {PAIR_WORDS.format(table="documents")} SELECT DISTINCT doc_id, a || ' ' || b AS term FROM p WHERE a <> '' AND b <> '')
SELECT term, count(*) AS documents FROM t JOIN d USING (term) GROUP BY term""")
def shared_phrases(spark, sf_dir):
    """All pairs of words of the conversations, sought in all documents at once."""
    said = table(spark, sf_dir, "conversations").select(F.explode(terms.word_pairs(F.col("text"))).alias("term")).distinct()
    return terms.count_pairs(table(spark, sf_dir, "documents"), "text", said).withColumnRenamed("texts", "documents")


SENTENCE_TERMS = ["the", "Leaux", "heion", "est une", "thing"]


@query(r"""WITH terms(term) AS (VALUES ('the'), ('Leaux'), ('heion'), ('est une'), ('thing')),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS n FROM documents),
e AS (SELECT term, doc_id, n, sentence, CASE WHEN length(sentence) > 400 THEN length(regexp_extract(sentence, '(?i)^((?:.*?[^\p{L}\p{N}_])??)' || replace(term, ' ', '[\s-]+') || '(?:s|es)?(?:[^\p{L}\p{N}_]|$)', 1)) ELSE 0 END AS pos
      FROM (SELECT * FROM s JOIN terms ON strpos(lower(sentence), lower(split_part(term, ' ', 1))) > 0) WHERE regexp_matches(sentence, '(?i)(?:^|[^\p{L}\p{N}_])' || replace(term, ' ', '[\s-]+') || '(?:s|es)?(?:[^\p{L}\p{N}_]|$)')),
st AS (SELECT term, list_filter(list_transform(string_split(term, ' '), lambda w: CASE WHEN length(w) >= 4 THEN left(lower(w), greatest(4, length(w) - 3)) END), lambda w: w IS NOT NULL) AS stems FROM terms WHERE term NOT IN (SELECT term FROM e)),
l AS (SELECT term, doc_id, n, sentence, strpos(lower(sentence), stems[1]) - 1 AS pos FROM s JOIN st ON len(stems) > 0 AND len(list_filter(stems, lambda w: strpos(lower(sentence), w) = 0)) = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY term, doc_id ORDER BY n) AS r FROM (SELECT * FROM e UNION ALL SELECT * FROM l)),
k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY r > 1, doc_id, n) AS rank, greatest(0, least(pos - 180, length(sentence) - 400)) AS start FROM a)
SELECT term, rank, CASE WHEN length(sentence) <= 400 THEN sentence ELSE (CASE WHEN start > 0 THEN '…' ELSE '' END) || substr(sentence, start + 1, 400) || (CASE WHEN start + 400 < length(sentence) THEN '…' ELSE '' END) END AS sentence
FROM k WHERE rank <= 3""")
def select_sentences(spark, sf_dir):
    wanted = spark.createDataFrame([(t,) for t in SENTENCE_TERMS], "term string")
    return terms.select_sentences(table(spark, sf_dir, "documents"), "doc_id", "text", wanted)


# ---------------------------------------------------------------- panel
# Orders are candidates, their priority decides what the three judges say; a vendor
# nominates every candidate whose key it divides.

CANDIDATES_SQL = """WITH c AS (SELECT o_orderkey AS id, o_custkey, CAST(left(o_orderpriority, 1) AS INT) AS p FROM orders),
ven AS (SELECT id, 'v' || v AS vendor, v AS vendor_ord FROM c, (VALUES (0), (1), (2)) t(v) WHERE (id // 4) % (v + 2) = 0 OR v = id % 3),
vote AS (SELECT id, 'v' || v AS judge, v AS judge_ord, (p + v) % 2 = 0 AS keep, 't' || ((p * (v + 1)) % 3) AS translation, CASE WHEN p < 4 THEN 'fixed' ELSE 'preferred' END AS enforce FROM c, (VALUES (0), (1)) t(v) WHERE (o_custkey + v) % 5 <> 0),
own AS (SELECT id, min(vendor) AS v0, max(vendor) AS v1 FROM ven GROUP BY id)
"""


def panel_tables(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("p"))
    v = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v")
    name = F.concat(F.lit("v"), F.col("v").cast("string"))
    vendors = c.select("id", v).filter("(id div 4) % (v + 2) = 0 or v = id % 3").select("id", name.alias("vendor"), F.col("v").alias("vendor_ord"))
    votes = c.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).filter("(o_custkey + v) % 5 <> 0")
    votes = votes.select(
        "id", name.alias("judge"), F.col("v").alias("judge_ord"), ((F.col("p") + F.col("v")) % 2 == 0).alias("keep"), F.concat(F.lit("t"), ((F.col("p") * (F.col("v") + 1)) % 3).cast("string")).alias("translation"), F.when(F.col("p") < 4, "fixed").otherwise("preferred").alias("enforce"), "o_custkey"
    )
    judges = spark.createDataFrame([("v0", 0), ("v1", 1)], "judge string, judge_ord int")
    return c.select("id"), vendors, votes, judges


TALLY_SQL = CANDIDATES_SQL + """, n AS (SELECT id, count(*) FILTER (WHERE keep AND NOT (v0 = judge AND v1 = judge)) AS keeps, count(*) FILTER (WHERE NOT keep) AS drops FROM vote JOIN own USING (id) GROUP BY id),
tally AS (SELECT c.id, coalesce(keeps, 0) AS keeps, coalesce(drops, 0) AS drops, coalesce(drops, 0) <= coalesce(keeps, 0) AS kept FROM c LEFT JOIN n USING (id))
"""


@query(TALLY_SQL + "SELECT id, keeps, drops, kept FROM tally")
def vote_tally(spark, sf_dir):
    candidates, vendors, votes, _ = panel_tables(spark, sf_dir)
    return panel.tallies(candidates, vendors, votes)


WIN_SQL = TALLY_SQL + """, kept AS (SELECT id FROM tally WHERE kept),
prop AS (SELECT id, vendor, vendor_ord, 't' || (vendor_ord % 2) AS translation FROM ven SEMI JOIN kept USING (id)),
cast_ AS (SELECT * FROM vote SEMI JOIN kept USING (id)),
strong AS (SELECT id, translation, 0 AS k, judge_ord AS pos FROM cast_ WHERE keep UNION ALL SELECT id, translation, 1, vendor_ord FROM prop WHERE vendor NOT IN ('v0', 'v1')),
src AS (SELECT * FROM strong UNION ALL SELECT id, translation, 2, vendor_ord FROM prop WHERE id NOT IN (SELECT id FROM strong)),
cnt AS (SELECT id, translation, count(*) AS n, min((k, pos)) AS first FROM src GROUP BY id, translation),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS r FROM cnt),
top AS (SELECT id, max(translation) FILTER (WHERE r = 1) AS t1, max(n) FILTER (WHERE r = 1) AS n1, max(n) FILTER (WHERE r = 2) AS n2 FROM rk GROUP BY id),
bias AS (SELECT judge, judge_ord, count(*) FILTER (WHERE v0 = judge AND v1 = judge) AS ov, count(*) FILTER (WHERE keep AND v0 = judge AND v1 = judge) AS ok, count(*) FILTER (WHERE NOT (v0 = judge AND v1 = judge)) AS xv, count(*) FILTER (WHERE keep AND NOT (v0 = judge AND v1 = judge)) AS xk FROM vote JOIN own USING (id) GROUP BY ALL),
ties AS (SELECT judge, row_number() OVER (ORDER BY NOT (ov >= 10 AND xv > 0), CASE WHEN ov >= 10 AND xv > 0 THEN round(greatest(0.0, ok / ov - xk / xv), 4) ELSE 0 END, judge_ord) AS tie_rank FROM bias),
jd AS (SELECT id, arg_min(translation, tie_rank) AS bj FROM cast_ JOIN ties USING (judge) GROUP BY id),
vn AS (SELECT id, arg_min(translation, vendor_ord) AS bv FROM prop GROUP BY id),
ag AS (SELECT id, count(DISTINCT translation) AS texts, min(translation) AS txt, bool_and(enforce = 'fixed') AS allf FROM cast_ WHERE keep GROUP BY id),
ch AS (SELECT top.id, CASE WHEN n1 = n2 THEN coalesce(bj, bv) ELSE t1 END AS translation FROM top LEFT JOIN jd USING (id) LEFT JOIN vn USING (id)),
win AS (SELECT ch.id, ch.translation, coalesce(cnt.n, 0) AS sources,
        CASE WHEN coalesce(cnt.n, 0) >= 2 AND (ag.id IS NULL OR (texts = 1 AND txt = ch.translation AND allf)) THEN 'fixed' ELSE 'preferred' END AS tier
        FROM ch LEFT JOIN cnt ON cnt.id = ch.id AND cnt.translation = ch.translation LEFT JOIN ag ON ag.id = ch.id)
"""


def winners(spark, sf_dir) -> DataFrame:
    candidates, vendors, votes, judges = panel_tables(spark, sf_dir)
    proposed = vendors.withColumns({"prop_ord": F.lit(0), "translation": F.concat(F.lit("t"), (F.col("vendor_ord") % 2).cast("string"))})
    ties = panel.tie_break_order(panel.self_preference(candidates, vendors, votes, judges))
    return panel.elect(candidates, proposed, votes, judges, ties)


@query(WIN_SQL + "SELECT id, translation, sources FROM win")
def vote_winner(spark, sf_dir):
    return winners(spark, sf_dir).select("id", "translation", "sources")


@query(WIN_SQL + "SELECT tier, count(*) AS terms, CAST(sum(sources) AS BIGINT) AS sources FROM win GROUP BY tier")
def vote_tier(spark, sf_dir):
    return winners(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("terms"), F.sum("sources").alias("sources"))


@query(WIN_SQL + "SELECT judge, ok AS own_keeps, ov AS own_votes, xk AS other_keeps, xv AS other_votes FROM bias")
def self_preference(spark, sf_dir):
    candidates, vendors, votes, judges = panel_tables(spark, sf_dir)
    return panel.self_preference(candidates, vendors, votes, judges).select("judge", "own_keeps", "own_votes", "other_keeps", "other_votes")


@query(WIN_SQL + "SELECT judge, tie_rank FROM ties")
def tie_break_order(spark, sf_dir):
    candidates, vendors, votes, judges = panel_tables(spark, sf_dir)
    return panel.tie_break_order(panel.self_preference(candidates, vendors, votes, judges)).withColumn("tie_rank", F.col("tie_rank").cast("bigint"))


@query("""WITH RECURSIVE d(id, target) AS (SELECT o_orderkey, o_orderkey - 1 - o_custkey % 3 FROM orders WHERE o_custkey % 4 <> 0 AND o_orderkey - 1 - o_custkey % 3 IN (SELECT o_orderkey FROM orders)),
r AS (SELECT id, target FROM d UNION ALL SELECT r.id, d.target FROM r JOIN d ON r.target = d.id)
SELECT id, target FROM r WHERE target NOT IN (SELECT id FROM d)""")
def duplicate_chains(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    direct = orders.filter("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey - 1 - o_custkey % 3").alias("target"))
    return panel.resolve_chains(direct.join(spread(orders.select(F.col("o_orderkey").alias("target"))), "target", "left_semi").select("id", "target"))


@query("""WITH v AS (SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag <> 'R' AS keep, l_linenumber % 4 <> 0 AND (l_quantity >= 50 OR l_suppkey % 25 = 0) AS bad FROM lineitem),
g AS (SELECT id, max(bad::INT) AS bad, count(*) FILTER (WHERE n % 4 <> 0) AS votes, count(*) FILTER (WHERE n % 4 <> 0 AND keep) AS keeps FROM v GROUP BY id)
SELECT id, CASE WHEN id % 41 = 0 THEN 'not JSON' WHEN bad = 1 THEN 'vote is not valid' END AS error, CASE WHEN id % 41 <> 0 AND bad = 0 THEN votes END AS votes, CASE WHEN id % 41 <> 0 AND bad = 0 THEN keeps END AS keeps FROM g""")
def parse_votes(spark, sf_dir):
    """An order is a judge's reply, its line items the votes; of every fourth candidate
    nothing was asked."""
    n, text = F.col("l_linenumber"), lambda c: c.cast("string")
    keep = F.when(F.col("l_suppkey") % 25 == 0, "1").otherwise(text(F.col("l_returnflag") != "R"))
    enforce = F.when(F.col("l_quantity") >= 50, "strict").when(n % 2 == 1, "fixed").otherwise("preferred")
    same = F.when((F.col("l_linestatus") == "F") & (n > 1), text(n - 1)).otherwise("null")
    vote = F.concat(F.lit('{"id": '), text(n), F.lit(', "keep": '), keep, F.lit(', "translation": " '), F.col("l_returnflag"), text(F.col("l_suppkey")), F.lit('", "enforce": "'), enforce, F.lit('", "duplicate_of": '), same, F.lit("}"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), vote.alias("v")))).alias("x"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["v"]), ", "), F.when(F.col("id") % 41 == 0, F.lit("")).otherwise("]"))
    reply = F.when(F.col("id") % 3 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    ids = F.transform(F.filter("x", lambda x: x["n"] % 4 != 0), lambda x: x["n"].cast("bigint"))
    out = panel.parse_votes(rows.select("id", reply.alias("reply"), ids.alias("ids")))
    count = lambda c: F.when(F.col("votes").isNotNull(), F.size(c)).cast("bigint")
    return out.select("id", "error", count(F.col("votes")).alias("votes"), count(F.filter("votes", lambda v: v["keep"])).alias("keeps"))


@query(PLAN_SQL + """SELECT p.book, p.ord, p.batch_id, '[' || length(coalesce(text, '')) || '] ' || reverse(coalesce(text, '')) AS translated FROM p JOIN documents ON source = p.book AND doc_id = p.ord""")
def stub_translate_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("ord"), "text")
    plan = batching.plan_batches(docs, "book", "ord", "text", PLAN_CHARS, 6, PLAN_SEGMENTS).select("book", "ord", "batch_id")
    return resume.translate(docs.join(plan, ["book", "ord"])).select("book", "batch_id", "ord", "translated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
