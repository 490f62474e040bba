"""Queries of the reply protocol, glossaries, panels from end to end, and runs, over
the synthetic tables, and their SQL. Importing this module adds them to the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import CANDIDATES_SQL, panel_tables, query, table
from .functions import protocol as P
from .functions import text as T
from .operators import glossary, links, panel, replies, resumption, runs, terms
from .tables import keep, shared_dir, spread

# ---------------------------------------------------------------- replies
# A conversation is a batch and its turns the segments; its number decides what is wrong
# with the reply.

TURNS_SQL = r"""WITH c AS (SELECT conv_id, list(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') ORDER BY turn) AS parts, count(*) AS n FROM conversations GROUP BY conv_id)
"""


def turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", P.stripped(F.coalesce("text", F.lit(""))).alias("t")).alias("s"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select("conv_id", F.transform("s", lambda x: x["t"]).alias("parts"), F.size("s").cast("bigint").alias("n"))


@query(TURNS_SQL + r"""SELECT conv_id, n,
  md5(CASE WHEN n = 1 THEN parts[1] ELSE list_aggregate(list_transform(parts, lambda x, i: '<segment id="' || i || '">' || x || '</segment>'), 'string_agg', chr(10) || chr(10)) END) AS tagged,
  md5(list_aggregate(parts, 'string_agg', chr(10) || chr(10) || '%%' || chr(10) || chr(10))) AS delimited FROM c""")
def segment_frames(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "n", F.md5(P.framed(F.col("parts"))).alias("tagged"), F.md5(P.framed(F.col("parts"), tagged=False)).alias("delimited"))


@query(TURNS_SQL + r"""SELECT conv_id, CASE WHEN n = 1 AND parts[1] = '' THEN 'empty reply' WHEN n > 1 THEN CASE conv_id % 7 WHEN 1 THEN 'text outside tags' WHEN 2 THEN 'wrong number of segments' WHEN 3 THEN 'repeated ids' WHEN 4 THEN 'wrong ids' WHEN 5 THEN 'no segment tags' END END AS error,
  CASE WHEN (n = 1 AND parts[1] <> '') OR (n > 1 AND conv_id % 7 IN (0, 6)) THEN md5(list_aggregate(parts, 'string_agg', '|')) END AS parts FROM c""")
def segment_replies(spark, sf_dir):
    rows = turns(spark, sf_dir)
    tag = lambda i, x: F.concat(F.lit("<Segment  id = '"), i.cast("string"), F.lit("'>\n "), x, F.lit(" </segment>"))
    every = F.transform("parts", lambda x, i: tag(i + 1, x))
    k = F.col("conv_id") % 7
    lists = (
        F.when(k == 2, F.concat(every, F.array(tag(F.lit(99), F.lit("more")))))
        .when(k == 3, F.transform("parts", lambda x, i: tag(F.greatest(i, F.lit(1)), x)))
        .when(k == 4, F.transform("parts", lambda x, i: tag(i, x)))
        .when(k == 0, F.reverse(every))
        .otherwise(every)
    )
    joined = F.array_join(lists, "\n")
    made = F.when(k == 1, F.concat(F.lit("Here they are:\n"), joined)).when(k == 5, F.array_join("parts", "\n")).when(k == 6, F.concat(F.lit("```xml\n"), joined, F.lit("\n```"))).otherwise(joined)
    got = rows.select("conv_id", P.split_tagged(F.when(F.col("n") == 1, F.get("parts", F.lit(0))).otherwise(made), F.col("n")).alias("r"))
    return got.select("conv_id", "r.error", F.md5(F.array_join("r.parts", "|")).alias("parts"))


@query(TURNS_SQL + r""", k AS (SELECT conv_id, n, parts, list_filter(parts, lambda x: x <> '') AS kept FROM c)
SELECT conv_id, CASE WHEN n = 1 AND parts[1] = '' THEN 'empty reply' WHEN n > 1 AND (conv_id % 3 = 2 OR len(kept) < n) THEN 'wrong number of segments' END AS error,
  CASE WHEN (n = 1 AND parts[1] <> '') OR (n > 1 AND conv_id % 3 < 2 AND len(kept) = n) THEN md5(list_aggregate(parts, 'string_agg', '|')) END AS parts FROM k""")
def delimited_replies(spark, sf_dir):
    k = F.col("conv_id") % 3
    made = F.when(k == 0, P.framed(F.col("parts"), tagged=False)).when(k == 1, F.array_join("parts", "\n  %%\t\n")).otherwise(F.array_join("parts", " %% "))
    got = turns(spark, sf_dir).select("conv_id", P.split_delimited(made, F.col("n")).alias("r"))
    return got.select("conv_id", "r.error", F.md5(F.array_join("r.parts", "|")).alias("parts"))


# ---------------------------------------------------------------- glossaries
# A brand's parts are its glossary: size decides priority and tier.

ENTRIES_SQL = """WITH e AS (SELECT p_brand AS book, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord, p_name AS term, 'T' || p_partkey AS translation,
  CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'odd' END AS priority, CASE p_size % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'preferred' END AS tier,
  CASE WHEN p_size % 4 = 0 THEN ['a' || p_size, 'b'] ELSE [] END AS alternatives, CASE WHEN p_size % 7 = 0 THEN 'not ' || p_size ELSE '' END AS negative FROM part),
r AS (SELECT *, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'low' THEN 3 ELSE 2 END AS rank FROM e)
"""
ENTRY = "struct<term: string, suggested_translation: string, priority: string, tier: string, alternatives: array<string>, negative_constraint: string>"


def glossary_replies(spark, sf_dir) -> DataFrame:
    """Each brand's glossary as a model would reply with it."""
    s = F.col("p_size")
    priority = F.when(s % 5 == 0, "critical").when(s % 5 == 1, "high").when(s % 5 == 2, "medium").when(s % 5 == 3, "low").otherwise("odd")
    tier = F.when(s % 3 == 0, "fixed").when(s % 3 == 1, "preferred")
    others = F.when(s % 4 == 0, F.array(F.concat(F.lit("a"), s.cast("string")), F.lit("b")))
    entry = F.struct(F.col("p_name").alias("term"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("suggested_translation"), priority.alias("priority"), tier.alias("tier"), others.alias("alternatives"), F.when(s % 7 == 0, F.concat(F.lit("not "), s.cast("string"))).alias("negative_constraint")).cast(ENTRY)
    lists = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("book")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("all"))
    whole = F.to_json(F.struct(F.transform("all", lambda x: x["e"]).alias(glossary.TERMS)))
    return lists.select("book", F.concat(F.lit("```json\n"), whole, F.lit("\n```")).alias("reply"))


def glossary_entries(spark, sf_dir) -> DataFrame:
    return glossary.entries(glossary.parse(glossary_replies(spark, sf_dir)), "book")


@query(ENTRIES_SQL + "SELECT book, ord, term, translation, priority, tier, list_aggregate(alternatives, 'string_agg', '/') AS alternatives, nullif(negative, '') AS negative FROM e")
def glossary_parse(spark, sf_dir):
    others = F.nullif(F.array_join("alternatives", "/"), F.lit(""))
    return glossary_entries(spark, sf_dir).select("book", F.col("ord").cast("bigint").alias("ord"), "term", "translation", "priority", "tier", others.alias("alternatives"), "negative")


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'no critical_terminology' WHEN 3 THEN 'critical_terminology is not a list' WHEN 4 THEN 'a term is not an object' WHEN 5 THEN 'unknown tier' END AS error,
  CASE WHEN p_partkey % 8 >= 6 THEN p_partkey % 8 - 6 END AS n FROM part""")
def glossary_errors(spark, sf_dir):
    k = F.col("p_partkey") % 8
    name = F.regexp_replace("p_name", '["\\\\]', "")
    body = lambda x: F.concat(F.lit(f'{{"{glossary.TERMS}": '), x, F.lit("}"))
    entry = lambda tier: F.concat(F.lit('[{"term": "'), name, F.lit(f'", "tier": {tier}}}]'))
    reply = F.when(k == 0, name).when(k == 1, F.lit("[1]")).when(k == 2, F.lit('{"terms": []}')).when(k == 3, body(F.lit("{}"))).when(k == 4, body(F.lit('[{"term": "a"}, 7]')))
    reply = reply.when(k == 5, body(entry('"strict"'))).when(k == 6, body(F.lit("[]"))).otherwise(body(entry('"fixed"')))
    rows = table(spark, sf_dir, "part").select("p_partkey", reply.alias("reply"))
    return glossary.parse(rows).select("p_partkey", "error", F.when(F.col("error").isNull(), F.size("terms")).cast("bigint").alias("n"))


LINE_SQL = """'  • ' || term || ' → ' || translation || CASE WHEN tier = 'preferred' AND len(alternatives) > 0 THEN '（也可：' || list_aggregate(alternatives, 'string_agg', '、') || '）' ELSE '' END || CASE WHEN negative <> '' THEN '（' || negative || '）' ELSE '' END"""


@query(ENTRIES_SQL + f"""SELECT book, md5(concat_ws(chr(10) || chr(10),
  '{P.FIXED_HEADING}' || chr(10) || string_agg({LINE_SQL}, chr(10) ORDER BY rank, ord) FILTER (WHERE tier IS DISTINCT FROM 'preferred'),
  '{P.PREFERRED_HEADING}' || chr(10) || string_agg({LINE_SQL}, chr(10) ORDER BY rank, ord) FILTER (WHERE tier = 'preferred'))) AS block_md5 FROM r WHERE rank <= 1 GROUP BY book""")
def glossary_blocks(spark, sf_dir):
    rows = glossary.urgent(glossary_entries(spark, sf_dir), "high")
    return glossary.blocks(rows, "book").select("book", F.md5("block").alias("block_md5"))


@query(ENTRIES_SQL + """SELECT book, count(*) AS terms, string_agg(term, '|' ORDER BY ord) AS names FROM e WHERE ord < 20 GROUP BY book""")
def glossary_files(spark, sf_dir):
    """Written as files would hold them, and read back."""
    kept = glossary.files(glossary.first_terms(glossary_entries(spark, sf_dir), 20), "book").withColumnRenamed("json", "reply")
    return glossary.parse(kept, fenced=False).select("book", F.size("terms").cast("bigint").alias("terms"), F.array_join(F.transform("terms", lambda x: x["term"]), "|").alias("names"))


CODES = ["zh", "en", "ja", "ko", "fr", "de", "es", "pt", "ru", "ar", "it", "zh-CN", "Old Norse"]


@query(f"""WITH n AS (SELECT ['Chinese', 'English', 'Japanese', 'Korean', 'French', 'German', 'Spanish', 'Portuguese', 'Russian', 'Arabic', 'Italian', 'zh-CN', 'Old Norse'] AS names)
SELECT doc_id, md5('To ' || names[doc_id % 13 + 1] || '. ' || 'G' || doc_id || ' {{GLOSSARY}} ' || coalesce(text, '')) AS prompt_md5 FROM documents, n""")
def prompt_render(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("doc_id") % 13).cast("int"))
    template = F.lit("To {TARGET_LANGUAGE}. {GLOSSARY_BLOCK} {GLOSSARY} {CUSTOM_INSTRUCTIONS_BLOCK}")
    return docs.select("doc_id", F.md5(P.rendered(template, code, F.concat(F.lit("G"), F.col("doc_id").cast("string")), F.col("text"))).alias("prompt_md5"))


@query(f"""SELECT conv_id, md5('say' || CASE WHEN count(*) > 1 THEN '{P.DELIMITED_ADDENDUM}' ELSE '' END) AS delimited, md5('say' || CASE WHEN count(*) > 1 THEN '{P.TAGGED_ADDENDUM}' ELSE '' END) AS tagged FROM conversations GROUP BY conv_id""")
def batch_contracts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    say = lambda tagged: F.md5(P.with_contract(F.lit("say"), F.col("n"), tagged))
    return rows.select("conv_id", say(False).alias("delimited"), say(True).alias("tagged"))


@query(r"""WITH p AS (SELECT p_brand AS chunk, p_partkey AS id, p_name AS term FROM part),
o AS (SELECT id, k AS ord, CASE k WHEN 0 THEN 'A' ELSE 'B' END AS letter, term || ' "' || k || '"' AS translation, CASE WHEN k = 1 THEN 'high' END AS priority FROM p, (VALUES (0), (1)) t(k) WHERE (id + k) % 3 <> 0),
oj AS (SELECT id, string_agg('   {' || chr(10) || '    "list": ' || to_json(letter) || ',' || chr(10) || '    "translation": ' || to_json(translation) || ',' || chr(10) || '    "priority": ' || coalesce(CAST(to_json(priority) AS VARCHAR), 'null') || ',' || chr(10) || '    "reason": ' || to_json('é\' || id) || chr(10) || '   }', ',' || chr(10) ORDER BY ord) AS x FROM o GROUP BY id),
s AS (SELECT l_partkey AS id, string_agg('   ' || to_json('sold ' || l_quantity::INT), ',' || chr(10) ORDER BY l_orderkey, l_linenumber, 'sold ' || l_quantity::INT) AS x FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY l_partkey),
e AS (SELECT chunk, p.id, ' {' || chr(10) || '  "id": ' || p.id || ',' || chr(10) || '  "term": ' || to_json(term) || ',' || chr(10) || '  "proposals": ' || coalesce('[' || chr(10) || oj.x || chr(10) || '  ]', '[]') || ',' || chr(10) || '  "sentences": ' || coalesce('[' || chr(10) || s.x || chr(10) || '  ]', '[]') || chr(10) || ' }' AS j FROM p LEFT JOIN oj ON oj.id = p.id LEFT JOIN s ON s.id = p.id)
SELECT chunk, md5('Judge ' || count(*) || ' of ' || (SELECT string_agg(DISTINCT letter, ', ' ORDER BY letter) FROM o JOIN p ON p.id = o.id WHERE p.chunk = e.chunk) || '.' || chr(10) || 'CANDIDATES:' || chr(10) || '[' || chr(10) || string_agg(j, ',' || chr(10) ORDER BY id) || chr(10) || ']' || chr(10) || chr(10) || 'TABLE OF CONTENTS:' || chr(10) || 'One' || chr(10) || chr(10) || 'INDEX:' || chr(10) || '(none)' || chr(10)) AS prompt_md5 FROM e GROUP BY chunk""")
def judge_prompts(spark, sf_dir):
    """Brands are chunks and their parts the candidates; line items stand for sentences."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chunk"), F.col("p_partkey").alias("id"), F.col("p_name").alias("term"))
    offers = rows.withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1)))).filter((F.col("id") + F.col("ord")) % 3 != 0)
    offers = offers.select("id", "ord", F.when(F.col("ord") == 0, "A").otherwise("B").alias("letter"), F.concat("term", F.lit(' "'), F.col("ord").cast("string"), F.lit('"')).alias("translation"), F.when(F.col("ord") == 1, "high").alias("priority"), F.concat(F.lit("é\\"), F.col("id").cast("string")).alias("reason"))
    sold = table(spark, sf_dir, "lineitem").filter("l_orderkey % 7 = 0").select(F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber").alias("rank"), F.concat(F.lit("sold "), F.col("l_quantity").cast("int").cast("string")).alias("sentence"))
    out = panel.judge_prompts(rows, offers, sold, F.lit("Judge {count} of {letters}."), F.lit("One"), F.lit(""))
    return out.select("chunk", F.md5("prompt").alias("prompt_md5"))


# ---------------------------------------------------------------- panels
# The judges call a candidate a duplicate of one before it where a customer's number says so.

WHOLE_SQL = CANDIDATES_SQL.replace("WITH c AS", "WITH RECURSIVE c AS").rstrip() + """,
ids AS (SELECT id FROM c),
direct(id, target) AS (SELECT DISTINCT vote.id, vote.id - 1 - o_custkey % 3 FROM vote JOIN c ON c.id = vote.id WHERE o_custkey % 4 = 1 AND vote.id - 1 - o_custkey % 3 IN (SELECT id FROM ids)),
hop(id, target) AS (SELECT id, target FROM direct UNION ALL SELECT hop.id, direct.target FROM hop JOIN direct ON hop.target = direct.id),
ends AS (SELECT id, target FROM hop WHERE target NOT IN (SELECT id FROM direct)),
grp AS (SELECT c.id, coalesce(ends.target, c.id) AS target, p FROM c LEFT JOIN ends ON ends.id = c.id),
prop AS (SELECT grp.target AS id, ven.id AS member, vendor, vendor_ord, 't' || (vendor_ord % 2) AS translation, (ven.id + vendor_ord) % 5 AS rank, CASE WHEN (ven.id + vendor_ord) % 6 = 0 THEN 'not t' || (ven.id % 4) ELSE '' END AS note FROM ven JOIN grp ON grp.id = ven.id),
mine AS (SELECT id, min(vendor) AS v0, max(vendor) AS v1, count(DISTINCT vendor) AS n_vendors, list_sort(list(DISTINCT vendor)) AS vendors, min(CASE WHEN rank > 3 THEN 2 ELSE rank END) AS rank FROM prop GROUP BY id),
n AS (SELECT vote.id, count(*) FILTER (WHERE keep AND NOT (v0 = judge AND v1 = judge)) AS keeps, count(*) FILTER (WHERE NOT keep) AS drops, count(*) FILTER (WHERE keep) AS keepers FROM vote JOIN mine ON mine.id = vote.id GROUP BY vote.id),
t AS (SELECT mine.id, n_vendors, vendors, rank, coalesce(keeps, 0) AS keeps, coalesce(drops, 0) AS drops, coalesce(keepers, 0) AS keepers, coalesce(drops, 0) <= coalesce(keeps, 0) AS kept FROM mine LEFT JOIN n ON n.id = mine.id),
good AS (SELECT id FROM t WHERE kept),
one AS (SELECT id, vendor, vendor_ord, translation FROM (SELECT *, row_number() OVER (PARTITION BY id, vendor ORDER BY member) AS r FROM prop) WHERE r = 1 AND id IN (SELECT id FROM good)),
cast_ AS (SELECT * FROM vote WHERE id IN (SELECT id FROM good)),
strong AS (SELECT id, translation, 0 AS k, judge_ord AS pos FROM cast_ WHERE keep UNION ALL SELECT id, translation, 1, vendor_ord FROM one WHERE vendor NOT IN ('v0', 'v1')),
src AS (SELECT * FROM strong UNION ALL SELECT id, translation, 2, vendor_ord FROM one WHERE id NOT IN (SELECT id FROM strong)),
cnt AS (SELECT id, translation, count(*) AS n, min((k, pos)) AS first FROM src GROUP BY id, translation),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS r FROM cnt),
top AS (SELECT id, max(translation) FILTER (WHERE r = 1) AS t1, max(n) FILTER (WHERE r = 1) AS n1, max(n) FILTER (WHERE r = 2) AS n2 FROM rk GROUP BY id),
bias AS (SELECT judge, judge_ord, count(*) FILTER (WHERE v0 = judge AND v1 = judge) AS ov, count(*) FILTER (WHERE keep AND v0 = judge AND v1 = judge) AS ok, count(*) FILTER (WHERE NOT (v0 = judge AND v1 = judge)) AS xv, count(*) FILTER (WHERE keep AND NOT (v0 = judge AND v1 = judge)) AS xk FROM vote JOIN own USING (id) GROUP BY ALL),
ties AS (SELECT judge, row_number() OVER (ORDER BY NOT (ov >= 10 AND xv > 0), CASE WHEN ov >= 10 AND xv > 0 THEN round(greatest(0.0, ok / ov - xk / xv), 4) ELSE 0 END, judge_ord) AS tie_rank FROM bias),
jd AS (SELECT id, arg_min(translation, tie_rank) AS bj FROM cast_ JOIN ties USING (judge) GROUP BY id),
vn AS (SELECT id, arg_min(translation, vendor_ord) AS bv FROM one GROUP BY id),
ag AS (SELECT id, count(DISTINCT translation) AS texts, min(translation) AS txt, bool_and(enforce = 'fixed') AS allf FROM cast_ WHERE keep GROUP BY id),
ch AS (SELECT top.id, CASE WHEN n1 = n2 THEN coalesce(bj, bv) ELSE t1 END AS translation FROM top LEFT JOIN jd USING (id) LEFT JOIN vn USING (id)),
alt AS (SELECT ch.id, list(rk.translation ORDER BY r)[1:2] AS alternatives FROM ch JOIN rk ON rk.id = ch.id AND rk.translation <> ch.translation GROUP BY ch.id),
win AS (SELECT ch.id, ch.translation, coalesce(cnt.n, 0) AS sources, coalesce(alt.alternatives, []) AS alternatives,
        CASE WHEN coalesce(cnt.n, 0) >= 2 AND (ag.id IS NULL OR (texts = 1 AND txt = ch.translation AND allf)) THEN 'fixed' ELSE 'preferred' END AS tier
        FROM ch LEFT JOIN cnt ON cnt.id = ch.id AND cnt.translation = ch.translation LEFT JOIN ag ON ag.id = ch.id LEFT JOIN alt ON alt.id = ch.id),
neg AS (SELECT prop.id, arg_min(note, (member, vendor_ord)) AS note FROM prop JOIN win ON win.id = prop.id WHERE note <> '' AND NOT contains(note, win.translation) AND len(list_filter(alternatives, lambda a: contains(note, a))) = 0 GROUP BY prop.id),
dec AS (SELECT t.id, n_vendors, keeps, drops, kept, win.translation, win.sources, win.tier, alternatives, rank,
        CASE WHEN kept THEN CASE rank WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END END AS priority, CASE WHEN kept THEN coalesce(neg.note, '') END AS negative,
        CASE WHEN kept THEN 'Term Panel: nominated by ' || list_aggregate(vendors, 'string_agg', ', ') || '; kept by ' || keepers || ' of 2 judges.' END AS reason
        FROM t LEFT JOIN win ON win.id = t.id LEFT JOIN neg ON neg.id = t.id),
capped AS (SELECT * FROM dec WHERE kept ORDER BY tier <> 'fixed', n_vendors DESC, rank, 'term ' || id LIMIT 500)
"""


def decisions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    candidates, vendors, votes, judges = panel_tables(spark, sf_dir)
    target = F.expr("id - 1 - o_custkey % 3")
    votes = votes.withColumn("duplicate_of", F.when(F.expr("o_custkey % 4 = 1"), target)).drop("o_custkey")
    named = candidates.select("id", F.concat(F.lit("term "), F.col("id").cast("string")).alias("term"))
    both = F.col("id") + F.col("vendor_ord")
    names = F.array(*[F.lit(x) for x in T.PRIORITIES])
    note = F.when(both % 6 == 0, F.concat(F.lit("not t"), (F.col("id") % 4).cast("string"))).otherwise("")
    proposed = vendors.withColumns({"prop_ord": F.col("vendor_ord"), "translation": F.concat(F.lit("t"), (F.col("vendor_ord") % 2).cast("string")), "priority": F.get(names, (both % 5).cast("int")), "negative_constraint": note})
    return panel.decide(named, proposed, votes, judges, 2), named


@query(WHOLE_SQL + "SELECT id, 'term ' || id AS term, n_vendors, keeps, drops, kept, translation, sources, tier, list_aggregate(alternatives, 'string_agg', '|') AS alternatives, priority, negative, reason FROM dec")
def panel_decisions(spark, sf_dir):
    out, _ = decisions(spark, sf_dir)
    return out.withColumn("alternatives", F.nullif(F.array_join("alternatives", "|"), F.lit("")))


@query(WHOLE_SQL + """SELECT (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM c) - (SELECT count(*) FROM dec) AS merged, (SELECT count(*) FROM dec WHERE NOT kept) AS dropped,
(SELECT count(*) FROM capped WHERE tier = 'fixed') AS fixed, (SELECT count(*) FROM capped WHERE tier = 'preferred') AS preferred, (SELECT count(*) FROM dec WHERE kept) - (SELECT count(*) FROM capped) AS cut_by_limit""")
def panel_summary(spark, sf_dir):
    out, named = decisions(spark, sf_dir)
    out = keep(out.select("id", "term", "n_vendors", "kept", "tier", "priority"))  # decided once, read twice
    return panel.summary(out, terms.glossary_cap(out.filter("kept"), 500), named.count())


@query(CANDIDATES_SQL + """, a AS (SELECT id, list_sort(list(DISTINCT vendor)) AS s FROM ven GROUP BY id), b AS (SELECT id, list_sort(list(DISTINCT judge)) AS s FROM vote GROUP BY id)
SELECT coalesce(a.id, b.id) AS id, a.s IS NOT DISTINCT FROM b.s AS same FROM a FULL JOIN b ON a.id = b.id""")
def vendor_sets(spark, sf_dir):
    _, vendors, votes, _ = panel_tables(spark, sf_dir)
    return panel.same_vendors(vendors, votes.withColumnRenamed("judge", "vendor"), "id")


# ---------------------------------------------------------------- runs


@query("SELECT source, doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def final_pairs(spark, sf_dir):
    return runs.final_pairs(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def segments_to_probe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return runs.to_probe(docs.select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), docs.filter("n_chars > 500"), "doc_id")


@query("SELECT o_custkey AS book, o_orderkey AS batch, CAST(sum(o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM orders")
def running_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("batch"), (F.col("o_orderkey") % 7).alias("n"))
    return runs.progress(rows, "book", "batch", "n").drop("n")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN user_id END AS saved FROM events")
def checkpoint_progress(spark, sf_dir):
    k = F.col("event_id") % 5
    file = lambda x: F.concat(F.lit('{"schema_version": 2, "translated_segment_count": '), x, F.lit("}"))
    state = F.when(k == 1, file(F.col("user_id").cast("string"))).when(k == 2, file(F.lit('"7"'))).when(k == 3, F.lit('{"segments": ')).when(k == 4, F.lit("[3]"))
    return table(spark, sf_dir, "events").select("event_id", runs.saved_count(state).alias("saved"))


@query(r"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, t, string_split_regex(regexp_replace(t, '\r?\n$', ''), '\r?\n') AS a FROM s)
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE least(len(a), 20) END AS n, md5(CASE WHEN t = '' THEN '' ELSE array_to_string(a[greatest(len(a) - 19, 1):], '|') END) AS tail FROM l""")
def log_tail(spark, sf_dir):
    out = runs.log_tail(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.size("tail").cast("bigint").alias("n"), F.md5(F.array_join("tail", "|")).alias("tail"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag <> 'N' THEN 'input' END, CASE WHEN l_linestatus <> 'O' THEN 'effort' END) AS mismatches, l_returnflag <> 'N' OR l_linestatus <> 'O' AS refused, l_returnflag <> 'N' AS refused_forced FROM lineitem""")
def identity_verdict(spark, sf_dir):
    stored = {"input": F.col("l_returnflag"), "effort": F.col("l_linestatus"), "prompt": F.col("l_shipdate").cast("string")}
    expected = {"input": F.lit("N"), "effort": F.lit("O"), "prompt": F.lit("?")}
    v = lambda force: runs.verdict(stored, expected, ("input",), force=force, deferred=("prompt",))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v(False).alias("v"), v(True).alias("f"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join("v.mismatches", ",").alias("mismatches"), F.col("v.refused").alias("refused"), F.col("f.refused").alias("refused_forced"))


@query("""WITH l AS (SELECT user_id, arg_max(value, event_id) AS v, arg_max(CASE WHEN event_id % 1000 <> 999 THEN event_id END, event_id) AS m FROM events GROUP BY user_id)
SELECT count(*) AS runs, round(sum(v), 2) AS input_tokens, CASE WHEN count(*) = (SELECT count(*) FROM (SELECT user_id, max(event_id) AS e FROM events GROUP BY user_id) WHERE e % 1000 <> 999) THEN CAST(sum(m) AS BIGINT) END AS output_tokens FROM l""")
def usage_across_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", F.col("value").alias("input_tokens"), F.when(F.col("event_id") % 1000 != 999, F.col("event_id")).alias("output_tokens"))
    return runs.usage_totals(rows, "event_id", "input_tokens", "output_tokens").withColumn("input_tokens", F.round("input_tokens", 2))


CALLS_SQL = "SELECT doc_id, sha256('model-' || lang || chr(10) || coalesce(text, '')) AS digest FROM documents"


@query(f"SELECT DISTINCT digest FROM ({CALLS_SQL}) WHERE digest NOT IN (SELECT digest FROM ({CALLS_SQL}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND digest IS NOT NULL) AND digest IS NOT NULL")
def unsaved_replies(spark, sf_dir):
    calls = table(spark, sf_dir, "documents").select("doc_id", P.reply_digest(F.concat(F.lit("model-"), F.col("lang")), F.coalesce("text", F.lit(""))).alias("digest")).filter("digest is not null")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") != 1, "broken").alias("error"))
    saved = runs.savable(calls.join(labels, "doc_id"))
    return runs.unsaved_calls(calls, saved).select("digest")


@query("""SELECT doc_id, sha256('{"chars": ' || coalesce(CAST(n_chars AS VARCHAR), 'null') || ', "effort": null, "mark": "\\u00e9\\"\\ud83d\\ude00\\n", "source": "' || source || '"}') AS identity FROM documents""")
def cache_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.identity(source=F.col("source"), chars__raw=F.col("n_chars"), effort=F.lit(None), mark=F.lit('é"😀\n')).alias("identity"))


@query("""WITH u AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS used FROM events GROUP BY user_id), o AS (SELECT user_id, list_filter(used, lambda x: x <> 'click' AND x IN ('view', 'click', 'purchase')) AS others FROM u)
SELECT user_id, len(others) > 0 AND contains(list_value('purchase'), 'click') OR (len(others) > 0 AND list_contains(others, 'purchase')) AS refused FROM o""")
def trial_models(spark, sf_dir):
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("used"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    return used.select("user_id", runs.mixed_models(F.col("used"), F.lit("click"), lit("view", "click", "purchase"), lit("purchase")).alias("refused"))


# Customers are runs, their orders saved segments; line items tell which segments the book has.

RUN_SQL = """WITH e AS (SELECT c_custkey AS run, CAST(c_nationkey AS VARCHAR) AS input_signature, c_mktsegment AS output_lang, CAST(c_custkey % 3 AS VARCHAR) AS effort, 'p' || c_custkey % 4 AS system_prompt_hash, 'm' || c_custkey % 5 AS model, c_custkey % 6 = 0 AS force FROM customer),
r AS (SELECT o_custkey AS run, o_orderkey AS ord, o_orderkey AS segment_id, CASE WHEN o_orderkey % 61 = 0 THEN ' ' ELSE o_orderpriority END AS translated, CASE WHEN o_orderkey % 71 = 0 THEN 'other' ELSE 'cli' END AS provider, 'm' || CASE WHEN o_custkey % 7 = 0 THEN o_orderkey % 5 ELSE o_custkey % 5 END AS model FROM orders),
v AS (SELECT run, CASE WHEN run % 13 = 0 THEN 'changed' ELSE input_signature END AS input_signature, CASE WHEN run % 10 = 0 THEN 'changed' ELSE output_lang END AS output_lang, CASE WHEN run % 9 = 0 THEN NULL ELSE effort END AS effort, CASE WHEN run % 8 = 0 THEN 'changed' ELSE system_prompt_hash END AS system_prompt_hash, CASE WHEN run % 12 = 0 THEN 1 + (SELECT count(*) FROM r WHERE r.run = e.run) ELSE (SELECT count(*) FROM r WHERE r.run = e.run) END AS claimed FROM e WHERE run % 11 <> 0),
s AS (SELECT DISTINCT o_custkey AS run, l_orderkey AS segment_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 53 <> 0),
d AS (SELECT e.run, e.force, list_filter([CASE WHEN v.input_signature IS DISTINCT FROM e.input_signature THEN 'input_signature' END, CASE WHEN v.output_lang IS DISTINCT FROM e.output_lang THEN 'output_lang' END, CASE WHEN v.effort IS DISTINCT FROM e.effort THEN 'effort' END, CASE WHEN v.system_prompt_hash IS DISTINCT FROM e.system_prompt_hash THEN 'system_prompt_hash' END], lambda x: x IS NOT NULL) AS f FROM e JOIN v USING (run)),
bad AS (SELECT r.run, arg_min(CASE WHEN s.segment_id IS NULL THEN 'unknown segment' WHEN trim(translated) = '' THEN 'empty translation' ELSE 'invalid origin' END, ord) AS problem FROM r LEFT JOIN s ON s.run = r.run AND s.segment_id = r.segment_id WHERE s.segment_id IS NULL OR trim(translated) = '' OR provider <> 'cli' GROUP BY r.run),
n AS (SELECT v.run, coalesce(bad.problem, CASE WHEN claimed <> (SELECT count(*) FROM r WHERE r.run = v.run) THEN 'wrong number of records' END) AS problem FROM v LEFT JOIN bad USING (run)),
o AS (SELECT e.run, e.model, list_sort(list_filter(list_distinct(list(r.model)), lambda x: x <> e.model AND x IN ('m0', 'm1', 'm2'))) AS others FROM e JOIN r ON r.run = e.run GROUP BY e.run, e.model),
x AS (SELECT run, others FROM o WHERE len(others) > 0 AND (model = 'm1' OR list_contains(others, 'm1'))),
vf AS (SELECT e.run, d.f IS NOT NULL AS may_reuse, CASE WHEN list_contains(d.f, 'input_signature') THEN 'mismatch: ' || array_to_string(d.f, ', ') WHEN n.problem IS NOT NULL THEN n.problem WHEN NOT e.force AND x.others IS NOT NULL THEN 'model on trial, with: ' || array_to_string(x.others, ', ')
  WHEN NOT e.force AND len(list_filter(d.f, lambda y: y <> 'system_prompt_hash')) > 0 THEN 'mismatch: ' || array_to_string(list_filter(d.f, lambda y: y <> 'system_prompt_hash'), ', ') END AS refused FROM e LEFT JOIN d USING (run) LEFT JOIN n USING (run) LEFT JOIN x USING (run)),
rs AS (SELECT vf.run, may_reuse, coalesce(refused, CASE WHEN NOT d.force AND len(d.f) > 0 THEN 'mismatch: ' || array_to_string(d.f, ', ') END) AS late FROM vf LEFT JOIN d USING (run))
"""
RUN_FIELDS = ["input_signature", "output_lang", "effort", "system_prompt_hash"]


def run_tables(spark, sf_dir) -> tuple[DataFrame, ...]:
    """Expected and saved identities, records, and the segments of the books."""
    k = F.col("run")
    text = lambda c: c.cast("string")
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), text(F.col("c_nationkey")).alias("input_signature"), F.col("c_mktsegment").alias("output_lang"))
    expected = expected.withColumns({"effort": text(k % 3), "system_prompt_hash": F.concat(F.lit("p"), text(k % 4)), "model": F.concat(F.lit("m"), text(k % 5)), "force": k % 6 == 0})
    o = F.col("o_orderkey")
    model = F.concat(F.lit("m"), text(F.when(F.col("o_custkey") % 7 == 0, o % 5).otherwise(F.col("o_custkey") % 5)))
    records = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), o.alias("ord"), o.alias("segment_id"), F.when(o % 61 == 0, " ").otherwise(F.col("o_orderpriority")).alias("translated"), F.lit("pro").alias("profile"), F.when(o % 71 == 0, "other").otherwise("cli").alias("provider"), F.lit("codex").alias("backend"), model.alias("model")
    )
    n = records.groupBy("run").agg(F.count("*").alias("n"))
    changed = lambda m, c: F.when(k % m == 0, "changed").otherwise(F.col(c)).alias(c)
    saved = expected.filter(k % 11 != 0).join(spread(n), "run", "left").select("run", changed(13, "input_signature"), changed(10, "output_lang"), F.when(k % 9 != 0, F.col("effort")).alias("effort"), changed(8, "system_prompt_hash"), (F.coalesce("n", F.lit(0)) + F.when(k % 12 == 0, 1).otherwise(0)).alias("claimed"))
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 53 <> 0").select(F.col("l_orderkey").alias("segment_id")).distinct()
    segments = lines.join(spread(records.select("run", "segment_id")), "segment_id")
    return expected, saved, records, segments


def verified_runs(spark, sf_dir) -> DataFrame:
    expected, saved, records, segments = run_tables(spark, sf_dir)
    names = lambda *x: F.array(*map(F.lit, x))
    return resumption.verify(saved, expected, records, segments, RUN_FIELDS, ["cli"], ["codex"], names("m0", "m1", "m2"), names("m1"))


@query(RUN_SQL + "SELECT run, may_reuse, refused FROM vf")
def verify_runs(spark, sf_dir):
    return verified_runs(spark, sf_dir)


@query(RUN_SQL + "SELECT rs.run, late AS refused, count(r.run) AS released FROM rs LEFT JOIN r ON r.run = rs.run AND late IS NULL AND may_reuse GROUP BY rs.run, late")
def restore_runs(spark, sf_dir):
    expected, saved, records, _ = run_tables(spark, sf_dir)
    told, released = resumption.restore(keep(verified_runs(spark, sf_dir)), saved, expected, records, RUN_FIELDS)
    return told.join(spread(released.groupBy("run").agg(F.count("*").alias("released"))), "run", "left").na.fill(0, ["released"])


@query("""WITH o AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 17 = 0 THEN 2 ELSE 1 END AS layout, CASE c_custkey % 3 WHEN 0 THEN 'gemini-2.5-flash' WHEN 1 THEN 'gemini-2.5-pro' ELSE 'else' END AS model, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'fr' END AS lang, c_custkey % 2 = 0 AS force, c_custkey % 7 <> 0 AS same, CASE WHEN c_custkey % 4 = 0 THEN 'epub-leaf-block-v3' ELSE 'v2' END AS seg FROM customer),
t AS (SELECT o_custkey AS run, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 101 <> 0) AS told FROM orders GROUP BY o_custkey),
u AS (SELECT o.*, coalesce(n, 0) AS n, CASE WHEN layout <> 1 THEN 'unsupported layout' WHEN lang IS NULL THEN 'missing: output_lang' WHEN model = 'else' AND NOT force THEN 'unknown model' WHEN NOT same THEN 'another file' WHEN NOT force THEN 'unverified source, not forced' WHEN coalesce(told, 0) < coalesce(n, 0) THEN 'invalid translation' WHEN o.run % 23 = 0 THEN 'wrong number of records' END AS refused FROM o LEFT JOIN t USING (run))
SELECT run, refused, CASE WHEN refused IS NULL THEN CASE model WHEN 'gemini-2.5-flash' THEN 'flash' WHEN 'gemini-2.5-pro' THEN 'pro' ELSE 'now' END END AS profile, CASE WHEN refused IS NULL THEN CASE seg WHEN 'v2' THEN 'legacy_unknown' ELSE 'segment_tags' END END AS protocol, CASE WHEN refused IS NULL THEN n ELSE 0 END AS records FROM u""")
def upgraded_runs(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("run"))
    k = F.col("run")
    texts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("segment_id"), F.when(F.col("o_orderkey") % 101 != 0, F.col("o_orderpriority")).alias("translated"))
    n = texts.groupBy("run").agg(F.count("*").alias("n"))
    old = rows.join(spread(n), "run", "left").select(
        "run", F.when(k % 17 == 0, 2).otherwise(1).alias("schema_version"), F.lit("s").alias("input_signature"), F.lit("epub").alias("input_format"), F.when(k % 4 == 0, "epub-leaf-block-v3").otherwise("v2").alias("segmenter_signature"), F.when(k % 19 != 0, "fr").alias("output_lang"),
        F.lit("h").alias("system_prompt_hash"), F.lit(100).alias("max_batch_chars"), F.lit(6).alias("separator_overhead"), F.when(k % 3 == 0, "gemini-2.5-flash").when(k % 3 == 1, "gemini-2.5-pro").otherwise("else").alias("model"), F.lit("cli").alias("provider"), (F.coalesce("n", F.lit(0)) + F.when(k % 23 == 0, 1).otherwise(0)).alias("claimed"),
    )
    now = rows.select("run", F.lit("sha").alias("input_signature"), F.when(k % 7 == 0, "t").otherwise("s").alias("legacy_signature"), F.lit("now").alias("profile"), (k % 2 == 0).alias("force"))
    identities, records = resumption.upgrade(old, texts, now)
    count = records.groupBy("run").agg(F.count("*").alias("records"))
    return identities.join(spread(count), "run", "left").na.fill(0, ["records"]).select("run", "refused", "profile", "protocol", "records")


@query(f"""WITH k AS (SELECT DISTINCT digest FROM ({CALLS_SQL}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND digest IS NOT NULL)
SELECT source AS purpose, count(DISTINCT CASE WHEN k.digest IS NULL THEN c.digest END) AS made, count(k.digest) AS reused FROM ({CALLS_SQL}) c JOIN documents USING (doc_id) LEFT JOIN k ON k.digest = c.digest GROUP BY source""")
def panel_calls(spark, sf_dir):
    """Replies are saved where they parse; what is asked then is made once or reused."""
    calls = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("purpose"), P.reply_digest(F.concat(F.lit("model-"), F.col("lang")), F.coalesce("text", F.lit(""))).alias("digest"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") != 1, "broken").alias("error"))
    path = f"{shared_dir(spark)}/replies-{uuid.uuid4().hex}"
    for _ in range(2):  # the second run saves nothing more
        replies.save(calls.join(labels, "doc_id").withColumn("reply", F.col("digest")), path)
    return replies.calls(calls, keep(replies.saved(spark, path)))


@query("""WITH r AS (SELECT user_id AS run, CASE WHEN user_id % 3 = 0 THEN 7 END AS exit_code, CASE WHEN user_id % 3 = 0 THEN 0 END AS ended_at FROM events GROUP BY user_id),
f AS (SELECT user_id AS run, arg_min(event_id % 4, event_id) AS exit_code, min(event_id) AS at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT r.run, CASE WHEN r.ended_at IS NOT NULL THEN r.exit_code ELSE f.exit_code END AS exit_code, coalesce(r.ended_at, f.at) AS ended_at FROM r LEFT JOIN f USING (run)""")
def finished_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = F.col("run") % 3 == 0
    records = events.select(F.col("user_id").alias("run")).distinct().select("run", F.when(done, F.lit(7).cast("long")).alias("exit_code"), F.when(done, F.lit(0).cast("long")).alias("ended_at"))
    return replies.finished(records, events.filter("event_type = 'purchase'").select(F.col("user_id").alias("run"), (F.col("event_id") % 4).alias("exit_code"), F.col("event_id").alias("at")))


@query("""WITH p AS (SELECT l_suppkey AS model, l_linenumber AS version, max(CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 1 ELSE 0 END) AS worst FROM lineitem GROUP BY ALL)
SELECT model, version FROM p WHERE worst = 0 AND (model, version) NOT IN (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey % 50 = 0)""")
def new_certificates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "model", "l_linenumber": "version"})
    problems = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48), F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>"))
    return replies.certified_anew(rows.filter("l_orderkey % 50 = 0"), rows.select("model", "version", problems.alias("problems")), "model", "version")


@query("""SELECT p_partkey, p_name AS model, CASE WHEN starts_with(p_name, 'a') THEN 'first' WHEN starts_with(p_name, 'blu') THEN 'second' WHEN starts_with(p_name, 'b') THEN 'third' WHEN starts_with(p_name, 'sp') THEN 'fourth' END AS vendor FROM part""")
def model_vendors(spark, sf_dir):
    """Prefixes overlap: the first of them in their order counts."""
    prefixes = spark.createDataFrame([("b", "third", 3), ("a", "first", 1), ("blu", "second", 2), ("an", "never", 5), ("sp", "fourth", 4)], "prefix string, vendor string, ord int")
    return runs.vendors_of(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("model")), prefixes)


@query("SELECT c_custkey, c_nationkey AS runtime, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment <> 'BUILDING', c_custkey) AS rank FROM customer")
def preset_order(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("runtime"), F.when(F.col("c_mktsegment") == "BUILDING", "default").otherwise("manual").alias("status"), F.col("c_custkey").alias("ord"))
    return runs.presets_in_order(rows).drop("status", "ord")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey % 5 = 0 AND b.l_returnflag = a.l_returnflag AND b.l_linestatus = a.l_linestatus AND b.l_suppkey = a.l_suppkey AND b.l_linenumber = a.l_linenumber AND b.l_quantity = a.l_quantity)")
def certified_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return runs.certified(rows, rows.filter("l_orderkey % 5 = 0"), "l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber")


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'Stra\u00dfe \u00e9' || page_id || '.zh.epub' WHEN 1 THEN 'x' || page_id || '.epub' WHEN 5 THEN 'y.EPUB' END AS name,
CASE page_id % 8 WHEN 2 THEN 'not a plain file name' WHEN 3 THEN 'does not end in .epub' WHEN 4 THEN 'is the uploaded file' WHEN 6 THEN 'is the uploaded file' WHEN 7 THEN 'not a plain file name' END AS error FROM pages""")
def output_names(spark, sf_dir):
    """The source is named in composed letters; 4 gives it in capitals, 6 in decomposed ones."""
    k, n = F.col("page_id") % 8, F.col("page_id").cast("string")
    given = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("x"), n)).when(k == 2, F.concat(F.lit("a/"), n)).when(k == 3, F.lit("name.pdf")).when(k == 4, F.concat(F.lit("STRASSE \u00c9"), n, F.lit(".EPUB")))
    given = given.when(k == 6, F.concat(F.lit("stra\u00dfe e\u0301"), n, F.lit(".epub"))).when(k == 7, F.concat(F.lit("a\u2028"), n)).otherwise("y.EPUB")
    return table(spark, sf_dir, "pages").select("page_id", P.output_name(given, F.concat(F.lit("Stra\u00dfe \u00e9"), n, F.lit(".epub"))).alias("o")).select("page_id", "o.name", "o.error")


# ---------------------------------------------------------------- links

LINKS_SQL = """WITH f AS (SELECT page_id, 'd' || page_id % 9 || '/p' || page_id || '.md' AS path FROM pages)
"""


def markdown_pages(spark, sf_dir) -> DataFrame:
    """A Markdown file for each page: its address, three files, and a link in code."""
    n = F.col("page_id")
    s = lambda x: x.cast("string")
    path = lambda x: F.concat(F.lit("d"), s(x % 9), F.lit("/p"), s(x), F.lit(".md"))
    text = F.concat(
        F.lit("See [the page]("), F.coalesce("url", F.lit("http://none")), F.lit(") and [next](../"), path(n + 1), F.lit("#top).\n\n```\n[code](gone.md)\n```\n![pic](<../d0/p%"), F.hex(F.lit(48)), F.lit("0.md>) `[x](y.md)` [same](p"), s(n), F.lit(".md:12) [up](../../out.md) [root](/etc/x)\n")
    )
    return table(spark, sf_dir, "pages").select(path(n).alias("path"), text.alias("text"))


@query(LINKS_SQL + """, g AS (SELECT path FROM f)
SELECT path, 1 AS line, '../d' || (page_id + 1) % 9 || '/p' || (page_id + 1) || '.md#top' AS target, 'missing' AS reason FROM f WHERE 'd' || (page_id + 1) % 9 || '/p' || (page_id + 1) || '.md' NOT IN (SELECT path FROM g)
UNION ALL SELECT path, 6, '../d0/p00.md', 'missing' FROM f
UNION ALL SELECT path, 6, '../../out.md', 'outside-repository' FROM f
UNION ALL SELECT path, 6, '/etc/x', 'machine-specific' FROM f""")
def broken_document_links(spark, sf_dir):
    files = markdown_pages(spark, sf_dir)
    return links.broken(links.links(files.filter(links.maintained(F.col("path")))), files)
