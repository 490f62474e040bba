"""Glossaries: replies and files to term tables, blocks of a prompt, files again.

Table: ``entry(book, ord, term, translation, priority, tier, alternatives,
negative)``; tier is null where a glossary names none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import protocol as P
from ..functions import text as T

TERMS = "critical_terminology"
TIERS = ("fixed", "preferred")


def parse(replies: DataFrame, reply: str = "reply", fenced: bool = True) -> DataFrame:
    """Adds ``error`` and ``terms``: the entries of a JSON object in order, none when
    there is an error. A reply may stand in a Markdown fence, a file may not."""
    text = T.strip_fence(F.col(reply)) if fenced else F.col(reply)
    rows = replies.withColumn("v_", F.try_parse_json(text))
    rows = rows.withColumn("kind_", F.schema_of_variant("v_")).withColumn("list_", F.expr(f"try_variant_get(v_, '$.{TERMS}', 'variant')"))
    rows = rows.withColumn("items_", F.expr("case when schema_of_variant(list_) like 'ARRAY<%' then try_variant_get(list_, '$', 'array<variant>') end"))
    field = lambda name: f"case when schema_of_variant(try_variant_get(x, '$.{name}', 'variant')) = 'STRING' then try_variant_get(x, '$.{name}', 'string') end"
    entry = F.expr(
        f"""transform(items_, (x, i) -> named_struct('ord', i, 'object', schema_of_variant(x) like 'OBJECT<%',
        'tiered', coalesce(schema_of_variant(try_variant_get(x, '$.tier', 'variant')), '') <> '',
        'term', {field("term")}, 'translation', {field("suggested_translation")}, 'priority', {field("priority")}, 'tier', {field("tier")},
        'alternatives', coalesce(try_variant_get(x, '$.alternatives', 'array<string>'), array()), 'negative', {field("negative_constraint")}))"""
    )
    rows = rows.withColumn("terms_", entry)
    error = (
        F.when(F.col("v_").isNull(), "not JSON")
        .when(~F.col("kind_").startswith("OBJECT<"), "not an object")
        .when(F.col("list_").isNull(), f"no {TERMS}")
        .when(F.col("items_").isNull(), f"{TERMS} is not a list")
        .when(F.exists("terms_", lambda x: ~x["object"]), "a term is not an object")
        .when(F.exists("terms_", lambda x: x["tiered"] & ~F.coalesce(x["tier"].isin(*TIERS), F.lit(False))), "unknown tier")
    )
    names = ("ord", "term", "translation", "priority", "tier", "alternatives", "negative")
    terms = F.transform("terms_", lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return rows.withColumn("error", error).withColumn("terms", F.when(F.col("error").isNull(), terms)).drop("v_", "kind_", "list_", "items_", "terms_")


def entries(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.inline("terms"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``path, error, terms`` of glossary files, one object a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("reply"))
    return parse(files, fenced=False).drop("reply")


def first_terms(rows: DataFrame, most: int) -> DataFrame:
    """The entries up to a limit, in the order in which they were given."""
    return rows.filter(F.col("ord") < most)


def files(rows: DataFrame, *keys: str) -> DataFrame:
    """``json`` of each glossary, its entries in order; what an entry lacks is left out."""
    some = F.when(F.size("alternatives") > 0, F.col("alternatives"))
    entry = F.struct("ord", F.struct("term", F.col("translation").alias("suggested_translation"), "priority", "tier", some.alias("alternatives"), F.nullif("negative", F.lit("")).alias("negative_constraint")).alias("e"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    return lists.select(*keys, F.to_json(F.struct(F.transform("all", lambda x: x["e"]).alias(TERMS))).alias("json"))


def write(rows: DataFrame, path: str, book: str, most: int) -> None:
    """A glossary file for each book, of its first entries, in a folder of its name.
    The folder at path is replaced as a whole."""
    files(first_terms(rows, most), book).write.mode("overwrite").partitionBy(book).text(path)


def urgent(rows: DataFrame, least: str) -> DataFrame:
    """Entries at least as urgent as a priority; unknown ones count as medium."""
    return rows.filter(T.priority_rank(F.col("priority")) <= T.priority_rank(F.lit(least)))


def blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """``block``: a glossary as its prompt states it, strict terms before preferred ones,
    each by priority and then as given. A glossary's entries meet in one row; they
    are capped by its maximum of terms."""
    preferred = F.coalesce(F.col("tier") == "preferred", F.lit(False))
    line = F.when(preferred, P.glossary_line(F.col("term"), F.col("translation"), F.col("negative"), F.col("alternatives"))).otherwise(P.glossary_line(F.col("term"), F.col("translation"), F.col("negative")))
    lines = rows.select(*keys, preferred.alias("p"), F.struct(T.priority_rank(F.col("priority")).alias("rank"), "ord", line.alias("line")).alias("x"))
    lists = lines.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("p") == side, F.col("x")))).alias(name) for side, name in ((False, "strict"), (True, "loose"))])
    part = lambda name, heading: F.when(F.size(name) > 0, F.concat(F.lit(heading + "\n"), F.array_join(F.transform(name, lambda x: x["line"]), "\n")))
    block = F.concat_ws("\n\n", part("strict", P.FIXED_HEADING), part("loose", P.PREFERRED_HEADING))
    return lists.select(*keys, block.alias("block"))


def usage_summary(usage: DataFrame, tier: Column | None = None) -> DataFrame:
    """``terms, inconsistent, preferred_varied`` of a term usage table; terms that a
    glossary only prefers vary freely. usage: consistent."""
    loose = F.lit(False) if tier is None else F.coalesce(tier == "preferred", F.lit(False))
    return usage.agg(F.count("*").alias("terms"), F.count_if(~F.col("consistent") & ~loose).alias("inconsistent"), F.count_if(~F.col("consistent") & loose).alias("preferred_varied"))


def usage_report(usage: DataFrame) -> DataFrame:
    """One row, ``json``: the summary of a term usage table and its terms, inconsistent
    ones first, each group in the glossary's order. Tiers are named only where some term
    has one. A glossary is bounded by its maximum of terms, so its report is one value."""
    tiered = F.max(F.col("tier").isNotNull())
    terms = F.array_sort(F.collect_list(F.struct("consistent", "ord", "term", "translation", "segments", "option_counts_", "missing", "tier")))
    loose = F.col("tier").eqNullSafe(F.lit("preferred"))
    rows = usage.withColumn("option_counts_", F.to_json("option_counts"))  # a map has no order to sort by
    out = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("consistent") & ~loose).alias("off"), F.count_if(~F.col("consistent") & loose).alias("varied"), F.coalesce(tiered, F.lit(False)).alias("tiered"), terms.alias("terms"))
    named = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), x["translation"].alias("translation"), x["segments"].alias("segments"), F.from_json(x["option_counts_"], "map<string,bigint>").alias("option_counts"), x["missing"].alias("missing"), x["tier"].alias("tier"), x["consistent"].alias("consistent")))
    summary = F.struct(F.col("n").alias("terms"), F.col("off").alias("inconsistent"), F.when(F.col("tiered"), F.col("varied")).alias("preferred_varied"))
    return out.select(F.to_json(F.struct(summary.alias("summary"), named.alias("terms"))).alias("json"))
