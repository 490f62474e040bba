"""What runs leave behind: progress, usage, saved replies, identities, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def final_pairs(segments: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Segments that have a saved text, with it: what a report is made of."""
    return segments.join(state, key)


def to_probe(segments: DataFrame, state: DataFrame, probed: DataFrame, key: str) -> DataFrame:
    """Restored segments with their text that no probe has seen."""
    return final_pairs(segments, state, key).join(probed.select(key), key, "left_anti")


def progress(batches: DataFrame, book: str, order: str, n: str) -> DataFrame:
    """Adds ``done``: how many segments of a book are translated after each batch."""
    return batches.withColumn("done", F.sum(n).over(W.partitionBy(book).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def saved_count(state: Column) -> Column:
    """The number of saved segments that a checkpoint file states, without a check of
    the rest: 0 when there is no file, null when it cannot be read."""
    v = F.try_parse_json(state)
    n = F.try_variant_get(v, "$.translated_segment_count", "variant")
    whole = F.schema_of_variant(n) == "BIGINT"
    return F.when(state.isNull(), 0).when(whole, F.try_variant_get(n, "$", "bigint"))


def log_tail(logs: DataFrame, text: str, n: int = 20) -> DataFrame:
    """The text's last lines; a line end at the end is no line."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r?\n$", ""), r"\r?\n", -1)
    some = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(lines, F.greatest(F.size(lines) - n, F.lit(0)) + 1, F.lit(n)))
    return logs.withColumn("tail", some)


def verdict(stored: dict[str, Column], expected: dict[str, Column], hard: tuple[str, ...], force: bool = False, hard_only: bool = False, deferred: tuple[str, ...] = ()) -> Column:
    """``mismatches`` and ``refused`` of saved state: hard fields that differ always
    refuse, others unless forced or only hard ones are asked for; deferred ones are
    not looked at yet."""
    if set(stored) != set(expected):
        raise ValueError("incomplete identity")
    names = [k for k in expected if k in hard or k not in deferred]
    differ = F.array_compact(F.array(*[F.when(~stored[k].eqNullSafe(expected[k]), F.lit(k)) for k in names]))
    bad = F.exists(differ, lambda x: x.isin(*hard)) if hard else F.lit(False)
    return F.struct(differ.alias("mismatches"), (bad | (F.lit(not force and not hard_only) & (F.size(differ) > 0))).alias("refused"))


def usage_totals(usage: DataFrame, version: str, *sums: str) -> DataFrame:
    """Totals over all runs of an append-only table: the latest row of each run counts,
    and a total is null as soon as one of its values is."""
    last = usage.groupBy("run").agg(*[F.max_by(c, version).alias(c) for c in sums])
    return last.agg(F.count("*").alias("runs"), *[F.when(F.count("*") == F.count(c), F.sum(c)).alias(c) for c in sums])


def unsaved_calls(calls: DataFrame, saved: DataFrame) -> DataFrame:
    """Calls whose reply is not saved, each digest once. A reply is saved once it parses."""
    return calls.dropDuplicates(["digest"]).join(saved.select("digest"), "digest", "left_anti")


def savable(replies: DataFrame, error: str = "error") -> DataFrame:
    """Of replies those that parse; others are asked for again."""
    return replies.filter(F.col(error).isNull()).drop(error)


def audit(requests: DataFrame) -> DataFrame:
    """One JSON row a run: its requests in order and their totals."""
    n = ("input_tokens", "output_tokens")
    rows = requests.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("ord", "model", *n))).alias("requests"), *[F.when(F.count("*") == F.count(c), F.sum(c)).alias(c) for c in n])
    summary = F.struct(F.size("requests").alias("requests"), *n)
    return rows.select("run", F.to_json(F.struct(F.col("run").alias("run_id"), "requests", summary.alias("summary"))).alias("json"))


def mixed_models(used: Column, model: Column, enabled: Column, trial: Column) -> Column:
    """Whether a run would mix models where one of them is on trial."""
    others = F.array_intersect(F.array_except(used, F.array(model)), enabled)
    return (F.size(others) > 0) & (F.array_contains(trial, model) | (F.size(F.array_intersect(others, trial)) > 0))


def vendors_of(models: DataFrame, prefixes: DataFrame, strict: bool = False) -> DataFrame:
    """Each row of models with its family's vendor: that of the first prefix, in order of
    ``ord``, that the model begins with. An unknown model has none, or with strict is an
    error. prefixes: prefix (not empty), vendor, ord; they meet distinct models by their
    first letter."""
    names = models.select("model").distinct().withColumn("head_", F.left("model", F.lit(1)))
    known = prefixes.withColumn("head_", F.left("prefix", F.lit(1)))
    fit = names.join(known, "head_").filter(F.col("model").startswith(F.col("prefix")))
    fit = fit.groupBy(F.col("model").alias("model_")).agg(F.min_by("vendor", "ord").alias("vendor"))
    out = models.join(fit, F.col("model") == F.col("model_"), "left").drop("model_")
    unknown = F.raise_error(F.concat(F.lit("no vendor is known for model "), F.coalesce("model", F.lit("null")))).cast("string")
    return out.withColumn("vendor", F.coalesce("vendor", unknown)) if strict else out


def presets_with_vendors(presets: DataFrame, prefixes: DataFrame, asked: DataFrame) -> DataFrame:
    """The vendor that each asked preset name stands for, by the model of the preset;
    ``error`` where no preset has the name."""
    named = vendors_of(presets.select("preset", "model"), prefixes).withColumn("there_", F.lit(True))
    error = F.when(F.col("there_").isNull(), F.concat(F.lit("unknown preset: "), F.col("preset")))
    return asked.join(named, "preset", "left").withColumn("error", error).drop("there_")


def presets_in_order(presets: DataFrame) -> DataFrame:
    """``rank``: default presets first, each group in its own order."""
    return presets.withColumn("rank", F.row_number().over(W.partitionBy("runtime").orderBy(F.col("status") != "default", "ord")).cast("bigint"))


def certified(runs: DataFrame, certificates: DataFrame, *keys: str) -> DataFrame:
    """Runs whose whole identity is certified."""
    return runs.join(certificates.select(*keys).distinct(), list(keys), "left_semi")
