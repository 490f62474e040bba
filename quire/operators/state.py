"""Joins between ordered segments and saved state, and checks of that state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.numbering import numbered


def pending(segments: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Segments without a saved translation."""
    return segments.join(state.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def restored(segments: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Segments with what was saved for them, null where nothing was."""
    return segments.join(state, key, "left")


def unknown_state(state: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Saved rows whose segment does not exist; must be empty before a resume."""
    return state.join(segments.select(key), key, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1")


def upsert(state: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key; changes win over state with an equal version."""
    both = state.withColumn("from_", F.lit(0)).unionByName(changes.withColumn("from_", F.lit(1)))
    ranked = both.withColumn("rank_", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version), F.desc("from_"))))
    return ranked.filter("rank_ = 1").drop("from_", "rank_")


def identity_diff(stored: DataFrame, expected: DataFrame, hard: list[str], key: str) -> DataFrame:
    """``key, field, stored, expected, hard`` of every field of a run that differs between
    two tables with a row a run; a field or run of one side only differs from null."""

    def long(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != key]
        pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.col(c).cast("string") for c in fields]))
        return df.select(key, F.explode(pairs).alias("field", name))

    both = long(stored, "stored").join(long(expected, "expected"), [key, "field"], "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("expected"))).withColumn("hard", F.col("field").isin(hard))


def reply_ids(expected: DataFrame, found: DataFrame, group: str, number: str) -> DataFrame:
    """For each group its expected numbers 1 to n against those of a reply: counts
    of missing, extra and repeated numbers. expected: group, n."""
    want = expected.filter("n > 0").select(group, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias(number))
    got = found.groupBy(group, number).agg(F.count("*").alias("times"))
    both = want.withColumn("wanted", F.lit(1)).join(got, [group, number], "full")
    return both.groupBy(group).agg(
        F.count_if(F.col("times").isNull()).alias("missing"),
        F.count_if(F.col("wanted").isNull()).alias("extra"),
        F.count_if(F.col("times") > 1).alias("repeated"),
    )


def strict_sum(x):
    """A sum that is null as soon as one value is."""
    return F.when(F.count("*") == F.count(x), F.sum(x))


def distinct_sorted(x):
    return F.array_sort(F.collect_set(x))


def run_state(exit_code, ended, pid_alive):
    """running, finished, stopped, failed or ended."""
    return F.when(pid_alive, "running").when(exit_code == 0, "finished").when(exit_code < 0, "stopped").when(exit_code.isNotNull(), "failed").otherwise("ended")


def sample_places(total, n: int):
    """0-based places of a sample of n out of total rows, total a column of more than
    n: the first, the middle, the last, then k n-ths of the whole, each moved on by
    one when taken; the sample ends early when that is taken or past the end too."""
    if n < 1:
        raise ValueError("a sample has one row at least")
    fixed = [F.lit(0).cast("long"), F.expr("0L") + F.floor(total / 2), F.expr("0L") + total - 1][:n]
    out, more = F.array(*fixed), F.lit(True)
    for k in range(len(fixed), n):
        at = F.floor(total * k / n)
        moved = F.when(F.array_contains(out, at), at + 1).otherwise(at)
        more = more & ~F.array_contains(out, moved) & (moved < total)
        out = F.when(more, F.concat(out, F.array(moved))).otherwise(out)
    return out


def head_middle_tail(rows: DataFrame, group: str, order: str, n: int = 3) -> DataFrame:
    """n rows of each group at the places of ``sample_places``; all rows of a group
    that has no more."""
    placed = numbered(rows, [order], [group], "at_", "of_")
    wanted = F.array_contains(sample_places(F.col("of_"), n), F.col("at_") - 1)
    return placed.filter((F.col("of_") <= n) | wanted).drop("at_", "of_")
