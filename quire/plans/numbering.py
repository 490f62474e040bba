"""Row numbers without a task that sees a whole group: rows are sorted by range, each
partition numbers its own, and what stands before it is added. A group of any size
spreads over as many partitions as it needs; only sizes, one for each group and
partition, meet in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import keep


def numbered(rows: DataFrame, order: list[Column | str], group: list[str] | None = None, number: str = "at", total: str = "of") -> DataFrame:
    """rows with their 1-based number in the group (the whole table by default) and the
    group's size. Rows of equal order are numbered in some order."""
    group = group or []
    kept = keep(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("seq_", F.monotonically_increasing_id()))
    kept = kept.withColumn("part_", F.shiftright("seq_", 33))
    sizes = kept.groupBy(*group, "part_").agg(F.count("*").alias("n_"), F.min("seq_").alias("first_"))
    whole = W.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("n_").over(whole.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(g).alias(f"g{i}_") for i, g in enumerate(group)], F.col("part_").alias("own_"), "first_", F.coalesce(before, F.lit(0)).alias("before_"), F.sum("n_").over(whole).alias("total_"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"g{i}_")) for i, g in enumerate(group)], F.col("part_") == F.col("own_"))
    out = kept.join(sizes, same)
    return out.select(*rows.columns, (F.col("before_") + F.col("seq_") - F.col("first_") + 1).alias(number), F.col("total_").alias(total))
