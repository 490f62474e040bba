"""A small table beside a large one, in each task once.

A value that every task needs (an automaton's words, a block of queries) would be
copied to each row by a join. Here the first row of each partition carries it and
the others carry null, so a scan in Python receives it once and no job runs to build
the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition are numbered in the low bits of a monotonically increasing id.
ROW_BITS = (1 << 33) - 1


def beside_first(rows: DataFrame, block: DataFrame) -> DataFrame:
    """rows with the columns of block, filled in the first row of each partition only.

    block has one row. It is broadcast, so the caller bounds its size. The order of
    rows inside a partition stays as it is."""
    first = F.when(F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)) == 0, F.lit(True))
    right = block.withColumn("block_", F.lit(True))
    return rows.withColumn("first_", first).join(F.broadcast(right), F.col("first_") == F.col("block_"), "left").drop("first_", "block_")


#: Bytes of an Arrow batch between the JVM and Python; a longer row is one batch.
BATCH_BYTES = 1 << 23


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are counted in rows by default, whatever their texts take; for this
    session they are bounded in bytes too."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
