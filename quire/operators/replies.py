"""Saved replies and records that are written once.

A reply is found by its content key, the digest of model and prompt, so a reused one is
never stale. The table is append-only and its readers take one row a digest, so tasks
that run again, or two runs at once, do no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import exists
from .runs import savable

SCHEMA = "digest string, reply string, saved_at timestamp"


def saved(spark, path: str) -> DataFrame:
    """``digest, reply``: of each digest the reply that was saved first, the least of equals."""
    if not exists(spark, path):
        return spark.createDataFrame([], "digest string, reply string")
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.groupBy("digest").agg(F.min_by("reply", F.struct("saved_at", "reply")).alias("reply"))


def save(replies: DataFrame, path: str) -> None:
    """Appends the replies (digest, reply, error) that parsed and whose digest is not
    saved yet, each digest once; others are asked for again on the next run."""
    good = savable(replies.select("digest", "reply", "error")).filter("digest is not null and reply is not null")
    new = good.groupBy("digest").agg(F.min("reply").alias("reply")).join(saved(replies.sparkSession, path).select("digest"), "digest", "left_anti")
    new.withColumn("saved_at", F.current_timestamp()).write.mode("append").option("compression", "zstd").parquet(path)


def calls(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``purpose, made, reused``: how many calls of each purpose a run has to make, each
    digest once, and how many it takes from saved replies. asked: purpose, digest."""
    rows = asked.select("purpose", "digest").join(known.select("digest", F.lit(True).alias("known_")), "digest", "left")
    return rows.groupBy("purpose").agg(F.countDistinct(F.when(F.col("known_").isNull(), F.col("digest"))).alias("made"), F.count("known_").alias("reused"))


def finished(records: DataFrame, ends: DataFrame) -> DataFrame:
    """Run records with the end of each run: an end that a record has stays as it is, and
    of several reports the first by ``at`` counts. records: run, exit_code, ended_at and
    more; ends: run, exit_code, at."""
    first = ends.groupBy("run").agg(F.min_by(F.struct("exit_code", "at"), F.struct("at", "exit_code")).alias("end_"))
    rows = records.join(first, "run", "left")
    done = F.col("ended_at").isNotNull()
    return rows.withColumns({"exit_code": F.when(done, F.col("exit_code")).otherwise(F.col("end_.exit_code")), "ended_at": F.coalesce("ended_at", "end_.at")}).drop("end_")


def certified_anew(certificates: DataFrame, probes: DataFrame, *keys: str) -> DataFrame:
    """Certificates to append: keys of probes of which each is without a problem, and
    that have none yet. probes: the keys and ``problems``, an array."""
    passed = probes.groupBy(*keys).agg(F.max(F.size("problems")).alias("worst_")).filter("worst_ <= 0").select(*keys)
    return passed.join(certificates.select(*keys).distinct(), list(keys), "left_anti")
