"""Connected components of an edge table by alternating large and small stars.

Every step is grouped minima and joins, with a table in the shared folder after
it; nothing is gathered on the driver but a count. Trees halve in depth, so the
number of steps grows with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours go to the least of its neighbourhood.
    Small star: so do its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: _base.Scratch, tag: str) -> DataFrame:
    """edges: ``u``, ``v`` of one orderable kind. Returns ``node``, ``root`` for all
    nodes of at least one edge between different nodes, root the least node
    reachable. Null ends, self-links, repeated and reversed edges are ignored."""
    now = scratch.keep(edges.filter("u <> v").select("u", "v").distinct(), f"{tag}0")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, step = None, 0
    while (mark := print_of(now)) != before:
        before, step = mark, step + 1
        now = scratch.keep(_stars(_stars(now, True), False), f"{tag}{step}")
        scratch.drop(f"{tag}{step - 1}")
    pairs = now.groupBy("u").agg(F.min("v").alias("v"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
