"""Hard negatives by a full score sort of each anchor.

1. Scores of an anchor are its integer inner products with all rows. In each block
   of rows the rows of the anchor's label are sorted by score and id; the first of
   all blocks, merged, are its positives.
2. In each block, rows of other labels are sorted by score and id for each anchor.
   A binary search finds where scores fall to a positive's own, the upper limit, and
   the entries from there on are read while they reach the lower limit, at most as
   many as are asked for. Merged over the blocks they are the negatives.

What leaves a block is at most ``positives`` rows an anchor, then ``negatives`` rows
an anchor and positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base, vectors

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 80, 100
SCALE = 256


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, while they fit in 64
    bits; in doubles where no sum can pass 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def sides(left: pa.Table, right: pa.Table):
    """Anchors and rows of a group, and the scores of some anchors at a time."""
    a, r = vectors.Rows(left), vectors.Rows(right)
    if a.dim != r.dim:
        a, r = vectors.Rows(left, r.dim), vectors.Rows(right, a.dim)
    step = max(1, vectors.SCORES // max(1, len(r)))

    def scores():
        for lo in range(0, len(a), step):
            for i, s in enumerate(products(a.x[lo : lo + step], r.x), lo):
                yield i, s

    return a, r, a.table["label"].to_numpy(), r.table["label"].to_numpy(), scores()


POSITIVE = "key long, p_id long, p_score long"
FOUND = "key long, anchor long, p int, p_id long, p_score long, n_id long, n_score long"


def best_of_label(k: int):
    """The first k other rows of each anchor's label in this block."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r, own, labels, scores = sides(left, right)
        keys, at, got = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, s in scores:
            same = np.flatnonzero((labels == own[i]) & ~(r.valid & (r.id == a.id[i])))
            first = same[np.lexsort((same, -s[same]))[:k]]  # rows stand in order of id
            keys.append(np.full(len(first), a.key[i]))
            at.append(first)
            got.append(s[first])
        return pa.table([pa.array(np.concatenate([at[0], *keys]), pa.int64()), r.ids(np.concatenate(at)), pa.array(np.concatenate(got))], ["key", "p_id", "p_score"])

    return scan


def between_limits(k: int, low: int, high: int):
    """For each anchor and positive, the first k rows of other labels between the
    limits in this block."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        a, r, own, labels, scores = sides(left, right)
        positives, rows = a.table["positives"].to_pylist(), []
        for i, s in scores:
            other = np.flatnonzero(labels != own[i])
            order = other[np.lexsort((other, -s[other]))]
            falling = -s[order]
            for p in positives[i]:
                top = p["p_score"]
                # the first place whose score is at most high hundredths of the positive's
                at = int(np.searchsorted(falling, -((high * top) // 100), "left"))
                for x in order[at : at + k].tolist():
                    if low * top > 100 * int(s[x]):
                        break
                    rows.append((int(a.key[i]), int(a.id[i]), p["p"], p["p_id"], top, int(r.id[x]) if r.valid[x] else None, int(s[x])))
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return scan


def mine(
    rows: DataFrame, anchors: Column, id_: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, values: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: a condition on rows; their ids must not be null. A component x counts as
    floor(scale * x). An anchor's positives are its first other rows of the same label
    by score, ties by smaller id; its negatives for a positive are the first rows of
    other labels whose score is from low to high hundredths of the positive's.

    Rows with a null label, a null vector, or a null or non-finite component take no
    part; neither does an anchor without an id. Other rows of a null id do, before all
    others where scores tie, and their id stays null. All rows of an anchor's id are
    its own; an anchor row that is repeated gives its rows as often. Vectors of several
    lengths meet as if the shorter ended in zeros; an empty one scores 0. Scores are
    exact as far as 64 bits hold them. An empty table gives none. Other columns are
    not read.
    """
    scratch = _base.Scratch(rows.sparkSession)
    _base.small_batches(rows.sparkSession)
    vec = F.col(vector).cast("array<double>")
    taken = rows.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vec.alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    taken = taken.filter(F.col("label").isNotNull() & vectors.is_whole(F.col("vec")))
    taken = vectors.kept(taken.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale))), scratch, "rows")
    asked, every = taken.filter("asked and id is not null").drop("asked"), taken.drop("asked")

    near = vectors.in_blocks(asked, every, best_of_label(positives), POSITIVE, values)
    near = vectors.nearest_first(near, ["key"], [F.desc("p_score"), F.asc("p_id")], positives, "p")
    near = near.groupBy("key").agg(F.collect_list(F.struct("p", "p_id", "p_score")).alias("positives"))  # at most as many as positives
    told = scratch.keep(asked.join(near, "key"), "positives")

    found = vectors.in_blocks(told, every, between_limits(negatives, low, high), FOUND, values)
    found = vectors.nearest_first(found, ["key", "p"], [F.desc("n_score"), F.asc("n_id")], negatives, "rank")
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank", F.col("n_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score")
    )
