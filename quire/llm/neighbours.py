"""Approximate nearest neighbours by multiprobe p-stable hashing.

A row's code in a table is floor((x . a + b) / width) for CODES Gaussian directions
a; rows of equal codes share a bucket. Every row is hashed once into TABLES tables
and the hashes are written with it: the index. Row blocks sort their rows by bucket.

A query visits its own bucket and perturbed ones: a perturbation moves some codes
by one. For a neighbour at distance r each code is normal around the query's own
projection, so the chance that it lies in a perturbed bucket is a product over the
codes. Buckets are visited in falling order of that chance until, over all tables,
a neighbour at distance r is found with probability RECALL; r is the distance of
the query's k-th neighbour in a bounded sample, at least that in all rows.
Candidates of all tables are merged and measured exactly.

The sets of perturbations tried are the PROBES likeliest for an average query. If
for some query these do not reach RECALL, its blocks are measured whole, so the
bound on probes costs time and not results.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base, vectors

K = 10
TABLES, CODES, PROBES = 10, 12, 2048
#: Bucket width in medians of the sample's k-th distances.
WIDTH = 2.5
#: Estimated chance of finding a row that is as near as the sample's k-th.
RECALL = 0.95
#: Bound of the fit: rows of the sample, and components of all of them.
SAMPLE_ROWS, SAMPLE_VALUES = 4096, 1 << 20
SEED = 20


@lru_cache
def perturbations(codes: int, most: int) -> np.ndarray:
    """The likeliest sets of perturbations, as rows of 0 and 1. Column j is the j-th
    nearest of the 2 * codes bucket walls; columns j and 2 * codes - 1 - j are the two
    walls of one code, of which a set has one at most. Sets come in order of their
    expected squared distance, for projections that are uniform in their buckets."""
    j = np.arange(1, codes + 1)
    near = j * (j + 1) / (4 * (codes + 1) * (codes + 2))
    far = (1 - j / (codes + 1) + near)[::-1]
    cost, n = np.concatenate([near, far]), 2 * codes
    sets, heap = [()], [(cost[0], (0,))]
    while heap and len(sets) < most:
        total, last = heapq.heappop(heap)
        if not any(n - 1 - x in last for x in last):
            sets.append(last)
        end = last[-1]
        if end + 1 < n:
            heapq.heappush(heap, (total - cost[end] + cost[end + 1], (*last[:-1], end + 1)))
            heapq.heappush(heap, (total + cost[end + 1], (*last, end + 1)))
    out = np.zeros((len(sets), n))
    for i, s in enumerate(sets):
        out[i, list(s)] = 1
    return out


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return 0.5 + 0.5 * np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2))


@dataclass
class Hashes:
    """Directions, offsets and width of all tables, and the sample of the fit."""

    sample: np.ndarray
    ids: np.ndarray
    dim: int
    k: int
    width: float = 1.0
    tables: int = TABLES
    codes: int = CODES
    probes: int = PROBES
    recall: float = RECALL

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(self.dim, self.tables * self.codes))
        self.b = rng.random(self.tables * self.codes)
        self.factor = rng.integers(0, 2**63, (self.tables, self.codes)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in bucket widths: vector, table, code."""
        return (x @ self.a / self.width + self.b).reshape(len(x), self.tables, self.codes)

    def buckets(self, place: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the codes for each vector and table. Buckets of one hash are
        visited together."""
        code = np.clip(np.floor(place), -(2.0**62), 2.0**62).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return (code * self.factor).sum(axis=2, dtype=np.uint64)

    def radius(self, x: np.ndarray, id_: int) -> float:
        """Distance of the k-th row of the sample, the query's own left out; of the last
        where the sample has fewer."""
        d = np.sort(distances(x, self.sample[self.ids != id_]))
        return float(d[min(self.k, len(d)) - 1]) if len(d) else self.width

    def probes_of(self, x: np.ndarray, r: float) -> list[np.ndarray] | None:
        """For each table the hashes of the buckets to visit, likeliest first; none if
        the sets at hand do not reach the recall at distance r."""
        place = self.places(x[None])[0]
        own, inside, r = self.buckets(place[None])[0], place - np.floor(place), max(r / self.width, 1e-6)
        walls = normal(np.stack([-1 - inside, -inside, 1 - inside, 2 - inside]) / r)
        below, stay, above = np.log(np.maximum(np.diff(walls, axis=0), 1e-300))
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
        gain = np.take_along_axis(np.concatenate([below - stay, above - stay], axis=1), order, 1)
        with np.errstate(over="ignore"):
            step = np.take_along_axis(np.concatenate([np.uint64(0) - self.factor, self.factor], axis=1), order, 1)
            sets = perturbations(self.codes, self.probes)
            hashes = sets.astype(np.uint64) @ step.T + own
        chance = np.exp(sets @ gain.T + stay.sum(axis=1))
        goal, out, missed = 1 - (1 - self.recall) ** (1 / self.tables), [], 1.0
        for t in range(self.tables):
            first = np.argsort(-chance[:, t], kind="stable")
            sums = np.cumsum(chance[first, t])
            n = int(np.searchsorted(sums, goal)) + 1
            missed *= 1 - min(1.0, sums[min(n, len(sums)) - 1])
            out.append(hashes[first[:n], t])
        return out if missed <= 1 - self.recall + 1e-9 else None


def distances(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - x) ** 2).sum(axis=1))


def fit(rows: DataFrame, dim: int, k: int, **how) -> Hashes:
    """Bucket width from a bounded sample: the rows whose ids hash lowest."""
    most = max(k + 1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, dim)))
    got = rows.select("id", "key", "vec").orderBy(F.xxhash64("id"), "id", "key").limit(most).toArrow()
    if not got.num_rows:
        return Hashes(np.zeros((0, dim)), np.zeros(0, np.int64), dim, k, **how)
    part = vectors.Rows(got, dim)
    model = Hashes(part.x, np.where(part.valid, part.id, np.iinfo(np.int64).min), dim, k, **how)
    radii = [model.radius(x, i) for x, i in zip(part.x[:256], model.ids[:256])]
    model.width = WIDTH * float(np.median([r for r in radii if r > 0] or [1.0]))
    return model


FOUND = "key long, query_id long, vec_id long, score double"


def search_block(shared: _base.Shared):
    """The first k rows of a block for each query: candidates of all tables, measured."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        model = shared.value
        q, r = vectors.Rows(left, model.dim), vectors.Rows(right, model.dim)
        keys, asked, at, got = [], [], [np.zeros(0, np.int64)], [np.zeros(0)]
        flat = r.table["buckets"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(r), model.tables) if len(r) else np.zeros((0, model.tables), np.uint64)
        order = np.argsort(flat, axis=0, kind="stable")
        tables = [(flat[order[:, t], t], order[:, t]) for t in range(model.tables)]
        for i in range(len(q)):
            probes = model.probes_of(q.x[i], model.radius(q.x[i], q.id[i]))
            near = np.full(len(r), probes is None)
            for (bucket, row), wanted in zip(tables, probes or []):
                lo, hi = np.searchsorted(bucket, wanted, "left"), np.searchsorted(bucket, wanted, "right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    near[row[a:b]] = True
            near &= ~(r.valid & (r.id == q.id[i]))
            rows = np.flatnonzero(near)  # in order of id
            d = distances(q.x[i], r.x[rows])
            first = vectors.least(d, model.k)
            keys.append(np.full(len(first), q.key[i]))
            asked.append(np.full(len(first), q.id[i]))
            at.append(rows[first])
            got.append(d[first])
        none = np.zeros(0, np.int64)
        return pa.table([pa.array(np.concatenate([none, *keys])), pa.array(np.concatenate([none, *asked])), r.ids(np.concatenate(at)), pa.array(np.concatenate(got))], ["key", "query_id", "vec_id", "score"])

    return scan


def index(rows: DataFrame, scratch: _base.Scratch, id_: str = "vec_id", vector: str = "embedding", asked: Column | None = None, k: int = K, **how) -> tuple[DataFrame, Hashes]:
    """All rows that take part, with their bucket in each table, and the hashes."""
    taken = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), F.coalesce(asked if asked is not None else F.lit(False), F.lit(False)).alias("asked"))
    taken = vectors.kept(taken.filter(vectors.is_whole(F.col("vec")) & F.exists("vec", lambda x: x != 0)), scratch, "rows")
    dim = taken.agg(F.max(F.size("vec"))).first()[0] or 0
    model = fit(taken, dim, k, **how)
    shared = _base.Shared(rows.sparkSession, model)  # a sample of bounded size and dim x tables x codes directions

    def hashed(batches):
        for batch in batches:
            if batch.num_rows:
                part = pa.Table.from_batches([batch])
                # Rows orders by id; keys bring each row's buckets with it
                r = vectors.Rows(part, shared.value.dim)
                found = shared.value.buckets(shared.value.places(r.x)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield from r.table.append_column("buckets", lists).to_batches()

    out = taken.select("key", "id", "vec", "asked").mapInArrow(hashed, "key long, id long, vec array<double>, asked boolean, buckets array<long>")
    return scratch.keep(out, "index"), model


def search(rows: DataFrame, queries: Column, k: int = K, id_: str = "vec_id", vector: str = "embedding", values: int | None = None, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean
    distance in double precision, nearest first, ties to smaller id.

    queries: a condition on rows; queries without an id take no part. Vectors that are
    null, zero or empty, or hold null or non-finite components take no part. Rows of a
    null id do, before all others where distances tie, and their id stays null. All
    rows of a query's id are its own and no candidates; a query row that is repeated
    gives its rows as often. Vectors of several lengths meet as if the shorter ended in
    zeros. An empty table gives none. Other columns are not read.
    """
    spark = rows.sparkSession
    _base.small_batches(spark)
    indexed, model = index(rows, _base.Scratch(spark), id_, vector, queries, k, **how)
    asked = indexed.filter("asked and id is not null").select("key", "id", "vec")
    found = vectors.in_blocks(asked, indexed.drop("asked"), search_block(_base.Shared(spark, model)), FOUND, values)
    return vectors.nearest_first(found, ["key"], [F.asc("score"), F.asc("vec_id")], k, "rank").select("query_id", "rank", "vec_id", "score")
