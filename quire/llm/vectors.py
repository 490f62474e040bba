"""What the operators on vectors share: rows with whole vectors, and a stated query
set met with all rows in blocks.

Queries and rows are dealt to blocks by a hash of their row key. Each pair of a
query block and a row block is one group of a cogrouped scan, so both sides of a
group have a bounded size, a very common vector or label is spread over all row
blocks, and what leaves a group is a few rows a query, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _base

#: Components of the rows, and of the queries, of a block: 32 MB of doubles, 8 MB.
ROW_VALUES, QUERY_VALUES = 1 << 22, 1 << 20
#: Rows that are worth a block of their own while there are free cores.
LEAST_ROWS = 1 << 10
#: Scores that are held at a time.
SCORES = 1 << 21


def is_whole(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def kept(rows: DataFrame, scratch: _base.Scratch, name: str) -> DataFrame:
    """rows with a ``key`` of each, written, so that keys stay as they are when a task
    runs again."""
    return scratch.keep(rows.withColumn("key", F.monotonically_increasing_id()), name)


def in_blocks(queries: DataFrame, rows: DataFrame, scan: Callable[[pa.Table, pa.Table], pa.Table], schema: str, values: int | None = None) -> DataFrame:
    """scan over each pair of a block of queries and a block of rows. Both have the
    columns ``key`` and ``vec``."""
    spark = rows.sparkSession
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0))).first()
    asked = queries.agg(F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0))).first()[0]
    by_row = max(-(-size // (values or ROW_VALUES)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS)), 1)
    by_query = max(-(-asked // ((values or ROW_VALUES) * QUERY_VALUES // ROW_VALUES or 1)), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    left = queries.withColumn("i", part(by_query)).withColumn("j", every(by_row))
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # both sides may read one table: Spark must see columns of their own
    right = rows.withColumn("j", part(by_row)).withColumn("i", every(by_query))
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    nothing = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))]).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return scan(a, b) if a.num_rows and b.num_rows else nothing  # a side without rows has no columns either

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


class Rows:
    """One side of a group in order of id, a null id first: arrays of its columns and
    its vectors as a matrix. A shorter vector ends in zeros."""

    def __init__(self, table: pa.Table, dim: int = 0):
        table = table.combine_chunks()
        ids = table["id"]
        self.valid = ids.is_valid().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy()
        order = np.lexsort((table["key"].to_numpy(), self.id, self.valid))
        self.valid, self.id, self.table = self.valid[order], self.id[order], table.take(pa.array(order))
        self.key = self.table["key"].to_numpy()
        vec = self.table["vec"].combine_chunks() if isinstance(self.table["vec"], pa.ChunkedArray) else self.table["vec"]
        size = np.diff(vec.offsets.to_numpy())
        values = vec.flatten().to_numpy(zero_copy_only=False)
        self.dim = max(dim, int(size.max(initial=0)))
        if (size == self.dim).all():
            self.x = values.reshape(len(size), self.dim)
        else:
            self.x = np.zeros((len(size), self.dim), values.dtype)
            self.x[np.arange(self.dim) < size[:, None]] = values

    def __len__(self) -> int:
        return len(self.key)

    def ids(self, at) -> pa.Array:
        """Ids of the rows at the places at, null where they have none."""
        return pa.array(self.id[at], pa.int64(), mask=~self.valid[at])


def least(value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least values, equal ones in order of place."""
    if len(value) > k:
        edge = np.partition(value, k - 1)[k - 1]
        near = np.flatnonzero(value <= edge)  # with all that tie for the last place
    else:
        near = np.arange(len(value))
    return near[np.argsort(value[near], kind="stable")[:k]]


def nearest_first(found: DataFrame, by: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first k rows of each key with their rank. Spark keeps k rows a key and task
    before it shuffles."""
    from pyspark.sql import Window

    return found.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)
