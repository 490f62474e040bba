"""Size-bounded batch plans, packed in parallel.

A batch's end depends on where it began, yet where the batch that begins at a given
row would end depends on that row alone: a binary search in the prefix sums. So every
row has a successor, and the batches of a book are the path from its first row.

1. Rows are numbered by sorted ranges and dealt to chunks of consecutive rows, each
   with a copy of the rows that a batch can still take from the next chunk.
2. Each chunk follows successors inside itself for the rows at its head, where batches
   of the chunk before may end: the first row past the chunk, and how many batches
   lie between.
3. These few jumps from chunk to chunk are squared (pointer doubling) until every
   chunk knows at which row, and with which number, its first batch begins.
4. Each chunk follows its own path from there.

No task holds more than a chunk, whatever the length of a book."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import keep
from .numbering import numbered

MAX_CHARS, SEPARATOR, MAX_SEGMENTS = 60_000, 6, 200
#: Rows of a chunk.
CHUNK = 1 << 16


def successors(size: np.ndarray, limit: int, separator: int, most: int | None) -> np.ndarray:
    """For each row the first row that its batch does not take, if it began there; the
    number of rows where it takes all."""
    n = len(size)
    used = np.append(0, np.cumsum(size)) + separator * np.arange(n + 1)
    last = np.searchsorted(used, used[:-1] + limit + separator, "right") - 1
    first = np.arange(n)
    return np.maximum(first + 1, np.minimum(last, first + most) if most is not None else last)


def jumps(following: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row before end, the first row at or past end on its path, and the batches
    up to it, by repeated squaring."""
    to, steps = np.minimum(following[:end], end), np.ones(end + 1, np.int64)
    leaving = following[:end] >= end
    exits = np.append(np.where(leaving, following[:end], 0), 0)
    to, steps[end] = np.append(to, end), 0
    while True:
        inside = to[:end] < end
        if not inside.any():
            return exits[:end], steps[:end]
        # a row whose jump stays inside goes on from where it lands
        land = to[:end][inside]
        at = np.flatnonzero(inside)
        exits[at], steps[at], to[at] = np.where(to[land] >= end, exits[land], 0), steps[at] + steps[land], to[land]


def _packed(rows: DataFrame, out: str, limit: int, separator: int, most: int | None, chunk: int | None = None) -> DataFrame:
    """rows (book, ord, size and more) with the number of their batch."""
    chunk = max(chunk or CHUNK, most or 1)
    kept = numbered(rows, ["ord"], ["book"])
    longest = kept.agg(F.max("of")).first()[0] or 0
    kept = kept.withColumn("chunk", F.floor((F.col("at") - 1) / chunk))
    if longest <= chunk:
        starts = kept.filter("at = 1").select("book", F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("entry"), F.lit(0).cast("long").alias("base"))
        return _numbered_batches(kept, starts, out, limit, separator, most)
    edges, head = None, most or chunk
    while edges is None:  # only where a batch has more rows than a chunk are chunks made larger
        found = keep(_chunk_jumps(kept, chunk, head, limit, separator, most))
        if found.filter("exit is null").limit(1).count():
            chunk *= 8
            head = chunk
            kept = kept.withColumn("chunk", F.floor((F.col("at") - 1) / chunk))
        else:
            edges = found
    lengths = kept.filter("at = 1").select(F.col("book").alias("b_"), "of")
    starts = _entries(edges, -(-longest // chunk)).join(lengths, F.col("book").eqNullSafe(F.col("b_")))
    starts = starts.withColumn("chunk", F.floor((F.least("entry", "of") - 1) / chunk))  # a path's end belongs to the last chunk
    first = starts.groupBy("book", "chunk").agg(F.min_by(F.struct("entry", "base"), "entry").alias("s")).select("book", "chunk", "s.entry", "s.base")
    return _numbered_batches(kept, first, out, limit, separator, most)


def _chunk_jumps(kept: DataFrame, chunk: int, head: int, limit: int, separator: int, most: int | None) -> DataFrame:
    """(book, entry, exit, steps) of the first head rows of each chunk; exit is null where
    the rows at hand do not hold the whole batch."""
    offset = (F.col("at") - 1) % chunk
    own = kept.select("book", "chunk", "at", "of", "size")
    ahead = own.filter((F.col("chunk") > 0) & (offset < head)).withColumn("chunk", F.col("chunk") - 1)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        at, of = group["at"].to_numpy(), group["of"][0].as_py()
        following = successors(group["size"].to_numpy(), limit, separator, most)
        end = int(np.searchsorted(at, (at[0] - 1) // chunk * chunk + chunk, "right"))
        exits, steps = jumps(following, end)
        # a batch that takes the last row at hand may take more, unless the book ends there
        whole = (exits < len(at)) | (at[-1] == of)
        n = min(head, end)
        values = [pa.array(at[:n]), pa.array(exits[:n] + at[0], mask=~whole[:n]), pa.array(steps[:n])]
        return pa.table([group["book"].combine_chunks().slice(0, 1).take(pa.array(np.zeros(n, np.int64))), *values], ["book", "entry", "exit", "steps"])

    kind = kept.schema["book"].dataType.simpleString()
    return own.unionByName(ahead).groupBy("book", "chunk").applyInArrow(run, f"book {kind}, entry long, exit long, steps long")


def _entries(edges: DataFrame, chunks: int) -> DataFrame:
    """(book, entry, base): the rows where paths enter a chunk, with the batches before
    them. After k rounds the paths are known 2**k chunks far."""
    reached = edges.filter("entry = 1").select("book", "entry", F.lit(0).cast("long").alias("base"))
    hop = edges
    for _ in range(max(1, (chunks + 1).bit_length())):
        a, b = reached.alias("a"), hop.alias("b")
        on = F.col("a.book").eqNullSafe(F.col("b.book")) & (F.col("a.entry") == F.col("b.entry"))
        further = a.join(b, on).select("a.book", F.col("b.exit").alias("entry"), (F.col("a.base") + F.col("b.steps")).alias("base"))
        reached = keep(reached.unionByName(further).distinct())
        c = hop.alias("c")
        on = F.col("b.book").eqNullSafe(F.col("c.book")) & (F.col("b.exit") == F.col("c.entry"))
        hop = keep(b.join(c, on).select("b.book", "b.entry", "c.exit", (F.col("b.steps") + F.col("c.steps")).alias("steps")))
    return reached


def _numbered_batches(kept: DataFrame, starts: DataFrame, out: str, limit: int, separator: int, most: int | None) -> DataFrame:
    """starts: (book, chunk, entry, base): the first batch to begin in a chunk or, where
    none does, after it."""
    columns = [c for c in kept.columns if c not in ("at", "of", "chunk")]
    a, b = kept.alias("a"), starts.alias("b")
    on = F.col("a.book").eqNullSafe(F.col("b.book")) & (F.col("a.chunk") == F.col("b.chunk"))
    joined = a.join(b, on).select("a.*", "b.entry", "b.base")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        at = group["at"].to_numpy()
        i, number = group["entry"][0].as_py() - at[0], group["base"][0].as_py()
        following = successors(group["size"].to_numpy(), limit, separator, most).tolist()
        begins = np.zeros(len(at), np.int64)
        while i < len(at):
            begins[i] = 1
            i = following[i]
        return group.select(columns).append_column(out, pa.array(number - 1 + np.cumsum(begins)))

    fields = [kept.schema[c] for c in columns]
    return joined.groupBy("book", "chunk").applyInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {out} bigint")


def plan_batches(segments: DataFrame, book: str, order: str, text: str, max_chars: int = MAX_CHARS, separator: int = SEPARATOR, max_segments: int | None = MAX_SEGMENTS, chunk: int | None = None) -> DataFrame:
    """``book, ord, chars, batch_id``: consecutive segments of a book share a batch
    while their characters and separators fit max_chars and their number
    max_segments; a segment that alone exceeds the limit is a batch of its own."""
    if max_chars < 1 or separator < 0 or (max_segments is not None and max_segments < 1):
        raise ValueError("limits must be positive")
    rows = segments.select(F.col(book).alias("book"), F.col(order).alias("ord"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("size"))
    return _packed(rows, "batch_id", max_chars, separator, max_segments, chunk).withColumnRenamed("size", "chars")


def batch_summary(plan: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    return plan.groupBy("book", "batch_id").agg(F.count("*").alias("segments"), (F.sum("chars") + (F.count("*") - 1) * separator).alias("chars"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def head_word_chunks(groups: DataFrame, max_size: int, chunk: int | None = None) -> DataFrame:
    """``book, ord, head, size, chunk_id``: groups of one head word are never split;
    a chunk takes groups in order while they fit. A group that alone is too large
    is an error, as is a book's only group."""
    message = F.concat(F.lit("head word "), F.coalesce("head", F.lit("")), F.lit(" needs "), F.col("size").cast("string"), F.lit(f", over {max_size}; lower the term limit"))
    size = F.when(F.col("size") > max_size, F.raise_error(message).cast("long")).otherwise(F.col("size").cast("long"))
    return _packed(groups.select("book", "ord", "head", size.alias("size")), "chunk_id", max_size, 0, None, chunk)
