"""Line deduplication by sorted ranges of line hashes.

Lines become (hash, document, positions) rows; text stays where it is. Rows are
range-partitioned and sorted by hash, document and row, so one very common line
spreads over as many partitions as it needs, and each partition is streamed
once: a line's occurrences arrive in order of document, and all but the last of
three or more are refused at once. Only the first and last line of a partition
can continue in a neighbour; what is undecided of them (a few rows a partition)
is settled by a second, tiny step. Refused positions become one compressed keep
bitmap a document, and bitmaps, not texts, come back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from . import _base

MIN_CHARS, MIN_DOCS = 20, 3
LEAST_ID = -(2**63)
STRIP = " \t\n\x0b\x0c\r"
OUT = "kind int, doc long, row long, pos array<int>, h1 long, h2 long, weight long"


def keys_of(text):
    """Lines of a text and their keys."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda x: F.trim(_base.ascii_lower(x), F.lit(STRIP)))


def stream(rows_needed: int):
    """Over sorted (h1, h2, doc, row, pos) batches: kind 0 rows are refused, kind 1
    rows wait for the neighbour partitions, with the number of documents they
    stand for as weight."""

    class Run:
        """Occurrences of one line in this partition: complete documents seen and
        the rows of the latest document, which may yet stay."""

        def __init__(self, key, first):
            self.key, self.first, self.docs, self.held, self.late = key, first, 0, [], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Run | None = None
        early: list = []  # rows of a run that has fewer than rows_needed documents so far

        out: list = []

        def close(last: bool) -> None:
            nonlocal early
            if now is None:
                return
            kept = early + now.held
            if now.first or last:
                docs = {r[0] for r in kept}
                settled = now.docs - len(docs)
                seen = set()
                for r in kept:
                    weight = (0 if r[0] in seen else 1) + (settled if not seen else 0)
                    seen.add(r[0])
                    out.append((1, *r, *now.key, weight))
            early = []

        for batch in batches:
            h1, h2, doc, row = (batch.column(i).to_numpy() for i in range(4))
            pos = batch.column(4)
            n = len(h1)
            if not n:
                continue
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, n]
            for i in range(len(starts)):
                a, b = int(starts[i]), int(ends[i])
                key = (int(h1[a]), int(h2[a]))
                if now is None or now.key != key:
                    if b - a == 1 and now is not None and i + 1 < len(starts):
                        # the common case: a line met once, inside the partition
                        close(False)
                        now = Run(key, False)
                        continue
                    close(False)
                    now = Run(key, now is None)
                for j in range(a, b):
                    d = int(doc[j])
                    if now.late != d:
                        now.docs, now.late = now.docs + 1, d
                        early, now.held = early + now.held, []
                        if now.docs >= rows_needed and early:
                            out.extend((0, *r, *key, 0) for r in early)
                            early = []
                    now.held.append((d, int(row[j]), pos[j].as_py()))
            if len(out) > 20_000:
                yield table(out)
                out = []
        close(True)
        yield table(out)

    def table(out: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*out)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in OUT.split(", ")])

    return run


def refused(docs: DataFrame, text: str, id_: str, min_chars: int, min_docs: int, scratch: _base.Scratch) -> DataFrame:
    """(doc, row, pos): positions of lines to drop; row is a fingerprint of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # the whole text is hashed once a document, below the explode, not once a line
    rows = docs.select(F.coalesce(F.col(id_).cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(whole).alias("row"), keys_of(F.col(text)).alias("keys"))
    rows = rows.select("doc", "row", F.posexplode("keys").alias("p", "key")).filter(F.length("key") >= min_chars)
    rows = rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "row", F.array("p").alias("pos"))
    rows = scratch.keep(rows, "hashes")  # the splitters are sampled from it, then it is dealt
    ordered = rows.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "row")
    found = scratch.keep(ordered.mapInArrow(stream(min_docs), OUT), "lines")
    scratch.drop("hashes")
    waiting = found.filter("kind = 1")
    # at most a few rows a partition, grouped by line
    total = waiting.groupBy("h1", "h2").agg(F.sum("weight").alias("docs"), F.max("doc").alias("last"))
    late = waiting.join(total, ["h1", "h2"]).filter((F.col("docs") >= min_docs) & (F.col("doc") < F.col("last")))
    return found.filter("kind = 0").select("doc", "row", "pos").unionByName(late.select("doc", "row", "pos"))


def pack(n: int, drop: list[int]) -> bytes:
    """Whole bytes that end at or after line n; lines past them are kept."""
    keep = np.ones(-(-n // 8) * 8, bool)
    keep[drop] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


@F.pandas_udf(types.BinaryType())
def bitmaps(size: pd.Series, pos: pd.Series) -> pd.Series:
    """Compressed keep bitmaps of size lines each, without the listed positions."""
    return pd.Series([pack(int(n), [x for part in p for x in part]) for n, p in zip(size, pos)])


@F.pandas_udf(types.StructType().add("n_lines", types.LongType()).add("n_dropped", types.LongType()).add("kept", types.StringType()))
def apply_bitmap(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    rows = []
    for t, k in zip(text, keep):
        lines = (t or "").split("\n")
        if k is None:
            rows.append((len(lines), 0, t or ""))
            continue
        mask = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8))[: len(lines)]
        kept = [x for x, m in zip(lines, mask) if m] + lines[len(mask) :]
        rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def keep_bitmaps(docs: DataFrame, text: str = "text", id_: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, keep): the documents that lose a line, by id (a null id as the
    least long) and text fingerprint, with their compressed keep bitmap."""
    scratch = _base.Scratch(docs.sparkSession)
    drops = refused(docs, text, id_, min_chars, min_docs, scratch)
    flat = drops.groupBy("doc", "row").agg(F.collect_list("pos").alias("pos"), F.max(F.array_max("pos")).alias("top"))
    return flat.select("doc", "row", bitmaps(F.col("top") + 1, "pos").alias("keep"))


def dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with the text cut to its kept lines, and a struct column
    ``lines`` (n_lines, n_dropped) after them.

    A line's key is the line stripped of ASCII whitespace with A-Z lower-cased.
    A key of at least min_chars code points found in at least min_docs documents
    loses all its lines except in the document of the largest id; ids decide, so
    rows that repeat an id count as one document. A null or empty text is one
    empty line; a null id sorts below all others. Rows are never added or lost.
    Keys are told apart by 128-bit hashes; a text's lines cost time in proportion
    to their number, whatever it is.
    """
    _base.small_batches(docs.sparkSession)
    maps = keep_bitmaps(docs, text, id_, min_chars, min_docs)
    d, r, k, out = (_base.unused(docs, x) for x in ("doc_", "row_", "keep_", "lines"))
    left = docs.withColumns({d: F.coalesce(F.col(id_).cast("long"), F.lit(LEAST_ID)), r: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    right = maps.select(F.col("doc").alias(d), F.col("row").alias(r), F.col("keep").alias(k))
    joined = left.join(right, [d, r], "left").withColumn(k, apply_bitmap(F.col(text), F.col(k)))
    cols = [F.col(f"{k}.kept").alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*cols, F.struct(f"{k}.n_lines", f"{k}.n_dropped").alias(out))
