"""Ranked lexical search over document-sharded postings.

1. Each Arrow pass of about SHARD_BYTES of text becomes a shard: its distinct terms,
   and in compressed sparse rows, term by term, the documents that hold it and how
   often. Arrow's dictionary encoding tells terms apart by their bytes. Shards are
   written; a document lives in one shard, so a term of every document is spread over
   all of them.
2. Numbers of documents and terms are sums over shards, document frequencies a
   grouped sum over the shards' own lists. They give each query term its weight.
3. Queries are packed into blocks of bounded size. A block is broadcast and reaches
   each task once, beside the first shard of its partition; shards stay where they are.
   A shard turns term counts into integer impacts once, then scores a query term at a
   time into a dense array of its documents. The k highest are selected with all that
   tie for the last place, and a task keeps the k best of all its shards.
4. The tasks' lists are merged for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import beside_first
from . import _base, vectors

K = 10
#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 1 << 22
#: Query terms of a block, on average, and bytes of their text.
BLOCK_TERMS, BLOCK_BYTES = 1 << 16, 1 << 20
#: Shards of a row group of the index. Writer and reader hold a row group, and Parquet looks
#: at a group's bytes only every hundred rows, so rows bound it.
GROUP_SHARDS = 4
#: Terms: anything but ASCII other than letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"

SHARD = "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<string>, df array<long>, places binary, counts binary"
FOUND = "q long, doc_id long, score long"


def term_fold() -> np.ndarray:
    """Letters, digits and bytes beyond ASCII as they are, A-Z lower-cased; others separate."""
    t = np.zeros(256, np.uint8)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        t[a:b] = np.arange(a, b)
    t[65:91] += 32
    return t


def terms_of(raw: np.ndarray, offs: np.ndarray, fold: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a slice of documents, and the number of terms of each document."""
    arr = fold[raw]
    inside = arr != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[:-1][offs[:-1] < len(arr)]
    first[cut] = inside[cut]  # no term crosses from one document to the next
    ends = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(arr[inside]))
    return terms, np.diff(np.append(0, np.cumsum(first))[offs])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice of (id, text) rows that has a term."""
    fold = term_fold()
    for batch in batches:
        for part, raw, offs in _base.passes(batch, 1, SHARD_BYTES):
            terms, size = terms_of(raw, offs, fold)
            held = np.flatnonzero(size)
            if not len(held):
                continue
            coded = terms.dictionary_encode()
            n = len(held)
            pairs, count = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), size[held]), return_counts=True)
            term, place = np.divmod(pairs, n)
            df = np.bincount(term, minlength=len(coded.dictionary))
            cols = [
                pa.array([n]),
                pa.array([len(terms)]),
                one_list(part.column(0).take(pa.array(held))),
                one_list(pa.array(size[held])),
                one_list(coded.dictionary.cast(pa.string())),
                one_list(pa.array(df)),
                pa.array([place.astype("<i4").tobytes()]),
                pa.array([count.astype("<i4").tobytes()]),
            ]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SHARD.split(", ")])


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def index(docs: DataFrame, scratch: _base.Scratch, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The shards of all documents that have a term."""
    rows = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text_"))
    return scratch.keep(rows.mapInArrow(shards, SHARD), "shards", **{"parquet.block.row.count.limit": GROUP_SHARDS})


def weights(shards_: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(term, w) of the terms that queries and documents share."""
    df = shards_.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    w = F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1).cast("double")))
    return df.join(wanted, "term", "left_semi").select("term", w.alias("w"))


def impacts(counts: np.ndarray, places: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of each posting, before its term's weight."""
    m = 100 - 90 + (90 * sizes * n) // total
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m[places])


class Best:
    """The k best documents of each query of a block, over the shards of a task."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.found = q, k, [None] * len(q)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """Keeps the k best of query i: highest score, null id first, smaller id."""
        at = np.flatnonzero(score > 0)
        if len(at) > self.k:
            edge = np.partition(score[at], len(at) - self.k)[len(at) - self.k]
            at = at[score[at] >= edge]  # with all that tie for the last place
        if not len(at):
            return
        new = (score[at], ids[at], valid[at])
        if self.found[i] is not None:
            new = tuple(np.concatenate(x) for x in zip(self.found[i], new))
        first = np.lexsort((new[1], new[2], -new[0]))[: self.k]
        self.found[i] = tuple(x[first] for x in new)

    def rows(self) -> pa.RecordBatch:
        there = [(i, x) for i, x in enumerate(self.found) if x is not None]
        q = np.repeat(self.q[[i for i, _ in there]], [len(x[0]) for _, x in there]) if there else np.zeros(0, np.int64)
        score, ids, valid = (np.concatenate(x) for x in zip(*[x for _, x in there])) if there else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=~valid), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")])


def score_shards(n: int, total: int, k: int):
    """Over shards, the first of them with a block of queries: each task's k best of
    each query."""

    def block_of(terms: pa.Array):
        """Distinct terms of a block, the (query, term) pairs in order of query, and where each query's begin."""
        x = terms.flatten()
        q, word, w = (x.field(i) for i in range(3))
        q, coded = q.to_numpy(), word.dictionary_encode()
        order = np.argsort(q, kind="stable")
        q, code, w = q[order], coded.indices.to_numpy()[order], w.to_numpy()[order]
        own, first = np.unique(q, return_index=True)
        return coded.dictionary, own, np.append(first, len(q)), code, w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
                if best is None:
                    words, own, first, code, w = block_of(row["block"])
                    best = Best(own, k)
                ids, sizes, df = (row[c].flatten() for c in ("ids", "sizes", "df"))
                places, counts = (np.frombuffer(row[c][0].as_buffer(), "<i4").astype(np.int64) for c in ("places", "counts"))
                value = impacts(counts, places, sizes.to_numpy(), n, total)
                ends = np.append(0, np.cumsum(df.to_numpy()))
                # where this shard has each term of the block, -1 where it has not
                at = pc.fill_null(pc.index_in(words, value_set=row["terms"].flatten()), -1).to_numpy()[code]
                id_, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
                for j in range(len(own)):
                    score = None
                    for t, weight in zip(at[first[j] : first[j + 1]].tolist(), w[first[j] : first[j + 1]].tolist()):
                        if t >= 0:
                            score = np.zeros(len(id_), np.int64) if score is None else score
                            score[places[ends[t] : ends[t + 1]]] += weight * value[ends[t] : ends[t + 1]]
                    if score is not None:
                        best.add(j, score, id_, valid)
        if best:
            yield best.rows()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", id_: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each
    row of items, equal scores by ascending id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A
    term held by df of N documents weighs w = floor(1000 * ln((2N + 2) / (2 df + 1)));
    a document of n terms, of L in all, has m = 10 + 90 n N div L, and a term that it
    holds tf times adds w * (10**9 tf div (1000 tf + 8 m)). A term counts once a query.

    A null or empty text has no terms, is not counted in N and is never found; nor does
    an item without terms find anything. A null document id stays null and comes before
    all others where scores tie; a null item id stays null. Every row is a document, and
    an item, of its own, repeated ones too. Texts are read whole, at any length. Empty
    tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    _base.small_batches(spark)
    scratch = _base.Scratch(spark)
    held = index(docs, scratch, text, id_)
    n, total = (x or 0 for x in held.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    words = F.array_distinct(F.regexp_extract_all(_base.ascii_lower(F.coalesce(F.col(item_text), F.lit(""))), F.lit(TERM), F.lit(0)))
    queries = scratch.keep(items.select(F.col(item_id).alias("item_id"), words.alias("terms")).withColumn("q", F.monotonically_increasing_id()), "queries")

    entries = queries.select("q", F.explode("terms").alias("term")).join(weights(held, queries, n), "term")
    entries = scratch.keep(entries, "entries")
    pairs, size = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-pairs // block_terms), -(-size // BLOCK_BYTES))

    def scored(g: int) -> DataFrame:
        own = entries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == g).agg(F.collect_list(F.struct("q", "term", "w")).alias("block"))  # a block of bounded size
        return beside_first(held.select("ids", "sizes", "terms", "df", "places", "counts"), own).mapInArrow(score_shards(n, total, k), FOUND)

    found = reduce(DataFrame.unionByName, map(scored, range(blocks)))
    found = vectors.nearest_first(found, ["q"], [F.desc("score"), F.asc("doc_id")], k, "rank")
    return found.join(queries.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
