"""Benchmark decontamination: a broadcast hash table of normalised test n-grams,
training-token windows scanned against it, hits verified word by word.

The benchmark is a small table by nature, but its size is checked: it is read in
blocks of at most BLOCK_WINDOWS windows, long items in parts. Each block is a broadcast
of its own and a further pass over the same batch, and no more than BLOCKS are held
at a time, so no broadcast grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base

WINDOW = 13
#: Windows in one broadcast table, about 200 bytes each, and tables that are held
#: at a time: between groups of them the rows found so far are kept.
BLOCK_WINDOWS, BLOCKS = 200_000, 4


def word_fold() -> np.ndarray:
    """A-Z to a-z; ASCII other than digits and letters separates."""
    t = np.zeros(256, np.uint8)
    for lo, hi in ((48, 58), (97, 123), (128, 256)):
        t[lo:hi] = np.arange(lo, hi)
    t[65:91] = np.arange(97, 123)
    return t


class Grams:
    """Windows of a block of benchmark items: sorted hashes, and by hash the
    windows' words and items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.by_size = window, {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = _base.Words(raw, np.array([0, len(raw)]), word_fold())
            k = min(window, len(words.hash))
            if k:
                folded = word_fold()[raw].tobytes()
                spans = [folded[a:b] for a, b in zip(words.starts, words.ends)]
                table = self.by_size.setdefault(k, {})
                for i, h in enumerate(_base.shingles(words.hash, k).tolist()):
                    table.setdefault(h, {}).setdefault(tuple(spans[i : i + k]), set()).add(item)
        self.keys = {k: np.sort(np.fromiter(t, np.uint64, len(t))) for k, t in self.by_size.items()}
        self.probe = {}
        for k, keys in self.keys.items():  # a first test by 16 bits of the hash
            self.probe[k] = np.zeros(1 << 16, bool)
            self.probe[k][keys & np.uint64(0xFFFF)] = True

    def scan(self, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, set]]:
        """Words, hit words as a mask and items for each document."""
        words = _base.Words(raw, offs, word_fold())
        n = len(words.hash)
        hit, items = np.zeros(n + 1, np.int64), {}
        for k, keys in self.keys.items():
            if n < k:
                continue
            h = _base.shingles(words.hash, k)
            at = np.flatnonzero(self.probe[k][h & np.uint64(0xFFFF)])
            at = at[np.isin(h[at], keys)] if len(at) else at
            if not len(at):
                continue
            folded = word_fold()[raw]
            doc = np.searchsorted(words.bounds, at, "right") - 1
            for i, d in zip(at.tolist(), doc.tolist()):
                if i + k > words.bounds[d + 1]:
                    continue  # not one document's words
                window = tuple(folded[words.starts[j] : words.ends[j]].tobytes() for j in range(i, i + k))
                found = self.by_size[k][int(h[i])].get(window)
                if found:
                    hit[i] += 1
                    hit[i + k] -= 1
                    items.setdefault(d, set()).update(found)
        mask = np.cumsum(hit[:n]) > 0
        for d in range(len(offs) - 1):
            yield int(words.bounds[d + 1] - words.bounds[d]), mask[words.bounds[d] : words.bounds[d + 1]], items.get(d, set())


def parts_of(text: str | None, window: int, block: int) -> Iterator[tuple[str | None, int]]:
    """A text in parts of at most block windows, with their windows; parts overlap so
    that no window is lost."""
    if len(text or "") <= block:
        yield text, len(text or "") // 2 + 1
        return
    raw = np.frombuffer(text.encode(), np.uint8)
    words = _base.Words(raw, np.array([0, len(raw)]), word_fold())
    n = len(words.hash)
    for lo in range(0, max(1, n - window + 1), block):
        hi = min(n, lo + block + window - 1)
        yield raw[words.starts[lo] : words.ends[hi - 1]].tobytes().decode() if n else "", hi - lo


def _blocks(benchmark: DataFrame, text: str, id_: str, window: int, block: int) -> Iterator[Grams]:
    held, size = [], 0
    rows = benchmark.select(F.col(id_).alias("i"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        for part, n in parts_of(row.t, window, block):
            if held and size + n > block:
                yield Grams(held, window)
                held, size = [], 0
            held.append((row.i, part))
            size += n
    yield Grams(held, window)


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, block: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """One row a document: the columns in keep (the id alone by default; the result's own
    columns replace any of their names), ``n_words long``, ``hits array<struct<start,end>>``
    (runs of hit words, word positions, end exclusive) and ``items array<string>``
    (ids of items with a window in the text, sorted as strings).

    An item of fewer than window words, but not none, is one window. Null and
    empty texts have no words and no hits. A null item id is no id: its windows
    hit words and are not listed. Repeated rows give repeated results. A window's hash only proposes a hit; the
    words decide.
    """
    spark = docs.sparkSession
    _base.small_batches(spark)
    keep = [id_] if keep is None else keep
    made = ["n_words", "hits", "items"]
    held = _base.Carried(docs, keep if text in keep else [*keep, text], text, made)
    out = held.rows
    scratch, shared = _base.Scratch(spark), []
    for i, grams in enumerate(_blocks(benchmark, item_text, item_id, window, block)):
        if i and i % BLOCKS == 0:
            out = scratch.keep(out, f"blocks{i}")
            scratch.drop(f"blocks{i - BLOCKS}")
            while shared:
                shared.pop().free()
        shared.append(_base.Shared(spark, grams))
        out = out.mapInArrow(_scan(shared[-1], held), held.with_columns("n_words long", FOUND))
    return held.back(out, *made).select(*[c for c in keep if c.lower() not in made], *made)


FOUND = "hits array<struct<start: long, end: long>>, items array<string>"


def _scan(shared, held):
    """Each block's scan passes the text on, with the runs found so far and its own."""
    runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in _base.passes(batch, held.text):
                before = zip(*[c.to_pylist() for c in part.columns[-2:]]) if part.num_columns > len(held.names) else None
                n_words, hits, items = [], [], []
                for n, mask, found in shared.value.scan(raw, offs):
                    if before is not None:
                        old_hits, old_items = next(before)
                        for x in old_hits:
                            mask[x["start"] : x["end"]] = True
                        found = {str(x) for x in found if x is not None} | set(old_items)
                    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))) if mask.any() else np.zeros(0, np.int64)
                    n_words.append(n)
                    hits.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                    items.append(sorted(str(x) for x in found if x is not None))
                yield pa.RecordBatch.from_arrays([*held.columns(part), pa.array(n_words, pa.int64()), pa.array(hits, runs), pa.array(items, pa.list_(pa.string()))], [*held.names, "n_words", "hits", "items"])

    return run


def n_hit():
    """Hit words of a row of find_hits."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contaminated():
    """The rule: some hit, and at least a twentieth of the words."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))
