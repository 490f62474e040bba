"""Removal of repeated byte strings by a sparse suffix array.

A suffix at every byte would hold the corpus many times over. Suffixes start at
*anchors*, tokens chosen by content: in each string of LENGTH bytes the LEAD-byte
substring of least hash (the leftmost of equals) is its anchor. Equal strings have
equal anchors at equal places, so every repeat is seen at some anchor, and about
one byte in 35 starts a suffix.

1. Anchors met once lead no repeated string. Each task counts its own anchors and
   sends one row an anchor to a bucket of anchor hashes; what is met again in its
   task or in its bucket goes on. The count is exact, and a passage copied a
   million times reaches its bucket once a task.
2. Documents emit the suffixes at these anchors: LENGTH bytes to the right of the
   anchor's start, LENGTH - LEAD to its left. Occurrences with equal bytes on both
   sides inside one task are combined; all but the first are repeats as a whole.
3. Splitters sampled from the suffixes range-partition them by their leading bytes
   (then by document and place, so that one very common passage spreads over many
   buckets). A bucket is put in order by multikey quicksort, eight bytes at a time.
   Neighbours are compared byte by byte: runs with equal leads are ordered again by
   the bytes to their left, and a string that reaches f bytes to the left is told by
   its run to the right (at least LENGTH - f bytes in common) and to the left (at
   least f). All but the first of a string's places repeat.
4. The first and last run of a bucket may go on in the buckets beside it. Suffixes of
   runs that do are ordered by the bytes to their left; their strings, as far as what
   they have in common with the bucket's end and with a neighbour in that order
   allows, are compared across the boundary by their bytes, as a grouped minimum.
5. Repeated ranges go back to their documents, where they are merged.

Hashes only choose anchors and propose; which bytes go is decided on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from . import _base

LENGTH, LEAD = 100, 32
REACH = LENGTH - LEAD
#: Suffixes of a bucket, as sampled splitters cut them on average.
BUCKET_ROWS = 100_000
#: Bytes of text whose anchors share a counting bucket, on average (about half a million
#: anchors), whatever the size of the input.
BUCKET_BYTES = 1 << 24
#: Anchors that a task counts at a time.
COUNTED = 1_000_000
#: Runs up to this size are ordered by plain sorts in place of further quicksort steps.
SMALL = 1 << 13
#: Contexts that a task remembers to combine equal ones; a full table is emptied,
#: after which equal ones are sent once more.
SEEN = 100_000
LEAST_ID = -(2**63)


# ---------------------------------------------------------------- anchors


def lead_hashes(raw: np.ndarray, lead: int = LEAD) -> np.ndarray:
    """64-bit hash of the lead bytes from each byte on (lead a power of two)."""
    with np.errstate(over="ignore"):
        h, step, factor = _base.byte_values()[raw], 1, np.uint64(_base.MIX_A)
        while step < lead:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, step * 2
        return _base.mix(h)


def anchors(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the anchors of all strings inside one document each, and
    the hashes of their leading bytes."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = lead_hashes(raw, lead)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, step = length - lead + 1, 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if step < width:
        v = np.minimum(v[: len(v) - (width - step)], v[width - step :])
    ok = np.zeros(n - length + 2, np.int32)  # starts whose string ends in the same document
    last = offs[1:] - length
    some = last >= offs[:-1]
    np.add.at(ok, offs[:-1][some], 1)
    np.add.at(ok, last[some] + 1, -1)
    at = (v[np.cumsum(ok[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.unique(at)
    return at, h[at]


# ---------------------------------------------------------------- 1: anchors met again

MET = "kind int, bucket int, doc long, row long, packed binary"
PLACE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<u4"), ("sent", "u1")])


def by_document(places: np.ndarray, kind: int, buckets: int) -> pa.RecordBatch:
    """Places of each document as packed 32-bit numbers."""
    places = places[np.lexsort((places["at"], places["row"], places["doc"]))]
    doc, row = places["doc"].astype(np.int64), places["row"].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]) if len(doc) else np.zeros(0, np.int64)
    offs = np.append(new, len(doc)).astype(np.int32) * 4
    packed = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offs), pa.py_buffer(places["at"].astype("<u4").tobytes())])
    with np.errstate(over="ignore"):  # only passes through: any bucket will do
        bucket = (_base.mix((doc[new] ^ row[new]).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(new), kind, np.int32)), pa.array(bucket), pa.array(doc[new]), pa.array(row[new]), packed], ["kind", "bucket", "doc", "row", "packed"])


def runs_of(h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places in order, each place once, and the starts of equal hashes."""
    order = np.lexsort((places["at"], places["row"], places["doc"], h))
    h, places = h[order], places[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (places["doc"][1:] == places["doc"][:-1]) & (places["row"][1:] == places["row"][:-1]) & (places["at"][1:] == places["at"][:-1])
    if again.any():  # a repeated row is one document; a place that was sent before stays so
        group = np.cumsum(~again) - 1
        sent = np.zeros(group[-1] + 1, np.uint8)
        np.maximum.at(sent, group, places["sent"])
        h, places = h[~again], places[~again]
        places["sent"] = sent
    return h, places, np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)


def scan_anchors(buckets: int, counted: int = COUNTED):
    """Kind 1: places of anchors that this task met again. Kind 0: for each bucket
    the anchors met here, one place each, packed."""

    def flush(h: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, places, new = runs_of(h, places)
        size = np.diff(np.append(new, len(h)))
        yield by_document(places[np.repeat(size, size) > 1], 1, buckets)
        h, places = h[new], places[new]
        places["sent"] = size > 1
        # anchors have the least hashes of their strings: mixed again, they spread evenly
        with np.errstate(over="ignore"):
            at = _base.mix(h ^ np.uint64(_base.MIX_A)) % np.uint64(buckets)
        by = np.argsort(at, kind="stable")
        h, places, at = h[by], places[by], at[by]
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        blobs = [planes(h[a:b], places[a:b]) for a, b in zip(edge, np.append(edge[1:], len(h)))]
        none = np.zeros(len(edge), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(none.astype(np.int32)), pa.array(at[edge].astype(np.int32)), pa.array(none), pa.array(none), pa.array(blobs, pa.binary())], ["kind", "bucket", "doc", "row", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part, raw, offs in _base.passes(batch, 2):
                at, h = anchors(raw, offs)
                own = np.searchsorted(offs, at, "right") - 1
                places = np.zeros(len(at), PLACE)
                places["doc"], places["row"] = part.column(0).to_numpy(zero_copy_only=False)[own], part.column(1).to_numpy(zero_copy_only=False)[own]
                places["at"] = at - offs[own]
                held.append((h, places))
                size += len(h)
                if size >= counted:
                    yield from flush(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from flush(*map(np.concatenate, zip(*held)))

    return run


def planes(h: np.ndarray, places: np.ndarray) -> bytes:
    """Hashes and places byte by byte, so that leading zeros lie together."""
    both = np.hstack([h.astype("<u8").view(np.uint8).reshape(-1, 8), places.view(np.uint8).reshape(-1, PLACE.itemsize)])
    return both.T.tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8 + PLACE.itemsize, -1).T)
    return np.ascontiguousarray(both[:, :8]).view("<u8").ravel(), np.ascontiguousarray(both[:, 8:]).view(PLACE).ravel()


def settle_anchors(buckets: int):
    """Over rows of scan_anchors in order of bucket: places of anchors met again."""

    def settled(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if blobs:
            h, places, new = runs_of(*map(np.concatenate, zip(*map(unpacked, blobs))))
            size = np.diff(np.append(new, len(h)))
            yield by_document(places[(np.repeat(size, size) > 1) & (places["sent"] == 0)], 1, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            kind, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield batch.take(pa.array(np.flatnonzero(kind == 1)))
            for i in np.flatnonzero(kind == 0).tolist():
                if bucket[i] != now:
                    yield from settled(held)
                    now, held = bucket[i], []
                held.append(batch.column(4)[i].as_py())
        yield from settled(held)

    return run


# ---------------------------------------------------------------- 2: suffixes

PARTS = "kind int, doc long, row long, at long, left binary, right binary, wanted binary"
NAMES = [x.split()[0] for x in PARTS.split(", ")]


def emit(kind: int, doc, row, at, left, right, wanted=None) -> pa.RecordBatch:
    n = len(doc)
    wanted = [None] * n if wanted is None else wanted
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(wanted, pa.binary())], NAMES)


def ranged(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Kind 1: for each document its ranges, as packed 64-bit pairs in left."""
    if len(doc):
        order = np.lexsort((end, start, row, doc))
        doc, row = doc[order], row[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
        pairs = np.c_[start[order], end[order]].astype(np.int64)
        left = [union_of(pairs[a:b]).tobytes() for a, b in zip(new, np.append(new[1:], len(doc)))]
        yield emit(1, doc[new], row[new], np.zeros(len(new), np.int64), left, [None] * len(new))


def emit_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (doc, row, text, places): kind 0 are suffixes (left context, bytes from
    the anchor on), kind 1 ranges known to repeat."""
    seen: dict[bytes, tuple[int, int, int]] = {}
    for batch in batches:
        for part, raw, offs in _base.passes(batch, 2):
            doc, row = part.column(0).to_pylist(), part.column(1).to_pylist()
            blob, out, gone = raw.tobytes(), [], []
            for i, packed in enumerate(part.column(3).to_pylist()):
                lo, hi = int(offs[i]), int(offs[i + 1])
                for at in np.unique(np.frombuffer(b"".join(packed), "<u4")).tolist():
                    a, m, b = max(lo, lo + at - REACH), lo + at, min(hi, lo + at + LENGTH)
                    left, right = blob[a:m], blob[m:b]
                    mine = (doc[i], row[i], at)
                    if m - a == REACH and b - m == LENGTH:
                        first = seen.get(left + right)
                        if first is not None and mine > first:
                            gone.append(mine)
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[left + right] = mine  # an earlier one is sent too; its bucket sorts it out
                    out.append((*mine, left, right))
            if gone:
                d, r, at = (np.array(x, np.int64) for x in zip(*gone))
                yield from ranged(d, r, at - REACH, at + LENGTH)
            if out:
                yield emit(0, *zip(*out))


# ---------------------------------------------------------------- 3: order and comparison


def matrix(col: pa.Array, width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column as rows of width bytes, zeros after their end, and
    their lengths; backwards puts the last byte first."""
    _, offsets, data = col.cast(pa.large_binary()).buffers()
    offs = np.frombuffer(offsets, np.int64)[: len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    size = np.diff(offs)
    step = np.arange(width)
    at = offs[1:, None] - 1 - step if backwards else offs[:-1, None] + step
    out = raw[np.clip(at, 0, len(raw) - 1)]
    out[step[None, :] >= size[:, None]] = 0
    return out, size


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers that order alike."""
    pad = -rows.shape[1] % 8
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray, small: int = SMALL) -> np.ndarray:
    """Order of rows of words: three ways around a pivot at one word, the middle
    part again at the next word. Parts of at most small rows end in plain sorts."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        own = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        w = words[own, depth]
        some = np.sort(w[:: max(1, len(w) // 9)][:9])
        pivot = some[len(some) // 2]
        less, same = w < pivot, w == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(same.sum())
        order[lo:hi] = np.concatenate([own[less], own[same], own[w > pivot]])
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def longest(lcp: np.ndarray) -> np.ndarray:
    """The most that each row has in common with either neighbour."""
    return np.maximum(lcp, np.append(lcp[1:], 0))


class Bucket:
    """Suffixes between two splitters."""

    def __init__(self, rows: pa.Table):
        self.doc, self.row, self.at = (rows.column(i).to_numpy() for i in (1, 2, 3))
        self.left, self.n_left = matrix(rows.column(4).combine_chunks(), REACH, backwards=True)
        self.right, self.n_right = matrix(rows.column(5).combine_chunks(), LENGTH)
        place = np.lexsort((self.at, self.row, self.doc))
        d, r, a = self.doc[place], self.row[place], self.at[place]
        moved = np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (a[1:] != a[:-1])]
        #: Rank of each suffix by document and place; equal ranks are one place.
        self.rank = np.empty(len(place), np.int64)
        self.rank[place] = np.cumsum(moved)

    def take(self, keep: np.ndarray) -> None:
        for name in ("doc", "row", "at", "left", "n_left", "right", "n_right", "rank"):
            setattr(self, name, getattr(self, name)[keep])

    def combine(self) -> Iterator[pa.RecordBatch]:
        """Puts the suffixes in order; of those equal on both sides the first stays,
        and the others are repeats as a whole."""
        lens = (self.n_left << 32 | self.n_right).astype(np.uint64)
        key = np.hstack([words_of(self.right), words_of(self.left), lens[:, None]])
        order = multikey_quicksort(key)
        key = key[order]
        self.take(order)
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.append(new, len(key)))
        least = np.repeat(np.minimum.reduceat(self.rank, new), size)
        gone = np.flatnonzero((self.rank > least) & (self.n_left + self.n_right >= LENGTH))
        yield from ranged(self.doc[gone], self.row[gone], self.at[gone] - self.n_left[gone], self.at[gone] + self.n_right[gone])
        run = np.repeat(np.arange(len(new)), size)
        firsts = np.flatnonzero(self.rank == least)
        self.take(firsts[np.r_[True, run[firsts][1:] != run[firsts][:-1]]])  # repeated rows are one

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix and reach f to the left: whether the string of LENGTH bytes
        from there is in the bucket before, and whether it is not but may be in another
        bucket. Leaves only suffixes that may have a partner, here or beside."""
        lcp = common(self.right)
        run = np.cumsum(lcp < LEAD)
        edge = (run == run[0]) | (run == run[-1])
        most = longest(lcp)
        keep = np.flatnonzero((most >= LEAD) | edge)
        self.take(keep)
        lcp, edge = common(self.right), edge[keep]
        run = np.cumsum(lcp < LEAD)
        most = longest(lcp)
        # the same runs in order of the bytes to their left
        by = multikey_quicksort(np.hstack([run[:, None].astype(np.uint64), words_of(self.left)]))
        lcs = common(self.left[by])
        lcs[np.r_[True, run[by][1:] != run[by][:-1]]] = -1
        side = np.empty(len(by), np.int64)
        side[by] = np.arange(len(by))
        reach = np.maximum(lcs, np.append(lcs[1:], -1))[side]
        far = np.arange(REACH + 1)
        ok = (far[None, :] <= self.n_left[:, None]) & (LENGTH - far[None, :] <= self.n_right[:, None])
        late = np.zeros(ok.shape, bool)
        for f in far.tolist():
            pick = np.flatnonzero(ok[:, f] & (most >= LENGTH - f) & (reach >= f))
            if not len(pick):
                continue
            right = np.cumsum(lcp < LENGTH - f)
            left = np.cumsum(lcs < f)[side]
            key = right[pick] * (len(by) + 1) + left[pick]
            order = np.lexsort((self.rank[pick], key))
            key, own, rank = key[order], pick[order], self.rank[pick][order]
            new = np.r_[True, key[1:] != key[:-1]]
            late[own, f] = rank > rank[np.flatnonzero(new)][np.cumsum(new) - 1]
        # a partner in a bucket before or after has no more in common with a suffix on the
        # right than the bucket's first or last suffix has
        whole = np.full(len(lcp), LENGTH)
        to_first, to_last = whole.copy(), whole.copy()
        to_first[1:] = np.minimum.accumulate(lcp[1:])
        to_last[:-1] = np.minimum.accumulate(lcp[1:][::-1])[::-1]
        beyond = np.maximum(np.where(run == run[0], to_first, 0), np.where(run == run[-1], to_last, 0))
        wanted = ok & ~late & edge[:, None] & (far[None, :] >= LENGTH - beyond[:, None])
        return late, wanted


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket. Kind 1: ranges that repeat. Kind 2: suffixes of its first and last
    run with strings that come first here and may not elsewhere (bits in wanted),
    the bytes to the left put backwards. Kind 3: those runs' leads in right."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    bucket = Bucket(pa.Table.from_batches(held))
    held.clear()
    yield from bucket.combine()
    leads = sorted({bucket.right[i, :LEAD].tobytes() for i in (0, -1)})
    yield emit(3, *[np.zeros(len(leads), np.int64)] * 3, [None] * len(leads), leads)
    late, wanted = bucket.repeats()
    step = np.diff(np.pad(late.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, lo = np.nonzero(step == 1)
    hi = np.nonzero(step == -1)[1] - 1
    yield from ranged(bucket.doc[i], bucket.row[i], bucket.at[i] - hi, bucket.at[i] - lo + LENGTH)
    some = np.flatnonzero(wanted.any(axis=1))
    bits = np.packbits(wanted[some], axis=1)
    for a in range(0, len(some), 20_000):
        own = some[a : a + 20_000]
        left = [bucket.left[i, :n].tobytes() for i, n in zip(own.tolist(), bucket.n_left[own].tolist())]
        right = [bucket.right[i, :n].tobytes() for i, n in zip(own.tolist(), bucket.n_right[own].tolist())]
        yield emit(2, bucket.doc[own], bucket.row[own], bucket.at[own], left, right, [x.tobytes() for x in bits[a : a + 20_000]])


# ---------------------------------------------------------------- 4: boundaries


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over suffixes of kind 2 in order of lead and of the bytes to the left: kind 2,
    their wanted strings in right and where these start, as far as a neighbour has
    the same bytes to the left. What lies beyond the partition may have all."""
    last: pa.Table | None = None
    before = REACH  # bytes that the first row has in common with the one before it

    def found(rows: pa.Table, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, row, at = (rows.column(i).to_numpy() for i in (1, 2, 3))
        left, _ = matrix(rows.column(4).combine_chunks(), REACH)
        right, _ = matrix(rows.column(5).combine_chunks(), LENGTH)
        bits, _ = matrix(rows.column(6).combine_chunks(), -(-(REACH + 1) // 8))
        i, far = np.nonzero(np.unpackbits(bits, axis=1)[:, : REACH + 1].astype(bool) & (np.arange(REACH + 1)[None, :] <= reach[:, None]))
        for a in range(0, len(i), 20_000):
            own, f = i[a : a + 20_000], far[a : a + 20_000]
            whole = np.hstack([left[own][:, ::-1], right[own]])
            text = whole[np.arange(len(own))[:, None], (REACH - f)[:, None] + np.arange(LENGTH)]
            yield emit(2, doc[own], row[own], at[own] - f, [None] * len(own), [t.tobytes() for t in text])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([last, rows]).combine_chunks() if last is not None else rows
        left, _ = matrix(rows.column(4).combine_chunks(), REACH)
        lead, _ = matrix(rows.column(5).combine_chunks(), LEAD)
        lcs = common(left)
        lcs[1:][(lead[1:] != lead[:-1]).any(axis=1)] = 0
        lcs[0] = before
        yield from found(rows.slice(0, rows.num_rows - 1), np.maximum(lcs[:-1], lcs[1:]))
        last, before = rows.slice(rows.num_rows - 1), int(lcs[-1])
    if last is not None:
        yield from found(last, np.array([REACH]))


# ---------------------------------------------------------------- 5: documents


def union_of(x: np.ndarray) -> np.ndarray:
    """Sorted disjoint ranges, as rows of start and end; ranges that touch are one."""
    x = x[np.argsort(x[:, 0], kind="stable")]
    top = np.maximum.accumulate(x[:, 1])
    new = np.r_[True, x[1:, 0] > top[:-1]]
    return np.c_[x[new, 0], np.r_[top[np.flatnonzero(new)[1:] - 1], top[-1]]]


CUT = types.StructType().add("n_bytes", types.LongType()).add("n_removed", types.LongType()).add("n_spans", types.LongType()).add("spans", types.BinaryType()).add("kept", types.BinaryType())


@F.pandas_udf(CUT)
def cut(text: pd.Series, packed: pd.Series) -> pd.DataFrame:
    rows = []
    for t, p in zip(text, packed):
        raw = (t or "").encode()
        if p is None or not len(p):
            rows.append((len(raw), 0, 0, b"", raw))
            continue
        u = union_of(np.frombuffer(b"".join(p), np.int64).reshape(-1, 2))
        ends = [0, *u[:, 1].tolist()]
        starts = [*u[:, 0].tolist(), len(raw)]
        rows.append((len(raw), int((u[:, 1] - u[:, 0]).sum()), len(u), u.tobytes(), b"".join(raw[a:b] for a, b in zip(ends, starts))))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept"])


def dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id", bucket_rows: int = BUCKET_ROWS, counted: int = COUNTED) -> DataFrame:
    """One row a row of docs: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``spans`` (their starts and ends as packed 64-bit numbers) and
    ``kept`` (the bytes left, binary: a cut may fall inside a character).

    A byte goes when some string of LENGTH bytes that covers it also starts
    earlier: in a document of smaller id, or earlier in the same one. Strings are
    judged on the input and never cross documents. A null text is empty; a null
    id sorts first. Rows that repeat an id and its text are one document and get
    the same result; rows of one id with different texts are ordered by a
    fingerprint of the text. Other columns are not read.
    """
    spark = docs.sparkSession
    _base.small_batches(spark)
    scratch = _base.Scratch(spark)
    rows = docs.select(F.coalesce(F.col(id_).cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text_"))

    size = rows.agg(F.sum(F.octet_length("text_").cast("long"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    met = rows.mapInArrow(scan_anchors(buckets, counted), MET).repartition("bucket").sortWithinPartitions("bucket")
    met = scratch.keep(met.mapInArrow(settle_anchors(buckets), MET).select("doc", "row", "packed"), "met")
    scratch.free_shuffles()

    places = met.groupBy("doc", "row").agg(F.collect_list("packed").alias("places"))
    own = rows.join(places, ["doc", "row"]).select("doc", "row", "text_", "places")
    parts = scratch.keep(own.mapInArrow(emit_suffixes, PARTS), "suffixes")
    scratch.drop("met")
    scratch.free_shuffles()

    suffixes = parts.filter("kind = 0")
    n = max(1, -(-suffixes.count() // bucket_rows))
    dealt = suffixes.repartitionByRange(n, "right", "doc", "row", "at")
    found = scratch.keep(dealt.mapInArrow(compare, PARTS), "found")
    known = scratch.keep(parts.filter("kind = 1").select("doc", "row", F.col("left").alias("packed")), "known")
    scratch.drop("suffixes")
    scratch.free_shuffles()

    # leads that end one bucket and begin another
    lead = F.substring("right", 1, LEAD).alias("lead")
    split = found.filter("kind = 3").groupBy(F.col("right").alias("lead")).agg(F.count("*").alias("n")).filter("n > 1").select("lead")
    edges = found.filter("kind = 2").select(*NAMES, lead).join(split, "lead", "left_semi")
    edges = scratch.keep(edges, "edges")
    edges = edges.repartitionByRange("lead", "left", "doc", "row", "at").sortWithinPartitions("lead", "left", "doc", "row", "at")
    told = scratch.keep(edges.select(*NAMES).mapInArrow(strings, PARTS).select("right", "doc", "row", "at"), "strings")
    first = told.groupBy("right").agg(F.min(F.struct("doc", "row", "at")).alias("first"))
    again = told.join(first, "right").filter(F.struct("doc", "row", "at") > F.col("first"))
    pair = F.unhex(F.concat(*[little_endian(x) for x in (F.col("at"), F.col("at") + LENGTH)]))
    late = known.unionByName(found.filter("kind = 1").select("doc", "row", F.col("left").alias("packed")))
    late = late.unionByName(again.select("doc", "row", pair.alias("packed")))
    by_doc = late.groupBy("doc", "row").agg(F.collect_list("packed").alias("packed"))

    left = docs.select(F.col(id_).alias("id_"), F.col(text).alias("text_"), F.coalesce(F.col(id_).cast("long"), F.lit(LEAST_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"))
    out = left.join(by_doc, ["doc", "row"], "left").select("id_", cut("text_", "packed").alias("c"))
    return out.select(F.col("id_").alias(id_), "c.n_bytes", "c.n_removed", "c.n_spans", "c.spans", "c.kept")


def little_endian(x):
    """The 8 bytes of a long, least first, as hex."""
    hexed = F.lpad(F.hex(x), 16, "0")
    return F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
