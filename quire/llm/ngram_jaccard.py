"""Exact Jaccard self-join of documents on word n-grams, as a blocked product of
the sparse document by n-gram incidence matrix.

Documents with equal n-gram sets are one *class*; only classes are multiplied.
With classes ordered by size, a pair at the bound must share an n-gram among the
first few of each in any common order of the n-grams (the prefix). The order
puts n-grams met often last, so prefixes hold rare ones and a passage that many
documents share hardly ever makes a candidate. A column of the matrix (the
classes with one prefix n-gram) is a block of candidate products. A pair's
overlap can be no larger than its sizes and places in the column of its first common
n-gram allow, and pairs below the bound that their sizes set are discarded. Of the rest most fall to a
parity table of one bit an n-gram, whose differing bits bound the overlap from
above; what is left is counted exactly on whole sets.

Columns are first multiplied along neighbours only (each class with the one
before it of like size), and of these each class keeps two. Links found so merge
classes into components, and later rounds pair only what lies in different
components: first a least spanning forest of each block by differing bits, which
joins what links join but for the error of the tables, at last all members that
the bounds leave. N-grams are told apart by 64-bit hashes, whose chance meetings are
too rare to move an overlap. A group of n near copies so costs about n exact counts and not n
squared, while a link between any two components is still found.

Links are then counted, where they are asked for. All of them lie inside components, so
each component's incidence matrix is multiplied by its transpose in blocks: overlap
counts are accumulated over stretches of columns, pairs below the bound that their sizes
set are discarded, and what leaves a block is a number for each class. This is exact and
takes time with the square of a component's classes, spread over its pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base
from .components import components as connected

WORDS, PERCENT = 5, 80
#: Slots of the table of n-gram frequencies, one byte each.
LEVEL_BITS = 22
#: An n-gram counts as frequent from so many documents on; a task reports one it
#: met LOCAL times among SPAN n-grams.
FREQUENT, LOCAL, SPAN = 16, 2, 4_000_000
#: Frequent columns are cut in pieces of about this many classes for the first round.
PIECE = 1024
#: A task holds so many rows of a column at most, and seeks partners in columns up to SMALL.
HELD, SMALL = 4096, 64
#: Bits of the filter on documents whose sets are wanted, at most (32 MB); beyond the
#: documents that fit, more sets pass and the join after it still decides.
FILTER_BITS = 28
#: Classes of a column in one block of the last round, and of a component in one block
#: of the count.
BLOCK = 512
#: Columns that the count multiplies at a time.
STRETCH = 4096


def sets_of(part: pa.RecordBatch, raw: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each document."""
    words = _base.Words(raw, offs, _base.whitespace_fold())
    h = _base.shingles(words.hash, k)
    for d in range(len(offs) - 1):
        a, b = words.bounds[d], words.bounds[d + 1]
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        else:
            yield _base.shingles(words.hash[a:b], k)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity(s: np.ndarray) -> bytes:
    """A bit for each slot of a table of at least as many slots as n-grams: whether
    an odd number of them falls there. The bits in which two such tables differ are
    no more than the n-grams in which the sets do."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    slot = (s >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(slot.astype(np.int64), minlength=bits) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parity tables differ; the larger is folded to the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Columns:
    """Growing output columns of a pass."""

    def __init__(self, *kinds):
        self.kinds, self.rows = kinds, []

    def batch(self, names: list[str]) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(self.kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, self.kinds)], names)


def scan_classes(k: int):
    """Kind 0: a document's class. Kind 1: an n-gram met often here, in class n times.
    Documents of a class met before in this span count once."""
    names = ["kind", "at", "n", "class", "parity"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def often(tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = np.sort(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)
        new = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(whole) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(whole)))
        new, n = new[n >= LOCAL], n[n >= LOCAL]
        for lo in range(0, len(n), 50_000):
            token, times = whole[new[lo : lo + 50_000]].view(np.int64), n[lo : lo + 50_000]
            none = pa.nulls(len(times), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(times), np.int32)), pa.array(token), pa.array(times), none, none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, size, seen = [], 0, set()
        for batch in batches:
            for part, raw, offs in _base.passes(batch, 1):
                out = Columns(*kinds)
                for row, s in zip(part.column(0).to_pylist(), sets_of(part, raw, offs, k)):
                    name = fingerprint(s) if len(s) else None
                    out.rows.append((0, row, len(s), name, parity(s) if len(s) else None))
                    if name is not None and name not in seen:
                        seen.add(name)
                        tokens.append(s)
                        size += len(s)
                yield out.batch(names)
                if size > SPAN:
                    yield from often(tokens)
                    tokens, size, seen = [], 0, set()
        yield from often(tokens)

    return run


def ordered_prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n-grams of a set, rare ones first, that a partner must meet, and their levels."""
    n = len(s)
    p = n - -(-percent * n // 100) + 1
    level = levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)]
    rank = (level.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    order = np.argsort(rank, kind="stable")[:p]
    return s[order], level[order]


def scan_prefixes(shared, k: int, percent: int):
    names = ["token", "n", "at", "level", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        levels = shared.value
        for batch in batches:
            for part, raw, offs in _base.passes(batch, 1):
                tokens, level, sizes, counts, classes = [], [], [], [], []
                for s in sets_of(part, raw, offs, k):
                    if not len(s) or (name := fingerprint(s)) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    t, v = ordered_prefix(s, levels, percent)
                    tokens.append(t)
                    level.append(v)
                    sizes.append(len(s))
                    counts.append(len(t))
                    classes.append(name)
                if not tokens:
                    continue
                c = np.array(counts)
                at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(sizes, c).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(np.concatenate(level).astype(np.int32)), pa.array(classes, pa.binary()).take(pa.array(np.repeat(np.arange(len(c)), c)))],
                    names,
                )

    return run


def partnered(rows: list[tuple], percent: int) -> list[bool]:
    """Which rows (n, at, class) of a column, by size, have a partner there within bounds."""
    ok = [False] * len(rows)
    for i, (n, at, _) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            m, to, _ = rows[j]
            if percent * m > 100 * n:
                break
            if min(n - at, m - to) * (100 + percent) >= percent * (n + m):
                ok[i] = ok[j] = True
    return ok


def shared_columns(percent: int):
    """Of rows sorted by token, piece, n and class: each with the row before it in
    its piece. Rows that repeat a class are left out, and of columns that are one
    piece (-1) also rows without a partner."""
    names = ["token", "n", "at", "class", "n0", "at0", "class0"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, before = None, [], None
        out = Columns(*kinds)

        def send(ended: bool):
            nonlocal before, held
            rows = held
            if rows and ended and key[1] < 0 and before is None and len(rows) <= SMALL:
                rows = [r for r, ok in zip(rows, partnered(rows, percent)) if ok]
            for r in rows:
                out.rows.append((key[0], *r, *(before or (None,) * 3)))
                before = r
            before, held = None if ended else before, []

        for batch in batches:
            token, piece, n, at = (batch.column(i).to_numpy() for i in range(4))
            if not len(token):
                continue
            own = batch.column(4).to_pylist()
            same = token[1:] == token[:-1]
            near = np.flatnonzero(np.r_[True, same] | np.r_[same, True] | (piece >= 0))
            for i, t, p, n_, at_ in zip(near.tolist(), token[near].tolist(), piece[near].tolist(), n[near].tolist(), at[near].tolist()):
                if (t, p) != key:
                    send(True)
                    key = (t, p)
                last = held[-1] if held else before
                if last is None or last[2] != own[i]:
                    held.append((n_, at_, own[i]))
                if len(held) >= HELD:
                    send(False)
            yield out.batch(names)
        send(True)
        yield out.batch(names)

    return run


def bounded(percent: int, n, at, n0, at0):
    """Whether sizes and places in a column leave a pair a chance with this n-gram as
    the first that both have: the overlap is then at most what either has from
    there on, and must be at least percent / (100 + percent) of both sizes. A linked
    pair passes in the column of its first common n-gram."""
    most = F.least(n - at, n0 - at0)
    return (100 * F.least(n, n0) >= percent * F.greatest(n, n0)) & (most * (100 + percent) >= percent * (n + n0))


def scan_sets(shared, k: int):
    """(class, n-gram set as bytes) of the documents whose keys pass the filter, a class
    once a task. Other texts are not cut into words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(shared.value.has(batch.column(0).to_numpy().view(np.uint64)))))
            for part, raw, offs in _base.passes(batch, 1):
                names, sets = [], []
                for s in sets_of(part, raw, offs, k):
                    if len(s) and (name := fingerprint(s)) not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(name)
                        names.append(name)
                        sets.append(s.tobytes())
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["class", "set"])

    return run


def near_pairs(rows: list[tuple], cross: bool, percent: int, forest: bool) -> Iterator[tuple[bytes, bytes]]:
    """The pairs of one block (side, n, at, class, root, parity) that no bound
    refuses; across the two sides only when cross. With forest, of these the ones
    of a least spanning forest of the block's components by differing bits."""
    rows = sorted(rows, key=lambda r: (r[1], r[3]))
    n, at = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    side = np.array([r[0] for r in rows])
    root = np.unique(np.array([r[4] for r in rows], dtype="S16"), return_inverse=True)[1]
    size = np.array([len(r[5]) for r in rows])
    own = {w: np.frombuffer(b"".join(r[5] for r in rows if len(r[5]) == w), np.uint8).reshape(-1, w) for w in set(size.tolist())}
    place = np.zeros(len(rows), np.int64)
    for w in own:
        place[size == w] = np.arange(len(own[w]))
    half = {w // 2: own[w][:, : w // 2] ^ own[w][:, w // 2 :] for w in own}
    left, right, weight = [], [], []
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, np.searchsorted(n, 100 * n[i] // percent, "right"))
        most = np.minimum(n[i] - at[i], n[j] - at[j])
        ok = (root[j] != root[i]) & (most * (100 + percent) >= percent * (n[i] + n[j]))
        if cross:
            ok &= side[j] != side[i]
        j = j[ok]
        if not len(j):
            continue
        w, far = size[i], np.full(len(j), 1 << 60)
        mine = own[w][place[i]]
        for same, tables in ((size[j] == w, own), (size[j] == 2 * w, half)):
            if same.any():
                far[same] = np.bitwise_count(tables[w][place[j[same]]] ^ mine).sum(axis=1, dtype=np.int64)
        good = far * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
        j, far = j[good], far[good]
        left.append(np.full(len(j), i))
        right.append(j)
        weight.append(far / (n[i] + n[j]))
    if not left:
        return
    left, right = np.concatenate(left), np.concatenate(right)
    if forest:
        order = np.argsort(np.concatenate(weight), kind="stable")
        left, right = left[order], right[order]
    above = list(range(len(rows)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for i, j, x, y in zip(left.tolist(), right.tolist(), root[left].tolist(), root[right].tolist()):
        if forest:
            x, y = top(x), top(y)
            if x == y:
                continue
            above[x] = y
        a, b = rows[i][3], rows[j][3]
        yield (a, b) if a < b else (b, a)


def product(percent: int, forest: bool):
    """Over rows sorted by token and block pair: (u, v) of the pairs of each block
    that no bound refuses, or a forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], set()

        def batch_of(pairs) -> pa.RecordBatch:
            pairs = list(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["u", "v"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for token, low, high, *row in zip(*cols):
                if (token, low, high) != key:
                    if len(held) > 1:
                        found.update(near_pairs(held, key[1] != key[2], percent, forest))
                    if len(found) > 50_000:
                        yield batch_of(found)
                        found = set()
                    key, held = (token, low, high), []
                held.append(row)
        if len(held) > 1:
            found.update(near_pairs(held, key[1] != key[2], percent, forest))
        yield batch_of(found)

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of each set of a with each of b: dense products of the columns that
    two sets at least have, some at a time."""
    sets = [*a, *b]
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, STRETCH):
        i, j = np.searchsorted(column, [lo, lo + STRETCH])
        dense = np.zeros((len(sets), min(STRETCH, int(column[-1]) + 1 - lo)), np.float32)
        dense[row[i:j], column[i:j] - lo] = 1
        out += dense[: len(a)] @ dense[len(a) :].T  # whole numbers, exact up to 2**24
    return out.astype(np.int64)


def counted(percent: int):
    """Over rows (root, low, high, side, class, m, set) in order of root and block pair:
    for each class the documents of the classes of the other side that link with it."""

    def links(rows: list[tuple], cross: bool) -> Iterator[tuple[bytes, int]]:
        side = [r[0] for r in rows]
        first = [i for i, x in enumerate(side) if x == side[0]] if cross else list(range(len(rows)))
        second = [i for i, x in enumerate(side) if x != side[0]] if cross else first
        if not second:
            return
        n, m = np.array([len(r[3]) for r in rows]), np.array([r[2] for r in rows])
        if len(first) <= 2 and len(second) <= 2:  # most components are a pair
            both = np.array([[len(np.intersect1d(rows[i][3], rows[j][3], assume_unique=True)) for j in second] for i in first])
        else:
            both = overlaps([rows[i][3] for i in first], [rows[j][3] for j in second])
        linked_ = 100 * both >= percent * (n[first][:, None] + n[second] - both)
        if not cross:
            np.fill_diagonal(linked_, False)
        yield from zip([rows[i][1] for i in first], (linked_ @ m[second]).tolist())
        if cross:
            yield from zip([rows[j][1] for j in second], (m[first] @ linked_).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], Columns(pa.binary(), pa.int64())
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[:-1]]
            for i, (root, low, high, *row) in enumerate(zip(*cols)):
                if (root, low, high) != key:
                    if len(held) > 1:
                        out.rows.extend(links(held, key[1] != key[2]))
                    key, held = (root, low, high), []
                held.append((*row, np.frombuffer(batch.column(6)[i].as_buffer(), np.uint64)))
            yield out.batch(["class", "links"])
        if len(held) > 1:
            out.rows.extend(links(held, key[1] != key[2]))
        yield out.batch(["class", "links"])

    return run


def hopeful(percent: int):
    """Pairs whose parity tables differ in no more bits than linked sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            far = np.array([differing(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            keep = pa.array(np.flatnonzero(far * (100 + percent) <= n * (100 - percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["u", "v"])

    return run


def linked(percent: int):
    """Pairs of sets that reach the bound, by exact count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["u", "v"])

    return run


class Join:
    """The steps of one join; every table is kept in the scratch folder."""

    def __init__(self, docs: DataFrame, text: str, id_: str, words: int, percent: int):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        _base.small_batches(self.spark)
        self.scratch = _base.Scratch(self.spark)
        self.docs = docs.select(F.col(id_).cast("long").alias("id_"), F.col(text).alias("text_"))
        self.texts = self.docs.select(hashed_id("id_").alias("key"), "text_")
        #: n-gram sets of the classes that rounds have wanted, each class in one table.
        self.sets: list[DataFrame] = []

    def classes(self) -> DataFrame:
        """(id, n, class) of each document; also counts n-grams for the order."""
        found = self.scratch.keep(self.docs.mapInArrow(scan_classes(self.words), "kind int, at long, n long, class binary, parity binary"), "classes")
        often = found.filter("kind = 1").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
        slot = often.groupBy(F.col("at").bitwiseAND((1 << LEVEL_BITS) - 1).alias("slot")).agg(F.floor(F.log2(F.max("n"))).cast("int").alias("level"))
        rows = slot.toArrow()  # at most one row a slot of a table of fixed size
        self.levels = np.zeros(1 << LEVEL_BITS, np.uint8)
        self.levels[rows["slot"].to_numpy()] = rows["level"].to_numpy()
        #: One document of each class, by the hash of its id.
        self.first = found.filter("kind = 0 and class is not null").groupBy("class").agg(F.min(hashed_id("at")).alias("key"))
        self.parities = found.filter("kind = 0 and class is not null").select("class", "n", "parity")
        return found.filter("kind = 0").select(F.col("at").alias("id"), "n", "class")

    def columns(self) -> DataFrame:
        shared = _base.Shared(self.spark, self.levels)
        rows = self.texts.mapInArrow(scan_prefixes(shared, self.words, self.percent), "token long, n int, at int, level int, class binary")
        pieces = (F.pow(F.lit(2.0), F.col("level")) / PIECE).cast("long")
        piece = F.when(pieces < 2, -1).otherwise(F.pmod(F.xxhash64("class"), F.greatest(pieces, F.lit(1)))).cast("int")
        rows = rows.select("token", piece.alias("piece"), "n", "at", "class")
        dealt = rows.repartition("token", "piece").sortWithinPartitions("token", "piece", "n", "class")
        return self.scratch.keep(dealt.mapInArrow(shared_columns(self.percent), "token long, n int, at int, class binary, n0 int, at0 int, class0 binary"), "columns")

    def verify(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Edges among distinct candidate pairs (u < v), by whole sets."""
        pairs = self.scratch.keep(pairs, f"pairs{tag}")
        self.scratch.free_shuffles()
        members = ends(pairs)
        for known in self.sets:
            members = members.join(known, "class", "left_anti")
        members = self.scratch.keep(members.join(self.first, "class"), f"members{tag}")
        n = members.count()
        if n:
            shared = _base.Shared(self.spark, _base.key_filter(members.select("key"), n, FILTER_BITS))
            raw = self.texts.mapInArrow(scan_sets(shared, self.words), "class binary, set binary")
            self.sets.append(self.scratch.keep(raw.join(members.select("class"), "class", "left_semi").dropDuplicates(["class"]), f"sets{tag}"))
            self.scratch.free_shuffles()
        if not self.sets:
            return pairs.select("u", "v")
        sets = reduce(DataFrame.unionByName, self.sets)
        both = pairs.join(sets.select(F.col("class").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("class").alias("v"), F.col("set").alias("b")), "v")
        edges = self.scratch.keep(both.select("u", "v", "a", "b").mapInArrow(linked(self.percent), "u binary, v binary"), f"edges{tag}")
        self.scratch.drop(f"members{tag}", f"pairs{tag}")
        return edges

    def links(self, roots: DataFrame, classes: DataFrame) -> DataFrame:
        """(class, links): of the classes that link with another, how many documents of
        other classes each links with."""
        own = roots.select(F.col("node").alias("class"), "root")
        sizes = own.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        times = classes.filter("class is not null").groupBy("class").agg(F.count("*").alias("m"))
        rows = own.join(sizes, "root").join(times, "class").withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        rows = reduce(DataFrame.unionByName, self.sets).join(rows, "class")
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("root", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "class", "m", "set")
        dealt = rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
        found = dealt.mapInArrow(counted(self.percent), "class binary, links long")
        return self.scratch.keep(found.groupBy("class").agg(F.sum("links").alias("links")), "links")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (u < v) those that their parity tables leave."""
        pairs = self.scratch.keep(pairs, "all")
        self.scratch.free_shuffles()
        tables = self.parities.join(ends(pairs), "class", "left_semi").groupBy("class").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
        tables = self.scratch.keep(tables, "parity")
        self.scratch.free_shuffles()
        sides = [tables.select(*[F.col(c).alias(f"{c}_{x}") for c in ("n", "parity")], F.col("class").alias(x)) for x in ("u", "v")]
        both = pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "n_u", "n_v", "parity_u", "parity_v")
        return both.mapInArrow(hopeful(self.percent), "u binary, v binary")

    def nearest(self, rows: DataFrame) -> DataFrame:
        """Of the pairs that rows propose, two for each class: the partner of most
        columns and the smallest one. What is left out stays for a later round,
        and for the last, which leaves nothing out."""
        ok = bounded(self.percent, F.col("n"), F.col("at"), F.col("n0"), F.col("at0"))
        met = rows.filter(ok & (F.col("class") != F.col("class0"))).groupBy("class", "class0").agg(F.count("*").alias("times"), F.min("n0").alias("n0"))
        two = met.groupBy("class").agg(F.max_by("class0", F.struct("times", "class0")).alias("a"), F.min_by("class0", F.struct("n0", "class0")).alias("b"))
        pairs = two.select("class", F.explode(F.array_distinct(F.array("a", "b"))).alias("class0"))
        return pairs.select(F.least("class", "class0").alias("u"), F.greatest("class", "class0").alias("v")).distinct()

    def multiplied(self, rows: DataFrame, forest: bool) -> DataFrame:
        """Pairs of each column whose components differ, as far as the bounds leave
        them: the column's classes in blocks, and a task for each two blocks, so that
        a column of any size is split and its pairs never leave the task. With forest
        each block is taken alone and gives a spanning forest of its pairs."""
        tables = self.parities.join(rows.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.first("parity").alias("parity"))
        sizes = rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = rows.join(sizes, "token").withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        other = F.col("side") if forest else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = dealt.withColumn("other", other).join(tables, "class")
        dealt = dealt.select("token", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "n", "at", "class", "root", "parity")
        dealt = dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
        return dealt.mapInArrow(product(self.percent, forest), "u binary, v binary").distinct()

    def split(self, columns: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of columns that still touch more than one component, with it."""
        own = columns.select("token", "n", "at", "class").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        mixed = own.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("token")
        return own.join(mixed, "token", "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("class")).unionByName(pairs.select(F.col("v").alias("class"))).distinct()


def hashed_id(name: str):
    """A hash of an id; a null id has one too."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit(0)), F.col(name).isNull())


def components(docs: DataFrame, text: str = "text", id_: str = "doc_id", words: int = WORDS, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """One row a row of docs: id, ``n_shingles`` (distinct n-grams) and
    ``component_id``, the least id reachable by links. With links also ``class_id``, the
    least id of the documents with the same n-grams, and ``n_links``, the number of other
    documents that the document links with, those of its class among them.

    Words are runs of anything but ASCII whitespace, with A-Z lower-cased. A text
    of fewer words than an n-gram has its whole sequence as one; one without
    words has none and links with nothing. Two documents link when 100 times
    their common n-grams is at least percent times those of either. A null id
    reaches others and is never the least unless all are null; repeated rows link
    with each other.
    """
    job = Join(docs, text, id_, words, percent)
    classes = job.classes()
    columns = job.columns()
    job.scratch.free_shuffles()
    edges = job.verify(job.likely(job.nearest(columns.filter("class0 is not null"))), "a")
    roots = job.scratch.keep(connected(edges, job.scratch, "ca"), "rootsa")

    # a forest of each block between different components, then every pair left
    for tag, forest in (("b", True), ("c", False)):
        columns = job.scratch.keep(job.split(columns, roots), f"split{tag}")
        job.scratch.drop("all", "parity", "columns")
        job.scratch.free_shuffles()
        if columns.isEmpty():
            break
        more = job.verify(job.multiplied(columns, forest), tag)
        if not more.isEmpty():
            edges = job.scratch.keep(edges.unionByName(more), f"links{tag}")
            roots = job.scratch.keep(connected(edges, job.scratch, f"c{tag}"), f"roots{tag}")
        job.scratch.free_shuffles()

    named = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.filter("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    least = job.scratch.keep(least, "least")  # as a table of its own, a giant component's rows can be split
    out = named.join(least, "root", "left")
    if links:
        own = named.filter("class is not null").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("m"))
        own = own.join(job.links(roots, classes), "class", "left") if job.sets else own.withColumn("links", F.lit(0))
        own = job.scratch.keep(own.select("class", "class_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "counts")
        out = out.join(own, "class", "left")
        more = [F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    else:
        more = []
    return out.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *more)
