"""Many words sought in a text at once, by an Aho-Corasick automaton.

Each row to find has pieces, strings that a text must all hold. Rows are dealt to
blocks of bounded size; a block travels to each task once, beside the first row of a
partition, and the task builds its automaton there. A text is read once a block,
whatever the number of rows in it.

The automaton proposes: it sees texts and pieces in a folded form (one case, runs of
joints as one space) in which whatever a pattern can match is found. Patterns decide, on
the few letters around each place, so a long text is not searched again for each hit."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..plans.blocks import beside_first
from ..tables import keep

#: Bytes of the pieces of a block, on average: some 80,000 terms.
BLOCK_BYTES = 1 << 20
#: Texts whose hits are sent at a time.
SENT = 256


class Fold:
    """One form for all letters that a pattern which ignores case takes for equal: the
    lower case of the upper case, letter by letter; and one space for a run of joints."""

    def __init__(self, joints: str | None, case: bool = True):
        self.joints, self.case = joints and re.compile(joints), case

    def __call__(self, text: str) -> tuple[str, Callable[[int], int]]:
        """The folded text, and where each of its letters stands in the text."""
        if self.case:
            text = text.lower() if text.isascii() or not odd_letters().search(text) else "".join(map(one_case, text))
        if not self.joints:
            return text, same_place
        whole = self.joints.sub(" ", text)
        if len(whole) == len(text):  # no run is longer than a letter
            return whole, same_place
        ends, skipped = [0], [0]
        for run in self.joints.finditer(text):
            if run.end() - run.start() > 1:
                ends.append(run.start() + 1 - skipped[-1])  # where letters after the run stand when folded
                skipped.append(skipped[-1] + run.end() - run.start() - 1)
        return whole, lambda i: i + skipped[bisect_right(ends, i) - 1]


def same_place(i: int) -> int:
    return i


@lru_cache
def odd_letters() -> re.Pattern:
    """Letters of which lower case is not the one form: all that have cases are below
    U+20000, and a sigma's lower case depends on what follows it."""
    return re.compile("[" + re.escape("".join(c for c in map(chr, range(128, 0x20000)) if c == "Σ" or c.lower() != one_case(c))) + "]")


@lru_cache(1 << 16)
def one_case(letter: str) -> str:
    upper = letter.upper()
    return (upper if len(upper) == 1 else letter).lower()[0]


#: How pieces of terms, of phrases and of stems are met: joints, and whether pieces
#: stand at word boundaries, with these endings before the second.
WORDS, PHRASES, PARTS = (r"\s+", True, ("",)), (r"[\s\-]+", True, ("", "s", "es")), (None, False, ())


class Finder:
    """The rows of a block whose pieces a text all holds, each with the places of its
    longest piece: slices of the text from the letter before the piece (a line end where
    the text begins) to as far as a pattern may look behind it."""

    def __init__(self, block: pa.StructArray, joints: str | None, bounded: bool, endings: tuple[str, ...]):
        import ahocorasick

        self.fold, self.bounded, self.endings = Fold(joints, case=bounded), bounded, endings
        self.tail = 1 + max(map(len, endings), default=0)
        self.ids, self.said = block.field("id"), block.field("said")
        number: dict[str, int] = {}
        # of each row, the longest piece leads to it and the others, if any, are then asked for
        self.led: list[list[int]] = []
        self.others: dict[int, frozenset[int]] = {}
        for row, pieces in enumerate(block.field("pieces")):
            own = {self.fold(p)[0].strip(" ") if joints else p for p in pieces.as_py() or ()} - {""}
            if own:
                at = {p: number.setdefault(p, len(number)) for p in own}
                self.led += [[] for _ in range(len(number) - len(self.led))]
                self.led[at[max(own, key=lambda p: (len(p), p))]].append(row)
                if len(own) > 1:
                    self.others[row] = frozenset(at.values())
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS) if number else None
        self.size = [0] * len(number)
        for p, i in number.items():
            self.tree.add_word(p, i)
            self.size[i] = len(p)
        if number:
            self.tree.make_automaton()

    def at_word(self, text: str, start: int, end: int) -> bool:
        if start and is_word(text[start - 1]):
            return False
        return any(text.startswith(x, end) and not (end + len(x) < len(text) and is_word(text[end + len(x)])) for x in self.endings)

    def __call__(self, text: str | None) -> list[tuple[int, list[str]]]:
        """Rows of the block, each with its slices."""
        if not text or not self.tree:
            return []
        folded, place = self.fold(text)
        met: dict[int, set[str]] = {}
        for last, i in self.tree.iter(folded):
            start, end = last + 1 - self.size[i], last + 1
            if not self.bounded:
                met.setdefault(i, set())
            elif self.at_word(folded, start, end):
                a = place(start)
                met.setdefault(i, set()).add((text[a - 1] if a else "\n") + text[a : place(end - 1) + 1 + self.tail])
        return [(row, sorted(slices)) for i, slices in met.items() for row in self.led[i] if self.others.get(row, frozenset()) <= met.keys()]

    def hits(self, found: list[list[tuple[int, list[str]]]]) -> pa.ListArray:
        """Rows found in each of several texts as structs of id, said and slices."""
        rows = pa.array([row for text in found for row, _ in text], pa.int64())
        slices = pa.array([s for text in found for _, s in text], pa.list_(pa.string()))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([self.ids.take(rows), self.said.take(rows), slices], ["id", "said", "slices"]))


def is_word(letter: str) -> bool:
    """What every pattern takes for a part of a word: letters, decimal digits and the
    low line. Other characters may be one for some pattern, which then refuses."""
    return letter.isalpha() or letter.isdecimal() or letter == "_"


ROWS = pa.struct([("id", pa.int64()), ("pieces", pa.list_(pa.string())), ("said", pa.string())])
HITS = types.ArrayType(types.StructType().add("id", types.LongType()).add("said", types.StringType()).add("slices", types.ArrayType(types.StringType())))


def find(rows: DataFrame, text: Column, keep_: list[str], sought: DataFrame, how: tuple, block_bytes: int | None = None) -> DataFrame:
    """The columns keep_ of rows and ``hit``, one row for each text and each row of sought
    (id long, pieces array<string>, said string) whose pieces the text can hold. said is a
    pattern to hold against the hit's slices, or null. Neither texts nor patterns leave the
    task. sought should be a written table: it is read once to count its bytes, and once a
    block."""
    size = sought.agg(F.sum(F.octet_length(F.array_join("pieces", "")).cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    carried = [f"c{i}" for i in range(len(keep_))]
    lean = rows.select(*[F.col(c).alias(n) for c, n in zip(keep_, carried)], text.alias("text_"))
    schema = types.StructType([*lean.schema.fields[:-1], types.StructField("hits", HITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None
        for batch in batches:
            if finder is None and batch.num_rows:
                finder = Finder(pa.array(json.loads(batch.column("block_rows")[0].as_py()), ROWS), *how)
            found = [finder(t) for t in batch.column("text_").to_pylist()]
            met = [i for i, h in enumerate(found) if h]
            for lo in range(0, len(met), SENT):
                some = met[lo : lo + SENT]
                kept = batch.select(carried).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*kept.columns, finder.hits([found[i] for i in some])], [*carried, "hits"])

    def block(g: int) -> DataFrame:
        own = sought.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == g) if blocks > 1 else sought
        # a block of bounded size, as one string: a nested column would cost each row that lacks it
        own = own.agg(F.to_json(F.collect_list(F.struct("id", "pieces", "said"))).alias("block_rows"))
        return beside_first(lean, own).mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, map(block, range(blocks)))
    found = found.select(*carried, F.explode("hits").alias("h")).select(*[F.col(n).alias(c) for n, c in zip(carried, keep_)], F.col("h.id").alias("hit"), F.col("h.said").alias("said_"), F.col("h.slices").alias("slices_"))
    # a slice begins one letter before the match
    return found.filter(F.expr("said_ is null or exists(slices_, x -> x rlike concat('(?s)^.', said_))")).drop("said_", "slices_")


def with_ids(terms: DataFrame) -> DataFrame:
    """terms, written, with an ``id`` of each row that stays as it is when a task runs again."""
    return keep(terms.withColumn("id", F.monotonically_increasing_id()))
