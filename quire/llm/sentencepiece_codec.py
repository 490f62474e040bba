"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary continues past a whitespace marker, and none but the
byte pieces holds a newline. A text therefore falls into chunks (a run of
markers with what follows it, cut after each newline) whose ids do not depend on
their neighbours: each distinct chunk is segmented once and the ids are joined
back by position.

Chunks are counted over the whole corpus, distinct ones only being shuffled. The
(up to) TABLE_CHUNKS met most often are segmented once and their ids broadcast, a table
of at most TABLE_CHUNKS entries of ENTRY_BYTES. The rare rest is segmented where it
stands, each distinct chunk once a pass of a task. Shuffling every occurrence to
join ids back would move the text several times over. Bytes are cut, told apart
and joined back by numpy and Arrow; Python sees distinct chunks alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base

MARK = "▁"
#: Bounds of the broadcast table: entries, and bytes of a chunk in it. Longer
#: chunks are segmented where they stand.
TABLE_CHUNKS, ENTRY_BYTES = 100_000, 128
#: Distinct chunks that a task counts at a time.
COUNTED = 500_000


def check_model(model: bytes) -> None:
    """Refuses a model whose ids do depend on neighbouring chunks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    n = m.normalizer_spec
    bad = [p.piece for p in m.pieces if p.type not in (2, 3, 6) and (re.search(f"[^{MARK}]{MARK}", p.piece) or "\n" in p.piece or p.type == 4)]
    if bad or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"chunks of this model are not independent: {bad[:5] or n.name}")


def chunks_of(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of a slice of texts, each text with a space before it, and the
    first chunk of each text (and after the last)."""
    some = np.diff(offs) > 0
    buf = np.insert(raw, offs[:-1][some], 32)
    top = offs + np.r_[0, np.cumsum(some)]
    lead = buf == 32
    end = lead.copy()
    mark = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81)) if len(buf) > 2 else np.zeros(0, np.int64)
    lead[mark], end[mark + 2] = True, True
    cut = lead
    cut[1:] &= ~end[:-1]
    cut[1:] |= buf[:-1] == 10
    cut[top[:-1][some]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(buf)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
    return chunks.dictionary_encode(), np.searchsorted(starts, top)


class Segmenter:
    """Ids of single chunks."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.mark, self.skip = self.sp.piece_to_id(MARK), len(self.sp.encode("\n"))

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The library puts a marker before a text: that of the chunk itself, or one
        before a newline whose ids are left out."""
        marked = [c[0] in (" ", MARK) for c in chunks]
        out = self.sp.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked)], num_threads=1)
        return [(x or [self.mark]) if m else x[self.skip :] for x, m in zip(out, marked)]


def joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array with n + 1 offsets."""
    offs = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offs[1:])
    return np.fromiter((i for x in lists for i in x), np.int32, int(offs[-1])), offs


class Table:
    """Chunks met often, with their ids."""

    def __init__(self, chunks: list[str], ids: list[list[int]]):
        self.place = {c: i for i, c in enumerate(chunks)}
        self.ids, self.offs = joined(ids)

    def encode(self, raw: np.ndarray, offs: np.ndarray, segmenter: Segmenter) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, and their n + 1 offsets."""
        chunks, first = chunks_of(raw, offs)
        names, own = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        at = np.array([self.place.get(c, -1) for c in names], np.int64)
        rare = np.flatnonzero(at < 0)
        ids, ends = joined(segmenter.segment([names[i] for i in rare.tolist()]))
        start, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        known = at >= 0
        start[known], size[known] = self.offs[at[known]], np.diff(self.offs)[at[known]]
        start[rare], size[rare] = ends[:-1] + len(self.ids), np.diff(ends)
        sizes = size[own]
        before = np.r_[0, np.cumsum(sizes)]
        flat = np.concatenate([self.ids, ids])[np.repeat(start[own] - before[:-1], sizes) + np.arange(before[-1])]
        return flat, before[first]


def scan_chunks(counted: int):
    """Distinct chunks of a task and how often it met them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined() -> pa.Table:
            return pa.concat_tables(held).group_by("chunk").aggregate([("n", "sum")]).rename_columns(["chunk", "n"])

        def sent(table: pa.Table) -> list[pa.RecordBatch]:
            return table.cast(pa.schema([("chunk", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=20_000)

        for batch in batches:
            for _, raw, offs in _base.passes(batch, 1):
                chunks, _ = chunks_of(raw, offs)
                n = np.bincount(chunks.indices.to_numpy(), minlength=len(chunks.dictionary))
                held.append(pa.table({"chunk": chunks.dictionary, "n": n}))
                size += len(n)
                if size > counted:
                    held = [combined()]
                    size = held[0].num_rows
                    if 2 * size > counted:
                        yield from sent(held[0])
                        held, size = [], 0
        if held:
            yield from sent(combined())

    return run


def common_chunks(docs: DataFrame, model: bytes, text: str = "text", entries: int = TABLE_CHUNKS, counted: int = COUNTED) -> Table:
    """The chunks of the whole corpus that are met most often, each segmented once."""
    shared = _base.Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(segmenter.segment(batch.column(0).to_pylist()), pa.list_(pa.int32()))], ["chunk", "ids"])

    scratch = _base.Scratch(docs.sparkSession)
    found = docs.select(F.lit(0).alias("zero_"), F.col(text).alias("text_")).mapInArrow(scan_chunks(counted), "chunk string, n long")
    counts = found.groupBy("chunk").agg(F.sum("n").alias("n")).filter((F.col("n") > 1) & (F.octet_length("chunk") <= ENTRY_BYTES))
    counts = scratch.keep(counts.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "chunks")
    # the lowest step of counts from which on no more than the bound are left
    least, left = 1 << 30, entries
    for step, n in sorted(map(tuple, counts.groupBy("step").count().collect()), reverse=True):
        if n > left:
            break
        least, left = step, left - n
    often = counts.filter(F.col("step") >= least).select("chunk")
    rows = often.mapInArrow(run, "chunk string, ids array<int>").toArrow()  # at most so many entries
    scratch.drop("chunks")
    return Table(rows["chunk"].to_pylist(), rows["ids"].to_pylist())


def encode(docs: DataFrame, model: bytes, text: str = "text", id_: str = "doc_id", keep: list[str] | None = None, decoded: bool = False, entries: int = TABLE_CHUNKS, counted: int = COUNTED) -> DataFrame:
    """Adds ``ids array<int>`` (and ``decoded string``: those ids put through the
    library's decode) to the columns in keep (the id alone by default; of these the
    result's own columns replace any of their names).

    Null and empty texts have no ids and decode to the empty text. Texts are encoded
    whole, at any length; a null id stays null. Repeated rows give repeated results, an
    empty table none; other columns, whatever their names, are not read.
    """
    check_model(model)
    _base.small_batches(docs.sparkSession)
    more = ["ids", *["decoded"] * decoded]
    held = _base.Carried(docs, [id_] if keep is None else keep, text, more)
    shared = _base.Shared(docs.sparkSession, (model, common_chunks(docs, model, text, entries, counted)))  # of bounded size
    at = held.text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        segmenter = Segmenter(model)
        for batch in batches:
            for part, raw, offs in _base.passes(batch, at):
                flat, ends = table.encode(raw, offs, segmenter)
                cols = [*held.columns(part), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    lists = [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
                    cols.append(pa.array(segmenter.sp.decode(lists, num_threads=1) if lists else [], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*held.names, *more])

    out = held.rows.mapInArrow(run, held.with_columns("ids array<int>", *["decoded string"] * decoded))
    return held.back(out, *more)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", id_: str = "doc_id") -> DataFrame:
    """``decoded string`` for each row's ids, by the library's decode; null ids give the empty text."""
    shared = _base.Shared(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Segmenter(shared.value).sp
        for batch in batches:
            texts = [sp.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id_", "decoded"])

    kind = rows.schema[id_].dataType.simpleString()
    out = rows.select(F.col(id_).alias("id_"), F.col(ids).alias("ids_")).mapInArrow(run, f"id_ {kind}, decoded string")
    return out.withColumnRenamed("id_", id_)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by commas."""
    inner = F.expr(f"cast({ids} as string)")
    return F.replace(F.substring(inner, F.lit(2), F.length(inner) - 2), F.lit(" "))
