"""What the training-data operators share: byte views of Arrow text, word and
shingle hashing in numpy, fixed-size key filters, and scratch tables in the
shared folder.

Rules that hold for every operator of this subpackage
* a null text is the empty text;
* a null id sorts below every other id and is kept as null in results;
* extra columns pass through table operators untouched, whatever their names;
* intermediate results are written to the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer text is one pass.
PASS_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python; a longer row is one batch.
BATCH_BYTES = 1 << 23

MIX_A, MIX_B, MIX_C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, and only
    when driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Shared:
    """A broadcast value, unpickled once a task."""

    def __init__(self, spark: SparkSession, value):
        self.raw, self.value_ = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"raw": self.raw, "value_": None}

    def free(self) -> None:
        """Frees the executors' copies; a later use would fetch it again."""
        self.raw.unpersist()

    @property
    def value(self):
        if self.value_ is None:
            self.value_ = pickle.loads(self.raw.value)
        return self.value_


class Scratch:
    """Tables written once to the shared folder and read back, so that a lost
    executor costs a re-read and not the whole lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
        atexit.register(self.close)  # results are read from here for as long as the program runs

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone by now
            self.drop("")

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(compression="zstd", **options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free_shuffles(self) -> None:
        """Shuffle files behind kept tables are needed no more; Spark deletes them once
        the driver has collected the plans that made them, so collect now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are counted in rows by default; whole texts and sets are long
    rows, so batches are bounded in bytes too, for this session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have in any letter case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c):
    """A-Z only; other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Carried:
    """The columns of a scan in Python: those to keep, under names that cannot
    clash, and the text once, wherever it stands. Of columns to keep that have the
    name of one in made (in any letter case) the made one takes the place."""

    def __init__(self, docs: DataFrame, keep: list[str], text: str, made: list[str] = []):  # noqa: B006
        keep = [c for c in keep if c.lower() not in made]
        self.keep, self.names = keep, [f"c{i}" for i in range(len(keep))]
        cols = [F.col(c).alias(n) for c, n in zip(keep, self.names)]
        self.text = keep.index(text) if text in keep else len(keep)
        self.rows = docs.select(*cols, *[F.col(text).alias("text_")] * (text not in keep))
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema.fields}
        self.schema = ", ".join(f"`{n}` {kinds[n]}" for n in self.names)

    def with_columns(self, *more: str) -> str:
        """The schema of the kept columns and more."""
        return ", ".join([*[self.schema] * bool(self.schema), *more])

    def columns(self, part: pa.RecordBatch) -> list[pa.Array]:
        return part.columns[: len(self.names)]

    def back(self, out: DataFrame, *more: str) -> DataFrame:
        return out.select(*[F.col(n).alias(c) for n, c in zip(self.names, self.keep)], *more)

    def __getstate__(self):
        return {"names": self.names, "text": self.text}


# ---------------------------------------------------------------- bytes of a batch


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def passes(batch: pa.RecordBatch, text: int, size: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about size (PASS_BYTES) of text each, with bytes and offsets."""
    raw, offs = utf8(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + (size or PASS_BYTES), "right")) - 1))
        yield batch.slice(lo, hi - lo), raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_B)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_C)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX_A)) | np.uint64(1)


#: Places in a word whose values are looked up; those of later bytes are computed.
NEAR_PLACES = 64


def placed_values(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte at its place in its word, as good as random: sums
    of these, unlike polynomials modulo 2**64, have no words that always meet."""
    value = byte_values()
    with np.errstate(over="ignore"):
        known = mix(value[:, None] + np.arange(NEAR_PLACES, dtype=np.uint64) * np.uint64(MIX_B)).ravel()
        out = known[raw.astype(np.int64) * NEAR_PLACES + np.minimum(place, NEAR_PLACES - 1)]
        far = np.flatnonzero(place >= NEAR_PLACES)
        if len(far):
            out[far] = mix(value[raw[far]] + place[far].astype(np.uint64) * np.uint64(MIX_B))
    return out


class Words:
    """Words of a slice of documents: 64-bit hashes, spans and the first word of
    each document. fold maps each byte to its folded form, 0 for a separator."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, fold: np.ndarray):
        arr = fold[raw] if len(raw) else raw
        inside = arr != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = offs[:-1][(offs[:-1] < len(arr))]
        first[cut] = inside[cut]  # no word crosses from one document to the next
        self.starts = np.flatnonzero(first)
        packed = arr[inside]
        at = np.cumsum(inside, dtype=np.int64)[self.starts] - 1 if len(self.starts) else np.zeros(0, np.int64)
        lens = np.diff(np.append(at, len(packed)))
        self.ends = self.starts + lens
        with np.errstate(over="ignore"):
            if len(at):
                offset = np.arange(len(packed)) - np.repeat(at, lens)
                h = np.add.reduceat(placed_values(packed, offset), at)
                self.hash = mix(h + lens.astype(np.uint64) * np.uint64(MIX_C))
            else:
                self.hash = np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.starts, offs)  # words of document i: bounds[i] to bounds[i + 1]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; fewer words are one run, none is nothing."""
    k = min(k, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k * MIX_B & (2**64 - 1), np.uint64)
        for j in range(k):
            out = out * np.uint64(MIX_A) + h[j : j + len(out)]
        return mix(out)


def whitespace_fold() -> np.ndarray:
    """A-Z to a-z; space and bytes 9 to 13 separate."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[0] = 255  # a word character; UTF-8 has no byte 255
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


# ---------------------------------------------------------------- fixed-size key filter


class KeyFilter:
    """A Bloom filter of at most 2**max_bits bits over 64-bit keys, for thinning
    rows before an exact shuffle. Its size has a fixed bound; beyond the keys
    that fit, more rows pass and the exact step still decides."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            at = (keys >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            out &= (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def key_filter(keys: DataFrame, n: int, max_bits: int = 26) -> KeyFilter:
    """From a DataFrame with one long column ``key``: the two 32-bit halves give
    the positions. Words are or-ed on the executors; the driver receives at most
    2**(max_bits - 3) bytes in rows of 64 bits."""
    bits = int(min(max_bits, max(12, np.ceil(np.log2(max(1, n) * 12)))))
    bits = min(bits, 32)
    mask = (1 << bits) - 1
    at = keys.select(F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toArrow()
    words = np.zeros((1 << bits) // 64, np.int64)
    words[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return KeyFilter(bits, words.view(np.uint8))
