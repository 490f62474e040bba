"""Quality by compression: zstandard dictionaries cut from good and from bad labelled
text. A text is compressed with each; the difference of the sizes that the best
dictionary of either class gives, over the text's size, is its raw score, and a rising
curve (isotonic regression) fitted on labelled texts outside the dictionaries makes it
a probability.

The compressor looks up about the last million bytes of a dictionary and no others, so
a class has as many dictionaries of DICT_BYTES as its texts fill, and each frame takes
the least of their sizes: all of a class's text counts, wherever it stands.

Whole texts are compressed, in frames of FRAME bytes, so that a dictionary
matters as much at the end of a long text as at its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _base

FRAME, LEVEL = 2048, 3
#: Bounds of the fit: labelled texts of each class, and bytes of a class's dictionaries.
#: Half of the texts make the dictionaries, half the calibration; whole texts are taken in
#: order of their ids' hashes while both halves are within the bound, and the one that
#: passes it is cut there.
PER_CLASS, DICTS, DICT_BYTES = 800, 4, 900_000
#: Score of a text without bytes, and of any text when one class has no rows.
NEUTRAL = 0.5
THRESHOLD = 0.3
#: The curve's odds end here, as a bounded sample tells nothing surer.
CERTAIN = 0.002


@dataclass
class Model:
    goods: tuple[bytes, ...]
    bads: tuple[bytes, ...]
    #: The calibration curve: log-odds at raw scores, straight between, and their slope beyond.
    raws: tuple[float, ...]
    odds: tuple[float, ...]
    slope: float

    @property
    def good(self) -> bytes:
        return b"".join(self.goods)

    @property
    def bad(self) -> bytes:
        return b"".join(self.bads)

    def scorer(self):
        import zstandard as z

        def pack(raw: bytes):
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        goods, bads = ([pack(raw) for raw in own] for own in (self.goods, self.bads))

        def raw_score(data: bytes) -> float:
            frames = [data[i : i + FRAME] for i in range(0, len(data), FRAME)]
            good, bad = (sum(min(len(p.compress(f)) for p in packs) for f in frames) for packs in (goods, bads))
            return (bad - good) / len(data)

        return raw_score

    def probability(self, raw: float) -> float:
        beyond = min(raw - self.raws[0], 0.0) + max(raw - self.raws[-1], 0.0)
        return float(1 / (1 + np.exp(-np.clip(np.interp(raw, self.raws, self.odds) + self.slope * beyond, -30, 30))))


def dictionary(texts: list[str]) -> bytes:
    """Raw content: the whole texts, up to the bound of a class."""
    return b"".join(t.encode() for t in texts)[: DICTS * DICT_BYTES]


def dictionaries(texts: list[str]) -> tuple[bytes, ...]:
    """The content in as few dictionaries of equal size as the compressor looks up whole."""
    raw = dictionary(texts)
    n = max(1, -(-len(raw) // DICT_BYTES))
    size = max(1, -(-len(raw) // n))
    return tuple(raw[i : i + size] for i in range(0, len(raw), size)) or (b"",)


def fit(rows: list[tuple[str, int]], share: float = 0.5) -> Model | None:
    """rows: (text, label 0 or 1), a bounded sample in a fixed order; none when a
    class is missing. share: how many of the table's labels are 1, to which the
    probabilities are calibrated."""
    halves = {y: [t for t, x in rows if x == y and t] for y in (0, 1)}
    if min(map(len, halves.values())) < 2:
        return None
    first = {y: halves[y][0::2] for y in halves}
    model = Model(dictionaries(first[1]), dictionaries(first[0]), (0.0,), (0.0,), 0.0)
    score = model.scorer()
    held = [(score(t.encode()), y) for y in (0, 1) for t in halves[y][1::2]]
    x, y = np.array([a for a, _ in held]), np.array([float(b) for _, b in held])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    raws, odds = rising(x, y, weight)
    return Model(model.goods, model.bads, raws, odds, steepness(x, y, weight))


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Isotonic regression by pooling adjacent violators: mean raw score and log-odds
    of each pool."""
    pools: list[list[float]] = []  # weight, weighted label, weighted raw score
    for i in np.argsort(x, kind="stable"):
        pools.append([weight[i], weight[i] * y[i], weight[i] * x[i]])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0] or pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]):
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    p = np.clip([b / a for a, b, _ in pools], CERTAIN, 1 - CERTAIN)
    odds = np.log(p / (1 - p))
    return tuple(c / a for a, _, c in pools), tuple(odds.tolist())


def steepness(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Slope of a logistic curve through all rows, at least 0."""
    mean, scale = x.mean(), x.std() or 1.0
    design, b = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(50):  # Newton steps of a lightly ridged logistic regression
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-3 * b * [1, 0]
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-9])
        b = b - np.linalg.solve(hess, grad)
    return float(max(0.0, b[0] / scale))


def sample(docs: DataFrame, labels: DataFrame, learn, text: str = "text", id_: str = "doc_id", label: str = "quality") -> list[tuple[str, int]]:
    """The bounded training rows. PER_CLASS ids a class are chosen from the labels
    first, one for each hash slot, so the join's small side has at most
    2 * PER_CLASS rows; lengths then choose those whose texts come to the driver, at
    most twice a class's dictionaries in bytes, and one text more of each class, cut to
    that size."""
    rows = labels.select(F.col(id_).alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null and y in (0, 1)")
    rows = rows.filter(learn("i"))
    h = F.xxhash64("i")
    chosen = rows.groupBy("y", F.pmod(h, F.lit(PER_CLASS)).alias("slot")).agg(F.min_by("i", h).alias("i")).select("i", "y")
    whole = docs.select(F.col(id_).alias("i"), F.col(text).alias("t")).filter("t <> ''")
    most = 2 * DICTS * DICT_BYTES
    sizes = whole.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min(F.octet_length("t")).cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("y").orderBy(h, "i").rowsBetween(Window.unboundedPreceding, -1))
    taken = sizes.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most).select("i", "y")
    found = whole.join(F.broadcast(taken), "i").groupBy("i", "y").agg(F.min("t").alias("t")).select("y", F.left("t", F.lit(most)).alias("t")).orderBy(h, "i")
    return [(r.t, r.y) for r in found.collect()]


def share(labels: DataFrame, learn, id_: str = "doc_id", label: str = "quality") -> float:
    """How many of the learnable labels are 1; a half when there are none."""
    rows = labels.select(F.col(id_).alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null and y in (0, 1)")
    return rows.filter(learn("i")).agg(F.avg("y")).first()[0] or 0.5


def score(docs: DataFrame, model: Model | None, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row a document: id and ``score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts, and every text when there was no model to fit, score
    NEUTRAL. Equal texts score alike, repeated rows each by itself; a null id stays null.
    Texts are scored whole, at any length; other columns, whatever their names, are not
    read. An empty table gives none."""
    _base.small_batches(docs.sparkSession)
    shared = _base.Shared(docs.sparkSession, model)  # at most 2 * DICTS * DICT_BYTES of dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        raw_score = m.scorer() if m else None
        for batch in batches:
            for part, raw, offs in _base.passes(batch, 1):
                out = [m.probability(raw_score(raw[a:b].tobytes())) if m and b > a else NEUTRAL for a, b in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], ["id_", "score"])

    kind = docs.schema[id_].dataType.simpleString()
    out = docs.select(F.col(id_).alias("id_"), F.col(text).alias("text_")).mapInArrow(run, f"id_ {kind}, score double")
    return out.withColumnRenamed("id_", id_)
