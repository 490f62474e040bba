"""Language identification by a string kernel.

The kernel of two texts counts the n-grams, of every order up to ORDERS, present
in both, divided by the root of the product of their numbers (a blended-spectrum
presence kernel). Landmark texts span a Nyström feature space; in it, one ridge
regression for each language against the rest is solved. n-grams are bytes of
the lower-cased text, hashed to DIMS slots for each order.

The presence kernel is linear in presence vectors, so landmarks and regression
fold into one slots x languages matrix: a batch is scored by one product of its
sparse presence matrix with that matrix, at a cost that does not depend on the
number of landmarks, and equals the sum over landmarks to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _base

ORDERS = (1, 2, 3, 4)
#: Slots for each order.
DIMS = 1 << 15
#: Bounds of the fit: whole texts of one language, landmarks in all.
PER_LANGUAGE, LANDMARKS = 400, 256
#: Texts of all languages together.
TOTAL = 4000
#: Kernel rows that are computed at a time.
ROWS = 64
RIDGE = 1e-2
UNDETERMINED = "und"
#: Sharpness of the score; monotone in the margin.
SHARP = 6.0


def fold_table() -> np.ndarray:
    """A-Z to a-z; runs of ASCII that is no letter act as one separator value."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    other = np.ones(128, bool)
    other[97:123] = other[65:91] = False
    t[:128][other] = 32
    return t


def presence(raw: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Sorted slots of the n-grams of one text."""
    x = fold_table()[raw]
    flags = np.zeros(len(ORDERS) * dims, bool)
    if len(x):
        x = np.r_[np.uint8(32), x, np.uint8(32)]
        x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]].astype(np.uint32)
        h = np.zeros(len(x), np.uint32)
        for i, n in enumerate(ORDERS):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
            slot = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(17)
            flags[slot.astype(np.int64) % dims + i * dims] = True
    return np.flatnonzero(flags)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    bias: np.ndarray

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sparse presence rows times the weights, a row for each text."""
        lens = np.array([len(s) for s in sets])
        out = np.zeros((len(sets), len(self.languages)))
        some = np.flatnonzero(lens)
        if len(some):
            flat = np.concatenate([sets[i] for i in some])
            sums = np.add.reduceat(self.weights[flat], np.r_[0, np.cumsum(lens[some])[:-1]], axis=0)
            out[some] = sums / np.sqrt(lens[some])[:, None]
        return out + self.bias


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def kernel_rows(sets: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """The presence kernel of texts with landmarks: common slots over the root of
    the product of both numbers, by batched products of 0/1 matrices on the slots
    that landmarks have."""
    cols = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    if not len(cols):
        return np.zeros((len(sets), len(marks)))

    def dense(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(some), len(cols)), np.float32)
        for i, x in enumerate(some):
            out[i, np.searchsorted(cols, x[np.isin(x, cols, assume_unique=True)])] = 1
        return out

    right = dense(marks).T
    norm = [np.sqrt([max(1, len(x)) for x in some]) for some in (sets, marks)]
    both = np.vstack([dense(sets[i : i + ROWS]) @ right for i in range(0, len(sets), ROWS)])
    return both / norm[0][:, None] / norm[1]


def fit(rows: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """rows: (slots, language), already a bounded sample in a fixed order."""
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return Model([], np.zeros((len(ORDERS) * DIMS, 0)), np.zeros(0))
    sets = [s for s, _ in rows]
    by_lang = [[i for i, (_, x) in enumerate(rows) if x == lang] for lang in languages]
    take = max(1, landmarks // len(languages))
    marks = [i for own in by_lang for i in own[:take]]
    kernel = kernel_rows(sets, [sets[i] for i in marks])
    value, vector = np.linalg.eigh((kernel[marks] + kernel[marks].T) / 2)
    good = value > value.max() * 1e-6
    root = vector[:, good] / np.sqrt(value[good])  # Nyström map: kernel to landmarks times root
    x = kernel @ root
    y = np.array([[1.0 if lang == x_ else -1.0 for lang in languages] for _, x_ in rows])
    mean, bias = x.mean(axis=0), y.mean(axis=0)
    a = (x - mean).T @ (x - mean) + ridge * len(rows) * np.eye(x.shape[1])
    beta = root @ np.linalg.solve(a, (x - mean).T @ (y - bias))
    # the primal form: each landmark's share at its slots
    weights = np.zeros((len(ORDERS) * DIMS, len(languages)))
    for i, w in zip(marks, beta):
        weights[sets[i]] += w / np.sqrt(max(1, len(sets[i])))
    return Model(languages, weights.astype(np.float32), bias - kernel.mean(axis=0) @ beta)


def unlearned(name: str = "any") -> Model:
    """A model of one language, that of every text with a letter."""
    return Model([name], np.zeros((len(ORDERS) * DIMS, 1)), np.zeros(1))


def sample(docs: DataFrame, learn, text: str = "text", id_: str = "doc_id", lang: str = "lang") -> list[tuple[np.ndarray, str]]:
    """The bounded training rows, slots and language: for each language up to
    PER_LANGUAGE learnable texts, and no more than TOTAL in all (one a language at
    least), the one of least hash in each slot of hashes.
    Hashes are chosen first and the chosen rows found by them; whole texts become
    slots (at most ORDERS x DIMS of them) where they stand."""
    rows = docs.filter(learn).filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(id_), F.col(text)).alias("h")).filter(F.col("t").rlike("\\p{L}"))
    languages = docs.filter(learn).agg(F.countDistinct(F.col(lang).cast("string"))).first()[0]
    each = max(1, min(PER_LANGUAGE, TOTAL // max(1, languages)))
    chosen = rows.groupBy("l", F.pmod("h", F.lit(each)).alias("slot")).agg(F.min("h").alias("h")).select("l", "h")
    found = rows.join(F.broadcast(chosen), ["l", "h"], "left_semi").select("h", "l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in _base.passes(batch, 2):
                sets = [presence(raw[a:b]).astype(np.int32).tobytes() for a, b in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["h", "l", "s"])

    sets = found.mapInArrow(run, "h long, l string, s binary").groupBy("l", "h").agg(F.first("s").alias("s"))
    return [(np.frombuffer(r.s, np.int32).astype(np.int64), r.l) for r in sets.orderBy("l", "h").collect()]


def identify(docs: DataFrame, model: Model, text: str = "text", id_: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row a document: the columns in keep (the id alone by default; the result's
    own columns replace any of their names), ``lang_pred`` and ``score`` (0 to 1, the chosen language's share). A text that is null or has no letter, or a model that
    learned from nothing, gives ``und`` and 0. Ties go to the first language in
    alphabetical order; equal texts give equal values."""
    _base.small_batches(docs.sparkSession)
    shared = _base.Shared(docs.sparkSession, model)  # slots x languages, fixed size
    held = _base.Carried(docs, [id_] if keep is None else keep, text, ["lang_pred", "score"])
    at = held.text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, raw, offs in _base.passes(batch, at):
                texts = part.column(at).to_pylist()
                sets = [presence(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])]
                if m.languages:
                    out = m.score(sets)
                    s = np.exp(SHARP * (out - out.max(axis=1, keepdims=True)))
                    best, share = out.argmax(axis=1), (s / s.sum(axis=1, keepdims=True)).max(axis=1)
                ok = [bool(t) and bool(m.languages) and has_letter(t) for t in texts]
                langs = pa.array([m.languages[best[i]] if x else UNDETERMINED for i, x in enumerate(ok)], pa.string())
                scores = pa.array([float(share[i]) if x else 0.0 for i, x in enumerate(ok)], pa.float64())
                yield pa.RecordBatch.from_arrays([*held.columns(part), langs, scores], [*held.names, "lang_pred", "score"])

    out = held.rows.mapInArrow(run, held.with_columns("lang_pred string", "score double"))
    return held.back(out, "lang_pred", "score")
