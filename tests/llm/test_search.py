"""Operators on vectors and ranked search, against brute force."""

from __future__ import annotations

import glob
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm import _base, catalog, hard_negatives, neighbours, ranked_search, vectors

NAN, INF = float("nan"), float("inf")
#: Vectors that take no part anywhere, and names that operators use inside.
ODD = [None, [1.0, None], [NAN, 1.0], [INF, 0.0], [-INF]]
CLASHES = ("key", "i", "j", "vec", "id", "ASKED", "rank", "score", "buckets", "p_id", "label_")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for name in CLASHES if extra else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def low(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rank_of(i):
    return (i is not None, i or 0)


# ---------------------------------------------------------------- hard negatives


def mined(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    """rows: (id, vector, label); anchors have ids divisible by 10."""
    held = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if y is not None and whole(v)]
    out = []
    for i, v, y in held:
        if i is None or i % 10:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), rank_of(j), j, z) for j, w, z in held if j != i), key=lambda x: x[:2])
        for s, _, p, z in [x for x in scored if x[3] == y][:positives]:
            fit = [x for x in scored if x[3] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, p, k + 1, x[2], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("values", [None, 40])
def test_hard_negatives(spark, values):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(1).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.25, 0.0], i % 3) for i in range(40)]  # ties of one common vector
    rows += [(300 + i, v, 1) for i, v in enumerate(ODD)] + [(310, [1.0, 1.0], None), (None, [0.5, 0.5, 0.5, 0.5], 0), (None, None, None), (320, [], 1), (330, [1.0], 2), (340, [1.0, 0.5, 0.5, 0.0, 2.0], 0), (350, [0.0] * 4, 7)]
    rows.append(rows[3])  # a repeated row
    out = hard_negatives.mine(frame(spark, rows, extra=True), F.col("vec_id") % 10 == 0, values=values)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == mined(rows) and len(got) > 100


def test_hard_negatives_of_other_limits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), i % 2) for i in range(60)]
    out = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=7, low=-50, high=120, scale=1000)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == mined(rows, 2, 7, -50, 120, 1000)


def test_hard_negatives_of_repeated_anchors_and_nothing(spark):
    rows = [(10, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [0.9, 0.1], 0), (12, [0.8, 0.0], 1)]
    got = [tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()]
    assert got == [(10, 11, 1, 12, 256 * 230, 256 * 204)] * 2
    for none in ([], [(1, [1.0], 0)], [(10, [1.0], 0), (20, [1.0], 1)]):
        assert hard_negatives.mine(frame(spark, none), F.col("vec_id") % 10 == 0).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for most in (100, 2**20, 2**28):  # the last past what doubles hold
        a, b = (rng.integers(-most, most, (5, 9)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert hard_negatives.products(a, b).tolist() == want


# ---------------------------------------------------------------- nearest neighbours


def nearest(rows, k=10, every=10):
    held = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if whole(v) and any(v)]
    out = {}
    for i, v in held:
        if i is not None and i % every == 0:
            pad = lambda w: np.pad(w, (0, max(0, len(v) - len(w)))) - np.pad(v, (0, max(0, len(w) - len(v))))
            out[i] = sorted(((float(np.sqrt((pad(w) ** 2).sum())), rank_of(j), j) for j, w in held if j != i), key=lambda x: x[:2])[:k]
    return out


def recall(got, rows, k=10, every=10):
    want = nearest(rows, k, every)
    exact = {(i, w[2]): w[0] for i, found in want.items() for w in found}
    found = {(r.query_id, r.vec_id) for r in got}
    for r in got:
        if (r.query_id, r.vec_id) in exact:
            assert math.isclose(r.score, exact[r.query_id, r.vec_id], rel_tol=1e-12)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    for i, own in by.items():
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and i not in [r.vec_id for r in own]
        assert [(r.score, rank_of(r.vec_id)) for r in own] == sorted((r.score, rank_of(r.vec_id)) for r in own)
    return len(found & set(exact)) / max(1, len(exact))


@pytest.mark.parametrize("values", [None, 500])
def test_neighbours(spark, values):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12))
    rows = [(i, (centres[i % 20] + rng.normal(size=12) * rng.choice([0.01, 0.5])).tolist(), 0) for i in range(800)]
    rows += [(2000 + i, centres[0].tolist(), 0) for i in range(100)]  # one common vector
    rows += [(3000 + i, v, 0) for i, v in enumerate(ODD)] + [(3010, [0.0, 0.0], 0), (3020, [], 0), (None, centres[1].tolist(), 0), (3030, [1.0], 0), (3040, [1.0] * 15, 0)]
    got = neighbours.search(frame(spark, rows, extra=True), F.col("vec_id") % 10 == 0, values=values).collect()
    assert recall(got, rows) >= 0.97
    assert {r.query_id for r in got} == set(nearest(rows))
    common = [r for r in got if r.query_id == 2050]
    assert [(r.vec_id, r.score) for r in common] == [(2000 + i, 0.0) for i in range(10)]  # ties by id


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours_recall_on_tables(spark, sf):
    docs = catalog.table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    got = catalog.op12_nearest_neighbours(spark, f"/root/testdata/{sf}").collect()
    assert recall(got, rows, every=100) >= 0.9 and len(got) == 10 * sum(i % 100 == 0 for i, _ in rows)


def test_neighbours_beyond_the_probes_and_the_sample(spark, monkeypatch):
    """Too few probes for the recall asked: blocks are measured whole, so results are exact."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(300)]
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 30)
    got = neighbours.search(frame(spark, rows), F.col("vec_id") % 10 == 0, probes=2, recall=0.999).collect()
    assert recall(got, rows) == 1.0
    few = [(10, [1.0, 2.0], 0), (11, [1.0, 2.5], 0), (10, [1.0, 2.0], 0)]
    assert sorted(tuple(r) for r in neighbours.search(frame(spark, few), F.col("vec_id") % 10 == 0).collect()) == [(10, 1, 11, 0.5)] * 2
    for none in ([], [(10, [0.0], 0)], [(10, [1.0], 0)]):
        assert neighbours.search(frame(spark, none), F.col("vec_id") % 10 == 0).count() == 0


def test_estimated_success():
    """Chances of perturbed buckets against how often a neighbour falls into those visited."""
    rng = np.random.default_rng(6)
    model = neighbours.Hashes(np.zeros((0, 24)), np.zeros(0, np.int64), 24, 10, width=2.5, tables=1, recall=0.3)
    met = 0
    for _ in range(400):
        x = rng.normal(size=24)
        way = rng.normal(size=24)
        near = x + way / np.linalg.norm(way)
        model.b = rng.random(model.codes)
        model.a = rng.normal(size=model.a.shape)
        met += int(model.buckets(model.places(near[None]))[0, 0] in model.probes_of(x, 1.0)[0])
    assert 0.22 < met / 400 < 0.42


def test_perturbations():
    sets = neighbours.perturbations(4, 81)
    assert len(sets) == len({tuple(s) for s in sets}) == 81  # 3 moves for each of 4 codes
    assert all(s[j] + s[7 - j] <= 1 for s in sets for j in range(4))
    assert not sets[0].any() and sets[1].tolist() == [1] + [0] * 7


def test_least_keeps_ties():
    rng = np.random.default_rng(7)
    for _ in range(50):
        v = rng.integers(0, 6, rng.integers(0, 40))
        assert vectors.least(v, 5).tolist() == sorted(range(len(v)), key=lambda i: (v[i], i))[:5]


# ---------------------------------------------------------------- ranked search

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked(docs, items, k=10):
    held = [(i, Counter(re.findall(WORD, low(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m, s = 100 - 90 + (90 * sum(c.values()) * n) // total, 0
            for t in set(re.findall(WORD, low(text))) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                s += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, rank_of(i), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def texts(spark, rows, name, extra=False):
    df = spark.createDataFrame(rows, f"{name} long, text string").repartition(3)
    for c in ("id", "text_", "terms", "q", "G", "rank", "score", "shard") if extra else ():
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("size,block", [(None, 1 << 16), (300, 5)])
def test_ranked_search(spark, monkeypatch, size, block):
    if size:
        monkeypatch.setattr(ranked_search, "SHARD_BYTES", size)
    random.seed(3)
    words = ["The", "a", "ÉTÉ", "été", "x1", "1", "rare", "😀", "naïve", "It's", "under_score", "tab\tbed", "ſ", "K"]
    text = lambda n: random.choice([" ", ", ", "\n"]).join(random.choices(words, weights=range(len(words), 0, -1), k=n))
    docs = [(i, text(random.randint(0, 40))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, " \n--"), (None, "rare naïve"), (None, None), (303, "word " * 60_000 + "rare"), docs[5], docs[5]]
    docs += [(400 + i, "tie of many") for i in range(30)]
    items = [(i, text(random.randint(0, 9))) for i in range(25)] + [(50, None), (None, "rare 😀"), (51, "tie TIE many"), (52, "unseen"), (53, "---"), (3, "another item of one id"), (3, "another item of one id")]
    out = ranked_search.search(texts(spark, docs, "doc_id", True), texts(spark, items, "item_id", True), block_terms=block)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == ranked(docs, items) and len(got) > 200


def test_ranked_search_of_nothing(spark):
    docs, items = texts(spark, [(1, "a b"), (2, None)], "doc_id"), texts(spark, [(1, "a")], "item_id")
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.filter("text is null"), items).count() == 0
    assert [tuple(r) for r in ranked_search.search(docs, items).collect()] == ranked([(1, "a b")], [(1, "a")])


def test_terms_across_shards(spark):
    """Lists of shards against counts of all texts, whatever the shards."""
    docs = catalog.table(spark, "/root/testdata/sf0.001", "documents")
    scratch = _base.Scratch(spark)
    held = ranked_search.index(docs, scratch)
    want = Counter(t for r in docs.collect() for t in set(re.findall(WORD, low(r.text))))
    got = {r.term: r.n for r in held.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("n")).collect()}
    assert got == dict(want)


def test_row_groups_of_the_index_hold_few_shards(spark, monkeypatch):
    """A row group is held whole by its writer and its reader."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 100)
    scratch = _base.Scratch(spark)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.lit(30)).alias("text")).coalesce(1)
    assert ranked_search.index(docs, scratch).count() == 60
    files = [pq.ParquetFile(f) for f in glob.glob(scratch.root.removeprefix("file://") + "/shards/*.parquet")]
    sizes = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(sizes) == 60 and max(sizes) <= 4


def test_slices_of_arrow_arrays():
    raw = pa.array(["skipped", "One two", None, "", "two"])[1:]
    terms, size = ranked_search.terms_of(*_base.utf8(raw), ranked_search.term_fold())
    assert terms.to_pylist() == ["one", "two", "two"] and size.tolist() == [2, 0, 0, 1]
