from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import catalog, reply_catalog  # noqa: F401 (the second adds its queries to the first)
from quire.functions import text as T
from quire.functions import protocol
from quire.operators import glossary, integrity, panel, probe, runs, state, terms
from quire.plans import batching, blocks, numbering
from quire.streaming import resume


def sizes(spark, lengths, **limits):
    rows = spark.createDataFrame([("b", i, "x" * n) for i, n in enumerate(lengths)], "book string, ord int, text string").repartition(3)
    out = batching.plan_batches(rows, "book", "ord", "text", **limits).orderBy("ord").collect()
    return [r.batch_id for r in out]


def test_batches(spark):
    assert sizes(spark, [5, 5], max_chars=16, separator=6) == [0, 0]  # exact fit
    assert sizes(spark, [5, 6], max_chars=16, separator=6) == [0, 1]  # the separator pushes over
    assert sizes(spark, [3, 50, 3], max_chars=10, separator=0) == [0, 1, 2]  # oversized alone
    assert sizes(spark, [10], max_chars=10, separator=6) == [0]
    many = sizes(spark, [1 + i % 3 for i in range(919)])
    assert [many.count(b) for b in range(5)] == [200, 200, 200, 200, 119]
    assert sizes(spark, []) == []
    with pytest.raises(ValueError, match="positive"):
        sizes(spark, [1], max_chars=0)


def packed(lengths, limit, separator, most):
    """Batch numbers one row after the other."""
    out, chars, count, batch = [], 0, 0, 0
    for n in lengths:
        after = chars + (separator if count else 0) + n
        if count and (after > limit or (most is not None and count >= most)):
            batch, after, count = batch + 1, n, 0
        chars, count = after, count + 1
        out.append(batch)
    return out


@pytest.mark.parametrize(("most", "separator", "chunk"), [(25, 6, None), (25, 6, 40), (7, 0, 7), (None, 6, 64), (None, 0, 5)])
def test_batches_over_chunks(spark, most, separator, chunk):
    """Books of several chunks, batches of more rows than a chunk among them."""
    random.seed(most or 0)
    books = {"long": [random.choice([0, 1, 5, 30, 99, 101, 250]) for _ in range(900)], "tiny": [0] * 130, "one": [500], None: [random.randint(0, 40) for _ in range(200)], "whole": [1] * 160}
    rows = [(b, i, "x" * n) for b, sizes in books.items() for i, n in enumerate(sizes)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, place int, body string").repartition(5)
    got = batching.plan_batches(df, "name", "place", "body", 100, separator, most, chunk).collect()
    assert len(got) == len(rows)
    for b, sizes in books.items():
        own = sorted((r.ord, r.chars, r.batch_id) for r in got if r.book == b)
        assert own == [(i, n, k) for (i, n), k in zip(enumerate(sizes), packed(sizes, 100, separator, most))], b


def test_jumps():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        following = batching.successors(rng.integers(0, 30, n), 50, int(rng.integers(0, 3)), 6)
        end = int(rng.integers(1, n + 1))
        exits, steps = batching.jumps(following, end)
        for i in range(end):
            at, k = i, 0
            while at < end:
                at, k = int(following[at]), k + 1
            assert (at, k) == (exits[i], steps[i])


def test_beside_first(spark):
    rows = spark.range(0, 100, 1, 7).filter("id % 50 > 9 or id < 30")
    block = spark.createDataFrame([(["a", "b"],)], "words array<string>")
    parts = blocks.beside_first(rows, block).groupBy(F.spark_partition_id().alias("p")).agg(F.min_by("words", "id").alias("first"), F.count("words").alias("n"), F.min("id").alias("least"), F.collect_list("id").alias("ids")).collect()
    assert all(r.n == 1 and r.first == ["a", "b"] and r.ids == sorted(r.ids) for r in parts) and sum(len(r.ids) for r in parts) == rows.count()


def test_head_words(spark):
    rows = spark.createDataFrame([("b", 0, "x", 6), ("b", 1, "y", 5), ("b", 2, "z", 4)], "book string, ord int, head string, size long")
    assert [r.chunk_id for r in batching.head_word_chunks(rows, 10).orderBy("ord").collect()] == [0, 1, 1]
    with pytest.raises(Exception, match="lower the term limit"):
        batching.head_word_chunks(rows, 5).collect()


def test_probe(spark):
    rows = [("a", "x" * 30, ""), ("b", "x" * 30, "y" * 61), ("c", "x" * 19, "y" * 100), ("d", "x" * 40, "中" * 12), ("e", "x" * 40, "Proper Name -=!中"), ("f", "see www.a.b " + "x" * 40, "abc def ghi")]
    df = spark.createDataFrame(rows, "id string, source string, target string")
    got = {(r.id, r.check) for r in probe.sanity_warnings(df).collect()}
    assert got == {("a", "empty_output"), ("b", "length_ratio"), ("e", "cjk_density")}
    assert {r.check for r in probe.sanity_warnings(df, language="fr").collect()} == {"empty_output", "length_ratio"}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Ports and Adapters matter", {"Ports and Adapters", "Adapters"}),
        ("History of", {"History"}),
        ("The Shire and mud", {"Shire"}),
        ("Hexagonal Architecture, now", {"Hexagonal Architecture", "Architecture"}),
        (None, set()),
    ],
)
def test_phrases(text, found):
    assert terms.phrases_of(text) == found


def test_candidates(spark):
    blocks = spark.createDataFrame([("front", 1.5, "Frodo Frodo"), ("body", 1.0, "Frodo met Sam and Pippin")], "label string, weight double, text string")
    rows = {r.term: (r.frequency, r.weighted_score, r.kind, r.sources) for r in terms.rank_candidates(blocks, terms.phrases("text")).collect()}
    assert rows["Frodo"] == (2, 2.5, "entity", ["body", "front"])
    assert rows["Frodo Frodo"] == (1, 1.5, "technical", ["front"])
    assert rows["Sam and Pippin"] == (1, 1.0, "technical", ["body"])


def test_usage(spark):
    pairs = spark.createDataFrame([("The port is here", "端口在"), ("a port, b", "港口"), ("ports", "x"), ("PORT", "none")], "source string, target string")
    glossary = spark.createDataFrame([("port", "端口", ["港口"], None), ("absent", "无", None, None)], "term string, suggested_translation string, alternatives array<string>, tier string")
    rows = {r.term: r for r in terms.term_usage(pairs, glossary).collect()}
    assert (rows["port"].segments, rows["port"].option_counts, rows["port"].missing, rows["port"].consistent) == (3, {"港口": 1, "端口": 1}, 1, False)
    assert (rows["absent"].segments, rows["absent"].consistent) == (0, True)
    fixed = glossary.withColumn("tier", F.when(F.col("term") == "absent", "preferred"))
    assert {r.term: r.missing for r in terms.term_usage(pairs, fixed).collect()}["port"] == 2


ODD_LETTERS = ["s", "ſ", "S", "K", "\u212a", "k", "İ", "i", "ı", "I", "é", "É", "ß", "ẞ", "σ", "ς", "Σ", "_", "²", "1", "中", "+", "(", ".", "-", "\u0301", "\u00a0", "ŉ", "ǅ"]


@pytest.mark.parametrize("block_bytes", [None, 60])
def test_terms_by_every_pattern(spark, block_bytes):
    """The automaton's proposals lose nothing that a pattern finds, in any block."""
    random.seed(5)
    word = lambda: "".join(random.choices(ODD_LETTERS, k=random.randint(1, 2)))
    names = sorted({" ".join(word() for _ in range(random.randint(1, 2))) for _ in range(150)}) + ["", "  ", "c++", ".net"]
    texts = [(i, "".join(random.choice([word(), random.choice(names).upper(), random.choice(names)]) + random.choice([" ", "  ", "\n", ",", "", "-"]) for _ in range(random.randint(0, 12)))) for i in range(120)] + [(900, None), (901, "Uses C++ and .NET.")]
    docs, wanted = spark.createDataFrame(texts, "n int, body string").repartition(3), spark.createDataFrame([(t,) for t in names], "term string")
    every = docs.crossJoin(wanted.filter(F.col("term").rlike(r"(?U)\S")).withColumn("p", T.term_pattern(F.col("term")))).filter("body rlike p")
    want = {(r.n, r.term) for r in every.collect()}
    got = [(r.n, r.term) for r in terms.match_terms(docs, "body", wanted, block_bytes=block_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300 and {(901, "c++"), (901, ".net")} <= want


@pytest.mark.parametrize("block_bytes", [None, 40])
def test_sentences_by_every_pattern(spark, block_bytes):
    random.seed(6)
    words = ["port", "ports", "Port-and", "adapter", "adapters", "adaptive", "box", "boxes", "a/b", "ſet", "set", "x"]
    texts = [(i, " ".join(random.choice(words) + random.choice(["", "", ".", "-", "!"]) for _ in range(random.randint(0, 25)))) for i in range(60)] + [(99, None)]
    wanted = ["port and adapter", "box", "adapters (of any kind)", "set", "adapting porter", "nothing", "ports/box", "", "x"]
    docs, asked = spark.createDataFrame(texts, "n int, body string").repartition(3), spark.createDataFrame([(t,) for t in wanted], "term string")
    cut = docs.select("n", F.posexplode(T.sentences(F.col("body"))).alias("at", "s"))
    both = cut.crossJoin(asked.select("term", T.phrase_pattern(F.col("term")).alias("p"), T.stems(F.col("term")).alias("stems")))
    rows = both.select("term", "n", "at", "s", (F.expr("s rlike p") & (F.col("term") != "")).alias("exact"), ((F.size("stems") > 0) & F.forall("stems", lambda x: F.contains(F.lower("s"), x))).alias("loose")).collect()
    want = set()
    for t in wanted:
        hits = [r for r in rows if r.term == t and r.exact] or [r for r in rows if r.term == t and r.loose]
        seen, order = set(), []
        for r in sorted(hits, key=lambda r: (r.n, r["at"])):
            order.append((r.n in seen, r.n, r["at"], r.s))
            seen.add(r.n)
        want |= {(t, k + 1, x[3]) for k, x in enumerate(sorted(order)[:3])}
    got = terms.select_sentences(docs, "n", "body", asked, block_bytes=block_bytes).collect()
    assert {(r.term, r["rank"], r.sentence) for r in got} == want and len(got) == len(want) > 12


def test_a_hundred_thousand_terms(spark):
    names = spark.range(100_000).select(F.concat(F.lit("term"), F.col("id").cast("string"), F.lit(" of many")).alias("term"))
    docs = spark.createDataFrame([(i, f"a Term{i * 1000}  of many and term{i}x of many") for i in range(90)], "n int, body string")
    got = {(r.n, r.term) for r in terms.match_terms(docs, "body", names).collect()}
    assert got == {(i, f"term{i * 1000} of many") for i in range(90)}


def test_usage_report(spark):
    pairs = spark.createDataFrame([("a port", "端口"), ("port", "港口"), ("box box", "盒")], "source string, target string")
    entries = [("box", "盒", None, None, 2), ("port", "端口", ["港口"], "preferred", 1), ("port", "端口", ["港口"], "fixed", 0), ("gone", "无", None, None, 3)]
    usage = terms.term_usage(pairs, spark.createDataFrame(entries, "term string, suggested_translation string, alternatives array<string>, tier string, ord int"))
    got = json.loads(glossary.usage_report(usage).first().json)
    assert got["summary"] == {"terms": 4, "inconsistent": 1, "preferred_varied": 1}
    assert [(t["term"], t["tier"], t["option_counts"], t["missing"], t["consistent"]) for t in got["terms"]] == [
        ("port", "fixed", {"端口": 1}, 1, False),
        ("port", "preferred", {"端口": 1, "港口": 1}, 0, False),
        ("box", "fixed", {"盒": 1}, 0, True),
        ("gone", "fixed", {"无": 0}, 0, True),
    ]
    bare = terms.term_usage(pairs, spark.createDataFrame([("box", "盒/箱", None, None)], "term string, suggested_translation string, alternatives array<string>, tier string"))
    assert json.loads(glossary.usage_report(bare).first().json) == {"summary": {"terms": 1, "inconsistent": 0}, "terms": [{"term": "box", "translation": "盒/箱", "segments": 1, "option_counts": {"盒": 1, "箱": 0}, "missing": 0, "consistent": True}]}
    assert json.loads(glossary.usage_report(usage.limit(0)).first().json)["summary"] == {"terms": 0, "inconsistent": 0}


def test_longest_option_first(spark):
    row = spark.range(1).select(terms.consume(F.lit("abcab"), F.array(F.lit("ab"), F.lit("abc"), F.lit("zz"))))
    assert row.first()[0] == ["abc", "ab"]


def test_sentences(spark):
    docs = spark.createDataFrame([(0, "Ports-and adapters. A ports and adapter's. Port and adapter."), (1, "Nothing. Port  and\nadapters here.")], "n int, text string")
    wanted = spark.createDataFrame([("port and adapter",), ("ports and adapters",), ("adaptive",)], "term string")
    rows = [(r.term, r.rank, r.sentence) for r in terms.select_sentences(docs, "n", "text", wanted).orderBy("term", "rank").collect()]
    assert ("port and adapter", 1, "Port and adapter.") in rows
    assert ("port and adapter", 2, "Port and adapters here.") in rows
    assert [r for r in rows if r[0] == "ports and adapters"] == [("ports and adapters", 1, "Ports-and adapters.")]
    assert [r[2] for r in rows if r[0] == "adaptive"] == ["Ports-and adapters.", "Port and adapters here.", "A ports and adapter's."]


def vote(judge, order, id_, keep, text="t", enforce="fixed", dup=None):
    return (judge, order, id_, keep, text, enforce, dup)


VOTE = "judge string, judge_ord int, id long, keep boolean, translation string, enforce string, duplicate_of long"


def test_own_term_rule(spark):
    candidates = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    vendors = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "id long, vendor string")
    votes = spark.createDataFrame([vote("a", 0, 1, True), vote("b", 1, 1, False), vote("a", 0, 2, True), vote("b", 1, 2, False), vote("b", 1, 3, True)], VOTE)
    got = {r.id: (r.keeps, r.drops, r.kept) for r in panel.tallies(candidates, vendors, votes).collect()}
    assert got == {1: (0, 1, False), 2: (1, 1, True), 3: (0, 0, True)}


def test_choice_tiers_and_ties(spark):
    kept = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    proposed = spark.createDataFrame([(1, "n", 0, 0, "x"), (2, "n", 0, 0, "q"), (3, "n", 0, 0, "z"), (3, "m", 1, 0, "w")], "id long, vendor string, vendor_ord int, prop_ord int, translation string")
    votes = spark.createDataFrame([vote("a", 0, 1, True, "x"), vote("b", 1, 1, True, "x"), vote("a", 0, 2, True, "r"), vote("b", 1, 2, True, "s", "preferred")], VOTE)
    judges = spark.createDataFrame([("a", 0), ("b", 1)], "judge string, judge_ord int")
    ties = spark.createDataFrame([("b", 1), ("a", 2)], "judge string, tie_rank int")
    got = {r.id: (r.translation, r.sources, r.tier, r.alternatives) for r in panel.choose(kept, proposed, votes, judges, ties).collect()}
    assert got == {1: ("x", 3, "fixed", []), 2: ("s", 1, "preferred", ["r", "q"]), 3: ("z", 1, "preferred", ["w"])}


def test_chains_and_cycles(spark):
    votes = spark.createDataFrame([vote("a", 0, i, True, dup=d) for i, d in ((2, 3), (3, 1), (4, 5), (5, 4), (6, 4), (7, 99))], VOTE)
    candidates = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    direct = panel.duplicate_targets(candidates, votes, 2)
    assert {(r.id, r.target) for r in panel.resolve_chains(direct).collect()} == {(2, 1), (3, 1)}


def test_long_chains(spark):
    edges = [(i, i - 1) for i in range(1, 301)] + [(1000, 1001), (1001, 1002), (1002, 1000)] + [(i, i - 1) for i in range(1003, 1200)] + [(2000, 2000)]
    direct = spark.createDataFrame(edges, "id long, target long")
    assert sorted((r.id, r.target) for r in panel.resolve_chains(direct).collect()) == [(i, 0) for i in range(1, 301)]
    assert panel.resolve_chains(direct.filter("id > 900")).count() == 0
    assert panel.resolve_chains(direct.filter("id < 0")).count() == 0


def test_bias_needs_ten_votes(spark):
    vendors = spark.createDataFrame([(i, "a") for i in range(10)] + [(i, "b") for i in range(10, 15)], "id long, vendor string")
    votes = spark.createDataFrame([vote("a", 0, i, i < 9) for i in range(15)] + [vote("b", 1, i, True) for i in range(15)], VOTE)
    judges = spark.createDataFrame([("b", 0), ("a", 1)], "judge string, judge_ord int")
    bias = panel.self_preference(vendors.select("id"), vendors, votes, judges)
    assert {r.judge: r.bias for r in bias.collect()} == {"a": 0.9, "b": None}
    assert {r.judge: r.tie_rank for r in panel.tie_break_order(bias).collect()} == {"a": 1, "b": 2}


@pytest.mark.parametrize(
    ("item", "error"),
    [
        ({"id": 1, "keep": True, "translation": " t ", "enforce": "fixed", "duplicate_of": None}, None),
        ({"id": 1, "keep": True, "translation": "t", "enforce": "fixed"}, None),
        ({"id": 1, "keep": 1, "translation": "t", "enforce": "fixed"}, "vote is not valid"),
        ({"id": True, "keep": True, "translation": "t", "enforce": "fixed"}, "item has no integer id"),
        ({"id": "1", "keep": True, "translation": "t", "enforce": "fixed"}, "item has no integer id"),
        ({"id": 1, "keep": True, "translation": " ", "enforce": "fixed"}, "vote is not valid"),
        ({"id": 1, "keep": True, "translation": "t", "enforce": "no"}, "vote is not valid"),
        ({"id": 1, "keep": True, "translation": "t", "enforce": "fixed", "duplicate_of": 1}, "vote is not valid"),
        ({"id": 9, "keep": 7}, None),
        (3, "item is not an object"),
    ],
)
def test_parse_votes(spark, item, error):
    df = spark.createDataFrame([(json.dumps([item]), [1, 2])], "reply string, ids array<long>")
    row = panel.parse_votes(df).first()
    assert row.error == error
    if error is None:
        assert [v.translation for v in row.votes] == (["t"] if item["id"] == 1 else [])


def test_parse_refuses_other_shapes(spark):
    df = spark.createDataFrame([("nope", [1]), ('{"id": 1}', [1]), ("```json\n[]\n```", [1])], "reply string, ids array<long>")
    assert [r.error for r in panel.parse_votes(df).collect()] == ["not JSON", "not an array", None]


def test_links(spark):
    docs = spark.createDataFrame([("t/a.html", '<a href="b.html#x"/><a href="#top"/><a href="b.html#no"/><a href="http://c#d"/><a href="b.html#"/><p data-id="top">'), ("t/b.html", '<p id="x">')], "doc_path string, html string")
    assert [tuple(r) for r in integrity.broken_fragments(docs).collect()] == [("t/a.html", "b.html#no")]
    package = spark.createDataFrame([("b", "cover.png", "nope")], "book_id string, cover_item_id string, toc_item_id string")
    manifest = spark.createDataFrame([("b", "c", "cover.png")], "book_id string, id string, href string")
    spine = spark.createDataFrame([("b", "c"), ("b", "d")], "book_id string, idref string")
    assert sorted(r.error for r in integrity.package_errors(package, manifest, spine).collect()) == ["spine item not in manifest: d", "toc not in manifest: nope"]


def test_retry_splits_and_keeps_order(spark):
    def provider(texts):
        if len(texts) > 2:
            raise resume.SplitError
        return [t.upper() for t in texts]

    assert resume.call(provider, list("abcde")) == list("ABCDE")

    def limited(texts):
        raise resume.RateLimited

    with pytest.raises(resume.RateLimited):
        resume.call(limited, ["a", "b"])
    rows = spark.createDataFrame([("b", i // 7, i, f"s{i}") for i in range(100)], "book string, batch_id long, ord int, text string")
    out = resume.translate(rows, provider).collect()
    assert {r.ord: r.translated for r in out} == {i: f"S{i}" for i in range(100)}


def test_stream_resumes(spark, tmp_path):
    src, st, cp = (str(tmp_path / x) for x in ("src", "state", "cp"))
    work = lambda rows: rows.withColumn("translated", F.upper("text"))
    schema = "id int, text string"
    for start in (0, 5, 5):
        spark.createDataFrame([(i, f"t{i}") for i in range(start, start + 8)], schema).write.mode("append").parquet(src)
        resume.resume_stream(spark.readStream.schema(schema).parquet(src), st, cp, "id", work).awaitTermination()
    rows = spark.read.parquet(st)
    assert rows.count() == 13  # nothing is translated twice
    assert resume.latest(rows, "id").filter("translated = upper(text)").count() == 13


def test_state(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, v string, version int")
    assert {(r.id, r.v) for r in state.upsert(old, new, "id", "version").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    random.seed(0)
    rows = spark.createDataFrame([("g", i) for i in range(7)], "g string, i int")
    assert [r.i for r in state.head_middle_tail(rows, "g", "i").orderBy("i").collect()] == [0, 3, 6]


def test_sample_places(spark):
    rows = spark.createDataFrame([("g", i) for i in range(100)] + [("small", 1), (None, 5)], "g string, i int")
    for n, want in ((1, [0]), (2, [0, 50]), (3, [0, 50, 99]), (5, [0, 50, 60, 80, 99]), (7, [0, 42, 50, 57, 71, 85, 99])):
        got = state.head_middle_tail(rows, "g", "i", n).collect()
        assert sorted(r.i for r in got if r.g == "g") == want
        assert [r.i for r in got if r.g != "g"] in ([1, 5], [5, 1])
    short = [r.i for r in state.head_middle_tail(rows.filter("i < 4 and g = 'g'"), "g", "i", 3).collect()]
    assert sorted(short) == [0, 2, 3]


def test_warning_details(spark):
    rows = spark.createDataFrame([(1, "x" * 40, "x"), (2, "a" * 40, " "), (3, "b" * 40, "y" * 40)], "id int, source string, target string")
    got = {(r.id, r.check): r.detail for r in probe.sanity_warnings(rows).collect()}
    assert got[1, "length_ratio"] == "length_ratio=0.03 not in [0.15, 2.0]" and got[2, "empty_output"] == "translation is empty"
    assert got[3, "cjk_density"] == "cjk_density=0.00 < 0.3"


def test_numbering(spark):
    random.seed(1)
    rows = [(random.choice(["big"] * 8 + ["x", None]), random.randint(0, 10_000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(7)
    got = numbering.numbered(df, ["o", "i"], ["g"]).collect()
    assert len(got) == len(rows)
    for g in ("big", "x", None):
        want = sorted((o, i) for h, o, i in rows if h == g)
        assert [(r.o, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r["at"])] == want
        assert sorted(r["at"] for r in got if r.g == g) == list(range(1, len(want) + 1)) and {r["of"] for r in got if r.g == g} == {len(want)}
    every = numbering.numbered(df, [F.desc("o"), "i"]).collect()
    assert [(-r.o, r.i) for r in sorted(every, key=lambda r: r["at"])] == sorted((-o, i) for _, o, i in rows)
    assert numbering.numbered(df.limit(0), ["o"], ["g"]).count() == 0


def test_probe_replies(spark):
    rows = [("", "a"), (None, "a"), (" \u00a0", "a"), ("a ", "a"), ("```x", "a"), ("中 file://x", "a"), ("ok", "a"), ("中文", "a"), ("中", "中")]
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "n int, reply string, source string").coalesce(1)
    got = [[p.removeprefix(f"segment {r.n} ") for p in r.p] for r in df.select("n", probe.output_problems(F.col("reply"), F.col("source"), F.col("n")).alias("p")).collect()]
    fence, other = "contains a fence or artifact link", "not translated into Chinese"
    assert got == [["empty"], ["empty"], ["empty"], [], [fence], [fence], [], [], []]
    got = [[p.removeprefix("segment 1 ") for p in r[0]] for r in df.select(probe.output_problems(F.col("reply"), F.col("source"), expect_chinese=True)).collect()]
    assert got == [["empty"], ["empty"], ["empty"], [other], [other, fence], [fence], [other], [], [other]]


def test_vendors(spark):
    models = spark.createDataFrame([("gpt-5", 1), ("gpt-5", 2), ("gemini-x", 3), ("other", 4), (None, 5)], "model string, n int")
    prefixes = spark.createDataFrame([("g", "any", 2), ("gpt-", "one", 1), ("gpt-5", "late", 3)], "prefix string, vendor string, ord int")
    got = {(r.n, r.vendor) for r in runs.vendors_of(models, prefixes).collect()}
    assert got == {(1, "one"), (2, "one"), (3, "any"), (4, None), (5, None)}
    with pytest.raises(Exception, match="no vendor is known for model other"):
        runs.vendors_of(models.filter("n = 4"), prefixes, strict=True).collect()
    presets = spark.createDataFrame([("fast", "gpt-5"), ("slow", "gemini-x")], "preset string, model string")
    asked = spark.createDataFrame([("fast",), ("gone",)], "preset string")
    assert {tuple(r) for r in runs.presets_with_vendors(presets, prefixes, asked).collect()} == {("fast", "gpt-5", "one", None), ("gone", None, None, "unknown preset: gone")}


def test_names(spark):
    pairs = [("é.epub", "e\u0301.EPUB", True), ("Straße.epub", "STRASSE.epub", True), ("a.epub", "b.epub", False), ("ﬁ.epub", "FI.epub", True), ("①.epub", "1.epub", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r.got == r.same for r in rows.select("same", protocol.same_name(F.col("a"), F.col("b")).alias("got")).collect())
    given = [("x", "x.epub", None), ("a\u200b.epub", None, "not a plain file name"), ("a\u3000b.epub", None, "not a plain file name"), ("a b.epub", "a b.epub", None), ("é" * 130, None, "too long"), ("STRASSE.epub", None, "is the uploaded file")]
    rows = spark.createDataFrame([g[0] for g in given], "string").coalesce(1)
    assert [(r.o.name, r.o.error) for r in rows.select(protocol.output_name(F.col("value"), F.lit("straße.epub")).alias("o")).collect()] == [g[1:] for g in given]


def test_warnings_are_replaced_by_segment(spark):
    old = spark.createDataFrame([("s1", "length_ratio"), ("s2", "empty_output")], "id string, check string")
    new = spark.createDataFrame([("s1", "cjk_density")], "id string, check string")
    probed = spark.createDataFrame([("s1",), ("s3",), ("s1",)], "id string")
    assert sorted(map(tuple, probe.replace_warnings(old, new, probed, "id").collect())) == [("s1", "cjk_density"), ("s2", "empty_output")]


def test_negative_constraints(spark):
    cases = [([" not B ", "other"], ["A", "B"], "other"), (["not A"], ["A"], ""), ([], ["A"], ""), (["  ", "keep"], ["", "A"], "keep")]
    df = spark.createDataFrame(cases, "c array<string>, allowed array<string>, want string")
    assert all(r[0] == r.want for r in df.select(panel.negative_constraint(F.col("c"), F.col("allowed")), "want").collect())


def test_slashes_flag_choices(spark):
    df = spark.createDataFrame([("甲/乙",), ("甲／乙",), ("甲乙",)], "t string")
    assert [r[0] for r in df.select(T.offers_choice(F.col("t"))).collect()] == [True, True, False]


def test_judge_prompts(spark):
    """The candidates are JSON with an indent of one, as a plain writer gives it."""
    candidates = spark.createDataFrame([(0, 2, 'a "b"'), (0, 1, "é\\n"), (1, 3, "x")], "chunk int, id long, term string")
    proposals = spark.createDataFrame([(1, 1, "B", "t2", None, "r"), (1, 0, "A", "t\n1", "high", "")], "id long, ord int, letter string, translation string, priority string, reason string")
    sentences = spark.createDataFrame([(2, 2, "two"), (2, 1, "one\t")], "id long, rank int, sentence string")
    got = {r.chunk: r.prompt for r in panel.judge_prompts(candidates, proposals, sentences, F.lit("{count} by {letters}"), F.lit(None).cast("string"), F.lit("i")).collect()}
    payload = [
        {"id": 1, "term": "é\\n", "proposals": [{"list": "A", "translation": "t\n1", "priority": "high", "reason": ""}, {"list": "B", "translation": "t2", "priority": None, "reason": "r"}], "sentences": []},
        {"id": 2, "term": 'a "b"', "proposals": [], "sentences": ["one\t", "two"]},
    ]
    assert got[0] == f"2 by A, B\nCANDIDATES:\n{json.dumps(payload, ensure_ascii=False, indent=1)}\n\nTABLE OF CONTENTS:\n(none)\n\nINDEX:\ni\n"
    assert got[1].startswith("1 by \nCANDIDATES:\n")


def test_contracts_of_batches(spark):
    row = spark.range(1).select(protocol.with_contract(F.lit("p"), F.lit(1), True).alias("one"), protocol.with_contract(F.lit("p"), F.lit(2), True).alias("tagged"), protocol.with_contract(F.lit("p"), F.lit(3), False).alias("plain")).first()
    assert row.one == "p" and row.tagged.startswith("p\n\n[STRICT OUTPUT CONTRACT]\n") and row.plain.endswith("sections as the input.")


def test_pairs_counted_as_terms_are_found(spark):
    """Counted pairs against the automaton, in one pass of the texts whatever the list."""
    texts = spark.createDataFrame([(1, "One  two\tthree, four"), (2, "one two ONE TWO"), (3, "one two one-two one, two"), (4, "Été one"), (5, None), (6, ""), (7, "xone two two")], "id int, text string")
    pairs = spark.createDataFrame([("one two",), ("two three",), ("three four",), ("two one",), ("été one",), ("never met",), ("two two",)], "term string")
    got = {tuple(r) for r in terms.count_pairs(texts, "text", pairs).collect()}
    found = terms.match_terms(texts, "text", pairs, keep_=["id"]).groupBy("term").agg(F.countDistinct("id")).collect()
    assert got == {("one two", 3), ("two three", 1), ("two one", 2), ("été one", 1), ("two two", 1)}
    assert got == {tuple(r) for r in found}
    assert {r.term for r in texts.select(F.explode(terms.word_pairs(F.col("text"))).alias("term")).collect()} == {"one two", "two three", "two one", "été one", "xone two", "two two"}


def test_elected_at_once(spark):
    """One shuffle by id for tallies and choice; the rows of both in turn."""
    random.seed(9)
    vendors = [(i, f"v{v}", v, o, random.choice(["t0", "t1", None])) for i in range(60) for v in range(3) for o in range(random.randint(0, 2))]
    votes = [(i, f"v{j}", j, random.random() < 0.6, random.choice(["t0", "t1", "t2"]), random.choice(["fixed", "fixed", "preferred"])) for i in range(64) for j in range(2) if random.random() < 0.8]
    candidates, judges = spark.range(2, 66), spark.createDataFrame([("v0", 0), ("v1", 1)], "judge string, judge_ord int")
    proposed = spark.createDataFrame(vendors, "id long, vendor string, vendor_ord int, prop_ord int, translation string")
    cast = spark.createDataFrame(votes, "id long, judge string, judge_ord int, keep boolean, translation string, enforce string")
    ties = spark.createDataFrame([("v0", 2), ("v1", 1)], "judge string, tie_rank int")
    out = panel.elect(candidates, proposed, cast, judges, ties)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id#") == 1 and "SortMergeJoin" not in plan
    kept = panel.tallies(candidates, proposed, cast).filter("kept")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, panel.choose(kept, proposed, cast, judges, ties).collect())) and out.count() > 20


@pytest.mark.parametrize("name", ["vote_winner", "vote_tier"])
def test_votes_are_shuffled_by_id_twice_at_most(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 1 <= plan.count("Exchange hashpartitioning(id#") <= 2


def test_a_panel_is_decided_once(spark):
    optimized = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in optimized("panel_summary")  # what was decided is read back
    assert optimized("panel_decisions").count("Join") <= 10


@pytest.mark.parametrize("name", ["tag_lines", "stub_translate_batches"])
def test_texts_reach_python_in_batches_of_bounded_bytes(spark, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 1 << 28)
        catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) <= 1 << 23
    finally:
        spark.conf.set(key, before)


def test_merged_terms_are_dealt_out_and_never_sent_whole(spark):
    plan = catalog.QUERIES["panel_decisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [id#" not in plan


def test_votes_are_taken_apart_in_one_pass(spark):
    """A field is looked up once; of its kinds, only that of the field itself is worked out."""
    df = spark.createDataFrame([("[]", [1])], "reply string, ids array<long>")
    plan = panel.parse_votes(df)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("variant_get(") <= 6


@pytest.mark.parametrize(("reply", "error"), [("null", "not an array"), ("[null]", "item is not an object"), ("[{}]", "item has no integer id"), ('[{"id": 1.5}]', "item has no integer id"), ('[{"id": 1, "keep": true, "translation": "t", "enforce": "fixed", "duplicate_of": "2"}]', "vote is not valid"), ('[{"id": 1, "keep": true, "translation": 5, "enforce": "fixed"}]', "vote is not valid")])
def test_votes_of_odd_shapes(spark, reply, error):
    assert panel.parse_votes(spark.createDataFrame([(reply, [1])], "reply string, ids array<long>")).first().error == error
