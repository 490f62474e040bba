from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import helpers as H  # noqa: E402

from quire.llm import _base, catalog, components, decontaminate, language_id, line_dedup, media, ngram_jaccard, pii, quality, sentencepiece_codec, suffix_dedup, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "word " * 20_000
#: Nulls, empty and long texts, ties and repeated rows.
EDGES = [(1, None), (2, ""), (3, "a"), (4, LONG), (5, "same text here, in full"), (6, "same text here, in full"), (6, "same text here, in full"), (None, "no id"), (None, None), (7, "\n\n"), (8, "😀 é\x00ß"), (9, "12345 67890")]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:  # names that the operators use inside
        for name in ("doc", "row", "Lines", "keep_", "c0", "ids", "text_", "id_", "host", "label"):
            df = df.withColumn(name, F.lit("x"))
    return df


# ---------------------------------------------------------------- PII

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_pii(spark):
    cards = "4111 1111 1111 1111 x 4111-1111-1111-1112 "
    rows = [*EDGES, (20, "é😀 a@b.c_x@d.e.f@g.h mail +44 (0)20 7946 0958 + +1-----2 +123"), (21, "1.2.3.4.5.6.7.8 0255.1.1.0001 300.1.1.1"), (22, cards * 400), (23, "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433"), (24, "ssn: 123-45-6789, 123-45-6789 alone"), (25, "9" * 5000)]
    got = {(r.doc_id, r.spans, r.base_sha256) for r in pii.run(frame(spark, rows, extra=True)).collect()}
    for i, t in rows:
        base = base_spans(t)
        digest = hashlib.sha256(",".join(base).encode()).hexdigest()
        assert any(g[0] == i and g[2] == digest and g[1].startswith(",".join(base)) for g in got), i
    spans = {g[0]: g[1] for g in got}
    assert spans[23] == "iban:5:32" and spans[24].startswith("ssn:5:16")
    assert pii.run(frame(spark, [])).count() == 0


def test_iban_before_capitals_and_numbers(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"
    tails = ["", " Please pay", " I paid", " 2024", " BIC COBADEFF", " AND 12 MORE WORDS IN CAPITALS", "A", "a", "é", ".", "  X"]
    rows = [(i, f"to 😀 {n}{t}") for i, (n, t) in enumerate((n, t) for n in (de, de.replace(" ", ""), gb, no) for t in tails)]
    rows += [(100, f"{de} {gb} {no} {de}"), (101, "DE89 3704 0044 0532 0130 01 Please"), (102, f"{gb} X " * 600), (103, "AB12 " * 5000)]
    got = {r.doc_id: r.spans for r in pii.run(frame(spark, rows)).collect()}
    for i, t in rows[: 4 * len(tails)]:
        n = (de, de.replace(" ", ""), gb, no)[i // len(tails)]
        glued = tails[i % len(tails)] in ("A", "a")
        found = [x for x in got[i].split(",") if x.startswith("iban")]
        assert found == ([] if glued else [f"iban:5:{5 + len(n)}"]), t
    at = [0, len(de) + 1, len(de) + len(gb) + 2, len(de) + len(gb) + len(no) + 3]
    assert [x for x in got[100].split(",") if x.startswith("iban")] == [f"iban:{a}:{a + len(n)}" for a, n in zip(at, (de, gb, no, de))]
    assert "iban" not in got[101] and got[102].count("iban") == 600 and "iban" not in got[103]


# ---------------------------------------------------------------- SentencePiece


def test_codec(spark):
    import sentencepiece

    model = catalog.tokenizer_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    random.seed(5)
    rows = EDGES + [(100 + i, "".join(random.choice([" ", "  ", "▁", "\n", "\t", "a", "the", "é", "😀", "\x00", "Word", ".", "1"]) for _ in range(random.randint(0, 60)))) for i in range(300)]
    df = frame(spark, rows, extra=True)
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in sentencepiece_codec.encode(df, model, decoded=True).collect()}
    assert got == {(i, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or "")) if t else "") for i, t in rows}
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, model), model)
    assert {(r.doc_id, r.decoded) for r in back.collect()} == {(i, d) for i, _, d in got}
    assert sentencepiece_codec.encode(frame(spark, []), model).count() == 0
    for entries, counted in ((0, 10), (3, 1), (40, 100)):  # tables that hold nothing, little, and are counted in parts
        got = {(r.doc_id, tuple(r.ids)) for r in sentencepiece_codec.encode(df, model, entries=entries, counted=counted).collect()}
        assert got == {(i, tuple(sp.encode(t or ""))) for i, t in rows}
    wide = frame(spark, [(1, "a b")]).withColumns({"IDS": F.lit("x"), "other": F.lit("y")})
    assert sentencepiece_codec.encode(wide, model, keep=["IDS", "other"]).columns == ["other", "ids"]
    assert sentencepiece_codec.encode(wide, model, keep=["IDS"]).first().ids == sp.encode("a b")


# ---------------------------------------------------------------- lines


@pytest.mark.parametrize("parts", [1, 7])
def test_lines(spark, parts):
    random.seed(parts)
    common = [f"  A Common line number {i}, long enough " for i in range(6)]
    rows = EDGES + [(100 + i, "\n".join(random.choice([*common, "short", f"own line {i} of this document", ""]) for _ in range(random.randint(0, 12)))) for i in range(150)]
    rows += [(None, common[0]), (100, common[1] + "\n" + common[2])]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = line_dedup.dedup(frame(spark, rows, extra=True))
        got = sorted(((r.doc_id, r.text, r.lines_.n_lines) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == sorted(((i, t, len((x or "").split("\n"))) for (i, t), (_, x) in zip(H.kept_lines(rows), rows)), key=repr)
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_lines_of_a_long_text(spark):
    """70,000 lines in 5 MB: time in proportion, where a hash of the text a line took minutes."""
    random.seed(11)
    lines = [f"line {i} of one very long text, " + "x" * random.randint(20, 60) for i in range(70_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[::1000])), (3, "\n".join(lines[::2000]))]
    docs = frame(spark, rows)
    began = time.time()
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup(docs).collect())
    assert time.time() - began < 40
    assert got == sorted(H.kept_lines(rows))


# ---------------------------------------------------------------- URLs


def test_urls(spark):
    urls = ["http://Sub.Example.NET/en/x?q", "http://a.net", "http://a.net/", "https://www.bad.example/p#f", "ftp://example.com/de/", "http://x.org/fr/1", "http://nonet/x", "no scheme", None, "http://", "://bad.example?x", "http://deep.www.bad.example:80/", "x://y.bad.example"] + [f"http://h{i}.example/" for i in range(400)]
    listed = ["bad.example", None, "", "BAD.example", "unseen.example"] + [f"h{i}.example" for i in range(0, 400, 9)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame([(x,) for x in listed], "h string")).collect()}
    assert got[0] == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("a.net", "", None, "allow")
    assert got[2] == ("a.net", "/", "net/", "block")
    assert got[3] == ("www.bad.example", "/p", None, "block")
    assert got[4] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2] is None
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("", "", None, "allow") and got[10][3] == "block" and got[12][3] == "block"
    assert got[11][3] == "allow"  # a port is part of the host
    names = {x for x in listed if x}
    assert all((got[13 + i][3] == "block") == (f"h{i}.example" in names) for i in range(400))
    none = spark.createDataFrame([], "h string")
    assert url_filter.judge(pages.limit(0), none).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.filter("page_id = 3"), none).collect()} == {"allow"}


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_urls_of_a_long_list(spark, monkeypatch, most):
    built, build = [], url_filter.build
    monkeypatch.setattr(url_filter, "build", lambda universe: built.append(build(universe)) or built[-1])
    monkeypatch.setattr(url_filter, "MAX_WORDS", most)
    hosts = [f"h{i}.site{i % 50}.{end}" for i in range(2500) for end in ("example", "com", "org")]
    listed = set(hosts[::3]) | {f"site{i}.com" for i in range(0, 50, 2)}
    pages = spark.createDataFrame([(i, f"http://www.{h}/p", "x", "y") for i, h in enumerate(hosts)], "page_id long, url string, listed_ string, Verdict string")
    pages = pages.unionByName(pages.filter("page_id = 7"))  # a repeated row, and names that the operator uses
    out = url_filter.judge(pages, spark.createDataFrame([(x,) for x in sorted(listed)], "h string"), rules=())
    got = out.collect()
    assert len(got) == len(hosts) + 1 and [c.lower() for c in out.columns] == ["page_id", "url", "listed_", "verdict", "host", "path", "rule"]
    assert all(r.listed_ == "x" for r in got)
    assert {r.page_id: r[3] for r in got} == {i: "block" if h in listed or h.split(".", 1)[1] in listed else "allow" for i, h in enumerate(hosts)}
    if most > 100:
        assert len(built) == 1 and len(built[0]) > 2 and len(built[0][0].words) > 256  # a cascade, whose first array is read from JSON
    else:
        assert len(built) == 4  # shards


# ---------------------------------------------------------------- n-gram Jaccard


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, k, percent):
    random.seed(k)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(random.choice(words) for _ in range(30))
    rows = list(EDGES)
    for _ in range(14):
        base = [random.choice(words) for _ in range(random.randint(2, 90))]
        for _ in range(random.choice([1, 2, 3, 25])):
            own = list(base)
            for _ in range(random.randint(0, 4)):
                own[random.randrange(len(own))] = random.choice(words)
            rows.append((100 + len(rows), " ".join(own) + random.choice(["", "", " " + passage])))
    out = ngram_jaccard.components(frame(spark, rows, extra=True), words=k, percent=percent)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr)
    want = [(i, n, i if not n else c) for (i, _), (n, c) in zip(rows, H.jaccard_components(rows, k, percent))]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_links(spark, monkeypatch, block):
    """Every link is counted, inside groups of near copies too, whose blocks meet in pairs."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "STRETCH", 7 if block == 3 else 4096)
    random.seed(block)
    words, rows = [f"w{i}" for i in range(500)], list(EDGES)
    for _ in range(8):
        base = random.choices(words, k=random.randint(8, 60))
        for _ in range(random.choice([1, 2, 30])):
            own = list(base)
            for _ in range(random.randint(0, 2)):
                own[random.randrange(len(own))] = random.choice(words)
            rows += [(100 + len(rows), " ".join(own))] * random.choice([1, 1, 2])
    sets = H.shingle_sets(rows, 3)
    n = [sum(bool(x & y) and 100 * len(x & y) >= 70 * len(x | y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    least = [min((i for (i, _), y in zip(rows, sets) if y == x and i is not None), default=None) if x else own for (own, _), x in zip(rows, sets)]
    out = ngram_jaccard.components(frame(spark, rows, extra=True), words=3, percent=70, links=True)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "class_id", "n_links"]
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out.collect()), key=repr) == sorted(((i, c, k) for (i, _), c, k in zip(rows, least, n)), key=repr)
    assert max(n) > 20


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(20)]
    assert ngram_jaccard.overlaps(sets[:12], sets[12:]).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[12:]] for a in sets[:12]]
    assert ngram_jaccard.overlaps([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_jaccard_of_nothing(spark):
    assert ngram_jaccard.components(frame(spark, [])).count() == 0
    assert ngram_jaccard.components(frame(spark, []), links=True).count() == 0
    assert [r.n_links for r in ngram_jaccard.components(frame(spark, [(1, "a b"), (2, None)]), links=True).collect()] == [0, 0]


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements share no n-gram, nor do words that differ far inside."""
    morse = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    rows = []
    for n in (64, 1024, 2048, 4096):
        rows += [(len(rows), morse[:n]), (len(rows) + 1, morse[:n].translate(str.maketrans("ab", "ba")))]
    rows += [(90, "x" * 500 + "a" + "x" * 500), (91, "x" * 500 + "b" + "x" * 500), (92, "x" * 501 + "a" + "x" * 499)]
    assert all(r.component_id == r.doc_id for r in ngram_jaccard.components(frame(spark, rows)).collect())


def test_parity_bounds_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((10, 12), (500, 400), (5000, 90), (1, 1)):
        a, b = (np.unique(rng.integers(0, 2**63, x, dtype=np.uint64)) for x in (n, m))
        b = np.unique(np.r_[b, a[: n // 2]])
        assert ngram_jaccard.differing(ngram_jaccard.parity(a), ngram_jaccard.parity(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 30)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components.components(df, _base.Scratch(spark), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90, **{200 + i: 200 for i in range(30)}}


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("block", [200_000, 120])
def test_decontamination(spark, block):
    random.seed(2)
    words = [f"w{i}" for i in range(60)] + ["É", "x1"]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(40)] + [(50, None), (None, "lonely marker phrase"), (3, "repeated id of another item")]
    docs = EDGES + [(100 + i, " ".join([random.choice([random.choice(items)[1] or "", random.choice(words)]) for _ in range(random.randint(0, 30))]).replace(" ", random.choice([" ", ", ", "\n-"])).upper()) for i in range(60)] + [(300, "LONELY marker--phrase")]
    out = decontaminate.find_hits(frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id long, text string"), block=block)
    got = sorted(((r["doc_id"], r["n_words"], r["n"], list(r["items"])) for r in out.withColumn("n", decontaminate.n_hit()).collect()), key=repr)
    assert got == sorted(H.hits(docs, items), key=repr)


def test_parts_of_a_long_item(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    items = [(1, " ".join(random.choices(words, k=700))), (2, "é, " * 400), (3, "--" * 500)]
    docs = [(i, " ".join(items[0][1].split()[i : i + random.choice([12, 13, 40])])) for i in range(0, 690, 3)] + [(900, "é é é " * 5)]
    out = decontaminate.find_hits(spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, items string, Hits string"), spark.createDataFrame(items, "item_id long, text string"), block=20, keep=["doc_id", "items", "Hits"])
    assert out.columns == ["doc_id", "n_words", "hits", "items"]
    got = sorted(((r["doc_id"], r["n_words"], r["n"], list(r["items"])) for r in out.withColumn("n", decontaminate.n_hit()).collect()), key=repr)
    assert got == sorted(H.hits(docs, items), key=repr)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_words for r in decontaminate.find_hits(frame(spark, [(1, "a b")]), bench).collect()] == [2]
    assert decontaminate.find_hits(frame(spark, []), bench).count() == 0


# ---------------------------------------------------------------- quality


def test_quality(spark):
    docs, labels = _base.table(spark, SF.replace("0.001", "0.01"), "documents"), _base.table(spark, SF.replace("0.001", "0.01"), "labels")
    learn = lambda i: catalog.crc_slot(i, 5) != 0
    model = quality.fit(quality.sample(docs, labels, learn), quality.share(labels, learn))
    scored = quality.score(docs, model).join(labels, "doc_id").filter(catalog.crc_slot("doc_id", 5) == 0).collect()
    good, bad = ([r.score for r in scored if r.quality == y] for y in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.85
    rate = len(good) / len(scored)
    brier = sum((r.score - r.quality) ** 2 for r in scored) / len(scored)
    assert brier < 0.5 * rate * (1 - rate)  # half of what the rate alone gives
    none = docs.limit(0)
    assert quality.sample(none, labels, learn) == [] and quality.sample(docs, labels.limit(0), learn) == [] and quality.share(labels.limit(0), learn) == 0.5
    edges = quality.score(frame(spark, EDGES, extra=True), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    assert {r.score for r in edges if r.doc_id in (1, 2)} == {quality.NEUTRAL}
    assert len({r.score for r in edges if r.doc_id in (5, 6)}) == 1
    assert quality.fit([("only", 1)]) is None
    assert {r.score for r in quality.score(frame(spark, EDGES), None).collect()} == {quality.NEUTRAL}
    assert quality.score(frame(spark, []), model).count() == 0


def test_dictionary_holds_whole_texts():
    random.seed(7)
    texts = ["".join(random.choices("abcdefgh é", k=random.choice([5, 9000]))) for _ in range(40)]
    assert quality.dictionary(texts) == "".join(texts).encode() and quality.dictionary([]) == b""
    # classes that differ in the last words of long texts only
    rows = [("".join(random.choices("abcdefgh ", k=4000)) + f" {w} {w} {w} {w}", y) for y, w in ((1, "excellent-reading"), (0, "worthless-clutter")) for _ in range(100)]
    model = quality.fit(rows)
    score = model.scorer()
    assert model.probability(score(b"an excellent-reading here")) > 0.5 > model.probability(score(b"an worthless-clutter here"))
    assert all(w in d and w not in e for w, d, e in ((b"excellent-reading", model.good, model.bad), (b"worthless-clutter", model.bad, model.good)))


def test_no_part_of_a_dictionary_is_lost():
    """4 MB a class in short texts: frames from anywhere in it shrink by it, and only by it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    text = {y: [" ".join(word() for _ in range(1400)) for _ in range(800)] for y in (0, 1)}  # 7.8 MB a class, half of it for the dictionaries
    model = quality.fit([(t, y) for i in range(800) for y, t in ((0, text[0][i]), (1, text[1][i]))])
    assert len(model.goods) == len(model.bads) == quality.DICTS and all(len(d) <= quality.DICT_BYTES for d in model.goods + model.bads)
    score = model.scorer()
    for y in (0, 1):
        used = b"".join(t.encode() for t in text[y][0::2])[: quality.DICTS * quality.DICT_BYTES]
        for part in range(40):
            frame_ = used[len(used) * part // 40 :][: quality.FRAME]
            raw = score(frame_)
            assert raw > 0.5 if y else raw < -0.5, (y, part, raw)
        assert abs(score(" ".join(word() for _ in range(300)).encode())) < 0.05


def test_bound_of_the_sample(spark, monkeypatch):
    """Whole texts up to a bound in bytes; the one that passes it is cut."""
    monkeypatch.setattr(quality, "DICT_BYTES", 500)
    rows = [(i, "é" * (700 if i % 7 else 9000) + str(i)) for i in range(60)] + [(90, None), (91, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(95)], "doc_id long, quality int")
    got = quality.sample(frame(spark, rows, extra=True), labels, lambda i: F.lit(True))
    most, texts = 2 * quality.DICTS * 500, {t: i for i, t in rows}
    for y in (0, 1):
        own = [t for t, x in got if x == y]
        sizes = [len(t.encode()) for t in own]
        assert sum(sizes[:-1]) < most and len(own) >= 1 and all(t in texts or len(t) == most for t in own)
    assert quality.fit(got) is None or sum(map(len, quality.fit(got).goods)) <= quality.DICTS * 500


def test_quality_by_plain_sizes(spark):
    """Scores from sizes that a plain compressor gives, and the class shares that they are calibrated to."""
    import zstandard as z

    random.seed(8)
    word = lambda y: random.choice(["clear", "fine", "prose"] if y else ["spam", "click", "buy"]) if random.random() < 0.3 else random.choice(["the", "of", "and", "x"])
    rows = [(" ".join(word(y) for _ in range(random.randint(1, 900))), y) for y in [0, 1] * 60]
    model = quality.fit(rows, 0.9)
    halves = {y: [t for t, x in rows if x == y][0::2] for y in (0, 1)}
    packs = {y: z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict("".join(halves[y]).encode(), dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for y in halves}
    texts = [t for t, _ in rows[:20]]
    got = {r.doc_id: r.score for r in quality.score(frame(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        size = {y: sum(len(p.compress(raw[j : j + 2048])) for j in range(0, len(raw), 2048)) for y, p in packs.items()}
        raw_score = (size[0] - size[1]) / len(raw)
        assert abs(model.scorer()(raw) - raw_score) < 0.02, i  # precomputed tables may compress a few bytes better
        near = [model.probability(raw_score + d) for d in (-0.02, 0.02)]
        assert near[0] - 1e-9 <= got[i] <= near[1] + 1e-9
    held = [t for y in (0, 1) for t in [t for t, x in rows if x == y][1::2]]
    mean = {y: sum(model.probability(model.scorer()(t.encode())) for t in held[y * 30 : y * 30 + 30]) / 30 for y in (0, 1)}
    assert abs(0.1 * mean[0] + 0.9 * mean[1] - 0.9) < 0.05


def test_rising_curve():
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-6 * np.where(x > 0, x, 0.2 * x)))).astype(float)
    raws, odds = quality.rising(x, y, np.full(400, 1 / 400))
    assert list(raws) == sorted(set(raws)) and list(odds) == sorted(odds)
    order = np.argsort(x)
    # pools by brute force: the largest of least means over all stretches
    best = [max(min(y[order][a : b + 1].mean() for b in range(i, 400)) for a in range(i + 1)) for i in range(0, 400, 37)]
    curve = 1 / (1 + np.exp(-np.array(odds)))
    assert all(np.abs(curve - min(max(b, 0.002), 0.998)).min() < 1e-9 for b in best)
    assert quality.rising(np.zeros(4), np.array([0.0, 1, 0, 1]), np.full(4, 0.25)) == ((0.0,), (0.0,))


# ---------------------------------------------------------------- media


def test_png_filters():
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 64 * 23, dtype=np.uint8).tobytes()
    for kinds in ([k] * 23 for k in range(5)):
        assert media.read_png(media.write_png(data, kinds=np.array(kinds, np.uint8))).tobytes() == data
    mixed = rng.integers(0, 5, 23).astype(np.uint8)
    png = media.write_png(data, kinds=mixed)
    assert media.read_png(png).tobytes() == data
    broken = bytearray(png)
    broken[60] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.read_png(bytes(broken))
    with pytest.raises(ValueError, match="truncated|checksum"):
        media.read_png(png[:-12])


def test_png_filters_at_work(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    ramp = np.cumsum(rng.integers(0, 3, (40, 64)), axis=1).astype(np.uint8)
    data = np.vstack([ramp, ramp[::-1], np.cumsum(ramp, axis=0).astype(np.uint8), rng.integers(0, 256, (40, 64), dtype=np.uint8)]).tobytes()
    monkeypatch.setattr(media, "LINES", 7)
    lines = media.inflated(media.write_png(data))
    assert set(lines[:, 0]) == {0, 1, 2, 3, 4} and media.unfiltered(lines).tobytes() == data
    # images of several heights, filtered and undone together as each by itself
    parts = [data[64 * a : 64 * b] for a, b in ((0, 1), (1, 90), (90, 91), (91, 160))]
    first = np.isin(np.arange(160), (0, 1, 90, 91))
    every = media.filtered(np.frombuffer(data, np.uint8).reshape(-1, 64), None, first)
    assert every.tobytes() == b"".join(media.inflated(media.write_png(p)).tobytes() for p in parts)
    assert media.unfiltered(every, first).tobytes() == data
    docs = _base.table(spark, SF, "documents").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    kinds = set()
    for r in media.to_media(docs).collect():
        assert bytes(r.payload) == media.payload((text[r.doc_id] or "").encode()) == media.read_png(bytes(r.media)).tobytes()
        kinds |= set(media.inflated(bytes(r.media))[:, 0])
    assert kinds >= {1, 2, 3, 4}


def test_media_by_a_plain_reader(spark):
    """Stored images and features against a decoder and a transform that share no code with the operator."""
    random.seed(12)
    texts = ["", "a", "é" * 40, "".join(random.choices("abc \n", k=3000)), "".join(map(chr, range(32, 2000))), "same " * 700]
    kinds = set()
    for r in media.to_media(frame(spark, [*enumerate(texts), (99, None)])).collect():
        raw = (texts[r.doc_id] if r.doc_id < 99 else "").encode()
        lines = H.plain_png(bytes(r.media))
        assert bytes(x for line in lines for x in line) == raw + bytes(-len(raw) % 64 if raw else 64) == bytes(r.payload)
        kinds |= set(media.inflated(bytes(r.media))[:, 0].tolist())
        bits, freq, middle = H.plain_hash(lines)
        got = f"{int(r.feature, 16):064b}"
        assert all(a == b or abs(f - middle) < 1e-4 for a, b, f in zip(got, bits, freq))
    assert len(kinds) > 2  # filters at work


def test_media(spark):
    rows = [*EDGES, (50, "x" * 64), (51, "x" * 65)]
    out = media.to_media(frame(spark, rows, extra=True)).collect()
    want = {(i, len((t or "").encode()), media.payload((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.n_bytes, bytes(r.payload)) for r in out} == want
    assert {len(r.payload) for r in out if r.doc_id in (1, 2, 50)} == {64} and {len(r.payload) for r in out if r.doc_id == 51} == {128}
    assert len({(r.feature, bytes(r.media)) for r in out if r.doc_id in (5, 6)}) == 1
    assert media.to_media(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- language


def test_language(spark):
    docs = _base.table(spark, SF.replace("0.001", "0.01"), "documents")
    model = language_id.fit(language_id.sample(docs, catalog.crc_slot("doc_id", 4) != 2))
    held = language_id.identify(docs.filter(catalog.crc_slot("doc_id", 4) == 2), model, keep=["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    edges = language_id.identify(frame(spark, EDGES, extra=True), model).collect()
    assert {r.lang_pred for r in edges if r.doc_id in (1, 2, 7, 9)} == {"und"}
    assert all(0 <= r.score <= 1 for r in edges) and len(edges) == len(EDGES)
    nothing = language_id.fit([])
    assert {r.lang_pred for r in language_id.identify(frame(spark, EDGES), nothing).collect()} == {"und"}
    assert language_id.identify(frame(spark, []), model).count() == 0


def test_kernel_by_brute_force():
    """The model's scores against kernel ridge regression on n-gram sets, with no slots x languages matrix."""
    random.seed(6)
    vocab = {"de": "der die das und nicht ist ein".split(), "en": "the and of that is a not".split(), "fr": "le la les et des un pas".split()}
    text = lambda lang: " ".join(random.choice(vocab[lang] + ["mixed", "words"]) for _ in range(random.randint(3, 40)))
    rows = [(text(lang), lang) for lang in vocab for _ in range(12)]
    slots = lambda t: set(language_id.presence(np.frombuffer(t.encode(), np.uint8)).tolist())
    model = language_id.fit([(np.array(sorted(slots(t))), lang) for t, lang in rows], landmarks=15)
    marks = [t for lang in vocab for t, x in rows if x == lang][0:5] + [t for t, x in rows if x == "en"][:5] + [t for t, x in rows if x == "fr"][:5]
    k = lambda a, b: len(slots(a) & slots(b)) / (len(slots(a)) * len(slots(b))) ** 0.5
    kmm = np.array([[k(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(kmm)
    half = vector / np.sqrt(value)  # landmarks are independent here
    x = np.array([[k(t, m) for m in marks] for t, _ in rows]) @ half
    y = np.array([[1.0 if lang == other else -1.0 for other in sorted(vocab)] for _, lang in rows])
    w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + language_id.RIDGE * len(rows) * np.eye(15), (x - x.mean(0)).T @ (y - y.mean(0)))
    new = [text(lang) for lang in vocab for _ in range(5)]
    want = (np.array([[k(t, m) for m in marks] for t in new]) @ half - x.mean(0)) @ w + y.mean(0)
    got = model.score([np.array(sorted(slots(t))) for t in new])
    assert np.allclose(got, want, atol=1e-4) and [model.languages[i] for i in got.argmax(axis=1)] == ["de"] * 5 + ["en"] * 5 + ["fr"] * 5


def test_language_learns_from_whole_texts(spark):
    """Languages that differ only after thousands of equal bytes, and a table without any."""
    rows = [(i, "same words here " * 600 + f"{w} {w}", lang, "x") for i in range(40) for w, lang in (("gleich", "de"), ("equal", "en"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fit(language_id.sample(docs, F.lit(True)))
    got = language_id.identify(docs, model, keep=["doc_id", "lang", "score"])
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"] and all(r.lang == r.lang_pred for r in got.collect())
    assert language_id.sample(docs.limit(0), F.lit(True)) == []


# ---------------------------------------------------------------- suffixes


@pytest.mark.parametrize("bucket_rows,counted", [(100_000, 1_000_000), (25, 40)])
def test_suffixes(spark, monkeypatch, bucket_rows, counted):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 40 * counted)  # buckets by size in the second case
    random.seed(3)
    text = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 150, 400)]
    rows = [(i, "".join(random.choice([text(random.randint(0, 130)), random.choice(shared), random.choice(shared)[30:]]) for _ in range(random.randint(0, 5)))) for i in range(110)]
    rows += [(200, None), (201, ""), (202, "ab" * 150), (203, "é" * 120), (204, shared[4]), (205, rows[3][1]), (206, "\0" * 130), (207, "x" + "\0" * 120), (None, shared[3])]
    df = frame(spark, rows, extra=True).unionByName(frame(spark, [(204, shared[4])], extra=True))  # a repeated row
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(df, bucket_rows=bucket_rows, counted=counted).collect()}
    assert got == set(H.repeats_removed(rows))


def test_hot_suffix_spans_buckets(spark):
    """One passage in every document, before and after it other text each time."""
    random.seed(4)
    text = lambda n: "".join(random.choice("abcd") for _ in range(n))
    common, rows = text(70), []
    for i in range(300):
        rows.append((i, text(20) + random.choice("xy") * 25 + common + random.choice("zw") * 25 + text(20)))
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(frame(spark, rows), bucket_rows=20, counted=100).collect()}
    assert got == set(H.repeats_removed(rows))


def test_multikey_quicksort():
    rng = np.random.default_rng(5)
    for spread in (2, 50, 1 << 60):
        words = rng.integers(0, spread, (3000, 4)).astype(np.uint64)
        for small in (1, 100, 5000):
            order = suffix_dedup.multikey_quicksort(words, small)
            assert words[order].tolist() == sorted(words.tolist()) and sorted(order.tolist()) == list(range(3000))


def test_suffixes_of_nothing(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- long texts


def test_texts_longer_than_a_pass(spark):
    """Texts of 1.4 MB, over one pass, by every operator that cuts texts into passes."""
    import sentencepiece

    random.seed(21)
    words = ["the", "über", "clear", "mail@host.example", "10.0.0.1", "prose\n", "été", *(f"w{i}" for i in range(3000))]
    long = " ".join(random.choices(words, k=260_000))
    assert len(long.encode()) > 1.2 * _base.PASS_BYTES
    near = long.replace("w77 ", "w78 ", 40)
    passage = " ".join(f"item{i}" for i in range(20))
    rows = [(1, long), (2, near), (3, "short one"), (4, long[:700_000] + f" {passage} " + long[700_000:])]
    docs = frame(spark, rows)

    assert {r.doc_id: r.spans for r in pii.run(docs.filter("doc_id = 1")).collect()}[1].startswith(",".join(base_spans(long)))
    sp = sentencepiece.SentencePieceProcessor(model_proto=catalog.tokenizer_model())
    assert {(r.doc_id, tuple(r.ids)) for r in sentencepiece_codec.encode(docs, catalog.tokenizer_model()).collect()} == {(i, tuple(sp.encode(t))) for i, t in rows}
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.components(docs, links=True).collect())
    assert got == [(i, n, c) for (i, _), (n, c) in zip(rows, H.jaccard_components(rows, 5, 80))] and got[1][2] == 1
    items = [(7, passage), (8, "absent words only")]
    out = decontaminate.find_hits(docs, spark.createDataFrame(items, "item_id long, text string")).withColumn("n", decontaminate.n_hit()).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n"], list(r["items"])) for r in out) == sorted(H.hits(rows, items))
    assert {(r.doc_id, bytes(r.payload)) for r in media.to_media(docs).collect()} == {(i, media.payload(t.encode())) for i, t in rows}
    assert {(r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs.filter("doc_id <> 2")).collect()} == {(i, n, s, k) for i, _, n, s, k in H.repeats_removed([r for r in rows if r[0] != 2])}
    model = quality.fit([("clear prose " * 30, 1), ("spam " * 30, 0)] * 4)
    score = model.scorer()
    assert all(abs(r.score - model.probability(score(dict(rows)[r.doc_id].encode()))) < 1e-12 for r in quality.score(docs, model).collect())
    tongue = language_id.fit([(np.array(sorted(set(language_id.presence(np.frombuffer(t.encode(), np.uint8)).tolist()))), lang) for t, lang in (("the clear prose of an end", "en"), ("über die Prosa", "de"))])
    assert {r.lang_pred for r in language_id.identify(docs, tongue).collect()} <= {"en", "de"}


def test_bound_of_all_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} here", f"l{i % 40}") for i in range(800)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "TOTAL", 80)
    got = language_id.sample(docs, F.lit(True))
    assert {lang for _, lang in got} == {f"l{i}" for i in range(40)} and len(got) <= 80


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = _base.table(spark, SF, "documents").select(P.COLUMNS)
    odd = spark.createDataFrame([(9001, None, None, "s", None), (9002, "123 --", "en", "s", 6)], docs.schema)
    scratch = _base.Scratch(spark)
    now = docs.unionByName(odd)
    rows = {r.doc_id: r.text for r in now.collect()}
    for i, (name, stage) in enumerate(P.STAGES):
        now = scratch.keep(stage(spark, now, SF), str(i))
        if i < 4:
            assert now.columns == P.COLUMNS, name
            after = {r.doc_id: r.text for r in now.collect()}
            assert all(r.n_chars == len(r.text) for r in now.collect())
            before = sorted(rows.items())
            if i == 0:
                assert set(rows) - set(after) == {k for k, t in before if not language_id.has_letter(t or "")} >= {9001, 9002}
            if i == 1:
                assert after == dict(H.kept_lines(before))
            if i == 2:
                assert set(after) == {k for (k, _), (_, c) in zip(before, H.jaccard_components(before, 5, 80)) if c in (k, None)}
            if i == 3:
                items = [tuple(r) for r in _base.table(spark, SF, "benchmark").select("item_id", "text").collect()]
                assert set(after) == {k for k, n, h, _ in H.hits(before, items) if not (h and 20 * h >= n)}
            rows = after
    sp = sentencepiece_codec.Segmenter(catalog.tokenizer_model()).sp
    assert all(r.ids == sp.encode(rows[r.doc_id]) for r in now.collect()) and now.count() == len(rows)


def test_pipeline_without_languages(spark):
    import corpus_pipeline as P

    docs = _base.table(spark, SF, "documents").select(P.COLUMNS)
    odd = spark.createDataFrame([(9001, None, None, "s", None), (9002, "123 --", None, "s", 6), (9003, "é", None, "s", 1)], docs.schema)
    bare = docs.unionByName(odd).withColumn("lang", F.lit(None).cast("string"))
    held = docs.unionByName(odd).withColumn("lang", F.when(catalog.crc_slot("doc_id", 4) == 2, F.col("lang")))
    for now in (bare, held):
        want = {(r.doc_id, r.text, r.lang) for r in now.collect() if language_id.has_letter(r.text or "")}
        out = P.identify_language(spark, now, SF)
        assert out.columns == P.COLUMNS and {(r.doc_id, r.text, r.lang) for r in out.collect()} == want and len(want) > 100
    assert P.identify_language(spark, docs.filter("false"), SF).count() == 0
