from __future__ import annotations

import pytest

from quire.operators import index_ladder as L

SCHEMA = "book_id string, item_ord int, spine_ord int, href string, html string, properties string, is_toc boolean"
ENTRIES = "<h1>Index</h1>" + "".join(f"<p>Term number {i}, {i}</p>" for i in range(10, 30))
BAR = "<p>[ A ][ B ][ C ]</p>" + "<p>word</p>" * 60


def docs(spark, *rows):
    return spark.createDataFrame([("b", i, i if s else None, h, x, "", False) for i, (h, x, s) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    ("rows", "found"),
    [
        ([("a.html", '<p epub:type="index">x y</p>', True), ("b.html", '<p epub:type="index" class="index">x y z</p>', True)], (0, "b.html")),
        ([("a.html", '<p epub:type="index">x y</p>', True), ("b.html", '<p epub:type="index">x y z</p>', True)], (0, "a.html")),
        ([("myindex.html", "<p>some words</p>", False), ("idx2.html", ENTRIES, False)], (1, "idx2.html")),
        ([("myindex.html", "<p>some words</p>", False), ("theindex.html", "<p>more words</p>", False)], (1, "theindex.html")),
        ([("myindex.html", "<p>some words</p>", False), ("c.html", "<p>prose</p>", True)], (2, "myindex.html")),
        ([("a.html", BAR, True), ("z.html", "<p>prose</p>", True)], (3, "a.html")),
        ([("a.html", ENTRIES.replace("Index", "Terminology"), True), ("z.html", "<p>prose</p>", True)], (4, "a.html")),
        ([("myindex.html", "<h1>Index</h1>", True)], None),
    ],
)
def test_ladder(spark, rows, found):
    got = L.locate_index(docs(spark, *rows)).collect()
    assert [(r.pass_no, r.href) for r in got] == ([found] if found else [])


def test_body(spark):
    rows = [("cover.html", "<p>c</p>", True), ("c1.html", "<p>one</p>", True), ("nav.html", '<nav epub:type="toc"><p>x</p></nav>', True), ("toc.html", "<p>t</p>", True), ("e.html", "<p> </p>", True), ("ix01.html", ENTRIES, True), ("pic.svg", "<p>x</p>", False)]
    df = docs(spark, *rows)
    index = L.locate_index(df)
    assert [r.href for r in index.collect()] == ["ix01.html"]
    assert [(r.href, r.text) for r in L.body_documents(df, index).collect()] == [("c1.html", "one")]


def test_judges(spark):
    judges = spark.createDataFrame([("a",), ("b",)], "judge string")
    candidates = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    vendors = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id long, vendor string")
    votes = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True)], "id long, judge string, keep boolean")
    assert {tuple(r) for r in L.judge_report(judges, candidates, vendors, votes).collect()} == {("a", 1, 2, 1), ("b", 0, 0, 2)}
