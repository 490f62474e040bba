from __future__ import annotations

import random
import re
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quire.functions import index_pages as I
from quire.functions import text as T
from quire.sources import trees


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(*columns).first()


@pytest.mark.parametrize(("term", "key"), [("The Ring-Bearer", "ring bearer"), ("A  Day's end", "days end"), ("Ångström", "ngstrm"), ("An", "an"), ("--", "")])
def test_term_key(spark, term, key):
    assert one(spark, T.term_key(F.col("t")), t=term)[0] == key


def test_excerpt_and_clip(spark):
    assert one(spark, T.excerpt(F.col("t")), t="x" * 120)[0] == "x" * 120
    assert one(spark, T.excerpt(F.col("t")), t="x" * 121)[0] == "x" * 120 + "..."
    long = "".join(chr(97 + i % 26) for i in range(1000))
    assert one(spark, T.clip(F.col("t"), F.lit(500)), t=long)[0] == "…" + long[320:720] + "…"
    assert one(spark, T.clip(F.col("t"), F.lit(990)), t=long)[0] == "…" + long[600:]
    assert one(spark, T.clip(F.col("t"), F.lit(0)), t=long)[0] == long[:400] + "…"


def test_two_script_counts_differ(spark):
    assert tuple(one(spark, T.high_count(F.col("t")), T.cjk_count(F.col("t")), t="a中😀一가")) == (3, 2)
    assert one(spark, T.cjk_density(F.col("t")), t="  Foo中文 ")[0] == 1.0


@pytest.mark.parametrize(("text", "seconds"), [("05:09", 309), ("01:00:00", 3600), ("2-03:04:05", 183845), ("x", None), ("1:2:3:4", None), ("", None)])
def test_elapsed(spark, text, seconds):
    assert one(spark, T.elapsed_seconds(F.col("t")), t=text)[0] == seconds


def test_small_functions(spark):
    assert one(spark, T.options_of(F.col("t")), t="甲 / 乙／丙")[0] == ["甲", "乙", "丙"]
    assert one(spark, T.strip_fence(F.col("t")), t="```json\n{}\n```")[0] == "{}"
    assert one(spark, T.retry_after(F.col("t")), t='{"retryDelay": "7s", "x": "retry after 9"}')[0] == 7
    assert one(spark, T.retry_after(F.col("t")), t="Please Retry after 30 seconds.")[0] == 30
    assert one(spark, T.retry_after(F.col("t")), t="no")[0] is None
    assert one(spark, T.progress_value(F.col("t")), t='a "b"')[0] == '"a \\"b\\""'
    assert one(spark, T.language_name(F.col("t")), t="fr")[0] == "French"
    assert one(spark, T.language_name(F.col("t")), t="xx")[0] == "xx"
    assert one(spark, T.sentences(F.col("t")), t=" One.  Two! three")[0] == ["One.", "Two!", "three"]
    assert [one(spark, T.priority_rank(F.col("t")), t=p)[0] for p in ("critical", "high", "low", "?")] == [0, 1, 3, 2]


@pytest.mark.parametrize(("base", "href", "path"), [("OEBPS/text", "../img/a.png", "OEBPS/img/a.png"), ("", "./a//b", "a/b"), ("a", "/c/../d", "/d"), ("a", "../../b", "../b")])
def test_resolve_href(spark, base, href, path):
    assert one(spark, T.resolve_href(F.col("b"), F.col("h")), b=base, h=href)[0] == path


def test_index_signals(spark):
    def score(href, html):
        return tuple(one(spark, *I.score(F.col("h"), F.col("x")), h=href, x=html))

    assert score("back/index.xhtml", "<p>x</p>") == (25, ["href_hint"])
    assert score("a.xhtml", '<section epub:type="index"/>') == (40, ["epub_type"])
    assert score("a.xhtml", '<div class="my-index list">') == (20, ["css_class"])
    assert score("a.xhtml", '<div class="indexes">') == (0, [])
    assert score("ix01.xhtml", "<h2> Index </h2><p>Adapter, 10-15, 42</p>") == (55, ["href_hint", "heading", "line_shape"])


def test_index_lines(spark):
    page = "<h1>Index</h1>" + "".join(f"<p>Term {i}, {i}</p>" for i in range(10, 14)) + "<p>prose that goes on</p>"
    assert one(spark, I.index_page(F.col("t")), t=page)[0]
    assert not one(spark, I.index_page(F.col("t")), t="<p>a</p><p>b</p><p>c</p>")[0]
    assert one(spark, I.is_placeholder(F.col("t")), t=" Index  Terms ")[0]
    assert not one(spark, I.is_placeholder(F.col("t")), t="Index of names")[0]
    assert one(spark, I.is_toc_name(F.col("t")), t="x/mytoc.html")[0] and not one(spark, I.is_toc_href(F.col("t")), t="x/mytoc.html")[0]
    assert one(spark, I.is_toc_href(F.col("t")), t="x/my-toc.html")[0]


def plain_lines(page):
    """Lines of a page by way of its element tree."""
    try:
        root = ET.fromstring(page)
    except ET.ParseError:
        return [x.strip() for x in re.sub("<[^>]+>", "\n", page).splitlines() if x.strip()], re.sub("<[^>]+>", " ", page).strip()
    wanted = [e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2].lower() in trees.LINE_TAGS]
    return [x for x in (" ".join("".join(e.itertext()).split()) for e in wanted) if x], " ".join(root.itertext()).strip()


def test_lines_by_tags(spark):
    random.seed(1)

    def node(depth):
        tag = random.choice(["p", "li", "ul", "b", "H2", "div", "dd", "x:dt"])
        inner = "".join(node(depth + 1) if depth < 5 and random.random() < 0.6 else random.choice(["word ", " a\n b ", "é\u00a0", "&amp;", "<!-- c -->", ""]) for _ in range(random.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>" + random.choice(["", " tail ", "\n"])

    pages = [f'<html xmlns:x="http://www.w3.org/1999/xhtml">{node(0)}{node(0)}</html>' for _ in range(120)]
    pages += [p.replace("</ul>", "", 1) for p in pages[:40]] + ["", "no tags\x0bhere\u2028and", "<p>1<p>2", "<p/>", "<p>" * 3000 + "deep" + "</p>" * 3000]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(None, None)], "n int, html string").repartition(3)
    got = {r.n: r for r in df.select("n", trees.page_lines(F.col("html")).alias("lines"), trees.visible_text(F.col("html")).alias("text")).collect()}
    for i, p in enumerate(pages):
        lines, text = plain_lines(p)
        assert got[i].lines == lines and got[i].text.split() == text.split(), i
    assert got[None].lines is None or got[None].lines == []


def test_nodes_as_intervals(spark):
    pages = [(1, "<a>x<b>y<c/>z</b><b>w</b></a>"), (2, "<a><b></a>"), (None, "<q>é</q>"), (None, "<q>é</q>"), (3, None)]
    df = spark.createDataFrame(pages, "id long, html string")
    rows = trees.nodes(df, "id", "html").orderBy("id", "at").collect()
    assert [tuple(r) for r in rows] == [(None, 0, 0, 0, "q", "é")] * 2 + [(1, 0, 3, 0, "a", "xyzw"), (1, 1, 2, 1, "b", "yz"), (1, 2, 2, 2, "c", ""), (1, 3, 3, 1, "b", "w")]
    nodes = trees.nodes(df, "id", "html")
    met = nodes.alias("o").join(nodes.alias("i"), trees.inside("o", "i", "id")).filter("o.id = 1").select("o.at", "i.at").collect()
    assert sorted(tuple(r) for r in met) == [(0, 1), (0, 2), (0, 3), (1, 2)]
    assert trees.nodes(df.limit(0), "id", "html").count() == 0
