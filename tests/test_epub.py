from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import integrity
from quire.sources import dom, epub

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/pkg.opf"/></rootfiles></container>'


def page(body: str) -> str:
    return f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>t</title></head><body>{body}</body></html>'


def book(docs: dict[str, str], spine: list[str], extra: str = "", title: str | None = "A &amp; B", cover: str = "") -> bytes:
    items = "".join(f'<item id="{k}" href="{k}.xhtml" media-type="application/xhtml+xml"/>' for k in docs)
    refs = "".join(f'<itemref idref="{k}"/>' for k in spine)
    dc = f"<dc:title>{title}</dc:title>" if title else ""
    opf = f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{dc}{cover}</metadata><manifest>{items}{extra}</manifest><spine toc="ncx">{refs}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/pkg.opf", opf)
        for k, v in docs.items():
            z.writestr(f"OEBPS/{k}.xhtml", page(v))
    return out.getvalue()


@pytest.mark.parametrize(
    ("body", "texts"),
    [
        ("<p>One</p><div>Leaf prose</div>", ["One", "Leaf prose"]),
        ('<div><b>Short heading</b></div><p class="subtitle">x</p><h2>y</h2><p>z</p>', ["z"]),
        ("<div><b>Chapter</b> 12</div><div><b>Note</b> then prose</div>", ["Note then prose"]),
        ("<div><b>重点</b>这是正文</div>", ["重点这是正文"]),
        ("<p>a<script>no</script> b</p>", ["a b"]),
        ('<div><img src="i.png"/>caption</div><div><p>inner</p></div>', ["inner"]),
        ("<p>a<br/>  b<br/>c </p>", ["a\nb\nc"]),
        ('<nav epub:type="toc"><ol><li>x</li></ol></nav><nav role="doc-toc"><p>y</p></nav><ol><li>one</li></ol>', ["one"]),
        ("<table><tr><td>cell</td></tr></table><dl><dt>t</dt><dd>def</dd></dl>", ["def"]),
        ("<blockquote><p> </p>quote</blockquote>", ["quote"]),
    ],
)
def test_blocks(body, texts):
    assert [b.text for b in dom.book_blocks(page(body), "c1.xhtml")] == texts


def test_documents_left_out():
    assert dom.book_blocks(page("<p>x</p>"), "text/my-toc.xhtml") == []
    assert dom.book_blocks(page("<h1>References</h1><p>x</p>"), "r.xhtml") == []
    assert len(dom.book_blocks(page("<p>prose</p><h1>References</h1><p>x</p>"), "r.xhtml")) == 2
    assert len(dom.book_blocks(page("<h1>References</h1><h2>More</h2><p>x</p>"), "r.xhtml")) == 1


def test_patch_round_trip():
    source = page("<p>a</p><ol><li>b</li></ol><dl><dd>c</dd></dl>")
    out = dom.patch(source, ["A", "B\nBB", "C"], "c.xhtml")
    assert '<p>a</p><p class="quire-translation">A</p>' in out
    assert '<li>b<p class="quire-translation">B<br />BB</p></li>' in out
    assert '<dd>c</dd><dd class="quire-translation">C</dd>' in out
    assert out.count("<style") == 1
    with pytest.raises(ValueError, match="3 blocks and 1"):
        dom.patch(source, ["A"], "c.xhtml")


def test_tolerant_pages():
    assert [b.text for b in dom.page_blocks("<body><p>one<p>two<ul><li>x<li>y</ul>")] == ["one", "two", "x", "y"]
    assert dom.page_blocks(None) == []


def test_book_tables(spark, tmp_path):
    data = book({"c2": "<p>second</p>", "c1": "<p>first</p><p>more</p>", "bib": "<h1>Bibliography</h1><p>x</p>"}, ["c1", "gone", "c2", "bib"], '<item id="pic" href="p.png" media-type="image/png"/><item href="noid"/>', cover='<meta name="cover" content="pic"/>')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(data)
    books = epub.read_books(spark, str(tmp_path / "in"))
    row = books.first()
    assert (row.title, row.cover_item_id, row.toc_item_id, row.spine) == ("A & B", "pic", "ncx", ["c1", "gone", "c2", "bib"])
    assert [m.path for m in row.manifest] == ["OEBPS/c2.xhtml", "OEBPS/c1.xhtml", "OEBPS/bib.xhtml", "OEBPS/p.png"]
    segs = [(r.seg_ord, r.id, r.text) for r in epub.segments(books).orderBy("seg_ord").collect()]
    assert segs == [(0, "OEBPS/c1.xhtml::0", "first"), (1, "OEBPS/c1.xhtml::1", "more"), (2, "OEBPS/c2.xhtml::0", "second")]
    errors = integrity.package_errors(books.select("book_id", "cover_item_id", "toc_item_id"), epub.manifest_items(books), epub.spine_items(books))
    assert sorted(r.error for r in errors.collect()) == ["spine item not in manifest: gone", "toc not in manifest: ncx"]

    translated = epub.segments(books).select("book_id", "doc_path", "idx", F.upper("text").alias("translated"))
    docs = epub.apply_translations(books, translated)
    overrides = docs.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_path", "xhtml"))).alias("overrides"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "in")).select(F.col("path").alias("book_id"), "content")
    out = files.join(overrides, "book_id").select(F.lit("out.epub").alias("name"), "content", "overrides")
    for _ in range(2):  # the second time it replaces the first
        epub.write_books(out, f"file://{tmp_path}/out")
    with zipfile.ZipFile(tmp_path / "out" / "out.epub") as z:
        assert z.namelist() == zipfile.ZipFile(io.BytesIO(data)).namelist()
        assert z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "FIRST" in z.read("OEBPS/c1.xhtml").decode()
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["out.epub"]


def test_sink_refuses_as_a_whole(spark, tmp_path):
    data = book({"c": "<p>x</p>"}, ["c"])
    with zipfile.ZipFile(tmp_path / "said.epub", "w") as z:
        z.writestr("mimetype", "x")
        z.comment = b"said before"
    said = (tmp_path / "said.epub").read_bytes()
    schema, folder = "name string, content binary, overrides map<string, string>", f"file://{tmp_path}/out"
    write = lambda *rows: epub.write_books(spark.createDataFrame(rows, schema).repartition(3), folder)
    write()
    for rows, what in (([("../x", data, None)], "unsafe"), ([(None, data, None)], "unsafe"), ([("a", data, None), ("a", data, {})], "repeated"), ([("a", data, None), ("b", data, {"nope": "x"})], "no such entries")):
        with pytest.raises(Exception, match=what):
            write(*rows)
    assert not (tmp_path / "out").exists() or not [p for p in (tmp_path / "out").iterdir() if p.suffix != ".crc"]
    write(*[(f"Straße {i} %20 =.epub", said if i == 3 else data, {"OEBPS/c.xhtml": f"new {i}"} if i % 2 == 0 else None) for i in range(7)])
    made = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix != ".crc")
    assert [p.name for p in made] == [f"Straße {i} %20 =.epub" for i in range(7)]
    for i, p in enumerate(made):
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None and z.comment == (b"said before\n" if i == 3 else b"\n")
            if i != 3:
                assert (z.read("OEBPS/c.xhtml") == f"new {i}".encode()) == (i % 2 == 0)


def test_refusals():
    with pytest.raises(ValueError, match="no META-INF/container.xml"):
        out = io.BytesIO()
        zipfile.ZipFile(out, "w").writestr("x", "y")
        epub.open_book(out.getvalue())
    with pytest.raises(ValueError, match="no such entries"):
        epub.repack(book({"c": "<p>x</p>"}, ["c"]), {"nope": "x"})


def test_deep_trees():
    """Trees deeper than Python's own stack."""
    deep = "<div>" * 10_000 + "<p>inside <b>all</b></p>" + "</div>" * 10_000
    assert [b.text for b in dom.page_blocks(deep)] == ["inside all"]
    assert [(b.text, len(b.path)) for b in dom.book_blocks(f"<html><body>{deep}</body></html>", "x.xhtml")] == [("inside all", 10_001)]
    assert len(dom.page_blocks("<p>x<b>y<i>" * 3000)) >= 1
    assert dom.shown(dom.from_html("<b>" * 5000 + "a<br> b" + "</b>" * 5000)) == "a\nb"
