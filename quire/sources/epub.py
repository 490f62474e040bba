"""EPUB archives as tables, and tables as EPUB archives.

Archives are read with the ``binaryFile`` source, so any file system Spark knows
will do, and taken apart one row at a time.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types

from ..tables import delete, keep
from . import dom

DOCUMENT_TYPES = ("application/xhtml+xml", "text/html")
BOOK = (
    "book_id string, opf_path string, cover_item_id string, toc_item_id string, title string, "
    "manifest array<struct<id: string, href: string, path: string, media_type: string, properties: string>>, "
    "spine array<string>, documents array<struct<doc_path: string, xhtml: string>>"
)


def member(archive: zipfile.ZipFile, name: str) -> str:
    try:
        return archive.read(name).decode("utf-8")
    except KeyError:
        raise ValueError(f"archive has no {name}") from None
    except UnicodeDecodeError:
        raise ValueError(f"{name} is not UTF-8") from None


def resolve(opf_path: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(opf_path), href))


def open_book(content: bytes) -> dict:
    """What BOOK lists, of one archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = dom.from_xml(member(archive, "META-INF/container.xml")).find("rootfile")
        if root is None or not root.attrs.get("full-path"):
            raise ValueError("container names no package")
        opf_path = root.attrs["full-path"]
        raw = member(archive, opf_path)
        opf = dom.from_xml(raw)
        manifest: dict[str, dict] = {}
        for item in (opf.find("manifest") or dom.Node("")).children:
            a = item.attrs
            if item.tag == "item" and a.get("id") and a.get("href"):
                manifest[a["id"]] = {"id": a["id"], "href": a["href"], "path": resolve(opf_path, a["href"]), "media_type": a.get("media-type"), "properties": a.get("properties", "")}
        spine = opf.find("spine") or dom.Node("")
        refs = [x.attrs["idref"] for x in spine.children if x.tag == "itemref" and x.attrs.get("idref")]
        metas = [x for x in (opf.find("metadata") or dom.Node("")).children if x.tag == "meta" and x.attrs.get("name") == "cover"]
        title = re.search(r"<dc:title[^>]*>(.*?)</dc:title>", raw, re.DOTALL)
        docs = [manifest[r]["path"] for r in refs if r in manifest and manifest[r]["media_type"] in DOCUMENT_TYPES]
        return {
            "opf_path": opf_path,
            "cover_item_id": metas[0].attrs.get("content") if metas else None,
            "toc_item_id": spine.attrs.get("toc") or None,
            "title": " ".join(html.unescape(title[1]).split()) if title else None,
            "manifest": list(manifest.values()),
            "spine": refs,
            "documents": [{"doc_path": p, "xhtml": member(archive, p)} for p in docs],
        }


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row an archive, by the columns of BOOK; the title falls back to the file's stem."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"book_id": p, **open_book(bytes(c))} for p, c in zip(part["path"], part["content"])]
            for row in rows:
                row["title"] = row["title"] or posixpath.splitext(posixpath.basename(row["book_id"]))[0]
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in ("book_id", "opf_path", "cover_item_id", "toc_item_id", "title", "manifest", "spine", "documents")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInPandas(run, BOOK)


def manifest_items(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.posexplode("manifest").alias("item_ord", "m")).select("book_id", "item_ord", "m.*")


def spine_items(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.posexplode("spine").alias("spine_ord", "idref"))


def documents(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.posexplode("documents").alias("doc_ord", "d")).select("book_id", "doc_ord", "d.*")


#: idx, text, tag_name and block_path of each block of a document.
SEGMENTS = types.ArrayType(
    types.StructType().add("idx", types.IntegerType()).add("text", types.StringType()).add("tag_name", types.StringType()).add("block_path", types.ArrayType(types.IntegerType()))
)


@F.pandas_udf(SEGMENTS)
def book_segments(xhtml: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([[{"idx": i, "text": b.text, "tag_name": b.tag, "block_path": list(b.path)} for i, b in enumerate(dom.book_blocks(x, p))] for x, p in zip(xhtml, path)])


@F.pandas_udf(SEGMENTS)
def page_segments(pages: pd.Series) -> pd.Series:
    return pd.Series([[{"idx": i, "text": b.text, "tag_name": b.tag, "block_path": list(b.path)} for i, b in enumerate(dom.page_blocks(x))] for x in pages])


def segments(books: DataFrame) -> DataFrame:
    """``book_id, seg_ord, id, doc_path, idx, tag_name, text, block_path``; the id is
    the document's path and the block's place in it."""
    rows = documents(books).select("book_id", "doc_ord", "doc_path", F.explode(book_segments("xhtml", "doc_path")).alias("s")).select("book_id", "doc_ord", "doc_path", "s.*")
    order = F.row_number().over(W.partitionBy("book_id").orderBy("doc_ord", "idx")) - 1
    return rows.select("book_id", order.cast("bigint").alias("seg_ord"), F.concat_ws("::", "doc_path", F.col("idx").cast("string")).alias("id"), "doc_path", "idx", "tag_name", "text", "block_path")


@F.pandas_udf(types.StringType())
def patched(xhtml: pd.Series, translations: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([dom.patch(x, list(t) if t is not None else [], p) for x, t, p in zip(xhtml, translations, path)])


def apply_translations(books: DataFrame, translations: DataFrame) -> DataFrame:
    """``book_id, doc_path, xhtml`` of every document with a translation (book_id,
    doc_path, idx, translated), in order of idx; all blocks need one."""
    lists = translations.groupBy("book_id", "doc_path").agg(F.array_sort(F.collect_list(F.struct("idx", "translated"))).alias("t"))
    joined = documents(books).join(lists, ["book_id", "doc_path"])
    return joined.select("book_id", "doc_path", patched("xhtml", F.transform("t", lambda x: x["translated"]), "doc_path").alias("xhtml"))


def repack(content: bytes, overrides: dict[str, str], line_end: bool = False) -> bytes:
    """The archive with some entries replaced: same order, metadata and comment,
    ``mimetype`` first and stored. An override of an entry that does not exist is
    refused. With line_end the comment, and so the archive, ends with a line end."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        unknown = sorted(set(overrides) - set(old.namelist()))
        if unknown:
            raise ValueError(f"no such entries: {unknown}")
        for info in sorted(old.infolist(), key=lambda i: i.filename != "mimetype"):
            data = overrides[info.filename].encode() if info.filename in overrides else old.read(info.filename)
            new.writestr(info, data, zipfile.ZIP_STORED if info.filename == "mimetype" else info.compress_type)
        new.comment = old.comment[: 65535 - line_end] + b"\n" * line_end
    return out.getvalue()


def write_books(rows: DataFrame, folder: str) -> None:
    """Writes rows of name, content and overrides (map of entry to text, or null) as one
    archive each in folder, wherever Spark can write.

    Two phases: tasks repack archives and Spark's own writer commits them under a
    temporary folder beside their places, one file a row, whatever tasks run again; then
    the driver, which sees names only, moves each to its place, replacing what is there.
    A name that is unsafe or repeated, or an override of no entry, fails the first phase,
    after which nothing is left. An empty table writes nothing."""
    spark = rows.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    temporary = f"{folder.rstrip('/')}/.quire-{uuid.uuid4().hex}"

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            # the writer ends each file with a line end, which is the last byte of the archive's comment
            yield pd.DataFrame({"n": part["n"], "data": [repack(bytes(c), dict(o) if o is not None else {}, line_end=True)[:-1] for c, o in zip(part["content"], part["overrides"])]})

    try:
        names = rows.select("name")
        bad = names.filter(F.col("name").isNull() | F.col("name").isin("", ".", "..") | F.contains("name", F.lit("/")) | F.col("name").startswith("."))
        for found, what in ((bad, "unsafe file name"), (names.groupBy("name").count().filter("count > 1").select("name"), "repeated file name")):
            if first := found.first():
                raise ValueError(f"{what} {first[0]!r}")
        held = keep(rows.select("name", "content", "overrides").withColumn("n", F.monotonically_increasing_id()))
        data = held.select("n", "content", "overrides").mapInPandas(packed, "n long, data binary")
        data.select("n", F.col("data").cast("string")).write.partitionBy("n").option("compression", "none").text(temporary)
        context = fs.FileContext.getFileContext(fs.Path(folder).toUri(), conf)
        replacing = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        replacing[0] = fs.Options.Rename.OVERWRITE
        for row in held.select("n", "name").toLocalIterator():
            (made,) = context.util().globStatus(fs.Path(f"{temporary}/n={row.n}/part-*"))
            context.rename(made.getPath(), fs.Path(f"{folder}/{row['name']}"), replacing)
    finally:
        delete(spark, temporary)
