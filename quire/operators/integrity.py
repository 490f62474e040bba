"""Links, assets and package structure, as anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

EXTERNAL = "^(?:http://|https://|mailto:|tel:|javascript:)"


def hrefs(docs: DataFrame, path: str, html: str) -> DataFrame:
    return docs.select(F.col(path).alias("doc_path"), F.explode(F.regexp_extract_all(F.col(html), F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1))).alias("href"))


def ids(docs: DataFrame, path: str, html: str) -> DataFrame:
    """Every id of a document; any attribute whose name ends in id counts."""
    return docs.select(F.col(path).alias("target"), F.explode(F.regexp_extract_all(F.col(html), F.lit("id=[\"']([^\"']+)[\"']"), F.lit(1))).alias("fragment")).distinct()


def broken_fragments(docs: DataFrame, path: str = "doc_path", html: str = "html") -> DataFrame:
    """``doc_path, href`` of local links to a fragment that its document lacks.
    External links, links without a fragment and empty fragments are not tested."""
    links = hrefs(docs, path, html).filter(~F.col("href").rlike(EXTERNAL) & F.contains("href", F.lit("#")))
    file, fragment = F.substring_index("href", "#", 1), F.expr("substr(href, instr(href, '#') + 1)")
    folder = F.regexp_replace(F.regexp_replace("doc_path", "[^/]*$", ""), "/$", "")
    target = F.when(file == "", F.col("doc_path")).otherwise(T.resolve_href(folder, file))
    links = links.withColumns({"target": target, "fragment": fragment}).filter("fragment <> ''")
    return links.join(ids(docs, path, html), ["target", "fragment"], "left_anti").select("doc_path", "href")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Manifest paths without a file, overrides without an entry, dead seeds: keys of
    one table that the other lacks."""
    return wanted.join(present.select(key), key, "left_anti")


def package_errors(package: DataFrame, manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """``book_id, error``: a cover that is neither an id nor an href of the manifest,
    a table of contents or a spine reference that is no id."""
    own = manifest.select("book_id", F.col("id").alias("key"))
    either = own.unionByName(manifest.select("book_id", F.col("href").alias("key"))).distinct()
    cover = package.filter("cover_item_id is not null").select("book_id", F.col("cover_item_id").alias("key")).join(either, ["book_id", "key"], "left_anti").select("book_id", F.concat(F.lit("cover not in manifest: "), "key").alias("error"))
    toc = package.filter("toc_item_id is not null").select("book_id", F.col("toc_item_id").alias("key")).join(own, ["book_id", "key"], "left_anti").select("book_id", F.concat(F.lit("toc not in manifest: "), "key").alias("error"))
    refs = spine.select("book_id", F.col("idref").alias("key")).join(own, ["book_id", "key"], "left_anti").select("book_id", F.concat(F.lit("spine item not in manifest: "), "key").alias("error"))
    return cover.unionByName(toc).unionByName(refs)
