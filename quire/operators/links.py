"""Links of Markdown files and the files that they name.

The scan reads inline links, images and reference definitions line by line outside
fenced code; it is no full CommonMark parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where old files are kept, and what a target may be besides a path.
ARCHIVE = "docs/_archive/"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
FILE_LINE = r"^[^:/]+\.[^:/]+:\d+(?:-\d+)?(?:[?#].*)?$"
LINE_SUFFIX = r":\d+(?:-\d+)?$"
LINK = r"""!?\[(?:[^\[\]]|\[[^\[\]]*\])*\]\(\s*(?:<([^<>]*)>|([^\s()<]+(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:"[^"]*"|'[^']*'))?\s*\)"""


def maintained(path: Column) -> Column:
    """Markdown files that are kept up: all but the archive, and there each README of
    its top two levels."""
    rest = F.substr(path, F.lit(len(ARCHIVE) + 1))
    return path.endswith(".md") & (~path.startswith(ARCHIVE) | rest.rlike(r"^(?:[^/]+/)?README\.md$"))


def links(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, line, target`` of each link; lines count from 1."""
    fence = lambda r: r.rlike(r"^ {0,3}(?:```|~~~)")
    whole = files.select(F.col(path).alias("path"), F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n", -1).alias("all"))
    fences = F.array_compact(F.transform("all", lambda r, i: F.when(fence(r), i)))
    lines = whole.select("path", fences.alias("fences"), F.posexplode("all").alias("at", "row")).filter(F.contains("row", F.lit("](")))
    rows = lines.filter(F.size(F.filter("fences", lambda i: i < F.col("at"))) % 2 == 0)
    plain = F.regexp_replace("row", r"`[^`]*`", "")
    targets = F.zip_with(F.regexp_extract_all(plain, F.lit(LINK), F.lit(1)), F.regexp_extract_all(plain, F.lit(LINK), F.lit(2)), lambda a, b: F.concat(a, b))
    return rows.select("path", (F.col("at") + 1).alias("line"), F.explode(F.filter(targets, lambda t: t != "")).alias("target"))


def normal_path(directory: Column, path: Column) -> Column:
    """Both joined, ``.`` and ``..`` resolved as far as they go."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(directory, F.lit("")), path), "/"), lambda p: (p != "") & (p != "."))
    step = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def broken(found: DataFrame, files: DataFrame) -> DataFrame:
    """Links that lead nowhere, with a reason: machine-specific, outside-repository or
    missing. files: path of every file and folder."""
    t = F.col("target")
    decoded = F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    own = F.lower(decoded).startswith("file:") | decoded.rlike("^[/~]")
    address = (t.rlike(SCHEME) & ~t.rlike(FILE_LINE)) | t.startswith("#")
    bare = F.regexp_replace(F.regexp_replace(t, r"[#?].*$", ""), LINE_SUFFIX, "")
    bare = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    rows = found.withColumns({"target": decoded, "own_": own, "skip_": ~own & (address | (bare == "")), "to_": normal_path(directory, bare)}).filter("not skip_")
    known = files.select(F.col("path").alias("to_"), F.lit(True).alias("there_")).distinct()
    rows = rows.join(known, "to_", "left")
    reason = F.when(F.col("own_"), "machine-specific").when(F.col("to_").rlike(r"^\.\.(?:/|$)"), "outside-repository").when(F.col("there_").isNull() & (F.col("to_") != ""), "missing")
    return rows.withColumn("reason", reason).filter("reason is not null").select("path", "line", "target", "reason")
