"""Files by name and signature, and only those that changed read again.

Names, sizes and times come from the listing that Spark makes anyway; no content is
read to compare them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, name, size, modified, signature`` of the files of a folder (and below) whose
    names fit a pattern; empty files, which hold nothing to read, are left out. signature: SHA-256 of path, size and time, which tells a file as
    it was from the file as it is, but says nothing of its content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    out = files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.withColumn("signature", F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.unix_micros("modified").cast("string")), 256))


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of listed files that are new or not as they were. known: path, signature."""
    return now.join(known.select("path", "signature").distinct(), ["path", "signature"], "left_anti")


def contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``path, content, digest`` of the listed files alone, digest the SHA-256 of the
    content. Only paths, which the driver lists for any scan, pass through the driver."""
    paths = [r.path for r in files.select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "path string, content binary, digest string")
    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return found.withColumn("digest", F.concat(F.lit("sha256:"), F.sha2("content", 256)))


def texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``ord, name, text`` of whole text files, in order of their names."""
    from ..plans.numbering import numbered

    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))  # names come with their odd letters encoded
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(name.alias("name"), F.col("value").alias("text"))
    return numbered(rows, ["name"], number="ord").select("ord", "name", "text")
