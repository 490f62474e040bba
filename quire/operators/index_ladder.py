"""Where a book's index is, and which of its documents hold the body.

Input tables have one row a document: ``book_id, item_ord`` (manifest order),
``spine_ord`` (null outside the spine), ``href, html``. Each pass of the ladder is a
filter; the passes' candidates are ranked together and the best one of a book wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import index_pages as I
from ..functions import text as T
from ..sources.trees import visible_text

#: Spine documents from the end that the last two passes look at.
TAIL, USABLE_CHARS = 10, 100
TITLE_NAME = r"(?i)(?<![a-z0-9])(?:title|cover)"
TOC_MARKUP = r"""(?i)<nav\b[^>]*\bepub:type\s*=\s*["'][^"']*\btoc\b"""
TITLE_MARKUP = r"""(?i)\bepub:type\s*=\s*["'][^"']*\b(?:titlepage|halftitlepage|cover)\b"""


def first_script(text: Column) -> Column:
    """The lines that are not mostly above U+4E00, or all of them if none is left."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~T.is_high_script_line(x))
    kept = F.array_join(lines, "\n")
    return F.when(kept.rlike(r"(?U)\S"), kept).otherwise(text)


def locate_index(docs: DataFrame) -> DataFrame:
    """``book_id, pass_no, href, text, usable`` for each book with an index.

    Pass 0: the spine document of most signals, if they are strong, the earliest of
    equals. 1: a manifest item named like an index that reads like one, or the
    second so named that does not; 2: failing these the first so named. 3 and 4: from
    the end of the spine, the first of the last ten documents with an alphabet bar,
    or with index lines. Placeholders never count in passes 0 to 2."""
    total, _ = I.score(F.col("href"), F.col("html"))
    told = docs.select("book_id", "item_ord", "spine_ord", "href", total.alias("total"), visible_text(F.col("html")).alias("plain"), I.index_page(F.col("html")).alias("lined"))
    real, bar = ~I.is_placeholder(F.col("plain")), I.has_alphabet_bar(F.col("plain"))
    rows = told.select("book_id", "item_ord", "spine_ord", "href", "total", "lined", real.alias("real"), bar.alias("bar"))  # documents are ranked without their texts
    book = W.partitionBy("book_id")
    named = I.is_index_path(F.col("href")) & F.col("real")
    weak = named & ~(F.col("bar") | F.col("lined"))
    rows = rows.withColumn("weak_no", F.when(weak, F.count(F.when(weak, 1)).over(book.orderBy("item_ord").rowsBetween(W.unboundedPreceding, 0))))
    rows = rows.withColumn("from_end", F.when(F.col("spine_ord").isNotNull(), F.max("spine_ord").over(book) - F.col("spine_ord")))
    spine, tail = F.col("spine_ord").isNotNull(), F.col("from_end") < TAIL

    def step(pass_no: int, at: str, rank=None) -> Column:
        return F.struct(F.lit(pass_no).alias("pass_no"), (F.lit(0) if rank is None else rank).cast("int").alias("rank"), F.col(at).cast("int").alias("at"))

    strong = spine & F.col("real") & (F.col("total") >= I.STRONG)
    second = F.col("weak_no").isNull() | (F.col("weak_no") > 1)
    steps = F.array_compact(
        F.array(
            F.when(strong, step(0, "spine_ord", -F.col("total"))),
            F.when(named & second, step(1, "item_ord")),
            F.when(named & ~second, step(2, "item_ord")),
            F.when(tail & F.col("bar"), step(3, "from_end")),
            F.when(tail & F.col("lined"), step(4, "from_end")),
        )
    )
    best = rows.select("book_id", "item_ord", F.array_min(steps).alias("step"), strong.alias("strong")).filter("step is not null")
    out = best.groupBy("book_id").agg(F.min_by("item_ord", "step").alias("item_ord"), F.min("step").alias("step"), F.max("strong").alias("strong"))
    won = docs.select("book_id", "item_ord", "href", "html").join(out, ["book_id", "item_ord"])
    won = won.select("book_id", "step", "strong", "href", first_script(visible_text(F.col("html"))).alias("text"))
    return won.select("book_id", F.col("step.pass_no").alias("pass_no"), "href", "text", ((F.length("text") > USABLE_CHARS) | F.col("strong")).alias("usable"))


def body_documents(docs: DataFrame, index: DataFrame, properties: str = "properties") -> DataFrame:
    """Spine documents but the index, navigation and contents, title and cover pages
    and those without text: ``book_id, spine_ord, href, text``. docs also has
    properties (space-separated) and is_toc."""
    stem = F.regexp_replace(F.regexp_extract("href", "[^/]*$", 0), r"\.[^.]*$", "")
    out = docs.filter("spine_ord is not null and not coalesce(is_toc, false)").join(index.select("book_id", "href"), ["book_id", "href"], "left_anti")
    nav = F.array_contains(F.split(F.coalesce(F.col(properties), F.lit("")), r"\s+"), "nav")
    out = out.filter(~nav & ~I.is_toc_href(F.col("href")) & ~stem.rlike(TITLE_NAME) & ~F.col("html").rlike(TOC_MARKUP) & ~F.col("html").rlike(TITLE_MARKUP))
    return out.select("book_id", "spine_ord", "href", visible_text(F.col("html")).alias("text")).filter(F.col("text").rlike(r"(?U)\S"))


def judge_report(judges: DataFrame, candidates: DataFrame, vendors: DataFrame, votes: DataFrame) -> DataFrame:
    """``judge, own_list_keeps, own_list_votes, abstained``: votes of each judge on what
    its own vendor proposed, and the number of candidates it left out."""
    own = vendors.withColumnRenamed("vendor", "judge").join(votes.select("id", "judge", "keep"), ["id", "judge"]).groupBy("judge").agg(F.count_if("keep").alias("own_list_keeps"), F.count("*").alias("own_list_votes"))
    voted = votes.join(candidates.select("id"), "id", "left_semi").groupBy("judge").agg(F.countDistinct("id").alias("voted"))
    total = candidates.agg(F.count("*").alias("total"))  # one row
    out = judges.select("judge").join(own, "judge", "left").join(voted, "judge", "left").na.fill(0).join(F.broadcast(total), F.lit(True))
    return out.select("judge", "own_list_keeps", "own_list_votes", (F.col("total") - F.col("voted")).alias("abstained"))
