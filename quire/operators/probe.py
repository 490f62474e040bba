"""Quality signals on translated segments; they observe and never stop a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_RATIO, MAX_RATIO, MIN_SOURCE = 0.15, 2.0, 20
MIN_DENSITY, MIN_DENSE_SOURCE = 0.30, 40


def sanity_warnings(pairs: DataFrame, source: str = "source", target: str = "target", language: str = "zh", min_ratio: float = MIN_RATIO, max_ratio: float = MAX_RATIO, min_source: int = MIN_SOURCE, min_density: float = MIN_DENSITY, min_dense_source: int = MIN_DENSE_SOURCE) -> DataFrame:
    """All columns of pairs, ``check``, its ``detail`` and excerpts of both texts: one
    row for each signal. An empty target has no other signal."""
    s, t = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(target), F.lit(""))
    empty = ~t.rlike(r"(?U)\S")
    ratio = F.length(t) / F.greatest(F.length(s), F.lit(1))
    off = (F.length(s) >= min_source) & ((ratio < min_ratio) | (ratio > max_ratio))
    thin = F.lit(language.startswith("zh")) & (F.length(s) >= min_dense_source) & ~s.rlike(T.URL_HINT) & (T.cjk_density(t) < min_density)
    signal = lambda name, detail: F.struct(F.lit(name).alias("check"), detail.alias("detail"))
    found = F.array_compact(
        F.array(
            F.when(empty, signal("empty_output", F.lit("translation is empty"))),
            F.when(~empty & off, signal("length_ratio", F.format_string(f"length_ratio=%.2f not in [{min_ratio}, {max_ratio}]", ratio))),
            F.when(~empty & thin, signal("cjk_density", F.format_string(f"cjk_density=%.2f < {min_density}", T.cjk_density(t)))),
        )
    )
    rows = pairs.select("*", F.explode(found).alias("signal_"), T.excerpt(s).alias("source_excerpt"), T.excerpt(t).alias("target_excerpt"))
    return rows.select(*pairs.columns, "signal_.check", "signal_.detail", "source_excerpt", "target_excerpt")


def replace_warnings(old: DataFrame, new: DataFrame, probed: DataFrame, key: str) -> DataFrame:
    """Old warnings of segments that were not probed again, and all new ones."""
    return old.join(probed.select(key).distinct(), key, "left_anti").unionByName(new)


#: Fixed value: what shows that a probe's reply came with something else.
ARTIFACT = r"```|file://|antigravity-cli/brain/"


def output_problems(reply, source, segment=None, expect_chinese: bool = False):
    """All defects of a probe's reply, in order, as an array. segment: its number. With a
    prompt of the caller's own the target language is not known, so a reply may be like
    its source; where Chinese is expected, one without an ideograph is a defect too."""
    reply, number = F.coalesce(reply, F.lit("")), F.lit(1) if segment is None else segment
    text = F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")
    told = lambda what: F.concat(F.lit("segment "), number.cast("string"), F.lit(f" {what}"))
    first = F.when(text == "", told("empty"))
    if expect_chinese:
        first = first.when((text == source) | (T.cjk_count(text) == 0), told("not translated into Chinese"))
    return F.array_compact(F.array(first, F.when(reply.rlike(ARTIFACT), told("contains a fence or artifact link"))))
