"""Term candidates, the sentences that hold them, and how translations use them.

A term is matched by a pattern only where it can match at all: an automaton over all
terms reads each text once and proposes, then the pattern decides, so the result is
that of trying every pattern on every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from ..plans.numbering import numbered
from ..tables import keep
from . import automaton

#: Words that are no term, and words that may join two.
STOPWORDS = "a an and are as at be but by for from has have he in is it its of on or that the this to was were will with".split()
CONNECTORS = "and or of the a an for in on at to with".split()
EDGES = r""".,;:!?"()[]{}"""
TITLE = "^[A-Z][a-z]+$"
MAX_FOLLOWING = 6


def position_labels(docs: DataFrame, book: str, order: str) -> DataFrame:
    """front, body or back by place in the book (a tenth at each end, one at least), with
    its weight. Only places are sorted; documents meet the places where their book's
    ends begin. Documents of one place share its label."""
    at = numbered(docs.select(book, order), [order], [book])
    edge = F.greatest(F.lit(1), F.floor(F.col("of") / 10))
    cuts = at.groupBy(F.col(book).alias("book_")).agg(F.max(F.when(F.col("at") <= edge, F.col(order))).alias("front_"), F.min(F.when(F.col("at") > F.col("of") - edge, F.col(order))).alias("back_"))
    label = F.when(F.col(order) <= F.col("front_"), "front").when(F.col(order) >= F.col("back_"), "back").otherwise("body")
    weight = F.when(F.col("label") == "front", 1.5).when(F.col("label") == "back", 1.2).otherwise(1.0)
    return docs.join(cuts, F.col(book).eqNullSafe(F.col("book_")), "left").withColumn("label", label).withColumn("weight", weight).drop("book_", "front_", "back_")


def tidy(word: Column) -> Column:
    return F.trim(word, F.lit(EDGES))


def title_words(text: Column) -> Column:
    """The distinct single title-case words of a text that are no stopwords."""
    words = F.transform(F.split(F.trim(text), r"\s+"), tidy)
    return F.array_distinct(F.filter(words, lambda w: w.rlike(TITLE) & ~F.lower(w).isin(STOPWORDS)))


def phrases_of(text: str | None) -> set[str]:
    """Terms of one text: the longest runs of title-case words, joined directly or
    by a connector that a title-case word follows; single words stand alone."""
    import re

    title, stop, joins = re.compile(TITLE), set(STOPWORDS), set(CONNECTORS)
    raw = (text or "").split()
    words = [w.strip(EDGES) for w in raw]
    head = [bool(title.match(w)) for w in words]
    noun = [h and w.lower() not in stop for h, w in zip(head, words)]
    found = set()

    def valid(term: str) -> bool:
        return len(term) > 1 and term.lower() not in stop and not all(w.lower() in stop for w in term.split())

    for i, word in enumerate(words):
        if not head[i] or not valid(word):
            continue
        end = i + 1
        while end < len(words) and end <= i + MAX_FOLLOWING:
            joint = words[end] in joins and end + 1 < len(words) and noun[end + 1]
            if not (noun[end] or joint):
                break
            end += 1
        term = " ".join(words[i:end])
        if end == i + 1 or valid(term):
            found.add(term)
    chain = r"\b[A-Z][a-z]+(?:\s+(?:" + "|".join(CONNECTORS) + r")\s+[A-Z][a-z]+)+\b"
    return found | {m for m in re.findall(chain, text or "") if valid(m)}


@F.pandas_udf(types.ArrayType(types.StringType()))
def phrases(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: sorted(phrases_of(t)))


def rank_candidates(blocks: DataFrame, terms: Column, limit: int | None = 300) -> DataFrame:
    """blocks: label, weight. One row a term: blocks that hold it, their weight,
    technical (more than one word) or entity, sorted labels; best first."""
    each = blocks.select("label", "weight", F.explode(F.array_distinct(terms)).alias("term"))
    out = each.groupBy("term").agg(F.count("*").alias("frequency"), F.sum("weight").alias("weighted_score"), F.array_sort(F.collect_set("label")).alias("sources"))
    out = out.withColumn("kind", F.when(F.col("term").rlike(r"\s"), "technical").otherwise("entity"))
    return out.orderBy(F.desc("weighted_score"), "term").limit(limit) if limit is not None else out


def match_terms(texts: DataFrame, text: str, terms: DataFrame, term: str = "term", keep_: list[str] | None = None, block_bytes: int | None = None) -> DataFrame:
    """Rows of texts with the terms they hold as whole words in any case: the columns
    keep_ of texts (all by default) and those of terms.

    One pass over the texts for each block of terms: an automaton finds the terms that a
    text can hold, and their patterns decide, so the result is that of trying every
    pattern on every text. A blank term matches nothing."""
    keyed = automaton.with_ids(terms.filter(F.col(term).rlike(r"(?U)\S")))
    sought = keyed.select("id", F.array(term).alias("pieces"), T.term_pattern(F.col(term)).alias("said"))
    found = automaton.find(texts, F.col(text), texts.columns if keep_ is None else keep_, sought, automaton.WORDS, block_bytes)
    return found.join(keyed.withColumnRenamed("id", "hit"), "hit").drop("hit")


#: A word before white space and another word, and that other word. Both patterns match in
#: the same places, as each match ends where the other word begins.
LETTERS = r"[\p{L}\p{N}_]"
FORMER, LATTER = rf"({LETTERS}++)\s+(?={LETTERS})", rf"{LETTERS}++\s+(?=({LETTERS}++))"


def word_pairs(text: Column) -> Column:
    """The distinct pairs of words that only white space parts, in lower case, as
    ``a b``; null for a null text."""
    low = F.lower(text)
    both = F.zip_with(F.regexp_extract_all(low, F.lit(FORMER), F.lit(1)), F.regexp_extract_all(low, F.lit(LATTER), F.lit(1)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(both)


def count_pairs(texts: DataFrame, text: str, pairs: DataFrame, term: str = "term") -> DataFrame:
    """``term, texts``: how many texts hold each of pairs (distinct, as word_pairs gives
    them); those of no text are left out.

    For lists that grow with the corpus, of which an automaton would read all texts once a
    block: a text is read once, its pairs are counted before anything moves, and counts
    meet the list by a shuffle."""
    held = texts.select(F.explode(word_pairs(F.col(text))).alias(term)).groupBy(term).agg(F.count("*").alias("texts"))
    return held.join(pairs, term, "left_semi")


def select_sentences(docs: DataFrame, order: str, text: str, terms: DataFrame, term: str = "term", most: int = 3, block_bytes: int | None = None) -> DataFrame:
    """Up to most sentences for each term: ``term, rank, sentence`` (clipped around
    the match). Whole phrase first; if it is nowhere, sentences that hold all the
    term's stems. Different documents first, then book order; documents of one order
    value are one document.

    An automaton proposes the sentences of each term. Only places travel until the few
    that a term keeps are known; their sentences are then cut from the texts again."""
    cut = lambda rows: rows.select(F.col(order).alias("doc_"), F.posexplode(T.sentences(F.col(text))).alias("at_", "sentence"))
    words = F.filter(F.split(F.regexp_replace(term, r"\(.*?\)", ""), r"(?U)[\s/-]+"), lambda w: w != "")
    keyed = automaton.with_ids(terms.select(term, T.phrase_pattern(F.col(term)).alias("pattern_"), T.stems(F.col(term)).alias("stems_"), F.array_join(words, " ").alias("phrase_")))
    first = lambda hits: _first_places(hits, most)

    phrases_ = keyed.filter("phrase_ <> ''").select("id", F.array("phrase_").alias("pieces"), F.col("pattern_").alias("said"))
    exact = keep(first(automaton.find(cut(docs), F.col("sentence"), ["doc_", "at_"], phrases_, automaton.PHRASES, block_bytes)))

    rest = keep(keyed.join(exact, keyed["id"] == exact["hit"], "left_anti").filter(F.size("stems_") > 0).select("id", F.col("stems_").alias("pieces"), F.lit(None).cast("string").alias("said")))
    loose = first(automaton.find(cut(docs), F.lower("sentence"), ["doc_", "at_"], rest, automaton.PARTS, block_bytes))

    places = keep(exact.withColumn("loose_", F.lit(False)).unionByName(loose.withColumn("loose_", F.lit(True))))
    texts = cut(docs.join(places.select(F.col("doc_").alias("d_")).distinct(), F.col(order) == F.col("d_"), "left_semi"))
    found = texts.join(places, ["doc_", "at_"]).join(keyed.withColumnRenamed("id", "hit"), "hit")
    phrase_at = F.length(F.get(F.split("sentence", F.col("pattern_"), 2), F.lit(0)))
    stem_at = F.expr("instr(lower(sentence), stems_[0]) - 1")
    found = found.withColumn("pos_", F.when(F.col("loose_"), stem_at).otherwise(phrase_at)).dropDuplicates(["hit", "rank"])
    return found.select(term, "rank", T.clip(F.col("sentence"), F.col("pos_")).alias("sentence"))


def _first_places(hits: DataFrame, most: int) -> DataFrame:
    """(hit, doc_, at_, rank): the first sentence of each of a hit's first documents; where
    it has fewer documents than most, further sentences in order."""
    nth = F.row_number().over(W.partitionBy("hit", "doc_").orderBy("at_"))
    rank = F.row_number().over(W.partitionBy("hit").orderBy(F.col("n_") > 1, "doc_", "at_"))
    own = hits.select("hit", "doc_", "at_").distinct().withColumn("n_", nth).filter(F.col("n_") <= most)
    return own.withColumn("rank", rank).filter(F.col("rank") <= most).drop("n_")


def consume(target: Column, options: Column) -> Column:
    """Which options a target uses: longest first, each removed everywhere before
    the next is tried; equal lengths in order of text."""
    ordered = F.array_sort(options, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    start = F.struct(target.alias("rest"), F.array().cast("array<string>").alias("hits"))
    step = lambda acc, o: F.when(F.contains(acc["rest"], o), F.struct(F.replace(acc["rest"], o, F.lit("")).alias("rest"), F.concat(acc["hits"], F.array(o)).alias("hits"))).otherwise(acc)
    return F.aggregate(ordered, start, step, lambda acc: acc["hits"])


def term_usage(pairs: DataFrame, glossary: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``ord, term, translation, tier, segments, option_counts, missing, consistent`` for
    each glossary row (term, suggested_translation, alternatives, tier, and ord, its place,
    where the glossary has one).

    When any row has a tier, a row without one is fixed, and a fixed term's
    alternatives don't count as its translation. option_counts has every option in order,
    also those that no segment uses, and the whole translation where it is used."""
    tiered = glossary.filter("tier is not null").limit(1).select(F.lit(True).alias("tiered_"))
    terms = glossary.filter("trim(term) <> '' and trim(suggested_translation) <> ''").join(F.broadcast(tiered), F.lit(True), "left")  # one row at most
    fixed = (F.col("tier") == "fixed") | (F.col("tier").isNull() & F.col("tiered_").isNotNull())
    whole = F.trim("suggested_translation")
    parts = F.array_distinct(F.concat(T.options_of(whole), F.when(F.coalesce(fixed, F.lit(False)) | F.col("alternatives").isNull(), F.array().cast("array<string>")).otherwise(T.clean_alternatives(F.col("alternatives")))))
    ord_ = F.col("ord") if "ord" in glossary.columns else F.lit(None).cast("long")
    tier = F.when(F.col("tiered_").isNotNull(), F.coalesce("tier", F.lit("fixed")))
    terms = keep(terms.select(F.monotonically_increasing_id().alias("no_"), ord_.alias("ord"), F.trim("term").alias("term"), whole.alias("translation"), tier.alias("tier"), parts.alias("parts")))
    hits = match_terms(pairs.select(F.col(source).alias("s_"), F.col(target).alias("t_")), "s_", terms, keep_=["t_"])
    used = hits.select("no_", consume(F.coalesce(F.col("t_"), F.lit("")), F.array_union(F.col("parts"), F.array("translation"))).alias("used"))
    total = used.groupBy("no_").agg(F.count("*").alias("segments"), F.count_if(F.size("used") == 0).alias("missing"))
    counts = used.select("no_", F.explode("used").alias("option")).groupBy("no_", "option").agg(F.count("*").alias("n"))
    counts = counts.groupBy("no_").agg(F.map_from_entries(F.collect_list(F.struct("option", "n"))).alias("met"))  # a term's few options
    out = terms.join(total, "no_", "left").join(counts, "no_", "left")
    n = lambda o: F.coalesce(F.try_element_at(F.col("met"), o), F.lit(0)).cast("bigint")
    shown = F.concat("parts", F.when((n(F.col("translation")) > 0) & ~F.array_contains("parts", F.col("translation")), F.array("translation")).otherwise(F.array().cast("array<string>")))
    options = F.map_from_entries(F.transform(shown, lambda o: F.struct(o.alias("key"), n(o).alias("value"))))
    missing = F.coalesce("missing", F.lit(0)).cast("bigint")
    one = F.coalesce(F.size("met"), F.lit(0)) <= 1
    return out.select("ord", "term", "translation", "tier", F.coalesce("segments", F.lit(0)).cast("bigint").alias("segments"), options.alias("option_counts"), missing.alias("missing"), ((missing == 0) & one).alias("consistent"))


def glossary_cap(entries: DataFrame, max_terms: int) -> DataFrame:
    """The first entries by fixed tier, number of vendors, priority and key."""
    order = [F.coalesce(F.col("tier"), F.lit("fixed")) != "fixed", F.desc("n_vendors"), T.priority_rank(F.col("priority")), T.term_key(F.col("term"))]
    return entries.orderBy(*order).limit(max_terms)
