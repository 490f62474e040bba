"""From raw documents to token ids in five stages, each written as Parquet and
read again before the next.

For all stages: an empty table gives an empty table of the same columns; rows are
judged by their whole text, so ties and repeated rows get equal decisions, and
rows that repeat an id and its text are one document, kept or dropped together;
columns other than those of documents are left out at the start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import _base, catalog, decontaminate, language_id, line_dedup, ngram_jaccard, sentencepiece_codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The near-duplicate stage: five words, four fifths in common.
WORDS, PERCENT = 5, 80

#: Stages with kernels and segmentation have no SQL form.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a determined language (null, or no letter at all) go, no others:
    where no row has a language to learn, all texts with a letter stay."""
    model = language_id.fit(language_id.sample(docs, catalog.crc_slot("doc_id", 4) != 2))
    if not model.languages:
        model = language_id.unlearned()
    return language_id.identify(docs, model, keep=COLUMNS).filter(F.col("lang_pred") != language_id.UNDETERMINED).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in the last only. A null text
    becomes an empty one; a null id sorts before all others."""
    out = line_dedup.dedup(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each linked group stays, a null id only where the
    group has no other. Documents without words link with nothing and stay."""
    found = ngram_jaccard.components(docs, words=WORDS, percent=PERCENT)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay_")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_")), "left_semi").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; others, and those
    without words, stay whole."""
    hits = decontaminate.find_hits(docs, _base.table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return hits.filter(~decontaminate.contaminated()).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of what they decode to; an empty text has no ids."""
    out = sentencepiece_codec.encode(docs, catalog.tokenizer_model(), keep=["doc_id", "lang", "source"], decoded=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language identification", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = _base.Scratch(spark)
    docs = _base.table(spark, sf_dir, "documents").select(COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
