"""Cleaning a corpus: STAGES over documents, each on all that the one before kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import byte_bpe, decontaminate, jaccard_join, language_id, quality
from vecloom.llm.common import remove, shared_folder, table
from vecloom.llm.queries import remainder

#: A text of at least so many characters that needs more phrases a character than this is in no learned language.
MIN_CHARS, MAX_PHRASE_RATE = 20, 0.5


def packed(docs: DataFrame) -> DataFrame:
    """docs as one column, row, beside which no operator's columns can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier gives label 0.

    A null text is scored as the empty one; empty and very long texts have scores like all others, of their whole
    text. Every row is judged by its own text, so rows that share a doc_id, or have none, go or stay each for itself, and repeated rows alike.
    An empty table stays empty; without labels of both kinds nothing is learned and the share of label 1 decides for all."""
    network = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    found = quality.score_quality(packed(docs), network, F.col("row.text"))
    return found.filter("predicted = 1").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and longer ones that resemble no learned language.

    A null or empty text has no letter. Ties between languages don't matter here. Every row is judged by its own
    whole text; rows that share a doc_id or have none are kept or dropped each for itself. An empty table stays empty; with no
    labelled text at all no language is known, and every document is dropped."""
    samples = language_id.sample_languages(docs, remainder("doc_id", 3) != 1)
    found = language_id.identify(packed(docs), samples, F.col("row.text"))
    strange = (F.length("row.text") >= MIN_CHARS) & (F.col("phrase_rate") > MAX_PHRASE_RATE)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & ~strange).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document, that of the least doc_id, of each group of near duplicates.

    Rows without a doc_id or without a word stay; repeated rows (doc_id and text alike) become one; rows that share a
    doc_id go or stay each by its own text. Texts are compared whole. An empty table stays empty."""
    return jaccard_join.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, of one without an id too.

    Null and empty texts hold none and stay, as do repeated rows and rows without a doc_id that hold none. An empty table, or an empty
    benchmark, drops nothing."""
    found = decontaminate.find_contamination(packed(docs), table(spark, sf_dir, "benchmark"), F.col("row.text"), unnamed=True)
    return decontaminate.remove_contamination(found).select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as counts and digests of ids and decoded bytes: a row for each row, repeated ones too.

    A null text counts as empty: no ids, and the digests of nothing."""
    encoded = byte_bpe.encode_digests(docs.select("doc_id", "text"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("byte_bpe", bpe_stage)]
#: Trained classifiers and component ids have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written to the shared folder and read again, and the one before it removed."""
    folder, docs, before = shared_folder(spark), table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        after = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(after)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(after), after
    return STAGES[-1][1](spark, docs, sf_dir)
