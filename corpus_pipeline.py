"""A pipeline from documents to token ids: quality, language, near copies, source mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next stage's docs. All but the last
return the columns of documents. Mixing decides the order: its rows, and so those of token ids, are in the order of the mixture. NULLs, extra columns and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.common import drop_stored, in_file_order, read, stored
from riskloom.llm.langid import in_known_language
from riskloom.llm.mixing import mixed
from riskloom.llm.piece import encode_documents
from riskloom.llm.quality import good_documents
from riskloom.llm.simhash import without_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted to the labelled ones, rejects."""
    return good_documents(docs, read(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in none of the corpus's languages."""
    return in_known_language(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies."""
    return without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture, in which every stretch keeps its sources' target weights; each comes once."""
    return mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, lossless) of every document left, in the order of docs, which is the mixture's."""
    return encode_documents(in_file_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]
#: The trained classifiers, the fingerprints and the tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result but the last is a Parquet table in the shared folder."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
