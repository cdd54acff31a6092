"""A training corpus from documents: five operators of tallyspark.llm, one after the other.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import lang_ftrl, mixing, near_dup, piece_codec, quality_rff
from tallyspark.llm._common import stash, table
from tallyspark.llm.queries import PIECE_VOCABULARY, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.5) go."""
    return quality_rff.keep_quality(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or with a score below 0.4, go."""
    return lang_ftrl.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix (mix_place: from 0): sources that are used up leave the rest in proportion."""
    return mixing.mix(docs, place="mix_place")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, intact, source, mix_place: files hold ranges of places in the mix, in ascending order."""
    laid = docs.repartitionByRange("mix_place").sortWithinPartitions("mix_place")  # files of the mix are not read in their order
    return piece_codec.encode_documents(laid, vocabulary(PIECE_VOCABULARY), keep=["source", "mix_place"])


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("pieces", pieces)]

#: None: classifiers, near duplicates by full sets and merge-dropout are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
