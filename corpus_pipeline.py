"""Corpus preparation as a chain of stages, each working on all that its predecessor kept.

Language identification, near-duplicates, benchmark decontamination, personal data, token ids. Stages run on their own
too: (spark, docs, sf_dir) -> rows; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.llm import bpe, decontaminate, language, pii, simhash
from prepspark.llm.common import load, ship
from prepspark.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays doubtful."""
    ship(spark)
    train = docs.where(~language.held_out(F.col("doc_id"))).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    return language.accepted(docs, language.fit(train))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    ship(spark)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text."""
    ship(spark)
    return pii.redact(docs, pii.fit(docs), size="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the digests of ids and decoded text."""
    ship(spark)
    return bpe.encode_decode(docs, ["doc_id", "lang", "source"], outputs=("ids", *bpe.DIGESTS))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("token_ids", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written before the next stage reads it, as stages read their input repeatedly."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
