"""Corpus pipeline: documents → good → one of each near-duplicate group → pseudonyms → mix → token ids.

``STAGES`` are functions of ``(spark, docs, sf_dir)``; each one's rows are written as Parquet and reread as
the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wholesail.llm import mixing, near_order_minhash, pii_feistel, quality_pu, sentencepiece_rounds
from wholesail.llm.common import stored, table
from wholesail.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``docs`` and the labels, accepts."""
    configure(spark)
    return quality_pu.accept(docs, quality_pu.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    configure(spark)
    return near_order_minhash.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; ``n_chars`` follows."""
    configure(spark)
    return pii_feistel.pseudonymise_column(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as the schedule takes it."""
    configure(spark)
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row of the mix."""
    configure(spark)
    return sentencepiece_rounds.encode(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
