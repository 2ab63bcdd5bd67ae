"""From raw documents to tokens, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostlens.llm import mixing, pieces, quality_model, quality_rules, simhash
from hostlens.llm.common import table
from hostlens.sources.store import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail a rule nor come from a failing host."""
    return quality_rules.accepted(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good."""
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What remains, with its pieces and their places in the text."""
    return pieces.encoded(docs, pieces.default_model())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("sentencepiece", tokens),
]

#: hashing, boosted trees and tokenising have no SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
