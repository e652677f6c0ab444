"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import dedup, mixing, near, packing, toxicity
from panelforge.llm.common import Scratch, read_table
from panelforge.llm.queries import MIX_TARGETS, mix_domains


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one with the smallest doc_id."""
    return near.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates, none dropped: the least rate is 1."""
    mix = mixing.fit_mixture(docs, mix_domains(read_table(spark, sf_dir, "labels")), MIX_TARGETS, least=1.0)
    return mixing.apply_rates(docs, mix)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document that is left."""
    return packing.pack_power_of_two(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet in the shared folder and read again; a stage's table is removed when the next one is written."""
    docs, written = read_table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written.keep(stage(spark, docs, sf_dir))
        if k:
            written.drop(k - 1)
    return docs
