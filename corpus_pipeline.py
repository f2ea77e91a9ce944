"""A corpus pipeline from the operators of bitlake.llm: each stage's output is written and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. Stages read ``labels`` from sf_dir where they need it. Edge cases (nulls, empty and very
long texts, repeated rows, empty tables) are those of the operators, as their modules state them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitlake.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from bitlake.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def first_of_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_neardup", one_of_near_duplicates),
    ("suffix_array_dedup", first_of_repeats),
    ("mix_sources", mix_to_targets),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express near-duplicate components, tokenisation and packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
