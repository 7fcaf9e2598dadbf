"""A corpus pipeline of five stages over `documents`. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packmill.llm import decontaminate, mixing, sharding, simhash, toxicity
from packmill.llm.common import spread, table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the sources have their weights in the mix."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's region, rack and shard."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL has neither the classifier nor the tokenizer nor the fingerprints: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their shards: one row for each document of the mix.

    Rows with nulls are defined stage by stage: a null text is not toxic, has no copies and no passages, and is
    not taken into the mix; a null source is a source of its own; a null doc_id is kept up to the mix and drawn
    there by its text. Extra columns stay as they are, whatever their names. Empty documents give no rows.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
