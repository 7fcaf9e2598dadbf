"""Retrieve, then read: evidence to a prompt, an answer from a given column function, and a status for each item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packmill.functions import texts as X

NO_EVIDENCE, FAILED = "no_evidence", "generator_failed"


def retrieve_then_read(items: DataFrame, results: DataFrame, generate: Callable[[Column], Column], inner_k: int = 25, prompt_k: int = 10, outer_k: int = 5) -> DataFrame:
    """(query_id, answer, evidence, status, error) for items (query_id, question, status, error) and their results (query_id, rank, text).

    Up to inner_k results are read; the first prompt_k distinct texts that are not blank make the prompt, and
    outer_k are shown as evidence. An item whose own status is not "ok" keeps it; without usable evidence an
    item fails, and so it does where generate() gives null. generate takes the prompt, and may be any
    column function, such as a Pandas UDF around a model.
    """
    ranked = results.filter(F.col("rank") <= inner_k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("all"))
    met = items.join(ranked, "query_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    sound = F.slice(F.array_distinct(F.filter(F.transform("all", lambda t: F.trim(t)), lambda t: t != "")), 1, prompt_k)
    met = met.withColumn("used", sound).withColumn("ready", (F.col("status") == "ok") & (F.size("used") > 0))
    read = met.withColumn("answer", F.when(F.col("ready"), generate(X.prompt(F.col("question"), F.col("used")))))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("ready") & F.col("answer").isNotNull(), "ok").otherwise("failed")
    error = F.when(F.col("status") != "ok", F.col("error")).when(~F.col("ready"), NO_EVIDENCE).when(F.col("answer").isNull(), FAILED)
    return read.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.slice("all", 1, outer_k).alias("evidence"), status.alias("status"), error.alias("error"))
