"""Fusion of ranked lists, confidence, and the retrieve-judge-reformulate loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packmill.functions.texts import keywords
from packmill.operators.retrieval import top

RRF_K = 60
CONFIDENT = 1.10


def fuse(lists: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score, first_list): reciprocal-rank fusion of (query_id, list_no, rank, id), rank from 1."""
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"), F.min_by("list_no", F.struct("list_no", "rank")).alias("first_list"))
    return fused if k is None else top(fused, ["query_id"], k, tie="id")


def confident(results: DataFrame, ratio: float = CONFIDENT) -> DataFrame:
    """(query_id, confident): the first score is `ratio` times the second, or the second is not above 0; fewer than two results are not."""
    s = results.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    return s.select("query_id", F.coalesce((F.col("s2") <= 0) | (F.col("s1") >= ratio * F.col("s2")), F.lit(False)).alias("confident"))


def reformulating(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], k: int, reformulate=keywords, ratio: float = CONFIDENT) -> DataFrame:
    """(query_id, id, score, first_list): queries (query_id, text) whose first results are not confident are asked again in other words, and both lists are fused.

    retrieve gives (query_id, rank, id, score). Confident queries keep their first list, in fused form too.
    """
    first = retrieve(queries)
    unsure = queries.join(confident(first, ratio).filter("confident"), "query_id", "left_anti")
    again = retrieve(unsure.withColumn("text", reformulate(F.col("text"))).filter("text is not null"))
    lists = first.withColumn("list_no", F.lit(0)).unionByName(again.withColumn("list_no", F.lit(1)))
    return fuse(lists.select("query_id", "list_no", "rank", "id"), k)


def best_variant(scored: DataFrame) -> DataFrame:
    """(query_id, variant, id, score): of all variants' results the best one, the first variant among equals."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "variant", "id")
    return scored.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def rerank_by_text(results: DataFrame, score) -> DataFrame:
    """Results (query_id, rank, id, query, text) by score(query, text); those without a text follow in their old order."""
    scored = results.withColumn("text_score", F.when(F.col("text").isNotNull(), score(F.col("query"), F.col("text"))))
    order = Window.partitionBy("query_id").orderBy(F.col("text").isNull(), F.desc_nulls_last("text_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).select("query_id", F.col("new_rank").alias("rank"), "id", "text_score")
