"""How the test tables stand for the engine's data, in Spark and in SQL.

A vector is a cell (owner = label); five consecutive vectors are a multi-vector cell and a pack; a
pack's text is the document of its id; events are its history of reads, writes and days. Everything is
over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.functions import governance as G
from packmill.sources.shared import spread

__all__ = ["QUERIES", "SQL", "query", "spread", "table"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").cast("long").alias("owner"), F.col("embedding").cast("array<double>").alias("key"))


def mcells(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 5").alias("cell_id"), "vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return e.groupBy("cell_id").agg(F.min_by("label", "vec_id").alias("owner"), F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("tokens"))


def as_queries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("cell_id", "query_id")


def pack_cells(spark: SparkSession, d: str) -> DataFrame:
    return mcells(spark, d).withColumn("pack_id", F.col("cell_id") + 1)


def pack_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(F.countDistinct(F.expr("vec_id div 5")).alias("n"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """(pack_id, ts, event_id, action, days)"""
    e = table(spark, d, "events").crossJoin(F.broadcast(pack_count(spark, d)))
    kind = F.col("event_type")
    action = F.when(kind.isin("click", "view"), "read").when(kind == "purchase", "write").otherwise("days")
    days = F.when(kind == "signup", 20).when(kind == "error", 45).otherwise(0)
    return e.select((F.col("event_id") % F.col("n") + 1).alias("pack_id"), "ts", "event_id", action.alias("action"), days.alias("days"))


def packs(spark: SparkSession, d: str) -> DataFrame:
    """(pack_id, owner, salience, importance, tier, days): each pack after its history."""
    base = pack_cells(spark, d).select("pack_id", "owner", (F.col("pack_id") * 37 % 61 + 20).cast("double").alias("salience"), (F.col("pack_id") * 13 % 90 + 0.5).cast("double").alias("days"))
    log = history(spark, d).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "action", "days"))).alias("events"))
    none = F.array().cast("array<struct<ts: timestamp, event_id: bigint, action: string, days: int>>")
    state = G.fold(F.coalesce("events", none), G.written(F.col("salience")))
    return base.join(log, "pack_id", "left").withColumn("g", state).select("pack_id", "owner", "salience", F.col("g.importance").alias("importance"), F.col("g.tier").alias("tier"), "days")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("pack_id"), "text")


def pack_edges(spark: SparkSession, d: str) -> DataFrame:
    p = pack_cells(spark, d).select("pack_id").crossJoin(F.broadcast(pack_count(spark, d)))
    i, n = F.col("pack_id"), F.col("n")
    a = p.select(i.alias("src"), (i * 7 % n + 1).alias("dst"), (i % 4).cast("int").alias("edge_type"))
    b = p.select(i.alias("src"), ((i * 11 + 3) % n + 1).alias("dst"), ((i + 1) % 4).cast("int").alias("edge_type"))
    return a.unionByName(b).withColumn("ts", F.col("src"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("node", F.col("conv_id") * 1000 + F.col("turn"))


def bench_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a benchmark run: (system, dataset, category, item_id, replicate, status, score)."""
    x = table(spark, d, "lineitem")
    status = F.when(F.col("l_discount") < 0.005, "failed").when(F.col("l_discount") < 0.015, "skipped").otherwise("ok")
    return x.select(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("dataset"), F.when(F.col("l_quantity") > 5, F.concat(F.lit("c"), F.expr("l_partkey % 7"))).alias("category"), F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("replicate"), status.alias("status"), (F.col("l_tax") * 12.5).alias("score"))


CELLS = "cells AS (SELECT vec_id AS cell_id, label::BIGINT AS owner, CAST(embedding AS DOUBLE[]) AS key FROM embeddings)"
MCELLS = "mcells AS (SELECT vec_id // 5 AS cell_id, arg_min(label, vec_id)::BIGINT AS owner, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS tokens FROM embeddings GROUP BY 1)"
TOKENS = "tok AS (SELECT vec_id // 5 AS cell_id, vec_id % 5 AS tok_at, CAST(embedding AS DOUBLE[]) AS t FROM embeddings)"
DOTS = f"{MCELLS}, {TOKENS}, dots AS (SELECT a.cell_id AS query_id, a.tok_at AS q_at, b.cell_id, b.tok_at AS c_at, list_inner_product(a.t, b.t) / sqrt(len(a.t)::DOUBLE) AS s FROM tok a CROSS JOIN tok b)"
TOP5 = f"{DOTS}, ranked5 AS (SELECT *, row_number() OVER (PARTITION BY query_id, cell_id ORDER BY s DESC) AS r FROM dots), scores AS (SELECT query_id, cell_id, round(avg(s), 6) AS score FROM ranked5 WHERE r <= 5 GROUP BY ALL)"
_TIER = "CASE WHEN up = 2 AND imp < 60 THEN CASE WHEN imp < 35 THEN 0 ELSE 1 END WHEN up = 1 AND imp < 35 THEN 0 ELSE up END"
_UP = "CASE WHEN imp >= 85 THEN 2 WHEN imp >= 65 THEN greatest(tier, 1) ELSE tier END"
PACKS = f"""n_packs AS (SELECT count(DISTINCT vec_id // 5) AS n FROM embeddings),
base AS (SELECT vec_id // 5 + 1 AS pack_id, arg_min(label, vec_id)::BIGINT AS owner, ((vec_id // 5 + 1) * 37 % 61 + 20)::DOUBLE AS salience, ((vec_id // 5 + 1) * 13 % 90)::DOUBLE + 0.5::DOUBLE AS days FROM embeddings GROUP BY vec_id // 5),
ev AS (SELECT event_id % n + 1 AS pack_id, event_type, row_number() OVER (PARTITION BY event_id % n ORDER BY ts, event_id) AS i FROM events, n_packs),
state AS (
  SELECT pack_id, 0::BIGINT AS i, imp AS importance, ({_TIER})::INTEGER AS tier FROM (SELECT *, {_UP} AS up FROM (SELECT pack_id, least(100.0, salience + 5)::DOUBLE AS imp, 0 AS tier FROM base))
  UNION ALL
  SELECT pack_id, i, imp, ({_TIER})::INTEGER FROM (SELECT *, {_UP} AS up FROM (
    SELECT s.pack_id, e.i, s.tier, CASE WHEN event_type IN ('click', 'view') THEN least(100.0, importance + 3) WHEN event_type = 'purchase' THEN least(100.0, importance + 5) WHEN event_type = 'signup' THEN importance * pow(0.995::DOUBLE, 20) ELSE importance * pow(0.995::DOUBLE, 45) END::DOUBLE AS imp
    FROM state s JOIN ev e ON e.pack_id = s.pack_id AND e.i = s.i + 1))),
packs AS (SELECT b.pack_id, b.owner, b.salience, s.importance, s.tier, b.days FROM base b JOIN (SELECT pack_id, arg_max(importance, i) AS importance, arg_max(tier, i) AS tier FROM state GROUP BY pack_id) s ON s.pack_id = b.pack_id)"""
EDGES = """n_packs2 AS (SELECT count(DISTINCT vec_id // 5) AS n FROM embeddings), ids AS (SELECT DISTINCT vec_id // 5 + 1 AS i, n FROM embeddings, n_packs2),
edges AS (SELECT i AS src, i * 7 % n + 1 AS dst, (i % 4)::INTEGER AS edge_type, i AS ts FROM ids UNION ALL SELECT i, (i * 11 + 3) % n + 1, ((i + 1) % 4)::INTEGER, i FROM ids)"""
LINKS = "both_ways AS (SELECT src AS pack_id, dst AS other, edge_type FROM edges WHERE src <> dst UNION SELECT dst, src, edge_type FROM edges WHERE src <> dst), links AS (SELECT DISTINCT pack_id, other FROM both_ways)"
BENCH = "rows_ AS (SELECT l_returnflag AS system, l_linestatus AS dataset, CASE WHEN l_quantity > 5 THEN 'c' || (l_partkey % 7) END AS category, l_orderkey AS item_id, l_linenumber AS replicate, CASE WHEN l_discount < 0.005 THEN 'failed' WHEN l_discount < 0.015 THEN 'skipped' ELSE 'ok' END AS status, l_tax * 12.5 AS score FROM lineitem)"
TURNS = "turns AS (SELECT *, conv_id * 1000 + turn AS node FROM conversations)"
