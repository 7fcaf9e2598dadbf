"""ST1, ST5, ST8 and an extension: streams, run over all files there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from packmill.queries.base import MCELLS, PACKS, pack_cells, query, table
from packmill.sources.shared import new_dir
from packmill.streaming import streams as S


def _events(spark, d):
    return S.file_stream(spark, f"{d}/events.parquet")


@query("ST1_buffered_writes", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_ids FROM events GROUP BY 1")
def buffered(spark, d):
    return S.buffered(_events(spark, d)).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("distinct_ids"))


@query("ST5_streamed_governance", f"WITH RECURSIVE {PACKS} SELECT pack_id, round(importance, 6) AS importance, tier FROM packs WHERE pack_id IN (SELECT event_id % n + 1 FROM events, n_packs)")
def governance(spark, d):
    n = pack_cells(spark, d).count()
    kind = F.col("event_type")
    pack = F.col("event_id") % n + 1
    days = F.when(kind == "signup", 20).when(kind == "error", 45).otherwise(0)
    action = F.when(kind.isin("click", "view"), "read").when(kind == "purchase", "write").otherwise("days")
    rows = _events(spark, d).select(pack.alias("pack_id"), (pack * 37 % 61 + 20).cast("double").alias("salience"), "ts", "event_id", action.alias("action"), days.alias("days"))
    got = S.run_into(S.governance(rows), new_dir(spark, "governance"), "update")
    return S.latest(got, ["pack_id"]).select("pack_id", F.round("importance", 6).alias("importance"), "tier")


@query("ST8_refresh", f"WITH {MCELLS} SELECT count(*) AS packs FROM mcells")
def refresh(spark, d):
    """A table is re-read as it is now: whatever other writers have committed is seen."""
    path = f"{d}/embeddings.parquet"
    spark.catalog.refreshByPath(path)
    return table(spark, d, "embeddings").select(F.expr("vec_id div 5").alias("c")).distinct().agg(F.count("*").alias("packs"))


@query("ext_windowed_events", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed(spark, d):
    rows = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    got = S.run_into(S.windowed_counts(rows, late="3650 days"), new_dir(spark, "windows"), "update")
    return S.latest(got, ["start", "event_type"]).withColumn("start", F.unix_micros("start"))


@query("ST6_due_jobs", "SELECT event_id % 97 AS job, count(*) AS times, 1 AS done FROM events GROUP BY 1")
def due_jobs(spark, d):
    """Jobs named by events, at least once each: a job that is asked for again, or in a batch that is repeated, is done once."""
    rows = _events(spark, d).select((F.col("event_id") % 97).alias("job"))
    log, done = S.idempotent(rows, ["job"])
    return log.groupBy("job").agg(F.count("*").alias("times")).join(done.groupBy("job").agg(F.count("*").alias("done")), "job")


@query("ST7_ingest_queue", "SELECT count(*) AS rows, true AS failed, true AS resumed FROM events")
def ingest_queue(spark, d):
    """Files are taken a few at a time; a sink that fails stops the stream with its error, and a new run goes on where that one was."""
    src, out = new_dir(spark, "queue"), new_dir(spark, "taken")
    table(spark, d, "events").repartition(6).write.parquet(src)
    stream = S.file_stream(spark, src, per_trigger=2)
    failed, resumed = S.ingest(stream, out, fail_after=1)
    return spark.read.parquet(out).agg(F.count("*").alias("rows")).select("rows", F.lit(failed).alias("failed"), F.lit(resumed).alias("resumed"))
