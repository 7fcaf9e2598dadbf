"""Streams over event tables: buffered writes, governance state for each pack, and watermarked windows.

Every stream checkpoints in the shared folder and ends when it has read what there is (availableNow);
a service would give another trigger. Batches are written by batch number, so a batch that is run
again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors.exceptions.captured import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packmill.functions.governance import DAILY, DEMOTE, MAX_DAYS, PROMOTE, READ, WRITE
from packmill.sources.shared import exists, hadoop, new_dir


def file_stream(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """New files of a Parquet table, a directory or one file, as they come."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    fs, p = hadoop(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_into(stream: DataFrame, path: str, mode: str = "append", partition: str = "batch") -> DataFrame:
    """Runs a stream over what there is into a Parquet table at path, with the batch's number as a column; the table."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{partition}={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_dir(spark, "stream")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add(partition, "long")).parquet(path)


def buffered(stream: DataFrame) -> DataFrame:
    """The stream's rows, appended micro-batch by micro-batch."""
    return run_into(stream, new_dir(stream.sparkSession, "buffer"))


def step(importance: float, tier: int, action: str, days: int) -> tuple[float, int]:
    """One event of a pack's history: functions.governance.fold, for one state."""
    if action == "days":
        importance *= DAILY ** min(max(days, 0), MAX_DAYS)
    else:
        importance += READ if action == "read" else WRITE
    importance = min(max(importance, 0.0), 100.0)
    tier = 2 if importance >= PROMOTE[1] else max(tier, 1) if importance >= PROMOTE[0] else tier
    if tier == 2 and importance < DEMOTE[1]:
        tier = 0 if importance < DEMOTE[0] else 1
    elif tier == 1 and importance < DEMOTE[0]:
        tier = 0
    return importance, tier


def governance(stream: DataFrame) -> DataFrame:
    """(pack_id, importance, tier, seen) updates from a stream of events (pack_id, salience, ts, event_id, action, days).

    A pack's state begins at its salience, as a write makes it; events of one batch are taken in order of (ts, event_id).
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        importance, tier, seen = state.get if state.exists else (*step(float(rows["salience"].iloc[0]), 0, "write", 0), 0)
        for action, days in zip(rows["action"], rows["days"]):
            importance, tier = step(importance, tier, action, int(days))
        seen += len(rows)
        state.update((importance, tier, seen))
        yield pd.DataFrame({"pack_id": [key[0]], "importance": [importance], "tier": [tier], "seen": [seen]})

    return stream.groupBy("pack_id").applyInPandasWithState(update, "pack_id bigint, importance double, tier int, seen bigint", "importance double, tier int, seen bigint", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, by: list[str]) -> DataFrame:
    """The last update of each key."""
    order = Window.partitionBy(*by).orderBy(F.desc("batch"))
    return updates.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "batch")


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n) updates of tumbling windows; rows later than the watermark are left out."""
    seen = stream.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def idempotent(stream: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all requests, what was done) for a stream of requests: each key is done once, however often it is asked for.

    A batch does what is not done yet and writes it under its own number, so a batch that is run again after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    log, done = new_dir(spark, "log"), new_dir(spark, "done")
    schema = stream.schema.add("batch", "long")

    def work(rows: DataFrame, batch: int) -> None:
        new = rows.dropDuplicates(key)
        if exists(spark, done):
            new = new.join(spark.read.schema(schema).parquet(done).filter(F.col("batch") < batch), key, "left_anti")
        new.select(*rows.columns).write.mode("overwrite").parquet(f"{done}/batch={batch}")
        rows.write.mode("overwrite").parquet(f"{log}/batch={batch}")

    stream.writeStream.option("checkpointLocation", new_dir(spark, "jobs")).trigger(availableNow=True).foreachBatch(work).start().awaitTermination()
    return spark.read.schema(schema).parquet(log).drop("batch"), spark.read.schema(schema).parquet(done).drop("batch")


def ingest(stream: DataFrame, path: str, fail_after: int | None = None) -> tuple[bool, bool]:
    """Runs a stream into a table, its files per trigger being the depth of the queue: (failed once, ended well).

    The sink's error ends the run and reaches the caller; the next run goes on from the checkpoint. fail_after makes the sink fail at that batch, once.
    """
    failures = [fail_after]
    checkpoint = new_dir(stream.sparkSession, "ingest")

    def write(rows: DataFrame, batch: int) -> None:
        if failures[0] is not None and batch >= failures[0]:
            failures[0] = None
            raise OSError("the sink is full")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    def run() -> bool:
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            return False
        return True

    ended = run()
    return not ended, run() if not ended else ended
