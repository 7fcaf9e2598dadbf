"""What the operators share: the folder all executors see, tables that cut lineage, worker caches."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.sources.shared import new_dir, remove, shared_dir, spread, written

__all__ = ["BATCH_BYTES", "BROADCAST_BYTES", "cached", "fresh", "new_dir", "remove", "shared_dir", "small_batches", "spread", "table", "unit_hash", "unit_hash_sql", "worker_cache", "written"]

#: Broadcast only what is at most this large; each operator has another way beyond it.
BROADCAST_BYTES = 64 << 20

#: Bytes of an Arrow batch that goes to a Python worker: what a worker holds follows from it, not from how long texts are.
BATCH_BYTES = 4 << 20
_MOST = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_BYTES (a smaller setting stays): long texts then come a few at a time."""
    spark = df.sparkSession
    if int("".join(c for c in spark.conf.get(_MOST) if c.isdigit())) > BATCH_BYTES:
        spark.conf.set(_MOST, BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker and is shared by its tasks."""
    return sys.modules.setdefault("_packmill_worker", types.ModuleType("_packmill_worker")).__dict__


def cached(key: str, make):
    """make(), once for each worker and key; only the latest few keys are kept."""
    cache = worker_cache()
    kept = cache.setdefault("kept", {})
    if key not in kept:
        while len(kept) >= 3:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]


def unit_hash(*parts: Column) -> Column:
    """A draw in (0, 1) that any SQL engine with md5 can repeat: 52 bits of the md5 of the parts joined by '|'."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def unit_hash_sql(*parts: str) -> str:
    """unit_hash in DuckDB's SQL."""
    joined = " || '|' || ".join(parts)
    return f"((('0x' || substr(md5({joined}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"
