"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths only: functions of this module travel to workers by value, and a session may not.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, as a URI of the cluster's file system. Where it is unset (tests), a folder of this machine.

    A cluster without the setting gets an error: a machine's own folder is not seen by the others.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="packmill-")
        spark.conf.set("spark.checkpoint.dir", named)
        _made.append(named)
    fs, p = hadoop(spark, named)
    return fs.makeQualified(p).toString().rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A path not used before in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/packmill/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    (fs, a), (_, b) = hadoop(spark, old), hadoop(spark, new)
    if not fs.rename(a, b):
        raise OSError(f"{old} cannot be renamed to {new}")


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:  # the session ended first; its folder is then the cluster's to clean
        return
    for path in _made:
        try:
            remove(spark, path)
        except Exception:
            return


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and lost executors cost no more than their tasks."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table that has fewer splits than there are cores, dealt out to them; what is larger stays where it lies."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Bytes of an Arrow batch that goes to a Python worker, so that what a worker holds does not follow the number of rows.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_BYTES (a smaller setting stays)."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if int("".join(c for c in spark.conf.get(name) if c.isdigit())) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)
    return df
