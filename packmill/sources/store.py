"""Durable tables of a memory store: append-only Parquet directories with derived views.

A write is one Parquet append with its commit protocol; a deletion is a row in `deletions`; the last
text of a pack wins; nothing is changed in place. Compaction rewrites files in which few rows live.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.sources.shared import exists, hadoop, remove, rename

SCHEMAS = {
    "cells": "cell_id bigint, pack_id bigint, owner bigint, layer int, key array<double>, tokens array<array<double>>, value array<double>, created_at bigint, tags bigint, is_retrieval boolean, is_view boolean",
    "packs": "pack_id bigint, owner bigint, salience double, importance double, tier int, created_at bigint",
    "layers": "pack_id bigint, layer_idx int, data array<double>",
    "texts": "pack_id bigint, text string, seq bigint",
    "deletions": "pack_id bigint, seq bigint",
    "edges": "src bigint, dst bigint, edge_type int, ts bigint",
    "access_log": "pack_id bigint, action string, days int, seq bigint",
    "schedule": "id bigint, fires_at bigint, action string, owner bigint, threshold double, state string, seq bigint",
    "synapses": "id bigint, owner bigint, lora_a array<float>, lora_b array<float>, scale float, rank int, d_model int, last_used bigint, quality float",
    "clock": "days double, seq bigint",
}


class Store:
    """Tables below a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table_path(self, name: str) -> str:
        return f"{self.path}/{name}"

    def read(self, name: str) -> DataFrame:
        path = self.table_path(name)
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(path)

    def append(self, name: str, rows: DataFrame, files_of: int | None = None, bytes_of: int | None = None) -> None:
        """One append job. Columns that rows lack are null; files_of is the most rows of a file, bytes_of about its most bytes, by the rows' mean size as text."""
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        have = set(rows.columns)
        rows = rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields))
        if bytes_of:
            mean = rows.agg(F.avg(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 1
            files_of = max(1, int(bytes_of / mean))
        writer = rows.write.mode("append")
        (writer.option("maxRecordsPerFile", files_of) if files_of else writer).parquet(self.table_path(name))

    def live(self, name: str) -> DataFrame:
        """Rows of packs that are not deleted; rows of no pack stay."""
        return self.read(name).join(self.read("deletions").select("pack_id").distinct(), "pack_id", "left_anti")

    def texts(self) -> DataFrame:
        return self.live("texts").groupBy("pack_id").agg(F.max_by("text", "seq").alias("text"))

    def edges(self) -> DataFrame:
        """(src, dst, edge_type, ts): the log replayed; an edge that was appended again counts once, from its first time."""
        return self.read("edges").filter("src is not null and dst is not null").groupBy("src", "dst", "edge_type").agg(F.min("ts").alias("ts"))

    def checkpoint_edges(self) -> int:
        """Replaces the log by what it replays to; how many edges. Readers see the old files or the new ones: the new table is complete before it takes the old one's place."""
        fresh, old = f"{self.path}/_edges-new", f"{self.path}/_edges-old"
        for path in (fresh, old):
            remove(self.spark, path)
        self.edges().write.parquet(fresh)
        if exists(self.spark, self.table_path("edges")):
            rename(self.spark, self.table_path("edges"), old)
        rename(self.spark, fresh, self.table_path("edges"))
        remove(self.spark, old)
        self.spark.catalog.refreshByPath(self.table_path("edges"))
        return self.read("edges").count()

    def files(self, name: str) -> DataFrame:
        """(file, rows, live): how many rows of each file live."""
        dead = self.read("deletions").select("pack_id").distinct().withColumn("dead", F.lit(True))
        rows = self.read(name).select("pack_id", F.input_file_name().alias("file")).join(dead, "pack_id", "left")
        return rows.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.col("dead").isNull()).alias("live"))

    def compact(self, name: str, live_ratio: float = 0.5) -> dict:
        """Rewrites the files of which less than live_ratio lives: {files, rows_dropped}. Running it again finds nothing to do.

        The live rows are written beside the table and moved in before the old files go, under new names: nothing is
        ever missing, but a reader in between may see a row twice, so compact when no one reads.
        """
        worn = self.files(name).filter(F.col("live") < live_ratio * F.col("rows")).collect()
        if not worn:
            return {"files": 0, "rows_dropped": 0}
        paths = [r["file"] for r in worn]
        fresh = f"{self.path}/_compacting-{name}"
        remove(self.spark, fresh)
        kept = self.spark.read.schema(SCHEMAS[name]).parquet(*paths).join(self.read("deletions").select("pack_id").distinct(), "pack_id", "left_anti")
        kept.write.parquet(fresh)
        fs, folder = hadoop(self.spark, fresh)
        for status in fs.listStatus(folder):
            file = status.getPath().getName()
            if file.endswith(".parquet"):
                rename(self.spark, f"{fresh}/{file}", f"{self.table_path(name)}/{file}")
        for path in paths:
            remove(self.spark, path)
        remove(self.spark, fresh)
        return {"files": len(paths), "rows_dropped": sum(r["rows"] - r["live"] for r in worn)}


# Snapshots: a directory of the tables and a manifest with a checksum of every file.

MAGIC, VERSION, CODEC = "PACKMILL", 1, "parquet"


def _digest(spark: SparkSession, path: str) -> tuple[str, int]:
    """(a digest of all files, number of files): each file's sha256 is of its name and contents, read piece by piece in a task, and the files' hashes are added up, so that none of it is gathered in one place."""
    fs, root = hadoop(spark, path)
    walk, names = fs.listFiles(root, True), []
    while walk.hasNext():
        f = walk.next().getPath().toString()
        if f.endswith(".parquet"):
            names.append((f, f[f.index("/" + path.rsplit("/", 1)[1] + "/") :]))

    def hashed(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs as pfs

        for batch in batches:
            out = []
            for uri, name in zip(*(batch.column(c).to_pylist() for c in ("uri", "name"))):
                system, where = pfs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
                h = hashlib.sha256(name.encode())
                with system.open_input_stream(where, compression=None) as source:
                    while piece := source.read(1 << 20):
                        h.update(piece)
                out.append([int.from_bytes(h.digest()[i : i + 4], "big") for i in range(0, 32, 4)])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(8)], [f"h{i}" for i in range(8)])

    if not names:
        return "0", 0
    rows = spark.createDataFrame(names, "uri string, name string").repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism))
    got = rows.mapInArrow(hashed, ", ".join(f"h{i} bigint" for i in range(8))).agg(*(F.sum(f"h{i}").alias(f"h{i}") for i in range(8))).first()
    return "".join(f"{got[i] & 0xFFFFFFFF:08x}" for i in range(8)), len(names)


def snapshot(store: Store, out: str, created_at: int = 0) -> dict:
    """Copies the tables to a path outside the store and writes its manifest, which makes the snapshot complete."""
    out = out.rstrip("/")
    if (out + "/").startswith(store.path + "/"):
        raise ValueError("a snapshot may not lie inside its store")
    for name in SCHEMAS:
        store.read(name).write.mode("overwrite").parquet(f"{out}/{name}")
    digest, files = _digest(store.spark, out)
    packs = store.live("packs").agg(F.count("*").alias("p"), F.countDistinct("owner").alias("o")).first()
    manifest = {"magic": MAGIC, "format_version": VERSION, "created_at": created_at, "codecs": {"table": CODEC}, "stats": {"pack_count": packs["p"], "owner_count": packs["o"], "files": files}, "sha256": digest}
    store.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest.json")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/manifest.json"):
        raise FileNotFoundError(f"{path} holds no snapshot")
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()["value"])
    except ValueError as e:
        raise ValueError("the manifest is not JSON") from e
    if manifest.get("magic") != MAGIC:
        raise ValueError("this is not a snapshot of this engine")
    if manifest.get("format_version") != VERSION:
        raise ValueError(f"unknown snapshot version {manifest.get('format_version')}")
    return manifest


def restore(spark: SparkSession, path: str, into: str) -> Store:
    """A new store from a snapshot whose codecs and checksum hold."""
    manifest = read_manifest(spark, path)
    if manifest.get("codecs") != {"table": CODEC}:
        raise ValueError(f"unknown codecs {manifest.get('codecs')}")
    if _digest(spark, path)[0] != manifest["sha256"]:
        raise ValueError("the snapshot's files are not those its manifest was written for")
    if exists(spark, into):
        raise FileExistsError(f"{into} exists")
    store = Store(spark, into)
    for name, schema in SCHEMAS.items():
        spark.read.schema(schema).parquet(f"{path}/{name}").write.parquet(store.table_path(name))
    return store


class Checkpoints:
    """Snapshots by label and a sequence number of four digits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def list(self) -> list[tuple[str, int, str]]:
        """(label, seq, path), ordered."""
        if not exists(self.spark, self.root):
            return []
        found = []
        fs, root = hadoop(self.spark, self.root)
        for label in fs.listStatus(root):
            for seq in fs.listStatus(label.getPath()):
                name = seq.getPath().getName()
                if name.isdigit() and exists(self.spark, f"{seq.getPath()}/manifest.json"):
                    found.append((label.getPath().getName(), int(name), seq.getPath().toString()))
        return sorted(found)

    def save(self, store: Store, label: str, created_at: int = 0) -> tuple[str, int, str]:
        if not label or any(c in label for c in "/\\:") or label.startswith("."):
            raise ValueError(f"{label!r} is no label")
        seq = max([s for name, s, _ in self.list() if name == label], default=-1) + 1
        path = f"{self.root}/{label}/{seq:04d}"
        snapshot(store, path, created_at)
        return label, seq, path

    def latest(self, label: str) -> tuple[str, int, str] | None:
        return max((c for c in self.list() if c[0] == label), key=lambda c: c[1], default=None)

    def restore_latest(self, label: str, into: str) -> Store:
        found = self.latest(label)
        if found is None:
            raise FileNotFoundError(f"no checkpoint is labelled {label!r}")
        return restore(self.spark, found[2], into)
