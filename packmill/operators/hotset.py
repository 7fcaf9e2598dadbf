"""A hot set: the cells used last, up to a capacity, searched in 8 bits before anything else."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packmill.operators.retrieval import brute_force
from packmill.sources.shared import written

CAPACITY = 4096
_ENTRIES = "cell_id bigint, owner bigint, key array<double>, touched bigint"


class HotSet:
    """Entries (cell_id, owner, key, touched); the least recently touched go first when there are more than `capacity`.

    A set is small by its capacity, so each change is a written table of its own.
    """

    def __init__(self, spark, capacity: int = CAPACITY):
        if capacity < 1:
            raise ValueError("a hot set holds at least one cell")
        self.spark, self.capacity, self.turn = spark, capacity, 0
        self.entries = spark.createDataFrame([], _ENTRIES)

    def _keep(self, rows: DataFrame) -> None:
        last = rows.groupBy("cell_id").agg(F.max_by(F.struct("owner", "key"), "touched").alias("e"), F.max("touched").alias("touched"))
        order = Window.orderBy(F.desc("touched"), F.desc("cell_id"))
        newest = last.select("cell_id", "e.owner", "e.key", "touched").orderBy(F.desc("touched"), F.desc("cell_id")).limit(self.capacity)
        self.entries = written(newest.withColumn("n", F.row_number().over(order)).drop("n"), "hot")

    def insert(self, cells: DataFrame, order: str = "cell_id") -> None:
        """Cells (cell_id, owner, key) in order of a whole-number column; one that is there is renewed."""
        ranks = cells.select("cell_id", F.col("owner").cast("long").alias("owner"), F.col("key").cast("array<double>").alias("key"), F.col(order).cast("long").alias("_o"))
        most = ranks.agg(F.min("_o").alias("lo"), F.max("_o").alias("hi")).first()
        if most["lo"] is None:
            return
        new = ranks.select("cell_id", "owner", "key", (F.col("_o") - most["lo"] + self.turn + 1).alias("touched"))
        self.turn += most["hi"] - most["lo"] + 1
        # of many new cells only the newest can stay, so the rest never meets the set
        self._keep(self.entries.unionByName(new.orderBy(F.desc("touched"), F.desc("cell_id")).limit(2 * self.capacity) if most["hi"] - most["lo"] > 2 * self.capacity and ranks.select("cell_id").distinct().count() == ranks.count() else new))

    def query(self, queries: DataFrame, k: int, same_owner: bool = False, skip_self: bool = False) -> DataFrame:
        """(query_id, rank, cell_id, owner, score) by 8-bit dots; the cells found count as touched, in order of query and rank, best last."""
        found = written(brute_force(queries, self.entries, k, same_owner=same_owner, skip_self=skip_self, int8=True), "hits")
        size = found.agg(F.count("*").alias("n"), F.max("query_id").alias("q")).first()
        if size["n"]:
            order = Window.orderBy("query_id", F.desc("rank"))
            used = found.groupBy("cell_id").agg(F.max(F.struct("query_id", (-F.col("rank")).alias("r"))).alias("u")).select("cell_id", F.col("u.query_id").alias("query_id"), (-F.col("u.r")).alias("rank"))
            touched = used.withColumn("touched", F.row_number().over(order) + self.turn).select("cell_id", "touched")
            self.turn += self.capacity
            self._keep(self.entries.drop("touched").join(touched, "cell_id", "left").join(self.entries.select("cell_id", F.col("touched").alias("was")), "cell_id").select("cell_id", "owner", "key", F.coalesce("touched", "was").alias("touched")))
        return found

    def remove(self, ids: DataFrame) -> None:
        self.entries = written(self.entries.join(ids.select("cell_id"), "cell_id", "left_anti"), "hot")

    def __len__(self) -> int:
        return self.entries.count()
