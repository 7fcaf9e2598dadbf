"""The engine's public face: a store, and what is asked of it, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.functions import governance as G, vectors as V
from packmill.operators import graph, packs as P, refine, retrieval as R
from packmill.sources import store as ST
from packmill.sources.shared import written


class Engine:
    """Packs of one store. Reads change nothing: log_access() records them, and governance follows from the log.

    A pack is given as (owner, tokens, salience, text, layers): tokens is its retrieval key, an array of
    vectors, layers an array of (layer_idx, data). Ids are given in order of the rows' `row_no`; a store has one
    writer at a time and any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, refinement: str = "none"):
        self.spark, self.store = spark, ST.Store(spark, path)
        self.set_refinement_mode(refinement)

    def set_refinement_mode(self, mode: str) -> None:
        self.refinement_mode = refine.known(mode)

    def _next(self, name: str, column: str, first: int) -> int:
        top = self.store.read(name).agg(F.max(column)).first()[0]
        return first if top is None else top + 1

    def _seq(self, name: str) -> int:
        return self._next(name, "seq", 0)

    # Writes

    def next_pack(self) -> int:
        return self._next("packs", "pack_id", 1)

    def write_packs(self, rows: DataFrame) -> DataFrame:
        """Appends packs (row_no, owner, tokens, salience, text, layers); gives (row_no, pack_id)."""
        placed = written(P.number(rows, "pack_id", ["row_no"], self.next_pack()), "packs")
        self.append_packs(placed)
        return placed.select("row_no", "pack_id")

    def append_packs(self, placed: DataFrame) -> None:
        """Appends packs that have their pack_id. The table of packs comes last: a pack is there when all of it is."""
        g = G.written(F.col("salience").cast("double"))
        self.store.append("cells", placed.select((F.col("pack_id") * 1024).alias("cell_id"), "pack_id", "owner", F.lit(-1).alias("layer"), V.mean_pool(F.col("tokens").cast("array<array<double>>")).alias("key"), "tokens", F.lit(True).alias("is_retrieval"), F.lit(False).alias("is_view")))
        self.store.append("layers", placed.select("pack_id", F.inline("layers")))
        self.store.append("texts", placed.filter("text is not null").select("pack_id", "text", F.lit(self._seq("texts")).alias("seq")))
        self.store.append("packs", placed.select("pack_id", "owner", "salience", g["importance"].alias("importance"), g["tier"].alias("tier")))

    def write_packs_linked(self, rows: DataFrame, threshold: float = 250.0) -> DataFrame:
        """write_packs(), and an edge from each new pack to the best older one of its owner that scores at least the threshold."""
        old = self.store.live("cells").filter("is_retrieval").select("cell_id", "owner", "tokens", "pack_id")
        before = written(old, "before")
        ids = self.write_packs(rows)
        asked = rows.join(ids, "row_no").select(F.col("pack_id").alias("query_id"), "owner", "tokens")
        best = R.search(asked, before, 1).filter(F.col("score") >= threshold).join(before.select("cell_id", "pack_id"), "cell_id")
        self.add_edges(best.select(F.col("query_id").alias("src"), F.col("pack_id").alias("dst"), F.lit(graph.FOLLOWS).alias("edge_type")))
        return ids

    def write_cells(self, rows: DataFrame) -> DataFrame:
        """Single cells (row_no, owner, key, salience): each is a pack of one vector; gives (row_no, pack_id)."""
        layers = F.array().cast("array<struct<layer_idx: int, data: array<double>>>")
        return self.write_packs(rows.select("row_no", "owner", F.array(F.col("key").cast("array<double>")).alias("tokens"), "salience", F.lit(None).cast("string").alias("text"), layers.alias("layers")))

    def flush(self) -> None:
        """A barrier: every append is committed when it returns, so there is nothing left to do."""

    def refresh(self) -> None:
        """Sees what other writers have committed: state is always derived from the tables, whose file lists are read anew."""
        for name in ST.SCHEMAS:
            self.spark.catalog.refreshByPath(self.store.table_path(name))

    def add_view_keys(self, views: DataFrame) -> int:
        """More retrieval keys (pack_id, view_no from 1 to 1023, tokens) of packs that exist; how many were added."""
        owned = views.join(self.packs().select("pack_id", "owner"), "pack_id")
        cell = (F.col("pack_id") * 1024 + F.col("view_no")).alias("cell_id")
        self.store.append("cells", owned.select(cell, "pack_id", "owner", F.lit(-1).alias("layer"), V.mean_pool(F.col("tokens").cast("array<array<double>>")).alias("key"), "tokens", F.lit(True).alias("is_retrieval"), F.lit(True).alias("is_view")))
        return owned.count()

    def view_count(self) -> DataFrame:
        return P.view_counts(self.store.live("cells"))

    def set_pack_texts(self, rows: DataFrame) -> None:
        """All texts (pack_id, text), or none if a pack does not exist."""
        if not rows.join(self.packs().select("pack_id"), "pack_id", "left_anti").isEmpty():
            raise KeyError("a text is for a pack that does not exist")
        self.store.append("texts", rows.select("pack_id", "text", F.lit(self._seq("texts")).alias("seq")))

    def delete(self, ids: DataFrame) -> int:
        """Deletes packs (pack_id); how many lived."""
        gone = self.packs().select("pack_id").join(ids.select("pack_id").distinct(), "pack_id", "left_semi").withColumn("seq", F.lit(self._seq("deletions")))
        n = gone.count()
        if n:
            self.store.append("deletions", gone)
        return n

    def delete_owner(self, owner: int) -> int:
        return self.delete(self.packs().filter(F.col("owner") == owner))

    def add_edges(self, edges: DataFrame) -> None:
        """Typed edges (src, dst, edge_type); those that exist are not written again."""
        new = edges.select("src", "dst", F.col("edge_type").cast("int").alias("edge_type")).distinct()
        self.store.append("edges", new.join(self.store.read("edges"), ["src", "dst", "edge_type"], "left_anti"))

    def log_access(self, events: DataFrame) -> None:
        """Reads, writes and days (pack_id, action, days), in order of one batch."""
        self.store.append("access_log", events.withColumn("seq", F.lit(self._seq("access_log"))))

    def advance_days(self, days: float) -> None:
        self.store.append("clock", self.spark.createDataFrame([(float(days), self._seq("clock"))], "days double, seq bigint"))

    # State

    def packs(self) -> DataFrame:
        """(pack_id, owner, salience, importance, tier, days) of the packs that live, after their log and the days that passed."""
        base = self.store.live("packs").select("pack_id", "owner", "salience", F.struct("importance", "tier").alias("g"))
        log = self.store.read("access_log").groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "days"))).alias("events"))
        none = F.array().cast("array<struct<seq: bigint, action: string, days: int>>")
        state = base.join(log, "pack_id", "left").withColumn("g", G.fold(F.coalesce("events", none), F.col("g")))
        now = state.select("pack_id", "owner", "salience", "g.importance", "g.tier", F.lit(0.0).alias("days"))
        passed = self.store.read("clock").agg(F.sum("days")).first()[0]
        return P.advance(now, passed) if passed else now

    def list_packs(self) -> DataFrame:
        return self.packs().join(self.store.texts(), "pack_id", "left").orderBy(F.desc("importance"), "pack_id")

    def list_owners(self) -> DataFrame:
        return self.packs().select("owner").distinct().orderBy("owner")

    def evict_drafts(self, threshold: float = 15.0, owner: int | None = None) -> int:
        return self.delete(P.evictable(self.packs(), threshold, owner))

    def sweep_now(self, hours: float = 1.0, threshold: float = 15.0) -> int:
        if hours > 0:
            self.advance_days(hours / 24)
        return self.evict_drafts(threshold)

    def status(self) -> DataFrame:
        """One row: packs, owners, cells, edge_count, node_count."""
        p = self.packs().agg(F.count("*").alias("packs"), F.countDistinct("owner").alias("owners"))
        return p.crossJoin(self.store.live("cells").agg(F.count("*").alias("cells"))).crossJoin(graph.counts(self.store.read("edges")))

    def compact(self, live_ratio: float = 0.5) -> dict:
        return {name: self.store.compact(name, live_ratio) for name in ("cells", "layers", "texts")}

    # Reads

    def read_packs(self, queries: DataFrame, k: int, boost: float | None = None, follow: bool = False) -> DataFrame:
        """The k best packs of each query (query_id, owner, tokens), of its owner; with `boost` linked packs count more, with `follow` their links come too."""
        cells, packs, edges = self.store.live("cells").filter("is_retrieval"), self.packs(), self.store.read("edges")
        if boost is not None:
            found = P.read_packs_boosted(queries, cells, packs, edges, k, boost)
            return P.follow(found, edges, packs) if follow else found
        return P.read_packs(queries, cells, packs, self.store.texts(), k)

    def read_cells(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best cells of each query under the refinement mode, governed."""
        cells = self.store.live("cells").filter("is_retrieval")
        found = refine.refine(self.refinement_mode, queries, cells, 2 * k).drop("rank").join(cells.select("cell_id", "pack_id"), "cell_id")
        return R.top(P.govern(found, self.packs()), ["query_id"], k)

    def ancestors(self, starts: DataFrame | None = None) -> DataFrame:
        return graph.ancestors(self.store.read("edges"), starts)

    def pack_links(self, edge_type: int | None = None) -> DataFrame:
        return graph.links(self.store.read("edges"), edge_type)

    def load_packs(self, ids: DataFrame) -> DataFrame:
        """Packs with their layers; open_packs() also logs the access."""
        return P.hydrate(self.packs().join(ids, "pack_id", "left_semi"), self.store.read("layers"))

    def open_packs(self, ids: DataFrame) -> DataFrame:
        """load_packs() of packs (pack_id), each of which is logged as read; KeyError if one does not live."""
        wanted = ids.select("pack_id").distinct()
        if not wanted.join(self.packs().select("pack_id"), "pack_id", "left_anti").isEmpty():
            raise KeyError("a pack does not exist")
        self.log_access(wanted.select("pack_id", F.lit("read").alias("action"), F.lit(0).alias("days")))
        return self.load_packs(wanted)

    def read_tokens(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best cells of queries given as whole matrices (query_id, owner, tokens), governed."""
        cells = self.store.live("cells").filter("is_retrieval")
        found = R.search(queries, cells, 2 * k).drop("rank").join(cells.select("cell_id", "pack_id"), "cell_id")
        return R.top(P.govern(found, self.packs()), ["query_id"], k)

    def store_synapses(self, rows: DataFrame) -> None:
        self.store.append("synapses", rows)

    def synapses(self, owner: int) -> DataFrame:
        return self.store.read("synapses").filter(F.col("owner") == owner)

    def snapshot(self, out: str, created_at: int = 0) -> dict:
        return ST.snapshot(self.store, out, created_at)

    @classmethod
    def restored(cls, spark: SparkSession, path: str, into: str) -> Engine:
        ST.restore(spark, path, into)
        return cls(spark, into)

    # Schedule: the last row of an id is its state

    def schedule_evict_drafts(self, fires_at: int, threshold: float = 15.0, owner: int | None = None) -> int:
        i = self._next("schedule", "id", 1)
        self._schedule([(i, fires_at, "evict_draft", owner, threshold, "open")])
        return i

    def _schedule(self, rows: list) -> None:
        seq = self._seq("schedule")
        self.store.append("schedule", self.spark.createDataFrame([(*r, seq) for r in rows], ST.SCHEMAS["schedule"]))

    def list_scheduled(self) -> DataFrame:
        last = self.store.read("schedule").groupBy("id").agg(F.max_by(F.struct("fires_at", "action", "owner", "threshold", "state"), "seq").alias("s"))
        return last.select("id", "s.*").filter("state = 'open'").drop("state").orderBy("fires_at", "id")

    def cancel_scheduled(self, i: int) -> bool:
        got = self.list_scheduled().filter(F.col("id") == i).collect()
        self._schedule([(*r, "cancelled") for r in got]) if got else None
        return bool(got)

    def fire_due(self, now: int) -> int:
        """Does what is due, then marks it: what is repeated after a failure finds nothing more to evict."""
        due = self.list_scheduled().filter(F.col("fires_at") <= now).collect()
        for r in due:
            self.evict_drafts(r["threshold"], r["owner"])
            self._schedule([(*r, "done")])
        return len(due)
