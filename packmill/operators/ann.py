"""Approximate search over sharded neighbour graphs, which are built once and kept as a table.

Cells are spread over shards by a hash; each shard is a graph of its own (pruned nearest neighbours,
entered at the cell nearest to the shard's centre), one row of the table. A query visits all shards (with
owners, those of its owner) and the results are merged, so shards bound the memory of a worker at any
number of cells. New cells are wired into their shards one by one, as an online index does it.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.functions import vectors as V
from packmill.operators.refine import mean_vector
from packmill.operators.retrieval import DECIMALS, brute_force, search, top
from packmill.sources.shared import exists, new_dir, small_batches, written

DEGREE, ALPHA, ACTIVE_FROM, SHARD = 16, 1.2, 10_000, 20_000


def neighbours(cells: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(src, dst, rank): each cell's best `degree` others by scaled dot."""
    q = cells.withColumn("query_id", F.col("cell_id"))
    return brute_force(q, cells, degree, skip_self=True).select(F.col("query_id").alias("src"), F.col("cell_id").alias("dst"), "rank")


def medoid(cells: DataFrame) -> DataFrame:
    """One row (cell_id): the cell of the largest dot with the mean; the smallest id of several."""
    mean = mean_vector(cells.select("cell_id", F.col("key").alias("token")))
    scored = cells.crossJoin(F.broadcast(mean)).select("cell_id", F.round(V.dot(F.col("key"), F.col("mean")), DECIMALS).alias("s"))
    return scored.agg(F.max_by("cell_id", F.struct("s", -F.col("cell_id"))).alias("cell_id"))


def prune(node: np.ndarray, others: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Which of the others stay neighbours: best first, without those nearer to one that stays than alpha times their nearness to the node."""
    near = others @ node
    limit, out = alpha * near, np.zeros(len(others), bool)
    kept: list[int] = []
    for i in np.argsort(-near, kind="stable").tolist():
        if not out[i]:
            kept.append(i)
            if len(kept) >= degree:
                break
            out |= others @ others[i] > limit
    return kept


def build(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[list[list[int]], int]:
    """(neighbours of each row, entry row). Candidates are the 4 x degree best; edges go both ways, and what exceeds twice the degree is pruned again."""
    n = len(vectors)
    edges: list[list[int]] = []
    for a in range(0, n, 1024):
        s = vectors[a : a + 1024] @ vectors.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        m = min(4 * degree, n - 1)
        best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(s), 0), int)
        edges += [[int(b[i]) for i in prune(vectors[a + r], vectors[b], degree, alpha)] for r, b in enumerate(best)]
    for i, out in enumerate([list(e) for e in edges]):
        for j in out:
            if i not in edges[j]:
                edges[j].append(i)
    for i, e in enumerate(edges):
        if len(e) > 2 * degree:
            edges[i] = [e[k] for k in prune(vectors[i], vectors[e], 2 * degree, alpha)]
    return edges, int(np.argmax(vectors @ vectors.mean(0))) if n else 0


def beam(query: np.ndarray, vectors: np.ndarray, edges: list[list[int]], entry: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dots) of the best that a beam search finds."""
    n = len(vectors)
    seeds = np.unique([entry, *range(0, n, max(1, n // min(10, max(1, n // 100))))])
    seen = np.zeros(n, bool)
    seen[seeds] = True
    rows, dots, done = seeds, vectors[seeds] @ query, np.zeros(len(seeds), bool)
    while not done.all():
        at = int(np.argmax(np.where(done, -np.inf, dots)))
        done[at] = True
        new = np.array([j for j in edges[rows[at]] if not seen[j]], np.int64)
        if len(new):
            seen[new] = True
            rows, dots, done = np.append(rows, new), np.append(dots, vectors[new] @ query), np.append(done, np.zeros(len(new), bool))
            keep = np.argsort(-dots, kind="stable")[:width]
            rows, dots, done = rows[keep], dots[keep], done[keep]
    order = np.argsort(-dots, kind="stable")
    return rows[order], dots[order]


#: Vectors that a step of beams() takes neighbours from, for each query.
_EXPANDED = 4


def padded(edges: list[list[int]], width: int = 0) -> np.ndarray:
    """The lists as rows of one length, -1 where they have ended."""
    counts = np.array([len(e) for e in edges], np.int64)
    out = np.full((len(edges), max(width, int(counts.max(initial=1)))), -1, np.int32)
    out[np.repeat(np.arange(len(edges)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = [j for e in edges for j in e]
    return out


def beams(queries: np.ndarray, vectors: np.ndarray, near: np.ndarray, entry: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dots) of the best that a beam search finds for each query, best first, -1 and -inf where there are fewer.

    beam() for many queries at once: a step takes the neighbours of the few best vectors of each query that were not taken yet.
    """
    n, m = len(vectors), len(queries)
    seeds = np.unique([entry, *range(0, n, max(1, n // min(10, max(1, n // 100))))])
    seen = np.zeros((m, n), bool)
    seen[:, seeds] = True
    size = max(width, len(seeds))
    rows, dots, done = np.full((m, size), -1, np.int64), np.full((m, size), -np.inf), np.ones((m, size), bool)
    rows[:, : len(seeds)], dots[:, : len(seeds)], done[:, : len(seeds)] = seeds, queries @ vectors[seeds].T, False
    active = np.arange(m)
    while len(active):
        open_ = np.where(done[active], -np.inf, dots[active])
        at = np.argpartition(-open_, min(_EXPANDED, size) - 1, axis=1)[:, :_EXPANDED]
        taken = ~done[active[:, None], at]
        done[active[:, None], at] = True
        new = np.where(taken[:, :, None], near[rows[active[:, None], at]], -1).reshape(len(active), -1)
        q, c = np.nonzero(new >= 0)
        j = new[q, c].astype(np.int64)
        fresh = ~seen[active[q], j]
        pair = np.unique(q[fresh] * n + j[fresh])
        q, j = np.divmod(pair, n)
        if len(q):
            seen[active[q], j] = True
            count = np.bincount(q, minlength=len(active))
            place = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            shape = len(active), int(count.max())
            r, d, f = np.full(shape, -1, np.int64), np.full(shape, -np.inf), np.ones(shape, bool)
            r[q, place], d[q, place], f[q, place] = j, np.einsum("ij,ij->i", queries[active[q]], vectors[j]), False
            r, d, f = (np.concatenate([x[active], y], 1) for x, y in ((rows, r), (dots, d), (done, f)))
            best = np.argpartition(-d, width - 1, axis=1)[:, :width] if d.shape[1] > width else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            if size > best.shape[1]:
                rows, dots, done, size = rows[:, :width], dots[:, :width], done[:, :width], best.shape[1]
            rows[active], dots[active], done[active] = (np.take_along_axis(x, best, 1) for x in (r, d, f))
        active = active[~done[active].all(1)]
    order = np.argsort(-dots, axis=1, kind="stable")
    return np.take_along_axis(rows, order, 1), np.take_along_axis(dots, order, 1)


#: New vectors that are looked for in a graph together; what came before in such a batch is compared whole.
_TOGETHER = 64


def insert(vectors: np.ndarray, edges: list[list[int]], entry: int, new: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[np.ndarray, list[list[int]], int]:
    """(vectors, neighbours, entry) after new vectors are wired in one by one: neighbours come from a search of the graph, pruned, and edges go both ways."""
    have, n = np.concatenate([vectors, new]) if len(vectors) else new.copy(), len(vectors)
    near = np.full((len(have), 2 * degree + 1), -1, np.int32)
    first = padded([e[: 2 * degree] for e in edges], 2 * degree + 1) if n else near[:0]
    near[:n], count = first, np.zeros(len(have), np.int64)
    count[:n] = (first >= 0).sum(1)
    for lo in range(0, len(new), _TOGETHER):
        base, some = n, new[lo : lo + _TOGETHER]
        found = beams(some, have[:base], near[:base], entry, 3 * degree)[0] if base else np.full((len(some), 1), -1)
        for v, old in zip(some, found):
            others = np.concatenate([old[old >= 0], np.arange(base, n)])
            kept = others[prune(v, have[others], degree, alpha)] if len(others) else others
            near[n, : len(kept)], count[n] = kept, len(kept)
            for j in kept:
                near[j, count[j]] = n
                count[j] += 1
                if count[j] > 2 * degree:
                    row = near[j, : count[j]]
                    row = row[prune(have[j], have[row], 2 * degree, alpha)]
                    near[j], count[j] = -1, len(row)
                    near[j, : len(row)] = row
            n += 1
    return have, [r[:c].tolist() for r, c in zip(near, count)], int(np.argmax(have @ have.mean(0))) if len(have) else 0


_SHARD = "part bigint, owner bigint, n int, dim int, entry int, ids binary, owners binary, vectors binary, counts binary, edges binary"


def _row(part: int, owner, ids: np.ndarray, owners: np.ndarray, vectors: np.ndarray, edges: list, entry: int) -> dict:
    flat = np.array([j for e in edges for j in e], np.int32)
    return {"part": part, "owner": owner, "n": len(ids), "dim": vectors.shape[1], "entry": entry, "ids": ids.astype(np.int64).tobytes(), "owners": owners.astype(np.int64).tobytes(), "vectors": vectors.astype(np.float64).tobytes(), "counts": np.array([len(e) for e in edges], np.int32).tobytes(), "edges": flat.tobytes()}


def _graph(r) -> tuple:
    """(ids, owners, vectors, neighbours, entry) of a shard's row."""
    flat, ends = np.frombuffer(r["edges"], np.int32), np.cumsum(np.frombuffer(r["counts"], np.int32))
    edges = [flat[a:b].tolist() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["owners"], np.int64), np.frombuffer(r["vectors"]).reshape(r["n"], r["dim"]), edges, r["entry"]


def _placed(cells: DataFrame, shards: int, by_owner: bool) -> DataFrame:
    part = F.xxhash64(F.struct(F.col("owner").cast("long") if by_owner else F.lit(0).cast("long"), F.pmod(F.xxhash64(F.col("cell_id").cast("long")), F.lit(shards))))
    fine = F.col("cell_id").isNotNull() & (F.size("key") > 0) & ~F.exists("key", lambda x: x.isNull())
    placed = cells.select(part.alias("part"), F.col("cell_id").cast("long").alias("cell_id"), F.col("owner").cast("long").alias("owner"), F.col("key").cast("array<double>").alias("key"))
    return placed.filter(fine)


class Graphs:
    """Neighbour graphs of cells (cell_id, owner, key), kept in a folder: save by build(), then load and search as often as wanted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not exists(spark, f"{self.path}/about"):
            raise FileNotFoundError(f"{path} holds no graphs")
        about = spark.read.schema("shards int, by_owner boolean, version string, turn bigint").parquet(f"{self.path}/about").orderBy(F.desc("turn")).first()
        self.shards, self.by_owner, self.version, self.turn = about["shards"], about["by_owner"], about["version"], about["turn"]
        self.table = spark.read.schema(_SHARD).parquet(f"{self.path}/{self.version}")

    @classmethod
    def build(cls, cells: DataFrame, path: str, by_owner: bool = False, shard: int = SHARD) -> Graphs:
        """Vectors of a shard have one length; those of other lengths than its most common one are left out."""
        shards = max(1, math.ceil(cells.count() / shard))

        def work(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("cell_id")
            size = rows["key"].map(len)
            rows = rows[size == size.mode()[0]]
            vectors = np.stack(rows["key"].to_numpy())
            edges, entry = build(vectors)
            owners = rows["owner"].fillna(-1).to_numpy().astype(np.int64)
            return pd.DataFrame([_row(int(rows["part"].iloc[0]), int(owners[0]) if by_owner else None, rows["cell_id"].to_numpy(), owners, vectors, edges, entry)])

        made = _placed(cells, shards, by_owner).groupBy("part").applyInPandas(work, _SHARD)
        cls._save(cells.sparkSession, path.rstrip("/"), made, shards, by_owner, 0)
        return cls(cells.sparkSession, path)

    @staticmethod
    def _save(spark: SparkSession, path: str, table: DataFrame, shards: int, by_owner: bool, turn: int) -> None:
        """The graphs first, then the row that names them: readers see the old ones or the new ones."""
        version = uuid.uuid4().hex
        table.write.parquet(f"{path}/{version}")
        spark.createDataFrame([(shards, by_owner, version, turn)], "shards int, by_owner boolean, version string, turn bigint").coalesce(1).write.mode("append").parquet(f"{path}/about")

    def insert(self, cells: DataFrame) -> Graphs:
        """The graphs with new cells wired in; a cell that is there already stays as it is. Shards without new cells are copied as they are."""
        new = _placed(cells, self.shards, self.by_owner)
        by_owner = self.by_owner

        def work(have: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
            more = more.sort_values("cell_id").drop_duplicates("cell_id")
            if len(have):
                ids, owners, vectors, edges, entry = _graph(have.iloc[0])
                more = more[~more["cell_id"].isin(ids) & (more["key"].map(len) == vectors.shape[1])]
            elif len(more):
                size = more["key"].map(len)
                more = more[size == size.mode()[0]]
                ids, owners, vectors, edges, entry = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(more["key"].iloc[0]))), [], 0
            if not len(more):
                return have
            vectors, edges, entry = insert(vectors, edges, entry, np.stack(more["key"].to_numpy()))
            added = more["owner"].fillna(-1).to_numpy().astype(np.int64)
            part = int(have["part"].iloc[0] if len(have) else more["part"].iloc[0])
            return pd.DataFrame([_row(part, int(added[0]) if by_owner else None, np.concatenate([ids, more["cell_id"].to_numpy()]), np.concatenate([owners, added]), vectors, edges, entry)])

        made = self.table.groupBy("part").cogroup(new.groupBy("part")).applyInPandas(work, _SHARD)
        self._save(self.spark, self.path, made, self.shards, self.by_owner, self.turn + 1)
        return Graphs(self.spark, self.path)

    def edges(self) -> DataFrame:
        """(src, dst, rank): every cell's neighbours."""

        def work(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    ids, _, _, edges, _ = _graph(r)
                    src = np.repeat(ids, [len(e) for e in edges])
                    dst = ids[np.array([j for e in edges for j in e], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(np.array([i + 1 for e in edges for i in range(len(e))], np.int64))], ["src", "dst", "rank"])

        return self.table.mapInArrow(work, "src bigint, dst bigint, rank bigint")

    def search(self, queries: DataFrame, k: int, skip_self: bool = False, width: int | None = None, block: int = 128) -> DataFrame:
        """(query_id, rank, cell_id, owner, score) for queries (query_id, owner, key): blocks of queries meet each shard, or their owner's shards."""
        by_owner = self.by_owner
        beam_width = width or 4 * max(k, DEGREE)

        def pack(batches):
            for batch in batches:
                rows = [r for r in batch.to_pylist() if r["query_id"] is not None and r["q"] and None not in r["q"]]
                kinds: dict = {}
                for r in rows:
                    kinds.setdefault((r["q_owner"] if by_owner else None, len(r["q"])), []).append(r)
                for (owner, dim), some in kinds.items():
                    for a in range(0, len(some), block):
                        ids, x = np.array([r["query_id"] for r in some[a : a + block]], np.int64), np.array([r["q"] for r in some[a : a + block]], np.float64)
                        yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["q_owner", "q_dim", "q_ids", "q"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("owner").cast("long").alias("q_owner"), F.col("key").cast("array<double>").alias("q"))
        blocks = written(asked.mapInArrow(pack, "q_owner bigint, q_dim int, q_ids binary, q binary"), "asked")

        def work(batches):
            last, graph = None, None
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.float64()
            for batch in batches:
                parts = batch.column("part").to_pylist()
                for at, part in enumerate(parts):
                    if part != last:  # a graph is read once for all blocks that follow each other
                        ids, owners, vectors, edges, entry = _graph({c: batch.column(c)[at].as_py() for c in ("n", "dim", "entry", "ids", "owners", "vectors", "counts", "edges")})
                        last, graph = part, (ids, owners, vectors, padded(edges), entry)
                    ids, owners, vectors, near, entry = graph
                    asked, dim = np.frombuffer(batch.column("q_ids")[at].as_py(), np.int64), batch.column("q_dim")[at].as_py()
                    rows, dots = beams(np.frombuffer(batch.column("q")[at].as_py()).reshape(-1, dim), vectors, near, entry, beam_width)
                    fine = (rows >= 0) & ~(skip_self & (ids[rows] == asked[:, None]))
                    q, c = np.nonzero(fine & (np.cumsum(fine, 1) <= k))
                    found = asked[q], ids[rows[q, c]], owners[rows[q, c]], np.round(dots[q, c] / math.sqrt(dim), DECIMALS)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds)], ["query_id", "cell_id", "owner", "score"])

        # each block is sent to its shards by their number, so shards spread over tasks whatever the join
        parts = self.table.select("part", F.col("owner").alias("p_owner"), F.col("dim").alias("p_dim"))
        sent = blocks.join(parts, (F.col("p_dim") == F.col("q_dim")) & (F.col("p_owner") == F.col("q_owner")) if by_owner else F.col("p_dim") == F.col("q_dim"))
        sent = sent.select("part", "q_dim", "q_ids", "q")
        tasks = self.spark.sparkContext.defaultParallelism
        # a shard's blocks of queries follow each other in a few tasks, so that its graph is read a few times, not for each block
        turns = max(1, -(-2 * tasks // self.shards))
        sent = sent.withColumn("turn", F.pmod(F.xxhash64("q_ids"), F.lit(turns)))
        graphs = self.table.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)).cast("array<bigint>")))
        met = sent.withColumn("turn", F.col("turn").cast("bigint")).hint("shuffle_merge").join(graphs.hint("shuffle_merge"), ["part", "turn"])
        found = small_batches(met).select("part", "n", "dim", "entry", "ids", "owners", "vectors", "counts", "edges", "q_dim", "q_ids", "q").mapInArrow(work, "query_id bigint, cell_id bigint, owner bigint, score double")
        return top(found, ["query_id"], k).select("query_id", "rank", "cell_id", "owner", "score")


def ann_search(queries: DataFrame, cells: DataFrame, k: int, same_owner: bool = False, skip_self: bool = False, shard: int = SHARD, width: int | None = None) -> DataFrame:
    """(query_id, rank, cell_id, owner, score) of plain keys by graphs built for this search; Graphs keeps them for more.

    With same_owner each owner's cells are graphs of their own, so that an owner's results are not crowded out.
    """
    graphs = Graphs.build(cells, new_dir(cells.sparkSession, "graphs"), same_owner, shard)
    return graphs.search(queries, k, skip_self, width)


def planned(queries: DataFrame, cells: DataFrame, k: int, active_from: int = ACTIVE_FROM, certain: bool = False, **options) -> DataFrame:
    """Exact below `active_from` cells, graphs from there on; the column `exact` says which.

    With `certain` the graphs' results are the start of an exact search: a query's k-th score there is a floor, and only what reaches it is looked at.
    """
    exact = cells.count() < active_from
    if certain and not exact:
        found = ann_search(queries, cells, k, **options).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        floor = found.select("query_id", F.when((F.col("n") >= k) & ~F.isnan("least"), F.col("least") - 10.0**-DECIMALS).alias("floor"))
        return brute_force(queries.join(floor, "query_id", "left"), cells, k, floor="floor", **options).withColumn("exact", F.lit(True))
    return (brute_force if exact else ann_search)(queries, cells, k, **options).withColumn("exact", F.lit(exact))


__all__ = ["Graphs", "ann_search", "beam", "beams", "build", "insert", "medoid", "neighbours", "planned", "prune", "search"]
