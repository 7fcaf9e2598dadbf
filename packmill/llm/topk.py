"""Operator 10: exact top-k search with vector-approximation files.

Vectors are quantised to 8 bits a dimension on a grid over each dimension's range; the approximation is
the cell's centre and the distance from it to the vector. That gives bounds: a vector is no nearer and
no farther from a query than its cell's centre, plus or minus that distance. All arithmetic is on
differences to the middle of the ranges, and the bounds give way by the rounding that the norms allow,
so vectors far from the origin have sound bounds too.

Exact vectors and approximations are written to files once, block by block, and only the blocks' places are
shuffled: groups of query blocks meet groups of data blocks in the cells of a grid. A task reads the queries of
its cell, as many at once as the candidates it may hold allow, streams the cell's approximations past them and
keeps each query's k smallest upper bounds, so it passes on only vectors whose lower bound is not above the k-th
of them. Queries and a data block are compared in tiles of TILE pairs, so a task's memory follows neither the
number of queries nor that of vectors. At last the candidates of a query, from all cells, are
read from the files by position, in the order of their lower bounds, until the k-th exact distance is
below the next bound: what the bounds exclude is never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from packmill.llm.common import BROADCAST_BYTES, new_dir, small_batches, table, written
from packmill.llm.files import Attempt, open_input

K = 10
#: The rows that are queries in op10_topk: those whose id is divisible by this.
EVERY = 50
#: Vectors in a block.
BLOCK = 2048
#: Distances are compared after rounding to so many decimals, then by id.
DECIMALS = 6
#: Bytes of the exact vectors of the queries of a cell.
QUERY_BYTES = 32 << 20
#: Pairs of a query and an approximation whose distances are held at once.
TILE = 1 << 19
#: Pairs of a query and an approximation that a task compares, about: minutes of work.
PAIRS = 50_000_000_000
#: Bytes of a file of exact vectors, about.
ROLL = 256 << 20
#: Candidates that a scanning task holds before it passes them on; it takes so many queries at once that 2k for each are held.
_HELD = 1 << 19
#: Candidates in a batch that is passed on.
_PASSED = 1 << 16
#: Bytes between two vectors of a file that are read rather than skipped.
_GAP = 1 << 14
_SLACK = 2 * 10.0**-DECIMALS
_EPS = np.finfo(np.float64).eps
_OUT = "vec_id bigint, rank int, neighbour_id bigint, distance double"
_BLOCKS = "block bigint, uri string, at bigint, n int"
_FOUND = "q_block bigint, q_at int, q_id bigint, block bigint, at int, id bigint, lower double, upper double"


def _extremes(batches):
    """(d, i, low, high): the range of every dimension, for each length of vectors of a task."""
    seen: dict = {}
    for batch in batches:
        v = batch.column("v")
        start, flat = v.offsets.to_numpy()[:-1] - v.offsets[0].as_py(), v.flatten().to_numpy()
        size = np.diff(np.append(start, len(flat)))
        for d in np.unique(size):
            x = flat[start[size == d][:, None] + np.arange(d)]
            n, low, high = seen.get(d, (0, x[0], x[0]))
            seen[d] = n + len(x), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    for d, (n, low, high) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(low.astype(np.float64)), pa.array(high.astype(np.float64))], ["d", "i", "n", "low", "high"])


def _blocks(folder: str, low: np.ndarray, step: np.ndarray, block: int):
    """Packs rows (id, row, v) into blocks: exact vectors, ids, rows, distances and codes go to a file, one behind the other, and their place into a row."""
    middle = low + 128 * step

    def work(batches):
        out, held, done = None, [], []

        def pack(ids, at, v):
            x = v - middle
            codes = np.clip(np.floor(x / step + 128), 0, 255).astype(np.uint8)
            with np.errstate(over="ignore"):
                off = np.sqrt(((x - (codes - 127.5) * step) ** 2).sum(1)) * (1 + 1e-12) + 4 * _EPS * np.sqrt((x * x).sum(1))
            row = (int(at.min()), out.uri, out.size, len(ids))
            for part in (v, ids, at, off, codes):
                out.write(part.tobytes())
            return row

        def ready():
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int32()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [f.split()[0] for f in _BLOCKS.split(", ")])

        def chunk(part):
            v = part.column("v").combine_chunks()
            return part.column("id").to_numpy(), part.column("row").to_numpy(), np.ascontiguousarray(v.flatten().to_numpy().reshape(len(v), -1))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(h.num_rows for h in held) < block:
                continue
            rows = pa.concat_tables(held)
            while rows.num_rows >= block:
                out = out or Attempt(folder, ".vec")
                done.append(pack(*chunk(rows.slice(0, block))))
                rows = rows.slice(block)
                if out.size >= ROLL:
                    out.close()
                    out = None
                    yield ready()
                    done = []
            held = [rows] if rows.num_rows else []
        if held:
            out = out or Attempt(folder, ".vec")
            done.append(pack(*chunk(pa.concat_tables(held))))
        if out is not None:
            out.close()
        if done:
            yield ready()

    return work


class _Scan:
    """Some queries, their k smallest upper bounds so far, and the candidates that these leave."""

    def __init__(self, step: np.ndarray, k: int, most: int = _HELD):
        self.step, self.k, self.most = step, k, most
        self.q: list = []
        self.ready = False

    def add_query(self, block: int, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, first: int = 0) -> None:
        """Queries of a block, from its place `first` on."""
        self.q.append((np.full(len(rows), block), first + np.arange(len(rows)), ids, rows, x))
        self.ready = False

    def begin(self) -> None:
        self.block, self.place, self.ids, self.rows, x = (np.concatenate(c) for c in zip(*self.q))
        with np.errstate(over="ignore"):
            self.square = (x * x).sum(1)
            self.norm = np.sqrt(self.square)
            # times (centre, 1, square of the centre): the square of the distance
            self.x = np.concatenate([-2 * x, self.square[:, None], np.ones((len(x), 1))], 1)
        self.best = np.full((len(x), self.k), np.inf)
        self.own = np.argsort(self.rows, kind="stable")
        self.pool: list = []
        self.held = 0
        self.ready = True

    def data(self, block: int, ids, rows, codes, off):
        """Compares a block with the queries, tile by tile; gives batches of candidates when it holds too many."""
        if not self.q:
            return
        if not self.ready:
            self.begin()
        centre = (codes.reshape(len(ids), -1) - 127.5) * self.step
        with np.errstate(over="ignore", invalid="ignore"):
            c_square = (centre * centre).sum(1)
            # what the square form may be wrong by
            wrong = 8 * (centre.shape[1] + 8) * _EPS * (self.norm + np.sqrt(c_square.max())) ** 2
            sound = np.isfinite(wrong).all() and np.isfinite(self.square.max() + c_square.max())
        centre = np.concatenate([centre, np.ones((len(ids), 1)), c_square[:, None]], 1).T
        mine, its = self.same(rows)
        size = max(1, TILE // len(ids))
        for a in range(0, len(self.x), size):
            with np.errstate(over="ignore", invalid="ignore"):
                square = self.x[a : a + size] @ centre
                if not sound:
                    square[~np.isfinite(square)] = np.nan  # beyond what squares can hold: no bound, so the exact vectors decide
                here = (mine >= a) & (mine < a + size)
                square[mine[here] - a, its[here]] = np.inf
                limit = (self.kth(a, square, wrong[a : a + size], off.max()) + off.max() + 2 * _SLACK) ** 2 + wrong[a : a + size]
                i, j = np.nonzero(~(square > limit[:, None]))
                self.take(block, a + i, j, square[i, j], wrong[a + i], off[j], ids)
            if self.held > self.most:
                self.prune()
                if self.held > self.most:
                    yield from self.found()

    def same(self, rows: np.ndarray):
        """A row is not its own neighbour: the queries among the rows, and which rows they are."""
        place = np.searchsorted(self.rows, rows, sorter=self.own)
        place = self.own[np.minimum(place, len(self.rows) - 1)]
        its = np.flatnonzero(self.rows[place] == rows)
        return place[its], its

    def kth(self, a: int, square: np.ndarray, wrong: np.ndarray, off: float) -> np.ndarray:
        """The k-th upper bounds of a tile's queries. Those that have none yet get what their k smallest squares allow, or all pairs would be kept."""
        kth = self.best[a : a + len(square), -1].copy()
        new = np.flatnonzero(np.isposinf(kth))
        if len(new) and square.shape[1] >= self.k:
            part = square[new]
            part.partition(self.k - 1, axis=1)
            bound = np.sqrt(np.maximum(part[:, self.k - 1] + wrong[new], 0)) + off + _SLACK
            kth[new] = np.where(np.isnan(bound), np.inf, bound)
        return kth

    def take(self, block: int, i, j, square, wrong, off, ids) -> None:
        lower = np.sqrt(np.maximum(square - wrong, 0)) - off - _SLACK
        upper = np.sqrt(np.maximum(square + wrong, 0)) + off + _SLACK
        lower, upper = np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)
        other = ~np.isposinf(square)
        i, j, lower, upper = i[other], j[other], lower[other], upper[other]
        if not len(i):
            return
        # each query's k smallest upper bounds, with those it had
        order = np.lexsort((upper, i))
        first = np.flatnonzero(np.diff(i[order], prepend=-1))
        many = np.diff(np.append(first, len(order)))
        nth = np.arange(len(order)) - np.repeat(first, many)
        few, some = nth < self.k, i[order[first]]
        new = np.full((len(some), self.k), np.inf)
        new[np.repeat(np.arange(len(some)), many)[few], nth[few]] = upper[order[few]]
        self.best[some] = np.sort(np.concatenate([self.best[some], new], 1), axis=1)[:, : self.k]
        keep = lower <= self.best[i, -1]
        i, j = i[keep], j[keep]
        self.pool.append((i.astype(np.int32), np.full(len(i), block), j.astype(np.int32), ids[j], lower[keep], upper[keep]))
        self.held += len(i)

    def prune(self) -> None:
        pool = list(zip(*self.pool))
        i, lower = np.concatenate(pool[0]), np.concatenate(pool[4])
        keep = lower <= self.best[i, -1]
        self.pool = [tuple(np.concatenate(c)[keep] for c in pool)]
        self.held = int(keep.sum())

    def found(self):
        """The candidates left, as batches of rows."""
        if not self.ready or not self.pool:
            return
        self.prune()
        pool, self.pool, self.held = self.pool[0], [], 0
        for lo in range(0, len(pool[0]), _PASSED):
            i, block, j, ids, lower, upper = (c[lo : lo + _PASSED] for c in pool)
            yield pa.RecordBatch.from_arrays([pa.array(self.block[i]), pa.array(self.place[i].astype(np.int32)), pa.array(self.ids[i]), pa.array(block), pa.array(j), pa.array(ids), pa.array(lower), pa.array(upper)], [f.split()[0] for f in _FOUND.split(", ")])


def _some(asked: list, most: int):
    """The queries of blocks as lists of (block's row, from, to), each list of `most` queries at most."""
    now, size = [], 0
    for r in asked:
        for lo in range(0, r["n"], most):
            n = min(most, r["n"] - lo)
            if size + n > most:
                yield now
                now, size = [], 0
            now.append((r, lo, lo + n))
            size += n
    if now:
        yield now


def _scan(dim: int, kind: type, step: np.ndarray, middle: np.ndarray, k: int, held: int):
    """The candidates of the cells of a partition; rows are places of blocks, a cell's queries before its data."""

    def one(asked, data, read):
        for some in _some(asked, max(1, held // (2 * k))):
            scan = _Scan(step, k, held)
            for r, lo, hi in some:
                ids, rows, _, _ = read.block(r["uri"], r["at"], r["n"], False)
                scan.add_query(r["block"], ids[lo:hi], rows[lo:hi], read.exact(r["uri"], r["at"], lo, hi) - middle, lo)
            for r in data:
                yield from scan.data(r["block"], *read.block(r["uri"], r["at"], r["n"]))
            yield from scan.found()

    def work(batches):
        read, now, asked, data = _Files(dim, kind), None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != now:
                    yield from one(asked, data, read)
                    now, asked, data = r["cell"], [], []
                (data if r["kind"] else asked).append(r)
        yield from one(asked, data, read)
        read.close()

    return work


class _Files:
    """Reads vectors by file and position, neighbours in one go, and parts of blocks; the latest files stay open."""

    def __init__(self, dim: int, kind: type):
        self.dim, self.kind, self.size, self.open = dim, kind, dim * np.dtype(kind).itemsize, {}

    def file(self, uri: str):
        if uri not in self.open:
            while len(self.open) >= 16:
                self.open.pop(next(iter(self.open))).close()
            self.open[uri] = open_input(uri)
        return self.open[uri]

    def exact(self, uri: str, at: int, lo: int, hi: int) -> np.ndarray:
        """Vectors lo to hi of a block of exact vectors."""
        return np.frombuffer(self.file(uri).read_at((hi - lo) * self.size, at + lo * self.size), self.kind).reshape(hi - lo, self.dim).astype(np.float64)

    def block(self, uri: str, at: int, n: int, codes: bool = True):
        """(ids, rows, codes, distances from the cells' centres) of a block of n vectors, the last two if asked for."""
        data = self.file(uri).read_at(n * (24 + self.dim if codes else 16), at + n * self.size)
        ids, rows = (np.frombuffer(data, np.int64, n, 8 * n * i) for i in range(2))
        return (ids, rows, np.frombuffer(data, np.uint8, n * self.dim, 24 * n), np.frombuffer(data, np.float64, n, 16 * n)) if codes else (ids, rows, None, None)

    def __call__(self, uris: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, size = np.empty((len(at), self.dim)), self.size
        order = np.lexsort((at, uris))
        lo = 0
        while lo < len(order):
            hi, uri = lo + 1, uris[order[lo]]
            while hi < len(order) and uris[order[hi]] == uri and at[order[hi]] - at[order[hi - 1]] <= _GAP + size and at[order[hi]] - at[order[lo]] < 4 << 20:
                hi += 1
            first = int(at[order[lo]])
            data = self.file(uri).read_at(int(at[order[hi - 1]]) - first + size, first)
            for i in order[lo:hi]:
                out[i] = np.frombuffer(data, self.kind, self.dim, int(at[i]) - first)
            lo = hi
        return out

    def close(self) -> None:
        for f in self.open.values():
            f.close()


def _refine(dim: int, kind: type, k: int):
    """Exact neighbours of the queries of a partition, whose candidates come query by query in the order of lower bounds.

    Queries go on together: in each round every query that is not certain yet reads its next k candidates.
    A query may go on in the next batch, with what it has: no batch is kept, however many candidates a query has.
    """
    names = ["q_block", "q_at", "q_uri", "q_base", "q_id", "block", "at", "id", "uri", "base", "lower", "upper"]

    def search(t: pa.RecordBatch, read: _Files, before):
        """(block, place, id, neighbours, whether they are certain) of each query; before: of the query that the last batch ended with."""
        c = {n: t.column(n).to_numpy(zero_copy_only=False) for n in names if n not in ("uri", "q_uri")}
        uri, q_uri = (t.column(n).to_numpy(zero_copy_only=False) for n in ("uri", "q_uri"))
        start = np.flatnonzero((np.diff(c["q_block"], prepend=-1) != 0) | (np.diff(c["q_at"], prepend=-1) != 0))
        end = stop = np.append(start[1:], t.num_rows)
        group = np.repeat(np.arange(len(start)), stop - start)
        order = np.lexsort((c["upper"], group))
        kth = np.where(stop - start >= k, c["upper"][order[np.minimum(start + k - 1, len(order) - 1)]], np.inf)
        # sorted by lower bound, so what is beyond a query's k-th upper bound is a tail
        stop = start + np.add.reduceat((c["lower"] <= kth[group]).astype(np.int64), start)
        q = read(q_uri[start], c["q_base"][start] + read.size * c["q_at"][start].astype(np.int64))
        best: list = [[] for _ in start]
        at = start.copy()
        key = list(zip(c["q_block"][start].tolist(), c["q_at"][start].tolist(), c["q_id"][start].tolist()))
        certain = False
        if before is not None and before[:3] == key[0]:
            best[0], certain = before[3:]
        goes_on = lambda i: at[i] < stop[i] and (len(best[i]) < k or best[i][-1][0] >= c["lower"][at[i]])
        live = np.array([i for i in range(certain, len(start)) if goes_on(i)], np.int64)
        while len(live):
            take = [np.arange(at[i], min(at[i] + k, stop[i])) for i in live]
            own, rows = np.repeat(live, [len(x) for x in take]), np.concatenate(take)
            x = read(uri[rows], c["base"][rows] + read.size * c["at"][rows].astype(np.int64))
            with np.errstate(over="ignore"):
                far = np.round(np.sqrt(((q[own] - x) ** 2).sum(1)), DECIMALS)
            for i, d, r in zip(own, far, rows):
                best[i].append((float(d), int(c["id"][r])))
            for i in live:
                best[i] = sorted(best[i])[:k]
                at[i] = min(at[i] + k, stop[i])
            live = np.array([i for i in live if goes_on(i)], np.int64)
        return [(*of, b, bool(n < m)) for of, b, n, m in zip(key, best, at, end)]

    def result(done):
        rows = [(q, r + 1, i, d) for _, _, q, b, _ in done for r, (d, i) in enumerate(b)]
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.float64()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["vec_id", "rank", "neighbour_id", "distance"])

    def work(batches):
        read, last = _Files(dim, kind), None
        for batch in batches:
            if not batch.num_rows:
                continue
            done = search(batch, read, last)
            if last is not None and last[:3] != done[0][:3]:
                done.insert(0, last)
            last = done.pop()
            if done:
                yield result(done)
        if last is not None:
            yield result([last])
        read.close()

    return work


def _usable(vectors: DataFrame) -> DataFrame:
    """(id, v) of the rows that can be compared; floats stay floats."""
    held = vectors.schema["embedding"].dataType
    v = F.col("embedding").cast("array<float>" if isinstance(held, ArrayType) and held.elementType == FloatType() else "array<double>")
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(fine)


def _copies_cut(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, row, v) without those that have k + 1 copies of smaller (id, row). Only vectors whose hash is that frequent are shuffled."""
    h = F.xxhash64("v").alias("h")
    heavy = written(rows.groupBy(h).count().filter(F.col("count") > k + 1).select("h"), "frequent")
    n = heavy.count()
    if not n:
        return rows.select("id", "row", "v")
    if n * 64 <= BROADCAST_BYTES:
        heavy = F.broadcast(heavy)
    hashed = rows.select("id", "row", "v", h)
    copies = Window.partitionBy("h", "v").orderBy("id", "row")
    first = hashed.join(heavy, "h", "left_semi").withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    return hashed.join(heavy, "h", "left_anti").select("id", "row", "v").unionByName(first.select("id", "row", "v"))


def nearest(vectors: DataFrame, k: int = K, block: int = BLOCK, every: int = 1, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k rows nearest to the queries among all rows of vectors (vec_id, embedding), in Euclidean distance.

    Queries are the rows whose vec_id is divisible by `every`. Equal distances (to DECIMALS decimals) are
    ranked by neighbour_id. Cases: a row is not its own neighbour, but a repeated row is a neighbour at
    distance 0, and a repeated vec_id gets its ranks once for each row; rows with a null vec_id, a null,
    empty, infinite or NaN vector, a null element, or a length other than the most common one (the shorter
    of two) are neither queries nor neighbours; with k or fewer other rows all of them are given; an empty
    table gives none. Of more than k + 1 rows with one vector only the k + 1 of smallest ids can be anyone's
    neighbours, so only they are searched, and a vector that very many rows share costs no more than any other.
    """
    spark = vectors.sparkSession
    numbered = written(small_batches(_usable(vectors)).withColumn("row", F.monotonically_increasing_id()), "vectors")
    ranges = written(numbered.select("v").mapInArrow(_extremes, "d int, i int, n bigint, low double, high double").groupBy("d", "i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "ranges")
    first = ranges.filter("i = 0").orderBy(F.desc("n"), "d").select("d").first()
    if first is None:
        return spark.createDataFrame([], _OUT)
    dim = first["d"]
    got = ranges.filter(F.col("d") == dim).orderBy("i").select("low", "high").toArrow()
    low, high = (got.column(c).to_numpy() for c in ("low", "high"))
    step = np.maximum((high / 256 - low / 256), np.maximum(np.abs(low), np.abs(high)) * _EPS * 4 + 1e-300)
    middle = low + 128 * step
    rows = numbered.filter(F.size("v") == dim)
    kind = np.float32 if numbered.schema["v"].dataType.elementType == FloatType() else np.float64
    folder = new_dir(spark, "exact")
    packed = lambda df: written(df.mapInArrow(_blocks(folder, low, step, block), _BLOCKS), "blocks")
    blocks, asked = packed(_copies_cut(rows, k)), packed(rows.filter(F.pmod("id", F.lit(every)) == 0))
    of_data, of_queries = (b.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first() for b in (blocks, asked))
    if not of_queries["rows"]:
        return spark.createDataFrame([], _OUT)
    # a grid of groups of query blocks and groups of data blocks: as few of the first as their size allows
    down = -(-of_queries["rows"] * 8 * dim // query_bytes)
    across = max(1, min(of_data["blocks"], -(-4 * spark.sparkContext.defaultParallelism // down)))
    across = max(across, -(-of_queries["rows"] * of_data["rows"] // (down * PAIRS)))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select("*", group(down).alias("y"), each(across).alias("z"), F.lit(0).alias("kind"))
    c = blocks.select("*", each(down).alias("y"), group(across).alias("z"), F.lit(1).alias("kind"))
    grid = q.unionByName(c).withColumn("cell", F.col("y") * across + F.col("z")).repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "kind", "block")
    found = written(grid.mapInArrow(_scan(dim, kind, step, middle, k, _HELD), _FOUND), "candidates")
    # from blocks to places in files: one short row a block
    place = blocks.select("block", "uri", F.col("at").alias("base"))
    q_place = asked.select(F.col("block").alias("q_block"), F.col("uri").alias("q_uri"), F.col("at").alias("q_base"))
    small = (of_data["blocks"] + of_queries["blocks"]) * 256 <= BROADCAST_BYTES
    tasks = max(1, min(found.count() // 20_000 + 1, 100_000))
    if small:  # places are looked up after the shuffle, which carries numbers only
        met = found.repartition(tasks, "q_block", "q_at").join(F.broadcast(place), "block").join(F.broadcast(q_place), "q_block")
    else:
        met = found.join(place, "block").join(q_place, "q_block").repartition(tasks, "q_block", "q_at")
    met = met.select("q_block", "q_at", "q_uri", "q_base", "q_id", "block", "at", "id", "uri", "base", "lower", "upper").sortWithinPartitions("q_block", "q_at", "lower", "id")
    return met.mapInArrow(_refine(dim, kind, k), _OUT)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by EVERY against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), every=EVERY)


OP10_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pair AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_distance(a.e, b.e), {DECIMALS}) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM pair)
SELECT vec_id, rank::INTEGER AS rank, neighbour_id, distance FROM ranked WHERE rank <= {K}
"""
