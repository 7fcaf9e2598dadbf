"""Refinement of queries: corpus statistics, centring, whitening, pseudo-relevance feedback."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packmill.functions import vectors as V
from packmill.operators.retrieval import search

FLOOR = 1e-5
MODES = {"none": "none", "": "none", "centered": "centered", "mean_centered": "centered", "prf": "prf", "latent_prf": "prf", "whitened": "whitened", "zca": "whitened"}


def tokens_of(cells: DataFrame) -> DataFrame:
    """(cell_id, at, token)"""
    return cells.select("cell_id", F.posexplode("tokens").alias("at", "token"))


def mean_by_position(tokens: DataFrame) -> DataFrame:
    """(pos, mean) over all vectors: partial sums at the map side, one row for each dimension."""
    return tokens.select(F.posexplode("token").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def mean_vector(tokens: DataFrame) -> DataFrame:
    """One row: mean, the mean vector."""
    return mean_by_position(tokens).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mean"))


def covariance(tokens: DataFrame) -> DataFrame:
    """(i, j, cov) of the population, for all pairs of dimensions.

    Each task sums outer products of its vectors, so what is shuffled is a d x d matrix of each task.
    """

    def sums(batches):
        import pyarrow as pa

        n, s, ss = 0, None, None
        for batch in batches:
            x = np.array(batch.column("token").to_pylist(), np.float64)
            if len(x):
                n, s, ss = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if ss is None else ss + x.T @ x
        if n:
            d = len(s)
            i, j = (a.ravel() for a in np.indices((d, d)))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(d * d, float(n))), pa.array(s[i]), pa.array(s[j]), pa.array(ss.ravel())], ["i", "j", "n", "si", "sj", "sij"])

    part = tokens.select("token").mapInArrow(sums, "i int, j int, n double, si double, sj double, sij double")
    total = part.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")))
    return total.select("i", "j", (F.col("sij") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")).alias("cov"))


def whitening(tokens: DataFrame, floor: float = FLOOR) -> list[list[float]]:
    """The ZCA matrix, rows of a d x d matrix: its size depends on the vectors' length only, so it is computed at the driver."""
    rows = covariance(tokens).toPandas()
    d = int(rows["i"].max()) + 1
    c = np.zeros((d, d))
    c[rows["i"], rows["j"]] = rows["cov"]
    value, vector = np.linalg.eigh((c + c.T) / 2)
    return (vector @ np.diag(1 / np.sqrt(np.maximum(value, floor))) @ vector.T).tolist()


def _mapped(df: DataFrame, mean: DataFrame, f) -> DataFrame:
    """tokens with f(token, mean) of each vector; mean is one row."""
    return df.crossJoin(F.broadcast(mean)).withColumn("tokens", F.transform("tokens", lambda t: f(t, F.col("mean")))).drop("mean")


def centered(queries: DataFrame, cells: DataFrame, k: int, **options) -> DataFrame:
    mean = mean_vector(tokens_of(cells))
    return search(_mapped(queries, mean, V.center), _mapped(cells, mean, V.center), k, **options)


def whitened(queries: DataFrame, cells: DataFrame, k: int, **options) -> DataFrame:
    mean = mean_vector(tokens_of(cells))
    rows = F.array(*(F.array(*map(F.lit, r)) for r in whitening(tokens_of(cells))))
    f = lambda t, m: V.whiten(t, m, rows)
    return search(_mapped(queries, mean, f), _mapped(cells, mean, f), k, **options)


def feedback_centroid(first: DataFrame, cells: DataFrame, used: int = 3) -> DataFrame:
    """(query_id, centroid): the mean of all vectors of each query's best cells."""
    best = first.filter(F.col("rank") <= used).select("query_id", "cell_id").join(tokens_of(cells), "cell_id")
    by = best.select("query_id", F.posexplode("token").alias("pos", "x")).groupBy("query_id", "pos").agg(F.avg("x").alias("c"))
    return by.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("centroid"))


def feedback(queries: DataFrame, cells: DataFrame, k: int, alpha: float = 0.7, beta: float = 0.3, used: int = 3, **options) -> DataFrame:
    """Searches again with each query vector moved towards the centroid of its best cells."""
    centroid = feedback_centroid(search(queries, cells, max(k, used), **options), cells, used)
    moved = queries.join(centroid, "query_id").withColumn("tokens", F.transform("tokens", lambda t: V.expand(t, F.col("centroid"), alpha, beta))).drop("centroid")
    return search(moved, cells, k, **options)


_STRATEGIES = {"none": search, "centered": centered, "whitened": whitened, "prf": feedback}


def register(name: str, strategy, aliases: tuple = ()) -> None:
    """Adds a refinement strategy: f(queries, cells, k, **options), as search() is."""
    for alias in (name, *aliases):
        if alias.lower() in MODES:
            raise ValueError(f"there is a refinement mode {alias!r} already")
    _STRATEGIES[name.lower()] = strategy
    MODES.update(dict.fromkeys((a.lower() for a in (name, *aliases)), name.lower()))


def known(mode: str) -> str:
    """The name of a mode or of one of its aliases."""
    name = MODES.get(mode.lower())
    if name is None:
        raise ValueError(f"unknown refinement mode {mode!r}; known are {sorted(MODES)}")
    return name


def refine(mode: str, queries: DataFrame, cells: DataFrame, k: int, **options) -> DataFrame:
    """Search under a refinement mode or one of its aliases."""
    return _STRATEGIES[known(mode)](queries, cells, k, **options)
