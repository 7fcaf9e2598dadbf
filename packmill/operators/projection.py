"""Maps between two vector spaces, fitted on paired vectors: least squares, canonical correlation, truncation.

Tasks sum outer products, so what reaches the driver is a few d x d matrices whatever the number of
pairs; the maps are applied as column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packmill.functions import vectors as V


def _moments(pairs: DataFrame) -> tuple[int, np.ndarray, np.ndarray, int]:
    """(pairs, sum, sum of outer products, length of a) of the joined vectors a and b; pairs with a null or of other lengths than the first ones are left out."""

    def sums(batches):
        n, s, ss, d = 0, None, None, 0
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if not a or not b or None in a or None in b:
                    continue
                x = np.concatenate([a, b])
                if s is None:
                    s, ss, d = np.zeros(len(x)), np.zeros((len(x), len(x))), len(a)
                if len(x) == len(s) and len(a) == d:
                    n, s, ss = n + 1, s + x, ss + np.outer(x, x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([d]), pa.array([len(s)]), pa.array([s.tobytes()], pa.binary()), pa.array([ss.tobytes()], pa.binary())], ["n", "d", "size", "s", "ss"])

    rows = pairs.select(F.col("a").cast("array<double>").alias("a"), F.col("b").cast("array<double>").alias("b")).mapInArrow(sums, "n bigint, d bigint, size bigint, s binary, ss binary")
    got = rows.collect()  # one small row for each task
    if not got:
        raise ValueError("no pair to fit on")
    d, size = max(((r["d"], r["size"]) for r in got), key=lambda k: sum(r["n"] for r in got if (r["d"], r["size"]) == k))
    got = [r for r in got if (r["d"], r["size"]) == (d, size)]
    return sum(r["n"] for r in got), sum(np.frombuffer(r["s"]) for r in got), sum(np.frombuffer(r["ss"]).reshape(size, size) for r in got), d


def least_squares(pairs: DataFrame) -> np.ndarray:
    """W with W a near b, for pairs (a, b): rows of b's length."""
    _, _, ss, d = _moments(pairs)
    return np.linalg.pinv(ss[:d, :d]) @ ss[:d, d:] if d == 0 else (np.linalg.pinv(ss[:d, :d], hermitian=True) @ ss[:d, d:]).T


def canonical(pairs: DataFrame, components: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(W_a, W_b, correlations): both spaces' maps to shared components, strongest first."""
    n, s, ss, d = _moments(pairs)
    c = ss / n - np.outer(s / n, s / n)

    def root(m):
        value, vector = np.linalg.eigh(m + ridge * np.eye(len(m)))
        return vector / np.sqrt(np.maximum(value, 1e-12)) @ vector.T

    ra, rb = root(c[:d, :d]), root(c[d:, d:])
    u, strength, v = np.linalg.svd(ra @ c[:d, d:] @ rb, full_matrices=False)
    # a component's sign is free: its largest weight is positive
    sign = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    return (u * sign).T[:components] @ ra, (v.T * sign).T[:components] @ rb, strength[:components]


def apply(w: np.ndarray, v: Column) -> Column:
    """W v for a column of vectors."""
    return F.transform(F.array(*(F.array(*map(F.lit, map(float, r))) for r in w)), lambda r: V.dot(r, v))


def truncated(v: Column, size: int) -> Column:
    return F.when(F.size(v) <= size, v).otherwise(F.slice(v, 1, size))
