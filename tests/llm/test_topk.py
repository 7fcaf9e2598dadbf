import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from helpers import rows_of, same
from packmill.llm import topk as N

VECTORS = "vec_id bigint, embedding array<float>"


def brute(rows, k, every=1):
    """All distances, sorted; rows of the most common length only."""
    out = []
    for a, (i, x) in enumerate(rows):
        if i % every:
            continue
        near = sorted((round(float(np.sqrt(((np.array(x, np.float32).astype(float) - np.array(y, np.float32).astype(float)) ** 2).sum())), N.DECIMALS), j) for b, (j, y) in enumerate(rows) if b != a)
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_exact_for_any_block(spark, block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=(150, 6)).astype(np.float32)
    x[40:60] = x[0:20]  # ties
    rows = [(i % 140, v.tolist()) for i, v in enumerate(x)]  # repeated ids
    assert rows_of(N.nearest(spark.createDataFrame(rows, VECTORS), 5, block)) == brute(rows, 5)


def test_all_cases(spark):
    from pyspark.sql import functions as F

    good = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0]), (3, [5.0, 1.0])]
    bad = [(None, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(good + bad, VECTORS).withColumns({c: F.lit("own") for c in ("id", "row", "v", "block", "rank", "distance")})
    assert rows_of(N.nearest(df, 10)) == brute(good, 10)
    assert N.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert N.nearest(spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)).count() == 0
    same_ = [(i, [2.0, 2.0]) for i in range(30)]
    assert rows_of(N.nearest(spark.createDataFrame(same_, VECTORS), 4, 8)) == brute(same_, 4)


def exact(rows, k, every=1):
    """The neighbours of each query by all distances, in doubles."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        far = np.round(np.sqrt(((x - x[a]) ** 2).sum(1)), N.DECIMALS)
        order = [b for b in np.lexsort((ids, far)) if b != a][:k]
        out += [(int(ids[a]), r + 1, int(ids[b]), float(far[b])) for r, b in enumerate(order)]
    return sorted(out, key=repr)


DOUBLES = "vec_id bigint, embedding array<double>"


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e6])
def test_far_from_the_origin(spark, offset):
    x = np.random.default_rng(5).normal(size=(300, 8)) * 1e-3 + offset
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert rows_of(N.nearest(spark.createDataFrame(rows, DOUBLES), 5, 64)) == exact(rows, 5)


def test_huge_and_flat_values(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 4)) * np.array([1e200, 1.0, 0.0, 1e-200])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    with np.errstate(over="ignore"):
        assert rows_of(N.nearest(spark.createDataFrame(rows, DOUBLES), 3, 16)) == exact(rows, 3)


@pytest.mark.parametrize("query_bytes", [2_000, 1 << 25])
def test_stated_queries_in_groups(spark, query_bytes):
    """Queries are the rows whose id is divisible; a third of all rows are one vector, whose ids are spread."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    x[rng.permutation(3000)[:1000]] = x[17]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, DOUBLES).repartition(5)
    assert rows_of(N.nearest(df, 10, 128, every=50, query_bytes=query_bytes)) == exact(rows, 10, 50)


def test_files_are_read_in_place_of_a_join(spark, monkeypatch):
    """Beyond the broadcast limit places are joined; the rows are the same."""
    x = np.random.default_rng(8).normal(size=(500, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(N, "BROADCAST_BYTES", 0)
    assert rows_of(N.nearest(spark.createDataFrame(rows, DOUBLES), 4, 32, every=7)) == exact(rows, 4, 7)


@pytest.mark.parametrize("loose", [False, True])
def test_memory_does_not_follow_the_number_of_queries(loose):
    """4000 queries meet blocks of 2048: no array of all pairs, even if no bound excludes any pair."""
    rng = np.random.default_rng(9)
    k, n, d, step = 10, 4000, 4, np.full(4, 1 / 32)
    x = rng.normal(size=(n, d)) / 2
    scan = N._Scan(step, k)
    scan.add_query(0, np.arange(n), np.arange(n), x)
    seen = np.zeros(n, np.int64)

    def pass_on(batches):
        for b in [batches] if isinstance(batches, pa.RecordBatch) else batches or ():
            np.add.at(seen, b.column("q_id").to_numpy(), 1)

    tracemalloc.start()
    try:
        for block in range(2):
            codes = rng.integers(64, 192, size=(2048, d)).astype(np.uint8)
            rows = np.arange(2048) + 2048 * block
            pass_on(scan.data(block, rows, rows, codes.ravel(), np.full(2048, 1e3 if loose else 1e-2)))
        pass_on(scan.found())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 160e6
    if loose:
        assert (seen == 2 * 2048 - (np.arange(n) < 2 * 2048)).all()
    else:
        assert seen.min() >= k and seen.mean() < 4 * k


def test_memory_does_not_follow_a_query_s_candidates(tmp_path):
    """A query with 400 000 candidates in batches of 5000, half of which must be read, between two with 3 each."""
    rng = np.random.default_rng(11)
    n, k, d = 400_000, 1000, 2
    x = np.concatenate([np.zeros((1, d)), rng.normal(size=(n, d))])
    x[n // 2 + 1 :] += 100
    (tmp_path / "x").write_bytes(x.tobytes())
    query = np.repeat([0, 1, 2], [3, n, 3])
    at = np.concatenate([[1, 2, 3], np.arange(1, n + 1), [4, 5, 6]])
    lower = np.where(at > n // 2, 90.0, 0.0)

    def batches():
        for lo in range(0, len(query), 5000):
            q, a, low = (c[lo : lo + 5000] for c in (query, at, lower))
            none, uri = np.zeros(len(q), np.int64), pa.array([str(tmp_path / "x")] * len(q))
            yield pa.RecordBatch.from_pydict({"q_block": q, "q_at": none.astype(np.int32), "q_uri": uri, "q_base": none, "q_id": q, "block": none, "at": a.astype(np.int32), "id": a, "uri": uri, "base": none, "lower": low, "upper": np.full(len(q), np.inf)})

    work = N._refine(d, np.float64, k)
    tracemalloc.start()
    try:
        got = [tuple(r.values()) for b in work(batches()) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48e6
    far = np.round(np.sqrt((x * x).sum(1)), N.DECIMALS)
    want = []
    for q, seen in enumerate([range(1, 4), range(1, n + 1), range(4, 7)]):
        want += [(q, r + 1, i, float(far[i])) for r, i in enumerate(sorted(seen, key=lambda i: (far[i], i))[:k])]
    assert got == want


@pytest.mark.parametrize("held,broadcast", [(40, 0), (400, 1 << 26)])
def test_queries_a_few_at_a_time(spark, monkeypatch, held, broadcast):
    """Tasks that hold few candidates take queries in parts and pass candidates on early; frequent vectors also without broadcast. The rows are the same."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[rng.permutation(700)[:200]] = x[3]
    x[rng.permutation(700)[:30]] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(N, "_HELD", held)
    monkeypatch.setattr(N, "BROADCAST_BYTES", broadcast)
    assert rows_of(N.nearest(spark.createDataFrame(rows, VECTORS).repartition(3), 5, 64, every=3)) == exact(rows, 5, 3)


def test_very_long_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3000).tolist()) for i in range(12)]
    assert rows_of(N.nearest(spark.createDataFrame(rows, VECTORS), 3)) == brute(rows, 3)


def test_sql(spark, duck):
    got, want = same(N.op10_topk(spark, "/root/testdata/sf0.001"), duck.sql(N.OP10_SQL))
    assert got == want
