"""Searches beyond the sizes of the small tables, against plain NumPy."""

import numpy as np
import pytest

from packmill.operators import ann, retrieval as R
from packmill.queries import QUERIES, SQL
from packmill.queries.base import as_queries

SF = "/root/testdata/sf0.001"


def test_candidates_follow_the_rule():
    """All of up to 512 cells, then max(256, 64 k); the SQL of R4 and K5 has the same rule."""
    assert [R.candidates_for(n, 5) for n in (0, 20, 512, 513, 5000)] == [0, 20, 512, 320, 320] and R.candidates_for(600, 20) == 600
    assert all(str(R.PREFILTER_ABOVE) in SQL[q] and "<= 20" not in SQL[q] for q in ("R4_candidate_reduction", "K5_candidate_limit"))
    assert all("lang" not in SQL[q] for q in ("J13_gold_containment", "A17_A18_recall_ndcg"))


def test_rerank_beyond_the_prefilter(spark):
    """700 cells, so that only 320 candidates of a query are scored: those of the best mean vectors, as plain NumPy finds them."""
    x = np.random.default_rng(3).normal(size=(700, 3, 8)).round(3)
    cells = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, owner bigint, tokens array<array<double>>")
    got = {(r["query_id"], r["cell_id"]) for r in R.two_phase(as_queries(cells.filter("cell_id % 70 = 0")), cells, 5, 700, skip_self=True).collect()}
    mean = x.mean(1)
    want = set()
    for q in range(0, 700, 70):
        pre = [c for c in np.lexsort((np.arange(700), -np.round(mean @ mean[q] / np.sqrt(8), R.DECIMALS))) if c != q][:320]
        score = np.round(np.sort((x[q] @ x[pre].transpose(0, 2, 1) / np.sqrt(8)).reshape(320, -1), 1)[:, -5:].mean(1), R.DECIMALS)
        want |= {(q, int(pre[i])) for i in np.lexsort((pre, -score))[:5]}
    assert got == want


@pytest.mark.parametrize("query_bytes, block", [(1 << 25, 4096), (2000, 16)])
def test_search_in_a_grid(spark, monkeypatch, query_bytes, block):
    """Any grid gives the same rows; NaN scores come last, cells of other lengths do not meet, repeated cells count one by one."""
    monkeypatch.setattr(R, "QUERY_BYTES", query_bytes)
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, rng.normal(size=(1 + i % 4, 6)).round(2).tolist()) for i in range(120)]
    rows += [(200, 0, [[float("nan")] * 6]), (201, 0, [[1.0, 2.0]]), (202, None, [[0.5] * 6]), (203, 0, None), (204, 0, []), (5, 2, rows[5][2])]
    cells = spark.createDataFrame(rows, "cell_id bigint, owner bigint, tokens array<array<double>>")
    for same in (False, True, "other"):
        got = sorted((r["query_id"], r["rank"], r["cell_id"]) for r in R.search(as_queries(cells.filter("cell_id < 10")), cells, 7, same_owner=same, skip_self=True, block=block).collect() if r["query_id"] != 5)
        want = []
        for q, own, t in rows[:10]:
            if q == 5:
                continue
            scored = []
            for c, o, u in rows:
                o = -1 if o is None else o
                if c != q and u and len(u[0]) == 6 and (same is False or (o == own) == (same is True)):
                    s = np.sort((np.array(t) @ np.array(u).T / np.sqrt(6)).ravel())[::-1][:5].mean()
                    scored.append((np.isnan(s), -round(float(s), 6) if not np.isnan(s) else 0.0, c))
            want += [(q, i + 1, c) for i, (_, _, c) in enumerate(sorted(scored)[:7])]
        assert got == sorted(want), same


def test_a_grid_spreads_the_work():
    """Many blocks use many tasks, and a task's pairs are bounded."""
    down, across = R.grid_of(10**6, 10**6 * 512, 10**8, 25_000, 64)
    assert down == 16 and down * across >= 64 and 10**6 * 10**8 / (down * across) <= R.PAIRS
    assert R.grid_of(10, 100, 10, 1, 64) == (1, 1)


def test_read_tokens_is_exact_beyond_the_prefilter(spark, tmp_path):
    """2000 cells of one owner, whose mean vectors say little of their pairs; each query's best 5 are those of all pairs."""
    x = np.random.default_rng(1).normal(size=(2000, 5, 64)).round(4)
    rows = [(c * 5 + t, 0, x[c, t].tolist()) for c in range(len(x)) for t in range(5)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["cell_id"]) for r in QUERIES["R14_read_tokens"](spark, str(tmp_path)).filter("query_id % 50 = 0").collect()}
    s = np.einsum("qid,cjd->qcij", x[::50], x).reshape(40, 2000, 25) / np.sqrt(x.shape[2])
    score = np.sort(s, axis=2)[:, :, -5:].mean(2).round(6)
    want = {(q * 50, int(c)) for q in range(40) for c in np.argsort(-score[q], kind="stable")[:5]}
    assert len(got & want) / len(want) >= 0.99


def test_planned_search_beyond_its_threshold(spark):
    """Recall of the graphs on 10 500 cells against all pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 10_500)] + rng.normal(size=(10_500, 64))
    cells = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, owner bigint, key array<double>")
    q = as_queries(cells.filter("cell_id % 100 = 0"))
    pairs = lambda df: {(r["query_id"], r["cell_id"]) for r in df.collect()}
    exact, found = pairs(R.brute_force(q, cells, 5, skip_self=True)), pairs(ann.planned(q, cells, 5, skip_self=True))
    print("recall", len(exact & found) / len(exact))
    assert len(exact & found) / len(exact) >= 0.9
