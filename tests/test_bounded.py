"""Steps whose figures follow their input: results against plain Python, and shapes of plans that would grow."""

import numpy as np
import pytest

from packmill.operators import ann, evaluate as E, retrieval as R
from packmill.queries import QUERIES, SQL
from packmill.queries.base import as_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_snippets_are_found_in_one_pass(spark):
    """Each snippet's first document of each class; anchors that texts share, short snippets, ends of texts, text of several bytes a character."""
    texts = ["abcdefgh1 abcdefgh2", "abcdefgh2", "über die brücke", "xx" * 700_000 + "abcdefgh3", "abcdefgh", "e3", "brücke ", "abcdefg", "abcdefgh2 über die", ""]
    snippets = ["abcdefgh1", "abcdefgh2", "abcdefgh3", "über die", "brücke", "ü", "e3", "not there at all", "h2 über d"]
    docs = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)] + [(99, 0, None)], "doc_id bigint, cls bigint, text string").repartition(3)
    got = {(r["snippet"], r["cls"]): r["doc_id"] for r in E.first_holding(snippets, docs).collect()}
    want = {}
    for i, t in enumerate(texts):
        for n, s in enumerate(snippets):
            if s in t:
                want.setdefault((n, i % 3), i)
    assert got == want


@pytest.mark.parametrize("name", ["A17_A18_recall_ndcg", "J13_gold_containment"])
def test_gold_is_not_met_with_every_text(spark, name):
    """Texts are looked through where they are scanned, so no join or window carries them to each query."""
    assert "contains(" not in plan(QUERIES[name](spark, SF)).lower()


def test_search_bounds_its_batches_and_keeps_ties(spark):
    """Blocks come one at a time however many a task has; among equal scores the smallest ids stay, whatever single precision makes of them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, 64 << 20)
    x = np.random.default_rng(7).integers(-2, 3, (400, 2, 5)) * 0.3333333
    x[:50] *= 1000.0
    cells = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, owner bigint, tokens array<array<double>>").repartition(3)
    for how in ("max", "top_mean", "sum_max"):
        for same in (False, True, "other"):
            got = {(r["query_id"], r["rank"]): r["cell_id"] for r in R.search(as_queries(cells), cells, 7, how=how, same_owner=same, skip_self=True, block=100).collect()}
            dots = np.einsum("qid,cjd->qcij", x, x) / np.sqrt(5)
            score = {"max": dots.max((2, 3)), "sum_max": dots.max(3).sum(2), "top_mean": dots.mean((2, 3))}[how].round(R.DECIMALS)
            owner = np.arange(400) % 3
            ok = (owner[:, None] == owner) == (same is True) if same else np.ones((400, 400), bool)
            score[~ok | np.eye(400, dtype=bool)] = -np.inf
            assert got == {(q, r + 1): int(c) for q in range(400) for r, c in enumerate(np.lexsort((np.arange(400), -score[q]))[:7])}, (how, same)
    assert int(spark.conf.get(name)) <= 4 << 20


def test_nominations_are_no_rows(spark):
    """Cells of a group meet as blocks, not by a join of pairs."""
    assert "(g#" not in plan(QUERIES["J9_semi_join_candidates"](spark, SF))


@pytest.mark.parametrize("name", "A2_max_sim_pairs A3_top5_pairs DX1_pair_trace DX2_cosine_scores F23_per_head_max_sim J1_query_by_corpus J2_token_pairs U1_union_earliest_stage WN1_first_of_pack WN2_top_k_hof F42_lexical_overlap F43_word_overlap".split())
def test_pairs_are_scored_in_blocks(spark, name):
    """No join gives a row for each pair, to be scored number by number."""
    assert "Join Cross" not in plan(QUERIES[name](spark, SF))


def test_whole_ranking_sorts_no_pairs(spark):
    assert "Window" not in plan(QUERIES["DX14_dense_rank"](spark, SF))


@pytest.mark.parametrize("name", ["P12_open_packs", "W22_drop_first_token"])
def test_a_pack_of_one_vector(spark, tmp_path, name):
    """The last pack has one vector only: two layers all the same, and no row where nothing is left of it."""
    import duckdb

    spark.createDataFrame([(i, 1, [float(i), 1.0]) for i in range(11)], "vec_id bigint, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*[c[0] for c in want.description])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_planned_search_can_be_certain(spark):
    """The graphs are a start: what comes out is what all pairs give."""
    x = np.random.default_rng(5).normal(size=(500, 16))
    cells = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "cell_id bigint, owner bigint, key array<double>")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["cell_id"], r["score"]) for r in df.collect())
    got = ann.planned(as_queries(cells), cells, 5, active_from=100, certain=True, skip_self=True)
    assert rows(got) == rows(R.brute_force(as_queries(cells), cells, 5, skip_self=True))


def test_pruned_graph_takes_vectors_as_bytes(spark):
    """One vector goes with a neighbour, not both as arrays of numbers."""
    p = plan(QUERIES["R9_pruned_graph"](spark, SF))
    assert "FlatMapGroupsInPandas" not in p and "half#" in p


def test_candidates_take_no_vectors_along(spark):
    """Ids of candidates go to blocks of queries; no row of a pair has a vector."""
    cells = spark.createDataFrame([(i, 0, [[float(i % 13), float(i % 7)]]) for i in range(600)], "cell_id bigint, owner bigint, tokens array<array<double>>")
    assert "tokens" not in plan(R.two_phase(as_queries(cells), cells, 5, 600, skip_self=True))


@pytest.mark.parametrize("name", "A21_rank_fusion A24_best_of_scorers DX4_DX5_negatives DX7_head_sweep DX8_projection_deltas R6_staged_pipeline".split())
def test_searches_run_once(spark, name):
    """What a query names several times is written first: the search is not in its plan again."""
    assert "MapInArrow" not in plan(QUERIES[name](spark, SF))


def test_graphs_are_searched_for_many_queries_at_once():
    """beams() finds what beam() does or more, in small and empty surroundings too; insertion keeps what can be found."""
    x = np.random.default_rng(9).normal(size=(700, 12))
    edges, entry = ann.build(x)
    best = np.argsort(-(x[:40] @ x.T), axis=1)[:, :8]
    share = lambda rows: np.mean([len(set(a) & set(b)) / 8 for a, b in zip(best, rows)])
    rows, dots = ann.beams(x[:40], x, ann.padded(edges), entry, 40)
    assert np.allclose(dots, np.einsum("qd,qkd->qk", x[:40], x[rows])) and (np.diff(dots, axis=1) <= 0).all()
    assert share(rows[:, :8]) >= share([ann.beam(q, x, edges, entry, 40)[0][:8] for q in x[:40]]) - 0.01
    have, wired, start = ann.insert(x[:300], *ann.build(x[:300]), x[300:])
    assert (have == x).all() and max(map(len, wired)) <= 32 and share(ann.beams(x[:40], have, ann.padded(wired), start, 40)[0][:, :8]) >= 0.95
    few, wired, start = ann.insert(x[:0], [], 0, x[:3])
    rows, dots = ann.beams(x[:2], few, ann.padded(wired), start, 10)
    assert [sorted(r[r >= 0]) for r in rows] == [[0, 1, 2]] * 2 and np.isneginf(dots[rows < 0]).all()
