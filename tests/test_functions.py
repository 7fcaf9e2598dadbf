import numpy as np
import pytest
from pyspark.sql import functions as F

from packmill.functions import quantize as Q, texts as X, vectors as V
from packmill.operators import ann, retrieval as R
from packmill.streaming.streams import step


def one(spark, value, schema, f):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("v")).alias("r")).first()["r"]


def test_round_half_away_and_quantisation_error(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(size=70)] + [0.0]
    back = one(spark, v, "v array<double>", lambda c: Q.q4_restore(Q.q4(c)))
    assert len(back) == 71 and np.abs(np.array(back) - v).max() <= np.abs(v).max() / 14 + 1e-9
    packed = one(spark, v, "v array<double>", lambda c: Q.q4_unpack(Q.q4_pack(Q.q4(c)), F.size(c)))
    assert list(packed) == list(one(spark, v, "v array<double>", lambda c: Q.q4(c)["codes"]))
    assert list(one(spark, [0.0, 0.0], "v array<double>", lambda c: Q.int8_restore(Q.int8(c)))) == [0.0, 0.0]


def test_recall_after_quantisation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 64)) * np.where(rng.random(64) < 0.05, 10, 1)
    cells = spark.createDataFrame([(i, 1, r.tolist()) for i, r in enumerate(x)], "cell_id bigint, owner bigint, key array<double>")
    q = cells.withColumnRenamed("cell_id", "query_id")
    near = lambda c: {(r["query_id"], r["cell_id"]) for r in R.brute_force(q, c, 5, skip_self=True).collect()}
    exact, coarse = near(cells), near(cells.withColumn("key", Q.q4_restore(Q.q4(F.col("key")))))
    assert len(exact & coarse) / len(exact) >= 0.8
    eight = near(cells.withColumn("key", Q.int8_groups_restore(Q.int8_groups(F.col("key")))))
    assert len(exact & eight) / len(exact) >= 0.95


def test_broad_against_spike(spark):
    a = [[0.6] + [0.0] * 7] * 5
    b = [[1.0] + [0.0] * 7] + [[0.0] * k + [1.0] + [0.0] * (7 - k) for k in range(1, 5)]
    cells = spark.createDataFrame([(1, 1, a), (2, 1, b), (3, 2, b)], "cell_id bigint, owner bigint, tokens array<array<double>>")
    q = spark.createDataFrame([(0, 1, [[1.0] + [0.0] * 7])], "query_id bigint, owner bigint, tokens array<array<double>>")
    assert [r["cell_id"] for r in R.search(q, cells, 5).orderBy("rank").collect()] == [1, 2]
    assert R.search(q, cells, 1, how="max").first()["cell_id"] == 2


@pytest.mark.parametrize("boundary", ["whitespace", "sentence", "paragraph"])
def test_chunks_cover_the_text(boundary):
    text = "\n\n".join(" ".join(f"word{k}x{j}" for j in range(30)) + "." for k in range(20))
    chunks = X.chunk_words(text, 64, 8, boundary)
    assert [c[3] for c in chunks] == list(range(len(chunks))) and all(c[4] <= 64 for c in chunks)
    assert chunks[0][1] == 0 and chunks[-1][2] == len(text)
    assert all(text[a:b].strip() == t for t, a, b, *_ in chunks)
    assert {w for t, *_ in chunks for w in t.split()} == set(text.split())
    assert X.chunk_words("", 5, 1) == X.chunk_words(None, 5, 1) == X.chunk_words("  \n", 5, 1) == []
    assert X.chunk_chars("aa bb cc", 5) == ["aa", "bb cc"] or X.chunk_chars("aa bb cc", 5) == ["aa bb", "cc"]
    pieces = X.chunk_chars(text.replace("\n", " "), 40)
    assert all(0 < len(p) <= 40 for p in pieces) and " ".join(pieces).split() == text.split()


def test_framings(spark):
    q = lambda t: one(spark, t, "v string", X.question)
    assert q("Ada Lovelace wrote the first program") == "What did Ada Lovelace wrote do?"
    assert q("The cat sat").endswith("?")
    assert one(spark, "He built a machine, then moved", "v string", X.paraphrase) == "then relocated, He constructed a machine"
    assert one(spark, "D1:3", "v string", X.session_index) == 1 and one(spark, "x", "v string", X.session_index) is None


def test_tier_hysteresis():
    assert step(50.0, 0, "write", 0) == (55.0, 0)
    assert step(62.0, 0, "read", 0) == (65.0, 1)
    assert step(82.0, 1, "read", 0)[1] == 2
    assert step(62.0, 2, "days", 0)[1] == 2 and step(60.0, 2, "days", 1)[1] == 1
    assert step(40.0, 2, "days", 100)[1] == 0


def test_rope_and_keys(spark):
    v = [float(i) for i in range(8)]
    turned = one(spark, v, "v array<double>", lambda c: V.rotate(V.rotate(c, F.lit(5)), F.lit(5), back=True))
    assert np.allclose(turned, v)
    t = [[1.0, 2.0], [3.0, 4.0]]
    assert [list(x) for x in one(spark, t, "v array<array<double>>", lambda c: V.decode_key(V.encode_key(c)))] == t


def test_graph_search_finds_what_exact_search_finds(spark):
    x = np.random.default_rng(4).normal(size=(1200, 16))
    cells = spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(x)], "cell_id bigint, owner bigint, key array<double>")
    q = cells.withColumnRenamed("cell_id", "query_id")
    pairs = lambda df: {(r["query_id"], r["cell_id"]) for r in df.collect()}
    exact, found = pairs(R.brute_force(q, cells, 10, skip_self=True)), pairs(ann.ann_search(q, cells, 10, skip_self=True, shard=500))
    assert len(exact & found) / len(exact) >= 0.9
