"""Pluggable parts, the hot set, buffers and stores: cases beyond what queries show."""

import numpy as np
import pytest

from packmill.functions import support
from packmill.operators import refine, retrieval as R
from packmill.operators.hotset import HotSet
from packmill.plans import protocols
from packmill.plans.buffer import WriteBuffer
from packmill.plans.engine import Engine
from packmill.sources import store as ST

CELLS = "cell_id bigint, owner bigint, key array<double>"
PACK = "row_no int, owner bigint, tokens array<array<double>>, salience double, text string, layers array<struct<layer_idx: int, data: array<double>>>"


def test_hot_set_forgets_what_is_used_least(spark):
    cells = spark.createDataFrame([(i, i % 2, np.eye(8)[i].tolist()) for i in range(8)], CELLS)
    hot = HotSet(spark, 4)
    assert len(hot) == 0 and hot.query(cells.withColumnRenamed("cell_id", "query_id"), 2).count() == 0
    hot.insert(cells.filter("cell_id < 4"))
    q = spark.createDataFrame([(9, 0, np.eye(8)[0].tolist())], "query_id bigint, owner bigint, key array<double>")
    assert [r["cell_id"] for r in hot.query(q, 1).collect()] == [0]  # cell 0 is touched
    hot.insert(cells.filter("cell_id in (4, 5)"))
    assert sorted(r["cell_id"] for r in hot.entries.collect()) == [0, 3, 4, 5]
    hot.insert(cells.filter("cell_id = 3"))
    hot.insert(cells.filter("cell_id > 5"))
    assert sorted(r["cell_id"] for r in hot.entries.collect()) == [3, 5, 6, 7]
    hot.remove(cells.filter("cell_id = 6").select("cell_id"))
    assert len(hot) == 3
    with pytest.raises(ValueError):
        HotSet(spark, 0)


def packs(spark, ids):
    return spark.createDataFrame([(i, 1, [[1.0, float(i)]], 50.0, None, []) for i in ids], PACK)


def test_write_buffer(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    b = WriteBuffer(e, 4)
    assert b.flush() == 0
    assert [r["pack_id"] for r in b.enqueue(packs(spark, [0, 1, 2])).orderBy("row_no").collect()] == [1, 2, 3]
    assert e.packs().count() == 0
    assert [r["pack_id"] for r in b.enqueue(packs(spark, [3])).collect()] == [4]
    assert e.packs().count() == 4 and b.size == 0
    b.enqueue(packs(spark, [4]))
    assert (b.flush(), b.flush()) == (1, 0)
    assert sorted(r["pack_id"] for r in e.packs().collect()) == [1, 2, 3, 4, 5]
    assert [r["pack_id"] for r in e.write_packs(packs(spark, [9])).collect()] == [6]
    with pytest.raises(ValueError):
        WriteBuffer(e, 0)


def test_opening_a_pack_that_is_not_there(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.write_cells(spark.createDataFrame([(0, 1, [1.0, 0.0], 50.0)], "row_no int, owner bigint, key array<double>, salience double"))
    with pytest.raises(KeyError):
        e.open_packs(spark.createDataFrame([(7,)], "pack_id bigint"))
    assert e.open_packs(spark.createDataFrame([(1,)], "pack_id bigint")).first()["importance"] == 58.0


def test_snapshot_through_the_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.write_packs(packs(spark, [0, 1]))
    e.snapshot(f"file://{tmp_path}/out")
    back = Engine.restored(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/again")
    assert back.packs().count() == 2
    (next((tmp_path / "out" / "packs").glob("*.parquet"))).write_bytes(b"damaged")
    with pytest.raises(ValueError):
        Engine.restored(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/third")


def test_edges_through_a_checkpoint(spark, tmp_path):
    s = ST.Store(spark, f"file://{tmp_path}/store")
    assert s.checkpoint_edges() == 0
    rows = spark.createDataFrame([(1, 2, 0, 5), (1, 2, 0, 3), (2, 1, 0, 4), (None, 1, 0, 1)], "src bigint, dst bigint, edge_type int, ts bigint")
    s.append("edges", rows)
    assert s.checkpoint_edges() == 2
    s.append("edges", rows)
    assert sorted(tuple(r) for r in s.edges().collect()) == [(1, 2, 0, 3), (2, 1, 0, 4)]


def test_refinement_can_be_added(spark):
    cells = spark.createDataFrame([(i, 0, [np.eye(3)[i].tolist()]) for i in range(3)], "cell_id bigint, owner bigint, tokens array<array<double>>")
    q = cells.withColumnRenamed("cell_id", "query_id")
    refine.register("only-one", lambda queries, cells, k, **o: R.search(queries, cells, 1, **o), ("single",))
    assert refine.refine("SINGLE", q, cells, 3).count() == 3
    for name in ("only-one", "none"):
        with pytest.raises(ValueError):
            refine.register(name, R.search)
    with pytest.raises(ValueError):
        refine.refine("nothing", q, cells, 1)


def test_registry_and_retriever(spark):
    r = protocols.Registry("scorer")
    r.add("Max", max)
    assert r["max"] is max and "MAX" in r and r.names() == ["max"]
    with pytest.raises(ValueError):
        r.add("max", min)
    with pytest.raises(ValueError):
        r["other"]
    cells = spark.createDataFrame([(i, 0, [np.eye(3)[i].tolist()]) for i in range(3)], "cell_id bigint, owner bigint, tokens array<array<double>>")
    kept = R.Retriever(cells.filter("cell_id < 2"))
    assert isinstance(kept, protocols.Retriever)
    kept.insert(cells.filter("cell_id = 2"))
    kept.remove(cells.filter("cell_id = 0").select("cell_id"))
    assert len(kept) == 2 and kept.query(cells.withColumnRenamed("cell_id", "query_id"), 1).count() == 3


def test_retries():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert support.retrying(flaky, 4, 1.0, 3.0, waits.append)("a") == "a" and waits == [1.0, 3.0]
    with pytest.raises(support.Exhausted):
        support.retrying(lambda: 1 / 0, 2, sleep=waits.append)()
    with pytest.raises(ValueError):
        support.retrying(flaky, 0)
