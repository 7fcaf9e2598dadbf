import pytest

from packmill.plans.engine import Engine

PACK = "row_no int, owner bigint, tokens array<array<double>>, salience double, text string, layers array<struct<layer_idx: int, data: array<double>>>"
QUERY = "query_id bigint, owner bigint, tokens array<array<double>>"


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    rows = [(i, i % 2, [[float(i == j) for j in range(4)], [0.0, 0.0, 0.0, 0.1]], 20.0 * i, f"text {i}" if i else None, [(1, [2.0 * i]), (0, [1.0 * i])]) for i in range(4)]
    got = e.write_packs(spark.createDataFrame(rows, PACK)).collect()
    assert sorted((r["row_no"], r["pack_id"]) for r in got) == [(i, i + 1) for i in range(4)]
    return e


def test_read_is_by_owner_and_governed(spark, engine):
    q = spark.createDataFrame([(7, 0, [[0.0, 0.0, 1.0, 0.0]])], QUERY)
    rows = engine.read_packs(q, 2).orderBy("rank").collect()
    assert [r["pack_id"] for r in rows] == [3, 1] and rows[0]["text"] == "text 2"
    assert rows[0]["score"] > rows[1]["score"] == 0.0 or rows[1]["score"] < rows[0]["score"]
    assert engine.read_packs(q, 0).count() == 0
    for mode in ("none", "prf"):
        engine.set_refinement_mode(mode)
        assert engine.read_cells(q, 1).first()["cell_id"] in (1024, 3072)
    with pytest.raises(ValueError):
        engine.set_refinement_mode("other")


def test_governance_evicts_only_weak_drafts(spark, engine):
    assert {r["pack_id"]: (r["importance"], r["tier"]) for r in engine.packs().collect()} == {1: (5.0, 0), 2: (25.0, 0), 3: (45.0, 0), 4: (65.0, 1)}
    engine.log_access(spark.createDataFrame([(3, "read", 0)] * 7, "pack_id bigint, action string, days int"))
    assert engine.packs().filter("pack_id = 3").first()["tier"] == 1
    assert engine.evict_drafts(30.0, 1) == 1 and engine.evict_drafts(30.0, 1) == 0
    i = engine.schedule_evict_drafts(100, 30.0)
    j = engine.schedule_evict_drafts(200, 100.0)
    assert engine.cancel_scheduled(j) and not engine.cancel_scheduled(j)
    assert [r["id"] for r in engine.list_scheduled().collect()] == [i]
    assert engine.fire_due(99) == 0 and engine.fire_due(100) == 1 and engine.fire_due(300) == 0
    assert sorted(r["pack_id"] for r in engine.packs().collect()) == [3, 4]
    engine.advance_days(2.5)
    assert engine.packs().filter("pack_id = 4").first()["importance"] == pytest.approx(65 * 0.995**2)


def test_edges_views_texts_and_deletion(spark, engine):
    e = spark.createDataFrame([(3, 2, 0), (2, 1, 0), (3, 2, 0), (1, 3, 3)], "src bigint, dst bigint, edge_type int")
    engine.add_edges(e)
    engine.add_edges(e)
    assert {(r["node"], r["ancestor"]) for r in engine.ancestors().collect()} == {(3, 2), (3, 1), (2, 1)}
    assert {(r["pack_id"], r["other"]) for r in engine.pack_links(3).collect()} == {(1, 3), (3, 1)}
    assert tuple(engine.status().first()) == (4, 2, 4, 3, 3)
    q = spark.createDataFrame([(7, 0, [[1.0, 0.0, 0.0, 0.0]])], QUERY)
    followed = engine.read_packs(q, 1, 0.3, follow=True).collect()
    assert {(r["pack_id"], r["followed"]) for r in followed} == {(1, False), (3, True)}
    assert engine.add_view_keys(spark.createDataFrame([(1, 1, [[0.0, 1.0, 0.0, 0.0]]), (99, 1, [[1.0]])], "pack_id bigint, view_no int, tokens array<array<double>>")) == 1
    assert {r["pack_id"]: r["views"] for r in engine.view_count().collect()}[1] == 1
    with pytest.raises(KeyError):
        engine.set_pack_texts(spark.createDataFrame([(1, "new"), (99, "none")], "pack_id bigint, text string"))
    engine.set_pack_texts(spark.createDataFrame([(1, "new")], "pack_id bigint, text string"))
    assert {r["pack_id"]: r["text"] for r in engine.list_packs().collect()}[1] == "new"
    assert [list(x) for x in engine.load_packs(spark.createDataFrame([(2,)], "pack_id bigint")).first()["layers"]] == [[0, [1.0]], [1, [2.0]]]
    assert engine.delete_owner(0) == 2 and engine.delete_owner(0) == 0
    assert [r["owner"] for r in engine.list_owners().collect()] == [1]
    assert engine.compact(0.9)["cells"]["rows_dropped"] >= 2
    assert engine.read_packs(q, 5).count() == 0
