import hashlib
import math

import pytest

from helpers import docs_of, rows_of, same, with_clashes
from packmill.llm import sharding as H


def draw(path, key):
    return (int(hashlib.md5(f"{path}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def brute(key, tree=H.TREE):
    node, path, out = tree, "/", []
    for _ in H.LEVELS:
        name = min((-math.log(draw(path + n, key)) / H.weight_of(c), n) for n, c in node.items() if H.weight_of(c) > 0)[1]
        out.append(name)
        path += name + "/"
        node = node[name]
    return tuple(out)


def test_each_level_by_hand(spark):
    docs = docs_of(spark, [(i, "x") for i in range(500)])
    got = {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in H.assign(docs).collect()}
    assert got == {i: brute(i) for i in range(500)}


def test_shares_follow_the_weights(spark):
    n = 20_000
    got = H.assign(spark.range(n).withColumnRenamed("id", "doc_id")).groupBy("region", "rack", "shard").count().collect()
    whole = H.weight_of(H.TREE)
    assert len(got) == sum(len(s) for r in H.TREE.values() for s in r.values())
    for r in got:
        want = n * H.TREE[r["region"]][r["rack"]][r["shard"]] / whole
        assert abs(r["count"] - want) < 6 * want**0.5


def test_only_changed_subtrees_move(spark):
    import copy

    changed = copy.deepcopy(H.TREE)
    changed["west"]["r1"]["s1"] *= 2
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    before, after = ({r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in H.assign(ids, t).collect()} for t in (H.TREE, changed))
    moved = {i for i in before if before[i] != after[i]}
    assert moved
    for i in moved:  # into the subtree that got heavier; what was in it already moves only below the node that did
        assert after[i][0] == "west"
        assert before[i][0] != "west" or after[i][1] == "r1"
        assert before[i][:2] != ("west", "r1") or after[i] == ("west", "r1", "s1")
    gone = copy.deepcopy(H.TREE)
    del gone["north"]["r2"]["s3"]
    later = {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in H.assign(ids, gone).collect()}
    for i in before:
        if before[i] != later[i]:  # out of the subtrees that lost weight, and nowhere else
            assert before[i][0] == "north"


def test_all_cases(spark):
    docs = with_clashes(docs_of(spark, [(1, None), (1, "x"), (None, "y"), (None, ""), (2, "z" * 10**6)]))
    got = H.assign(docs)
    assert got.columns == [*docs.columns, "_region", "_rack", "_shard"]
    rows = got.collect()
    assert len(rows) == 5 and all(r["_shard"] for r in rows)
    assert len({(r["_region"], r["_rack"], r["_shard"]) for r in rows if r["doc_id"] is None}) == 1
    assert [r["region"] for r in rows] == ["own region"] * 5
    assert H.assign(docs_of(spark, [])).count() == 0
    zero = {"a": {"r": {"s": 1.0, "t": 0.0}}, "b": {"r": {"s": 0.0}}}
    assert {(r["region"], r["shard"]) for r in H.assign(docs_of(spark, [(i, "") for i in range(50)]), zero).collect()} == {("a", "s")}
    with pytest.raises(ValueError):
        H.assign(docs, {"a": {"r": {"s": 0.0}}})


def test_sql(spark, duck):
    got, want = same(H.op7_sharding(spark, "/root/testdata/sf0.001"), duck.sql(H.OP7_SQL))
    assert got == want


def test_a_map_of_children_chooses_what_nested_cases_choose(spark):
    docs = docs_of(spark, [(i, "t") for i in range(500)] + [(None, "t")])
    plain, mapped = (rows_of(H.assign(docs, plain_nodes=n).select("doc_id", "region", "rack", "shard")) for n in (10**6, 0))
    assert plain == mapped


def test_thousands_of_shards(spark):
    tree = {f"r{a}": {f"k{b}": {f"s{c}": 1.0 + c % 3 for c in range(20)} for b in range(15)} for a in range(10)}
    got = H.assign(docs_of(spark, [(i, "t") for i in range(3000)]), tree).select("region", "rack", "shard").distinct().count()
    assert got > 1500
