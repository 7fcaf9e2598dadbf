import sys

import corpus_pipeline as P
from test_decontaminate import brute as leaks
from test_mixing import expected as mixed
from test_sharding import brute as shard
from test_simhash import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [name for name, _ in P.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    import __spark_entry__ as E

    ours = {q for q in E.queries() if q.startswith("op") or q == "pipeline"}
    assert len([q for q in ours if q.startswith("op")]) == 10 and "pipeline" in ours
    assert P.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()


def test_run_against_brute_force(spark):
    """Every stage in plain Python, on what the one before it kept."""
    from packmill.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    severity = {r["doc_id"]: r["rejected"] for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if not severity[r["doc_id"]]}
    assert len(rows) < docs.count()
    for i, group, _, kept in brute_groups(list(rows), [r["text"] for r in rows.values()]):
        if not kept:
            del rows[i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    from packmill.llm.decontaminate import Automaton

    hit = {list(rows)[f[0]] for f in Automaton(items).find([r["text"] for r in rows.values()])}
    small = [(i, r["text"]) for i, r in rows.items() if r["text"] and len(r["text"]) < 1500]
    assert {d for d, *_, short in leaks(small, items) if not short} == hit & {i for i, _ in small}
    rows = {i: r for i, r in rows.items() if i not in hit}
    kept = {i for i, _, _ in mixed([(i, r["text"], r["source"]) for i, r in rows.items()])}
    want = sorted((i, rows[i]["text"], *shard(i)) for i in kept)
    got = P.run(spark, SF)
    assert got.columns == [*docs.columns, "region", "rack", "shard"]
    assert sorted((r["doc_id"], r["text"], r["region"], r["rack"], r["shard"]) for r in got.collect()) == want


def test_stages_keep_the_columns_and_take_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).union(spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (2, "", None, "", 0), (3, "x" * 200_000, "en", "s", 1)], docs.schema))
    for table in (odd, docs.limit(0)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns, name
            out.collect()
        assert P.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_import_errors_are_not_swallowed():
    assert "packmill.llm.common" in sys.modules
    source = open(P.__file__).read()
    assert "except" not in source
