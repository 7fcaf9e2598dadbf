"""Operator 7: sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child of the node draws
-ln(u) / weight, with u a hash of the child's path and the document, and the smallest draw wins: a
child gets its share of the weight, and a child's draws depend on nothing but its own path and weight.
A node weighs what its shards weigh together, so a changed shard moves documents only into or out of
the subtrees that hold it. The draws are plain column expressions: no shuffle, no Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.llm.common import fresh, table, unit_hash, unit_hash_sql

#: region -> rack -> shard -> weight
TREE = {
    "east": {"r1": {"s1": 4.0, "s2": 4.0, "s3": 2.0}, "r2": {"s1": 3.0, "s2": 3.0}, "r3": {"s1": 1.0, "s2": 1.0, "s3": 1.0, "s4": 1.0}},
    "north": {"r1": {"s1": 5.0, "s2": 2.5}, "r2": {"s1": 2.0, "s2": 2.0, "s3": 2.0}},
    "west": {"r1": {"s1": 6.0, "s2": 1.0}, "r2": {"s1": 2.0, "s2": 4.0, "s3": 4.0}, "r3": {"s1": 8.0}},
}
LEVELS = "region", "rack", "shard"


def weight_of(node) -> float:
    return sum(map(weight_of, node.values())) if isinstance(node, dict) else float(node)


def _children(node: dict) -> list[tuple[str, float]]:
    found = [(name, weight_of(child)) for name, child in sorted(node.items()) if weight_of(child) > 0]
    if not found or any(weight_of(c) < 0 for c in node.values()):
        raise ValueError("every node needs a child of positive weight, and no weight may be negative")
    return found


def _pick(node: dict, path: str, key: Column) -> Column:
    draws = [F.struct((-F.log(unit_hash(F.lit(path + name), key)) / weight).alias("d"), F.lit(name).alias("c")) for name, weight in _children(node)]
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["c"]


def _branch(node: dict, path: str, above: list[Column], depth: int, key: Column) -> Column:
    """The choice at `depth` below node, for rows whose choices above it are the given columns."""
    if depth == 0:
        return _pick(node, path, key)
    out = None
    for name, _ in _children(node):
        hit, then = above[0] == name, _branch(node[name], f"{path}{name}/", above[1:], depth - 1, key)
        out = F.when(hit, then) if out is None else out.when(hit, then)
    return out


#: Nodes from which on a level's children stand in one literal map rather than in nested cases, which code could not hold.
PLAIN_NODES = 64


def _children_by_path(node: dict, path: str, depth: int) -> dict:
    if depth == 0:
        return {path: _children(node)}
    return {k: v for name, _ in _children(node) for k, v in _children_by_path(node[name], f"{path}{name}/", depth - 1).items()}


def _look_up(tree: dict, above: list[Column], depth: int, key: Column) -> Column:
    """What _branch chooses, from a map of each node's children."""
    found = _children_by_path(tree, "/", depth)
    kind = "map<string,array<struct<c:string,w:double>>>"
    children = F.from_json(F.lit(json.dumps({p: [{"c": c, "w": w} for c, w in v] for p, v in found.items()})), kind)
    path = F.concat(F.lit("/"), *(F.concat(a, F.lit("/")) for a in above)) if above else F.lit("/")
    draw = lambda x: F.struct((-F.log(unit_hash(F.concat(path, x["c"]), key)) / x["w"]).alias("d"), x["c"].alias("c"))
    return F.array_min(F.transform(F.element_at(children, path), draw))["c"]


def assign(docs: DataFrame, tree: dict | None = None, key: str = "doc_id", plain_nodes: int = PLAIN_NODES) -> DataFrame:
    """docs with the columns region, rack and shard; where docs has such a column, the new one gets a leading underscore.

    Cases: a null key is hashed as an empty one, so all such rows share a shard; rows of equal key go
    together; of equal draws the first name wins; children of weight 0 get nothing; an empty table stays empty.
    """
    tree = TREE if tree is None else tree
    hashed = F.coalesce(F.col(key).cast("string"), F.lit(""))
    names: list[str] = []
    for depth, level in enumerate(LEVELS):
        name = fresh(docs, level)
        above = [F.col(n) for n in names]
        many = sum(map(len, _children_by_path(tree, "/", depth).values())) > plain_nodes
        docs = docs.withColumn(name, _look_up(tree, above, depth, hashed) if many else _branch(tree, "/", above, depth, hashed))
        names.append(name)
    return docs


def _sql_pick(node: dict, path: str, key: str) -> str:
    found = _children(node)
    draws = [f"(-ln({unit_hash_sql(repr(path + name), key)}) / {weight!r}::DOUBLE)" for name, weight in found]
    cases = [f"WHEN {' AND '.join(f'{draws[i]} <= {d}' for d in draws[i + 1 :])} THEN '{found[i][0]}'" for i in range(len(found) - 1)]
    return f"CASE {' '.join(cases)} ELSE '{found[-1][0]}' END" if cases else f"'{found[-1][0]}'"


def assign_sql(source: str, columns: str, tree: dict | None = None, key: str = "doc_id") -> str:
    """assign() in DuckDB's SQL: `columns` of the table or query `source`, and the three levels."""
    tree = TREE if tree is None else tree
    k = f"coalesce(CAST({key} AS VARCHAR), '')"
    region = _sql_pick(tree, "/", k)
    rack = "CASE " + " ".join(f"WHEN region = '{r}' THEN {_sql_pick(tree[r], f'/{r}/', k)}" for r, _ in _children(tree)) + " END"
    shard = "CASE " + " ".join(f"WHEN region = '{r}' AND rack = '{c}' THEN {_sql_pick(tree[r][c], f'/{r}/{c}/', k)}" for r, _ in _children(tree) for c, _ in _children(tree[r])) + " END"
    return f"SELECT {columns}, region, rack, {shard} AS shard FROM (SELECT *, {rack} AS rack FROM (SELECT *, {region} AS region FROM {source}))"


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


OP7_SQL = assign_sql("documents", "doc_id, source, n_chars")
