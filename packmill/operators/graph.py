"""Typed edges between packs: a table (src, dst, edge_type, ts) with each (src, dst, edge_type) once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packmill.sources.shared import written

CAUSED_BY, FOLLOWS, CONTRADICTS, SUPPORTS = range(4)


def both_ways(edges: DataFrame) -> DataFrame:
    """(pack_id, other, edge_type), from either end; not a pack with itself."""
    there = edges.select(F.col("src").alias("pack_id"), F.col("dst").alias("other"), "edge_type")
    back = edges.select(F.col("dst").alias("pack_id"), F.col("src").alias("other"), "edge_type")
    return there.unionByName(back).filter("pack_id <> other").distinct()


def links(edges: DataFrame, edge_type: int | None = None) -> DataFrame:
    """(pack_id, other): distinct neighbours in either direction, of one type if given."""
    used = both_ways(edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type))
    return used.select("pack_id", "other").distinct()


def outgoing(edges: DataFrame, edge_type: int | None = None) -> DataFrame:
    used = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    return used.select("src", "dst", "edge_type")


def chain_edges(rows: DataFrame, by: str, order: str, node: str, edge_type: int = SUPPORTS) -> DataFrame:
    """An edge from each row to the next one of its group."""
    then = F.lead(node).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("dst", then).filter("dst is not null").select(F.col(node).alias("src"), "dst", F.lit(edge_type).alias("edge_type"))


def all_pairs(rows: DataFrame, by: str, node: str, edge_type: int = FOLLOWS) -> DataFrame:
    """An edge for every pair of a group, from the smaller node."""
    a, b = rows.select(by, F.col(node).alias("src")), rows.select(by, F.col(node).alias("dst"))
    return a.join(b, by).filter("src < dst").select("src", "dst", F.lit(edge_type).alias("edge_type"))


def ancestors(edges: DataFrame, starts: DataFrame | None = None, edge_type: int | None = CAUSED_BY, most_rounds: int | None = None) -> DataFrame:
    """(node, ancestor): all that a node reaches along edges of a type; itself only on a cycle.

    Each round joins the paths found last with the edges and drops what was reached before; rounds are
    written tables, and they end when one finds nothing.
    """
    used = written(outgoing(edges, edge_type).select("src", "dst").distinct(), "edges")
    found = used.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"))
    if starts is not None:
        found = found.join(starts.select("node").distinct(), "node", "left_semi")
    reached = last = written(found, "reached")
    rounds = 1
    while most_rounds is None or rounds < most_rounds:
        more = last.join(used, last["ancestor"] == used["src"]).select("node", F.col("dst").alias("ancestor")).distinct()
        last = written(more.join(reached, ["node", "ancestor"], "left_anti"), "frontier")
        if last.isEmpty():
            break
        reached = written(reached.unionByName(last), "reached")
        rounds += 1
    return reached


def counts(edges: DataFrame) -> DataFrame:
    """One row: edge_count, node_count."""
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).agg(F.countDistinct("n").alias("node_count"))
    return edges.select("src", "dst", "edge_type").distinct().agg(F.count("*").alias("edge_count")).crossJoin(nodes)
