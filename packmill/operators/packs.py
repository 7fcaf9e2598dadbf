"""Packs: groups of cells that are found, hydrated and governed together.

Tables: cells (cell_id, pack_id, owner, tokens, is_retrieval, is_view), packs (pack_id, owner, salience,
importance, tier, days), layers (pack_id, layer_idx, data), texts (pack_id, text, seq), deletions
(pack_id), edges (src, dst, edge_type, ts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packmill.functions import governance as G
from packmill.operators.graph import links
from packmill.operators.retrieval import DECIMALS, search, top
from packmill.sources.shared import written


def live(rows: DataFrame, deletions: DataFrame) -> DataFrame:
    """Rows whose pack is not deleted."""
    return rows.join(deletions.select("pack_id").distinct(), "pack_id", "left_anti")


def latest_texts(texts: DataFrame) -> DataFrame:
    """(pack_id, text): the last one written."""
    return texts.groupBy("pack_id").agg(F.max_by("text", "seq").alias("text"))


def first_of_pack(results: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The k best packs of each query, each by its best cell."""
    owned = results.join(cells.select("cell_id", "pack_id"), "cell_id")
    best = owned.groupBy("query_id", "pack_id").agg(F.max("score").alias("score"))
    return top(best, ["query_id"], k, tie="pack_id")


def govern(results: DataFrame, packs: DataFrame) -> DataFrame:
    """Adds importance, tier and days, and turns score into raw x recency x boost; an unknown pack is a new draft."""
    state = packs.select("pack_id", "importance", "tier", "days")
    joined = results.join(state, "pack_id", "left").withColumns({"tier": F.coalesce("tier", F.lit(0)), "days": F.coalesce("days", F.lit(0.0))})
    return joined.withColumn("score", F.round(G.governed(F.col("score"), F.col("days"), F.col("tier")), DECIMALS))


def read_packs(queries: DataFrame, cells: DataFrame, packs: DataFrame, texts: DataFrame, k: int, same_owner: bool = True, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, pack_id, score, tier, text): k packs by raw score, then ordered by the governed one."""
    # more cells than packs are asked for only where a pack has views
    found = search(queries, cells, k, same_owner=same_owner, skip_self=skip_self) if "is_view" not in cells.columns else search(queries, cells, 4 * k, same_owner=same_owner, skip_self=skip_self)
    best = govern(first_of_pack(found, cells, k).drop("rank"), packs)
    return top(best, ["query_id"], k, tie="pack_id").join(texts, "pack_id", "left").select("query_id", "rank", "pack_id", "score", "tier", "text")


def read_packs_boosted(queries: DataFrame, cells: DataFrame, packs: DataFrame, edges: DataFrame, k: int, factor: float = 0.3, same_owner: bool = True, skip_self: bool = False) -> DataFrame:
    """As read_packs, of max(5k, 10) candidates, with the raw score times 1 + factor x links before governance."""
    wide = max(5 * k, 10)
    found = first_of_pack(search(queries, cells, wide, same_owner=same_owner, skip_self=skip_self), cells, wide).drop("rank")
    degree = links(edges).groupBy("pack_id").agg(F.count("*").alias("links"))
    boosted = found.join(degree, "pack_id", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    boosted = boosted.withColumn("score", F.col("score") * (1 + F.col("links") * factor))
    return top(govern(boosted, packs), ["query_id"], k, tie="pack_id").select("query_id", "rank", "pack_id", "score", "links", "tier")


def follow(results: DataFrame, edges: DataFrame, packs: DataFrame) -> DataFrame:
    """(query_id, pack_id, score, followed): the results, and the packs of one link more, of the same owner, with score 0."""
    shown = results.select("query_id", "pack_id", "score", F.lit(False).alias("followed"))
    owner = packs.select("pack_id", "owner")
    step = results.select("query_id", "pack_id").join(owner, "pack_id").join(links(edges), "pack_id")
    linked = step.join(owner.select(F.col("pack_id").alias("other"), F.col("owner").alias("other_owner")), "other").filter("owner = other_owner")
    linked = linked.select("query_id", F.col("other").alias("pack_id")).distinct().join(results.select("query_id", "pack_id"), ["query_id", "pack_id"], "left_anti")
    return shown.unionByName(linked.select("query_id", "pack_id", F.lit(0.0).alias("score"), F.lit(True).alias("followed")))


def hydrate(results: DataFrame, layers: DataFrame) -> DataFrame:
    """The results with their layers as an array in order of layer_idx."""
    by_pack = layers.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("layer_idx", "data"))).alias("layers"))
    return results.join(by_pack, "pack_id", "left")


def explode_packs(packs: DataFrame, first_cell: int = 0) -> DataFrame:
    """(cell_id, pack_id, owner, layer, is_retrieval, data): the retrieval cell and one for each layer, ids in order of pack and layer.

    packs has pack_id, owner, retrieval_key and layers, an array of (layer_idx, data).
    """
    key = packs.select("pack_id", "owner", F.lit(-1).alias("layer"), F.lit(True).alias("is_retrieval"), F.col("retrieval_key").alias("data"))
    layer = packs.select("pack_id", "owner", F.inline("layers")).select("pack_id", "owner", F.col("layer_idx").alias("layer"), F.lit(False).alias("is_retrieval"), "data")
    return number(key.unionByName(layer), "cell_id", ["pack_id", "layer"], first_cell)


def number(df: DataFrame, name: str, by: list[str], first: int = 0) -> DataFrame:
    """Consecutive ids in order, without one task for all rows: rows are range-partitioned, and each partition starts after the rows before it."""
    # written once, so that counting and numbering see the same partitions
    keyed = written(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return keyed.join(start.select("_part", "_start"), "_part").withColumn(name, (F.col("_start") + at - 1 + first).cast("long")).drop("_part", "_start")


def advance(packs: DataFrame, days: float) -> DataFrame:
    """Time passes: days grow, and each whole day crossed lets importance decay and the tier be judged anew."""
    crossed = (F.floor(F.col("days") + days) - F.floor("days")).cast("int")
    importance = F.when(crossed > 0, G.decayed(F.col("importance"), crossed)).otherwise(F.col("importance"))
    moved = packs.withColumns({"importance": importance, "tier": F.when(crossed > 0, G.next_tier(F.col("tier"), importance)).otherwise(F.col("tier"))})
    return moved.withColumn("days", F.col("days") + days)


def evictable(packs: DataFrame, threshold: float = 15.0, owner: int | None = None) -> DataFrame:
    """Drafts below the threshold, of one owner if given."""
    weak = packs.filter((F.col("tier") == G.DRAFT) & (F.col("importance") < threshold))
    return weak if owner is None else weak.filter(F.col("owner") == owner)


def sweep(packs: DataFrame, hours: float = 1.0, threshold: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """(packs that stay, packs that go) after some hours."""
    moved = advance(packs, hours / 24) if hours > 0 else packs
    gone = evictable(moved, threshold)
    return moved.join(gone.select("pack_id"), "pack_id", "left_anti"), gone


def view_counts(cells: DataFrame) -> DataFrame:
    """(pack_id, views): retrieval cells but one, 0 at least."""
    return cells.groupBy("pack_id").agg(F.greatest(F.count_if("is_retrieval") - 1, F.lit(0)).alias("views"))


def prefix(packs: DataFrame, texts: DataFrame, budget: int | None = None, validated: bool = True) -> DataFrame:
    """(owner, position, pack_id, tier, line, cost): what goes into each owner's memory prefix, core and validated packs by importance.

    With a budget of tokens an owner's list ends before the first line that does not fit; the heading is paid first.
    """
    from packmill.functions.texts import bullet, token_estimate

    fit = packs.filter(F.col("tier") >= (1 if validated else 2)).join(texts.filter("text is not null"), "pack_id")
    line = fit.withColumn("line", bullet(F.col("text"))).withColumn("cost", token_estimate(F.concat("line", F.lit("\n"))))
    order = Window.partitionBy("owner").orderBy(F.desc("importance"), "pack_id")
    placed = line.withColumns({"position": F.row_number().over(order), "spent": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    heading = max(1, len("Memory context:\n") // 4)
    placed = placed if not budget else placed.filter(F.col("spent") + heading <= budget)
    return placed.select("owner", "position", "pack_id", "tier", "line", "cost")
