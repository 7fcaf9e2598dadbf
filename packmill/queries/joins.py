"""J3-J14, G1-G5, U2-U5, P4-P16, K7-K8: joins, links, set operations and filters over packs, edges and turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from packmill.operators import graph, packs as P
from packmill.queries.base import CELLS, EDGES, LINKS, MCELLS, PACKS, TURNS, cells, mcells, pack_cells, pack_edges, packs, query, table, texts, turns

#: Packs whose number is a multiple of 7 stand for deleted ones.
_DEAD = "dead AS (SELECT cell_id + 1 AS pack_id FROM mcells WHERE (cell_id + 1) % 7 = 0)"


def dead(spark, d):
    return pack_cells(spark, d).select("pack_id").filter("pack_id % 7 = 0")


@query("J3_hydrate_candidates", f"WITH {CELLS}, cand AS (SELECT event_id, event_id % 997 AS cell_id FROM events) SELECT event_id, cell_id, owner FROM cand JOIN cells USING (cell_id)")
def hydrate_candidates(spark, d):
    cand = table(spark, d, "events").select("event_id", (F.col("event_id") % 997).alias("cell_id"))
    return cand.join(cells(spark, d).select("cell_id", "owner"), "cell_id").select("event_id", "cell_id", "owner")


@query("J4_cells_to_packs", f"WITH {CELLS}, {MCELLS} SELECT c.cell_id, m.cell_id + 1 AS pack_id, m.owner AS pack_owner FROM cells c JOIN mcells m ON m.cell_id = c.cell_id // 5")
def to_packs(spark, d):
    c = cells(spark, d).select("cell_id", F.expr("cell_id div 5 + 1").alias("pack_id"))
    return c.join(pack_cells(spark, d).select("pack_id", F.col("owner").alias("pack_owner")), "pack_id").select("cell_id", "pack_id", "pack_owner")


@query("J5_hydrate_layers", f"WITH {MCELLS} SELECT cell_id + 1 AS pack_id, generate_subscripts(tokens, 1) - 1 AS layer_idx, round(unnest(tokens)[1], 6) + 0.0::DOUBLE AS first FROM mcells")
def layers(spark, d):
    c = pack_cells(spark, d)
    rows = c.select("pack_id", F.posexplode("tokens").alias("layer_idx", "data"))
    full = P.hydrate(c.select("pack_id"), rows)
    return full.select("pack_id", F.inline("layers")).select("pack_id", F.col("layer_idx").cast("long").alias("layer_idx"), F.round(F.element_at("data", 1), 6).alias("first"))


@query("J6_governance_defaults", f"WITH RECURSIVE {PACKS} SELECT event_id, event_id % 211 AS pack_id, coalesce(tier, 0) AS tier, coalesce(days, 0.0::DOUBLE) AS days FROM events LEFT JOIN packs ON packs.pack_id = event_id % 211")
def defaults(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 211).alias("pack_id"))
    joined = e.join(packs(spark, d).select("pack_id", "tier", "days"), "pack_id", "left")
    return joined.select("event_id", "pack_id", F.coalesce("tier", F.lit(0)).alias("tier"), F.coalesce("days", F.lit(0.0)).alias("days"))


@query("J7_pack_texts", f"WITH {MCELLS} SELECT cell_id + 1 AS pack_id, owner, text FROM mcells LEFT JOIN documents ON doc_id = cell_id + 1")
def pack_texts(spark, d):
    return pack_cells(spark, d).select("pack_id", "owner").join(texts(spark, d), "pack_id", "left")


@query("J8_G4_pack_links", f"WITH {EDGES}, {LINKS} SELECT pack_id, other FROM links")
def pack_links(spark, d):
    return graph.links(pack_edges(spark, d))


for _type, _name in enumerate(("caused_by", "follows", "contradicts", "supports")):

    @query(f"G4_{_name}_links", f"WITH {EDGES}, {LINKS} SELECT DISTINCT pack_id, other FROM both_ways WHERE edge_type = {_type}")
    def typed_links(spark, d, edge_type=_type):
        return graph.links(pack_edges(spark, d), edge_type)


@query("J10_not_yet_retrieved", f"WITH {EDGES}, {LINKS} SELECT pack_id, other FROM links WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = links.pack_id AND e.dst = links.other)")
def not_retrieved(spark, d):
    e = pack_edges(spark, d)
    return graph.links(e).join(e.select(F.col("src").alias("pack_id"), F.col("dst").alias("other")), ["pack_id", "other"], "left_anti")


@query("J11_G3_turn_ancestors", f"WITH {TURNS} SELECT a.node, b.node AS ancestor FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn < a.turn")
def turn_ancestors(spark, d):
    t = turns(spark, d)
    back = graph.chain_edges(t, "conv_id", "turn", "node", graph.CAUSED_BY)
    return graph.ancestors(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))


@query("G3_pack_ancestors", f"WITH RECURSIVE {EDGES}, used AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 0), reach AS (SELECT src AS node, dst AS ancestor FROM used UNION SELECT r.node, u.dst FROM reach r JOIN used u ON u.src = r.ancestor) SELECT node, ancestor FROM reach")
def pack_ancestors(spark, d):
    return graph.ancestors(pack_edges(spark, d))


@query("J14_turn_dates", f"WITH {TURNS}, day AS (SELECT user_id, min(epoch_us(ts)) AS first FROM events GROUP BY 1) SELECT node, coalesce(first, 0) AS first FROM turns LEFT JOIN day ON day.user_id = conv_id")
def turn_dates(spark, d):
    day = table(spark, d, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("first"))
    return turns(spark, d).join(day, "conv_id", "left").select("node", F.coalesce("first", F.lit(0)).alias("first"))


@query("G1_edges_both_directions", f"WITH {EDGES}, {LINKS} SELECT pack_id, other, edge_type FROM both_ways")
def both_directions(spark, d):
    return graph.both_ways(pack_edges(spark, d))


@query("G2_outgoing_incoming", f"WITH {EDGES}, n AS (SELECT src AS pack_id, count(*) AS o, 0 AS i FROM edges GROUP BY 1 UNION ALL SELECT dst, 0, count(*) FROM edges GROUP BY 1) SELECT pack_id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM n GROUP BY 1")
def degrees(spark, d):
    e = graph.outgoing(pack_edges(spark, d))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("pack_id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("pack_id"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("pack_id").agg(F.sum("o").alias("outgoing"), F.sum(1 - F.col("o")).alias("incoming"))


@query("P8_edges_of_type", f"WITH {EDGES} SELECT src, dst, edge_type FROM edges WHERE edge_type = 3")
def of_type(spark, d):
    return graph.outgoing(pack_edges(spark, d), graph.SUPPORTS)


@query("G5_graph_counts", f"WITH {EDGES} SELECT (SELECT count(*) FROM (SELECT DISTINCT src, dst, edge_type FROM edges)) AS edge_count, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS node_count")
def graph_counts(spark, d):
    return graph.counts(pack_edges(spark, d))


@query("U2_intersection", f"WITH {EDGES} SELECT src AS pack_id FROM edges WHERE edge_type = 1 INTERSECT SELECT dst FROM edges WHERE edge_type = 2")
def intersection(spark, d):
    e = pack_edges(spark, d)
    return e.filter("edge_type = 1").select(F.col("src").alias("pack_id")).intersect(e.filter("edge_type = 2").select("dst"))


@query("U3_difference", f"WITH {MCELLS}, {_DEAD} SELECT cell_id + 1 AS pack_id FROM mcells EXCEPT SELECT pack_id FROM dead")
def difference(spark, d):
    return pack_cells(spark, d).select("pack_id").exceptAll(dead(spark, d)).distinct()


@query("U4_ordered_distinct", "SELECT user_id, event_type, min(epoch_us(ts)) AS first FROM events GROUP BY ALL")
def ordered_distinct(spark, d):
    """Each user's kinds of event, by first occurrence."""
    e = table(spark, d, "events").select("user_id", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "event_type").alias("s"))
    seen = e.groupBy("user_id").agg(F.array_sort(F.collect_list("s")).alias("ss"))
    once = seen.select("user_id", "ss", F.explode(F.array_distinct(F.transform("ss", lambda s: s["event_type"]))).alias("event_type"))
    return once.select("user_id", "event_type", F.element_at(F.filter("ss", lambda s: s["event_type"] == F.col("event_type")), 1)["t"].alias("first"))


@query("U5_union_of_keys", "SELECT l_returnflag AS system FROM lineitem WHERE l_linenumber < 4 UNION SELECT o_orderstatus FROM orders ORDER BY 1")
def union_keys(spark, d):
    a = table(spark, d, "lineitem").filter("l_linenumber < 4").select(F.col("l_returnflag").alias("system"))
    return a.union(table(spark, d, "orders").select("o_orderstatus")).distinct().orderBy("system")


@query("P4_index_eligible", f"WITH {MCELLS} SELECT count(*) AS cells, sum(CASE WHEN layer < 0 THEN 1 ELSE 0 END)::BIGINT AS indexed FROM (SELECT cell_id, -1 AS layer FROM mcells UNION ALL SELECT cell_id, generate_subscripts(tokens, 1) - 1 FROM mcells)")
def eligible(spark, d):
    c = pack_cells(spark, d).select("pack_id", "owner", F.element_at("tokens", 1).alias("retrieval_key"), F.transform("tokens", lambda t, i: F.struct(i.alias("layer_idx"), t.alias("data"))).alias("layers"))
    return P.explode_packs(c).agg(F.count("*").alias("cells"), F.count_if("is_retrieval").alias("indexed"))


@query("P5_live_packs", f"WITH {MCELLS}, {_DEAD} SELECT cell_id + 1 AS pack_id, owner FROM mcells WHERE cell_id + 1 NOT IN (SELECT pack_id FROM dead)")
def live(spark, d):
    return P.live(pack_cells(spark, d).select("pack_id", "owner"), dead(spark, d))


@query("P6_tier_filter", f"WITH RECURSIVE {PACKS} SELECT pack_id, owner, tier FROM packs WHERE tier >= 1")
def tier_filter(spark, d):
    return packs(spark, d).filter("tier >= 1").select("pack_id", "owner", "tier")


@query("P9_due_entries", "SELECT event_id AS id, epoch_us(ts) AS fires_at FROM events WHERE ts <= TIMESTAMP '2024-01-05 00:00:00' ORDER BY fires_at, id")
def due(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").filter("ts <= timestamp'2024-01-05 00:00:00'").select(F.col("event_id").alias("id"), at.alias("fires_at")).orderBy("fires_at", "id")


@query("P10_exists", f"WITH {MCELLS} SELECT doc_id, EXISTS (SELECT 1 FROM mcells WHERE cell_id + 1 = doc_id) AS pack_exists, EXISTS (SELECT 1 FROM mcells WHERE owner = doc_id % 13) AS owner_exists FROM documents")
def exists(spark, d):
    c = pack_cells(spark, d)
    have = c.select(F.col("pack_id").alias("doc_id"), F.lit(True).alias("p"))
    own = c.select(F.col("owner").alias("o")).distinct().withColumn("w", F.lit(True))
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 13).alias("o"))
    return docs.join(have, "doc_id", "left").join(own, "o", "left").select("doc_id", F.coalesce("p", F.lit(False)).alias("pack_exists"), F.coalesce("w", F.lit(False)).alias("owner_exists"))


@query("P11_point_lookup", f"WITH RECURSIVE {PACKS} SELECT p.pack_id, tier, round(importance, 6) AS importance, text FROM packs p LEFT JOIN documents ON doc_id = pack_id WHERE pack_id = 42")
def lookup(spark, d):
    return packs(spark, d).filter("pack_id = 42").join(texts(spark, d), "pack_id", "left").select("pack_id", "tier", F.round("importance", 6).alias("importance"), "text")


@query("P12_load_pack", f"WITH {MCELLS} SELECT 42 AS pack_id, generate_subscripts(tokens, 1) - 1 AS layer_idx, len(unnest(tokens))::BIGINT AS size, 0.0::DOUBLE AS score FROM mcells WHERE cell_id = 41")
def load_pack(spark, d):
    got = mcells(spark, d).filter("cell_id = 41").select(F.lit(42).alias("pack_id"), F.posexplode("tokens").alias("i", "v"))
    return got.select("pack_id", F.col("i").cast("long").alias("layer_idx"), F.size("v").cast("long").alias("size"), F.lit(0.0).alias("score"))


@query("P13_forget_by_text", "SELECT doc_id FROM documents WHERE text IS NULL OR NOT contains(text, 'the ')")
def forget(spark, d):
    return table(spark, d, "documents").filter("text is null or not contains(text, 'the ')").select("doc_id")


@query("P14_evidence_adjacent", f"WITH {TURNS} SELECT node, text FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM turns WHERE trim(coalesce(text, '')) <> '') WHERE before IS NULL OR before <> text")
def evidence(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, d).filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("before", F.lag("text").over(w))
    return rows.filter("before is null or before <> text").select("node", "text")


@query("P15_evidence_distinct", "WITH r AS (SELECT lang, text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY ALL), n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM r) SELECT lang, doc_id, rank FROM n WHERE rank <= 10")
def evidence_distinct(spark, d):
    """The first ten distinct texts of each language; the limit is the feature."""
    first = table(spark, d, "documents").filter("text is not null").groupBy("lang", "text").agg(F.min("doc_id").alias("doc_id"))
    return first.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).cast("long").alias("rank")).filter("rank <= 10")


@query("K7_ordered_output", "SELECT l_linestatus AS dataset, l_orderkey AS item_id, l_returnflag AS system, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY ALL")
def ordered(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("dataset"), F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("system")).agg(F.count("*").alias("n"))
    return t.orderBy("dataset", "item_id", "system", "n")


@query("K8_max_items", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10")
def max_items(spark, d):
    """The first items; the limit is the feature."""
    return table(spark, d, "benchmark").orderBy("item_id").limit(10)
