"""A1, A5-A9, F1-F22, SC26: vector functions, quantisation, governance steps. Vectors leave as rows (.., i, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packmill.functions import governance as G, quantize as Q, vectors as V
from packmill.operators import projection as PR, refine
from packmill.queries.base import CELLS, MCELLS, PACKS, TOKENS, cells, mcells, packs, query, table

_R = "round({}, 6) + 0.0::DOUBLE"
#: Each cell's key number by number, and each cell beside the one after it.
FLAT = f"{CELLS}, flat AS (SELECT cell_id, generate_subscripts(key, 1) - 1 AS i, unnest(key) AS x FROM cells)"
NEXT = f"{CELLS}, next_ AS (SELECT a.cell_id, a.key AS a, b.key AS b FROM cells a JOIN cells b ON b.cell_id = a.cell_id + 1)"


def spread(df: DataFrame, ids: list[str], v: Column, digits: int | None = 6) -> DataFrame:
    """(ids, i, x) of a column of vectors."""
    out = df.select(*ids, F.posexplode(v).alias("i", "x"))
    return out.select(*ids, F.col("i").cast("long").alias("i"), (F.round("x", digits) if digits else F.col("x")).alias("x"))


def once(df: DataFrame, value: Column) -> DataFrame:
    """(cell_id, q): the value is computed once for each row, however often what follows names it."""
    return df.select("cell_id", F.explode(F.array(value)).alias("q"))


def beside(spark, d) -> DataFrame:
    c = cells(spark, d)
    then = c.select((F.col("cell_id") - 1).alias("cell_id"), F.col("key").alias("b"))
    return c.select("cell_id", F.col("key").alias("a")).join(then, "cell_id")


@query("A1_mean_pool", f"WITH {TOKENS} SELECT cell_id, i - 1 AS i, {_R.format('avg(x)')} AS x FROM (SELECT cell_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM tok) GROUP BY cell_id, i")
def mean_pool(spark, d):
    return spread(mcells(spark, d), ["cell_id"], V.mean_pool(F.col("tokens")))


@query("A5_corpus_mean", f"WITH {FLAT} SELECT i, {_R.format('avg(x)')} AS mean FROM flat GROUP BY i")
def corpus_mean(spark, d):
    tokens = refine.tokens_of(mcells(spark, d))
    return refine.mean_by_position(tokens).select(F.col("pos").cast("long").alias("i"), F.round("mean", 6).alias("mean"))


@query("A6_covariance", f"WITH {FLAT} SELECT a.i, b.i AS j, {_R.format('covar_pop(a.x, b.x)')} AS cov FROM flat a JOIN flat b ON a.cell_id = b.cell_id GROUP BY ALL")
def covariance(spark, d):
    got = refine.covariance(refine.tokens_of(mcells(spark, d)))
    return got.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("cov", 6).alias("cov"))


@query("A7_whitening_matrix")
def whitening(spark, d):
    rows = refine.whitening(refine.tokens_of(mcells(spark, d)))
    made = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<double>")
    return made.select(F.col("i").cast("long").alias("i"), F.posexplode("r").alias("j", "w")).select("i", F.col("j").cast("long").alias("j"), F.round("w", 6).alias("w"))


_SIGMA = "sigma AS (SELECT i, greatest(max(abs(x)), 1e-6::DOUBLE) AS s FROM flat WHERE cell_id < 4096 GROUP BY i)"


def sigmas(spark, d) -> DataFrame:
    """(i, s): the largest magnitude of each dimension over the first 4096 vectors, 1e-6 at least. The window is the feature."""
    first = cells(spark, d).orderBy("cell_id").limit(4096)
    by = first.select(F.posexplode("key").alias("i", "x")).groupBy("i").agg(F.greatest(F.max(F.abs("x")), F.lit(1e-6)).alias("s"))
    return by.select(F.col("i").cast("long").alias("i"), "s")


def sigma_vector(spark, d) -> DataFrame:
    return sigmas(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("sigma"))


@query("A9_channel_sigma", f"WITH {FLAT}, {_SIGMA} SELECT i, {_R.format('s')} AS s FROM sigma")
def channel_sigma(spark, d):
    return sigmas(spark, d).select("i", F.round("s", 6).alias("s"))


_ENCODED = f"{MCELLS}, enc AS (SELECT cell_id, [-1e9::DOUBLE] || [0.0::DOUBLE for z in range(32)] || [len(tokens[1])::DOUBLE] || [0.0::DOUBLE for z in range(30)] || flatten(tokens) AS key FROM mcells)"


@query("F1_encode_key", f"WITH {_ENCODED} SELECT cell_id, generate_subscripts(key, 1) - 1 AS i, {_R.format('unnest(key)')} AS x FROM enc")
def encode(spark, d):
    return spread(mcells(spark, d), ["cell_id"], V.encode_key(F.col("tokens")))


@query("F2_decode_key", f"WITH {TOKENS} SELECT cell_id, tok_at AS at, generate_subscripts(t, 1) - 1 AS i, {_R.format('unnest(t)')} AS x FROM tok")
def decode(spark, d):
    got = mcells(spark, d).withColumn("key", V.encode_key(F.col("tokens"))).select("cell_id", F.posexplode(V.decode_key(F.col("key"))).alias("at", "v"))
    return spread(got.withColumn("at", F.col("at").cast("long")), ["cell_id", "at"], F.col("v"))


@query("P7_key_kind", f"WITH {_ENCODED}, {CELLS}, keys AS (SELECT cell_id, CASE cell_id % 4 WHEN 3 THEN key[1:70] ELSE key END AS key FROM enc UNION ALL SELECT 100000 + cell_id, key FROM cells) SELECT cell_id, CASE WHEN key[1] > -1e8 THEN 'plain' WHEN len(key) > 64 AND (len(key) - 64) % round(key[34])::BIGINT = 0 THEN 'encoded' ELSE 'malformed' END AS kind FROM keys")
def key_kind(spark, d):
    e = mcells(spark, d).select("cell_id", V.encode_key(F.col("tokens")).alias("key"))
    e = e.withColumn("key", F.when(F.col("cell_id") % 4 == 3, F.slice("key", 1, 70)).otherwise(F.col("key")))
    plain = cells(spark, d).select((F.col("cell_id") + 100000).alias("cell_id"), "key")
    return e.unionByName(plain).select("cell_id", V.key_kind(F.col("key")).alias("kind"))


@query("P3_dimension_guard", f"WITH {_ENCODED} SELECT count(*) FILTER (len(key) = 384) AS sound, count(*) FILTER (len(key) <> 384) AS other FROM enc")
def guard(spark, d):
    e = mcells(spark, d).select(F.size(V.encode_key(F.col("tokens"))).alias("n"))
    return e.agg(F.count_if(F.col("n") == 384).alias("sound"), F.count_if(F.col("n") != 384).alias("other"))


@query("F3_scaled_dot", f"WITH {NEXT} SELECT cell_id, {_R.format('list_inner_product(a, b)')} AS dot, {_R.format('list_inner_product(a, b) / sqrt(len(a)::DOUBLE)')} AS scaled FROM next_")
def scaled(spark, d):
    return beside(spark, d).select("cell_id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(V.scaled_dot(F.col("a"), F.col("b")), 6).alias("scaled"))


@query("F4_cosine", f"WITH {NEXT} SELECT cell_id, {_R.format('list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))')} AS cosine FROM next_")
def cosine(spark, d):
    return beside(spark, d).select("cell_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


_INT8 = f"{FLAT}, s8 AS (SELECT cell_id, CASE WHEN max(abs(x)) > 0 THEN max(abs(x)) / 127 ELSE 1.0::DOUBLE END AS scale FROM flat GROUP BY cell_id), v8 AS (SELECT cell_id, i, x, scale, least(greatest(round(x / scale), -127), 127)::INTEGER AS q FROM flat JOIN s8 USING (cell_id))"


@query("F5_int8", f"WITH {_INT8} SELECT cell_id, i, q, {_R.format('q * scale')} AS restored FROM v8")
def int8(spark, d):
    q = once(cells(spark, d), Q.int8(F.col("key")))
    both = q.select("cell_id", F.posexplode(F.arrays_zip(F.col("q.values").alias("q"), Q.int8_restore(F.col("q")).alias("r"))).alias("i", "z"))
    return both.select("cell_id", F.col("i").cast("long").alias("i"), F.col("z.q").alias("q"), F.round("z.r", 6).alias("restored"))


@query("F6_int8_dot", f"WITH {_INT8} SELECT a.cell_id, {_R.format('sum(a.q * b.q) * any_value(a.scale) * any_value(b.scale)')} AS dot FROM v8 a JOIN v8 b ON b.cell_id = a.cell_id + 1 AND a.i = b.i GROUP BY a.cell_id")
def int8_dot(spark, d):
    return beside(spark, d).select("cell_id", F.round(Q.int8_dot(Q.int8(F.col("a")), Q.int8(F.col("b"))), 6).alias("dot"))


_Q4 = f"{FLAT}, s4 AS (SELECT cell_id, i // 32 AS g, max(abs(x)) / 7 AS scale FROM flat GROUP BY ALL), v4 AS (SELECT cell_id, i, x, scale, CASE WHEN scale > 0 THEN least(greatest(round(x / scale) + 8, 0), 15) ELSE 8 END::INTEGER AS code FROM flat JOIN s4 USING (cell_id) WHERE i // 32 = g)"


@query("F7_q4", f"WITH {_Q4} SELECT cell_id, i, code, {_R.format('(code - 8) * scale')} AS restored FROM v4")
def q4(spark, d):
    q = once(cells(spark, d), Q.q4(F.col("key")))
    both = q.select("cell_id", F.posexplode(F.arrays_zip(F.col("q.codes").alias("c"), Q.q4_restore(F.col("q")).alias("r"))).alias("i", "z"))
    return both.select("cell_id", F.col("i").cast("long").alias("i"), F.col("z.c").alias("code"), F.round("z.r", 6).alias("restored"))


@query("F7_q4_packed_bytes", f"WITH {_Q4} SELECT a.cell_id, a.i // 2 AS i, (a.code + 16 * b.code)::BIGINT AS x FROM v4 a JOIN v4 b ON a.cell_id = b.cell_id AND b.i = a.i + 1 WHERE a.i % 2 = 0")
def q4_packed(spark, d):
    q = once(cells(spark, d), Q.q4(F.col("key"))).select("cell_id", Q.q4_pack(F.col("q")).alias("b"))
    return spread(q, ["cell_id"], F.col("b"), None).withColumn("x", F.col("x").cast("long"))


@query("F8_int8_groups", f"WITH {FLAT}, s AS (SELECT cell_id, i // 32 AS g, greatest(max(abs(x)), 1e-12::DOUBLE) / 127 AS scale FROM flat GROUP BY ALL) SELECT cell_id, i, {_R.format('least(greatest(round(x / scale), -127), 127) * scale')} AS x FROM flat JOIN s USING (cell_id) WHERE i // 32 = g")
def int8_groups(spark, d):
    return spread(cells(spark, d), ["cell_id"], Q.int8_groups_restore(Q.int8_groups(F.col("key"))))


@query("F9_per_channel", f"WITH {FLAT}, {_SIGMA}, n AS (SELECT cell_id, i, x / s AS y, s AS sig FROM flat JOIN sigma USING (i)), g AS (SELECT cell_id, i // 32 AS g, greatest(max(abs(y)), 1e-12::DOUBLE) / 127 AS scale FROM n GROUP BY ALL) SELECT cell_id, i, {_R.format('least(greatest(round(y / scale), -127), 127) * scale * sig')} AS x FROM n JOIN g USING (cell_id) WHERE i // 32 = g")
def per_channel(spark, d):
    c = cells(spark, d).crossJoin(F.broadcast(sigma_vector(spark, d)))
    return spread(c, ["cell_id"], Q.per_channel_restore(Q.per_channel(F.col("key"), F.col("sigma")), F.col("sigma")))


@query("F10_recency", f"WITH RECURSIVE {PACKS} SELECT pack_id, round(exp(-greatest(days, 0.0::DOUBLE) / 30.0::DOUBLE), 9) AS recency FROM packs")
def recency(spark, d):
    return packs(spark, d).select("pack_id", F.round(G.recency(F.col("days")), 9).alias("recency"))


@query("F11_importance_steps", f"WITH RECURSIVE {PACKS} SELECT pack_id, round(least(importance + 3, 100.0::DOUBLE), 6) AS accessed, round(least(importance + 5, 100.0::DOUBLE), 6) AS updated, round(importance * pow(0.995::DOUBLE, least(pack_id, 10000)), 6) AS decayed FROM packs")
def importance_steps(spark, d):
    i = F.col("importance")
    return packs(spark, d).select("pack_id", F.round(G.accessed(i), 6).alias("accessed"), F.round(G.updated(i), 6).alias("updated"), F.round(G.decayed(i, F.col("pack_id")), 6).alias("decayed"))


@query("F12_tiers", f"WITH RECURSIVE {PACKS} SELECT pack_id, round(importance, 6) AS importance, tier FROM packs")
def tiers(spark, d):
    return packs(spark, d).select("pack_id", F.round("importance", 6).alias("importance"), "tier")


@query("F13_boost", f"WITH RECURSIVE {PACKS} SELECT pack_id, (CASE tier WHEN 2 THEN 1.25 WHEN 1 THEN 1.1 ELSE 1.0 END)::DOUBLE AS boost FROM packs")
def boost(spark, d):
    return packs(spark, d).select("pack_id", G.boost(F.col("tier")).alias("boost"))


@query("F14_mean_center", f"WITH {FLAT} SELECT cell_id, i, {_R.format('x - avg(x) OVER (PARTITION BY i)')} AS x FROM flat")
def centered(spark, d):
    c = cells(spark, d)
    mean = refine.mean_vector(c.select(F.col("key").alias("token")))
    return spread(c.crossJoin(F.broadcast(mean)), ["cell_id"], V.center(F.col("key"), F.col("mean")))


@query("F15_whiten")
def whiten(spark, d):
    c = cells(spark, d)
    tokens = c.select("cell_id", F.col("key").alias("token"))
    rows = F.array(*(F.array(*map(F.lit, r)) for r in refine.whitening(tokens)))
    return spread(c.crossJoin(F.broadcast(refine.mean_vector(tokens))), ["cell_id"], V.whiten(F.col("key"), F.col("mean"), rows))


@query("F17_token_weight", f"WITH {CELLS}, mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(key) AS x, generate_subscripts(key, 1) AS i FROM cells) GROUP BY i)) SELECT cell_id, {_R.format('least(greatest(1 - list_inner_product(key, mu) / (sqrt(list_inner_product(key, key)) * sqrt(list_inner_product(mu, mu))), 0), 1)')} AS weight FROM cells, mu")
def token_weight(spark, d):
    c = cells(spark, d)
    mean = refine.mean_vector(c.select(F.col("key").alias("token")))
    return c.crossJoin(F.broadcast(mean)).select("cell_id", F.round(V.token_weight(F.col("key"), F.col("mean")), 6).alias("weight"))


@query("F18_matvec", f"WITH {FLAT} SELECT cell_id, r AS i, {_R.format('sum(x * ((r * 7 + i * 3) % 11 - 5))')} AS x FROM flat CROSS JOIN range(4) t(r) GROUP BY ALL")
def matvec(spark, d):
    rows = F.array(*(F.array(*(F.lit(float((r * 7 + i * 3) % 11 - 5)) for i in range(64))) for r in range(4)))
    return spread(cells(spark, d), ["cell_id"], V.matvec(rows, F.col("key")))


_ANGLE = "(cell_id / pow(10000.0::DOUBLE, (i - i % 2) / 64.0::DOUBLE))"


@query("F19_rope", f"WITH {FLAT}, p AS (SELECT a.cell_id, a.i, a.x, b.x AS y FROM flat a JOIN flat b ON a.cell_id = b.cell_id AND b.i = CASE WHEN a.i % 2 = 0 THEN a.i + 1 ELSE a.i - 1 END) SELECT cell_id, i, {_R.format(f'CASE WHEN i % 2 = 0 THEN x * cos({_ANGLE}) - y * sin({_ANGLE}) ELSE y * sin({_ANGLE}) + x * cos({_ANGLE}) END')} AS x FROM p")
def rope(spark, d):
    return spread(cells(spark, d), ["cell_id"], V.rotate(F.col("key"), F.col("cell_id")))


@query("F19_rope_undone", f"WITH {FLAT} SELECT cell_id, i, {_R.format('x')} AS x FROM flat")
def rope_undone(spark, d):
    c = cells(spark, d).withColumn("turned", V.rotate(F.col("key"), F.col("cell_id")))
    return spread(c, ["cell_id"], V.rotate(F.col("turned"), F.col("cell_id"), back=True))


@query("F20_split_halves", f"WITH {FLAT} SELECT cell_id, CASE WHEN i < 32 THEN 'k' ELSE 'v' END AS half, (i % 32) // 8 AS row, i % 8 AS i, {_R.format('x')} AS x FROM flat")
def halves(spark, d):
    k, v = V.split_halves(F.col("key"))
    c = cells(spark, d).select("cell_id", F.explode(F.array(F.struct(F.lit("k").alias("half"), k.alias("v")), F.struct(F.lit("v").alias("half"), v.alias("v")))).alias("h"))
    rows = c.select("cell_id", "h.half", F.posexplode(V.split_rows(F.col("h.v"), 8)).alias("row", "v")).withColumn("row", F.col("row").cast("long"))
    return spread(rows, ["cell_id", "half", "row"], F.col("v"))


@query("F21_compose", f"WITH {MCELLS}, t AS (SELECT owner, cell_id, unnest(tokens) AS v, generate_subscripts(tokens, 1) AS tok_at FROM mcells), n AS (SELECT owner, v, row_number() OVER (PARTITION BY owner ORDER BY cell_id, tok_at) - 1 AS position FROM t) SELECT owner, position, generate_subscripts(v, 1) - 1 AS i, {_R.format('unnest(v)')} AS x FROM n")
def compose(spark, d):
    """Each owner's packs one after the other, at consecutive positions."""
    t = mcells(spark, d).select("owner", "cell_id", F.posexplode("tokens").alias("at", "v"))
    n = t.withColumn("position", (F.row_number().over(Window.partitionBy("owner").orderBy("cell_id", "at")) - 1).cast("long"))
    return spread(n, ["owner", "position"], F.col("v"))


@query(
    "F22_embedding_keys",
    f"WITH {CELLS}, n AS (SELECT count(*) AS n FROM cells), ids AS (SELECT conv_id, turn, j, (conv_id * 31 + turn * 7 + j * 13) % (n + 50) AS id FROM conversations, n, range(5) r(j)), met AS (SELECT conv_id, turn, j, c.key FROM ids JOIN cells c ON c.cell_id = ids.id), mean AS (SELECT conv_id, turn, i, avg(x) AS x FROM (SELECT conv_id, turn, unnest(key) AS x, generate_subscripts(key, 1) AS i FROM met) GROUP BY ALL), last AS (SELECT conv_id, turn, arg_max(key, j) AS key FROM met GROUP BY ALL) SELECT m.conv_id, m.turn, m.i - 1 AS i, {_R.format('m.x')} AS mean_x, {_R.format('l.key[m.i]')} AS last_x FROM mean m JOIN last l ON m.conv_id = l.conv_id AND m.turn = l.turn",
)
def embedding_keys(spark, d):
    """Token ids to keys: the mean and the last one of those that the vocabulary has."""
    c = cells(spark, d)
    ids = table(spark, d, "conversations").crossJoin(F.broadcast(c.agg(F.count("*").alias("n")))).select("conv_id", "turn", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    met = ids.withColumn("cell_id", (F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("j") * 13) % (F.col("n") + 50)).join(c, "cell_id")
    one = met.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "key"))), lambda s: s["key"]).alias("vs"))
    both = one.select("conv_id", "turn", F.posexplode(F.arrays_zip(V.mean_pool(F.col("vs")).alias("m"), F.element_at("vs", -1).alias("l"))).alias("i", "z"))
    return both.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.round("z.m", 6).alias("mean_x"), F.round("z.l", 6).alias("last_x"))


@query("SC26_padded_blocks", f"WITH {FLAT}, padded AS (SELECT cell_id, i, x FROM flat UNION ALL SELECT DISTINCT cell_id, 64 + j, 0.0::DOUBLE FROM flat, range(6) r(j)) SELECT cell_id, i // 14 AS block, i % 14 AS i, {_R.format('x')} AS x FROM padded")
def blocks(spark, d):
    b = cells(spark, d).select("cell_id", F.posexplode(V.pad_to_blocks(F.col("key"), 14)).alias("block", "v"))
    return spread(b.withColumn("block", F.col("block").cast("long")), ["cell_id", "block"], F.col("v"))


@query("DX15_least_squares")
def projection(spark, d):
    """Each key's first half mapped to its second half by least squares over all keys: the squared error that is left."""
    c = cells(spark, d).select("cell_id", F.slice("key", 1, 32).alias("a"), F.slice("key", 33, 32).alias("b"))
    w = PR.least_squares(c)
    return c.select("cell_id", F.round(Q.squared_error(PR.apply(w, F.col("a")), F.col("b")), 6).alias("left"))


@query("DX15_canonical")
def canonical(spark, d):
    """The correlations of the halves' shared components."""
    c = cells(spark, d).select("cell_id", F.slice("key", 1, 32).alias("a"), F.slice("key", 33, 32).alias("b"))
    _, _, strength = PR.canonical(c, 8)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(strength)], "component bigint, correlation double")


@query("DX15_truncation", f"WITH {CELLS}, t AS (SELECT cell_id, key[1:16] AS t FROM cells) SELECT cell_id, len(t) AS size, {_R.format('list_sum(t)')} AS total FROM t")
def truncation(spark, d):
    t = PR.truncated(F.col("key"), 16)
    return cells(spark, d).select("cell_id", F.size(t).cast("long").alias("size"), F.round(V.total(t), 6).alias("total"))
