"""F30-F50, DX16-DX17, R19-R22, C1: text functions, framings, scores and reformulation over whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packmill.functions import support, texts as X, vectors as V
from packmill.operators import answering, evaluate as E, fusion, retrieval as R
from packmill.queries.base import CELLS, PACKS, as_queries, cells, mcells, packs, query, spread, table

_T = "text IS NOT NULL"
_STOPS = "[" + ", ".join(f"'{w}'" for w in X.QUERY_STOPS) + "]"
_SYNONYMS = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(w) for w in v)}]" for k, v in X.SYNONYMS.items()) + "}"
_CONTENT = f"list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: len(w) > 2 AND NOT list_contains({_STOPS}, w))"
#: Keeps the first of equal elements.
_UNIQUE = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"


def turn_texts(spark, d):
    return table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", "text")


def sentences(spark, d):
    """(item_id, no, text): the benchmark's sentences."""
    return table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\\. ")).alias("no", "text")).withColumn("no", F.col("no").cast("long"))


_SENT = "sent AS (SELECT item_id, generate_subscripts(string_split(text, '. '), 1) - 1 AS no, unnest(string_split(text, '. ')) AS text FROM benchmark)"


@query("F30_split_points", f"SELECT conv_id, turn, CASE WHEN instr(reverse(left(text, 80)), ' ') > 0 AND length(left(text, 80)) - instr(reverse(left(text, 80)), ' ') > 0 THEN length(left(text, 80)) - instr(reverse(left(text, 80)), ' ') ELSE 80 END AS split_at FROM conversations WHERE {_T}")
def split_points(spark, d):
    return turn_texts(spark, d).select("conv_id", "turn", X.find_space(F.col("text"), 80).cast("long").alias("split_at"))


@query("F31_chunks")
def chunks(spark, d):
    chunk = X.chunker()
    rows = spread(table(spark, d, "documents")).select("doc_id", F.explode(chunk(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.chunk_index").cast("long").alias("chunk_index"), "c.start_char", "c.end_char", "c.token_count", F.md5(F.col("c.text").cast("binary")).alias("text_md5"))


@query("F31_sentence_chunks")
def sentence_chunks(spark, d):
    chunk = X.chunker(64, 8, "sentence")
    rows = spread(table(spark, d, "documents")).select("doc_id", F.explode(chunk(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.chunk_index").cast("long").alias("chunk_index"), "c.start_char", "c.end_char", "c.token_count")


@query("F32_keywords", f"WITH {_SENT}, w AS (SELECT item_id, no, {_CONTENT} AS ws FROM sent), a AS (SELECT item_id, no, ws, ws || flatten(list_transform(ws, lambda w: coalesce({_SYNONYMS}[w], []))) AS x FROM w) SELECT item_id, no, array_to_string({_UNIQUE.format('x')}, ' ') AS words FROM a WHERE len(ws) > 0")
def keywords(spark, d):
    return sentences(spark, d).select("item_id", "no", X.keywords(F.col("text")).alias("words")).filter("words is not null")


@query("F33_phrasings", f"WITH {_SENT}, w AS (SELECT item_id, no, array_to_string({_CONTENT}, ' ') AS ws FROM sent) SELECT item_id, no, 0 AS i, ws AS phrase FROM w WHERE ws <> '' UNION ALL SELECT item_id, no, 1, 'What did ' || ws || ' involve' FROM w WHERE ws <> ''")
def phrasings(spark, d):
    return sentences(spark, d).select("item_id", "no", F.posexplode(X.phrasings(F.col("text"))).alias("i", "phrase"))


@query("F34_neighbour_expansion", f"WITH {CELLS}, c AS (SELECT a.cell_id AS query_id, b.cell_id, round(list_inner_product(a.key, b.key) / (sqrt(list_inner_product(a.key, a.key)) * sqrt(list_inner_product(b.key, b.key))), 6) AS cosine FROM cells a JOIN cells b ON a.cell_id <> b.cell_id) SELECT query_id, cell_id, cosine FROM c WHERE cosine >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, cell_id) <= 10")
def expansion(spark, d):
    """The ten nearest by cosine that are near enough: unit vectors, so the blocked search's dots are cosines times 1 / sqrt(d)."""
    c = cells(spark, d).withColumn("key", F.transform("key", lambda x: x / V.norm(F.col("key")) * F.sqrt(F.sqrt(F.size("key").cast("double")))))
    found = R.brute_force(as_queries(c), c, 10, skip_self=True)
    return found.filter("score >= 0.3").select("query_id", "cell_id", F.col("score").alias("cosine"))


_TRIM = "trim(text)"
_CUT = f"coalesce({', '.join(f'''CASE WHEN instr({_TRIM}, '{s}') - 1 > 10 THEN instr({_TRIM}, '{s}') - 1 END''' for s in (',', ';', ' — ', ' - '))})"
_SPACE = f"CASE WHEN instr(reverse(left({_TRIM}, 60)), ' ') > 0 AND length(left({_TRIM}, 60)) - instr(reverse(left({_TRIM}, 60)), ' ') > 0 THEN length(left({_TRIM}, 60)) - instr(reverse(left({_TRIM}, 60)), ' ') ELSE 60 END"


@query("F36_summary", f"WITH {_SENT} SELECT item_id, no, CASE WHEN {_CUT} IS NOT NULL THEN trim(left({_TRIM}, {_CUT})) WHEN length({_TRIM}) > 60 AND {_SPACE} > 10 AND {_SPACE} < 60 THEN trim(left({_TRIM}, {_SPACE})) ELSE trim(left({_TRIM}, 60)) END AS summary FROM sent")
def summary(spark, d):
    return sentences(spark, d).select("item_id", "no", X.summary(F.col("text")).alias("summary"))


_FRAME = "[" + ", ".join(f"'{w}'" for w in X.STOPS) + "]"
_ACTS = " OR ".join(f"contains(lower({{0}}), '{v}')" for v in X.VERBS)


def _question(text: str) -> str:
    words = f"list_transform(list_filter(regexp_split_to_array(trim({text}), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[,;:.!?]$', ''))"
    end = f"least(4, len({words}), coalesce(list_min(list_filter(range(2, len({words}) + 1), lambda i: list_contains({_FRAME}, lower(({words})[i])))) - 1, 4))"
    subject = f"array_to_string(({words})[1:{end}], ' ')"
    return f"CASE WHEN {_ACTS.format(text)} THEN 'What did ' || {subject} || ' do?' ELSE 'What is known about ' || {subject} || '?' END"


def _paraphrase(text: str) -> str:
    out = f"array_to_string(list_reverse(regexp_split_to_array(trim({text}), '[,;]\\s*')), ', ')"
    for word, other in X.REWORD:
        out = f"regexp_replace({out}, '\\b{word}\\b', '{other}', 'gi')"
    return out


@query("F37_question", f"WITH {_SENT} SELECT item_id, no, {_question('text')} AS question FROM sent")
def question(spark, d):
    return sentences(spark, d).select("item_id", "no", X.question(F.col("text")).alias("question"))


@query("F38_paraphrase", f"WITH {_SENT} SELECT item_id, no, {_paraphrase('text')} AS paraphrase FROM sent")
def paraphrase(spark, d):
    return sentences(spark, d).select("item_id", "no", X.paraphrase(F.col("text")).alias("paraphrase"))


@query("F40_diversity")
def diversity(spark, d):
    """Of each cell's vectors those that are not like one kept before, three at most; the limit is the feature."""
    c = mcells(spark, d)
    kept = F.aggregate("tokens", F.array().cast("array<array<double>>"), lambda a, t: F.when((F.size(a) < 3) & ~F.exists(a, lambda k: V.cosine(k, t) >= 0.92), F.array_append(a, t)).otherwise(a))
    return c.select("cell_id", F.posexplode(kept).alias("i", "v")).select("cell_id", F.col("i").cast("long").alias("i"), F.round(F.element_at("v", 1), 6).alias("first"))


_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query("F41_answer_score", f"WITH p AS (SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations WHERE {_T}), t AS (SELECT conv_id, turn, {_TOK.format('expected')} AS e, {_TOK.format('answer')} AS a FROM p WHERE expected IS NOT NULL), s AS (SELECT conv_id, turn, CASE WHEN len(e) > 0 THEN round(len(list_intersect(e, a)) / len(e), 6) ELSE 0.0 END AS score FROM t) SELECT conv_id, turn, score, score >= 0.8 AS passed FROM s")
def answer_score(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = turn_texts(spark, d).withColumn("expected", before).filter("expected is not null")
    return p.select("conv_id", "turn", X.answer_score(F.col("expected"), F.col("text")).alias("score")).withColumn("passed", F.col("score") >= 0.8)


@query("F42_lexical_overlap", f"WITH q AS (SELECT item_id, {_UNIQUE.format('t')} AS terms FROM (SELECT item_id, {_CONTENT} AS t FROM benchmark)) SELECT item_id, conv_id, turn, len(list_filter(terms, lambda w: contains(lower(text), w))) AS hits FROM q, conversations WHERE {_T}")
def lexical_overlap(spark, d):
    q = table(spark, d, "benchmark").select("item_id", F.array_distinct(X.content_words(F.col("text"))).alias("terms"))
    return E.shared_terms(q, spread(turn_texts(spark, d)).select("conv_id", "turn", F.lower("text").alias("text")))


_SPLIT = "regexp_split_to_array(trim(lower({})), '\\s+')"


@query("F43_word_overlap", f"WITH q AS (SELECT item_id, {_SPLIT.format('text')} AS ws FROM benchmark), t AS (SELECT conv_id, turn, {_SPLIT.format('text')} AS tw FROM conversations WHERE {_T}) SELECT item_id, conv_id, turn, len(list_filter(tw, lambda w: w <> '' AND list_contains(ws, w))) AS hits FROM q, t")
def word_overlap(spark, d):
    words = F.filter(F.split(F.trim(F.lower("text")), r"\s+"), lambda w: w != "")
    q = table(spark, d, "benchmark").select("item_id", F.array_distinct(words).alias("terms"))
    return E.shared_terms(q, spread(turn_texts(spark, d)).select("conv_id", "turn", words.alias("words")))


@query("F44_judge_score", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN least(round((event_id % 150) / 100.0::DOUBLE, 6), 1.0) ELSE 0.0 END::DOUBLE AS score FROM events")
def judge_score(spark, d):
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('```json\n{"score": '), F.format_string("%.2f", (F.col("event_id") % 150) / 100.0), F.lit("}\n```"))).when(F.col("event_id") % 3 == 1, "score unknown").otherwise('{"score": -0.5}')
    return table(spark, d, "events").select("event_id", F.round(X.judge_score(reply), 6).alias("score"))


@query("F45_prefix_lines", f"WITH RECURSIVE {PACKS} SELECT pack_id, '- ' || replace(text, chr(10), ' ') AS line, '- [' || CASE tier WHEN 0 THEN 'Draft' WHEN 1 THEN 'Validated' ELSE 'Core' END || '] ' || replace(text, chr(10), ' ') AS tier_line FROM packs JOIN documents ON doc_id = pack_id WHERE {_T}")
def prefix_lines(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("pack_id"), "text")
    return packs(spark, d).join(t, "pack_id").select("pack_id", X.bullet(F.col("text")).alias("line"), X.tier_bullet(F.col("text"), F.col("tier")).alias("tier_line"))


@query("F46_token_estimate", f"SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents WHERE {_T}")
def token_estimate(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("F47_normalized", "SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents")
def normalized(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalized(F.col("text")).cast("binary")).alias("text_md5"))


@query("F48_session_index", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN turn ELSE -1 END AS session FROM conversations")
def session_index(spark, d):
    name = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("D"), F.col("turn").cast("string"), F.lit(":3"))).when(F.col("conv_id") % 3 == 1, "x1:2").otherwise("D:")
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(X.session_index(name), F.lit(-1)).cast("long").alias("session"))


@query("F49_prompt", f"WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE {_T}) SELECT conv_id, 'Evidence:' || chr(10) || string_agg(i || '. ' || text, chr(10) ORDER BY i) || chr(10) || chr(10) || 'Question: who?' || chr(10) || 'Answer:' AS prompt FROM l GROUP BY conv_id")
def prompt(spark, d):
    e = turn_texts(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("e"))
    return e.select("conv_id", X.prompt(F.lit("who?"), F.col("e")).alias("prompt"))


@query("F50_text_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query("DX16_question_terms", f"WITH t AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9#]+'), lambda w: lower(w)), lambda w: len(w) >= 4 AND NOT list_contains({_STOPS}, w)) AS t FROM benchmark), u AS (SELECT item_id, ({_UNIQUE.format('t')})[1:5] AS t FROM t) SELECT item_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS term FROM u")
def question_terms(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(X.question_terms(F.col("text"), X.QUERY_STOPS)).alias("i", "term"))
    return rows.withColumn("i", F.col("i").cast("long"))


@query("DX17_capped_chunks")
def capped_chunks(spark, d):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: X.chunk_chars(t, 1000))

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(cut("text")).alias("i", "piece"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.length("piece").cast("long").alias("chars"))


# Lexical retrieval loops


def lexical(spark, d, k: int = 5):
    """retrieve(queries (query_id, text)) over the documents by BM25: (query_id, rank, id, score)."""
    terms = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("terms")
    docs = spread(table(spark, d, "documents")).filter("text is not null").select("doc_id", terms)

    def retrieve(queries):
        scored = E.bm25(queries.select("query_id", terms), docs)
        return R.top(scored, ["query_id"], k, tie="doc_id").select("query_id", "rank", F.col("doc_id").alias("id"), "score")

    return retrieve


@query("R19_reformulating_loop")
def reformulating(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return fusion.reformulating(q, lexical(spark, d), 5).select("query_id", "id", "score", "first_list", F.col("rank").cast("long").alias("rank"))


@query("R20_best_variant")
def best_variant(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.concat(F.array("text"), X.phrasings(F.col("text")))).alias("variant", "text"))
    flat = q.select((F.col("query_id") * 10 + F.col("variant")).alias("query_id"), "text")
    found = lexical(spark, d)(flat).filter("rank = 1")
    scored = found.select(F.expr("query_id div 10").alias("query_id"), (F.col("query_id") % 10).alias("variant"), "id", "score")
    return fusion.best_variant(scored)


@query("R22_rerank_by_text", f"WITH e AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations WHERE {_T}), s AS (SELECT conv_id, turn, rank, CASE WHEN turn % 3 <> 2 THEN len(list_filter({_SPLIT.format('text')}, lambda w: w <> '' AND list_contains({_SPLIT.format('q')}, w))) END AS sc FROM e) SELECT conv_id AS query_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY sc IS NULL, sc DESC, rank) AS rank FROM s")
def rerank(spark, d):
    """Turns re-ranked by what they share with the first; every third one stands for a result without a text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turn_texts(spark, d).select(F.col("conv_id").alias("query_id"), F.row_number().over(w).alias("rank"), F.col("turn").alias("id"), F.first("text").over(w).alias("query"), F.when(F.col("turn") % 3 != 2, F.col("text")).alias("text"))
    return fusion.rerank_by_text(rows, X.word_overlap).select("query_id", F.col("rank").cast("long").alias("rank"), "id")


_SUMMARY = f"CASE WHEN {_CUT} IS NOT NULL THEN trim(left({_TRIM}, {_CUT})) WHEN length({_TRIM}) > 60 AND {_SPACE} > 10 AND {_SPACE} < 60 THEN trim(left({_TRIM}, {_SPACE})) ELSE trim(left({_TRIM}, 60)) END"


@query("C1_consolidation_views", f"WITH RECURSIVE {PACKS}, framed AS (SELECT pack_id, [{_SUMMARY}, {_question('text')}, {_paraphrase('text')}] AS x FROM packs JOIN documents ON doc_id = pack_id WHERE tier >= 1 AND trim(text) <> ''), once AS (SELECT pack_id, {_UNIQUE.format('x')} AS x FROM framed) SELECT pack_id, generate_subscripts(x, 1) - 1 AS view, unnest(x) AS view_text FROM once")
def consolidation(spark, d):
    """Validated packs with a text get three framings of it."""
    t = table(spark, d, "documents").filter("trim(text) <> ''").select(F.col("doc_id").alias("pack_id"), "text")
    p = packs(spark, d).filter("tier >= 1").join(t, "pack_id")
    text = F.col("text")
    return p.select("pack_id", F.posexplode(F.array_distinct(F.array(X.summary(text), X.question(text), X.paraphrase(text)))).alias("view", "view_text")).withColumn("view", F.col("view").cast("long"))


# What surrounds a run


@query("X1_text_keys", "SELECT doc_id, i, round(('0x' || substr(md5(i || '|' || coalesce(text, '')), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1, 6) AS x FROM documents, range(8) r(i)")
def text_keys(spark, d):
    """A key for each document from its text alone: the capture function where there is no model."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(support.text_key(F.col("text"))).alias("i", "x"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("R23_retrieve_then_read", f"WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations WHERE {_T}), n AS (SELECT DISTINCT conv_id FROM conversations), e AS (SELECT n.conv_id, max(rank) AS shown, count(*) FILTER (conv_id % 4 <> 1 AND trim(text) <> '' AND rank <= 25) AS usable FROM n LEFT JOIN l USING (conv_id) GROUP BY n.conv_id) SELECT conv_id AS query_id, CASE WHEN conv_id % 5 = 0 THEN 'skipped' WHEN conv_id % 4 = 1 OR usable = 0 THEN 'failed' WHEN conv_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN conv_id % 5 = 0 THEN 'asked not to' WHEN conv_id % 4 = 1 OR usable = 0 THEN 'no_evidence' WHEN conv_id % 3 = 0 THEN 'generator_failed' END AS error, CASE WHEN conv_id % 5 <> 0 AND conv_id % 4 <> 1 AND usable > 0 AND conv_id % 3 <> 0 THEN 'about ' || conv_id ELSE '' END AS answer, least(CASE WHEN conv_id % 4 = 1 THEN 0 ELSE coalesce(shown, 0) END, 5) AS shown FROM e")
def read_answers(spark, d):
    """Conversations as items, their turns as results; every fourth has none, and a generator that fails for every third."""
    c = table(spark, d, "conversations")
    items = c.select(F.col("conv_id").alias("query_id")).distinct().select("query_id", F.concat(F.lit("about "), F.col("query_id").cast("string")).alias("question"), F.when(F.col("query_id") % 5 == 0, "skipped").otherwise("ok").alias("status"), F.when(F.col("query_id") % 5 == 0, "asked not to").alias("error"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    results = turn_texts(spark, d).select(F.col("conv_id").alias("query_id"), F.row_number().over(w).alias("rank"), "text").filter("query_id % 4 <> 1")
    asked = lambda prompt: F.regexp_extract(prompt, r"Question: (about \d+)\n", 1)
    reader = lambda prompt: F.when(F.regexp_extract(asked(prompt), r"(\d+)", 1).cast("long") % 3 != 0, asked(prompt))
    got = answering.retrieve_then_read(items, results, reader)
    return got.select("query_id", "status", "error", "answer", F.size("evidence").cast("long").alias("shown"))


@query("DX18_retry_delays", "SELECT i AS retry, 0.5::DOUBLE * pow(2, i) AS delay FROM range(4) r(i)")
def retry_delays(spark, d):
    """What a call that fails five times waits for."""
    waits: list = []

    def fails():
        raise OSError("no")

    try:
        support.retrying(fails, attempts=5, delay=0.5, factor=2.0, sleep=waits.append)()
    except support.Exhausted:
        return spark.createDataFrame(list(enumerate(waits)), "retry bigint, delay double")


@query("F51_expanded_configuration", "SELECT * FROM (VALUES ('inner', 'value'), ('list', 'value'), ('missing', ''), ('part', 'x${NAME}'), ('plain', 'plain')) t(key, value)")
def expanded(spark, d):
    got = support.expand_env({"plain": "plain", "part": "x${NAME}", "missing": "${OTHER}", "deep": {"inner": "${NAME}"}, "list": [{"x": "${NAME}"}]}, {"NAME": "value"})
    flat = {"plain": got["plain"], "part": got["part"], "missing": got["missing"], "inner": got["deep"]["inner"], "list": got["list"][0]["x"]}
    return spark.createDataFrame(sorted(flat.items()), "key string, value string")
