"""Evaluation of retrieval runs: metrics of ranked lists, run aggregates, comparison and gate.

Result rows: (system, dataset, category, item_id, replicate, status, score). Ranked rows: (query_id, rank, ...).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packmill.sources.shared import written

KS = (1, 5, 10)
CUTOFFS = (1, 3, 5, 10, 20, 50, 100)


def covered(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, gold_no, first_rank): where each gold snippet first occurs in a query's texts, null if nowhere.

    gold (query_id, gold_no, text), ranked (query_id, rank, text). Blank snippets are left out.
    """
    g = gold.select("query_id", "gold_no", F.lower(F.trim("text")).alias("gold")).filter("gold <> ''")
    met = g.join(ranked.select("query_id", "rank", F.lower("text").alias("chunk")), "query_id", "left")
    return met.groupBy("query_id", "gold_no").agg(F.min(F.when(F.contains("chunk", "gold"), F.col("rank"))).alias("first_rank"))


#: Bytes of texts that are looked through at once.
_CHUNK = 1 << 20


def _anchored(sent):
    """Rows (doc_id, cls, text) to the smallest doc_id of each snippet and class.

    A snippet's first eight bytes are its anchor; texts are compared with all anchors at once, by a table of their hashes.
    """

    def work(batches):
        snippets = sent.value
        short = [n for n, s in enumerate(snippets) if len(s) < 8]
        by: dict = {}
        for n, s in enumerate(snippets):
            if len(s) >= 8:
                by.setdefault(int.from_bytes(s[:8], "little"), []).append(n)
        mix, shift, none = np.uint64(0x9E3779B97F4A7C15), np.uint64(44), np.iinfo(np.int64).max
        marked = np.zeros(1 << 20, bool)
        marked[(np.array(list(by), np.uint64) * mix) >> shift] = True
        best: dict = {}
        for batch in batches:
            ids, classes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary())
            start, data = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64), texts.buffers()[2]
            for c in np.unique(classes).tolist():
                best.setdefault(c, np.full(len(snippets), none))
            for i, c, lo, hi in zip(ids.tolist(), classes.tolist(), start, start[1:]) if short else ():
                for n in short:
                    if i < best[c][n] and snippets[n] in data[lo:hi].to_pybytes():
                        best[c][n] = i
            for lo in range(int(start[0]), int(start[-1]) if by else 0, _CHUNK):
                hi = min(lo + _CHUNK + 7, int(start[-1]))
                for o in range(lo, min(lo + 8, hi - 7)):
                    words = np.frombuffer(data, "<u8", (hi - o) // 8, o)
                    hit = np.flatnonzero(marked[(words * mix) >> shift])
                    for at, word in zip((hit * 8 + o).tolist(), words[hit].tolist()):
                        if word not in by:
                            continue
                        doc = int(np.searchsorted(start, at, "right")) - 1
                        have, i = best[int(classes[doc])], int(ids[doc])
                        for n in by[word]:
                            size = len(snippets[n])
                            if i < have[n] and at + size <= start[doc + 1] and data[at : at + size].to_pybytes() == snippets[n]:
                                have[n] = i
        for c, have in best.items():
            at = np.flatnonzero(have < none)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), c)), pa.array(have[at])], ["snippet", "cls", "doc_id"])

    return work


def first_holding(snippets: list[str], docs: DataFrame) -> DataFrame:
    """(snippet, cls, doc_id): for each snippet, by its place in the list, and each class of documents the smallest doc_id whose text contains it.

    docs (doc_id, cls, text). One pass: workers get the snippets, a stated set, and a task gives a row for each snippet
    and class at most, so nothing but ids leaves the scan.
    """
    sent = docs.sparkSession.sparkContext.broadcast([s.encode() for s in snippets])
    fine = docs.select(F.col("doc_id").cast("long"), F.col("cls").cast("long"), "text").filter("doc_id is not null and text is not null")
    return fine.mapInArrow(_anchored(sent), "snippet bigint, cls bigint, doc_id bigint").groupBy("snippet", "cls").agg(F.min("doc_id").alias("doc_id"))


def recall_ndcg(queries: DataFrame, hits: DataFrame, ks=KS) -> DataFrame:
    """(query_id, recall_at_k, ndcg_at_k) for every query; NaN for one without gold.

    A rank is relevant if some gold snippet occurs there for the first time; the ideal list has min(gold, k) such ranks.
    """
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_gold"), *(F.count_if(F.col("first_rank") <= k).alias(f"c{k}") for k in ks))
    gain = hits.filter("first_rank is not null").select("query_id", "first_rank").distinct()
    gain = gain.groupBy("query_id").agg(*(F.sum(F.when(F.col("first_rank") <= k, 1 / F.log2(F.col("first_rank") + 1))).alias(f"d{k}") for k in ks))
    all_ = queries.select("query_id").join(n, "query_id", "left").join(gain, "query_id", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    nan = F.lit(float("nan"))
    out = []
    for k in ks:
        out.append(F.when(F.col("n_gold").isNull(), nan).otherwise(F.round(F.col(f"c{k}") / F.col("n_gold"), 6)).alias(f"recall_at_{k}"))
        out.append(F.when(F.col("n_gold").isNull(), nan).otherwise(F.round(F.coalesce(f"d{k}", F.lit(0.0)) / ideal(k), 6)).alias(f"ndcg_at_{k}"))
    return all_.select("query_id", *out)


def skip_nan_means(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The means over rows without a NaN, and their number n."""
    sound = metrics.filter(~F.exists(F.array(*names), lambda x: F.isnan(x)))
    return sound.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in names))


def first_relevant(ranked: DataFrame, relevant: Column, queries: DataFrame) -> DataFrame:
    """(query_id, first_rank): the best rank of a relevant row, null where there is none."""
    hit = ranked.filter(relevant).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").distinct().join(hit, "query_id", "left")


def rank_summary(firsts: DataFrame, by: list[str] = (), cutoffs=CUTOFFS) -> DataFrame:
    """MRR, median and worst rank, and the share of queries found up to each cutoff."""
    r = F.col("first_rank")
    return firsts.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"),
        F.percentile("first_rank", 0.5).alias("median_rank"),
        F.max(r).alias("worst_rank"),
        *(F.round(F.avg(F.coalesce((r <= c).cast("double"), F.lit(0.0))), 6).alias(f"recall_at_{c}") for c in cutoffs),
    )


def run_aggregates(rows: DataFrame) -> DataFrame:
    """(system, avg_score, score_stddev, score_ci95, run_count, ok, skipped, failed): the mean of the replicates' means.

    Only ok rows score; a replicate without one counts as 0.
    """
    run = rows.groupBy("system", "replicate").agg(F.coalesce(F.avg(F.when(F.col("status") == "ok", F.col("score"))), F.lit(0.0)).alias("m"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "failed")))
    out = run.groupBy("system").agg(F.avg("m").alias("a"), F.stddev_pop("m").alias("sd"), F.count("*").alias("run_count"), *(F.sum(s).alias(s) for s in ("ok", "skipped", "failed")))
    return out.select("system", F.round("a", 6).alias("avg_score"), F.round("sd", 6).alias("score_stddev"), F.round(1.96 * F.col("sd") / F.sqrt("run_count"), 6).alias("score_ci95"), "run_count", "ok", "skipped", "failed")


def by_category(rows: DataFrame) -> DataFrame:
    """(system, category_key, n, ok, avg_score) of each dataset/category."""
    key = F.concat_ws("/", F.coalesce("dataset", F.lit("unknown")), F.coalesce("category", F.lit("unknown")))
    score = F.when(F.col("status") == "ok", F.col("score"))
    return rows.groupBy("system", key.alias("category_key")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("avg_score"))


def pairwise(rows: DataFrame, baseline: str) -> DataFrame:
    """(system, avg_score, delta): each system's mean against the baseline's, or the best one where there is no baseline."""
    avg = rows.groupBy("system").agg(F.coalesce(F.avg(F.when(F.col("status") == "ok", F.col("score"))), F.lit(0.0)).alias("a"))
    base = avg.agg(F.coalesce(F.max(F.when(F.col("system") == baseline, F.col("a"))), F.max("a")).alias("b"))
    return avg.crossJoin(F.broadcast(base)).select("system", F.round("a", 6).alias("avg_score"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(system, baseline_avg_score, candidate_avg_score, delta) of two run_aggregates; a missing system scores 0."""
    b, c = (df.select("system", F.col("avg_score").alias(n)) for df, n in ((baseline, "b"), (candidate, "c")))
    return b.join(c, "system", "full_outer").select("system", F.coalesce("b", F.lit(0.0)).alias("baseline_avg_score"), F.coalesce("c", F.lit(0.0)).alias("candidate_avg_score"), F.round(F.coalesce("c", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 6).alias("delta"))


def validity(aggregates: DataFrame) -> DataFrame:
    """One row (state, reason): invalid if a system has no success, degraded if one has failures or skips, else comparable."""
    none = (F.col("ok") == 0)
    some = ~none & ((F.col("skipped") > 0) | (F.col("failed") > 0))
    got = aggregates.agg(F.count("*").alias("n"), *(F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("system")))), ",").alias(a) for a, c in (("none", none), ("some", some))))
    state = F.when((F.col("n") == 0) | (F.col("none") != ""), "invalid").when(F.col("some") != "", "degraded").otherwise("comparable")
    reason = F.when(F.col("n") == 0, "missing_system_aggregates").when(F.col("none") != "", F.concat(F.lit("no_successful_results_for="), F.col("none"))).when(F.col("some") != "", F.concat(F.lit("partial_failures_or_skips_for="), F.col("some"))).otherwise("all_systems_ok")
    return got.select(state.alias("state"), reason.alias("reason"))


def gate(rows: DataFrame, warn: float = 0.05, fail: float = 0.20) -> DataFrame:
    """One row (total, ok, skipped, failed, non_ok_ratio, verdict)."""
    got = rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "failed")))
    ratio = F.when(F.col("total") > 0, (F.col("skipped") + F.col("failed")) / F.col("total")).otherwise(1.0)
    return got.select("*", F.round(ratio, 6).alias("non_ok_ratio"), F.when(ratio >= fail, "fail").when(ratio >= warn, "warn").otherwise("pass").alias("verdict"))


#: Bytes of the queries' terms that workers are sent; more of them are joined.
TERM_BYTES = 64 << 20


def _counted(sent):
    """(doc_id, dl, term, tf): for each document how often it has the terms asked for, by their numbers."""

    def work(batches):
        terms = pa.array(sent.value, pa.string())
        for batch in batches:
            lists = batch.column("terms")
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            number = pc.index_in(lists.flatten(), value_set=terms)
            hit = np.flatnonzero(pc.is_valid(number).to_numpy(zero_copy_only=False))
            doc = np.searchsorted(at, hit, "right") - 1
            key, tf = np.unique(doc * (len(terms) + 1) + number.take(pa.array(hit)).to_numpy(), return_counts=True)
            doc, term = np.divmod(key, len(terms) + 1)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(lists)))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (term, tf))], ["doc_id", "dl", "term", "tf"])

    return work


#: Scores of documents and queries that a task adds up at once.
_CELLS = 1 << 21


def _scored(sent, n: int, mean: float, k1: float, b: float):
    """(query_id, doc_id, score) from the counts of documents."""

    def work(batches):
        queries, q_from, q_at, df = sent.value
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        step = max(1, _CELLS // max(1, len(queries)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                count = pc.list_value_length(batch.column("term")).to_numpy().astype(np.int64)
                term, tf = (batch.column(c).flatten().to_numpy() for c in ("term", "tf"))
                doc = np.repeat(np.arange(batch.num_rows), count)
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * batch.column("dl").to_numpy()[doc] / mean))
                size = q_from[term + 1] - q_from[term]
                row = np.repeat(np.arange(len(term)), size)
                asked = q_at[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(q_from[term], size)]
                total = np.bincount(doc[row] * len(queries) + asked, weight[row], batch.num_rows * len(queries))
                hit = np.flatnonzero(total > 0)
                at, q = np.divmod(hit, max(1, len(queries)))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), batch.column("doc_id").take(pa.array(at)), pa.array(np.round(total[hit], 6))], ["query_id", "doc_id", "score"])

    return work


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, limit: int = TERM_BYTES) -> DataFrame:
    """(query_id, doc_id, score): queries and docs with `terms`, arrays of words; pairs without a common term are left out.

    One pass over the documents counts the terms that some query has and drops all others where they are;
    document frequencies and lengths are over all documents. The queries' terms are a stated set: up to
    `limit` bytes of them are sent to workers, which add up a document's scores where its counts are; more of
    them are joined with the counts. Rows are documents, also where they share a doc_id or it is null.
    """
    spark = docs.sparkSession
    asked = written(queries.select("query_id", F.explode("terms").alias("word")).filter("word is not null").distinct(), "asked")
    docs = docs.select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    if (asked.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0) <= limit:
        got = asked.toArrow()
        words, ids = got.column("word").combine_chunks().dictionary_encode(), got.column("query_id").combine_chunks().dictionary_encode()
        have, term, q = words.dictionary, words.indices.to_numpy(), ids.indices.to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(have)))])
        kinds = [docs.schema["doc_id"], T.StructField("dl", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("term", "tf"))]
        tf = written(docs.mapInArrow(_counted(spark.sparkContext.broadcast(have.to_pylist())), T.StructType(kinds)), "terms")
        n, words_ = tf.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        df = np.zeros(len(have))
        for r in tf.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row for each term asked for
            df[r["term"]] = r["df"]
        sent = spark.sparkContext.broadcast((ids.dictionary, starts, q[order], df))
        out = T.StructType([asked.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
        return tf.mapInArrow(_scored(sent, n, max(words_, 1) / max(n, 1), k1, b), out)
    docs = docs.withColumn("doc", F.monotonically_increasing_id())
    n = docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    every = docs.select("doc_id", "doc", F.size("terms").alias("dl"), F.explode("terms").alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    tf = written(every.groupBy("doc_id", "doc", "dl", "word").agg(F.count("*").alias("tf")), "terms")
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    met = asked.join(df, "word").join(tf, "word").crossJoin(F.broadcast(n))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "doc", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).drop("doc")


def shared_terms(items: DataFrame, turns: DataFrame) -> DataFrame:
    """(item_id, conv_id, turn, hits) for all items (item_id, terms) and turns: how many of a turn's `words`, repeats included, are an item's terms; of a turn with a `text`, how many of an item's terms are parts of it.

    The items are a stated set that workers get. A turn's text is gone through once for all of them: what each item has is
    counted from the terms found, by lists of the items that have a term.
    """
    got = items.select("item_id", "terms").toArrow()
    flat = got["terms"].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(flat), 0).to_numpy()
    terms = flat.flatten().dictionary_encode()
    term, item = terms.indices.to_numpy(), np.repeat(np.arange(len(got)), lengths)
    order = np.argsort(term, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms.dictionary)))])
    null = pc.is_null(flat).to_numpy(zero_copy_only=False)
    sent = turns.sparkSession.sparkContext.broadcast((got["item_id"].combine_chunks(), terms.dictionary.to_pylist(), starts, item[order], null))
    by_word = turns.columns[-1] == "words"

    def work(batches):
        ids, words, start, of, empty = sent.value
        known, step = pa.array(words, pa.string()), max(1, (1 << 18) // max(1, len(ids)))
        for whole in batches:
            for lo in range(0, whole.num_rows if len(ids) else 0, step):
                batch = whole.slice(lo, step)
                n = batch.num_rows
                if by_word:
                    number = pc.index_in(batch.column(2).flatten(), value_set=known)
                    row = np.repeat(np.arange(n), pc.list_value_length(batch.column(2)).to_numpy())
                    hit = pc.is_valid(number).to_numpy(zero_copy_only=False)
                    row, at = row[hit], number.drop_null().to_numpy()
                else:
                    found = [[k for k, w in enumerate(words) if w in text] for text in batch.column(2).to_pylist()]
                    row, at = np.repeat(np.arange(n), [len(f) for f in found]), np.array([k for f in found for k in f], np.int64)
                size = start[at + 1] - start[at]
                place = np.arange(size.sum()) + np.repeat(start[at] - np.cumsum(size) + size, size)
                hits = np.bincount(np.repeat(row, size) * len(ids) + of[place], minlength=n * len(ids))
                again, each = pa.array(np.tile(np.arange(len(ids)), n)), pa.array(np.repeat(np.arange(n), len(ids)))
                yield pa.RecordBatch.from_arrays([ids.take(again), batch.column(0).take(each), batch.column(1).take(each), pa.array(hits, pa.int64(), mask=np.tile(empty, n))], ["item_id", "conv_id", "turn", "hits"])

    kinds = [items.schema["item_id"], turns.schema["conv_id"], turns.schema["turn"], T.StructField("hits", T.LongType())]
    return turns.mapInArrow(work, T.StructType(kinds))


def running(df: DataFrame, by: list[str], order: str, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
