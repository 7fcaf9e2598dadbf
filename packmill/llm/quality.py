"""Operator 5: quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is over the bytes of texts, one model for each language, trained on the documents labelled
good. Counts live in tables sharded by n-gram; probabilities come from joins of these tables. The
n-grams of all documents are gathered, each once, and resolved by the joins order by order; then every
document adds up the log probabilities of its n-grams. If the resolved table is small enough
(BROADCAST_BYTES) workers hold it and texts do not move; otherwise the documents' own n-gram counts
are joined with it shard by shard. Either way gives the same sums. A document is kept if its
perplexity is at most a quantile, for its language, of labelled good documents that the model has not seen.
A language with few good documents holds none out: all of them train its model, and its quantile is over
all of them too, each scored by a model of the same language without the documents of its fold.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packmill.llm.common import BROADCAST_BYTES, cached, small_batches, spread, table, unit_hash, written
from packmill.llm.text import chunks

ORDER = 5
#: Documents up to this quantile of held-out good ones are kept.
QUANTILE = 0.995
#: Share of the good documents that are held out to find the thresholds.
HELD_OUT = 0.1
#: A language that would hold out fewer documents takes its quantile over all its good ones, by folds.
LEAST_HELD_OUT = 50
FOLDS = 10
_LANG_BITS = 23
_GRAM = np.int64((1 << 8 * ORDER) - 1)
#: Distinct n-grams that a counting task holds before it hands them on.
_HELD_GRAMS = 4 << 20


def _tag(lang: str | None) -> int:
    """A language's hash; a null language is one of its own."""
    return zlib.crc32(b"\0none" if lang is None else lang.encode("utf-8", "replace")) & ((1 << _LANG_BITS) - 1)


def grams(texts: list, langs: list):
    """Yields (key of every byte's n-gram, first text, bytes of each text), chunk by chunk.

    A key is the language's hash above ORDER bytes: the byte and those before it; a text begins with zero bytes.
    """
    for first, end in chunks(texts):
        parts = [t.encode("utf-8", "replace") if t else b"" for t in texts[first:end]]
        pad = b"\0" * (ORDER - 1)
        size = np.array([len(p) for p in parts])
        buf = np.frombuffer(pad + pad.join(parts), np.uint8)
        key = np.zeros(len(buf), np.int64)
        for back in range(ORDER):
            key[back:] |= buf[: len(buf) - back].astype(np.int64) << np.int64(8 * back)
        at = np.arange(size.sum()) + np.repeat((ORDER - 1) * np.arange(1, len(parts) + 1), size)
        tag = np.array([_tag(lang) for lang in langs[first:end]], np.int64)
        yield key[at] | np.repeat(tag << np.int64(8 * ORDER), size), first, size


def _tally(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def _count(batches):
    """(key, c): the n-grams of all texts of the task, with their occurrences in training texts (0 for the others)."""
    keys, counts, held = [], [], 0
    for batch in batches:
        texts, langs, train = (batch.column(c).to_pylist() for c in ("text", "lang", "train"))
        for side in (True, False):
            mine = [i for i, t in enumerate(train) if bool(t) == side]
            for key, _, _ in grams([texts[i] for i in mine], [langs[i] for i in mine]):
                key, n = _unique(key)
                keys.append(key)
                counts.append(n if side else np.zeros(len(key), np.int64))
                held += len(key)
                if held > _HELD_GRAMS:
                    key, n = _tally(keys, counts)
                    keys, counts, held = [key], [n], len(key)
                    if held > _HELD_GRAMS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "c"])
                        keys, counts, held = [], [], 0
    if keys:
        key, n = _tally(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "c"])


def _suffix(key: Column, n: int) -> Column:
    """The last n bytes of an n-gram, with its language."""
    return key.bitwiseAND(~((1 << 8 * ORDER) - 1) | ((1 << 8 * n) - 1))


def _context(key: Column, n: int) -> Column:
    """All but the last byte of an n-gram of n bytes, with its language."""
    return F.shiftright(key.bitwiseAND((1 << 8 * n) - 1), 8).bitwiseOR(key.bitwiseAND(~((1 << 8 * ORDER) - 1)))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from counts of counts."""
    lang = F.shiftright("key", 8 * ORDER).alias("lang")
    n = counts.groupBy(lang).agg(*(F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    out = {}
    for k in (1, 2, 3):
        d = k - (k + 1) * F.try_divide(y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        # where counts of counts are too few to estimate a discount, half of the count
        out[f"d{k}"] = F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{k}") > 0) & (d > 0), F.least(d, F.lit(float(k)))).otherwise(k / 2)
    return n.select("lang", *(c.alias(name) for name, c in out.items()))


def _discounted(c: str, out: str) -> Column:
    return F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).when(F.col(c) > 2, F.col("d3")).alias(out)


def resolve(found: DataFrame) -> DataFrame:
    """(key, logp) for the n-grams of `found` (key, c, asked) that are asked for, c being the count in the training texts.

    Joins from the shortest order to the longest: p_n = max(c - D(c), 0) / total + gamma * p_(n-1), with
    continuation counts below the highest order and 1/256 below order 1.
    """
    counts = {ORDER: found.filter("c > 0")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = written(counts[n + 1].groupBy(_suffix(F.col("key"), n).alias("key")).agg(F.count("*").alias("c")), f"counts{n}")
    p = None
    for n in range(1, ORDER + 1):
        asked = found.filter("asked")
        keys = asked.select(_suffix(F.col("key"), n).alias("key")).distinct() if n < ORDER else asked.select("key")
        d = _discounts(counts[n])
        seen = counts[n].join(F.broadcast(d), F.shiftright("key", 8 * ORDER) == d["lang"]) if n else None
        part = seen.select("key", "c", ((F.col("c") - _discounted("c", "d"))).alias("rest"), _discounted("c", "d"))
        ctx = part.groupBy(_context(F.col("key"), n).alias("ctx")).agg(F.sum("c").alias("total"), F.sum("d").alias("taken"))
        now = keys.join(part.select("key", "rest"), "key", "left").withColumn("ctx", _context(F.col("key"), n)).join(ctx, "ctx", "left")
        if p is None:
            lower = now.withColumn("p", F.lit(1 / 256))
        else:
            lower = now.withColumn("sfx", _suffix(F.col("key"), n - 1)).join(p.withColumnRenamed("key", "sfx"), "sfx")
        p = lower.select("key", (F.coalesce(F.col("rest") / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("taken") / F.col("total"), F.lit(1.0)) * F.col("p")).alias("p"))
        if n < ORDER:
            p = written(p, f"p{n}")
    return p.select("key", F.log("p").alias("logp"))


class Lookup:
    """Values of known keys in an open-addressing table; every key asked for is known."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(4, int(2 * len(key) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.key[slot[left]] == -1]
            self.key[slot[free]] = key[free]  # of several, the last one stays
            won = free[self.key[slot[free]] == key[free]]
            self.value[slot[won]] = value[won]
            done = np.zeros(len(key), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        out = self.value[slot]
        left = np.flatnonzero(self.key[slot] != key)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            hit = self.key[slot] == key[left]
            out[left[hit]] = self.value[slot[hit]]
            left, slot = left[~hit], slot[~hit]
        return out


def _sums_in_workers(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    got = resolved.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((got.column("key").to_numpy(), got.column("logp").to_numpy()))
    name = f"grams {id(sent)} {sent.id if hasattr(sent, 'id') else sent._jbroadcast.id()}"

    def work(batches):
        lookup = None
        for batch in batches:
            lookup = lookup or cached(name, lambda: Lookup(*sent.value))
            texts = batch.column("text").to_pylist()
            total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for key, first, n in grams(texts, batch.column("lang").to_pylist()):
                ends = np.concatenate([[0], np.cumsum(n)])
                run = np.concatenate([[0.0], np.cumsum(lookup(key), dtype=np.float64)])
                total[first : first + len(n)], size[first : first + len(n)] = run[ends[1:]] - run[ends[:-1]], n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "good", "train")), pa.array(size), pa.array(total)], ["doc_id", "lang", "good", "train", "n", "total"])

    return docs.mapInArrow(work, "doc_id bigint, lang string, good boolean, train boolean, n bigint, total double")


def _sums_by_join(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """The same sums where the n-grams are too many for a worker: each document's own n-grams, as numbers only, meet them shard by shard."""
    docs = written(docs.withColumn("uid", F.monotonically_increasing_id()), "texts")

    def own(batches):
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for key, first, n in grams(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uid[first + doc[at]]), pa.array(key[at]), pa.array(np.diff(np.append(at, len(key))).astype(np.int32))], ["uid", "key", "c"])

    rows = docs.select("uid", "text", "lang").mapInArrow(own, "uid bigint, key bigint, c int")
    sums = rows.join(resolved, "key").groupBy("uid").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("logp")).alias("total"))
    met = docs.drop("text").join(sums, "uid", "left")
    return met.select("doc_id", "lang", "good", "train", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def _folds(known: DataFrame, held_out: float) -> DataFrame:
    """(f_lang, f_id, fold) of the good documents of languages that would hold out too few; up to FOLDS documents have a fold each."""
    good = known.filter("good and octet_length(text) > 0").select("lang", "doc_id", _held(held_out).alias("held"))
    few = good.groupBy(F.col("lang").alias("l")).agg(F.count_if("held").alias("c")).filter(F.col("c") < LEAST_HELD_OUT)
    ids = good.join(F.broadcast(few), F.col("lang").eqNullSafe(F.col("l"))).select(F.col("lang").alias("f_lang"), F.col("doc_id").alias("f_id")).distinct()
    order = Window.partitionBy("f_lang").orderBy(unit_hash(F.lit("fold"), F.col("f_id").cast("string")), "f_id")
    return ids.withColumn("fold", (F.row_number().over(order) - 1) % FOLDS)


def _held(held_out: float) -> Column:
    return unit_hash(F.lit("held out"), F.col("doc_id").cast("string")) < held_out


def _fold_lang(fold: Column) -> Column:
    """A language of its own for the model without a fold; its third character on is the language, if it has one."""
    return F.concat(fold.cast("string"), F.when(F.col("lang").isNull(), "-").otherwise("+"), F.coalesce("lang", F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, held_out: float = HELD_OUT, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, kept) for every row of docs.

    labels has doc_id and quality (1 is good); a document with a good label and no other trains the model,
    or helps to find the thresholds if a hash of its doc_id holds it out; in a language where fewer than
    LEAST_HELD_OUT would be held out it does both, by folds. Cases: a null or empty text has
    a null perplexity and is not kept; a null lang is a language of its own; a null doc_id is scored, and
    labels of one are not used; repeated rows are counted and scored one by one; in a language without any good
    document perplexity is that of 256 equally likely bytes and all texts are kept, as are nearly all where there
    is one good document only, which a model without it finds as unlikely; empty docs give no rows.
    """
    said = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q")).filter("id is not null and q is not null").groupBy("id").agg((F.min("q") == 1).alias("good"))
    said = written(said, "good").filter("good")
    side = F.broadcast(said) if said.count() * 16 <= limit else said
    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
    known = narrow.join(side, F.col("doc_id") == F.col("id"), "left").select("doc_id", "lang", "text", F.coalesce("good", F.lit(False)).alias("good"))
    folds = written(_folds(known, held_out), "folds")
    n_folds = folds.count()
    folded = known.join(F.broadcast(folds) if n_folds * 64 <= limit else folds, F.col("lang").eqNullSafe(F.col("f_lang")) & (F.col("doc_id") == F.col("f_id")), "left").drop("f_lang", "f_id")
    known = folded.select("doc_id", "lang", "text", "good", (F.col("good") & (F.col("fold").isNotNull() | ~_held(held_out))).alias("train"))
    counted = known.select("text", "lang", "train").mapInArrow(_count, "key bigint, c bigint").withColumn("asked", F.lit(True))
    if n_folds:
        again = folded.filter("good and fold is not null")
        others = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).filter("other <> fold")
        others = others.select("text", _fold_lang(F.col("other")).alias("lang"), F.lit(True).alias("train"))
        unseen = again.select("doc_id", _fold_lang(F.col("fold")).alias("lang"), "text", "good", F.lit(None).cast("boolean").alias("train"))
        counted = counted.union(others.mapInArrow(_count, "key bigint, c bigint").withColumn("asked", F.lit(False)))
        counted = counted.union(unseen.select("text", "lang", "train").mapInArrow(_count, "key bigint, c bigint").withColumn("asked", F.lit(True)))
        known = known.union(unseen)
    found = written(counted.groupBy("key").agg(F.sum("c").alias("c"), F.max("asked").alias("asked")), "grams")
    resolved = written(resolve(found), "resolved")
    small = resolved.count() * 24 <= limit
    sums = (_sums_in_workers if small else _sums_by_join)(known, resolved)
    scored = written(sums.select("doc_id", "lang", "good", "train", F.col("n").alias("n_bytes"), F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n"))).alias("perplexity")), "scored")
    unseen = scored.filter("train is null").withColumn("lang", F.when(F.substring("lang", 2, 1) == "+", F.expr("substring(lang, 3)")))
    held = scored.join(F.broadcast(folds.select("f_lang").distinct()), F.col("lang").eqNullSafe(F.col("f_lang")), "left_anti").filter("good and not train").union(unseen).filter("perplexity is not null")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(1_000_000))
    by_lang = held.groupBy(F.col("lang").alias("l")).agg(cut.alias("t"))
    out = scored.filter("train is not null").join(F.broadcast(by_lang), F.col("lang").eqNullSafe(F.col("l")), "left")
    kept = F.col("perplexity").isNotNull() & (F.col("t").isNull() | (F.col("perplexity") <= F.col("t") + 1e-9))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", F.coalesce("t", F.lit(256.0)).alias("threshold"), kept.alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
