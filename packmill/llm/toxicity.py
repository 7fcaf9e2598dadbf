"""Operator 3: severity of toxicity by cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings of 5 and 8 bytes, valued 1 + log(occurrences). One
weight vector is shared by all thresholds: P(grade >= k) = sigmoid(w.x - theta_k), with ordered
thetas, and the output is the expected severity, the sum of these over k. Labels only say toxic or
not; the grades 1 to GRADES of the toxic ones are the quantile groups of how many marked features
they have (by value), where a feature is marked if the labelled rows themselves show it far more often in toxic texts.
Features enter by a likelihood-ratio test and are fitted by full-batch proximal gradient (L1), so
words without evidence weigh exactly zero and the length of a clean text does not add up to a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packmill.llm.common import BROADCAST_BYTES, fresh, small_batches, spread, table, unit_hash, written
from packmill.llm.text import Words, chunks

GRADES = 3
#: Labelled rows of each class that the fit reads at most (drawn by a seeded hash); all rows are scored.
MAX_PER_CLASS = 4000
ROUNDS = 300
RATE = 0.05
L1 = 3e-4
#: Features enter the fit whose G squared (presence against label) is at least this.
EVIDENCE = 8.0
#: Documents of at least this expected severity are rejected.
REJECT = 0.25
_BEGINNINGS = 5, 8
_SIEVE = 20


def _occurrences(texts: list):
    """(row, feature hash) of every word and word beginning, and the words of each text; in chunks."""
    for first, end in chunks(texts):
        w = Words(texts[first:end])
        if not len(w.start):
            continue
        parts, docs = [w.hashes()], [w.doc + first]
        for k in _BEGINNINGS:
            longer = w.end - w.start > k
            parts.append(w.hashes(k)[longer] ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
            docs.append(w.doc[longer] + first)
        yield np.concatenate(docs), np.concatenate(parts), first, w.counts()


def features(texts: list, known: np.ndarray | None = None):
    """(row, feature, value, words): each text's distinct features and its number of words.

    With `known`, a sorted array of hashes, feature is the place in it and others are left out.
    """
    sieve = None if known is None else _sieve(known)
    rows, index, value, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0)], np.zeros(len(texts), np.int64)
    for doc, key, first, counts in _occurrences(texts):
        words[first : first + len(counts)] = counts
        if known is not None:
            maybe = np.flatnonzero(sieve[key >> np.uint64(64 - _SIEVE)])
            doc, key = doc[maybe], key[maybe]
            place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            real = np.flatnonzero(known[place] == key) if len(known) else []
            doc, key = doc[real], place[real].astype(np.uint64)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        rows.append(doc[at])
        index.append(key[at])
        value.append(1 + np.log(np.diff(np.append(at, len(key)))))
    return np.concatenate(rows), np.concatenate(index), np.concatenate(value), words


def _sieve(known: np.ndarray) -> np.ndarray:
    """Which upper bits of a hash occur among the known ones: most words of a text end here."""
    sieve = np.zeros(1 << _SIEVE, bool)
    sieve[known >> np.uint64(64 - _SIEVE)] = True
    return sieve


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def evidence(a, b, toxic: int, clean: int) -> np.ndarray:
    """G squared of features that a toxic and b clean texts have: how far presence and label are from independent."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    n, total = toxic + clean, np.zeros(len(a))
    for seen, side, margin in ((a, toxic, a + b), (b, clean, a + b), (toxic - a, toxic, n - a - b), (clean - b, clean, n - a - b)):
        total += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(side * margin / n, 1e-12))
    return total


def grades(row, index, value, toxic: np.ndarray, dims: int) -> np.ndarray:
    """0 for what is not toxic, else 1 to GRADES by the value of its marked features."""
    a = np.bincount(index[toxic[row]], minlength=dims)
    b = np.bincount(index[~toxic[row]], minlength=dims)
    lift = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
    marked = np.bincount(row, weights=value * (lift > 2)[index], minlength=len(toxic))
    cuts = np.quantile(marked[toxic], np.arange(1, GRADES) / GRADES)
    return np.where(toxic, 1 + (marked[:, None] > cuts).sum(1), 0)


def fit(row, col, value, grade: np.ndarray, weight: np.ndarray, dims: int):
    """(weights of the features, thetas) from rows of graded texts."""
    n = len(grade)
    weight = weight / weight.sum()
    above = np.array([weight[grade >= k].sum() for k in range(1, GRADES + 1)]).clip(1e-6, 1 - 1e-6)
    theta = -np.log(above / (1 - above))
    w, mw, vw = np.zeros((3, dims))
    mt, vt = np.zeros((2, GRADES))
    hot = np.arange(1, GRADES + 1)
    for turn in range(1, ROUNDS + 1):
        f = np.bincount(row, weights=w[col] * value, minlength=n)
        s = np.concatenate([np.ones((n, 1)), _sigmoid(f[:, None] - theta), np.zeros((n, 1))], 1)
        at, up = s[np.arange(n), grade], s[np.arange(n), grade + 1]
        p = np.maximum(at - up, 1e-12)
        df = weight * (at + up - 1)
        slope = s[:, 1:-1] * (1 - s[:, 1:-1]) * (weight / p)[:, None]
        dt = (slope * (grade[:, None] == hot)).sum(0) - (slope * (grade[:, None] == hot - 1)).sum(0)
        dw = np.bincount(col, weights=value * df[row], minlength=len(w))
        # Adam, with the L1 term as a proximal step
        rate = RATE * min(1.0, 3 * (1 - turn / (ROUNDS + 1)))
        mw, vw = 0.9 * mw + 0.1 * dw, 0.99 * vw + 0.01 * dw * dw
        mt, vt = 0.9 * mt + 0.1 * dt, 0.99 * vt + 0.01 * dt * dt
        bias = (1 - 0.9**turn), (1 - 0.99**turn)
        pace = rate / (np.sqrt(vw / bias[1]) + 1e-5)
        w = w - pace * mw / bias[0]
        w = np.sign(w) * np.maximum(0, np.abs(w) - pace * L1)
        theta = np.maximum.accumulate(theta - rate * mt / bias[0] / (np.sqrt(vt / bias[1]) + 1e-5))
    return w, theta


def severity(texts: list, known: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Expected severity of each text, 0 for one without words."""
    row, index, value, words = features(texts, known)
    f = np.bincount(row, weights=weights[index.astype(np.int64)] * value, minlength=len(texts))
    return np.where(words > 0, _sigmoid(f[:, None] - theta).sum(1), 0.0)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS):
    """(known features, weights, thetas) from the labelled documents, or None where a class has no document.

    labels has doc_id and toxic (0 or 1); rows with a null in either, or that say both, are not used.
    At most max_per_class documents of each class are read, drawn by a hash of their doc_id.
    """
    docs = small_batches(docs)
    said = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    said = said.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("id", "toxic")
    known = written(docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").join(said, "id", "left_semi").distinct().join(said, "id"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    draw = unit_hash(F.lit("toxicity"), F.col("id").cast("string"))
    sample = None
    for c in (0, 1):
        part = known.filter(F.col("toxic") == c).orderBy(draw, "id").limit(max_per_class)
        sample = part if sample is None else sample.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text")).filter("text is not null")
    # of rows that share an id one text, so that the bound holds
    texts = written(texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "sample")

    def presence(batches):
        for batch in batches:
            row, key, _, _ = features(batch.column("text").to_pylist())
            toxic = batch.column("toxic").to_numpy() == 1
            found, place = np.unique(key, return_inverse=True)
            a, b = (np.bincount(place[toxic[row] == c], minlength=len(found)) for c in (True, False))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(a), pa.array(b)], ["key", "a", "b"])

    counts = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None

    def telling(batches):
        for batch in batches:
            strong = evidence(batch.column("a").to_numpy(), batch.column("b").to_numpy(), counts[1], counts[0]) >= EVIDENCE
            yield batch.filter(pa.array(strong)).select(["key"])

    seen = texts.mapInArrow(presence, "key bigint, a bigint, b bigint").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # a feature of one or two texts cannot reach the evidence asked for
    known = np.sort(seen.filter("a + b > 1").mapInArrow(telling, "key bigint").toArrow().column("key").to_numpy().view(np.uint64))

    def chosen(batches):
        for batch in batches:
            row, index, value, _ = features(batch.column("text").to_pylist(), known)
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (index.astype(np.int64), value)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), *lists], ["id", "toxic", "index", "value"])

    got = texts.mapInArrow(chosen, "id bigint, toxic int, index array<bigint>, value array<double>").toArrow()
    got = got.take(pa.array(np.argsort(got.column("id").to_numpy(), kind="stable"))).combine_chunks()
    toxic = got.column("toxic").to_numpy() == 1
    lists = got.column("index").combine_chunks()
    row = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    index, value = lists.flatten().to_numpy(), got.column("value").combine_chunks().flatten().to_numpy()
    grade = grades(row, index, value, toxic, len(known))
    weight = np.where(toxic, sizes[1] / toxic.sum(), sizes[0] / (~toxic).sum())
    weights, theta = fit(row, index, value, grade, weight, len(known))
    return known[weights != 0], weights[weights != 0], theta


def _scorer(spark: SparkSession, model):
    """A column function. The model's size follows the bounded sample it was fitted on, not the data."""
    known, weights, theta = model
    assert known.nbytes + weights.nbytes <= BROADCAST_BYTES
    sent = spark.sparkContext.broadcast((known, weights, theta))

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(severity(text.to_pylist(), *sent.value))

    return score


def score(docs: DataFrame, labels: DataFrame, reject: float = REJECT, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, severity, grade, rejected) for every row of docs.

    severity is the expected grade, 0 to GRADES; grade is it rounded; rejected is severity >= reject.
    Cases: a null or empty text, or one without words, has severity 0; a null doc_id is scored like
    any; repeated rows get one row each; without labelled documents of both classes every severity is 0;
    an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    model = train(docs, labels, max_per_class)
    narrow = docs.select("doc_id", F.col("text").alias("text"))
    value = F.lit(0.0) if model is None else _scorer(docs.sparkSession, model)("text")
    return narrow.select("doc_id", value.alias("severity")).select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= reject).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """The documents that score() does not reject, with all their columns. One pass, no shuffle of texts."""
    model = train(docs, labels, max_per_class)
    if model is None:
        return docs
    name = fresh(docs, "severity")
    return docs.withColumn(name, _scorer(docs.sparkSession, model)(F.col("text"))).filter(F.col(name) < reject).drop(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
