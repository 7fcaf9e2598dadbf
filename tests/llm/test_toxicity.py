import random

import numpy as np
import pytest

from helpers import docs_of, with_clashes
from packmill.llm import toxicity as X

WORDS = [f"plain{k}" for k in range(400)]
BAD = [f"vile{k}" for k in range(12)]


def corpus(n, seed):
    """Texts of ordinary words; every fourth has bad ones, one to six, among them."""
    rng = random.Random(seed)
    rows, toxic = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 120))
        bad = i % 4 == 0
        if bad:
            for w in rng.choices(BAD, k=rng.randint(1, 6)):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        toxic.append(int(bad))
    return rows, toxic


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, toxic = corpus(1200, 3)
    labels = labels_of(spark, [(i, 1, toxic[i]) for i in range(600)])
    got = {r["doc_id"]: r for r in X.score(docs_of(spark, rows), labels).collect()}
    held = range(600, 1200)
    assert np.mean([got[i]["rejected"] for i in held if toxic[i]]) >= 0.95
    assert np.mean([got[i]["rejected"] for i in held if not toxic[i]]) <= 0.02
    # more bad words are worse
    assert got[600]["severity"] > 0
    few = [got[i]["severity"] for i in held if toxic[i] and rows[i][1].count("vile") <= 1]
    many = [got[i]["severity"] for i in held if toxic[i] and rows[i][1].count("vile") >= 5]
    assert np.mean(many) > np.mean(few) + 0.3


def test_gradient_of_the_ordinal_likelihood_reaches_its_minimum():
    """Against a plain evaluation: no small step from the fit does better."""
    rng = np.random.default_rng(0)
    n, dims = 200, 5
    x = rng.random((n, dims))
    grade = np.clip((x @ np.array([2.0, -1, 0, 0, 1]) + rng.normal(0, 0.5, n)).round().astype(int), 0, X.GRADES)
    row, col = (a.ravel() for a in np.indices(x.shape))
    w, theta = X.fit(row, col, x.ravel(), grade, np.ones(n), dims)

    def loss(w, theta):
        s = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - theta))), np.zeros((n, 1))], 1)
        return -np.log(np.maximum(s[np.arange(n), grade] - s[np.arange(n), grade + 1], 1e-12)).mean() + X.L1 * np.abs(w).sum()

    best = loss(w, theta)
    assert (np.diff(theta) >= 0).all()
    for k in range(dims):
        for step in (-0.1, 0.1):
            assert loss(w + step * np.eye(dims)[k], theta) > best - 1e-3
    for step in (-0.1, 0.1):
        assert loss(w, theta + step) > best - 1e-3


def test_features_by_hand():
    row, key, value, words = X.features(["Alpha beta alpha", None, ""])
    assert words.tolist() == [3, 0, 0]
    assert sorted(value.round(6).tolist()) == [1.0, round(1 + np.log(2), 6)]
    assert (row == 0).all() and len(set(key.tolist())) == 2
    long = X.features(["abcdefghij"])
    assert len(long[1]) == 3  # the word, and its first 5 and 8 bytes


def test_all_cases(spark):
    rows, toxic = corpus(200, 9)
    docs = [*rows, (None, "vile1 vile2 vile3 vile4"), (1000, None), (1001, ""), (1002, " ... "), (0, rows[0][1]), (1003, "plain1 " * 50_000)]
    labels = labels_of(spark, [*((i, 1, toxic[i]) for i in range(200)), (None, 1, 1), (5, None, None), (6, 1, 1), (9999, 0, 1)])
    got = X.score(with_clashes(docs_of(spark, docs)), labels).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["rejected"] and len(by[0]) == 2 and by[0][0] == by[0][1]
    assert [by[i][0]["severity"] for i in (1000, 1001, 1002)] == [0.0] * 3
    assert not by[1003][0]["rejected"]
    kept = X.drop_toxic(with_clashes(docs_of(spark, docs)), labels)
    assert kept.columns == with_clashes(docs_of(spark, docs)).columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.select("doc_id").collect()))) == sorted(repr(r["doc_id"]) for r in got if not r["rejected"])


@pytest.mark.parametrize("label_rows", [[], [(1, 1, 1)], [(1, 1, 1), (77, 1, 0)]])
def test_without_both_classes_nothing_is_toxic(spark, label_rows):
    docs, labels = docs_of(spark, [(1, "vile1"), (2, "plain")]), labels_of(spark, label_rows)
    assert [r["severity"] for r in X.score(docs, labels).collect()] == [0.0, 0.0]
    assert X.drop_toxic(docs, labels).count() == 2


def test_empty(spark):
    assert X.score(docs_of(spark, []), labels_of(spark, [(1, 1, 1), (2, 1, 0)])).count() == 0


def test_query_agrees_with_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = X.op3_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    said = {r["doc_id"]: r["rejected"] for r in got.collect()}
    assert np.mean([said[i] for i in toxic if toxic[i] == 1 and i in said]) >= 0.95
    assert np.mean([said[i] for i in toxic if toxic[i] == 0 and i in said]) <= 0.02


def test_every_row_against_a_plain_scorer(spark):
    """The fitted model applied word by word in plain Python gives each row's severity, grade and verdict."""
    import math
    from collections import Counter

    from packmill.llm.text import Words, fold

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known, weights, theta = X.train(docs, labels)
    weight = dict(zip(known.tolist(), weights.tolist()))
    seen = {}

    def marks(word):
        if word not in seen:
            w, n = Words([word]), len(word.encode())
            seen[word] = [int(w.hashes()[0])] + [int(w.hashes(k)[0]) ^ (k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in (5, 8) if n > k]
        return seen[word]

    want = {}
    for r in docs.select("doc_id", "text").collect():
        text = fold(r["text"]) if r["text"] else ""
        words = "".join(c if (c.isascii() and c.isalnum()) or ord(c) >= 128 else " " for c in text).split(" ")
        counts = Counter(m for w in words if w for m in marks(w))
        f = sum(weight.get(m, 0.0) * (1 + math.log(n)) for m, n in counts.items())
        want[r["doc_id"]] = sum(1 / (1 + math.exp(t - f)) for t in theta) if any(words) else 0.0
    got = X.op3_toxicity(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["severity"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["rejected"] == (r["severity"] >= X.REJECT) and r["grade"] == int(r["severity"] + 0.5)


def test_repeated_ids_do_not_pass_the_bound(spark):
    rows, toxic = corpus(60, 3)
    docs = docs_of(spark, [*rows, *[(0, f"{rows[0][1]} again{i}") for i in range(50)]])
    assert X.train(docs, labels_of(spark, [(i, 1, toxic[i]) for i in range(60)]), 10) is not None
