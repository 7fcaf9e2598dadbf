import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import docs_of, with_clashes
from packmill.llm import quality as Q

LABELS = "doc_id bigint, quality int, toxic int"


def model(texts, order=Q.ORDER):
    """Interpolated modified Kneser-Ney over bytes in plain Python: a function from an n-gram to its log probability."""
    counts = {order: Counter()}
    for t in texts:
        b = b"\0" * (order - 1) + t.encode()
        for i in range(order - 1, len(b)):
            counts[order][b[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc, total, taken = {}, defaultdict(float), defaultdict(float)
    for n, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else None
        disc[n] = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * of[k + 1] / of[k] if y is not None and of[k] else 0
            disc[n].append(min(d, k) if d > 0 else k / 2)
        for g, v in c.items():
            total[n, g[:-1]] += v
            taken[n, g[:-1]] += disc[n][min(v, 3) - 1]

    def p(g, n):
        if n == 0:
            return 1 / 256
        low = p(g[1:], n - 1)
        ctx = (n, g[:-1])
        if ctx not in total:
            return low
        v = counts[n].get(g, 0)
        return ((v - disc[n][min(v, 3) - 1]) / total[ctx] if v else 0) + taken[ctx] / total[ctx] * low

    return lambda g: math.log(p(g, order))


def perplexity(logp, text, order=Q.ORDER):
    b = b"\0" * (order - 1) + text.encode()
    return math.exp(-sum(logp(b[i - order + 1 : i + 1]) for i in range(order - 1, len(b))) / (len(b) - order + 1))


def small(seed, n):
    rng = random.Random(seed)
    words = ["the", "cat", "sat", "on", "a", "mat", "größe", "über", "and", "then"]
    return [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(n)]


@pytest.mark.parametrize("limit", [Q.BROADCAST_BYTES, 0])
def test_perplexity_by_hand(spark, limit):
    """Both ways of adding up give what a plain model of each language gives."""
    texts = small(1, 40) + ["zzz qqq " * 5, "the cat", "", None]
    docs = [(i, t, "en" if i % 3 else "de", "s") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(30, 0, 0), (31, None, 0), (None, 1, 0), (2, 1, 0)], LABELS)
    got = {r["doc_id"]: r for r in Q.classify(docs_of(spark, docs), labels, held_out=0.0, limit=limit).collect()}
    by = {lang: model([t for i, t, l, _ in docs if l == lang and i < 30]) for lang in ("en", "de")}
    for i, t, lang, _ in docs:
        if t:
            assert got[i]["perplexity"] == pytest.approx(perplexity(by[lang], t), rel=1e-5)
        else:
            assert got[i]["perplexity"] is None and not got[i]["kept"]


def test_thresholds_are_quantiles_of_the_held_out(spark):
    texts = small(2, 700)
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(700)], LABELS)
    got = Q.classify(docs_of(spark, docs), labels, quantile=0.9, held_out=0.3).toPandas()
    assert got["threshold"].nunique() == 1
    cut = got["threshold"].iloc[0]
    assert 0.85 <= (got["perplexity"] <= cut).mean() <= 1.0
    assert (got["kept"] == (got["perplexity"] <= cut + 1e-9)).all()


def test_garbage_is_told_apart(spark):
    rng = random.Random(4)
    bad = ["".join(rng.choice("zqxjkvw%$#@!") for _ in range(150)) for _ in range(60)]
    docs = [(i, t, "en", "s") for i, t in enumerate(small(3, 600) + bad)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)] + [(600 + i, 0, 0) for i in range(20)], LABELS)
    got = {r["doc_id"]: r["kept"] for r in Q.classify(docs_of(spark, docs), labels).collect()}
    assert np.mean([got[i] for i in range(400, 600)]) >= 0.95
    assert np.mean([got[i] for i in range(620, 660)]) <= 0.02


def test_all_cases(spark):
    docs = [(1, "some good text here", "en", "s"), (1, "some good text here", "en", "s"), (2, "other", None, "s"), (None, "some text", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"), (5, "word " * 60_000, "fr", None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (None, 1, 1)], LABELS)
    got = Q.classify(with_clashes(docs_of(spark, docs)), labels).collect()
    assert len(got) == len(docs)
    assert all((r["perplexity"] is None) == (r["n_bytes"] == 0) for r in got)
    none = Q.classify(docs_of(spark, docs), spark.createDataFrame([], LABELS)).collect()
    assert all(r["perplexity"] is None or r["perplexity"] == pytest.approx(256) for r in none)
    assert sorted(r["kept"] for r in none) == [False, False] + [True] * 5
    assert Q.classify(docs_of(spark, []), labels).count() == 0


def test_null_and_empty_languages_are_two(spark):
    docs = docs_of(spark, [(1, "abc abc", None, "s"), (2, "abc abc", "", "s"), (3, "abc abc", None, "s")])
    got = {r["doc_id"]: r for r in Q.classify(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).collect()}
    assert got[3]["perplexity"] < 200 and got[2]["perplexity"] == pytest.approx(256)


def test_small_languages_have_thresholds_of_their_own(spark):
    """30 good documents of a language that no other is like, beside many of another; and languages with one good document or none."""
    rng = random.Random(6)
    odd = ["".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω ") for _ in range(200)) for _ in range(60)]
    docs = [(i, t, "en", "s") for i, t in enumerate(small(5, 600))] + [(1000 + i, t, "el", "s") for i, t in enumerate(odd)]
    docs += [(2000, "one good text", "xx", "s"), (2001, "another text", "xx", "s"), (3000, "no good text", "yy", "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(600), *range(1000, 1030), 2000]], LABELS)
    got = {r["doc_id"]: r for r in Q.classify(docs_of(spark, docs), labels).collect()}
    assert len(got) == len(docs)
    # by hand: each good document by a model of the others that are not in its fold; with 30 documents folds are of 3
    unseen = [min(perplexity(model([t for t in odd[:30] if t != x]), x), 1e9) for x in odd[:30]]
    assert got[1000]["threshold"] == pytest.approx(max(unseen), rel=0.1) and got[1000]["threshold"] > 2 * got[0]["threshold"]
    assert np.mean([got[i]["kept"] for i in range(1030, 1060)]) >= 0.8
    assert got[2001]["threshold"] == pytest.approx(256) and got[2001]["kept"]
    assert got[3000]["threshold"] == pytest.approx(256) and got[3000]["kept"]
