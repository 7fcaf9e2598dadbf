import itertools
import random
from collections import Counter

import numpy as np
import pytest

from helpers import docs_of, prose, with_clashes
from packmill.llm import mixing as M
from packmill.llm.tokens import encoding


def test_lengths_that_greedy_choices_miss():
    got = M.fit_budget(np.array([2, 17, 23, 30, 34]), np.array([2, 1, 2, 1, 3]), 120)
    assert int((got * np.array([2, 17, 23, 30, 34])).sum()) == 119
    assert list(M.fit_budget(np.array([10_000, 17_000]), np.array([2, 2]), 34_000)) == [0, 2]
    assert int((M.fit_budget(np.array([10_000, 17_000]), np.array([2000, 2000]), 34_000_000) * np.array([10_000, 17_000])).sum()) == 34_000_000


def test_long_and_short_documents_keep_their_shares():
    """A thousand lengths that occur once each: the mean length taken is the source's."""
    lengths = np.random.default_rng(3).permutation(np.arange(100, 100_100, 100))
    lengths.sort()
    for share in (0.3, 0.5, 0.7):
        target = int(lengths.sum() * share)
        got = M.fit_budget(lengths, np.ones(1000, np.int64), target)
        assert (got * lengths).sum() == target // 100 * 100
        assert abs((got * lengths).sum() / got.sum() / lengths.mean() - 1) < 0.02
    many = np.arange(5, 3000)
    counts = np.random.default_rng(4).integers(1, 50, len(many))
    got = M.fit_budget(many, counts, int((many * counts).sum() * 0.4))
    assert abs((got * many).sum() / got.sum() / ((counts * many).sum() / counts.sum()) - 1) < 0.02


def test_one_length_is_cut_by_buckets(spark, monkeypatch):
    """Very many documents of one length: the cut is where ranking all of them puts it, whatever the buckets are."""
    rows = [(i, "one two", "en", "a") for i in range(400)]
    want = expected([(i, t, s) for i, t, _, s in rows], 0.37)
    for buckets in (1, 7, 1 << 16):
        monkeypatch.setattr(M, "BUCKETS", buckets)
        assert sorted((tuple(r) for r in M.mix(docs_of(spark, rows), budget=0.37, tokens="n").select("doc_id", "source", "n").collect()), key=repr) == want


@pytest.mark.parametrize("seed", range(600))
def test_budget_is_met_as_well_as_any_choice_meets_it(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 5)))
    counts = [rng.randint(1, 4) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    target = rng.randint(0, total + 3)
    got = M.fit_budget(np.array(lengths), np.array(counts), target)
    assert all(0 <= g <= c for g, c in zip(got, counts))
    reached = sum(n * int(g) for n, g in zip(lengths, got))
    best = max(s for s in (sum(n * k for n, k in zip(lengths, take)) for take in itertools.product(*(range(c + 1) for c in counts))) if s <= target)
    assert reached <= target
    assert reached == best


def test_exact_where_lengths_are_many():
    rng = np.random.default_rng(1)
    lengths = np.arange(5, 3000)
    counts = rng.integers(1, 5, len(lengths))
    total = int((lengths * counts).sum())
    for target in (total // 3, total // 2 + 1, total - 12345):
        assert int((M.fit_budget(lengths, counts, target) * lengths).sum()) == target


def test_shares():
    assert M.share({"a": 100, "b": 100}, {"a": 3, "b": 1}, 1, 80) == {"a": 60, "b": 20}
    assert M.share({"a": 10, "b": 100}, {"a": 3, "b": 1}, 1, 80) == {"a": 10, "b": 70}
    assert M.share({"a": 10, "b": 10, None: 10}, {"a": 0}, 1, 100) == {"a": 0, "b": 10, None: 10}
    assert sum(M.share({c: 50 for c in "abc"}, {}, 1, 100).values()) == 100


def expected(rows, budget=M.BUDGET, weights=None):
    """The mix, chosen one document at a time in plain Python."""
    import hashlib

    bpe = encoding()
    counted = [(i, t, s, len(bpe.encode_ordinary(t))) for i, t, s in rows if t]
    have = Counter()
    for *_, s, n in counted:
        have[s] += n
    targets = M.share(dict(have), M.WEIGHTS if weights is None else weights, M.DEFAULT_WEIGHT, int(budget * sum(have.values())))
    out = []
    for s in have:
        by = {}
        for i, t, source, n in counted:
            if source == s:
                draw = (int(hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                by.setdefault(n, []).append((draw, i is not None, i or 0))
        lengths = sorted(by)
        for n, take in zip(lengths, M.fit_budget(np.array(lengths), np.array([len(by[n]) for n in lengths]), targets[s])):
            out += [(None if not known else i, s, n) for _, known, i in sorted(by[n])[: int(take)]]
    return sorted(out, key=repr)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert sorted((tuple(r) for r in M.op2_mixing(spark, sf).collect()), key=repr) == expected(rows)


def test_all_cases(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two", "en", None), (4, "one two", "en", None), (None, "three four five", "en", "b"), (5, prose(1, 20_000), "en", "c"), (6, "six", "en", "d"), (6, "six", "en", "d")]
    docs = with_clashes(docs_of(spark, rows))
    got = M.mix(docs, weights={"d": 0.0}, budget=10**9)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 3, 4, 5]
    assert M.mix(docs, budget=0).count() == 0
    assert sorted((tuple(r) for r in M.mix(docs, budget=0.5, tokens="how many").select("doc_id", "source", "how many").collect()), key=repr) == expected([(i, t, s) for i, t, _, s in rows], 0.5)


def test_empty(spark):
    assert M.mix(docs_of(spark, [])).count() == 0
