import random

import pytest

from helpers import docs_of, prose, rows_of, with_clashes
from packmill.llm import decontaminate as D
from packmill.llm.text import Words


def words_at(text):
    """[(word, start, end)] in characters, one by one; every Han or kana character is a word."""
    w = Words([text])
    out = []
    for a, b in zip(w.start, w.end):
        start = len(bytes(w.buf[:a]).decode("utf-8"))
        at = None
        for i, c in enumerate(bytes(w.buf[a:b]).decode("utf-8"), start):
            alone = "\u3041" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff"
            if alone or at is None:
                out.append((c.encode(), i, i + 1))
            else:
                out[-1] = (out[-1][0] + c.encode(), at, i + 1)
            at = None if alone else i if at is None else at
    return out


def brute(docs, items, window=D.WINDOW, shortest=1):
    """Every maximal common run of words, by comparing all places of all texts."""
    found = set()
    for d, text in docs:
        if not text:
            continue
        mine = words_at(text)
        for item, other in items:
            if item is None or other is None:
                continue
            theirs = [w for w, _, _ in words_at(other)]
            need = min(window, len(theirs))
            if len(theirs) < shortest:
                continue
            for i in range(len(mine)):
                for j in range(len(theirs)):
                    if mine[i][0] != theirs[j] or (i and j and mine[i - 1][0] == theirs[j - 1]):
                        continue
                    n = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n][0] == theirs[j + n]:
                        n += 1
                    if n >= need:
                        found.add((d, item, mine[i][1], mine[i + n - 1][2], n, len(theirs) < D.SHORTEST))
    return found


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("seed", range(4))
def test_matches_are_all_common_runs(spark, seed):
    rng = random.Random(seed)
    small = [f"a{k}" for k in range(12)] + ["Élan", "naïve", "größe", "don't", "日本"]
    text = lambda n: " ".join(rng.choice(small) + rng.choice(["", ",", " ", "!\n"]) for _ in range(n))
    items = [(k, text(rng.randint(2, 30))) for k in range(12)]
    docs = []
    for i in range(40):
        words = text(60).split(" ")
        k = rng.randrange(len(items))
        words[rng.randrange(30) : 35] = [items[k][1].upper().replace(",", " ;")]
        docs.append((i, " ".join(words)))
    got = {tuple(r) for r in D.matches(docs_of(spark, docs), items_of(spark, items)).collect()}
    assert got == brute(docs, items)
    assert got


def test_offsets_are_of_the_original(spark):
    item = "Where do the seven blue herons sleep when it rains?"
    text = f"«Début» — ÀÇ 日本語! WHERE  do the\nSEVEN, blue (herons) sleep when it rains … fin"
    (_, _, start, end, n, _), = rows_of(D.matches(docs_of(spark, [(1, text)]), items_of(spark, [(9, item)])))
    assert text[start:end] == "WHERE  do the\nSEVEN, blue (herons) sleep when it rains" and n == 10


def test_all_cases(spark):
    passage = prose(7, 30)
    long = prose(8, 30_000) + " " + passage
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (None, passage), (4, passage + " and again " + passage), (5, long), (6, "short one here now"), (7, "too short"), (8, prose(9, 60))]
    items = [(1, passage), (2, passage), (None, prose(9, 60)), (3, None), (4, ""), (5, "Short one, here now."), (6, "too short")]
    got = D.matches(with_clashes(docs_of(spark, docs)), with_clashes(items_of(spark, items))).collect()
    count = {}
    for r in got:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {3: 4, None: 2, 4: 4, 5: 2, 6: 1, 7: 1}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["short"]} == {(7, 6)}
    kept = D.drop_contaminated(with_clashes(docs_of(spark, docs)), items_of(spark, items))
    assert kept.columns == with_clashes(docs_of(spark, docs)).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 7, 8]
    # a benchmark beyond the limit is searched for in parts, with the same result
    parts = D.matches(docs_of(spark, docs), items_of(spark, items), limit=100)
    assert rows_of(parts) == sorted((tuple(r) for r in got), key=repr)


def test_scripts_without_spaces(spark):
    """An item that is one run of Han and kana is searched for character by character; offsets are of the original."""
    item = "東京タワーは何年に完成しましたか"
    docs = [(1, f"前置き。{item}、後書き。 Ünd"), (2, "東京タワーは何年に建ちましたか"), (3, "𠀀" + item[3:14])]
    got = {tuple(r) for r in D.matches(docs_of(spark, docs), items_of(spark, [(1, item), (2, "42"), (3, "yes")])).collect()}
    assert got == {(1, 1, 4, 4 + len(item), len(item), False), (2, 1, 0, 9, 9, False), (3, 1, 1, 12, 11, False)}
    assert D.drop_contaminated(docs_of(spark, [*docs, (4, "yes, 42")]), items_of(spark, [(1, item), (2, "42"), (3, "yes")])).collect()[0]["doc_id"] == 4


def test_empty(spark):
    assert D.matches(docs_of(spark, []), items_of(spark, [(1, prose(1, 20))])).count() == 0
    assert D.matches(docs_of(spark, [(1, prose(1, 20))]), items_of(spark, [])).count() == 0
    assert D.drop_contaminated(docs_of(spark, [(1, prose(1, 20))]), items_of(spark, [])).count() == 1


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    docs, items = read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")
    wordy = {w for _, t in items for w, _, _ in words_at(t)}
    got = {tuple(r) for r in D.op6_decontaminate(spark, sf).collect()}
    near = [d for d in docs if d[1] and (len(d[1]) < 2500 or d[0] in {g[0] for g in got}) and sum(w in wordy for w, _, _ in words_at(d[1])) >= 4]
    near = [d for d in near if len(d[1]) < 6000]
    assert {g for g in got if g[0] in {d[0] for d in near}} == brute(near, items)
