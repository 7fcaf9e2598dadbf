import numpy as np
import pytest

from helpers import docs_of, prose, rows_of, with_clashes
from packmill.llm import simhash as S


def distances(fps):
    bits = np.unpackbits(fps.view(np.uint8), axis=1).astype(int)
    return (bits[:, None, :] != bits[None, :, :]).sum(2)


def brute_groups(ids, texts, radius=S.RADIUS):
    """Components of all pairs within the radius, by comparing every pair."""
    fps, has = S.fingerprints(texts)
    d = distances(fps)
    parent = {i: i for i in set(ids)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if has[a] and has[b] and d[a, b] <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    groups = {}
    for i, h in zip(ids, has):
        if h:
            groups.setdefault(find(i), set()).add(i)
    return {(i, g, len(m), i == g) for g, m in groups.items() if len(m) > 1 for i in m}


@pytest.mark.parametrize("radius", [3, 17, 20, 31])
def test_bit_sliced_distances_are_exact(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    fps = np.repeat(base, 7, axis=0)
    for r in range(len(fps)):
        for p in rng.choice(128, rng.integers(0, 20), replace=False):
            fps[r, p >> 6] ^= np.uint64(1) << np.uint64(p & 63)
    group = np.sort(rng.integers(0, 3, len(fps)))
    d = distances(fps)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and d[i, j] <= radius}
    got = {(int(a), int(b)) for i, j in S.close_pairs(fps, group, radius) for a, b in zip(i, j)}
    assert got == want


def test_groups_are_those_of_all_pairs(spark):
    rows, i = [], 0
    for g in range(30):
        words = prose(g, 120).split()
        for copy in range(1 + g % 4):
            changed = list(words)
            for k in range(copy * 3):
                changed[(k * 37 + copy) % 120] = f"other{k}{copy}"
            rows.append((i, " ".join(changed)))
            i += 1
    got = {tuple(r) for r in S.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_groups([r[0] for r in rows], [r[1] for r in rows])
    assert len(got) > 20


def test_recall_where_buckets_are_many():
    """With buckets far smaller than the table, at least 0.9 of the pairs at the very edge still meet."""
    rng = np.random.default_rng(5)
    n = 4000
    fps = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    twin = fps.copy()
    for r in range(n):
        for p in rng.choice(128, S.RADIUS, replace=False):
            twin[r, p >> 6] ^= np.uint64(1) << np.uint64(p & 63)
    met = np.zeros(n, bool)
    for positions in S.tables_for(2 * n, bucket=16):
        met |= S.table_keys(fps, positions) == S.table_keys(twin, positions)
    assert met.mean() >= 0.88


def test_all_cases(spark):
    long = prose(1, 30_000)
    rows = [(1, None), (2, ""), (3, " ... !"), (4, "word"), (5, "word"), (6, long), (7, long + " end"), (None, long), (8, prose(2, 50)), (8, prose(2, 50)), (9, prose(3, 50)), (9, prose(4, 50)), (10, prose(3, 50)), (11, prose(4, 50))]
    got = rows_of(S.near_duplicates(with_clashes(docs_of(spark, rows))))
    assert got == [(10, 9, 3, False), (11, 9, 3, False), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (7, 6, 2, False), (9, 9, 3, True)]
    kept = S.drop_near_duplicates(with_clashes(docs_of(spark, rows)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 8, 9)] + [(True, 0)]
    assert kept.columns == with_clashes(docs_of(spark, rows)).columns


def test_empty(spark):
    assert S.near_duplicates(docs_of(spark, [])).count() == 0
    assert S.drop_near_duplicates(docs_of(spark, [])).count() == 0


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in S.op1_simhash(spark, sf).collect()} == brute_groups([d[0] for d in docs], [d[1] for d in docs])


def test_small_buckets_find_what_whole_comparison_finds(spark):
    """Tables of sampled bits, as large corpora need them: no pair that is not there, and at least the stated share of pairs at the edge."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, (400, 2)).astype(np.uint64)
    twin = base.copy()
    for r in range(len(twin)):
        for p in rng.choice(128, S.RADIUS if r % 2 else rng.integers(1, 12), replace=False):
            twin[r, p >> 6] ^= np.uint64(1) << np.uint64(p & 63)
    fps = np.concatenate([base, twin])
    positions = S.tables_for(len(fps), bucket=16)
    assert positions.shape[1] > 0
    met = np.zeros(400, bool)
    for p in positions:
        k = S.table_keys(fps, p)
        met |= k[:400] == k[400:]
    assert met[1::2].mean() >= S.RECALL - 0.05 and met[::2].mean() >= 0.99


def test_groups_with_small_buckets(spark):
    rows, i = [], 0
    for g in range(60):
        words = prose(g, 150).split()
        for copy in range(1 + g % 4):
            changed = list(words)
            changed[(copy * 37) % 150] = f"other{copy}"
            rows.append((i, " ".join(changed)))
            i += 1
    got = rows_of(S.near_duplicates(docs_of(spark, rows), bucket=16))
    assert {tuple(r) for r in got} == brute_groups([r[0] for r in rows], [r[1] for r in rows])


def test_one_of_several_texts_of_an_id_stays(spark):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (1, prose(3, 50)), (2, prose(4, 50))]
    kept = {tuple(r) for n in (1, 2, 3) for r in S.drop_near_duplicates(docs_of(spark, rows).repartition(n)).collect()}
    assert len(kept) == 2
