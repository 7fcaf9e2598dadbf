"""Operator 1: SimHash near-duplicate groups.

A fingerprint of 128 bits is the majority vote, bit by bit, over the set of a text's words of at
least four bytes and its pairs of neighbouring words. Two documents are near duplicates when their
fingerprints differ in at most RADIUS bits; groups are the connected components.

Comparing works on bit planes: plane p holds bit p of 64 fingerprints in one machine word. The
distances of a fingerprint to 64 others grow together, eight planes at a time, in carry-save
counters (bitwise full adders); a block of 64 is abandoned as soon as all its counters exceed the
radius. Blocks come from tables of sampled bit positions: rows that agree in a table's key are
compared exactly. The key's width follows the number of fingerprints, so that a bucket holds about
BUCKET of them at any size, and the number of tables follows from the width so that a pair at the
very edge of the radius meets in some table with probability RECALL at least (closer pairs far more).
No bucket and no partner list is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packmill.llm.common import fresh, small_batches, spread, table, written
from packmill.llm.text import Words, chunks, mix

BITS = 128
RADIUS = 20
BUCKET = 512
RECALL = 0.9
MIN_WORD = 4
_LANES = np.uint64(64)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Blocks of 64 lanes compared at once: bounds the memory of the counters.
_ACTIVE = 1 << 16
#: Features whose bits are unpacked at once.
_VOTES = 1 << 17
_SEEDS = 0x5851F42D4C957F2D, 0x14057B7EF767814F
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def _votes(features: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many features of each text set each bit. Each byte of a hash is spread over the eight lanes of a word; 255 such words add up without overflow."""
    size = np.diff(np.append(start, len(features)))
    parts = -(-size // 255)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    cut = np.repeat(start, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    lanes = _SPREAD[np.stack([mix(features ^ np.uint64(s)) for s in _SEEDS], 1).view(np.uint8)]
    sums = np.add.reduceat(lanes, cut, axis=0).view(np.uint8)
    return np.add.reduceat(sums, first, axis=0, dtype=np.int32)


def _runs(start: np.ndarray, n: int):
    """Runs of texts of about _VOTES features together."""
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + _VOTES, "right")) - 1)
        yield lo, hi, start[lo], start[hi] if hi < len(start) else n
        lo = hi


def fingerprints(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints, and which texts have one: a text without any word has none."""
    out = np.zeros((len(texts), 2), np.uint64)
    has = np.zeros(len(texts), bool)
    for first, end in chunks(texts):
        for a in range(first, end, 4096):
            b = min(end, a + 4096)
            w = Words(texts[a:b])
            if not len(w.start):
                continue
            h, doc = w.hashes(), w.doc
            long, pair = w.end - w.start >= MIN_WORD, doc[1:] == doc[:-1]
            two = mix(h[:-1] * np.uint64(3) + h[1:])[pair]
            alone = w.counts()[doc] == 1
            keep = long | alone
            f = np.concatenate([h[keep], two]) >> np.uint64(12)
            f |= np.concatenate([doc[keep], doc[:-1][pair]]).astype(np.uint64) << np.uint64(52)
            f.sort()
            f = f[np.concatenate([[True], f[1:] != f[:-1]])]
            doc = (f >> np.uint64(52)).astype(np.int64)
            f &= np.uint64((1 << 52) - 1)
            start = np.flatnonzero(np.diff(doc, prepend=-1))
            size = np.diff(np.append(start, len(doc)))
            votes = np.concatenate([_votes(f[i:j], start[lo:hi] - i) for lo, hi, i, j in _runs(start, len(f))])
            out[a + doc[start]] = np.packbits(2 * votes > size[:, None], axis=1).view(np.uint64)
            has[a + doc[start]] = True
    return out, has


@F.arrow_udf(T.StructType().add("hi", "long").add("lo", "long"))
def _fingerprint(text: pa.Array) -> pa.Array:
    fps, has = fingerprints(text.to_pylist())
    half = [pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in (0, 1)]
    return pa.StructArray.from_arrays(half, ["hi", "lo"], mask=pa.array(~has))


def tables_for(n: int, radius: int = RADIUS, recall: float = RECALL, bucket: int = BUCKET) -> np.ndarray:
    """(tables, width) bit positions for n fingerprints; seeded, so that any run draws the same. Up to `bucket` of them are one block, compared whole."""
    width = math.ceil(math.log2(max(1, n / bucket)))
    if not width:
        return np.zeros((1, 0), np.int64)
    meet = math.prod((BITS - radius - i) / (BITS - i) for i in range(width))
    count = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    rng = np.random.default_rng(20260101)
    drawn = np.concatenate([rng.permutation(BITS) for _ in range(math.ceil(count * width / BITS) + count)])
    out: list[np.ndarray] = []
    at = 0
    while len(out) < count:
        row = drawn[at : at + width]
        at += width
        if len(set(row)) == width:
            out.append(row)
    return np.array(out)


def _bit(fps: np.ndarray, position: np.ndarray | int) -> np.ndarray:
    return (fps[:, position >> 6] >> np.uint64(position & 63)) & np.uint64(1)


def table_keys(fps: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The key of each fingerprint in one table."""
    key = np.zeros(len(fps), np.uint64)
    for p in positions:
        key = (key << np.uint64(1)) | _bit(fps, int(p))
    return key.view(np.int64)


def _planes(fps: np.ndarray) -> np.ndarray:
    """(BITS, n / 64) words: lane j of word w of plane p is bit p of fingerprint 64 w + j. n is a multiple of 64."""
    by_bit = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(by_bit.T), axis=1, bitorder="little").view(np.uint64)


def _add(a, b, c):
    """A full adder on bit planes: sum and carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _exceeds(planes: list, radius: int) -> np.ndarray:
    """Lanes whose counter, given from the lowest plane to the highest, is above the radius."""
    above, equal = np.zeros_like(planes[0]), np.full_like(planes[0], _ONES)
    for k in reversed(range(len(planes))):
        if radius >> k & 1:
            equal = equal & planes[k]
        else:
            above |= equal & planes[k]
            equal = equal & ~planes[k]
    return above


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS):
    """Yields (i, j), i < j, of one group and within the radius. Rows of a group are neighbours.

    Groups start at a multiple of 64 lanes, so one pass compares many small groups as well as one large group.
    """
    n = len(fps)
    if n < 2:
        return
    start = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    size = np.diff(np.append(start, n))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return
    words = -(-size // 64)
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(start, size) + nth
    lane = np.repeat(first_word * 64, size) + nth
    total = int(words.sum()) * 64
    placed, owner = np.zeros((total, 2), np.uint64), np.full(total, -1, np.int64)
    placed[lane], owner[lane] = fps[row], row
    planes = _planes(placed)
    valid = np.packbits(owner >= 0, bitorder="little").view(np.uint64)
    last_word = np.repeat(first_word + words, size)
    per_row = last_word - (lane >> 6)  # a row meets the words from its own to the end of its group
    ends = np.cumsum(per_row)
    radius_planes = max(6, radius.bit_length() + 1)
    at = 0
    while at < len(lane):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _ACTIVE, "right")))
        reps = per_row[at:upto]
        q = np.repeat(lane[at:upto], reps)
        w = np.repeat(lane[at:upto] >> 6, reps) + np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
        at = upto
        counter = [np.zeros(len(q), np.uint64) for _ in range(radius_planes)]
        own = placed[q]
        for p in range(0, BITS, 8):
            x = [planes[p + k, w] ^ (np.uint64(0) - ((own[:, (p + k) >> 6] >> np.uint64((p + k) & 63)) & np.uint64(1))) for k in range(8)]
            ones, a = _add(counter[0], x[0], x[1])
            ones, b = _add(ones, x[2], x[3])
            twos, c = _add(counter[1], a, b)
            ones, a = _add(ones, x[4], x[5])
            ones, b = _add(ones, x[6], x[7])
            twos, d = _add(twos, a, b)
            fours, carry = _add(counter[2], c, d)
            counter[:3] = ones, twos, fours
            for k in range(3, radius_planes):
                if k == radius_planes - 1:
                    counter[k] = counter[k] | carry  # sticky: far beyond the radius
                else:
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
            if p >= 2 * radius:
                live = np.flatnonzero((~_exceeds(counter, radius) & valid[w]) != 0)
                if len(live) < 0.8 * len(q):
                    q, w, own, counter = q[live], w[live], own[live], [k[live] for k in counter]
                    if not len(live):
                        break
        if not len(q):
            continue
        near = ~_exceeds(counter, radius) & valid[w]
        hit = np.flatnonzero(near)
        if not len(hit):
            continue
        k, bit = np.nonzero(np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left, right = q[hit[k]], w[hit[k]] * 64 + bit
        later = right > left
        yield owner[left[later]], owner[right[later]]


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, for the edges a-b among n rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (label == before).all():
            return label


def _bucket_edges(radius: int):
    """Edges of the buckets in a partition sorted by (t, k): each bucket's components as stars, which is all that connects."""

    def work(batches):
        rest = None

        def edges(t):
            fps = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], 1)
            rep = t.column("rep").to_numpy()
            tk = mix(t.column("k").to_numpy().view(np.uint64) * np.uint64(4099) + t.column("t").to_numpy().astype(np.uint64)).view(np.int64)
            group = np.cumsum(np.diff(tk, prepend=tk[0]) != 0)
            label = np.arange(len(rep))
            for i, j in close_pairs(fps, group, radius):
                label = _stars(len(rep), np.concatenate([np.arange(len(rep)), i]), np.concatenate([label, j]))
            m = np.flatnonzero(label != np.arange(len(rep)))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[m], rep[label[m]])), pa.array(np.minimum(rep[m], rep[label[m]]))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            t, k = now.column("t").to_numpy(), now.column("k").to_numpy()
            cut = int(np.flatnonzero((t != t[-1]) | (k != k[-1]))[-1]) + 1 if ((t != t[-1]) | (k != k[-1])).any() else 0
            rest = now.slice(cut).combine_chunks()
            if cut:
                yield edges(now.slice(0, cut).combine_chunks())
        if rest is not None and rest.num_rows:
            yield edges(rest)

    return work


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node of its component.

    Large-star and small-star steps in turn; each round is a written table, so lineage stays short, and
    the rounds grow with the logarithm of the component's size.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = written(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before is not None and now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, group_id, group_size, kept): every document of a group of two or more; group_id is the group's smallest doc_id.

    kept is true for one row of the group, the one whose doc_id is group_id. Rows that repeat a doc_id
    are one document. Cases: a null doc_id, a null or empty text, and a text without any word take no
    part and do not appear; equal texts always share a group; a text of one word is compared by that
    word; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    narrow = written(
        small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprint(F.col("text")).alias("f")).filter("doc_id is not null and f is not null").select("doc_id", "f.hi", "f.lo"),
        "fingerprints",
    )
    unique = written(narrow.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "unique")
    positions = tables_for(unique.count(), radius, recall, bucket)

    def keyed(batches):
        for batch in batches:
            fps = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], 1)
            for t, p in enumerate(positions):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int32)), pa.array(table_keys(fps, p)), *(batch.column(c) for c in ("hi", "lo", "rep"))], ["t", "k", "hi", "lo", "rep"])

    buckets = unique.mapInArrow(keyed, "t int, k bigint, hi bigint, lo bigint, rep bigint").repartition("t", "k").sortWithinPartitions("t", "k")
    roots = written(components(buckets.mapInArrow(_bucket_edges(radius), "u bigint, v bigint")), "roots")
    rep = narrow.join(unique, ["hi", "lo"]).select("doc_id", "rep").distinct()
    # rows that repeat a doc_id with other texts tie their groups together
    tied = rep.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).filter("u <> v")
    group = rep.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("group_id"))
    group = group.groupBy("doc_id").agg(F.min("group_id").alias("group_id")) if tied.isEmpty() else _tied(group)
    sizes = group.groupBy("group_id").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return group.join(sizes, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def _tied(group: DataFrame) -> DataFrame:
    """Groups that share a doc_id become one."""
    group = written(group.distinct(), "tied")
    lows = group.groupBy("doc_id").agg(F.min("group_id").alias("v"))
    more = components(group.join(lows, "doc_id").select(F.col("group_id").alias("u"), "v").filter("u <> v"))
    return group.join(more.withColumnRenamed("node", "group_id"), "group_id", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "group_id")).alias("group_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one of each near-duplicate group; all columns stay.

    Of rows that repeat a doc_id one stays, chosen by hashes of its text and of all its columns. Rows with a null doc_id, or with a
    text that has no word, stay as they are.
    """
    lost_id, again_id = fresh(docs, "lost_id"), fresh(docs, "again_id")
    lost = written(near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias(lost_id)), "lost")
    kept = docs.join(lost, docs["doc_id"].cast("long") == F.col(lost_id), "left_anti")
    ids = docs.select(F.col("doc_id").alias(again_id)).filter(F.col(again_id).isNotNull()).groupBy(again_id).agg(F.count("*").alias("n")).filter("n > 1").select(again_id)
    again = written(ids, "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == F.col(again_id), "left_anti")
    nth = fresh(docs, "nth")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind)))
    several = kept.join(again, kept["doc_id"] == F.col(again_id), "left_semi").withColumn(nth, F.row_number().over(order))
    return once.unionByName(several.filter(F.col(nth) == 1).drop(nth))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))
