"""Operator 2: mixing sources to target weights by fitting a token budget exactly.

Every text is counted in tokens of a public vocabulary. The budget is shared among the sources by
weight; a source that has less than its share gives all it has, and the others share the rest. For
each source the histogram (length, documents) decides how many documents of each length to take. The
bulk is the same proportion of every length, with what rounding leaves carried on to the next length,
so that long and short documents keep their shares even where every length occurs once. Bounded-knapsack
dynamic programming then fits the rest: it may add documents and give back some of the bulk, and gets a
wider stretch of the target to rearrange until the target is met to the token, or the stretch is all of
it, when no choice of lengths comes nearer. Which documents those are is drawn by a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packmill.llm.common import BROADCAST_BYTES, fresh, small_batches, spread, table, unit_hash, written
from packmill.llm.tokens import VOCABULARY, encoding

#: Share of each source in the mix; sources not named have weight DEFAULT_WEIGHT.
WEIGHTS = {"src0": 2.0, "src1": 1.0, "src2": 1.5, "src3": 0.5}
DEFAULT_WEIGHT = 1.0
#: Tokens of the mix, as a share of all tokens there are.
BUDGET = 0.6
#: Tokens of the bulk that the dynamic programming may give back at most: only a source whose documents' lengths make no
#: exact sum within that (after division by what they have in common) may miss one that exists.
WIDEST = 1 << 24
#: Bits of reachable sums that are kept for going back.
_KEPT_BITS = 1 << 32
#: Draws fall into so many buckets of a length; only one bucket of it is ranked.
BUCKETS = 1 << 16
#: Bytes of a broadcast row of the cuts: source, length and key.
CUT_BYTES = 128


def token_counter(vocabulary: str = VOCABULARY):
    @F.arrow_udf(T.LongType())
    def count(text: pa.Array) -> pa.Array:
        bpe = encoding(vocabulary)
        return pa.array([len(bpe.encode_ordinary(t)) if t else 0 for t in text.to_pylist()], pa.int64())

    return count


def share(available: dict, weights: dict, default: float, budget: int) -> dict:
    """Whole tokens for each source: proportional to weight, at most what is available, budget in all where there is that much."""
    weight = {s: max(0.0, float(weights.get(s, default))) for s in available}
    out, left = dict.fromkeys(available, 0), min(budget, sum(n for s, n in available.items() if weight[s] > 0))
    open_ = sorted((s for s in available if weight[s] > 0 and available[s]), key=lambda s: (available[s] / weight[s], str(s)))
    while open_:
        total = sum(weight[s] for s in open_)
        if available[open_[0]] * total <= left * weight[open_[0]]:
            out[open_[0]] = available[open_[0]]
            left -= available[open_.pop(0)]
            continue
        exact = {s: left * weight[s] / total for s in open_}
        out |= {s: int(exact[s]) for s in open_}
        short = left - sum(int(exact[s]) for s in open_)
        for s in sorted(open_, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: max(0, short)]:
            out[s] += 1
        break
    return out


def _bulk(lengths: list, counts: list, target: int) -> list:
    """About target tokens: the same proportion of every length, rounded so that what is left over counts for the next length."""
    total = sum(n * c for n, c in zip(lengths, counts))
    take, before, at = [], 0, 0
    for c in counts:
        at += c
        upto = (2 * at * target + total) // (2 * total)
        take.append(min(c, upto - before))
        before = upto
    return take


def _scattered(lengths: list) -> list:
    """Places of all lengths, short and long ones in turn."""
    return sorted(range(len(lengths)), key=lambda i: (i * 0x9E3779B1) & 0xFFFFFFFF)


def _released(lengths: list, take: list, width: int) -> list:
    """How many of `take` to give back, about width tokens in all and some of every length, from lengths all over the range."""
    free, out = width, [0] * len(lengths)
    each = max(1, width // max(1, len(lengths)))
    order = _scattered(lengths)
    for i in order:
        if lengths[i] <= free:
            out[i] = min(take[i], max(1, each // lengths[i]), free // lengths[i])
            free -= out[i] * lengths[i]
    for i in order:  # and what is left of the width, where there is more to give back
        more = min(take[i] - out[i], free // lengths[i])
        out[i] += more
        free -= more * lengths[i]
    return out


def _fill(lengths: list, room: list, rest: int) -> tuple[int, list]:
    """(sum, how many of each) of the largest sum up to rest with at most room[i] of lengths[i]."""
    for i, n in enumerate(lengths):
        if n == rest and room[i]:
            return rest, [int(j == i) for j in range(len(lengths))]
    mask, reach, steps, kept = (1 << (rest + 1)) - 1, 1, [], 0
    for i in _scattered(lengths):
        n = lengths[i]
        left, part = min(room[i], rest // n), 1
        while left > 0 and not reach >> rest & 1 and kept <= _KEPT_BITS:
            k = min(part, left)
            steps.append((i, k, reach))
            kept += rest
            reach |= reach << (k * n) & mask
            left, part = left - k, part * 2
    at = best = reach.bit_length() - 1
    got = [0] * len(lengths)
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            got[i] += k
            at -= k * lengths[i]
    return best, got


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: int) -> np.ndarray:
    """How many documents of each length to take, for the largest total that is at most target.

    lengths are distinct and positive. If all documents fit, all are taken.
    """
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    if target >= sum(n * c for n, c in zip(lengths, counts)):
        return np.array(counts, np.int64)
    unit = math.gcd(*lengths)
    lengths, target = [n // unit for n in lengths], max(0, int(target)) // unit
    bulk = _bulk(lengths, counts, target)
    over = sum(n * t for n, t in zip(lengths, bulk)) - target
    best, width, widest = (-1, []), 0, min(target, max(WIDEST, 2 * max(lengths)))
    while True:
        back = bulk if width >= target else _released(lengths, bulk, max(over, 0) + width)
        base = [t - r for t, r in zip(bulk, back)]
        fixed = sum(n * t for n, t in zip(lengths, base))
        if fixed <= target:
            reached, more = _fill(lengths, [c - t for c, t in zip(counts, base)], target - fixed)
            if fixed + reached > best[0]:
                best = fixed + reached, [t + m for t, m in zip(base, more)]
        if best[0] == target or width >= widest:
            break
        width = min(widest, max(4 * width, 2 * min(lengths)))
    return np.array(best[1], np.int64)


def mix(docs: DataFrame, weights: dict | None = None, budget: float | int = BUDGET, seed: str = "mix", vocabulary: str = VOCABULARY, tokens: str | None = None) -> DataFrame:
    """The documents of the mix, with all columns of docs and the number of tokens in a column `tokens` where a name is given.

    budget is a number of tokens, or a share of all of them if it is a fraction up to 1. Cases: texts that
    are null, empty or have no token are never taken; a null source is a source of its own with the default
    weight; a source of weight 0 or less gives nothing; rows that repeat are counted and taken one by
    one; between documents of equal draw doc_id and then a hash of the text decide; an empty table gives none.
    """
    n, row, key, cut, s_, n_ = (fresh(docs, c) for c in (tokens or "n_tokens", "mix_row", "mix_key", "mix_cut", "mix_source", "mix_length"))
    draw = unit_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    counted = small_batches(docs).withColumn(n, token_counter(vocabulary)(F.col("text"))).filter(F.col(n) > 0).withColumn(row, F.monotonically_increasing_id())
    counted = written(counted.withColumn(key, F.struct(draw.alias("draw"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.col(row).alias("row"))), "counted")
    lengths = counted.groupBy(F.col("source").alias("s"), F.col(n).alias("n")).agg(F.count("*").alias("c"))
    lengths = written(lengths, "lengths")
    # one row for each source
    have = {r["s"]: int(r["t"]) for r in lengths.groupBy("s").agg(F.sum(F.col("n") * F.col("c")).alias("t")).collect()}
    whole = int(budget * sum(have.values())) if isinstance(budget, float) and budget <= 1 else int(budget)
    targets = share(have, WEIGHTS if weights is None else weights, DEFAULT_WEIGHT, whole)

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        s = part["s"].iloc[0]
        part = part.sort_values("n")
        got = fit_budget(part["n"].to_numpy(), part["c"].to_numpy(), targets.get(None if pd.isna(s) else s, 0))
        return pd.DataFrame({"s": part["s"], "n": part["n"], "c": part["c"], "take": got})

    plans = written(lengths.groupBy("s").applyInPandas(plan, "s string, n bigint, c bigint, take bigint").filter("take > 0"), "plans")
    # where not all of a length are taken: the key of the last one that is. Texts stay where they are, only keys move,
    # and of a length that many documents have only the bucket of draws that the last one falls into
    keys = counted.select(F.col("source").alias("s"), F.col(n).alias("n"), F.col(key).alias("key"), F.floor(F.col(f"{key}.draw") * BUCKETS).cast("int").alias("b"))
    wanted = plans.filter("take < c").select(F.col("s").alias("ps"), F.col("n").alias("pn"), "take")
    wanted = F.broadcast(wanted) if wanted.count() * CUT_BYTES <= BROADCAST_BYTES else wanted
    keys = keys.join(wanted, F.col("s").eqNullSafe(F.col("ps")) & (F.col("n") == F.col("pn"))).select("s", "n", "take", "b", "key")
    upto = Window.partitionBy("s", "n").orderBy("b")
    found = keys.groupBy("s", "n", "take", "b").agg(F.count("*").alias("here"), F.max("key").alias("last")).withColumn("below", F.sum("here").over(upto) - F.col("here"))
    found = written(found.filter("below < take and below + here >= take"), "buckets")
    # most such buckets hold one document
    plain = found.filter("below + here = take").select("s", "n", F.col("last").alias("cut"))
    split = found.filter("below + here > take").select(F.col("s").alias("fs"), F.col("n").alias("fn"), F.col("b").alias("fb"), "below")
    split = F.broadcast(split) if split.count() * CUT_BYTES <= BROADCAST_BYTES else split
    ranked = keys.join(split, F.col("s").eqNullSafe(F.col("fs")) & (F.col("n") == F.col("fn")) & (F.col("b") == F.col("fb")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("s", "n").orderBy("key")) + F.col("below")).filter("rank = take")
    last = plain.unionByName(ranked.select("s", "n", F.col("key").alias("cut")))
    cuts = plans.filter("take = c").select("s", "n", F.lit(None).cast(last.schema["cut"].dataType).alias("cut")).unionByName(last)
    cuts = written(cuts, "cuts").select(F.col("s").alias(s_), F.col("n").alias(n_), F.col("cut").alias(cut))
    side = F.broadcast(cuts) if cuts.count() * CUT_BYTES <= BROADCAST_BYTES else cuts
    chosen = counted.join(side, F.col("source").eqNullSafe(F.col(s_)) & (F.col(n) == F.col(n_))).filter(F.col(cut).isNull() | (F.col(key) <= F.col(cut)))
    return chosen.select(*docs.columns, *([n] if tokens else []))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spread(table(spark, sf_dir, "documents")).select("doc_id", "source", "text"), tokens="n_tokens").select("doc_id", "source", "n_tokens")
