"""Operator 6: passages of a benchmark in documents, found by one Aho-Corasick automaton.

Questions and answers are normalised to words; every run of WINDOW words of an item is a pattern (a
shorter item is one pattern), and all patterns form one automaton. A document's normalised text is
scanned once; matches that continue each other in both texts are joined, and their ends are mapped
back to characters of the original text. In scripts without spaces between words (Han, kana) every
character is a word.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packmill.llm.common import BROADCAST_BYTES, cached, fresh, small_batches, spread, table
from packmill.llm.text import Words, chunks

#: Words that a match has at least, unless the item is shorter.
WINDOW = 8
#: Items of fewer words are searched for too, but their matches are marked as short, and no document is dropped for one: they occur in ordinary text.
SHORTEST = 4
_ALONE = re.compile("[\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _spaced(text: str | None) -> tuple[str | None, np.ndarray | None]:
    """The text with blanks around every character that is a word of its own, and where each of its characters was before (None: where it is)."""
    if not text or not _ALONE.search(text):
        return text, None
    alone = np.zeros(len(text), bool)
    alone[[m.start() for m in _ALONE.finditer(text)]] = True
    return _ALONE.sub(" \\g<0> ", text), np.repeat(np.arange(len(text)), np.where(alone, 3, 1))


class Automaton:
    """The patterns of some items, and where in which item each occurs."""

    def __init__(self, items: list, window: int = WINDOW, shortest: int = SHORTEST):
        import ahocorasick

        self.window, self.places, self.short = window, [], {}
        number: dict[str, int] = {}
        for item, text in items:
            w = Words([_spaced(text)[0]])
            words = [bytes(w.buf[a:b]).decode("latin-1") for a, b in zip(w.start, w.end)]
            if len(words) < shortest:
                continue
            size = min(window, len(words))
            # of several texts of one item a match is short if the item has no longer one
            self.short[item] = self.short.get(item, True) and len(words) < SHORTEST
            for at in range(len(words) - size + 1):
                pattern = " ".join(words[at : at + size])
                k = number.setdefault(pattern, len(number))
                if k == len(self.places):
                    self.places.append((size, []))
                self.places[k][1].append((item, at))
        self.machine = ahocorasick.Automaton()
        for pattern, k in number.items():
            self.machine.add_word(pattern, (k, len(pattern)))
        if number:
            self.machine.make_automaton()

    def find(self, texts: list):
        """Yields (text, item, start, end, words, short): matches as character ranges of the texts."""
        if not self.places:
            return
        for first, end in chunks(texts):
            parts, before = zip(*(_spaced(t) for t in texts[first:end]))
            w = Words(list(parts))
            if not len(w.start):
                continue
            inside = np.zeros(len(w.buf) + 1, bool)
            edge = np.zeros(len(w.buf) + 1, np.int8)
            edge[w.start] = 1
            edge[w.end] = -1
            inside = np.cumsum(edge, dtype=np.int8)[:-1].astype(bool)
            ends = np.zeros(len(w.buf), bool)
            ends[w.base[1:] - 1] = ends[-1] = True
            after = np.concatenate([[False], inside[:-1]])
            keep = np.flatnonzero(inside | after | ends)
            flat = np.where(inside, w.buf, np.where(ends, np.uint8(10), np.uint8(32)))[keep]
            text = flat.tobytes().decode("latin-1")
            hits = [(stop, *k) for stop, k in self.machine.iter(text)]
            if not hits:
                continue
            stop, k, size = np.array(hits).T
            begin = stop - size + 1
            real = ((begin == 0) | (flat[begin - 1] <= 32)) & (flat[np.minimum(stop + 1, len(flat) - 1)] <= 32)
            where = np.searchsorted(w.start, keep[begin[real]])
            found = sorted((int(w.doc[i]), item, int(i) - at, int(i), self.places[n][0]) for i, n in zip(where, k[real]) for item, at in self.places[n][1])
            chars = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
            run = None
            for doc, item, shift, i, n in [*found, (-1, None, 0, 0, 0)]:
                if run and run[:3] == (doc, item, shift) and i <= run[4]:
                    run = (*run[:4], i + n)
                    continue
                if run:
                    base = chars[w.base[run[0]]]
                    a, b = int(chars[w.start[run[3]]] - base), int(chars[w.end[run[4] - 1]] - base)
                    was = before[run[0]]
                    yield first + run[0], run[1], *((a, b) if was is None else (int(was[a]), int(was[b - 1]) + 1)), run[4] - run[3], self.short[run[1]]
                run = (doc, item, shift, i, i + n)


def _sides(benchmark: DataFrame, limit: int) -> list:
    """The items as lists for broadcasting, each of at most about `limit` bytes: one automaton, or several scans if the benchmark is that large."""
    items = small_batches(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-size // limit) or 1
    sides = []
    for i in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i)
        got = sorted((r["item_id"], r["text"]) for r in part.distinct().collect())
        sides.append((f"automaton {uuid.uuid4().hex}", benchmark.sparkSession.sparkContext.broadcast(got)))
    return sides


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = 1, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, n_words, short): every maximal run of words that a document shares with an item.

    A run has `window` words or more, or is all of an item of fewer words (but at least `shortest`); short
    marks items of fewer than SHORTEST words, such as bare answers, which ordinary text has too.
    start_char and end_char are a range of the original text, the end excluded. Cases: null and empty
    texts match nothing; items with a null id or text are not searched; rows with a null doc_id are
    searched as any; repeated rows give repeated matches; several places give several rows; an empty
    benchmark or an empty table gives none. Case, punctuation and spacing do not matter.
    """
    out = None
    for name, sent in _sides(benchmark, limit):

        def work(batches, name=name, sent=sent):
            automaton = None
            for batch in batches:
                automaton = automaton or cached(name, lambda: Automaton(sent.value, window, shortest))
                found = list(automaton.find(batch.column("text").to_pylist()))
                at, item, start, end, n = (pa.array([f[i] for f in found], pa.int64()) for i in range(5))
                short = pa.array([f[5] for f in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), item, start, end, n, short], ["doc_id", "item_id", "start_char", "end_char", "n_words", "short"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(work, "doc_id bigint, item_id bigint, start_char bigint, end_char bigint, n_words bigint, short boolean")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without a match of an item of `shortest` words or more, with all their columns. One pass, no shuffle. Null and empty texts stay."""
    for name, sent in _sides(benchmark, limit):
        flag = fresh(docs, "clean")
        docs = docs.withColumn(flag, _clean(name, sent, window, shortest)(F.col("text"))).filter(F.col(flag)).drop(flag)
    return docs


def _clean(name: str, sent, window: int, shortest: int):
    @F.arrow_udf(T.BooleanType())
    def clean(text: pa.Array) -> pa.Array:
        automaton = cached(name, lambda: Automaton(sent.value, window, shortest))
        out = np.ones(len(text), bool)
        out[[f[0] for f in automaton.find(text.to_pylist())]] = False
        return pa.array(out)

    return clean


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
