"""Small tables for the operators' tests."""

from __future__ import annotations

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASHES = ["severity", "grade", "rank", "take", "n_tokens", "tokens", "region", "rack", "shard", "clean", "lost_id", "hi", "lo", "rep", "f", "id", "toxic", "key", "t", "k"]


def docs_of(spark, rows):
    """(doc_id, text) or (doc_id, text, lang, source) rows as documents."""
    full = [(*r, *("en", "src0")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], DOC)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def prose(seed: int, words: int, stem: str = "w") -> str:
    rng = random.Random(seed)
    return " ".join(f"{stem}{rng.randrange(5000)}x" for _ in range(words))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, duck_rel):
    """The rows of a DataFrame and of a DuckDB relation, columns by name."""
    cols = sorted(df.columns)
    want = duck_rel.fetchall()
    names = [d[0] for d in duck_rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda r: repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r))
    return sorted(key(tuple(r)) for r in df.select(*cols).collect()), sorted(key(tuple(r[i] for i in at)) for r in want)
