"""Vector functions on array<double> columns, composed of built-in higher-order functions.

A multi-vector ("tokens") is an array of vectors. Sums run left to right in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first 64 numbers of an encoded key: a mark, the vectors' length at DIM_AT, zeros elsewhere.
HEADER, DIM_AT, MARK, MARK_LIMIT = 64, 33, -1e9, -1e8


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scaled_dot(a: Column, b: Column) -> Column:
    """a.b / sqrt(d)"""
    return dot(a, b) / F.sqrt(F.size(a).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine with norms of at least eps."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def mean_pool(tokens: Column) -> Column:
    """The mean vector of a multi-vector; null for one without vectors."""
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    summed = F.aggregate(rest, F.element_at(tokens, 1), lambda acc, t: F.zip_with(acc, t, lambda x, y: x + y))
    return F.when(F.size(tokens) > 0, F.transform(summed, lambda x: x / F.size(tokens)))


def pair_scores(query: Column, tokens: Column) -> Column:
    """Scaled dots of all pairs of a query's and a cell's vectors."""
    return F.flatten(F.transform(query, lambda q: F.transform(tokens, lambda t: scaled_dot(q, t))))


def max_sim(query: Column, tokens: Column) -> Column:
    return F.array_max(pair_scores(query, tokens))


def top_mean(scores: Column, n: int = 5) -> Column:
    """The mean of the n largest scores, of all if there are fewer."""
    top = F.slice(F.sort_array(scores, asc=False), 1, n)
    return F.when(F.size(top) > 0, total(top) / F.size(top))


def sum_of_max(query: Column, tokens: Column) -> Column:
    return total(F.transform(query, lambda q: F.array_max(F.transform(tokens, lambda t: scaled_dot(q, t)))))


def per_head_max_sim(query: Column, tokens: Column, heads: int) -> Column:
    """The mean over heads, equal slices of every vector, of the head's largest dot."""

    def best(h: int) -> Column:
        part = lambda v: F.slice(v, (F.size(v) / heads).cast("int") * h + 1, (F.size(v) / heads).cast("int"))
        return F.array_max(F.flatten(F.transform(query, lambda q: F.transform(tokens, lambda t: scaled_dot(part(q), part(t))))))

    return total(F.array(*[best(h) for h in range(heads)])) / heads


def matvec(rows: Column, v: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, v))


def center(v: Column, mean: Column) -> Column:
    return subtract(v, mean)


def whiten(v: Column, mean: Column, rows: Column) -> Column:
    """W (v - mean)"""
    return matvec(rows, subtract(v, mean))


def expand(query: Column, centroid: Column, alpha: float = 0.7, beta: float = 0.3) -> Column:
    """Pseudo-relevance feedback: alpha times the query and beta times the centroid."""
    return F.zip_with(query, centroid, lambda q, c: alpha * q + beta * c)


def token_weight(token: Column, mean: Column) -> Column:
    """1 - cosine with the corpus mean, within 0 and 1; 1 where either has no length."""
    product = norm(token) * norm(mean)
    return F.when(product > 0, F.least(F.greatest(1 - dot(token, mean) / product, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)


def encode_key(tokens: Column) -> Column:
    """A multi-vector as one array with a header."""
    dim = F.size(F.element_at(tokens, 1)).cast("double")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.concat(F.array(F.lit(MARK)), zeros(DIM_AT - 1), F.array(dim), zeros(HEADER - DIM_AT - 1), F.flatten(tokens))


def key_kind(key: Column) -> Column:
    """'encoded', 'plain', or 'malformed' for a marked key whose length its header does not explain; null for none."""
    dim = F.round(F.element_at(key, DIM_AT + 1))
    body = F.size(key) - HEADER
    marked = F.element_at(key, 1) <= MARK_LIMIT
    sound = (F.size(key) > HEADER) & (dim > 0) & (F.pmod(body.cast("double"), dim) == 0)
    return F.when(key.isNull() | (F.size(key) == 0), None).when(~marked, "plain").when((F.size(key) > DIM_AT) & F.coalesce(sound, F.lit(False)), "encoded").otherwise("malformed")


def decode_key(key: Column) -> Column:
    """The multi-vector of an encoded key, null for any other."""
    dim = F.round(F.try_element_at(key, F.lit(DIM_AT + 1))).cast("int")
    count = ((F.size(key) - HEADER) / dim).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(key, i * dim + HEADER + 1, dim))
    return F.when(key_kind(key) == "encoded", parts)


def rotate(v: Column, position: Column, base: float = 10000.0, back: bool = False) -> Column:
    """Rotary position: pairs (2i, 2i+1) turned by position / base^(2i/d); `back` undoes it."""
    d = F.size(v)

    def turned(x: Column, i: Column) -> Column:
        even = i - F.pmod(i, F.lit(2))
        angle = position.cast("double") / F.pow(F.lit(base), even.cast("double") / d)
        sin = -F.sin(angle) if back else F.sin(angle)
        a, b = F.element_at(v, even + 1), F.element_at(v, even + 2)
        return F.when(F.pmod(i, F.lit(2)) == 0, a * F.cos(angle) - b * sin).otherwise(a * sin + b * F.cos(angle))

    return F.transform(v, turned)


def split_halves(flat: Column) -> tuple[Column, Column]:
    """A flat payload's keys and values."""
    half = (F.size(flat) / 2).cast("int")
    return F.slice(flat, 1, half), F.slice(flat, half + 1, half)


def split_rows(flat: Column, width: int) -> Column:
    """A flat array as rows of `width`; what does not fill a row is left out."""
    n = (F.size(flat) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * width + 1, width))).otherwise(F.array().cast("array<array<double>>"))


def pad_to_blocks(flat: Column, block: int) -> Column:
    """A flat array padded with zeros to whole blocks, as blocks."""
    short = F.pmod(-F.size(flat), F.lit(block))
    return split_rows(F.concat(flat, F.array_repeat(F.lit(0.0), short)), block)
