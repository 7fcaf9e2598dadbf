"""Quantisation on array<double> columns. round() is half away from zero, as the formats ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packmill.functions.vectors import split_rows, total

GROUP = 32


def absmax(v: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(0.0))


def int8(v: Column) -> Column:
    """struct(values, scale): one scale, the largest magnitude / 127, 1 for a zero vector."""
    scale = F.when(absmax(v) > 0, absmax(v) / 127).otherwise(1.0)
    return F.struct(F.transform(v, lambda x: F.least(F.greatest(F.round(x / scale), F.lit(-127.0)), F.lit(127.0)).cast("int")).alias("values"), scale.alias("scale"))


def int8_restore(q: Column) -> Column:
    return F.transform(q["values"], lambda x: x * q["scale"])


def int8_dot(a: Column, b: Column) -> Column:
    """Whole-number dot of two int8() structs, times both scales."""
    whole = F.aggregate(F.zip_with(a["values"], b["values"], lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return whole * a["scale"] * b["scale"]


def _groups(v: Column, size: int) -> Column:
    """The array cut into groups; the last one may be shorter."""
    n = F.ceil(F.size(v) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * size + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def int8_groups(v: Column, size: int = GROUP) -> Column:
    """struct(values, scales, dim): a scale for each group, its magnitude (1e-12 at least) / 127."""
    scale = lambda g: F.greatest(absmax(g), F.lit(1e-12)) / 127
    groups = _groups(v, size)
    values = F.flatten(F.transform(groups, lambda g: F.transform(g, lambda x: F.least(F.greatest(F.round(x / scale(g)), F.lit(-127.0)), F.lit(127.0)).cast("int"))))
    return F.struct(values.alias("values"), F.transform(groups, scale).alias("scales"), F.size(v).alias("dim"))


def int8_groups_restore(q: Column, size: int = GROUP) -> Column:
    return F.transform(q["values"], lambda x, i: x * F.element_at(q["scales"], (i / size).cast("int") + 1))


def q4(v: Column, size: int = GROUP) -> Column:
    """struct(codes, scales, length): 4-bit codes 0 to 15 around 8, a scale (magnitude / 7) for each group."""
    scale = lambda g: absmax(g) / 7
    groups = _groups(v, size)
    code = lambda x, g: F.when(scale(g) > 0, F.least(F.greatest(F.round(x / scale(g)) + 8, F.lit(0.0)), F.lit(15.0))).otherwise(8.0).cast("int")
    return F.struct(F.flatten(F.transform(groups, lambda g: F.transform(g, lambda x: code(x, g)))).alias("codes"), F.transform(groups, scale).alias("scales"), F.size(v).alias("length"))


def q4_restore(q: Column, size: int = GROUP) -> Column:
    return F.transform(q["codes"], lambda c, i: (c - 8) * F.element_at(q["scales"], (i / size).cast("int") + 1))


def q4_pack(q: Column, size: int = GROUP) -> Column:
    """The codes of a q4() struct as bytes (0 to 255), the earlier code in the low half, padded with 8 to whole groups."""
    short = F.pmod(-F.size(q["codes"]), F.lit(size))
    codes = F.concat(q["codes"], F.array_repeat(F.lit(8), short))
    return F.transform(split_rows(codes, 2), lambda p: F.element_at(p, 1).cast("int").bitwiseOR(F.shiftleft(F.element_at(p, 2).cast("int"), 4)))


def q4_unpack(packed: Column, length: Column) -> Column:
    return F.slice(F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4)))), F.lit(1), length)


def per_channel(v: Column, sigma: Column) -> Column:
    """int8_groups of v / sigma."""
    return int8_groups(F.zip_with(v, sigma, lambda x, s: x / s))


def per_channel_restore(q: Column, sigma: Column) -> Column:
    return F.zip_with(int8_groups_restore(q), sigma, lambda x, s: x * s)


def squared_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
