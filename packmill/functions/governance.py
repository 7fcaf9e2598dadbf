"""Importance, tiers and recency: scalar steps, and their fold over a history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAFT, VALIDATED, CORE = 0, 1, 2
READ, WRITE, DAILY, MAX_DAYS = 3.0, 5.0, 0.995, 10_000
PROMOTE, DEMOTE = (65.0, 85.0), (35.0, 60.0)
BOOST = (1.0, 1.1, 1.25)
TAU = 30.0


def clamp(importance: Column) -> Column:
    return F.least(F.greatest(importance, F.lit(0.0)), F.lit(100.0))


def accessed(importance: Column) -> Column:
    return clamp(importance + READ)


def updated(importance: Column) -> Column:
    return clamp(importance + WRITE)


def decayed(importance: Column, days: Column) -> Column:
    """After whole days, at most MAX_DAYS of them."""
    return clamp(importance * F.pow(F.lit(DAILY), F.least(F.greatest(days, F.lit(0)), F.lit(MAX_DAYS)).cast("double")))


def recency(days: Column) -> Column:
    return F.exp(-F.greatest(days, F.lit(0.0)) / TAU)


def boost(tier: Column) -> Column:
    return F.when(tier == CORE, BOOST[2]).when(tier == VALIDATED, BOOST[1]).otherwise(BOOST[0])


def next_tier(tier: Column, importance: Column) -> Column:
    """Up at 65 and 85, down below 60 and 35; both steps may happen at once."""
    up = F.when(importance >= PROMOTE[1], CORE).when(importance >= PROMOTE[0], F.greatest(tier, F.lit(VALIDATED))).otherwise(tier)
    return F.when((up == CORE) & (importance < DEMOTE[1]), F.when(importance < DEMOTE[0], DRAFT).otherwise(VALIDATED)).when((up == VALIDATED) & (importance < DEMOTE[0]), DRAFT).otherwise(up)


def written(salience: Column) -> Column:
    """struct(importance, tier) of a new memory."""
    importance = updated(clamp(salience))
    return F.struct(importance.alias("importance"), next_tier(F.lit(DRAFT), importance).alias("tier"))


def fold(events: Column, start: Column) -> Column:
    """struct(importance, tier) after an ordered array of events (action, days).

    start is such a struct. An action is 'read', 'write' or 'days', the last with a number of whole days.
    """

    def step(state: Column, e: Column) -> Column:
        importance = F.when(e["action"] == "read", accessed(state["importance"])).when(e["action"] == "write", updated(state["importance"])).otherwise(decayed(state["importance"], e["days"]))
        return F.struct(importance.alias("importance"), next_tier(state["tier"], importance).alias("tier"))

    return F.aggregate(events, start, step)


def governed(raw: Column, days: Column, tier: Column) -> Column:
    """The final score of a result."""
    return raw * recency(days) * boost(tier)
