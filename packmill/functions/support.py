"""Small things around a run: environment variables in configurations, retries, and keys for texts without a model."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_env(value, env: dict | None = None):
    """Strings that are `${NAME}` as a whole become that variable, or empty; lists and dictionaries are gone through."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v, env) for v in value]
    whole = isinstance(value, str) and value[:2] == "${" and value[-1:] == "}"
    return env.get(value[2:-1], "") if whole else value


class Exhausted(RuntimeError):
    """All attempts failed; the last error is the cause."""


def retrying(call: Callable, attempts: int = 3, delay: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again after delay, delay * factor, ... seconds; Exhausted after the last attempt."""
    if attempts < 1:
        raise ValueError("at least one attempt is needed")

    def tried(*args):
        error = None
        for n in range(attempts):
            if n:
                sleep(delay * factor ** (n - 1))
            try:
                return call(*args)
            except Exception as e:  # whatever the wrapped call raises
                error = e
        raise Exhausted(f"{attempts} attempts failed") from error

    return tried


def text_key(text: Column, size: int = 8) -> Column:
    """A vector in [-1, 1) from a text alone, the same in any process: what a capture function gives where there is no model."""
    unit = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", i.cast("string"), F.coalesce(text, F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 31) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), unit)
