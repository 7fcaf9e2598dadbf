"""Vectorised word scanning shared by the operators that read whole texts.

A *word* is a maximal run of ASCII letters and digits and of non-ASCII characters that are not
punctuation or spaces; case is folded. Texts are scanned as one byte buffer per chunk, so the work
per character is a handful of NumPy passes and no Python loop runs over words.
"""

from __future__ import annotations

import re

import numpy as np

#: Non-ASCII spaces and punctuation; they separate words as the ASCII ones do.
MARKS = re.compile("[\u0080-©«-´¶-¹»-¿×÷ -⁯₠-⃏←-⯿⸀-⹿　-〄〈-〠〰︐-︟︰-﹯！-／：-＠［-｀｛-･﻿]")
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[0x80:] = True


def fold(text: str) -> str:
    """Lower case with marks as spaces, and exactly as many characters as the text has."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[:1] for c in text)
    if not low.isascii() and MARKS.search(low):
        low = MARKS.sub(" ", low)
    return low


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """(first, end) index ranges of about `limit` characters; a longer text is a range of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


class Words:
    """The words of some texts: `doc` (index of the text), byte `start` and `end` in `buf`.

    A null text has no words, as an empty one.
    """

    def __init__(self, texts: list):
        parts = [fold(t).encode("utf-8", "replace") if t else b"" for t in texts]
        self.buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.base = np.zeros(len(parts), np.int64)
        np.cumsum([len(p) + 1 for p in parts[:-1]], out=self.base[1:]) if len(parts) > 1 else None
        inside = _WORD[self.buf].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.n = len(parts)
        self._sums = None

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.n)

    def _prefix_sums(self):
        if self._sums is None:
            n = len(self.buf)
            power = np.full(n, BASE, np.uint64)
            power[0] = 1
            np.cumprod(power, out=power)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
            inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            np.cumprod(inverse, out=inverse)
            self._sums = sums, inverse
        return self._sums

    def hashes(self, first_bytes: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first bytes. Equal words have equal hashes everywhere."""
        sums, inverse = self._prefix_sums()
        end = self.end if first_bytes is None else np.minimum(self.end, self.start + first_bytes)
        return mix((sums[end] - sums[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64))
