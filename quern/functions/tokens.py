"""The token estimate: a column expression, and its counterpart for texts inside Python functions.

Punctuation costs 1. A word holding digits and letters costs one per 2 characters begun, any
other word one per 7, and a compound identifier is costed run by run.
"""

from __future__ import annotations

import functools
import itertools
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a piece and a run of an identifier are, and characters per token.
PIECE = r"\w+|[^\w\s]"
RUN = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"
WORD_CHARS, MIXED_CHARS = 7, 2

_piece, _run = re.compile(PIECE), re.compile(RUN)


@functools.lru_cache(200_000)
def word_cost(word: str) -> int:
    """Tokens of one piece. Words recur, so most are only looked up."""
    n = len(word)
    if n == 1:
        return 1
    if word.isalpha() and word.islower():  # the common case: one run, or none
        runs = [n] if word.isascii() else [len(x) for x in _run.findall(word)]
        per = WORD_CHARS
    else:
        mixed = any(map(str.isdigit, word)) and any(map(str.isalpha, word))
        runs = [n] if mixed else [len(x) for x in _run.findall(word)]
        per = MIXED_CHARS if mixed else WORD_CHARS
    return sum(1 + (k - 1) // per for k in (runs if len(runs) > 1 else [n]))


def costed(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]]:
    """Start, end and tokens of every piece of text[start:end]."""
    return [(m.start(), m.end(), word_cost(m[0])) for m in _piece.finditer(text, start, len(text) if end is None else end)]


def estimate(text: str, start: int = 0, end: int | None = None) -> int:
    """Tokens of text[start:end]."""
    return sum(word_cost(x) for x in _piece.findall(text, start, len(text) if end is None else end))


class Ruler:
    """Tokens of any slice of a text from running sums over its pieces."""

    def __init__(self, text: str):
        self.text = text
        own = costed(text)
        self.starts, self.ends = [p[0] for p in own], [p[1] for p in own]
        self.sums = [0, *itertools.accumulate(p[2] for p in own)]

    def tokens(self, a: int, b: int) -> int:
        """``estimate(text, a, b)``."""
        i, j = bisect_left(self.starts, a), bisect_right(self.ends, b)
        if i and self.ends[i - 1] > a or j < len(self.ends) and self.starts[j] < b:
            return estimate(self.text, a, b)  # an end lies within a piece
        return self.sums[max(i, j)] - self.sums[i]


def token_estimate(text: Column) -> Column:
    """Tokens of a text column, computed in the JVM; null for null."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f])"), 1)

    def cost(p: Column) -> Column:
        n = F.length(p)
        runs = F.regexp_extract_all(p, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?![a-z])|\p{Nd}+)"), 1)
        by_run = F.aggregate(runs, F.lit(0), lambda a, r: a + 1 + F.floor((F.length(r) - 1) / WORD_CHARS).cast("int"))
        whole = (1 + F.floor((n - 1) / WORD_CHARS)).cast("int")
        mixed = p.rlike(r"\p{Nd}") & p.rlike(r"\p{L}")
        return F.when(n == 1, 1).when(mixed, (1 + F.floor((n - 1) / MIXED_CHARS)).cast("int")).when(F.size(runs) > 1, by_run).otherwise(whole)

    return F.aggregate(pieces, F.lit(0), lambda a, p: a + cost(p))
