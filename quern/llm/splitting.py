"""Cutting oversized texts at natural boundaries (problem 4).

A text is divided into units: paragraphs, code blocks as far as they fit, sentences, and words
where a sentence alone is too large. Between units the cosine of the words in the blocks before
and after is taken; its valleys mark changes of topic. Within the window of sizes that a
piece may have the deepest valley is cut, block and line boundaries being favoured. The next piece
repeats whole units, or else the last lines, words or, in a run without blanks, characters, of up to ``overlap`` tokens from before the cut.

Defined results: null, empty and small texts give no rows. Every piece has at most ``limit``
tokens by the estimate; pieces cover all of the text but white space. A run without any
boundary is cut between characters. Rows repeated exactly give the same pieces once.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import Ruler, estimate
from quern.llm.sentences import Splitter, train

BLOCK_UNITS = 6
LEAST_SHARE = 0.5  # a piece is at least this share of the limit, where a boundary allows
# What kind of boundary ends a unit, and what it adds to the depth of a valley there.
CHARACTER, WORD, SENTENCE, LINE, BLOCK = range(5)
FAVOUR = {CHARACTER: -4.0, WORD: -2.0, SENTENCE: 0.0, LINE: 0.3, BLOCK: 0.6}
TERM = re.compile(r"[^\W\d_]{3,}|[぀-鿿]{2}|[฀-๿]{4}")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
LINE_START, WORD_START = re.compile(r"\n\s*(?=\S)"), re.compile(r"\s+(?=\S)")
OPENING = re.compile(r"^[ ]{0,3}(```|~~~)")


@functools.cache
def splitter() -> Splitter:
    """Sentence boundaries by the built-in examples alone, so that no corpus is needed."""
    return train([])


def block_spans(text: str) -> list[tuple[int, int, bool]]:
    """Paragraphs and fenced code blocks: start, end, is code."""
    out, at, fence = [], 0, ""
    cuts = [m.span() for m in BLANK.finditer(text)] + [(len(text), len(text))]
    start = 0
    for a, b in cuts:
        for line in text[at:a].split("\n"):
            m = OPENING.match(line)
            if m and not fence:
                fence = m[1]
            elif fence and line.strip() == fence:
                fence = ""
        if not fence or b == len(text):
            own = text[start:a]
            if own.strip():
                out.append((start, a, bool(OPENING.match(own.lstrip("\n")))))
            start = b
        at = b
    return out


class Costs(Ruler):
    """Tokens of any slice of a text, and the pieces of a slice."""

    of = Ruler.tokens

    def within(self, a: int, b: int) -> list[tuple[int, int, int]]:
        """Start, end and tokens of the pieces of a slice whose ends lie between pieces."""
        i, j = bisect_left(self.starts, a), bisect_right(self.ends, b)
        return [(self.starts[k], self.ends[k], self.sums[k + 1] - self.sums[k]) for k in range(i, j)]

    def suffix(self, a: int, b: int, most: int) -> int:
        """Where the longest suffix of text[a:b] of at most ``most`` tokens begins: at a line if one begins in it, else a word, else a character."""
        low, high = a, b
        while low < high:  # cost falls as the beginning moves on
            mid = (low + high) // 2
            if self.of(mid, b) <= most:
                high = mid
            else:
                low = mid + 1
        while low < b and (self.of(low, b) > most or unicodedata.combining(self.text[low]) or self.text[low].isspace()):
            low += 1
        if low == a or low >= b:
            return low
        m = LINE_START.search(self.text, low, b) or (None if self.text[low - 1].isspace() else WORD_START.search(self.text, low, b))
        return m.end() if m and m.end() < b else low


def units(text: str, limit: int, costs: Costs) -> list[tuple[int, int, int, int]]:
    """Start, end, tokens and closing boundary of units of at most ``limit`` tokens each."""
    out: list[tuple[int, int, int, int]] = []

    def words(a: int, b: int, last: int) -> None:
        """Word windows of an eighth of the limit; longer runs by characters."""
        goal = max(1, limit // 8)
        start, held, stop = a, 0, a
        for s, e, c in costs.within(a, b):
            if held and held + c > goal:
                out.append((start, s, held, WORD))
                start, held = s, 0
            if c > goal:
                x = s
                while x < e:
                    y = min(e, x + goal * 2)
                    while y - x > 1 and costs.of(x, y) > goal:
                        y -= max(1, (y - x) // 8)
                    out.append((x, y, costs.of(x, y), CHARACTER if y < e else WORD))
                    x = y
                start, held = e, 0
            else:
                held += c
            stop = e
        if held or stop < b and text[start:b].strip():
            out.append((start, b, held, last))
        elif out:
            s, _, n, _ = out[-1]
            out[-1] = (s, b, n, last)

    for a, b, code in block_spans(text):
        parts = [(a, b)]
        if costs.of(a, b) > limit // 4 or not code:
            if code or text.count("\n", a, b) and re.search(r"\n[ ]*(?:[-*+|]|\d+\.|\\item|<)", text[a:b]):
                parts = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\n]+", text[a:b])]
        for k, (s, e) in enumerate(parts):
            ends = LINE if k + 1 < len(parts) else BLOCK
            n = costs.of(s, e)
            if code and n <= limit // 2:
                out.append((s, e, n, ends))
                continue
            spans = list(splitter().paragraph(text, s, e)) or [(s, e)]
            for j, (x, y) in enumerate(spans):
                last = SENTENCE if j + 1 < len(spans) else ends
                c = costs.of(x, y)
                if c > limit // 2:
                    words(x, y, last)
                else:
                    out.append((x, y, c, last))
    return out


def depths(bags: list[Counter]) -> list[float]:
    """Of each gap after a unit, how deep a valley of cohesion it is."""
    n = len(bags)
    sim = []
    # The blocks before and after a gap move on by one unit each, and with them their product and lengths.
    left, right = Counter(), Counter()
    dot = ll = rr = 0
    for x in bags[1 : 1 + BLOCK_UNITS]:
        for k, v in x.items():
            rr += v * (2 * right[k] + v)
            right[k] += v

    def move(block: Counter, other: Counter, bag: Counter, sign: int) -> tuple[int, int]:
        """Add or take a bag: what that changes of the square of the block and of the product."""
        square = product = 0
        for k, v in bag.items():
            v *= sign
            square += v * (2 * block[k] + v)
            product += v * other[k]
            block[k] += v
        return square, product

    for i in range(n - 1):
        for block, other, j, sign in ((left, right, i, 1), (left, right, i - BLOCK_UNITS, -1), (right, left, i, -1) if i else (right, left, -1, 1), (right, left, i + BLOCK_UNITS, 1) if i else (right, left, -1, 1)):
            if 0 <= j < n:
                square, product = move(block, other, bags[j], sign)
                dot += product
                if block is left:
                    ll += square
                else:
                    rr += square
        sim.append(dot / math.sqrt(ll * rr) if ll and rr else 0.0)
    out = []
    for i, s in enumerate(sim):
        l = r = s
        for j in range(i - 1, max(-1, i - 2 * BLOCK_UNITS), -1):
            if sim[j] < l:
                break
            l = sim[j]
        for j in range(i + 1, min(len(sim), i + 2 * BLOCK_UNITS)):
            if sim[j] < r:
                break
            r = sim[j]
        out.append(l + r - 2 * s)
    return [*out, 0.0]


def pieces(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Start, end and tokens of the pieces of a text above ``limit`` tokens; none for others."""
    if not text or len(text) <= limit or estimate(text) <= limit:
        return []
    costs = Costs(text)
    own = units(text, limit, costs)
    bags = [Counter(t.lower() for t in TERM.findall(text, a, b)) for a, b, _, _ in own]
    deep = depths(bags)
    sums = [0]
    for u in own:
        sums.append(sums[-1] + u[2])
    split_run = [0]
    for u in own:
        split_run.append(split_run[-1] + (u[3] == CHARACTER))

    def size(first: int, start: int, last: int) -> int:
        """Tokens from ``start``, which lies before unit ``first``, to the end of unit ``last``."""
        if split_run[last + 1] > split_run[max(0, first - 1)]:
            return costs.of(start, own[last][1])
        return costs.of(start, own[first][0]) + sums[last + 1] - sums[first]

    out: list[tuple[int, int, int]] = []
    first, start = 0, own[0][0]
    while first < len(own):
        shared = costs.of(start, own[first][0])
        room = limit - shared
        # The last unit that fits, by sums and then, where runs are cut, by the text itself.
        last = min(len(own), bisect_right(sums, sums[first] + room)) - 2
        last = max(first, min(last, len(own) - 1))
        while last > first and size(first, start, last) > limit:
            last -= 1
        if last == first and size(first, start, last) > limit:
            start, shared = own[first][0], 0  # no room for what is shared
            last = min(len(own), bisect_right(sums, sums[first] + limit)) - 2
            last = max(first, min(last, len(own) - 1))
            while last > first and size(first, start, last) > limit:
                last -= 1
        if last < len(own) - 1:
            least = limit * LEAST_SHARE
            window = [i for i in range(first, last + 1) if shared + sums[i + 1] - sums[first] >= least] or [last]
            last = max(window, key=lambda i: (deep[i] + FAVOUR[own[i][3]], i))
        end = own[last][1]
        out.append((start, end, costs.of(start, end)))
        first = last + 1
        if first >= len(own):
            break
        # What the next piece repeats: whole units, else the end of the last one, from a line, word or character on.
        begin, held = own[first][0], 0
        k = last
        while k >= 0 and own[k][0] > out[-1][0] and held + own[k][2] <= overlap and own[k][3] != CHARACTER:
            begin, held = own[k][0], held + own[k][2]
            k -= 1
        if begin == own[first][0] and overlap:
            begin = costs.suffix(max(own[last][0], out[-1][0] + 1), own[last][1], overlap)
            if begin >= own[last][1]:
                begin = own[first][0]
        start = begin
    return out


PIECES = "array<struct<ordinal:int,start_char:int,end_char:int,token_count:int>>"


def split_oversized(parents: DataFrame, limit: int, overlap: int) -> DataFrame:
    """parent_id, ordinal, start_char, end_char and token_count (offsets within the parent's text) and text of all pieces."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below limit")

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"ordinal": i, "start_char": a, "end_char": b, "token_count": n} for i, (a, b, n) in enumerate(pieces(t, limit, overlap))] for t in texts], dtype=object)

    # A token has at least one character: what is no longer than the limit never reaches Python.
    rows = parents.where(F.length("text") > limit).select("id", "text").withColumn("p", F.explode(cut("text")))
    return rows.select(F.col("id").alias("parent_id"), "p.ordinal", "p.start_char", "p.end_char", "p.token_count", F.expr("substring(text, p.start_char + 1, p.end_char - p.start_char)").alias("text"))


def oversized(parents: DataFrame, limit: int, overlap: int) -> DataFrame:
    """parent_id of all parents that had to be cut."""
    return split_oversized(parents, limit, overlap).where(F.col("ordinal") == 0).select("parent_id").distinct()
