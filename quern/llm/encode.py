"""Corpus encoding with a public byte-level BPE vocabulary (problem 8).

Pre-tokens are found without a regular expression: every code point becomes a symbol, a
small transducer over those symbols tells where pre-tokens begin, and its transition
functions are composed block by block with an associative scan, all in numpy. Each
distinct slice then goes through pair merging once per worker and is kept in a cache.

Defined results: a null, empty text gives no ids (an empty list). Nothing is truncated.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies are, unless a path is given.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

# Symbols of the transducer. The letters are those that an English contraction may hold.
LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, STMD, RV, E_, L_, END = range(11)
# States: what the current pre-token is made of so far.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, QUOTE, QUOTE_RV, QUOTE_L = range(9)
N_SYMBOLS, N_STATES, BLOCK = 11, 9, 512
HERE, BEFORE = 1, 2  # a pre-token begins at this code point, at the one before


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    step = np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    mark = np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    kind = {LETTER: IN_LETTERS, STMD: IN_LETTERS, RV: IN_LETTERS, E_: IN_LETTERS, L_: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, APOSTROPHE: QUOTE, END: FRESH}
    for state in range(N_STATES):
        for symbol in range(N_SYMBOLS):
            to, out = kind[symbol], HERE
            if state in (AFTER_BLANK, AFTER_SPACE):
                if symbol in (BLANK, SPACE):
                    out = 0
                elif symbol == END:
                    out = HERE
                elif state == AFTER_BLANK:  # the last blank belongs to what follows
                    out, to = BEFORE, IN_OTHER if symbol == APOSTROPHE else to
                else:
                    out = HERE | BEFORE
            elif state == QUOTE:
                if symbol == STMD:
                    to, out = FRESH, 0
                elif symbol in (RV, L_):
                    to, out = (QUOTE_RV if symbol == RV else QUOTE_L), 0
                elif symbol in (APOSTROPHE, OTHER):
                    to, out = IN_OTHER, 0
            elif state in (QUOTE_RV, QUOTE_L):
                if symbol == (E_ if state == QUOTE_RV else L_):
                    to, out = FRESH, 0
                else:  # no contraction after all: the letter begins a pre-token
                    out = BEFORE | (0 if to == IN_LETTERS else HERE)
            elif state == IN_OTHER and symbol in (OTHER, APOSTROPHE):
                to, out = IN_OTHER, 0
            elif state != FRESH and to == state:
                out = 0
            step[state, symbol], mark[state, symbol] = to, out
    return step.ravel(), mark.ravel()


# Letters and numbers that are newer than the version of Unicode that the vocabulary's libraries know; to them they are other characters.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb
11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
""".split()


@functools.cache
def _symbols() -> np.ndarray:
    """The symbol of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110001, OTHER, np.uint8)
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            shift = [x + (0x800 if x >= 0xD800 else 0) for x in (m.start(), m.end() - 1)]
            out[shift[0] : shift[1] + 1] = symbol
    for run in NEWER:
        first, _, last = run.partition("-")
        out[int(first, 16) : int(last or first, 16) + 1] = OTHER
    for chars, symbol in ((" ", BLANK), ("'", APOSTROPHE), ("stmd", STMD), ("rv", RV), ("e", E_), ("l", L_)):
        out[[ord(c) for c in chars]] = symbol
    out[0x110000] = END
    return out


STEP, MARK = _transducer()


def pretoken_starts(points: np.ndarray) -> np.ndarray:
    """Indices at which pre-tokens begin, in code points where 0x110000 parts the texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // BLOCK)
    symbols = np.full(rows * BLOCK, END, np.uint8)
    symbols[:n] = _symbols()[points]
    grid = symbols.reshape(rows, BLOCK)
    # 1. each block's transition function, for all entry states at once
    f = np.tile(np.arange(N_STATES, dtype=np.int64), (rows, 1))
    for j in range(BLOCK):
        f = STEP[f * N_SYMBOLS + grid[:, j, None]].astype(np.int64)
    # 2. inclusive scan: composing functions is associative, so distances double
    gap = 1
    while gap < rows:
        f[gap:] = np.take_along_axis(f[gap:], f[:-gap].copy(), 1)
        gap *= 2
    state = np.concatenate([[FRESH], f[:-1, FRESH]]).astype(np.int64)
    # 3. with each block's entry state known, the marks
    marks = np.empty((rows, BLOCK), np.uint8)
    for j in range(BLOCK):
        at = state * N_SYMBOLS + grid[:, j]
        marks[:, j] = MARK[at]
        state = STEP[at].astype(np.int64)
    flat = marks.ravel()[:n]
    begins = (flat & HERE) > 0
    begins[:-1] |= (flat[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


class ByteBPE:
    """Pair merging by rank, with a bounded cache of whole slices."""

    def __init__(self, path: str, cached: int = 400_000):
        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.cached, self.cache = cached, {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one slice. The pair of the lowest rank, leftmost first, is merged until none is left."""
        ranks = self.ranks
        if (one := ranks.get(word)) is not None:
            return [one]
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(x := both + parts[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, x))
            if (h := before[i]) >= 0 and (r := ranks.get(x := parts[h] + both)) is not None:
                heapq.heappush(heap, (r, h, x))
        return [ranks[p] for p in parts if p is not None]

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """Of each text its ids, and the pre-tokens' first code points and numbers of ids."""
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1]) + 1
            if size > 1_000_000:
                yield from self._encode(part)
                part, size = [], 0
        if part:
            yield from self._encode(part)

    def _encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        one = [np.append(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.uint32(0x110000)) for t in texts]
        starts = pretoken_starts(np.concatenate(one))
        ends = np.cumsum([len(x) for x in one])
        at, base, cache = 0, 0, self.cache
        for text, end in zip(texts, ends):
            upto = int(np.searchsorted(starts, end - 1, "right"))
            cuts = (starts[at:upto] - base).tolist()
            if not cuts or cuts[-1] != len(text):
                cuts.append(len(text))
            ids: list[int] = []
            counts: list[int] = []
            for a, b in zip(cuts, cuts[1:]):
                piece = text[a:b]
                found = cache.get(piece)
                if found is None:
                    found = self.merge(piece.encode())
                    if len(piece) <= 64:
                        if len(cache) >= self.cached:
                            cache.clear()
                        cache[piece] = found
                ids += found
                counts.append(len(found))
            yield ids, cuts[:-1], counts
            at, base = int(np.searchsorted(starts, end, "left")), int(end)


@functools.lru_cache(4)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def ids_of(text: Column, vocabulary: str = BYTE_BPE_50K) -> Column:
    """The ids of a text column without special tokens; an empty list for null and empty texts."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([x[0] for x in tokenizer(vocabulary).encode_batch(texts.tolist())], dtype=object)

    return encode(text)


def token_count(text: Column, vocabulary: str = BYTE_BPE_50K) -> Column:
    """The number of ids of a text column; 0 for null and empty texts."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x[0]) for x in tokenizer(vocabulary).encode_batch(texts.tolist())], dtype="int32")

    return count(text)


PIECES = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def pieces_of(text: Column, vocabulary: str = BYTE_BPE_50K) -> Column:
    """Ids with the pre-tokens' first code points and numbers of ids, which tie every id to its place."""

    @F.pandas_udf(PIECES)
    def encode(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(tokenizer(vocabulary).encode_batch(texts.tolist()), columns=["ids", "starts", "counts"])

    return encode(text)


def text_of(ids: Column, vocabulary: str = BYTE_BPE_50K) -> Column:
    """The text of a list of ids; null for null. Bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        of = tokenizer(vocabulary).bytes_of
        return pd.Series([None if x is None else b"".join(of[i] for i in x).decode("utf-8", "replace") for x in lists], dtype=object)

    return decode(ids)


def encode_corpus(documents: DataFrame, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id and ids of every row of ``documents`` (doc_id, text; other columns are left aside)."""
    return documents.select("doc_id", ids_of(F.col("text"), vocabulary).alias("ids"))
