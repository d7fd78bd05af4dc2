"""Questions that occur in an evaluation split and, exactly or almost, in the training split (problem 5).

A question is reduced to its names and its words. Names are flags, camel-case and underscored
words, paths, numbers and versions; two questions that differ in one ask for different things, so a
pair must share them all. The words give the shingles: letter trigrams within a word, because
order, spelling and wording may change; five-word shingles would break at each such change.

* Equal reduced questions are one class, so copies are never compared with one another.
* Only names that both sides have can make a pair: the classes of all others are left out first.
* Minwise hashes of the shingles are cut into bands; a training and an evaluation class that share their
  names and a band are a candidate, and the exact Jaccard similarity of the shingles decides.
* What is left may still name another object. Where two questions have different words, no misspellings of
  one another, between the same two neighbours, all questions tell what kind of place that is: a slot that
  many words fill (by the perplexity of its words, SLOT or more) holds an object, so the pair is none; a place
  with few words holds wording. In a small collection no place is known as a slot.
* Items are joined back to confirmed classes at the end; the report counts by class sizes and expands no pairs.

Defined results: items with a null id, question or split, or a split other than train, dev and test,
are in no pair; of several questions of one id in one split the least counts; an item is no pair with
itself; blank questions match nothing.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed

BANDS, ROWS = 30, 3
#: Of a pair at this similarity the bands find 0.98, at 0.65 and above more than 0.9998.
LEAST_SIMILARITY = 0.5
#: Words that a place holds, in effect, from which on it is a slot for objects.
SLOT = 8.0
TRAIN, EVALUATION = "train", ("dev", "test")

NAME = re.compile(r"--[\w-]+|\b[a-z]+(?:[A-Z][a-z0-9]*)+\b|\b\w+(?:_\w+)+\b|\bv?\d+(?:[.,]\d+)*\b|\b[\w-]+\.[a-z]{2,4}\b|/[\w./-]+")
PLACE = re.compile(r"#|[^\W_]+")
INVISIBLE = re.compile("[­​-‏⁠﻿]")


def reduced(question: str) -> tuple[str, str, str]:
    """The names of a question, its words, each in order and parted by blanks, and its words as they follow, with # for a name."""
    if not question.isascii():
        question = INVISIBLE.sub("", unicodedata.normalize("NFKC", question))
    names: list[str] = []

    def taken(m: re.Match) -> str:
        names.append(m[0].rstrip("."))
        return " # "

    said = PLACE.findall(NAME.sub(taken, question.replace("#", " ")).lower())
    names.sort()
    if question.isupper():
        names = [x.lower() for x in names]
    return " ".join(names), " ".join(sorted(w for w in said if w != "#")), " ".join(said)


def misspelt(a: str, b: str, more: int = 0) -> bool:
    """Whether few edits (a letter more, less, other, or two swapped) turn a word into the other: none below 4 letters, 1 at 4, 1 + ``more`` up to 7, else 2 + ``more``."""
    if a == b:
        return True
    n = max(len(a), len(b))
    most = 0 if n < 4 else 1 if n == 4 else 1 + more if n <= 7 else 2 + more
    if abs(len(a) - len(b)) > most:
        return False
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        two, one = one, row
    return one[-1] <= most


def frames(said: str) -> list[tuple[int, str]]:
    """Of each word between two others or at the end: a hash of its neighbours, and the word."""
    import xxhash

    words = said.split()
    return [(xxhash.xxh3_64_intdigest(f"{l} {r}") >> 1, w) for l, w, r in zip(words, words[1:], [*words[2:], "$"]) if w != "#"]


def exchanged(a: str, b: str) -> list[int]:
    """The places, by ``frames``, in which two questions have words that the other lacks and that are no misspellings."""
    own_a, own_b = frames(a), frames(b)
    of_a, of_b = set(a.split()), set(b.split())
    left = {f: w for f, w in own_b if w not in of_a}
    return [f for f, w in own_a if w not in of_b and f in left and not misspelt(w, left[f], 1)]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of words parted by blanks: hashes of the trigrams of ``^word$`` and, of each, the text it is of."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(points) < 3:
        return np.zeros(0, np.uint64), owner[:0]
    with np.errstate(over="ignore"):
        h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + points[2:]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    # A trigram is centred on a letter; those across the blank between two words are none.
    inner = (points[1:-1] != 32) & (owner[:-2] == owner[2:])
    return h[inner] ^ (h[inner] >> np.uint64(31)), owner[1:-1][inner]


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = BANDS * ROWS
    return rng.integers(1, 2**61, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**61, n, dtype=np.uint64)


def bands(texts: list[str]) -> list[list[int]]:
    """The band hashes of each text; a text without words has those of the empty set."""
    a, b = _functions()
    x, owner = trigrams(texts)
    first = np.searchsorted(owner, np.arange(len(texts)))
    some = np.flatnonzero(np.diff(np.r_[first, len(owner)]) > 0)
    mix = np.zeros((len(texts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            for j in range(band * ROWS, (band + 1) * ROWS):
                low = np.zeros(len(texts), np.uint64)
                if len(some):
                    low[some] = np.minimum.reduceat((x * a[j] + b[j]) >> np.uint64(20), first[some])
                mix[:, band] = (mix[:, band] ^ low) * np.uint64(0x9E3779B97F4A7C15)
        mix += np.arange(BANDS, dtype=np.uint64)
    return mix.view(np.int64).tolist()


def similarities(a: list[str], b: list[str]) -> np.ndarray:
    """The exact Jaccard similarity of the trigrams of each pair; two texts without words are alike."""
    x, of_x = trigrams(a)
    y, of_y = trigrams(b)
    # Sorted by pair and trigram, a trigram's first row counts for the union, and its first row of the second side after one of the first for the intersection.
    pair, h, side = np.r_[of_x, of_y], np.r_[x, y], np.r_[np.zeros(len(x), bool), np.ones(len(y), bool)]
    order = np.lexsort((side, h, pair))
    pair, h, side = pair[order], h[order], side[order]
    again = np.r_[False, (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])][: len(pair)]
    second = again & side & ~np.r_[False, side[:-1]][: len(pair)]
    both, every = np.bincount(pair[second], minlength=len(a)), np.bincount(pair[~again], minlength=len(a))
    return np.where(every > 0, both / np.maximum(1, every), 1.0)


def matched(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): item, split and class of every item in reach, and the confirmed pairs of classes.

    members: id, split, cid. pairs: t, e (classes, maybe the same) and similarity.
    """
    split = F.lower(F.trim(F.regexp_replace("split", r"\s+", " ")))
    own = items.where("id is not null and question is not null").select("id", "question", split.alias("split")).where(F.col("split").isin(TRAIN, *EVALUATION))
    own = own.groupBy("id", "split").agg(F.min("question").alias("question"))

    @F.pandas_udf("names string, words string, said string")
    def read(questions: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reduced(q) for q in questions], columns=["names", "words", "said"])

    @F.pandas_udf("array<long>")
    def buckets(words: pd.Series) -> pd.Series:
        return pd.Series(bands(words.tolist()), dtype=object)

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(similarities(a.tolist(), b.tolist()))

    @F.pandas_udf("array<long>")
    def places(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([exchanged(x, y) for x, y in zip(a, b)], dtype=object)

    @F.pandas_udf("places array<long>, words array<string>")
    def fillers(said: pd.Series) -> pd.DataFrame:
        own = [frames(x) for x in said]
        return pd.DataFrame({"places": [[f for f, _ in x] for x in own], "words": [[w for _, w in x] for x in own]})

    rows = checkpointed(own.withColumn("r", read("question")).select("id", "split", "r.names", "r.words", "r.said").where("names <> '' or words <> ''"))
    train = F.col("split") == TRAIN
    sides = F.max(train).alias("in_train"), F.max(~train).alias("in_eval")
    classes = rows.groupBy("names", "words").agg(F.min(F.concat_ws("\t", "id", "split")).alias("cid"), F.min("said").alias("said"), *sides)
    reach = classes.groupBy("names").agg(F.max("in_train").alias("a"), F.max("in_eval").alias("b")).where("a and b").select("names")
    classes = checkpointed(classes.join(reach, "names"))
    bucketed = classes.select("cid", "names", "in_train", "in_eval", F.explode(buckets("words")).alias("bucket"))
    left = bucketed.where("in_train").select("bucket", "names", F.col("cid").alias("t"))
    right = bucketed.where("in_eval").select("bucket", "names", F.col("cid").alias("e"))
    candidates = left.join(right, ["bucket", "names"]).where("t <> e").select("t", "e").distinct()
    one = classes.select(F.col("cid").alias("t"), F.col("words").alias("a"), F.col("said").alias("x"))
    two = classes.select(F.col("cid").alias("e"), F.col("words").alias("b"), F.col("said").alias("y"))
    near = candidates.join(one, "t").join(two, "e").withColumn("similarity", similarity("a", "b")).where(F.col("similarity") >= LEAST_SIMILARITY)
    near = checkpointed(near.select("t", "e", "similarity", places("x", "y").alias("places")))
    # All questions tell how many words the places hold in which a pair differs.
    asked = checkpointed(near.select(F.explode("places").alias("place")).distinct())
    few = asked.count() < 500_000  # of 8 bytes each
    held = rows.select(fillers("said").alias("f")).select(F.explode(F.arrays_zip("f.places", "f.words")).alias("f")).select(F.col("f.places").alias("place"), F.col("f.words").alias("word")).join(F.broadcast(asked) if few else asked, "place", "left_semi").groupBy("place", "word").agg(F.count("*").alias("n"))
    spread = held.groupBy("place").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("bits"))
    slots = spread.where(F.col("bits") >= float(np.log(SLOT))).select("place")
    other = near.select("t", "e", F.explode("places").alias("place")).join(slots, "place", "left_semi").select("t", "e").distinct()
    near = near.join(other, ["t", "e"], "left_anti").select("t", "e", "similarity")
    same = classes.where("in_train and in_eval").select(F.col("cid").alias("t"), F.col("cid").alias("e"), F.lit(1.0).alias("similarity"))
    members = rows.join(classes.select("cid", "names", "words"), ["names", "words"]).select("id", "split", "cid")
    return members, near.unionByName(same)


def overlaps(items: DataFrame) -> DataFrame:
    """train_id, eval_id, eval_split and similarity of all confirmed pairs of ``items`` (id, question, split)."""
    members, pairs = matched(items)
    train = members.where(F.col("split") == TRAIN).select(F.col("cid").alias("t"), F.col("id").alias("train_id"))
    evaluation = members.where(F.col("split") != TRAIN).select(F.col("cid").alias("e"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"))
    return pairs.join(train, "t").join(evaluation, "e").where("train_id <> eval_id").select("train_id", "eval_id", "eval_split", "similarity")


def found(items: DataFrame) -> DataFrame:
    """item_a and item_b, smaller id first."""
    return overlaps(items).select(F.least("train_id", "eval_id").alias("item_a"), F.greatest("train_id", "eval_id").alias("item_b")).distinct()


def report(items: DataFrame) -> DataFrame:
    """Confirmed pairs and the items in them per evaluation split and source (``provenance.method``).

    Pairs are the products of class sizes, less an item's pair with itself where its id is on both sides.
    """
    members, pairs = matched(items)
    members, pairs = checkpointed(members), checkpointed(pairs.select("t", "e"))
    method = items.where("id is not null").groupBy("id").agg(F.min("provenance.method").alias("method"))
    train = members.where(F.col("split") == TRAIN).select("id", F.col("cid").alias("t"))
    evaluation = members.where(F.col("split") != TRAIN).select("id", "split", F.col("cid").alias("e")).join(method, "id", "left")
    itself = train.join(evaluation, "id").join(pairs, ["t", "e"]).groupBy("id", "split", "method").agg(F.lit(1).alias("self"))
    key = ["split", "method"]
    # From the evaluation side: how many training items each class reaches.
    reached = pairs.join(train.groupBy("t").agg(F.count("*").alias("n")), "t").groupBy("e").agg(F.sum("n").alias("n"))
    asked = evaluation.join(reached, "e").join(itself.drop("method"), ["id", "split"], "left").withColumn("n", F.col("n") - F.coalesce("self", F.lit(0))).where("n > 0")
    of_eval = asked.groupBy(*key).agg(F.sum("n").alias("pairs"), F.count("*").alias("eval_items"))
    # From the training side: how many evaluation items of each split and method.
    sizes = evaluation.groupBy("e", *key).agg(F.count("*").alias("m"))
    sides = pairs.join(sizes, "e").groupBy("t", *key).agg(F.sum("m").alias("m"))
    known = train.join(sides, "t").alias("k").join(itself.alias("i"), (F.col("k.id") == F.col("i.id")) & (F.col("k.split") == F.col("i.split")) & F.col("k.method").eqNullSafe(F.col("i.method")), "left")
    of_train = known.where(F.col("k.m") > F.coalesce("i.self", F.lit(0))).groupBy("k.split", "k.method").agg(F.count("*").alias("train_items"))
    a, b = of_eval.alias("a"), of_train.alias("b")
    joined = a.join(b, (F.col("a.split") == F.col("b.split")) & F.col("a.method").eqNullSafe(F.col("b.method")))
    return joined.select(F.col("a.split").alias("eval_split"), "a.method", "a.pairs", "a.eval_items", "b.train_items")
