"""One ranking from several differently scaled scores (problem 1).

Each query's retrievers list chunks with scores. A walker on the chunks picks one of the
query's retrievers at random and jumps to a chunk, uniformly among those the retriever scores
at least as high as the present one (a chunk the retriever doesn't list lies below all it
lists). With probability 1 - DAMPING the walker starts anew at any chunk. Chunks are ordered by the
stationary probability, so only each list's order counts and every list counts equally.

The chunks above a place are a prefix of the sorted list, so one step of the power iteration
needs only running sums over each list, not the pairs. Two ways give the same figures:
queries of up to ``resident_rows`` scores are solved batch by batch in numpy, many queries at
once; a larger query, however large, is solved with DataFrames whose running sums are kept per
block of places, so that no task holds a whole list.

Defined results: null and NaN scores, rows without query, chunk or retriever, and repeated
rows count nothing; infinite scores are the best or worst of their list; equal scores share a
place; a list whose scores are all equal lifts all its chunks alike. Of several scores of one
chunk in one list the highest counts. Ties in the final order go to the higher mean
normalised place, then to the smaller chunk id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpointed

DAMPING = 0.85
#: The walk goes on until a step moves less probability than this within every query; damping bounds the steps by 171.
TOLERANCE = 1e-12
#: Scores that one task solves together, about.
PACK_ROWS = 200_000
RANKED = "query_id string, chunk_id string, rank int, weight double"


def scores(results: DataFrame, fused: tuple[str, ...] = ("hybrid",)) -> DataFrame:
    """(query_id, chunk_id, list, score), one row each: single rows as they are, fused rows taken apart."""
    single = results.where(F.col("components").isNull() & ~F.col("retriever").isin(*fused)).select("query_id", "chunk_id", F.col("retriever").alias("list"), "score")
    parts = results.where(F.col("components").isNotNull()).select("query_id", "chunk_id", F.explode("components").alias("list", "part")).select("query_id", "chunk_id", "list", F.col("part")["score"].alias("score"))
    every = single.unionByName(parts)
    return every.where("query_id is not null and chunk_id is not null and list is not null and score is not null and not isnan(score)").groupBy("query_id", "chunk_id", "list").agg(F.max("score").alias("score"))


def walk(query: np.ndarray, chunk: np.ndarray, lists: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solve many queries at once. All arguments are codes or scores of one row per (query, chunk, list).

    Returns of each item, an item being a (query, chunk): its query, its chunk, its stationary probability, and
    with it the tie-break, its mean normalised place.
    """
    order = np.lexsort((-score, lists, query))
    query, chunk, lists, score = query[order], chunk[order], lists[order], score[order]
    n = len(query)
    item_key, item = np.unique(np.stack([query, chunk]), axis=1, return_inverse=True)
    item = item.ravel()
    item_query = item_key[0]
    new = np.r_[True, (query[1:] != query[:-1]) | (lists[1:] != lists[:-1])]
    of_list = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, n])
    list_query = query[first]
    tie = np.r_[True, new[1:] | (score[1:] != score[:-1])]
    of_tie = np.cumsum(tie) - 1
    tie_end = np.r_[np.flatnonzero(tie)[1:], n]
    reach = (tie_end[of_tie] - first[of_list]).astype(float)  # chunks at least as high
    _, n_lists = np.unique(list_query, return_counts=True)
    queries, items_of = np.unique(item_query, return_counts=True)
    q_item, q_list = np.searchsorted(queries, item_query), np.searchsorted(queries, list_query)
    start = 1.0 / items_of[q_item]
    x = start.copy()
    tie_first = np.flatnonzero(tie)
    last = np.r_[first[1:], n]
    moving = 1.0
    while moving > TOLERANCE:
        mine = x[item]
        sums = np.r_[np.cumsum((mine / reach)[::-1])[::-1], 0.0]  # from a place down, over all lists
        listed = np.add.reduceat(mine, first)
        per_query = np.bincount(q_item, x, len(queries))
        outside = (per_query[q_list] - listed) / size
        got = sums[tie_first[of_tie]] - sums[last[of_list]] + outside[of_list]
        moved = np.bincount(item, got / n_lists[q_list[of_list]], len(x))
        new_x = (1 - DAMPING) * start + DAMPING * moved
        moving = np.bincount(q_item, np.abs(new_x - x), len(queries)).max() if len(x) else 0.0
        x = new_x
    place = np.bincount(item, 1.0 - (reach - 1) / size[of_list], len(x)) / n_lists[q_item]
    return item_query, item_key[1], x, place


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rank the chunks of the queries of one pack of scores (query_id, chunk_id, list, score)."""
    query, queries = pd.factorize(pdf["query_id"], sort=True)
    chunk, chunks = pd.factorize(pdf["chunk_id"], sort=True)
    lists, _ = pd.factorize(pdf["list"], sort=True)
    q, c, x, place = walk(query, chunk, lists, pdf["score"].to_numpy(float))
    weight = np.round(x, 12)
    order = np.lexsort((c, -np.round(place, 9), -weight, q))
    q, c, weight = q[order], c[order], weight[order]
    new = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(new, np.diff(np.r_[new, len(q)])) + 1
    return pd.DataFrame({"query_id": np.asarray(queries)[q], "chunk_id": np.asarray(chunks)[c], "rank": rank.astype("int32"), "weight": weight})


def _solve_large(own: DataFrame, block: int, tolerance: float) -> DataFrame:
    """The same walk over (query_id, chunk_id, list, score) with DataFrames, until ``tolerance`` is met."""
    by_list = ["query_id", "list"]
    # Places without a window over a whole list: score ties are counted, cut into blocks by quantiles, and
    # summed block by block; a block never holds more than its share of distinct scores.
    ties = own.groupBy(*by_list, "score").agg(F.count("*").alias("n"))
    bins = ties.groupBy(*by_list).agg(F.percentile_approx("score", [i / block for i in range(1, block)], 10 * block).alias("edges"))
    ties = ties.join(F.broadcast(bins) if bins.count() < 1000 else bins, by_list).withColumn("blk", F.lit(block) - F.size(F.filter("edges", lambda e: e < F.col("score")))).drop("edges")
    per = ties.groupBy(*by_list, "blk").agg(F.sum("n").alias("bn"))
    w = Window.partitionBy(*by_list).orderBy("blk")
    per = per.select(*by_list, "blk", (F.sum("bn").over(w) - F.col("bn")).alias("before"), F.sum("bn").over(Window.partitionBy(*by_list)).alias("size"))
    inside = Window.partitionBy(*by_list, "blk").orderBy(F.desc("score"))
    ties = ties.join(per, [*by_list, "blk"]).select(*by_list, "score", "blk", "size", (F.col("before") + F.sum("n").over(inside)).alias("reach"))
    n_lists = own.groupBy("query_id").agg(F.count_distinct("list").alias("n_lists"), F.count_distinct("chunk_id").alias("n_items"))
    placed = checkpointed(own.join(ties, [*by_list, "score"]).join(F.broadcast(n_lists), "query_id"))
    x = checkpointed(placed.select("query_id", "chunk_id", "n_items").distinct().withColumn("x", 1 / F.col("n_items")))
    down = Window.partitionBy(*by_list).orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    moving = 1.0
    while moving > tolerance:
        mine = placed.join(x.select("query_id", "chunk_id", "x"), ["query_id", "chunk_id"])
        tie = mine.groupBy(*by_list, "blk", "reach").agg(F.sum(F.col("x") / F.col("reach")).alias("s"), F.sum("x").alias("m"))
        lower = tie.groupBy(*by_list, "blk").agg(F.sum("s").alias("bs"), F.sum("m").alias("bm")).select(*by_list, "blk", F.coalesce(F.sum("bs").over(down), F.lit(0.0)).alias("lower"), F.sum("bm").over(Window.partitionBy(*by_list)).alias("listed"))
        sums = tie.join(lower, [*by_list, "blk"]).select(*by_list, "blk", "reach", "listed", (F.col("lower") + F.sum("s").over(Window.partitionBy(*by_list, "blk").orderBy(F.desc("reach")))).alias("got"))
        moved = placed.join(sums, [*by_list, "blk", "reach"]).groupBy("query_id", "chunk_id", "n_items").agg(F.sum((F.col("got") + (1 - F.col("listed")) / F.col("size")) / F.col("n_lists")).alias("moved"))
        former = x.select("query_id", "chunk_id", F.col("x").alias("former"))
        x = checkpointed(moved.select("query_id", "chunk_id", "n_items", ((1 - DAMPING) / F.col("n_items") + DAMPING * F.col("moved")).alias("x")).join(former, ["query_id", "chunk_id"]))
        moving = x.groupBy("query_id").agg(F.sum(F.abs(F.col("x") - F.col("former"))).alias("m")).agg(F.max("m")).first()[0] or 0.0
    place = placed.groupBy("query_id", "chunk_id").agg((F.sum(1 - (F.col("reach") - 1) / F.col("size")) / F.max("n_lists")).alias("place"))
    return x.join(place, ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.round("x", 12).alias("weight"), F.round("place", 9).alias("place"))


def _ranked_large(solved: DataFrame) -> DataFrame:
    """Ranks within queries of any size: rows are sorted in ranges, and a range's ranks begin after those before it."""
    order = [F.desc("weight"), F.desc("place"), F.col("chunk_id")]
    ranges = checkpointed(solved.repartitionByRange("query_id", *order).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("query_id", "range").agg(F.count("*").alias("n"))  # a row per query and range
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("query_id").orderBy("range")) - F.col("n"))
    inside = F.row_number().over(Window.partitionBy("query_id", "range").orderBy(*order))
    return ranges.join(before, ["query_id", "range"]).select("query_id", "chunk_id", (F.col("before") + inside).cast("int").alias("rank"), "weight")


def rank_chunks(results: DataFrame, top: int | None = None, resident_rows: int = 20_000, block: int = 64, tolerance: float = TOLERANCE) -> DataFrame:
    """query_id, chunk_id, rank and weight of every scored chunk, or of each query's first ``top``.

    Queries of up to ``resident_rows`` scores are dealt to packs of about PACK_ROWS scores each by a hash of their id, one
    task per pack; larger ones are solved with DataFrames.
    """
    own = checkpointed(scores(results))
    size = own.groupBy("query_id").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") > resident_rows).select("query_id")
    any_large = not large.isEmpty()
    small = own
    if any_large:  # at most rows / resident_rows queries
        small = own.join(F.broadcast(large), "query_id", "left_anti")
    packs = -(-own.count() // PACK_ROWS) or 1
    pack = F.pmod(F.xxhash64("query_id"), F.lit(packs))
    ranked = small.withColumn("pack", pack).groupBy("pack").applyInPandas(_solve, RANKED)
    if any_large:
        solved = checkpointed(_solve_large(own.join(F.broadcast(large), "query_id"), block, tolerance))
        ranked = ranked.unionByName(_ranked_large(solved))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def first_chunks(results: DataFrame) -> DataFrame:
    """query_id and chunk_id of the chunk that comes first of each query."""
    return rank_chunks(results, top=1).select("query_id", "chunk_id")
