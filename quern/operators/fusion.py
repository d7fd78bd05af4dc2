"""Fusion of ranked lists, and reranking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import content_words, sigmoid
from quern.operators.bm25 import top_k


def _weights(weights: dict[str, float]) -> Column:
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative and must not all be zero")
    return F.element_at(F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(float(w)))]), F.col("retriever"))


def _components() -> Column:
    entry = F.struct(F.col("retriever"), F.map_from_arrays(F.array(F.lit("rank"), F.lit("score")), F.array(F.col("rank").cast("double"), F.round("score", 6))))
    return F.map_from_entries(F.collect_list(entry)).alias("components")


def rrf(lists: DataFrame, k: int, weights: dict[str, float], rrf_k: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of lists (query_id, retriever, chunk_id, score, rank), summed per chunk."""
    own = lists.where(F.col("retriever").isin(*weights)).withColumn("w", _weights(weights))
    fused = own.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 9).alias("score"), _components())
    return top_k(fused, k)


def linear(lists: DataFrame, k: int, weights: dict[str, float]) -> DataFrame:
    """Weighted sums of scores brought to 0..1 within each list; a list of one score counts 1."""
    own = lists.where(F.col("retriever").isin(*weights)).withColumn("w", _weights(weights))
    span = own.groupBy("query_id", "retriever").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    own = own.join(span, ["query_id", "retriever"])
    unit = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    fused = own.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * unit), 9).alias("score"), _components())
    return top_k(fused, k)


def term_overlap(query: Column, passage: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: content words shared, over the query's."""
    q = content_words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_words(passage))) / F.size(q)).otherwise(0.0)


def scorer(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A model as a scoring function of two columns, called once per Arrow batch."""

    @F.pandas_udf("double")
    def batch(queries: pd.Series, passages: pd.Series) -> pd.Series:
        return pd.Series(score(queries.tolist(), passages.tolist()), dtype="float64")

    return batch


def rerank(candidates: DataFrame, k: int, score: Callable[[Column, Column], Column] = term_overlap, name: str = "reranker") -> DataFrame:
    """Candidates (query_id, chunk_id, query, text, score, rank, retriever) anew by ``score``; ties keep their former order.

    Former components stay; the first stage and the new score with its probability are added.
    """
    rows = candidates.withColumn("new", F.round(score(F.col("query"), F.col("text")).cast("double"), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("new"), "rank", "chunk_id")
    rows = rows.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)
    first = F.map_from_arrays(F.array(F.lit("rank"), F.lit("score")), F.array(F.col("rank").cast("double"), F.round("score", 6)))
    second = F.map_from_arrays(F.array(F.lit("score"), F.lit("probability")), F.array(F.col("new"), F.round(sigmoid(F.col("new")), 6)))
    kind = "map<string,map<string,double>>"
    earlier = F.coalesce(F.col("components"), F.create_map().cast(kind)) if "components" in candidates.columns else F.create_map().cast(kind)
    return rows.select("query_id", "chunk_id", F.col("new").alias("score"), F.col("new_rank").alias("rank"), F.lit(name).alias("retriever"), F.map_concat(earlier, F.create_map(F.lit("first_stage"), first, F.lit(name), second)).alias("components"))
