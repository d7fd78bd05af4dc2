"""Retrieval strategies by name: each maps a table of queries to ranked rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import text as T
from quern.functions.analyzer import Analyzer
from quern.operators import bm25, dense, fusion

PLANNED = ("parent_child", "query_rewrite", "multi_query", "corrective", "self_reflective", "claim_verification")


def _containing(wanted: object) -> Callable[[Column], Column]:
    return lambda entry: contains(entry, wanted)


def contains(value: Column, wanted: object, path: str = "$") -> Column:
    """Whether a text, or the JSON in it, contains what is wanted: equal values, all entries of a list, all fields of an object."""
    if isinstance(wanted, dict):
        out = F.lit(True)
        for k, v in wanted.items():
            out = out & contains(value, v, f"{path}['{k}']")
        return out
    if isinstance(wanted, (list, tuple)):
        entries = F.from_json(F.get_json_object(value, path), "array<string>")
        out = entries.isNotNull()
        for v in wanted:
            out = out & F.exists(entries, _containing(v))
        return F.coalesce(out, F.lit(False))
    plain = str(wanted).lower() if isinstance(wanted, bool) else str(wanted)
    return F.coalesce((value if path == "$" else F.get_json_object(value, path)) == plain, F.lit(False))


@dataclass
class Context:
    """What a strategy searches: chunks, settings, an embedder of a text column, a scoring function, and the indexes kept between searches."""

    chunks: DataFrame
    settings: Settings
    embed: Callable[[Column], Column] | None = None
    score: Callable[[Column, Column], Column] = fusion.term_overlap
    filters: dict | None = None
    indexes: bm25.Registry = field(default_factory=bm25.Registry)

    def kept(self) -> Column:
        """Metadata that contains all filters; a filter may be a value, a list or an object, as deep as wanted."""
        out = F.lit(True)
        for k, v in (self.filters or {}).items():
            out = out & contains(F.col("metadata")[k], v)
        return out

    def distinct(self) -> DataFrame:
        """Chunks, one row per id."""
        return self.chunks.where("id is not null").dropDuplicates(["id"])


def by_vector(c: Context, queries: DataFrame, k: int) -> DataFrame:
    """Filters and the check for the present model are below the search, on the scan."""
    if c.embed is None:
        raise RuntimeError("no embedder is configured")
    model = c.settings.embedding.model
    own = c.distinct().where(F.col("embedding").isNotNull() & (F.col("embedding_model") == model) & c.kept()).select(F.col("id").alias("chunk_id"), "embedding")
    asked = queries.where("trim(query) <> ''").select("query_id", c.embed(F.concat(F.lit(c.settings.embedding.query_prefix), "query")).alias("embedding"))
    return dense.search(own, asked, k, c.settings.retrieval.metric, c.settings.embedding.dim).withColumn("retriever", F.lit("dense"))


def by_words(c: Context, queries: DataFrame, k: int) -> DataFrame:
    """Filters are above the search, so that statistics are those of all chunks."""
    r = c.settings.retrieval
    a = Analyzer.of(compound=r.compounds, camel=r.camel_parts, stem=r.stemming)
    text = T.embedding_input(F.col("metadata")["title"], F.col("section"), F.col("text")) if r.include_context else F.col("text")
    index = c.indexes.get(f"context={r.include_context}", c.chunks, text, a)
    keep = c.chunks.where(c.kept()).select(F.col("id").alias("chunk_id")) if c.filters else None
    return bm25.search(index, queries, k, a, r.k1, r.b, keep).withColumn("retriever", F.lit("bm25"))


def by_both(c: Context, queries: DataFrame, k: int) -> DataFrame:
    r = c.settings.retrieval
    depth = max(k, r.candidates)
    columns = ["query_id", "retriever", "chunk_id", "score", "rank"]
    lists = by_vector(c, queries, depth).select(columns).unionByName(by_words(c, queries, depth).select(columns))
    weights = {"dense": r.dense_weight, "bm25": r.bm25_weight}
    fused = fusion.rrf(lists, k, weights, r.rrf_k) if r.fusion == "rrf" else fusion.linear(lists, k, weights)
    return fused.withColumn("retriever", F.lit("hybrid"))


def reranked(c: Context, queries: DataFrame, k: int) -> DataFrame:
    first = by_both(c, queries, max(k, c.settings.retrieval.rerank_candidates))
    texts = c.distinct().select(F.col("id").alias("chunk_id"), "text")
    return fusion.rerank(first.join(texts, "chunk_id").join(queries.select("query_id", "query"), "query_id"), k, c.score).withColumn("retriever", F.lit("hybrid_rerank"))


STRATEGIES: dict[str, Callable[[Context, DataFrame, int], DataFrame]] = {"baseline": by_vector, "dense": by_vector, "bm25": by_words, "hybrid": by_both, "hybrid_rerank": reranked}


def retrieve(c: Context, queries: DataFrame, k: int | None = None, strategy: str | None = None) -> DataFrame:
    """Ranked rows with all columns of a result, for every query (query_id, query).

    A planned strategy raises NotImplementedError, an unknown one ValueError. k <= 0 and blank queries give no rows.
    """
    name = strategy or c.settings.retrieval.strategy
    if name in PLANNED:
        raise NotImplementedError(f"strategy '{name}' is planned")
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy '{name}'")
    if k is None:
        k = c.settings.retrieval.rerank_top_k if name == "hybrid_rerank" else c.settings.retrieval.top_k
    found = STRATEGIES[name](c, queries, max(k, 0))
    own = c.distinct().select(F.col("id").alias("chunk_id"), "document_id", "text", "parent_id", "section", "page", "start_char", "end_char", "metadata")
    out = found.join(own, "chunk_id")
    return out if "components" in out.columns else out.withColumn("components", F.lit(None).cast("map<string,map<string,double>>"))
