"""A dataset of evaluation items from the tables of an engine: candidates by type, items by a model, splits and statistics."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import builders, dataset, dense
from quern.operators.generation import Reply, offline
from quern.plans.service import Engine
from quern.schema import EVAL_ITEMS
from quern.session import checkpointed
from quern.sources import datasets

ABSENT = ("warp drive", "time crystal", "quantum berth", "bread recipe", "football league", "tax return")


def passages(engine: Engine, existing: DataFrame | None = None, most_per_document: int = 3, seed: int = 0) -> DataFrame:
    """Eligible chunks with their document's text, few per document, without those that existing items use; existing documents count towards the few."""
    chunks = engine.table("chunks")
    own = dataset.eligible(chunks)
    if existing is not None:
        own = dataset.unused(own, existing)
        used = existing.select(F.explode("relevant_document_ids").alias("document_id")).groupBy("document_id").agg(F.count("*").alias("used"))
        own = own.join(used, "document_id", "left").where(F.coalesce("used", F.lit(0)) < most_per_document).drop("used")
    texts = engine.table("documents").select(F.col("id").alias("document_id"), "content")
    return dataset.per_document(own, most_per_document, seed).withColumn("title", F.col("metadata")["title"]).join(texts, "document_id")


def linked(chunks: DataFrame, k: int = 3) -> DataFrame:
    """chunk_id and other_id: of each chunk the ``k`` chunks, most similar by embedding, of the pages that it links to."""
    pairs = dataset.linked_pairs(chunks)
    own = chunks.where("embedding is not null").select(F.col("id").alias("chunk_id"), F.col("embedding").alias("a"))
    other = chunks.where("embedding is not null").select(F.col("id").alias("other_id"), F.col("document_id").alias("to_id"), F.col("embedding").alias("b"))
    near = pairs.join(own, "chunk_id").join(other, "to_id").select("chunk_id", "other_id", dense.similarity(F.col("a"), F.col("b")).alias("score"))
    from quern.operators.bm25 import top_k

    return top_k(near.toDF("query_id", "chunk_id", "score"), k).select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("other_id"), "rank")


def comparable(chunks: DataFrame, k: int = 30, dims: int = 64) -> DataFrame:
    """chunk_id and other_id: introductions and those among their ``k`` most similar ones that lie in the same folder of another document."""
    intros = dataset.introductions(chunks)
    vectors = intros.select(F.col("id").alias("chunk_id"), "embedding")
    near = dense.search(vectors, vectors.withColumnRenamed("chunk_id", "query_id"), k, dims=dims)
    return dataset.siblings(intros, near.select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("other_id")))


def candidates(engine: Engine, kind: str, own: DataFrame, wanted: int, seed: int = 0) -> DataFrame:
    """Up to ``wanted`` candidates of a type in seeded order, as builders.build takes them."""
    spark = engine.spark
    if kind in builders.UNANSWERABLE:
        terms = spark.createDataFrame([(t,) for t in ABSENT], "term string")
        absent = dataset.absent_terms(terms, engine.table("documents").select(F.col("content").alias("text")))
        return absent.select(F.sha2("term", 256).alias("candidate_id"), "term").orderBy(dataset.seeded("term", seed)).limit(wanted)
    columns = ["document_id", "content", "title", "section", "start_char", "end_char"]
    first = own.select(F.col("id").alias("candidate_id"), *columns, "text")
    if kind in builders.PAIRED:
        chunks = engine.table("chunks")
        pairs = linked(chunks) if kind == "multi_hop" else comparable(chunks, dims=engine.settings.embedding.dim)
        other = own.select(F.col("id").alias("other_id"), *[F.col(c).alias(f"{c}_b") for c in columns])
        rows = first.join(pairs.select(F.col("chunk_id").alias("candidate_id"), "other_id"), "candidate_id").join(other, "other_id").dropDuplicates(["candidate_id"]).drop("other_id")
    elif kind == "keyword_heavy":
        rows = first.withColumn("term", F.get(T.identifiers(F.col("text")), F.lit(0))).where("term is not null")
    elif kind == "numerical":
        rows = first.where(T.has_numeric_fact(F.col("text")))
    else:
        rows = first
    return rows.drop("text").orderBy(dataset.seeded("candidate_id", seed), "candidate_id").limit(wanted)


def create(engine: Engine, quotas: dict[str, int], call: Callable[[str, str], Reply] = offline, existing: DataFrame | None = None, dev_fraction: float = 0.3, attempts: int = 4, seed: int = 0) -> tuple[DataFrame, dict]:
    """(items, statistics): of every type up to its quota of new items, from at most quota * ``attempts`` candidates, and the existing ones.

    Existing questions count as duplicates, and existing chunks and documents as used. Splits are dealt to all items anew.
    """
    spark = engine.spark
    unknown = set(quotas) - set(dataset.QUOTAS)
    if unknown:
        raise ValueError(f"unknown types {sorted(unknown)}")
    known = existing if existing is not None else spark.createDataFrame([], EVAL_ITEMS)
    own = checkpointed(passages(engine, existing, seed=seed))
    made, rejected = spark.createDataFrame([], EVAL_ITEMS), {}
    for kind, quota in quotas.items():
        built = checkpointed(builders.build(candidates(engine, kind, own, quota * attempts, seed), kind, call))
        rejected[kind] = {r["reason"]: r["n"] for r in builders.rejections(built).collect()}  # a row per reason
        good = builders.accepted(built)
        seen = known.unionByName(made).select("id", "question")
        twice = dataset.near_duplicates(seen.unionByName(good.select("id", "question")))
        repeated = twice.join(good.select(F.col("id").alias("b")), "b").select(F.col("b").alias("id")).unionByName(twice.join(good.select(F.col("id").alias("a")), "a").select(F.col("a").alias("id"))).distinct()
        good = good.join(repeated, "id", "left_anti").join(seen.select("id"), "id", "left_anti").orderBy("candidate_id").limit(quota)
        spans = F.transform("evidence", lambda e: e["document_id"])
        rows = good.select(
            "id", "question", F.col("answer").alias("ground_truth_answer"), "question_type", "difficulty", F.lit("dev").alias("split"), "evidence", F.array_distinct(spans).alias("relevant_document_ids"),
            F.when(F.size("evidence") > 0, F.array("candidate_id")).otherwise(F.array().cast("array<string>")).alias("relevant_chunk_ids"), F.lit(kind if kind in builders.UNANSWERABLE else None).cast("string").alias("subtype"), "notes",
            F.struct(F.lit("synthetic_llm").alias("method"), F.lit(None).cast("string").alias("generator_model"), F.lit("1").alias("prompt_version")).alias("provenance"),
        )
        made = checkpointed(made.unionByName(rows))
    items = datasets.extended(known, made)
    split = dataset.stratified_split(items.select("id", "question_type"), dev_fraction, seed).select("id", "split")
    items = datasets.ordered(checkpointed(items.drop("split").join(split, "id").select(spark.createDataFrame([], EVAL_ITEMS).columns)))
    stats = {"created_at": datetime.now(timezone.utc).isoformat(), "seed": seed, "added": made.count(), "counts": {}, "rejected": rejected}
    for r in dataset.counts(items).collect():  # a row per type and per split
        stats["counts"][r["question_type"] or r["split"] or "all"] = r["n"]
    return items, stats
