"""Documents to tables: what changed is found by fingerprint, cut again, and stored; the rest is kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import text as T
from quern.functions.markdown import Section
from quern.operators import chunking
from quern.session import stored as stored_table

#: Document metadata that every chunk carries, so that filters need no join.
CHUNK_METADATA = ("title", "url", "doc_category", "corpus")


@dataclass(frozen=True)
class Tables:
    documents: DataFrame
    parents: DataFrame
    chunks: DataFrame
    #: source, document_id, status, parents, chunks, error of every document given
    results: DataFrame
    #: The pieces of new documents as they were cut, in a table of ``quern.session.stored``
    pieces: DataFrame


def fingerprinted(documents: DataFrame, settings: Settings) -> DataFrame:
    """document_id, content_hash and fingerprint of documents (source, text)."""
    own = settings.chunking.fingerprint(chunking.VERSION)
    return documents.withColumns({"document_id": T.document_id(F.col("source")), "content_hash": T.content_hash(F.col("text"))}).withColumn("fingerprint", T.fingerprint(F.col("content_hash"), own, settings.embedding.model, settings.embedding.include_context))


def changes(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """``documents`` with status created, updated or unchanged against ``stored`` (id, fingerprint)."""
    known = stored.select(F.col("id").alias("document_id"), F.col("fingerprint").alias("former"))
    status = F.when(F.col("former").isNull(), "created").when(F.col("former") == F.col("fingerprint"), "unchanged").otherwise("updated")
    return documents.join(known, "document_id", "left").withColumn("status", status).drop("former")


def chunk_metadata(metadata: Column, source_type: Column) -> Column:
    own = F.map_filter(metadata, lambda k, v: k.isin(*CHUNK_METADATA) & v.isNotNull())
    return F.map_concat(own, F.create_map(F.lit("source_type"), source_type))


def ingest(loaded: DataFrame, settings: Settings = Settings(), stored: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, most_tokens: int | None = None) -> Tables:
    """New rows of all three tables for loaded files (see quern.sources.files), and a result for every file.

    Files that were skipped or failed, and documents whose fingerprint is stored, give a result row and nothing else.
    """
    good = fingerprinted(loaded.where("status = 'loaded'").drop("status", "error"), settings)
    if stored is not None:
        good = changes(good, stored)
    else:
        good = good.withColumn("status", F.lit("created"))
    new = good.where("status <> 'unchanged'")
    now = F.current_timestamp()
    documents = new.select(
        F.col("document_id").alias("id"), "name", "source", "source_type", "content_hash", F.col("text").alias("content"), F.length("text").alias("char_count"),
        F.map_concat("metadata", F.create_map(F.lit("fingerprint"), F.col("fingerprint"))).alias("metadata"), now.alias("created_at"), now.alias("updated_at"),
    )
    size = settings.chunking

    @F.pandas_udf(f"struct<parents:{chunking.PARENTS},children:{chunking.CHILDREN}>")
    def cut(texts, sections):
        import pandas as pd

        rows = [chunking.chunk(t, [Section(s["start"], s["end"], tuple(s["heading_path"]), s["page"]) for s in own], size) for t, own in zip(texts, sections)]
        return pd.DataFrame(rows, columns=["parents", "children"])

    # Cut once; parents, children and counts are read from what is stored.
    pieces = stored_table(new.select(F.col("document_id").alias("id"), "text", "name", "source_type", "metadata", cut("text", "sections").alias("c")).select("id", "text", "name", "source_type", "metadata", "c.parents", "c.children"))
    parents = chunking.parent_rows(pieces).withColumn("created_at", now)
    chunks = chunking.child_rows(pieces).join(pieces.select(F.col("id").alias("document_id"), "name", chunk_metadata(F.col("metadata"), F.col("source_type")).alias("metadata")), "document_id")
    seen = T.embedding_input(F.col("name"), F.col("section"), F.col("text")) if settings.embedding.include_context else F.col("text")
    chunks = chunks.withColumn("embedding", embed(seen) if embed else F.lit(None).cast("array<float>"))
    chunks = chunks.withColumn("embedding_model", F.lit(settings.embedding.model if embed else None).cast("string")).withColumn("created_at", now)
    if most_tokens is not None:  # what an embedder would cut off is marked
        from quern.functions.tokens import token_estimate

        mark = F.create_map(F.lit("embedding_truncated"), F.lit("true"))
        chunks = chunks.withColumn("metadata", F.when(token_estimate(seen) > most_tokens, F.map_concat("metadata", mark)).otherwise(F.col("metadata")))
    counts = pieces.select(F.col("id").alias("document_id"), F.size("parents").alias("parents"), F.size("children").alias("chunks"))
    done = good.select("source", "document_id", "status").join(counts, "document_id", "left").select("source", "document_id", "status", F.coalesce("parents", F.lit(0)).alias("parents"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.lit(None).cast("string").alias("error"))
    other = loaded.where("status <> 'loaded'").select("source", F.lit(None).cast("string").alias("document_id"), "status", F.lit(0).alias("parents"), F.lit(0).alias("chunks"), "error")
    return Tables(documents, parents, chunks.drop("name"), done.unionByName(other), pieces)


def upsert(stored: DataFrame, new: DataFrame, document: str = "document_id") -> DataFrame:
    """``stored`` without rows of any document in ``new``, and ``new``."""
    return stored.join(new.select(document).distinct(), document, "left_anti").unionByName(new, allowMissingColumns=True)


def summary(results: DataFrame) -> DataFrame:
    """Files and chunks written, by status."""
    return results.groupBy("status").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))


def corpus_stats(documents: DataFrame, parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, parent_chunks, chunks and embedded."""
    a = documents.agg(F.count("*").alias("documents"))
    b = parents.agg(F.count("*").alias("parent_chunks"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))
