"""Evaluation datasets, runs and reports as JSON lines and CSV, read with checks and written with versions."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.dataset import seeded
from quern.schema import EVAL_ITEMS, QUESTION_TYPES, SPLITS


def violations(items: DataFrame) -> DataFrame:
    """id and reason of items that break an invariant: evidence, quotes, documents, enumerations, repeated ids."""
    n = F.coalesce(F.size("evidence"), F.lit(0))
    named = F.array_distinct(F.transform("evidence", lambda e: e["document_id"]))
    reasons = [
        (F.col("id").isNull(), "no id"),
        (~F.col("question_type").isin(*QUESTION_TYPES), "unknown question_type"),
        ((F.col("question_type") == "unanswerable") & (n > 0), "unanswerable with evidence"),
        ((F.col("question_type") != "unanswerable") & (n <= 0), "no evidence"),
        (F.exists("evidence", lambda e: (e["start_char"] < 0) | (e["end_char"] <= e["start_char"])), "bad evidence span"),
        (F.exists("evidence", lambda e: F.length(e["quote"]) != e["end_char"] - e["start_char"]), "quote does not fit its span"),
        ((n > 0) & (F.size(F.array_except(named, F.coalesce("relevant_document_ids", F.array().cast("array<string>")))) > 0), "evidence from an unlisted document"),
    ]
    row = items.select("id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(r)) for bad, r in reasons]))).alias("reason"))
    twice = items.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("reason"))
    return row.unionByName(twice)


def read_items(spark: SparkSession, path: str, split: str | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """Items of a JSON lines file. Malformed lines and items that break an invariant raise."""
    items = spark.read.schema(EVAL_ITEMS).option("mode", "FAILFAST").json(path)
    bad = violations(items).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['reason']}" for r in bad))
    if split and split != "all":
        if split not in SPLITS:
            raise ValueError(f"split must be one of {', '.join(SPLITS)} or all")
        items = items.where(F.col("split") == split)
    return items.where(F.col("question_type").isin(*types)) if types else items


def version(items: DataFrame) -> str:
    """12 digits that depend on all items and not on their order or partitions."""
    h = items.select(F.sha2(F.to_json(F.struct(*sorted(items.columns))), 256).alias("h")).agg(F.sum(F.conv(F.substring("h", 1, 14), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    import hashlib

    return hashlib.sha256(f"{h['s']}|{h['n']}".encode()).hexdigest()[:12]


def write_items(items: DataFrame, path: str) -> str:
    """Write JSON lines without nulls; the version of what was written."""
    items.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return version(items)


def run_name(name: str, split: str, label: str | None = None) -> str:
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    return f"{stamp}-retrieval-{name}-{split}" + (f"-{label}" if label else "")


def write_run(folder: str, report: dict, per_query: DataFrame) -> None:
    """report (one JSON object) and per_query of a run below ``folder``."""
    line = per_query.sparkSession.createDataFrame([(json.dumps(report, default=str),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{folder}/report")
    per_query.write.mode("overwrite").json(f"{folder}/per_query")


def paired_runs(spark: SparkSession, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The rows per query of two runs; ValueError unless both are of one version of a dataset."""
    (ra, qa), (rb, qb) = read_run(spark, a), read_run(spark, b)
    versions = [{r[0] for r in x.select("dataset_version").distinct().limit(2).collect()} if "dataset_version" in x.columns else set() for x in (ra, rb)]
    if versions[0] != versions[1]:
        raise ValueError(f"runs of different datasets: {sorted(map(str, versions[0]))} and {sorted(map(str, versions[1]))}")
    return qa, qb


def ordered(items: DataFrame) -> DataFrame:
    """Items by question type and id."""
    return items.orderBy("question_type", "id")


def extended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All items of a dataset and those of the new ones whose id it has not."""
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True)


def read_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{folder}/report"), spark.read.json(f"{folder}/per_query")


def review_sample(items: DataFrame, per_type: int, seed: int = 0) -> DataFrame:
    """Up to ``per_type`` items of every question type in seeded order, evidence and notes in one cell each, for a CSV sheet."""
    w = Window.partitionBy("question_type").orderBy(seeded("id", seed), "id")
    quotes = F.concat_ws(" || ", F.transform("evidence", lambda e: e["quote"]))
    noted = F.array_join(F.transform(F.array_sort(F.map_keys("notes")), lambda k: F.concat(k, F.lit("="), F.element_at("notes", k))), "; ") if "notes" in items.columns else None
    return items.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_type).select("id", "question_type", "question", "ground_truth_answer", quotes.alias("evidence"), *([noted.alias("notes")] if "notes" in items.columns else []))


def write_review(items: DataFrame, path: str, per_type: int, seed: int = 0) -> None:
    review_sample(items, per_type, seed).write.mode("overwrite").option("header", True).csv(path)
