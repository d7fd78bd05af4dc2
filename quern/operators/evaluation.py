"""Evidence labels, ranking metrics, their means and intervals, and comparison of runs."""

from __future__ import annotations

import math
import random
import statistics
import time
from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import overlap
from quern.session import checkpointed

KS = (1, 3, 5, 10, 20)
CI_METRICS = ("evidence_recall@5", "evidence_recall@10", "mrr", "ndcg@10")
#: Values that one task may hold for a bootstrap in the order of one seeded generator.
RESIDENT_VALUES = 1_000_000


def spans(items: DataFrame) -> DataFrame:
    """item_id, span, document_id, start_char and end_char of all evidence of (id, evidence)."""
    return items.select(F.col("id").alias("item_id"), F.posexplode("evidence").alias("span", "e")).select("item_id", "span", "e.document_id", "e.start_char", "e.end_char")


def span_labels(evidence: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """item_id, span and chunk_id of chunks that cover at least the share ``least`` of a span. Unmapped spans do not appear."""
    own = chunks.select(F.col("id").alias("chunk_id"), "document_id", F.col("start_char").alias("c_start"), F.col("end_char").alias("c_end")).distinct()
    covered = overlap(F.col("start_char"), F.col("end_char"), F.col("c_start"), F.col("c_end"))
    joined = evidence.join(own, "document_id").where((covered > 0) & (covered >= least * (F.col("end_char") - F.col("start_char"))))
    return joined.select("item_id", "span", "chunk_id").distinct()


def _dcg(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))


def ranking_metrics(ranking: DataFrame, labels: DataFrame, evidence: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per item with evidence: mrr and, at every k, evidence_recall, hit, precision, recall, ndcg and doc_recall.

    ``ranking``: item_id, chunk_id, document_id, rank. Only ranks up to the largest k are read, so an item's lists
    are bounded. An item without results scores 0 everywhere; an unmapped span is a miss; repeated chunks count once.
    """
    most = max(ks)
    relevant = labels.select("item_id", "chunk_id").distinct()
    n_relevant = relevant.groupBy("item_id").agg(F.count("*").alias("n_rel"))
    total = evidence.groupBy("item_id").agg(F.count_distinct("span").alias("n_spans"), F.count_distinct("document_id").alias("n_docs"))
    top = ranking.groupBy("item_id", "chunk_id").agg(F.min("rank").alias("rank")).where(F.col("rank") <= most)
    hits = top.join(relevant, ["item_id", "chunk_id"], "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    span_rank = labels.join(top, ["item_id", "chunk_id"]).groupBy("item_id", "span").agg(F.min("rank").alias("r")).groupBy("item_id").agg(F.collect_list("r").alias("span_ranks"))
    # Documents in order of first appearance, as many as the largest k; limited before the shuffle.
    w = Window.partitionBy("item_id").orderBy("r", "document_id")
    seen = ranking.groupBy("item_id", "document_id").agg(F.min("rank").alias("r"))
    first = seen.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "document_id"))), lambda x: x["document_id"]).alias("docs"))
    wanted = evidence.groupBy("item_id").agg(F.collect_set("document_id").alias("rel_docs"))
    rows = total.join(n_relevant, "item_id", "left").join(hits, "item_id", "left").join(span_rank, "item_id", "left").join(first, "item_id", "left").join(wanted, "item_id")
    none = F.array().cast("array<int>")
    rows = rows.withColumns({"n_rel": F.coalesce("n_rel", F.lit(0)), "ranks": F.coalesce("ranks", none), "span_ranks": F.coalesce("span_ranks", none), "docs": F.coalesce("docs", F.array().cast("array<string>"))})
    out = {"mrr": F.when(F.size("ranks") > 0, 1 / F.element_at("ranks", 1)).otherwise(0.0)}
    for k in ks:
        within = F.filter("ranks", lambda r: r <= k)
        n = F.size(within)
        ideal = F.lit(0.0)
        for i in range(1, k + 1):
            ideal = ideal + F.when(F.col("n_rel") >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(0.0)
        some = F.col("n_rel") > 0
        out |= {
            f"evidence_recall@{k}": F.size(F.filter("span_ranks", lambda r: r <= k)) / F.col("n_spans"),
            f"hit@{k}": F.when(n > 0, 1.0).otherwise(0.0),
            f"precision@{k}": n / F.lit(k),
            f"recall@{k}": F.when(some, n / F.col("n_rel")).otherwise(0.0),
            f"ndcg@{k}": F.when(some, _dcg(within) / ideal).otherwise(0.0),
            f"doc_recall@{k}": F.size(F.array_intersect(F.slice("docs", 1, k), "rel_docs")) / F.col("n_docs"),
        }
    return rows.select("item_id", *[c.cast("double").alias(n) for n, c in out.items()])


def metric_means(metrics: DataFrame, types: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Means (4 decimals) over all items, as type null, and by question_type, in one aggregation."""
    own = metrics.join(types.select("item_id", "question_type"), "item_id")
    return own.groupingSets([[], ["question_type"]], "question_type").agg(F.count("*").alias("n"), *[F.bround(F.avg(f"`{m}`"), 4).alias(m) for m in names])


def latency(values: DataFrame, group: str, value: str) -> DataFrame:
    """mean, p50 (upper median) and p95 (the value at index int(0.95 n) - 1) of every group, by place and not interpolated.

    A group is cut into ranges of about equal counts; only the ranges that hold the two places are ordered,
    so no task orders a whole group.
    """
    own = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    edges = own.groupBy("g").agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("edges"), F.count("*").alias("n"), F.avg("v").alias("mean"))
    ranged = own.join(F.broadcast(edges.select("g", "edges")) if edges.count() <= 10_000 else edges.select("g", "edges"), "g").select("g", "v", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("range"))
    counts = ranged.groupBy("g", "range", "v").agg(F.count("*").alias("c"))
    sums = counts.groupBy("g", "range").agg(F.sum("c").alias("rc")).withColumn("before", F.sum("rc").over(Window.partitionBy("g").orderBy("range")) - F.col("rc"))
    places = sums.join(edges.select("g", "n", "mean"), "g").withColumns({"at50": F.floor(F.col("n") / 2), "at95": F.greatest(F.floor(F.col("n") * 0.95) - 1, F.lit(0))})
    holds = lambda p: (F.col("before") <= F.col(p)) & (F.col(p) < F.col("before") + F.col("rc"))
    wanted = places.where(holds("at50") | holds("at95"))
    upto = counts.join(wanted, ["g", "range"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("g", "range").orderBy("v")))
    least = lambda p: F.min(F.when(holds(p) & (F.col("upto") > F.col(p)), F.col("v")))
    return upto.groupBy(F.col("g").alias(group)).agg(F.round(F.max("mean"), 6).alias("mean"), least("at50").alias("p50"), least("at95").alias("p95"), F.max("n").alias("n"))


def interval(values: list[float], samples: int = 2000, seed: int = 0) -> tuple[float, float]:
    """Percentile bootstrap of the mean, in the order of Python's generator; (0, 0) without values."""
    if not values:
        return 0.0, 0.0
    rng = random.Random(seed)
    means = sorted(statistics.fmean(rng.choices(values, k=len(values))) for _ in range(samples))
    return round(means[int(0.025 * samples)], 4), round(means[int(0.975 * samples) - 1], 4)


#: Shares of draws of at most 0, 1, 2, ... times: the Poisson distribution of mean 1.
POISSON = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])


def draws(items: list[str], samples: int, seed: int) -> np.ndarray:
    """How often each item is drawn in each sample, by its id, the sample and the seed alone."""
    own = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in items], np.uint64)[:, None]
    with np.errstate(over="ignore"):
        z = own + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) / 2.0**53)


def bootstrap(rows: DataFrame, samples: int = 2000, seed: int = 0, method: str = "poisson") -> DataFrame:
    """metric, n, low and high of values (metric, item_id, value): a percentile bootstrap of the mean.

    "poisson" resamples where the rows are, each item drawn a number of times that only its id, the sample and the
    seed decide, so it is the same however the rows are partitioned; only sums are shuffled. "resample" gives the
    figures of ``interval`` in item order and holds a metric in one task, so it raises ValueError for more than RESIDENT_VALUES values.
    """
    if method == "resample":
        if not rows.groupBy("metric").count().where(F.col("count") > RESIDENT_VALUES).isEmpty():
            raise ValueError(f"a metric has more than {RESIDENT_VALUES} values; use the poisson method")

        def exact(pdf: pd.DataFrame) -> pd.DataFrame:
            low, high = interval(pdf.sort_values("item_id")["value"].tolist(), samples, seed)
            return pd.DataFrame({"metric": [pdf["metric"].iloc[0]], "n": [len(pdf)], "low": [low], "high": [high]})

        return rows.groupBy("metric").applyInPandas(exact, "metric string, n long, low double, high double")
    if method != "poisson":
        raise ValueError("method must be poisson or resample")

    def drawn(batches):
        sums: dict[str, list] = {}
        for pdf in batches:
            for metric, own in pdf.groupby("metric"):
                held = sums.setdefault(metric, [0, np.zeros(samples), np.zeros(samples)])
                for a in range(0, len(own), 500):
                    w = draws(own["item_id"].iloc[a : a + 500].astype(str).tolist(), samples, seed)
                    held[0] += len(w)
                    held[1] += own["value"].iloc[a : a + 500].to_numpy(float) @ w
                    held[2] += w.sum(0)
        for metric, (n, total, count) in sums.items():
            yield pd.DataFrame({"metric": metric, "n": n, "sample": np.arange(samples), "total": total, "count": count})

    parts = rows.where("value is not null").select("metric", "item_id", "value").mapInPandas(drawn, "metric string, n long, sample int, total double, count double")
    means = parts.groupBy("metric", "sample").agg((F.sum("total") / F.greatest(F.sum("count"), F.lit(1.0))).alias("m"), F.sum("n").alias("n"))
    lists = means.groupBy("metric").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("m")).alias("ms"))  # ``samples`` numbers a metric
    return lists.select("metric", "n", F.bround(F.col("ms")[int(0.025 * samples)], 4).alias("low"), F.bround(F.col("ms")[int(0.975 * samples) - 1], 4).alias("high"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs (item_id, metric, value): means, difference and how many items each wins, by metric.

    Raises ValueError unless both runs hold the same items and metrics. Both are read once, in one full join.
    """
    keys = ["item_id", "metric"]
    both = a.select(*keys, F.col("value").alias("x"), F.lit(1).alias("in_a")).join(b.select(*keys, F.col("value").alias("y"), F.lit(1).alias("in_b")), keys, "full").withColumn("d", F.col("y") - F.col("x"))
    # One row per metric.
    out = checkpointed(both.groupBy("metric").agg(
        F.bround(F.avg("x"), 4).alias("a"), F.bround(F.avg("y"), 4).alias("b"), F.bround(F.avg("d"), 4).alias("diff_b_minus_a"),
        F.count_if(F.col("d") > 0).alias("b_better"), F.count_if(F.col("d") < 0).alias("a_better"), F.count_if(F.col("d") == 0).alias("tied"),
        F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("alone"),
    ))
    if not out.where("alone > 0").isEmpty():
        raise ValueError("runs are not comparable: different items or metrics")
    return out.drop("alone")


def report(search: Callable[[DataFrame, int], DataFrame], items: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = KS, **about: str) -> tuple[dict, DataFrame]:
    """(report, per query) of a search (queries, k) -> ranked rows over items (id, question, question_type, difficulty, evidence).

    The report: means of all metrics over all items and by type, intervals, counts, items without evidence, spans that no
    chunk covers, seconds of the whole batch and per query, and whatever ``about`` names (dataset, version, config). Items are
    searched as one batch after a warm-up, so latency is the batch's share.
    """
    scored = items.where(F.size("evidence") > 0)
    queries = scored.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    search(queries.limit(1), 1).count()  # loads what a first call loads
    began = time.perf_counter()
    found = checkpointed(search(queries, max(ks)).select(F.col("query_id").alias("item_id"), "chunk_id", "document_id", "rank"))
    took = time.perf_counter() - began
    evidence = checkpointed(spans(scored))
    labels = checkpointed(span_labels(evidence, chunks))
    metrics = checkpointed(ranking_metrics(found, labels, evidence, tuple(sorted(set(ks)))))
    names = tuple(c for c in metrics.columns if c != "item_id")
    types = scored.select(F.col("id").alias("item_id"), "question_type")
    means = [r.asDict() for r in metric_means(metrics, types, names).collect()]  # a row per type
    n, every = metrics.count(), items.count()
    unmapped = evidence.select("item_id", "span").join(labels.select("item_id", "span").distinct(), ["item_id", "span"], "left_anti").count()
    ci = {r["metric"]: [r["low"], r["high"]] for r in bootstrap(long_form(metrics, tuple(m for m in CI_METRICS if m in names))).collect()}
    own = lambda r: {k: r[k] for k in names}
    out = {
        **about, "created_at": datetime.now(timezone.utc).isoformat(), "ks": sorted(set(ks)), "n_evaluated": n, "n_excluded_no_evidence": every - n, "unmapped_evidence_spans": unmapped,
        "overall": next((own(r) for r in means if r["question_type"] is None), {}), "overall_ci95": ci, "by_type": {r["question_type"]: own(r) for r in means if r["question_type"] is not None},
        "counts_by_type": {r["question_type"]: r["n"] for r in means if r["question_type"] is not None}, "latency_s": {"batch": round(took, 5), "mean": round(took / max(1, n), 5)},
    }
    listed = found.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved_chunk_ids"))
    relevant = labels.groupBy("item_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant_chunk_ids"))
    return out, metrics.join(types, "item_id").join(listed, "item_id", "left").join(relevant, "item_id", "left")


def long_form(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """item_id, metric and value."""
    return metrics.unpivot("item_id", [F.col(f"`{n}`") for n in names], "metric", "value")
