"""Command line: python -m quern init|ingest|eval|compare|create|audit|review ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern import logs


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("ingest", help="files below a folder into tables")
    x.add_argument("path")
    x.add_argument("tables")
    x.add_argument("--limit", type=int)
    x.add_argument("--no-embed", action="store_true")
    x = sub.add_parser("init", help="empty tables")
    x.add_argument("tables")
    x.add_argument("--drop", action="store_true", help="remove what is there first")
    x = sub.add_parser("create", help="a dataset of evaluation items from tables")
    x.add_argument("tables")
    x.add_argument("--out", required=True)
    x.add_argument("--seed", type=int, default=42)
    x.add_argument("--dev-fraction", type=float, default=0.3)
    x.add_argument("--pilot", type=int, help="so many items of every type only")
    x.add_argument("--extend", action="store_true", help="add to the dataset that is there")
    x.add_argument("--quota", action="append", default=[], metavar="TYPE=N")
    x.add_argument("--attempts", type=int, default=4)
    x.add_argument("--llm-url", help="endpoint of chat completions; else the offline stand-in")
    x.add_argument("--llm-model", default="default")
    x = sub.add_parser("eval", help="retrieval metrics of a dataset over tables")
    x.add_argument("tables")
    x.add_argument("--dataset", required=True)
    x.add_argument("--split", default="dev", choices=("dev", "test", "all"))
    x.add_argument("--retriever", default="bm25", choices=("dense", "bm25", "hybrid", "hybrid_rerank"))
    x.add_argument("--out-dir", required=True)
    x.add_argument("--label")
    x = sub.add_parser("compare", help="two runs, item by item")
    x.add_argument("run_a")
    x.add_argument("run_b")
    x.add_argument("--metric", action="append")
    x = sub.add_parser("audit", help="token counts against the estimate")
    x.add_argument("tables")
    x.add_argument("--limit", type=int, default=512)
    x = sub.add_parser("review", help="a CSV sample per question type")
    x.add_argument("dataset")
    x.add_argument("--per-type", type=int, default=5)
    x.add_argument("--seed", type=int, default=0)
    x.add_argument("--out", required=True)
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--json-logs", action="store_true")
    a = p.parse_args(argv)
    logs.configure(a.log_level, a.json_logs)
    spark = SparkSession.builder.appName("quern").getOrCreate()

    from quern.operators import clients, generation
    from quern.operators import dataset, dense, evaluation
    from quern.plans import creation, registry
    from quern.plans.service import Engine
    from quern.session import checkpointed
    from quern.sources import datasets, files

    embed = lambda c: dense.hash_embedding(c, 384)
    if a.command == "ingest":
        found = files.scan(spark, a.path).select("source", "content").orderBy("source")
        engine = Engine(spark, a.tables, embed=None if a.no_embed else embed)
        engine.ingest(found.limit(a.limit) if a.limit else found).groupBy("status").count().show()
    elif a.command == "eval":
        items = datasets.read_items(spark, a.dataset, a.split)
        engine = Engine(spark, a.tables, embed=embed)
        c = registry.Context(engine.table("chunks"), engine.settings, embed)
        report, rows = evaluation.report(
            lambda q, k: registry.retrieve(c, q, k, a.retriever), items, engine.table("chunks"), retriever=a.retriever, dataset=a.dataset, dataset_version=datasets.version(items), split=a.split, config=engine.settings.snapshot()
        )
        folder = f"{a.out_dir}/{datasets.run_name(a.retriever, a.split, a.label)}"
        datasets.write_run(folder, report, rows)
        print(folder)
    elif a.command == "init":
        Engine(spark, a.tables).init(a.drop)
    elif a.command == "create":
        quotas = {k: int(v) for k, v in (q.split("=", 1) for q in a.quota)} or ({k: a.pilot for k in dataset.QUOTAS} if a.pilot else dataset.QUOTAS)
        existing = datasets.read_items(spark, a.out) if a.extend else None
        call = generation.with_retry(clients.ChatClient(a.llm_url, a.llm_model), 3) if a.llm_url else generation.offline
        items, stats = creation.create(Engine(spark, a.tables, embed=embed), quotas, call, existing, a.dev_fraction, a.attempts, a.seed)
        items = checkpointed(items)  # before its own files are written over
        stats["version"] = datasets.write_items(items, a.out)
        print(json.dumps(stats))
    elif a.command == "compare":
        runs = datasets.paired_runs(spark, a.run_a, a.run_b)
        names = tuple(a.metric or [c for c in runs[0].columns if c == "mrr" or "@" in c])
        print(json.dumps([r.asDict() for r in evaluation.compare(*[evaluation.long_form(r, names) for r in runs]).orderBy("metric").collect()], indent=2))
    elif a.command == "audit":
        dataset.token_audit(Engine(spark, a.tables).table("chunks"), a.limit).show()
    else:
        datasets.write_review(spark.read.json(a.dataset), a.out, a.per_type, a.seed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
