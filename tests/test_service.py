"""The service over HTTP, model clients, filters, reports and dataset creation."""

import io
import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quern import logs
from quern.config import Chunking, Embedding, Retrieval, Settings
from quern.functions import text as T
from quern.operators import clients, dense, evaluation, generation
from quern.plans import creation, http, registry
from quern.plans.service import Engine, ServiceError
from quern.sources import datasets, files


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("e") / "tables"), Settings(Chunking(120, 10, 200), Embedding(dim=64), Retrieval(strategy="bm25")), lambda c: dense.hash_embedding(c, 64), buckets=4)
    e.init()
    assert e.table("chunks").count() == 0 and e.health()["status"] == "ok"
    said = "The buoy {0} waits {1} seconds before a retry and then keeps its lease in the ledger file of the harbour for all of the other ships to read. "
    docs = [(f"docs/{n}.md", ("# Buoys\n\n" + said.format(n, n + 20) * 5).encode()) for n in range(4)]
    e.ingest(spark.createDataFrame(docs, "source string, content binary")).count()
    return e


def ask(app, method, path, body=None, query=""):
    raw = json.dumps(body).encode() if body is not None else b""
    seen = {}
    out = app({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(raw)), "wsgi.input": io.BytesIO(raw)}, lambda s, h: seen.update(status=int(s.split()[0])))
    return seen["status"], json.loads(b"".join(out))


def test_http(engine):
    app = http.application(engine)
    assert ask(app, "GET", "/health")[0] == 200
    status, page = ask(app, "GET", "/documents", query="limit=2")
    assert status == 200 and len(page["documents"]) == 2
    status, answer = ask(app, "POST", "/query", {"query": "How long does a buoy wait?", "top_k": 2})
    assert status == 200 and answer["sources"][0].startswith("[1] ") and len(answer["contexts"]) == 2 and "text" not in answer["contexts"][0] and answer["usage"]["model"] == "offline"
    assert "text" in ask(app, "POST", "/query", {"query": "buoy", "include_context_text": True})[1]["contexts"][0]
    assert [ask(app, *x)[0] for x in (("POST", "/query", {"query": ""}), ("POST", "/query", {"query": "x", "strategy": "corrective"}), ("POST", "/query", {}), ("GET", "/query"), ("GET", "/none"))] == [422, 501, 422, 405, 404]
    assert ask(app, "POST", "/documents", {"files": [{"filename": "a/b.txt", "content": "Pilots sign."}]})[1]["results"][0]["status"] == "created"


def test_failures_have_a_status(engine):
    def down(system, user):
        raise RuntimeError("down")

    broken = F.udf(lambda t: 1 / 0, "array<float>")
    other = lambda **k: Engine(engine.spark, engine.folder, engine.settings, **{"embed": engine.embed, "buckets": 4} | k)
    for e, strategy, status in ((other(call=down), "bm25", 502), (other(embed=lambda c: broken(c)), "dense", 503), (other(embed=None), "dense", 503)):
        with pytest.raises(ServiceError) as failure:
            e.query("How long does a buoy wait?", strategy)
        assert failure.value.status == status


def test_chat_client():
    replies = [(429, {"Retry-After": "7"}, "slow"), (500, {}, "broken"), (200, {}, "no json"), (400, {}, "bad"), (200, {}, json.dumps({"model": "m1", "choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}))]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            assert json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"] == "u" and self.headers["Authorization"] == "Bearer k"
            status, headers, body = replies.pop(0)
            self.send_response(status)
            for h in headers.items():
                self.send_header(*h)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    call = clients.ChatClient(f"http://127.0.0.1:{server.server_port}", "m", "k", timeout_s=5)
    waits = []
    for _ in range(3):
        with pytest.raises(generation.Retryable) as e:
            call("s", "u")
        waits.append(e.value.after)
    with pytest.raises(clients.ModelError):
        call("s", "u")
    r = generation.with_retry(call, 1)("s", "u")
    assert waits == [7.0, None, None] and (r.content, r.model, r.input_tokens, r.attempts) == ("hi", "m1", 3, 1)
    server.shutdown()
    server.server_close()
    with pytest.raises(generation.Retryable):
        call("s", "u")
    slept = []
    late = clients.Scripted([generation.Retryable("x", 99.0), "ok"])
    assert generation.with_retry(late, 2, sleep=slept.append)("s", "u").attempts == 2 and slept == [30.0] and len(late.asked) == 2
    assert clients.Scripted(responder=lambda s, u: u + "!")("s", "u").content == "u!" and clients.seconds("Tue, 1 Jan") is None


def test_filters_contain(spark):
    rows = spark.createDataFrame([("a", {"k": "v", "j": '{"x": {"y": 1, "z": [1, 2]}, "t": ["p", "q"], "b": true}'}), ("b", {"k": "w", "j": "plain"}), ("c", {})], "id string, m map<string,string>")
    for filters, want in (({"k": "v"}, "a"), ({"j": {"x": {"y": 1}}}, "a"), ({"j": {"t": ["q"]}}, "a"), ({"j": {"t": ["q", "z"]}}, ""), ({"j": {"b": True}}, "a"), ({"j": {"x": {"z": [2, 1]}}}, "a"), ({"j": "plain"}, "b"), ({"k": "v", "j": "plain"}, ""), ({}, "abc")):
        c = registry.Context(rows.withColumnRenamed("m", "metadata"), Settings(), filters=filters)
        assert "".join(sorted(r["id"] for r in c.chunks.where(c.kept()).collect())) == want
    assert rows.limit(1).select(T.capitalized(F.lit("The Pod of a Node. Then Pod and Node, or QuaySet")).alias("w")).first()["w"] == ["Pod", "Node", "QuaySet"]


def test_report_and_paired_runs(spark, engine, tmp_path):
    chunk = engine.table("chunks").orderBy("id").first()
    quote = chunk["text"][:20]
    item = lambda i, e: (i, "How long does the buoy 0 wait?", "x", "numerical" if e else "unanswerable", "easy", "dev", e, [x[0] for x in e], [], None, None, None)
    from quern.schema import EVAL_ITEMS

    items = spark.createDataFrame([item("a", [(chunk["document_id"], chunk["start_char"], chunk["start_char"] + 20, quote)]), item("b", [("nowhere", 0, 2, "ab")]), item("c", [])], EVAL_ITEMS)
    c = registry.Context(engine.table("chunks"), engine.settings, engine.embed)
    report, rows = evaluation.report(lambda q, k: registry.retrieve(c, q, k, "bm25"), items, engine.table("chunks"), (1, 5), dataset_version=datasets.version(items), retriever="bm25")
    assert (report["n_evaluated"], report["n_excluded_no_evidence"], report["unmapped_evidence_spans"]) == (2, 1, 1) and report["counts_by_type"] == {"numerical": 2}
    assert set(report["overall_ci95"]) == {"evidence_recall@5", "mrr", "ndcg@5"} - {"ndcg@5"} and report["by_type"]["numerical"] == report["overall"]
    for name, about in (("r1", report), ("r2", report), ("r3", report | {"dataset_version": "other"})):
        datasets.write_run(str(tmp_path / name), about, rows)
    a, b = datasets.paired_runs(spark, str(tmp_path / "r1"), str(tmp_path / "r2"))
    assert evaluation.compare(evaluation.long_form(a, ("mrr",)), evaluation.long_form(b, ("mrr",))).first()["tied"] == 2
    with pytest.raises(ValueError):
        datasets.paired_runs(spark, str(tmp_path / "r1"), str(tmp_path / "r3"))


def test_dataset_creation_and_extension(spark, engine):
    def call(system, user):
        first = next(w for w in user.split() if w.isdigit())
        return generation.Reply(json.dumps({"question": f"What is the pause length of marker number {first} there?", "answer": f"The buoy {first} waits seconds before a retry.", "sentence_ids": [1]}), "m", 1, 1)

    items, stats = creation.create(engine, {"simple_factual": 2, "out_of_domain": 1}, call)
    assert stats["added"] == 2 and stats["counts"]["all"] == 2 and stats["rejected"]["out_of_domain"] == {"no_reply": 4}
    assert datasets.violations(items).count() == 0
    again, more = creation.create(engine, {"simple_factual": 9}, call, items)
    assert more["added"] <= 2 and {r["id"] for r in items.collect()} <= {r["id"] for r in again.collect()}
    kinds = [r["question_type"] for r in again.collect()]
    assert kinds == sorted(kinds)
    assert creation.linked(engine.table("chunks")).count() == 0 and creation.comparable(engine.table("chunks")).count() == 0
    with pytest.raises(ValueError):
        creation.create(engine, {"none": 1}, call)


def test_review_manifest_and_logs(spark, tmp_path, capsys):
    items = spark.createDataFrame([("i", "t", "Q?", "A", [], {"b": "2", "a": "1"})], "id string, question_type string, question string, ground_truth_answer string, evidence array<struct<quote:string>>, notes map<string,string>")
    assert datasets.review_sample(items, 1).first()["notes"] == "a=1; b=2"
    files.write_manifest(spark.createDataFrame([("a.md", b"abc")], "source string, content binary"), str(tmp_path / "m"), {"commit": "c1"})
    assert spark.read.json(str(tmp_path / "m" / "header")).first().asDict() == {"bytes": 3, "commit": "c1", "files": 1}
    logs.configure("INFO", True)
    logging.getLogger("x").info("hello %s", "you", extra={"n": 3})
    line = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert line["msg"] == "hello you" and line["n"] == 3 and line["level"] == "INFO"
    logs.configure("WARNING")
