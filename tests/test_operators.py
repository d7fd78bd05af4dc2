"""Search, fusion, chunking, ingest, evaluation, generation and dataset operators on small cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.config import Chunking, Retrieval, Settings
from quern.functions.markdown import Section, sections
from quern.functions.tokens import estimate
from quern.operators import ann, bm25, chunking, dataset, dense, evaluation, fusion, generation
from quern.plans import registry
from quern.plans.service import Engine, ServiceError
from quern.sources import datasets, files


def test_bm25_golden(spark):
    docs = spark.createDataFrame([("d0", "liveness probe probe"), ("d1", "readiness probe"), ("d2", "volume mount"), ("d2", "volume mount"), ("d3", None)], "id string, text string").where("id <> 'd3'")
    index = bm25.build(docs, F.col("text"))
    q = spark.createDataFrame([("q", "probe"), ("blank", "  ")], "query_id string, query string")
    rows = bm25.search(index, q, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["d0", "d1"]
    assert rows[0]["score"] == pytest.approx(0.598186, abs=1e-6)
    assert bm25.search(index, q, 0).count() == 0
    kept = bm25.search(index, q, 10, keep=spark.createDataFrame([("d1",)], "chunk_id string")).collect()
    assert [(r["chunk_id"], r["score"]) for r in kept] == [("d1", rows[1]["score"])]


@pytest.mark.parametrize("metric", dense.METRICS)
def test_inverted_file(spark, metric, monkeypatch):
    """Exact with all cells, near to it with some, filtered before ranking; also with queries in blocks."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    v = centres[rng.integers(0, 8, 600)] + 0.3 * rng.normal(size=(600, 16))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "chunk_id long, embedding array<double>")
    q = rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {(r["query_id"], r["chunk_id"]) for r in dense.search(rows, q, 10, metric, 16).collect()}
    index = ann.build(rows, metric, 16, cell_rows=50)
    assert len(index.centres) == 12 and index.rows.count() == 600
    monkeypatch.setattr(ann, "CELL_QUERIES", 2)
    whole = {(r["query_id"], r["chunk_id"]) for r in ann.search(index, q, 10, 12).collect()}
    assert whole == exact
    near = {(r["query_id"], r["chunk_id"]) for r in ann.search(index, q, 10, 4).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    kept = ann.search(index, q, 10, 12, keep=rows.where("chunk_id < 100")).collect()
    assert {r["chunk_id"] for r in kept} <= set(range(100)) and len(kept) == 10 * q.count()


def test_embedder_of_a_model(spark):
    lengths = lambda texts: np.array([[len(t), 0.0, 3.0] for t in texts])
    df = spark.createDataFrame([("abcd",), (None,), ("",)], "t string")
    got = [r["v"] for r in df.select(dense.embedder("lengths", lambda: lengths, 3)(F.col("t")).alias("v")).collect()]
    assert np.allclose(got[0], [0.8, 0, 0.6]) and got[1] is None and np.allclose(got[2], [0, 0, 1])
    raw = df.select(dense.embedder("lengths", lambda: lengths, 3, normalize=False)(F.col("t")).alias("v")).first()["v"]
    assert np.allclose(raw, [4, 0, 3])
    with pytest.raises(Exception, match="not 4"):
        df.select(dense.embedder("other", lambda: lengths, 4)(F.col("t")).alias("v")).collect()


@pytest.mark.parametrize("metric", dense.METRICS)
def test_dense_in_blocks(spark, metric, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(90, 8)))], "chunk_id long, embedding array<double>")
    q = rows.where("chunk_id < 25").withColumnRenamed("chunk_id", "query_id")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(dense.search(rows, q, 4, metric, 8))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(dense, "ROW_BLOCK", 20)
    assert key(dense.search(rows, q, 4, metric, 8)) == want


@pytest.mark.parametrize("metric", dense.METRICS)
def test_dense_is_exact(spark, metric):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, [1.0]), (98, None)], "chunk_id long, embedding array<double>")
    q = rows.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    got = dense.search(rows, q, 4, metric, 8)
    expr = rows.where("chunk_id < 60").alias("c").join(q.alias("q"), F.lit(True)).select("query_id", "chunk_id", F.round(dense.similarity(F.col("q.embedding"), F.col("c.embedding"), metric), 6).alias("score"))
    want = bm25.top_k(expr, 4)
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect())
    assert key(got) == key(want)
    assert dense.search(rows.limit(0), q, 4, metric, 8).count() == 0


def test_fusion_golden(spark):
    rows = [("q", "dense", "a", 0.9, 1), ("q", "dense", "b", 0.5, 2), ("q", "dense", "c", 0.1, 3), ("q", "bm25", "c", 8.0, 1), ("q", "bm25", "a", 4.0, 2)]
    lists = spark.createDataFrame(rows, "query_id string, retriever string, chunk_id string, score double, rank int")
    got = {r["chunk_id"]: r for r in fusion.rrf(lists, 10, {"dense": 1, "bm25": 1}).collect()}
    assert got["a"]["score"] == pytest.approx(1 / 61 + 1 / 62) and got["c"]["score"] == pytest.approx(1 / 63 + 1 / 61) and got["b"]["score"] == pytest.approx(1 / 62)
    assert got["a"]["components"]["dense"] == {"rank": 1.0, "score": 0.9}
    lin = {r["chunk_id"]: r["score"] for r in fusion.linear(lists, 10, {"dense": 0.5, "bm25": 0.5}).collect()}
    assert lin == {"a": 0.5, "b": 0.25, "c": 0.5}
    with pytest.raises(ValueError):
        fusion.rrf(lists, 10, {"dense": 0, "bm25": 0})


def test_rerank_keeps_order_on_ties(spark):
    rows = [("q", x, "tide gauge", t, 1.0 - i / 10, i + 1, "hybrid") for i, (x, t) in enumerate([("a", "none"), ("b", "the tide"), ("c", "tide")])]
    c = spark.createDataFrame(rows, "query_id string, chunk_id string, query string, text string, score double, rank int, retriever string")
    got = fusion.rerank(c, 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("b", 0.5), ("c", 0.5)]
    assert got[0]["components"]["first_stage"] == {"rank": 2.0, "score": 0.9}


TEXT = "# A\n\nFirst paragraph. It has two sentences.\n\n## B\n\n```yaml\nkey: value\n\nother: 1\n```\n\n" + "A sentence with several words that goes on. " * 40 + "\n\n### C\n"


@pytest.mark.parametrize("text", [TEXT, "word " * 900, "a" * 5000, "中文。" * 400, "\n\n# only heading", "~~~\nunclosed\n\ncode", "# H1\n# H2\ntext"])
def test_chunk_invariants(text):
    size = Chunking(60, 10, 200)
    ups, downs = chunking.chunk(text, sections(text), size)
    covered = [False] * len(text)
    for c in downs:
        p = ups[c["parent"]]
        own = text[c["start_char"] : c["end_char"]]
        assert p["start_char"] <= c["start_char"] < c["end_char"] <= p["end_char"]
        assert own == own.strip() and c["token_count"] == estimate(own) <= 60
        covered[c["start_char"] : c["end_char"]] = [True] * len(own)
    assert all(p["token_count"] <= 200 for p in ups)
    assert all(done or ch.isspace() for done, ch in zip(covered, text))


def test_chunk_random_texts():
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "Sentence. ", "\n", "\n\n", "# h\n", "```\n", "- item\n", "x" * 30, "中文。", " "]) for _ in range(rng.randint(0, 120)))
        ups, downs = chunking.chunk(text, sections(text), Chunking(50, 10, 100))
        assert "".join(text.split()) == "" or downs
        seen = {i for c in downs for i in range(c["start_char"], c["end_char"])}
        assert all(i in seen or ch.isspace() for i, ch in enumerate(text))


def test_parents_keep_pages_apart():
    text = "one\n\ntwo\n\nthree"
    got = chunking.parents(text, [Section(0, 3, page=1), Section(5, 8, page=1), Section(10, 15, page=2)], 100)
    assert [(p.start, p.end, page) for p, _, _, page in got] == [(0, 8, 1), (10, 15, 2)]


def test_sentences_ignore_hard_wraps():
    text = "One sentence\nover two lines. Another:\n- item one\n- item two"
    assert [text[a:b] for a, b in chunking.sentence_spans(text)] == ["One sentence\nover two lines.", "Another:", "- item one", "- item two"]


def test_files(spark):
    rows = [("a.md", b"---\ntitle: T\nweight: 3\n---\n# H {#h}\ntext"), ("b.TXT", b" x\r\n\r\n\r\n\r\ny "), ("c.txt", b" \n"), ("d.txt", b"\xff"), ("e.doc", b"x"), ("f.pdf", b"no pdf"), ("g.md", None)]
    got = {r["source"]: r for r in files.load_files(spark.createDataFrame(rows, "source string, content binary")).collect()}
    assert got["a.md"]["name"] == "T" and got["a.md"]["text"] == "# H\ntext\n" and got["a.md"]["metadata"]["weight"] == "3"
    assert got["b.TXT"]["text"] == "x\n\ny\n" and got["b.TXT"]["source_type"] == "txt"
    assert [got[s]["status"] for s in ("c.txt", "d.txt", "e.doc", "f.pdf", "g.md")] == ["skipped", "failed", "failed", "failed", "skipped"]
    assert "unsupported file type" in got["e.doc"]["error"]


def test_engine_end_to_end(spark, tmp_path):
    settings = Settings(chunking=Chunking(60, 10, 200), retrieval=Retrieval(strategy="bm25"))
    from quern.config import Embedding

    settings = Settings(settings.chunking, Embedding(dim=64), settings.retrieval)
    engine = Engine(spark, str(tmp_path / "tables"), settings, lambda c: dense.hash_embedding(c, 64))
    docs = [("a.md", b"# Quays\n\nA quay limits the traffic of boats."), ("b.txt", b"Buoys mark the channel."), ("c.txt", b"")]
    found = spark.createDataFrame(docs, "source string, content binary")
    assert {r["source"]: r["status"] for r in engine.ingest(found).collect()} == {"a.md": "created", "b.txt": "created", "c.txt": "skipped"}
    assert {r["status"] for r in engine.ingest(found.where("source <> 'c.txt'")).collect()} == {"unchanged"}
    changed = spark.createDataFrame([("b.txt", b"Buoys mark the fairway now.")], "source string, content binary")
    assert engine.ingest(changed).first()["status"] == "updated"
    # Only the bucket of the changed document was written anew, and both versions of it are kept.
    (_, before), (_, after) = engine._commits()
    moved = {(n, b) for n in after for b in after[n] if before[n].get(b) != after[n][b]}
    assert len({b for _, b in moved}) == 1 and {n for n, _ in moved} == set(engine.NAMES)
    assert engine.documents().count() == 2 and engine.health()["status"] == "ok"
    assert "fairway" in " ".join(r["text"] for r in engine.table("chunks").collect())
    answer = engine.query("What do buoys mark?")
    assert answer["answer"].endswith("[1]") and answer["citations"][0]["number"] == 1 and not answer["abstained"]
    for strategy in ("dense", "hybrid", "hybrid_rerank"):
        assert engine.query("traffic of a quay", strategy, 2)["contexts"]
    assert engine.query("zzz unknown")["abstained"]
    for text, strategy, status in (("x", "corrective", 501), ("", None, 422), ("x", "none", 422)):
        with pytest.raises(ServiceError) as failure:
            engine.query(text, strategy)
        assert failure.value.status == status
    assert engine.query("traffic", "bm25", filters={"source_type": "txt"})["contexts"] == []


def test_a_write_is_seen_whole_or_not(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "t"), buckets=4)
    put = lambda text: engine.ingest(spark.createDataFrame([(f"{n}.txt", f"{text} {n}".encode()) for n in range(8)], "source string, content binary"))
    put("one")
    (tmp_path / "t" / "commits" / "00000002.json").write_text('{"documents"')  # a writer that died
    assert engine.table("chunks").count() == 8
    put("two")
    assert {r["text"].split()[0] for r in engine.table("chunks").collect()} == {"two"}
    for text in ("three", "four", "five"):
        put(text)
    assert {r["text"].split()[0] for r in engine.table("chunks").collect()} == {"five"}
    assert len(list((tmp_path / "t" / "chunks").iterdir())) == Engine.KEPT


def test_stream_ingest_repeats_nothing(spark, tmp_path):
    from quern.streaming.ingest import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Buoys mark the channel.")
    engine = Engine(spark, str(tmp_path / "t"))
    for _ in range(2):
        watch(engine, str(tmp_path / "in"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert engine.table("documents").count() == 1


def test_labels_and_metrics(spark):
    chunks = spark.createDataFrame([("a", "d", 0, 120), ("b", "d", 90, 300), ("c", "e", 0, 50)], "id string, document_id string, start_char int, end_char int")
    spans = spark.createDataFrame([("i", 0, "d", 100, 200), ("i", 1, "e", 60, 90), ("j", 0, "e", 0, 10)], "item_id string, span int, document_id string, start_char int, end_char int")
    labels = evaluation.span_labels(spans, chunks)
    assert sorted((r["item_id"], r["span"], r["chunk_id"]) for r in labels.collect()) == [("i", 0, "b"), ("j", 0, "c")]
    ranking = spark.createDataFrame([("i", "a", "d", 1), ("i", "b", "d", 2), ("i", "b", "d", 3)], "item_id string, chunk_id string, document_id string, rank int")
    got = {r["item_id"]: r for r in evaluation.ranking_metrics(ranking, labels, spans, (1, 2)).collect()}
    assert got["i"]["mrr"] == 0.5 and got["i"]["evidence_recall@2"] == 0.5 and got["i"]["recall@1"] == 0 and got["i"]["precision@2"] == 0.5
    assert got["i"]["ndcg@2"] == pytest.approx(1 / np.log2(3)) and got["i"]["doc_recall@1"] == 0.5
    assert got["j"]["mrr"] == 0 and got["j"]["evidence_recall@1"] == 0


def test_metrics_golden(spark):
    spans = spark.createDataFrame([("i", n, "d", 0, 1) for n in range(4)], "item_id string, span int, document_id string, start_char int, end_char int")
    labels = spark.createDataFrame([("i", n, c) for n, c in enumerate("abcd")], "item_id string, span int, chunk_id string")
    ranking = spark.createDataFrame([("i", c, "d", n) for n, c in enumerate("axbyc", 1)], "item_id string, chunk_id string, document_id string, rank int")
    r = evaluation.ranking_metrics(ranking, labels, spans, (3, 5)).first()
    assert r["recall@3"] == 0.5 and r["recall@5"] == 0.75 and r["precision@5"] == 0.6 and r["hit@3"] == 1 and r["mrr"] == 1
    ideal = sum(1 / np.log2(i + 1) for i in range(1, 5))
    assert r["ndcg@5"] == pytest.approx((1 + 1 / np.log2(4) + 1 / np.log2(6)) / ideal)


def test_bootstrap_and_comparison(spark, monkeypatch):
    rng = random.Random(2)
    values = [rng.random() for _ in range(300)]
    rows = spark.createDataFrame([("m", f"i{k:04d}", v) for k, v in enumerate(values)], "metric string, item_id string, value double")
    got = evaluation.bootstrap(rows, method="resample").first()
    low, high = evaluation.interval(values)
    assert (got["low"], got["high"]) == (low, high) and evaluation.interval([]) == (0.0, 0.0)
    spread = evaluation.bootstrap(rows).first()
    assert spread["low"] == pytest.approx(low, abs=0.01) and spread["high"] == pytest.approx(high, abs=0.01) and spread["n"] == 300
    assert evaluation.bootstrap(rows.repartition(7)).first() == spread
    monkeypatch.setattr(evaluation, "RESIDENT_VALUES", 10)
    for method in ("resample", "other"):
        with pytest.raises(ValueError):
            evaluation.bootstrap(rows, method=method)
    a = rows.where("item_id < 'i0004'")
    c = evaluation.compare(a, a.withColumn("value", F.col("value") + F.when(F.col("item_id") == "i0000", 0.5).otherwise(0))).first()
    assert (c["b_better"], c["a_better"], c["tied"]) == (1, 0, 3)
    with pytest.raises(ValueError):
        evaluation.compare(a, rows)


def test_generation(spark):
    q = spark.createDataFrame([("q", "What?"), ("none", "Else?")], "query_id string, query string")
    ranked = spark.createDataFrame([("q", "c1", "d", "T", None, 2, 0, 5, "Alpha beta. Gamma.", 1)], "query_id string, chunk_id string, document_id string, title string, section string, page int, start_char int, end_char int, text string, rank int")
    got = {r["query_id"]: r for r in generation.answer(q, ranked).collect()}
    assert got["q"]["answer"] == "Alpha beta. [1]" and got["none"]["abstained"] and got["none"]["model"] is None

    def broken(system, user):
        raise RuntimeError("down")

    assert generation.answer(q, ranked, broken).where("query_id = 'q'").first()["error"] == "RuntimeError: down"
    calls = []

    def flaky(system, user):
        calls.append(1)
        if len(calls) < 3:
            raise generation.Retryable("busy")
        return generation.Reply("ok", "m", 1, 1)

    assert generation.with_retry(flaky, 3, sleep=lambda s: None)("s", "u").attempts == 3


@pytest.mark.parametrize("reply, found", [('{"a": 1}', {"a": 1}), ('```json\n{"a": "}"}\n```', {"a": "}"}), ('Sure: {"a": {"b": "{"}} done', {"a": {"b": "{"}}), ('{bad} {"x": 2}', {"x": 2})])
def test_json_object(reply, found):
    assert generation.json_object(reply) == found


def test_json_object_missing():
    with pytest.raises(ValueError):
        generation.json_object("[1, 2]")


def test_cost(spark):
    calls = spark.createDataFrame([("m", 1000, 2000, 1.5), ("offline", 5, 5, 0.0), ("x", 1, 1, 0.0)], "model string, input_tokens int, output_tokens int, latency_s double")
    u = generation.usage(generation.cost(calls, spark.createDataFrame([("m", 1.0, 2.0)], "model string, price_in double, price_out double"))).first()
    assert u["estimated_cost_usd"] == 0.005 and u["unpriced_models"] == ["x"] and u["llm_calls"] == 3


def test_dataset_building(spark):
    guard = dataset.DuplicateGuard()
    assert guard.accept("How does the buoy limit traffic?") and not guard.accept("Does the buoy limit traffic how?") and guard.accept("Where is the lease stored?")
    assert dataset.evidence_runs([(0, 5), (6, 9), (10, 12)], [3, 1, 2, 2]) == [(0, 12)] and dataset.evidence_runs([(0, 5), (6, 9), (10, 12)], [1, 3]) == [(0, 5), (10, 12)]
    with pytest.raises(ValueError):
        dataset.evidence_runs([(0, 5)], [2])

    def make(row):
        if row["n"] % 2:
            raise ValueError("odd")
        return {"question": f"What about item number {row['n']} of kind {row['n'] * 7}?"}

    b = dataset.build({"a": [{"n": n} for n in range(20)]}, {"a": make}, {"a": 3})
    assert len(b.items) == 3 and b.rejected["a", "odd"] == 2
    items = spark.createDataFrame([(f"i{n}", "t" if n < 10 else "u") for n in range(14)], "id string, question_type string")
    n = {(r["question_type"], r["split"]): r["count"] for r in dataset.stratified_split(items, 0.25).groupBy("question_type", "split").count().collect()}
    assert n == {("t", "dev"): 2, ("t", "test"): 8, ("u", "dev"): 1, ("u", "test"): 3}
    assert dataset.shuffled_split(items, 0.25).where("split = 'dev'").count() == 3


GOLDEN = (
    "# Guide\n\nIntro text here.\n\n## Setup\n\nFirst step is short. Second step is short too! A third one?\n\n```yaml\nkind: Pod\nname: x\n```\n\n- item one\n- item two\n\n## Empty\n"
)


def test_chunker_golden():
    """Pieces of a small document, written out: headings with what follows, a fence whole, sentences and list items where a block is too large, the last sentences repeated."""
    cut = lambda limit, overlap=0, a=0, b=len(GOLDEN): [GOLDEN[p.start : p.end] for p in chunking.pieces(chunking.Ruler(GOLDEN), a, b, limit, overlap)]
    assert [GOLDEN[p.start : p.end] for p in chunking.blocks(chunking.Ruler(GOLDEN), 0, len(GOLDEN))] == [
        "# Guide\n\nIntro text here.", "## Setup\n\nFirst step is short. Second step is short too! A third one?", "```yaml\nkind: Pod\nname: x\n```", "- item one\n- item two", "## Empty"
    ]
    assert cut(1000) == [GOLDEN.strip()]
    assert cut(16) == ["# Guide\n\nIntro text here.\n\n## Setup\n\nFirst step is short.", "Second step is short too! A third one?", "```yaml\nkind: Pod\nname: x\n```", "- item one\n- item two\n\n## Empty"]
    begin = "# Guide\n\nIntro text here.\n\n## Setup\n\nFirst step is short. Second step is short too! A third one?"
    # A repeated span leaves no room for the next one, or only its last sentence fits.
    assert cut(24, 10) == [begin, "Second step is short too! A third one?\n\n```yaml\nkind: Pod\nname: x\n```", "- item one\n- item two\n\n## Empty"]
    assert cut(24, 6) == [begin, "A third one?\n\n```yaml\nkind: Pod\nname: x\n```\n\n- item one\n- item two", "- item one\n- item two\n\n## Empty"]
    own = sections(GOLDEN)
    ups = chunking.parents(GOLDEN, own, 30)
    assert [(u[1], u[2]) for u in ups] == [("Guide", ["Guide"]), ("Guide > Setup", ["Guide > Setup"]), ("Guide > Setup", ["Guide > Setup"]), ("Guide > Empty", ["Guide > Empty"])]


def test_absent_terms(spark):
    terms = spark.createDataFrame([("Quay",), ("buoy mark",), ("İx",), ("",), (None,), ("quay",)], "term string")
    docs = spark.createDataFrame([("the QUAYS",), (None,), ("",)], "text string")
    assert sorted(r["term"] for r in dataset.absent_terms(terms, docs).collect()) == ["buoy mark", "İx"]
    assert dataset.absent_terms(terms.limit(0), docs).count() == 0


def test_normalization_of_files_and_columns_is_one(spark):
    from quern.functions import text as T

    texts = ["", " \n", "a\r\n b \t\r\n\r\n\r\n\r\nc\0", "# H {#x}\n\n\n\n<!-- c\nd -->text  \n", "\u00a0x\u00a0\n\n \n\ny", "## A  B {#y} \n```\n# c {#z}\n```\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_plain(F.col("t")).alias("p"), T.normalize_markdown(F.col("t")).alias("m"))
    for r in df.collect():
        assert r["p"] == files.clean_plain(r["t"]) and r["m"] == files.clean_markdown(r["t"])


def test_dataset_files(spark, tmp_path):
    from quern.schema import EVAL_ITEMS

    good = [("q1", "Q?", "A", "semantic", "easy", "dev", [("d", 0, 2, "ab")], ["d"], ["c"], None, None, None)]
    items = spark.createDataFrame(good, EVAL_ITEMS)
    v = datasets.write_items(items, str(tmp_path / "d"))
    assert len(v) == 12 and datasets.read_items(spark, str(tmp_path / "d"), "dev").count() == 1 and datasets.read_items(spark, str(tmp_path / "d"), "test").count() == 0
    bad = spark.createDataFrame([("q1", "Q?", "A", "semantic", "easy", "dev", [("d", 0, 3, "ab")], ["e"], ["c"], None, None, None)], EVAL_ITEMS)
    assert {r["reason"] for r in datasets.violations(bad).collect()} == {"quote does not fit its span", "evidence from an unlisted document"}


@pytest.mark.parametrize("bad", [{"k1": 9.0}, {"metric": "dot"}, {"dense_weight": 0, "bm25_weight": 0}, {"rerank_top_k": 30, "rerank_candidates": 20}])
def test_settings(bad):
    with pytest.raises(ValueError):
        Retrieval(**bad)
    with pytest.raises(ValueError):
        Chunking(60, 60, 200)


def test_empty_strategy(spark):
    chunks = spark.createDataFrame([], "id string, document_id string, parent_id string, section string, page int, start_char int, end_char int, text string, embedding array<float>, embedding_model string, metadata map<string,string>, created_at timestamp")
    q = spark.createDataFrame([("q", "tide")], "query_id string, query string")
    assert registry.retrieve(registry.Context(chunks, Settings()), q, 5, "bm25").count() == 0


def test_sentences_of_all_documents(spark, data):
    from quern.plans.catalogue import QUERIES

    texts = {
        "md": "# Head\nPods run. They stop!\n\nSteps:\n- one. two\n- three\n\n```\na. b.\n\nc?\n```\n\nEnd",
        "pdf": "Is it? Yes.  \nNo end\n\n\n1. first\n2) second", "blank": " \n", "null": None,
    }
    want = {
        "md": ["# Head\nPods run.", "They stop!", "Steps:", "- one.", "two", "- three", "```\na. b.\n\nc?\n```", "End"],
        "pdf": ["Is it?", "Yes.", "No end", "1.", "first", "2) second"],
    }
    got = {}
    for r in chunking.document_sentences(spark.createDataFrame(list(texts.items()), "id string, text string")).orderBy("document_id", "ordinal").collect():
        got.setdefault(r["document_id"], []).append(texts[r["document_id"]][r["start_char"] : r["end_char"]])
    assert got == want
    docs = {r["id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["document_sentences"](spark, data).collect()
    assert {r["document_id"] for r in rows} == {i for i, t in docs.items() if t and t.strip()}
    inside = {}
    for r in rows:
        inside.setdefault(r["document_id"], []).append((r["start_char"], r["end_char"]))
    assert all("".join("".join(docs[i][a:b] for a, b in sorted(set(own))).split()) == "".join(docs[i].split()) for i, own in inside.items())
