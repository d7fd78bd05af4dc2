"""Problems 1 and 2: the rank walk against a dense transition matrix, neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import neighbours as N
from quern.llm import rank_walk as W
from quern.llm import router

RESULTS = "query_id string, chunk_id string, score double, rank int, retriever string, components map<string,map<string,double>>, chunk_ids string, weight int"


def stationary(lists):
    """Of {list: {chunk: score}} by the full transition matrix."""
    chunks = sorted({c for own in lists.values() for c in own})
    n = len(chunks)
    p = np.zeros((n, n))
    for own in lists.values():
        for i, c in enumerate(chunks):
            up = [j for j, x in enumerate(chunks) if x in own and (c not in own or own[x] >= own[c])]
            p[i, up] += 1 / len(up) / len(lists)
    x = np.full(n, 1 / n)
    for _ in range(200):
        x = (1 - W.DAMPING) / n + W.DAMPING * x @ p
    return dict(zip(chunks, x))


def logged(seed=3, queries=7):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for q in range(queries):
        lists = {}
        for name, scale in (("bm25", 10), ("dense", 1), ("sparse", 5000)):
            own = {f"c{i}": float(np.round(rng.random() * scale, 2 if name != "bm25" else 0)) for i in rng.permutation(12)[: rng.integers(1, 12)]}
            lists[name] = own
            rows += [(f"q{q}", c, s, 1, name, None, "clash", 1) for c, s in own.items()]
        truth[f"q{q}"] = stationary(lists)
    rows += [("q0", "c0", None, 1, "bm25", None, "", 0), ("q0", "c99", float("nan"), 1, "dense", None, "", 0), (None, "c", 1.0, 1, "dense", None, "", 0), ("q0", "c1", 5.0, 1, "hybrid", None, "", 0)]
    return rows + rows[:20], truth


@pytest.mark.parametrize("resident, tolerance", [(20_000, 1e-12), (5, 1e-3)])
def test_walk_is_the_chain(spark, resident, tolerance):
    rows, truth = logged(queries=7 if resident > 5 else 2)
    got = W.rank_chunks(spark.createDataFrame(rows, RESULTS), resident_rows=resident, block=4, tolerance=tolerance).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {(q, c) for q, own in truth.items() for c in own}
    near = max(1e-9, 5 * tolerance)
    for r in got:
        assert r["weight"] == pytest.approx(truth[r["query_id"]][r["chunk_id"]], abs=near)
    for q, own in truth.items():
        first = next(r["chunk_id"] for r in got if r["query_id"] == q and r["rank"] == 1)
        assert own[first] == pytest.approx(max(own.values()), abs=near)


def test_ranks_of_a_large_query(spark):
    """Sorted in ranges, with ties that a range boundary may cut."""
    rng = np.random.default_rng(0)
    rows = [(q, f"c{i:04d}", float(rng.integers(0, 6)), float(rng.integers(0, 3))) for q in ("a", "b") for i in range(500)]
    got = W._ranked_large(spark.createDataFrame(rows, "query_id string, chunk_id string, weight double, place double")).collect()
    for q in ("a", "b"):
        want = [c for _, _, c in sorted((-w, -p, c) for x, c, w, p in rows if x == q)]
        assert [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
        assert {r["rank"] for r in got if r["query_id"] == q} == set(range(1, 501))


def test_fused_rows_and_edges(spark):
    rows = [
        ("f", "a", 9.0, 1, "hybrid", {"dense": {"rank": 1.0, "score": 0.9}, "bm25": {"rank": 2.0, "score": 1.0}}, "", 0), ("f", "b", 8.0, 2, "hybrid", {"dense": {"rank": 2.0, "score": 0.8}, "bm25": {"rank": 1.0, "score": None}}, "", 0),
        ("same", "b", 1.0, 1, "dense", None, "", 0), ("same", "a", 1.0, 1, "dense", None, "", 0), ("inf", "a", float("inf"), 1, "dense", None, "", 0), ("inf", "b", float("-inf"), 1, "dense", None, "", 0),
    ]
    df = spark.createDataFrame(rows, RESULTS)
    assert {r["query_id"]: r["chunk_id"] for r in W.first_chunks(df).collect()} == {"f": "a", "same": "a", "inf": "a"}
    assert W.first_chunks(df.limit(0)).count() == 0


def vectors(n, seed=1, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    v = centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, dims))
    v[5:9] = v[4]  # copies
    v[20] = v[21] * 3 + 1e-3
    return v


def frame(spark, v, models=None):
    rows = [(f"i{k:04d}", (models or {}).get(k, "m"), [float(x) for x in r], "extra") for k, r in enumerate(v)]
    dims = v.shape[1]
    rows += [("z", "m", [0.0] * dims, ""), ("n", "m", [float("nan")] * dims, ""), ("s", "m", [1.0], ""), ("u", "m", None, ""), (None, "m", [1.0] * dims, ""), ("x", None, [1.0] * dims, ""), rows[0]]
    return spark.createDataFrame(rows, "id string, embedding_model string, embedding array<double>, vec string")


def brute(v, models, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in range(len(v)):
        s = sorted((-round(float(u[i] @ u[j]), 6), f"i{j:04d}") for j in range(len(v)) if j != i and models.get(i, "m") == models.get(j, "m"))
        out[f"i{i:04d}"] = s[:k]
    return out


def test_small_sets_are_exact(spark):
    v = vectors(150)
    models = {k: "other" for k in range(100, 150)}
    want = brute(v, models, 5)
    got = N.neighbours(frame(spark, v, models), 5, dims=16).collect()
    found = {}
    for r in got:
        found.setdefault(r["chunk"], set()).add(r["neighbour"])
    assert set(found) == set(want)
    assert np.mean([len(found[c] & {x for _, x in s}) / len(s) for c, s in want.items()]) > 0.98
    pairs = {(min(c, x), max(c, x)) for c, s in want.items() for d, x in s if -d >= 0.9}
    got = {(r["chunk_a"], r["chunk_b"]) for r in N.near_pairs(frame(spark, v, models), 5, 0.9, dims=16).collect()}
    assert got == pairs


@pytest.mark.parametrize("parts, rows", [(8, 100), (2, 30)])
def test_learned_parts_and_blocks(spark, monkeypatch, parts, rows):
    monkeypatch.setattr(N, "DATA_BLOCK", rows)
    monkeypatch.setattr(N, "QUERY_BLOCK", 2 * rows)
    v = vectors(1200)
    want = brute(v, {}, 5)
    found = {}
    for r in N.neighbours(frame(spark, v), 5, dims=16, part_rows=1200 // parts).collect():
        found.setdefault(r["chunk"], set()).add(r["neighbour"])
    assert np.mean([len(found.get(c, set()) & {x for _, x in s}) / len(s) for c, s in want.items()]) >= 0.9


def test_probes_are_chosen_outside_the_sample(spark, monkeypatch):
    seen = {}
    fit, homes = N.fit, N._true_homes
    monkeypatch.setattr(N, "fit", lambda v, *a: seen.update(fitted=v) or fit(v, *a))
    monkeypatch.setattr(N, "_true_homes", lambda distinct, asked, *a: seen.update(asked=asked) or homes(distinct, asked, *a))
    N.neighbours(frame(spark, vectors(1200)), 5, dims=16, part_rows=150)
    fitted = {x.tobytes() for x in seen["fitted"]}
    assert len(seen["asked"]) >= 100 and not any(x.tobytes() in fitted for x in seen["asked"])


def test_many_copies(spark):
    v = np.tile(vectors(30)[:1], (40, 1))
    got = N.neighbours(frame(spark, v), 3, 0.9, dims=16).collect()
    assert {r["chunk"] for r in got} == {f"i{k:04d}" for k in range(40)}
    assert all(r["similarity"] == 1.0 for r in got)
    near = {r["neighbour"] for r in got if r["chunk"] == "i0030"}
    assert near == {"i0000", "i0001", "i0002"}


def dense_cluster(spark, monkeypatch, n=200):
    """Scaled copies of a vector, jittered ones and others, in blocks; and their k nearest by brute force (SQL's rounding and ties)."""
    monkeypatch.setattr(N, "DATA_BLOCK", 100)
    monkeypatch.setattr(N, "QUERY_BLOCK", 150)
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    v = np.concatenate([one * rng.uniform(0.1, 10, (n, 1)), one + 0.004 * rng.normal(size=(n, 16)), one + 0.4 * rng.normal(size=(n, 16)), rng.normal(size=(n, 16))]).astype(np.float32).astype(float)
    ids = [f"i{x:04d}" for x in rng.permutation(len(v))]
    df = spark.createDataFrame([(i, "m", [float(x) for x in r]) for i, r in zip(ids, v)], "id string, embedding_model string, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    near = {a: sorted((-round(float(s[x, y]), 9), b) for y, b in enumerate(ids) if y != x) for x, a in enumerate(ids)}
    return df, near


def test_floor_in_a_dense_cluster(spark, monkeypatch):
    df, near = dense_cluster(spark, monkeypatch)
    want = {(min(a, b), max(a, b)) for a, own in near.items() for d, b in own[:10] if -d >= 0.9}
    assert {tuple(r) for r in N.near_pairs(df, 10, 0.9, dims=16).collect()} == want


def test_ranks_in_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_PARTS", 1)  # blocks are tested here, not routing
    df, near = dense_cluster(spark, monkeypatch, 100)
    got = {a: [] for a in near}
    for r in N.neighbours(df, 10, dims=16).orderBy("chunk", "rank").collect():
        got[r["chunk"]].append((r["neighbour"], round(r["similarity"], 9)))
    assert got == {a: [(b, -d) for d, b in own[:10]] for a, own in near.items()}


def test_no_vectors(spark):
    df = frame(spark, vectors(30)).where("id = 'z'")
    assert N.near_pairs(df, 3, 0.9, dims=16).count() == 0


def test_router_is_balanced():
    v = vectors(2000, dims=16)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    top = router.fit(v, 8, 10)
    assert top.parts == 8
    graph = router.neighbour_graph(v, 10)
    label = router.refine(graph, router.seeded(v, graph, 8, np.random.default_rng(0)), 8)
    start = router.seeded(v, graph, 8, np.random.default_rng(0))
    assert np.bincount(label, minlength=8).max() <= max(np.bincount(start).max(), 1.3 * 2000 / 8 + 1)
    r = router.Router(top, probes=3)
    assert (r.routes(v)[:, 0] == r.homes(v)).all() and r.routes(v).shape == (2000, 3)


def test_two_levels_route_like_their_probabilities():
    v = vectors(3000, dims=16).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    top = router.fit(v, 6, 10)
    home = router.Router(top).homes(v)
    r = router.Router(top, {c: router.fit(v[home == c], 4, 5) for c in range(5)}, probes=4)
    assert r.parts == sum(r.fine[c].parts for c in range(5)) + 1
    routes = r.routes(v)
    assert (routes[:, 0] == r.homes(v)).all() and all(len(set(x)) == 4 for x in routes.tolist())
    assert (r.depths(v, routes[:, 0]) == 1).all()
    for j in range(1, 4):
        assert (r.depths(v, routes[:, j]) >= 2).all()


def test_parts_grow_with_the_collection(spark):
    """More parts than one classifier tells apart: a second level, and still nine of ten neighbours."""
    v = vectors(2400)
    want = brute(v, {}, 5)
    distinct = N.checkpointed(N.classes(N.usable(frame(spark, v), 16), 6))
    r = N.fitted_router(distinct, 16, 5, None, 0.96, part_rows=60, wide=8)
    assert len(r.fine) >= 4 and r.parts > 20 and r.probes < r.parts
    found = {}
    for x in N.neighbours(frame(spark, v), 5, dims=16, part_rows=60, wide=8).collect():
        found.setdefault(x["chunk"], set()).add(x["neighbour"])
    assert np.mean([len(found.get(c, set()) & {x for _, x in s}) / len(s) for c, s in want.items()]) >= 0.9


def test_recall_on_real_chunks(spark):
    """Of 400 chunks at sf0.1, the share of their true neighbours that is found, and how many parts are probed for it."""
    chunks = spark.read.parquet("/root/testdata/sf0.1/chunks.parquet")
    vectors_ = N.usable(chunks, 64).dropDuplicates(["id"]).toPandas()
    u = N.units(vectors_["vec"], 64)
    ids, models = vectors_["id"].to_numpy(), vectors_["model"].to_numpy()
    asked = np.random.default_rng(3).choice(len(ids), 400, False)
    got = {}
    for r in N.neighbours(chunks, 10).where(F.col("chunk").isin(ids[asked].tolist())).collect():
        got.setdefault(r["chunk"], {})[r["neighbour"]] = r["similarity"]
    hits = every = 0
    place = {x: k for k, x in enumerate(ids)}
    for a in asked:
        s = np.where(models == models[a], u @ u[a], -2)
        s[a] = -2
        least = np.sort(s)[-10] - 1e-9
        hits += sum(s[place[x]] >= least for x in got[ids[a]])
        every += 10
        assert all(abs(s[place[x]] - c) < 1e-8 for x, c in got[ids[a]].items())
    assert hits / every >= 0.93
