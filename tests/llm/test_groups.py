"""Problems 5 and 7 against brute force, and the contract of the subpackage."""

import random

import numpy as np
import pytest

from quern.llm import grouping, overlap

ITEMS = "id string, question string, split string, relevant_document_ids array<string>, provenance struct<method:string,generator_model:string,prompt_version:string>, fixed string"


def components(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_spanning_forest(spark, shape):
    rng = random.Random(4)
    n = [f"n{i:03d}" for i in range(60)]
    edges = {"random": [tuple(rng.sample(n, 2)) for _ in range(45)], "chain": list(zip(n, n[1:])), "star": [(n[30], x) for x in n], "none": []}[shape]
    df = spark.createDataFrame(edges, "a string, b string")
    labels, forest = grouping.spanning_forest(df)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = components(edges, nodes)
    assert {r["node"]: r["root"] for r in labels.collect()} == want
    kept = [(r["a"], r["b"]) for r in forest.distinct().collect()]
    assert len(kept) == len(nodes) - len(set(want.values())) and components(kept, nodes) == want


def test_groups_and_splits(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        docs = [" Hub "] if i < 100 else [rng.choice("ABCDEFGHIJ") + str(rng.randint(0, 30))] if i < 250 else rng.choice([[], None, [None, " "]])
        rows.append((f"q{i:03d}", "x", rng.choice(["train", " Train", "dev", "TEST", None]), docs, None, "z"))
    rows += [("q000", "x", rows[0][2], ["hub", "b3"], None, "z"), (None, "x", "dev", ["hub"], None, "z")]
    df = spark.createDataFrame(rows, ITEMS)
    ids = {r[0] for r in rows if r[0]}
    by_doc = {}
    for r in rows:
        for x in r[3] or []:
            if r[0] and x and x.strip():
                by_doc.setdefault(x.strip().lower(), []).append(r[0])
    want = components([(own[0], o) for own in by_doc.values() for o in own], ids)
    got = {r["item_id"]: r["group_id"] for r in grouping.item_groups(df).collect()}
    assert got == want
    forest = [(r["a"], r["b"]) for r in grouping.item_forest(df).collect()]
    assert len(forest) == len(ids) - len(set(want.values())) and components(forest, ids) == want
    splits = {}
    for r in rows:
        if r[0] and r[2]:
            splits.setdefault(want[r[0]], set()).add(r[2].strip().lower())
    mixed = {i for i in ids if len(splits.get(want[i], ())) > 1}
    assert {r["item_id"] for r in grouping.straddling_groups(df).collect()} == mixed
    dealt = grouping.dealt_splits(df, {"train": 0.7, "dev": 0.12, "test": 0.18}).collect()
    assert len(dealt) == len(ids)
    for g in set(want.values()):
        assert len({r["split"] for r in dealt if want[r["item_id"]] == g}) == 1
    share = {s: sum(r["split"] == s for r in dealt) / len(dealt) for s in grouping.SPLITS}
    assert abs(share["train"] - 0.7) < 0.06 and abs(share["dev"] - 0.12) < 0.06
    assert grouping.straddling_groups(df.limit(0)).count() == 0


PAIRS = [
    ("After the drift watcher restarts, is shoal_rate_factor inherited by a copy of the pontoon when 7 berths are in use?", "Hi, After the drift watcher reboots, is shoal_rate_factor inherited by a copy of the pontoon when 7 berths are in use", True),
    ("Which command prints the current x_y_z of the buoy while the server is draining?", "While the server is draining, which command prints the current x_y_z of the buoy?", True),
    ("Who may change tug_slot_phase on the flotilla if no lease is held?", "Please tell me, Who may chagne tug_slot_phase on the foltilla if no lease is held", True),
    ("Where is keelTrimPath stored for the quay?", "where is keelTrimPath kept for the quay, thanks?", True),
    ("Where is keelTrimPath stored for the quay?", "Where is keelTrimPath stored for the beacon?", False),
    ("How long does it wait with 318 berths?", "How long does it wait with 325 berths?", False),
    ("Where is keelTrimPath stored for the quay?", "Who is allowed to change keelTrimPath on the quay?", False),
    ("Where is keelTrimPath stored for the quay?", "Where is keelTrimPhase stored for the quay?", False),
    ("For v1.2.3, where is a_b_c stored?", "For v1.2.4, where is a_b_c stored?", False),
]


@pytest.mark.parametrize("n", range(len(PAIRS)))
def test_same_question(spark, n):
    a, b, same = PAIRS[n]
    rows = [("a", a, " Train", None, ("m", None, None), "z"), ("b", b, "dev", None, ("m", None, None), "z"), ("c", b, "train", None, None, "z"), ("d", b, None, None, None, "z"), ("e", None, "test", None, None, "z"), ("b", b, "dev ", None, ("m", None, None), "z"), ("f", "  ", "dev", None, None, "z"), ("g", "  ", "train", None, None, "z")]
    # Other questions tell that an object follows "for the" and "of the".
    objects = "quay beacon buoy berth skiff jetty ballast hawser pontoon capstan lockgate tidebook flotilla keelset".split()
    rows += [(f"o{k}", f"Where is other_{k}_name stored for the {o}?", "train", None, None, "z") for k, o in enumerate(objects)]
    df = spark.createDataFrame(rows, ITEMS)
    want = {("b", "c")} | ({("a", "b")} if same else set())
    assert {(r["item_a"], r["item_b"]) for r in overlap.found(df).collect()} == want
    assert [(r["eval_split"], r["method"], r["pairs"]) for r in overlap.report(df).collect()] == [("dev", "m", len(want))]


def test_empty(spark):
    assert overlap.found(spark.createDataFrame([], ITEMS)).count() == 0


def jaccard(a, b):
    x, y = ({f"^{w}$"[i : i + 3] for w in t.split() for i in range(len(w))} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similarity_is_exact():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdé中") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    a, b = texts[:150], texts[150:]
    b[:20] = a[:20]
    assert np.allclose(overlap.similarities(a, b), [jaccard(x, y) for x, y in zip(a, b)])


def test_bands_keep_similar_sets():
    rng = random.Random(0)
    base = [f"word{i}" for i in range(16)]
    missed = 0
    for _ in range(200):
        a = rng.sample(base, 12)
        b = list(a)
        b[rng.randrange(12)] = "other"
        x, y = overlap.bands([" ".join(sorted(a)), " ".join(sorted(b))])
        missed += not set(x) & set(y)
    assert missed == 0


def test_report_counts_what_pairs_would(spark):
    """Against the expanded pairs, with copies on both sides, an item in two splits, and null methods."""
    rng = random.Random(2)
    rows = []
    for n in range(60):
        q = f"Where is name_{rng.randrange(6)}_x stored for the {rng.choice(['quay', 'quay please', 'quayy'])}?"
        rows.append((f"i{rng.randrange(45)}", q, rng.choice(["train", "dev", "test", " Dev"]), None, rng.choice([("m", None, None), ("n", None, None), None]), "z"))
    df = spark.createDataFrame(rows, ITEMS)
    method = {}
    for r in rows:
        method.setdefault(r[0], []).append(r[4][0] if r[4] else None)
    method = {k: min([m for m in v if m], default=None) for k, v in method.items()}
    pairs = {(r["train_id"], r["eval_id"], r["eval_split"]) for r in overlap.overlaps(df).collect()}
    want = {}
    for t, e, s in pairs:
        w = want.setdefault((s, method[e]), [0, set(), set()])
        w[0] += 1
        w[1].add(e)
        w[2].add(t)
    got = {(r["eval_split"], r["method"]): (r["pairs"], r["eval_items"], r["train_items"]) for r in overlap.report(df).collect()}
    assert got == {k: (n, len(a), len(b)) for k, (n, a, b) in want.items()}


def test_queries_run(spark, data):
    from quern.llm.queries import QUERIES

    for n in range(1, 11):
        assert any(name.startswith(f"p{n}_") for name in QUERIES)
    for name in ("p1_ranking", "p3_found", "p5_report", "p6_clean", "p9_containers", "p10_sentences"):
        assert QUERIES[name](spark, data).count() > 0
