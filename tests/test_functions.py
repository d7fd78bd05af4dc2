"""Text functions, token estimate, analyzer and validators against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import validators as V
from quern.functions.analyzer import Analyzer
from quern.functions.markdown import Shortcodes, front_matter, sections
from quern.functions.tokens import estimate, token_estimate, word_cost


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["x"])
    return row.select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize("word, cost", [("pod", 1), ("a" * 22, 4), ("4dccb216c4adb", 7), ("PodDisruptionBudget", 4), ("réeaution", 2), ("_", 1), ("!", 1)])
def test_word_cost(word, cost):
    assert word_cost(word) == cost


def test_estimate_golden_and_column(spark):
    texts = ["kube-apiserver --v=2", "", "zero​width‍join", "コントローラーは207秒ごとに", "a\x1cb", "x_1y HTTPServer2 Éa", None]
    assert estimate(texts[0]) == 9
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_estimate(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r["n"] == (None if r["t"] is None else estimate(r["t"]))


def test_analyzer(spark):
    text = "The kube-apiserver and PodDisruptionBudget running v1.2"
    assert one(spark, Analyzer().terms(F.col("t")), t=text) == ["kube", "apiserver", "poddisruptionbudget", "running", "v1", "2", "kube-apiserver", "v1.2"]
    full = one(spark, Analyzer.of(compound=True, camel=True, stem=True).terms(F.col("t")), t=text)
    assert full == ["kube", "apiserver", "poddisruptionbudget", "runn", "v1", "2", "kube-apiserver", "v1.2", "pod", "disruption", "budget"]
    assert Analyzer().name == "words+compound"


@pytest.mark.parametrize("word, stem", [("policies", "policy"), ("requires", "requir"), ("required", "requir"), ("requiring", "requir"), ("bed", "bed"), ("uses", "uses"), ("nodes", "node"), ("ties", "ties")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem


def test_normalization(spark):
    raw = "a\r\nb \t\r\r\n\n\n\x00c \n"
    assert one(spark, T.normalize_plain(F.col("t")), t=raw) == "a\nb\n\nc"
    assert one(spark, T.normalize_markdown(F.col("t")), t="# T {#x}\n<!-- c\n -->\ntext  \n") == "# T\n\ntext\n"
    assert one(spark, T.normalize_markdown(F.col("t")), t=" \n") == ""


def test_shares_and_similarity(spark):
    assert one(spark, T.html_fraction(F.col("t")), t="<b>ab") == pytest.approx(3 / 5)
    assert one(spark, T.prose_fraction(F.col("t")), t="ab```cd```") == pytest.approx(2 / 10)
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, T.sigmoid(F.lit(-1000.0))) == 0.0
    assert one(spark, T.shingles(F.split(F.lit("a b c"), " "), 2)) == ["a b", "b c"]
    assert one(spark, T.shingles(F.split(F.lit("a"), " "), 2)) == []


def test_citations(spark):
    assert one(spark, T.cited_numbers(F.col("t")), t="x [1], y [3, 1][2] [a]") == [1, 3, 2]
    assert one(spark, T.is_abstention(F.col("t")), t="Sorry. I don’t know  based on the\nprovided sources.")
    assert one(spark, T.citation_label(F.lit(2), F.lit("T"), F.lit("S"), F.lit("d"), F.lit(4))) == "[2] T > S, page 4"
    assert one(spark, T.source_block(F.lit(1), F.lit(None).cast("string"), F.lit(""), F.lit("d"), F.lit(None).cast("int"), F.lit("x"))) == "[1] d\nx"


def test_urls(spark):
    url = lambda s: one(spark, T.page_url(F.col("s"), "https://h/docs/", "c/", "reference/glossary"), s=s)
    assert url("c/a/_index.md") == "https://h/docs/a/"
    assert url("c/reference/glossary/pod.md") == "https://h/docs/reference/glossary/?all=true#term-pod"
    assert one(spark, T.docs_version(F.lit('x\n latest = "v1.37"\n'))) == "1.37"


@pytest.mark.parametrize(
    "check, args, reason",
    [
        (V.question, ["What is the default of x?"], None), (V.question, ["What?"], "question_length"), (V.question, ["This has no mark at the end"], "question_not_a_question"),
        (V.question, ["Whatsoeverisit aaaa?"], "question_too_short"), (V.answer, ["..."], "answer_empty"), (V.answer, ["I don't know"], "answer_is_abstention"),
        (V.no_leakage, ["a b c d e f g h i?", "x a b c d e f g h y"], "question_copies_evidence"), (V.no_leakage, ["a b c d e f g", "a b c d e f g"], None),
        (V.paraphrase, ["which scheduler evicts pods", "the scheduler evicts pods"], "not_paraphrased"), (V.self_contained, ["What does the passage say?"], "not_self_contained"),
        (V.substantive_quote, ["See [x](y)"], "evidence_is_only_a_link"), (V.numeric_answer, ["3 nodes", "4 nodes"], "number_not_in_evidence"), (V.numeric_answer, ["none", "4"], "answer_has_no_number"),
        (V.contains_term, ["About Quays", "quay"], None), (V.answer_supported, ["alpha beta gamma", "delta", "other words"], "answer_not_supported_by_evidence"),
    ],
)
def test_validators(spark, check, args, reason):
    row = spark.createDataFrame([tuple(args)], [f"c{i}" for i in range(len(args))])
    assert row.select(check(*[F.col(f"c{i}") for i in range(len(args))]).alias("y")).first()["y"] == reason


PERTURBED = [
    ("waits 30 seconds", "30 s", ("waits 60 seconds", "30", "60")), ("has 1 node", "1 and 2", ("has 3 node", "1", "3")), ("takes 0.5 s", "0.5", ("takes 1 s", "0.5", "1")), ("v1.2 only", "1.2", None), ("30 or 4", "30 60 4", ("30 or 8", "4", "8")),
    ("x30 then 30, 30.", "30", ("x30 then 60, 30.", "30", "60")), ("1234.5678 m", "1234.5678", ("2469.14 m", "1234.5678", "2469.14")), ("2500000.5", "2500000.5", ("5e+06", "2500000.5", "5e+06")), ("100.0", "100.0", ("200", "100.0", "200")), ("é30", "30", None), (None, "30", None), ("30", None, None), ("", "", None),
]


def test_perturbed_numbers(spark):
    rows = spark.createDataFrame([(n, a, b) for n, (a, b, _) in enumerate(PERTURBED)], "n int, a string, b string")
    got = rows.select("n", V.perturb_number(F.col("a"), F.col("b")).alias("p")).orderBy("n").collect()
    assert [tuple(r["p"]) if r["p"]["statement"] is not None else None for r in got] == [want for *_, want in PERTURBED]


def test_front_matter_and_sections():
    assert front_matter("---\ntitle: T\n---\nbody") == ({"title": "T"}, "body")
    assert front_matter("---\n[x\n---\nbody") == ({}, "body")
    text = "intro\n\n# A\n\n```\n# no heading\n```\n\n## B ##\ntext\n# C#\n"
    own = sections(text)
    assert [s.label for s in own] == [None, "A", "A > B", "C#"]
    assert "".join(text[s.start : s.end] for s in own) == text


@pytest.mark.parametrize(
    "source, shown",
    [
        ('{{< glossary_tooltip text="pods" term_id="pod" >}}', "pods"), ('{{< glossary_tooltip term_id="pod" >}}', "Pod"), ('{{< glossary_tooltip term_id="x" >}}', "x"),
        ('{{< glossary_definition term_id="pod" length="short" prepend="So," >}}', "So, a v1.37 unit"), ("{{< skew currentVersion >}}", "1.37"), ("{{< skew currentVersionAddMinor -1 >}}", "1.36"),
        ("{{< skew currentPatchVersion >}}", "1.37.x"), ('{{< param "version" >}}', "v1.37"), ('{{< feature-state for_k8s_version="v1.29" state="stable" >}}', "FEATURE STATE: Kubernetes v1.29 [stable]"),
        ("{{< note >}}x{{< /note >}}", "Note:x"), ('{{% code_sample file="a.yaml" %}}', "(Example manifest: `a.yaml`)"), ("{{< mermaid >}}graph{{< /mermaid >}}z", "z"), ("{{< odd >}}kept{{< /odd >}}", "kept"),
        ('{{% heading "whatsnext" %}}', "What's next"), ('{{% heading "see-this" %}}', "See this"), ('{{< api-reference page="core/persistent-volume-v1" >}}', "PersistentVolume"), ('{{< figure alt="A" >}}', "Figure: A"),
    ],
)
def test_shortcodes(source, shown):
    rule = Shortcodes("v1.37", {"pod": ("Pod", 'A {{< param "version" >}} unit', "Full.")})
    assert rule(source) == shown
    assert rule.unknown == ({"odd"} if "odd" in source else set())
