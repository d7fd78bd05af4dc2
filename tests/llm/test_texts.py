"""Problems 3, 4, 6, 8, 9 and 10 on fixtures, round trips and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.tokens import estimate
from quern.llm import defects, encode, markup, packing, sentences, splitting

tok = lambda: encode.tokenizer(encode.BYTE_BPE_50K)


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "don't you're 'tis ''s 'll 've'x 'r", "a  b \n\n c\t", "x" * 3000, "中文 кириллица ไทย 😀", "<|endoftext|>", "1234 5,6", "  lead", "trail  ", "\u00a0\u2003x", "'", "' s", "!'s", "it'S"]


def test_encoding_equals_the_library():
    t = reference()
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab'strevlmd  \n\t 中é１½!.’-🎉") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got = [x[0] for x in tok().encode_batch(texts)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoding_over_all_planes():
    """Letters that are newer than the library count for it as other characters."""
    t = reference()
    rng = random.Random(9)
    point = lambda: rng.choice((rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x3FFFF), 0x27, 0x20, 0x61))
    texts = ["".join(chr(point()) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += [f"a{chr(int(x, 16))}b {chr(int(x, 16))}1" for run in encode.NEWER for x in run.split("-")]
    assert [x[0] for x in tok().encode_batch(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=80), max_size=5))
def test_encoding_round_trip(texts):
    of = tok().bytes_of
    for text, (ids, starts, counts) in zip(texts, tok().encode_batch(texts)):
        assert b"".join(of[i] for i in ids).decode() == text
        assert sum(counts) == len(ids) and len(starts) == len(counts)
        assert all(text[a:b] for a, b in zip(starts, [*starts[1:], len(text)]))


def test_encoding_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    rows = encode.encode_corpus(df).withColumn("back", encode.text_of(F.col("ids"))).collect()
    assert {r["doc_id"]: r["back"] for r in rows} == {i: t or "" for i, t in enumerate([*TEXTS, None])}
    assert encode.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [10, 64, 100])
def test_best_fit_is_the_plain_rule(capacity):
    rng = np.random.default_rng(capacity)
    sizes = rng.integers(0, capacity + 1, 400)
    got = packing.best_fit_decreasing(sizes, capacity)
    room, want = [], np.empty(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        fits = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
        k = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(capacity)
        room[k] -= sizes[i]
        want[i] = k
    load = np.bincount(got, sizes)
    assert load.max() <= capacity and len(load) == len(room)
    assert sorted(load) == sorted(capacity - np.array(room))


def test_containers(spark):
    sizes = {0: 0, 1: 25, 2: 10, 3: 5, 4: 5, 5: None, 6: 20}
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()] + [(None, 3)], "doc_id long, n_tokens int")
    rows = packing.fill_containers(df.fillna(0, ["n_tokens"]), 10).collect()
    load, seen = {}, {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["token_end"]))
    assert max(load.values()) <= 10 and sum(load.values()) == 65 and len(load) == 7
    assert sorted(seen[1]) == [(0, 0, 10), (1, 10, 20), (2, 20, 25)] and len(seen[6]) == 2 and seen[0] == [(0, 0, 0)]
    assert packing.fill_containers(df.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        packing.fill_containers(df, 0)


@pytest.mark.parametrize("text", ["word " * 2000, "a" * 9000, "ab1" * 3000, "中文。" * 900, "First one. Second one! " * 300, "```\n" + "key: v\n" * 900 + "```", "- item one two\n" * 500, " \n" * 50 + "x " * 3000])
def test_pieces(text):
    got = splitting.pieces(text, 100, 20)
    assert len(got) > 1
    seen = set()
    for (a, b, n), nxt in zip(got, [*got[1:], None]):
        assert n == estimate(text[a:b]) <= 100
        seen.update(range(a, b))
        if nxt:
            assert nxt[0] > a and nxt[1] > b and estimate(text[nxt[0] : b]) <= 20
    assert all(i in seen or c.isspace() for i, c in enumerate(text))


@pytest.mark.parametrize("text", ["a" * 9000, "ab1" * 3000, "中文字符" * 900, "ระบบทำงานได้ดี" * 200, "中文。" * 900, "```\n" + "key: v\n" * 900 + "```", "word " * 2000, "First one goes on for a while, with commas, and more words than fit. " * 60])
def test_every_gap_is_shared(text):
    """Neighbouring pieces share up to the overlap, in scripts without blanks and in code too."""
    got = splitting.pieces(text, 100, 20)
    for (_, b, _), (c, _, _) in zip(got, got[1:]):
        assert c < b and 1 <= estimate(text[c:b]) <= 20


def test_pieces_of_small_and_null(spark):
    df = spark.createDataFrame([("a", "short", 1), ("b", None, 1), ("c", "word " * 300, 9), ("c", "word " * 300, 9), ("d", "", 0)], "id string, text string, ordinal int")
    assert [r["parent_id"] for r in splitting.oversized(df, 100, 20).collect()] == ["c"]
    rows = splitting.split_oversized(df, 100, 20).distinct().collect()
    assert all(r["text"] == ("word " * 300)[r["start_char"] : r["end_char"]] for r in rows)
    with pytest.raises(ValueError):
        splitting.split_oversized(df, 10, 10)


def test_valley_is_cut():
    a = "The buoy marks the channel for ships and boats. " * 8
    b = "Bread needs flour, yeast, salt and water in the bowl. " * 8
    got = splitting.pieces(a + b, 120, 0)
    assert any(abs(end - len(a)) <= 1 for _, end, _ in got)


MARKUP = [
    ("# Title\n\ntext", {"markdown"}), ("Title\n=====\n\ntext", {"markdown"}), ("a **bold** word", {"markdown"}), ("see [x](http://y)", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("> quoted", {"markdown"}),
    ("```\n<b>x</b> \\emph{y}\n```", {"markdown"}), ("<p>text</p>", {"html"}), ("a &nbsp; b", {"html"}), ("<!-- c --> x", {"html"}), ("note 3 -->\nx", {"html"}), ("so a --> b holds", set()), ("<pre>**x**</pre>", {"html"}), ("'''Bold''' is [[linked]]", {"wiki"}), ("== Head ==\n", {"wiki"}),
    ("{| class=x\n|-\n| a || b\n|}", {"wiki"}), ("{{term|x}}", {"wiki"}), ("\\section{A}\ntext", {"latex"}), ("\\begin{verbatim}\n# x\n\\end{verbatim}", {"latex"}), ("so $x_{1} \\le 3$ holds", {"latex"}), ("cited \\cite{a}", {"latex"}),
    ("Replace <berth-name> with it", set()), ("A List<Cargo> holds", set()), ("[[ -f x.lock ]] must succeed", set()), ("$HOME/x costs $5", set()), ("Use a * wildcard such as *.hl to match", set()), ("C:\\textures\\item\\x.cfg", set()),
    ("5 < 7 and 9 > 7, a == b", set()), ("the snake_case_name of x_y_z", set()), ("~/quay and _cache/ are", set()), ("<|endoftext|> is literal", set()), ("!!!!!! ------ ....", set()), ("", set()), (" \n", set()), ('{"a": 1}', set()),
]


@pytest.mark.parametrize("text, kinds", MARKUP)
def test_markup(text, kinds):
    clean, found = markup.convert(text)
    assert set(found) == kinds
    if not kinds:
        assert clean == text.strip()
    else:
        import re

        body = re.sub(r"\[(code|math)\].*?\[/\1\]", "", clean, flags=re.S)
        assert not markup.lexed(markup.Held(body))


def test_structure_is_kept():
    clean = lambda t: markup.convert(t)[0]
    assert clean("## A {#x}\n\n- one\n- two\n\n1. three") == "[h2] A\n\n• one\n• two\n\n(1) three"
    assert clean("<h2>A</h2><ul><li>x<li>y</ul><ol><li>z</ol>") == "[h2] A\n\n• x\n• y\n\n(1) z"
    assert clean("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>") == "a\tb\n1\t2"
    assert clean("```py\nx = 1\n```") == "[code]\nx = 1\n[/code]"
    assert "[math] x^{2} \\le 1 [/math]" in clean("so $x^{2} \\le 1$")
    assert clean("{| \n! f !! v\n|-\n| a || 1\n|}\n[[File:x.png|thumb|y]]\n[[a|b]]") == "f\tv\na\t1\nb"
    links = "<div>" + "".join(f'<a href="/{i}">menu entry {i}</a> ' for i in range(9)) + "</div>"
    assert clean(links + "<div><p>" + "Real text, with commas, goes on here. " * 8 + "</p></div>").startswith("Real text")
    assert markup.convert(None) == (None, [])


ARTICLE = "<p>" + "Real text, with commas, goes on here. " * 8 + "</p>"
MENU = "<ul>" + "".join(f'<li><a href="/{i}">menu entry {i}</a></li>' for i in range(9)) + "</ul>"


def test_only_the_article_is_kept():
    """Navigation in a wrapper before it and link lists in another after it go; its own heading, list, table and code stay."""
    inner = f"<h1>Title</h1>{ARTICLE}<ul><li>one point</li><li>another <a href='/x'>point</a></li></ul><table><tr><td>a</td><td>b</td></tr></table><pre>x = 1</pre>"
    page = f"<body><div class=top><div><nav>{MENU}</nav></div></div><div><div>{inner}</div><p>A short end.</p></div><div><div>{MENU}</div><footer>Legal <a href='/l'>notice</a> <a href='/p'>privacy</a></footer></div></body>"
    clean, kinds = markup.convert(page)
    assert kinds == ["html"] and "menu entry" not in clean and "privacy" not in clean
    for part in ("[h1] Title", "Real text", "• one point", "• another point", "a\tb", "[code]\nx = 1\n[/code]", "A short end."):
        assert part in clean
    assert "menu entry 3" in markup.convert(MENU)[0]  # nothing else to keep


def test_deep_nesting_and_all_languages_in_one_tree():
    assert markup.convert("<div>" * 5000 + "text" + "</div>" * 5000)[0] == "text"
    assert "deep" in markup.convert("{{a|" * 300 + "deep" + "}}" * 300)[0]
    text = "# Head\n\n<p>para</p>\n\n'''bold''' [[link|shown]]\n\n\\emph{word} and $x_{1} \\le 3$"
    root, nodes = markup.tree_of(text)
    assert {"markdown", "html", "wiki", "latex"} <= {n.language for n in nodes}
    clean, kinds = markup.convert(text)
    assert kinds == list(markup.KINDS) and clean.startswith("[h1] Head") and "bold shown" in clean and "word and [math] x_{1} \\le 3 [/math]" in clean


SENTENCES = [
    ("One. Two.", ["One.", "Two."]), ("See Dr. Smith vs. 3.5 others. Next.", ["See Dr. Smith vs. 3.5 others.", "Next."]), ("It takes 3 ms. The rest.", ["It takes 3 ms.", "The rest."]), ("Ms. Smith came. He left.", ["Ms. Smith came.", "He left."]), ("Cats, dogs, etc. We go.", ["Cats, dogs, etc.", "We go."]), ("He said “Stop. Now.” and left. Then.", ["He said “Stop. Now.” and left.", "Then."]),
    ("“Is it?” asks he. Yes.", ["“Is it?” asks he.", "Yes."]), ("It ends.\n\nno stop\n\nNew.", ["It ends.", "no stop", "New."]), ("hard\nwrapped line. More", ["hard\nwrapped line.", "More"]), ("(All is skipped.) Next.", ["(All is skipped.)", "Next."]),
    ("他来了。你好吗？“好。”然后走。", ["他来了。", "你好吗？", "“好。”然后走。"]), ("ระบบทำงาน 35 วินาที ห้ามแก้ไข", ["ระบบทำงาน 35 วินาที", "ห้ามแก้ไข"]), ("यह है। वह भी।", ["यह है।", "वह भी।"]), ("Nach z. B. 3 d. h. etwa 4. Dann.", ["Nach z. B. 3 d. h. etwa 4.", "Dann."]),
    ("tides.v2.toml is finished. v1.2.3 too.", ["tides.v2.toml is finished.", "v1.2.3 too."]), ("a task.Note that. Ok", ["a task.", "Note that.", "Ok"]), ("", []), (" \n\n ", []), ("?!", ["?!"]),
]


@pytest.mark.parametrize("text, parts", SENTENCES)
def test_sentences(text, parts):
    assert [text[a:b] for a, b in splitting.splitter().spans(text)] == parts


def test_held_out_boundaries(spark):
    """Paragraph ends that training never saw are found where the blank line is taken away."""
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["text", "source_type"])
    texts = docs[(docs.source_type != "markdown") & docs.text.notna()].text.tolist()
    model = sentences.train(texts[: len(texts) // 2])
    right = total = 0
    for t in texts[len(texts) // 2 :]:
        own = [t[a:b].strip() for a, b in sentences.blocks(t)]
        for x, y in zip(own, own[1:]):
            if x[-1:] in ".!?" and len(x) < 2000:
                total += 1
                right += any(b == len(x) for _, b in model.spans(f"{x} {y}"))
    assert total > 100 and right / total > 0.98


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "txt", "z"), (2, None, "txt", "z"), (3, "# H\n- a\n- b", "markdown", "z"), (4, "", None, "z")], "doc_id long, text string, source_type string, s string")
    got = sorted((r["doc_id"], r["start_char"], r["end_char"]) for r in sentences.sentences(df).collect())
    assert got == [(1, 0, 4), (1, 5, 9), (3, 0, 3), (3, 4, 7), (3, 8, 11)]
    assert sentences.sentences(df.limit(0)).count() == 0


def test_starters_do_not_depend_on_the_size(spark):
    """Two paragraphs that begin with a word are enough, however many other paragraphs there are."""
    own = spark.createDataFrame([("zcli starts it.",), ("Ok.\n\nzcli ends it.",), ("once is chance.",), (None,), ("",)], "text string").withColumn("doc_id", F.monotonically_increasing_id())
    others = spark.range(3000).select(F.repeat(F.lit("Ok.\n\n"), 1000).alias("text"), F.col("id").alias("doc_id"))
    few, many = sentences.starters_of(own), sentences.starters_of(own.unionByName(others))
    assert "zcli" in many and "once" not in many and "Ok" not in many
    assert set(few) == set(many) == {"zcli"}


def test_listed_words(spark):
    """Lookups in the file of words, in the driver and in the workers, equal those in a set."""
    rng = random.Random(5)
    some = {"".join(rng.choice("aàbяß中𝒶") for _ in range(rng.randint(1, 4))) for _ in range(600)}
    asked = [*some, "", "a" * 9, *(w + "a" for w in some), *(w[:-1] for w in some)]
    words = sentences.Words(sentences.shipped(spark.createDataFrame([(w,) for w in some], "w string"))) | frozenset(["more"])
    assert sorted(words) == sorted(some | {"more"}) and len(words) == len(some) + 1 and "more" in words
    assert [w in words for w in asked] == [w in some for w in asked]
    there = F.udf(lambda w: w in words, "boolean")
    assert {(r["w"], r["x"]) for r in spark.createDataFrame([(w,) for w in asked], "w string").select("w", there("w").alias("x")).collect()} == {(w, w in some) for w in asked}
    none = sentences.Words(sentences.shipped(spark.createDataFrame([], "w string")))
    assert "a" not in none and not list(none) and "a" in frozenset("a") | none


def test_starters_begin_sentences(spark):
    rows = [(n, "zcli starts it.", "txt") for n in range(2)] + [(2, "All is done. zcli runs now. It was e.g. here.", "txt")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source_type string")
    assert sorted((r["start_char"], r["end_char"]) for r in sentences.sentences(df).where("doc_id = 2").collect()) == [(0, 12), (13, 27), (28, 45)]


Q = "How does shoalShardLabel limit the traffic of the beacon?"
DEFECTS = [
    (None, "empty"), ("", "empty"), (" \u200b", "empty"), ("n/a", "empty"), ("—", "empty"), ("<answer>", "empty"), ("[]", "empty"), ("TBD", "empty"), ("Sorry, I can't help with that request.", "refusal"), ("I must decline to answer.", "refusal"),
    ("Je suis désolé, mais je ne peux pas vous aider.", "refusal"), ("Leider kann ich dabei nicht helfen.", "refusal"), ("No puedo ayudarte con eso.", "refusal"), (Q, "copied_question"), ("You want to know: " + Q.lower(), "copied_question"), (Q + " please", "copied_question"),
    ("Старый шлюз копирует значения.", "other_language"), ("El número de peticiones se limita a 3, y el componente rechaza las siguientes.", "other_language"), ("It caps requests (for all", "truncated"), ("It caps requests:\n\n```yaml\nkind: x", "truncated"), ("It caps requests “", "truncated"), ("It stops, spec:", "truncated"),
    ("Yes.", None), ("pilot agent", None), ("319 ms", None), ("`cargoLeaseScope`", None), ("hlctl get x_y_z --all", None), ("The harbormaster cannot change it on its own. It caps requests.", None), ("The log says „Fertig. Warte auf Leerung.“", None),
    (Q + " It caps the number of open requests at 3.", None), ("It caps requests.\n\n- hlctl get x_y_z\n- hlctl logs --follow", None),
]


PAIRS = [
    ("Hur begränsar systemet trafiken när det är fullt och vem får ändra det?", "Tyvärr kan jag inte svara på det.", "refusal"),
    ("Wie begrenzt das System den Verkehr, wenn es voll ist?", "Tyvärr kan jag inte hjälpa till med det.", "refusal"),
    ("Hur begränsar systemet trafiken när det är fullt och vem får ändra det?", "It caps the number of requests, and the rest of them wait in the queue.", "other_language"),
    ("Czy system zapisuje dane na dysku, kiedy jest pełny?", "Niestety nie mogę odpowiedzieć na to pytanie.", "refusal"),
    ("ระบบจำกัดจำนวนคำขออย่างไร", "The system caps them.", "other_language"),
    (Q, Q + " " + Q, "copied_question"), (Q, Q + " " + Q + " " + Q, "copied_question"), ("Limits?", "limits", "copied_question"), (Q, Q + " The beacon sheds half of them.", None),
    (Q, "The documentation says nothing about it. " * 6, "refusal"), (Q, "It caps requests.\n\n<ul><li>one<li>two", "truncated"), (Q, "It caps requests.\n\n<ul><li>one<li>two</ul>", None), (Q, "<p>It caps requests.", None), (Q, "\\begin{itemize}\n\\item It caps requests.", "truncated"),
]


@pytest.mark.parametrize("question, answer, defect", PAIRS)
def test_defects_by_grammar_and_structure(question, answer, defect):
    assert defects.judge(question, answer, "semantic")[0] == defect


@pytest.mark.parametrize("answer, defect", DEFECTS)
def test_defects_of_a_pair(answer, defect):
    assert defects.judge(Q, answer, "semantic")[0] == defect


def test_silence_is_an_answer_to_the_unanswerable():
    text = "The documentation does not state this."
    assert defects.judge(Q, text, "unanswerable")[0] is None and defects.judge(Q, text, "semantic")[0] == "refusal"


def test_truncation_by_context(spark):
    whole = "The buoy resets the value whenever the ship moves, so it is lost after a restart."
    rows = [(f"i{n}", Q, whole, "semantic", "x") for n in range(8)] + [("cut", Q, whole[:40], "semantic", "x"), ("mid", Q, whole[:-3], "semantic", "x"), ("stop", Q, whole[:-1], "semantic", "x"), ("none", Q, None, None, "x"), ("none", Q, None, None, "y"), (None, Q, None, "semantic", "x")]
    df = spark.createDataFrame(rows, "id string, question string, ground_truth_answer string, question_type string, defect string")
    assert {(r["item_id"], r["defect"]) for r in defects.defects(df).collect()} == {("cut", "truncated"), ("mid", "truncated"), ("none", "empty")}
    assert defects.defects(df.limit(0)).count() == 0
