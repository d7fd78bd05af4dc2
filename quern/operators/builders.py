"""Evaluation items of every question type from candidate passages: prompt, reply, evidence spans, checks.

One plan per type: the model is called in the tasks, its JSON reply is parsed to columns, numbered sentences become
exact evidence spans, and the checks of quern.functions.validators give the first reason to reject. A call
that fails, or a reply that is no object, is a rejection like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import validators as V
from quern.operators import dataset
from quern.operators.chunking import sentence_spans
from quern.operators.generation import Reply, json_text, offline, schema_prompt

SINGLE = ("simple_factual", "semantic", "keyword_heavy", "numerical", "ambiguous", "adversarial")
PAIRED = ("multi_hop", "comparison")
UNANSWERABLE = ("nonexistent_feature", "out_of_domain")
REPLY = "question string, answer string, sentence_ids array<int>, sentence_ids_b array<int>, specific string, subject_terms array<string>, statement string, term string"
TASK = {
    "simple_factual": "Ask for one fact of the passage.", "semantic": "Ask for one fact of the passage in words that the passage does not use.", "keyword_heavy": "Ask for one fact and name the identifier exactly.",
    "numerical": "Ask for one number of the passage.", "ambiguous": "Write a specific question, and the same without its subject.", "adversarial": "State one fact of the passage that holds a number.",
    "multi_hop": "Ask a question that needs both passages.", "comparison": "Ask how the subjects of both passages differ.", "nonexistent_feature": "Ask about the term as if it existed.", "out_of_domain": "Ask about the topic.",
}
SPANS = "array<struct<document_id:string,start_char:int,end_char:int,quote:string>>"


def _passage(title: str, section: str, text: str, start: str, end: str) -> Column:
    """The numbered sentences of [start, end) of a document's text."""

    @F.pandas_udf("array<string>")
    def sentences(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[t[x:y] for x, y in sentence_spans(t, p, q)] for t, p, q in zip(texts, a, b)], dtype=object)

    return T.numbered_passage(F.col(title), F.col(section), sentences(text, start, end))


def _evidence(document: str, text: str, start: str, end: str, ids: Column) -> Column:
    """Evidence of sentence numbers; null where a number is none of the passage's."""

    @F.pandas_udf(SPANS)
    def spans(documents: pd.Series, texts: pd.Series, a: pd.Series, b: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for d, t, p, q, n in zip(documents, texts, a, b, numbers):
            try:
                own = dataset.evidence_runs(sentence_spans(t, p, q), [int(x) for x in (n if n is not None else [])])
                out.append([{"document_id": d, "start_char": x, "end_char": y, "quote": t[x:y]} for x, y in own])
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return spans(document, text, start, end, ids)


def _ask(rows: DataFrame, kind: str, call: Callable[[str, str], Reply]) -> DataFrame:
    """``rows`` (candidate_id, prompt, ...) with the fields of the reply."""
    system = schema_prompt(TASK[kind], REPLY)

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = []
            for prompt in pdf["prompt"]:
                try:
                    replies.append(call(system, prompt).content)
                except Exception:
                    replies.append(None)
            yield pd.DataFrame({"candidate_id": pdf["candidate_id"], "reply": replies})

    made = rows.select("candidate_id", "prompt").mapInPandas(generate, "candidate_id string, reply string")
    made = made.select("candidate_id", F.from_json(json_text(F.col("reply")), REPLY).alias("r"))
    return rows.join(made, "candidate_id")


def build(candidates: DataFrame, kind: str, call: Callable[[str, str], Reply] = offline) -> DataFrame:
    """candidate_id, question_type, difficulty, question, answer, evidence, notes and reason (null for accepted items).

    Candidates: candidate_id, document_id, content (the document's text), title, section, start_char, end_char; for
    paired types the same of the other passage with the suffix _b; for keyword_heavy and unanswerable types term.
    """
    quote = lambda e: F.array_join(F.transform(e, lambda x: x["quote"]), " ")
    r = F.col("r")
    rows = candidates
    if kind in UNANSWERABLE:
        rows = _ask(rows.withColumn("prompt", F.concat(F.lit("Term: "), "term")), kind, call)
        question, answer, evidence = r["question"], F.lit("The sources do not say."), F.array().cast(SPANS)
        reason = F.coalesce(F.when(r.isNull(), "no_reply"), V.question(question), V.contains_term(question, F.col("term")))
        notes = F.create_map(F.lit("term"), F.col("term"))
        shown = "unanswerable"
    else:
        passage = _passage("title", "section", "content", "start_char", "end_char")
        if kind in PAIRED:
            passage = F.concat(F.lit("Passage A\n"), passage, F.lit("\n\nPassage B\n"), _passage("title_b", "section_b", "content_b", "start_char_b", "end_char_b"))
        extra = F.concat(F.lit("\n\nTerm: "), "term") if kind == "keyword_heavy" else F.lit("")
        rows = _ask(rows.withColumn("prompt", F.concat(passage, extra)), kind, call)
        rows = rows.withColumn("e", _evidence("document_id", "content", "start_char", "end_char", r["sentence_ids"]))
        if kind in PAIRED:
            rows = rows.withColumn("e_b", _evidence("document_id_b", "content_b", "start_char_b", "end_char_b", r["sentence_ids_b"]))
            evidence = F.concat("e", "e_b")
        else:
            evidence = F.col("e")
        quotes, question, answer = quote(evidence), r["question"], r["answer"]
        notes = F.create_map().cast("map<string,string>")
        checks = [F.when(r.isNull(), "no_reply"), F.when(evidence.isNull(), "invalid_sentence_ids")]
        if kind == "adversarial":
            rows = rows.withColumn("false", V.perturb_number(r["statement"], quote(F.col("e"))))
            question = F.concat(F.lit("Is it true that "), F.regexp_replace(F.col("false")["statement"], r"\.\s*$", ""), F.lit("?"))
            answer = F.concat(F.lit("No. "), r["statement"])
            notes = F.create_map(F.lit("original"), F.col("false")["original"], F.lit("replacement"), F.col("false")["replacement"])
            checks += [F.when(F.col("false")["statement"].isNull(), "nothing_to_perturb"), V.answer_supported(r["statement"], F.lit(""), quotes, 0.7)]
        else:
            checks += [V.question(question), V.answer(answer), V.self_contained(question), V.no_leakage(question, quotes), V.substantive_quote(quotes), V.answer_supported(answer, question, quotes)]
        if kind == "semantic":
            checks.append(V.paraphrase(question, quotes))
        elif kind == "keyword_heavy":
            checks.append(V.contains_term(question, F.col("term")))
        elif kind == "numerical":
            checks.append(V.numeric_answer(answer, quotes))
        elif kind == "ambiguous":
            checks.append(V.subject_removed(question, r["subject_terms"]))
            notes = F.create_map(F.lit("specific"), r["specific"])
        elif kind in PAIRED:
            checks.append(V.uses_both(answer, quote(F.col("e")), quote(F.col("e_b"))))
        reason, shown = F.coalesce(*checks), kind
    return rows.select("candidate_id", F.lit(shown).alias("question_type"), F.lit(dataset.DIFFICULTY[shown]).alias("difficulty"), question.alias("question"), answer.alias("answer"), evidence.alias("evidence"), notes.alias("notes"), reason.alias("reason"))


def accepted(built: DataFrame, quota: int | None = None, threshold: float = 0.8) -> DataFrame:
    """Items without a reason to reject; of near duplicates the one with the least id stays; at most ``quota`` if given."""
    good = built.where("reason is null").withColumn("id", T.question_id(F.col("question")))
    good = good.groupBy("id").agg(*[F.min_by(c, "candidate_id").alias(c) for c in ("candidate_id", "question_type", "difficulty", "question", "answer", "evidence", "notes")])
    twice = dataset.near_duplicates(good.select("id", "question"), threshold).select(F.greatest("a", "b").alias("id")).distinct()
    left = good.join(twice, "id", "left_anti")
    return left if quota is None else left.orderBy("candidate_id").limit(quota)


def rejections(built: DataFrame) -> DataFrame:
    """How many candidates each reason rejected, by type."""
    return dataset.rejections(built.where("reason is not null"))
