"""Answers from sources: prompts, an offline model, citations, usage and cost, and JSON replies."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.tokens import estimate

SYSTEM = f"Answer from the numbered sources only. End every sentence with the number of its source, such as [1]. If the sources do not hold the answer, reply exactly: {T.ABSTENTION}"
REMINDER = "Cite a source number after every sentence."


@dataclass(frozen=True)
class Reply:
    content: str
    model: str
    input_tokens: int
    output_tokens: int
    latency_s: float = 0.0
    attempts: int = 1


class Retryable(RuntimeError):
    """A failure worth another attempt; ``after`` is the wait that the provider asks for."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


def offline(system: str, user: str) -> Reply:
    """A deterministic stand-in for a model: the first sentence of the first source, cited. Without sources it abstains."""
    head, _, rest = user.partition("[1] ")
    body = rest.split("\n", 1)[1].split("\n\n")[0].strip() if "\n" in rest else ""
    sentence = body.split(". ")[0].rstrip(".")
    content = f"{sentence}. [1]" if sentence else T.ABSTENTION
    return Reply(content, "offline", estimate(system) + estimate(user), estimate(content))


def with_retry(call: Callable[[str, str], Reply], retries: int, cap_s: float = 30.0, sleep: Callable[[float], None] = time.sleep, seed: int | None = None) -> Callable[[str, str], Reply]:
    """``call`` again on Retryable, after a random part of a doubling wait or what the provider asks for."""
    rng = random.Random(seed)

    def tried(system: str, user: str) -> Reply:
        for attempt in range(retries + 1):
            try:
                r = call(system, user)
                return Reply(r.content, r.model, r.input_tokens, r.output_tokens, r.latency_s, attempt + 1)
            except Retryable as e:
                if attempt == retries:
                    raise
                sleep(min(cap_s, e.after) if e.after is not None else rng.uniform(0, min(cap_s, 2.0**attempt)))
        raise AssertionError

    return tried


def sources(ranked: DataFrame) -> DataFrame:
    """query_id, contexts (array by rank) and the prompt's block of sources of ranked rows with title, section, page, text."""
    row = F.struct("rank", "chunk_id", "document_id", "title", "section", "page", "start_char", "end_char", T.source_block(F.col("rank"), F.col("title"), F.col("section"), F.col("document_id"), F.col("page"), F.col("text")).alias("block"))
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("contexts"))
    return listed.withColumn("sources", F.array_join(F.transform("contexts", lambda c: c["block"]), "\n\n"))


def answer(queries: DataFrame, ranked: DataFrame, call: Callable[[str, str], Reply] = offline, retries: int = 3) -> DataFrame:
    """One row per query (query_id, query): answer, abstained, model, tokens, attempts, latency, error and contexts.

    A query without results abstains and makes no call. Calls run in the tasks; a call that fails for good
    gives an error and no answer, and fails alone.
    """
    own = queries.select("query_id", "query").join(sources(ranked), "query_id", "left")
    asked = own.where("sources is not null").select("query_id", F.concat(F.lit("Sources:\n\n"), "sources", F.lit("\n\nQuestion: "), "query", F.lit(f"\n\n{REMINDER}")).alias("prompt"))
    key = queries.schema["query_id"].dataType.simpleString()

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tried = with_retry(call, retries)
        for pdf in batches:
            out = []
            for q, prompt in zip(pdf["query_id"], pdf["prompt"]):
                try:
                    r = tried(SYSTEM, prompt)
                    out.append((q, r.content, r.model, r.input_tokens, r.output_tokens, r.attempts, r.latency_s, None))
                except Exception as e:
                    out.append((q, None, None, 0, 0, retries + 1, 0.0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["query_id", "answer", "model", "input_tokens", "output_tokens", "attempts", "latency_s", "error"])

    made = asked.mapInPandas(generate, f"query_id {key}, answer string, model string, input_tokens int, output_tokens int, attempts int, latency_s double, error string")
    out = own.join(made, "query_id", "left")
    none = F.col("sources").isNull()
    return out.select("query_id", "query", F.when(none, F.lit(T.ABSTENTION)).otherwise(F.col("answer")).alias("answer"), (none | F.coalesce(T.is_abstention(F.col("answer")), F.lit(False))).alias("abstained"), "model", "input_tokens", "output_tokens", "attempts", "latency_s", "error", "contexts")


def citations(answers: DataFrame) -> DataFrame:
    """query_id, citations (contexts cited, in order of first mention) and invalid_citations of answers with contexts."""
    n = F.coalesce(F.size("contexts"), F.lit(0))
    own = answers.withColumn("cited", F.coalesce(T.cited_numbers(F.col("answer")), F.array().cast("array<int>")))
    valid = F.filter("cited", lambda i: (i >= 1) & (i <= n))
    return own.select("query_id", F.transform(valid, lambda i: F.struct(i.alias("number"), F.element_at("contexts", i).alias("context"))).alias("citations"), F.filter("cited", lambda i: (i < 1) | (i > n)).alias("invalid_citations"))


def cost(calls: DataFrame, pricing: DataFrame, local: tuple[str, ...] = ("offline",)) -> DataFrame:
    """``calls`` (model, input_tokens, output_tokens) with cost_usd: by price per million (model, price_in, price_out), 0 for local models, else null."""
    priced = calls.join(pricing, "model", "left")
    value = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1_000_000
    return priced.withColumn("cost_usd", F.when(F.col("price_in").isNotNull(), value).when(F.col("model").isin(*local), 0.0)).drop("price_in", "price_out")


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens, latency, cost and models without a price, of calls with their cost."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("llm_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bround(F.sum("latency_s"), 4).alias("llm_latency_s"),
        F.bround(F.sum(F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(38,12)")), 6).cast("double").alias("estimated_cost_usd"), F.array_sort(F.collect_set(F.when(F.col("cost_usd").isNull(), F.col("model")))).alias("unpriced_models"),
    )


def json_object(reply: str) -> dict:
    """The first JSON object in a reply, whether bare, fenced or within prose; ValueError if there is none."""
    decoder, text = json.JSONDecoder(), reply
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            found = None
        if isinstance(found, dict):
            return found
        at = text.find("{", at + 1)
    raise ValueError("no JSON object in the reply")


def json_text(replies: Column) -> Column:
    """json_object of a column as text, for from_json; null where there is none."""

    def one(r: str | None) -> str | None:
        try:
            return None if r is None else json.dumps(json_object(r), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return first(replies)


def structured(call: Callable[[str, str], Reply], check: Callable[[dict], str | None], repairs: int = 1) -> Callable[[str, str], tuple[dict, int]]:
    """Calls that must give a JSON object which ``check`` accepts; its complaint is sent back up to ``repairs`` times."""

    def ask(system: str, user: str) -> tuple[dict, int]:
        problem = ""
        for attempt in range(repairs + 1):
            prompt = f"{user}\n\nYour last reply was not usable: {problem}. Reply with one JSON object only." if problem else user
            try:
                found = json_object(call(system, prompt).content)
                problem = check(found) or ""
            except ValueError as e:
                problem = str(e)
            if not problem:
                return found, attempt + 1
        raise ValueError(problem)

    return ask


def schema_prompt(system: str, ddl: str) -> str:
    """A system prompt that asks for one JSON object of the given fields."""
    return f"{system}\n\nReply with a single JSON object and nothing else. Its fields are: {ddl}"


