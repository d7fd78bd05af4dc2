"""Text functions as column expressions: normalization, ids, shares, markup of answers, sentence splits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is dropped from words before comparing contents, and words that every question shares.
STOP = "a an the of to in on for and or is are was were be been by with as at from that this it its can do does how what which when why who you your if not no into than then there their they them these those will would should could about over under".split()
GENERIC = "kubernetes k8s cluster clusters use used using".split()
ABSTENTION = "I don't know based on the provided sources."


def normalize_plain(text: Column) -> Column:
    """Line feeds only, no NUL, no trailing blanks, single blank lines, trimmed."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, "\x00", "")
    t = F.regexp_replace(t, r"(?mdU)[^\S\n]+$", "")
    t = F.regexp_replace(t, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def normalize_markdown(text: Column) -> Column:
    """normalize_plain without comments and heading anchors, ending in one line feed unless empty."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?mdU)[^\S\n]+$", "")
    t = F.regexp_replace(t, r"(?m)^(#{1,6}[ \t]+.+?)[ \t]*\{#[^}\n]*\}[ \t]*$", "$1")
    t = F.regexp_replace(t, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def embedding_input(title: Column, section: Column, text: Column) -> Column:
    """``title > section``, a blank line and the text; missing parts are left out."""
    context = F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))
    return F.when(context == "", text).otherwise(F.concat(context, F.lit("\n\n"), text))


def document_id(source: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.trim(source), 256), 1, 16))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(text_hash: Column, chunker: str, model: str | None, include_context: bool) -> Column:
    """Changes whenever the stored pieces of a document could change."""
    return F.substring(F.sha2(F.concat(text_hash, F.lit(f"|{chunker}|{model or 'none'}|ctx={include_context}")), 256), 1, 24)


def question_id(question: Column) -> Column:
    return F.concat(F.lit("q_"), F.substring(F.sha1(question), 1, 10))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def stem(word: Column) -> Column:
    """One light suffix off: ies to y; or ing, ed, s; then a final e of what is longer than 4."""
    n = F.length(word)
    cut = (
        F.when((n > 6) & word.endswith("ing"), F.substring(word, 1, n - 3))
        .when((n > 5) & word.endswith("ed"), F.substring(word, 1, n - 2))
        .when((n > 4) & word.endswith("s"), F.substring(word, 1, n - 1))
        .otherwise(word)
    )
    bare = F.when((F.length(cut) > 4) & cut.endswith("e"), F.substring(cut, 1, F.length(cut) - 1)).otherwise(cut)
    return F.when((n > 5) & word.endswith("ies"), F.concat(F.substring(word, 1, n - 3), F.lit("y"))).otherwise(bare)


def content_words(text: Column) -> Column:
    """Distinct words that are no stop words and have 3 letters or are numbers."""
    return F.array_distinct(F.filter(words(text), lambda w: ~w.isin(*STOP) & ((F.length(w) > 2) | w.rlike(r"^\p{Nd}+$"))))


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(content_words(text), lambda w: ~w.isin(*GENERIC)), stem))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, each joined by blanks."""
    last = F.size(tokens) - n
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def html_fraction(text: Column) -> Column:
    """The share of characters within tags; 0 for empty."""
    tags = F.regexp_extract_all(text, F.lit(r"(<[^>]{1,200}>)"), 1)
    total = F.aggregate(tags, F.lit(0), lambda a, t: a + F.length(t))
    return F.when(F.length(text) == 0, 0.0).otherwise(total / F.length(text))


def prose_fraction(text: Column) -> Column:
    """The share of characters outside code fences; 0 for empty."""
    code = F.regexp_extract_all(text, F.lit(r"(?s)(```.*?(?:```|\z))"), 1)
    total = F.aggregate(code, F.lit(0), lambda a, t: a + F.length(t))
    return F.when(F.length(text) == 0, 0.0).otherwise(1 - total / F.length(text))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def cited_numbers(answer: Column) -> Column:
    """Numbers in ``[1]`` and ``[1, 3]``, in order of first appearance."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).cast("int")))))


def is_abstention(answer: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(answer), "’", "'"), r"(?U)\s+", " "))
    return F.contains(t, F.lit(ABSTENTION.lower().rstrip(".")))


def citation_header(title: Column, section: Column, fallback: Column) -> Column:
    where = F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")))
    return F.when(where == "", fallback).otherwise(where)


def citation_label(number: Column, title: Column, section: Column, document: Column, page: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), citation_header(title, section, document), F.coalesce(F.concat(F.lit(", page "), page.cast("string")), F.lit("")))


def source_block(number: Column, title: Column, section: Column, document: Column, page: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "), citation_header(title, section, document), F.coalesce(F.concat(F.lit(" (page "), page.cast("string"), F.lit(")")), F.lit("")))
    return F.concat(head, F.lit("\n"), text)


def numbered_passage(title: Column, section: Column, sentences: Column) -> Column:
    """``(title > section)`` and the sentences, each on a line behind its number."""
    lines = F.transform(sentences, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s))
    return F.concat(F.lit("("), citation_header(title, section, F.lit("")), F.lit(")\n"), F.array_join(lines, "\n"))


def split_sentences(text: Column) -> Column:
    """Plain prose only: cut after closing punctuation followed by white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def page_url(source: Column, site: str, prefix: str, glossary: str, front_matter_id: Column | None = None) -> Column:
    """Where a corpus file is published; glossary entries are anchors of one page."""
    rel = F.regexp_replace(F.regexp_replace(source, "^" + re.escape(prefix), ""), r"\.md$", "")
    term = F.element_at(F.split(rel, "/"), -1)
    if front_matter_id is not None:
        term = F.coalesce(front_matter_id, term)
    page = F.regexp_replace(F.regexp_replace(rel, "_index$", ""), "/+$", "")
    return F.when(rel.startswith(glossary + "/"), F.concat(F.lit(f"{site}{glossary}/?all=true#term-"), term)).otherwise(F.when(page == "", F.lit(site)).otherwise(F.concat(F.lit(site), page, F.lit("/"))))


def docs_version(config: Column) -> Column:
    """``X.Y`` of the line ``latest = "vX.Y"``; null where there is none."""
    return F.nullif(F.regexp_extract(config, r'(?m)^\s*latest\s*=\s*"v?(\d+\.\d+)"', 1), F.lit(""))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"`([A-Za-z-][\w.\-/=]{3,40})`"), 1)


def capitalized(text: Column) -> Column:
    """Words with a capital that do not begin the text or a sentence, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<=[a-z0-9,;:)] )([A-Z][A-Za-z]{2,})"), 1))


def doc_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\]\((/docs/[a-z0-9/_-]+?)/?(?:#[^)]*)?\)"), 1)


def has_numeric_fact(text: Column) -> Column:
    return text.rlike(r"\b\d+(?:\.\d+)?\s?(?:seconds?|minutes?|hours?|days?|ms|MiB|GiB|Mi|Gi|KiB|%|percent|bytes|nodes|pods|replicas|characters)\b")
