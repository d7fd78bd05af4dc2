"""Queries of the text functions, the chunker and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import validators as V
from quern.functions.analyzer import STOPWORDS, Analyzer
from quern.functions.tokens import token_estimate
from quern.operators import chunking, generation, ingest
from quern.plans.catalogue import query
from quern.session import spread, table

# Parts of SQL that several queries share.
SQL_STOP = "['" + "','".join(T.STOP) + "']"
SQL_GENERIC = "['" + "','".join(T.GENERIC) + "']"
SPACE = r"[\t\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sql_content(x: str) -> str:
    return f"list_distinct(list_filter({sql_words(x)}, lambda w: not list_contains({SQL_STOP}, w) and (length(w) > 2 or regexp_full_match(w, '[0-9]+'))))"


def sql_stem(w: str) -> str:
    cut = f"(case when length({w}) > 6 and {w} like '%ing' then left({w}, -3) when length({w}) > 5 and {w} like '%ed' then left({w}, -2) when length({w}) > 4 and {w} like '%s' then left({w}, -1) else {w} end)"
    return f"(case when length({w}) > 5 and {w} like '%ies' then left({w}, -3) || 'y' when length({cut}) > 4 and {cut} like '%e' then left({cut}, -1) else {cut} end)"


def sql_stems(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({sql_content(x)}, lambda w: not list_contains({SQL_GENERIC}, w)), lambda w: {sql_stem('w')}))"


SQL_ESTIMATE = r"""
    words as (select key, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) as w from own),
    parts as (select key, w, length(w) as n, regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') as p from words),
    costs as (select key, case when n = 1 then 1 when regexp_matches(w, '\p{Nd}') and regexp_matches(w, '\p{L}') then 1 + (n - 1) // 2
        when len(p) > 1 then list_sum(list_transform(p, lambda x: 1 + (length(x) - 1) // 7)) else 1 + (n - 1) // 7 end as c from parts),
    estimates as (select key, sum(c) as tokens from costs group by key)"""


@query(rf"with own as (select doc_id as key, text from documents where text is not null), {SQL_ESTIMATE.strip()} select doc_id, coalesce(tokens, 0)::int as tokens from documents left join estimates on key = doc_id where text is not null")
def token_estimates(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


SQL_TERMS = "list_concat(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: not list_contains(['" + "','".join(STOPWORDS) + "'], w)), list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-._/][A-Za-z0-9]+)+'), lambda w: lower(w)))"


@query(f"select doc_id, len({SQL_TERMS}) as terms, len(list_distinct({SQL_TERMS})) as distinct_terms from documents where text is not null")
def analyzed_documents(spark, d):
    terms = Analyzer().terms(F.col("text"))
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", terms.alias("t")).select("doc_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("distinct_terms"))


@query(f"with t as (select doc_id, unnest({SQL_TERMS}) as term from documents where text is not null) select term, count(distinct doc_id) as df, count(*) as cf from t group by term")
def term_frequencies(spark, d):
    terms = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(Analyzer().terms(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"with w as (select distinct unnest({sql_words('name')}) as word from documents) select word, {sql_stem('word')} as stem from w")
def stemmed_words(spark, d):
    return table(spark, d, "documents").select(F.explode(T.words(F.col("name"))).alias("word")).distinct().select("word", T.stem(F.col("word")).alias("stem"))


def _sql_plain(x: str) -> str:
    t = rf"regexp_replace(regexp_replace(replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(0), ''), '(?m){SPACE}+$', '', 'g'), '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({t}, '^(?:{SPACE}|\n)+|(?:{SPACE}|\n)+$', '', 'g')"


@query(f"select doc_id, sha256({_sql_plain('text')}) as hash, length({_sql_plain('text')}) as chars from documents where text is not null and source_type <> 'markdown'")
def normalized_texts(spark, d):
    t = T.normalize_plain(F.col("text"))
    return table(spark, d, "documents").where("text is not null and source_type <> 'markdown'").select("doc_id", F.sha2(t, 256).alias("hash"), F.length(t).alias("chars"))


@query("select doc_id, 'doc_' || left(sha256(trim(source)), 16) as source_id, sha256(text) as text_hash, left(sha256(sha256(text) || '|c1|m|ctx=True'), 24) as fingerprint, 'q_' || left(sha1(name), 10) as name_id from documents where text is not null")
def ids_and_hashes(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    h = T.content_hash(F.col("text"))
    return t.select("doc_id", T.document_id(F.col("source")).alias("source_id"), h.alias("text_hash"), T.fingerprint(h, "c1", "m", True).alias("fingerprint"), T.question_id(F.col("name")).alias("name_id"))


@query(
    "with own as (select distinct id, text from parent_chunks) select id, round(case when length(text) = 0 then 0 else coalesce(list_sum(list_transform(regexp_extract_all(text, '<[^>]{1,200}>'), lambda x: length(x))), 0) / length(text) end, 6) as html, "
    "round(case when length(text) = 0 then 0 else 1 - coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s)```.*?(?:```|\\z)'), lambda x: length(x))), 0) / length(text) end, 6) as prose from own"
)
def markup_shares(spark, d):
    t = table(spark, d, "parent_chunks").select("id", "text").distinct()
    return t.select("id", F.round(T.html_fraction(F.col("text")), 6).alias("html"), F.round(T.prose_fraction(F.col("text")), 6).alias("prose"))


@query(r"select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\x0c\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) as sentences from documents where text is not null and source_type = 'txt'")
def plain_sentences(spark, d):
    return table(spark, d, "documents").where("text is not null and source_type = 'txt'").select("doc_id", F.size(T.split_sentences(F.col("text"))).alias("sentences"))


@query()
def document_sentences(spark, d):
    """Sentences of all documents by the rules of the chunker, as spans."""
    return chunking.document_sentences(table(spark, d, "documents").select("id", "text"))


@query("with own as (select distinct id, document_id, section, text from chunks) select own.id, sha256(case when coalesce(nullif(d.name, ''), nullif(section, '')) is null then own.text else concat_ws(' > ', nullif(d.name, ''), nullif(section, '')) || chr(10) || chr(10) || own.text end) as hash from own join documents d on d.id = own.document_id where own.text is not null")
def embedding_inputs(spark, d):
    own = table(spark, d, "chunks").select("id", "document_id", "section", "text").distinct()
    names = table(spark, d, "documents").select(F.col("id").alias("document_id"), "name")
    return own.where("text is not null").join(names, "document_id").select("id", F.sha2(T.embedding_input(F.col("name"), F.col("section"), F.col("text")), 256).alias("hash"))


ANSWERS = [
    ("a1", "Pods restart [1]. Leases expire [2, 1] and [4].", 3), ("a2", "I don’t  know based on the provided sources.", 2), ("a3", "No citation here.", 1),
    ("a4", "Both [2][3], see [x] and [10].", 3), ("a5", "", 0), ("a6", "I DON'T KNOW BASED ON THE PROVIDED SOURCES", 1),
]
SQL_ANSWERS = "(select * from (values " + ", ".join("('{}', '{}', {})".format(a, b.replace("'", "''"), n) for a, b, n in ANSWERS) + ") as x(id, answer, sources) union all select id, any_value(ground_truth_answer), 3 from eval_items where id is not null and ground_truth_answer is not null group by id) as v"


@query(
    rf"""with cited as (select id, sources, i.pos, trim(i.n)::int as n from (select id, sources, unnest(list_transform(string_split(array_to_string(regexp_extract_all(answer, '\[([0-9]+(?:\s*,\s*[0-9]+)*)\]', 1), ','), ','), lambda x, k: {{'pos': k, 'n': x}})) as i
        from {SQL_ANSWERS}) where i.n <> ''), firsts as (select id, sources, n, min(pos) as pos from cited group by all),
        lists as (select id, list(n order by pos) filter (where n between 1 and sources) as valid, list(n order by pos) filter (where n not between 1 and sources) as invalid from firsts group by id)
        select v.id, coalesce(array_to_string(valid, ','), '') as valid, coalesce(array_to_string(invalid, ','), '') as invalid,
        contains(trim(regexp_replace(replace(lower(answer), '’', ''''), '\s+', ' ', 'g')), 'i don''t know based on the provided sources') as abstained from {SQL_ANSWERS} left join lists on lists.id = v.id"""
)
def parsed_citations(spark, d):
    """All ground truth answers, and some that cite."""
    own = table(spark, d, "eval_items").where("id is not null and ground_truth_answer is not null").groupBy("id").agg(F.min("ground_truth_answer").alias("answer")).withColumn("sources", F.lit(3))
    rows = own.unionByName(spark.createDataFrame(ANSWERS, "id string, answer string, sources int"))
    n = T.cited_numbers(F.col("answer"))
    good, bad = F.filter(n, lambda i: i.between(1, F.col("sources"))), F.filter(n, lambda i: ~i.between(1, F.col("sources")))
    return rows.select("id", F.array_join(good, ",").alias("valid"), F.array_join(bad, ",").alias("invalid"), T.is_abstention(F.col("answer")).alias("abstained"))


@query(
    """with r as (select distinct query_id, chunk_id, document_id, section, page, rank, start_char, end_char from retrieval_results where retriever = 'bm25' and components is null and rank between 1 and 5),
        one as (select query_id, chunk_id, min(document_id) as document_id, min(section) as section, min(page) as page, min(rank) as rank from r group by all),
        texts as (select id as chunk_id, min(text) as text from chunks group by id),
        ranked as (select *, row_number() over (partition by query_id order by rank, chunk_id) as n from one join texts using (chunk_id)),
        blocks as (select query_id, n, '[' || n || '] ' || coalesce(nullif(section, ''), document_id) || case when page is null then '' else ' (page ' || page || ')' end || chr(10) || text as block from ranked where text is not null)
        select query_id, sha256(string_agg(block, chr(10) || chr(10) order by n)) as hash, count(*) as sources from blocks group by query_id"""
)
def formatted_sources(spark, d):
    """The prompt's block of sources of every query, with the texts of its chunks."""
    from pyspark.sql import Window

    r = table(spark, d, "retrieval_results").where("retriever = 'bm25' and components is null and rank between 1 and 5")
    one = r.groupBy("query_id", "chunk_id").agg(F.min("document_id").alias("document_id"), F.min("section").alias("section"), F.min("page").alias("page"), F.min("rank").alias("rank"), F.min("start_char").alias("start_char"), F.min("end_char").alias("end_char"))
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    texts = table(spark, d, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("text").alias("text"))
    ranked = one.join(texts, "chunk_id").withColumns({"rank": F.row_number().over(w), "title": F.lit(None).cast("string")}).where("text is not null")
    return generation.sources(ranked).select("query_id", F.sha2("sources", 256).alias("hash"), F.size("contexts").alias("sources"))


@query()
def document_chunks(spark, d):
    """Children of all documents, cut anew."""
    docs = table(spark, d, "documents").select("id", "text", "source_type")
    return chunking.child_rows(chunking.chunk_documents(docs)).select("id", "document_id", "parent_id", "section", "start_char", "end_char", "token_count")


BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    rf"""with own as (select id, regexp_replace(coalesce(text, ''), '{BLANKS}', '', 'g') as said from documents)
        select id, sha256(said) as parents, sha256(said) as children, 0::bigint as outside, 0::bigint as too_large, 0::bigint as edge_blanks from own where said <> ''"""
)
def chunk_coverage(spark, d):
    """Of every document, what its parents and its children (less what a child repeats) hold together, blanks aside: all of it, in order. And how many pieces break a bound."""
    docs = table(spark, d, "documents").select("id", "text", "source_type")
    cut = chunking.chunk_documents(docs).toDF("id", "text", "ups", "downs")

    def said(pieces):
        """The text of pieces in order, each from where the last one ended."""
        def new(p, i):
            begin = F.greatest(F.when(i == 0, 0).otherwise(F.get(pieces, i - 1)["end_char"]), p["start_char"])
            return F.substr("text", begin + 1, F.greatest(p["end_char"] - begin, F.lit(0)))

        return F.sha2(F.regexp_replace(F.array_join(F.transform(pieces, new), ""), BLANKS, ""), 256)

    def count(pieces, bad):
        return F.size(F.filter(pieces, bad)).cast("long")

    slice_ = lambda p: F.substr("text", p["start_char"] + 1, p["end_char"] - p["start_char"])
    outside = count("downs", lambda c: ~F.exists("ups", lambda p: (p["ordinal"] == c["parent"]) & (c["start_char"] >= p["start_char"]) & (c["end_char"] <= p["end_char"])))
    large = count("downs", lambda c: (c["token_count"] > 360) | (token_estimate(slice_(c)) != c["token_count"])) + count("ups", lambda p: (p["token_count"] > 1600) | (token_estimate(slice_(p)) != p["token_count"]))
    edges = count("downs", lambda c: slice_(c).rlike(r"(?U)^\s|\s\z")) + count("ups", lambda p: slice_(p).rlike(r"(?U)^\s|\s\z"))
    return cut.where(F.size("ups") > 0).select("id", said(F.col("ups")).alias("parents"), said(F.col("downs")).alias("children"), outside.alias("outside"), large.alias("too_large"), edges.alias("edge_blanks"))


SQL_ITEMS = "(select id, any_value(question) as question, any_value(ground_truth_answer) as answer, any_value(evidence) as evidence from eval_items group by id)"


def items(spark, d):
    """Items, one row per id; repeated rows differ in load time only."""
    return table(spark, d, "eval_items").where("id is not null").dropDuplicates(["id"])


@query(rf"select id, case when length(trim(question, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) not between 15 and 300 then 'question_length' when not ends_with(trim(question, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '?') then 'question_not_a_question' when len({sql_words('question')}) < 4 then 'question_too_short' end as question_reason, case when len({sql_words('answer')}) < 1 then 'answer_empty' when contains(lower(answer), 'don''t know') or contains(lower(answer), 'not mentioned') then 'answer_is_abstention' end as answer_reason from {SQL_ITEMS}")
def checked_questions(spark, d):
    return items(spark, d).select("id", V.question(F.col("question")).alias("question_reason"), V.answer(F.col("ground_truth_answer")).alias("answer_reason"))


SQL_SHINGLES = "list_transform(range(1, len({0}) - 6), lambda i: array_to_string({0}[i:i+7], ' '))"


@query(
    f"""with own as (select id, question, answer, array_to_string(list_transform(evidence, lambda e: e.quote), ' ') as quotes from {SQL_ITEMS} where len(evidence) > 0 and question is not null and answer is not null),
        w as (select *, {sql_words('question')} as qw, {sql_words('quotes')} as ew, {sql_stems('question')} as qs, {sql_stems('quotes')} as es, {sql_stems('answer')} as s from own)
        select id, case when list_has_any({SQL_SHINGLES.format('qw')}, {SQL_SHINGLES.format('ew')}) then 'question_copies_evidence' end as leakage,
        case when len(qs) > 0 and len(list_intersect(qs, es)) / len(qs) > 0.4 then 'not_paraphrased' end as paraphrase,
        case when len(list_filter(s, lambda x: not list_contains(qs, x))) > 0 and len(list_intersect(list_filter(s, lambda x: not list_contains(qs, x)), es)) / len(list_filter(s, lambda x: not list_contains(qs, x))) < 0.5 then 'answer_not_supported_by_evidence' end as support from w"""
)
def evidence_checks(spark, d):
    own = items(spark, d).where(F.size("evidence") > 0).where("question is not null and ground_truth_answer is not null").withColumn("quotes", F.array_join(F.transform("evidence", lambda e: e["quote"]), " "))
    q, a, e = F.col("question"), F.col("ground_truth_answer"), F.col("quotes")
    return own.select("id", V.no_leakage(q, e).alias("leakage"), V.paraphrase(q, e).alias("paraphrase"), V.answer_supported(a, q, e).alias("support"))


@query(
    rf"""with own as (select * from {SQL_ITEMS} where question is not null and answer is not null)
        select id, case when regexp_matches(question, '(?i)\bpassages?\b|\b(the|this|that) (example|output|snippet|status message|above|following|text|document|section|command output|manifest)\b|\bin this case\b|\baccording to the\b') then 'not_self_contained' end as contained,
        case when len(regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?')) = 0 then 'answer_has_no_number' when not list_has_any(regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?'), regexp_extract_all(question, '[0-9]+(?:\.[0-9]+)?')) then 'number_not_in_evidence' end as numeric,
        case when not contains(lower(question), 'quay') then 'missing_required_term' end as term,
        case when contains(lower(question), 'buoy') or contains(lower(question), 'skiff') then 'ambiguous_question_names_subject' end as subject,
        case when regexp_matches(answer, '(?i)^\W*(see|refer to|read|learn more about)\b.*\]\(') then 'evidence_is_only_a_link' end as link from own"""
)
def wording_checks(spark, d):
    own = items(spark, d).where("question is not null and ground_truth_answer is not null")
    q, a = F.col("question"), F.col("ground_truth_answer")
    return own.select("id", V.self_contained(q).alias("contained"), V.numeric_answer(a, q).alias("numeric"), V.contains_term(q, F.lit("quay")).alias("term"), V.subject_removed(q, F.array(F.lit("buoy"), F.lit("skiff"))).alias("subject"), V.substantive_quote(a).alias("link"))


@query(
    f"""with own as (select id, answer, evidence[1].quote as qa, evidence[2].quote as qb from {SQL_ITEMS} where len(evidence) > 1 and answer is not null),
        s as (select id, {sql_stems('answer')} as s, {sql_stems('qa')} as a, {sql_stems('qb')} as b from own)
        select id, case when len(list_intersect(s, list_filter(a, lambda x: not list_contains(b, x)))) < 2 or len(list_intersect(s, list_filter(b, lambda x: not list_contains(a, x)))) < 2 then 'answer_does_not_use_both_sources' end as both_used from s"""
)
def both_sources_used(spark, d):
    own = items(spark, d).where(F.size("evidence") > 1).where("ground_truth_answer is not null")
    return own.select("id", V.uses_both(F.col("ground_truth_answer"), F.col("evidence")[0]["quote"], F.col("evidence")[1]["quote"]).alias("both_used"))


@query(
    rf"""with own as (select id, answer, regexp_extract_all(answer, '[\p{{L}}\p{{M}}\p{{N}}_.]+|[^\p{{L}}\p{{M}}\p{{N}}_.]+') as runs, regexp_extract_all(question, '[\p{{L}}\p{{M}}\p{{N}}_.]+') as known from {SQL_ITEMS} where question is not null and answer is not null),
        old as (select *, list_filter(runs, lambda r: regexp_full_match(r, '[0-9]+([.][0-9]+)?') and list_contains(known, r)) as shared from own),
        changes as (select *, list_transform(shared, lambda r: {{'o': r, 'n': case when contains(r, '.') then format('{{:g}}', case when r::double in (0, 1) then r::double + 2 else r::double * 2 end) else (case when r::hugeint in (0, 1) then r::hugeint + 2 else r::hugeint * 2 end)::varchar end}}) as c from old),
        first as (select *, list_filter(c, lambda x: not list_contains(known, x.n))[1] as x from changes)
        select id, case when x is not null then array_to_string(runs[:list_position(runs, x.o) - 1] || [x.n] || runs[list_position(runs, x.o) + 1:], '') end as statement, x.o as original, x.n as replacement from first"""
)
def perturbed_numbers(spark, d):
    own = items(spark, d).where("question is not null and ground_truth_answer is not null")
    return own.select("id", V.perturb_number(F.col("ground_truth_answer"), F.col("question")).alias("p")).select("id", "p.*")


@query(
    """select case when former is null then 'created' when former = now then 'unchanged' else 'updated' end as status, count(*) as files, sum(chars) as chars from (
        select sha256(coalesce(text, '')) as now, length(text) as chars, case when updated_at > created_at + interval 7 day then sha256(left(coalesce(text, ''), 10)) when updated_at is not null then sha256(coalesce(text, '')) end as former from documents) group by 1"""
)
def changed_documents(spark, d):
    """Documents against an older state, in which those updated more than a week after creation were shorter."""
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    late = F.col("updated_at") > F.col("created_at") + F.expr("interval 7 days")
    stored = docs.where("updated_at is not null").select("id", F.sha2(F.when(late, F.substring("text", 1, 10)).otherwise(F.col("text")), 256).alias("fingerprint"))
    now = table(spark, d, "documents").select(F.col("id").alias("document_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), F.length("text").alias("chars"))
    return ingest.changes(now, stored).groupBy("status").agg(F.count("*").alias("files"), F.sum("chars").alias("chars"))
