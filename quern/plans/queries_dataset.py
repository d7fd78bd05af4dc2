"""Queries of dataset building, usage and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import bm25, dataset, generation, ingest
from quern.plans.catalogue import query
from quern.plans.queries_text import SQL_ESTIMATE, SQL_ITEMS, items, sql_content
from quern.plans.service import list_documents
from quern.session import table
from quern.sources import datasets


@query("select d.id, d.name, d.source, coalesce(c.n, 0) as chunks from (select * from documents order by source, id limit 100 offset 20) d left join (select document_id, count(distinct id) as n from chunks group by 1) c on c.document_id = d.id")
def listed_documents(spark, d):
    """One page of the listing: the limit is the feature."""
    return list_documents(table(spark, d, "documents"), table(spark, d, "chunks"), 100, 20)


@query("select d.id, count(distinct c.id) as chunks from documents d left join chunks c on c.document_id = d.id group by d.id")
def document_chunk_counts(spark, d):
    n = table(spark, d, "chunks").groupBy(F.col("document_id").alias("id")).agg(F.count_distinct("id").alias("chunks"))
    return table(spark, d, "documents").select("id").join(n, "id", "left").select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("select (select count(*) from documents) as documents, (select count(*) from parent_chunks) as parent_chunks, (select count(*) from chunks) as chunks, (select count(embedding) from chunks) as embedded")
def corpus_stats(spark, d):
    return ingest.corpus_stats(table(spark, d, "documents"), table(spark, d, "parent_chunks"), table(spark, d, "chunks"))


@query(
    rf"""with texts as (select distinct id, text from parent_chunks where text is not null and text <> ''), own as (select id as key, text from texts), {SQL_ESTIMATE.strip()}
        select id from texts join estimates on key = id where tokens >= 80 and (1 - coalesce(list_sum(list_transform(regexp_extract_all(text, '(?s)```.*?(?:```|\z)'), lambda x: length(x))), 0) / length(text)) >= 0.5
        and coalesce(list_sum(list_transform(regexp_extract_all(text, '<[^>]{{1,200}}>'), lambda x: length(x))), 0) / length(text) < 0.05"""
)
def eligible_pieces(spark, d):
    own = table(spark, d, "parent_chunks").select("id", "text").distinct()
    return dataset.eligible(own).select("id")


@query(r"with own as (select distinct id, text from chunks where text is not null) select id, regexp_matches(text, '\b[0-9]+(?:\.[0-9]+)?\s?(?:seconds?|minutes?|hours?|days?|ms|MiB|GiB|Mi|Gi|KiB|%|percent|bytes|nodes|pods|replicas|characters)\b') as numeric, regexp_matches(text, '`[A-Za-z-][A-Za-z0-9_.\-/=]{3,40}`') as identifier, regexp_matches(text, '\]\((/docs/[a-z0-9/_-]+?)/?(?:#[^)]*)?\)') as linked from own")
def chunk_pools(spark, d):
    return dataset.pools(table(spark, d, "chunks").select("id", "text").distinct().where("text is not null"))


@query("select c.id from (select distinct id from chunks) c where not exists (select 1 from (select unnest(relevant_chunk_ids) as id from eval_items) u where u.id = c.id)")
def unused_chunks(spark, d):
    return dataset.unused(table(spark, d, "chunks").select("id").distinct(), table(spark, d, "eval_items"))


@query("select document_id, count(*) as kept from (select distinct id, document_id from chunks) group by 1 having count(*) <= 3 union all select document_id, 3 from (select distinct id, document_id from chunks) group by 1 having count(*) > 3")
def capped_per_document(spark, d):
    own = table(spark, d, "chunks").select("id", "document_id").distinct()
    return dataset.per_document(own).groupBy("document_id").agg(F.count("*").alias("kept"))


@query("select t.term from (select title as term from glossary where title is not null union select 'no such term 0x1f') t where not exists (select 1 from documents where contains(lower(text), lower(t.term)))")
def absent_terms(spark, d):
    terms = table(spark, d, "glossary").where("title is not null").select(F.col("title").alias("term"))
    extra = spark.createDataFrame([("no such term 0x1f",)], "term string")
    return dataset.absent_terms(terms.unionByName(extra), table(spark, d, "documents"))


@query(
    f"""with own as (select id, list_sort({sql_content('question')}) as w from {SQL_ITEMS} where question is not null and id is not null),
        reps as (select w, min(id) as rep from own where len(w) > 0 group by w)
        select a.rep as a, b.rep as b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as similarity from reps a join reps b on a.rep < b.rep and len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(list_concat(a.w, b.w)))
        union all select rep, id, 1.0 from own join reps using (w) where id <> rep"""
)
def near_duplicate_questions(spark, d):
    """Pairs of representatives to the threshold, and each other member of a class of equal word sets with its representative."""
    return dataset.near_duplicates(items(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query("with s as (select distinct l_orderkey as key, l_linenumber as n from lineitem where l_quantity > 20) select key, min(n) as first, max(n) as last from (select key, n, n - row_number() over (partition by key order by n) as i from s) group by key, i")
def merged_runs(spark, d):
    """Runs of consecutive line numbers of orders: the joining of numbered sentences at scale."""
    return dataset.merged_runs(table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n")))


SQL_SEEDED = "sha256('0|' || id)"


@query(f"with i as (select id, any_value(question_type) as question_type from eval_items group by id), n as (select question_type, round_even(count(*) * 0.3, 0) as n_dev from i group by 1) select id, case when row_number() over (partition by question_type order by {SQL_SEEDED}, id) <= n_dev then 'dev' else 'test' end as split from i join n using (question_type)")
def stratified_splits(spark, d):
    own = items(spark, d).select("id", "question_type")
    return dataset.stratified_split(own, 0.3).select("id", "split")


@query(f"with i as (select id, any_value(question_type) as question_type, any_value(question) as question, any_value(ground_truth_answer) as ground_truth_answer, any_value(evidence) as evidence from eval_items group by id) select id, question_type, question, ground_truth_answer, coalesce(array_to_string(list_transform(evidence, lambda e: e.quote), ' || '), '') as evidence from i qualify row_number() over (partition by question_type order by {SQL_SEEDED}, id) <= 5")
def review_sheet(spark, d):
    """Five items per type: the sample is the feature."""
    return datasets.review_sample(items(spark, d), 5)


@query("with i as (select distinct id, question_type, lower(trim(split)) as split from eval_items) select question_type, split, count(*) as n from i group by grouping sets ((question_type), (split), ())")
def dataset_counts(spark, d):
    return dataset.counts(items(spark, d).withColumn("split", F.lower(F.trim("split"))))


@query(
    f"""with i as (select id, question_type, coalesce(len(evidence), 0) as n, evidence, relevant_document_ids as docs from eval_items qualify row_number() over (partition by id) = 1)
        select id, 'unanswerable with evidence' as reason from i where question_type = 'unanswerable' and n > 0
        union all select id, 'no evidence' from i where question_type <> 'unanswerable' and n = 0
        union all select id, 'quote does not fit its span' from i where len(list_filter(evidence, lambda e: length(e.quote) <> e.end_char - e.start_char)) > 0
        union all select id, 'bad evidence span' from i where len(list_filter(evidence, lambda e: e.start_char < 0 or e.end_char <= e.start_char)) > 0
        union all select id, 'evidence from an unlisted document' from i where n > 0 and len(list_filter(evidence, lambda e: not coalesce(list_contains(docs, e.document_id), false))) > 0"""
)
def item_violations(spark, d):
    return datasets.violations(items(spark, d))


PRICES = (("tidewriter-7b", 0.4, 1.2), ("mistral-quay-3b", 0.1, 0.3))


@query(
    """with calls as (select question_type, coalesce(provenance.generator_model, 'offline') as model, length(question) as i, length(ground_truth_answer) as o from (select * from eval_items qualify row_number() over (partition by id) = 1)),
        priced as (select *, case model when 'tidewriter-7b' then i * 4 + o * 12 when 'mistral-quay-3b' then i * 1 + o * 3 when 'offline' then 0 end as c from calls)
        select question_type, count(*) as llm_calls, sum(i) as input_tokens, sum(o) as output_tokens, (sum(coalesce(c, 0))::hugeint // 10 + case when sum(coalesce(c, 0))::hugeint % 10 > 5 or sum(coalesce(c, 0))::hugeint % 10 = 5 and sum(coalesce(c, 0))::hugeint // 10 % 2 = 1 then 1 else 0 end)::double / 1e6 as estimated_cost_usd, coalesce(array_to_string(list_sort(list_distinct(list(model) filter (where c is null))), ','), '') as unpriced from priced group by question_type"""
)
def usage_cost(spark, d):
    calls = items(spark, d).select("question_type", F.coalesce("provenance.generator_model", F.lit("offline")).alias("model"), F.length("question").alias("input_tokens"), F.length("ground_truth_answer").alias("output_tokens"), F.lit(0.0).alias("latency_s"))
    prices = F.broadcast(spark.createDataFrame(PRICES, "model string, price_in double, price_out double"))
    u = generation.usage(generation.cost(calls, prices), "question_type")
    return u.select("question_type", "llm_calls", "input_tokens", "output_tokens", "estimated_cost_usd", F.array_join("unpriced_models", ",").alias("unpriced"))


@query(
    f"""with own as (select row_number() over () as key, text, token_count from chunks where token_count > 0 and text is not null), {SQL_ESTIMATE.strip()},
        rated as (select token_count, round(coalesce(tokens, 0) / token_count, 4) as ratio from own left join estimates using (key)),
        listed as (select list_sort(list(ratio)) as r, count(*) as n, max(token_count) as largest, count(*) filter (where token_count > 360) as over_limit from rated)
        select n as chunks, """
    + ", ".join(f"(select round(r[floor(p)::int] * (1 - (p - floor(p))) + r[least(floor(p)::int + 1, n)] * (p - floor(p)), 4) from (select greatest(1, least(n, {q} * (n + 1))) as p)) as {name}" for q, name in ((0.05, "p5"), (0.5, "median"), (0.95, "p95")))
    + ", largest, over_limit from listed"
)
def token_audit(spark, d):
    return dataset.token_audit(table(spark, d, "chunks"), 360)


@query()
def offline_answers(spark, d):
    """Answers of the deterministic stand-in from the BM25 top 5 of every 20th document's name, with their citations."""
    from quern.plans.queries_retrieval import asked, indexed

    found = bm25.search(indexed(spark, d), asked(spark, d), 5)
    own = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "text", "section", "page", "start_char", "end_char").distinct()
    ranked = found.join(own, "chunk_id").withColumn("title", F.lit(None).cast("string"))
    answers = generation.answer(asked(spark, d), ranked)
    return answers.join(generation.citations(answers), "query_id").select("query_id", "answer", "abstained", "input_tokens", "output_tokens", F.size("citations").alias("citations"), F.size("invalid_citations").alias("invalid"))
