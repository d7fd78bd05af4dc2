"""Queries of retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import ann, bm25, dense, evaluation, fusion
from quern.plans.catalogue import query
from quern.plans.queries_text import SQL_ITEMS, SQL_TERMS, sql_content
from quern.session import checkpointed, table

# The searched texts: distinct chunks behind the section they stand in. The stated queries: names of every 20th document.
SQL_INDEX = f"""
    own as (select distinct id as chunk_id, document_id, case when coalesce(section, '') = '' then coalesce(text, '') else section || chr(10) || chr(10) || coalesce(text, '') end as text from chunks),
    counted as (select chunk_id, {SQL_TERMS} as t from own),
    lengths as (select chunk_id, len(t) as dl from counted),
    stats as (select count(*) as n, avg(dl) as avgdl from lengths),
    postings as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(t) as term from counted) group by all),
    terms as (select term, count(*) as df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from postings, stats group by term)"""
SQL_ASKED = f"asked as (select distinct doc_id as query_id, unnest({SQL_TERMS}) as term from (select doc_id, name as text from documents where doc_id % 20 = 0))"
SQL_SCORED = "scored as (select query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score from asked join terms using (term) join postings using (term) join lengths using (chunk_id), stats group by all)"


def indexed(spark, d) -> bm25.Index:
    chunks = table(spark, d, "chunks").select("id", "section", "text")
    return bm25.build(chunks, T.embedding_input(F.lit(None).cast("string"), F.col("section"), F.coalesce("text", F.lit(""))))


def asked(spark, d):
    return table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("name").alias("query"))


@query(f"with {SQL_INDEX} select term, df, round(idf, 6) as idf from terms")
def bm25_df_idf(spark, d):
    return indexed(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {SQL_INDEX}, {SQL_ASKED}, {SQL_SCORED} select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored qualify rank <= 10")
def bm25_topk(spark, d):
    return bm25.search(indexed(spark, d), asked(spark, d), 10)


@query(f"with {SQL_INDEX}, {SQL_ASKED}, {SQL_SCORED} select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored semi join (select id from chunks where map_extract(metadata, 'doc_category')[1] = 'concepts') c on c.id = scored.chunk_id qualify rank <= 10")
def bm25_filtered(spark, d):
    """Filtered after scoring: the statistics are those of all chunks."""
    keep = table(spark, d, "chunks").where(F.col("metadata")["doc_category"] == "concepts").select(F.col("id").alias("chunk_id"))
    return bm25.search(indexed(spark, d), asked(spark, d), 10, keep=keep)


@query("select count(id) as chunks, max(created_at) as latest from chunks")
def index_signature(spark, d):
    return bm25.signature(table(spark, d, "chunks"))


def _sql_dense(score: str, where: str = "true") -> str:
    return f"""with e as (select vec_id, label, embedding::double[] as v from embeddings where len(embedding) = 64)
        select q.vec_id as query_id, c.vec_id as chunk_id, round({score}, 6) as score, row_number() over (partition by q.vec_id order by round({score}, 6) desc, c.vec_id) as rank
        from e q, e c where q.vec_id % 20 = 0 and {where} qualify rank <= 10"""


COSINE = "list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v)))"


def _dense(spark, d, metric, where="true"):
    e = table(spark, d, "embeddings")
    chunks = e.where(where).select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(chunks, queries, 10, metric)


@query()
def dense_approximate(spark, d):
    """Top 10 of every 20th vector from the nearest cells of an inverted file; recall is tested against the exact search."""
    e = table(spark, d, "embeddings")
    index = ann.build(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), cell_rows=200)
    return ann.search(index, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, probes=max(1, len(index.centres) // 2))


@query(_sql_dense(COSINE))
def dense_cosine(spark, d):
    return _dense(spark, d, "cosine")


@query(_sql_dense("-list_distance(q.v, c.v)"))
def dense_l2(spark, d):
    return _dense(spark, d, "l2")


@query(_sql_dense("list_inner_product(q.v, c.v)"))
def dense_inner_product(spark, d):
    return _dense(spark, d, "inner_product")


@query(_sql_dense(COSINE, "c.label in (1, 3)"))
def dense_filtered(spark, d):
    return _dense(spark, d, "cosine", "label in (1, 3)")


SQL_LISTS = """lists as (select query_id, retriever, chunk_id, score, row_number() over (partition by query_id, retriever order by score desc, chunk_id) as rank from (
    select query_id, retriever, chunk_id, max(score) as score from retrieval_results where components is null and retriever in ('dense', 'bm25') and score is not null and not isnan(score) group by all))"""


def lists(spark, d, *retrievers):
    """Single lists of the log: one score per chunk, ranked anew."""
    from pyspark.sql import Window

    r = table(spark, d, "retrieval_results").where(F.col("components").isNull() & F.col("retriever").isin(*retrievers) & F.col("score").isNotNull() & ~F.isnan("score"))
    one = r.groupBy("query_id", "retriever", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "retriever").orderBy(F.desc("score"), "chunk_id")
    return one.withColumn("rank", F.row_number().over(w))


@query(f"with {SQL_LISTS} select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select query_id, chunk_id, round(sum(0.5 / (60 + rank)), 9) as score from lists group by all) qualify rank <= 10")
def rrf_fusion(spark, d):
    return fusion.rrf(lists(spark, d, "dense", "bm25"), 10, {"dense": 0.5, "bm25": 0.5}).drop("components")


SQL_LINEAR = """unit as (select *, case when max(score) over l > min(score) over l then (score - min(score) over l) / (max(score) over l - min(score) over l) else 1 end as u from lists window l as (partition by query_id, retriever)),
    fused as (select query_id, chunk_id, round(sum(0.5 * u), 9) as score from unit group by all),
    best as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused)"""


@query(f"with {SQL_LISTS}, {SQL_LINEAR} select * from best where rank <= 10")
def linear_fusion(spark, d):
    return fusion.linear(lists(spark, d, "dense", "bm25"), 10, {"dense": 0.5, "bm25": 0.5}).drop("components")


@query(f"""with {SQL_LISTS}, {SQL_LINEAR}, texts as (select distinct id as chunk_id, text from chunks), q as (select id as query_id, question from {SQL_ITEMS}),
    pairs as (select query_id, chunk_id, best.rank as former, {sql_content('question')} as w, {sql_content('text')} as c from best join texts using (chunk_id) join q using (query_id) where best.rank <= 20),
    s as (select query_id, chunk_id, former, round(case when len(w) > 0 then len(list_intersect(w, c)) / len(w) else 0 end, 6) as score from pairs)
    select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, former, chunk_id) as rank from s qualify rank <= 5""")
def reranked(spark, d):
    """The cascade: fused 20, scored by shared words, 5 left."""
    first = fusion.linear(lists(spark, d, "dense", "bm25"), 20, {"dense": 0.5, "bm25": 0.5})
    texts = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "text").distinct()
    questions = table(spark, d, "eval_items").groupBy(F.col("id").alias("query_id")).agg(F.first("question").alias("query"))
    return fusion.rerank(first.join(texts, "chunk_id").join(questions, "query_id"), 5).select("query_id", "chunk_id", "score", "rank")


SQL_SPANS = f"""spans as (select id as item_id, i - 1 as span, evidence[i].document_id as document_id, evidence[i].start_char as a, evidence[i].end_char as b
        from (select id, evidence, unnest(range(1, len(evidence) + 1)) as i from {SQL_ITEMS})),
    own as (select distinct id as chunk_id, document_id, start_char as x, end_char as y from chunks),
    labels as (select distinct item_id, span, chunk_id from spans join own using (document_id) where least(b, y) - greatest(a, x) > 0 and least(b, y) - greatest(a, x) >= 0.5 * (b - a))"""


def evidence(spark, d):
    items = table(spark, d, "eval_items").groupBy("id").agg(F.first("evidence").alias("evidence"))
    return evaluation.spans(items)


@query(f"with {SQL_SPANS} select * from labels")
def span_labels(spark, d):
    return evaluation.span_labels(evidence(spark, d), table(spark, d, "chunks"))


def run(spark, d, retriever):
    """Metrics of one retriever's logged lists."""
    found = lists(spark, d, retriever)
    documents = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "document_id").distinct()
    ranking = found.join(documents, "chunk_id").select(F.col("query_id").alias("item_id"), "chunk_id", "document_id", "rank")
    own = evidence(spark, d).join(found.select(F.col("query_id").alias("item_id")).distinct(), "item_id", "left_semi")
    return evaluation.ranking_metrics(ranking, evaluation.span_labels(own, table(spark, d, "chunks")), own, (5, 10))


def _sql_metrics(retriever: str) -> str:
    at = lambda k: f"""count(distinct span) filter (where r <= {k}) / any_value(n_spans)"""
    return f"""
    l_{retriever} as (select query_id as item_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
        select query_id, chunk_id, max(score) as score from retrieval_results where components is null and retriever = '{retriever}' and score is not null and not isnan(score) group by all)),
    s_{retriever} as (select * from spans where item_id in (select item_id from l_{retriever})),
    t_{retriever} as (select item_id, count(distinct span) as n_spans, count(distinct document_id) as n_docs from s_{retriever} group by all),
    h_{retriever} as (select item_id, l.rank from l_{retriever} l where l.rank <= 10 and exists (select 1 from labels b where b.item_id = l.item_id and b.chunk_id = l.chunk_id)),
    r_{retriever} as (select item_id, count(distinct chunk_id) as n_rel from labels group by all),
    e_{retriever} as (select item_id, count(*) filter (where r <= 5) as e5, count(*) filter (where r <= 10) as e10 from (select b.item_id, span, min(l.rank) as r from labels b join l_{retriever} l on l.item_id = b.item_id and l.chunk_id = b.chunk_id and l.rank <= 10 group by all) group by item_id),
    d_{retriever} as (select item_id, document_id, row_number() over (partition by item_id order by min(rank), document_id) as n from l_{retriever} join own using (chunk_id) group by item_id, document_id),
    g_{retriever} as (select s.item_id, count(distinct s.document_id) filter (where n <= 5) as d5, count(distinct s.document_id) filter (where n <= 10) as d10 from s_{retriever} s left join d_{retriever} d on d.item_id = s.item_id and d.document_id = s.document_id group by s.item_id),
    x_{retriever} as (select item_id, min(rank) as first, count(*) filter (where rank <= 5) as h5, count(*) as h10, sum(1 / log2(rank + 1)) filter (where rank <= 5) as g5, sum(1 / log2(rank + 1)) as g10 from h_{retriever} group by all),
    m_{retriever} as (select t.item_id, coalesce(1 / first, 0) as mrr,
        coalesce(e5, 0) / n_spans as "evidence_recall@5", coalesce(e10, 0) / n_spans as "evidence_recall@10", least(coalesce(h5, 0), 1)::double as "hit@5", least(coalesce(h10, 0), 1)::double as "hit@10",
        coalesce(h5, 0) / 5 as "precision@5", coalesce(h10, 0) / 10 as "precision@10", coalesce(coalesce(h5, 0) / n_rel, 0) as "recall@5", coalesce(coalesce(h10, 0) / n_rel, 0) as "recall@10",
        coalesce(coalesce(g5, 0) / list_sum(list_transform(range(1, least(n_rel, 5) + 1), lambda i: 1 / log2(i + 1))), 0) as "ndcg@5", coalesce(coalesce(g10, 0) / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))), 0) as "ndcg@10",
        d5 / n_docs as "doc_recall@5", d10 / n_docs as "doc_recall@10"
        from t_{retriever} t left join r_{retriever} using (item_id) left join e_{retriever} using (item_id) left join x_{retriever} using (item_id) left join g_{retriever} using (item_id))"""


NAMES = ("mrr", *(f"{m}@{k}" for k in (5, 10) for m in ("evidence_recall", "hit", "precision", "recall", "ndcg", "doc_recall")))
ROUNDED = ", ".join(f'round("{n}", 6) as "{n}"' for n in NAMES)


@query(f"with {SQL_SPANS}, {_sql_metrics('bm25')} select item_id, {ROUNDED} from m_bm25")
def retrieval_metrics(spark, d):
    return run(spark, d, "bm25").select("item_id", *[F.round(f"`{n}`", 6).alias(n) for n in NAMES])


@query(f"with {SQL_SPANS}, {_sql_metrics('bm25')}, q as (select id as item_id, any_value(question_type) as question_type from eval_items group by id) select question_type, count(*) as n, {', '.join(f'round_even(avg(\"{n}\"), 4) as \"{n}\"' for n in ('mrr', 'recall@10', 'ndcg@10'))} from m_bm25 join q using (item_id) group by grouping sets ((), (question_type))")
def metrics_by_type(spark, d):
    types = table(spark, d, "eval_items").groupBy(F.col("id").alias("item_id")).agg(F.first("question_type").alias("question_type"))
    return evaluation.metric_means(run(spark, d, "bm25"), types, ("mrr", "recall@10", "ndcg@10"))


COMPARED = ("evidence_recall@5", "evidence_recall@10", "mrr", "ndcg@10")


@query(
    f"with {SQL_SPANS}, {_sql_metrics('bm25')}, {_sql_metrics('dense')}, d as ("
    + " union all ".join(f"select '{m}' as metric, a.\"{m}\" as x, b.\"{m}\" as y from m_dense a join m_bm25 b using (item_id)" for m in COMPARED)
    + ") select metric, round_even(avg(x), 4) as a, round_even(avg(y), 4) as b, round_even(avg(y - x), 4) as diff_b_minus_a, count(*) filter (where round(y - x, 12) > 0) as b_better, count(*) filter (where round(y - x, 12) < 0) as a_better, count(*) filter (where round(y - x, 12) = 0) as tied from d group by metric"
)
def compared_runs(spark, d):
    a, b = paired(spark, d)
    common = a.select("item_id").distinct().join(b.select("item_id").distinct(), "item_id", "left_semi")
    return evaluation.compare(a.join(common, "item_id", "left_semi"), b.join(common, "item_id", "left_semi"))


def paired(spark, d):
    """Two runs in long form, each evaluated once."""
    return [checkpointed(evaluation.long_form(run(spark, d, r), COMPARED).withColumn("value", F.round("value", 12))) for r in ("dense", "bm25")]


@query()
def bootstrap_intervals(spark, d):
    return evaluation.bootstrap(evaluation.long_form(run(spark, d, "bm25"), evaluation.CI_METRICS))


@query()
def resampled_intervals(spark, d):
    """By the seeded resampling of one ordered list, for evaluation sets of bounded size."""
    return evaluation.bootstrap(evaluation.long_form(run(spark, d, "bm25"), evaluation.CI_METRICS), method="resample")


@query()
def paired_bootstrap(spark, d):
    a, b = paired(spark, d)
    diffs = a.alias("a").join(b.alias("b"), ["item_id", "metric"]).select("item_id", "metric", (F.col("b.value") - F.col("a.value")).alias("value"))
    return evaluation.bootstrap(diffs)


@query("with v as (select event_type, list_sort(list(value)) as v, avg(value) as m from events where value is not null group by all) select event_type, round(m, 6) as mean, v[len(v) // 2 + 1] as p50, v[greatest(floor(0.95 * len(v))::int - 1, 0) + 1] as p95, len(v) as n from v")
def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", "value")
