"""The queries of this subpackage, and the SQL that some of them can be compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import table

BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def settings(spark: SparkSession, folder: str) -> dict[str, float]:
    """run_settings, eight rows."""
    return {r["setting"]: r["amount"] for r in table(spark, folder, "run_settings").collect()}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.rank_walk import first_chunks

    return first_chunks(table(spark, folder, "retrieval_results"))


def p1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.rank_walk import rank_chunks

    return rank_chunks(table(spark, folder, "retrieval_results"))


def p1_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The stationary probabilities behind the ranking, to 7 digits."""
    from quern.llm.rank_walk import rank_chunks

    return rank_chunks(table(spark, folder, "retrieval_results")).select("query_id", "chunk_id", F.round("weight", 7).alias("weight"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.neighbours import near_pairs

    own = settings(spark, folder)
    return near_pairs(table(spark, folder, "chunks"), int(own["neighbours_k"]), own["neighbour_floor"])


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.neighbours import neighbours

    return neighbours(table(spark, folder, "chunks"), int(settings(spark, folder)["neighbours_k"]))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.defects import defects

    return defects(table(spark, folder, "eval_items"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.splitting import oversized

    own = settings(spark, folder)
    return oversized(table(spark, folder, "parent_chunks"), int(own["child_chunk_size"]), int(own["child_chunk_overlap"]))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.splitting import split_oversized

    own = settings(spark, folder)
    return split_oversized(table(spark, folder, "parent_chunks"), int(own["child_chunk_size"]), int(own["child_chunk_overlap"])).distinct()


def _said(pieces: Column, text: Callable[[Column], Column]) -> Column:
    """A hash of the text of pieces in order, each from where the one before it ended, blanks aside."""

    def new(p: Column, i: Column) -> Column:
        again = F.greatest(F.when(i == 0, 0).otherwise(F.get(pieces, i - 1)["end_char"]) - p["start_char"], F.lit(0))
        return F.substr(text(p), again + 1, F.greatest(p["end_char"] - p["start_char"] - again, F.lit(0)))

    return F.sha2(F.regexp_replace(F.array_join(F.transform(pieces, new), ""), BLANKS, ""), 256)


def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each oversized text hold together, and how many break the limit or share nothing with the piece before."""
    from quern.llm.splitting import split_oversized

    own = settings(spark, folder)
    limit, overlap = int(own["child_chunk_size"]), int(own["child_chunk_overlap"])
    cut = split_oversized(table(spark, folder, "parent_chunks").select("id", "text").distinct(), limit, overlap)
    listed = cut.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "token_count", "text"))).alias("p"))
    apart = F.size(F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i)["start_char"] >= F.get("p", i - 1)["end_char"]))
    return listed.select("parent_id", _said(F.col("p"), lambda x: x["text"]).alias("said"), F.size(F.filter("p", lambda x: x["token_count"] > limit)).alias("too_large"), apart.alias("apart"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.overlap import found

    return found(table(spark, folder, "eval_items"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.overlap import report

    return report(table(spark, folder, "eval_items"))


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """piece_id and text of all chunks and parent chunks."""
    both = [table(spark, folder, name).select(F.col("id").alias("piece_id"), "text") for name in ("chunks", "parent_chunks")]
    return both[0].unionByName(both[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.markup import markup_found

    return markup_found(pieces(spark, folder))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.markup import clean_pieces

    return clean_pieces(pieces(spark, folder)).distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.grouping import straddling_groups

    return straddling_groups(table(spark, folder, "eval_items"))


def p7_splits(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.grouping import SPLITS, dealt_splits

    own = settings(spark, folder)
    return dealt_splits(table(spark, folder, "eval_items"), {s: own[f"{s}_share"] for s in SPLITS})


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.grouping import item_groups

    return item_groups(table(spark, folder, "eval_items")).select("item_id", "group_id")


def p7_forest(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.grouping import item_forest

    return item_forest(table(spark, folder, "eval_items"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.encode import encode_corpus

    return encode_corpus(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of what the ids of each document decode to: its text."""
    from quern.llm.encode import encode_corpus, text_of

    return encode_corpus(table(spark, folder, "documents")).select("doc_id", F.sha2(text_of(F.col("ids")), 256).alias("hash"))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.packing import fill_containers, sized_documents

    capacity = int(settings(spark, folder)["container_tokens"])
    return fill_containers(sized_documents(table(spark, folder, "documents")), capacity)


def p9_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Documents placed, containers above their capacity, documents split though they fit, and documents with a gap between pieces."""
    capacity = int(settings(spark, folder)["container_tokens"])
    placed = p9_containers(spark, folder)
    load = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("too_full"))
    own = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.min("token_start").alias("first"), F.max("token_end").alias("last"))
    documents = own.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("split"), F.count_if((F.col("first") != 0) | (F.col("last") != F.col("n"))).alias("gaps"))
    return documents.join(load, F.lit(True)).select("documents", "too_full", "split", "gaps")


def p10_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What the sentences of each document hold together: all of it, blanks aside."""
    documents = table(spark, folder, "documents").select("doc_id", "text").where("text is not null").dropDuplicates(["doc_id"])
    spans = p10_sentences(spark, folder).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("s"))
    whole = F.col("text")
    return spans.join(documents, "doc_id").select("doc_id", _said(F.col("s"), lambda x: F.substr(whole, x["start_char"] + 1, x["end_char"] - x["start_char"])).alias("said"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.sentences import fitted, sentences

    documents = table(spark, folder, "documents")
    return sentences(documents.where(F.col("source_type").isin("txt", "pdf")), fitted(documents))


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    from quern.llm.sentences import sentences

    return sentences(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_ranking, p1_weights, p2_found, p2_neighbours, p3_found, p4_found, p4_pieces, p4_coverage, p5_found, p5_report, p6_found, p6_clean, p7_found, p7_splits, p7_groups, p7_forest, p8_ids, p8_decoded, p9_containers, p9_summary, p10_found, p10_sentences, p10_coverage)
}

ORACLE_SQL: dict[str, str] = {
    # Another way to let every list count equally: the mean normalised place. It picks the same chunk.
    "p1_found": """
        with own as (
            select query_id, chunk_id, retriever as list, score from retrieval_results where components is null and retriever <> 'hybrid'
            union all
            select query_id, chunk_id, e.key, map_extract(e.value, 'score')[1]
            from (select query_id, chunk_id, unnest(map_entries(components)) as e from retrieval_results where components is not null)),
        best as (select query_id, chunk_id, list, max(score) as score from own where score is not null and not isnan(score) group by all),
        placed as (
            select query_id, chunk_id, 1 - (rank() over l + count(*) over (partition by query_id, list, score) - 2.0) / count(*) over (partition by query_id, list) as place
            from best window l as (partition by query_id, list order by score desc)),
        summed as (select query_id, chunk_id, round(sum(place), 9) as s from placed group by all)
        select query_id, chunk_id from summed qualify row_number() over (partition by query_id order by s desc, chunk_id) = 1""",
    # The chain step by step over all pairs of a query's chunks.
    "p1_weights": """
        with recursive own as (
            select query_id, chunk_id, retriever as list, score from retrieval_results where components is null and retriever <> 'hybrid'
            union all
            select query_id, chunk_id, e.key, map_extract(e.value, 'score')[1]
            from (select query_id, chunk_id, unnest(map_entries(components)) as e from retrieval_results where components is not null)),
        best as (select query_id, chunk_id, list, max(score) as score from own where score is not null and not isnan(score) and query_id is not null and chunk_id is not null group by all),
        items as (select query_id, chunk_id, count(*) over (partition by query_id) as ni from (select distinct query_id, chunk_id from best)),
        lists as (select query_id, list, count(*) over (partition by query_id) as nl from (select distinct query_id, list from best)),
        jumps as (
            select i.query_id, i.chunk_id as a, t.chunk_id as b, 1.0::double / count(*) over (partition by i.query_id, i.chunk_id, l.list) / nl as p
            from items i join lists l using (query_id) left join best s on s.query_id = i.query_id and s.chunk_id = i.chunk_id and s.list = l.list
            join best t on t.query_id = i.query_id and t.list = l.list and (s.score is null or t.score >= s.score)),
        step as (select query_id, a, b, sum(p) as p from jumps group by all),
        walk(k, query_id, chunk_id, ni, x) as (
            select 0, query_id, chunk_id, ni, 1.0::double / ni from items
            union all
            select w.k + 1, s.query_id, s.b, w.ni, 0.15 / w.ni + 0.85 * sum(w.x * s.p) from walk w join step s on s.query_id = w.query_id and s.a = w.chunk_id where w.k < 110 group by w.k, s.query_id, s.b, w.ni)
        select query_id, chunk_id, round(x, 7) as weight from walk where k = 110""",
    "p2_found": """
        with own as (
            select distinct id, embedding_model as m, embedding::double[64] as v from chunks
            where len(embedding) = 64 and embedding_model is not null and len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs as (select a.id as a, b.id as b, array_cosine_similarity(a.v, b.v) as s from own a join own b on a.m = b.m and a.id <> b.id where array_cosine_similarity(a.v, b.v) >= 0.9),
        near as (select a, b from pairs qualify row_number() over (partition by a order by round(s, 9) desc, b) <= 10)
        select distinct least(a, b) as chunk_a, greatest(a, b) as chunk_b from near""",
    "p4_found": r"""
        with words as (
            select id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) as w from (select distinct id, text from parent_chunks)),
        parts as (
            select id, w, length(w) as n, regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') as p from words),
        costs as (
            select id, case when n = 1 then 1
                when regexp_matches(w, '\p{Nd}') and regexp_matches(w, '\p{L}') then 1 + (n - 1) // 2
                when len(p) > 1 then list_sum(list_transform(p, lambda x: 1 + (length(x) - 1) // 7))
                else 1 + (n - 1) // 7 end as c from parts)
        select id as parent_id from costs group by id having sum(c) > (select amount from run_settings where setting = 'child_chunk_size')""",
    "p4_coverage": r"""
        with own as (select distinct id, text from parent_chunks where text is not null),
        words as (select id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) as w from own),
        parts as (
            select id, w, length(w) as n, regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') as p from words),
        costs as (
            select id, case when n = 1 then 1
                when regexp_matches(w, '\p{Nd}') and regexp_matches(w, '\p{L}') then 1 + (n - 1) // 2
                when len(p) > 1 then list_sum(list_transform(p, lambda x: 1 + (length(x) - 1) // 7))
                else 1 + (n - 1) // 7 end as c from parts),
        large as (select id from costs group by id having sum(c) > (select amount from run_settings where setting = 'child_chunk_size'))
        select id as parent_id, sha256(regexp_replace(text, '%s', '', 'g')) as said, 0 as too_large, 0 as apart from own semi join large using (id)""" % BLANKS,
    "p8_decoded": "select doc_id, sha256(coalesce(text, '')) as hash from documents",
    "p9_summary": "select count(distinct doc_id) as documents, 0::bigint as too_full, 0::bigint as split, 0::bigint as gaps from documents",
    "p10_coverage": f"select doc_id, sha256(regexp_replace(any_value(text), '{BLANKS}', '', 'g')) as said from documents where text is not null and regexp_replace(text, '{BLANKS}', '', 'g') <> '' group by doc_id",
    "p7_groups": """
        with recursive named as (
            select distinct id, lower(trim(d)) as doc from (select id, unnest(relevant_document_ids) as d from eval_items) where trim(d) <> ''),
        links as (select distinct a.id as a, b.id as b from named a join named b using (doc)),
        reach(a, b) as (select id, id from (select distinct id from eval_items where id is not null) union select r.a, l.b from reach r join links l on r.b = l.a)
        select a as item_id, min(b) as group_id from reach group by a""",
    "p7_found": """
        with recursive named as (
            select distinct id, lower(trim(d)) as doc from (select id, unnest(relevant_document_ids) as d from eval_items) where trim(d) <> ''),
        links as (select distinct a.id as a, b.id as b from named a join named b using (doc)),
        reach(a, b) as (select id, id from (select distinct id from eval_items) union select r.a, l.b from reach r join links l on r.b = l.a),
        groups as (select a as item_id, min(b) as group_id from reach group by a),
        splits as (select distinct id as item_id, nullif(lower(trim(split)), '') as split from eval_items),
        mixed as (select group_id from groups join splits using (item_id) group by group_id having count(distinct split) > 1)
        select item_id, group_id from groups semi join mixed using (group_id)""",
}
