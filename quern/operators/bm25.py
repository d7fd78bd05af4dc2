"""BM25 over any table of texts: an index is a stored table of term counts, a search joins query terms with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.analyzer import Analyzer
from quern.session import discard, spread, stored

#: Rows of a side that may be broadcast; a query term row is well under 100 bytes.
SMALL = 200_000


def small_side(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, which is cheap to count, with a broadcast hint if it is proven small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass(frozen=True)
class Index:
    """postings (term, chunk_id, dl, tf), where dl is the number of terms of the chunk; stats (n, avgdl), one row of all chunks.

    ``counts`` is the stored table that both are read from.
    """

    postings: DataFrame
    stats: DataFrame
    counts: DataFrame

    def weights(self, wanted: DataFrame | None = None) -> DataFrame:
        """(term, df, idf) of all terms, or of those in ``wanted`` (term)."""
        own = self.postings if wanted is None else self.postings.join(wanted, "term", "left_semi")
        df = own.groupBy("term").agg(F.count("*").alias("df"))
        return df.join(F.broadcast(self.stats), F.lit(True)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    @property
    def terms(self) -> DataFrame:
        return self.weights()


def build(chunks: DataFrame, text: Column, key: str = "id", analyzer: Analyzer = Analyzer()) -> Index:
    """Index (key, text); texts without terms count in N and in the average length.

    Rows of one key count once: repeated rows are divided out, and of different texts under one key the one with the
    least hash counts. Texts are analyzed in one pass; only terms and keys are shuffled, never texts.
    """
    own = spread(chunks.select(F.col(key).alias("chunk_id"), F.coalesce(text, F.lit("")).alias("text"))).where("chunk_id is not null")
    read = own.select("chunk_id", F.xxhash64("text").alias("of"), analyzer.terms(F.col("text")).alias("terms"))
    # A row without a term stands for the text itself.
    rows = read.select("chunk_id", "of", F.size("terms").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term"))
    counts = stored(rows.groupBy("term", "chunk_id", "of", "dl").agg(F.count("*").alias("n")))
    texts = counts.where("term is null").groupBy("chunk_id").agg(F.min(F.struct("of", "n", "dl")).alias("one"), F.count("*").alias("texts"))
    repeated = small_side(texts.where("texts > 1 or one.n > 1").select("chunk_id", F.col("one.of").alias("kept"), F.col("one.n").alias("rows")))
    postings = counts.where("term is not null").join(repeated, "chunk_id", "left").where("kept is null or of = kept")
    postings = postings.select("term", "chunk_id", "dl", (F.col("n") / F.coalesce("rows", F.lit(1))).cast("long").alias("tf"))
    stats = texts.agg(F.count("*").alias("n"), F.avg("one.dl").alias("avgdl")).select("n", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl"))
    return Index(postings, stats, counts)


def search(index: Index, queries: DataFrame, k: int, analyzer: Analyzer = Analyzer(), k1: float = 1.2, b: float = 0.75, keep: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score (6 decimals) and rank of the k best chunks of every query (query_id, query).

    Distinct query terms count once; chunks without a query term do not appear; blank queries and k <= 0 give
    nothing. ``keep`` (chunk_id) filters after scoring, so that the statistics stay those of the whole corpus.
    """
    if k <= 0:
        return queries.select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    # Queries with the same terms are one class, scored once.
    read = queries.where("trim(query) <> ''").select("query_id", F.array_sort(F.array_distinct(analyzer.terms(F.col("query")))).alias("terms")).where(F.size("terms") > 0)
    classes = read.select("terms").distinct().select(F.array_join("terms", " ").alias("class"), "terms")
    asked = classes.select("class", F.explode("terms").alias("term"))
    # Only the queries are counted. Where they are few, their terms go to the postings and nothing but hits is shuffled.
    few = asked.limit(SMALL + 1).count() <= SMALL
    hint = F.broadcast if few else (lambda df: df)
    weighted = asked.join(index.weights(hint(asked.select("term").distinct())).select("term", "idf"), "term")
    hits = index.postings.join(hint(weighted), "term").join(F.broadcast(index.stats), F.lit(True))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("class", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    if keep is not None:
        scored = scored.join(keep.select("chunk_id").distinct(), "chunk_id", "left_semi")
    best = top_k(scored, k, key="class")
    return read.select("query_id", F.array_join("terms", " ").alias("class")).join(best, "class").drop("class")


def top_k(scored: DataFrame, k: int, by: str = "score", key: str = "query_id") -> DataFrame:
    """The k best rows of every query (or other key) with their rank; ties go to the smaller chunk_id. Limited before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(by), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def signature(chunks: DataFrame) -> DataFrame:
    """What tells whether an index is stale: number of chunks and the latest creation."""
    return chunks.agg(F.count("id").alias("chunks"), F.max("created_at").alias("latest"))


class Registry:
    """Indexes by name and analyzer, rebuilt when the signature of their chunks has changed."""

    def __init__(self) -> None:
        self._kept: dict[tuple, tuple[tuple, Index]] = {}

    def get(self, name: str, chunks: DataFrame, text: Column, analyzer: Analyzer = Analyzer()) -> Index:
        now = tuple(signature(chunks).first())
        key = (name, analyzer.name)
        if key not in self._kept or self._kept[key][0] != now:
            old = self._kept.pop(key, None)
            self._kept[key] = (now, build(chunks, text, analyzer=analyzer))
            if old:
                discard(old[1].counts)
        return self._kept[key][1]
