"""Exact vector search: every query against all rows by blocks of matrix products, best rows kept per block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "inner_product")
#: Queries that go to every task at once. More of them are cut into blocks of this size, and the rows into blocks of ROW_BLOCK.
QUERY_BLOCK, ROW_BLOCK = 20_000, 50_000


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Score of two array columns, in double precision: 1 - distance, -distance, or the inner product."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    if metric == "inner_product":
        return dot(a, b)
    if metric == "l2":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) ** 2), F.lit(0.0), lambda s, v: s + v))
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    s = q @ v.T
    if metric == "inner_product":
        return s
    qq, vv = (q * q).sum(1)[:, None], (v * v).sum(1)[None]
    if metric == "l2":
        return -np.sqrt(np.maximum(qq + vv - 2 * s, 0))
    with np.errstate(all="ignore"):
        return s / (np.sqrt(qq) * np.sqrt(vv))


def search(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", dims: int = 64) -> DataFrame:
    """query_id, chunk_id, score (6 decimals) and rank of the k best rows of ``chunks`` (chunk_id, embedding) for every query (query_id, embedding).

    Filters and the check for one embedding model are the caller's, on ``chunks``, where they reach the scan.
    Rows and queries without an embedding of ``dims`` numbers are in no result. Each task keeps k rows per
    query and batch before anything is shuffled.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    spark = chunks.sparkSession
    if k <= 0:
        return spark.createDataFrame([], schema + ", rank int")
    usable = F.size("embedding") == dims
    asked = queries.where(usable).select("query_id", "embedding")
    own = chunks.where(usable).select("chunk_id", "embedding")
    n = asked.count()

    def matched(ids: np.ndarray, q: np.ndarray, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The k best of some rows for some queries, and all that tie with the k-th, so that ties can be settled by id."""
        v = np.array(rows["embedding"].tolist(), float).reshape(-1, dims)
        names = rows["chunk_id"].to_numpy()
        for a in range(0, len(q) if len(v) else 0, 512):
            s = np.round(scores(q[a : a + 512], v, metric), 6)
            s[np.isnan(s)] = -np.inf
            kept = min(k, s.shape[1])
            least = -np.partition(-s, kept - 1, 1)[:, kept - 1]
            i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            yield pd.DataFrame({"query_id": ids[a + i], "chunk_id": names[j], "score": s[i, j]})

    if n <= QUERY_BLOCK:  # so few that every task can hold them: the rows are only scanned
        pdf = asked.toPandas()
        sent = spark.sparkContext.broadcast((pdf["query_id"].to_numpy(), np.array(pdf["embedding"].tolist(), float).reshape(-1, dims)))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                yield from matched(*sent.value, rows)

        out = own.mapInPandas(best, schema)
    else:  # both sides in blocks, every pair of blocks being a task; nothing passes through the driver
        of_q, of_d = -(-n // QUERY_BLOCK), max(1, -(-own.count() // ROW_BLOCK))
        left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(of_q))).withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_d - 1).cast("long"))))
        right = own.withColumn("db", F.pmod(F.xxhash64("chunk_id"), F.lit(of_d))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of_q - 1).cast("long"))))

        def tile(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            found = list(matched(q["query_id"].to_numpy(), np.array(q["embedding"].tolist(), float).reshape(-1, dims), rows))
            return pd.concat(found) if found else pd.DataFrame({"query_id": q["query_id"][:0], "chunk_id": rows["chunk_id"][:0], "score": pd.Series(dtype=float)})

        out = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInPandas(tile, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_MODELS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def embedder(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], dims: int, normalize: bool = True) -> Callable[[Column], Column]:
    """A model as a function of a text column, called once per Arrow batch.

    ``load`` is called once in each worker process, under ``name``. Vectors come out at unit length unless ``normalize`` is off; null
    texts give null, and vectors of another length than ``dims`` are an error.
    """

    def column(text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            if name not in _MODELS:
                _MODELS[name] = load()
            there = texts.notna().to_numpy()
            out = pd.Series([None] * len(texts), dtype=object)
            if there.any():
                v = np.asarray(_MODELS[name](texts[there].tolist()), np.float32)
                if v.shape != (there.sum(), dims):
                    raise ValueError(f"{name} gave vectors of shape {v.shape[1:]}, not {dims}")
                if normalize:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                out[np.flatnonzero(there)] = pd.Series(list(v), index=np.flatnonzero(there), dtype=object)
            return out

        return embed(text)

    return column


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of unit length.

    It has no knowledge of meaning and is for tests and offline runs only.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import re

        import xxhash

        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = xxhash.xxh3_64_intdigest(w)
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out, dtype=object)

    return embed(text)
