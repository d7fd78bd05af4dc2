"""Approximate vector search: an inverted file. Rows lie in cells around centres; a query reads a few cells and ranks their rows exactly.

The centres are fitted on a bounded sample; every row is in the index. Cells are in proportion to the rows, and the
cells a query reads are its nearest ones. Filters apply within the cells, before anything is cut, so a filtered search
still gives k rows where the cells hold them; ``probes`` equal to the number of cells makes the search exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.dense import METRICS, scores
from quern.session import stored

#: Rows of a cell, rows per cell that centres are fitted on, and cells at most: the sample has at most their product.
CELL_ROWS, FIT_ROWS, MOST_CELLS = 2_000, 64, 4_096
#: Queries of one cell that one task answers.
CELL_QUERIES = 20_000


@dataclass(frozen=True)
class Index:
    """rows (cell, chunk_id, embedding), stored by cell, and the centres."""

    rows: DataFrame
    centres: np.ndarray
    metric: str
    dims: int


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(-1, dims)


def _near(v: np.ndarray, centres: np.ndarray, metric: str, n: int) -> np.ndarray:
    """The n cells of each vector that are best by the metric, best first."""
    s = scores(v, centres, metric)
    s[np.isnan(s)] = -np.inf
    return np.argsort(-s, 1, kind="stable")[:, :n]


def centres_of(v: np.ndarray, cells: int, spherical: bool, sweeps: int = 12, seed: int = 5) -> np.ndarray:
    """Means of ``cells`` clusters of a sample; an empty cluster takes a row of the largest one."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), cells, False)]
    for _ in range(sweeps):
        label = _near(v, c, "cosine" if spherical else "l2", 1)[:, 0]
        n = np.bincount(label, minlength=cells)
        sums = np.zeros_like(c)
        np.add.at(sums, label, v)
        c = sums / np.maximum(1, n)[:, None]
        for empty in np.flatnonzero(n == 0):
            c[empty] = v[rng.choice(np.flatnonzero(label == n.argmax()))]
    return c


def build(chunks: DataFrame, metric: str = "cosine", dims: int = 64, cell_rows: int = CELL_ROWS) -> Index:
    """An index of chunks (chunk_id, embedding); rows without an embedding of ``dims`` numbers are left out."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    own = chunks.where(F.size("embedding") == dims).select("chunk_id", "embedding")
    n = own.count()
    cells = max(1, min(MOST_CELLS, round(n / cell_rows)))
    h = F.xxhash64("chunk_id", F.lit("sample"))
    wanted = FIT_ROWS * cells
    few = own.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(min(1.0, (2 * wanted + 100) / max(1, n)) * (1 << 30)))).orderBy(h, "chunk_id").limit(wanted).select("embedding").toPandas()
    v = _matrix(few["embedding"], dims)
    spherical = metric != "l2"
    if spherical:
        with np.errstate(all="ignore"):
            v = np.nan_to_num(v / np.linalg.norm(v, axis=1, keepdims=True))
    centres = centres_of(v, min(cells, len(v)), spherical) if len(v) else np.zeros((1, dims))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=_near(_matrix(pdf["embedding"], dims), centres, "cosine" if spherical else "l2", 1)[:, 0].astype("int32"))

    kind = own.schema["chunk_id"].dataType.simpleString()
    rows = own.mapInPandas(placed, f"chunk_id {kind}, embedding {own.schema['embedding'].dataType.simpleString()}, cell int")
    return Index(stored(rows.repartitionByRange("cell").sortWithinPartitions("cell")), centres, metric, dims)


def search(index: Index, queries: DataFrame, k: int, probes: int, keep: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score (6 decimals) and rank of the k best rows for every query (query_id, embedding) within its ``probes`` nearest cells.

    ``keep`` (chunk_id) filters rows before they are ranked. Hot cells are asked by blocks of queries; each task keeps k rows a query.
    """
    centres, metric, dims = index.centres, index.metric, index.dims
    spherical = metric != "l2"
    asked = queries.where(F.size("embedding") == dims).select("query_id", "embedding")
    q_kind, c_kind = queries.schema["query_id"].dataType.simpleString(), index.rows.schema["chunk_id"].dataType.simpleString()
    if k <= 0:
        return queries.sparkSession.createDataFrame([], f"query_id {q_kind}, chunk_id {c_kind}, score double, rank int")

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = _near(_matrix(pdf["embedding"], dims), centres, "cosine" if spherical else "l2", probes)
                for j in range(near.shape[1]):
                    yield pdf.assign(cell=near[:, j].astype("int32"))

    sent = asked.mapInPandas(routed, f"query_id {q_kind}, embedding {asked.schema['embedding'].dataType.simpleString()}, cell int")
    own = index.rows if keep is None else index.rows.join(keep.select("chunk_id").distinct(), "chunk_id", "left_semi")
    # A cell's queries in blocks; its rows go to each block.
    blocks = max(1, -(-asked.count() * min(probes, len(centres)) // (CELL_QUERIES * len(centres))))
    sent = sent.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            q, v, names, ids = _matrix(left["embedding"], dims), _matrix(right["embedding"], dims), right["chunk_id"].to_numpy(), left["query_id"].to_numpy()
            for a in range(0, len(q), 512):
                s = np.round(scores(q[a : a + 512], v, metric), 6)
                s[np.isnan(s)] = -np.inf
                kept = min(k, s.shape[1])
                least = -np.partition(-s, kept - 1, 1)[:, kept - 1]
                i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                out.append(pd.DataFrame({"query_id": ids[a + i], "chunk_id": names[j], "score": s[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": left["query_id"][:0], "chunk_id": right["chunk_id"][:0], "score": pd.Series(dtype=float)})

    found = sent.groupBy("cell", "block").cogroup(own.groupBy("cell", "block")).applyInPandas(best, f"query_id {q_kind}, chunk_id {c_kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
