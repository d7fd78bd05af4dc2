"""Filling containers of a fixed capacity with documents (problem 9).

Documents are dealt by a hash of their id into groups of about ``group_rows``; each group is
packed by best fit decreasing. A segment tree over remaining capacities finds the tightest
open container in logarithmic time. The groups are independent, so the work is spread over
all cores and no group depends on how common a source is; since one group leaves only its
last few containers part-filled, the loss against one global packing is negligible.

Defined results: a document without tokens (null or empty text) takes no room and is put in
the tightest container, as piece 0 from 0 to 0. A document larger than a container is cut
into full containers' worth and a rest; only such documents have several pieces. Repeated
rows of one doc_id are one document. A row with a null doc_id is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.encode import BYTE_BPE_50K, token_count

PLACED = "container_id string, doc_id long, piece int, token_start int, token_end int, n_tokens int"


class OpenBins:
    """Open containers by remaining capacity, under a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, name: int) -> None:
        self.bins[room].append(name)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove the container with the least room of at least ``size``; its room and name."""
        node, count = size + self.leaves, self.count
        if size >= self.leaves:
            return None
        while not count[node]:  # up, until a subtree to the right has one
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.leaves
        name = self.bins[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, name


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size; all sizes are within ``capacity``."""
    out, bins, opened = np.empty(len(sizes), np.int64), OpenBins(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room, name = bins.take(size) or (capacity, opened)
        opened = max(opened, name + 1)
        out[i] = name
        bins.add(room - size, name)
    return out


def fill_containers(sized: DataFrame, capacity: int, group_rows: int = 50_000) -> DataFrame:
    """Containers of ``sized`` (doc_id, n_tokens): one row per document, or per piece of an oversized one."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    # Over n rows, as many groups as keep a group near group_rows.
    groups = max(1, -(-sized.select("doc_id").count() // group_rows))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id").reset_index(drop=True)
        n = rows["n_tokens"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-n // capacity))
        of = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[of] - piece * capacity)
        name = best_fit_decreasing(size, capacity)
        group = str(rows["grp"].iloc[0]) if len(rows) else ""
        return pd.DataFrame({"container_id": [f"{group}-{x}" for x in name], "doc_id": rows["doc_id"].to_numpy()[of], "piece": piece, "token_start": piece * capacity, "token_end": piece * capacity + size, "n_tokens": size})

    return (
        sized.where("doc_id is not null").select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("grp"))
        .groupBy("grp").applyInPandas(pack, PLACED)
    )


def sized_documents(documents: DataFrame, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id and the number of tokens of its text; repeated ids count once."""
    return documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("n_tokens")).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
