"""The most similar vectors of every vector (problem 2).

A router (``quern.llm.router``) is fitted on a bounded sample: the sample's neighbour graph is
cut into balanced parts and a softmax classifier learns them. A large collection has two levels of
this, so that the number of parts grows with its rows. Every vector is stored in its
most probable part and sent as a query to its few most probable parts; within a (model, part)
queries meet vectors by matrix products, block by block.

* Exact copies are one class before anything else. A class keeps its first k + 1 ids, which is
  all that k neighbours can need, so copies are never compared with one another. The limit is
  applied on the map side. Members beyond them get the class's first ids as neighbours.
* A part that holds too many vectors or gets too many queries is cut into blocks of rows, each
  pair of blocks being one task, so a hot part makes more tasks, not larger ones.
* The vectors are shuffled to the parts as they are stored. Products in single precision leave
  those that may be among the k best within ``FLOAT_ERROR``; cosines in double precision cut them to k.
* Classes are numbered in the order of their first ids, so that ties are cut by id in every block.
* With ``floor`` a pair is found from either side: what a part stores also meets the queries sent there.

Defined results: unusable vectors (null, of another length, all zero, with NaN or infinite
values) and rows with a null id or model are in no result. Rows repeated exactly count once; of
several vectors of one id each counts. Cosine similarity to 9 digits; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quern.llm.router import Level, Router, fit, largest, pairs_at
from quern.session import checkpointed

#: Rows of a part, rows per part that a classifier is fitted on, and parts of one classifier; so a fit takes at most their product.
PART_ROWS, FIT_ROWS, WIDE = 3_000, 128, 512
#: Parts that a collection has at least, however small.
LEAST_PARTS = 4
PROBE_QUERIES = 512
DATA_BLOCK, QUERY_BLOCK, TILE = 16_384, 32_768, 1_024
FLOAT_ERROR = 4e-6  # more than single precision can change a cosine
DIGITS = 9  # of a cosine; beyond them vectors tie


def units(vec: pd.Series, dims: int) -> np.ndarray:
    """Unit vectors in double precision of stored ones, float32 or float64 bytes."""
    raw = b"".join(vec)
    v = np.frombuffer(raw, "<f8" if len(raw) == 8 * dims * len(vec) else "<f4").reshape(-1, dims).astype(float)
    with np.errstate(all="ignore"):
        v = v / np.abs(v).max(1, keepdims=True)  # before squaring, so that no length overflows
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(chunks: DataFrame, dims: int) -> DataFrame:
    """(id, model, vec): the vectors as little-endian bytes of their own precision."""
    good = F.col("id").isNotNull() & F.col("embedding_model").isNotNull() & (F.size("embedding") == dims)
    single = chunks.schema["embedding"].dataType.elementType == FloatType()

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.array([np.asarray(x, np.float64) for x in pdf["embedding"]]).reshape(-1, dims) + 0.0  # no negative zeros
            vec = pd.Series([x.tobytes() for x in v.astype("<f4" if single else "<f8")], index=pdf.index, dtype=object)
            ok = np.isfinite(units(vec, dims)).all(1)
            yield pd.DataFrame({"id": pdf["id"][ok], "model": pdf["embedding_model"][ok], "vec": vec[ok]})

    return chunks.select("id", "embedding_model", "embedding").where(good).mapInPandas(stored, "id string, model string, vec binary")


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(model, cid, ids, vec): one row per distinct vector, with its first ``keep`` ids; cid is a number in the order of the first ids.

    The numbers hold once the result is checkpointed.
    """
    w = Window.partitionBy("model", "hash", "vec").orderBy("id")
    first = vectors.withColumn("hash", F.xxhash64("vec")).withColumn("nth", F.dense_rank().over(w)).where(F.col("nth") <= keep)
    ids = first.groupBy("model", "hash", "vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return ids.orderBy(F.col("ids")[0], "model", "vec").select("model", F.monotonically_increasing_id().alias("cid"), "ids", "vec")


def _sampled(distinct: DataFrame, rows: int, n: int) -> list:
    """The first ``rows`` of ``n`` rows in hash order. A hash threshold keeps about twice as many, so that only those are sorted."""
    h = F.xxhash64("vec", F.lit("sample"))
    share = min(1.0, (2 * rows + 100) / max(1, n))
    some = distinct.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(np.ceil(share * (1 << 30)))))
    return some.select("model", "vec", h.alias("h")).orderBy("h", "vec", "model").limit(rows).collect()


def fitted_router(distinct: DataFrame, dims: int, k: int, floor: float | None, target: float, part_rows: int = PART_ROWS, wide: int = WIDE) -> Router:
    """A router to about n / part_rows parts, and its number of probes.

    Up to ``wide`` parts one classifier is fitted on FIT_ROWS rows per part. Beyond that it finds coarse parts only,
    and each of these gets its own classifier, fitted where its sample is, with parts in proportion to its rows: the
    number of parts grows with the collection. What the driver and every task hold of the model is
    (dims + 1) * 4 bytes a part, 4 MB for 50 million vectors.

    Without ``floor`` the probes are as many as bring the share ``target`` of true neighbours together: those of
    PROBE_QUERIES rows outside the sample are found among all rows in one pass.
    """
    n = distinct.count()
    parts = max(LEAST_PARTS, round(n / part_rows))
    coarse = parts if parts <= wide else min(wide, int(np.ceil(np.sqrt(parts))))
    asked = min(PROBE_QUERIES, n // 4)
    fit_rows = max(0, min(FIT_ROWS * coarse, n - asked))
    rows = _sampled(distinct, fit_rows + asked, n)
    v = units([bytes(r["vec"]) for r in rows], dims).astype("<f4")
    router = Router(fit(v[:fit_rows], coarse, k))
    if coarse < parts and router.parts > 1:
        router = _refined(distinct, router, dims, k, part_rows)
    if router.parts > 1:
        if floor is None:
            found = _true_homes(distinct, v[fit_rows:], [r["model"] for r in rows[fit_rows:]], router, k)
            depth = router.depths(v[fit_rows:][[q for q, _ in found]], np.array([p for _, p in found])) if found else [1]
        else:  # a pair is found from either side
            a, b = pairs_at(v, floor)
            depth = np.minimum(router.depths(a, router.homes(b)), router.depths(b, router.homes(a)))
        router.probes = int(np.quantile(depth, target, method="higher"))
    return router


def _refined(distinct: DataFrame, router: Router, dims: int, k: int, part_rows: int) -> Router:
    """The router with a second classifier for each of its parts, fitted in one task each on FIT_ROWS rows per part to come."""

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"home": router.homes(units(pdf["vec"], dims).astype("<f4")).astype("int32"), "vec": pdf["vec"]})

    placed = distinct.select("vec").mapInPandas(homes, "home int, vec binary")
    sizes = {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}  # a row per coarse part
    inner = {c: max(1, min(WIDE, round(m / part_rows))) for c, m in sizes.items()}
    # The share of each coarse part's rows that its fit takes, as a threshold on the hash.
    upto = F.create_map(*(F.lit(x) for c, m in sizes.items() for x in (c, int(min(1.0, FIT_ROWS * inner[c] / m) * (1 << 30)))))
    some = placed.where(F.pmod(F.xxhash64("vec", F.lit("fine")), F.lit(1 << 30)) < upto[F.col("home")])

    def fine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        level = fit(units(rows.sort_values("vec")["vec"], dims).astype("<f4"), inner[int(key[0])], k)
        return pd.DataFrame({"home": [key[0]], "parts": [level.parts], "weights": [level.weights.astype("<f4").tobytes()], "bias": [level.bias.astype("<f4").tobytes()]})

    levels = {}
    for r in some.groupBy("home").applyInPandas(fine, "home int, parts int, weights binary, bias binary").collect():
        if r["parts"] > 1:
            levels[r["home"]] = Level(np.frombuffer(r["weights"], "<f4").reshape(dims, -1), np.frombuffer(r["bias"], "<f4"))
    return Router(router.top, levels)


def _true_homes(distinct: DataFrame, asked: np.ndarray, models: list[str], router: Router, k: int) -> list[tuple[int, int]]:
    """(query, part) of the k nearest rows of each of a few queries, by brute force; each task gives k rows a query."""
    dims = asked.shape[1]
    names = np.array(models, dtype=object)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sims, parts = np.full((len(asked), k), -2.0, np.float32), np.full((len(asked), k), -1, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            v = units(pdf["vec"], dims).astype("<f4")
            s = asked @ v.T
            s[(names[:, None] != pdf["model"].to_numpy()[None]) | (s > 1 - 1e-6)] = -2
            best = largest(np.concatenate([sims, s], 1), k)
            homes = np.concatenate([parts, np.broadcast_to(router.homes(v), s.shape)], 1)
            sims, parts = np.take_along_axis(np.concatenate([sims, s], 1), best, 1), np.take_along_axis(homes, best, 1)
        q, nth = np.nonzero(sims > -2)
        yield pd.DataFrame({"q": q.astype("int32"), "sim": sims[q, nth], "part": parts[q, nth].astype("int32")})

    w = Window.partitionBy("q").orderBy(F.desc("sim"), "part")
    own = distinct.select("model", "vec").mapInPandas(nearest, "q int, sim float, part int")
    best = own.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return [(r["q"], r["part"]) for r in best.select("q", "part").collect()]


def _routed(distinct: DataFrame, router: Router, dims: int) -> DataFrame:
    """(model, part, role, cid, vec): role 0 stores a vector, and asks there, its home; role 1 only asks."""

    model = distinct.sparkSession.sparkContext.broadcast(router)  # (dims + 1) * 4 bytes a part

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = units(pdf["vec"], dims).astype("<f4")
            parts = model.value.routes(v)
            for j in range(parts.shape[1]):
                yield pd.DataFrame({"model": pdf["model"], "part": parts[:, j].astype("int32"), "role": np.int8(j > 0), "cid": pdf["cid"], "vec": pdf["vec"]})

    return distinct.select("model", "cid", "vec").mapInPandas(route, "model string, part int, role byte, cid long, vec binary")


def _blocks(routed: DataFrame) -> DataFrame:
    """Copies of the rows for each pair of blocks, as block_d, block_q and the roles ``stored``, ``asks`` and ``visits`` (asks, stored elsewhere) in it."""
    counts = routed.groupBy("model", "part").agg(F.count_if(F.col("role") == 0).alias("d"), F.count("*").alias("q"))
    # Only parts above a block are cut; their number is at most rows / DATA_BLOCK or QUERY_BLOCK, probes included.
    cut = counts.where((F.col("d") > DATA_BLOCK) | (F.col("q") > QUERY_BLOCK)).select("model", "part", F.ceil(F.col("d") / DATA_BLOCK).cast("int").alias("nd"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("nq"))
    cut = checkpointed(cut)
    n = cut.count()
    stored = F.col("role") == 0
    if not n:
        return routed.select("model", "part", F.lit(0).alias("block_d"), F.lit(0).alias("block_q"), stored.alias("stored"), F.lit(True).alias("asks"), (~stored).alias("visits"), "cid", "vec")
    rows = routed.join(F.broadcast(cut) if n < 100_000 else cut, ["model", "part"], "left")
    nd, nq = F.coalesce("nd", F.lit(1)), F.coalesce("nq", F.lit(1))
    h = F.xxhash64("cid")
    rows = rows.withColumns({"nd": nd, "nq": nq, "my_d": F.pmod(h, nd), "my_q": F.pmod(F.shiftrightunsigned(h, 20), nq)})
    # As a query to all blocks of vectors, as a stored vector to all blocks of queries; where both fall together, one row.
    places = F.array_union(
        F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda d: F.struct(d.cast("long").alias("d"), F.col("my_q").alias("q"))),
        F.when(stored, F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: F.struct(F.col("my_d").alias("d"), q.cast("long").alias("q")))).otherwise(F.array().cast("array<struct<d:bigint,q:bigint>>")),
    )
    rows = rows.withColumn("at", F.explode(places))
    return rows.select("model", "part", F.col("at.d").cast("int").alias("block_d"), F.col("at.q").cast("int").alias("block_q"), (stored & (F.col("at.d") == F.col("my_d"))).alias("stored"), (F.col("at.q") == F.col("my_q")).alias("asks"), (~stored & (F.col("at.q") == F.col("my_q"))).alias("visits"), "cid", "vec")


NEAR = "model string, qc long, near array<struct<d:double,dc:long>>"


def _cut(sim: np.ndarray, k: int) -> np.ndarray:
    """Which entries of each row are its k largest; of equal ones the first. What is -inf is none."""
    best = min(k, sim.shape[1])
    kth = -np.partition(-sim, best - 1, 1)[:, best - 1 : best]
    more, tie = sim > kth, (sim == kth) & (sim > -np.inf)
    return more | (tie & (np.cumsum(tie, 1) <= k - more.sum(1, keepdims=True)))


def nearest(q: np.ndarray, d: np.ndarray, own: np.ndarray, k: int, floor: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of q, rows of d and cosines of the k nearest of d to each of q, or those of them at ``floor`` or above.

    Of rows that tie in ``DIGITS`` digits the first of d count. ``own`` is the row of d that is the query itself, or -1.
    """
    if not len(d):
        return
    dt = np.ascontiguousarray(d.astype(np.float32).T)
    best = min(k, len(d))
    for a in range(0, len(q), TILE):
        u, mine = q[a : a + TILE], own[a : a + TILE]
        self_ = np.flatnonzero(mine >= 0)
        s = -u.astype(np.float32) @ dt
        s[self_, mine[self_]] = 4
        most = np.partition(s, best - 1, 1)[:, best - 1] + np.float32(2 * FLOAT_ERROR + 10.0**-DIGITS)
        if floor is not None:
            most = np.minimum(most, np.float32(FLOAT_ERROR - floor))
        may = s <= np.minimum(most, 2)[:, None]
        many = may.sum(1)
        few = np.flatnonzero((many > 0) & (many <= 8 * k))
        for x in range(0, len(few), 256):
            i, j = np.nonzero(may[few[x : x + 256]])
            i = few[x : x + 256][i]
            sim = np.einsum("ij,ij->i", u[i], d[j])
            if floor is not None:
                i, j, sim = (y[sim >= floor] for y in (i, j, sim))
            sim = np.round(sim, DIGITS)
            order = np.lexsort((j, -sim, i))
            i, j, sim = i[order], j[order], sim[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield a + i[keep], j[keep], sim[keep]
        rest = np.flatnonzero(many > 8 * k)  # within a dense cluster: all of d in double precision
        for x in range(0, len(rest), 128):
            r = rest[x : x + 128]
            sim = u[r] @ d.T
            sim[~may[r] | (sim < (-2 if floor is None else floor))] = -np.inf
            sim = np.round(sim, DIGITS)
            i, j = np.nonzero(_cut(sim, k))
            yield a + r[i], j, sim[i, j]


def _candidates(routed: DataFrame, dims: int, k: int, floor: float | None) -> DataFrame:
    """(model, qc, near): of each query in each block its k best, at ``floor`` or above."""

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid", ignore_index=True)
        v, cid = units(rows["vec"], dims), rows["cid"].to_numpy()
        stored, asks, visits = (np.flatnonzero(rows[c].to_numpy(bool)) for c in ("stored", "asks", "visits"))
        where = np.full(len(v), -1)
        where[stored] = np.arange(len(stored))
        ways = [(asks, stored, where[asks])]
        if floor is not None:  # what is stored asks the visitors
            ways.append((stored, visits, np.full(len(stored), -1)))
        names, near = [], []
        for q, d, own in ways:
            for i, j, sim in nearest(v[q], v[d], own, k, floor):
                pairs = list(zip((-sim).tolist(), cid[d[j]].tolist()))
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.array([], int)
                names += cid[q[i[first]]].tolist() if len(i) else []
                near += [pairs[x:y] for x, y in zip(first, [*first[1:], len(pairs)])]
        model = rows["model"].iloc[0] if len(rows) else ""
        return pd.DataFrame({"model": pd.Series([model] * len(names), dtype=object), "qc": pd.Series(names, dtype="int64"), "near": pd.Series(near, dtype=object)})

    return _blocks(routed).groupBy("model", "part", "block_d", "block_q").applyInPandas(match, NEAR)


def neighbours(chunks: DataFrame, k: int = 10, floor: float | None = None, dims: int = 64, recall: float | None = None, part_rows: int = PART_ROWS, wide: int = WIDE) -> DataFrame:
    """model, chunk, neighbour, rank and similarity: of every usable vector its k nearest, or those of them at ``floor`` or above.

    ``recall`` is the share of pairs that the probes must bring together; by default 0.96 of true neighbours, or 0.999
    of pairs whose cosine is ``floor``. ``part_rows`` is about how many vectors a part holds, ``wide`` how many parts one classifier tells apart.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vectors = usable(chunks, dims)
    distinct = checkpointed(classes(vectors, k + 1))
    router = fitted_router(distinct, dims, k, floor, recall or (0.96 if floor is None else 0.999), part_rows, wide)
    found = _candidates(_routed(distinct, router, dims), dims, k, floor)
    if floor is not None:  # few pairs, some of them found in two places
        pair = found.select("model", "qc", F.explode("near").alias("n")).groupBy("model", "qc", F.col("n.dc").alias("dc")).agg(F.min("n.d").alias("d"))
        best = Window.partitionBy("model", "qc").orderBy("d", "dc")
        found = pair.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("model", "qc", "dc", "d")
    else:
        # A query has one list per probe and block, without common members.
        merged = found.groupBy("model", "qc").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        found = merged.select("model", "qc", F.explode("near").alias("n")).select("model", "qc", "n.dc", "n.d")
    # The ids behind the classes. What has several ids is rare; still every neighbour's ids come by a join.
    ids = distinct.select(F.col("cid").alias("dc"), F.col("ids").alias("d_ids"))
    lists = found.join(ids, "dc").groupBy("qc").agg(F.collect_list(F.struct("d", F.col("d_ids").alias("ids"))).alias("near"))
    own = distinct.select("model", F.col("cid").alias("qc"), F.col("ids").alias("q_ids"))
    # Without neighbours at or above the floor, a class of one vector yields no row: an inner join loses nothing then.
    rows = own.join(lists, "qc", "left").where(F.col("near").isNotNull() | (F.size("q_ids") > 1))
    near = F.coalesce("near", F.array().cast("array<struct<d:double,ids:array<string>>>"))
    struct = "array<struct<d:double,id:string>>"
    flat = F.flatten(F.transform(near, lambda x: F.transform(x["ids"], lambda i: F.struct(x["d"].alias("d"), i.alias("id"))))).cast(struct)
    same = F.transform("q_ids", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id"))).cast(struct)
    listed = rows.select("model", "qc", "q_ids", F.array_sort(F.concat(same, flat)).alias("all"))
    rows = listed.select("model", F.explode("q_ids").alias("chunk"), "all")
    rows = rows.select("model", "chunk", F.posexplode(F.slice(F.filter("all", lambda x: x["id"] != F.col("chunk")), 1, k)).alias("pos", "n"))
    out = rows.select("model", "chunk", F.col("n.id").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("n.d")).alias("similarity"))
    # Members of a class beyond its first k + 1 ids have the class's first k neighbours, which all tie at 1.
    hot = distinct.where(F.size("ids") > k).select("model", "vec", "cid", "ids")
    if not hot.isEmpty():
        first = listed.where(F.size("q_ids") > k).select(F.col("qc").alias("cid"), F.transform(F.slice("all", 1, k), lambda x: x["id"]).alias("first"))
        hot = hot.join(first, "cid").drop("cid")
        salts = 16
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rest = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["model", "vec", "salt"]).where(~F.array_contains("ids", F.col("id")))
        rest = rest.select("model", F.col("id").alias("chunk"), "first").distinct().select("model", "chunk", F.posexplode("first").alias("pos", "neighbour"))
        out = out.unionByName(rest.select("model", "chunk", "neighbour", (F.col("pos") + 1).alias("rank"), F.lit(1.0).alias("similarity")))
    return out


def near_pairs(chunks: DataFrame, k: int, floor: float, dims: int = 64) -> DataFrame:
    """chunk_a and chunk_b, smaller id first, of which one is among the other's k nearest, at ``floor`` or above."""
    near = neighbours(chunks, k, floor, dims)
    return near.select(F.least("chunk", "neighbour").alias("chunk_a"), F.greatest("chunk", "neighbour").alias("chunk_b")).distinct()
