"""Splits that keep related records together (problem 7).

Items and the documents they name form a graph. Its components come from Borůvka's method:
in every round each component picks its least edge to another one, the picks are added to a
persisted spanning forest, chains of picks are followed to their root by pointer doubling,
and the edges are contracted. Components at least halve in number per round.

A document that a third of all items name makes no large group anywhere: its items are tied
to one item per (document, salt), and those few to one per document, so no row has more than
about items/SALTS neighbours before the first contraction, and every minimum is combined on
the map side. Nothing of the graph reaches the driver except counts of edges.

Defined results: repeated rows of one id count once, with the union of what they name; an
item that names nothing (null or empty list, null or blank entries) is a group of its own;
rows with a null id are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpointed

SALTS = 64
SPLITS = ("train", "dev", "test")


def links(items: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that join all items naming one document, in two levels of stars."""
    name = F.lower(F.trim(F.col("doc")))
    named = (
        items.where("id is not null").select("id", F.explode("relevant_document_ids").alias("doc"))
        .select("id", name.alias("doc")).where("doc is not null and doc <> ''").distinct()
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    )
    hubs = named.groupBy("doc", "salt").agg(F.min("id").alias("hub"), F.count("*").alias("n"))
    centre = hubs.groupBy("doc").agg(F.min("hub").alias("a"), F.count("*").alias("k"))
    # Most documents are named by few items of one salt; only true stars need the join.
    inner = named.join(hubs.where("n > 1").select("doc", "salt", "hub"), ["doc", "salt"]).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    outer = hubs.join(centre.where("k > 1").select("doc", "a"), "doc").select("a", F.col("hub").alias("b"))
    return inner.unionByName(outer).where("a <> b").distinct()


def _followed(hooks: DataFrame) -> DataFrame:
    """Every node (node, up) with what its ``up`` points to."""
    return hooks.join(hooks.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) of undirected edges (a, b): node and root of every node that has an edge, and the picked edges.

    ``root`` is the least node of its component.
    """
    spark = edges.sparkSession
    left = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels, picked = None, []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The least edge by (smaller end, larger end); ties can't occur, so picks form no cycle but pairs.
        pick = both.groupBy("a").agg(F.min(F.struct(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("e"))
        pick = checkpointed(pick.select(F.col("a").alias("node"), F.when(F.col("e.lo") == F.col("a"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("to"), "e.lo", "e.hi"))
        picked.append(pick.select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct())
        # Two components that picked each other: the smaller one is the root.
        back = pick.select(F.col("node").alias("to"), F.col("to").alias("back"))
        hooks = pick.select("node", "to").join(back, "to", "left").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("up"))
        hooks = checkpointed(hooks)
        while True:  # pointer doubling, twice before anything is written: the depth falls to a quarter
            twice = _followed(hooks)
            jumped = checkpointed(_followed(twice).join(twice.withColumnRenamed("up", "former"), "node"))
            hooks = jumped.select("node", "up")
            if jumped.where("up <> former").isEmpty():
                break
        up = hooks
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            labels = checkpointed(labels.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
        left = checkpointed(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct())
    if labels is None:
        node = edges.select(F.col("a").alias("node"))
        return node.withColumn("root", F.col("node")).limit(0), edges.select("a", "b").limit(0)
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    forest = reduce(DataFrame.unionByName, picked)
    return labels.join(least, "root").select("node", F.col("least").alias("root")), forest


def item_forest(items: DataFrame) -> DataFrame:
    """a and b, a < b: the links of a spanning forest of the items, as they were persisted: of every group as many as it has items, less one."""
    return spanning_forest(links(items))[1].select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def item_groups(items: DataFrame) -> DataFrame:
    """item_id, its trimmed lower-case split and group_id, the least item id of its group."""
    own = F.lower(F.trim("split"))
    one = items.where("id is not null").groupBy(F.col("id").alias("item_id")).agg(F.min(F.when(own != "", own)).alias("split"))
    labels, _ = spanning_forest(links(items))
    return one.join(labels.withColumnRenamed("node", "item_id"), "item_id", "left").select("item_id", "split", F.coalesce("root", "item_id").alias("group_id"))


def straddling_groups(items: DataFrame) -> DataFrame:
    """item_id and group_id of all items whose group now holds two or more splits."""
    groups = checkpointed(item_groups(items))
    split = groups.groupBy("group_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("group_id")
    # split has one row per group and so no hot key; AQE splits a hot group on the other side.
    return groups.join(split, "group_id").select("item_id", "group_id")


def dealt_splits(items: DataFrame, shares: dict[str, float], large_at: int = 1000, lanes: int | None = None) -> DataFrame:
    """item_id, group_id and the split that its whole group is dealt to, near ``shares`` of all items.

    Groups of more than 1/large_at of the items, at most ``large_at`` of them, go one by one,
    largest first, to the split that lacks most. All others are stratified by size band (powers
    of two) and dealt systematically: in hash order within a band, by their place among the
    band's items, in the proportions that are then left to fill.
    """
    total = sum(shares[s] for s in SPLITS)
    groups = checkpointed(item_groups(items))
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    count = groups.count()
    lanes = lanes or max(256, count // 50_000)  # so that no lane holds many groups
    lacking = {s: shares[s] / total * count for s in SPLITS}
    spark = items.sparkSession
    dealt = []
    for row in sizes.where(F.col("n") * large_at > F.lit(count)).orderBy(F.desc("n"), "group_id").collect():  # fewer than large_at rows
        s = max(SPLITS, key=lambda x: lacking[x])
        lacking[s] -= row["n"]
        dealt.append((row["group_id"], s))
    left = sum(max(0.0, x) for x in lacking.values()) or 1.0
    upto, cuts = 0.0, []
    for s in SPLITS:
        upto += max(0.0, lacking[s]) / left
        cuts.append((s, upto))
    h = F.xxhash64("group_id")
    small = sizes.where(F.col("n") * large_at <= F.lit(count)).select("group_id", "n", F.floor(F.log2("n")).alias("band"), h.alias("h"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(lanes)).alias("lane"))
    # Places within a band: sums per (band, lane) are few rows; within a lane groups are counted in hash order.
    per_lane = small.groupBy("band", "lane").agg(F.sum("n").alias("lane_n"))
    w = Window.partitionBy("band").orderBy("lane")
    per_lane = per_lane.select("band", "lane", (F.sum("lane_n").over(w) - F.col("lane_n")).alias("before"), F.sum("lane_n").over(Window.partitionBy("band")).alias("band_n"))
    inside = Window.partitionBy("band", "lane").orderBy("h", "group_id")
    placed = small.withColumn("at", F.sum("n").over(inside) - F.col("n") / 2).join(per_lane, ["band", "lane"])
    u = (F.col("before") + F.col("at")) / F.col("band_n")
    choice = F.lit(cuts[-1][0])
    for s, c in reversed(cuts[:-1]):
        choice = F.when(u < c, s).otherwise(choice)
    out = placed.select("group_id", choice.alias("new_split"))
    if dealt:
        out = out.unionByName(spark.createDataFrame(dealt, "group_id string, new_split string"))
    return groups.join(out, "group_id").select("item_id", "group_id", F.col("new_split").alias("split"))
