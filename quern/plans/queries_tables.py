"""Relational and stream-like queries over the driver's tables; extensions beside document retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.plans.catalogue import query
from quern.session import table
from quern.streaming.ingest import sessions, windowed_counts


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("select o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by all order by round(sum(l_extendedprice * (1 - l_discount)), 2) desc, o_orderkey limit 20")
def top_orders(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(20)


@query("select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def balances_by_place(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"), F.sum("c_acctbal").alias("b"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.sum("k").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_by_hour(spark, d):
    return windowed_counts(table(spark, d, "events"))


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from s group by user_id, k")
def user_sessions(spark, d):
    return sessions(table(spark, d, "events"))


@query("with p as (select * from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by all) select p.event_id, v.event_id as view_id from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts")
def last_view_before_purchase(spark, d):
    """An as-of join as one pass: both sides in one order, the last view carried forward."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'view')").select("event_id", "user_id", "ts", "event_type")
    view = F.col("event_type") == "view"
    w = Window.partitionBy("user_id").orderBy("ts", F.when(view, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("view_id", F.last(F.when(view, F.col("event_id")), ignorenulls=True).over(w)).where(~view).select("event_id", "view_id")


@query("select event_type, json_extract_string(props, '$.k') as k, count(*) as n from events group by all")
def json_properties(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("(select distinct o_custkey as custkey from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderstatus = 'F') except select c_custkey from customer where c_acctbal < 0")
def customers_of_both_states(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("custkey")) for s in "OF")
    return a.intersect(b).exceptAll(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("select source, count(*) as documents, count(text) as texts, sum(n_chars) as chars, count(distinct lang) as langs, c.title from documents d left join corpora c using (source) group by source, c.title")
def documents_by_source(spark, d):
    docs = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count("text").alias("texts"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"))
    return docs.join(F.broadcast(table(spark, d, "corpora").select("source", "title")), "source", "left")
