"""Registered queries mirroring the reference's literal query shapes
library operators, plus the remaining single-operator checks (PRJ2, FLT1,
partitioned WIN1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.functions.columns import month_start, parse_number
from supplylens.operators import geo as G
from supplylens.operators import relational as R
from supplylens.operators.scenario import scenario
from supplylens.operators.widgets import widget
from supplylens.plans import geo_queries
from supplylens.plans.model_queries import _scenario_sql
from supplylens.plans.registry import register, table

# --------------------------------------------------------------------------
# single operators not covered elsewhere
# --------------------------------------------------------------------------


@register("rounded_latest", """
WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events)
SELECT event_type, round(avg(value), 4) AS avg_value, count(*) AS n
FROM e WHERE day = (SELECT max(day) FROM e) GROUP BY event_type
""")
def rounded_latest(spark, d):
    e = R.latest_period(table(spark, d, "events"), "ts", "DAY")
    g = e.groupBy("event_type").agg(F.avg("value").alias("avg_value"),
                                                     F.count(F.lit(1)).alias("n"))
    return R.rounded(g, {"avg_value": 4})


@register("filter_conjunction", """
SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 25
""")
def filter_conjunction(spark, d):
    li = table(spark, d, "lineitem").filter(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25))
    return li.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@register("pct_of_total_by_key", """
WITH g AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(qty, 2) AS qty,
       round(qty / sum(qty) OVER (PARTITION BY l_returnflag) * 100, 4) AS pct_of_total
FROM g
""")
def pct_of_total_by_key(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"))
    out = R.pct_of_total(g, "qty", partition=["l_returnflag"], digits=4)
    return out.withColumn("qty", F.round("qty", 2))


# --------------------------------------------------------------------------
# literal query shapes
# --------------------------------------------------------------------------


@register("catalogue_trend_one_key", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 4) AS avg_price
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 ORDER BY 1
""")
def catalogue_trend_one_key(spark, d):
    o = R.at(table(spark, d, "orders"), "o_orderpriority", "1-URGENT")
    g = o.groupBy(month_start("o_orderdate").alias("month")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("avg_price"))
    return R.order(g, ["month"])


def _emissions_text(spark, d):
    c = table(spark, d, "customer")
    txt = F.when(F.col("c_acctbal") >= 0, F.format_number(F.floor("c_acctbal"), 0)).otherwise(F.lit(""))
    return c.select("c_name", txt.alias("emissions_text"))


@register("catalogue_top_emitters", """
SELECT c_name, CAST(floor(c_acctbal) AS BIGINT) AS emissions FROM customer WHERE c_acctbal >= 0
ORDER BY emissions DESC, c_name ASC LIMIT 15
""")
def catalogue_top_emitters(spark, d):
    t = R.present(_emissions_text(spark, d), ["emissions_text"])
    t = t.select("c_name", parse_number("emissions_text").alias("emissions"))
    return R.top_k(t, [("emissions", "desc"), ("c_name", "asc")], 15)


@register("catalogue_emitter_count", """
SELECT count(*) AS value FROM customer WHERE c_acctbal >= 0
""")
def catalogue_emitter_count(spark, d):
    return R.counter(R.present(_emissions_text(spark, d), ["emissions_text"]))


@register("catalogue_producers_percent", """
WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
g AS (SELECT o_orderpriority, sum(o_totalprice) AS revenue FROM o
      WHERE month = (SELECT max(month) FROM o) GROUP BY 1)
SELECT o_orderpriority, round(revenue, 2) AS revenue,
       round(revenue / sum(revenue) OVER () * 100, 4) AS pct_of_total
FROM g
""")
def catalogue_producers_percent(spark, d):
    o = R.latest_period(table(spark, d, "orders"), "o_orderdate", "MONTH")
    g = o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("revenue"))
    out = R.pct_of_total(g, "revenue", digits=4).withColumn("revenue", F.round("revenue", 2))
    return R.order(out, [("pct_of_total", "desc")])


_PLACEHOLDER_NATIONS = [0, 24]


@register("catalogue_importers_by_volume", """
SELECT s_nationkey, round(sum(l_quantity), 2) AS sum_l_quantity,
       round(sum(l_extendedprice), 2) AS sum_l_extendedprice
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE s_nationkey NOT IN (0, 24) AND l_quantity IS NOT NULL
GROUP BY s_nationkey HAVING sum(l_extendedprice) > 0
ORDER BY sum_l_extendedprice DESC, s_nationkey ASC LIMIT 15
""")
def catalogue_importers_by_volume(spark, d):
    li = table(spark, d, "lineitem")
    # pre-aggregate per supplier, so a hot supplier is one row per task
    per_supp = R.present(li, ["l_quantity"], junk=()).groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("l_quantity"), F.sum("l_extendedprice").alias("l_extendedprice"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = R.exclude(R.lookup(per_supp, s, "l_suppkey"), "s_nationkey", _PLACEHOLDER_NATIONS)
    g = R.group_sum(j, ["s_nationkey"], ["l_quantity", "l_extendedprice"], having="l_extendedprice")
    return R.top_k(g, [("sum_l_extendedprice", "desc"), ("s_nationkey", "asc")], 15)


@register("catalogue_importers_by_count", """
SELECT CASE WHEN coalesce(trim(p_type), '') = '' THEN 'Unknown' ELSE trim(p_type) END AS label,
       count(*) AS n
FROM part WHERE p_name LIKE '%o%' GROUP BY 1 ORDER BY n DESC, label ASC LIMIT 3
""")
def catalogue_importers_by_count(spark, d):
    g = R.group_count_clean(R.like(table(spark, d, "part"), "p_name", "%o%"), "p_type")
    return R.top_k(g, [("n", "desc"), ("label", "asc")], 3)


def _asia_suppliers(spark, d):
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    j = R.lookup(R.lookup(s, n, "s_nationkey"), r, "n_regionkey")
    return j.filter((F.col("r_name") == "ASIA") & (F.col("s_acctbal") > 0))


_ASIA_SQL = """
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND s_acctbal > 0"""


@register("catalogue_operational_list", f"SELECT s_name, s_acctbal {_ASIA_SQL} ORDER BY s_name")
def catalogue_operational_list(spark, d):
    return R.order(_asia_suppliers(spark, d).select("s_name", "s_acctbal"), ["s_name"])


@register("catalogue_operational_count", f"SELECT count(*) AS value {_ASIA_SQL}")
def catalogue_operational_count(spark, d):
    return R.counter(_asia_suppliers(spark, d))


@register("catalogue_last_days", """
SELECT event_id, ts, value FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY ORDER BY ts DESC
""")
def catalogue_last_days(spark, d):
    e = R.trailing(table(spark, d, "events"), "ts", 10, prune=True).select("event_id", "ts", "value")
    return R.order(e, [("ts", "desc")])


@register("catalogue_this_year", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' ORDER BY o_orderdate DESC
""")
def catalogue_this_year(spark, d):
    o = R.since(table(spark, d, "orders"), "o_orderdate", "2001-01-01 00:00:00")
    return R.order(o.select("o_orderkey", "o_orderdate", "o_totalprice"), [("o_orderdate", "desc")])


@register("catalogue_day_lookup", "SELECT * FROM (" + _scenario_sql(
    "SELECT coalesce(arg_max(value, (ts, value)), 82.0) AS base FROM events "
    "WHERE ts IS NOT NULL AND value IS NOT NULL") + ") s WHERE day_number IN (0, 14)")
def catalogue_day_lookup(spark, d):
    s = scenario(table(spark, d, "events"), "ts", "value")
    return s.filter(F.col("day_number").isin(0, 14))


@register("catalogue_dearest_10", """
SELECT p_partkey, p_brand, p_retailprice FROM part
WHERE p_size > 6 ORDER BY p_retailprice DESC, p_partkey ASC LIMIT 10
""")
def catalogue_dearest_10(spark, d):
    p = table(spark, d, "part")
    junky = (F.when(F.col("p_size") <= 3, F.lit("")).when(F.col("p_size") <= 5, F.lit("-"))
             .when(F.col("p_size") == 6, F.lit(None).cast("string")).otherwise(F.col("p_brand")))
    p = R.present(p.withColumn("p_brand", junky), ["p_brand"])
    return R.top_k(p.select("p_partkey", "p_brand", "p_retailprice"),
                   [("p_retailprice", "desc"), ("p_partkey", "asc")], 10)


@register("catalogue_prompt_rollup", """
WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
g AS (SELECT o_orderpriority, sum(o_totalprice) AS revenue FROM o
      WHERE month = (SELECT max(month) FROM o) GROUP BY 1),
t AS (SELECT * FROM g ORDER BY revenue DESC, o_orderpriority ASC LIMIT 3)
SELECT string_agg(o_orderpriority || ': ' || CAST(CAST(round(revenue, 2) AS DECIMAL(18, 2)) AS VARCHAR), '; '
                  ORDER BY revenue DESC, o_orderpriority ASC) AS summary
FROM t
""")
def catalogue_prompt_rollup(spark, d):
    o = R.latest_period(table(spark, d, "orders"), "o_orderdate", "MONTH")
    g = o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("revenue"))
    text = F.concat("o_orderpriority", F.lit(": "),
                    F.round("revenue", 2).cast("decimal(18,2)").cast("string"))
    return R.rollup_text(g, text, [("revenue", "desc"), ("o_orderpriority", "asc")], k=3)


@register("catalogue_stock_by_month", """
SELECT date_trunc('month', o_orderdate) AS "month(o_orderdate)",
       round(sum(o_totalprice), 2) AS "sum(o_totalprice)"
FROM orders GROUP BY 1
""")
def catalogue_stock_by_month(spark, d):
    w = widget(table(spark, d, "orders"), x="o_orderdate", grain="MONTH", y=[("SUM", "o_totalprice")])
    return w.withColumn("sum(o_totalprice)", F.round("sum(o_totalprice)", 2))


@register("catalogue_coverage_vs_imports", """
SELECT date_trunc('month', l_shipdate) AS "month(l_shipdate)",
       round(avg(l_discount), 6) AS "avg(l_discount)", round(sum(l_quantity), 2) AS "sum(l_quantity)"
FROM lineitem GROUP BY 1
""")
def catalogue_coverage_vs_imports(spark, d):
    w = widget(table(spark, d, "lineitem"), x="l_shipdate", grain="MONTH",
               y=[("AVG", "l_discount"), ("SUM", "l_quantity")])
    return w.withColumns({"avg(l_discount)": F.round("avg(l_discount)", 6),
                          "sum(l_quantity)": F.round("sum(l_quantity)", 2)})


_SIX = [1, 3, 5, 7, 11, 13]


@register("catalogue_six_sources", """
SELECT date_trunc('month', l_shipdate) AS "month(l_shipdate)",
       round(sum(l_quantity), 2) AS "sum(l_quantity)", s_nationkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE s_nationkey IN (1, 3, 5, 7, 11, 13) GROUP BY 1, 3
""")
def catalogue_six_sources(spark, d):
    li = table(spark, d, "lineitem")
    # pre-aggregate per (supplier, month) so a hot supplier is one row per
    # month before the join; the widget's SUM over the sums is the same total
    per_supp = li.groupBy("l_suppkey", F.date_trunc("MONTH", "l_shipdate").cast("timestamp_ntz")
                          .alias("l_shipdate")).agg(F.sum("l_quantity").alias("l_quantity"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    ds = R.lookup(per_supp, R.include(s, "s_nationkey", _SIX), "l_suppkey")
    w = widget(ds, x="l_shipdate", grain="MONTH", y=[("SUM", "l_quantity")], color="s_nationkey")
    return w.withColumn("sum(l_quantity)", F.round("sum(l_quantity)", 2))


@register("catalogue_point_feed", f"""
SELECT to_json({{'type': 'Feature',
                'geometry': {{'type': 'Point', 'coordinates': [longitude, latitude]}},
                'properties': {{'acctbal': acctbal, 'name': substring(c_name, 1, 300),
                                'commodity': substring(c_mktsegment, 1, 200), 'state': ''}}}})::VARCHAR AS feature
FROM (SELECT * FROM ({geo_queries._CUST_SQL}) c) t
""")
def catalogue_point_feed(spark, d):
    return G.to_features(geo_queries.customer_points(spark, d))


@register("catalogue_scenario_latest", "SELECT * FROM (" + _scenario_sql(
    "SELECT coalesce(arg_max(value, (ts, value)), 82.0) AS base FROM events "
    "WHERE ts IS NOT NULL AND value IS NOT NULL") + ") s ORDER BY scenario_date DESC LIMIT 1")
def catalogue_scenario_latest(spark, d):
    """The scenario's latest row (price, FX) as the ticker reads it: S3 on SCN1."""
    s = scenario(table(spark, d, "events"), "ts", "value")
    return R.latest_row(s, "scenario_date")


@register("catalogue_emissions_by_state_fuel", """
SELECT c_nationkey, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS "sum(emissions)", c_mktsegment
FROM customer WHERE c_acctbal >= 0 GROUP BY c_nationkey, c_mktsegment
""")
def catalogue_emissions_by_state_fuel(spark, d):
    c = table(spark, d, "customer")
    txt = F.when(F.col("c_acctbal") >= 0, F.format_number(F.floor("c_acctbal"), 0)).otherwise(F.lit(""))
    t = R.present(c.withColumn("emissions_text", txt), ["emissions_text"])
    t = t.withColumn("emissions", parse_number("emissions_text"))
    return widget(t, x="c_nationkey", y=[("SUM", "emissions")], color="c_mktsegment")
