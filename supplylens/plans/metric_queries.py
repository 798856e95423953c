"""Registered queries for the metric view, widgets, KPI row and briefing
context, run over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F


from supplylens.operators import relational as R
from supplylens.operators.metrics import MetricStates, MetricView, context, kpis
from supplylens.operators.widgets import date_range, filter_values, filter_values_all, widget
from supplylens.plans.registry import register, table
from supplylens.session import scratch_path


def order_metrics(spark, d) -> MetricView:
    """Three dimensions and five measures over orders (the MET1 shape)."""
    return MetricView(
        source=table(spark, d, "orders"),
        dimensions={"order_year": "year(o_orderdate)", "priority": "o_orderpriority",
                    "status": "o_orderstatus"},
        measures={"avg_price": "round(avg(o_totalprice), 4)",
                  "max_price": "max(o_totalprice)",
                  "min_price": "min(o_totalprice)",
                  "price_volatility": "round(stddev_samp(o_totalprice), 4)",
                  "record_count": "count(*)"},
        comment="order price KPIs")


_MV_SELECT = """round(avg(o_totalprice), 4) AS avg_price, max(o_totalprice) AS max_price,
       min(o_totalprice) AS min_price, round(stddev_samp(o_totalprice), 4) AS price_volatility,
       count(*) AS record_count"""


@register("metric_view", f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderpriority AS priority,
       {_MV_SELECT}
FROM orders GROUP BY 1, 2
""")
def metric_view(spark, d):
    return order_metrics(spark, d).query(["order_year", "priority"])


@register("metric_view_total", f"""
SELECT o_orderstatus AS status, {_MV_SELECT}
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1
""")
def metric_view_total(spark, d):
    return order_metrics(spark, d).query(["status"], where="o_orderpriority <> '5-LOW'")


# --------------------------------------------------------------------------
# widgets
# --------------------------------------------------------------------------


@register("widget_group", """
SELECT event_type, round(sum(value), 2) AS "sum(value)", user_bucket
FROM (SELECT *, CAST(user_id // 50 AS BIGINT) AS user_bucket FROM events) t
GROUP BY event_type, user_bucket
""")
def widget_group(spark, d):
    e = table(spark, d, "events").withColumn("user_bucket", F.floor(F.col("user_id") / 50).cast("bigint"))
    w = widget(e, x="event_type", y=[("SUM", "value")], color="user_bucket")
    return w.withColumn("sum(value)", F.round("sum(value)", 2))


@register("widget_grain", """
SELECT date_trunc('day', ts) AS "day(ts)", round(avg(value), 4) AS "avg(value)",
       count(*) AS "count(*)"
FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1
""")
def widget_grain(spark, d):
    e = table(spark, d, "events")
    w = widget(e, x="ts", grain="DAY", y=[("AVG", "value"), ("COUNT", "*")],
               filters=[F.col("event_type").isin("click", "purchase", "view")])
    return w.withColumn("avg(value)", F.round("avg(value)", 4))


@register("widget_detail", """
SELECT user_id, value, event_type FROM events WHERE value > 50
""")
def widget_detail(spark, d):
    return widget(table(spark, d, "events"), disaggregated=True,
                  fields=["user_id", "value", "event_type"], filters=[F.col("value") > 50])


@register("widget_count", """
SELECT event_type, count(*) AS "count(*)" FROM events GROUP BY event_type
""")
def widget_count(spark, d):
    return widget(table(spark, d, "events"), x="event_type", y=[("COUNT", "*")])


@register("widget_counter", """
SELECT round(sum(o_totalprice), 2) AS "sum(o_totalprice)" FROM orders
""")
def widget_counter(spark, d):
    w = widget(table(spark, d, "orders"), y=[("SUM", "o_totalprice")])
    return w.withColumn("sum(o_totalprice)", F.round("sum(o_totalprice)", 2))


@register("filter_values", """
SELECT event_type, CAST(count_if(value > 10 AND user_id < 100) AS BIGINT) AS event_type_associativity
FROM events GROUP BY event_type
""")
def filter_values_q(spark, d):
    e = table(spark, d, "events")
    return filter_values(e, "event_type", [F.col("value") > 10, F.col("user_id") < 100])


@register("filter_date_range", """
SELECT min(CASE WHEN event_type = 'purchase' THEN ts END) AS "min(ts)",
       max(CASE WHEN event_type = 'purchase' THEN ts END) AS "max(ts)"
FROM events
""")
def filter_date_range(spark, d):
    return date_range(table(spark, d, "events"), "ts", [F.col("event_type") == "purchase"])


# --------------------------------------------------------------------------
# KPI row and briefing context
# --------------------------------------------------------------------------


@register("kpi_row", """
WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
latest_order AS (SELECT o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
SELECT
  coalesce((SELECT round(o_totalprice, 2) FROM latest_order),
           (SELECT round(avg(o_totalprice), 2) FROM o WHERE month = (SELECT max(month) FROM o))) AS latest_price,
  CAST((SELECT count(*) FROM events) AS DOUBLE) AS n_events,
  CAST((SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS DOUBLE) AS n_urgent,
  (SELECT round(sum(CASE WHEN event_type = 'purchase' THEN value END) / nullif(sum(value), 0) * 100, 1)
   FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) AS purchase_share,
  CAST(NULL AS DOUBLE) AS missing_metric,
  (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS latest_value
""")
def kpi_row(spark, d):
    o = table(spark, d, "orders")
    e = table(spark, d, "events")
    base = {
        "latest_price": lambda: R.latest_period(o, "o_orderdate", "MONTH").agg(
            F.round(F.avg("o_totalprice"), 2)),
        "n_events": lambda: R.counter(e),
        "n_urgent": lambda: R.counter(R.at(o, "o_orderpriority", "1-URGENT")),
        "purchase_share": lambda: R.share(R.latest_period(e, "ts", "DAY"),
                                          F.col("event_type") == "purchase", "value"),
        # a KPI over a table that was never loaded fails alone, to NULL
        "missing_metric": lambda: spark.table("no_such_table_anywhere").select("value"),
        # the other reading of a coverage KPI: the latest value, not a row count
        "latest_value": lambda: R.latest_row(e, "ts", tiebreak=["event_id"], cols=["value"]),
    }
    overrides = {
        "latest_price": lambda: R.latest_row(o, "o_orderdate", tiebreak=["o_orderkey"],
                                             cols=["o_totalprice"]).select(F.round("o_totalprice", 2)),
    }
    return kpis(spark, base, overrides)


@register("briefing_context", """
SELECT 'Latest order' AS label, 0::BIGINT AS chunk,
       (SELECT CAST(to_json(list({'o_orderkey': o_orderkey, 'o_totalprice': o_totalprice, 'o_orderpriority': o_orderpriority}
                            ORDER BY o_orderkey)) AS VARCHAR)
        FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)) AS context
UNION ALL
SELECT 'Regions', 0, (SELECT to_json(list({'r_regionkey': r_regionkey, 'r_name': r_name} ORDER BY r_regionkey))::VARCHAR FROM region)
UNION ALL
SELECT 'Top customer', 0,
       (SELECT to_json(list({'c_custkey': c_custkey, 'c_name': c_name, 'c_acctbal': c_acctbal} ORDER BY c_acctbal DESC))::VARCHAR
        FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey ASC LIMIT 1))
UNION ALL
SELECT 'Urgent orders by status', 0,
       (SELECT to_json(list({'o_orderstatus': o_orderstatus, 'n': n} ORDER BY o_orderstatus))::VARCHAR
        FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1))
UNION ALL
SELECT 'Missing table', 0, 'unavailable'
UNION ALL
SELECT 'Bad number', 0, 'unavailable'
UNION ALL
SELECT 'All orders', chunk, to_json(list({'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority} ORDER BY o_orderkey))::VARCHAR
FROM (SELECT *, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS chunk FROM orders) q GROUP BY chunk
""")
def briefing_context(spark, d):
    o = table(spark, d, "orders")
    sets = {
        "Latest order": lambda: R.latest_row(o, "o_orderdate", tiebreak=["o_orderkey"],
                                             cols=["o_orderkey", "o_totalprice", "o_orderpriority"]),
        "Regions": lambda: table(spark, d, "region"),
        "Top customer": lambda: R.top_k(table(spark, d, "customer")
                                        .select("c_custkey", "c_name", "c_acctbal"),
                                        [("c_acctbal", "desc"), ("c_custkey", "asc")], 1),
        "Urgent orders by status": lambda: R.group_count(R.at(o, "o_orderpriority", "1-URGENT"),
                                                         ["o_orderstatus"]),
        "Missing table": lambda: spark.table("no_such_table_anywhere"),
        # plans, and fails when it runs
        "Bad number": lambda: o.select(F.col("o_orderpriority").cast("int").alias("n")),
        "All orders": lambda: o.select("o_orderkey", "o_orderpriority"),
    }
    return context(spark, sets, order={"Top customer": [("c_acctbal", "desc")]})


@register("filter_values_all", """
SELECT 'event_type' AS field, event_type AS value, count(*) FILTER (WHERE user_id < 100 AND hour(ts) >= 6) AS associativity
FROM events GROUP BY 2
UNION ALL
SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FILTER (WHERE event_type IN ('click', 'view') AND hour(ts) >= 6)
FROM events GROUP BY 2
UNION ALL
SELECT 'hour', CAST(hour(ts) AS VARCHAR), count(*) FILTER (WHERE event_type IN ('click', 'view') AND user_id < 100)
FROM events GROUP BY 2
UNION ALL
SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR),
       count(*) FILTER (WHERE event_type IN ('click', 'view') AND user_id < 100 AND hour(ts) >= 6)
FROM events GROUP BY 2
""")
def filter_values_all_q(spark, d):
    """Three active filters and one without a condition, in one scan."""
    e = table(spark, d, "events").withColumns({"hour": F.hour("ts"), "day": F.to_date("ts")})
    return filter_values_all(e, {"event_type": F.col("event_type").isin("click", "view"), "user_id": F.col("user_id") < 100,
                                 "hour": F.col("hour") >= 6, "day": None})


@register("metric_rollup", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderpriority AS priority, o_orderstatus AS status,
       CAST(grouping(year(o_orderdate)) * 4 + grouping(o_orderpriority) * 2 + grouping(o_orderstatus) AS BIGINT) AS level,
       round(avg(o_totalprice), 4) AS avg_price, max(o_totalprice) AS max_price, min(o_totalprice) AS min_price,
       round(stddev_samp(o_totalprice), 4) AS price_volatility, count(*) AS record_count
FROM orders GROUP BY CUBE (year(o_orderdate), o_orderpriority, o_orderstatus)
""")
def metric_rollup(spark, d):
    """MET1: every subset of the dimensions from stored partial states."""
    view = order_metrics(spark, d)
    path = scratch_path(spark, "metric-states")
    MetricStates.build(view.source, view.dimensions, "o_totalprice").write.parquet(path)
    m = MetricStates(spark.read.parquet(path), list(view.dimensions)).every_subset()
    return m.select("order_year", "priority", "status", F.col("level").cast("long").alias("level"), F.round("avg", 4).alias("avg_price"),
                    F.col("max").alias("max_price"), F.col("min").alias("min_price"), F.round("stddev", 4).alias("price_volatility"),
                    F.col("rows").alias("record_count"))
