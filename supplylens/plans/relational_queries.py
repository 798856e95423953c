"""Registered queries for projections, filters, joins, aggregates, windows,
sorting and set operations, run over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.functions.columns import month_start, parse_number, try_number
from supplylens.operators import relational as R
from supplylens.plans.registry import register, table

# --------------------------------------------------------------------------
# FLT8 + AGG3 + PRJ2 — the minimum slice
# --------------------------------------------------------------------------


def orders_by_month(spark, d):
    return table(spark, d, "orders").withColumn("month", month_start("o_orderdate"))


@register("latest_group_avg", """
WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
SELECT o_orderpriority,
       round(avg(o_totalprice), 4) AS avg_o_totalprice,
       round(min(o_totalprice), 4) AS min_o_totalprice,
       round(max(o_totalprice), 4) AS max_o_totalprice
FROM o WHERE month = (SELECT max(month) FROM o)
GROUP BY o_orderpriority
""")
def latest_group_avg(spark, d):
    # the latest month as a literal range on o_orderdate: pushed into the scan
    o = R.latest_period(table(spark, d, "orders"), "o_orderdate", "MONTH")
    return R.group_stats(o, ["o_orderpriority"], "o_totalprice", digits=4)


@register("latest_scalar", """
WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
SELECT round(avg(o_totalprice), 4) AS avg_price, count(*) AS n_orders
FROM o WHERE o_orderpriority = '1-URGENT' AND month = (SELECT max(month) FROM o)
""")
def latest_scalar(spark, d):
    o = R.latest_period(table(spark, d, "orders"), "o_orderdate", "MONTH")
    o = R.at(o, "o_orderpriority", "1-URGENT")
    return o.agg(F.round(F.avg("o_totalprice"), 4).alias("avg_price"),
                 F.count(F.lit(1)).alias("n_orders"))


@register("latest_per_key", """
WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
m AS (SELECT o_orderstatus, max(month) AS month FROM o GROUP BY 1)
SELECT o.o_orderstatus, o.month, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM o JOIN m ON o.o_orderstatus = m.o_orderstatus AND o.month = m.month
GROUP BY 1, 2
""")
def latest_per_key(spark, d):
    o = R.latest(orders_by_month(spark, d), "month", by=["o_orderstatus"])
    return o.groupBy("o_orderstatus", "month").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@register("trailing_days", """
SELECT CAST(ts AS DATE) AS day, round(sum(value), 2) AS total_value, count(*) AS n_events
FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
GROUP BY 1
""")
def trailing_days(spark, d):
    e = R.trailing(table(spark, d, "events"), "ts", 7, prune=True)
    out = e.groupBy(F.to_date("ts").alias("day")).agg(
        F.round(F.sum("value"), 2).alias("total_value"), F.count(F.lit(1)).alias("n_events"))
    return R.order(out, ["day"])


@register("since_literal", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders
FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'
GROUP BY 1
""")
def since_literal(spark, d):
    o = R.since(table(spark, d, "orders"), "o_orderdate", "2000-01-01 00:00:00")
    out = o.groupBy(month_start("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n_orders"))
    return R.order(out, ["month"])


# --------------------------------------------------------------------------
# FLT2-5, FLT9
# --------------------------------------------------------------------------

# A text column with junk in it, derived from a natural attribute (size).
def _junky_brand():
    return (F.when(F.col("p_size") <= 3, F.lit(""))
            .when(F.col("p_size") <= 5, F.lit("-"))
            .when(F.col("p_size") == 6, F.lit(None).cast("string"))
            .otherwise(F.col("p_brand")))
_JUNKY_BRAND_SQL = ("CASE WHEN p_size <= 3 THEN '' WHEN p_size <= 5 THEN '-' "
                    "WHEN p_size = 6 THEN NULL ELSE p_brand END")


@register("present_filter", f"""
SELECT brand, count(*) AS n
FROM (SELECT {_JUNKY_BRAND_SQL} AS brand FROM part) t
WHERE brand IS NOT NULL AND trim(brand) NOT IN ('', '-')
GROUP BY brand
""")
def present_filter(spark, d):
    p = table(spark, d, "part").select(_junky_brand().alias("brand"))
    return R.group_count(R.present(p, ["brand"]), ["brand"])


@register("exclude_include", """
SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total_balance
FROM customer
WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 5, 8, 13)
GROUP BY c_mktsegment, c_nationkey
""")
def exclude_include(spark, d):
    c = R.exclude(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    c = R.include(c, "c_nationkey", [1, 2, 3, 5, 8, 13])
    return c.groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total_balance"))


@register("like_filter", """
SELECT p_type, count(*) AS n FROM part WHERE p_name LIKE '%ring%' GROUP BY p_type
""")
def like_filter(spark, d):
    return R.group_count(R.like(table(spark, d, "part"), "p_name", "%ring%"), ["p_type"])


@register("pick_value", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem WHERE l_linenumber = 4 GROUP BY l_returnflag
""")
def pick_value(spark, d):
    li = R.at(table(spark, d, "lineitem"), "l_linenumber", 4)
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("l_quantity"), 2).alias("qty"))


# --------------------------------------------------------------------------
# PRJ3 / FN5: thousands-separated text
# --------------------------------------------------------------------------


@register("parse_number", """
SELECT o_orderpriority,
       count(CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM')
                  THEN 1 END) AS n_parsed,
       CAST(sum(CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM')
                     THEN CAST(floor(o_totalprice) AS BIGINT) END) AS BIGINT) AS total_parsed
FROM orders GROUP BY o_orderpriority
""")
def parse_number_q(spark, d):
    o = table(spark, d, "orders")
    text = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("-"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.format_number("o_totalprice", 2))
            .otherwise(F.format_number(F.floor("o_totalprice"), 0)))
    o = o.withColumn("amount_text", text).withColumn("amount", parse_number("amount_text"))
    return o.groupBy("o_orderpriority").agg(F.count("amount").alias("n_parsed"),
                                            F.sum("amount").alias("total_parsed"))


# --------------------------------------------------------------------------
# PRJ4 / SET1 / SET2
# --------------------------------------------------------------------------


@register("tag_union", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, count(*) AS n,
       CASE o_orderstatus WHEN 'F' THEN 'actual' ELSE 'forecast' END AS series_type
FROM orders GROUP BY 1, 3
""")
def tag_union(spark, d):
    o = table(spark, d, "orders")

    def monthly(rows):
        return (o.filter(rows)
                .groupBy(month_start("o_orderdate").alias("ds"))
                .agg(F.count(F.lit(1)).alias("n")))
    done = F.col("o_orderstatus").eqNullSafe(F.lit("F"))
    return R.stack_series(monthly(done), monthly(~done))


@register("union_missing", """
SELECT c_custkey AS entity_key, c_name AS entity_name, c_acctbal AS acctbal,
       c_mktsegment AS segment, NULL::INTEGER AS nationkey FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL::VARCHAR, s_nationkey FROM supplier
""")
def union_missing(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("entity_name"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("entity_key"), F.col("s_name").alias("entity_name"),
        F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
    return R.union_all(c, s)


# --------------------------------------------------------------------------
# PRJ1 and the scalar function families FN1-FN7
# --------------------------------------------------------------------------


@register("project", """
SELECT l_orderkey AS order_key, l_linenumber AS line,
       round(l_extendedprice * (1 - l_discount), 4) AS net_price, l_returnflag
FROM lineitem
""")
def project(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net_price"),
        "l_returnflag")


@register("fn_string", """
SELECT c_custkey,
       concat(c_name, ' (', c_mktsegment, ')') AS label,
       concat_ws('|', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS seg_nation,
       replace(c_name, 'Customer#', 'C-') AS short_name,
       trim('  ' || c_mktsegment || '  ') AS trimmed,
       lower(c_mktsegment) AS seg_lower, upper(lower(c_mktsegment)) AS seg_upper,
       substring(c_name, 10, 9) AS digits
FROM customer
""")
def fn_string(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey",
        F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("label"),
        F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("seg_nation"),
        F.replace("c_name", F.lit("Customer#"), F.lit("C-")).alias("short_name"),
        F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit("  "))).alias("trimmed"),
        F.lower("c_mktsegment").alias("seg_lower"),
        F.upper(F.lower("c_mktsegment")).alias("seg_upper"),
        F.substring("c_name", 10, 9).alias("digits"))


@register("fn_date", """
SELECT o_orderkey,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS due_ts,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due_date,
       concat(CAST(year(o_orderdate) AS VARCHAR), '-Q', CAST(quarter(o_orderdate) AS VARCHAR)) AS quarter_label,
       make_date(CAST(year(o_orderdate) AS INTEGER), CAST((quarter(o_orderdate) - 1) * 3 + 1 AS INTEGER), 1) AS quarter_start,
       strftime(o_orderdate, '%Y-%m') AS ym
FROM orders
""")
def fn_date(spark, d):
    o = table(spark, d, "orders")
    q = F.quarter("o_orderdate")
    return o.select(
        "o_orderkey",
        month_start("o_orderdate").alias("month"),
        F.date_add(F.to_date("o_orderdate"), 30).cast("timestamp_ntz").alias("due_ts"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), q.cast("string")).alias("quarter_label"),
        F.make_date(F.year("o_orderdate"), (q - 1) * 3 + 1, F.lit(1)).alias("quarter_start"),
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@register("fn_math", """
SELECT l_orderkey, l_linenumber,
       round(l_extendedprice * (1 - l_discount), 4) AS net,
       least(l_quantity, 25.0) AS qty_capped,
       greatest(l_discount, 0.05) AS disc_floor,
       round(l_tax / nullif(l_discount, 0), 6) AS tax_per_disc,
       round(ln(l_extendedprice), 6) AS ln_price,
       CAST(floor(l_quantity / 10) AS BIGINT) AS qty_bucket
FROM lineitem
""")
def fn_math(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
        F.least("l_quantity", F.lit(25.0)).alias("qty_capped"),
        F.greatest("l_discount", F.lit(0.05)).alias("disc_floor"),
        F.round(F.try_divide("l_tax", F.nullif("l_discount", F.lit(0.0))), 6).alias("tax_per_disc"),
        F.round(F.ln("l_extendedprice"), 6).alias("ln_price"),
        F.floor(F.col("l_quantity") / 10).cast("bigint").alias("qty_bucket"))


@register("fn_cond", """
SELECT o_orderkey,
       CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 50000 THEN 'mid'
            ELSE 'low' END AS price_band,
       coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'pending') AS status,
       (o_orderpriority IS NULL) AS missing_priority
FROM orders
""")
def fn_cond(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 200000, "high").when(F.col("o_totalprice") >= 50000, "mid")
        .otherwise("low").alias("price_band"),
        F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
                   F.lit("pending")).alias("status"),
        F.col("o_orderpriority").isNull().alias("missing_priority"))


@register("fn_cast", """
SELECT event_id,
       CAST(floor(value) AS BIGINT) AS value_floor,
       CAST(value AS VARCHAR) IS NOT NULL AS has_text,
       TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
       CASE WHEN regexp_full_match(event_type, '[0-9]+') THEN CAST(event_type AS INTEGER) END AS type_as_int,
       CAST(user_id AS DOUBLE) AS user_double
FROM events
""")
def fn_cast(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        F.floor("value").cast("bigint").alias("value_floor"),
        F.col("value").cast("string").isNotNull().alias("has_text"),
        try_number(F.regexp_extract("props", r"([0-9]+)", 1), "int").alias("k"),
        try_number("event_type", "int").alias("type_as_int"),
        F.col("user_id").cast("double").alias("user_double"))


@register("fn_array", """
WITH x AS (
  SELECT n_nationkey,
         [{'attr': 'name', 'val': n_name},
          {'attr': 'region', 'val': CAST(n_regionkey AS VARCHAR)}] AS arr
  FROM nation)
SELECT n_nationkey, u.attr AS attr, u.val AS val
FROM x, (SELECT unnest(arr, recursive := true)) u
""")
def fn_array(spark, d):
    n = table(spark, d, "nation")
    arr = F.array(F.struct(F.lit("name").alias("attr"), F.col("n_name").alias("val")),
                  F.struct(F.lit("region").alias("attr"),
                           F.col("n_regionkey").cast("string").alias("val")))
    return n.select("n_nationkey", F.inline(arr))


@register("fn_json", """
SELECT event_id,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       to_json({'type': event_type, 'k': CAST(json_extract(props, '$.k') AS INTEGER)}) AS doc
FROM events
""")
def fn_json(spark, d):
    e = table(spark, d, "events")
    k = F.from_json("props", "k INT")["k"]
    return e.select("event_id", k.alias("k"),
                    F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("doc"))


# --------------------------------------------------------------------------
# AGG
# --------------------------------------------------------------------------


@register("counter", """
SELECT count(*) AS n_lines, round(sum(l_quantity), 2) AS total_qty,
       round(avg(l_extendedprice), 2) AS avg_price
FROM lineitem
""")
def counter(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("n_lines"),
                  F.round(F.sum("l_quantity"), 2).alias("total_qty"),
                  F.round(F.avg("l_extendedprice"), 2).alias("avg_price"))


@register("profile", """
SELECT min(ts) AS min_value, max(ts) AS max_value, count(*) AS n_rows FROM events
""")
def profile(spark, d):
    return R.profile(table(spark, d, "events"), "ts")


@register("distinct_count", """
SELECT count(DISTINCT l_orderkey) AS n_distinct FROM lineitem
""")
def distinct_count(spark, d):
    return R.distinct_count(table(spark, d, "lineitem"), "l_orderkey")


@register("count_if", """
SELECT CAST(count_if(l_returnflag = 'R') AS BIGINT) AS n FROM lineitem
""")
def count_if(spark, d):
    return R.count_if(table(spark, d, "lineitem"), F.col("l_returnflag") == "R")


@register("group_count", """
SELECT p_type, count(*) AS n FROM part GROUP BY p_type
""")
def group_count(spark, d):
    return R.group_count(table(spark, d, "part"), ["p_type"])


def _messy_type():
    return (F.when(F.col("p_size") <= 5, F.lit(""))
            .when(F.col("p_size") == 6, F.lit(None).cast("string"))
            .when(F.col("p_size") == 7, F.lit("   "))
            .otherwise(F.concat(F.lit(" "), F.col("p_type"), F.lit(" "))))


@register("group_count_clean", """
WITH t AS (
  SELECT CASE WHEN p_size <= 5 THEN '' WHEN p_size = 6 THEN NULL WHEN p_size = 7 THEN '   '
              ELSE ' ' || p_type || ' ' END AS raw FROM part)
SELECT CASE WHEN coalesce(trim(raw), '') = '' THEN 'Unknown' ELSE trim(raw) END AS label,
       count(*) AS n
FROM t GROUP BY 1
""")
def group_count_clean(spark, d):
    p = table(spark, d, "part").select(_messy_type().alias("raw"))
    return R.group_count_clean(p, "raw")


@register("group_stats", """
SELECT event_type, round(avg(value), 4) AS avg_value, round(min(value), 4) AS min_value,
       round(max(value), 4) AS max_value
FROM events GROUP BY event_type
""")
def group_stats(spark, d):
    return R.group_stats(table(spark, d, "events"), ["event_type"], "value", digits=4)


@register("volatility", """
SELECT event_type, round(stddev_samp(value), 6) AS stddev_value FROM events GROUP BY event_type
""")
def volatility(spark, d):
    return R.group_stats(table(spark, d, "events"), ["event_type"], "value", digits=6,
                         stats=("stddev",))


@register("group_sum_having", """
SELECT l_suppkey, round(sum(l_quantity), 2) AS sum_l_quantity,
       round(sum(l_extendedprice), 2) AS sum_l_extendedprice
FROM lineitem GROUP BY l_suppkey
HAVING sum(l_extendedprice) > 0
ORDER BY sum_l_extendedprice DESC, l_suppkey ASC LIMIT 15
""")
def group_sum_having(spark, d):
    g = R.group_sum(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice"],
                    having="l_extendedprice")
    return R.top_k(g, [("sum_l_extendedprice", "desc"), ("l_suppkey", "asc")], 15)


@register("resample_month", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
       round(avg(o_totalprice), 4) AS avg_o_totalprice
FROM orders GROUP BY 1
""")
def resample_month(spark, d):
    return R.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "MONTH", "AVG",
                      digits=4)


def _nation_balances(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    bal = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("balance"))
    return R.lookup(bal, n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")


@register("rollup_text", """
WITH b AS (
  SELECT n_name, sum(c_acctbal) AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
top AS (SELECT * FROM b ORDER BY balance DESC, n_name ASC LIMIT 5)
SELECT string_agg(n_name || ': ' || CAST(CAST(round(balance, 2) AS DECIMAL(18, 2)) AS VARCHAR), '; '
                  ORDER BY balance DESC, n_name ASC) AS summary
FROM top
""")
def rollup_text(spark, d):
    b = _nation_balances(spark, d)
    text = F.concat("n_name", F.lit(": "),
                    F.round("balance", 2).cast("decimal(18,2)").cast("string"))
    return R.rollup_text(b, text, [("balance", "desc"), ("n_name", "asc")], k=5)


def _customer_regions(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name",
                                         "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    c = R.lookup(c, n, "c_nationkey")
    return R.lookup(c, r, "n_regionkey")


@register("share_scalar", """
SELECT round(sum(CASE WHEN r_name = 'ASIA' THEN c_acctbal END)
             / nullif(sum(c_acctbal), 0) * 100, 1) AS share_pct
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def share_scalar(spark, d):
    return R.share(_customer_regions(spark, d), F.col("r_name") == "ASIA", "c_acctbal")


@register("pct_of_total", """
WITH g AS (
  SELECT r_name, sum(c_acctbal) AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name)
SELECT r_name, round(balance, 2) AS balance,
       round(balance / sum(balance) OVER () * 100, 2) AS pct_of_total
FROM g
""")
def pct_of_total(spark, d):
    g = _customer_regions(spark, d).groupBy("r_name").agg(F.sum("c_acctbal").alias("balance"))
    return R.pct_of_total(g, "balance").withColumn("balance", F.round("balance", 2))


# --------------------------------------------------------------------------
# S1-S4
# --------------------------------------------------------------------------


@register("order_by", """
SELECT n_regionkey, n_name, n_nationkey FROM nation ORDER BY n_regionkey, n_name
""")
def order_by(spark, d):
    return R.order(table(spark, d, "nation").select("n_regionkey", "n_name", "n_nationkey"),
                   ["n_regionkey", "n_name"])


@register("top_k", """
SELECT c_custkey, c_name, c_acctbal FROM customer
ORDER BY c_acctbal DESC, c_custkey ASC LIMIT 10
""")
def top_k(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return R.top_k(c, [("c_acctbal", "desc"), ("c_custkey", "asc")], 10)


@register("latest_row", """
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def latest_row(spark, d):
    e = table(spark, d, "events")
    return R.latest_row(e, "ts", partition=["user_id"], tiebreak=["event_id"],
                        cols=["ts", "event_id", "event_type", "value"])


@register("latest_row_global", """
SELECT ts, event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1
""")
def latest_row_global(spark, d):
    e = table(spark, d, "events")
    return R.latest_row(e, "ts", tiebreak=["event_id"], cols=["ts", "event_id", "event_type", "value"])


@register("cap", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey ASC LIMIT 200
""")
def cap(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return R.cap(o, 200, [("o_orderdate", "desc"), ("o_orderkey", "asc")])


# --------------------------------------------------------------------------
# JN2
# --------------------------------------------------------------------------


@register("lookup", """
SELECT c_custkey, n_name, r_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def lookup(spark, d):
    return _customer_regions(spark, d).select("c_custkey", "n_name", "r_name")
