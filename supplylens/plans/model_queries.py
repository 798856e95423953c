"""Registered queries for the scenario curve, the quarter index, forecasts
and the merged chart series, run over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.functions.columns import month_start, truncate_to
from supplylens.operators import relational as R
from supplylens.operators.forecast import chart_series, chart_series_multi, forecast, quarter_index
from supplylens.operators.scenario import scenario
from supplylens.plans.registry import register, table

# --------------------------------------------------------------------------
# SCN1
# --------------------------------------------------------------------------


def _scenario_sql(bases_sql: str, key_cols: str = "") -> str:
    """DuckDB form of the scenario curve over a ``bases`` CTE (keys..., base)."""
    k = f"{key_cols}, " if key_cols else ""
    return f"""
WITH bases AS ({bases_sql}),
d AS (SELECT bases.*, CAST(g.day AS BIGINT) AS day FROM bases, range(0, 91) g(day)),
p AS (
  SELECT *,
    greatest(CASE WHEN day = 0 THEN base
                  WHEN day <= 3 THEN base + day * 15
                  WHEN day <= 14 THEN base + 45 + (day - 3) * 1.5::DOUBLE
                  WHEN day <= 30 THEN base + 61 - (day - 14) * 0.5::DOUBLE
                  ELSE base + 53 - (day - 30) * 0.3::DOUBLE END, base + 13) AS price,
    greatest(0.655::DOUBLE - least(day * 0.005::DOUBLE, 0.115::DOUBLE)
             + greatest(0.0::DOUBLE, (day - 30) * 0.001::DOUBLE), 0.54::DOUBLE) AS fx
  FROM d)
SELECT {k}CAST(DATE '2026-04-01' + CAST(day AS INTEGER) AS DATE) AS scenario_date,
       day AS day_number,
       CASE WHEN day = 0 THEN 'Pre-Crisis' WHEN day <= 3 THEN 'Shock' WHEN day <= 14 THEN 'Escalation'
            WHEN day <= 30 THEN 'SPR Release' ELSE 'Recovery' END AS phase,
       round_even(price, 2) AS brent_usd_bbl,
       round_even(fx, 4) AS aud_usd,
       round_even(175.0::DOUBLE + (price - base) * 0.9::DOUBLE
                  + ((0.655::DOUBLE - fx) / 0.655::DOUBLE) * 175.0::DOUBLE * 0.5::DOUBLE, 1) AS adelaide_ulp_cpl,
       round_even(greatest(67.0::DOUBLE - day * 0.75::DOUBLE, 15.0::DOUBLE), 1) AS iea_days_coverage,
       round_even(CASE WHEN day = 0 THEN 27.0::DOUBLE ELSE 27.0::DOUBLE - 3.2::DOUBLE END, 1) AS opec_supply_mbpd
FROM p
"""


@register("scenario", _scenario_sql(
    "SELECT coalesce(arg_max(value, (ts, value)), 82.0) AS base FROM events "
    "WHERE ts IS NOT NULL AND value IS NOT NULL"))
def scenario_q(spark, d):
    """One curve whose base is the latest observed event value."""
    return scenario(table(spark, d, "events"), "ts", "value")


_BRAND_DAILY_SQL = """
SELECT p_brand, CAST(l_shipdate AS DATE) AS day,
       avg(l_extendedprice / l_quantity) / 15.0 AS unit_price
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2
"""


@register("scenario_by_brand", _scenario_sql(
    f"SELECT p_brand, arg_max(unit_price, (day, unit_price)) AS base FROM ({_BRAND_DAILY_SQL}) t "
    "WHERE unit_price IS NOT NULL GROUP BY p_brand", "p_brand"))
def scenario_by_brand(spark, d):
    """One curve per part brand; base = the brand's latest daily unit price / 15."""
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # Join first: (part, day) is nearly unique per line, so pre-aggregating
    # on it would remove no rows and add a full shuffle.  The (brand, day)
    # aggregate after the join is partial-aggregated map-side, and AQE splits
    # a hot part's partition in the sort-merge join at scale.
    daily = (li.join(p, "l_partkey")
             .groupBy("p_brand", F.to_date("l_shipdate").alias("day"))
             .agg((F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 15.0).alias("unit_price")))
    return scenario(daily, "day", "unit_price", by=["p_brand"])


# --------------------------------------------------------------------------
# FC2
# --------------------------------------------------------------------------

_QUARTER_SRC_SQL = """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS year_text,
       CASE WHEN o_orderstatus = 'P' THEN 'Q?' ELSE 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) END AS quarter_text,
       CAST(o_totalprice AS VARCHAR) AS price_text,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS cust_text
FROM orders
"""


def _quarter_src(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.year("o_orderdate").cast("string").alias("year_text"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Q?"))
        .otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))).alias("quarter_text"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a"))
        .otherwise(F.col("o_custkey").cast("string")).alias("cust_text"))


@register("quarter_index", f"""
SELECT year_text || '-' || quarter_text AS period,
       CASE quarter_text WHEN 'Q1' THEN make_date(CAST(year_text AS INTEGER), 1, 1)
                         WHEN 'Q2' THEN make_date(CAST(year_text AS INTEGER), 4, 1)
                         WHEN 'Q3' THEN make_date(CAST(year_text AS INTEGER), 7, 1)
                         WHEN 'Q4' THEN make_date(CAST(year_text AS INTEGER), 10, 1) END AS ds,
       round(TRY_CAST(price_text AS DOUBLE), 2) AS price_text,
       TRY_CAST(cust_text AS DOUBLE) AS cust_text
FROM ({_QUARTER_SRC_SQL}) s
WHERE year_text IS NOT NULL AND quarter_text IS NOT NULL
""")
def quarter_index_q(spark, d):
    q = quarter_index(_quarter_src(spark, d), "year_text", "quarter_text", ["price_text", "cust_text"])
    return q.withColumn("price_text", F.round("price_text", 2))


# --------------------------------------------------------------------------
# FC1
# --------------------------------------------------------------------------


def _forecast_sql(src_sql: str, values: list[str], horizon: str, step: int = 1,
                  by: list[str] = (), digits: int = 2) -> str:
    """DuckDB form of :func:`supplylens.operators.forecast.forecast`."""
    by = list(by)
    bk = "".join(f"{b}, " for b in by)
    keys = by + ["series"]
    using = ", ".join(keys)
    per_year = 12 // step
    obs = " UNION ALL ".join(
        f"SELECT {bk}'{v}' AS series, CAST(ds AS DATE) AS ds, CAST({v} AS DOUBLE) AS y FROM src "
        f"WHERE {v} IS NOT NULL AND ds IS NOT NULL" for v in values)
    outs = ", ".join(
        f"round(max(CASE WHEN series = '{v}' THEN {x} END), {digits}) AS {v}_{s}"
        for v in values for x, s in (("f", "forecast"), ("u", "upper"), ("l", "lower")))
    return f"""
WITH src AS ({src_sql}),
obs AS ({obs}),
f0 AS (SELECT {using}, min(ds) AS first_ds FROM obs GROUP BY {using}),
o2 AS (SELECT obs.*, f0.first_ds,
              CAST(date_diff('month', f0.first_ds, obs.ds) AS DOUBLE) / {step} AS t,
              (month(obs.ds) - 1) // {step} AS pos
       FROM obs JOIN f0 USING ({using})),
fit AS (SELECT {using}, coalesce(regr_slope(y, t), 0.0) AS slope,
               coalesce(regr_intercept(y, t), avg(y)) AS intercept,
               max(t) AS last_t, min(first_ds) AS first_ds, max(ds) AS last_ds
        FROM o2 GROUP BY {using}),
res AS (SELECT o2.*, y - (fit.intercept + fit.slope * o2.t) AS r, fit.last_t
        FROM o2 JOIN fit USING ({using})),
sea AS (SELECT {using}, pos, avg(r) AS season_raw FROM res GROUP BY {using}, pos),
sig AS (SELECT {", ".join("res." + k for k in keys)},
               coalesce(stddev_samp(r - CASE WHEN res.last_t >= {2 * per_year - 1} THEN sea.season_raw ELSE 0.0 END), 0.0) AS sigma
        FROM res JOIN sea USING ({using}, pos) GROUP BY {", ".join("res." + k for k in keys)}),
fut AS (SELECT fit.*, sig.sigma,
               CAST(unnest(generate_series(CAST(fit.last_ds + INTERVAL {step} MONTH AS TIMESTAMP),
                                           CAST(DATE '{horizon}' - INTERVAL 1 DAY AS TIMESTAMP),
                                           INTERVAL {step} MONTH)) AS DATE) AS ds
        FROM fit JOIN sig USING ({using})),
fut2 AS (SELECT fut.*, CAST(date_diff('month', fut.first_ds, fut.ds) AS DOUBLE) / {step} AS t,
                (month(fut.ds) - 1) // {step} AS pos FROM fut),
pred AS (SELECT fut2.*, fut2.intercept + fut2.slope * fut2.t
                 + coalesce(CASE WHEN fut2.last_t >= {2 * per_year - 1} THEN sea.season_raw ELSE 0.0 END, 0.0) AS f
         FROM fut2 LEFT JOIN sea USING ({using}, pos)),
b AS (SELECT *, f + {1.96} * sigma AS u, f - {1.96} * sigma AS l FROM pred)
SELECT {bk}ds, {outs} FROM b GROUP BY {bk}ds
"""


_MONTHLY_REVENUE_SQL = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, sum(o_totalprice) AS revenue
FROM orders GROUP BY 1
"""


def _monthly_revenue(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(month_start("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("revenue"))


@register("forecast_single", _forecast_sql(_MONTHLY_REVENUE_SQL, ["revenue"], "2003-01-01"))
def forecast_single(spark, d):
    return forecast(_monthly_revenue(spark, d), "ds", "revenue", "2003-01-01", "MONTH")


_QUARTERLY_SQL = """
SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ds,
       sum(o_totalprice) AS revenue, CAST(count(*) AS DOUBLE) AS n_orders
FROM orders GROUP BY 1
"""


@register("forecast_multi", _forecast_sql(_QUARTERLY_SQL, ["revenue", "n_orders"], "2004-01-01", step=3))
def forecast_multi(spark, d):
    o = table(spark, d, "orders")
    q = o.groupBy(truncate_to("o_orderdate", "QUARTER").alias("ds")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    return forecast(q, "ds", ["revenue", "n_orders"], "2004-01-01", "QUARTER")


_MONTHLY_BY_PRIORITY_SQL = """
SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
       sum(o_totalprice) AS revenue
FROM orders GROUP BY 1, 2
"""


@register("forecast_by_key", _forecast_sql(_MONTHLY_BY_PRIORITY_SQL, ["revenue"], "2002-07-01",
                                           by=["o_orderpriority"]))
def forecast_by_key(spark, d):
    o = table(spark, d, "orders")
    m = o.groupBy("o_orderpriority", month_start("o_orderdate").alias("ds")).agg(
        F.sum("o_totalprice").alias("revenue"))
    return forecast(m, "ds", "revenue", "2002-07-01", "MONTH", by=["o_orderpriority"])


# --------------------------------------------------------------------------
# JN1 / WIN2 / FC3
# --------------------------------------------------------------------------

_ACTUAL_SQL = "SELECT ds, round(revenue, 2) AS actual FROM monthly"
_FC_SQL = _forecast_sql(_MONTHLY_REVENUE_SQL, ["revenue"], "2003-01-01")


def _merge_sql(tail: str) -> str:
    return f"""
WITH monthly AS ({_MONTHLY_REVENUE_SQL}),
fc AS ({_FC_SQL}),
m AS (SELECT coalesce(a.ds, fc.ds) AS ds, a.actual, fc.revenue_forecast, fc.revenue_upper,
             fc.revenue_lower
      FROM ({_ACTUAL_SQL}) a FULL OUTER JOIN fc ON a.ds = fc.ds)
{tail}
"""


def _merged(spark, d):
    actual = _monthly_revenue(spark, d).select("ds", F.round("revenue", 2).alias("actual"))
    fc = forecast(_monthly_revenue(spark, d), "ds", "revenue", "2003-01-01", "MONTH")
    return actual, fc


@register("merge_series", _merge_sql("SELECT * FROM m"))
def merge_series_q(spark, d):
    actual, fc = _merged(spark, d)
    return R.merge_series(actual, fc, "ds")


_BRIDGE_TAIL = """SELECT ds, actual,
       CASE WHEN ds = (SELECT max(ds) FROM m WHERE actual IS NOT NULL) THEN actual
            ELSE revenue_forecast END AS revenue_forecast,
       revenue_upper, revenue_lower
FROM m"""


@register("bridge", _merge_sql(_BRIDGE_TAIL))
def bridge_q(spark, d):
    actual, fc = _merged(spark, d)
    last = actual.filter(F.col("actual").isNotNull()).select(F.max("ds")).scalar()
    return R.bridge(R.merge_series(actual, fc, "ds"), "actual", "revenue_forecast", "ds", last=last)


@register("chart_series", _merge_sql(
    f"SELECT * FROM ({_BRIDGE_TAIL}) b WHERE ds >= DATE '1999-01-01'"))
def chart_series_q(spark, d):
    actual, fc = _merged(spark, d)
    return chart_series(actual, fc, "actual", "revenue_forecast", "ds", start="1999-01-01")


_QUARTERLY_BY_PRIORITY_SQL = """
SELECT o_orderpriority, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ds,
       sum(o_totalprice) AS revenue, CAST(count(*) AS DOUBLE) AS n_orders
FROM orders GROUP BY 1, 2
"""


def _multi_sql() -> str:
    fc = _forecast_sql(_QUARTERLY_BY_PRIORITY_SQL, ["revenue", "n_orders"], "2003-01-01", step=3, by=["o_orderpriority"])
    one = """
SELECT coalesce(q.o_orderpriority, fc.o_orderpriority) AS o_orderpriority, '{name}' AS series, coalesce(q.ds, fc.ds) AS ds,
       CAST({col} AS DOUBLE) AS actual,
       CASE WHEN q.ds = (SELECT max(x.ds) FROM q x WHERE x.o_orderpriority = q.o_orderpriority) THEN {col}
            ELSE {col}_forecast END AS forecast, {col}_upper AS upper, {col}_lower AS lower
FROM q FULL OUTER JOIN fc ON q.ds = fc.ds AND q.o_orderpriority = fc.o_orderpriority"""
    return f"""
WITH q AS ({_QUARTERLY_BY_PRIORITY_SQL}), fc AS ({fc}),
c AS ({one.format(name="Revenue", col="revenue")} UNION ALL {one.format(name="Orders", col="n_orders")})
SELECT o_orderpriority, series, ds, round(actual, 2) AS actual, round(forecast, 2) AS forecast, upper, lower
FROM c WHERE ds >= DATE '1996-01-01'
"""


@register("chart_series_multi", _multi_sql())
def chart_series_multi_q(spark, d):
    """Actuals, forecasts and bounds of two measures per priority from one scan of the orders."""
    q = table(spark, d, "orders").groupBy("o_orderpriority", truncate_to("o_orderdate", "QUARTER").alias("ds")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    fc = forecast(q, "ds", ["revenue", "n_orders"], "2003-01-01", "QUARTER", by=["o_orderpriority"])
    pairs = {"Revenue": ("revenue", "revenue_forecast"), "Orders": ("n_orders", "n_orders_forecast")}
    out = chart_series_multi(q, fc, pairs, by=["o_orderpriority"], start="1996-01-01")
    return out.withColumns({c: F.round(c, 2) for c in ("actual", "forecast")})
