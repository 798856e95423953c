"""Trend + season forecast with bounds (FC1), quarter index (FC2) and the
chart series that merges actuals with a forecast (FC3).

Method (closed form, fully distributed):
* every value column of every key is one series; ``t`` counts periods
  since the series' first period;
* per series, the least-squares line of ``y`` on ``t``;
* the seasonal term is the mean residual by position in the year (month
  or quarter), used only when the series spans at least two years;
* ``sigma`` is the sample stddev of the residuals left after the season;
* future periods run from the period after the last observation up to the
  horizon (exclusive); forecast = trend + season, bounds = +-1.96 sigma.

The observations are read once.  One grouped aggregate gives centred moments
(count, means, variances, covariance) per series and position in the year;
they merge, so a huge series costs a row per task and position before the
shuffle.  Line, season and sigma of a series all follow from its at most
12 moments, and nothing is joined back to the observations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplylens.functions.columns import quarter_label, quarter_start, to_double
from supplylens.operators.relational import bridge, merge_series, since

Z_95 = 1.96
_PERIOD_MONTHS = {"MONTH": 1, "QUARTER": 3}
# Period index origin; the fitted line does not depend on it.
EPOCH = "2000-01-01"


def _long(df: DataFrame, time: str, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., series, ds, y) with one row per observed value."""
    arr = F.array(*[F.struct(F.lit(v).alias("series"), F.col(v).cast("double").alias("y"))
                    for v in values])
    return (df.select(*by, F.to_date(F.col(time)).alias("ds"), F.explode(arr).alias("_s"))
            .select(*by, "_s.series", "ds", "_s.y")
            .filter(F.col("y").isNotNull() & F.col("ds").isNotNull()))


def forecast(df: DataFrame, time: str, values: str | Sequence[str], horizon: str,
             grain: str = "MONTH", by: Sequence[str] = (), digits: int | None = 2,
             z: float = Z_95, season: bool | str = "auto") -> DataFrame:
    """FC1: ``(by..., ds, {v}_forecast, {v}_upper, {v}_lower)`` per value column.

    ``df`` holds one row per period (per key); the period key is ``time``
    truncated to the grain by the caller.  ``season``: True, False, or
    "auto", which fits one where a series covers two whole years.

    Plan: one aggregate per series and position in the year, one per series
    over those.  With b the slope, a position's mean residual is its mean of y less the
    line at its mean of t, and the residuals' spread within it is
    n (var y - 2 b cov + b^2 var t); sigma without a season adds the spread between positions.
    """
    values = [values] if isinstance(values, str) else list(values)
    grain = grain.upper()
    step = _PERIOD_MONTHS[grain]
    per_year = 12 // step
    keys = list(by) + ["series"]

    def t_of(c):
        return F.months_between(c, F.to_date(F.lit(EPOCH))) / step

    def pos_of(c):
        return ((F.month(c) - 1) / step).cast("int")

    obs = _long(df, time, values, by).withColumns({"t": t_of(F.col("ds")), "pos": pos_of(F.col("ds"))})
    by_pos = obs.groupBy(*keys, "pos").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("t").alias("mt"), F.avg("y").alias("my"),
        F.var_pop("t").alias("vt"), F.covar_pop("t", "y").alias("c"), F.var_pop("y").alias("vy"),
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("ds").alias("last"))
    # at most 12 moments a series
    ser = by_pos.groupBy(*keys).agg(
        F.collect_list(F.struct("pos", "n", "mt", "my", "vt", "c", "vy")).alias("m"), F.sum("n").alias("N"),
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("last").alias("last_ds"))
    ser = ser.withColumns({"T": _over("m", lambda x: x["n"] * x["mt"]) / F.col("N"),
                           "Y": _over("m", lambda x: x["n"] * x["my"]) / F.col("N")})

    def apart(x: Column) -> Column:
        return x["mt"] - F.col("T")

    ser = ser.withColumns({"sxx": _over("m", lambda x: x["n"] * (x["vt"] + apart(x) * apart(x))),
                           "sxy": _over("m", lambda x: x["n"] * (x["c"] + apart(x) * (x["my"] - F.col("Y"))))})
    # a one-point series has no fitted line: hold its mean flat
    ser = ser.withColumn("slope", F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(F.lit(0.0)))
    ser = ser.withColumn("intercept", F.col("Y") - F.col("slope") * F.col("T"))

    def residual(x: Column) -> Column:
        return x["my"] - F.col("intercept") - F.col("slope") * x["mt"]

    b = F.col("slope")
    ser = ser.withColumns({
        "S1": _over("m", lambda x: x["n"] * residual(x)), "SSB": _over("m", lambda x: x["n"] * residual(x) * residual(x)),
        "SSW": _over("m", lambda x: x["n"] * F.greatest(x["vy"] - 2 * b * x["c"] + b * b * x["vt"], F.lit(0.0))),
        "season_map": F.map_from_entries(F.transform("m", lambda x: F.struct(x["pos"], residual(x))))})
    use_season = ((F.col("t1") - F.col("t0")) >= F.lit(2 * per_year - 1)) if season == "auto" else F.lit(bool(season))
    var = F.when(use_season, F.col("SSW")).otherwise(
        F.col("SSW") + F.col("SSB") - F.col("S1") * F.col("S1") / F.col("N")) / (F.col("N") - 1)
    ser = ser.withColumn("sigma", F.when(F.col("N") > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
                         .otherwise(F.lit(0.0)))

    nxt = F.add_months("last_ds", step)
    end = F.date_sub(F.to_date(F.lit(horizon)), 1)
    periods = F.when(nxt <= end, F.sequence(nxt, end, F.expr(f"INTERVAL {step} MONTH")))
    fut = ser.withColumn("ds", F.explode(periods))
    at_season = F.when(use_season, F.coalesce(F.try_element_at("season_map", pos_of(F.col("ds"))),
                                           F.lit(0.0))).otherwise(F.lit(0.0))
    yhat = F.col("intercept") + F.col("slope") * t_of(F.col("ds")) + at_season
    fut = fut.select(*keys, "ds", yhat.alias("f"), (yhat + z * F.col("sigma")).alias("u"),
                     (yhat - z * F.col("sigma")).alias("l"))

    def r(c):
        return F.round(c, digits) if digits is not None else c

    return fut.groupBy(*by, "ds").agg(*[
        r(F.max(F.when(F.col("series") == v, F.col(x)))).alias(f"{v}_{suffix}")
        for v in values for x, suffix in (("f", "forecast"), ("u", "upper"), ("l", "lower"))])


def _over(moments: str, value) -> Column:
    """The sum of ``value`` over a series' moments."""
    return F.aggregate(F.transform(moments, value), F.lit(0.0), lambda acc, x: acc + x)


def quarter_index(df: DataFrame, year: str, quarter: str, values: Sequence[str]) -> DataFrame:
    """FC2: (period 'YYYY-Qn', ds first day of quarter, values as double).

    Rows without a year or quarter are skipped; an unknown quarter label
    gives a NULL ds rather than an error.
    """
    return (df.filter(F.col(year).isNotNull() & F.col(quarter).isNotNull())
            .select(quarter_label(year, quarter).alias("period"),
                    quarter_start(year, quarter).alias("ds"),
                    *[to_double(v).alias(v) for v in values]))


def chart_series(actual: DataFrame, fc: DataFrame, actual_col: str, forecast_col: str,
                 on: str = "ds", start: str | None = None) -> DataFrame:
    """FC3: actual and forecast merged on the date key, bridged on the last
    actual point, and cut to the rows from ``start`` on."""
    last = actual.filter(F.col(actual_col).isNotNull()).select(F.max(on)).scalar()
    merged = bridge(merge_series(actual, fc, on), actual_col, forecast_col, on, last=last)
    return since(merged, on, start) if start else merged


def chart_series_multi(actual: DataFrame, fc: DataFrame, pairs: Mapping[str, tuple[str, str]], on: str = "ds",
                       by: Sequence[str] = (), bounds: tuple[str, str] | None = ("_upper", "_lower"),
                       start: str | None = None) -> DataFrame:
    """FC3 + JN1 + WIN2 for many series at once: ``(by..., series, on, actual, forecast[, upper, lower])``.

    ``pairs`` maps a series' name to its actual column and its forecast
    column; ``bounds`` are the endings that replace ``_forecast`` in the names of the bound columns.
    Both frames are stacked into long rows and merged by one grouped
    conditional maximum, not by a full outer join.  On the last period with an actual value
    of a series (and key), found in a window over that series' periods, the
    forecast is the actual value, so that the lines meet.  Rows without any value, or without a period, are left out.
    """
    parts = ["actual", "forecast", *(("upper", "lower") if bounds else ())]

    def column(frame: DataFrame, name: str | None) -> Column:
        return F.col(name).cast("double") if name is not None and name in frame.columns else F.lit(None).cast("double")

    def long(frame: DataFrame, is_actual: bool) -> DataFrame:
        rows = []
        for series, (a, f) in pairs.items():
            names = [a, None, None, None] if is_actual else [
                None, f, *(f.removesuffix("_forecast") + ending for ending in bounds or ())]
            rows.append(F.struct(F.lit(series).alias("series"), *[column(frame, n).alias(p) for p, n in zip(parts, names)]))
        # the same filter as in forecast(), so that a shared source is read once
        return (frame.filter(F.col(on).isNotNull()).select(*by, F.col(on), F.explode(F.array(*rows)).alias("_s"))
                .select(*by, on, "_s.*"))

    stacked = long(actual, True).unionByName(long(fc, False))
    merged = stacked.groupBy(*by, "series", on).agg(*[F.max(p).alias(p) for p in parts])
    merged = merged.filter(F.coalesce(*[F.col(p) for p in parts]).isNotNull())
    last = F.max(F.when(F.col("actual").isNotNull(), F.col(on))).over(Window.partitionBy(*by, "series"))
    out = merged.withColumn("_last", last).withColumn(
        "forecast", F.when(F.col(on) == F.col("_last"), F.col("actual")).otherwise(F.col("forecast"))).drop("_last")
    return since(out, on, start) if start else out
