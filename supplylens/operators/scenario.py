"""What-if scenario curve (SCN1).

For every key, the latest observed value is the base; each key gets one row
per day of the horizon with a piecewise price path, exchange rate, pump
price, reserve days, supply and phase label.  All keys x days are one job:
a per-key ``max_by`` aggregate (partial-aggregated, skew-safe), then
``explode(sequence(0, days-1))`` and column arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scenario model (must equal the reference's curve).
# Price path: day 0 base; days 1-3 +15/day; days 4-14 +45 then +1.5/day;
# days 15-30 +61 then -0.5/day; later +53 then -0.3/day; never below base+13.
# Exchange rate: 0.655 minus 0.005/day (at most 0.115) plus 0.001/day after
# day 30, floor 0.54.  Pump price: 175 + 0.9 x price rise + half of 175 x the
# relative currency fall.  Reserve days: 67 - 0.75/day, floor 15.  Supply:
# 27.0 on day 0, 27.0 - 3.2 after.  Phases: Pre-Crisis (0), Shock (1-3),
# Escalation (4-14), SPR Release (15-30), Recovery (31+).
# Fallback base when no observation exists: 82.0.  Start date 2026-04-01.
FALLBACK_BASE = 82.0
START_DATE = "2026-04-01"
DAYS = 91
PUMP_BASE = 175.0
FX_START = 0.655
FX_FLOOR = 0.54
RESERVE_START = 67.0
RESERVE_FLOOR = 15.0
SUPPLY_START = 27.0
SUPPLY_DROP = 3.2


def price_path(base: Column, day: Column) -> Column:
    raw = (F.when(day == 0, base)
           .when(day <= 3, base + day * 15)
           .when(day <= 14, base + 45 + (day - 3) * 1.5)
           .when(day <= 30, base + 61 - (day - 14) * 0.5)
           .otherwise(base + 53 - (day - 30) * 0.3))
    return F.greatest(raw, base + 13)


def fx_path(day: Column) -> Column:
    fx = (F.lit(FX_START) - F.least(day * 0.005, F.lit(0.115))
          + F.greatest(F.lit(0.0), (day - 30) * 0.001))
    return F.greatest(fx, F.lit(FX_FLOOR))


def pump_price(price: Column, base: Column, fx: Column) -> Column:
    return (F.lit(PUMP_BASE) + (price - base) * 0.9
            + ((F.lit(FX_START) - fx) / FX_START) * PUMP_BASE * 0.5)


def reserve_days(day: Column) -> Column:
    return F.greatest(F.lit(RESERVE_START) - day * 0.75, F.lit(RESERVE_FLOOR))


def supply(day: Column) -> Column:
    return F.when(day == 0, F.lit(SUPPLY_START)).otherwise(F.lit(SUPPLY_START - SUPPLY_DROP))


def phase(day: Column) -> Column:
    return (F.when(day == 0, "Pre-Crisis").when(day <= 3, "Shock")
            .when(day <= 14, "Escalation").when(day <= 30, "SPR Release")
            .otherwise("Recovery"))


def latest_base(df: DataFrame, ts: str, value: str, by: Sequence[str] = (),
                fallback: float | None = FALLBACK_BASE) -> DataFrame:
    """Per key, the value at the greatest ``ts`` (ties: the larger value).

    Without keys the result is a one-row global aggregate, so an empty input
    still yields the fallback base.
    """
    src = df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
    pick = F.max_by(F.col(value), F.struct(F.col(ts), F.col(value)))
    if by:
        return src.groupBy(*by).agg(pick.cast("double").alias("base"))
    b = pick.cast("double")
    if fallback is not None:
        b = F.coalesce(b, F.lit(float(fallback)))
    return src.agg(b.alias("base"))


def project_days(bases: DataFrame, days: int = DAYS, start: str = START_DATE,
                 half_even: bool = True) -> DataFrame:
    """Expand a ``base`` per key to the day-by-day scenario rows."""
    rnd = F.bround if half_even else F.round
    day = F.col("day_number")
    base = F.col("base")
    rows = bases.withColumn("day_number", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    price = price_path(base, day)
    fx = fx_path(day)
    return (rows.select(
        *[c for c in bases.columns if c != "base"],
        F.date_add(F.to_date(F.lit(start)), day).alias("scenario_date"),
        day.cast("bigint").alias("day_number"),
        phase(day).alias("phase"),
        rnd(price, 2).alias("brent_usd_bbl"),
        rnd(fx, 4).alias("aud_usd"),
        rnd(pump_price(price, base, fx), 1).alias("adelaide_ulp_cpl"),
        rnd(reserve_days(day), 1).alias("iea_days_coverage"),
        rnd(supply(day), 1).alias("opec_supply_mbpd")))


def scenario(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), days: int = DAYS,
             start: str = START_DATE, fallback: float | None = FALLBACK_BASE) -> DataFrame:
    """SCN1: one scenario curve per key, based on each key's latest value."""
    return project_days(latest_base(df, ts, value, by, fallback), days, start)
