"""Chart-ready widget queries (WID1-WID5).

A widget is a dataset plus fields.  Non-aggregated fields are the group
keys; aggregated fields become measures; ``disaggregated=True`` returns the
raw projection (table / scatter widgets).  Output column names follow the
dashboard convention ``sum(value)``, ``month(ts)``, ``count(*)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.operators.relational import agg_expr


def measure_name(agg: str, column: str | None) -> str:
    if agg.upper() == "COUNT" and column in (None, "*"):
        return "count(*)"
    return f"{agg.lower()}({column})"


def axis(column: str, grain: str | None = None) -> tuple[str, Column]:
    """WID2: a plain field, or a time-grain bucket named ``grain(column)``."""
    if not grain:
        return column, F.col(column)
    return f"{grain.lower()}({column})", bucket(F.col(column).cast("timestamp_ntz"), grain)


def bucket(at: Column, grain: str) -> Column:
    """The start of the grain as a zone-free timestamp, from calendar fields only:
    no step goes through the session time zone, where an hour may be missing."""
    grain = grain.upper()
    day = F.to_date(at)
    if grain in ("HOUR", "MINUTE", "SECOND"):
        return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.hour(at),
                                    F.minute(at) if grain != "HOUR" else F.lit(0),
                                    F.floor(F.extract(F.lit("SECOND"), at)) if grain == "SECOND" else F.lit(0))
    return (day if grain == "DAY" else F.trunc(day, grain)).cast("timestamp_ntz")


def widget(df: DataFrame, x: str | None = None, y: Sequence[tuple[str, str | None]] = (),
           color: str | None = None, grain: str | None = None,
           filters: Sequence[Column] = (), disaggregated: bool = False,
           fields: Sequence[str] | None = None) -> DataFrame:
    """WID1/WID3/WID5: the rows a bar / line / pie / area / counter widget shows."""
    for f in filters:
        df = df.filter(f)
    if disaggregated:
        cols = list(fields) if fields else [c for c in [x, color] if c] + [c for _, c in y if c]
        return df.select(*cols)
    keys = []
    if x:
        name, c = axis(x, grain)
        keys.append(c.alias(name))
    if color:
        keys.append(F.col(color).alias(color))
    aggs = [agg_expr(a, c).alias(measure_name(a, c)) for a, c in y]
    return df.groupBy(*keys).agg(*aggs)


def filter_values(df: DataFrame, field: str, others: Sequence[Column] = ()) -> DataFrame:
    """WID4: each distinct value of a filter field, with how many rows also
    match the other active filters (``<field>_associativity``)."""
    pred = F.lit(True)
    for o in others:
        pred = pred & o
    return df.groupBy(field).agg(F.count_if(pred).alias(f"{field}_associativity"))


def filter_values_all(df: DataFrame, filters: Mapping[str, Column | None]) -> DataFrame:
    """WID4 for all filters at once: ``(field, value, associativity)``, values as text.

    ``filters`` gives each filter field its active condition, or None.  Every
    row gets a bit mask of the conditions that it meets; its fields are exploded once,
    and a value counts the rows that meet all conditions but its own field's.  One
    scan and one grouping, whatever the number of filters (60 at most).
    """
    active = {f: c for f, c in filters.items() if c is not None}
    bit = {f: 1 << i for i, f in enumerate(active)}
    full = (1 << len(active)) - 1
    mask = F.lit(0).cast("long")
    for f, c in active.items():
        mask = mask + F.when(c, F.lit(bit[f])).otherwise(F.lit(0))
    entries = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"),
                        (F.col("_mask").bitwiseOR(F.lit(bit.get(f, 0))) == full).alias("meets")) for f in filters]
    rows = df.withColumn("_mask", mask).select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    return rows.groupBy("field", "value").agg(F.count_if("meets").alias("associativity"))


def date_range(df: DataFrame, field: str, others: Sequence[Column] = ()) -> DataFrame:
    """WID4 (date picker): the field's min / max among rows matching the others."""
    pred = F.lit(True)
    for o in others:
        pred = pred & o
    return df.agg(F.min(F.when(pred, F.col(field))).alias(f"min({field})"),
                  F.max(F.when(pred, F.col(field))).alias(f"max({field})"))


# Per-kind helpers with the dashboard builder's field conventions.

def bar(df: DataFrame, x: str, y: str, agg: str = "SUM", color: str | None = None,
        filters: Sequence[Column] = ()) -> DataFrame:
    """Bar chart rows: ``x``, ``agg(y)`` (and ``color``)."""
    return widget(df, x=x, y=[(agg, y)], color=color, filters=filters)


def line(df: DataFrame, x: str, y: str, agg: str = "SUM", grain: str | None = None,
         color: str | None = None, filters: Sequence[Column] = ()) -> DataFrame:
    """Line / area chart rows, optionally bucketed by a time grain."""
    return widget(df, x=x, y=[(agg, y)], color=color, grain=grain, filters=filters)


area = line


def combo(df: DataFrame, x: str, ys: Sequence[tuple[str, str]], grain: str | None = None,
          filters: Sequence[Column] = ()) -> DataFrame:
    """Combo chart rows: several measures on one axis."""
    return widget(df, x=x, y=list(ys), grain=grain, filters=filters)


def pie(df: DataFrame, color: str, angle: str | None = None, agg: str = "COUNT",
        filters: Sequence[Column] = ()) -> DataFrame:
    """Pie rows: slice label and ``count(*)`` (or ``agg(angle)``)."""
    return widget(df, x=color, y=[(agg, "*" if agg.upper() == "COUNT" else angle)], filters=filters)


def counter(df: DataFrame, value: str | None = None, agg: str = "SUM",
            filters: Sequence[Column] = ()) -> DataFrame:
    """Counter (KPI tile): one row with ``agg(value)`` or ``count(*)``."""
    return widget(df, y=[(agg, "*" if agg.upper() == "COUNT" else value)], filters=filters)


def table(df: DataFrame, fields: Sequence[str], filters: Sequence[Column] = ()) -> DataFrame:
    """Table / scatter rows: the raw fields, not aggregated."""
    return widget(df, disaggregated=True, fields=fields, filters=filters)


scatter = table
