"""Relational building blocks (PRJ, FLT, JN, AGG, WIN, S, SET).

Design notes for scale:
* "Latest period" and "trailing window" compare against a global MAX.  That
  MAX is a scalar subquery: one partial+final aggregate, then a filter on
  the scan.  It never pulls rows into one task.
* Totals are combined with rows by joining a one-row aggregate.  A global
  aggregate has exactly one row, so broadcasting it is size-safe.  Per-key
  totals are a grouped aggregate (map-side combined, so a hot key costs one
  row per task) joined back on the key; Spark/AQE pick broadcast or
  sort-merge from the runtime size, and AQE splits a skewed partition.
* Top-k is ``orderBy().limit()``, planned as TakeOrderedAndProject: each task
  keeps k rows, the driver merges k x tasks rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplylens.functions.columns import (
    clean_label, is_present, order_cols, order_sql, truncate_to,
)

# --------------------------------------------------------------------------
# projections (PRJ)
# --------------------------------------------------------------------------


def rounded(df: DataFrame, spec: Mapping[str, int], half_even: bool = False) -> DataFrame:
    """PRJ2: round named columns in place (half-up, or half-even)."""
    fn = F.bround if half_even else F.round
    return df.withColumns({c: fn(F.col(c), n) for c, n in spec.items()})


def tag(df: DataFrame, column: str, value) -> DataFrame:
    """PRJ4: add a literal label column."""
    return df.withColumn(column, F.lit(value))


# --------------------------------------------------------------------------
# filters (FLT)
# --------------------------------------------------------------------------


def present(df: DataFrame, cols: Iterable[str], junk: Iterable[str] = ("", "-")) -> DataFrame:
    """FLT2: keep rows whose columns are all present (not NULL / blank / '-')."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & is_present(c, junk)
    return df.filter(cond)


def exclude(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """FLT3: drop rows whose column is in a list (NULLs are kept out too)."""
    return df.filter(~F.col(column).isin(list(values)))


def include(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """FLT4: keep rows whose column is in a list."""
    return df.filter(F.col(column).isin(list(values)))


def like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """FLT5: SQL LIKE pattern filter."""
    return df.filter(F.col(column).like(pattern))


def since(df: DataFrame, column: str, start: str) -> DataFrame:
    """FLT6: lower time bound from a literal (inclusive)."""
    return df.filter(F.col(column) >= F.to_timestamp(F.lit(start)))


def global_max(df: DataFrame, column: str) -> Column:
    """Scalar subquery: MAX(column) over the whole DataFrame."""
    return df.select(F.max(column)).scalar()


def _literal_like(df: DataFrame, column: str, text: str) -> Column:
    """A literal of ``column``'s own type, parsed by Spark (session-zone safe)."""
    return F.lit(text).cast(df.schema[column].dataType)


def trailing(df: DataFrame, column: str, days: int, prune: bool = False) -> DataFrame:
    """FLT7: rows within ``days`` of the data's own MAX(column), inclusive.

    With ``prune`` the MAX is evaluated first (one aggregate, one value to
    the driver) and the bound becomes a literal, so the filter is pushed into
    the parquet scan and skips row groups / partitions outside the window.
    """
    if not prune:
        bound = global_max(df, column) - F.make_dt_interval(F.lit(days))
        return df.filter(F.col(column) >= bound)
    b = df.agg((F.max(column) - F.make_dt_interval(F.lit(days))).cast("string")).first()[0]
    if b is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(column) >= _literal_like(df, column, b))


def latest(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """FLT8: rows at the global MAX(column).

    With ``by``, rows at each key's own MAX(column) instead (so a series
    that lacks the global latest period keeps its own latest rows).  The
    per-key maxima are a grouped aggregate (one row per key after partial
    aggregation) semi-joined back on ``(by..., column)``.
    """
    if not by:
        return df.filter(F.col(column) == global_max(df, column))
    tops = df.groupBy(*by).agg(F.max(column).alias(column))
    return join_on_keys(df, tops, [*by, column], "left_semi")


_NEXT = {"DAY": lambda d: F.date_add(d, 1), "WEEK": lambda d: F.date_add(d, 7),
         "MONTH": lambda d: F.add_months(d, 1), "QUARTER": lambda d: F.add_months(d, 3),
         "YEAR": lambda d: F.add_months(d, 12)}


def latest_period(df: DataFrame, column: str, unit: str = "MONTH") -> DataFrame:
    """FLT8 on a stored time column: rows in the calendar period (day, week,
    month, quarter, year) that holds the data's MAX(column).

    Same rows as ``latest`` on a truncated period column, but the MAX is
    evaluated first and the period becomes a literal half-open range on the
    stored column, so Catalyst pushes it into the scan (row-group and
    partition pruning).  The scalar subquery form cannot be pushed down.
    """
    u = unit.upper()
    start = truncate_to(F.max(column), u)
    row = df.agg(start.cast("string").alias("a"), _NEXT[u](start).cast("string").alias("b")).first()
    if row.a is None:
        return df.filter(F.lit(False))
    c = F.col(column)
    return df.filter((c >= _literal_like(df, column, row.a)) & (c < _literal_like(df, column, row.b)))


def at(df: DataFrame, column: str, value) -> DataFrame:
    """FLT9: pick rows where column equals a value."""
    return df.filter(F.col(column) == F.lit(value))


# --------------------------------------------------------------------------
# joins (JN)
# --------------------------------------------------------------------------


def lookup(df: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """JN2: code -> name dimension lookup.

    By default the join strategy is Spark's: a dimension read from files has
    size statistics, and Catalyst broadcasts it only under
    ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime).
    """
    return df.join(dim, on=on, how=how)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``<=>``), as SQL
    grouping treats NULL as one group.  ``right``'s key columns are renamed
    first, so a side derived from ``left`` joins back without ambiguity.
    """
    keys = list(keys)
    tmp = {k: f"__k{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(tmp)
    cond = [left[k].eqNullSafe(r[tmp[k]]) for k in keys]
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*tmp.values())


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """JN3: attach the columns of a one-row aggregate to every row.

    A scalar subquery, not a join: a frame of more than one row is an error
    when the query runs, so nothing larger is ever sent around.  Without a row
    the columns are NULL.
    """
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumns({c: row[c] for c in one_row.columns})


def merge_series(actual: DataFrame, forecast: DataFrame, on: str = "ds") -> DataFrame:
    """JN1: full-outer merge on a date key; the absent side is NULL."""
    return actual.join(forecast, on=on, how="full_outer")


# --------------------------------------------------------------------------
# aggregates (AGG)
# --------------------------------------------------------------------------

_AGG = {
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max,
    "COUNT": F.count, "STDDEV": F.stddev_samp, "COUNT_DISTINCT": F.count_distinct,
}


def agg_expr(agg: str, column: str | None) -> Column:
    agg = agg.upper()
    if agg == "COUNT" and (column in (None, "*")):
        return F.count(F.lit(1))
    return _AGG[agg](F.col(column))


def counter(df: DataFrame, column: str | None = None, agg: str = "COUNT",
            name: str = "value") -> DataFrame:
    """AGG1: one-row count / sum / avg."""
    return df.agg(agg_expr(agg, column).alias(name))


def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """AGG2: rows per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def group_stats(df: DataFrame, keys: Sequence[str], column: str, digits: int | None = 2,
                stats: Sequence[str] = ("avg", "min", "max")) -> DataFrame:
    """AGG3: average / min / max of a column per group, rounded."""
    fns = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum,
           "stddev": F.stddev_samp, "count": F.count}
    exprs = []
    for s in stats:
        e = fns[s](F.col(column))
        if digits is not None and s not in ("count",):
            e = F.round(e, digits)
        exprs.append(e.alias(f"{s}_{column}"))
    return df.groupBy(*keys).agg(*exprs)


def group_sum(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
              having: str | None = None, digits: int | None = 2) -> DataFrame:
    """AGG4: several sums per group, with an optional ``HAVING sum > 0`` on the
    unrounded sum; rounding comes last."""
    out = df.groupBy(*keys).agg(*[F.sum(F.col(c)).alias(f"sum_{c}") for c in cols])
    if having:
        out = out.filter(F.col(f"sum_{having}") > 0)
    if digits is not None:
        out = out.withColumns({f"sum_{c}": F.round(f"sum_{c}", digits) for c in cols})
    return out


def group_count_clean(df: DataFrame, column: str, name: str = "label",
                      blank: str = "Unknown") -> DataFrame:
    """AGG5: count per cleaned label (NULL / blank -> ``Unknown``)."""
    return (df.select(clean_label(column, blank).alias(name))
            .groupBy(name).agg(F.count(F.lit(1)).alias("n")))


def resample(df: DataFrame, ts: str, value: str, unit: str = "MONTH",
             agg: str = "AVG", by: Sequence[str] = (), name: str = "ds",
             digits: int | None = 2) -> DataFrame:
    """AGG6: calendar roll-up of a value (date key kept as DATE)."""
    e = agg_expr(agg, value)
    if digits is not None:
        e = F.round(e, digits)
    return (df.groupBy(*by, truncate_to(ts, unit).alias(name))
            .agg(e.alias(f"{agg.lower()}_{value}")))


def distinct_count(df: DataFrame, column: str, name: str = "n_distinct") -> DataFrame:
    """AGG8: exact distinct count (two-phase aggregate on the key)."""
    return df.agg(F.count_distinct(F.col(column)).alias(name))


def count_if(df: DataFrame, pred: Column, name: str = "n") -> DataFrame:
    """AGG9: conditional count."""
    return df.agg(F.count_if(pred).alias(name))


def rollup_text(df: DataFrame, text: Column, order: Sequence, k: int | None = None,
                sep: str = "; ", name: str = "summary", unbounded_ok: bool = False) -> DataFrame:
    """AGG10: top-k rows (by an explicit order) formatted and joined as text.

    The top-k is taken *before* aggregating, so at most k rows reach the
    single aggregate group.  Joining every row into one string puts the whole
    input in one group, so it must be asked for explicitly
    (``unbounded_ok=True``) and is only sound for inputs of known small size.
    """
    if k is None and not unbounded_ok:
        raise ValueError("rollup_text needs k (or unbounded_ok=True for a known-small input)")
    src = df.select(text.alias("_t"), *[F.col(o if isinstance(o, str) else o[0]) for o in order])
    if k is not None:
        src = src.orderBy(*order_cols(order)).limit(k)
    sep_sql = sep.replace("'", "''")
    return src.agg(F.expr(
        f"listagg(_t, '{sep_sql}') WITHIN GROUP (ORDER BY {order_sql(order)})").alias(name))


def share(df: DataFrame, pred: Column, value: str, digits: int = 1,
          name: str = "share_pct") -> DataFrame:
    """AGG11: part / NULLIF(total, 0) * 100 in one pass."""
    part = F.sum(F.when(pred, F.col(value)))
    total = F.sum(F.col(value))
    return df.agg(F.round(part / F.nullif(total, F.lit(0)) * 100, digits).alias(name))


def profile(df: DataFrame, column: str) -> DataFrame:
    """AGG12: min, max and row count of a column."""
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"),
                  F.count(F.lit(1)).alias("n_rows"))


# --------------------------------------------------------------------------
# windows (WIN)
# --------------------------------------------------------------------------


def pct_of_total(df: DataFrame, value: str, partition: Sequence[str] = (),
                 digits: int = 2, name: str = "pct_of_total") -> DataFrame:
    """WIN1: value / SUM(value) OVER (partition) * 100.

    Written as aggregate + join instead of an unpartitioned window, which
    would move every row into one task.
    """
    totals = df.groupBy(*partition).agg(F.sum(value).alias("_total"))
    joined = with_scalar(df, totals) if not partition else join_on_keys(df, totals, partition)
    return (joined.withColumn(name, F.round(F.col(value) / F.nullif(F.col("_total"), F.lit(0))
                                            * 100, digits))
            .drop("_total"))


def bridge(df: DataFrame, actual: str, forecast: str, order: str,
           last: Column | None = None) -> DataFrame:
    """WIN2: on the last row that has an actual value, copy it into forecast.

    The last actual key is a global MAX over the rows with an actual, a
    scalar subquery, so no window over all rows is needed.  Callers that
    hold the actual series separately pass ``last`` computed from it, so
    the subquery does not re-run the merged plan.
    """
    if last is None:
        last = df.filter(F.col(actual).isNotNull()).select(F.max(order)).scalar()
    return df.withColumn(forecast, F.when(F.col(order) == last, F.col(actual))
                         .otherwise(F.col(forecast)))


# --------------------------------------------------------------------------
# sort / limit (S)
# --------------------------------------------------------------------------


def order(df: DataFrame, keys: Sequence) -> DataFrame:
    """S1: order by keys (NULLS LAST in both directions)."""
    return df.orderBy(*order_cols(keys))


def top_k(df: DataFrame, by: Sequence, k: int) -> DataFrame:
    """S2: first k rows by the order; give a unique tiebreak key last."""
    return df.orderBy(*order_cols(by)).limit(k)


def latest_row(df: DataFrame, ts: str, partition: Sequence[str] = (),
               tiebreak: Sequence[str] = (), cols: Sequence[str] | None = None) -> DataFrame:
    """S3: the row with the greatest ``ts`` (per partition).

    Per partition this is ``max_by(struct, (ts present, ts, tiebreak))``: a
    partial aggregate keeps one candidate per key per task, so a hot key is
    cheap.  A NULL ``ts`` ranks below every real one (SQL ``DESC NULLS
    LAST``), so a key whose times are all NULL still yields a row.
    """
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in partition]
    key = F.struct(F.col(ts).isNotNull(), F.col(ts), *[F.col(t) for t in tiebreak])
    if not partition:
        return df.orderBy(*[c.desc_nulls_last() for c in [F.col(ts)] + [F.col(t) for t in tiebreak]]) \
                 .limit(1).select(*cols)
    return (df.groupBy(*partition)
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), key).alias("_r"))
            .select(*partition, "_r.*"))


def cap(df: DataFrame, n: int, by: Sequence) -> DataFrame:
    """S4: deterministic cap on row count (ordered limit)."""
    return top_k(df, by, n)


# --------------------------------------------------------------------------
# set operations (SET)
# --------------------------------------------------------------------------


def union_all(*dfs: DataFrame) -> DataFrame:
    """SET1: union by name; columns missing on one side become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def stack_series(actual: DataFrame, forecast: DataFrame, column: str = "series_type") -> DataFrame:
    """SET2: actual and forecast rows stacked with a series label."""
    return union_all(tag(actual, column, "actual"), tag(forecast, column, "forecast"))
