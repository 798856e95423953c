"""Semantic layer and scalar rows (MET1, KPI1, BRF1).

* ``MetricView`` is a named set of dimension and measure expressions over
  one source; a query picks any subset and becomes one ``groupBy().agg()``.
* ``kpis`` evaluates several scalar queries into one row.  Each scalar is a
  global aggregate (exactly one row), so joining them is a bounded
  broadcast of single rows.  A scalar that cannot be planned (missing
  table/column) becomes NULL on its own, as the reference's KPI bar does.
* ``MetricStates`` are the view's measures as mergeable partial states, stored at
  the finest grain; any subset of dimensions is then a merge of few rows.
* ``context`` renders labelled result sets as JSON text for a prompt, in
  chunks of a stated number of rows, so that a set of any size is packed by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.functions.columns import order_cols
from supplylens.operators.relational import join_on_keys, with_scalar
from supplylens.session import scratch_path


def _expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


@dataclass
class MetricView:
    """Named dimensions and measures over one source DataFrame."""

    source: DataFrame
    dimensions: Mapping[str, str | Column]
    measures: Mapping[str, str | Column]
    comment: str = ""
    filters: Sequence[str | Column] = field(default_factory=tuple)

    def query(self, dims: Sequence[str] = (), measures: Sequence[str] | None = None,
              where: str | Column | None = None) -> DataFrame:
        """Group by the chosen dimensions and compute the chosen measures."""
        unknown = [d for d in dims if d not in self.dimensions]
        if unknown:
            raise KeyError(f"unknown dimensions {unknown}")
        names = list(measures) if measures is not None else list(self.measures)
        df = self.source
        for f in self.filters:
            df = df.filter(_expr(f))
        if where is not None:
            df = df.filter(_expr(where))
        keys = [_expr(self.dimensions[d]).alias(d) for d in dims]
        aggs = [_expr(self.measures[m]).alias(m) for m in names]
        return df.groupBy(*keys).agg(*aggs)


def scalar(df: DataFrame, column: str | Column, name: str = "val") -> DataFrame:
    """Make a one-row DataFrame from a column of a one-row query (of several rows the largest value)."""
    c = F.col(column) if isinstance(column, str) else column
    return df.agg(F.max(c).alias(name))


def kpis(spark: SparkSession, queries: Mapping[str, Callable[[], DataFrame]],
         overrides: Mapping[str, Callable[[], DataFrame]] | None = None,
         value_type: str = "double") -> DataFrame:
    """KPI1: one row, one column per KPI; overrides win where not NULL.

    Each callable returns a DataFrame whose first column is the value.  Every
    KPI is evaluated alone (one small job, one value), so one that fails, when it
    is planned or when it runs, is NULL and the others stand.
    """
    overrides = overrides or {}

    def value(fn):
        try:
            df = fn()
            return scalar(df, df.columns[0]).select(F.col("val").cast(value_type)).first()[0]
        except (PySparkException, KeyError, ValueError):
            return None

    row = {}
    for name, fn in queries.items():
        over = value(overrides[name]) if name in overrides else None
        row[name] = value(fn) if over is None else over
    return spark.range(1).select(*[F.lit(v).cast(value_type).alias(k) for k, v in row.items()])


class MetricStates:
    """MET1 from stored partial states of one value column.

    ``build`` groups the source once by all dimensions and keeps count, mean,
    sum of squared deviations, least and greatest.  These merge exactly, so
    ``query`` of any subset of dimensions reads the small table alone.
    """

    def __init__(self, states: DataFrame, dims: Sequence[str]):
        self.states, self.dims = states, list(dims)

    @staticmethod
    def build(source: DataFrame, dimensions: Mapping[str, str | Column], value: str | Column) -> DataFrame:
        """The states, to be written wherever the caller keeps them; rows without a value count in ``rows`` alone."""
        v = _expr(value).cast("double")
        return source.groupBy(*[_expr(e).alias(d) for d, e in dimensions.items()]).agg(
            F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("least"), F.max(v).alias("greatest"))

    def query(self, dims: Sequence[str] = ()) -> DataFrame:
        """avg, stddev, min, max and rows by the chosen dimensions.

        Squares are taken of deviations from the merged group's own mean, which
        is one small aggregate before; so large values with a small spread lose nothing.
        """
        unknown = [d for d in dims if d not in self.dims]
        if unknown:
            raise KeyError(f"unknown dimensions {unknown}")
        n, total = F.col("n"), F.sum("n")
        mean = F.sum(n * F.col("mean")) / F.when(total > 0, total)
        means = self.states.groupBy(*dims).agg(mean.alias("_avg"))
        rows = join_on_keys(self.states, means, dims) if dims else with_scalar(self.states, means)
        off = F.col("mean") - F.col("_avg")
        spread = F.sum(F.col("m2") + n * off * off) - F.sum(n * off) * F.sum(n * off) / total
        return rows.groupBy(*dims).agg(
            F.sum("rows").alias("rows"), F.first("_avg").alias("avg"),
            F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1))).alias("stddev"),
            F.min("least").alias("min"), F.max("greatest").alias("max"))

    def every_subset(self) -> DataFrame:
        """:meth:`query` for all subsets of the dimensions; ``level`` has a bit set for each one left out (the last is bit 0)."""
        out = None
        for level in range(1 << len(self.dims)):
            kept = [d for i, d in enumerate(reversed(self.dims)) if not level >> i & 1][::-1]
            part = self.query(kept).withColumn("level", F.lit(level).cast("long"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out


#: Rows of a set in one text.
CONTEXT_ROWS = 1000


def context(spark: SparkSession, sets: Mapping[str, Callable[[], DataFrame]],
            order: Mapping[str, Sequence] | None = None, max_rows: int | None = None,
            chunk_rows: int = CONTEXT_ROWS) -> DataFrame:
    """BRF1: ``(label, chunk, context)``; the context is JSON text of up to ``chunk_rows`` rows of the set.

    Rows are ordered by the given keys (default: all columns) and then cut
    into chunks 0, 1, ...; an empty set is one empty chunk.  All rows are kept unless
    ``max_rows`` is given.  Each set is evaluated on its own and landed, so one that
    fails, when it is planned or while it runs, reads ``unavailable`` and the others stand.
    """
    order = order or {}
    body = F.to_json(F.transform("_a", lambda s: s["_row"])).alias("context")
    parts = []
    for label, fn in sets.items():
        path = scratch_path(spark, "context")
        try:
            df = fn()
            keys = order_cols(list(order.get(label, df.columns)))
            rows = df if max_rows is None else df.orderBy(*keys).limit(max_rows)
            placed = numbered(spark, rows.select(F.struct(*df.columns).alias("_row"), *df.columns), keys).select(
                F.expr(f"_pos div {int(chunk_rows)}").alias("chunk"), F.struct("_pos", "_row").alias("_s"))
            (placed.groupBy("chunk").agg(F.sort_array(F.collect_list("_s")).alias("_a"))
             .select("chunk", body).write.parquet(path))
            landed = spark.read.schema("chunk long, context string").parquet(path)
            if landed.isEmpty():
                landed = spark.range(1).select(F.lit(0).cast("long").alias("chunk"), F.lit("[]").alias("context"))
        except PySparkException:
            landed = spark.range(1).select(F.lit(0).cast("long").alias("chunk"), F.lit("unavailable").alias("context"))
        parts.append(landed.select(F.lit(label).alias("label"), "chunk", "context"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered(spark: SparkSession, df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``df`` with ``_pos``, the row's number in the given order, from 0.

    A range sort deals the rows out, and the counts of the parts before (one
    row a part) are added to a row's number in its part; the sorted parts are landed, so that both
    see the same ones.
    """
    path = scratch_path(spark, "numbered")
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
     .write.parquet(path))
    parts = spark.read.parquet(path)
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, shift = 0, []
    for part in sorted(counts):
        shift.append((part, before))
        before += counts[part]
    shift = F.broadcast(spark.createDataFrame(shift, "_of int, _before long"))
    return (parts.join(shift, F.col("_part") == F.col("_of"))
            .withColumn("_pos", F.col("_before") + F.col("_at")).drop("_part", "_of", "_at", "_before"))
