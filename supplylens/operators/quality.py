"""Sinks and load checks (SNK1, SNK2, QA1).

Writes go through Spark's file committer, so a lost executor only means its
tasks are re-run; an overwrite is all-or-nothing per job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_database(spark: SparkSession, db: str, location: str | None = None) -> str:
    """Create the namespace if missing (at ``location`` when given)."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{loc}")
    return db


def save(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> int:
    """SNK1: overwrite a catalog table (schema replaced) and return its row
    count, read back from the written table."""
    w = df.write.mode("overwrite").option("overwriteSchema", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)
    return df.sparkSession.table(name).count()


def export_points(df: DataFrame, path: str, layer: str = "layer", fmt: str = "parquet") -> DataFrame:
    """SNK2: full-refresh export of point layers, one folder per layer.

    Returns the exported data read back, for checks downstream.
    """
    df.hint("rebalance", layer).write.mode("overwrite").partitionBy(layer).format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def verify(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """QA1: ``(table_name, status, n_rows)`` with status OK / EMPTY / MISSING.

    Each present table is counted by its own aggregate; a name that does not
    resolve becomes a MISSING row without failing the report.
    """
    parts = []
    for n in names:
        try:
            t = spark.table(n)
            parts.append(t.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(n).alias("table_name"),
                F.when(F.col("n_rows") > 0, "OK").otherwise("EMPTY").alias("status"),
                "n_rows"))
        except AnalysisException:
            parts.append(spark.range(1).select(F.lit(n).alias("table_name"),
                                               F.lit("MISSING").alias("status"),
                                               F.lit(None).cast("bigint").alias("n_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_summary(report: DataFrame) -> DataFrame:
    """QA1 footer: how many of the expected tables loaded with rows."""
    return report.agg(F.count_if(F.col("status") == "OK").alias("ok"),
                      F.count(F.lit(1)).alias("expected"))
