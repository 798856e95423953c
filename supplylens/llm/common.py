"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.session import drop_scratch, scratch_path

# A word is a longest run of characters other than blank, \t, \n, \v, \f, \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

# A table is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Spark's setting that removes the shuffle files of a query when the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give their shuffle files back at their end, not when the driver's garbage collector comes by.

    Executors lost before the end are recovered from as usual.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def land(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage: a lost executor re-reads files
    instead of repeating everything before them, and nothing reads the shuffle
    files of the write again, so they go at its end.
    """
    path = scratch_path(spark, name)
    with _own_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.landed_at = path
    return out


def drop_landed(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by :func:`land` that nothing will read again."""
    for df in tables:
        drop_scratch(spark, df.landed_at)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a landed table for broadcast if its counted size is below ``limit``.

    Beyond it the table is returned as it is and the join shuffles (with
    Spark's split of skewed partitions).
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


#: Tables of at most so many bytes, told by a bound on their rows, are broadcast without a count of their own.
BOUNDED_BYTES = 8 << 20
#: A table is written by one task for so many rows, but by LEAST_TASKS at least.
TASK_ROWS, LEAST_TASKS = 100_000, 16


def bounded_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark a table of at most ``rows`` rows for broadcast if that bound is small; else the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BOUNDED_BYTES else df


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more partitions than these need: small tables make no hundreds of files."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
