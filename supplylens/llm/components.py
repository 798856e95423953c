"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _print(links: DataFrame) -> tuple:
    """What tells two tables of links apart: their number and a sum of hashes."""
    r = links.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).collect()[0]
    return r["n"], r["h"]


def _star(links: DataFrame, n: int, small: bool) -> DataFrame:
    """One step: each node's neighbours (large star: the larger ones; small star: the smaller ones) move to its least.

    ``links`` has a > b and ``n`` rows at most; the result has 2 n at most.  The least
    neighbour is a partial aggregate and the neighbours are joined back, so a node with very many
    links is never held in one task; Spark splits its part of the join.
    """
    near = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    least = common.bounded_side(common.few(least, 2 * n), 2 * n, 32)
    joined = near.join(least, F.col("a") == F.col("u"))
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return common.few(moved.where("a > b").distinct(), 2 * n)


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that can be reached.

    Rounds of a large and a small star until nothing changes; each is written
    to the shared folder.  Nothing but two numbers a round reaches the driver.
    """
    now = common.land(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a > b").distinct(), "links")
    seen = _print(now)
    while seen[0]:
        last, now = now, common.land(spark, _star(_star(now, seen[0], small=False), 2 * seen[0], small=True), "links")
        common.drop_landed(spark, last)
        if (found := _print(now)) == seen:
            break
        seen = found
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
