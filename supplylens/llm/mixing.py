"""Mixing sources to target weights (operator 8).

Sizes are summed per source, each source gets a target by water filling, and
its repetition rate is target / size.  A document is emitted floor(rate)
times plus one more time with probability rate - floor(rate), decided by a
hash of its id, so a rerun takes the same copies.

Only DataFrame functions are used.  The sum per source is a partial
aggregate, so a source with a third of all rows costs one row per task.  The
table of sources has one row per source (a dimension: thousands of rows, not
documents); it is landed, its size is checked and it is then broadcast, or
joined by shuffle if it is too large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3.0


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "size",
                   weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE,
                   share: float = 1.0) -> DataFrame:
    """Target words per source: (source, source_size, target, rate).

    Sources in code point order, null last, take ``weights`` in turn.  They
    share ``share`` of all words in proportion to their weight, but none gets
    more than ``max_rate`` times its own size; what is above is shared anew
    among the others.  That fixed point is min(cap, level * weight), with the
    level found from running sums in the order of cap / weight.  A source
    without words gets target 0 and rate 0.
    """
    per = (sizes.groupBy(F.col(source_col).alias("_source"))
           .agg(F.sum(size_col).cast("long").alias("source_size")))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.lit(float(max_rate)) * F.col("source_size")
    per = (per.withColumn("_w", weight).withColumn("_cap", cap)
           .withColumn("_total", F.sum("source_size").over(
               Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_w").over(onward))
    per = per.withColumn("_level", level)
    # The first source whose cap holds the level stops the filling; -1: every source is at its cap.
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"),
                         F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("_level").alias("level"))))
    stop = first.over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("_stop", stop)
    target = F.when(F.col("_stop").isNull(), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), F.col("_stop.level") * F.col("_w")))
    rate = F.when(F.col("source_size") > 0,
                  F.least(F.lit(float(max_rate)), target / F.col("source_size"))).otherwise(F.lit(0.0))
    return per.select("_source", "source_size", target.alias("target"), rate.alias("rate"))


def hash_unit(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the md5 of the seed and the id (a null id counts as empty)."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def _planned(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, source_col: str,
             weights: Sequence[float], max_rate: float, share: float, seed: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns of :data:`PLANNED` under names that are free in it, and those names."""
    name = {c: common.fresh(docs, f"_mix_{c}") for c in ("key", *PLANNED)}
    sizes = docs.select(F.col(source_col).alias("_source"), common.word_count(F.col(text_col)).alias("_size"))
    targets = source_targets(sizes, "_source", "_size", weights, max_rate, share)
    targets = targets.toDF(*[name[c] for c in ("key", "source_size", "target", "rate")])
    targets = common.small_side(common.land(spark, targets, "mix-targets"), row_bytes=256)
    joined = (docs.withColumn(name["size"], common.word_count(F.col(text_col)))
              .join(targets, F.col(source_col).eqNullSafe(F.col(name["key"])), "left"))
    whole = F.floor(name["rate"])
    extra = hash_unit(F.col(id_col), seed) < F.col(name["rate"]) - whole
    return joined.withColumn(name["copies"], (whole + extra.cast("long")).cast("long")).drop(name["key"]), name


PLANNED = ("size", "source_size", "target", "rate", "copies")


def plan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", weights: Sequence[float] = WEIGHTS,
         max_rate: float = MAX_RATE, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (long).

    Null text counts 0 words; a null source is a source of its own.  Extra
    columns are kept, but those named like one of the new columns are
    replaced.  Rows with equal ids take the same decision.
    """
    planned, name = _planned(spark, docs, id_col, text_col, source_col, weights, max_rate, share, seed)
    return planned.select(*[c for c in docs.columns if c.lower() not in PLANNED], *[F.col(name[c]).alias(c) for c in PLANNED])


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE,
        share: float = 1.0, seed: str = "mix") -> DataFrame:
    """Emit every document as often as :func:`plan` says, with its own columns.

    All columns of ``docs`` stay as they are; an empty table stays empty.
    """
    planned, name = _planned(spark, docs, id_col, text_col, source_col, weights, max_rate, share, seed)
    copies = F.col(name["copies"])
    return (planned.where(copies > 0).withColumn(name["key"], F.explode(F.sequence(F.lit(1).cast("long"), copies)))
            .select(*docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return plan(spark, docs).select("doc_id", "size", "source_size", "target",
                                    (F.col("size") * F.col("copies")).alias("taken"))


# The same filling written as rounds: sources above their cap are fixed, the rest is shared again.
# With 20 sources or fewer caps than rounds this ends; each round fixes one source at least.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
lv AS (
  SELECT *, (3.0 * source_size)::DOUBLE AS cap, (3.0 * source_size)::DOUBLE / w AS k FROM s),
r AS (
  SELECT 0 AS round, -1.0::DOUBLE AS level
  UNION ALL
  SELECT round + 1,
         (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (k < r.level), 0)) / sum(w) FILTER (k >= r.level) FROM lv)
  FROM r WHERE round < (SELECT count(*) FROM lv)
   AND (SELECT count(*) FILTER (k >= r.level) FROM lv) > 0),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM r)) AS target FROM lv),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(3.0, t.target / t.source_size) ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE
                                        / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
