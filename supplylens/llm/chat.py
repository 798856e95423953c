"""Collapse of cumulative conversation snapshots, then rendering (operator 7).

A log often keeps a conversation again after every turn.  Each turn gets a
rolling hash of the turns up to it; a conversation whose last hash is the
hash of a turn inside a longer one is a snapshot of that one and goes.  Of
equal conversations the one with the least id stays.

Only DataFrame functions are used.  The rolling hash of turn k is the sum of
position-bound hashes of turns 1 to k (two independent sums), so it needs no
fold over a conversation: conversations are cut into pieces by position, sums of whole
pieces are added before, and one with very many turns is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Turns of one conversation that one task handles together, and that one rendered row holds.
PIECE = 512


def _hash(position: Column, role: Column, text: Column, seed: int) -> Column:
    """40 bits of a hash of a turn and its position; null and empty differ."""
    told = F.xxhash64(F.lit(seed), position, role.isNull(), role, text.isNull(), text)
    return F.shiftrightunsigned(told, 24)


def ordered(spark: SparkSession, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, role, text and id of all turns, in ranges by conversation and turn; ids ascend by both. Landed.

    Turns go by ``turn_col``, null last; ties by role and text.  Rows that
    repeat a turn are turns of their own.  A null conversation id is an id.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # The input's row number parts rows that are equal in all else, so that they may go to several ranges.
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last(), F.col("_row")]
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return common.land(spark, rows.select("conv", "role", "text", F.monotonically_increasing_id().alias("id")), "ordered-turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, piece, at (1, 2, ...), role, text and p1, p2: the rolling hash up to this turn, of ``rows`` by :func:`ordered`.

    A piece is ``PIECE`` turns by position, so turn numbers that repeat or are null, however many, make no larger piece.
    """
    # A conversation's rows follow each other in a range, so its first id there and its turns in the ranges before number them.
    rows = rows.withColumn("range", F.shiftright("id", 33))
    sizes = rows.groupBy("conv", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv").alias("_conv"), F.col("range").alias("_range"), "first",
                         F.coalesce(F.sum("n").over(before.orderBy("range")), F.lit(0)).alias("_n"))
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    rows = rows.join(sizes, same & (F.col("range") == F.col("_range")))
    at = F.col("_n") + F.col("id") - F.col("first") + 1
    rows = rows.select("conv", F.floor((at - 1) / PIECE).alias("piece"), at.alias("at"), "role", "text")
    rows = (rows.withColumn("_h1", _hash(F.col("at"), F.col("role"), F.col("text"), 1))
            .withColumn("_h2", _hash(F.col("at"), F.col("role"), F.col("text"), 2)))
    sums = rows.groupBy("conv", "piece").agg(F.sum("_h1").alias("s1"), F.sum("_h2").alias("s2"))
    sums = sums.select(F.col("conv").alias("_conv"), F.col("piece").alias("_piece"),
                       *[F.coalesce(F.sum(f"s{i}").over(before.orderBy("piece")), F.lit(0)).alias(f"_p{i}") for i in (1, 2)])
    running = Window.partitionBy("conv", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, same & (F.col("piece") == F.col("_piece")))
    return rows.select("conv", "piece", "at", "role", "text",
                       *[(F.col(f"_p{i}") + F.sum(f"_h{i}").over(running)).alias(f"p{i}") for i in (1, 2)])


def maximal(spark: SparkSession, turns: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns) after the collapse.

    The first table has conv, n_turns and copies (equal conversations that it
    stands for); the second the rows of :func:`prefixes` of those conversations.
    """
    rows = ordered(spark, turns, **columns)
    rolled = common.land(spark, prefixes(rows), "turns")
    common.drop_landed(spark, rows)
    last = rolled.groupBy("conv").agg(F.max(F.struct("at", "p1", "p2")).alias("last"))
    last = last.select("conv", "last.*")
    # equal conversations: one aggregate by hash and length, so a very common one costs a row per task
    first = last.groupBy("at", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    # (hash of a turn that isn't the last of its conversation), once each
    inner = (rolled.join(last.select(F.col("conv").alias("_conv"), F.col("at").alias("_n")),
                         F.col("conv").eqNullSafe(F.col("_conv")))
             .where("at < _n").select("at", "p1", "p2").distinct())
    kept = common.land(spark, first.join(inner, ["at", "p1", "p2"], "left_anti"), "maximal")
    kept = kept.select("conv", F.col("at").alias("n_turns"), "copies")
    mine = rolled.join(kept.select(F.col("conv").alias("_conv")), F.col("conv").eqNullSafe(F.col("_conv")), "left_semi")
    return kept, mine


def render(turns: DataFrame) -> DataFrame:
    """conv, part, n_turns and chat: turns as ``<|im_start|>role``, text, ``<|im_end|>``, line by line.

    One row per piece of a conversation; a usual conversation is one piece
    (part 1).  The parts of a very long one, in order, make its text.  Null
    role: user; null text: empty.
    """
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    pieces = (turns.select("conv", "piece", "at", line.alias("line")).groupBy("conv", "piece")
              .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines")))
    return pieces.select("conv", (F.col("piece") + 1).cast("long").alias("part"), F.size("lines").cast("long").alias("n_turns"),
                         F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat"))


def collapse(spark: SparkSession, turns: DataFrame, **columns) -> DataFrame:
    """Maximal conversations, rendered: conv, part, n_turns, copies, chat.

    An empty table gives an empty one; extra columns are ignored.
    """
    kept, mine = maximal(spark, turns, **columns)
    copies = kept.select(F.col("conv").alias("_conv"), "copies")
    return render(mine).join(copies, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark, common.table(spark, sf_dir, "conversations")).select(
        F.col("conv").alias("conv_id"), "part", "n_turns", "copies", "chat")


# Written the plain way: prefixes as whole texts, not hashes.
OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos
  FROM conversations),
c AS (
  SELECT conv_id, max(pos) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
f AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n),
i AS (SELECT DISTINCT list_slice(turns, 1, k) AS head FROM (SELECT turns, unnest(range(1, n)) AS k FROM f)),
k AS (SELECT conv_id, copies FROM f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.head = f.turns)),
p AS (
  SELECT t.conv_id, (pos - 1) // 512 + 1 AS part, count(*) AS n_turns,
         string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
  FROM t WHERE EXISTS (SELECT 1 FROM k WHERE k.conv_id IS NOT DISTINCT FROM t.conv_id) GROUP BY t.conv_id, part)
SELECT p.conv_id, part::BIGINT AS part, n_turns, copies, chat
FROM p JOIN k ON k.conv_id IS NOT DISTINCT FROM p.conv_id
"""
