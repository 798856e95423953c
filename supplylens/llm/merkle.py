"""Merkle manifest of a dataset as a tree of SHA-256 midstates (operator 13).

Each row is a leaf.  Leaves of one key (a language, a shard, ...) ascend by id;
every ``fan`` consecutive nodes are hashed to their parent until one is left, the key's
subroot, and the subroots of the ascending keys likewise give the root.

A digest goes into its parent as 64 hexadecimal characters, which is just one block of
SHA-256.  So a parent retains a copy of the hash state before each child
slot, 32 bytes that can be stored.  To replace a child, the state of its slot
is resumed with the new digest and the siblings to the right only; those to
the left are in the state already.

Leaves are hashed where their rows lie, and only (key, id, digest) is
shuffled.  Positions come from a range sort and the counts of its parts.
Subtrees of ``fan`` ** ``levels`` leaves are whole tasks' groups whatever the
size of a key, and their tops are the leaves of the next round, until each key has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FAN = 2
#: Levels of a subtree that is built as one group (4,096 leaves for pairs).
LEVELS = 12


# -- SHA-256 with its states in sight (FIPS 180-4), many messages at a time

def _primes(n: int) -> list[int]:
    out, x = [], 2
    while len(out) < n:
        if all(x % p for p in out):
            out.append(x)
        x += 1
    return out


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid ** 3 <= x else (lo, mid - 1)
    return lo


#: The first 32 bits of the fractional parts of the square roots, and cube roots, of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], dtype=np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one more block of 16 numbers each (n, 16)."""
    w = list(np.ascontiguousarray(block.T))
    a, b, c, d, e, f, g, h = before = list(np.ascontiguousarray(state.T))
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                     + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        a, b, c, d, e, f, g, h = (t + (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b))),
                                  a, b, c, d + t, e, f, g)
    return np.stack([x + y for x, y in zip(before, (a, b, c, d, e, f, g, h), strict=True)], axis=1)


def as_block(digest: np.ndarray) -> np.ndarray:
    """Digests (n, 8) as the block of their hexadecimal text (n, 16)."""
    raw = np.ascontiguousarray(digest.astype(">u4")).view(np.uint8).reshape(len(digest), 32)
    text = np.empty((len(digest), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return text.view(">u4").astype(np.uint32)


def closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of messages that end after so many whole blocks."""
    pad = np.zeros((len(state), 16), np.uint32)
    pad[:, 0] = 0x80000000
    pad[:, 14], pad[:, 15] = (blocks * 512) >> 32, (blocks * 512) & 0xFFFFFFFF
    return absorb(state, pad)


# -- trees

def step_type(fan: int) -> np.dtype:
    """One level of a path: the state before the node's slot, the slot, the parent's children, the other children."""
    return np.dtype([("state", ">u4", (8,)), ("slot", "u1"), ("count", "u1"), ("others", ">u4", (fan - 1, 8))])


def parents(nodes: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the nodes (n, 8) of a level: the next level, children of each parent, states before each slot (m, fan, 8)."""
    m = -(-len(nodes) // fan)
    counts = np.full(m, fan, np.int64)
    counts[-1] = len(nodes) - (m - 1) * fan
    blocks = as_block(nodes)
    states = np.zeros((m, fan, 8), np.uint32)
    now = np.broadcast_to(START, (m, 8)).copy()
    for slot in range(fan):
        states[:, slot] = now
        has = np.flatnonzero(counts > slot)
        now[has] = absorb(now[has], blocks[has * fan + slot])
    return closed(now, counts), counts, states


def steps_of(nodes: np.ndarray, at: np.ndarray, counts: np.ndarray, states: np.ndarray, fan: int) -> np.ndarray:
    """The steps up from the nodes number ``at`` of a level."""
    out = np.zeros(len(at), step_type(fan))
    up, slot = at // fan, at % fan
    out["state"], out["slot"], out["count"] = states[up, slot], slot, counts[up]
    other = np.arange(fan - 1)[None, :] + (np.arange(fan - 1)[None, :] >= slot[:, None])
    out["others"] = nodes[np.minimum(up[:, None] * fan + other, len(nodes) - 1)]
    return out


def present(steps: np.ndarray, fan: int) -> np.ndarray:
    """Which of ``others`` exist."""
    other = np.arange(fan - 1)
    slot, count = steps["slot"][..., None].astype(int), steps["count"][..., None]
    return other + (other >= slot) < count


def resume(digest: np.ndarray, steps: np.ndarray, fan: int) -> np.ndarray:
    """The parents of ``digest`` (n, 8) by one step each: the retained state, the digest, the siblings to its right."""
    state = absorb(steps["state"].astype(np.uint32), as_block(digest))
    right = present(steps, fan) & (np.arange(fan - 1) >= steps["slot"][:, None].astype(int))
    for i in range(fan - 1):
        has = np.flatnonzero(right[:, i])
        if len(has):
            state[has] = absorb(state[has], as_block(steps["others"][has, i].astype(np.uint32)))
    return closed(state, steps["count"].astype(np.int64))


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Binary digests as (n, 8) numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").astype(np.uint32).reshape(-1, 8)


def _raw(digests: np.ndarray) -> pa.Array:
    """(n, 8) numbers as binary digests."""
    data = np.ascontiguousarray(digests.astype(">u4")).tobytes()
    return pa.array([data[i:i + 32] for i in range(0, len(data), 32)], pa.binary())


def _joined(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that lie end to end in the bytes of ``values``."""
    data, ends = values.tobytes(), np.concatenate(([0], np.cumsum(lengths))).tolist()
    return pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _subtree(table: pa.Table, fan: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by position, steps (rows, height) up to the subtree's top, the top) of one group."""
    order = np.argsort(table.column("pos").to_numpy(), kind="stable")
    nodes = _numbers(table.column("digest"))[order]
    whole = table.column("n")[0].as_py() <= fan ** levels  # the key ends here, else the subtree has all its levels
    at, steps = np.arange(len(nodes)), []
    while len(nodes) > 1 if whole else len(steps) < levels:
        above, counts, states = parents(nodes, fan)
        steps.append(steps_of(nodes, at, counts, states, fan))
        nodes, at = above, at // fan
    held = np.zeros((len(at), len(steps)), step_type(fan))  # filled by level: stacking would change the byte order
    for level, step in enumerate(steps):
        held[:, level] = step
    return order, held, nodes[0]


def _tops(rows: int, top: np.ndarray) -> pa.Array:
    return pa.array([top.astype(">u4").tobytes()] + [None] * (rows - 1), pa.binary())


def _siblings(steps: np.ndarray, fan: int) -> pa.Array:
    """Per row the siblings on its way, level by level and left to right, end to end."""
    there = present(steps, fan)
    return _joined(steps["others"][there], 32 * there.sum(axis=(1, 2)))


NODES = "key long, pos long, n long, top binary, path binary"


def _grow(fan: int, levels: int):
    """Of one subtree: each node's path as bytes; the first row carries the top."""
    def run(table: pa.Table) -> pa.Table:
        order, steps, top = _subtree(table, fan, levels)
        paths = _joined(steps, np.full(len(order), steps.shape[1] * steps.dtype.itemsize))
        taken = table.take(pa.array(order))
        return pa.table([taken.column("key"), taken.column("pos"), taken.column("n"), _tops(len(order), top), paths],
                        names=["key", "pos", "n", "top", "path"])

    return run


LEAVES = "key long, pos long, n long, id long, top binary, digest binary, folded binary, siblings binary"


def _grow_leaves(fan: int, levels: int):
    """Of one subtree of leaves: the top with each leaf replaced, folded from the retained states, and the siblings."""
    def run(table: pa.Table) -> pa.Table:
        order, steps, top = _subtree(table, fan, levels)
        taken = table.take(pa.array(order))
        now = _numbers(taken.column("replacement"))
        for level in range(steps.shape[1]):
            now = resume(now, steps[:, level], fan)
        return pa.table([taken.column("key"), taken.column("pos"), taken.column("n"), taken.column("id"), _tops(len(order), top),
                         taken.column("digest"), _raw(now), _siblings(steps, fan)],
                        names=["key", "pos", "n", "id", "top", "digest", "folded", "siblings"])

    return run


def _fold(fan: int):
    """Folds ``folded`` on by ``path`` and lengthens ``siblings`` by those on the path."""
    kind = step_type(fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            now = _numbers(batch.column("folded")) if len(paths) else np.zeros((0, 8), np.uint32)
            more = [b""] * len(paths)
            sizes = np.array([len(p) for p in paths], dtype=np.int64)
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                steps = np.frombuffer(b"".join([paths[i] for i in rows.tolist()]), kind).reshape(len(rows), -1)
                folded = now[rows]
                for level in range(steps.shape[1]):
                    folded = resume(folded, steps[:, level], fan)
                now[rows] = folded
                for i, s in zip(rows.tolist(), _siblings(steps, fan).to_pylist(), strict=True):
                    more[i] = s
            siblings = pa.array([a + b for a, b in zip(batch.column("siblings").to_pylist(), more, strict=True)], pa.binary())
            out = batch.set_column(batch.schema.get_field_index("folded"), "folded", _raw(now))
            out = out.set_column(out.schema.get_field_index("siblings"), "siblings", siblings)
            yield out.drop_columns(["path"])

    return run


def numbered(spark: SparkSession, rows: DataFrame, order: list[str], key: str | None = None) -> DataFrame:
    """``rows`` with pos, the row's number within its key in the given order, and n, the key's rows.

    ``key`` is an integer column and the first of ``order``; without it all rows count as one key.
    The sorted parts are landed; beside them only one row per part and key is looked at.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    of = F.col(key) if key else F.lit(0).cast("long")
    parts = (rows.repartitionByRange(*by).sortWithinPartitions(*by)
             .select("*", F.spark_partition_id().alias("_part"),
                     F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"), of.alias("_of")))
    parts = common.land(spark, parts, "numbered")
    counts = parts.groupBy("_of", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("_of").alias("_of2"), F.col("_part").alias("_part2"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("_of")).alias("n"))
    counts = common.small_side(common.land(spark, counts, "counts"), 32)
    return (parts.join(counts, (F.col("_of") == F.col("_of2")) & (F.col("_part") == F.col("_part2")))
            .withColumn("pos", F.col("_at") + F.col("_shift")).drop("_of", "_of2", "_part", "_part2", "_at", "_shift"))


def _climb(spark: SparkSession, nodes: DataFrame, fan: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes (key, pos, n, digest): (key, pos, path up to the key's top), and (key, digest) of the tops."""
    size = fan ** levels
    rows = common.land(spark, nodes.groupBy("key", F.expr(f"pos div {size}").alias("chunk"))
                       .applyInArrow(_grow(fan, levels), NODES), "nodes")
    above = _above(rows, size)
    if above.where("n > 1").isEmpty():
        return rows.select("key", "pos", "path"), above.select("key", "digest")
    paths, tops = _climb(spark, above, fan, levels)
    paths = paths.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("path").alias("_path"))
    joined = rows.join(paths, (F.col("key") == F.col("_key")) & (F.expr(f"pos div {size}") == F.col("_pos")))
    return joined.select("key", "pos", F.concat("path", "_path").alias("path")), tops


def _above(rows: DataFrame, size: int) -> DataFrame:
    """The tops of a round's subtrees as the nodes of the next round."""
    return rows.where("top is not null").select("key", F.expr(f"pos div {size}").alias("pos"),
                                                F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest"))


def manifest(spark: SparkSession, docs: DataFrame, leaf: Column, replacement: Column | None = None, id_col: str = "doc_id",
             key_col: str = "lang", fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``key_col``, leaf, subroot, root, siblings, folded_root (digests in binary).

    ``leaf`` and ``replacement`` are expressions on ``docs`` that give a SHA-256
    digest in hexadecimal.  ``siblings`` holds the digests that prove the leaf, end
    to end, level by level via the subroot to the root, each level left to right;
    ``folded_root`` is the root with this row's leaf replaced, folded from the
    retained states (without a replacement: the root, computed the same way).

    Ids and keys ascend, null first, text by its UTF-8 bytes; rows with equal
    ids ascend by digest and, where that is equal too, give equal subroots and roots in any
    order.  An empty table gives an empty result.  Only the two columns named and those of the expressions are read.
    """
    digest = lambda c: F.unhex(c)
    rows = common.land(spark, docs.select(
        F.col(key_col).cast("string").alias("name"), F.col(id_col).cast("long").alias("id"), digest(leaf).alias("digest"),
        digest(leaf if replacement is None else replacement).alias("replacement"), F.monotonically_increasing_id().alias("tie")), "leaves")
    keys = numbered(spark, rows.select("name").distinct(), ["name"]).select("name", F.col("pos").alias("key"))
    keys = common.small_side(common.land(spark, keys, "keys"), 64).withColumnRenamed("name", "_name")
    rows = rows.join(keys, F.col("name").eqNullSafe(F.col("_name"))).drop("_name", "name")
    rows = numbered(spark, rows, ["key", "id", "digest", "tie"], "key")
    size = fan ** levels
    leaves = common.land(spark, rows.groupBy("key", F.expr(f"pos div {size}").alias("chunk"))
                         .applyInArrow(_grow_leaves(fan, levels), LEAVES), "subtrees")
    above = _above(leaves, size)
    paths, tops = _climb(spark, above, fan, levels)
    tops = common.land(spark, tops, "subroots")
    # the subroots are the leaves of one more tree, whose single key is 0
    under = numbered(spark, tops.select(F.col("key").alias("name"), "digest"), ["name"])
    key_paths, root = _climb(spark, under.select(F.lit(0).cast("long").alias("key"), "pos", "n", "digest"), fan, levels)
    upper = tops.select(F.col("key").alias("_key"), F.col("digest").alias("subroot")).join(
        key_paths.select(F.col("pos").alias("_of"), F.col("path").alias("_last")), F.col("_key") == F.col("_of")).drop("_of")
    upper = upper.crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    upper = paths.join(upper, F.col("key") == F.col("_key")).select(
        F.col("key").alias("_key"), F.col("pos").alias("_chunk"), F.concat("path", "_last").alias("path"), "subroot", "root")
    upper = common.small_side(common.land(spark, upper, "upper"), 64 * 66 * (fan - 1) + 128)
    names = keys.select(F.col("key").alias("_key"), F.col("_name").alias("name"))
    told = leaves.join(upper, (F.col("key") == F.col("_key")) & (F.expr(f"pos div {size}") == F.col("_chunk"))).join(
        names, F.col("key") == names["_key"])
    told = told.select("id", "name", "digest", "subroot", "root", "siblings", "folded", "path").mapInArrow(
        _fold(fan), "id long, name string, digest binary, subroot binary, root binary, siblings binary, folded binary")
    return told.select(F.col("id").alias(id_col), F.col("name").alias(key_col), F.col("digest").alias("leaf"), "subroot", "root",
                       "siblings", F.col("folded").alias("folded_root"))


def field_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values, each as the count of its UTF-8 bytes, a colon and itself, or - for null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(tampered(spark, common.table(spark, sf_dir, "documents")))


def tampered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with the replacements that the query's contract names; a null id is never tampered with."""
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    fields = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    changed = (more == 1) & F.col("n_chars").isNotNull()
    leaf = field_digest(fields(F.col("n_chars")))
    return manifest(spark, docs, leaf, F.when(changed, field_digest(fields(F.col("n_chars") + more))).otherwise(leaf))


def digests(told: DataFrame) -> DataFrame:
    """The columns that the query's contract names."""
    hexadecimal = lambda c: F.lower(F.hex(c))
    return told.select(
        "doc_id", *[hexadecimal(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(hexadecimal(F.col("siblings")), 256).alias("proof_sha256"), hexadecimal(F.col("folded_root")).alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"))


OP13_SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM range(256) r(i))),
docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, source, lang, n_chars, text,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM documents, crc_table),
parts AS (
    SELECT row_id, doc_id, lang, h,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
        coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
        coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM docs),
leaves AS (
    SELECT row_id, doc_id, lang, sha256(head || size || tail) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND h % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || size || tail) END AS changed
    FROM parts),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS pos,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS key
    FROM leaves),
tree AS (
    SELECT 0 AS level, key, pos, leaf AS digest, count(*) OVER (PARTITION BY key) AS n FROM numbered
    UNION ALL
    SELECT level + 1, key, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM tree WHERE n > 1 GROUP BY level, key, pos // 2),
subroots AS (SELECT key, digest AS subroot, level AS height FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS level, key AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2
    FROM top WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT digest AS root, level AS height FROM top WHERE n = 1),
nodes AS (
    SELECT t.key, t.level, t.pos, t.digest FROM tree t JOIN subroots s ON t.key = s.key AND t.level < s.height
    UNION ALL
    SELECT s.key, s.height + t.level, t.pos, t.digest FROM top t, root r, subroots s WHERE t.level < r.height),
folding AS (
    SELECT n.row_id, n.key, n.pos, s.height, s.height + r.height AS last, 0 AS level, n.changed AS digest, '' AS proof
    FROM numbered n JOIN subroots s ON n.key = s.key CROSS JOIN root r
    UNION ALL
    SELECT f.row_id, f.key, f.pos, f.height, f.last, f.level + 1,
        sha256(CASE WHEN o.digest IS NULL THEN f.digest WHEN o.pos % 2 = 0 THEN o.digest || f.digest ELSE f.digest || o.digest END),
        f.proof || coalesce(o.digest, '')
    FROM folding f LEFT JOIN nodes o ON o.key = f.key AND o.level = f.level
        AND o.pos = xor(CASE WHEN f.level < f.height THEN f.pos >> f.level ELSE f.key >> (f.level - f.height) END, 1)
    WHERE f.level < f.last)
SELECT n.doc_id, n.leaf, s.subroot, r.root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = r.root AS verified
FROM folding f JOIN numbered n ON f.row_id = n.row_id JOIN subroots s ON f.key = s.key CROSS JOIN root r WHERE f.level = f.last
"""
