"""N-gram Jaccard join by set size: heavy and light (operator 9).

Two texts link when the Jaccard similarity of their sets of word shingles is
at least ``percent`` / 100.  The result is the connected components of all
links; equal sets are one node, so copies cost nothing.

*Light*: for a small set every subset of the size that a partner must share is
enumerated; linked small sets have one in common.

*Heavy*: for a large set enumeration explodes, so inverted lists are scanned.
A list per single shingle would hold every text that cites a common passage,
so a list's key is a block of shingles: sets of similar size cut the range of
hashes into the same m cells, where linked sets differ in fewer than m
shingles and so agree on a whole cell.  A set that differs from each partner
in d cells at most lists only the first d + 1 of its cells in one order for all: the first
cell that both have is among them.  Any order does; cells that many of a part of the texts have come last, so
a passage that many texts cite makes no long list.

The boundary between the two is the size up to which the subsets cost fewer
keys than the cells.

Members of a list whose sizes and sketches allow a link are compared.  While all pairs that share a list stay a
fixed multiple of the sets, sketches are compared in blocks: first each member of a longer list goes on with
its nearest one, then, once these links have joined most members, all pairs of different components do.

Beyond that only short lists are compared pair by pair.  In a longer one each
member gets a home, the most listed node among those it shares a list with,
and is compared with that.  Two members that link to it are one component.  A
member x that doesn't can link to a member y of the same home only if both
gained, or both lost, a common shingle against the home (if they shared no
such edit, the edits of x and y together would be their distance, but those of x alone are too
many).  So these go on to new lists, by home and edit, in the next round;
members of different homes are compared.  Rounds end when no list joins two
components; each leaves out what its homes have in common with their members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles
from .components import connected_components

WIDTH, PERCENT = 3, 90
#: Ratio of the largest to the smallest size of a class of large sets.
CLASS_RATIO = 2.0
#: Lists of up to so many members are compared pair by pair (at the start, and later on): a constant factor.
FIRST_SHORT, SHORT = 8, 64
#: So are longer ones up to MOST_SHORT members, the shortest first, while all pairs together are PAIRS a set at most:
#: pairs of sketches in proportion to the input cost less than further rounds.
MOST_SHORT, PAIRS = 1000, 4
#: Sketches are compared in blocks of BLOCK rows while all lists together have BLOCK_PAIRS pairs a set at most.
BLOCK, BLOCK_PAIRS = 2000, 20_000
#: One in so many texts at most tells which cells are common: COMMON of these texts or more have them.  Of COMMON_KEYS at most.
PART, PART_ROWS, COMMON, COMMON_KEYS = 32, 4096, 3, 100_000
#: Leaders' sets, and sketches, are broadcast up to so many bytes (the driver holds several copies of a broadcast).
SETS_BYTES = 12 << 20
#: Bits of the sketch that tells most sets apart before they are compared.
SKETCH_BITS = 2048
#: Bits of the one that pairs must pass then, before whole sets travel: a short one is full for sets of thousands of shingles.
WIDE_BITS = 16384
FEATURES = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())),
                      ("sketch", pa.list_(pa.int64()))])
FEATURES_DDL = "k long, h long, n_shingles long, node long, keys array<long>, sketch array<long>"


class Scheme:
    """Keys of a set so that linked sets share one; ``percent`` is the least similarity.

    Cells whose keys are ``common`` (ascending) are the last in the order; with ``every`` all cells are listed.
    """

    def __init__(self, percent: int, common: np.ndarray | None = None, every: bool = False):
        self.p, self.q = percent, 100
        self.common, self.every = np.zeros(0, dtype=np.uint64) if common is None else common, every
        x = 0
        while self._subsets(x + 1) <= self.apart(x + 1, self.partner(x + 1)) + 1:
            x += 1
        self.boundary = x  # subsets up to this size
        self.classes: list[tuple[int, int]] = []  # last size and cells of each class of larger sets

    def partner(self, n: int) -> int:
        """The largest set that one of size ``n`` can link to."""
        return n * self.q // self.p

    def apart(self, a: int, b: int) -> int:
        """In how many shingles linked sets of sizes a and b differ at most."""
        return (self.q - self.p) * (a + b) // (self.q + self.p)

    def shared(self, b: int) -> int:
        """How many shingles a set of size ``b`` shares with a linked one that isn't larger."""
        return -(-self.p * b // self.q)

    def _subsets(self, n: int) -> int:
        return sum(comb(n, self.shared(b)) for b in range(n, self.partner(n) + 1) if self.shared(b) <= n)

    def cells(self, c: int) -> tuple[int, int, int]:
        """Last size, cells and least distance at which all cells can differ, of class ``c``."""
        while len(self.classes) <= c:
            first = self.classes[-1][0] + 1 if self.classes else self.boundary + 1
            last = max(first, int(first * CLASS_RATIO))
            d = self.apart(last, last)
            least = max(1, self.shared(first))
            m = d + 1  # so many more cells that hardly any set fills fewer than d + 1 of them
            while m < 4 * (d + 1) and m * (1 - (e := exp(-least / m))) - 3 * sqrt(m * e) < d + 1:
                m += 1
            self.classes.append((last, m, d))
        return self.classes[c]

    def class_of(self, n: int) -> int:
        c = 0
        while self.cells(c)[0] < n:
            c += 1
        return c

    def _first(self, found: np.ndarray, n: int) -> np.ndarray:
        if not len(self.common):
            return np.partition(found, n - 1)[:n]
        found = np.sort(found)
        at = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
        late = self.common[at] == found
        return np.concatenate((found[~late], found[late]))[:n]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The keys of the ascending set ``s``."""
        n, out = len(s), []
        if n <= self.boundary:
            for b in range(n, min(self.boundary, self.partner(n)) + 1):
                k = self.shared(b)
                if k <= n:
                    tag = np.uint64(b)
                    sums = [sum(map(int, c)) & 0xFFFFFFFFFFFFFFFF for c in combinations(s.tolist(), k)]
                    out.append(shingles.mix(shingles.mix(np.array(sums, dtype=np.uint64)) + tag))
        if self.partner(n) > self.boundary:
            for c in range(self.class_of(max(n, self.boundary + 1)), self.class_of(self.partner(n)) + 1):
                last, m, _ = self.cells(c)
                d = self.apart(n, min(last, self.partner(n)))  # from any partner that is met in this class
                cell = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                full = cell[starts]
                sums = shingles.mix(np.add.reduceat(s, starts))
                if len(full) <= d:  # two such sets may agree on empty cells only
                    empty = np.setdiff1d(np.arange(m, dtype=np.uint64), full)
                    full, sums = np.concatenate((full, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64)))
                found = shingles.mix(sums + full * np.uint64(0xA24BAED4963EE407)
                                     + np.uint64((c + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
                # of all cells in one order the least that both have is among the first d + 1 of each
                out.append(self._first(found, d + 1) if len(found) > d + 1 and len(starts) > d and not self.every else found)
        return np.unique(np.concatenate(out)) if out else s[:0]


def _node(s: np.ndarray) -> int:
    """One number for the whole set."""
    total = np.add.reduce(shingles.mix(s), keepdims=True)
    return int(shingles.mix(total + np.uint64(len(s))).view(np.int64)[0])


def _sketch(s: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Bit i tells whether an odd number of the set's shingles fall to i."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _features(width: int, percent: int, common_keys=None, every: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent, None if common_keys is None else np.frombuffer(common_keys.value, dtype=np.uint64), every)
        for batch in batches:
            sizes, nodes, keys, sketches, done = [], [], [], [], set()
            for s in shingles.shingle_sets(batch.column(1), width):
                sizes.append(len(s))
                nodes.append(node := _node(s) if len(s) else None)
                # copies of a text in one batch give its keys once
                first = len(s) and node not in done
                keys.append(scheme.keys(s).view(np.int64) if first else None)
                sketches.append(_sketch(s) if first and not every else None)
                done.add(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                                              _lists(keys), _lists(sketches)], schema=FEATURES)

    return run


def _lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    """An Arrow array of the ``arrays``; None is an empty one."""
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in arrays])
    flat = np.concatenate([x for x in arrays if x is not None] or [np.zeros(0, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingles.shingle_sets(batch.column(0), width))
            nodes = [_node(s) if len(s) else None for s in sets]
            ends = np.cumsum([0] + [len(s) for s in sets])
            sketches = pa.array(np.concatenate([_sketch(s, WIDE_BITS) for s in sets]) if sets else np.zeros(0, np.int64))
            sets = [s.view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets))),
                 pa.ListArray.from_arrays(pa.array((np.arange(len(nodes) + 1) * (WIDE_BITS // 64)).astype(np.int32)), sketches)],
                ["node", "members", "sketch"])

    return run


def _open_lists(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, node, component, n) of the lists in which more than one component meets; n members each.

    All aggregates on lists are partial, so a list with a third of all nodes is never held in one task.
    """
    bound = lists.count()
    if labels is None:
        rows = lists.withColumn("component", F.col("node"))
    else:
        rows = (lists.join(common.small_side(labels, 32, common.BOUNDED_BYTES), "node", "left")
                .withColumn("component", F.coalesce("component", "node")))
    open_ = (rows.groupBy(F.col("key").alias("_k"))
             .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
             .where("lo < hi").select("_k", "n"))
    open_ = common.bounded_side(common.few(open_, bound), bound, 16)  # half as many keys as rows at most, 32 bytes each
    return common.few(rows.join(open_, F.col("key") == F.col("_k")).drop("_k"), bound)


def _short(rows: DataFrame, least: int, pairs: int) -> int:
    """Up to how many members lists are compared pair by pair: ``least``, or more while that makes ``pairs`` pairs at most."""
    sizes = rows.where(F.col("n") <= MOST_SHORT).groupBy("n").agg((F.count("*") * (F.col("n") - 1) / 2).alias("pairs"))
    told = sorted((r["n"], r["pairs"]) for r in sizes.collect())  # one row per size, MOST_SHORT at most
    short, total = least, 0
    for n, more in told:
        total += more
        if total <= pairs:
            short = max(short, n)
    return short


def _homes(rows: DataFrame, bound: int) -> DataFrame:
    """``rows`` of lists, ``bound`` at most, with home: the node with the most lists among those that a node shares a list with.

    Among copies with scattered edits that is the original, or one near it.
    """
    side = lambda df: common.bounded_side(common.few(df, bound), bound, 48)
    fame = side(rows.groupBy(F.col("node").alias("_n")).agg(F.count("*").alias("fame")))
    rows = rows.join(fame, F.col("node") == F.col("_n")).drop("_n")
    top = side(rows.groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("fame", "node")).alias("top")))
    rows = rows.join(top, F.col("key") == F.col("_k")).drop("_k", "fame")
    home = side(rows.groupBy(F.col("node").alias("_n")).agg(F.max("top").alias("home")))
    rows = rows.drop("top").join(home, F.col("node") == F.col("_n"))
    return common.few(rows.select("key", "node", "component", F.col("home.node").alias("home")), bound)


def _linked(a: str, b: str, percent: int):
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _compare(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int, edits: bool) -> DataFrame:
    """``pairs`` (node, leader) with linked, and with ``edits`` for new lists those of node against leader; landed.

    While the pairs and the leaders' sets are small they are broadcast, and
    no set is shuffled; beyond that bound both joins shuffle.
    """
    landed = common.land(spark, pairs, "pairs")
    pairs = common.small_side(landed, 16)
    left = sets.select("node", F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("leader"), F.col("members").alias("y"))
    right = right.join(common.small_side(landed.select("leader").distinct(), 8), "leader", "left_semi")  # not landed: sets are long
    held = right.agg(F.coalesce(F.sum(8 * F.size("y") + 64), F.lit(0))).first()[0]
    right = F.broadcast(right) if held <= SETS_BYTES else right
    rows = left.join(pairs, "node").join(right, "leader").withColumn("linked", _linked("x", "y", percent))
    if not edits:
        told = common.land(spark, rows.select("node", "leader", "linked"), "across")
        common.drop_landed(spark, landed)
        return told
    # Linked sets differ in ``most`` shingles at most, so of each kind of edit one more than that is enough to share one.
    rows = (rows.withColumn("most", F.floor(F.size("x") * F.lit(100 - percent) / F.lit(percent)).cast("int"))
            .withColumn("gained", F.array_except("x", "y")).withColumn("lost", F.array_except("y", "x")))
    first = lambda c: F.slice(F.array_sort(c), 1, F.col("most") + 1)
    told = common.land(spark, rows.select(
        "node", "leader", "linked", "most", F.size("gained").alias("n_gained"), F.size("lost").alias("n_lost"),
        first("gained").alias("gained"), first("lost").alias("lost")), "compared")
    common.drop_landed(spark, landed)
    return told


def _possible(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """The ``pairs`` whose sketches allow a link; no linked pair is left out.

    Every shingle that one set has and the other hasn't changes one bit of the
    difference of their sketches, so at least as many shingles differ as bits.  Only the
    sketches and sizes travel, a small part of the sets.
    """
    size = F.col("size") if "size" in sets.columns else F.size("members")
    short = sets.select("node", size.alias("size"), "sketch")
    if short.count() * (sketch_bits // 8 + 64) <= SETS_BYTES:
        short = F.broadcast(short)
    rows = (pairs.join(short.withColumnsRenamed({"size": "a", "sketch": "x"}), "node")
            .join(short.withColumnsRenamed({"node": "leader", "size": "b", "sketch": "y"}), "leader"))
    bits = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, n: acc + n)
    most = F.expr(f"({100 - percent} * (a + b)) div {100 + percent}")
    smaller, larger = F.least("a", "b"), F.greatest("a", "b")
    return rows.where((100 * smaller >= percent * larger) & (bits <= most)).select("node", "leader")


def _edit_lists(told: DataFrame) -> DataFrame:
    """(key, node): the lists by leader and edit in which a stray may meet a set that it links to.

    Two sets that link share a shingle that both gained, or one that both
    lost.  Those that share lost ones only differ in all that they gained
    and in at least the difference of how many they lost.  So lost shingles make lists
    only where these counts leave room: the distinct counts of a leader are compared
    first, a small table.
    """
    strays = told.where("not linked").select("leader").distinct()
    near = told.join(strays, "leader", "left_semi")
    counts = near.groupBy("leader", "n_gained", "n_lost").agg(
        F.max("most").alias("most"), F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("strays"))
    x, y = counts.alias("x"), counts.alias("y")
    room = (F.col("x.n_gained") + F.col("y.n_gained") + F.abs(F.col("x.n_lost") - F.col("y.n_lost")) <= F.col("x.most"))
    other = (F.col("x.n_gained") != F.col("y.n_gained")) | (F.col("x.n_lost") != F.col("y.n_lost")) | (F.col("x.n") > 1)
    meet = x.where("strays > 0").join(y, (F.col("x.leader") == F.col("y.leader")) & room & other)
    both = F.array(*[F.struct(f"{s}.leader", f"{s}.n_gained", f"{s}.n_lost") for s in "xy"])
    open_ = meet.select(F.inline(both)).distinct()
    gained = near.select("node", "leader", F.lit(1).alias("kind"), F.explode("gained").alias("edit"))
    lost = (near.join(open_, ["leader", "n_gained", "n_lost"], "left_semi")
            .select("node", "leader", F.lit(2).alias("kind"), F.explode("lost").alias("edit")))
    return gained.unionByName(lost).select(F.xxhash64("kind", "leader", "edit").alias("key"), "node")


def _across(rows: DataFrame, by: str, bound: int) -> DataFrame:
    """(node, leader) pairs of nodes of different components, and of different ``by``, that share a list; pairs may repeat.

    ``rows`` has ``bound`` rows at most.
    """
    many = (rows.groupBy(F.col("key").alias("_k")).agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
            .where("lo < hi").select("_k"))
    many = common.bounded_side(common.few(many, bound), bound, 16)
    rows = rows.join(many, F.col("key") == F.col("_k"), "left_semi").select(*dict.fromkeys(["key", "node", "component", by]))
    a, b = rows.alias("a"), common.bounded_side(rows.alias("b"), bound, 48)
    return (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col(f"a.{by}") < F.col(f"b.{by}"))
                   & (F.col("a.component") != F.col("b.component")))
            .select(F.col("a.node").alias("node"), F.col("b.node").alias("leader")))


def _common_keys(spark: SparkSession, texts: DataFrame, width: int, percent: int):
    """The keys of cells that many of a part of the ``texts`` have, ascending, broadcast to the workers.

    They only settle the order of cells; every order gives all links.
    """
    step = min(PART, max(1, texts.count() // PART_ROWS))
    part = texts.where(F.pmod("h", F.lit(step)) == 0).mapInArrow(_features(width, percent, every=True), FEATURES_DDL)
    told = (part.select("node", F.explode("keys").alias("key")).groupBy("key")
            .agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
            .where((F.col("n") >= COMMON) & F.expr("lo < hi")).orderBy(F.desc("n"), "key").limit(COMMON_KEYS).select("key").collect())
    return spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in told], dtype=np.int64).view(np.uint64)).tobytes())


def _sets_for(spark: SparkSession, texts: DataFrame, found: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """node, members and wide sketch of every node in ``pairs``; landed."""
    needed = common.land(spark, pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).distinct(), "needed")
    # A node's text is that of one row with it: the row's id may be null, or another's too, so its text's hash counts as well.
    first = (found.join(common.small_side(needed, 16), "node", "left_semi").groupBy("node")
             .agg(F.min(F.struct("k", "h")).alias("at")).select(F.col("at.k").alias("_k"), F.col("at.h").alias("_h")).distinct())
    first = common.land(spark, first, "first")
    sets = common.land(spark, texts.join(common.small_side(first, 24), (F.col("h") == F.col("_h")) & F.col("k").eqNullSafe(F.col("_k")))
                       .select("text").mapInArrow(_sets(width), "node long, members array<long>, sketch array<long>"), "sets")
    if sets.count() > needed.count():  # rows that repeat, id and text: only then are the long sets shuffled
        repeated, sets = sets, common.land(spark, sets.dropDuplicates(["node"]), "sets")
        common.drop_landed(spark, repeated)
    common.drop_landed(spark, needed, first)
    return sets


def _in_blocks(percent: int, whole: bool):
    """Of rows that lie list by list, the pairs of different components that sizes and sketches allow: of each row all, or the nearest."""

    def compared(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(size := rows["size"].to_numpy(), kind="stable")
        node, component, block = (rows[c].to_numpy()[order] for c in ("node", "component", "block"))
        size, n = size[order], len(order)
        sketch = rows["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)[order]
        last = np.searchsorted(size, size * 100 // percent, "right")
        across = rows["lo"][0].as_py() < rows["hi"][0].as_py()  # two blocks of one list: pairs inside either are compared elsewhere
        at, out = np.arange(n), []
        for a in range(0, n, step := max(1, 8192 // n)):
            i = at[a:a + step, None]
            open_ = (at > i) & (at < last[i]) & (component != component[i])
            if across:
                open_ &= block != block[i]
            x, y = np.nonzero(open_)
            x += a
            bits = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
            near = bits <= (100 - percent) * (size[x] + size[y]) // (100 + percent)
            x, y, bits = x[near], y[near], bits[near]
            if not whole:
                by = np.lexsort((bits, x))
                x, y = x[by], y[by]
                first = np.flatnonzero(np.diff(x, prepend=-1))
                x, y = x[first], y[first]
            out.append((node[x], node[y]))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(rows):
                continue
            ids = np.stack([rows[c].to_numpy() for c in ("key", "lo", "hi")])
            starts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()]
            held = rows.slice(starts[-1])  # its end may be in the next batch
            yield from found([rows.slice(a, b - a) for a, b in zip(starts[:-1], starts[1:], strict=True)])
        if held is not None:
            yield from found([held])

    def found(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if groups:
            told = [compared(g) for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in told]), pa.int64()) for i in (0, 1)], ["node", "leader"])

    return run


def _block_pairs(rows: DataFrame, nodes: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(node, leader) of different components that share a list of ``rows`` and may link; unless ``whole`` each row's nearest in a block.

    A list of more than BLOCK members is cut into blocks, and each two of them meet in one group: no
    group has many more than 2 BLOCK rows.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    held = nodes.select("node", "size", "sketch")
    rows = (rows.join(common.small_side(held, SKETCH_BITS // 8 + 64, SETS_BYTES), "node")
            .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                    "block", "node", "component", "size", "sketch"))
    return (rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(_in_blocks(percent, whole), "node long, leader long"))


def _total_pairs(rows: DataFrame) -> float:
    """How many pairs of rows share a list."""
    return rows.agg(F.coalesce(F.sum((F.col("n") - 1) / 2), F.lit(0.0))).first()[0]


def components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_shingles, node (one number per distinct set) and component_id.

    component_id is the least id that links reach, the row's own included;
    rows without words (null and empty texts) link to nothing.  Rows with a
    null id take part; the component of null ids alone is null.  Equal rows
    give equal results, an empty table an empty one; extra columns are ignored.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("k"), text.alias("text"), F.xxhash64(text).alias("h"))
    shared = _common_keys(spark, texts, width, percent)
    keyed = common.land(spark, texts.mapInArrow(_features(width, percent, shared), FEATURES_DDL), "shingles")
    # One exchange by key serves the lists' extremes and their members.
    rows = keyed.where(F.size("keys") > 0).select("node", F.explode("keys").alias("key")).repartition("key")
    many = (rows.groupBy(F.col("key").alias("_k")).agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
            .where("lo < hi").select("_k"))
    lists = common.land(spark, rows.join(many.hint("shuffle_hash"), F.col("key") == F.col("_k"), "left_semi")
                        .select("key", "node").distinct(), "lists")
    # Sketches of the listed nodes, and rows without keys: the keys themselves are done with.
    listed = common.land(spark, lists.select("node").distinct(), "listed")
    nodes = common.land(spark, keyed.where(F.size("sketch") > 0).select("node", F.col("n_shingles").alias("size"), "sketch")
                        .join(common.small_side(listed, 16), "node", "left_semi").dropDuplicates(["node"]), "nodes")
    found = common.land(spark, keyed.select("k", "h", "n_shingles", "node"), "found")
    common.drop_landed(spark, keyed, listed)
    labels, before, nearest = None, [], False
    n_nodes = nodes.count()
    while True:
        rows = common.land(spark, _open_lists(lists, labels), "open")
        if not (n := rows.count()):
            break
        direct, last = nearest or _total_pairs(rows) <= BLOCK_PAIRS * n_nodes, nearest
        if direct:
            # First short lists and each row's nearest in longer ones, then what is still open in those.
            apart = _block_pairs(rows.where(F.col("n") > FIRST_SHORT), nodes, percent, nearest)
            if not nearest:
                small = rows.where(F.col("n") <= FIRST_SHORT)
                apart = apart.unionByName(_possible(spark, _across(small, "component", n).distinct(), nodes, percent))
            pairs = common.land(spark, apart.select(F.least("node", "leader").alias("node"), F.greatest("node", "leader").alias("leader"))
                                .distinct(), "apart")
            sets = _sets_for(spark, texts, found, pairs, width)
            told = _compare(spark, _possible(spark, pairs, sets, percent, WIDE_BITS), sets, percent, False)
            new, done, nearest = told.where("linked").select("node", "leader"), [rows, pairs, sets, told], True
        else:
            short = _short(rows, FIRST_SHORT if labels is None else SHORT, PAIRS * n_nodes)
            long = common.land(spark, _homes(rows.where(F.col("n") > short), n), "homes")
            pairs = common.land(spark, long.where("node <> home").select("node", F.col("home").alias("leader")).distinct(), "to-homes")
            apart = _across(long, "home", n).unionByName(_across(rows.where(F.col("n") <= short), "component", n)).distinct()
            apart = common.land(spark, _possible(spark, apart, nodes, percent), "apart")
            sets = _sets_for(spark, texts, found, pairs.unionByName(apart), width)
            told = _compare(spark, pairs, sets, percent, True)
            across = _compare(spark, _possible(spark, apart, sets, percent, WIDE_BITS), sets, percent, False)
            new = told.where("linked").select("node", "leader").unionByName(across.where("linked").select("node", "leader"))
            done = [rows, long, pairs, apart, sets, across, told, lists]
        new = common.land(spark, new.select(F.col("node").alias("a"), F.col("leader").alias("b")), "new-links")
        # Labels stand for the links of all rounds before.
        links = new if labels is None else new.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        # The next round reads this one's new lists and labels; all else of it and of the round before is done with.
        done += [new, *before]
        before = [] if labels is None else [labels]
        labels = common.land(spark, connected_components(spark, links), "labels")
        if not direct:
            lists = common.land(spark, _edit_lists(told), "lists")
        common.drop_landed(spark, *done)
        if last:
            break
    common.drop_landed(spark, nodes, lists)
    rooted = found.select("k", "n_shingles", "node")
    if labels is None:
        rooted = rooted.withColumn("root", F.col("node"))
    else:
        rooted = rooted.join(common.small_side(labels, 32, common.BOUNDED_BYTES), "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    least = rooted.where("root is not null").groupBy(F.col("root").alias("_r")).agg(F.min("k").alias("least"))
    return (rooted.join(least, F.col("root") == F.col("_r"), "left")
            .select(F.col("k").alias(id_col), "n_shingles", "node",
                    F.when(F.col("root").isNull(), F.col("k")).otherwise(F.col("least")).alias("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that link to a row with a smaller id.

    The row with the least id of each component stays; rows with a null id, and
    without words, stay too.
    """
    told = components(spark, docs, id_col, text_col, width, percent)
    name = common.fresh(docs, "_gone")
    gone = told.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    gone = common.small_side(common.land(spark, gone, "gone"), 16)
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
