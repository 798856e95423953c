"""Context-tree weighting as a language model over bytes (operator 10).

A text is coded as its words with one blank between them and an end symbol,
byte by byte, each byte as eight binary decisions from the high bit down.  Each
decision (the bits of the byte so far) has its own tree over the bytes before
it, up to ``DEPTH``.  A node keeps how often its decision was 0 and 1; its
Krichevsky-Trofimov probability competes with the product of its children's,
half and half, at every depth.

Training counts runs of ``DEPTH`` + 1 bytes in tasks and adds them up by
shuffle; node counts and weighted probabilities go up the tree by one grouping a
depth, and each node's predictive probability comes down by one join a depth.
The code length of every run that occurs anywhere in the corpus is then a
table, and a text's score is the sum of its runs' entries.

Scoring keeps the commonest runs (and, for the word-count baseline, words) in
memory, a fixed number; the others of a text go through a join.  Nothing is
left out at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

DEPTH = 5
END = 0xFF  # no byte of UTF-8
#: Runs, and words, kept in each Python worker for scoring (16 bytes each).
HOT = 2_500_000
HOT_WORDS = 1_000_000
#: Distinct runs, or words, that a task adds up in memory before it hands them on (16 bytes each, up to twice as many).
TASK_KEYS = 2_000_000
#: Bytes of text that a counting task gets at least, where parts are smaller.
PART_BYTES = 32 << 20
#: The hash that stands for the end of a text among the words.
END_WORD = 0x5851F42D4C957F2D
FOLDS, HELD_OUT = 7, 2
WORD, RUN = 0, 1


def stream(low: np.ndarray, owner: np.ndarray, begins: np.ndarray, stops: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of ``n`` texts end to end, and where each one's begin (one more at the end)."""
    length = stops - begins
    empty = np.ones(n, dtype=bool)
    empty[owner] = False
    blank_texts = np.cumsum(empty)
    before = np.cumsum(length) - length
    at = before + np.arange(len(length)) + blank_texts[owner]
    out = np.full(int(length.sum()) + len(length) + int(empty.sum()), END, dtype=np.uint8)
    source = np.repeat(begins - before, length) + np.arange(int(length.sum()))
    out[np.repeat(at - before, length) + np.arange(int(length.sum()))] = low[source]
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    out[at[inner] + length[inner]] = 32
    sizes = np.bincount(owner, weights=length + 1, minlength=n).astype(np.int64) + empty
    return out, np.concatenate(([0], np.cumsum(sizes)))


def runs(coded: np.ndarray, limits: np.ndarray, depth: int) -> np.ndarray:
    """For every byte the number made of it (low byte) and the ``depth`` bytes before it; before a text stand end symbols."""
    at = np.arange(len(coded)) + np.repeat(depth * np.arange(1, len(limits)), np.diff(limits))
    padded = np.full(len(coded) + depth * (len(limits) - 1), END, dtype=np.int64)
    padded[at] = coded
    key, span = padded.copy(), 1  # numbers of 1, 2, 4, ... bytes, then the whole
    while span <= depth:
        step = min(span, depth + 1 - span)
        key[step:] |= key[:-step] << (8 * step) if len(key) > step else key[:0]
        span += step
    return key[at] & ((1 << (8 * (depth + 1))) - 1)


def _pieces(texts: pa.Array, depth: int):
    """(first row, rows, word hashes with ends, their texts, runs, limits of the runs by text)."""
    for a, b, data, ends in shingles.chunks(texts):
        hashes, owner, begins, stops = shingles.words(data, ends)
        coded, limits = stream(shingles.lower(data), owner, begins, stops, b - a)
        tokens = np.concatenate((hashes, np.full(b - a, END_WORD, dtype=np.uint64))).view(np.int64)
        yield a, b - a, tokens, np.concatenate((owner, np.arange(b - a))), runs(coded, limits, depth), limits


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {WORD: [], RUN: []}
        held = {WORD: 0, RUN: 0}

        def merged(kind: int) -> None:
            parts[kind] = [_added(parts[kind])]
            held[kind] = len(parts[kind][0][0])

        def given(kind: int) -> Iterator[pa.RecordBatch]:
            merged(kind)
            keys, counts = parts[kind].pop()
            held[kind] = 0
            for at in range(0, len(keys), 1 << 20):
                k, c = keys[at:at + (1 << 20)], counts[at:at + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c)],
                                                 ["kind", "key", "n"])

        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            for a, n, tokens, owner, keys, limits in _pieces(batch.column(2), depth):
                of = learn[a:a + n]
                for kind, values, mine in ((WORD, tokens, of[owner]), (RUN, keys, np.repeat(of, np.diff(limits)))):
                    found, counts = np.unique(values[mine], return_counts=True)
                    parts[kind].append((found, counts))
                    held[kind] += len(found)
                    if not of.all():  # what occurs in held-out texts only has the count 0
                        other = np.unique(values[~mine])
                        parts[kind].append((other, np.zeros(len(other), dtype=np.int64)))
                        held[kind] += len(other)
                    if held[kind] > 2 * TASK_KEYS:
                        merged(kind)
                        if held[kind] > TASK_KEYS:
                            yield from given(kind)
        for kind, found in parts.items():
            if found:
                yield from given(kind)

    return run


def _packed(texts: DataFrame) -> DataFrame:
    """``texts`` in parts of ``PART_BYTES`` of text or more, at least one a core, so that a task adds up many texts' runs.

    Parts are joined as they lie, without a shuffle; where they are larger already nothing changes.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, by Stirling's series eight steps up."""
    z = x + 8
    steps = F.lit(0.0)
    for k in range(0, 8, 4):
        steps = steps + F.log((x + k) * (x + k + 1) * (x + k + 2) * (x + k + 3))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def log_kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def _up(key: Column, depth: int) -> Column:
    """The node's parent, ``depth`` being the node's own: its context without the farthest byte."""
    return key.bitwiseAND(F.lit((1 << (8 * depth)) - 1))


def _decisions(grams: DataFrame, depth: int) -> DataFrame:
    """gram, n, node, bit of the eight decisions of each run.  node: context above, bits so far in the low byte."""
    context = F.shiftleft(F.shiftright(F.col("gram"), 8), 8)
    so_far = F.expr("shiftleft(1L, _b)") + F.expr("shiftright(gram & 255L, 8 - _b)")
    return (grams.withColumn("_b", F.explode(F.array(*[F.lit(i) for i in range(8)])))
            .select("gram", "n", (context + so_far).alias("node"),
                    F.expr("shiftright(gram & 255L, 7 - _b) & 1L").alias("bit")))


def train(spark: SparkSession, grams: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """Per depth 0 to ``depth`` the landed table (node, acc, rem): the probability of a 1 where the
    context is known to this depth and not further is acc + rem / 2.  ``grams``: (gram, n), of which only n > 0 count."""
    counted = _decisions(grams.where("n > 0"), depth).groupBy("node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("n0"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("n1"))
    n0, n1 = F.col("n0"), F.col("n1")
    levels = [common.land(spark, counted.withColumn("weighted", log_kt(n0, n1)).withColumn("odds", F.lit(None).cast("double")),
                          "tree")]
    for d in range(depth, 0, -1):
        up = (levels[0].groupBy(_up(F.col("node"), d).alias("node"))
              .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
              .withColumn("own", log_kt(n0, n1)).withColumn("odds", F.col("own") - F.col("below")))
        # ln(1/2 exp(own) + 1/2 exp(below))
        weighted = F.greatest("own", "below") + F.log1p(F.exp(-F.abs("odds"))) - math.log(2)
        levels.insert(0, common.land(spark, up.select("node", "n0", "n1", weighted.alias("weighted"), "odds"), "tree"))
    tables = []
    for d, level in enumerate(levels):
        one = (n1 + 0.5) / (n0 + n1 + 1)
        share = F.lit(1.0) if d == depth else 1 / (1 + F.exp(-F.col("odds")))
        if d == 0:
            now = level.withColumn("acc", F.lit(0.0)).withColumn("rem", F.lit(1.0))
        else:
            above = tables[-1].select(F.col("node").alias("_up"), "acc", "rem")
            now = level.join(above, _up(F.col("node"), d) == F.col("_up"))
        now = (now.withColumn("acc", F.col("acc") + F.col("rem") * share * one)
               .select("node", "acc", (F.col("rem") * (1 - share)).alias("rem")))
        tables.append(common.land(spark, now, "tree"))
        common.drop_landed(spark, level)
    return tables


def lengths(spark: SparkSession, grams: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The landed table (gram, value): log10 of each run's probability, also of runs that training never saw.

    A decision is looked up at the full depth, where it isn't found at one
    less, and so on; one never met has probability 1/2.
    """
    depth = len(tables) - 1
    look = lambda rows, d, how: rows.join(
        tables[d].select(F.col("node").alias("_node"), (F.col("acc") + F.col("rem") / 2).alias("p1")),
        F.col("node") == F.col("_node"), how)
    # Runs that training saw have all their decisions at the full depth; only the others go down.
    done = look(_decisions(grams.where("n > 0"), depth), depth, "inner").select("gram", "bit", "p1")
    open_ = _decisions(grams.where("n = 0"), depth).select("gram", "node", "bit")
    steps = []
    for d in range(depth, -1, -1):
        told = common.land(spark, look(open_, d, "left"), "decisions")
        steps.append(told)
        done = done.unionByName(told.where("p1 is not null").select("gram", "bit", "p1"))
        open_ = told.where("p1 is null").select("gram", _up(F.col("node"), d).alias("node") if d else F.col("node"), "bit")
    done = done.unionByName(open_.select("gram", "bit", F.lit(0.5).alias("p1")))
    p = F.when(F.col("bit") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    out = common.land(spark, done.groupBy("gram").agg(F.sum(F.log10(p)).alias("value")), "lengths")
    common.drop_landed(spark, *steps)
    return out


class Table:
    """A hash table of 64-bit keys and numbers in two arrays, looked up for many keys at once."""

    EMPTY = np.iinfo(np.int64).min

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(1.6 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.values = np.zeros(1 << self.bits)
        keys, values = keys[keys != self.EMPTY], values[keys != self.EMPTY]
        at = self._place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value or 0) of each wanted key."""
        at = self._place(wanted)
        got = self.keys[at]
        hit, value = got == wanted, self.values[at]
        value[~hit] = 0.0
        open_ = np.flatnonzero(~hit & (got != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[open_]]
            found = got == wanted[open_]
            hit[open_[found]] = True
            value[open_[found]] = self.values[at[open_[found]]]
            open_ = open_[~found & (got != self.EMPTY)]
        return hit, value


SCORED = ("row long, k long, held_out boolean, n_tokens long, n_bytes long, hot_base double, hot_known long, "
          "hot_score double, words array<long>, word_counts array<long>, grams array<long>, gram_counts array<long>")


def _rare(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Lists, one per text, of the distinct values that are not in the hot table, and their counts."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))) if len(v) else np.zeros(0, int)
    counts = np.diff(np.append(new, len(v)))
    ends = pa.array(np.searchsorted(o[new], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(v[new])), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))


def _score(shared, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, n, tokens, owner, keys, limits in _pieces(batch.column(2), depth):
                hit, value = words.find(tokens)
                base = np.bincount(owner, weights=value, minlength=n)
                known = np.bincount(owner, weights=hit, minlength=n).astype(np.int64)
                rare = _rare(tokens[~hit], owner[~hit], n)
                of = np.repeat(np.arange(n), np.diff(limits))
                hit, value = grams.find(keys)
                score = np.bincount(of, weights=value, minlength=n)
                rare_grams = _rare(keys[~hit], of[~hit], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0)[a:a + n], pa.compute.invert(batch.column(1)[a:a + n]),
                     pa.array(np.bincount(owner, minlength=n)), pa.array(np.diff(limits)), pa.array(base), pa.array(known),
                     pa.array(score), *rare, *rare_grams],
                    ["row", "k", "held_out", "n_tokens", "n_bytes", "hot_base", "hot_known", "hot_score", "words",
                     "word_counts", "grams", "gram_counts"])
                row += n

    return run


def _hot(table: DataFrame, most: int) -> Table:
    """The ``most`` commonest rows of (key, n, value)."""
    top = table.where("n > 0").orderBy(F.col("n").desc(), "key").limit(most).select("key", "value").toArrow()
    return Table(top.column(0).to_numpy(), top.column(1).to_numpy())


def _rest(scored: DataFrame, keys: str, counts: str, table: DataFrame) -> DataFrame:
    """Per row what the keys outside the hot table add: (row, value, known)."""
    each = scored.select("row", F.explode(F.arrays_zip(keys, counts)).alias("z")).select(
        "row", F.col(f"z.{keys}").alias("_key"), F.col(f"z.{counts}").alias("c"))
    return (each.join(table.select("key", "n", "value"), F.col("_key") == F.col("key"))
            .groupBy(F.col("row").alias("_row"))
            .agg(F.sum(F.col("c") * F.col("value")).alias("value"),
                 F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(0)).alias("known")))


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
          hot: int = HOT, hot_words: int = HOT_WORDS) -> DataFrame:
    """Learn from the training rows of ``docs`` and score all rows.

    Columns: ``id_col``, held_out (crc32 of the id as text leaves 2 modulo 7;
    a null id counts as empty text), n_tokens (words and one end), n_known,
    train_tokens, base_score, score (log10 probability of the coded text)
    and bits_per_byte.  Null text counts as empty: only its end is scored.  Equal rows are scored
    each; without training rows nothing is known.  Extra columns are ignored.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), (fold != HELD_OUT).alias("learn"),
                        F.col(text_col).cast("string").alias("text"))
    counts = common.land(spark, _packed(texts).mapInArrow(_count(depth), "kind int, key long, n long")
                         .groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n", F.log10(F.col("n") + 1.0).alias("value"))
    about = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    grams = counts.where(F.col("kind") == RUN).select(F.col("key").alias("gram"), "n")
    tree = train(spark, grams, depth)
    told = lengths(spark, grams, tree)
    common.drop_landed(spark, *tree)
    table = common.land(spark, grams.join(told, "gram").select(F.col("gram").alias("key"), "n", "value"), "code")
    common.drop_landed(spark, told)
    shared = spark.sparkContext.broadcast((_hot(words, hot_words), _hot(table, hot)))
    scored = common.land(spark, texts.mapInArrow(_score(shared, depth), SCORED), "scored")
    for name, keys, c, of in (("base", "words", "word_counts", words), ("gram", "grams", "gram_counts", table)):
        rest = _rest(scored, keys, c, of).select("_row", F.col("value").alias(f"{name}_rest"), F.col("known").alias(f"{name}_known"))
        scored = scored.join(rest, F.col("row") == F.col("_row"), "left").drop("_row", keys, c)
    none = lambda c: F.coalesce(c, F.lit(0))
    total = F.col("hot_score") + none(F.col("gram_rest"))
    return scored.select(
        F.col("k").alias(id_col), "held_out", "n_tokens", (F.col("hot_known") + none(F.col("base_known"))).alias("n_known"),
        F.lit(about["n"]).cast("long").alias("train_tokens"),
        (F.col("hot_base") + none(F.col("base_rest")) - F.col("n_tokens") * math.log10(about["n"] + about["v"] + 1)).alias("base_score"),
        total.alias("score"), (-total * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, common.table(spark, sf_dir, "documents"))
