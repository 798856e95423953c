"""Periodic runs of words by block convolution (operator 12).

A run is a maximal stretch of words with smallest period q (words q apart are
equal) that is at least ``LEAST_WORDS`` words and ``LEAST_TIMES`` periods long.

At each dyadic scale b the words are cut into blocks of b.  A run with a period
of b to 2 b - 1 contains a whole block and, q words later, its copy (at the
least scale this holds for all smaller periods too).  So each block is compared
with the windows that follow it: the sum of squared differences between the block and
every place of a window comes from one cyclic correlation, computed exactly by a
number-theoretic transform modulo a prime.  A sum of zero gives a distance;
from block and distance the run is extended word by word in both directions,
which also refutes the rare sum that is only a multiple of the prime.

A text is one row and is worked on in one task; short texts are transformed many
at a time.  Work is n log(n)^2 for a text of n words; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_WORDS, LEAST_TIMES = 24, 3
#: 119 * 2**23 + 1 and a generator of its multiplicative group: transforms of up to 2**23 numbers.
PRIME, GENERATOR = 998244353, 3
#: The least block; with runs of 24 words or more it serves all periods below 16.
LEAST_BLOCK = 8
#: Larger blocks are compared by their first words, window by window.
MOST_BLOCK = 1 << 22
#: Numbers transformed at a time (a cache-sized table) and bytes of text worked on at a time.
TABLE, CHUNK = 1 << 15, 2 << 20

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_DDL = "array<struct<start:bigint,length:bigint,period:bigint>>"

_P = np.uint64(PRIME)
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of an n-th root of one, or of its inverse."""
    if (n, inverse) not in _roots:
        root = pow(GENERATOR, (PRIME - 1) // n * (-1 if inverse else 1), PRIME)
        out = np.ones(max(1, n // 2), dtype=np.uint64)
        have = 1
        while have < len(out):  # doubling: the next powers are those known times root**have
            take = min(have, len(out) - have)
            out[have:have + take] = out[:take] * np.uint64(pow(root, have, PRIME)) % _P
            have += take
        _roots[n, inverse] = out
    return _roots[n, inverse]


def _reduce(x: np.ndarray, spare: np.ndarray) -> None:
    """x modulo the prime, in place."""
    np.floor_divide(x, _P, out=spare)
    np.multiply(spare, _P, out=spare)
    np.subtract(x, spare, out=x)


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """x modulo the prime for x below twice the prime, in place."""
    np.subtract(x, _P, out=spare)
    np.minimum(x, spare, out=x)


def _levels(x: np.ndarray, span: int, least: int, inverse: bool) -> np.ndarray:
    """Butterflies over (parts, span, columns) for spans from ``span`` down to ``least``, or back up."""
    half_size = x.size // 2
    one, two = np.empty(half_size, np.uint64), np.empty(half_size, np.uint64)
    spans = []
    while span >= least:
        spans.append(span)
        span //= 2
    for span in reversed(spans) if inverse else spans:
        half = span // 2
        view = x.reshape(-1, 2, half, x.shape[-1])
        a, b = view[:, 0], view[:, 1]
        s, t = one.reshape(a.shape), two.reshape(a.shape)
        w = _powers(span, inverse)[:, None]
        if inverse:
            np.multiply(b, w, out=s)
            _reduce(s, t)
            np.subtract(a, s, out=b)
            np.add(b, _P, out=b)
            _fold(b, t)
            np.add(a, s, out=a)
            _fold(a, t)
        else:
            np.subtract(a, b, out=s)
            np.add(s, _P, out=s)
            np.add(a, b, out=a)
            _fold(a, t)
            np.multiply(s, w, out=s)
            _reduce(s, t)
            b[...] = s
    return x


def _split(n: int, columns: int) -> int:
    """The span at which a table of few columns is turned so that rows stay long."""
    return n if columns >= 64 else max(2, 1 << (n.bit_length() // 2))


def transform(x: np.ndarray) -> np.ndarray:
    """The transform of each column of (n, columns), in an order that :func:`inverse` undoes."""
    n, columns = x.shape
    turn = _split(n, columns)
    if turn == n:
        return _levels(x, n, 2, False)
    x = _levels(x, n, 2 * turn, False).reshape(n // turn, turn, columns)
    return _levels(np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(turn, -1), turn, 2, False)


def inverse(x: np.ndarray, n: int, columns: int) -> np.ndarray:
    """n times what :func:`transform` was given."""
    turn = _split(n, columns)
    if turn == n:
        return _levels(x, n, 2, True)
    x = _levels(x, turn, 2, True).reshape(turn, n // turn, columns)
    return _levels(np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(n, columns), n, 2 * turn, True)


def _strips(v: np.ndarray, start: int, step: int, length: int, count: int) -> np.ndarray:
    """(length, count): v from start, start + step, ... on."""
    return np.lib.stride_tricks.as_strided(v[start:], (length, count), (v.itemsize, step * v.itemsize))


def zero_mismatches(values: np.ndarray, block: int, most: int = MOST_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Of all blocks of ``values``, (first place, distance) where the words that follow repeat the block.

    Distances are ``block`` to 2 ``block`` - 1, at the least scale also the
    smaller ones.  A pair is missing for no repetition; one in a billion may be none.
    """
    count = len(values) // block
    width = min(block, most)
    n = 2 * width
    v = np.concatenate((values.astype(np.uint64) % _P, np.zeros(4 * block, np.uint64)))
    squares = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * v % _P, dtype=np.uint64)))
    # twice the correlation, and the transforms' factor n taken back
    scale = np.uint64(2 * pow(n, -1, PRIME) % PRIME)
    firsts = ([0] if block == LEAST_BLOCK else []) + list(range(block, 2 * block, width))
    at_once = max(1, TABLE // n)
    places, distances = [], []
    for lo in range(0, count, at_once):
        g = min(at_once, count - lo)
        begin = lo * block
        pattern = np.zeros((n, g), np.uint64)
        strip = _strips(v, begin, block, width, g)
        pattern[0] = strip[0]
        pattern[n - width + 1:] = strip[:0:-1]
        pattern *= scale
        pattern %= _P
        pattern = transform(pattern)
        own = _strips(squares, begin + width, block, 1, g) - _strips(squares, begin, block, 1, g)
        for first in firsts:
            both = transform(_strips(v, begin + first, block, n, g).copy())
            spare = np.empty_like(both)
            np.multiply(both, pattern, out=both)
            _reduce(both, spare)
            cross = inverse(both, n, g)[:width]
            theirs = _strips(squares, begin + first + width, block, width, g) - _strips(squares, begin + first, block, width, g)
            distance, column = np.nonzero((own + theirs) % _P == cross)
            places.append(begin + column * block)
            distances.append(first + distance)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, distances = np.concatenate(places), np.concatenate(distances)
    real = distances > 0
    return places[real].astype(np.int64), distances[real].astype(np.int64)


def _equal_from(v: np.ndarray, i: int, q: int, end: int) -> int:
    """The first place from ``i`` on whose word differs from the one q later, or the last q words of ``end``."""
    step = 64
    while i + q < end:
        n = min(step, end - q - i)
        differs = v[i:i + n] != v[i + q:i + q + n]
        at = int(differs.argmax())
        if differs[at]:
            return i + at
        i, step = i + n, 2 * step
    return i


def _equal_to(v: np.ndarray, i: int, q: int, begin: int) -> int:
    """The first place of the stretch before ``i`` whose words all equal the ones q later."""
    step = 64
    while i > begin:
        n = min(step, i - begin)
        differs = (v[i - n:i] != v[i - n + q:i + q])[::-1]
        at = int(differs.argmax())
        if differs[at]:
            return i - at
        i, step = i - n, 2 * step
    return i


def find_runs(ids: np.ndarray, limits: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts that lie end to end.

    ``ids`` numbers the words so that no two texts share a number; text i is
    ids[limits[i]:limits[i + 1]].  Starts count from the whole array's begin.
    """
    sizes = np.diff(limits)
    out: list[tuple[int, int, int]] = []
    stretches: dict[tuple[int, int], int] = {}  # (start, end): smallest period, of every stretch looked at
    block = LEAST_BLOCK
    while True:
        long = np.flatnonzero(sizes >= max(least, times * block if block > LEAST_BLOCK else 0))
        if not len(long):
            return out
        # the texts long enough for this scale, end to end, and where each word of them stands in ids
        lengths = sizes[long]
        ends = np.cumsum(lengths)
        if len(long) == len(sizes):
            part, shift = ids, np.zeros(len(long), np.int64)
        else:
            shift = limits[long] - (ends - lengths)
            part = ids[np.repeat(shift, lengths) + np.arange(int(ends[-1]))]
        place, distance = zero_mismatches(part, block)
        text = np.searchsorted(ends, place, "right")
        inside = place + block + distance <= ends[np.minimum(text, len(ends) - 1)]
        place, distance, text = place[inside], distance[inside], text[inside]
        place = place + shift[text]
        order = np.lexsort((distance, place))
        _look(ids, limits, long[text[order]], place[order], distance[order], block, least, times, stretches, out)
        block *= 2


def _look(ids, limits, text, place, distance, block, least, times, stretches, out) -> None:
    """Extends the pairs of one scale, smaller distances first, and adds stretches and runs.

    A stretch with a period that divides the distance explains a pair inside it: the
    pair's own stretch is the same, as both overlap in more than both periods.
    """
    open_ = np.ones(len(place), bool)
    width = min(block, MOST_BLOCK)

    def explain(start: int, end: int, q: int) -> None:
        if q <= width:
            a, b = np.searchsorted(place, (start, end))
            inside = slice(int(a), int(b))
            open_[inside] &= (distance[inside] % q != 0) | (place[inside] + width + distance[inside] > end)

    for (start, end), q in stretches.items():
        explain(start, end, q)
    todo = np.flatnonzero(open_)
    for i in todo[np.argsort(distance[todo], kind="stable")].tolist():
        if not open_[i]:
            continue
        at, q, t = int(place[i]), int(distance[i]), int(text[i])
        begin, end = int(limits[t]), int(limits[t + 1])
        stop = _equal_from(ids, at, q, end)
        if stop < at + width:
            continue  # only a multiple of the prime
        start, stop = _equal_to(ids, at, q, begin), stop + q
        if (start, stop) in stretches:
            continue  # with a smaller period
        stretches[start, stop] = q
        open_[i] = False
        explain(start, stop, q)
        if stop - start >= max(least, times * q):
            out.append((start, stop - start, q))


def _words(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, their numbers end to end, and where each text begins."""
    rows = [t.split() if t else [] for t in texts]
    numbers, first = [], 0
    for row in rows:
        known: dict[bytes, int] = dict(zip(dict.fromkeys(row), range(first, first + len(row)), strict=False))
        numbers.append(np.fromiter(map(known.__getitem__, row), np.int64, len(row)))
        first += len(known)
    return rows, np.concatenate(numbers or [np.zeros(0, np.int64)]), np.cumsum([0] + [len(r) for r in rows])


def _collapsed(row: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text without those after the first period of a run, with one blank between."""
    if runs:
        keep = np.ones(len(row), bool)
        for start, length, q in runs:
            keep[start + q:start + length] = False
        row = [row[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(row)


def _task(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
            a = 0
            while a < len(texts):
                b, total = a + 1, sizes[a]
                while b < len(texts) and total + sizes[b] <= CHUNK:
                    total += sizes[b]
                    b += 1
                rows, ids, limits = _words(texts[a:b].to_pylist())
                found: list[list] = [[] for _ in rows]
                for start, length, q in sorted(find_runs(ids, limits, least, times)):
                    t = int(np.searchsorted(limits, start, "right")) - 1
                    found[t].append((start - int(limits[t]), length, q))
                flat = [r for runs in found for r in runs]
                ends = pa.array(np.cumsum([0] + [len(f) for f in found]), pa.int32())
                struct = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)],
                                                    fields=list(RUNS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([len(r) for r in rows], pa.int64()), pa.ListArray.from_arrays(ends, struct, type=RUNS),
                     pa.array([_collapsed(r, f).decode() for r, f in zip(rows, found, strict=True)], pa.string())],
                    ["k", "n_words", "runs", "collapsed"])
                a = b

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS,
                  times: int = LEAST_TIMES) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are runs of characters other than blank, \\t, \\n, \\v, \\f, \\r, numbered
    from 0.  ``collapsed`` is the text without the words that repeat a run's
    first period.  Null and empty texts have no words, no runs and an empty
    text; rows with equal or null ids are worked on one by one; an empty table
    gives an empty one; extra columns are ignored.  ``least`` must be 24 or more and ``times`` 3 or more
    (below that a run may hold no whole block with its copy).
    """
    if least < 3 * LEAST_BLOCK or times < 3:
        raise ValueError("runs must have at least 24 words and 3 periods")
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(_task(least, times), f"k long, n_words long, runs {RUNS_DDL}, collapsed string")
            .select(F.col("k").alias(id_col), "n_words", "runs", "collapsed"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; of equal ones that with the smallest start, then period."""
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])
    # runs come by start and period, so the first of equal ones stays
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the runs that the query's contract plants in a tenth of the rows."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.coalesce(F.regexp_extract_all("text", F.lit(f"({common.WORD_PATTERN})"), F.lit(1)), F.array().cast("array<string>"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    changed = F.expr("array_join(transform(w, (x, i) -> get(w, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(common.table(spark, sf_dir, "documents"))))


def digests(found: DataFrame) -> DataFrame:
    """The columns that the query's contract names, from the runs and collapsed texts."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = strongest(F.col("runs"))
    return (found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
