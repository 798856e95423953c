"""Benchmark decontamination by BM25 with block-max pruning (operator 4).

Test items are the indexed texts; every training passage (a window of words)
is a query.  An item's BM25 weights are divided by their sum, so a passage's
score is the share of the item's weight that it holds, and one threshold
serves all items.  All items at or above it are retrieved, then verified: the
word runs of the question and those of the answer must both be in the passage.
Words are compared in lower case and without punctuation.  Scripts written
without blanks (Chinese, Japanese, Thai, ...) give a word a character.

The search is WAND over blocks, for many passages at a time.  Of each item
the commonest terms, as many as together stay below the threshold, can't
reach it alone: only the other, essential lists are walked.  Their block
maxima plus the most that the left-out terms of a block can add give a bound
for (passage, block); blocks below the threshold are skipped, then items by
the same bound, and only the rest is scored in full.  Nothing at or above the
threshold is lost.

The index is cut into shards of a bounded number of words; each is broadcast
in turn and meets all documents, so a benchmark of any size is searched.  An
item's passages follow its own length: a shard has an index for each class of
lengths, and one pass over a text searches all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: Least share of the word runs of the question, and of the answer, that a passage must hold.
QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.5
RUN = 3
MIN_ANSWER_WORDS = 4
BLOCK_ITEMS = 16
#: Words of the items of one shard: about 16 MB when broadcast.
SHARD_WORDS = 1 << 19
FOUND_DDL = "k long, text_hash long, item_id long, start int, score double, question_share double, answer_share double"

#: Punctuation that counts as white space, in items and documents alike.
MARKS = ".,;:!?#*$%&|<>()[]{}=+/_~^`\"'-"


#: White space besides the bytes that end a word (9 to 13 and 32).
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\t\n\v\f\r ")
#: Characters of scripts without blanks between words, for regular expressions of Java and Python.
UNSPACED = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007),
    (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9DF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))) + "]"
_BLANKED = dict.fromkeys(map(ord, MARKS + SPACES), " ")


def normal(text: Column) -> Column:
    """Lower case (of all scripts) without punctuation marks, blanks for all white space and around unspaced characters."""
    plain = F.translate(F.lower(text), MARKS + SPACES, " " * len(MARKS + SPACES))
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.regexp_replace(plain, UNSPACED, " $0 "))


def _count(text: str) -> int:
    return len(re.sub(UNSPACED, r" \g<0> ", text.lower().translate(_BLANKED)).split())


def answer_start(text: str) -> int:
    """The number of words (of the normal form) before the answer.

    The answer is the last line, or in an item of one line the last sentence;
    it is lengthened by what is before it until it has ``MIN_ANSWER_WORDS``
    words.  At most half of the words are answer: none of a single word.
    """
    lines = [x for x in text.split("\n") if _count(x)]
    last = lines[-1] if len(lines) > 1 else re.split(r"(?<=[.?!])\s+", text.strip())[-1]
    words = _count(text)
    n = _count(last) if _count(last) < words else words // 2
    return words - min(max(n, MIN_ANSWER_WORDS), words // 2)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = [answer_start(t) for t in batch.column(1).fill_null("").to_pylist()]
        rows = []
        for a, b, data, ends in shingles.chunks(batch.column(2)):
            hashes, owner, _, _ = shingles.words(data, ends)
            limits = np.searchsorted(owner, np.arange(b - a + 1))
            rows += [hashes[i:j].view(np.int64) for i, j in zip(limits[:-1], limits[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.int64())), pa.array(split, pa.int32())],
            ["item_id", "words", "split"])


@dataclass
class Shard:
    """The index of some items as arrays; postings are ordered by (term, item)."""

    ids: list  # of each item
    splits: list
    texts: list  # word hashes of each item, in order
    vocabulary: np.ndarray  # ascending term hashes
    first: np.ndarray  # of each term its first posting; one more at the end
    item: np.ndarray
    weight: np.ndarray
    essential: np.ndarray  # bool, of each posting
    left_out: np.ndarray  # of each item the weight of its other postings
    window: int
    threshold: float

    def __post_init__(self):
        """Essential lists, their blocks of items and the block maxima."""
        n_terms = len(self.vocabulary)
        term = np.repeat(np.arange(n_terms), np.diff(self.first))
        keep = np.flatnonzero(self.essential)
        self.e_term, self.e_item, self.e_weight = term[keep], self.item[keep], self.weight[keep]
        self.e_first = np.searchsorted(self.e_term, np.arange(n_terms + 1))
        pair = self.e_term * (len(self.ids) // BLOCK_ITEMS + 1) + self.e_item // BLOCK_ITEMS
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, int)
        self.b_term, self.b_block = self.e_term[starts], self.e_item[starts] // BLOCK_ITEMS
        self.b_most = np.maximum.reduceat(self.e_weight, starts) if len(starts) else np.zeros(0)
        self.b_first = np.searchsorted(self.b_term, np.arange(n_terms + 1))
        blocks = len(self.ids) // BLOCK_ITEMS + 1
        self.block_left_out = np.zeros(blocks)
        np.maximum.at(self.block_left_out, np.arange(len(self.ids)) // BLOCK_ITEMS, self.left_out)
        self.blocks = blocks


def make_shard(items: list, df: dict, n_items: int, average: float, window: int, threshold: float) -> Shard | None:
    """``items``: (item_id, words, split) rows; ``df``: the number of items of each of their terms, in all shards."""
    items = [r for r in items if len(r["words"])]
    if not items:
        return None
    texts = [np.array(r["words"], dtype=np.int64).view(np.uint64) for r in items]
    rows = []
    for i, t in enumerate(texts):
        terms, tf = np.unique(t, return_counts=True)
        n = np.array([df[x] for x in terms.view(np.int64).tolist()], dtype=float)
        idf = np.log1p((n_items - n + 0.5) / (n + 0.5))
        w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / average))
        w /= w.sum()
        common_first = np.argsort(-n, kind="stable")
        cut = np.cumsum(w[common_first]) < threshold - 1e-9  # these can't reach the threshold alone
        essential = np.ones(len(w), dtype=bool)
        essential[common_first[cut]] = False
        rows.append((terms, np.full(len(w), i), w, essential, w[~essential].sum()))
    terms, item, weight, essential = (np.concatenate([r[k] for r in rows]) for k in range(4))
    order = np.lexsort((item, terms))
    vocabulary, first = np.unique(terms[order], return_index=True)
    return Shard([r["item_id"] for r in items], [r["split"] for r in items], texts, vocabulary,
                 np.append(first, len(terms)), item[order], weight[order], essential[order],
                 np.array([r[4] for r in rows]), window, threshold)


def _expand(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``rows`` the entries first[row] to first[row + 1]: (position in rows, entry)."""
    n = first[rows + 1] - first[rows]
    at = np.repeat(np.arange(len(rows)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights=values, minlength=len(found))


def terms_of(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in the ascending ``vocabulary``; -1 for others."""
    at = np.searchsorted(vocabulary, hashes)
    return np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == hashes, at, -1)


def retrieve(shard: Shard, hashes: np.ndarray, passages: np.ndarray, term: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, item, score) at or above the threshold.

    ``passages``: of each passage its first word and the word after its last;
    ``term``: the :func:`terms_of` the words, where they are known.
    """
    slack = 1e-9
    term = terms_of(shard.vocabulary, hashes) if term is None else term
    known = np.flatnonzero(term >= 0)
    listed = known[shard.e_first[term[known] + 1] > shard.e_first[term[known]]]
    n_terms, n_items = len(shard.vocabulary), len(shard.ids)
    # (passage, essential term), once each: words are in ascending order, and so are passages
    a, b = np.searchsorted(listed, passages[:, 0]), np.searchsorted(listed, passages[:, 1])
    own, word = _between(a, b)
    pairs = np.unique(own * n_terms + term[listed[word]])
    passage, t = pairs // n_terms, pairs % n_terms
    # blocks by their maxima
    k, entry = _expand(shard.b_first, t)
    keys, bound = _sums(passage[k] * shard.blocks + shard.b_block[entry], shard.b_most[entry])
    keys = keys[bound + shard.block_left_out[keys % shard.blocks] >= shard.threshold - slack]
    # items of those blocks
    k, entry = _expand(shard.e_first, t)
    inside = _among(passage[k] * shard.blocks + shard.e_item[entry] // BLOCK_ITEMS, keys)
    k, entry = k[inside], entry[inside]
    keys, part = _sums(passage[k] * n_items + shard.e_item[entry], shard.e_weight[entry])
    keys = keys[part + shard.left_out[keys % n_items] >= shard.threshold - slack]
    if not len(keys):
        return keys, keys, np.zeros(0)
    # the rest in full: all terms of their passages
    rows = np.unique(keys // n_items)
    own, word = _between(np.searchsorted(known, passages[rows, 0]), np.searchsorted(known, passages[rows, 1]))
    pairs = np.unique(rows[own] * n_terms + term[known[word]])
    k, entry = _expand(shard.first, pairs % n_terms)
    wanted = (pairs // n_terms)[k] * n_items + shard.item[entry]
    inside = _among(wanted, keys)
    keys, score = _sums(wanted[inside], shard.weight[entry[inside]])
    enough = score >= shard.threshold - slack
    return keys[enough] // n_items, keys[enough] % n_items, score[enough]


def _between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the numbers from a to b: (row, number)."""
    n = b - a
    own = np.repeat(np.arange(len(a)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def run_share(part: np.ndarray, passage: np.ndarray) -> float:
    """The share of the word runs of ``part`` that ``passage`` holds."""
    width = min(RUN, len(part))
    if not width or len(passage) < width:
        return 0.0
    return float(np.isin(np.unique(shingles.fold(part, width)), shingles.fold(passage, width)).mean())


def passages_of(limits: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``window`` words, each half a window after the one before: (first word, word after), and each one's text.

    Every run of half a window is inside one of them.
    """
    half = window // 2
    n = np.maximum(-(-(np.diff(limits) - half) // half), np.minimum(np.diff(limits), 1))
    own, number = _between(np.zeros(len(n), dtype=np.int64), n)
    first = limits[own] + number * half
    return np.stack((first, np.minimum(first + window, limits[own + 1])), axis=1), own


def half_window(words: int) -> int:
    """Half the passage window of an item of so many words: the power of two from a quarter above its length on."""
    return 1 << max(0, -(-5 * words // 4) - 1).bit_length()


def _found(shard: Shard, hashes: np.ndarray, limits: np.ndarray, term: np.ndarray) -> list:
    """(row, item_id, start, score, question share, answer share) of each text and item with its best passage."""
    windows, text = passages_of(limits, shard.window)
    best = {}
    for p, i, score in zip(*(x.tolist() for x in retrieve(shard, hashes, windows, term)), strict=True):
        words, item, cut = hashes[windows[p, 0]:windows[p, 1]], shard.texts[i], shard.splits[i]
        row = int(text[p])
        if 0 < cut < len(item):
            q, r = run_share(item[:cut], words), run_share(item[cut:], words)
        else:  # a single word has no parts; in a longer text it tells nothing
            q = r = run_share(item, words) if limits[row + 1] - limits[row] == len(item) else 0.0
        if q >= QUESTION_SHARE and r >= ANSWER_SHARE:
            told = (score, q, r, -int(windows[p, 0] - limits[row]))
            if told > best.get((row, i), (0,)):
                best[row, i] = told
    return [(row, shard.ids[i], -start, score, q, r) for (row, i), (score, q, r, start) in sorted(best.items())]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words are looked up once for all classes; each has its numbers of the terms, -1 (also the last entry) for others.
        shards = shared.value
        vocabulary = np.unique(np.concatenate([x.vocabulary for x in shards]))
        numbers = [np.full(len(vocabulary) + 1, -1) for _ in shards]
        for x, mine in zip(shards, numbers, strict=True):
            mine[np.searchsorted(vocabulary, x.vocabulary)] = np.arange(len(x.vocabulary))
        for batch in batches:
            out = []
            for a, b, data, ends in shingles.chunks(batch.column(2)):
                hashes, owner, _, _ = shingles.words(data, ends)
                limits = np.searchsorted(owner, np.arange(b - a + 1))
                term = terms_of(vocabulary, hashes)
                for shard, mine in zip(shards, numbers, strict=True):  # one for each class of lengths
                    out += [(a + row, *told) for row, *told in _found(shard, hashes, limits, mine[term])]
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.int32()), *[pa.array([o[c] for o in out], pa.float64()) for c in (3, 4, 5)]],
                ["k", "text_hash", "item_id", "start", "score", "question_share", "answer_share"])

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", threshold: float = THRESHOLD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """k (the document's id), text_hash, item_id, start, score, question_share, answer_share.

    One row per document and test item found in it, with the best passage
    (its first word's number).  An item is looked for in windows of 2.5 to 5 times its length, whatever other items there are.  An item of a single word is found in documents
    that hold nothing else.  Null and empty texts and items match nothing;
    equal rows give equal rows; an empty side gives an empty table; extra columns
    are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("text_hash"),
                        normal(F.col(text_col).cast("string")).alias("text"))
    items = common.land(spark, benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"),
                                                normal(F.col("text").cast("string")).alias("normal"))
                        .mapInArrow(_items, "item_id long, words array<long>, split int").distinct(), "items")
    items = items.where("size(words) > 0")
    about = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("average"),
                      F.sum(F.size("words")).alias("words")).collect()[0]
    parts = -(-(about["words"] or 0) // shard_words)
    shard_of = F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, parts)))
    df = common.land(spark, items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term")
                     .agg(F.count("*").alias("n")), "item-terms")
    found = None
    for part in range(parts):
        mine = items.where(shard_of == part)
        terms = mine.select(F.explode("words").alias("term")).distinct().join(df, "term").collect()
        counts, classes = {r["term"]: r["n"] for r in terms}, {}
        for row in mine.orderBy(F.size("words"), "item_id").collect():
            classes.setdefault(half_window(len(row["words"])), []).append(row)
        shards = [make_shard(rows, counts, about["n"], about["average"], 2 * half, threshold) for half, rows in classes.items()]
        if shards:
            one = texts.mapInArrow(_search(spark.sparkContext.broadcast(shards)), FOUND_DDL)
            found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], FOUND_DDL) if found is None else found


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their own columns."""
    k, text_hash = common.fresh(docs, "_k"), common.fresh(docs, "_text_hash")
    bad = contaminated(spark, docs, benchmark, id_col, text_col).select(F.col("k").alias(k), F.col("text_hash").alias(text_hash))
    bad = common.land(spark, bad.distinct(), "contaminated")
    same = F.col(id_col).eqNullSafe(F.col(k)) & (F.xxhash64(text_col) == F.col(text_hash))
    return docs.join(common.small_side(bad, 24), same, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("k").alias("doc_id"), "item_id", "start", "score", "question_share", "answer_share")
