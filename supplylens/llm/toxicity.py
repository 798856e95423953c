"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 11).

A text's words are read in overlapping windows.  Each word enters as a vector
of its own (words of the training sample) and as the mean of vectors of its
character n-grams, so that unknown and altered words count too.  Gated
recurrent units read a window in both directions, attention pools their states,
and a logistic unit scores the window.  A text's score is its highest window.

The network is trained in numpy on the driver, on a bounded sample of
labelled rows.  Labels belong to texts, not windows: at first a text is toxic as
soon as any window is (noisy or), later by its highest window.  Scoring runs in tasks,
row by row and with all windows of the whole text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The training sample: rows of each label, and words of a row at most.  Short texts say best which words a label is about.
SAMPLE_ROWS, SAMPLE_WORDS = 700, 400
#: Words of a window, and from one window's begin to the next.
WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 20, 16, 12
GRAMS, BUCKET_BITS = (3, 5), 14
#: Batches trained on, those of them by noisy or, texts of a batch.
STEPS, OR_STEPS, BATCH_TEXTS, RATE, SEED = 300, 130, 24, 4e-3, 7
#: Windows scored at a time, words whose vectors a worker keeps, and bytes of text worked on at a time.
AT_ONCE, KEPT_WORDS, CHUNK = 512, 400_000, 1 << 20
FOLDS, HELD_OUT = 5, 0


def split(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z as a-z."""
    return text.lower().split() if text else []


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words' character n-grams, their ends marked, end to end; how many each word has (one at least)."""
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the word's end
    buckets, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, np.uint64)
        for i in range(n):
            code = code << np.uint64(8) | data[at + i]
        buckets.append((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owners, minlength=len(words))


def window_starts(n: int) -> range:
    """Where the windows of a text of n words begin; a text without words has one, empty window."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


@dataclass
class Words:
    """Distinct words as they enter the network: their own number (0: unknown) and their n-grams end to end."""

    own: np.ndarray
    grams: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], vocabulary: dict[bytes, int]) -> Words:
        grams, counts = grams_of(words)
        return cls(np.array([vocabulary.get(w, 0) for w in words], np.int64), grams, np.cumsum(counts) - counts)

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        counts = np.diff(np.append(self.starts, len(self.grams)))
        means = np.add.reduceat(p["grams"][self.grams], self.starts, axis=0) / counts[:, None].astype(np.float32)
        return np.concatenate((p["words"][self.own], means), axis=1)

    def gradients(self, p: dict[str, np.ndarray], d: np.ndarray, g: dict[str, np.ndarray]) -> None:
        counts = np.diff(np.append(self.starts, len(self.grams)))
        _add_rows(g["words"], self.own, d[:, :WORD_DIM])
        g["words"][0] = 0
        _add_rows(g["grams"], self.grams, np.repeat(d[:, WORD_DIM:] / counts[:, None].astype(np.float32), counts, axis=0))


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    numbers, first = np.unique(at[order], return_index=True)
    to[numbers] += np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.multiply(x, 0.5)
    np.tanh(y, out=y)
    y *= 0.5
    y += 0.5
    return y


def initial(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (scale * rng.standard_normal(shape)).astype(np.float32)

    p = {"words": normal(n_words, WORD_DIM, scale=0.1), "grams": normal(1 << BUCKET_BITS, CHAR_DIM, scale=0.3)}
    p["words"][0] = 0
    for way in ("f", "b"):  # forward and backward: gates update, reset and the candidate, side by side
        p[f"in_{way}"] = normal(WORD_DIM + CHAR_DIM, 3 * HIDDEN, scale=0.3)
        p[f"bias_{way}"] = np.zeros(3 * HIDDEN, np.float32)
        p[f"gates_{way}"] = normal(HIDDEN, 2 * HIDDEN, scale=0.25)
        p[f"state_{way}"] = normal(HIDDEN, HIDDEN, scale=0.25)
    p["look"] = normal(2 * HIDDEN, ATTENTION, scale=0.2)
    p["weight"] = normal(ATTENTION, scale=0.2)
    p["out"] = normal(2 * HIDDEN, scale=0.2)
    p["base"] = np.zeros(1, np.float32)
    return p


def inputs(p: dict[str, np.ndarray], vectors: np.ndarray) -> dict[str, np.ndarray]:
    """What each word adds to the units, per direction; the first row is for places without a word."""
    return {way: np.concatenate((np.zeros((1, 3 * HIDDEN), np.float32), vectors @ p[f"in_{way}"] + p[f"bias_{way}"]))
            for way in ("f", "b")}


def _read(p: dict[str, np.ndarray], way: str, table: np.ndarray, ids: np.ndarray, there: np.ndarray, keep: list | None) -> np.ndarray:
    """The states (places, windows, HIDDEN) of one direction; ``ids`` and ``there`` are (places, windows)."""
    gates, candidate = p[f"gates_{way}"], p[f"state_{way}"]
    h = np.zeros((ids.shape[1], HIDDEN), np.float32)
    out = np.empty((len(ids), ids.shape[1], HIDDEN), np.float32)
    full = there.all(axis=1)
    for t in range(len(ids)) if way == "f" else range(len(ids) - 1, -1, -1):
        x = table[ids[t]]
        zr = _sigmoid(x[:, :2 * HIDDEN] + h @ gates)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        if not full[t]:
            z = z * there[t][:, None]  # without a word nothing is updated
        c = np.tanh(x[:, 2 * HIDDEN:] + (r * h) @ candidate)
        if keep is not None:
            keep.append((t, h, zr, c))
        h = h + z * (c - h)
        out[t] = h
    return out


def forward(p: dict[str, np.ndarray], tables: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window; ``ids`` is (places, windows) with the number 0 where no word is."""
    there = (ids > 0).astype(np.float32)
    steps = {way: [] if keep is not None else None for way in ("f", "b")}
    states = np.concatenate([_read(p, way, tables[way], ids, there, steps[way]) for way in ("f", "b")], axis=2)
    looked = np.tanh(states @ p["look"])
    e = np.where(there > 0, looked @ p["weight"], np.float32(-1e9))
    a = np.exp(e - e.max(axis=0)) * there
    a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
    pooled = np.einsum("tw,twh->wh", a, states)
    if keep is not None:
        keep.update(there=there, steps=steps, states=states, looked=looked, a=a, pooled=pooled)
    return pooled @ p["out"] + p["base"]


def backward(p: dict[str, np.ndarray], ids: np.ndarray, keep: dict, d: np.ndarray, g: dict[str, np.ndarray],
             rows: int) -> dict[str, np.ndarray]:
    """Adds the gradients of all weights to ``g``, and gives those of the input tables; ``d``: of each logit."""
    states, looked, a, there = keep["states"], keep["looked"], keep["a"], keep["there"]
    g["base"] += d.sum()
    g["out"] += keep["pooled"].T @ d
    d_pooled = d[:, None] * p["out"]
    d_a = np.einsum("twh,wh->tw", states, d_pooled)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["weight"] += np.einsum("tw,twk->k", d_e, looked)
    d_look = d_e[:, :, None] * p["weight"] * (1 - looked * looked)
    g["look"] += np.einsum("twh,twk->hk", states, d_look, optimize=True)
    d_states = a[:, :, None] * d_pooled + d_look @ p["look"].T
    out = {}
    for way, lo in (("f", 0), ("b", HIDDEN)):
        gates, candidate = p[f"gates_{way}"], p[f"state_{way}"]
        d_table = np.zeros((rows, 3 * HIDDEN), np.float32)
        d_x = np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
        d_h = np.zeros((ids.shape[1], HIDDEN), np.float32)
        for t, h, zr, c in reversed(keep["steps"][way]):
            d_h = d_h + d_states[t, :, lo:lo + HIDDEN]
            m = there[t][:, None]
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            d_c = d_h * z * m * (1 - c * c)
            d_rh = d_c @ candidate.T
            d_zr = np.concatenate((d_h * m * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)), axis=1)
            g[f"state_{way}"] += (r * h).T @ d_c
            g[f"gates_{way}"] += h.T @ d_zr
            d_h = d_h * (1 - z * m) + d_rh * r + d_zr @ gates.T
            d_x[t, :, :2 * HIDDEN], d_x[t, :, 2 * HIDDEN:] = d_zr, d_c
        _add_rows(d_table, ids.ravel(), d_x.reshape(-1, 3 * HIDDEN))
        out[way] = d_table[1:]
    return out


def windows_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, windows) of word numbers, which start at 1, of all windows of the texts, 0 beyond an end; each window's text."""
    cut = [r[i:i + WINDOW] for r in rows for i in window_starts(len(r))]
    out = np.zeros((len(cut), WINDOW), np.int64)
    for i, w in enumerate(cut):
        out[i, :len(w)] = w
    return np.ascontiguousarray(out.T), np.repeat(np.arange(len(rows)), [len(window_starts(len(r))) for r in rows])


@dataclass
class Network:
    """The trained weights and the words that have a vector of their own."""

    weights: dict[str, np.ndarray]
    vocabulary: dict[bytes, int]
    known: dict[bytes, int] = field(default_factory=dict)
    tables: dict[str, np.ndarray] = field(default_factory=dict)

    def _numbers(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        """The words' rows in the tables, which grow by the words that are new."""
        new = list({w for row in rows for w in row}.difference(self.known))
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known, self.tables = {}, {}
            new = list({w for row in rows for w in row})
        if new or not self.tables:
            vectors = (Words.of(new, self.vocabulary).vectors(self.weights) if new
                       else np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))
            first, last = len(self.known) + 1, len(self.known) + 1 + len(new)
            for way, rows_of in inputs(self.weights, vectors).items():
                if len(self.tables.get(way, ())) < last:
                    larger = np.zeros((max(last, KEPT_WORDS + 1), 3 * HIDDEN), np.float32)
                    larger[:first] = self.tables.get(way, larger)[:first]
                    self.tables[way] = larger
                self.tables[way][first:last] = rows_of[1:]
            self.known.update(zip(new, range(first, last), strict=True))
        return [np.fromiter(map(self.known.__getitem__, row), np.int64, len(row)) for row in rows]

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """The probability that each text is toxic: that of its highest window."""
        rows = self._numbers([split(t) for t in texts])
        best = np.full(len(rows), -np.inf, np.float32)
        at = 0
        while at < len(rows):  # texts of a few hundred windows, or the windows of a long one part by part
            end, n = at, 0
            while end < len(rows) and (n == 0 or n + len(window_starts(len(rows[end]))) <= AT_ONCE):
                n += len(window_starts(len(rows[end])))
                end += 1
            for lo in range(0, n, AT_ONCE):
                part = rows[at:end] if n <= AT_ONCE else [rows[at][STRIDE * lo:STRIDE * (lo + AT_ONCE - 1) + WINDOW]]
                ids, owner = windows_of(part)
                np.maximum.at(best, at + owner, forward(self.weights, self.tables, ids))
            at = end
        return _sigmoid(best.astype(np.float64))


def train(texts: list[bytes | None], labels: list[int], count: int = STEPS, seed: int = SEED) -> Network:
    """Fits the network to texts with labels 0 and 1; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    rows = [split(t) for t in texts]
    seen: dict[bytes, int] = {}
    for row in rows:
        for w in dict.fromkeys(row):
            seen[w] = seen.get(w, 0) + 1
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(w for w, n in seen.items() if n > 1))}
    words = list(seen)
    place = {w: i for i, w in enumerate(words)}
    all_words = Words.of(words, vocabulary) if words else None
    ends = np.append(all_words.starts, len(all_words.grams)) if words else None
    numbers = [np.fromiter(map(place.__getitem__, r), np.int64, len(r)) for r in rows]
    p = initial(len(vocabulary) + 1, rng)
    first, second, steps = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(3))
    y_all, order, lo = np.array(labels, np.float32), np.zeros(0, np.int64), 0
    for step in range(1, count + 1 if words else 1):
        if lo >= len(order):
            order, lo = rng.permutation(len(rows)), 0
        chosen, lo = order[lo:lo + BATCH_TEXTS], lo + BATCH_TEXTS
        here, inverse = np.unique(np.concatenate([numbers[i] for i in chosen] or [np.zeros(0, np.int64)]), return_inverse=True)
        if not len(here):
            continue
        spans = [np.arange(ends[i], ends[i + 1]) for i in here]
        own = all_words.own[here] * (rng.random(len(here)) > 0.3)  # some words must do with their characters
        some = Words(own, all_words.grams[np.concatenate(spans)], np.cumsum([0] + [len(s) for s in spans])[:-1])
        limits = np.cumsum([0] + [len(numbers[i]) for i in chosen])
        vectors = some.vectors(p)
        tables = inputs(p, vectors)
        ids, owner = windows_of([inverse[a:b] + 1 for a, b in zip(limits[:-1], limits[1:], strict=True)])
        keep: dict = {}
        logit = forward(p, tables, ids, keep)
        d = _text_gradient(logit, owner, y_all[chosen], step <= OR_STEPS) / np.float32(len(chosen))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_vectors = np.zeros_like(vectors)
        for way, d_table in backward(p, ids, keep, d, g, len(here) + 1).items():
            g[f"in_{way}"] += vectors.T @ d_table
            g[f"bias_{way}"] += d_table.sum(axis=0)
            d_vectors += d_table @ p[f"in_{way}"].T
        some.gradients(p, d_vectors, g)
        rate = RATE * (0.4 if step > count * 3 // 4 else 1.0)
        for k in p:  # Adam
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.001 * (g[k] * g[k] - second[k])
            steps[k] = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            p[k] -= np.float32(rate) * steps[k].astype(np.float32)
    return Network(p, vocabulary)


def _text_gradient(logit: np.ndarray, owner: np.ndarray, y: np.ndarray, noisy_or: bool) -> np.ndarray:
    """The gradient of the texts' log losses by the windows' logits."""
    prob = _sigmoid(logit)
    if noisy_or:
        none = np.exp(np.bincount(owner, weights=np.log(np.maximum(1 - prob, 1e-6)), minlength=len(y)))
        toxic = -np.minimum(none / np.maximum(1 - none, 1e-3), 20.0)[owner] * prob
        return np.where(y[owner] > 0, toxic, prob).astype(np.float32)
    order = np.lexsort((-logit, owner))
    _, first = np.unique(owner[order], return_index=True)
    top = order[first]
    d = np.zeros_like(logit)
    d[top] = prob[top] - y
    return d.astype(np.float32)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(*shared.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
            a = 0
            while a < len(texts):
                b, total = a + 1, sizes[a]
                while b < len(texts) and total + sizes[b] <= CHUNK:
                    total += sizes[b]
                    b += 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(network.score(texts[a:b].to_pylist()), pa.float64())],
                                                 ["k", "score"])
                a = b

    return run


def prior_shift(labels: list[int], share: float | None) -> float:
    """What the logit must change by, as the sample holds the two labels about equally and all rows hold ``share`` of label 1."""
    mine = sum(labels) / len(labels) if labels else 0.0
    if not share or share >= 1 or mine in (0.0, 1.0):
        return 0.0
    return float(np.log(share / (1 - share)) - np.log(mine / (1 - mine)))


def fold(id_col: str) -> Column:
    """Rows in fold 0 are held out; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> list[tuple[bytes, int]]:
    """The training sample: of each label at most ``rows`` texts of 1 to ``words`` words, chosen by a hash of the id.

    Held-out rows and null labels are never in it.  Four times as many labelled
    ids are looked up in one scan, as not every labelled row is there or short enough.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.where((fold("_id") != HELD_OUT) & F.col("_id").isNotNull()).distinct().withColumn("_at", F.xxhash64("_id"))
    some = [known.where(F.col("_label") == label).orderBy("_at", "_id").limit(4 * rows) for label in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    found = texts.join(ids, F.col("_doc") == F.col("_id")).where(F.length("_text") <= 16 * words)
    found = found.where(common.word_count(F.col("_text")).between(1, words)).select("_label", "_at", "_id", "_text")
    out = sorted((r["_label"], r["_at"], r["_id"], r["_text"].encode()) for r in found.collect())
    return [(text, label) for want in (0, 1) for label, _, _, text in [r for r in out if r[0] == want][:rows]]


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> DataFrame:
    """Per row of ``docs``: ``id_col``, held_out and score, the probability of label 1.

    Null texts and texts without words get the network's value for no words.
    Equal texts get equal scores; rows with equal or null ids are scored one
    by one; an empty table gives an empty one, and without labels of both
    kinds the network is trained on what there is.  Extra columns are ignored.
    """
    taught = sample(docs, labels, id_col, text_col, label_col, rows, words)
    network = train([t for t, _ in taught], [y for _, y in taught])
    learn = F.col(label_col).isin(0, 1) & (fold(id_col) != HELD_OUT)
    share = labels.where(learn).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    network.weights["base"] += np.float32(prior_shift([y for _, y in taught], share))
    shared = spark.sparkContext.broadcast((network.weights, network.vocabulary))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    return (texts.mapInArrow(_score(shared), "k long, score double")
            .select(F.col("k").alias(id_col), (fold("k") == HELD_OUT).alias("held_out"), "score"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = score(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return told.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
