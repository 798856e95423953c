"""Operators 11 to 13: odd rows, plain versions, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle_compare import canon_rows
from supplylens.llm import merkle, periodic_runs, toxicity

from conftest import SF_SMALL
from llm_fixtures import DDL, PROSE, no_docs, odd_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- 11

def test_network_gradients():
    """Backpropagation against differences of the loss."""
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(6, rng).items()}
    words = toxicity.Words.of([b"ab", b"idiot", b"xyz", b"long-word", b"q"], {b"ab": 1, b"idiot": 2, b"xyz": 3})
    rows = [np.array([1, 2, 3]), np.array([4, 5, 2, 2, 1] * 20), np.zeros(0, np.int64)]
    ids, owner = toxicity.windows_of(rows)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        logit = toxicity.forward(p, toxicity.inputs(p, words.vectors(p)), ids)
        prob = 1 / (1 + np.exp(-logit))
        top = np.array([prob[owner == i].max() for i in range(3)])
        return -(y * np.log(top) + (1 - y) * np.log(1 - top)).sum()

    keep, g = {}, {k: np.zeros_like(v) for k, v in p.items()}
    vectors = words.vectors(p)
    tables = toxicity.inputs(p, vectors)
    d = toxicity._text_gradient(toxicity.forward(p, tables, ids, keep), owner, y, False)
    d_vectors = np.zeros_like(vectors)
    for way, t in toxicity.backward(p, ids, keep, d, g, 6).items():
        g[f"in_{way}"] += vectors.T @ t
        g[f"bias_{way}"] += t.sum(axis=0)
        d_vectors += t @ p[f"in_{way}"].T
    words.gradients(p, d_vectors, g)
    for name in p:
        flat = p[name].reshape(-1)
        at = int(np.abs(g[name].reshape(-1)).argmax())
        held, e = flat[at], 1e-3
        flat[at] = held + e
        up = loss()
        flat[at] = held - e
        down = loss()
        flat[at] = held
        assert abs((up - down) / (2 * e) - g[name].reshape(-1)[at]) < 2e-2 * abs(g[name].reshape(-1)[at]) + 1e-4, name


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        starts = toxicity.window_starts(n)
        assert starts[0] == 0 and (n == 0 or starts[-1] < n <= starts[-1] + toxicity.WINDOW)
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_long_texts_are_scored_in_parts_alike():
    net = toxicity.Network(toxicity.initial(1, np.random.default_rng(1)), {})
    text = " ".join(f"w{i * 7919 % 613}" for i in range(40_000)).encode()  # 833 windows, two parts
    words = text.split()
    parts = [b" ".join(words[i:i + toxicity.WINDOW]) for i in toxicity.window_starts(len(words))]
    assert abs(net.score([text])[0] - net.score(parts).max()) < 1e-5
    assert net.score([None])[0] == net.score([b" \n"])[0]


@pytest.fixture(scope="module")
def tables(spark):
    big = SF_SMALL.replace("sf0.001", "sf0.1")  # enough labels to tell
    return spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    told = toxicity.score(spark, docs, labels).withColumnRenamed("doc_id", "d").join(labels, F.col("d") == F.col("doc_id"))
    held = [(r["score"], r["toxic"]) for r in told.where("held_out").collect()]
    good = [s for s, y in held if y == 1]
    rest = [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in rest])
    assert auc > 0.93 and np.mean([s >= 0.5 for s in good]) > 0.8 and np.mean([s >= 0.5 for s in rest]) < 0.08
    assert all((zlib.crc32(str(r["d"]).encode()) % 5 == 0) == r["held_out"] for r in told.collect())


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):  # noqa: F811
    labels = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (3, 1, "x"), (9, 1, "x"), (None, 1, "x"), (10, None, "x"), (99, 1, "x"),
                                    (1, 0, "x")], "doc_id long, toxic int, score string")
    got = toxicity.score(spark, odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[1] == by[2] and len(by[3]) == 1 and by[5] == by[6] == by[4]
    again = {(r["doc_id"], r["score"]) for r in toxicity.score(spark, odd_docs, labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    assert toxicity.score(spark, no_docs, labels).count() == 0
    assert toxicity.score(spark, odd_docs, labels.where("false")).count() == odd_docs.count()


def test_sample_is_bounded_and_never_held_out(spark, tables):
    docs, labels = tables
    taught = toxicity.sample(docs, labels, rows=20, words=300)
    assert [sum(y == v for _, y in taught) for v in (0, 1)] == [20, 20]
    held = {r["text"].encode() for r in docs.join(labels, "doc_id").where(toxicity.fold("doc_id") == 0).collect()}
    assert all(len(t.split()) <= 300 for t, _ in taught)
    learned = {r["text"].encode() for r in docs.where(toxicity.fold("doc_id") != 0).collect()}
    assert all(t in learned for t, _ in taught) and held


# -- 12

def plain_runs(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                s = w[i:j + q]
                if len(s) >= max(least, times * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.append((i, len(s), q))
                i = j
            i += 1
    return sorted(out)


def made_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        letters, w = rng.choice([1, 2, 3, 5, 40]), []
        while len(w) < rng.choice([10, 60, 200, 400]):
            base = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 40]))]
            w += [base[i % len(base)] for i in range(rng.randrange(1, 6 * len(base) + 2))]
        out.append(w)
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    return out + [[0] * 500, [0] * 23, [0] * 24, ([0] * 20 + [1]) * 30, [], b]


@pytest.mark.parametrize("most", [periodic_runs.MOST_BLOCK, 16])
def test_runs_against_plain_search(monkeypatch, most):
    plain_widths = periodic_runs.zero_mismatches
    monkeypatch.setattr(periodic_runs, "MOST_BLOCK", most)
    monkeypatch.setattr(periodic_runs, "zero_mismatches", lambda v, b: plain_widths(v, b, most))
    texts = made_texts(3, 150)
    ids, limits, first = [], [0], 0
    for w in texts:
        ids += [x + first for x in w]
        first += max(w, default=-1) + 1
        limits.append(len(ids))
    got = sorted(periodic_runs.find_runs(np.array(ids), np.array(limits)))
    want = [(limits[t] + s, n, q) for t, w in enumerate(texts) for s, n, q in plain_runs(w)]
    assert got == sorted(want) and len(want) > 100


def test_transform_is_a_convolution():
    rng = np.random.default_rng(2)
    for n, columns in ((2, 1), (16, 100), (64, 3), (1024, 1)):
        x, y = (rng.integers(0, periodic_runs.PRIME, (n, columns)).astype(np.uint64) for _ in range(2))
        both = periodic_runs.transform(x.copy()) * periodic_runs.transform(y.copy()) % np.uint64(periodic_runs.PRIME)
        got = periodic_runs.inverse(both, n, columns)
        for c in range(columns):
            at = rng.integers(0, n)
            want = sum(int(x[i, c]) * int(y[(at - i) % n, c]) for i in range(n)) * n % periodic_runs.PRIME
            assert int(got[at, c]) == want


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_against_plain_version(spark, sf_dir, odd_docs, no_docs):  # noqa: F811
    made = [(1000 + i, " ".join(f"w{x}" for x in w), "en", "m", 1) for i, w in enumerate(made_texts(5, 60))]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").where("coalesce(length(text), 0) < 10000")
    for rows in (docs.where("length(text) < 8000"), spark.createDataFrame(made, DDL), odd):
        got = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(rows))).collect()
        want = [plain_digest(r["doc_id"], r["text"]) for r in rows.collect()]
        key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
        assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    long = periodic_runs.periodic_runs(odd_docs.where("doc_id = 7")).collect()[0]
    assert long["n_words"] == 30_000 and long["runs"] == []
    assert periodic_runs.periodic_runs(no_docs).count() == 0
    with pytest.raises(ValueError, match="24 words"):
        periodic_runs.periodic_runs(odd_docs, least=10)


# -- 13

def sql_rows(sql, documents):
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    got = con.sql(sql)
    return list(got.columns), got.fetchall()


def test_sha_256_with_states():
    rng = np.random.default_rng(0)
    for fan in (2, 3, 5):
        for n in (1, 2, 5, 13, 50):
            nodes = rng.integers(0, 1 << 32, (n, 8), dtype=np.uint64).astype(np.uint32)
            text = [x.astype(">u4").tobytes().hex() for x in nodes]
            up, counts, states = merkle.parents(nodes, fan)
            want = [hashlib.sha256("".join(text[i:i + fan]).encode()).hexdigest() for i in range(0, n, fan)]
            assert [x.astype(">u4").tobytes().hex() for x in up] == want
            at = np.arange(n)
            new = rng.integers(0, 1 << 32, (n, 8), dtype=np.uint64).astype(np.uint32)
            folded = merkle.resume(new, merkle.steps_of(nodes, at, counts, states, fan), fan)
            for i in range(n):
                row = list(text[i // fan * fan:i // fan * fan + fan])
                row[i % fan] = new[i].astype(">u4").tobytes().hex()
                assert folded[i].astype(">u4").tobytes().hex() == hashlib.sha256("".join(row).encode()).hexdigest()


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_merkle_of_odd_rows(spark, monkeypatch, odd_docs, no_docs, levels):  # noqa: F811
    """Whatever the size of the subtrees, the same as SQL; one level means a round of jobs a level."""
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **k: whole(*a, levels=levels, **k))
    cols, rows = sql_rows(merkle.OP13_SQL, odd_docs.select("doc_id", "source", "lang", "n_chars", "text"))
    got = merkle.digests(merkle.tampered(spark, odd_docs))
    assert canon_rows(got.columns, [tuple(r) for r in got.collect()]) == canon_rows(cols, rows)
    assert {r["verified"] for r in got.collect()} == {True, False}
    assert merkle.digests(merkle.tampered(spark, no_docs)).count() == 0


def test_merkle_key_of_many_parts(spark):
    """A key whose rows lie in many parts, with subtrees across their bounds; fan of three."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "en").alias("lang"))
    told = merkle.manifest(spark, docs.repartition(7), F.sha2(F.col("doc_id").cast("string"), 256), fan=3, levels=2).collect()
    leaf = lambda i: hashlib.sha256(str(i).encode()).hexdigest()

    def up(nodes):
        while len(nodes) > 1:
            nodes = [hashlib.sha256("".join(nodes[i:i + 3]).encode()).hexdigest() for i in range(0, len(nodes), 3)]
        return nodes[0]

    none, en = up([leaf(i) for i in range(0, 500, 3)]), up([leaf(i) for i in range(500) if i % 3])
    for r in told:
        assert r["subroot"].hex() == (en if r["lang"] else none)
        assert r["root"].hex() == r["folded_root"].hex() == up([none, en])
        now = leaf(r["doc_id"])
        assert r["leaf"].hex() == now and len(r["siblings"]) % 32 == 0


def test_merkle_proof_holds(spark, sf_dir):
    """A plain verifier that knows a row's place alone folds the siblings to the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = merkle.tampered(spark, docs).collect()
    langs = sorted({r["lang"] for r in told}, key=lambda x: (x is not None, (x or "").encode()))
    sizes = {k: sorted(r["doc_id"] for r in told if r["lang"] == k) for k in langs}
    for r in told[::9]:
        now, rest = r["leaf"].hex(), r["siblings"].hex()
        for at, n in ((sizes[r["lang"]].index(r["doc_id"]), len(sizes[r["lang"]])), (langs.index(r["lang"]), len(langs))):
            while n > 1:
                if at ^ 1 < n:
                    other, rest = rest[:64], rest[64:]
                    now = other + now if at & 1 else now + other
                now, at, n = hashlib.sha256(now.encode()).hexdigest(), at // 2, (n + 1) // 2
        assert rest == "" and now == r["root"].hex()


# -- 9: ids that repeat or are null

def test_join_with_repeated_and_null_ids(spark):
    from supplylens.llm import jaccard_join
    rng = random.Random(8)
    a, b = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    near = lambda w, i: " ".join(w[:i] + ["changed"] + w[i + 1:])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 79)), (3, near(b, 79)), (None, near(b, 0)), (7, "x " + " ".join(a)), (8, "else " * 3),
            (None, "quite alone here and now")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    for part in (docs, docs.repartition(5)):
        got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.components(spark, part).collect()]
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(got, key=key) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (7, 1), (8, 8), (None, None)], key=key)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    """Pairs at the very limit of the similarity, of all sizes and classes."""
    from supplylens.llm import jaccard_join
    rng, scheme = np.random.default_rng(percent), jaccard_join.Scheme(percent)
    for n in [*range(1, 60), 100, 150, 333, 500, 1000, 3000] * 3:
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        apart = n * (100 - percent) // percent  # |x or y| <= 100 n / percent
        mine = int(rng.integers(0, apart + 1))
        more = rng.integers(0, 1 << 63, apart, dtype=np.uint64) * np.uint64(2)
        x, y = (np.unique(np.concatenate((both, m))) for m in (more[:mine], more[mine:]))
        if 100 * n >= percent * (len(x) + len(y) - n):
            assert len(np.intersect1d(scheme.keys(x), scheme.keys(y))), (n, mine, apart)


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_never_part_linked_sets(spark, percent):
    from supplylens.llm import jaccard_join
    rng, rows, pairs, linked = np.random.default_rng(1), [], [], set()
    for i in range(150):
        n = int(rng.integers(1, 4000))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        more = rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 2)), dtype=np.uint64) * np.uint64(2)
        cut = int(rng.integers(0, len(more) + 1))
        x, y = np.unique(np.concatenate((both, more[:cut]))), np.unique(np.concatenate((both, more[cut:])))
        for k, s in ((2 * i, x), (2 * i + 1, y)):
            rows.append((k, s.view(np.int64).tolist(), jaccard_join._sketch(s).tolist()))
        pairs += [(2 * i, 2 * i + 1), (2 * i, (2 * i + 2) % 300)]
        if 100 * n >= percent * (len(x) + len(y) - n):
            linked.add((2 * i, 2 * i + 1))
    sets = spark.createDataFrame(rows, "node long, members array<long>, sketch array<long>")
    got = {tuple(r) for r in jaccard_join._possible(spark, spark.createDataFrame(pairs, "node long, leader long"), sets, percent)
           .select("node", "leader").collect()}
    assert linked <= got and len(linked) > 20 and len(got) < len(pairs) - 100
