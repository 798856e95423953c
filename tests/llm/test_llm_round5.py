"""The Jaccard join: common cells last, lists in blocks."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from supplylens.llm import jaccard_join, shingles


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key_whatever_is_common(percent):
    rng = np.random.default_rng(percent)
    for n in [12, 40, 60, 150, 500, 3000] * 3:
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        more = rng.integers(0, 1 << 63, n * (100 - percent) // percent, dtype=np.uint64) * np.uint64(2)
        x, y = (np.unique(np.concatenate((both, m))) for m in (more[:len(more) // 2], more[len(more) // 2:]))
        every = np.union1d(*(jaccard_join.Scheme(percent, every=True).keys(s) for s in (x, y)))
        for share in (0.1, 0.5, 1):
            scheme = jaccard_join.Scheme(percent, common=np.sort(rng.choice(every, int(share * len(every)), replace=False)))
            assert len(np.intersect1d(scheme.keys(x), scheme.keys(y))), (n, share)


def test_a_shared_passage_makes_no_long_list(spark):
    """300 texts that have a passage in common, and nothing else: no list holds many of them."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(20)]
    texts = pa.array([" ".join([f"w{rng.randrange(10**6)}" for _ in range(120)] + passage) for _ in range(300)])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "k long, text string").withColumn("h", F.xxhash64("text"))
    shared = np.frombuffer(jaccard_join._common_keys(spark, docs, 5, 80).value, dtype=np.uint64)
    longest = lambda scheme: max(Counter(k for s in shingles.shingle_sets(texts, 5) for k in scheme.keys(s).tolist()).values())
    assert longest(jaccard_join.Scheme(80)) > 100 and longest(jaccard_join.Scheme(80, shared)) < 20


@pytest.mark.parametrize("block_pairs,block", [(20_000, 2000), (20_000, 7), (0, 2000)])
def test_edited_copies_in_blocks_and_in_rounds(spark, monkeypatch, block_pairs, block):
    """The same components whether lists are compared in one block, in many, or through homes and edits."""
    rng = random.Random(11)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(90)], []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "BLOCK_PAIRS", block_pairs)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    least = list(range(len(sets)))
    for _ in sets:  # spread the least number over links until nothing moves
        now = [min(least[j] for j, t in enumerate(sets) if 100 * len(s & t) >= 90 * len(s | t)) for s in sets]
        if now == least:
            break
        least = now
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(jaccard_join.components(spark, docs).select("doc_id", "component_id").collect()) == dict(enumerate(least))
    assert 5 < len(set(least)) < 115


def test_wide_sketches_tell_long_sets_apart(spark):
    """Of two long texts without a common shingle no whole set need travel; a link between long ones stays."""
    rng = random.Random(2)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(9000)] for _ in range(2)]
    words.append([*words[0][:8000], *words[1][:300]])
    texts = pa.record_batch([pa.array([" ".join(w) for w in words])], ["text"])
    (batch,) = jaccard_join._sets(5)(iter([texts]))
    sets = spark.createDataFrame(batch.to_pylist(), "node long, members array<long>, sketch array<long>")
    a, b, c = batch.column(0).to_pylist()
    pairs = spark.createDataFrame([(a, b), (a, c), (b, c)], "node long, leader long")
    got = jaccard_join._possible(spark, pairs, sets, 80, jaccard_join.WIDE_BITS).select("node", "leader").collect()
    assert [tuple(r) for r in got] == [(a, c)]
