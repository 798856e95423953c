"""Operators that SQL can't express, against plain Python versions of the same contract."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from supplylens.llm import (common, components, context_tree, decontaminate, html_extract, jaccard_join, mixing, pii,
                            quality_rules, shingles, token_store)

from llm_fixtures import PROSE, no_docs, odd_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# -- token ids

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_str(token_store.tokenizer_definition())


def test_token_files_equal_whole_text_encoding(spark, small, odd_docs, tokenizer, tmp_path):  # noqa: F811
    for n, docs in enumerate((small, odd_docs)):
        path = f"{tmp_path}/{n}"
        token_store.write_tokens(spark, docs, f"file://{path}", token_store.tokenizer_definition())
        got = token_store.checksums(token_store.read_tokens(spark, f"file://{path}")).orderBy("start").collect()
        ids = sorted((i is not None, i or 0) for i, _ in texts_of(docs))
        assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == ids
        assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
        want = collections.Counter()
        for i, text in texts_of(docs):
            row = tokenizer.encode(text or "", add_special_tokens=False).ids + [token_store.END_ID]
            want[i, len(row), zlib.crc32(np.array(row, dtype="<u4").tobytes())] += 1
        assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)


def test_token_file_layout(spark, small, tmp_path):
    token_store.write_tokens(spark, small, f"file://{tmp_path}/t", token_store.tokenizer_definition())
    column = {}
    for f in (tmp_path / "t").glob("*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        for i in range(group.num_columns):
            c = group.column(i)
            column[c.path_in_schema] = c
            assert c.has_offset_index and c.compression == "ZSTD"
    assert any("RLE_DICTIONARY" in e or "PLAIN_DICTIONARY" in e for e in column["tokens.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings
    plan = token_store.read_tokens(spark, f"file://{tmp_path}/t").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1]


def test_no_tokens(spark, no_docs, tmp_path):  # noqa: F811
    token_store.write_tokens(spark, no_docs, f"file://{tmp_path}/n", token_store.tokenizer_definition())
    assert token_store.checksums(token_store.read_tokens(spark, f"file://{tmp_path}/n")).count() == 0


def test_pieces_encode_as_the_whole(tokenizer):
    rng = random.Random(3)
    odd = ["a b", "Straße STRASSE", "é ́z", "ΑΣ ΣΑΣ.", "<|endoftext|> A<|startoftext|>b", "can't 'S ' t", "\x1c \x1f a\x85b",
           "İstanbul I", "1234 ١٢", "", " \n\t", "a‍b", "ﬁ ™ ½", "日本語　全角", "<|EndOfText|>", "don't... ,x.y;"]
    texts = odd + ["".join(rng.choices(odd, k=6)) for _ in range(300)]
    encoder = token_store.PieceEncoder(token_store.tokenizer_definition(), kept=20)
    for at in range(0, len(texts), 7):
        part = texts[at:at + 7]
        for text, ids in zip(part, encoder.encode([t.encode() for t in part])):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_decomposed_capitals_encode_as_the_whole(tokenizer):
    """NFC comes before lower case: these marks compose with the small letter only."""
    letters = ["T\u0308", "H\u0331", "W\u030a", "J\u030c", "Y\u030a"]
    texts = [f"{x}a" for x in letters] + [f"ABC {x}A B{x} de" for x in letters] + ["A\u0300B E\u0301 \u0301T T\u0323\u0308a <|ENDOFTEXT|>T\u0308"]
    texts += [f"Q{chr(c + 65)}{chr(m)}R S" for c in range(26) for m in range(0x300, 0x370)]
    got = token_store.PieceEncoder(token_store.tokenizer_definition()).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


# -- Jaccard join

def sets_of(docs, width):
    out = []
    for i, text in docs:
        w = words(text)
        out.append((i, frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k:k + width]) for k in range(len(w) - width + 1)])))
    return out


def groups_of(docs, width, percent):
    """component_id of each row by comparing all pairs that share a shingle."""
    sets = sets_of(docs, width)
    above = list(range(len(sets)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    lists = collections.defaultdict(list)
    for r, (_, s) in enumerate(sets):
        shared = collections.Counter(o for x in s for o in lists[x])
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o][1]) - n):
                above[root(r)] = root(o)
        for x in s:
            lists[x].append(r)
    least = {}
    for r, (i, _) in enumerate(sets):
        least[root(r)] = min((x for x in (least.get(root(r)), i) if x is not None), default=None)
    return collections.Counter((i, len(s), least[root(r)]) for r, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, small, odd_docs, width, percent):  # noqa: F811
    for docs in (small, odd_docs):
        got = jaccard_join.components(spark, docs, width=width, percent=percent).collect()
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups_of(texts_of(docs), width, percent)


def test_components_of_many_edited_copies(spark):
    """Copies with scattered edits, versions of a version, small sets, and a passage that all share: few links, many close misses."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, passage, rows = [name() for _ in range(120)], [name() for _ in range(30)], []
    for _ in range(3):
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = name()
            rows.append(w)
        for k in rng.sample(range(120), 12):
            base = base[:k] + [name()] + base[k + 1:]
    rows += [[name() for _ in range(60)] + passage for _ in range(60)]
    for n in range(1, 26):  # small sets around the boundary
        w = [name() for _ in range(n + 2)]
        rows += [w, w[:-1], w[1:], w + [name()], [*w[:-1], name()]]
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for percent in (80, 90):
        got = jaccard_join.components(spark, df, percent=percent).collect()
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups_of(docs, 3, percent)


def test_linked_sets_always_share_a_key():
    rng = random.Random(9)
    for percent in (80, 90):
        scheme = jaccard_join.Scheme(percent)
        for _ in range(1500):
            n = rng.choice([*range(1, 40), 120, 400])
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(a)
            for _ in range(rng.randrange(0, 2 + n // 8)):
                b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.getrandbits(64))
            if 100 * len(a & b) >= percent * len(a | b):
                keys = [set(scheme.keys(np.array(sorted(s), dtype=np.uint64)).tolist()) for s in (a, b)]
                assert keys[0] & keys[1], (len(a), len(b), len(a & b))


def test_no_documents_to_join(spark, no_docs, odd_docs):  # noqa: F811
    assert jaccard_join.components(spark, no_docs).count() == 0 and jaccard_join.keep_one(spark, no_docs).count() == 0
    kept = jaccard_join.keep_one(spark, odd_docs)
    assert kept.columns == odd_docs.columns and {r["node"] for r in kept.collect()} == {"x"}
    gone = {1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, -5} - {r["doc_id"] for r in kept.collect()}
    assert gone == {2, 8, 10}


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    above = {x: x for p in links for x in p}

    def root(x):
        return x if above[x] == x else root(above[x])

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    got = dict(components.connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: root(x) for p in links for x in p if p[0] != p[1]}


# -- benchmark decontamination

def test_item_windows_follow_the_item(spark):
    """An item is found, or isn't, whatever the length of other items; runs of its length and a quarter are in one passage."""
    item = " ".join(f"q{i}" for i in range(12)) + "\n" + " ".join(f"a{i}" for i in range(8))
    other = " ".join(f"o{i}" for i in range(3000))
    far = item.replace("\n", " " + " ".join(f"x{i}" for i in range(1500)) + " ")
    near = " ".join(f"y{i}" for i in range(77)) + " " + item.replace("\n", " so then ") + " end" * 90
    docs = spark.createDataFrame([(1, far), (2, near), (3, item), (4, "z " + other), (5, other[:9000])], "doc_id long, text string")
    alone = spark.createDataFrame([(7, item)], "item_id long, text string")
    both = spark.createDataFrame([(7, item), (8, other)], "item_id long, text string")
    told = lambda b: {(r["k"], r["item_id"]) for r in decontaminate.contaminated(spark, docs, b).collect()}
    assert told(alone) == {(2, 7), (3, 7)}
    assert told(both) - {(5, 8)} == {(2, 7), (3, 7), (4, 8)}
    assert [decontaminate.half_window(n) for n in (1, 2, 3, 20, 25, 26, 51, 52)] == [2, 4, 4, 32, 32, 64, 64, 128]


def shard_of(items, window=None, threshold=0.6):
    rows = []
    for i, text in items:
        for _, _, data, ends in shingles.chunks(pa.array([text])):
            rows.append({"item_id": i, "words": shingles.words(data, ends)[0].view(np.int64).tolist(), "split": decontaminate.answer_start(text)})
    df = collections.Counter(x for r in rows for x in set(r["words"]))
    window = window or 2 * max(len(r["words"]) for r in rows)
    return decontaminate.make_shard(rows, df, len(rows), float(np.mean([len(r["words"]) for r in rows])), window, threshold)


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.6, 0.9])
def test_block_max_search_finds_all_above_the_threshold(threshold):
    rng = random.Random(2)
    vocabulary = [f"v{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(150)]
    shard = shard_of(items, threshold=threshold)
    text = []
    for _ in range(60):
        text += rng.choices(vocabulary, k=rng.randrange(0, 50))
        w = rng.choice(items)[1].split()
        text += [x if rng.random() < 0.9 else "new" for x in w]
    for _, _, data, ends in shingles.chunks(pa.array([" ".join(text)])):
        hashes = shingles.words(data, ends)[0]
    passages, _ = decontaminate.passages_of(np.array([0, len(hashes)]), shard.window)
    got = {(p, i): s for p, i, s in zip(*(x.tolist() for x in decontaminate.retrieve(shard, hashes, passages)))}
    n, average = len(items), float(np.mean([len(t.split()) for _, t in items]))
    df = collections.Counter(x for _, t in items for x in set(t.split()))
    weights = []
    for _, t in items:  # BM25 the plain way
        tf = collections.Counter(t.split())
        w = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sum(tf.values()) / average)) for x, c in tf.items()}
        weights.append({x: v / sum(w.values()) for x, v in w.items()})
    want = {}
    for p, (a, b) in enumerate(passages.tolist()):
        here = set(text[a:b])
        for i, w in enumerate(weights):
            if (s := sum(v for x, v in w.items() if x in here)) >= threshold - 1e-12:
                want[p, i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_planted_items_are_found_and_clean_documents_stay(spark, small, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    clean = [f"{PROSE} {i} " * 8 for i in range(20)]
    rows = [(10_000 + i, clean[i % 20] + " " + t.upper() + "!! " + clean[(i + 1) % 20]) for i, t in items.items()]
    rows += [(20_000 + i, t) for i, t in enumerate(clean)] + [(None, next(iter(items.values()))), (30_000, None), (30_001, "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, k string, text_hash string")
    for shard_words in (1 << 19, 200):  # one shard, and several
        got = decontaminate.contaminated(spark, docs, bench, shard_words=shard_words).collect()
        assert {(r["k"], r["item_id"]) for r in got} >= {(10_000 + i, i) for i in items}
        assert not [r for r in got if (r["k"] or 0) >= 20_000]
    left = decontaminate.clean(spark, docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {20_000 + i for i in range(20)} | {30_000, 30_001}
    normal = lambda t: " ".join(t.lower().translate(dict.fromkeys(map(ord, decontaminate.MARKS), " ")).split())
    whole = {(i, b) for i, t in texts_of(small) for b, x in items.items() if f" {normal(x)} " in f" {normal(t or '')} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, small, bench).withColumnRenamed("k", "doc_id").collect()}
    assert got >= whole
    none = bench.where("false")
    assert decontaminate.contaminated(spark, docs, none).count() == 0 and decontaminate.clean(spark, docs, none).count() == docs.count()
    assert decontaminate.clean(spark, docs.where("false"), bench).count() == 0
    odd = spark.createDataFrame([(1, None), (None, "only"), (2, ""), (3, "...")], "item_id long, text string")
    assert decontaminate.clean(spark, docs, odd).count() == docs.count()


def test_items_without_blanks_or_with_other_white_space_are_found(spark):
    items = {1: "中国的首都是哪个城市？答案是北京市。", 2: "日本で一番高い山は何ですか答えは富士山です", 3: "ประเทศไทยมีเมืองหลวงคือกรุงเทพมหานคร",
             4: "combien\u00a0\u00a0coûte\u00a0\u00a0le\u2009\u2009pain\u3000\u3000ici", 5: "Supercalifragilistic",
             6: "1\u00a0000\u00a0\u00a0000\u2009\u2009+\u2009\u20092\u00a0000\u00a0\u00a0000", 7: "What is the capital of Peru?\nThe capital is Lima."}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(i, t) for i, t in items.items()] + [(10 + i, f"{PROSE} {t} {PROSE}") for i, t in items.items()]
    rows += [(20 + i, f"另外一段文字在这里{items[i]}后面还有别的内容") for i in (1, 2, 3)]
    rows += [(30, "中文的另一段话没有题目"), (31, PROSE), (32, "combien le pain"), (33, "capital\u00a0of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["k"], r["item_id"]) for r in decontaminate.contaminated(spark, docs, bench).collect()}
    # a single word in a longer text is no copy of the item
    assert got == ({(i + at, i) for i in items for at in (0, 10)} | {(20 + i, i) for i in (1, 2, 3)}) - {(15, 5)}
    normal = {r["item_id"]: len(r["n"].split(" ")) - r["n"].split(" ").count("") for r in
              bench.select("item_id", decontaminate.normal(F.col("text")).alias("n")).collect()}
    assert normal == {i: decontaminate._count(t) for i, t in items.items()}


# -- html

PAGES = {
    "<body><nav>menu</nav><article><h1>T &amp; U</h1><p>one  two\nthree<p>four<br>five</article><footer>f</footer>": "T & U\none two three\nfour five",
    "<main><h1>Head</h1><div><p>First paragraph of it.</p><ul><li>a<li>b</ul></div></main><aside>side</aside>": "Head\nFirst paragraph of it.\na\nb",
    "<div class='cookie-notice'>We use cookies</div><div><p>Real text that counts.</p><p>More of it.</p></div><section id=comments><p>First!</p></section>":
        "Real text that counts.\nMore of it.",
    "<article><p>a</p><form><p>name</p><input></form><script>var x = '</p>';</script><style>p{}</style><p>b &lt;i&gt; &#233;</p></article>": "a\nb <i> é",
    "<article><p>x<!-- <p>no</p> --> y</p><table><tr><td>1<td>2</table></article>": "x y\n1\n2",
    "plain": "plain", "": "", "<p>": "", "<script>x": "", "<!-- x": "", "< 3 and <b>bold</b>": "< 3 and bold",
}


def test_main_text_of_pages():
    for html, text in PAGES.items():
        assert html_extract.main_text(html) == text, html
    assert html_extract.main_text(None) == ""
    deep = "<div>" * 3000 + "<article><p>in</p><p>side</p></article>"
    assert html_extract.main_text(deep) == "in\nside"
    assert html_extract.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>") == "\n".join(["word word"] * 20_000)


LONG = "This is a long sentence of the article, with enough words to count as text. " * 4
WRAPPED = [  # (before the text, after it)
    ("<body><form id=aspnetForm><div class=menu><a href=x>Menu</a></div><article>", "</article></form>"),
    ("<body><form id=aspnetForm><main>", "</main></form><footer>f</footer>"),
    ("<body><form><div>", "</div></form>"),
    ("<body><div class='layout has-sidebar'><div class=sidebar><p>side</p></div><div>", "</div></div>"),
    ("<body><div class=no-sidebar><div class=ad-free>", "</div></div><div class=cookie-notice><p>We use cookies.</p></div>"),
    ("<body><div id='related-work'>", "</div><section id=comments><p>First!</p></section>"),
    ("<body><div class='page modal-open'><div>", "</div><div class=comments><p>First!</p></div></div>"),
    ("<article><div class=has-sidebar><div>", "</div></div></article><div class=related-posts><p>Other</p></div>"),
]


def test_wrappers_of_the_main_text_stay():
    for before, after in WRAPPED:
        assert html_extract.main_text(f"{before}<p>{LONG}</p><p>{LONG}</p>{after}") == "\n".join([LONG.strip()] * 2), before
    # what holds most of the text by its clear name is still no article
    talk = f"<div class=comment-list><p>{LONG}</p><p>{LONG}</p></div>"
    assert html_extract.main_text(f"<div><p>{LONG}</p></div>{talk}") == LONG.strip()
    assert html_extract.main_text(f"<article><p>Short news.</p></article><div class=related-posts><p>{LONG}</p></div>") == "Short news."


def test_bare_text_beside_the_densest_subtree_stays():
    page = f"<body><div id=content>{LONG}<br><b>Bold</b> {LONG}<div><p>{LONG}</p><p>{LONG}</p></div>{LONG}<p>{LONG}</p></div></body>"
    one = LONG.strip()
    assert html_extract.main_text(page) == "\n".join([f"{one} Bold {one}", one, one, one, one])
    inner = f"<div><div>{f'<p>{LONG}</p>' * 9}</div>{LONG}<br>{LONG}</div>"
    assert html_extract.main_text(f"<body>{inner}</body>") == "\n".join([one] * 9 + [f"{one} {one}"])


def test_main_text_of_the_table(spark, sf_dir):
    from html import unescape
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    odd = [(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x")] + [(p["page_id"], p["url"], p["html"], "x") for p in pages]
    got = html_extract.extract(spark.createDataFrame(odd, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(odd) and sum(r["text"] == "" for r in got) == 3
    text = {r["page_id"]: r["text"] for r in got if r["text"]}
    for p in pages:  # the tables' articles hold h1, p, b and br only
        inner = p["html"].partition("<article>")[2].partition("</article>")[0]
        lines = [" ".join(unescape(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert text[p["page_id"]] == "\n".join(x for x in lines if x)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


# -- personal data

SAMPLE = ("Mail Ann.Lee@shop.example.com or ann.lee@SHOP.example.com, call +1 (017) 555-7713 or +1 017 555 7713 from 10.20.30.40. "
          "Card 4111 1111 1111 1111 and 4111111111111111, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\", IBAN DE89 3704 0044 0532 0130 00. "
          "Mrs. Clara Weber met John Smith; Clara Weber left. Анна Петрова пришла. SSN 123-45-6789.")


def test_surrogates_keep_kind_layout_and_identity(spark):
    docs = spark.createDataFrame([(1, SAMPLE, "x"), (2, "Clara Weber, again: ann.lee@shop.example.com 4111111111111111", "x"), (3, "nothing here", "x"),
                                  (4, None, "x"), (5, "", "x"), (None, SAMPLE, "x"), (1, SAMPLE, "x")], "doc_id long, text string, again string")
    rows = pii.pseudonymize(spark, docs, key="k1").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 7 and got[3]["text"] == "nothing here" and got[4]["text"] is None and got[5]["text"] == ""
    assert got[None]["text"] == got[1]["text"] and got[1]["n_entities"] == len(pii.find(SAMPLE)) == 14
    old = [(SAMPLE[a:b], k, n) for a, b, k, n in pii.find(SAMPLE)]
    new_hits = pii.find(got[1]["text"])
    for mention, _, _ in old:
        assert mention not in got[1]["text"]
    grouped = re.compile(r"\d{4} \d{4} \d{4} \d{4}").search(got[1]["text"])[0]
    assert grouped.replace(" ", "") in got[1]["text"] and pii.luhn(grouped.replace(" ", "")) and grouped.replace(" ", "") in got[2]["text"]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1]["text"])
    person = re.search(r"Mrs\. (\w+) (\w+) met (\w+) (\w+); (\w+) (\w+) left", got[1]["text"])
    assert person[1] in pii.GIVEN["latin", "f"] and person[3] in pii.GIVEN["latin", "m"] and (person[1], person[2]) == (person[5], person[6])
    assert f"{person[1]} {person[2]}" in got[2]["text"]
    assert any(n in got[1]["text"] for n in pii.GIVEN["cyrillic", "f"]) and len(new_hits) >= 9
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(spark, docs, key="k2").collect()}
    assert other[1] != got[1]["text"]
    assert pii.pseudonymize(spark, docs.where("false"), key="k1").count() == 0


def test_layouts_of_cards_addresses_and_national_phones():
    text = ("Card 3782 822463 10005 or 378282246310005, from 2001:DB8:0:0:8:800:200C:417A or 2001:db8::8:800:200c:417a or fe80::1a, "
            "call 030 1234567 or 0171/2345678 or 089-123 456 78.")
    found = pii.find(text)
    assert [(k, text[a:b]) for a, b, k, _ in found] == [
        ("card", "3782 822463 10005"), ("card", "378282246310005"), ("ip", "2001:DB8:0:0:8:800:200C:417A"),
        ("ip", "2001:db8::8:800:200c:417a"), ("ip", "fe80::1a"), ("phone", "030 1234567"), ("phone", "0171/2345678"), ("phone", "089-123 456 78")]
    assert found[0][3] == found[1][3] and found[2][3] == found[3][3]
    for a, b, kind, norm in found:
        new = pii.rendered(kind, text[a:b], pii.surrogate("k", kind, norm))
        assert new != text[a:b] and [k for _, _, k, _ in pii.find(f"x {new}.")] == [kind]
    assert pii.find("at 12:30:45, ratio 1:2, std::vector<a>, a::b, 01.02.2024, 2024-01-02, 0.12345678, v 10 20 30") == []


def test_surrogates_stay_distinct(spark, monkeypatch):
    """Draws from a space of 16 values, 10 entities: redrawn until all differ and none is an entity."""
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, norm, attempt=0: f"{zlib.crc32(f'{key}{norm}{attempt}'.encode()) % 16}")
    drawn = {}
    entities = spark.createDataFrame([("ip", str(i)) for i in range(0, 5)] + [("ip", f"n{i}") for i in range(5)], "kind string, norm string")

    def fake(key):
        def run(batches):
            for batch in batches:
                values = [str(zlib.crc32(f"{key}{n}{a}".encode()) % 16) for n, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values)], ["kind", "norm", "attempt", "value"])
        return run

    monkeypatch.setattr(pii, "_drawn", fake)
    again = {r["norm"]: r["attempt"] for r in pii.redraws(spark, entities, "s").collect()}
    for r in entities.collect():
        drawn[r["norm"]] = pii.surrogate("s", "ip", r["norm"], again.get(r["norm"], 0))
    assert len(set(drawn.values())) == 10 and not set(drawn.values()) & set(drawn)


# -- context tree

def brute_tree(rows, depth, held):
    nodes = collections.defaultdict(lambda: [0, 0])
    coded = {i: b"\xff" * depth + " ".join(words(t)).encode() + b"\xff" for i, t in rows}
    for i, c in coded.items():
        for p in range(depth, len(c) if not held(i) else 0):
            node = 1
            for b in range(7, -1, -1):
                bit = c[p] >> b & 1
                for k in range(depth + 1):
                    nodes[c[p - k:p], node][bit] += 1
                node = 2 * node + bit
    lg, below, beta = math.lgamma, collections.defaultdict(float), {}
    for (c, n), (a, b) in sorted(nodes.items(), key=lambda x: -len(x[0][0])):
        own = lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1)
        total = own
        if len(c) < depth:
            beta[c, n] = own - below[c, n]
            top = max(own, below[c, n])
            total = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below[c, n] - top))
        if c:
            below[c[1:], n] += total

    def one(c, n, d=0):
        key = c[len(c) - d:], n
        if key not in nodes:
            return 0.5
        a, b = nodes[key]
        kt = (b + 0.5) / (a + b + 1)
        if d == depth:
            return kt
        share = 1 / (1 + math.exp(min(700, -beta[key])))
        return share * kt + (1 - share) * one(c, n, d + 1)

    out = {}
    for i, c in coded.items():
        total = 0.0
        for p in range(depth, len(c)):
            node = 1
            for b in range(7, -1, -1):
                bit, p1 = c[p] >> b & 1, one(c[p - depth:p], node)
                total += math.log10(p1 if bit else 1 - p1)
                node = 2 * node + bit
        out[i] = total
    return out


@pytest.mark.parametrize("hot", [0, 50, 10**6])
def test_scores_equal_the_plain_tree(spark, small, hot):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    docs = small.where("n_chars < 600").limit(25).select("doc_id", "text").unionByName(spark.createDataFrame(
        [(9001, None), (9002, ""), (9003, "ÀÉ \x00 zzz\x1f"), (None, "the end"), (9008, "qqqq jjj"), (9010, "qqqq xyzzy")], "doc_id long, text string"))
    rows = texts_of(docs)
    want = brute_tree(rows, 3, held)
    counts = collections.Counter(x for i, t in rows if not held(i) for x in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = context_tree.score(spark, docs.withColumn("row", F.lit("x")), depth=3, hot=max(1, hot), hot_words=max(1, hot)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        tokens = [*words(text[r["doc_id"]]), None]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and abs(r["score"] - want[r["doc_id"]]) < 1e-6 * abs(r["score"])


def test_scores_of_no_documents(spark, no_docs):  # noqa: F811
    assert context_tree.score(spark, no_docs, depth=2).count() == 0


def test_held_out_code_lengths_beat_order_zero(spark, small):
    deep, flat = (context_tree.score(spark, small, depth=d).where("held_out").agg(F.sum("score")).collect()[0][0] for d in (3, 0))
    assert deep > 0.7 * flat


# -- pipeline

def test_pipeline_equals_its_stages_in_plain_python(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").limit(120).unionByName(
        spark.createDataFrame([(70_001, PROSE, None, None, None), (70_002, PROSE, "en", "s", 1), (70_003, None, None, None, None), (70_004, "", "", "", 0)],
                              "doc_id long, text string, lang string, source string, n_chars long"))
    docs = common.land(spark, docs, "some")
    now, columns = docs, docs.columns
    texts = {i: t for i, t in texts_of(docs)}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts_of(now)
        now = common.land(spark, stage(spark, now, sf_dir), "stage")
        if k < 4:
            assert now.columns == columns, name
        ids = collections.Counter(r["doc_id"] for r in now.select("doc_id").collect())
        if k == 0:
            report = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(docs).collect()}
            assert set(ids) == {i for i, kept in report.items() if kept}
        elif k == 1:
            assert set(ids) == {i for i, _, c in groups_of(before, 5, 80) if i == c}
            assert 70_002 not in ids and 70_001 in ids
        elif k == 2:
            items = [r["text"] for r in common.table(spark, sf_dir, "benchmark").collect()]
            assert not [i for i in ids if any(x in texts[i] for x in items)]
            assert len(ids) >= 0.8 * len(before)
        elif k == 3:
            assert max(ids.values()) <= 3 and set(ids) <= {i for i, _ in before}
        else:
            assert ids == collections.Counter(i for i, _ in before)
    assert now.columns == ["doc_id", "start", "n_tokens", "tokens"]


def test_stages_take_empty_tables(spark, no_docs, sf_dir):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name


def test_stages_take_odd_rows(spark, odd_docs, sf_dir):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns and out.count() <= 3 * odd_docs.count(), name
