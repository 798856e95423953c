"""Registered queries against their SQL, on the small tables and on odd rows."""

import importlib

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_compare import canon_rows, compare, duck
from supplylens.llm import chat, mixing, quality_rules, registry, warc

from conftest import SF_SMALL
from llm_fixtures import no_docs, odd_docs  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    res = compare(spark, duck(SF_SMALL), name, registry.queries()[name], registry.oracle_sql()[name], SF_SMALL)
    assert res["status"] == "ok", res


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    entry = importlib.import_module("__spark_entry__")
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def against_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    got = con.sql(sql)
    cols, rows = list(got.columns), got.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert canon_rows(df.columns, [tuple(r) for r in df.collect()]) == canon_rows(cols, rows)


def test_mixing_of_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        planned = mixing.plan(spark, docs)
        digest = planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
        against_sql(digest, mixing.OP8_SQL, documents=docs.select("doc_id", "text", "source"))
    mixed = mixing.mix(spark, odd_docs)
    assert mixed.columns == odd_docs.columns
    planned = mixing.plan(spark, odd_docs).agg(F.sum("copies")).collect()[0][0]
    assert mixed.count() == planned and mixing.mix(spark, no_docs).count() == 0
    assert mixing.mix(spark, odd_docs).exceptAll(mixed).count() == 0  # reruns agree
    assert {r["size"] for r in mixed.collect()} == {"x"}


def test_targets_are_water_filled(spark):
    sizes = {"a": 10, "b": 400, "c": 90, "d": 0, None: 500}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["_source"]: r for r in mixing.source_targets(df).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while True:  # shares in rounds, as the contract words it
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= over
        left = sum(sizes.values()) - sum(target.values())
    target |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
    assert all(abs(got[s]["target"] - target[s]) < 1e-6 for s in sizes)


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"),
                                      F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    for r in mixing.plan(spark, docs).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t")).collect():
        assert abs(r["t"] - r["target"]) < 0.05 * r["target"]


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        short = docs.where("coalesce(length(text), 0) < 10000")  # the SQL copies a text's words for each of them
        against_sql(quality_rules.quality_report(short), quality_rules.OP2_SQL, documents=short.select("doc_id", "text"))
    long = quality_rules.quality_report(odd_docs.where("doc_id = 7")).collect()[0]
    assert (long["n_words"], long["n_repeat_words"], long["kept"]) == (30_000, 0, True)
    kept = quality_rules.quality_filter(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 3, 7, 8]
    assert {r["_words"] for r in kept.collect()} == {"x"}
    assert quality_rules.quality_filter(no_docs).count() == 0


def test_quality_order_never_changes_the_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    orders = [quality_rules.RULES, tuple(reversed(quality_rules.RULES))]
    a, b = ({r["doc_id"] for r in quality_rules.quality_filter(docs, order=o).collect()} for o in orders)
    assert a == b
    ranked = quality_rules.ranked(docs)
    assert {r.name for r, _, _ in ranked} == {r.name for r in quality_rules.RULES}
    worth = [share / cost for _, cost, share in ranked]
    assert worth == sorted(worth, reverse=True)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
            (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", ""), (5, 0, None, None),
            (None, 0, "user", "hi"), (None, 1, "user", "other"), (6, None, "user", "x"), (6, None, "user", "x"), (7, 0, "user", "x"),
            (8, 0, "user", "x"), (8, 1, "user", "x"), (9, -3, "user", "hi"), (9, 40_000, "assistant", "yo"), (9, 41_000, "user", "z")]
    rows += [(20, i, "user", f"t{i % 7}") for i in range(1500)] + [(21, i, "user", f"t{i % 7}") for i in range(1400)]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, at string, conv string")
    got = chat.collapse(spark, turns).withColumnRenamed("conv", "conv_id")
    against_sql(got, chat.OP7_SQL, conversations=turns.select("conv_id", "turn", "role", "text"))
    ids = {r["conv_id"] for r in got.select("conv_id").distinct().collect()}
    assert ids == {3, 4, 5, None, 6, 9, 20}
    assert {r["part"] for r in got.where("conv_id = 20").collect()} == {1, 2, 3}
    assert chat.collapse(spark, turns.where("false")).count() == 0


def test_chat_of_reused_and_null_ids(spark):
    """An id whose turn numbers start again and again, and null ids and turns, are cut by position."""
    rows = [(None, i % 8, "user", f"t{i}") for i in range(3000)] + [(1, None, "user", "same") for _ in range(1300)]
    rows += [(2, i % 8, None, f"u{i % 11}") for i in range(1100)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.collapse(spark, turns).withColumnRenamed("conv", "conv_id")
    against_sql(got, chat.OP7_SQL, conversations=turns)
    sizes = {(r["conv_id"], r["part"]): r["n_turns"] for r in got.collect()}
    want = {None: 3000, 1: 1300, 2: 1100}
    assert sizes == {(c, i + 1): min(512, n - 512 * i) for c, n in want.items() for i in range(-(-n // 512))}


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip_with_magic_in_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-row:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/", "plain"), (2, None, fake), (3, "http://c/WARC/1.1", "x" + fake + fake + "y"), (4, "u\r\nv", None),
            (5, "u", ""), (6, "u", fake), (7, "u", "WARC/1.1\r\n"), (8, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"), (9, "é", "Ünï\r\n\r\ncode \x00"),
            (10, "u", "long " * 50_000), (11, "u", "end WARC/1.1"), (12, "u", "plain"), (12, "u", "plain"), (None, "u", "lost")]
    pages = _pages(spark, rows).repartition(2)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark, pages, path)
    try:
        for size in ("128m", "999b"):  # whole files, and splits smaller than a record
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read_warc(spark, path)
            texts = {}
            for r in got.withColumn("text", F.col("payload").cast("string")).collect():
                assert r["type"] == "revisit" or r["declared_digest"] == f"sha1:{r['payload_digest']}"
                texts.setdefault(r["record_id"], []).append((r["type"], r["text"]))
            assert len(texts) == 13 and sum(map(len, texts.values())) == len(rows)
            assert texts["<urn:x-row:3>"] == [("response", rows[2][2])] and texts["<urn:x-row:>"] == [("response", "lost")]
            assert texts["<urn:x-row:12>"] == [("response", "plain")] * 2 and texts["<urn:x-row:1>"] == [("revisit", "")]
            assert texts["<urn:x-row:2>"][0][0] == "revisit" and texts["<urn:x-row:6>"] == [("response", fake)]
            for i in (7, 8, 9, 10, 11):
                assert texts[f"<urn:x-row:{i}>"] == [("response", rows[i - 1][2])]
            digest = warc.resolve(spark, got).select(
                warc.row_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                F.col("type").alias("record_type"), warc.row_id(F.col("refers_to")).alias("refers_to"))
            against_sql(digest.where("page_id is not null"), warc.OP1_SQL, pages=pages.where("page_id is not null"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_warc_empty_table_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_warc(spark, _pages(spark, [(1, "u", "x")]).where("false"), path)
    assert warc.read_warc(spark, path).count() == 0
    path = f"{tmp_path}/cut"
    warc.write_warc(spark, _pages(spark, [(i, "u", f"page {i} " * 9) for i in range(5)]).coalesce(1), f"file://{path}")
    part = next(p for p in (tmp_path / "cut").iterdir() if p.name.startswith("part"))
    part.write_bytes(part.read_bytes()[:-40])
    (tmp_path / "cut" / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="end of"):
        warc.read_warc(spark, f"file://{path}")
    assert warc.read_warc(spark, f"file://{path}", strict=False).count() == 4


def test_min_dedup_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/min"
    warc.write_warc(spark, _pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), path, min_dedup_bytes=3)
    kinds = {r["record_id"]: r["type"] for r in warc.read_warc(spark, path).collect()}
    assert [kinds[f"<urn:x-row:{i}>"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
