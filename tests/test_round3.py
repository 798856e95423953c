"""Page tables, wide sheets, the tile store and many-series charts on inputs the driver tables lack."""

import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from supplylens.operators import geo as G
from supplylens.operators import grid as X
from supplylens.operators.forecast import chart_series_multi
from supplylens.sources import page_tables


# -- page tables

def tables_of(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    out = {}
    for r in page_tables(df, "html", ["page"]).collect():
        out.setdefault((r["page"], r["table"]), {})[r["row"], r["col"]] = r["value"]
    return out


def plain_grid(rows):
    """Slots of (text, colspan, rowspan) rows, cell by cell as a reader would fill in a form."""
    slots, held = {}, {}
    for y, row in enumerate(rows):
        now = {c: t for c, (t, left) in held.items()}
        held = {c: (t, left - 1) for c, (t, left) in held.items() if left > 1}
        free = lambda c: c not in now
        x, mine = 0, {}
        for text, wide, tall in row:
            while not free(x):
                x += 1
            for c in range(x, x + wide):
                if free(c):
                    mine[c] = text
                    left = (1 << 30) if tall == 0 else tall - 1
                    if left > 0:
                        held[c] = (text, left)
            x += wide
        slots.update({(y, c): t for c, t in {**mine, **now}.items()})
    return slots


def test_spans_against_plain_grid(spark):
    rng = random.Random(4)
    pages, want = [], {}
    for i in range(60):
        rows = [[(f"c{y}.{x}", rng.choice([1, 1, 2, 3]), rng.choice([0, 1, 1, 2, 3])) for x in range(rng.randrange(1, 5))]
                for y in range(rng.randrange(1, 6))]
        pages.append("<table>" + "".join(
            "<tr>" + "".join(f'<td colspan="{w}" rowspan={t}>{text}</td>' for text, w, t in row) + "</tr>" for row in rows) + "</table>")
        want[i, 0] = plain_grid(rows)
    assert tables_of(spark, *pages) == want


def test_odd_markup(spark):
    page = ('<script>"<table><tr><td>s"</script><!-- <table><tr><td>c --><p>x</p><TABLE class=a><tr><th rowspan="2">A</th>'
            "<th colspan='2'>B &amp; C</th></tr><tr></tr>\n<tr><th>D<th>E</tr><tr><td>1<td> <b>a</b> b<br>c <td>"
            "<table><tr><td rowspan=0>n1<td>n2</tr><tr><td colspan=x>n3</table>tail</td></tr></table><table></table><table><tr><td>")
    got = tables_of(spark, page, None, "", "no tables", "<a " * 5000, "</table></td>", "<table><tr><td>x<!-- open")
    assert got == {
        (0, 0): {(0, 0): "A", (0, 1): "B & C", (0, 2): "B & C", (1, 0): "A", (1, 1): "D", (1, 2): "E",
                 (2, 0): "1", (2, 1): "a b c", (2, 2): "tail"},
        (0, 1): {(0, 0): "n1", (0, 1): "n2", (1, 0): "n1", (1, 1): "n3"},
        (0, 3): {(0, 0): None}, (6, 0): {(0, 0): "x"}}


def test_page_tables_serve_the_sheet_operators(spark):
    page = "<table><tr><th>Day<th>Price<th>City</tr><tr><td>1<td>2.5<td>Perth</tr><tr><td>2<td>.<td></tr></table>"
    cells = (page_tables(spark.createDataFrame([(1, page)], "page int, html string"), "html", ["page"])
             .select(F.concat_ws("/", "page", "table").alias("sheet"), F.col("row").alias("row_idx"), F.col("col").alias("col_idx"), "value"))
    wide = X.to_wide(X.sheet_table(cells, ignore_first=False))
    assert wide.columns == ["sheet", "row_idx", "Day", "Price", "City"]
    assert sorted(tuple(r)[2:] for r in wide.collect()) == [("1", "2.5", "Perth"), ("2", None, None)]


# -- wide sheets

def test_wide_sheets_unite_by_name(spark):
    rows = [("a", 0, c, v) for c, v in enumerate(["Key", "X", "x", ""])] + [("a", 1, c, v) for c, v in enumerate(["k1", "1", "2", "3"])]
    rows += [("b", 0, c, v) for c, v in enumerate(["KEY", "Y", "Z"])] + [("b", 1, c, v) for c, v in enumerate(["k2", "4", None])]
    rows += [("b", 2, 0, "k3"), ("c", 0, 0, "only one")]
    cells = spark.createDataFrame(rows, "sheet string, row_idx int, col_idx int, value string")
    wide = X.to_wide(X.sheet_table(cells))
    assert wide.columns == ["sheet", "row_idx", "Key", "X", "Y", "x_1", "Z", "col"]
    assert sorted(tuple(r) for r in wide.collect()) == [
        ("a", 1, "k1", "1", None, "2", None, "3"), ("b", 1, "k2", None, "4", None, None, None)]
    assert X.to_wide(X.sheet_table(cells.filter("false"))).columns == ["sheet", "row_idx"]


def test_saved_sheets(spark, tmp_path):
    rows = [(s, 0, c, v) for s in ("s1", "s2", "s3", "skip") for c, v in enumerate(["A", "B", s])]
    rows += [(s, 1, c, f"{s}{c}") for s in ("s1", "s2", "s3", "skip") for c in range(3)]
    cells = spark.createDataFrame(rows, "sheet string, row_idx int, col_idx int, value string")
    saved = X.save_sheets(cells, f"file://{tmp_path}", {"one": ["s1"], "none": ["s9"]}, "rest", exclude=["skip"])
    assert sorted(saved) == ["one", "rest"]
    one, rest = (spark.read.parquet(saved[k]) for k in ("one", "rest"))
    assert one.columns == ["source_sheet", "row_idx", "A", "B", "s1", "data_category"] and one.count() == 1
    assert sorted(r["source_sheet"] for r in rest.collect()) == ["s2", "s3"] and "s1" not in rest.columns


# -- tile store

@pytest.fixture(scope="module")
def spots(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90), "far" if i % 3 else "near") for i in range(4000)]
    rows += [(-i, x, y, "edge") for i, (x, y) in enumerate([(-180.0, 0.0), (180.0, 0.0), (0.0, 90.0), (0.0, -90.0), (0.0, 85.0511),
                                                            (0.0, 0.0), (45.0, 66.51326044311186), (179.99999, -85.05)], 1)]
    return spark.createDataFrame(rows, "id long, longitude double, latitude double, layer string")


@pytest.fixture(scope="module")
def store(spark, spots, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    G.write_tile_store(spots, f"file://{path}/t", row_group=16 << 10)
    return spark.read.parquet(f"file://{path}/t")


def test_stored_keys_give_the_tiles(spots, store):
    limits = {"near": (3, 12)}
    cols = ["layer", "id", "z", "x", "y"]
    a = G.tiles(spots, layer="layer", zoom_limits=limits).select(cols)
    b = G.tiles_from_store(store, zoom_limits=limits).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert {r["id"] for r in spots.select("id").collect()} == {r["id"] for r in store.select("id").collect()}


def test_lookup_equals_tiles(spots, store):
    tiles = G.tiles(spots).select("id", "z", "x", "y").collect()
    rng = random.Random(2)
    for z, x, y in [(0, 0, 0), (16, 5, 5), *[(r["z"], r["x"], r["y"]) for r in rng.sample(tiles, 12)]]:
        got = sorted(r["id"] for r in G.tile_range_lookup(store, z, x, y).collect())
        assert got == sorted(r["id"] for r in tiles if (r["z"], r["x"], r["y"]) == (z, x, y))
    assert G.tile_range_lookup(store, 3, 8, 0).count() == 0 and G.tile_range_lookup(store, 17, 0, 0).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.tuples(*[st.floats(-180, 180)] * 2, *[st.floats(-90, 90)] * 2), st.sampled_from([4, 16, 64]))
def test_box_ranges_hold_every_point(spots, store, box, most):
    x, y = sorted(box[:2]), sorted(box[2:])
    edges = (x[0], y[0], x[1], y[1])
    ranges = G.box_ranges(*edges, most=most)
    assert 0 < len(ranges) <= most and all(a <= b for a, b in ranges)
    assert all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    got = sorted(r["id"] for r in G.bbox_ranges(store, *edges, most=most).select("id").collect())
    assert got == sorted(r["id"] for r in G.in_bbox(spots, *edges).select("id").collect())


def test_empty_box(store):
    assert G.box_ranges(10, 0, 5, 1) == [] and G.bbox_ranges(store, 10, 0, 5, 1).count() == 0


def test_row_groups_can_be_skipped(store):
    """Most row groups lie outside the ranges of a small box."""
    ranges = G.box_ranges(10, 10, 40, 40)
    groups = []
    for f in store.inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        at = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == G.KEY)
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        groups += [(s.min, s.max) for s in stats]
    hit = [g for g in groups if any(a <= g[1] and g[0] <= b for a, b in ranges)]
    assert len(groups) >= 8 and len(hit) < len(groups) / 2


def test_summary_leaves_out_points_beyond_the_limit(spots):
    a = {(r["layer"], r["z"], r["x"], r["y"]): r["n_features"] for r in G.tile_summary(spots, 0, 4).collect()}
    b = {(r["layer"], r["z"], r["x"], r["y"]): r["n_features"] for r in G.tile_features(G.tiles(spots, 0, 4)).collect()}
    assert a == b


# -- charts

def test_chart_of_many_series(spark):
    actual = spark.createDataFrame([("k", "2024-01-01", 1.0, None), ("k", "2024-02-01", 2.0, 7.0), ("k", "2024-03-01", None, 8.0),
                                    ("k", None, 5.0, 5.0)], "key string, ds string, a double, b double").withColumn("ds", F.to_date("ds"))
    fc = spark.createDataFrame([("k", "2024-03-01", 2.5, 3.0, 2.0, 8.5), ("k", "2024-04-01", 2.6, 3.1, 2.1, 8.6), (None, "2024-04-01", 1.0, 1.0, 1.0, None)],
                               "key string, ds string, a_forecast double, a_upper double, a_lower double, b_forecast double").withColumn("ds", F.to_date("ds"))
    got = chart_series_multi(actual, fc, {"A": ("a", "a_forecast"), "B": ("b", "b_forecast")}, by=["key"])
    rows = {(r["key"], r["series"], str(r["ds"])): (r["actual"], r["forecast"], r["upper"], r["lower"]) for r in got.collect()}
    assert rows == {
        ("k", "A", "2024-01-01"): (1.0, None, None, None), ("k", "A", "2024-02-01"): (2.0, 2.0, None, None),
        ("k", "A", "2024-03-01"): (None, 2.5, 3.0, 2.0), ("k", "A", "2024-04-01"): (None, 2.6, 3.1, 2.1),
        ("k", "B", "2024-02-01"): (7.0, None, None, None), ("k", "B", "2024-03-01"): (8.0, 8.0, None, None),
        ("k", "B", "2024-04-01"): (None, 8.6, None, None), (None, "A", "2024-04-01"): (None, 1.0, 1.0, 1.0)}


# -- readers, briefing, filters, states

def test_headers_of_many_layouts(spark, tmp_path):
    from supplylens.sources import read_preamble_csv
    files = {"a": 'TITLE\nSeries ID,"Rate, a",x,x\n02-Jan-2020,"1,5",2,3\n03-Jan-2020,"7",,\n,,,\nnot a date,1,2,3\n',
             "b": '# c\nSeries ID,,X\n02-Feb-2020,4,5,\n04-Feb-2020,6\n', "c": "Series ID,RATE_A,z,q\n05-Mar-2020,8,9,1\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = read_preamble_csv(spark, f"file://{tmp_path}", numeric=False)
    rows = {str(r["date"]): {k.lower(): v for k, v in r.asDict().items() if v is not None and k != "date"} for r in got.collect()}
    assert rows["2020-01-02"] == {"rate_a": "1,5", "x": "2", "x_1": "3"} and rows["2020-01-03"] == {"rate_a": "7"}
    assert rows["2020-03-05"] == {"rate_a": "8", "z": "9", "q": "1"}


def test_plan_of_many_sources_stays_small(spark, tmp_path):
    from supplylens.sources import read_tagged_files
    sizes = []
    for n in (3, 120):
        for i in range(n):
            (tmp_path / f"{n}" / f"s{i}").mkdir(parents=True)
            (tmp_path / f"{n}" / f"s{i}" / "x.csv").write_text(f"id,v {i % 2}\n{i},1.5\n{i},bad\n")
        df = read_tagged_files(spark, {f"c{i}": f"file://{tmp_path}/{n}/s{i}/" for i in range(n)}, {"c1": "one"}, types={"id": "int", "v_0": "double"})
        assert df.columns == ["id", "v_0", "v_1", "region_code", "city"] and df.count() == 2 * n
        row = df.filter("region_code = 'c1'").orderBy("v_1").collect()
        assert [(r["id"], r["v_0"], r["v_1"], r["city"]) for r in row] == [(1, None, "1.5", "one"), (1, None, "bad", "one")]
        assert {r["v_0"] for r in df.filter("region_code = 'c2'").collect()} == {1.5, None}
        sizes.append(df._jdf.queryExecution().analyzed().toString().count("\n"))
    assert sizes[0] == sizes[1]


def test_briefing_in_chunks(spark):
    from supplylens.operators.metrics import context
    df = spark.range(2500).repartition(6).select((F.col("id") * 2).alias("k"), F.lit(None).cast("string").alias("v"))
    sets = {"many": lambda: df, "none": lambda: df.filter("false"), "runs badly": lambda: df.select(F.raise_error(F.lit("no")).alias("x")),
            "plans badly": lambda: df.select("nothing")}
    got = {(r["label"], r["chunk"]): r["context"] for r in context(spark, sets, chunk_rows=1000).collect()}
    assert sorted(got) == [("many", 0), ("many", 1), ("many", 2), ("none", 0), ("plans badly", 0), ("runs badly", 0)]
    import json
    assert [x["k"] for i in range(3) for x in json.loads(got["many", i])] == list(range(0, 5000, 2))
    assert got["none", 0] == "[]" and got["runs badly", 0] == got["plans badly", 0] == "unavailable"
    assert [len(json.loads(r["context"])) for r in context(spark, {"m": lambda: df}, max_rows=3).collect()] == [3]


def test_filters_with_nulls(spark):
    from supplylens.operators.widgets import filter_values, filter_values_all
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), (None, 5), ("b", None)], "f string, g int")
    conditions = {"f": F.col("f") == "a", "g": F.col("g") > 2}
    got = {(r["field"], r["value"]): r["associativity"] for r in filter_values_all(df, {**conditions}).collect()}
    for field in ("f", "g"):
        others = [c for k, c in conditions.items() if k != field]
        for r in filter_values(df, field, others).collect():
            assert got.pop((field, None if r[0] is None else str(r[0]))) == r[1]
    assert not got


def test_states_merge_to_the_view(spark):
    from supplylens.operators.metrics import MetricStates
    rows = [(i % 3, i % 2 or None, 1e9 + i * 0.25 if i % 5 else None) for i in range(200)] + [(9, 9, 7.0), (8, 8, None)]
    df = spark.createDataFrame(rows, "a int, b int, v double")
    states = MetricStates(MetricStates.build(df, {"a": "a", "b": "b"}, "v"), ["a", "b"])
    for dims in ([], ["a"], ["b"], ["a", "b"]):
        want = df.groupBy(*dims).agg(F.avg("v").alias("avg"), F.stddev_samp("v").alias("stddev"), F.min("v").alias("min"),
                                     F.max("v").alias("max"), F.count(F.lit(1)).alias("rows"))
        key = lambda r: str([r[d] for d in dims])
        for x, y in zip(sorted(states.query(dims).collect(), key=key), sorted(want.collect(), key=key), strict=True):
            assert x["rows"] == y["rows"] and x["min"] == y["min"] and x["max"] == y["max"]
            assert x["avg"] == y["avg"] or abs(x["avg"] - y["avg"]) < 1e-9 * abs(y["avg"])
            assert (x["stddev"] is None and y["stddev"] is None) or abs(x["stddev"] - y["stddev"]) < 1e-6 * (1 + y["stddev"])
    with pytest.raises(KeyError):
        states.query(["c"])


def test_with_scalar_refuses_many_rows(spark):
    from supplylens.operators.relational import with_scalar
    df = spark.range(3)
    assert [tuple(r) for r in with_scalar(df, df.agg(F.max("id").alias("m"), F.min("id").alias("n"))).collect()] == [(i, 2, 0) for i in range(3)]
    with pytest.raises(Exception, match="more than one row|SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        with_scalar(df, spark.range(2).select(F.col("id").alias("m"))).collect()
