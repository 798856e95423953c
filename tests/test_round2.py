"""Inputs that the driver tables don't hold: late and quoted headers, bad texts, tiny sums, blank headers, zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplylens.operators import geo, grid, metrics, relational, widgets
from supplylens.sources import readers


def test_preamble_header_past_the_first_split(spark, tmp_path):
    lines = [f"note {i}" for i in range(400)] + ['Series ID,"a,b",c,d'] + [f"{1 + i % 28:02d}-Jan-2024,{i},{i + 1},x" for i in range(200)]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    keep, got = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = readers.read_preamble_csv(spark, f"file://{tmp_path}", date_format="dd-MMM-yyyy")
            assert df.columns == ["date", "ab", "c", "d"]
            got.append(sorted(map(tuple, df.collect()), key=str))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got[0] == got[1] and len(got[0]) == 200


def test_small_sums_pass_having(spark):
    df = spark.createDataFrame([("a", 0.001), ("a", 0.002), ("b", -1.0)], "k string, v double")
    assert [(r.k, r.sum_v) for r in relational.group_sum(df, ["k"], ["v"], having="v").collect()] == [("a", 0.0)]


def test_blank_and_repeated_headers(spark):
    rows = [["a", "", None, "A", "a_1", "b (x)"], ["1", "2", "3", "4", "5", "6"]]
    cells = spark.createDataFrame([("s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)],
                                  "sheet string, row_idx int, col_idx int, value string")
    heads = spark.createDataFrame([("s", 0)], "sheet string, header_row int")
    got = grid.rows_as_maps(grid.apply_header(cells, heads, unique=True)).collect()
    assert [r.record for r in got] == [{"a": "1", "col": "2", "col_1": "3", "A_2": "4", "a_1": "5", "b_x": "6"}]
    assert grid.sanitize_names([x or "" for x in rows[0]]) == ["a", "col", "col_1", "A_2", "a_1", "b_x"]


def test_one_bad_text_does_not_stop_the_rest(spark):
    good = '{"success": true, "result": {"records": [{"x": 1}]}}'
    df = spark.createDataFrame([(good,), ("{broken",), (None,)], "t string")
    assert [r.x for r in readers.json_records_from_text(df, "t").collect()] == [1]


def test_wrong_encoding_is_passed_over(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name\nCafé\n".encode("latin-1"))
    read = lambda enc: lambda: spark.read.option("header", True).option("encoding", enc).csv(f"file://{tmp_path}")
    assert [r.name for r in readers.read_first([read("UTF-8"), read("ISO-8859-1")]).collect()] == ["Café"]


def test_a_failing_kpi_is_null_alone(spark):
    bad = lambda: spark.createDataFrame([("x",)], "v string").select(F.col("v").cast("double"))
    row = metrics.kpis(spark, {"good": lambda: spark.sql("SELECT 2 AS v"), "bad": bad, "gone": lambda: spark.table("no_such")},
                       overrides={"good": bad}).collect()
    assert [tuple(r) for r in row] == [(2.0, None, None)]


def test_context_keeps_every_row(spark):
    df = spark.range(80)
    row = metrics.context(spark, {"all": lambda: df}).collect()[0]
    assert row.context.count('"id"') == 80
    assert metrics.context(spark, {"all": lambda: df}, max_rows=5).collect()[0].context.count('"id"') == 5


def test_points_beyond_the_projection_have_no_tile(spark):
    df = spark.createDataFrame([(0.0, 89.5), (0.0, 10.0), (0.0, -86.0)], "longitude double, latitude double")
    assert {r.latitude for r in geo.tiles(df, 0, 2).collect()} == {10.0}
    assert [r.merc_y is None for r in geo.to_mercator(df).collect()] == [True, False, True]


def test_null_properties_stay(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, "n")], "longitude double, latitude double, brand string, name string")
    assert '"brand":null' in geo.to_features(df).collect()[0].feature


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_grains_do_not_depend_on_the_zone(spark, zone):
    keep = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:41.5' AS t")
        got = {g: df.select(widgets.bucket(F.col("t"), g)).collect()[0][0]
               for g in ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", keep)
    d = dt.datetime
    assert got == {"YEAR": d(2024, 1, 1), "QUARTER": d(2024, 1, 1), "MONTH": d(2024, 3, 1), "WEEK": d(2024, 3, 4), "DAY": d(2024, 3, 10),
                   "HOUR": d(2024, 3, 10, 2), "MINUTE": d(2024, 3, 10, 2, 30), "SECOND": d(2024, 3, 10, 2, 30, 41)}
