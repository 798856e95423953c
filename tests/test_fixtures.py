"""Unit checks on the small inputs listed in FIXTURES.md (sections 2 and 3)."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from supplylens.functions.columns import parse_number
from supplylens.operators import geo as G
from supplylens.operators import grid as GR
from supplylens.operators import relational as R
from supplylens.operators.forecast import quarter_index
from supplylens.operators.scenario import scenario
from supplylens.sources import readers as S


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def cells(spark, rows):
    """rows: {sheet: [[cell, ...], ...]} -> cell table (None = no cell)."""
    out = []
    for sheet, grid in rows.items():
        for r, line in enumerate(grid):
            for c, v in enumerate(line):
                if v is not None:
                    out.append((sheet, r, c, v))
    return spark.createDataFrame(out, "sheet STRING, row_idx INT, col_idx INT, value STRING")


# ---------------------------------------------------------------- sources

def test_src1_missing_token_dropped(spark, tmp_path):
    p = write(str(tmp_path / "a.csv"), "DATE,V\n2024-01-01,80.5\n2024-01-02,.\n")
    rows = S.read_delimited(spark, p, types={"DATE": "date", "V": "double"}).collect()
    assert [(r.DATE, r.V) for r in rows] == [(dt.date(2024, 1, 1), 80.5)]


def test_src2_preamble_header(spark, tmp_path):
    p = write(str(tmp_path / "p.csv"),
              "F11 rates\nTitle,a,b,c\nUnits,x,y,z\nSeries ID,A,B,C\n02-Jan-2024,1,2,3\nbad,1,2,3\n")
    df = S.read_preamble_csv(spark, p)
    assert df.columns == ["date", "A", "B", "C"]
    assert [tuple(r) for r in df.collect()] == [(dt.date(2024, 1, 2), 1.0, 2.0, 3.0)]


def test_src2_fallback_line(spark, tmp_path):
    lines = [f"note {i}" for i in range(10)] + ["d,v1,v2", "03-Feb-2024,5,6"]
    p = write(str(tmp_path / "f.csv"), "\n".join(lines) + "\n")
    df = S.read_preamble_csv(spark, p)
    assert [tuple(r) for r in df.collect()] == [(dt.date(2024, 2, 3), 5.0, 6.0)]


def test_src3_envelopes(spark, tmp_path):
    write(str(tmp_path / "e" / "ok.json"),
          json.dumps({"success": True, "result": {"records": [{"_id": 1, "name": "p"}]}}))
    write(str(tmp_path / "e" / "bad.json"),
          json.dumps({"success": False, "result": {"records": [{"_id": 2, "name": "q"}]}}))
    df = S.read_json_records(spark, str(tmp_path / "e"))
    assert df.columns == ["name"]
    assert [r.name for r in df.collect()] == ["p"]


def test_src4_resource_pick(spark):
    df = spark.createDataFrame(
        [("d", [("a", "CSV", "u1"), ("b", "XLSX", "u2"), ("Freight", "csv", "u3")])],
        "dataset STRING, resources ARRAY<STRUCT<name: STRING, format: STRING, url: STRING>>")
    assert S.pick_resource(df, which="last").first().url == "u3"
    assert S.pick_resource(df, which="first").first().url == "u1"
    assert S.pick_resource(df, which="first", contains="freight").first().url == "u3"


def test_src5_coded_records(spark, tmp_path):
    root = tmp_path / "c"
    write(str(root / "code=IRN" / "p.json"),
          json.dumps({"response": {"data": [{"period": "2024-01", "value": "3200"}]}}) + "\n")
    write(str(root / "code=SAU" / "p.json"),
          json.dumps({"response": {"data": [{"period": "2024-01", "value": "--"}]}}) + "\n")
    df = S.read_coded_records(spark, str(root), {"IRN": "Iran", "SAU": "Saudi Arabia"})
    got = {r.code: (r.name, r.value) for r in df.collect()}
    assert got == {"IRN": ("Iran", 3200.0), "SAU": ("Saudi Arabia", None)}


def test_src7_xml_items(spark, tmp_path):
    p = write(str(tmp_path / "f.xml"),
              '<rss xmlns:x="http://e/x"><channel>\n'
              "<item><title>A</title><x:price>172.9</x:price></item>\n"
              "<item><title>B</title><price>n/a</price></item>\n</channel></rss>\n")
    df = S.read_xml_items(spark, p)
    assert sorted(df.columns) == ["price", "title"]
    assert sorted((r.title, r.price) for r in df.collect()) == [("A", 172.9), ("B", None)]


def test_src8_geojson(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": "a"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"n": "b"},
         "geometry": {"type": "MultiPoint", "coordinates": [[3, 4], [5, 6]]}},
        {"type": "Feature", "properties": {"n": "c"}}]}
    p = write(str(tmp_path / "g.json"), json.dumps(fc))
    got = {r.n: (r.longitude, r.latitude) for r in S.flatten_features(spark, p).collect()}
    assert got == {"a": (1.0, 2.0), "b": (3.0, 4.0), "c": (None, None)}


def test_src9_elements(spark):
    df = spark.createDataFrame([(1, '<ul><li><a href="/x">X</a></li><li><a href="/y">Y</a></li></ul>')],
                               "id INT, html STRING")
    rows = S.extract_elements(df, "html", keep=["id"]).collect()
    assert [(r.pos, r.href, r.text) for r in rows] == [(0, "/x", "X"), (1, "/y", "Y")]


def test_src10_reference_rows(spark):
    t = S.reference_tables(spark)
    assert {k: v.count() for k, v in t.items()} == {
        "refineries": 6, "terminals": 17, "depots": 8, "freight_modes": 5}
    assert t["refineries"].filter(F.col("status") == "Operational").count() == 4


def test_src11_first_that_loads(spark, tmp_path):
    good = spark.range(3)
    got = S.read_first([lambda: spark.read.parquet(str(tmp_path / "missing")),
                        lambda: spark.range(0), lambda: good])
    assert got.count() == 3


# ---------------------------------------------------------------- grid

def test_grd1_header_by_text_count(spark):
    c = cells(spark, {"s": [["Title"], ["1", "2", "3"], ["Month", "A", "B"], ["2024-01", "1", "2"]]})
    for k in (3, 2):
        assert GR.detect_header(c, k=k).first().header_row == 2


def test_grd2_period_header(spark):
    c = cells(spark, {"s": [["Table F"], ["State", "2019-20", "2020-21"], ["NSW", "1", "2"]]})
    assert GR.detect_period_header(c).first().header_row == 1


def test_grd3_drop_empty_rows(spark):
    c = cells(spark, {"s": [["h0", "h1", "h2"], ["a", "1", "2"], ["", "", ""], ["only", None, None]]})
    h = GR.detect_header(c, k=3)
    rows = {r.row_idx for r in GR.apply_header(c, h).collect()}
    assert rows == {1, 3}
    rows = {r.row_idx for r in GR.apply_header(c, h, ignore_first=True).collect()}
    assert rows == {1}


def test_grd4_melt(spark):
    c = cells(spark, {"Average Petrol TGP": [["label", "Sydney", "Perth"], ["note"], ["Calendar Year"],
                                             ["2024", "170.128", "n/a"]],
                      "NOTES": [["label", "X"], [], [], ["2024", "1"]]})
    rows = GR.melt_grid(c, label_rules=[("petrol", "ULP")], default_label="Diesel").collect()
    assert [tuple(r) for r in rows] == [("2024", "Sydney", 170.13, "ULP")]


def test_grd6_routing(spark):
    df = spark.createDataFrame([("Index",), ("Refinery production",), ("Consumption cover",), ("Other",)],
                               "sheet STRING")
    out = GR.route_sheets(df, {"stocks": ["Consumption cover"], "supply": ["Refinery production"]},
                          "sales", exclude=["Index"])
    assert {r.sheet: r.data_category for r in out.collect()} == {
        "Refinery production": "supply", "Consumption cover": "stocks", "Other": "sales"}


def test_grd8_sanitize():
    assert GR.sanitize_names(["Total scope 1 emissions (t CO2-e)", "a  b", "a b", "()"]) == [
        "Total_scope_1_emissions_t_CO2-e", "a_b", "a_b_1", "col"]
    assert GR.sanitize_names(["x", "x_1", "x"]) == ["x", "x_1", "x_2"]


def test_grd9_normalize_nulls(spark):
    df = spark.createDataFrame([("",), ("nan",), ("None",), (".",), ("ok",)], "v STRING")
    assert [r.v for r in GR.normalize_nulls(df).collect()] == [None, None, None, None, "ok"]


# ---------------------------------------------------------------- scalars and aggregates

def test_prj3_parse_number(spark):
    df = spark.createDataFrame([("1,234",), ("",), ("-",), ("1.5",), (None,)], "t STRING")
    assert [r.n for r in df.select(parse_number("t").alias("n")).collect()] == [1234, None, None, None, None]


def test_agg10_topk_before_rollup(spark):
    df = spark.createDataFrame([(f"n{i}", float(i)) for i in range(6)], "name STRING, v DOUBLE")
    out = R.rollup_text(df, F.col("name"), [("v", "desc")], k=5).first().summary
    assert out == "n5; n4; n3; n2; n1"


def test_geo1_points_keep_valid(spark):
    df = spark.createDataFrame([(None, 1.0), ("NaN", 1.0), ("x", 1.0), ("-33.9", 151.2)],
                               "latitude STRING, longitude DOUBLE")
    rows = G.points(df, {"name": ["name", "Name"]}).collect()
    assert [(r.latitude, r.longitude, r.name) for r in rows] == [(-33.9, 151.2, "")]


def test_fc2_quarter_index(spark):
    df = spark.createDataFrame([("2024", "Q2", "170.5"), (None, "Q1", "1"), ("2024", "Q9", "2")],
                               "y STRING, q STRING, v STRING")
    rows = [tuple(r) for r in quarter_index(df, "y", "q", ["v"]).collect()]
    assert rows == [("2024-Q2", dt.date(2024, 4, 1), 170.5), ("2024-Q9", None, 2.0)]


# ---------------------------------------------------------------- scenario golden rows

GOLDEN = [  # date, day, phase, brent, aud, pump, reserve days, supply (base 82.0)
    ("2026-04-01", 0, "Pre-Crisis", 95.0, 0.655, 186.7, 67.0, 27.0),
    ("2026-04-02", 1, "Shock", 97.0, 0.65, 189.2, 66.2, 23.8),
    ("2026-04-04", 3, "Shock", 127.0, 0.64, 217.5, 64.8, 23.8),
    ("2026-04-05", 4, "Escalation", 128.5, 0.635, 219.5, 64.0, 23.8),
    ("2026-04-06", 5, "Escalation", 130.0, 0.63, 221.5, 63.2, 23.8),
    ("2026-04-15", 14, "Escalation", 143.5, 0.585, 239.7, 56.5, 23.8),
    ("2026-04-16", 15, "SPR Release", 142.5, 0.58, 239.5, 55.8, 23.8),
    ("2026-04-24", 23, "SPR Release", 138.5, 0.54, 241.2, 49.8, 23.8),
    ("2026-05-01", 30, "SPR Release", 135.0, 0.54, 238.1, 44.5, 23.8),
    ("2026-05-02", 31, "Recovery", 134.7, 0.541, 237.7, 43.8, 23.8),
    ("2026-05-31", 60, "Recovery", 126.0, 0.57, 226.0, 22.0, 23.8),
    ("2026-06-10", 70, "Recovery", 123.0, 0.58, 221.9, 15.0, 23.8),
    ("2026-06-30", 90, "Recovery", 117.0, 0.6, 213.8, 15.0, 23.8),
]


def _python_curve(base):
    """Independent plain-Python statement of the curve, for cross-checks."""
    out = []
    for day in range(91):
        if day == 0:
            b = base
        elif day <= 3:
            b = base + day * 15
        elif day <= 14:
            b = base + 45 + (day - 3) * 1.5
        elif day <= 30:
            b = base + 61 - (day - 14) * 0.5
        else:
            b = base + 53 - (day - 30) * 0.3
        b = max(b, base + 13)
        aud = max(0.655 - min(day * 0.005, 0.115) + max(0, (day - 30) * 0.001), 0.54)
        pump = 175.0 + (b - base) * 0.9 + ((0.655 - aud) / 0.655) * 175.0 * 0.5
        out.append((day, round(b, 2), round(aud, 4), round(pump, 1),
                    round(max(67.0 - day * 0.75, 15.0), 1), round(27.0 if day == 0 else 27.0 - 3.2, 1)))
    return out


@pytest.fixture(scope="module")
def curve_82(spark):
    src = spark.createDataFrame([(dt.datetime(2026, 3, 1), 82.0)], "ts TIMESTAMP_NTZ, v DOUBLE")
    return {r.day_number: r for r in scenario(src, "ts", "v").collect()}


def test_scn1_golden_rows(curve_82):
    assert len(curve_82) == 91
    for date, day, phase, brent, aud, pump, iea, opec in GOLDEN:
        r = curve_82[day]
        assert (str(r.scenario_date), r.phase, r.brent_usd_bbl, r.aud_usd, r.adelaide_ulp_cpl,
                r.iea_days_coverage, r.opec_supply_mbpd) == (date, phase, brent, aud, pump, iea, opec)


@pytest.mark.parametrize("base", [82.0, 79.37])
def test_scn1_matches_python_rounding(spark, base):
    src = spark.createDataFrame([(dt.datetime(2026, 3, 1), base)], "ts TIMESTAMP_NTZ, v DOUBLE")
    got = [(r.day_number, r.brent_usd_bbl, r.aud_usd, r.adelaide_ulp_cpl, r.iea_days_coverage,
            r.opec_supply_mbpd) for r in scenario(src, "ts", "v").orderBy("day_number").collect()]
    assert got == _python_curve(base)


def test_scn1_empty_input_uses_fallback(spark):
    src = spark.createDataFrame([], "ts TIMESTAMP_NTZ, v DOUBLE")
    r = scenario(src, "ts", "v").filter("day_number = 0").first()
    assert r.brent_usd_bbl == 95.0


def test_grd7_write_split(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sheet STRING, v INT")
    GR.write_split(df, "sheet", {"a": "alpha", "b": "beta", "z": "zeta"}, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.table, r.v) for r in back.collect()) == [("alpha", 1), ("beta", 2)]


def test_src2_multi_split_and_layouts(spark, tmp_path):
    """Header search uses only each file's first split; later splits are
    pure data.  Two layouts in one folder are unioned by name."""
    d = tmp_path / "pre"
    rows = [f"{(dt.date(2020, 1, 1) + dt.timedelta(days=i)).strftime('%d-%b-%Y')},{i},{i * 2},{i * 3}"
            for i in range(400)]
    write(str(d / "a.csv"), "Title,x,y,z\nUnits,a,b,c\n\nSeries ID,A,B,C\n" + "\n".join(rows) + "\n")
    write(str(d / "b.csv"), "Description,q\nSeries ID,A,D,E,F\n01-Jan-2021,7,8,9,10\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        lines = S._indexed_lines(spark, str(d / "a.csv"))
        assert lines.select("block").distinct().count() > 3
        df = S.read_preamble_csv(spark, str(d))
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(df.columns) == ["A", "B", "C", "D", "E", "F", "date"]
    assert len(got) == 401
    a = sorted((r.date, r.A, r.B, r.C) for r in got if r.B is not None)
    assert a[0] == (dt.date(2020, 1, 1), 0.0, 0.0, 0.0) and a[-1][1] == 399.0
    b = [r for r in got if r.D is not None]
    assert [(r.date, r.A, r.D, r.E, r.F) for r in b] == [(dt.date(2021, 1, 1), 7.0, 8.0, 9.0, 10.0)]


def test_src1_latin1(spark, tmp_path):
    p = str(tmp_path / "l.csv")
    with open(p, "wb") as f:
        f.write("name,v\ncaf\xe9,1\n".encode("latin-1"))
    rows = S.read_delimited(spark, p, types={"v": "int"}, encoding="ISO-8859-1").collect()
    assert [(r.name, r.v) for r in rows] == [("café", 1)]


def test_widget_kinds(spark):
    from supplylens.operators import widgets as W
    df = spark.createDataFrame([("a", 1.0, dt.datetime(2024, 1, 5)), ("a", 2.0, dt.datetime(2024, 2, 1)),
                                ("b", 4.0, dt.datetime(2024, 2, 9))], "k STRING, v DOUBLE, ts TIMESTAMP_NTZ")
    assert sorted(tuple(r) for r in W.bar(df, "k", "v").collect()) == [("a", 3.0), ("b", 4.0)]
    assert W.pie(df, "k").columns == ["k", "count(*)"]
    assert W.counter(df, "v").first()[0] == 7.0 and W.counter(df, agg="COUNT").first()[0] == 3
    months = sorted(r[0].month for r in W.line(df, "ts", "v", grain="MONTH").collect())
    assert months == [1, 2]
    assert W.combo(df, "k", [("SUM", "v"), ("MAX", "v")]).columns == ["k", "sum(v)", "max(v)"]
    assert W.table(df, ["k", "v"]).count() == 3


def test_geo7_export_and_qa_summary(spark, tmp_path):
    from supplylens.operators import quality as Q
    df = spark.createDataFrame([("x", "A", 1.0, 2.0), ("y", "B", 3.0, 4.0)],
                               "name STRING, layer STRING, longitude DOUBLE, latitude DOUBLE")
    G.export_features(df, str(tmp_path / "f"), partition_by=["layer"])
    back = spark.read.text(str(tmp_path / "f"))
    feats = sorted(json.loads(r.value)["properties"]["name"] for r in back.collect())
    assert feats == ["x", "y"] and sorted(back.columns) == ["layer", "value"]
    rep = spark.createDataFrame([("a", "OK", 3), ("b", "EMPTY", 0), ("c", "MISSING", None)],
                                "table_name STRING, status STRING, n_rows BIGINT")
    assert tuple(Q.load_summary(rep).first()) == (1, 3)


def test_q11_zero_coordinate_kept(spark):
    df = spark.createDataFrame([(0.0, 0.0), (95.0, 10.0), (float("nan"), 1.0)],
                               "latitude DOUBLE, longitude DOUBLE")
    assert [(r.latitude, r.longitude) for r in G.points(df, {}).collect()] == [(0.0, 0.0)]


def test_q13_deeper_geometry_is_null(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": "line"},
         "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]]]}}]}
    p = write(str(tmp_path / "deep.json"), json.dumps(fc))
    r = S.flatten_features(spark, p).first()
    assert (r.n, r.longitude, r.latitude) == ("line", None, None)


def test_src8_geojson_from_text_column(spark):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": "a", "v": 1.5}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"n": "b"},
         "geometry": {"type": "MultiPoint", "coordinates": [[3, 4], [5, 6]]}},
        {"type": "Feature", "properties": {"n": "c"}}]}
    df = spark.createDataFrame([(7, json.dumps(fc))], "page INT, body STRING")
    out = S.flatten_feature_text(df, "body", keep=["page"])
    assert out.columns == ["page", "n", "v", "longitude", "latitude"]
    got = {r.n: (r.page, r.v, r.longitude, r.latitude) for r in out.collect()}
    assert got == {"a": (7, 1.5, 1.0, 2.0), "b": (7, None, 3.0, 4.0), "c": (7, None, None, None)}


def test_src3_envelopes_from_text(spark):
    rows = [(json.dumps({"success": True, "result": {"records": [{"_id": 1, "name": "p", "x": 2.5}]}}),),
            (json.dumps({"success": False, "result": {"records": [{"_id": 2, "name": "q"}]}}),)]
    out = S.json_records_from_text(spark.createDataFrame(rows, "body STRING"), "body")
    assert out.columns == ["name", "x"]
    assert [(r.name, r.x) for r in out.collect()] == [("p", 2.5)]


def test_null_keys_are_kept_as_a_group(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 2.0, 1), ("a", 2.0, 2)],
                               "k STRING, v DOUBLE, t INT")
    pct = {(r.k, r.v): r.pct_of_total for r in R.pct_of_total(df, "v", partition=["k"]).collect()}
    assert pct == {(None, 1.0): 25.0, (None, 3.0): 75.0, ("a", 2.0): 50.0}
    last = sorted((r.k or "", r.v) for r in R.latest(df, "t", by=["k"]).collect())
    assert last == [("", 3.0), ("a", 2.0)]


def test_src2_byte_order_mark(spark, tmp_path):
    p = str(tmp_path / "bom.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("Series ID,A,B,C\n02-Jan-2024,1,2,3\n")
    df = S.read_preamble_csv(spark, p)
    assert df.columns == ["date", "A", "B", "C"]
    assert [tuple(r) for r in df.collect()] == [(dt.date(2024, 1, 2), 1.0, 2.0, 3.0)]


def test_src12_table_exists(spark):
    spark.range(2).createOrReplaceTempView("sl_probe_view")
    assert S.table_exists(spark, "sl_probe_view")
    assert not S.table_exists(spark, "sl_never_created")
    assert S.table(spark, "sl_probe_view").count() == 2


def test_s3_latest_row_keeps_all_null_key(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", dt.datetime(2024, 1, 1), 1),
                                ("b", None, 9)], "k STRING, ts TIMESTAMP_NTZ, id INT")
    got = {r.k: (r.ts, r.id) for r in R.latest_row(df, "ts", partition=["k"], tiebreak=["id"]).collect()}
    assert got == {"a": (None, 2), "b": (dt.datetime(2024, 1, 1), 1)}


def test_drop_scratch(spark):
    from supplylens.session import drop_scratch, scratch_path
    p = scratch_path(spark, "t-drop")
    spark.range(3).write.parquet(p)
    assert spark.read.parquet(p).count() == 3
    assert drop_scratch(spark, p)
    with pytest.raises(Exception):
        spark.read.parquet(p).count()
    with pytest.raises(ValueError):
        drop_scratch(spark, "/tmp/not-ours")


def test_latest_period_literal_range(spark):
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 31, 23, 59), 1), (dt.datetime(2024, 2, 1, 0, 0), 2),
                                (dt.datetime(2024, 2, 29, 23, 59, 59), 3)], "t TIMESTAMP_NTZ, v INT")
    assert sorted(r.v for r in R.latest_period(ts, "t", "MONTH").collect()) == [2, 3]
    assert sorted(r.v for r in R.latest_period(ts, "t", "YEAR").collect()) == [1, 2, 3]
    d = spark.createDataFrame([(dt.date(2024, 3, 1), 1), (dt.date(2024, 3, 2), 2)], "t DATE, v INT")
    assert [r.v for r in R.latest_period(d, "t", "DAY").collect()] == [2]
    assert R.latest_period(ts.limit(0), "t").count() == 0
    lazy = sorted(r.v for r in R.trailing(ts, "t", 29).collect())
    eager = sorted(r.v for r in R.trailing(ts, "t", 29, prune=True).collect())
    assert lazy == eager == [2, 3]


def test_trailing_prune_on_dates(spark):
    d = spark.createDataFrame([(dt.date(2024, 3, 1), 1), (dt.date(2024, 3, 8), 2), (dt.date(2024, 3, 15), 3)],
                              "t DATE, v INT")
    for days in (0, 7, 14, 20):
        lazy = sorted(r.v for r in R.trailing(d, "t", days).collect())
        eager = sorted(r.v for r in R.trailing(d, "t", days, prune=True).collect())
        assert lazy == eager, days
    assert sorted(r.v for r in R.trailing(d, "t", 7, prune=True).collect()) == [2, 3]
