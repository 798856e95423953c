"""Page tables are read within the row of their page: no window, no shuffle, parts of any length."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from supplylens.sources import page_tables
from supplylens.sources.readers import _PART


def slots(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["page"], r["table"]), {})[r["row"], r["col"]] = r["value"]
    return out


def test_no_window_and_no_shuffle(spark):
    df = page_tables(spark.createDataFrame([(1, "<table><tr><td>a")], "page int, html string"), "html", ["page"])
    with redirect_stdout(io.StringIO()) as told:
        df.explain()
    assert "Window" not in told.getvalue() and "Exchange" not in told.getvalue(), told.getvalue()


def test_long_page_across_parts(spark):
    n = 3 * _PART + 7  # rows; a table within a cell of each, and one cell whose text has many pieces
    rows = "".join(f"<tr><td>k{i}<td rowspan=2>v{i}<table><tr><td>in{i}</table>t<b>{i}</b></td></tr>" for i in range(n))
    page = f"<table>{rows}<tr><td>" + "x<br>" * n + "<td colspan=3>last"
    got = slots(page_tables(spark.createDataFrame([(1, page)], "page int, html string"), "html", ["page"]))
    assert len(got) == n + 1 and all(got[1, i + 1] == {(0, 0): f"in{i}"} for i in range(n))
    outer, held = got[1, 0], None
    for i in range(n):  # every second row's cell of two rows is passed over by the next row's second cell
        want = {0: f"k{i}"}
        if held is not None:
            want |= {1: held, 2: f"v{i}t{i}"} if held_at == 1 else {1: f"v{i}t{i}", 2: held}
            held_at = 2 if held_at == 1 else 1
        else:
            want[1], held_at = f"v{i}t{i}", 1
        held = f"v{i}t{i}"
        assert {c: outer[i, c] for c in range(3) if (i, c) in outer} == want, i
    assert outer[n, 0] == " ".join(["x"] * n)
    assert sorted(c for r, c in outer if r == n) == ([0, 1, 2, 3, 4] if held_at == 1 else [0, 1, 2, 3])


def test_end_tags_without_a_table_and_odd_attributes(spark):
    pages = ["</table></table><table><tr><td>no<table><tr><td>no either<table><tr><td rowspan = ' 2'>yes > 1<td title='<br>'>b</table>",
             "<p>x</p></td><table><td>a<tr><td>b</td>gone<th COLSPAN=\"2\">c<tr></tr></table></table><table><tr><td>lost"]
    df = spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    assert slots(page_tables(df, "html", ["page"])) == {
        (0, 2): {(0, 0): "yes > 1", (0, 1): "'>b"},
        (1, 0): {(0, 0): "a", (1, 0): "b", (1, 1): "c", (1, 2): "c"}}


def test_pages_with_equal_and_null_keys_stay_apart(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a"), (1, "<table><tr><td>b"), (None, "<table><tr><td>c")], "page int, html string")
    got = page_tables(df, "html", ["page"]).select("page", "table", "row", "col", "value")
    assert got.count() == 3 and got.dtypes == [("page", "int"), ("table", "bigint"), ("row", "int"), ("col", "int"), ("value", "string")]
    assert {r["value"] for r in got.where(F.col("page").isNull()).collect()} == {"c"}
