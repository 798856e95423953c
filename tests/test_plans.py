"""Plan checks: no Python UDF anywhere, filters and projections reach the
parquet scan, and the only nested-loop joins are against one-row sides."""

import re

import pytest

from supplylens.plans import registry

NAMES = sorted(registry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_in_plan(spark, sf_dir, name):
    p = plan(registry.queries()[name](spark, sf_dir))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF|FlatMapGroupsInPandas", p), name
    assert "CartesianProduct" not in p, name


def test_filter_pushed_to_scan(spark, sf_dir):
    p = plan(registry.queries()["pick_value"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[.*EqualTo\(l_linenumber,4\)", p), p
    p = plan(registry.queries()["since_literal"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate" in p, p


def test_projection_pruned(spark, sf_dir):
    p = plan(registry.queries()["top_k"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(x.split(":")[0] for x in schema.split(",")) == {"c_custkey", "c_name", "c_acctbal"}


def test_top_k_is_take_ordered(spark, sf_dir):
    p = plan(registry.queries()["top_k"](spark, sf_dir))
    assert "TakeOrderedAndProject" in p


def test_pct_of_total_has_no_unpartitioned_window(spark, sf_dir):
    p = plan(registry.queries()["pct_of_total"](spark, sf_dir))
    assert "Window" not in p


# Window operators only where each window partition is bounded: the prompt
# context (input capped first) and the preamble reader (partitioned by file,
# first-split lines only), header apply (partitioned by sheet row), the tokens of
# one page, and the periods of one chart series.
# Nested-loop joins only against one-row aggregates.
WINDOW_OK = {"briefing_context", "read_preamble", "grid_apply", "grid_apply_ignore_first", "page_tables",
             "chart_series_multi"}
NESTED_LOOP_OK = {"kpi_row", "pct_of_total", "catalogue_producers_percent"}


@pytest.mark.parametrize("name", NAMES)
def test_no_unbounded_window_or_nested_loop(spark, sf_dir, name):
    p = plan(registry.queries()[name](spark, sf_dir))
    if name not in WINDOW_OK:
        assert not re.search(r"\bWindow\b", p), name
    if name not in NESTED_LOOP_OK:
        assert "BroadcastNestedLoopJoin" not in p, name


def test_latest_period_is_pushed_into_the_scan(spark, sf_dir):
    for name, col in (("latest_group_avg", "o_orderdate"), ("rounded_latest", "ts"),
                      ("trailing_days", "ts")):
        p = plan(registry.queries()[name](spark, sf_dir))
        assert f"GreaterThanOrEqual({col}," in p, (name, p)
        assert "Subquery" not in p, name


def test_sources_are_read_once(spark, sf_dir):
    for name in ("forecast_single", "forecast_multi", "forecast_by_key"):
        assert plan(registry.queries()[name](spark, sf_dir)).count("FileScan") == 1, name
    df = registry.queries()["chart_series_multi"](spark, sf_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert plan(registry.queries()["page_tables"](spark, sf_dir)).count("FileScan") == 1


def test_tile_keys_are_pushed_into_the_scan(spark, sf_dir):
    p = plan(registry.queries()["tile_range_lookup"](spark, sf_dir))
    assert len(re.findall(r"PushedFilters: \[IsNotNull\(tile_key\)", p)) == 17, p
    boxes = plan(registry.queries()["bbox_ranges"](spark, sf_dir)).split("PushedFilters: [")[1:]
    assert len(boxes) == 2 and all("Or(" in s.split("ReadSchema")[0] for s in boxes)
