import importlib


def test_entry_contract(spark):
    mod = importlib.import_module("__spark_entry__")
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["o_orderpriority", "avg_o_totalprice", "min_o_totalprice",
                          "max_o_totalprice"]
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert len(mod.queries()) >= 90
