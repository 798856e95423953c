
from pyspark.sql import functions as F

from supplylens.operators import geo as G
from supplylens.operators import relational as R
from supplylens.plans import geo_queries
from supplylens.plans.registry import table


def test_shares_sum_to_100(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"))
    total = R.pct_of_total(g, "q", digits=6).agg(F.sum("pct_of_total")).first()[0]
    assert abs(total - 100.0) < 1e-3


def test_partitioned_pct_sums_to_100_per_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    sums = R.pct_of_total(g, "q", partition=["l_returnflag"], digits=6) \
        .groupBy("l_returnflag").agg(F.sum("pct_of_total").alias("s")).collect()
    assert all(abs(r.s - 100.0) < 1e-3 for r in sums)


def test_top_k_subset_of_input(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    top = R.top_k(c, [("c_acctbal", "desc"), ("c_custkey", "asc")], 7)
    assert top.count() == 7
    assert top.join(c, ["c_custkey", "c_acctbal"], "left_anti").count() == 0
    floor = top.agg(F.min("c_acctbal")).first()[0]
    assert c.filter(F.col("c_acctbal") > floor).count() <= 6


def test_union_count_is_sum(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    assert R.union_all(a, b).count() == a.count() + b.count()


def test_every_point_in_exactly_one_tile_per_zoom(spark, sf_dir):
    pts = geo_queries.layers(spark, sf_dir).filter(F.col("layer") == "customers")
    t = G.tiles(pts, 0, 8)
    n = pts.filter("abs(latitude) <= 85.0511").count()  # points beyond the limit lie in no tile
    assert 0 < n < pts.count()
    assert t.count() == n * 9
    assert t.groupBy("id", "z").count().filter("count <> 1").count() == 0
    bad = t.filter((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= F.pow(2, "z"))
                   | (F.col("y") >= F.pow(2, "z")))
    assert bad.count() == 0


def test_zoom_limits_per_layer(spark, sf_dir):
    t = G.tiles(geo_queries.layers(spark, sf_dir), 0, 16, layer="layer",
                zoom_limits=geo_queries.ZOOM_LIMITS)
    z = {r.layer: (r.lo, r.hi) for r in t.groupBy("layer").agg(F.min("z").alias("lo"),
                                                                F.max("z").alias("hi")).collect()}
    assert z == {"customers": (0, 16), "suppliers": (4, 16)}


def test_forecast_bounds_bracket_forecast(spark, sf_dir):
    from supplylens.plans.model_queries import forecast_multi
    rows = forecast_multi(spark, sf_dir).collect()
    assert rows
    assert all(r.revenue_lower <= r.revenue_forecast <= r.revenue_upper for r in rows)


def test_tile_rollup_equals_direct_tiling(spark, sf_dir):
    pts = geo_queries.layers(spark, sf_dir)
    direct = G.tile_features(G.tiles(pts, 0, 16, layer="layer", zoom_limits=geo_queries.ZOOM_LIMITS),
                             measures=["acctbal"])
    rolled = G.tile_summary(pts, 0, 16, zoom_limits=geo_queries.ZOOM_LIMITS, measures=["acctbal"])
    cols = ["layer", "z", "x", "y", "n_features", "min_lon", "max_lon", "min_lat", "max_lat"]
    assert direct.select(*cols).exceptAll(rolled.select(*cols)).count() == 0
    assert rolled.select(*cols).exceptAll(direct.select(*cols)).count() == 0
