"""Skew: one key holding a third of all rows.

Results under skew must equal a brute-force computation, grouped work must
be partially aggregated before its shuffle, and a sort-merge join on the hot
key must be split by AQE's skew-join rule.
"""

import re

import pandas as pd
from pyspark.sql import functions as F

from supplylens.operators import geo as G
from supplylens.operators import relational as R
from supplylens.plans.registry import table


def hot_events(spark, sf_dir):
    """events with every third row moved to user 0 (a hot key)."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


def test_latest_row_under_skew_matches_brute_force(spark, sf_dir):
    e = hot_events(spark, sf_dir)
    got = {r.user_id: (r.ts, r.event_id) for r in
           R.latest_row(e, "ts", partition=["user_id"], tiebreak=["event_id"], cols=["ts", "event_id"]).collect()}
    pdf = e.select("user_id", "ts", "event_id").toPandas()
    want = (pdf.sort_values(["ts", "event_id"]).groupby("user_id").tail(1)
            .set_index("user_id")[["ts", "event_id"]])
    assert len(got) == len(want)
    for uid, row in want.iterrows():
        assert got[uid] == (row.ts.to_pydatetime(), row.event_id)


def test_grouped_work_is_partially_aggregated(spark, sf_dir):
    e = hot_events(spark, sf_dir)
    plans = [
        R.latest_row(e, "ts", partition=["user_id"], tiebreak=["event_id"], cols=["value"]),
        R.pct_of_total(e.groupBy("user_id").agg(F.sum("value").alias("v")), "v"),
        R.latest(e, "ts", by=["user_id"]),
    ]
    for df in plans:
        p = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"partial_(max_by|sum|max)", p), p


def test_pct_of_total_under_skew(spark, sf_dir):
    e = hot_events(spark, sf_dir)
    g = e.groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    out = R.pct_of_total(g, "v", partition=["event_type"], digits=9).toPandas()
    sums = out.groupby("event_type")["pct_of_total"].sum()
    assert ((sums - 100).abs() < 1e-6).all()


def test_hot_key_sort_merge_join_is_split(spark, sf_dir):
    e = hot_events(spark, sf_dir)
    users = e.select("user_id").distinct().withColumn("tag", F.col("user_id") % 7)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        j = R.join_on_keys(e.repartition(8, "event_id"), users, ["user_id"])
        n = len(j.collect())
        final = j._jdf.queryExecution().executedPlan().toString()  # the adaptive plan as run
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert n == e.count()
    assert "skew=true" in final, final


def test_tile_summary_all_points_in_one_tile(spark):
    # every point in the same deep tile: the rollup still has one row per zoom
    pts = spark.range(5000).select(F.lit("L").alias("layer"), F.lit(138.6).alias("longitude"),
                                   F.lit(-34.9).alias("latitude"), F.lit(1.0).alias("w"))
    rows = G.tile_summary(pts, 0, 16, measures=["w"]).collect()
    assert len(rows) == 17 and all(r.n_features == 5000 and r.sum_w == 5000.0 for r in rows)
