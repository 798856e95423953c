"""The streaming refresh keeps a derived table equal to the batch result
after each drop of input files, without re-reading earlier drops."""

from pyspark.sql import functions as F

from supplylens.plans.registry import table
from supplylens.session import scratch_path
from supplylens.streaming import refresh_table


def test_refresh_after_each_drop(spark, sf_dir):
    src, sink, ckpt = (scratch_path(spark, "t-src"), scratch_path(spark, "t-sink"),
                       scratch_path(spark, "t-ckpt"))
    e = table(spark, sf_dir, "events")
    mid = F.lit("2024-01-15").cast("timestamp_ntz")

    def build(stream):
        return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    def counts(df):
        return {r.event_type: r.n for r in df.collect()}

    first = e.filter(F.col("ts") < mid)
    first.write.parquet(src)
    q = refresh_table(spark, src, e.schema, build, sink, checkpoint=ckpt)
    q.awaitTermination()
    assert counts(spark.read.parquet(sink)) == counts(build(first))
    assert q.lastProgress["numInputRows"] == first.count()

    second = e.filter(F.col("ts") >= mid)
    second.write.mode("append").parquet(src)
    q = refresh_table(spark, src, e.schema, build, sink, checkpoint=ckpt)
    q.awaitTermination()
    assert counts(spark.read.parquet(sink)) == counts(build(e))
    # the second refresh only read the new drop
    assert q.lastProgress["numInputRows"] == second.count()
