"""Registered queries for the readers, sinks and load report.

Each query first has Spark write files derived from a driver table (CSV
with a preamble, JSON envelopes, per-entity JSON pages, XML items, GeoJSON
feature collections...) into a fresh folder under the shared checkpoint
location, then reads them back with the library reader.  The DuckDB oracle
computes the expected rows straight from the driver tables.  Documents are
written in bounded pages (grouped by a key), never as one whole-table row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from supplylens.functions.columns import truncate_to

from supplylens.operators import quality as Q
from supplylens.plans import geo_queries
from supplylens.plans.registry import register, table
from supplylens.session import scratch_path
from supplylens.sources import readers as S

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _ordered_text(df, path):
    """Write ``(k, line)`` rows as one text file in ``k`` order (fixture
    files whose line order matters, e.g. a preamble above the data)."""
    df.repartition(1).sortWithinPartitions("k").select("line").write.mode("overwrite").text(path)


# --------------------------------------------------------------------------
# SRC1
# --------------------------------------------------------------------------


@register("read_delimited", """
SELECT date, price FROM (
  SELECT CAST(ts AS DATE) AS date, round(sum(value), 2) AS price
  FROM events WHERE event_type = 'purchase' GROUP BY 1) t
WHERE dayofweek(date) <> 0
""")
def read_delimited_q(spark, d):
    path = scratch_path(spark, "delimited")
    e = table(spark, d, "events").filter(F.col("event_type") == "purchase")
    daily = e.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("v"))
    (daily.select(F.date_format("day", "yyyy-MM-dd").alias("DATE"),
                  F.when(F.dayofweek("day") == 1, F.lit(None)).otherwise(F.col("v")).alias("VALUE"))
     .write.mode("overwrite").option("header", True).option("nullValue", ".").csv(path))
    return S.read_delimited(spark, path, types={"DATE": "date", "VALUE": "double"},
                            rename={"DATE": "date", "VALUE": "price"}, na=".")


# --------------------------------------------------------------------------
# SRC2
# --------------------------------------------------------------------------

_PREAMBLE = [
    "EVENT VALUES TABLE",
    "Title,Click value,Error value,Purchase value,Signup value,View value",
    "Description,Daily total,Daily total,Daily total,Daily total,Daily total",
    "Units,AUD,AUD,AUD,AUD,AUD",
    "",
    "# generated from the event log",
    "Series ID," + ",".join(EVENT_TYPES),
]


@register("read_preamble", f"""
SELECT CAST(ts AS DATE) AS date,
       {", ".join(f"round(sum(value) FILTER (WHERE event_type = '{t}'), 2) AS {t}" for t in EVENT_TYPES)}
FROM events GROUP BY 1
""")
def read_preamble_q(spark, d):
    path = scratch_path(spark, "preamble")
    e = table(spark, d, "events")
    piv = (e.groupBy(F.to_date("ts").alias("day")).pivot("event_type", EVENT_TYPES)
           .agg(F.round(F.sum("value"), 2)))
    data = piv.select(
        F.concat(F.lit("1-"), F.date_format("day", "yyyy-MM-dd")).alias("k"),
        F.concat_ws(",", F.date_format("day", "dd-MMM-yyyy"),
                    *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in EVENT_TYPES]).alias("line"))
    head = spark.createDataFrame([(f"0-{i:03d}", s) for i, s in enumerate(_PREAMBLE)], "k STRING, line STRING")
    tail = spark.createDataFrame([("2-end", "Source: event log,,,,,")], "k STRING, line STRING")
    _ordered_text(head.unionByName(data).unionByName(tail), path)
    return S.read_preamble_csv(spark, path)


# --------------------------------------------------------------------------
# SRC3
# --------------------------------------------------------------------------


@register("json_records", """
SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey <> 4
""")
def json_records_q(spark, d):
    path = scratch_path(spark, "envelopes")
    n = table(spark, d, "nation")
    env = (n.groupBy("n_regionkey")
           .agg(F.collect_list(F.struct(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name"),
                                        F.col("n_regionkey").alias("region"))).alias("records"))
           .select((F.col("n_regionkey") != 4).alias("success"),
                   F.struct(F.col("records")).alias("result")))
    env.write.mode("overwrite").json(path)
    return S.read_json_records(spark, path, multiline=False)


@register("json_records_text", """
SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey <> 4
""")
def json_records_text(spark, d):
    """The same envelopes held as a text column (e.g. a landed API table)."""
    n = table(spark, d, "nation")
    env = (n.groupBy("n_regionkey")
           .agg(F.collect_list(F.struct(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name"),
                                        F.col("n_regionkey").alias("region"))).alias("records"))
           .select(F.to_json(F.struct((F.col("n_regionkey") != 4).alias("success"),
                                      F.struct(F.col("records")).alias("result"))).alias("body")))
    return S.json_records_from_text(env, "body")


# --------------------------------------------------------------------------
# SRC4 / SRC9
# --------------------------------------------------------------------------

_LINKS_SQL = f"""
x AS (SELECT page_id, regexp_extract_all(html, '{S.LINK_ITEM_PATTERN}', 1) AS hrefs,
             regexp_extract_all(html, '{S.LINK_ITEM_PATTERN}', 2) AS texts FROM pages),
y AS (SELECT page_id, hrefs, texts, unnest(range(len(hrefs))) AS pos FROM x),
links AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, hrefs[pos + 1] AS href, texts[pos + 1] AS text FROM y)"""


@register("page_elements", f"WITH {_LINKS_SQL} SELECT * FROM links")
def page_elements(spark, d):
    return S.extract_elements(table(spark, d, "pages"), "html", keep=["page_id"])


def _catalog(spark, d):
    links = S.extract_elements(table(spark, d, "pages"), "html", keep=["page_id"])
    fmt = (F.when(F.col("text").rlike("^[a-m]"), "csv").when(F.col("text").rlike("^[n-z]"), "CSV")
           .otherwise("XLSX"))
    res = F.struct("pos", F.col("text").alias("name"), fmt.alias("format"), F.col("href").alias("url"))
    return (links.groupBy(F.col("page_id").alias("dataset"))
            .agg(F.sort_array(F.collect_list(res)).alias("_r"))
            .select("dataset", F.transform("_r", lambda s: F.struct(s["name"].alias("name"),
                                                                      s["format"].alias("format"),
                                                                      s["url"].alias("url")))
                    .alias("resources")))


def _pick_sql(agg: str, extra: str = "") -> str:
    return f"""
WITH {_LINKS_SQL},
r AS (SELECT page_id AS dataset, pos, text AS name, href AS url,
             CASE WHEN regexp_matches(text, '^[a-m]') THEN 'csv'
                  WHEN regexp_matches(text, '^[n-z]') THEN 'CSV' ELSE 'XLSX' END AS format FROM links)
SELECT dataset, {agg}(name, pos) AS name, {agg}(url, pos) AS url
FROM r WHERE upper(format) = 'CSV' {extra} GROUP BY dataset
"""


@register("resource_pick_last", _pick_sql("arg_max"))
def resource_pick_last(spark, d):
    return S.pick_resource(_catalog(spark, d), which="last")


@register("resource_pick_first", _pick_sql("arg_min"))
def resource_pick_first(spark, d):
    return S.pick_resource(_catalog(spark, d), which="first")


@register("resource_pick_contains", _pick_sql("arg_min", "AND contains(lower(name), 'the')"))
def resource_pick_contains(spark, d):
    return S.pick_resource(_catalog(spark, d), which="first", contains="the")


# --------------------------------------------------------------------------
# SRC5
# --------------------------------------------------------------------------


@register("coded_records", """
WITH m AS (
  SELECT c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS code, strftime(month, '%Y-%m') AS period,
       CASE WHEN month(month) = 12 THEN NULL ELSE CAST(n AS DOUBLE) END AS value, n_name AS name
FROM m JOIN nation ON c_nationkey = n_nationkey
""")
def coded_records(spark, d):
    path = scratch_path(spark, "coded")
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    # (customer, month) is nearly unique per order, so join first and let the
    # (nation, month) count aggregate map-side
    m = (o.join(c, "o_custkey")
         .groupBy("c_nationkey", truncate_to("o_orderdate", "MONTH").alias("month"))
         .agg(F.count(F.lit(1)).alias("n")))
    rec = F.struct(F.date_format("month", "yyyy-MM").alias("period"),
                   F.when(F.month("month") == 12, F.lit("--")).otherwise(F.col("n").cast("string"))
                   .alias("value"))
    pages = (m.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("code"),
                       F.year("month").alias("yr"))
             .agg(F.collect_list(rec).alias("data"))
             .select("code", F.to_json(F.struct(F.struct("data").alias("response"))).alias("line")))
    pages.write.mode("overwrite").partitionBy("code").text(path)
    names = table(spark, d, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), "n_name")
    return S.read_coded_records(spark, path, names)


# --------------------------------------------------------------------------
# SRC6
# --------------------------------------------------------------------------


@register("read_tagged", """
SELECT c_custkey, c_name, c_acctbal, CAST(r_regionkey AS VARCHAR) AS region_code, r_name AS region_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def read_tagged_q(spark, d):
    path = scratch_path(spark, "tagged")
    c = table(spark, d, "customer")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                         F.col("n_regionkey").alias("region_code"))
    (c.join(n, "c_nationkey").select("c_custkey", "c_name", "c_acctbal", "region_code")
     .write.mode("overwrite").option("header", True).partitionBy("region_code").csv(path))
    # the region dimension is fixed-size (5 rows); its codes name the sources
    regions = {str(r.r_regionkey): r.r_name for r in table(spark, d, "region").collect()}
    sources = {k: f"{path}/region_code={k}" for k in regions}
    return S.read_tagged(
        spark, sources, regions,
        reader=lambda s, p: S.read_delimited(s, p, types={"c_custkey": "bigint", "c_acctbal": "double"},
                                             dropna=False),
        code_col="region_code", name_col="region_name")


# --------------------------------------------------------------------------
# SRC7
# --------------------------------------------------------------------------


def _xml_text(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


_PART_LAT = "-35.0 + (p_partkey * 7 % 1000) / 100.0::DOUBLE"
_PART_LON = "115.0 + (p_partkey * 11 % 3000) / 100.0::DOUBLE"


@register("read_xml", f"""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS brand,
       CASE WHEN p_size = 1 THEN NULL ELSE p_retailprice END AS price,
       {_PART_LAT} AS latitude, {_PART_LON} AS longitude
FROM part
""")
def read_xml_q(spark, d):
    path = scratch_path(spark, "xml")
    p = table(spark, d, "part")
    lat = F.lit(-35.0) + (F.col("p_partkey") * 7 % 1000) / 100.0
    lon = F.lit(115.0) + (F.col("p_partkey") * 11 % 3000) / 100.0
    price = F.when(F.col("p_size") == 1, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    item = F.concat(F.lit("<item><id>"), F.col("p_partkey").cast("string"), F.lit("</id><title>"),
                    _xml_text(F.col("p_name")), F.lit("</title><brand>"), _xml_text(F.col("p_brand")),
                    F.lit("</brand><x:price>"), price, F.lit("</x:price><latitude>"),
                    lat.cast("string"), F.lit("</latitude><longitude>"), lon.cast("string"),
                    F.lit("</longitude></item>"))
    docs = (p.groupBy(F.expr("p_partkey div 1000").alias("page"))
            .agg(F.concat(F.lit('<rss xmlns:x="http://example.com/x"><channel>\n'),
                          F.array_join(F.collect_list(item), "\n"),
                          F.lit("\n</channel></rss>")).alias("line")))
    # one XML document per file: a second root element in a file is invalid
    docs.write.mode("overwrite").partitionBy("page").text(path)
    fields = ["id", "title", "brand", "x:price", "latitude", "longitude"]
    return S.read_xml_items(spark, path, schema=", ".join(f"`{c}` STRING" for c in fields)).drop("page")


# --------------------------------------------------------------------------
# SRC8
# --------------------------------------------------------------------------


@register("features_flatten", """
SELECT s_acctbal AS acctbal, s_name AS name, CAST(s_nationkey AS BIGINT) AS nationkey,
       CASE WHEN s_nationkey < 5 THEN NULL
            ELSE 112.0 + (s_suppkey * 37 % 4200) / 100.0::DOUBLE END AS longitude,
       CASE WHEN s_nationkey < 5 THEN NULL
            ELSE -44.0 + (s_suppkey * 53 % 3400) / 100.0::DOUBLE END AS latitude
FROM supplier
""")
def features_flatten(spark, d):
    path = scratch_path(spark, "geojson")
    _feature_pages(spark, d).select("line").write.mode("overwrite").text(path)
    return S.flatten_features(spark, path, multiline=False, properties="acctbal DOUBLE, name STRING, nationkey BIGINT")


@register("features_flatten_text", """
SELECT s_acctbal AS acctbal, s_name AS name, CAST(s_nationkey AS BIGINT) AS nationkey,
       CASE WHEN s_nationkey < 5 THEN NULL
            ELSE 112.0 + (s_suppkey * 37 % 4200) / 100.0::DOUBLE END AS longitude,
       CASE WHEN s_nationkey < 5 THEN NULL
            ELSE -44.0 + (s_suppkey * 53 % 3400) / 100.0::DOUBLE END AS latitude
FROM supplier
""")
def features_flatten_text(spark, d):
    """The same feature pages held as a text column (no files): flattened
    with variant parsing and a merged property schema."""
    return S.flatten_feature_text(_feature_pages(spark, d), "line")


def _feature_pages(spark, d):
    """Supplier points as GeoJSON FeatureCollection text, one page per
    (nation, 100 suppliers): Point, MultiPoint or no geometry by nation."""
    s = geo_queries.supplier_points(spark, d).join(
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey"), "id")
    props = F.to_json(F.struct(F.col("name"), F.col("acctbal"), F.col("s_nationkey").alias("nationkey")))
    lon, lat = F.col("longitude"), F.col("latitude")
    multi = F.to_json(F.struct(F.lit("MultiPoint").alias("type"),
                               F.array(F.array(lon, lat), F.array(lon + 1, lat + 1)).alias("coordinates")))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    geom = (F.when(F.col("s_nationkey") < 5, F.lit(""))
            .when(F.col("s_nationkey") < 12, F.concat(F.lit(',"geometry":'), multi))
            .otherwise(F.concat(F.lit(',"geometry":'), point)))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), props, geom, F.lit("}"))
    return (s.groupBy("s_nationkey", F.expr("id div 100").alias("page"))
            .agg(F.concat(F.lit('{"type":"FeatureCollection","features":['),
                          F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("line")))


# --------------------------------------------------------------------------
# SRC11 / SRC12 / SNK1 / SNK2 / QA1
# --------------------------------------------------------------------------


@register("read_first", "SELECT * FROM customer")
def read_first_q(spark, d):
    missing = scratch_path(spark, "never-written")
    return S.read_first([
        lambda: spark.read.parquet(missing),
        lambda: table(spark, d, "orders").filter(F.col("o_totalprice") < 0),
        lambda: table(spark, d, "customer"),
        lambda: table(spark, d, "supplier"),
    ])


def _scratch_db(spark):
    db = f"supplylens_{uuid.uuid4().hex[:12]}"
    return Q.ensure_database(spark, db, scratch_path(spark, "db"))


_MONTHLY_SQL = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n_orders,
       round(sum(o_totalprice), 2) AS revenue
FROM orders GROUP BY 1
"""


def _monthly(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(truncate_to("o_orderdate", "MONTH").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@register("save_count", _MONTHLY_SQL)
def save_count(spark, d):
    db = _scratch_db(spark)
    Q.save(_monthly(spark, d), f"{db}.order_months")
    return spark.table(f"{db}.order_months")


@register("list_tables", """
SELECT CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_tables FROM orders
""")
def list_tables_q(spark, d):
    """One table per order status is landed (a one-letter code: a few values), then the catalog is listed."""
    db = _scratch_db(spark)
    o = table(spark, d, "orders").filter(F.col("o_orderstatus").isNotNull())
    for r in o.select("o_orderstatus").distinct().collect():
        Q.save(o.filter(F.col("o_orderstatus") == r.o_orderstatus).groupBy("o_orderpriority").count(),
               f"{db}.orders_{r.o_orderstatus.lower()}")
    return S.list_tables(spark, db).agg(F.count_distinct("tableName").alias("n_tables"))


@register("verify", f"""
SELECT 'order_months' AS table_name, 'OK' AS status, (SELECT count(*) FROM ({_MONTHLY_SQL}) m) AS n_rows
UNION ALL SELECT 'no_urgent_low', 'EMPTY', 0
UNION ALL SELECT 'never_loaded', 'MISSING', NULL
""")
def verify_q(spark, d):
    db = _scratch_db(spark)
    Q.save(_monthly(spark, d), f"{db}.order_months")
    o = table(spark, d, "orders")
    Q.save(o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderpriority") == "5-LOW")),
           f"{db}.no_urgent_low")
    rep = Q.verify(spark, [f"{db}.order_months", f"{db}.no_urgent_low", f"{db}.never_loaded"])
    return rep.withColumn("table_name", F.substring_index("table_name", ".", -1))


@register("export_points", f"""
SELECT layer, count(*) AS n_points, round(sum(acctbal), 2) AS acctbal
FROM ({geo_queries._LAYERS_SQL}) l GROUP BY layer
""")
def export_points(spark, d):
    path = scratch_path(spark, "points")
    back = Q.export_points(geo_queries.layers(spark, d), path)
    return back.groupBy("layer").agg(F.count(F.lit(1)).alias("n_points"),
                                     F.round(F.sum("acctbal"), 2).alias("acctbal"))


# --------------------------------------------------------------------------
# streaming refresh of a derived table
# --------------------------------------------------------------------------


@register("stream_refresh", """
SELECT event_type, count(*) AS n_events, round(sum(value), 2) AS total_value
FROM events GROUP BY event_type
""")
def stream_refresh(spark, d):
    """Events land in two drops; an incremental refresh after each keeps a
    per-type aggregate table current without re-reading the first drop."""
    from supplylens.streaming import refresh_table

    src, sink, ckpt = (scratch_path(spark, "stream-src"), scratch_path(spark, "stream-sink"),
                       scratch_path(spark, "stream-ckpt"))
    e = table(spark, d, "events")
    mid = F.lit("2024-01-15").cast("timestamp_ntz")

    def build(stream):
        return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"),
                                                F.sum("value").alias("total_value"))

    for part in (e.filter(F.col("ts") < mid), e.filter(~F.coalesce(F.col("ts") < mid, F.lit(False)))):
        part.write.mode("append").parquet(src)
        refresh_table(spark, src, e.schema, build, sink, checkpoint=ckpt).awaitTermination()
    return spark.read.parquet(sink).withColumn("total_value", F.round("total_value", 2))


@register("features_export", f"""
WITH f AS (
  SELECT layer, to_json({{'type': 'Feature',
                         'geometry': {{'type': 'Point', 'coordinates': [longitude, latitude]}},
                         'properties': {{'acctbal': acctbal}}}})::VARCHAR AS feature
  FROM ({geo_queries._LAYERS_SQL}) l)
SELECT layer, count(*) AS n_features, CAST(sum(length(feature)) AS BIGINT) AS text_length
FROM f GROUP BY layer
""")
def features_export(spark, d):
    from supplylens.operators.geo import export_features
    path = scratch_path(spark, "geojsonl")
    export_features(geo_queries.layers(spark, d), path, partition_by=["layer"])
    back = spark.read.text(path)
    return back.groupBy("layer").agg(F.count(F.lit(1)).alias("n_features"),
                                     F.sum(F.length("value")).cast("bigint").alias("text_length"))


@register("verify_summary", f"""
SELECT CAST(1 AS BIGINT) AS ok, CAST(3 AS BIGINT) AS expected
FROM (SELECT count(*) AS n FROM ({_MONTHLY_SQL}) m) t WHERE n > 0
""")
def verify_summary(spark, d):
    db = _scratch_db(spark)
    Q.save(_monthly(spark, d), f"{db}.order_months")
    Q.save(table(spark, d, "orders").filter(F.col("o_totalprice") < 0), f"{db}.no_rows")
    rep = Q.verify(spark, [f"{db}.order_months", f"{db}.no_rows", f"{db}.never_loaded"])
    return Q.load_summary(rep)


@register("table_count", """
SELECT CAST(count(DISTINCT r_name) AS BIGINT) AS n_tables
FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
""")
def table_count(spark, d):
    """AGG8 over SRC12: one table per region is landed (its nations), then
    the catalog listing is counted by distinct table name."""
    from supplylens.operators.grid import sanitize_names
    db = _scratch_db(spark)
    nation = table(spark, d, "nation")
    region = table(spark, d, "region").join(nation.select("n_regionkey").distinct()
                                            .withColumnRenamed("n_regionkey", "r_regionkey"),
                                            "r_regionkey", "left_semi")
    # region is a fixed-size dimension: its names label the landed tables
    names = sorted(r.r_name for r in region.select("r_name").collect())
    for label, tname in zip(names, sanitize_names(names)):
        rk = region.filter(F.col("r_name") == label).select(F.col("r_regionkey").alias("n_regionkey"))
        Q.save(nation.join(rk, "n_regionkey", "left_semi"), f"{db}.nations_{tname.lower()}")
    return S.list_tables(spark, db).agg(F.count_distinct("tableName").alias("n_tables"))


def order_pages(spark, d):
    """A page per customer with orders: a table of them under a spanning header, with a table inside
    a cell of each row and a last column of which a cell spans two rows."""
    o = table(spark, d, "orders").select("o_custkey", F.struct(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus").alias("o"))
    pages = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("os"))

    def row(x, i):
        nested = F.concat(F.lit("<table><tr><td>"), x["o_orderpriority"], F.lit("<td rowspan=0>P&amp;R</td></tr><tr><td colspan=1>"),
                          x["o_orderstatus"], F.lit("</table>"))
        spanning = F.when(i % 2 == 0, F.concat(F.lit("<td rowspan='2'><b>G</b>"), (i / 2).cast("int").cast("string"), F.lit("</td>")))
        return F.concat(F.lit("<tr><td>"), x["o_orderkey"].cast("string"), F.lit("</td>\n <td> "),
                        x["o_totalprice"].cast("decimal(20,2)").cast("string"), F.lit("&nbsp;<br>AUD</td><td>"), nested,
                        F.lit("</td>"), F.coalesce(spanning, F.lit("")), F.lit("</tr>"))

    head = ("<html><!-- <table><tr><td>no</td></tr></table> --><script>var t = '<table><tr><td>';</script>"
            "<table class=x><tr><th rowspan=2>Order</th><th colspan=2>Amounts</th><th rowspan=2></th></tr><tr></tr><tr><th>Total<th>Kind</tr>")
    return pages.select(F.col("o_custkey").alias("page_id"), F.concat(
        F.lit(head), F.array_join(F.transform("os", row), ""), F.lit("</table></html>")).alias("html"))


@register("page_tables", """
WITH o AS (
  SELECT o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, * FROM orders),
slots AS (
  SELECT DISTINCT page_id, 0 AS tab, v.r AS row, v.c AS col, v.t AS value FROM o, (VALUES
    (0, 0, 'Order'), (0, 1, 'Amounts'), (0, 2, 'Amounts'), (0, 3, NULL), (1, 0, 'Order'), (1, 1, 'Total'), (1, 2, 'Kind'),
    (1, 3, NULL)) v(r, c, t)
  UNION ALL SELECT page_id, 0, i + 2, 0, CAST(o_orderkey AS VARCHAR) FROM o
  UNION ALL SELECT page_id, 0, i + 2, 1, CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR) || ' AUD' FROM o
  UNION ALL SELECT page_id, 0, i + 2, 2, NULL FROM o
  UNION ALL SELECT page_id, 0, i + 2, 3, 'G' || CAST(i // 2 AS VARCHAR) FROM o
  UNION ALL SELECT page_id, i + 1, 0, 0, o_orderpriority FROM o
  UNION ALL SELECT page_id, i + 1, 0, 1, 'P&R' FROM o
  UNION ALL SELECT page_id, i + 1, 1, 0, o_orderstatus FROM o
  UNION ALL SELECT page_id, i + 1, 1, 1, 'P&R' FROM o)
SELECT page_id, tab AS "table", row, col, value FROM slots
""")
def page_tables_q(spark, d):
    return S.page_tables(order_pages(spark, d), "html", ["page_id"])


# -- many layouts, many sources

N_LAYOUTS = 50


def _many_sql() -> str:
    totals = ", ".join(f"CASE WHEN f % 5 = {i} THEN total END AS \"Total_{i}\"" for i in range(5))
    own = ", ".join(f"CASE WHEN f = {i} THEN f::DOUBLE END AS f{i}" for i in range(N_LAYOUTS))
    return f"""
SELECT date, {totals}, n, {own}
FROM (SELECT CAST(o_custkey % {N_LAYOUTS} AS INTEGER) AS f, CAST(o_orderdate AS DATE) AS date,
             round(sum(o_totalprice), 2) AS total, count(*)::DOUBLE AS n
      FROM orders GROUP BY 1, 2) t
"""


@register("read_preamble_many", _many_sql())
def read_preamble_many(spark, d):
    """SRC2 on fifty files with a header of their own each, quoted names and values included."""
    path = scratch_path(spark, "preambles")
    f = (F.col("o_custkey") % N_LAYOUTS).cast("int")
    o = table(spark, d, "orders").groupBy(f.alias("f"), F.to_date("o_orderdate").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    data = o.select("f", F.concat(F.lit("1-"), F.col("day").cast("string")).alias("k"), F.concat(
        F.date_format("day", "dd-MMM-yyyy"), F.lit(',"'), F.col("total").cast("string"), F.lit('",'), F.col("n").cast("string"),
        F.lit(","), F.col("f").cast("string")).alias("line"))
    heads = o.select("f").distinct().select("f", F.explode(F.array(
        F.struct(F.lit("0-0").alias("k"), F.lit("ORDER TOTALS TABLE").alias("line")),
        F.struct(F.lit("0-1").alias("k"), F.lit("# one file of many").alias("line")),
        F.struct(F.lit("0-2").alias("k"), F.concat(F.lit('Series ID,"Total, '), (F.col("f") % 5).cast("string"), F.lit('",n,f'),
                                                   F.col("f").cast("string")).alias("line")))).alias("h")).select("f", "h.*")
    lines = data.unionByName(heads)
    (lines.repartition("f").sortWithinPartitions("f", "k").select("f", "line").write.mode("overwrite").partitionBy("f").text(path))
    return S.read_preamble_csv(spark, path)


@register("read_tagged_files", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, round(o_totalprice, 2) AS o_totalprice,
       CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS prio_0, CASE WHEN o_custkey % 3 = 1 THEN o_orderpriority END AS prio_1,
       CASE WHEN o_custkey % 3 = 2 THEN o_orderpriority END AS prio_2,
       CAST(o_custkey % 30 AS VARCHAR) AS code, 'Site ' || CAST(o_custkey % 30 AS VARCHAR) AS site
FROM orders
""")
def read_tagged_files_q(spark, d):
    """SRC6: thirty sources with three different headers, read in one scan."""
    path = scratch_path(spark, "sites")
    o = table(spark, d, "orders").withColumn("code", (F.col("o_custkey") % 30).cast("int"))
    for i in range(3):
        (o.filter(F.col("o_custkey") % 3 == i).select("code", F.round("o_totalprice", 2).alias("o_totalprice"),
                                                      F.col("o_orderpriority").alias(f"prio {i}"), "o_orderkey")
         .hint("rebalance", "code").write.mode("append").option("header", True).partitionBy("code").csv(path))
    sources = {str(c): f"{path}/code={c}" for c in range(30)}
    found = {r["code"] for r in o.select("code").distinct().collect()}  # thirty at most
    sources = {k: p for k, p in sources.items() if int(k) in found}
    return S.read_tagged_files(spark, sources, {k: f"Site {k}" for k in sources}, types={"o_orderkey": "bigint", "o_totalprice": "double"},
                               code_col="code", name_col="site")
