"""Registered queries for point cleaning, projection, tiling and GeoJSON
export.  The driver tables hold no coordinates, so both engines derive them
from keys: lon = 112 + (key*37 mod 4200)/100, lat = -44 + (key*53 mod 3400)/100;
some customers lie at 86 and at the poles, beyond the projection's limit.
Coordinates that are no numbers occur in the ``points`` query alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from supplylens.operators import geo as G
from supplylens.operators import relational as R
from supplylens.plans.registry import register, table

ZOOM_LIMITS = {"customers": (0, 16), "suppliers": (4, 16)}


def _lon(k):
    return F.lit(112.0) + (F.col(k) * 37 % 4200) / 100.0


def _lat(k):
    return F.lit(-44.0) + (F.col(k) * 53 % 3400) / 100.0


# Customers whose number these divide lie beyond the projection's limit.
_FAR = ((97, 86.0), (89, 90.0), (83, -90.0))


def _customer_lat():
    out = _lat("c_custkey")
    for n, lat in _FAR:
        out = F.when(F.col("c_custkey") % n == 0, F.lit(lat)).otherwise(out)
    return out


def customer_sites(spark, d, junk=False):
    """Raw customer 'sites': latitude as text, with ``junk`` no number for negative balances."""
    c = table(spark, d, "customer")
    lat_text = _customer_lat().cast("string")
    if junk:
        lat_text = (F.when(F.col("c_acctbal") < -500, F.lit("NaN"))
                    .when(F.col("c_acctbal") < 0, F.lit("x")).otherwise(lat_text))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("Name"),
                    F.col("c_mktsegment").alias("COMMODITY"), F.col("c_acctbal").alias("acctbal"),
                    lat_text.alias("latitude"), _lon("c_custkey").alias("longitude"))


def customer_points(spark, d, junk=False):
    return G.points(customer_sites(spark, d, junk),
                    {"name": ["name", "Name", "DEPOSIT_NAME"],
                     "commodity": ["commodity", "Commodity", "COMMODITY"],
                     "state": ["state", "State", "STATE"]},
                    limits={"name": 300, "commodity": 200, "state": 50}, keep=["id", "acctbal"])


def supplier_points(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                    F.col("s_acctbal").alias("acctbal"),
                    _lon("s_suppkey").alias("longitude"), _lat("s_suppkey").alias("latitude"))


def layers(spark, d):
    c = customer_points(spark, d).select("id", "acctbal", "longitude", "latitude")
    s = supplier_points(spark, d).select("id", "acctbal", "longitude", "latitude")
    return R.union_all(R.tag(c, "layer", "customers"), R.tag(s, "layer", "suppliers"))


_CUST_SQL = """
SELECT c_custkey AS id, c_name, c_mktsegment, c_acctbal AS acctbal,
       112.0 + (c_custkey * 37 % 4200) / 100.0::DOUBLE AS longitude,
       CASE WHEN c_custkey % 83 = 0 THEN -90.0 WHEN c_custkey % 89 = 0 THEN 90.0 WHEN c_custkey % 97 = 0 THEN 86.0
            ELSE -44.0 + (c_custkey * 53 % 3400) / 100.0::DOUBLE END::DOUBLE AS latitude
FROM customer
"""
_SUPP_SQL = """
SELECT s_suppkey AS id, s_acctbal AS acctbal,
       112.0 + (s_suppkey * 37 % 4200) / 100.0::DOUBLE AS longitude,
       -44.0 + (s_suppkey * 53 % 3400) / 100.0::DOUBLE AS latitude
FROM supplier
"""
_LAYERS_SQL = f"""
SELECT id, acctbal, longitude, latitude, 'customers' AS layer FROM ({_CUST_SQL}) c
UNION ALL
SELECT id, acctbal, longitude, latitude, 'suppliers' AS layer FROM ({_SUPP_SQL}) s
"""
_FX = "(longitude + 180.0) / 360.0 * pow(2.0, z)"
_FY = "(1.0 - ln(tan((latitude + 90.0) * pi() / 360.0)) / pi()) / 2.0 * pow(2.0, z)"
_IN_LIMIT = "abs(latitude) <= 85.0511"
_TILES_SQL = f"""
WITH pts AS ({_LAYERS_SQL}),
zz AS (SELECT pts.*, CAST(r.z AS INTEGER) AS z FROM pts, range(0, 17) r(z)
       WHERE r.z >= CASE layer WHEN 'suppliers' THEN 4 ELSE 0 END AND {_IN_LIMIT}),
t AS (SELECT zz.*, {_FX} AS fx, {_FY} AS fy FROM zz)
SELECT t.*, CAST(least(greatest(floor(fx), 0), pow(2.0, z) - 1) AS BIGINT) AS x,
       CAST(least(greatest(floor(fy), 0), pow(2.0, z) - 1) AS BIGINT) AS y
FROM t
"""


def _tiles(spark, d):
    return G.tiles(layers(spark, d), 0, 16, layer="layer", zoom_limits=ZOOM_LIMITS)


@register("points", f"""
SELECT id, acctbal, substring(c_name, 1, 300) AS name, substring(c_mktsegment, 1, 200) AS commodity,
       '' AS state, longitude, latitude
FROM ({_CUST_SQL}) c WHERE acctbal >= 0
""")
def points_q(spark, d):
    return customer_points(spark, d, junk=True)


@register("mercator", f"""
SELECT id, round(longitude * 20037508.34 / 180.0, 3) AS merc_x,
       CASE WHEN {_IN_LIMIT} THEN round(ln(tan((90.0 + latitude) * pi() / 360.0)) / pi() * 20037508.34, 3) END AS merc_y
FROM ({_CUST_SQL}) c
""")
def mercator_q(spark, d):
    m = G.to_mercator(customer_points(spark, d))
    return m.select("id", F.round("merc_x", 3).alias("merc_x"), F.round("merc_y", 3).alias("merc_y"))


@register("tiles", f"SELECT layer, id, z, x, y FROM ({_TILES_SQL}) q")
def tiles_q(spark, d):
    return _tiles(spark, d).select("layer", "id", "z", "x", "y")


@register("tile_coords", f"""
SELECT layer, id, z, x, y,
       CAST(least(greatest(floor((fx - x) * 4096), 0), 4095) AS BIGINT) AS px,
       CAST(least(greatest(floor((fy - y) * 4096), 0), 4095) AS BIGINT) AS py
FROM ({_TILES_SQL}) q
""")
def tile_coords_q(spark, d):
    return G.tile_coords(_tiles(spark, d)).select("layer", "id", "z", "x", "y", "px", "py")


@register("tile_features", f"""
SELECT layer, z, x, y, count(*) AS n_features, min(longitude) AS min_lon, max(longitude) AS max_lon,
       min(latitude) AS min_lat, max(latitude) AS max_lat, round(sum(acctbal), 2) AS sum_acctbal
FROM ({_TILES_SQL}) q GROUP BY layer, z, x, y
""")
def tile_features_q(spark, d):
    return G.tile_summary(layers(spark, d), 0, 16, zoom_limits=ZOOM_LIMITS, measures=["acctbal"])


@register("in_bbox", f"""
SELECT id, longitude, latitude FROM ({_CUST_SQL}) c
WHERE longitude BETWEEN 130.0 AND 150.0 AND latitude BETWEEN -35.0 AND -20.0
""")
def in_bbox_q(spark, d):
    return G.in_bbox(customer_points(spark, d), 130.0, -35.0, 150.0, -20.0).select(
        "id", "longitude", "latitude")


@register("features", f"""
SELECT to_json({{'type': 'Feature',
                'geometry': {{'type': 'Point', 'coordinates': [longitude, latitude]}},
                'properties': {{'acctbal': acctbal, 'name': substring(c_name, 1, 300),
                                'commodity': substring(c_mktsegment, 1, 200), 'state': ''}}}})::VARCHAR AS feature
FROM ({_CUST_SQL}) c
""")
def features_q(spark, d):
    return G.to_features(customer_points(spark, d))


@register("tiles_export", f"""
SELECT layer, z, count(*) AS n_points, count(DISTINCT (x, y)) AS n_tiles,
       CAST(sum(px + py) AS BIGINT) AS px_py_sum
FROM (SELECT *, CAST(least(greatest(floor((fx - x) * 4096), 0), 4095) AS BIGINT) AS px,
             CAST(least(greatest(floor((fy - y) * 4096), 0), 4095) AS BIGINT) AS py
      FROM ({_TILES_SQL}) q) t
GROUP BY layer, z
""")
def tiles_export(spark, d):
    """Write the tile store for zooms 0-16 and read it back per folder."""
    from supplylens.session import scratch_path
    path = scratch_path(spark, "tiles")
    G.export_tiles(layers(spark, d), path, 0, 16, zoom_limits=ZOOM_LIMITS)
    back = spark.read.parquet(path)
    return back.groupBy("layer", "z").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_distinct(F.struct("x", "y")).alias("n_tiles"),
        F.sum(F.col("px") + F.col("py")).cast("bigint").alias("px_py_sum"))


@register("tile_bounds", f"""
SELECT DISTINCT z, x, y, round(x / pow(2.0, z) * 360.0 - 180.0, 6) AS min_lon,
       round(degrees(atan(sinh(pi() * (1.0 - 2.0 * (y + 1) / pow(2.0, z))))), 6) AS min_lat,
       round((x + 1) / pow(2.0, z) * 360.0 - 180.0, 6) AS max_lon,
       round(degrees(atan(sinh(pi() * (1.0 - 2.0 * y / pow(2.0, z))))), 6) AS max_lat
FROM ({_TILES_SQL}) q
""")
def tile_bounds_q(spark, d):
    """The envelope of every occupied tile."""
    t = _tiles(spark, d).select("z", "x", "y").distinct()
    bounds = zip(("min_lon", "min_lat", "max_lon", "max_lat"), G.tile_bounds(F.col("z"), F.col("x"), F.col("y")))
    return t.select("z", "x", "y", *[F.round(c, 6).alias(n) for n, c in bounds])


@register("tile_lookup", f"""
SELECT layer, id, longitude, latitude FROM ({_TILES_SQL}) q WHERE z = 4 AND x = 13 AND y = 9
""")
def tile_lookup_q(spark, d):
    """The features of tile 4/13/9 by its envelope; the SQL takes them by tile number."""
    limits = {k for k, (a, b) in ZOOM_LIMITS.items() if not a <= 4 <= b}
    pts = layers(spark, d).filter(~F.col("layer").isin(list(limits)))
    return G.tile_lookup(pts, 4, 13, 9).select("layer", "id", "longitude", "latitude")


def _store(spark, d):
    """The points of all layers, written once as a tile store and read back."""
    from supplylens.session import scratch_path
    path = scratch_path(spark, "tile-store")
    G.write_tile_store(layers(spark, d), path)
    return spark.read.parquet(path)


@register("tile_store", f"SELECT layer, id, z, x, y FROM ({_TILES_SQL}) q")
def tile_store(spark, d):
    """GEO3 for zooms 0-16 from a store that holds each point once."""
    return G.tiles_from_store(_store(spark, d), zoom_limits=ZOOM_LIMITS).select("layer", "id", "z", "x", "y")


# The tiles of zooms 0-16 around a point of the data's area.
_PATH = [(z, int(324.5 / 360 * 2 ** z), int(0.5765 * 2 ** z)) for z in range(17)]


@register("tile_range_lookup", f"""
SELECT layer, id, z, x, y FROM ({_TILES_SQL}) q
WHERE x = CAST(floor(324.5 / 360 * pow(2, z)) AS BIGINT) AND y = CAST(floor(0.5765 * pow(2, z)) AS BIGINT)
""")
def tile_range_lookup_q(spark, d):
    """One tile of each zoom by its key range in the store."""
    store = _store(spark, d)
    out = None
    for z, x, y in _PATH:
        layers_at = [k for k, (a, b) in ZOOM_LIMITS.items() if a <= z <= b]
        part = G.tile_range_lookup(store.filter(F.col("layer").isin(layers_at)), z, x, y).select(
            "layer", "id", F.lit(z).alias("z"), F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


@register("bbox_ranges", f"""
SELECT layer, id, longitude, latitude FROM ({_LAYERS_SQL}) p
WHERE longitude BETWEEN 130.0 AND 150.0 AND (latitude BETWEEN -35.0 AND -20.0 OR latitude BETWEEN 85.5 AND 90.0)
""")
def bbox_ranges_q(spark, d):
    """Two boxes, one of them beyond the projection's limit, as key ranges of the store."""
    store = _store(spark, d)
    boxes = [(130.0, -35.0, 150.0, -20.0), (130.0, 85.5, 150.0, 90.0)]
    a, b = (G.bbox_ranges(store, *box).select("layer", "id", "longitude", "latitude") for box in boxes)
    return a.unionByName(b)
