"""Point data for maps (GEO1-GEO7).

Points are two double columns (longitude, latitude).  Tile assignment
replaces a per-request spatial index lookup: every point is expanded to its
tile at each zoom level with ``explode(sequence(zmin, zmax))`` and integer
maths, so a whole layer is tiled in one distributed pass.  Per-tile results
are aggregates (count, bounds): ``tile_summary`` groups points by their
deepest tile first and rolls those partial results up the zoom pyramid by
bit shifts, so a low-zoom tile holding most points costs one row per deep
tile, and no feature list is ever collected into a single group.

The tile store holds each point once, sorted by the interleaved bits of its
deepest tile's x and y.  A tile of any zoom, and a box up to a few pieces, is then a range
of keys, which the scan skips to by the files' statistics.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.columns import (
    MERCATOR_MAX_LAT, col_of, mercator_x, mercator_y, to_double, valid_coordinate,
)

# MVT tile extent, and per-layer zoom limits of the map
# (point layers 0-16, the station price layer 4-16).
TILE_EXTENT = 4096
DEFAULT_ZOOM = (0, 16)


def points(df: DataFrame, col_map: Mapping[str, str | Sequence[str]],
           limits: Mapping[str, int] | None = None, lat: str = "latitude",
           lon: str = "longitude", keep: Sequence[str] = ()) -> DataFrame:
    """GEO1: rows with a valid coordinate, columns mapped and cut to length.

    A mapped source may list candidates (``["name", "Name", "DEPOSIT_NAME"]``);
    the first one present in the DataFrame is used, else the value is ``''``.
    """
    limits = limits or {}
    present = {c.lower(): c for c in df.columns}
    out = []
    for target, sources in col_map.items():
        cands = [sources] if isinstance(sources, str) else list(sources)
        src = next((present[c.lower()] for c in cands if c.lower() in present), None)
        c = F.col(src).cast("string") if src else F.lit("")
        if target in limits:
            c = F.substring(c, 1, limits[target])
        out.append(c.alias(target))
    return (df.filter(valid_coordinate(lat, lon))
            .select(*keep, *out, to_double(lon).alias("longitude"), to_double(lat).alias("latitude")))


def to_mercator(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """GEO2: web-mercator metres ``merc_x``, ``merc_y``."""
    return df.withColumns({"merc_x": mercator_x(lon), "merc_y": mercator_y(lat)})


def _frac_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def _frac_y(lat: Column) -> Column:
    return (F.lit(1.0) - F.ln(F.tan((lat + 90.0) * F.lit(math.pi) / 360.0)) / F.lit(math.pi)) / 2.0


def tiles(df: DataFrame, zmin: int = 0, zmax: int = 16, layer: str | None = None,
          zoom_limits: Mapping[str, tuple[int, int]] | None = None,
          lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """GEO3: one row per point and zoom with its tile ``z, x, y``.

    ``zoom_limits`` narrows the zoom range per layer value.  Tiles are
    half-open, so every point lands in exactly one tile per zoom; a point
    beyond the projection's latitude limit lies in none.
    """
    df = df.filter(F.col(lat).between(-MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    lo, hi = F.lit(zmin), F.lit(zmax)
    if layer and zoom_limits:
        lim = F.create_map(*[x for k, (a, b) in zoom_limits.items()
                             for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
        lim_row = lim[F.col(layer)]
        lo = F.greatest(lo, F.coalesce(lim_row[0], lo))
        hi = F.least(hi, F.coalesce(lim_row[1], hi))
    zooms = F.when(lo <= hi, F.sequence(lo, hi))
    out = df.withColumn("z", F.explode(zooms))
    n = F.pow(F.lit(2.0), F.col("z"))
    fx = _frac_x(F.col(lon)) * n
    fy = _frac_y(F.col(lat)) * n
    maxi = n - 1
    return (out.withColumn("_fx", fx).withColumn("_fy", fy)
            .withColumn("x", F.least(F.greatest(F.floor("_fx"), F.lit(0)), maxi.cast("bigint")))
            .withColumn("y", F.least(F.greatest(F.floor("_fy"), F.lit(0)), maxi.cast("bigint")))
            .withColumn("z", F.col("z").cast("int")))


def tile_coords(df: DataFrame, extent: int = TILE_EXTENT) -> DataFrame:
    """GEO4: integer position inside the tile on a 0..extent grid, y down.

    Expects the output of :func:`tiles` (keeps its fractional positions).
    """
    px = F.floor((F.col("_fx") - F.col("x")) * extent)
    py = F.floor((F.col("_fy") - F.col("y")) * extent)
    return (df.withColumn("px", F.least(F.greatest(px, F.lit(0)), F.lit(extent - 1)))
            .withColumn("py", F.least(F.greatest(py, F.lit(0)), F.lit(extent - 1)))
            .drop("_fx", "_fy"))


def tile_features(df: DataFrame, layer: str = "layer", measures: Sequence[str] = ()) -> DataFrame:
    """GEO5: per layer and tile, the feature count and extent (plus sums)."""
    aggs = [F.count(F.lit(1)).alias("n_features"),
            F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
            F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat")]
    aggs += [F.round(F.sum(m), 2).alias(f"sum_{m}") for m in measures]
    return df.groupBy(layer, "z", "x", "y").agg(*aggs)


def tile_summary(df: DataFrame, zmin: int = 0, zmax: int = 16, layer: str = "layer",
                 zoom_limits: Mapping[str, tuple[int, int]] | None = None,
                 measures: Sequence[str] = (), lon: str = "longitude",
                 lat: str = "latitude") -> DataFrame:
    """GEO5 from points, aggregated before it is expanded over zooms.

    Points are first grouped by their tile at the deepest zoom (one pass,
    partial aggregation).  A tile at zoom ``z`` is that tile shifted right
    by ``zmax - z`` (scaling by a power of two is exact in floating point,
    so this equals tiling at ``z`` directly).  Only the per-tile partial
    results are exploded over zoom levels and rolled up, so a dense layer
    costs one row per occupied deep tile instead of one row per point per
    zoom.
    """
    n = F.pow(F.lit(2.0), F.lit(zmax))
    maxi = (n - 1).cast("bigint")
    deep = df.filter(F.col(lat).between(-MERCATOR_MAX_LAT, MERCATOR_MAX_LAT)).select(
        F.col(layer),
        F.least(F.greatest(F.floor(_frac_x(F.col(lon)) * n), F.lit(0)), maxi).alias("xd"),
        F.least(F.greatest(F.floor(_frac_y(F.col(lat)) * n), F.lit(0)), maxi).alias("yd"),
        lon, lat, *measures)
    part = deep.groupBy(layer, "xd", "yd").agg(
        F.count(F.lit(1)).alias("n"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"),
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
        *[F.sum(m).alias(f"s_{m}") for m in measures])
    lo, hi = F.lit(zmin), F.lit(zmax)
    if zoom_limits:
        lim = F.create_map(*[x for k, (a, b) in zoom_limits.items()
                             for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])[F.col(layer)]
        lo = F.greatest(lo, F.coalesce(lim[0], lo))
        hi = F.least(hi, F.coalesce(lim[1], hi))
    z = part.withColumn("z", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    z = z.withColumns({"x": F.expr(f"shiftright(xd, {int(zmax)} - z)"),
                       "y": F.expr(f"shiftright(yd, {int(zmax)} - z)"),
                       "z": F.col("z").cast("int")})
    return z.groupBy(layer, "z", "x", "y").agg(
        F.sum("n").alias("n_features"), F.min("min_lon").alias("min_lon"),
        F.max("max_lon").alias("max_lon"), F.min("min_lat").alias("min_lat"),
        F.max("max_lat").alias("max_lat"),
        *[F.round(F.sum(f"s_{m}"), 2).alias(f"sum_{m}") for m in measures])


def in_bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float,
            x: str = "longitude", y: str = "latitude") -> DataFrame:
    """GEO6: inclusive bounding-box filter (pushed to the scan on stored columns)."""
    return df.filter(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


_PRIMITIVE = (T.StringType, T.NumericType, T.BooleanType)


def to_features(df: DataFrame, props: Sequence[str] | None = None, lon: str = "longitude",
                lat: str = "latitude", drop: Sequence[str] = ("latitude", "longitude", "lat",
                                                              "lon", "geom", "id"),
                keep: Sequence[str] = ()) -> DataFrame:
    """GEO7: one GeoJSON Feature (JSON text) per row with a valid point.

    Properties are all columns except coordinates/geometry/id (and ``keep``)
    unless given; non-primitive values are rendered as text.  ``keep``
    columns are passed through next to ``feature``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(props) if props is not None else \
        [c for c in df.columns if c not in drop and c not in keep]
    prop_cols = []
    for c in names:
        v = F.col(c)
        if not isinstance(types[c], _PRIMITIVE):
            v = (F.to_json(v) if isinstance(types[c], (T.ArrayType, T.MapType, T.StructType))
                 else v.cast("string"))
        prop_cols.append(v.alias(c))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(col_of(lon).cast("double"), col_of(lat).cast("double")).alias("coordinates"))
        .alias("geometry"),
        F.struct(*prop_cols).alias("properties"))
    return df.filter(col_of(lat).isNotNull() & col_of(lon).isNotNull()).select(
        *keep, F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))



def tile_bounds(z: Column, x: Column, y: Column) -> list[Column]:
    """The envelope of a tile in degrees: min_lon, min_lat, max_lon, max_lat."""
    n = F.pow(F.lit(2.0), z)

    def lat(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - 2 * row / n))))
    return [(x / n * 360.0 - 180.0).alias("min_lon"), lat(y + 1).alias("min_lat"),
            ((x + 1) / n * 360.0 - 180.0).alias("max_lon"), lat(y).alias("max_lat")]


def tile_lookup(df: DataFrame, z: int, x: int, y: int, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """The points of one tile: its envelope as literal bounds, half-open as in :func:`tiles`
    (pushed to the scan on stored columns)."""
    n = 2.0 ** z
    north, south = (math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + i) / n)))) for i in (0, 1))
    return df.filter((F.col(lon) >= x / n * 360.0 - 180.0) & (F.col(lon) < (x + 1) / n * 360.0 - 180.0)
                     & (F.col(lat) <= north) & (F.col(lat) > south))


def export_features(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """GEO7 sink: one GeoJSON Feature per line (newline-delimited GeoJSON),
    written in parallel; ``partition_by`` columns become folders."""
    out = to_features(df, keep=partition_by)
    if partition_by:
        out = out.hint("rebalance", *partition_by)  # files by size, not one per task and folder
    out.write.mode("overwrite").partitionBy(*partition_by).text(path)


def export_tiles(df: DataFrame, path: str, zmin: int = 0, zmax: int = 16, layer: str = "layer",
                 zoom_limits: Mapping[str, tuple[int, int]] | None = None,
                 extent: int = TILE_EXTENT) -> None:
    """GEO3-5 sink: the precomputed tile store that replaces a per-process
    tile cache.  Every point is written once per zoom with its tile and
    tile-local position, partitioned by layer and zoom (``layer=.../z=...``)
    and clustered by tile, so serving a tile reads one folder and, by the
    statistics of ``x, y``, a few row groups of it."""
    t = tile_coords(tiles(df, zmin, zmax, layer=layer, zoom_limits=zoom_limits), extent)
    order = [layer, "z", "x", "y"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    t.write.mode("overwrite").partitionBy(layer, "z").parquet(path)


# --------------------------------------------------------------------------
# tile store by interleaved key
# --------------------------------------------------------------------------

KEY = "tile_key"
#: (shift, mask) that spread 16 bits to the even places of 32, from the widest step on.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(c: Column) -> Column:
    for shift, mask in _SPREAD:
        c = (c.bitwiseOR(F.shiftleft(c, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return c


def _gather(c: Column) -> Column:
    c = c.bitwiseAND(F.lit(_SPREAD[-1][1]).cast("long"))
    for (shift, _), mask in zip(reversed(_SPREAD), [m for _, m in reversed(_SPREAD[:-1])] + [0x0000FFFF], strict=True):
        c = (c.bitwiseOR(F.shiftright(c, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return c


def interleaved(x: int, y: int) -> int:
    """The key of a tile from its numbers: bits of y above bits of x."""
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(max(x.bit_length(), y.bit_length(), 1)))


def tile_key(lon: str = "longitude", lat: str = "latitude", depth: int = DEFAULT_ZOOM[1]) -> Column:
    """The key of a point's tile at zoom ``depth`` (16 at most); beyond the projection's limit that of the border tile."""
    n = 1 << depth
    inside = F.greatest(F.least(F.col(lat), F.lit(MERCATOR_MAX_LAT)), F.lit(-MERCATOR_MAX_LAT))

    def cell(fraction: Column) -> Column:
        return F.least(F.greatest(F.floor(fraction * float(n)), F.lit(0)), F.lit(n - 1)).cast("long")

    x, y = cell(_frac_x(F.col(lon))), cell(_frac_y(inside))
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def write_tile_store(df: DataFrame, path: str, layer: str = "layer", depth: int = DEFAULT_ZOOM[1],
                     row_group: int = 8 << 20) -> None:
    """GEO3/GEO4 sink: every point once, partitioned by layer and sorted by :func:`tile_key`.

    Range partitions cut a hot layer at its keys; small row groups with key
    statistics let a lookup read a few of them.  Points beyond the
    projection's limit are stored (a box can hold them), though no tile has them.
    """
    keyed = df.withColumn(KEY, tile_key(depth=depth))
    order = [layer, KEY, "longitude", "latitude"]
    (keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", row_group)
     .partitionBy(layer).parquet(path))


def tile_range_lookup(store: DataFrame, z: int, x: int, y: int, depth: int = DEFAULT_ZOOM[1]) -> DataFrame:
    """GEO3 lookup: the points of tile z/x/y as one range of keys, which is pushed to the scan."""
    if not 0 <= z <= depth or not (0 <= x < 1 << z and 0 <= y < 1 << z):
        return store.filter(F.lit(False))
    first = interleaved(x, y) << 2 * (depth - z)
    return store.filter(F.col(KEY).between(first, first + (1 << 2 * (depth - z)) - 1)
                        & F.col("latitude").between(-MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))


def tiles_from_store(store: DataFrame, zmin: int = 0, zmax: int = DEFAULT_ZOOM[1], depth: int = DEFAULT_ZOOM[1],
                     layer: str = "layer", zoom_limits: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """GEO3 from stored keys: a row per point and zoom with its tile, by shifts alone."""
    lo, hi = F.lit(zmin), F.lit(zmax)
    for name, (a, b) in (zoom_limits or {}).items():
        lo = F.when(F.col(layer) == name, F.lit(max(a, zmin))).otherwise(lo)
        hi = F.when(F.col(layer) == name, F.lit(min(b, zmax))).otherwise(hi)
    at = store.filter(F.col("latitude").between(-MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    at = at.withColumns({"_xd": _gather(F.col(KEY)), "_yd": _gather(F.shiftright(F.col(KEY), 1))})
    out = at.withColumn("z", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    return out.withColumns({"x": F.expr(f"shiftright(_xd, {int(depth)} - z)"),
                            "y": F.expr(f"shiftright(_yd, {int(depth)} - z)")}).drop("_xd", "_yd")


def box_ranges(xmin: float, ymin: float, xmax: float, ymax: float, depth: int = DEFAULT_ZOOM[1],
               most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys (first, last) that hold every point of the box, and little else.

    Squares that straddle the border are quartered, the largest first, while
    the ranges stay within ``most``; neighbouring ranges are joined.
    """
    if xmin > xmax or ymin > ymax:
        return []
    n = 1 << depth

    def cell(fraction: float) -> int:
        return min(max(math.floor(fraction * n), 0), n - 1)

    def row(lat: float) -> float:
        inside = min(max(lat, -MERCATOR_MAX_LAT), MERCATOR_MAX_LAT)
        return (1 - math.log(math.tan((inside + 90) * math.pi / 360)) / math.pi) / 2

    # one cell to spare on every side: the engine's logarithm may differ in the last digit
    left, right = max(cell((xmin + 180) / 360) - 1, 0), min(cell((xmax + 180) / 360) + 1, n - 1)
    top, bottom = max(cell(row(ymax)) - 1, 0), min(cell(row(ymin)) + 1, n - 1)
    whole, border = [], [(0, 0, 0)]  # (zoom, x, y)
    while border and len(whole) + len(border) + 3 <= most:
        z, x, y = border.pop(0)  # zooms ascend
        for cx, cy in ((2 * x, 2 * y), (2 * x + 1, 2 * y), (2 * x, 2 * y + 1), (2 * x + 1, 2 * y + 1)):
            side = depth - z - 1
            a, b, c, d = cx << side, ((cx + 1) << side) - 1, cy << side, ((cy + 1) << side) - 1
            if b < left or a > right or d < top or c > bottom:
                continue
            inside = (a >= left and b <= right and c >= top and d <= bottom) or side == 0
            (whole if inside else border).append((z + 1, cx, cy))
    ranges = sorted((interleaved(x, y) << 2 * (depth - z), ((interleaved(x, y) + 1) << 2 * (depth - z)) - 1)
                    for z, x, y in whole + border)
    joined: list[tuple[int, int]] = []
    for first, last in ranges:
        if joined and joined[-1][1] + 1 == first:
            joined[-1] = (joined[-1][0], last)
        else:
            joined.append((first, last))
    return joined


def bbox_ranges(store: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, depth: int = DEFAULT_ZOOM[1],
                most: int = 64) -> DataFrame:
    """GEO6 on the tile store: key ranges for the scan, then the exact inclusive box."""
    hit = F.lit(False)
    for first, last in box_ranges(xmin, ymin, xmax, ymax, depth, most):
        hit = hit | F.col(KEY).between(first, last)
    return in_bbox(store.filter(hit), xmin, ymin, xmax, ymax)
