"""Queries over coordinates, boundaries and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mercator as m
from ..operators import geofence, tiles
from .registry import query
from .views import BOXES, COARSE, GRID, POIS, PTS, boxes, edges, edges_sql, pois, pts, table

PI = "3.141592653589793::DOUBLE"


def _x(lng: str, zoom: int = 21) -> str:
    return f"(({lng} + 180.0::DOUBLE) / 360.0::DOUBLE * {2**zoom}::DOUBLE)"


def _y(lat: str, zoom: int = 21) -> str:
    return f"((1.0::DOUBLE - asinh(tan(radians({lat}))) / {PI}) / 2.0::DOUBLE * {2**zoom}::DOUBLE)"


def _lat(y: str, zoom: int = 21) -> str:
    return f"degrees(atan(sinh({PI} * (1.0::DOUBLE - 2.0::DOUBLE * ({y}) / {2**zoom}::DOUBLE))))"


def _lng(x: str, zoom: int = 21) -> str:
    return f"(({x}) / {2**zoom}::DOUBLE * 360.0::DOUBLE - 180.0::DOUBLE)"


LAT0, LNG0 = f"{GRID.lat!r}::DOUBLE", f"{GRID.lng!r}::DOUBLE"


def _tile(zoom: int = 21) -> str:
    x = f"CAST(round_even(({_x('lng', zoom)} - {_x(LNG0, zoom)}) / 7.5::DOUBLE, 0) AS INTEGER)"
    y = f"CAST(round_even(({_y('lat', zoom)} - {_y(LAT0, zoom)}) / 4.21875::DOUBLE, 0) AS INTEGER)"
    return f"{x} AS tx, {y} AS ty"


def _tile_lat(dy: str, zoom: int = 21) -> str:
    return _lat(f"{_y(LAT0, zoom)} + (ty + {dy}) * 4.21875::DOUBLE", zoom)


def _tile_lng(dx: str, zoom: int = 21) -> str:
    return _lng(f"{_x(LNG0, zoom)} + (tx + {dx}) * 7.5::DOUBLE", zoom)


def _haversine(a: str, b: str, c: str, d: str, r: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"({r}::DOUBLE * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def _gps(px: str, py: str, w: str, h: str, lat: str = "lat", lng: str = "lng", zoom: int = 21) -> tuple[str, str]:
    scale = f"{256 * 2**zoom}::DOUBLE"
    s = f"greatest(least(sin(radians({lat})), 0.9999::DOUBLE), -0.9999::DOUBLE)"
    y = f"((0.5::DOUBLE - ln((1 + {s}) / (1 - {s})) / (4 * {PI})) * {scale} + {py} - {h} / 2)"
    x = f"(({lng} + 180.0::DOUBLE) / 360.0::DOUBLE * {scale} + {px} - {w} / 2)"
    return f"degrees(atan(sinh({PI} - 2 * {PI} * {y} / {scale})))", f"({x} / {scale} * 360.0::DOUBLE - 180.0::DOUBLE)"


def _r(c, places: int = 6):
    return F.round(c, places)


def _inside(point: str = "p") -> str:
    """Pairs of a point and an area that holds it."""
    return (
        f"hits AS (SELECT DISTINCT pid, area_id FROM (SELECT {point}.pid, area_id, ring_id, count(*) AS n FROM pts {point} JOIN edges e ON "
        f"lat > least(y1, y2) AND lat <= greatest(y1, y2) AND lng <= greatest(x1, x2) AND (x1 = x2 OR lng <= (lat - y1) * (x2 - x1) / (y2 - y1) + x1) "
        f"GROUP BY ALL) WHERE n % 2 = 1)"
    )


_T = "greatest(0, least(1, ((lng - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
NEAR = (
    f"near AS (SELECT DISTINCT pid, area_id FROM (SELECT pid, area_id, lat, pow(lng - (x1 + {_T} * (x2 - x1)), 2) + pow(lat - (y1 + {_T} * (y2 - y1)), 2) AS d FROM pts, edges) "
    "WHERE d <= pow(greatest(100 / 111000.0::DOUBLE, 100 / greatest(1.0::DOUBLE, 111000.0::DOUBLE * cos(radians(lat)))), 2))"
)


@query(f"SELECT tx, ty, count(*) AS n FROM (SELECT {_tile(18)} FROM pts JOIN (SELECT DISTINCT pid FROM hits) USING (pid)) GROUP BY tx, ty ORDER BY tx * tx + ty * ty, abs(tx), ty, tx LIMIT 10", PTS, edges_sql(), _inside())
def tile_counts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = geofence.join_areas(pts(spark, sf_dir), edges(spark)).dropDuplicates(["pid"])
    tx, ty = m.tile_of(F.col("lat"), F.col("lng"), COARSE)
    counts = points.groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("n"))
    return tiles.next_tiles(counts, 10)


@query(f"SELECT pid, {_tile()} FROM pts", PTS)
def geo_latlng_to_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, ty = m.tile_of(F.col("lat"), F.col("lng"), GRID)
    return pts(spark, sf_dir).select("pid", tx.alias("tx"), ty.alias("ty"))


@query(f"SELECT pid, tx, ty, round({_tile_lat('0')}, 6) AS lat, round({_tile_lng('0')}, 6) AS lng FROM (SELECT pid, {_tile()} FROM pts)", PTS)
def geo_tile_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = m.tile_centre(F.col("tx"), F.col("ty"), GRID)
    return geo_latlng_to_tile(spark, sf_dir).select("pid", "tx", "ty", _r(lat).alias("lat"), _r(lng).alias("lng"))


@query(
    f"SELECT pid, round({_tile_lat('0.5')}, 6) AS lat_min, round({_tile_lng('-0.5')}, 6) AS lng_min, round({_tile_lat('-0.5')}, 6) AS lat_max, round({_tile_lng('0.5')}, 6) AS lng_max FROM (SELECT pid, {_tile()} FROM pts)",
    PTS,
)
def geo_tile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = m.tile_box(F.col("tx"), F.col("ty"), GRID)
    out = geo_latlng_to_tile(spark, sf_dir).withColumn("box", box)
    return out.select("pid", *(_r(F.col(f"box.{c}")).alias(c) for c in ("lat_min", "lng_min", "lat_max", "lng_max")))


_PIXEL = _gps("(pid % 1920)", "(pid * 7 % 1080)", "1920", "1080")


@query(f"SELECT pid, round({_PIXEL[0]}, 6) AS lat, round({_PIXEL[1]}, 6) AS lng FROM pts", PTS)
def geo_pixel_to_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = F.col("pid") % 1920, F.col("pid") * 7 % 1080
    lat, lng = m.pixel_to_gps(F.col("lat"), F.col("lng"), 21, F.lit(1920), F.lit(1080), px, py)
    return pts(spark, sf_dir).select("pid", _r(lat).alias("lat"), _r(lng).alias("lng"))


@query(f"SELECT pid, round({_haversine(LAT0, LNG0, 'lat', 'lng', '6371.0')}, 6) AS km, round({_haversine(LAT0, LNG0, 'lat', 'lng', '6371000.0')}, 3) AS metres FROM pts", PTS)
def geo_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = lambda r: m.haversine(F.lit(GRID.lat), F.lit(GRID.lng), F.col("lat"), F.col("lng"), r)
    return pts(spark, sf_dir).select("pid", _r(far(6371.0)).alias("km"), _r(far(6371000.0), 3).alias("metres"))


@query(
    f"""SELECT pid, round(sqrt(dx * dx + dy * dy), 6) AS pixels, round(fmod(degrees(atan2(dx, -dy)) + 360, 360), 6) AS bearing,
    round(sqrt(dx * dx + dy * dy) / 2 * (2 * {PI} * 6378137.0::DOUBLE * cos(radians(lat)) / {2**21}::DOUBLE / 256), 6) AS metres
    FROM (SELECT pid, lat, CAST(pid % 1920 - 960 AS DOUBLE) AS dx, CAST(pid * 7 % 1080 - 540 AS DOUBLE) AS dy FROM pts)""",
    PTS,
)
def geo_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("pid") % 1920).cast("double"), (F.col("pid") * 7 % 1080).cast("double"), F.lit(960.0), F.lit(540.0)
    pixels = m.pixel_distance(*at)
    return pts(spark, sf_dir).select("pid", _r(pixels).alias("pixels"), _r(m.pixel_bearing(*at)).alias("bearing"), _r(pixels / 2 * m.metres_per_pixel(F.col("lat"), 21)).alias("metres"))


_CORNERS = {"top_left": ("0", "0"), "top_right": ("1920", "0"), "bottom_left": ("0", "1080"), "bottom_right": ("1920", "1080")}


@query(
    "SELECT pid, " + ", ".join(f"round({_gps(px, py, '1920', '1080')[k]}, 6) AS {name}_{('lat', 'lng')[k]}" for name, (px, py) in _CORNERS.items() for k in (0, 1)) + " FROM pts",
    PTS,
)
def geo_image_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pts(spark, sf_dir).withColumn("c", m.image_corners(F.col("lat"), F.col("lng"), 21, F.lit(1920), F.lit(1080)))
    return out.select("pid", *(F.col(f"c.{name}.{k}").alias(f"{name}_{k}") for name in _CORNERS for k in ("lat", "lng")))


@query(
    """SELECT pid, x1, y1, CAST(least(w, x1 + 1224) AS INTEGER) AS x2, CAST(least(h, y1 + 900) AS INTEGER) AS y2 FROM
    (SELECT pid, w, h, CAST(greatest(0, floor((w - 1224) / 2)) AS INTEGER) AS x1, CAST(greatest(0, floor((h - 900) / 2)) AS INTEGER) AS y1 FROM (SELECT pid, 1000 + pid % 1500 AS w, 700 + pid % 700 AS h FROM pts))""",
    PTS,
)
def geo_crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = m.crop_window(1000 + F.col("pid") % 1500, 700 + F.col("pid") % 700, F.lit(1224), F.lit(900))
    return pts(spark, sf_dir).select("pid", box.alias("b")).select("pid", "b.*")


def _rescue() -> str:
    px = "(960 + CASE WHEN pid % 2 = 0 THEN 537.6::DOUBLE ELSE 0 END - CASE WHEN pid % 3 = 0 THEN 537.6::DOUBLE ELSE 0 END)"
    py = "(540 - CASE WHEN pid % 5 = 0 THEN 302.4::DOUBLE ELSE 0 END + CASE WHEN pid % 7 = 0 THEN 302.4::DOUBLE ELSE 0 END)"
    lat, lng = _gps(px, py, "1920", "1080")
    a, b = _gps("0", "0", "1920", "1080"), _gps("1920", "1080", "1920", "1080")
    return (
        f"SELECT pid, round({lat}, 6) AS lat, round({lng}, 6) AS lng, round(least({a[0]}, {b[0]}), 6) AS lat_min, round(least({a[1]}, {b[1]}), 6) AS lng_min, "
        f"round(greatest({a[0]}, {b[0]}), 6) AS lat_max, round(greatest({a[1]}, {b[1]}), 6) AS lng_max FROM pts"
    )


@query(_rescue(), PTS)
def geo_rescue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = [F.when(F.col("pid") % k == 0, side) for k, side in ((2, "right"), (3, "left"), (5, "top"), (7, "bottom"))]
    lat, lng = m.rescue_centre(F.col("lat"), F.col("lng"), F.array_compact(F.array(*cut)), GRID)
    box = m.view_box(F.col("lat"), F.col("lng"), GRID)
    out = pts(spark, sf_dir).select("pid", _r(lat).alias("lat"), _r(lng).alias("lng"), box.alias("b"))
    return out.select("pid", "lat", "lng", *(_r(F.col(f"b.{c}")).alias(c) for c in ("lat_min", "lng_min", "lat_max", "lng_max")))


@query(
    f"SELECT pid, round(sqrt(pow(({LAT0} - lat) * 111320, 2) + pow(({LNG0} - lng) * 111320 * cos(radians(lat)), 2)), 6) AS metres, CAST(greatest(1, ceil(pid % 9 / (40075.016::DOUBLE * cos(radians(lat)) / {2**21}::DOUBLE))) AS INTEGER) AS tile_radius FROM pts",
    PTS,
)
def geo_flat_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = m.flat_metres(F.col("lat"), F.col("lng"), F.lit(GRID.lat), F.lit(GRID.lng))
    return pts(spark, sf_dir).select("pid", _r(d).alias("metres"), m.radius_in_tiles(F.col("pid") % 9, F.col("lat"), 21).alias("tile_radius"))


@query(
    """SELECT tile, ordinal, array_to_string(list_filter([CASE WHEN x1 <= 48 THEN 'left' END, CASE WHEN x2 >= 1872 THEN 'right' END, CASE WHEN y1 <= 48 THEN 'top' END, CASE WHEN y2 >= 1032 THEN 'bottom' END], lambda s: s IS NOT NULL), ',') AS sides FROM boxes""",
    BOXES,
)
def edge_cut_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = m.edge_sides(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(1920.0), F.lit(1080.0), F.lit(1.0))
    return boxes(spark, sf_dir).select("tile", "ordinal", F.array_join(sides, ",").alias("sides"))


@query("SELECT tile, ordinal FROM boxes WHERE confidence >= 0.2 AND (x1 + x2) / 2 BETWEEN 188 AND 1732 AND (y1 + y2) / 2 BETWEEN 88 AND 912", BOXES)
def core_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = F.lit(200.0), F.lit(100.0), F.lit(1720.0), F.lit(900.0)
    slack = F.greatest(F.lit(8.0), F.lit(12.0) * 1.0)
    centre = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return boxes(spark, sf_dir).where(F.col("confidence") >= 0.2).where(m.in_core(*centre, core, slack)).select("tile", "ordinal")


@query("SELECT pid, area_id FROM hits", PTS, edges_sql(), _inside())
def geofence_pip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geofence.join_areas(pts(spark, sf_dir), edges(spark)).select("pid", "area_id")


@query("SELECT pid, area_id FROM hits UNION SELECT pid, area_id FROM near", PTS, edges_sql(), _inside(), NEAR)
def geofence_buffer_100m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geofence.join_areas(pts(spark, sf_dir), edges(spark), 100.0).select("pid", "area_id")


@query("SELECT ordinal FROM pois WHERE lat IS NULL OR ordinal IN (SELECT pid FROM hits UNION SELECT pid FROM near)", POIS, edges_sql(), "pts AS (SELECT ordinal AS pid, lat, lng FROM pois WHERE lat IS NOT NULL)", _inside(), NEAR)
def geofence_keep_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geofence.keep_inside(pois(spark, sf_dir), edges(spark), "ordinal", 100.0).select("ordinal")


@query("SELECT pid, CASE WHEN pid % 3 = 0 AND pid NOT IN (SELECT pid FROM hits UNION SELECT pid FROM near) THEN 'discarded' ELSE 'kept' END AS verdict FROM pts", PTS, edges_sql(), _inside(), NEAR)
def tile_geo_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir)
    held = geofence.join_areas(points, edges(spark), 100.0).select("pid").distinct().withColumn("held", F.lit(True))
    return points.join(held, "pid", "left").select("pid", geofence.tile_verdict(F.col("pid") % 3 == 0, F.col("held")).alias("verdict"))


@query("SELECT area_id, min(y1) AS lat_min, min(x1) AS lng_min, max(y1) AS lat_max, max(x1) AS lng_max, round((min(y1) + max(y1)) / 2, 6) AS lat, round((min(x1) + max(x1)) / 2, 6) AS lng FROM edges GROUP BY area_id", edges_sql())
def boundary_bbox_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geofence.bounding_boxes(edges(spark))
    centre = geofence.box_centres(box).select("area_id", _r(F.col("lat")).alias("lat"), _r(F.col("lng")).alias("lng"))
    return box.join(centre, "area_id").select("area_id", "lat_min", "lng_min", "lat_max", "lng_max", "lat", "lng")


_SPAN = (
    "span AS (SELECT area_id, "
    f"CAST(floor(({_x('min(x1)', 18)} - {_x(LNG0, 18)}) / 7.5::DOUBLE) AS BIGINT) AS tx1, CAST(ceil(({_x('max(x1)', 18)} - {_x(LNG0, 18)}) / 7.5::DOUBLE) AS BIGINT) AS tx2, "
    f"CAST(floor(({_y('max(y1)', 18)} - {_y(LAT0, 18)}) / 4.21875::DOUBLE) AS BIGINT) AS ty1, CAST(ceil(({_y('min(y1)', 18)} - {_y(LAT0, 18)}) / 4.21875::DOUBLE) AS BIGINT) AS ty2 FROM edges GROUP BY area_id), "
    "grid AS (SELECT area_id AS own, tx, unnest(range(ty1, ty2 + 1)) AS ty FROM (SELECT *, unnest(range(tx1, tx2 + 1)) AS tx FROM span)), "
    "samples(dx, dy) AS (VALUES (-0.5, 0.5), (0.5, 0.5), (-0.5, -0.5), (0.5, -0.5), (0.0, 0.0)), "
    f"pts AS (SELECT own || ' ' || tx || ' ' || ty || ' ' || dx || ' ' || dy AS pid, own, tx, ty, {_tile_lat('dy::DOUBLE', 18)} AS lat, {_tile_lng('dx::DOUBLE', 18)} AS lng FROM grid, samples)"
)


@query("SELECT DISTINCT area_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty FROM hits JOIN pts USING (pid) WHERE own = area_id", edges_sql(), _SPAN, _inside())
def tiles_for_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tiles_in_boundaries(edges(spark), COARSE)


def _radius() -> str:
    r = f"CAST(greatest(1, ceil(2 / (40075.016::DOUBLE * cos(radians({LAT0})) / {2**18}::DOUBLE))) AS INTEGER)"
    grid = f"(SELECT tx, unnest(range(-ry, ry + 1)) AS ty FROM (SELECT ry, unnest(range(-rx, rx + 1)) AS tx FROM (SELECT CAST(ceil({r} / 7.5::DOUBLE) AS BIGINT) AS rx, CAST(ceil({r} / 4.21875::DOUBLE) AS BIGINT) AS ry)))"
    far = _haversine(LAT0, LNG0, _tile_lat("0", 18), _tile_lng("0", 18), "6371.0")
    return f"SELECT CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty FROM {grid} WHERE {far} <= 2"


@query(_radius())
def tiles_for_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tiles_in_radius(COARSE, 2.0, spark)


@query(
    f"SELECT area_id, {_tile(18)}, count(*) AS n FROM (SELECT area_id, lat, lng FROM hits JOIN pts USING (pid)) GROUP BY ALL",
    "pts AS (SELECT row_number() OVER () AS pid, 10.75::DOUBLE + (l_partkey % 211) * 0.0002::DOUBLE AS lat, 106.68::DOUBLE + (l_suppkey * 7 % 173) * 0.0002::DOUBLE AS lng FROM lineitem)",
    edges_sql(),
    _inside(),
)
def lineitem_tiles_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large scan: every line item as a point."""
    lat, lng = 10.75 + (F.col("l_partkey") % 211) * F.lit(0.0002), 106.68 + (F.col("l_suppkey") * 7 % 173) * F.lit(0.0002)
    points = table(spark, sf_dir, "lineitem").select(lat.alias("lat"), lng.alias("lng"))
    tx, ty = m.tile_of(F.col("lat"), F.col("lng"), COARSE)
    return geofence.join_areas(points, edges(spark)).groupBy("area_id", tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("n"))
