"""Point-in-polygon joins over an index of boundary edges by latitude band.

The outer rings of every boundary are cut into horizontal bands. A point meets one row per area
and band, with the edges that cross the band, so a test reads about as many edges as cross
the point's latitude, never the whole ring, and needs no group-by. The index is broadcast if it is
small and joined by shuffle on the band otherwise.
"""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 0.001  # degrees of latitude
DEGREE_M = 111_000.0
INDEX_ROWS = 500_000

EDGE = "area_id string, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def rings_to_edges(rings: DataFrame) -> DataFrame:
    """rings(area_id, ring_id, points array<struct<x, y>>) to closed edges; rings of under three points have none."""
    n = F.size("points")
    point = lambda i: F.element_at("points", i + 1)
    step = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("seq"), point(i).alias("p"), point((i + 1) % n).alias("q")))
    out = rings.where(n >= 3).select("area_id", "ring_id", F.explode(step).alias("e"))
    return out.select("area_id", "ring_id", F.col("e.seq").cast("int").alias("seq"), F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def band_index(edges: DataFrame, buffer_m: float = 0.0, band: float = BAND) -> DataFrame:
    """One row per area and band with the edges that cross it, or come within the buffer of it.

    The buffer is a circle in degrees whose radius grows with latitude, so the edge farthest from
    the equator, and a degree more, bounds it.
    """
    reach = 0.0
    if buffer_m:
        far = min(89.0, (edges.agg(F.max(F.abs("y1"))).first()[0] or 0.0) + 1.0)
        reach = buffer_m / max(1.0, DEGREE_M * cos(radians(far)))
    low = F.floor((F.least("y1", "y2") - reach) / band)
    high = F.floor((F.greatest("y1", "y2") + reach) / band)
    cut = edges.withColumn("band", F.explode(F.sequence(low, high)))
    ring = F.struct("ring_id", "x1", "y1", "x2", "y2")
    grouped = cut.groupBy("area_id", "band").agg(
        F.collect_list(ring).alias("edges"),
        (F.min(F.least("x1", "x2")) - reach).alias("x_min"),
        (F.max(F.greatest("x1", "x2")) + reach).alias("x_max"),
    )
    return grouped.withColumn("rings", F.array_distinct(F.transform("edges", lambda e: e["ring_id"])))


def crosses(x: Column, y: Column, e: Column) -> Column:
    """Whether a ray to the right of (x, y) meets the edge; its lower end is open, its upper closed."""
    at = F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]) + e["x1"]
    return (y > F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"])) & (x <= F.greatest(e["x1"], e["x2"])) & ((e["x1"] == e["x2"]) | (x <= at))


def inside(x: Column, y: Column, edges: Column, rings: Column) -> Column:
    """Odd crossings of some ring. Holes are not kept apart: only outer rings are indexed."""
    return F.exists(rings, lambda r: F.size(F.filter(edges, lambda e: (e["ring_id"] == r) & crosses(x, y, e))) % 2 == 1)


def edge_distance_sq(x: Column, y: Column, e: Column) -> Column:
    """Squared distance in degrees from a point to an edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.nullif(length, F.lit(0.0)))))
    cx, cy = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
    return cx * cx + cy * cy


def buffer_degrees_sq(lat: Column, buffer_m: float) -> Column:
    wide = buffer_m / F.greatest(F.lit(1.0), DEGREE_M * F.cos(F.radians(lat)))
    widest = F.greatest(F.lit(buffer_m / DEGREE_M), wide)
    return widest * widest


def join_areas(points: DataFrame, edges: DataFrame, buffer_m: float = 0.0, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """points with area_id for every area that holds them, or comes within buffer_m of them; points with
    null coordinates match none. A point in two areas gets two rows."""
    index = band_index(edges, buffer_m)
    index = F.broadcast(index) if index.limit(INDEX_ROWS + 1).count() <= INDEX_ROWS else index
    x, y = F.col(lng), F.col(lat)
    near = points.withColumn("band", F.floor(y / BAND)).join(index, "band").where(x.between(F.col("x_min"), F.col("x_max")))
    test = inside(x, y, F.col("edges"), F.col("rings"))
    if buffer_m > 0:
        limit = buffer_degrees_sq(y, buffer_m)
        test = test | F.exists("edges", lambda e: edge_distance_sq(x, y, e) <= limit)
    return near.where(test).select(*(points[c] for c in points.columns), "area_id")


def keep_inside(points: DataFrame, edges: DataFrame, key: str, buffer_m: float = 100.0, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Points in some area, grown by the buffer. Points without coordinates are kept, and all
    points are if there are no edges."""
    if edges.isEmpty():
        return points
    hits = join_areas(points.select(key, lat, lng), edges, buffer_m, lat, lng).select(key).distinct()
    located = F.col(lat).isNotNull() & F.col(lng).isNotNull()
    return points.where(located).join(hits, key, "left_semi").unionAll(points.where(~located))


def tile_verdict(flagged: Column, inside_boundary: Column) -> Column:
    """A tile is discarded only if flagged as outside and not inside the grown boundary."""
    return F.when(flagged & ~F.coalesce(inside_boundary, F.lit(False)), "discarded").otherwise("kept")


def bounding_boxes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("area_id").agg(F.min("y1").alias("lat_min"), F.min("x1").alias("lng_min"), F.max("y1").alias("lat_max"), F.max("x1").alias("lng_max"))


def box_centres(boxes: DataFrame) -> DataFrame:
    return boxes.select("area_id", ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"), ((F.col("lng_min") + F.col("lng_max")) / 2).alias("lng"))
