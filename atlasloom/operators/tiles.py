"""Tile generation inside boundaries or radii, frontier order, neighbours, and tile state as set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mercator import EARTH_KM, Grid, haversine, radius_in_tiles, tile_centre, tile_point, world_x, world_y
from .geofence import bounding_boxes, join_areas

#: Points of a tile, right and down of its middle: one of them inside makes the tile part of an area.
SAMPLES = ((-0.5, 0.5), (0.5, 0.5), (-0.5, -0.5), (0.5, -0.5), (0.0, 0.0))
OFFSETS = tuple((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0))
KEY = ["area_id", "tx", "ty"]


def tiles_in_boundaries(edges: DataFrame, grid: Grid) -> DataFrame:
    """(area_id, tx, ty) of tiles with a corner or the middle inside the area."""
    x0, y0 = world_x(F.lit(grid.lng), grid.zoom), world_y(F.lit(grid.lat), grid.zoom)
    box = bounding_boxes(edges)
    xs = [(world_x(F.col(c), grid.zoom) - x0) / grid.step_x for c in ("lng_min", "lng_max")]
    ys = [(world_y(F.col(c), grid.zoom) - y0) / grid.step_y for c in ("lat_max", "lat_min")]
    span = box.select("area_id", F.explode(F.sequence(F.floor(xs[0]).cast("int"), F.ceil(xs[1]).cast("int"))).alias("tx"), F.floor(ys[0]).cast("int").alias("y1"), F.ceil(ys[1]).cast("int").alias("y2"))
    tiles = span.select("area_id", "tx", F.explode(F.sequence("y1", "y2")).alias("ty"))
    places = [tile_point(F.col("tx"), F.col("ty"), grid, *s) for s in SAMPLES]
    points = tiles.withColumn("p", F.explode(F.array(*(F.struct(lat.alias("lat"), lng.alias("lng")) for lat, lng in places))))
    points = points.select(F.col("area_id").alias("own"), "tx", "ty", "p.lat", "p.lng")
    return join_areas(points, edges).where("own = area_id").select(*KEY).distinct()


def tiles_in_radius(grid: Grid, radius_km: float, spark) -> DataFrame:
    """(tx, ty) of tiles whose middle is within the radius of the centre."""
    one = spark.range(1).withColumn("r", radius_in_tiles(F.lit(radius_km), F.lit(grid.lat), grid.zoom))
    reach = lambda step: F.ceil(F.col("r") / step).cast("int")
    tiles = one.select("r", F.explode(F.sequence(-reach(grid.step_x), reach(grid.step_x))).alias("tx")).select("tx", F.explode(F.sequence(-reach(grid.step_y), reach(grid.step_y))).alias("ty"))
    lat, lng = tile_centre(F.col("tx"), F.col("ty"), grid)
    return tiles.where(haversine(F.lit(grid.lat), F.lit(grid.lng), lat, lng, EARTH_KM) <= radius_km)


def frontier_order() -> list:
    """Nearest to the centre tile first."""
    return [F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"), F.abs("tx"), F.col("ty"), F.col("tx")]


def frontier_rank(tiles: DataFrame) -> DataFrame:
    """tiles(area_id, tx, ty) with the place of each in its area's frontier."""
    return tiles.withColumn("place", F.row_number().over(Window.partitionBy("area_id").orderBy(*frontier_order())))


def next_tiles(pending: DataFrame, k: int) -> DataFrame:
    """The k tiles to visit next."""
    return pending.orderBy(*frontier_order()).limit(k)


def neighbours(tiles: DataFrame, all_tiles: DataFrame, *done: DataFrame) -> DataFrame:
    """Of the eight tiles around each tile, those that exist and are in none of done."""
    around = F.array(*(F.struct((F.col("tx") + dx).cast("int").alias("tx"), (F.col("ty") + dy).cast("int").alias("ty")) for dx, dy in OFFSETS))
    out = tiles.select("area_id", F.explode(around).alias("t")).select("area_id", "t.tx", "t.ty").distinct().join(all_tiles.select(*KEY), KEY, "left_semi")
    for known in done:
        out = out.join(known.select(*KEY), KEY, "left_anti")
    return out


def fold_state(events: DataFrame) -> DataFrame:
    """events(area_id, tx, ty, status, ts, event_id) to the last status of each tile; of events at one time the last id wins."""
    last = F.max_by("status", F.struct("ts", "event_id"))
    return events.groupBy(*KEY).agg(last.alias("status"), F.count("*").alias("n_events"))


def resume(all_tiles: DataFrame, visited: DataFrame, queued: DataFrame, discarded: DataFrame) -> DataFrame:
    """The queue after a restart: stale tiles go, saved ones come first, each part in frontier order."""
    known = all_tiles.select(*KEY)
    open_ = known.join(visited.select(*KEY), KEY, "left_anti").join(discarded.select(*KEY), KEY, "left_anti")
    saved = queued.select(*KEY).distinct().withColumn("saved", F.lit(0))
    ordered = open_.join(saved, KEY, "left").withColumn("saved", F.coalesce("saved", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("area_id").orderBy("saved", *frontier_order()))
    return ordered.select(*KEY, (F.col("saved") == 0).alias("was_queued"), place.alias("place"))


def scan_stats(states: DataFrame) -> DataFrame:
    """Counts by area, and the share done; discarded tiles count as done."""
    n = lambda s: F.count_if(F.col("status") == s)
    done = n("visited") + n("discarded")
    return states.groupBy("area_id").agg(
        F.count("*").alias("total"),
        done.alias("done"),
        n("captured").alias("captured"),
        n("queued").alias("queued"),
        F.greatest(F.lit(0).cast("long"), F.count("*") - done - n("queued")).alias("pending"),
        F.round(F.when(F.count("*") > 0, 100.0 * done / F.count("*")).otherwise(0.0), 1).alias("pct"),
    )
