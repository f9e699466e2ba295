"""Geofences, tiles and projections against known values and plain versions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasloom.functions import mercator as m
from atlasloom.operators import geofence, tiles

SQUARE = [(106.6, 10.7), (106.8, 10.7), (106.8, 10.9), (106.6, 10.9)]


def edges(spark, *rings):
    rows = [("a", k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring in enumerate(rings)]
    return geofence.rings_to_edges(spark.createDataFrame(rows, "area_id string, ring_id int, points array<struct<x: double, y: double>>"))


def points(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "k int, lat double, lng double")


@pytest.mark.parametrize(("lat", "lng", "buffer", "inside"), [(10.8, 106.7, 0, True), (10.5, 106.5, 0, False), (10.6995, 106.7, 100, True), (10.6995, 106.7, 10, False)])
def test_square(spark, lat, lng, buffer, inside):
    assert (geofence.join_areas(points(spark, [(lat, lng)]), edges(spark, SQUARE), buffer).count() == 1) is inside


def crossings(lat, lng, ring):
    """The half-open rule, one edge at a time."""
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if min(y1, y2) < lat <= max(y1, y2) and lng <= max(x1, x2) and (x1 == x2 or lng <= (lat - y1) * (x2 - x1) / (y2 - y1) + x1):
            odd = not odd
    return odd


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=3, max_size=9), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=30))
def test_any_ring(spark, ring, at):
    ring = [(x / 1000, y / 1000) for x, y in ring]
    at = [(y / 1000, x / 1000) for x, y in at]
    found = {r.k for r in geofence.join_areas(points(spark, at), edges(spark, ring)).collect()}
    assert found == {k for k, (lat, lng) in enumerate(at) if crossings(lat, lng, ring)}


def test_null_points_stay_and_no_boundary_keeps_all(spark):
    p = points(spark, [(10.8, 106.7), (50, 8)]).unionAll(spark.createDataFrame([(9, None, 106.7)], "k int, lat double, lng double"))
    assert {r.k for r in geofence.keep_inside(p, edges(spark, SQUARE), "k").collect()} == {0, 9}
    assert geofence.keep_inside(p, edges(spark, SQUARE).limit(0), "k").count() == 3
    assert edges(spark, SQUARE[:2]).count() == 0


def test_tile_of_its_middle(spark):
    grid = m.Grid()
    t = spark.range(-40, 40).select(F.col("id").cast("int").alias("tx"), (F.col("id") * 3 % 17).cast("int").alias("ty"))
    lat, lng = m.tile_centre(F.col("tx"), F.col("ty"), grid)
    bx, by = m.tile_of(F.col("lat"), F.col("lng"), grid)
    back = t.withColumn("lat", lat).withColumn("lng", lng).select("tx", "ty", bx.alias("bx"), by.alias("by"))
    assert back.where("tx <> bx or ty <> by").count() == 0


def test_known_places(spark):
    grid = m.Grid()
    row = lambda *c: spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(c))).first()
    right = row(*m.tile_centre(F.lit(1), F.lit(0), grid))
    below = row(*m.tile_centre(F.lit(0), F.lit(1), grid))
    assert right[1] == pytest.approx(106.70113144173712, abs=1e-9)
    assert below[0] == pytest.approx(10.779144380012056, abs=1e-9)
    assert row(m.radius_in_tiles(F.lit(3.0), F.lit(grid.lat), 21))[0] == 160
    size = row(m.metres_per_pixel(F.lit(grid.lat), 21))[0]
    assert size * 1920 == pytest.approx(140.79, abs=0.01) and size * 1080 == pytest.approx(79.19, abs=0.01)
    assert row(m.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0] == pytest.approx(6371 * math.pi)


def test_tiles_of_parts_and_slivers(spark):
    grid = m.Grid(lat=10.8, lng=106.7, zoom=18)
    two = tiles.tiles_in_boundaries(edges(spark, [(106.70, 10.80), (106.71, 10.80), (106.71, 10.81)], [(106.68, 10.78), (106.69, 10.78), (106.69, 10.79)]), grid)
    one = tiles.tiles_in_boundaries(edges(spark, [(106.70, 10.80), (106.71, 10.80), (106.71, 10.81)]), grid)
    assert two.count() > one.count() > 0
    # Smaller than a tile and away from its samples: no tile.
    assert tiles.tiles_in_boundaries(edges(spark, [(106.7004, 10.8002), (106.7005, 10.8002), (106.7005, 10.8003)]), grid).count() == 0
