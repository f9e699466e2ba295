"""Outputs: clean rows, GeoJSON, viewer payloads, checkpoints and markers. Data goes out through Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.mercator import Grid, tile_box

BOM = "﻿"
SHOWN = ("discarded", "visited", "captured")
CLEAN_COLUMNS = ("title_poi", "ten_dia_diem", "toa_do", "quan_huyen_xa", "tinh_thanh_pho", "crop_image", "tile_x", "tile_y")


def clean_rows(records: DataFrame) -> DataFrame:
    """Final records as the eight text columns of the clean table; blank names are left out."""
    name = t.strip(F.coalesce("name", F.lit("")))
    out = records.select(
        name.alias("title_poi"),
        name.alias("ten_dia_diem"),
        t.coordinate_text(F.col("approx_lat"), F.col("approx_lng")).alias("toa_do"),
        t.admin_area(F.col("ward"), F.col("district")).alias("quan_huyen_xa"),
        F.coalesce("province", F.lit("")).alias("tinh_thanh_pho"),
        t.slashes(F.col("crop_image")).alias("crop_image"),
        F.coalesce(F.col("tile_x").cast("string"), F.lit("")).alias("tile_x"),
        F.coalesce(F.col("tile_y").cast("string"), F.lit("")).alias("tile_y"),
    )
    return out.where("title_poi <> ''")


def write_clean_csv(records: DataFrame, path: str) -> None:
    """Clean rows as CSV files with headers; the first header starts with a byte order mark, which spreadsheets look for."""
    rows = clean_rows(records)
    rows.withColumnRenamed("title_poi", BOM + "title_poi").write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_results(records: DataFrame, path: str) -> None:
    """Records as JSON lines; the commit protocol makes the change atomic for readers of the folder."""
    records.write.mode("overwrite").json(path)


def tile_features(states: DataFrame, grid: Grid) -> DataFrame:
    """states(area_id, tx, ty, status[, bbox]) with the closed ring of each shown tile, [lng, lat] points; a saved box goes before a computed one."""
    box = tile_box(F.col("tx"), F.col("ty"), grid)
    if "bbox" in states.columns:
        box = F.coalesce(F.col("bbox"), box)
    point = lambda lng, lat: F.array(F.col(f"b.{lng}"), F.col(f"b.{lat}"))
    ring = F.array(point("lng_min", "lat_min"), point("lng_max", "lat_min"), point("lng_max", "lat_max"), point("lng_min", "lat_max"), point("lng_min", "lat_min"))
    return states.where(F.col("status").isin(*SHOWN)).withColumn("b", box).select("area_id", "tx", "ty", "status", ring.alias("ring"))


def geojson(states: DataFrame, grid: Grid) -> DataFrame:
    """(area_id, geojson): a FeatureCollection for each area. A viewer's payload: one row per area holds its tiles."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("tx", "ty", "status").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"),
    )
    features = F.transform(F.sort_array(F.collect_list(F.struct("tx", "ty", feature.alias("f")))), lambda x: x["f"])
    collection = F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))
    return tile_features(states, grid).groupBy("area_id").agg(F.to_json(collection).alias("geojson"))


def viewer_counts(states: DataFrame) -> DataFrame:
    from ..operators.tiles import scan_stats

    return scan_stats(states)


def viewer_pois(records: DataFrame) -> DataFrame:
    """Names split into the main part and the rest, for a list of places."""
    main, rest = t.split_name(F.col("name"))
    return records.withColumn("main_name", main).withColumn("sub_info", rest)


def checkpoint_json(states: DataFrame) -> DataFrame:
    """(area_id, checkpoint): the saved form of an area's state; the queue is what is queued and not visited."""
    pairs = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.array("tx", "ty"))))
    body = F.struct(pairs("visited").alias("visited"), pairs("queued").alias("queue"), pairs("discarded").alias("discarded"), pairs("captured").alias("captured"))
    return states.groupBy("area_id").agg(F.to_json(body).alias("checkpoint"))


def write_manifest(areas: DataFrame, path: str) -> None:
    """{"areas": [...]}: one document, as its readers expect; a manifest is a small table."""
    areas.agg(F.to_json(F.struct(F.collect_list(F.struct(*areas.columns)).alias("areas"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_centres(centres: DataFrame, path: str) -> None:
    """{"centers": {key: {...}}}."""
    entry = F.struct("key", F.struct("center_lat", "center_lng", "boundary_path").alias("value"))
    centres.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("centers"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def done_marker(stats: DataFrame) -> DataFrame:
    """One JSON line per area that is finished."""
    return stats.where("pending = 0 and queued = 0").select("area_id", F.to_json(F.struct(*[c for c in stats.columns if c != "area_id"])).alias("done"))
