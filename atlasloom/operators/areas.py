"""Scan areas from a manifest: order, filters, centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import centre_key, fold, slashes, strip, strip_admin_prefix

# Which province comes first, and the order of district kinds.
FIRST_PROVINCE = "Thành phố Hồ Chí Minh"
DISTRICT_KINDS = (("Quận", 0), ("Quan", 0), ("Thành phố", 1), ("Thanh pho", 1), ("Thị xã", 2), ("Thi xa", 2), ("Huyện", 3), ("Huyen", 3))
OTHER_KIND = 9


def district_kind(c: Column) -> Column:
    rank = F.lit(OTHER_KIND)
    for name, place in reversed(DISTRICT_KINDS):
        rank = F.when(c.startswith(name + " "), place).otherwise(rank)
    return rank


def manifest_order(province: Column, district: Column) -> list[Column]:
    """First province, then provinces by name; districts by kind, numbered ones first, then by name."""
    bare = strip_admin_prefix(district)
    number = F.when(bare.rlike(r"^[+-]?[0-9]{1,9}$"), bare.cast("int"))
    first = province == FIRST_PROVINCE
    return [
        F.when(first, 0).otherwise(1),
        F.when(first, "").otherwise(F.lower(strip_admin_prefix(province))),
        district_kind(district),
        number.isNull(),
        number,
        F.lower(bare),
    ]


def ranked_areas(manifest: DataFrame, tie: str) -> DataFrame:
    """manifest with the place of each row in the manifest order, from 0; a manifest is a small table."""
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    order = Window.orderBy(*manifest_order(clean("province"), clean("district")), tie)
    return manifest.withColumn("place", F.row_number().over(order) - 1)


def select_areas(ranked: DataFrame, province: str = "", district: str = "", start: int = 0, most: int = 0) -> DataFrame:
    """Rows from place start on whose folded names contain the folded filters; blank names go; the limit comes last."""
    out = ranked.where(F.col("place") >= start).where((strip(F.col("province")) != "") & (strip(F.col("district")) != ""))
    for column, wanted in (("province", province), ("district", district)):
        if wanted.strip():
            out = out.where(F.contains(fold(F.col(column)), strip(fold(F.lit(wanted)))))
    return out.orderBy("place").limit(most) if most else out


def with_centres(areas: DataFrame, centres: DataFrame) -> DataFrame:
    """areas(province, district, boundary_path, centroid array<lat, lng>) with centre_lat, centre_lng: by key, else by the
    boundary's path, else the centroid; areas without any go. centres(key, center_lat, center_lng, boundary_path)."""
    path = lambda c: F.lower(strip(slashes(c)))
    by_key = centres.select(F.col("key").alias("k"), F.struct("center_lat", "center_lng").alias("c1"))
    by_path = centres.where(path(F.col("boundary_path")) != "").groupBy(path(F.col("boundary_path")).alias("p")).agg(F.min_by(F.struct("center_lat", "center_lng"), "key").alias("c2"))
    out = areas.withColumn("k", centre_key(F.col("province"), F.col("district"))).withColumn("p", path(F.col("boundary_path")))
    out = out.join(by_key, "k", "left").join(by_path, "p", "left")
    own = F.struct(F.get("centroid", F.lit(0)).alias("center_lat"), F.get("centroid", F.lit(1)).alias("center_lng"))
    out = out.withColumn("c", F.coalesce("c1", "c2", own))
    return out.where("c.center_lat is not null and c.center_lng is not null").select(*areas.columns, "c.center_lat", "c.center_lng")


def runtime_dir(root: str, province: Column, district: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), centre_key(province, district))
