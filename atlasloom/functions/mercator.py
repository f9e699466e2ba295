"""Web-Mercator columns: a tile grid around a centre, pixels to coordinates, distances."""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0
EARTH_KM = 6371.0
EQUATOR_RADIUS_M = 6_378_137.0
EQUATOR_KM = 40_075.016


@dataclass(frozen=True)
class Grid:
    """Tiles of width x height pixels, numbered from the tile centred on (lat, lng)."""

    lat: float = 10.779855797443227
    lng: float = 106.69984398140998
    zoom: int = 21
    width: int = 1920
    height: int = 1080

    @property
    def step_x(self) -> float:
        return self.width / 256.0

    @property
    def step_y(self) -> float:
        return self.height / 256.0


def world_x(lng: Column, zoom: int) -> Column:
    """Slippy-map x, in tiles of 256 pixels."""
    return (lng + 180.0) / 360.0 * float(2**zoom)


def world_y(lat: Column, zoom: int) -> Column:
    return (1.0 - F.asinh(F.tan(F.radians(lat))) / pi) / 2.0 * float(2**zoom)


def lng_of(x: Column, zoom: int) -> Column:
    return x / float(2**zoom) * 360.0 - 180.0


def lat_of(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(pi * (1.0 - 2.0 * y / float(2**zoom)))))


def _origin(grid: Grid) -> tuple[Column, Column]:
    return world_x(F.lit(grid.lng), grid.zoom), world_y(F.lit(grid.lat), grid.zoom)


def tile_of(lat: Column, lng: Column, grid: Grid) -> tuple[Column, Column]:
    """The nearest tile; halves go to the even number."""
    x0, y0 = _origin(grid)
    tx = F.bround((world_x(lng, grid.zoom) - x0) / grid.step_x, 0)
    ty = F.bround((world_y(lat, grid.zoom) - y0) / grid.step_y, 0)
    return tx.cast("int"), ty.cast("int")


def tile_centre(tx: Column, ty: Column, grid: Grid) -> tuple[Column, Column]:
    """(lat, lng) of a tile's middle."""
    return tile_point(tx, ty, grid, 0.0, 0.0)


def tile_point(tx: Column, ty: Column, grid: Grid, right: float, down: float) -> tuple[Column, Column]:
    """(lat, lng) of the point right and down of the tile's middle, in tiles."""
    x0, y0 = _origin(grid)
    return lat_of(y0 + ty * grid.step_y + down * grid.step_y, grid.zoom), lng_of(x0 + tx * grid.step_x + right * grid.step_x, grid.zoom)


def tile_box(tx: Column, ty: Column, grid: Grid) -> Column:
    """struct(lat_min, lng_min, lat_max, lng_max)."""
    top, left = tile_point(tx, ty, grid, -0.5, -0.5)
    bottom, right = tile_point(tx, ty, grid, 0.5, 0.5)
    return F.struct(bottom.alias("lat_min"), left.alias("lng_min"), top.alias("lat_max"), right.alias("lng_max"))


def radius_in_tiles(km: Column, lat: Column, zoom: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(km / (EQUATOR_KM * F.cos(F.radians(lat)) / float(2**zoom))).cast("int"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return radius * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def flat_metres(lat: Column, lng: Column, other_lat: Column, other_lng: Column) -> Column:
    """Equirectangular distance around (lat, lng); null where a coordinate is."""
    dy = (other_lat - lat) * METRES_PER_DEGREE
    dx = (other_lng - lng) * METRES_PER_DEGREE * F.cos(F.radians(lat))
    return F.sqrt(dx * dx + dy * dy)


def pixel_to_gps(lat: Column, lng: Column, zoom: int, width: Column, height: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """(lat, lng) of a pixel of an image of the given size centred on (lat, lng)."""
    scale = 256.0 * 2**zoom
    s = F.greatest(F.least(F.sin(F.radians(lat)), F.lit(0.9999)), F.lit(-0.9999))
    x = (lng + 180.0) / 360.0 * scale + px - width / 2
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * pi)) * scale + py - height / 2
    return F.degrees(F.atan(F.sinh(pi - 2 * pi * y / scale))), x / scale * 360.0 - 180.0


def pixel_distance(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))


def pixel_bearing(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(x - cx, cy - y)) + 360.0, F.lit(360.0))


def metres_per_pixel(lat: Column, zoom: int) -> Column:
    return 2 * pi * EQUATOR_RADIUS_M * F.cos(F.radians(lat)) / float(2**zoom) / 256.0


def image_corners(lat: Column, lng: Column, zoom: int, width: Column, height: Column) -> Column:
    """struct of four (lat, lng), to six places."""
    zero = F.lit(0.0)
    at = {"top_left": (zero, zero), "top_right": (width, zero), "bottom_left": (zero, height), "bottom_right": (width, height)}

    def corner(px: Column, py: Column) -> Column:
        found = pixel_to_gps(lat, lng, zoom, width, height, px, py)
        return F.struct(F.round(found[0], 6).alias("lat"), F.round(found[1], 6).alias("lng"))

    return F.struct(*(corner(*p).alias(name) for name, p in at.items()))


def crop_window(width: Column, height: Column, want_width: Column, want_height: Column) -> Column:
    """The centred window of the wanted size, clamped to the image."""
    x1 = F.greatest(F.lit(0), F.floor((width - want_width) / 2).cast("int"))
    y1 = F.greatest(F.lit(0), F.floor((height - want_height) / 2).cast("int"))
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.least(width, x1 + want_width).cast("int").alias("x2"), F.least(height, y1 + want_height).cast("int").alias("y2"))


SHIFT = 0.28  # of the viewport, toward a side that cuts a label


def rescue_centre(lat: Column, lng: Column, sides: Column, grid: Grid, overlap: int = 0) -> tuple[Column, Column]:
    """The centre moved toward the sides that cut a label."""
    width, height = float(grid.width + 2 * overlap), float(grid.height + 2 * overlap)
    toward = lambda side, by: F.when(F.array_contains(sides, side), by).otherwise(0.0)
    px = F.lit(width / 2) + toward("right", width * SHIFT) - toward("left", width * SHIFT)
    py = F.lit(height / 2) - toward("top", height * SHIFT) + toward("bottom", height * SHIFT)
    return pixel_to_gps(lat, lng, grid.zoom, F.lit(width), F.lit(height), px, py)


def view_box(lat: Column, lng: Column, grid: Grid, overlap: int = 0) -> Column:
    """struct(lat_min, lng_min, lat_max, lng_max) of the viewport centred on (lat, lng)."""
    width, height = F.lit(float(grid.width + 2 * overlap)), F.lit(float(grid.height + 2 * overlap))
    a = pixel_to_gps(lat, lng, grid.zoom, width, height, F.lit(0.0), F.lit(0.0))
    b = pixel_to_gps(lat, lng, grid.zoom, width, height, width, height)
    return F.struct(F.least(a[0], b[0]).alias("lat_min"), F.least(a[1], b[1]).alias("lng_min"), F.greatest(a[0], b[0]).alias("lat_max"), F.greatest(a[1], b[1]).alias("lng_max"))


def edge_sides(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, scale: Column) -> Column:
    """The sides of the image that a label comes within the margin of, in the order left, right, top, bottom."""
    margin = F.greatest(F.lit(24.0), 48.0 * scale)
    near = [("left", left <= margin), ("right", right >= width - margin), ("top", top <= margin), ("bottom", bottom >= height - margin)]
    return F.array_compact(F.array(*(F.when(cut, side) for side, cut in near)))


def in_core(x: Column, y: Column, core: tuple[Column, Column, Column, Column], slack: Column) -> Column:
    """Whether a point is in the core window grown by slack, borders included."""
    return x.between(core[0] - slack, core[2] + slack) & y.between(core[1] - slack, core[3] + slack)
