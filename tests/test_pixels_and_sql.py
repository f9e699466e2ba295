"""Pixel operators and the functions registered for SQL."""

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from atlasloom.functions.register import register
from atlasloom.operators import pixels
from atlasloom.sources.readers import read_images


def png(x: np.ndarray, kinds=(0, 1, 2, 3, 4)) -> bytes:
    """An RGB image with each kind of row filter."""
    flat = x.reshape(len(x), -1).astype(int)
    rows = b""
    for y, line in enumerate(flat):
        kind, up = kinds[y % len(kinds)], flat[y - 1] if y else np.zeros_like(line)
        left, corner = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        paeth = [min((abs(a - b), i, b) for i, b in enumerate(c))[2] for a, *c in zip(p, left, up, corner, strict=True)]
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: np.array(paeth)}[kind]
        rows += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    x = np.random.default_rng(0).integers(0, 256, (11, 7, 3))
    assert (pixels.decode_png(png(x)) == x).all() and pixels.decode_png(b"GIF") is None
    (tmp_path / "a.png").write_bytes(png(x))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = pixels.map_images(read_images(spark, str(tmp_path)), lambda path, a: [(path[-5:], int(a.sum()))], "name string, total long").collect()
    assert [tuple(r) for r in got] == [("a.png", int(x.sum()))]


def test_bands_and_groups():
    assert pixels.bands(np.array([0, 1, 1, 0, 1, 0, 0, 1], bool), gap=2) == [(1, 5), (7, 8)]
    gray = np.full((20, 9), 200)
    gray[3:8, 2] = gray[12:18, 4] = 20
    assert pixels.text_lines(gray) == [(3, 8), (12, 18)]
    assert pixels.box_groups(np.array([[0, 0, 2, 2], [3, 0, 5, 2], [6, 0, 8, 2], [50, 0, 52, 2]]), 1, 1).tolist() == [0, 0, 0, 3]


def test_icon_side(spark):
    row = spark.createDataFrame([(90.0, 10.0, 20.0), (90.0, 80.0, 1.0), (50.0, 1.0, 1.0)], "l double, r double, t double").select(pixels.icon_side(F.col("l"), F.col("r"), F.col("t"))).collect()
    assert [r[0] for r in row] == ["left", None, None]


def test_sql_functions(spark):
    names = register(spark)
    row = spark.sql("SELECT vn_fold('Đường') f, slugify('Quận 1') s, size(vn_tokens('a b')) n, round(haversine_m(0, 0, 0, 1)) h, lat_lng_to_tile(10.779855797443227, 106.69984398140998) t, tile_bbox(0, 0).lat_min < tile_center(0, 0).lat b, clean_final_text('Bình Bình Quán') c, name_similarity('ab', 'ab') r").first()
    assert (row.f, row.s, row.n, row.h, tuple(row.t), row.b, row.c, row.r) == ("duong", "quan_1", 2, 111195.0, (0, 0), True, "Bình Quán", 1.0)
    square = json.dumps({"type": "Polygon", "coordinates": [[[106.69, 10.77], [106.71, 10.77], [106.71, 10.79], [106.69, 10.79]]]})
    assert spark.sql(f"SELECT * FROM tiles_for_boundary('{square}', 10.78, 106.70, 16)").count() > 0
    assert len(names) == len(set(names)) == 23
    row = spark.sql(f"SELECT token_f1('Quán Phở', 'quan pho Hòa') f, is_junk_line('4.5 (12)') j, is_junk_line('Quán Phở') k, point_in_polygon(10.78, 106.70, '{square}') i, point_in_polygon(10.80, 106.70, '{square}') o, point_in_polygon(NULL, 106.70, '{square}') n, char_similarity('pho bo', 'pho boo') c").first()
    assert (row.f, row.j, row.k, row.i, row.o, row.n) == (0.8, True, False, True, False, None) and abs(row.c - 12 / 13) < 1e-9
