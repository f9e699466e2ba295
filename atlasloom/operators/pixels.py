"""Pixel operators over captured images: an extension point, and the parts that need no vision library.

map_images() hands decoded arrays to any function, a batch of files at a time; detectors and readers of text plug in there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE_SCORE = 78.0
SIDE_MARGIN = 12.0
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray | None:
    """Height x width x channels of an 8-bit, non-interlaced PNG; None for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        return None
    width, height, depth = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height, width * depth), dtype=np.uint8)
    above = np.zeros(width * depth, dtype=np.uint8)
    for y in range(height):
        out[y] = above = _unfilter(rows[y, 0], rows[y, 1:], above, depth)
    return out.reshape(height, width, depth)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, depth), axis=0, dtype=np.uint8).reshape(-1)
    line, up = row.astype(int), above.astype(int)
    for x in range(len(line)):
        left, corner = (line[x - depth], up[x - depth]) if x >= depth else (0, 0)
        if kind == 3:
            guess = (left + up[x]) // 2
        else:
            p = left + up[x] - corner
            guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
        line[x] = (line[x] + guess) & 255
    return line.astype(np.uint8)


def map_images(images: DataFrame, f: Callable[[str, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """f(path, pixels) for every file that decodes; images(path, content) as from sources.read_images."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for path, data in zip(pdf["path"], pdf["content"], strict=True) if (x := decode_png(bytes(data))) is not None for row in f(path, x)]
            yield pd.DataFrame(rows, columns=names)

    return images.select("path", "content").mapInPandas(run, schema)


def bands(mask: np.ndarray, gap: int = 1, least: int = 1) -> list[tuple[int, int]]:
    """Runs of true values; runs closer than gap are one, runs shorter than least are none."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    out: list[list[int]] = []
    for i, j in edges.reshape(-1, 2).tolist():
        if out and i - out[-1][1] < gap:
            out[-1][1] = j
        else:
            out.append([i, j])
    return [(i, j) for i, j in out if j - i >= least]


def text_lines(gray: np.ndarray, contrast: int = 60, gap: int = 2, least: int = 4) -> list[tuple[int, int]]:
    """Rows of an image that hold ink: pixels that differ from the background, its median."""
    ink = np.abs(gray.astype(int) - int(np.median(gray))) >= contrast
    return bands(ink.any(axis=1), gap, least)


def box_groups(boxes: np.ndarray, near_x: float, near_y: float) -> np.ndarray:
    """The group of each box (x1, y1, x2, y2): boxes whose gaps are within the limits are joined, directly or not."""
    apart = lambda a, b: np.maximum(0, np.maximum(boxes[:, None, a] - boxes[None, :, b], boxes[None, :, a] - boxes[:, None, b]))
    near = (apart(0, 2) <= near_x) & (apart(1, 3) <= near_y)
    label = np.arange(len(boxes))
    while len(boxes):
        least = np.where(near, label[None, :], len(boxes)).min(axis=1)
        if np.array_equal(least, label):
            break
        label = least
    return label


def icon_side(left: Column, right: Column, top: Column) -> Column:
    """The side with the best icon score, if it is high and clearly ahead of the second; null otherwise."""
    ranked = F.sort_array(F.array(F.struct(left.alias("s"), F.lit("left").alias("side")), F.struct(right.alias("s"), F.lit("right").alias("side")), F.struct(top.alias("s"), F.lit("top").alias("side"))), asc=False)
    best, second = ranked[0], ranked[1]
    return F.when((best["s"] >= SIDE_SCORE) & (best["s"] - second["s"] >= SIDE_MARGIN), best["side"])
