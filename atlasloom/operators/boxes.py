"""Merging label boxes that overlap or line up, one tile at a time.

Merged boxes grow, and the first pair in order merges first, so the result depends on the order and is
not a set of connected components: each tile is one sequential task over its few boxes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame

OVERLAP = 0.65
NEAR = 35.0
LEVEL = 8.0
STACKED = 20.0

Box = tuple[float, float, float, float, float]  # x1, y1, x2, y2, confidence


def joins(a: Box, b: Box, scale: float = 1.0) -> bool:
    """Most of the smaller box is covered, or the middles are near and in line."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide > 0 and high > 0:
        least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
        if least > 0 and wide * high / least > OVERLAP:
            return True
    dx, dy = abs(a[0] + a[2] - b[0] - b[2]) / 2, abs(a[1] + a[3] - b[1] - b[3]) / 2
    if dx * dx + dy * dy >= (NEAR * scale) ** 2:
        return False
    return dy < LEVEL * scale or (dx < LEVEL * scale and dy < STACKED * scale)


def merge_boxes(boxes: list[Box], scale: float = 1.0) -> list[Box]:
    """Merge the first pair in order until none merges."""
    boxes = list(boxes)
    i = 0
    while i < len(boxes) - 1:
        a = boxes[i]
        j = next((j for j in range(i + 1, len(boxes)) if joins(a, boxes[j], scale)), 0)
        if j:
            b = boxes.pop(j)
            boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]))
            i = 0  # a grown box may now reach one before it
        else:
            i += 1
    return boxes


def merge_tiles(detections: DataFrame, scale: float = 1.0) -> DataFrame:
    """detections(tile, ordinal, x1, y1, x2, y2, confidence) to merged boxes, numbered anew within each tile.

    Tiles are small and many, so tasks read them in order, one after the other, rather than one call per tile.
    """
    names = ["x1", "y1", "x2", "y2", "confidence"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            yield from zip(pdf["tile"], *(pdf[c] for c in names), strict=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for tile, group in groupby(rows(batches), key=itemgetter(0)):
            out += [(tile, k, *box) for k, box in enumerate(merge_boxes([r[1:] for r in group], scale))]
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=["tile", "ordinal", *names])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["tile", "ordinal", *names])

    ordered = detections.repartition("tile").sortWithinPartitions("tile", "ordinal").select("tile", *names)
    return ordered.mapInPandas(run, "tile long, ordinal int, x1 double, y1 double, x2 double, y2 double, confidence double")
