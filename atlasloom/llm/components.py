"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, discard, materialize, spread_join


def _beside(edges: DataFrame, least: DataFrame, rows: int, held: list[DataFrame]) -> DataFrame:
    """edges with the row of least of their end a. At most `rows` ends need no look at the table before it is broadcast."""
    if rows * 48 <= BROADCAST:
        return edges.join(F.broadcast(least), "a")
    held.append(materialize(least, "least"))
    return spread_join(edges, held[-1], "a", "degree", rows, held[-1].seen["n"])


def _large_star(edges: DataFrame, rows: int, held: list[DataFrame]) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    return _beside(both, least, 2 * rows, held).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame, rows: int, held: list[DataFrame]) -> DataFrame:
    """Edges point from the larger node a to the smaller node b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    joined = _beside(edges, least, rows, held).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """edges(a, b): long ids, any order. Returns (node, component) for every node that has an
    edge; component is the smallest node reachable. Each round is written to the shared folder;
    rounds grow with the logarithm of the number of nodes. A hub with a large share of all edges is
    not sent to one task. Rows with a null end and loops are ignored; no edges give no rows."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(ordered, tag)
    marks = {"hashed": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    mark, rows = None, current.seen["n"]
    while rows:
        held = [current]
        large = _large_star(current, rows, held)
        if rows * 48 > BROADCAST:  # else computing it again costs less than writing it
            large = materialize(large, tag)
            held.append(large)
        current = materialize(_small_star(large, rows, held), tag, **marks)
        discard(*held)
        rows = current.seen["n"]
        if current.seen == mark:
            break
        mark = current.seen
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
