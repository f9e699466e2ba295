"""Removing POIs that repeat another within a few metres.

Longest names first, a POI is kept unless a kept one is nearer than the limit and has an equal or
similar name: the lexicographically first maximal independent set of the duplicate relation.
Pairs come from grid cells as large as the limit (each POI meets its own and the eight around
it), so the join is by equality, and the set is found by rounds over the edges alone: in each, a
POI with a kept rival is dropped and one without undecided or kept rivals is kept. Rounds are
written to the checkpoint folder.
"""

from __future__ import annotations

import difflib
from functools import lru_cache
from math import cos, degrees, radians

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.mercator import haversine
from ..functions.text import clean_name, strip
from ..sources.scratch import cut

LIMIT_M = 12.0
SIMILAR = 0.6
EARTH_M = 6_371_000.0


@lru_cache(1 << 16)
def _ratio(new: str, kept: str) -> float:
    return difflib.SequenceMatcher(None, new, kept).ratio()


@F.pandas_udf(DoubleType())
def name_ratio(new: pd.Series, kept: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; not symmetric, the new name comes first."""
    return pd.Series([_ratio(a, b) if a and b else 0.0 for a, b in zip(new, kept, strict=True)])


def _cells(lat: Column, lng: Column, limit_m: float, widest: float) -> tuple[Column, Column]:
    """Cells whose sides are the limit at least, up to the latitude widest."""
    side = degrees(limit_m / EARTH_M) * 1.0001
    return F.floor(lat / side), F.floor(lng / (side / max(0.01, cos(radians(widest)))))


def near_pairs(pois: DataFrame, key: str, limit_m: float = LIMIT_M) -> DataFrame:
    """Pairs of located POIs nearer than the limit, as (a, b, name_a, name_b), both ways round."""
    located = pois.where("lat is not null and lng is not null").withColumn("clean", clean_name(F.col("name")))
    widest = min(89.0, located.agg(F.max(F.abs("lat"))).first()[0] or 0.0)
    cy, cx = _cells(F.col("lat"), F.col("lng"), limit_m, widest)
    around = F.array(*(F.struct((F.col("cy") + dy).alias("cy"), (F.col("cx") + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    side = located.select(F.col(key).alias("k"), "clean", "lat", "lng", cy.alias("cy"), cx.alias("cx"))
    left = side.select("k", "clean", "lat", "lng", F.explode(around).alias("cell")).select("cell.*", F.col("k").alias("a"), F.col("clean").alias("name_a"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"))
    right = side.select("cy", "cx", F.col("k").alias("b"), F.col("clean").alias("name_b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))
    pairs = left.join(right, ["cy", "cx"]).where("a <> b")
    return pairs.where(haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"), EARTH_M) < limit_m).select("a", "b", "name_a", "name_b")


def _ordered(pois: DataFrame, key: str) -> DataFrame:
    """The order in which POIs are considered: longest raw name first, then as they came."""
    return pois.select(F.col(key).alias("k"), F.struct((-F.length(F.coalesce("name", F.lit("")))).alias("length"), F.col(key).alias("at")).alias("place"))


def duplicate_edges(pois: DataFrame, key: str, limit_m: float = LIMIT_M, similar: float | None = SIMILAR) -> DataFrame:
    """Edges (later, earlier): a POI and one considered before it that would make it a duplicate."""
    named = pois.where(strip(F.coalesce("name", F.lit(""))) != "")
    order = _ordered(named, key)
    pairs = near_pairs(named, key, limit_m).join(order.withColumnRenamed("k", "a").withColumnRenamed("place", "pa"), "a").join(order.withColumnRenamed("k", "b").withColumnRenamed("place", "pb"), "b")
    pairs = pairs.where("pb < pa").select(F.col("a").alias("later"), F.col("b").alias("earlier"), "name_a", "name_b")
    equal = pairs.where("name_a = name_b").select("later", "earlier")
    if similar is None:
        return equal
    # The ratio is at most twice the shorter length over both, so most pairs need no comparison.
    a, b = F.length("name_a"), F.length("name_b")
    maybe = pairs.where("name_a <> name_b").where(F.try_divide(2.0 * F.least(a, b), a + b) >= similar)
    return equal.unionAll(maybe.where(name_ratio("name_a", "name_b") >= similar).select("later", "earlier"))


def _twins(pois: DataFrame, key: str, limit_m: float) -> DataFrame:
    """POIs, as (k), with the clean name and the place of one that is considered before them. They are dropped whatever
    becomes of that one: if it is dropped, what is kept in its stead drops them too. They drop nothing, so no pair
    needs them, and many repeats at one place cost their number and not its square."""
    named = pois.where(strip(F.coalesce("name", F.lit(""))) != "").where(F.col(key).isNotNull())
    here = named.where((F.abs("lat") <= 90) & (F.abs("lng") < float("inf")))
    if limit_m <= 0:
        here = here.limit(0)
    place = _ordered(here, key)
    classed = here.select(F.col(key).alias("k"), clean_name(F.col("name")).alias("clean"), "lat", "lng").join(place, "k")
    first = classed.groupBy("clean", "lat", "lng").agg(F.min("place").alias("first"))
    return cut(classed.join(first, ["clean", "lat", "lng"]).where("place > first").select("k").distinct())


def dropped(edges: DataFrame) -> DataFrame:
    """Of edges(later, earlier) the POIs that the greedy pass drops, as (k)."""
    edges = cut(edges.distinct())
    nodes = edges.select(F.col("later").alias("k")).unionAll(edges.select("earlier")).distinct()
    state = cut(nodes.withColumn("s", F.lit(0)))  # 0 undecided, 1 kept, 2 dropped
    while True:
        rival = state.withColumnRenamed("k", "earlier").withColumnRenamed("s", "rs")
        seen = edges.join(rival, "earlier").groupBy(F.col("later").alias("k")).agg(F.max((F.col("rs") == 1).cast("int")).alias("kept"), F.max((F.col("rs") == 0).cast("int")).alias("open"))
        new = F.when(F.col("s") != 0, F.col("s")).when(F.col("kept") == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = cut(state.join(seen, "k", "left").select("k", new.alias("s")))
        if state.where("s = 0").isEmpty():
            return state.where("s = 2").select("k")


def dedupe(pois: DataFrame, key: str, limit_m: float = LIMIT_M, similar: float | None = SIMILAR) -> DataFrame:
    """POIs that stay. Those without coordinates or with blank names always do; similar=None compares equal names only."""
    twins = _twins(pois, key, limit_m)
    rest = pois.join(twins.withColumnRenamed("k", key), key, "left_anti")
    gone = twins.unionAll(dropped(duplicate_edges(rest, key, limit_m, similar)))
    return pois.join(gone.withColumnRenamed("k", key), key, "left_anti")


def merge_new(kept: DataFrame, new: DataFrame, key: str, limit_m: float = LIMIT_M, similar: float | None = SIMILAR) -> DataFrame:
    """The incremental pass: what is kept so far and the new POIs, deduplicated together. A POI that an
    earlier pass dropped does not come back, so this need not equal one pass over everything."""
    return dedupe(kept.unionByName(new), key, limit_m, similar)
