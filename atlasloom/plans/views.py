"""Inputs that the registered queries read, built alike in Spark and in SQL from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mercator import Grid
from ..functions.text import TOKEN
from ..operators.geofence import rings_to_edges

GRID = Grid()
COARSE = Grid(zoom=18)

#: Two made-up areas: a concave one, and one of two parts. Points are (lng, lat).
RINGS = {
    ("core", 0): ((106.684, 10.752), (106.709, 10.753), (106.708, 10.771), (106.699, 10.763), (106.694, 10.782), (106.686, 10.785), (106.688, 10.768)),
    ("isles", 0): ((106.700, 10.775), (106.711, 10.774), (106.712, 10.788), (106.703, 10.789)),
    ("isles", 1): ((106.681, 10.751), (106.6835, 10.7515), (106.682, 10.757)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession) -> DataFrame:
    rows = [(a, r, [{"x": x, "y": y} for x, y in pts]) for (a, r), pts in RINGS.items()]
    return rings_to_edges(spark.createDataFrame(rows, "area_id string, ring_id int, points array<struct<x: double, y: double>>"))


def edges_sql() -> str:
    rows = []
    for (a, r), pts in RINGS.items():
        for k, (x, y) in enumerate(pts):
            x2, y2 = pts[(k + 1) % len(pts)]
            rows.append(f"('{a}', {r}, {k}, {x}::DOUBLE, {y}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return "edges(area_id, ring_id, seq, x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lat, lng = 10.75 + (key % 211) * F.lit(0.0002), 106.68 + (key * 7 % 173) * F.lit(0.0002)
    return table(spark, sf_dir, "customer").select(key.alias("pid"), F.col("c_name").alias("name"), lat.alias("lat"), lng.alias("lng"))


PTS = "pts AS (SELECT c_custkey AS pid, c_name AS name, 10.75::DOUBLE + (c_custkey % 211) * 0.0002::DOUBLE AS lat, 106.68::DOUBLE + (c_custkey * 7 % 173) * 0.0002::DOUBLE AS lng FROM customer)"


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at coarse places, so that many share a few metres; a few have no coordinates."""
    key = F.col("p_partkey")
    lat = F.when(key % 97 != 0, 10.75 + F.floor(key % 400 / 4) * F.lit(0.0005) + (key % 3) * F.lit(0.00003))
    lng = 106.68 + F.floor(key % 60 / 6) * F.lit(0.0005) + (key % 2) * F.lit(0.00004)
    return table(spark, sf_dir, "part").select(key.alias("ordinal"), F.col("p_name").alias("name"), lat.alias("lat"), lng.alias("lng"))


POIS = (
    "pois AS (SELECT p_partkey AS ordinal, p_name AS name, "
    "CASE WHEN p_partkey % 97 <> 0 THEN 10.75::DOUBLE + floor((p_partkey % 400) / 4) * 0.0005::DOUBLE + (p_partkey % 3) * 0.00003::DOUBLE END AS lat, "
    "106.68::DOUBLE + floor((p_partkey % 60) / 6) * 0.0005::DOUBLE + (p_partkey % 2) * 0.00004::DOUBLE AS lng FROM part)"
)


def by_id(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents whose id no other has, each of which is a whole text, and those with repeated ids, if there are any."""
    repeated = documents.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    n = repeated.count()
    if not n:
        return documents, None
    repeated = F.broadcast(repeated) if n <= 1_000_000 else repeated
    return documents.join(repeated, "doc_id", "left_anti"), documents.join(repeated, "doc_id", "left_semi")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = "lines AS (SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each document."""
    return words_of(table(spark, sf_dir, "documents"))


def words_of(documents: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    return documents.select("doc_id", F.posexplode(found).alias("at", "word"))


WORDS = (
    f"words AS (SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS \"at\", unnest(p) AS word "
    f"FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}', 0) AS p FROM documents WHERE text IS NOT NULL))"
)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for every five words of each document, numbered by name_no: three words, a slash, and two more; in every
    seventh document with a rating before it. A document without words has one label."""
    return names_of(table(spark, sf_dir, "documents"))


def names_of(documents: DataFrame) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    found = documents.where("text is not null").select("doc_id", w.alias("w"))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(5)), lambda i: F.slice("w", i + 1, 5))
    found = found.select("doc_id", F.posexplode(groups).alias("name_no", "g"))
    label = F.concat_ws(" / ", F.array_join(F.slice("g", 1, 3), " "), F.array_join(F.slice("g", 4, 2), " "))
    label = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("4.5 (12K) · "), label)).otherwise(label)
    return found.select("doc_id", "name_no", label.alias("label"))


NAMES = (
    WORDS + ", names AS (SELECT doc_id, name_no, CASE WHEN doc_id % 7 = 0 THEN '4.5 (12K) · ' || l ELSE l END AS label FROM ("
    "SELECT doc_id, \"at\" // 5 AS name_no, string_agg(word, ' ' ORDER BY \"at\") FILTER (\"at\" % 5 < 3) || ' / ' || coalesce(string_agg(word, ' ' ORDER BY \"at\") FILTER (\"at\" % 5 > 2), '') AS l FROM words GROUP BY 1, 2 "
    "UNION ALL SELECT doc_id, 0, ' / ' FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM words)))"
)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as districts of their regions, with prefixes and numbers that the order must handle."""
    key = F.col("n_nationkey")
    district = (
        F.when(key % 5 == 0, F.concat(F.lit("Quận "), F.col("n_nationkey").cast("string")))
        .when(key % 5 == 1, F.concat(F.lit("Huyện "), F.initcap("n_name")))
        .when(key % 5 == 2, F.concat(F.lit("Thành phố "), F.initcap("n_name")))
        .when(key % 5 == 3, F.concat(F.lit("Thị xã "), F.initcap("n_name")))
        .otherwise(F.col("n_name"))
    )
    province = F.when(F.col("n_regionkey") == 3, "Thành phố Hồ Chí Minh").otherwise(F.concat(F.lit("Tỉnh "), F.col("r_name")))
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(key.alias("area_no"), province.alias("province"), district.alias("district"))


AREAS = (
    "areas AS (SELECT n_nationkey AS area_no, CASE WHEN n_regionkey = 3 THEN 'Thành phố Hồ Chí Minh' ELSE 'Tỉnh ' || r_name END AS province, "
    "CASE n_nationkey % 5 WHEN 0 THEN 'Quận ' || n_nationkey WHEN 1 THEN 'Huyện ' || t WHEN 2 THEN 'Thành phố ' || t WHEN 3 THEN 'Thị xã ' || t ELSE n_name END AS district "
    "FROM (SELECT *, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS t FROM nation JOIN region ON n_regionkey = r_regionkey))"
)


def tile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "captured").when(F.col("event_type") == "error", "discarded").otherwise("visited")
    user = F.col("user_id")
    area = F.concat(F.lit("a"), (user % 3).cast("string"))
    return table(spark, sf_dir, "events").select(area.alias("area_id"), (user % 23 - 11).cast("int").alias("tx"), (user % 17 - 8).cast("int").alias("ty"), status.alias("status"), "ts", "event_id")


TILE_EVENTS = (
    "tile_events AS (SELECT 'a' || (user_id % 3) AS area_id, CAST(user_id % 23 - 11 AS INTEGER) AS tx, CAST(user_id % 17 - 8 AS INTEGER) AS ty, "
    "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'captured' WHEN 'error' THEN 'discarded' ELSE 'visited' END AS status, ts, event_id FROM events)"
)
STATES = "states AS (SELECT area_id, tx, ty, arg_max(status, (ts, event_id)) AS status, count(*) AS n_events FROM tile_events GROUP BY ALL)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as label boxes; an order is a tile."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x1 = (part * 13 % 1800).cast("double")
    y1 = ((supp * 29 + line * 7) % 1000).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tile"), line.alias("ordinal"), x1.alias("x1"), y1.alias("y1"), (x1 + 20 + part % 60).alias("x2"), (y1 + 8 + F.col("l_quantity") % 20).alias("y2"), F.round(F.col("l_discount") * 10, 4).alias("confidence")
    )


BOXES = (
    "boxes AS (SELECT tile, ordinal, x1, y1, x1 + 20 + l_partkey % 60 AS x2, y1 + 8 + l_quantity % 20 AS y2, round(l_discount * 10, 4) AS confidence FROM (SELECT l_orderkey AS tile, l_linenumber AS ordinal, "
    "CAST(l_partkey * 13 % 1800 AS DOUBLE) AS x1, CAST((l_suppkey * 29 + l_linenumber * 7) % 1000 AS DOUBLE) AS y1, l_partkey, l_quantity, l_discount FROM lineitem))"
)
