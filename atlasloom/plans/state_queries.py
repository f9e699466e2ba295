"""Queries over areas, tile states, boxes and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import areas as ar
from ..operators import boxes as bx
from ..operators import dedupe as dd
from ..operators import matching, tiles
from ..sources import sinks
from .geo_queries import _haversine, _lat, _lng, _x, _y
from .registry import query
from .text_sql import F1_SQL, fold_sql, slug_sql, strip_admin_sql
from .views import AREAS, BOXES, COARSE, POIS, STATES, TILE_EVENTS, areas, boxes, pois, table, tile_events

FRONTIER = "tx * tx + ty * ty, abs(tx), ty, tx"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.fold_state(tile_events(spark, sf_dir))


@query("SELECT area_id, tx, ty, status, n_events FROM states", TILE_EVENTS, STATES)
def tile_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir)


@query(
    """SELECT area_id, count(*) AS total, count(*) FILTER (status IN ('visited', 'discarded')) AS done, count(*) FILTER (status = 'captured') AS captured, count(*) FILTER (status = 'queued') AS queued,
    greatest(0, count(*) - count(*) FILTER (status IN ('visited', 'discarded')) - count(*) FILTER (status = 'queued')) AS pending,
    round(100.0::DOUBLE * count(*) FILTER (status IN ('visited', 'discarded')) / count(*), 1) AS pct FROM states GROUP BY area_id""",
    TILE_EVENTS,
    STATES,
)
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.scan_stats(states(spark, sf_dir))


@query(f"SELECT area_id, tx, ty, CAST(row_number() OVER (PARTITION BY area_id ORDER BY {FRONTIER}) AS INTEGER) AS place FROM states", TILE_EVENTS, STATES)
def frontier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.frontier_rank(states(spark, sf_dir).select("area_id", "tx", "ty"))


@query(f"SELECT tx, ty FROM (SELECT DISTINCT tx, ty FROM states WHERE status = 'queued') ORDER BY {FRONTIER} LIMIT 7", TILE_EVENTS, STATES)
def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.next_tiles(states(spark, sf_dir).where("status = 'queued'").select("tx", "ty").distinct(), 7)


@query(
    """SELECT DISTINCT area_id, tx, ty FROM (SELECT s.area_id, CAST(s.tx + dx AS INTEGER) AS tx, CAST(s.ty + dy AS INTEGER) AS ty FROM states s, (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b WHERE status = 'captured' AND (dx <> 0 OR dy <> 0))
    SEMI JOIN states USING (area_id, tx, ty) ANTI JOIN (SELECT area_id, tx, ty FROM states WHERE status IN ('visited', 'discarded')) USING (area_id, tx, ty)""",
    TILE_EVENTS,
    STATES,
)
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    return tiles.neighbours(s.where("status = 'captured'"), s, s.where("status = 'visited'"), s.where("status = 'discarded'"))


@query(
    f"""SELECT area_id, tx, ty, status = 'queued' AS was_queued, CAST(row_number() OVER (PARTITION BY area_id ORDER BY status <> 'queued', {FRONTIER}) AS INTEGER) AS place FROM states WHERE status NOT IN ('visited', 'discarded')""",
    TILE_EVENTS,
    STATES,
)
def resume_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    return tiles.resume(s, s.where("status = 'visited'"), s.where("status = 'queued'"), s.where("status = 'discarded'"))


@query("SELECT area_id, tx, ty FROM (SELECT DISTINCT area_id, tx, ty FROM tile_events WHERE status = 'queued') ANTI JOIN (SELECT DISTINCT area_id, tx, ty FROM tile_events WHERE status = 'visited') USING (area_id, tx, ty)", TILE_EVENTS)
def pending_tiles_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tile_events(spark, sf_dir)
    key = tiles.KEY
    return e.where("status = 'queued'").select(*key).distinct().join(e.where("status = 'visited'").select(*key), key, "left_anti")


_BARE = strip_admin_sql("district")
_ORDER = (
    f"CASE WHEN province = 'Thành phố Hồ Chí Minh' THEN 0 ELSE 1 END, CASE WHEN province = 'Thành phố Hồ Chí Minh' THEN '' ELSE lower({strip_admin_sql('province')}) END, "
    "CASE WHEN starts_with(district, 'Quận ') THEN 0 WHEN starts_with(district, 'Thành phố ') THEN 1 WHEN starts_with(district, 'Thị xã ') THEN 2 WHEN starts_with(district, 'Huyện ') THEN 3 ELSE 9 END, "
    f"TRY_CAST({_BARE} AS INTEGER) IS NULL, TRY_CAST({_BARE} AS INTEGER) NULLS FIRST, lower({_BARE}), area_no"
)
RANKED = f"ranked AS (SELECT area_no, province, district, CAST(row_number() OVER (ORDER BY {_ORDER}) - 1 AS INTEGER) AS place FROM areas)"


@query("SELECT area_no, province, district, place FROM ranked", AREAS, RANKED)
def area_manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.ranked_areas(areas(spark, sf_dir), "area_no").select("area_no", "province", "district", "place")


@query("SELECT area_no, place FROM ranked WHERE place >= 2 AND contains(lower(province), 'tinh a') = false AND contains(" + fold_sql("province") + ", 'tinh a') ORDER BY place LIMIT 4", AREAS, RANKED)
def area_filter_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ar.ranked_areas(areas(spark, sf_dir), "area_no")
    return ar.select_areas(ranked, province="Tỉnh A", start=2, most=4).select("area_no", "place")


@query(
    f"""SELECT a.area_no, coalesce(c1.lat, c2.lat, CASE WHEN a.area_no % 4 <> 3 THEN 1.5::DOUBLE + a.area_no END) AS center_lat FROM areas a
    LEFT JOIN centres c1 ON c1.key = {slug_sql('a.province')} || '/' || {slug_sql('a.district')} LEFT JOIN centres c2 ON c2.path = 'b/' || a.area_no || '.geojson'
    WHERE coalesce(c1.lat, c2.lat, CASE WHEN a.area_no % 4 <> 3 THEN 1.5::DOUBLE + a.area_no END) IS NOT NULL""",
    AREAS,
    f"centres AS (SELECT CASE WHEN area_no % 3 = 0 THEN {slug_sql('province')} || '/' || {slug_sql('district')} ELSE 'other/' || area_no END AS key, 10.0::DOUBLE + area_no AS lat, CASE WHEN area_no % 3 = 1 THEN 'b/' || area_no || '.geojson' ELSE '' END AS path FROM areas)",
)
def center_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = areas(spark, sf_dir)
    no = F.col("area_no")
    key = F.when(no % 3 == 0, t.centre_key(F.col("province"), F.col("district"))).otherwise(F.concat(F.lit("other/"), no.cast("string")))
    path = F.when(no % 3 == 1, F.concat(F.lit(" B\\"), no.cast("string"), F.lit(".geojson"))).otherwise("")
    centres = a.select(key.alias("key"), (10.0 + no).alias("center_lat"), F.lit(0.0).alias("center_lng"), path.alias("boundary_path"))
    centroid = F.when(no % 4 != 3, F.array(1.5 + no, F.lit(2.0)))
    listed = a.withColumn("boundary_path", F.concat(F.lit("b/"), no.cast("string"), F.lit(".geojson"))).withColumn("centroid", centroid)
    return ar.with_centres(listed, centres).select("area_no", "center_lat")


_PAIRS = f"""pairs AS (SELECT a.ordinal AS later, b.ordinal AS earlier FROM pois a JOIN pois b ON a.ordinal <> b.ordinal AND abs(a.lat - b.lat) < 0.001 AND abs(a.lng - b.lng) < 0.001
 AND regexp_replace({fold_sql('a.name')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') = regexp_replace({fold_sql('b.name')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AND (length(b.name) > length(a.name) OR (length(b.name) = length(a.name) AND b.ordinal < a.ordinal))
 WHERE {_haversine('a.lat', 'a.lng', 'b.lat', 'b.lng', '6371000.0')} < 12)"""


@query("SELECT later, earlier FROM pairs", POIS, _PAIRS)
def dedupe_pairs_12m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.duplicate_edges(pois(spark, sf_dir), "ordinal", similar=None).select("later", "earlier")


@query()
def dedupe_exact_12m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedupe(pois(spark, sf_dir), "ordinal", similar=None)


@query()
def dedupe_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedupe(pois(spark, sf_dir), "ordinal")


@query()
def dedupe_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pois(spark, sf_dir)
    first = dd.dedupe(p.where("ordinal % 2 = 0"), "ordinal")
    return dd.merge_new(first, p.where("ordinal % 2 = 1"), "ordinal")


@query()
def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bx.merge_tiles(boxes(spark, sf_dir))


_LABELS = (
    "labels_by_tile AS (SELECT p_partkey // 40 AS tile, p_partkey AS ordinal, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE split_part(p_name, ' ', 1) END AS label, "
    "10.75::DOUBLE + (p_partkey % 7) * 0.0001::DOUBLE AS lat, 106.7::DOUBLE AS lng, 'dom' AS source FROM part), "
    "own AS (SELECT p_partkey AS poi, (p_partkey + 20) // 40 AS tile, p_name AS name, 10.75::DOUBLE + (p_partkey % 5) * 0.0001::DOUBLE AS lat, 106.7::DOUBLE AS lng FROM part)"
)


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    label = F.when(key % 3 == 0, F.col("p_name")).when(key % 3 == 1, F.upper("p_name")).otherwise(F.element_at(F.split("p_name", " "), 1))
    labels = part.select(F.expr("p_partkey div 40").alias("tile"), key.alias("ordinal"), label.alias("label"), (10.75 + (key % 7) * F.lit(0.0001)).alias("lat"), F.lit(106.7).alias("lng"), F.lit("dom").alias("source"))
    own = part.select(key.alias("poi"), F.expr("(p_partkey + 20) div 40").alias("tile"), F.col("p_name").alias("name"), (10.75 + (key % 5) * F.lit(0.0001)).alias("lat"), F.lit(106.7).alias("lng"))
    return own, labels


@query(
    """SELECT poi, tile, name, label, CAST(coalesce(tier, 0) AS INTEGER) AS tier FROM (SELECT o.poi, o.tile, o.name, l.label, l.tier, row_number() OVER (PARTITION BY o.poi ORDER BY l.tier, l.ordinal) AS rn FROM own o LEFT JOIN
    (SELECT poi, b.ordinal, b.label, CASE WHEN name = b.label THEN 1 WHEN lower(name) = lower(b.label) THEN 2 WHEN length(b.label) > 3 AND (contains(lower(name), lower(b.label)) OR contains(lower(b.label), lower(name))) THEN 3 END AS tier
     FROM own JOIN labels_by_tile b USING (tile)) l ON o.poi = l.poi AND l.tier IS NOT NULL) WHERE rn = 1""",
    _LABELS,
)
def dom_soft_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, labels = _labels(spark, sf_dir)
    return matching.soft_match(own.select("poi", "tile", "name"), labels.select("tile", "ordinal", "label"), "poi").select("poi", "tile", "name", "label", F.coalesce("tier", F.lit(0)).alias("tier"))


_KEY = f"array_to_string(list_transform(regexp_extract_all(label, '{t.TOKEN}', 0), lambda w: {fold_sql('w')}), ' ')"


@query(f"SELECT tile, label_key, min(ordinal) AS ordinal, arg_min(label, ordinal) AS label FROM (SELECT *, {_KEY} AS label_key FROM labels_by_tile) WHERE label_key <> '' GROUP BY tile, label_key", _LABELS)
def nearby_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.first_spellings(_labels(spark, sf_dir)[1])


_TOK = lambda c: f"list_transform(regexp_extract_all({c}, '{t.TOKEN}', 0), lambda w: {fold_sql('w')})"
_LADDER = f"""
first AS (SELECT tile, ordinal, label, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY tile, {_KEY} ORDER BY ordinal) AS rn FROM labels_by_tile WHERE {_KEY} <> '') WHERE rn = 1),
scored AS (SELECT poi, name, label, ordinal, m, f1, greatest(0, least(1, 0.62::DOUBLE * f1 + 0.38::DOUBLE * f1 + CASE WHEN m <= 15 THEN 0.05::DOUBLE WHEN m <= 40 THEN 0.03::DOUBLE WHEN m <= 80 THEN 0.01::DOUBLE ELSE -0.04::DOUBLE END)) AS s FROM
 (SELECT o.poi, o.name, f.label, f.ordinal, sqrt(pow((f.lat - o.lat) * 111320, 2) + pow((f.lng - o.lng) * 111320 * cos(radians(o.lat)), 2)) AS m, {F1_SQL(_TOK('o.name'), _TOK('f.label'))} AS f1 FROM own o JOIN first f USING (tile))),
best AS (SELECT poi, label, m, s, f1 FROM (SELECT *, row_number() OVER (PARTITION BY poi ORDER BY s DESC, ordinal) AS rn FROM scored WHERE s > 0) WHERE rn = 1),
x AS (SELECT o.poi, o.name, b.label, b.m, b.f1, coalesce(b.s, 0) AS s, len({_TOK('o.name')}) AS n, len({_TOK("coalesce(b.label, '')")}) AS c FROM own o LEFT JOIN best b USING (poi)),
y AS (SELECT *, CASE WHEN n = 0 THEN 'no_tokens' WHEN m <= 18 AND s >= CASE WHEN n >= 3 AND c >= 3 THEN 0.30 ELSE 0.62 END THEN 'spatial_exact_fuzzy_match'
 WHEN label IS NOT NULL AND s >= 0.94 AND abs(n - c) <= 2 AND (c <= n OR f1 >= 0.86) THEN 'high_confidence_nearby_match'
 WHEN n <= 1 AND length(name) <= 4 THEN 'short_ocr' WHEN label IS NOT NULL AND s >= 0.86 THEN 'nearby_match_below_accept_threshold' ELSE 'clean_ocr_no_nearby_match' END AS reason FROM x)"""


@query("SELECT poi, CASE WHEN reason LIKE '%match' AND reason NOT LIKE 'clean%' THEN label ELSE name END AS selected, round(s, 6) AS score, reason FROM y", _LABELS, _LADDER)
def canonical_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the test tables are lower case words, so the rungs for brands and odd single words are left to tests."""
    own, labels = _labels(spark, sf_dir)
    return matching.resolve_names(own, labels, "poi").select("poi", "selected", F.round("score", 6).alias("score"), "reason")


_OLD = "regexp_replace(lower(left(p_name, 9)), '[^a-z0-9]+', '', 'g')"
_NEW = "regexp_replace(lower(q_name), '[^a-z0-9]+', '', 'g')"


@query(
    f"""SELECT poi, candidate, CAST(gain AS INTEGER) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY poi ORDER BY gain DESC, ordinal) AS rn FROM
    (SELECT poi, ordinal, candidate, length(n) - length(o) + CASE WHEN contains(n, o) OR contains(o, n) THEN 20 ELSE 0 END + CASE WHEN length(o) >= 8 AND length(n) >= 8 AND left(o, 8) = left(n, 8) THEN 12 ELSE 0 END AS gain, n, o
     FROM (SELECT a.p_partkey AS poi, b.p_partkey AS ordinal, b.p_name AS candidate, {_OLD.replace('p_name', 'a.p_name')} AS o, {_NEW.replace('q_name', 'b.p_name')} AS n FROM part a JOIN part b ON a.p_partkey // 40 = b.p_partkey // 40)
     WHERE o <> '' AND n <> '' AND NOT starts_with(n, 'unknown') AND (length(n) > length(o) + 2 OR contains(n, o) OR contains(o, n))) WHERE gain > 0) WHERE rn = 1"""
)
def rescue_candidate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.expr("p_partkey div 40").alias("tile"))
    pairs = part.select("tile", F.col("k").alias("poi"), F.left("name", F.lit(9)).alias("old_name")).join(part.select("tile", F.col("k").alias("ordinal"), F.col("name").alias("candidate")), "tile")
    return matching.pick_rescue(pairs, "poi")


@query(
    """SELECT l_orderkey AS poi, l_linenumber AS ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS rn FROM
    (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 97 + l_quantity AS BIGINT) AS score FROM lineitem)) WHERE rn = 1"""
)
def best_variant_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("poi"), F.col("l_linenumber").alias("ordinal"), (F.col("l_partkey") % 97 + F.col("l_quantity")).cast("long").alias("score"))
    return matching.best_variants(readings, ["poi"], "score", "ordinal", "ordinal")


_Y0, _X0 = _y(f"{COARSE.lat!r}::DOUBLE", 18), _x(f"{COARSE.lng!r}::DOUBLE", 18)
_CORNER = {
    "lat_min": _lat(f"{_Y0} + (ty + 0.5) * 4.21875::DOUBLE", 18),
    "lng_min": _lng(f"{_X0} + (tx - 0.5) * 7.5::DOUBLE", 18),
    "lat_max": _lat(f"{_Y0} + (ty - 0.5) * 4.21875::DOUBLE", 18),
    "lng_max": _lng(f"{_X0} + (tx + 0.5) * 7.5::DOUBLE", 18),
}


@query("SELECT area_id, tx, ty, status, " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _CORNER.items()) + ", 5 AS n_points FROM states WHERE status <> 'queued'", TILE_EVENTS, STATES)
def geojson_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sinks.tile_features(states(spark, sf_dir), COARSE)
    ring = F.get("ring", F.lit(0))
    top = F.get("ring", F.lit(2))
    return f.select("area_id", "tx", "ty", "status", F.round(ring[1], 6).alias("lat_min"), F.round(ring[0], 6).alias("lng_min"), F.round(top[1], 6).alias("lat_max"), F.round(top[0], 6).alias("lng_max"), F.size("ring").alias("n_points"))


@query(
    """SELECT title_poi, ten_dia_diem, toa_do, quan_huyen_xa, tinh_thanh_pho, crop_image, tile_x, tile_y FROM (SELECT trim(p_name) AS title_poi, trim(p_name) AS ten_dia_diem,
    CASE WHEN p_partkey % 9 = 0 THEN '' ELSE format('{:.6f}, {:.6f}', 10.0::DOUBLE + p_size, 106.0::DOUBLE + p_size) END AS toa_do, 'Q' || (p_partkey % 5) AS quan_huyen_xa, 'HCM' AS tinh_thanh_pho,
    'crops/' || p_partkey || '.png' AS crop_image, CAST(p_size AS VARCHAR) AS tile_x, CAST(p_size + 1 AS VARCHAR) AS tile_y FROM part) WHERE title_poi <> ''"""
)
def clean_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    there = F.col("p_partkey") % 9 != 0
    records = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"),
        F.when(there, 10.0 + size).alias("approx_lat"),
        F.when(there, 106.0 + size).alias("approx_lng"),
        F.lit(None).cast("string").alias("ward"),
        F.concat(F.lit("Q"), (F.col("p_partkey") % 5).cast("string")).alias("district"),
        F.lit("HCM").alias("province"),
        F.concat(F.lit("crops\\"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("crop_image"),
        size.alias("tile_x"),
        (size + 1).alias("tile_y"),
    )
    return sinks.clean_rows(records)
