"""Matching, deduplication, boxes, dictionaries, sources, sinks and streams on small data."""

import difflib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from atlasloom.functions import text as t
from atlasloom.functions.lexicon import fold
from atlasloom.functions.mercator import Grid
from atlasloom.operators import boxes, dedupe, dictionary, matching
from atlasloom.sources import readers, sinks
from atlasloom.streaming import tiles as stream


def resolve(spark, name, nearby, lat=None, lng=None, **limits):
    pois = spark.createDataFrame([(1, 0, name, lat, lng)], "poi int, tile int, name string, lat double, lng double")
    there = spark.createDataFrame([(0, k, *n) for k, n in enumerate(nearby)], "tile int, ordinal int, label string, lat double, lng double, source string")
    return matching.resolve_names(pois, there, "poi", **limits).first()


def test_ladder(spark):
    here = (10.00001, 106.00001)
    near = resolve(spark, "Poarx", [("VPbank", 10.0, 106.0, "dom")], *here)
    assert (near.selected, near.action, near.reason) == ("Poarx", "keep_ocr", "clean_ocr_no_nearby_match") or near.reason == "spatial_exact_short_ocr"
    assert resolve(spark, "Poarx", [("VPbank", None, None, "dom")]).action == "keep_ocr"
    fuzzy = resolve(spark, "Starbucks Plaza Sài Gòn", [("Starbucks mPlaza Sài Gòn", 10.0, 106.0, "dom")], *here)
    assert (fuzzy.action, fuzzy.reason) == ("use_canonical", "spatial_exact_fuzzy_match")
    assert resolve(spark, "Nice Weather", [("Nice Waether The Coffee shop", None, None, "dom")]).action == "keep_ocr"
    assert resolve(spark, "Some Name", []).reason == "clean_ocr_no_nearby_match"
    assert resolve(spark, "  ", []).reason == "empty_ocr"
    assert resolve(spark, "???", []).reason == "no_tokens"
    assert resolve(spark, "Ab", []).reason == "short_ocr"
    assert resolve(spark, "Ab#", []).reason == "ocr_artifact_chars"
    brand = resolve(spark, "KFC Quan Mot", [("Kfc quan mot", 10.0, 107.0, "osm")], 10.0, 106.0)
    assert (brand.reason, brand.needs_review) == ("brand_sensitive_near_match", True)


def greedy(rows):
    """The plain pass: longest names first, ties as they came."""
    kept = []
    clean = lambda n: "".join(c for c in fold(n) if c.isalnum())
    for k, name, lat, lng in sorted(rows, key=lambda x: -len(x[1])):
        for _, other, a, b in kept if lat is not None and name.strip() else []:
            if a is None or not other.strip():
                continue
            h = math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(a)) * math.sin(math.radians(b - lng) / 2) ** 2
            x, y = clean(name), clean(other)
            if 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) < 12 and (x == y or (x and y and difflib.SequenceMatcher(None, x, y).ratio() >= 0.6)):
                break
        else:
            kept.append((k, name, lat, lng))
    return {k for k, *_ in kept}


@pytest.mark.parametrize("seed", range(3))
def test_dedupe(spark, seed):
    rnd = random.Random(seed)
    words = ["Phở Hà", "Pho Ha", "Phở Hà Nội", "Bún Bò", "Bun Bo Hue", "--", "!!", " ", "Tiệm Nấm"]
    rows = [(k, rnd.choice(words), None if rnd.random() < 0.1 else 10.7 + rnd.randrange(8) * 0.00006, 106.7 + rnd.randrange(8) * 0.00006) for k in range(120)]
    pois = spark.createDataFrame(rows, "ordinal int, name string, lat double, lng double")
    assert {r.ordinal for r in dedupe.dedupe(pois, "ordinal").collect()} == greedy(rows)


def test_dedupe_limit(spark):
    step = math.degrees(12 / 6371000)
    for factor, n in ((0.999, 1), (1.001, 2)):
        pois = spark.createDataFrame([(0, "A B", 10.0, 106.0), (1, "A B", 10.0 + step * factor, 106.0)], "ordinal int, name string, lat double, lng double")
        assert dedupe.dedupe(pois, "ordinal").count() == n


def test_boxes(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 1, 1.0, 1.0, 9.0, 9.0, 0.9), (1, 2, 30.0, 2.0, 44.0, 8.0, 0.3), (1, 3, 500.0, 500.0, 510.0, 510.0, 0.4), (2, 0, 0.0, 0.0, 10.0, 10.0, 0.2)]
    out = boxes.merge_tiles(spark.createDataFrame(rows, "tile long, ordinal int, x1 double, y1 double, x2 double, y2 double, confidence double")).collect()
    assert sorted((r.tile, r.ordinal, r.x1, r.x2, r.confidence) for r in out) == [(1, 0, 0.0, 44.0, 0.9), (1, 1, 500.0, 510.0, 0.4), (2, 0, 0.0, 10.0, 0.2)]


def test_text_corners(spark):
    cases = [("Quận 1", "quan_1"), ("Đường Ä Ñ", "duong_a_n"), ("Cà  Phê!", "ca_phe"), ("", "unknown"), (None, "unknown"), ("Cà Phê", "ca_phe")]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, s string")
    assert [r.x for r in df.orderBy("k").select(t.slugify(F.col("s")).alias("x")).collect()] == [c[1] for c in cases]
    row = df.where("k = 4").select(t.fold(F.col("s")), t.coordinate_text(F.lit(None).cast("double"), F.lit(1.0)), F.size(t.tokens(F.col("s")))).first()
    assert tuple(row) == ("", "", 0)


def test_closest(spark):
    counts = spark.createDataFrame([("quan", 9, "quán"), ("pho", 5, "phở"), ("phu", 5, "phú")], "key string, weight long, word string")
    words = spark.createDataFrame([("quanx",), ("phz",), ("zzzzzz",), ("KFC",)], "word string")
    assert {(r.word, r.spelled, r.distance) for r in dictionary.closest_spellings(words, counts).collect()} == {("quanx", "quán", 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"areas": [{"province": "P", "district": "D", "centroid": [1.5, 2.5]}, "x", 3]}))
    (tmp_path / "bare.json").write_text(json.dumps([{"province": "Q", "district": "E"}]))
    assert [(r.province, r.ward, r.centroid) for r in readers.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [("P", "", [1.5, 2.5])]
    assert readers.read_manifest(spark, str(tmp_path / "bare.json")).first().province == "Q"
    assert readers.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "g").mkdir()
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    for name, body in {"p": {"type": "Polygon", "coordinates": [ring]}, "f": {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}, "x": {"type": "Point", "coordinates": [0, 0]}}.items():
        (tmp_path / "g" / f"{name}.geojson").write_text(json.dumps(body))
    (tmp_path / "g" / "bad.geojson").write_text("{")
    found = readers.read_geojson(spark, str(tmp_path / "g")).collect()
    assert sorted((r.path[-9], r.ring_id, len(r.points)) for r in found) == [("f", 0, 4), ("f", 1, 4), ("p", 0, 4)]
    (tmp_path / "c.json").write_text(json.dumps({"visited": [[0, 0]], "queue": [[0, 1], [0, 0]], "discarded": [], "captured": [[2, 2]], "tile_bboxes": {"0,0": [1, 2, 3, 4], "bad": [1], "x,y": [1, 2, 3, 4]}}))
    tiles = {(r.tx, r.ty): (r.status, r.bbox) for r in readers.read_checkpoint(spark, str(tmp_path / "c.json")).collect()}
    assert tiles[0, 0][0] == "visited" and tiles[0, 0][1].lat_max == 3 and tiles[0, 1] == ("queued", None) and tiles[2, 2][0] == "captured"
    (tmp_path / "places.txt").write_text("# c\n\nHà Nội\nHa Noi\nĐà Lạt\n")
    assert {(r.key, r.spelling) for r in readers.read_gazetteer(spark, str(tmp_path / "places.txt")).collect()} == {("ha noi", "Ha Noi"), ("da lat", "Đà Lạt")}
    (tmp_path / "w.json").write_text(json.dumps({" Quan ": "Quán", "12 3": "x", "y": "--"}))
    assert [tuple(r) for r in readers.read_words(spark, str(tmp_path / "w.json")).collect()] == [("quan", "Quán")]
    (tmp_path / "fix.json").write_text(json.dumps({"contextual_phrase_corrections": [{"source": ["a", "b"], "target": ["Á", "B"]}, {"source": ["a"], "target": ["b"]}], "safe_standalone_aliases": {"hn": "Hà Nội"}}))
    fixes = readers.read_corrections(spark, str(tmp_path / "fix.json"))
    assert fixes["phrases"].count() == 1 and fixes["aliases"].first().spelled == "Hà Nội" and fixes["context"].count() == 0


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([("Phở / x", 10.5, None, "W", "D", "P", "a\\b.png", 1, 2), (" ", 1.0, 1.0, "", "", "", "", 0, 0)], "name string, approx_lat double, approx_lng double, ward string, district string, province string, crop_image string, tile_x int, tile_y int")
    sinks.write_clean_csv(records, str(tmp_path / "csv"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("part-*"))
    assert text.startswith("﻿title_poi,") and "Phở / x" in text and "a/b.png" in text and text.replace("﻿title_poi", "").count("Phở / x,") == 2
    states = spark.createDataFrame([("a", 0, 0, "visited"), ("a", 1, 0, "queued")], "area_id string, tx int, ty int, status string")
    shown = json.loads(sinks.geojson(states, Grid()).first().geojson)
    ring = shown["features"][0]["geometry"]["coordinates"][0]
    assert len(shown["features"]) == 1 and len(ring) == 5 and ring[0] == ring[-1]
    saved = json.loads(sinks.checkpoint_json(states).first().checkpoint)
    assert saved["visited"] == [[0, 0]] and saved["queue"] == [[1, 0]]
    sinks.write_manifest(spark.createDataFrame([("P", "D")], "province string, district string"), str(tmp_path / "m"))
    assert readers.read_manifest(spark, str(tmp_path / "m")).first().province == "P"


def test_streams(spark, tmp_path):
    rows = [("a", 0, 0, "queued", 1, 1), ("a", 0, 0, "visited", 2, 2), ("a", 0, 0, "captured", 3, 3), ("b", 1, 1, "queued", 1, 4)]
    df = spark.createDataFrame(rows, "area_id string, tx int, ty int, status string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    events = lambda: stream.read_events(spark, str(tmp_path / "in"), "area_id string, tx int, ty int, status string, event_id long, ts timestamp", 1)
    folded = {(r.area_id, r.status, r.n_events) for r in stream.fold_stream(events(), str(tmp_path / "s"), str(tmp_path / "c")).collect()}
    assert folded == {("a", "captured", 3), ("b", "queued", 1)}
    one = stream.read_events(spark, str(tmp_path / "in"), "area_id string, tx int, ty int, status string, event_id long, ts timestamp")
    query = stream.state_machine(one).writeStream.format("memory").queryName("machine").outputMode("update").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.area_id, r.status) for r in spark.table("machine").collect()} == {("a", "visited"), ("b", "queued")}


def test_ladder_finds_words_before_pairs(spark):
    """The words of a name are found once, not again for every label of its tile."""
    pois = spark.createDataFrame([(k, 0, "Pho Pho Ha", 10.0, 106.0) for k in range(3)], "poi int, tile int, name string, lat double, lng double")
    there = spark.createDataFrame([(0, 0, "Pho Ha", 10.0, 106.0, "dom"), (0, 1, "Ha Pho Pho", 10.0, 106.0, "dom")], "tile int, ordinal int, label string, lat double, lng double, source string")
    out = matching.resolve_names(pois, there, "poi")
    assert {(r.selected, r.score) for r in out.collect()} == {("Ha Pho Pho", 1.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("regexp_extract_all" in line for line in plan if "Join " in line)


def test_dedupe_repeats_meet_no_pairs(spark, monkeypatch):
    """Repeats of a name at a place are dropped before any pairs are made."""
    seen = []
    edges = dedupe.duplicate_edges
    monkeypatch.setattr(dedupe, "duplicate_edges", lambda pois, *more: (seen.append(pois.count()), edges(pois, *more))[1])
    rows = [(k, ("Phở Hà", "pho-ha")[k % 2], 10.0, 106.0) for k in range(200)] + [(200, "Pho Ha", float("nan"), 106.0), (201, "Pho Ha", float("nan"), 106.0), (202, "Phở Hà", None, None)]
    pois = spark.createDataFrame(rows, "ordinal int, name string, lat double, lng double")
    assert {r.ordinal for r in dedupe.dedupe(pois, "ordinal").collect()} == {0, 200, 201, 202}
    assert seen == [4]


def test_phrases_are_reduced_before_the_shuffle(spark, monkeypatch):
    """Of a batch's repeats of a phrase one row is left, the one that a plain pass picks."""
    rnd = random.Random(5)
    texts = [(k, " ".join(rnd.choice(["phở", "Phở", "pho", "bò", "Bo", "ngon", "7up"]) for _ in range(rnd.randrange(9)))) for k in range(300)]
    best = {}
    for o, text in texts:
        w = text.split()
        for n in range(2, 6):
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                marks = sum(fold(x) != x.lower() for x in g)
                if marks and "7up" not in g:
                    key = " ".join(map(fold, g))
                    best[key] = max(best.get(key, ((0,), "")), ((marks, -o, -n, -i), " ".join(g)))
    df = spark.createDataFrame(texts, "ordinal long, spelling string").coalesce(1)
    found = {r.key: (r.marks, r.spelling) for r in dictionary.phrase_ngrams(df).collect()}
    assert found == {k: (order[0], spelling) for k, (order, spelling) in best.items()}
    words = [t.split() for _, t in texts]
    import pyarrow as pa

    mark = [[int(fold(x) != x.lower()) for x in w] for w in words]
    batch = pa.record_batch({"o": pa.array(range(300)), "word": pa.array(words, pa.list_(pa.string())), "key": pa.array([list(map(fold, w)) for w in words], pa.list_(pa.string())), "mark": pa.array(mark, pa.list_(pa.int32())), "digit": pa.array([[x == "7up" for x in w] for w in words], pa.list_(pa.bool_()))})
    assert sum(b.num_rows for b in dictionary._best_phrases([batch])) == len(best)
    monkeypatch.setattr(dictionary, "RUN", 40)
    runs = [b.to_pylist() for b in dictionary._best_phrases([batch])]
    assert {r["key"] for b in runs for r in b} == set(best) and sum(map(len, runs)) > len(best)
