"""Inputs: boundaries, manifests, centres, checkpoints, dictionaries, captured images. A path that holds nothing
readable gives an empty table where the data are optional."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, fold, strip, tokens

_AREA = "struct<province:string,district:string,ward:string,centroid:array<double>,boundary_path:string>"
_CENTRES = "map<string,struct<center_lat:double,center_lng:double,boundary_path:string>>"
_CHECKPOINT = "struct<visited:array<array<int>>,queue:array<array<int>>,discarded:array<array<int>>,captured:array<array<int>>,tile_bboxes:map<string,array<double>>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of each text file; none if there are no files."""
    try:
        read = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], "path string, value string")
    return read.select(F.col("_metadata.file_path").alias("path"), "value")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, ring_id, points) of the outer rings of every Polygon or MultiPolygon, features unwrapped; other and broken files give nothing."""
    files = whole_files(spark, path)
    outer = F.from_json("value", "struct<type:string,geometry:struct<type:string,coordinates:string>,coordinates:string>")
    typed = files.select("path", outer.alias("o"))
    shape = F.when(F.col("o.type") == "Feature", F.struct(F.col("o.geometry.type").alias("type"), F.col("o.geometry.coordinates").alias("c"))).otherwise(F.struct(F.col("o.type").alias("type"), F.col("o.coordinates").alias("c")))
    typed = typed.select("path", shape.alias("g")).where(F.col("g.type").isin("Polygon", "MultiPolygon"))
    one = F.from_json(F.when(F.col("g.type") == "Polygon", F.col("g.c")), "array<array<array<double>>>")
    many = F.from_json(F.when(F.col("g.type") == "MultiPolygon", F.col("g.c")), "array<array<array<array<double>>>>")
    rings = F.when(F.col("g.type") == "Polygon", F.array(F.get(one, F.lit(0)))).otherwise(F.transform(F.filter(many, lambda p: F.size(p) > 0), lambda p: F.get(p, F.lit(0))))
    out = typed.select("path", F.posexplode(rings).alias("ring_id", "ring")).where(F.size("ring") > 0)
    return out.select("path", "ring_id", F.transform("ring", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("points"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of {"areas": [...]} or of a bare array; entries that are not objects are dropped. Missing texts are empty."""
    files = whole_files(spark, path)
    wrapped = F.get_json_object("value", "$.areas")
    listed = F.from_json(F.coalesce(wrapped, F.col("value")), "array<string>")
    rows = files.select(F.posexplode(listed).alias("area_no", "row")).where(F.col("row").startswith("{")).select("area_no", F.from_json("row", _AREA).alias("a"))
    text = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit("")).alias(c)
    return rows.select("area_no", text("province"), text("district"), text("ward"), F.col("a.centroid").alias("centroid"), text("boundary_path"))


def read_centres(spark: SparkSession, path: str) -> DataFrame:
    """(key, center_lat, center_lng, boundary_path) of {"centers": {...}} or of a bare object."""
    files = whole_files(spark, path)
    body = F.from_json(F.coalesce(F.get_json_object("value", "$.centers"), F.col("value")), _CENTRES)
    return files.select(F.explode(body).alias("key", "c")).select("key", "c.*")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(path, tx, ty, status, bbox) of saved states; a tile is discarded before visited before captured before queued.
    Boxes whose keys are not `tx,ty` are skipped."""
    files = whole_files(spark, path).select("path", F.from_json("value", _CHECKPOINT).alias("c"))
    parts = [("discarded", "discarded"), ("visited", "visited"), ("captured", "captured"), ("queue", "queued")]
    empty = F.array().cast("array<array<int>>")

    def entries(part: str, status: str, rank: int):
        point = lambda p: F.struct(F.get(p, F.lit(0)).alias("tx"), F.get(p, F.lit(1)).alias("ty"), F.lit(rank).alias("rank"), F.lit(status).alias("status"))
        return F.transform(F.coalesce(f"c.{part}", empty), point)

    listed = F.flatten(F.array(*(entries(part, status, rank) for rank, (part, status) in enumerate(parts))))
    tiles = files.select("path", F.explode(listed).alias("t")).select("path", "t.*").where("tx is not null and ty is not null")
    tiles = tiles.groupBy("path", "tx", "ty").agg(F.min_by("status", "rank").alias("status"))
    boxes = files.select("path", F.explode("c.tile_bboxes").alias("k", "b")).where(F.col("k").rlike("^-?[0-9]+,-?[0-9]+$") & (F.size("b") == 4))
    at = F.split("k", ",")
    box = F.struct(*(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("lat_min", "lng_min", "lat_max", "lng_max"))))
    boxes = boxes.select("path", at[0].cast("int").alias("tx"), at[1].cast("int").alias("ty"), box.alias("bbox"))
    return tiles.join(boxes, ["path", "tx", "ty"], "left")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved records; none if there are no files."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, spelling, key) of phrases, one a line; comments and blank lines are skipped, of equal keys the last line wins."""
    lines = whole_files(spark, path).select(F.posexplode(F.split("value", r"\r?\n")).alias("ordinal", "line")).withColumn("spelling", strip(F.col("line")))
    good = lines.where((F.col("spelling") != "") & ~F.col("spelling").startswith("#") & F.col("spelling").rlike(TOKEN))
    keyed = good.withColumn("key", F.array_join(F.transform(tokens(F.col("spelling")), fold), " "))
    return keyed.groupBy("key").agg(F.max("ordinal").alias("ordinal"), F.max_by("spelling", "ordinal").alias("spelling")).select("ordinal", "spelling", "key")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(key, spelling) of a JSON object; numbers and values without words are skipped."""
    files = whole_files(spark, path)
    entries = files.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    entries = entries.select(F.lower(strip(F.col("k"))).alias("key"), strip(F.col("v")).alias("spelling"))
    return entries.where((F.col("key") != "") & ~F.replace("key", F.lit(" "), F.lit("")).rlike(r"^\p{Nd}+$") & F.col("spelling").rlike(TOKEN))


def read_corrections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three parts of a corrections file: phrases (source, target), context (base, spelled, near), aliases (key, spelled)."""
    body = "struct<contextual_phrase_corrections:array<struct<source:array<string>,target:array<string>>>,contextual_token_corrections:array<struct<wrong_base:string,canonical:string,context:array<string>>>,safe_standalone_aliases:map<string,string>>"
    files = whole_files(spark, path).select(F.from_json("value", body).alias("b"))
    clean = lambda c: F.filter(F.transform(c, strip), lambda x: x != "")
    phrases = files.select(F.explode("b.contextual_phrase_corrections").alias("p")).select(clean(F.col("p.source")).alias("source"), clean(F.col("p.target")).alias("target"))
    context = files.select(F.explode("b.contextual_token_corrections").alias("c")).where("c.wrong_base is not null and c.canonical is not null and c.context is not null")
    lower = lambda c: F.lower(strip(c))
    return {
        "phrases": phrases.where((F.size("source") == F.size("target")) & F.size("source").between(2, 5)),
        "targets": phrases.where(F.size("target").between(2, 5)).select("target"),
        "context": context.select(lower(F.col("c.wrong_base")).alias("base"), strip(F.col("c.canonical")).alias("spelled"), F.transform("c.context", lower).alias("near")),
        "aliases": files.select(F.explode("b.safe_standalone_aliases").alias("k", "v")).select(lower(F.col("k")).alias("key"), strip(F.col("v")).alias("spelled")),
    }


def dom_labels(raw: DataFrame) -> DataFrame:
    """raw(tile, ordinal, name, lat, lng, cx, cy, source): labels longer than two characters; of one text in a tile the last wins."""
    kept = raw.where(F.length(strip(F.col("name"))) > 2)
    rest = [c for c in raw.columns if c not in ("tile", "name")]
    return kept.groupBy("tile", "name").agg(F.max_by(F.struct(*rest), "ordinal").alias("r")).select("tile", "name", "r.*")


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, modificationTime, length, content) of captured images; pixel operators map over content (see operators.pixels)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


