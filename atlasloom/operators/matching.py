"""Names against nearby names: soft matches, first spellings, and the ladder that decides which name to keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import brand_sensitive, suspicious_short
from ..functions.scores import candidate_metres, numbered, numbered_f1, weighed
from ..functions.text import folded_tokens, name_key, strip

SPATIAL_M = 18.0
ACCEPT = 0.94
REVIEW = 0.86
BRAND = 0.975


def soft_match(names: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """For each name(key, tile, name) the label(tile, ordinal, label) that matches best: equal, equal but for case, or one
    within the other if the label is longer than three characters; the first label wins ties."""
    a, b = F.lower("name"), F.lower("label")
    tier = F.when(F.col("name") == F.col("label"), 1).when(a == b, 2).when((F.length("label") > 3) & (F.contains(a, b) | F.contains(b, a)), 3)
    joined = names.join(labels, "tile").withColumn("tier", tier).where("tier is not null")
    best = joined.groupBy(key).agg(F.min_by(F.struct("label", "tier"), F.struct("tier", "ordinal")).alias("m"))
    return names.join(best, key, "left").select(*names.columns, "m.label", "m.tier")


def first_spellings(nearby: DataFrame) -> DataFrame:
    """nearby(tile, ordinal, label): of labels with the same folded words the first; labels without words go."""
    key = F.array_join(folded_tokens(F.col("label")), " ")
    kept = nearby.withColumn("label_key", key).where("label_key <> ''")
    return kept.groupBy("tile", "label_key").agg(F.min("ordinal").alias("ordinal"), F.min_by("label", "ordinal").alias("label"))


def resolve_names(pois: DataFrame, nearby: DataFrame, key: str, accept: float = ACCEPT, review: float = REVIEW, chars: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Keep each name or take a nearby one.

    pois(key, tile, name, lat, lng) and nearby(tile, ordinal, label, lat, lng, source); coordinates may be null.
    Returns key, selected, source, score, action, needs_review, reason. Of candidates with equal
    scores the first wins; one that scores 0 never does. chars: see match_score.
    """
    first = first_spellings(nearby).select("tile", "ordinal")
    there = nearby.join(first, ["tile", "ordinal"], "left_semi").select("tile", "ordinal", F.col("label"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), "source")
    # Words are found once a name and once a label, not once a pair.
    there = there.withColumn("c_words", folded_tokens(F.col("label"))).withColumn("c_numbered", numbered(F.col("c_words")))
    cleaned = strip(F.coalesce("name", F.lit("")))
    own = pois.withColumn("cleaned", cleaned).withColumn("words", folded_tokens(F.col("cleaned"))).withColumn("numbered", numbered(F.col("words")))
    # Dealt by number: the pairs are many times the rows that are shuffled, so tasks must not be merged by their bytes.
    dealt = own.select(key, "tile", "lat", "lng", "words", "numbered").repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile")
    pairs = dealt.join(there, "tile")
    pairs = pairs.withColumn("metres", candidate_metres(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))).withColumn("f1", numbered_f1(F.col("numbered"), F.col("c_numbered")))
    like = chars(F.array_join("words", " "), F.array_join("c_words", " ")) if chars else F.col("f1")
    pairs = pairs.withColumn("s", weighed(like, F.col("f1"), F.col("metres"))).where("s > 0")
    best = pairs.groupBy(key).agg(F.max_by(F.struct("label", "metres", "s", "f1", F.size("c_words").alias("c"), "source"), F.struct("s", -F.col("ordinal"))).alias("best"))
    out = own.join(best, key, "left").withColumn("score", F.coalesce("best.s", F.lit(0.0))).withColumn("stripped", strip(F.coalesce("best.label", F.lit(""))))

    name, cand = F.col("cleaned"), F.col("stripped")
    n, c = F.size("words"), F.coalesce("best.c", F.lit(0))
    near = F.coalesce(F.col("best.metres") <= SPATIAL_M, F.lit(False))
    # Word counts differ by two at most, and a longer candidate has nearly the same words.
    safe_length = (n > 0) & (c > 0) & (F.abs(n - c) <= 2) & ((c <= n) | (F.coalesce("best.f1", F.lit(0.0)) >= 0.86))
    confident = F.col("best").isNotNull() & (F.col("score") >= accept) & safe_length
    reason = (
        F.when(name == "", "empty_ocr")
        .when(n == 0, "no_tokens")
        .when(near & suspicious_short(name) & (c <= 3), "spatial_exact_short_ocr")
        .when(near & (F.col("score") >= F.when((n >= 3) & (c >= 3), 0.30).otherwise(0.62)), "spatial_exact_fuzzy_match")
        .when(confident & brand_sensitive(name) & (F.col("score") < BRAND), "brand_sensitive_near_match")
        .when(confident, "high_confidence_nearby_match")
        .when(name.rlike("[?#*]"), "ocr_artifact_chars")
        .when((n <= 1) & (F.length(name) <= 4), "short_ocr")
        .when(F.col("best").isNotNull() & (F.col("score") >= review), "nearby_match_below_accept_threshold")
        .otherwise("clean_ocr_no_nearby_match")
    )
    taken = F.col("reason").isin("spatial_exact_short_ocr", "spatial_exact_fuzzy_match", "high_confidence_nearby_match")
    return out.withColumn("reason", reason).select(
        key,
        F.when(F.col("reason") == "empty_ocr", "").when(taken, cand).otherwise(name).alias("selected"),
        F.when(taken, F.coalesce("best.source", F.lit("nearby"))).otherwise("ocr").alias("source"),
        F.when(F.col("reason").isin("empty_ocr", "no_tokens"), 0.0).otherwise(F.col("score")).alias("score"),
        F.when(F.col("reason") == "empty_ocr", "empty").when(taken, "use_canonical").otherwise("keep_ocr").alias("action"),
        F.col("reason").isin("empty_ocr", "no_tokens", "brand_sensitive_near_match", "nearby_match_below_accept_threshold", "short_ocr", "ocr_artifact_chars").alias("needs_review"),
        "reason",
    )


def pick_rescue(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, old_name, ordinal, candidate): the candidate that gains most over the old name, if any gains.
    Unknown ones and those hardly longer that do not contain the old one (or it them) do not count."""
    old, new = name_key(F.col("old_name")), name_key(F.col("candidate"))
    contains = F.contains(new, old) | F.contains(old, new)
    prefix = (F.length(old) >= 8) & (F.length(new) >= 8) & (F.left(old, F.lit(8)) == F.left(new, F.lit(8)))
    cut = F.col("old_name").rlike(r"\.\.\.|…")
    gain = F.length(new) - F.length(old) + F.when(contains, 20).otherwise(0) + F.when(prefix, 12).otherwise(0) + F.when(cut, 10).otherwise(0)
    usable = (old != "") & (new != "") & ~new.startswith("unknown") & ((F.length(new) > F.length(old) + 2) | contains)
    scored = pairs.where(usable).withColumn("gain", gain).where("gain > 0")
    return scored.groupBy(key).agg(F.max_by(F.struct("candidate", "gain"), F.struct("gain", -F.col("ordinal"))).alias("b")).select(key, "b.candidate", "b.gain")


def best_variants(variants: DataFrame, keys: list[str], score: str, ordinal: str, *values: str) -> DataFrame:
    """Of the variants of each line or label the one with the best score, the first of equals."""
    best = F.max_by(F.struct(*values, score), F.struct(F.col(score), -F.col(ordinal)))
    return variants.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


__all__ = ["best_variants", "first_spellings", "pick_rescue", "resolve_names", "soft_match"]
