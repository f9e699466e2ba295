"""The pipeline's stages on rows with null and clashing ids."""

from collections import Counter

from conftest import SF

import corpus_pipeline as cp
from atlasloom.llm.common import materialize, table


def test_null_and_clashing_ids_lose_nothing(spark):
    docs = table(spark, SF, "documents")
    good = cp.quality(spark, docs, SF)
    rows = cp.dedup(spark, good, SF).orderBy("doc_id").limit(12).collect()
    assert len(rows) == 12
    bad = docs.join(good.select("doc_id"), "doc_id", "left_anti").where("text is not null").limit(1).collect()[0]
    # Two without an id, two that share one, a copy of one of them under a null id, and a bad text under a good one's id.
    new = [r.asDict() for r in rows[:9]]
    new[0]["doc_id"] = new[1]["doc_id"] = None
    new[3]["doc_id"] = new[2]["doc_id"]
    copy, wrong = new[3] | {"doc_id": None}, bad.asDict() | {"doc_id": new[4]["doc_id"]}
    strange = spark.createDataFrame([tuple(r.values()) for r in [*new, copy, new[5], wrong]], docs.schema).repartition(3)
    passed = materialize(cp.quality(spark, strange, SF), "passed")
    assert Counter(r.text for r in passed.collect()) == Counter([*(r["text"] for r in new), copy["text"], new[5]["text"]])
    kept = materialize(cp.dedup(spark, passed, SF), "kept")
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted((r["doc_id"] or -1, r["text"]) for r in new)
    mixed = {r.text for r in cp.mixture(spark, kept, SF).collect()}
    copies = cp.mix(kept.withColumn("k", cp.F.monotonically_increasing_id()), "k").where("copies > 0").count()
    assert len(mixed) == copies and {new[0]["text"], new[1]["text"]} & mixed


def test_stages_keep_columns_of_any_name(spark):
    more = {"__key": 1, "__lang": "x", "__rules": "y", "__copies": 3, "__copy": 4, "n": 5, "id": 6}
    docs = table(spark, SF, "documents").limit(60)
    wide = docs.withColumns({k: cp.F.lit(v) for k, v in more.items()})
    for k, (_, stage) in enumerate(cp.STAGES[:2] + cp.STAGES[3:4]):
        wide = materialize(stage(spark, wide, SF), f"wide{k}")
        assert wide.columns == [*docs.columns, *more] and wide.count() > 0
        assert {tuple(r)[-len(more) :] for r in wide.collect()} == {tuple(more.values())}


def test_language_goes_by_its_profiles(spark):
    """A plain count of ranks decides, and texts of another script or without letters go."""
    docs = table(spark, SF, "documents").where("text is not null")
    other = [(-1, "Съешь же ещё этих мягких французских булок " * 9, None, "s", 1), (-2, "今日は天気がいいです " * 20, None, "s", 1), (-3, "12 34 !!", "en", "s", 1), (-4, None, "en", "s", 1), (-5, "", "en", "s", 1)]
    out = cp.language(spark, docs.unionAll(spark.createDataFrame(other, docs.schema)), SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.where(cp.F.col("text").rlike("[A-Za-z]")).select("doc_id").collect()}
