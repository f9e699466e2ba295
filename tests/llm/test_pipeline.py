"""The pipeline's stages against plain versions of what they decide."""

import re
from collections import Counter

from conftest import SF

import corpus_pipeline as cp
from atlasloom.llm.common import materialize, table
from atlasloom.llm.mixing import mix
from atlasloom.llm.ngram_jaccard import ngram_jaccard
from atlasloom.llm.queries import ORACLES, QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    seen = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = materialize(stage(spark, docs, SF), f"t{k}")
        assert out.columns == columns, name
        assert all(tuple(r) == tuple(seen[r.doc_id]) for r in out.collect())
        if k == 0:
            assert out.count() == docs.count()
        if k == 1:
            kept = {r.doc_id for r in out.collect()}
            assert kept == {r.doc_id for r in QUERIES["op4_quality_rules"](spark, SF).where("kept").collect()}
            assert not any(labels[i].quality == 0 for i in kept if i in labels)
        if k == 2:
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in ngram_jaccard(docs).collect()}
        if k == 3:
            want = {r.doc_id: r.copies for r in mix(docs).collect() if r.copies}
            assert Counter(r.doc_id for r in out.collect()) == Counter(want)
        docs = out
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    assert max(Counter({s: sum(r.length for r in pieces if r.sequence_id == s) for s in {r.sequence_id for r in pieces}}).values()) <= 2048


def test_run_and_odd_documents(spark):
    assert cp.run(spark, SF).count() > 0
    docs = table(spark, SF, "documents")
    rows = docs.limit(30).collect()
    strange = spark.createDataFrame([*rows, *rows[:5], (None, None, None, None, None), (9_999_999, "", "en", None, 0)], docs.schema)
    for _, stage in cp.STAGES:
        strange_out = materialize(stage(spark, strange, SF), "odd")
        if strange_out.columns == docs.columns:
            strange = strange_out
    ids = [r.doc_id for r in strange_out.collect() if r.piece == 0]
    assert ids and None not in ids
    empty = docs.limit(0)
    for _, stage in cp.STAGES[:-1]:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and "pipeline" in names and len(QUERIES) == 10
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert all(re.match(r"op\d+_", n) for n in QUERIES)
