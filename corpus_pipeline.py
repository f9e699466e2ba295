"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasloom.llm.common import discard, materialize, small, table
from atlasloom.llm.language_id import UNKNOWN, predict, train
from atlasloom.llm.mixing import mix
from atlasloom.llm.ngram_jaccard import ngram_jaccard
from atlasloom.llm.packing import pack
from atlasloom.llm.quality_rules import measure

#: A document nearer to no profile than this, of 1, is in none of the languages learned. Texts in these languages reach 0.38 and
#: more even if they are a few words or mostly junk, so that only other languages and scripts fall.
LEAST_SCORE = 0.25


def _free(docs: DataFrame, name: str) -> str:
    """name, or one like it that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row, and that column's name: doc_id where it is never null nor repeated; else one of its
    own, written, so that it stays the same."""
    key = _free(docs, "__key")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has labels for, by their whole texts. Null, empty and letterless texts are in
    none and go. Rows that repeat, or share an id, are each judged by their own text; null ids stay. A table without labels
    learns nothing and keeps nothing; an empty one gives no rows. All columns are returned as they are."""
    found = _free(docs, "__lang")
    judged = docs.withColumn(found, predict(F.col("text"), train(docs)))
    return judged.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE)).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; each row by its own whole text, whatever its id, null ids and repeated rows
    too. Null and empty texts have no words and go. An empty table gives no rows; all columns are returned as they are."""
    rules = _free(docs, "__rules")
    return docs.withColumn(rules, measure(F.col("text"))).where(f"{rules}.kept").select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; null ids come last. Rows that share an
    id but not a text are documents of their own; of equal rows one stays. Null and wordless texts are near copies of
    nothing and stay. An empty table gives no rows; all columns are returned as they are."""
    keyed, key = _keyed(docs)
    found = materialize(ngram_jaccard(keyed, key).select(F.col("doc_id").alias(key), "component_id"), "found")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))[key].alias(key)
    kept = materialize(keyed.select(key, "doc_id").join(found, key).groupBy("component_id").agg(first).select(key), "kept")
    discard(found)
    out = keyed.join(small(kept, kept.seen["n"]), key, "left_semi").select(docs.columns)
    # Texts without words are near copies of nothing, equal rows among them too.
    return out if docs.groupBy("doc_id").count().where("count > 1").isEmpty() else out.dropDuplicates()


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, by its row, as often as the mix takes it; ties go by a hash, so reruns agree. Rows that repeat, or share
    an id, or have a null one are documents of their own. A null source is a source; null and wordless texts weigh nothing
    and stay once. An empty table gives no rows; all columns are returned as they are."""
    keyed, key = _keyed(docs)
    times, turn = _free(docs, "__copies"), _free(docs, "__copy")
    copies = materialize(mix(keyed, key).where("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias(times)), "copies")
    repeated = keyed.join(small(copies, copies.seen["n"]), key)
    return repeated.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences for training. Null and empty texts are their end alone, very long ones are cut,
    and rows that repeat, or share an id, or have a null one are each packed. An empty table gives no rows. Columns other
    than doc_id and text are not read."""
    return pack(docs)


STAGES = [("language ID", language), ("quality rules", quality), ("n-gram Jaccard join", dedup), ("mixing sources", mixture), ("best-fit packing", packed)]

#: Rank profiles, components and packing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
