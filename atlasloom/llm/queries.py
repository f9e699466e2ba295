"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, table
from .compaction import ShardStore
from .embedding_dedup import embedding_dedup
from .language_id import language_id
from .lm_score import lm_score
from .mixing import mix
from .ngram_jaccard import ngram_jaccard
from .oracles import ORACLES
from .packing import pack
from .quality_rules import quality_rules
from .site_bayes import site_bayes
from .url_filter import host_and_path, url_filter

ARRIVALS = 12


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled good and not toxic. The background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_score(table(spark, sf_dir, "documents"), good)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS lots by doc_id, are compacted, and are read from the last version."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    arrival = F.pmod("doc_id", F.lit(ARRIVALS)).cast("int")
    store.append(docs, by=arrival)
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", arrival.alias("arrival"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its url's path; it is bad if that is junk."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("__url"))
    numbered = pages.select("page_id", F.expr("try_cast(regexp_extract(__url, '/([0-9]{1,18})(?:[.]html)?/?(?:[?#].*)?$', 1) as bigint)").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    return numbered.join(labels, "doc_id").select("page_id", "bad")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), labelled_pages(spark, sf_dir))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the hosts and first path segments of all pages that show a document; a document without a page has its source for a host."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    sites = pages.select(F.expr("try_cast(regexp_extract(__url, '/([0-9]{1,18})(?:[.]html)?/?(?:[?#].*)?$', 1) as bigint)").alias("doc_id"), host.alias("host"), F.regexp_extract(path, "^/?([^/]*)", 1).alias("path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("source:"), "source").alias("host"), F.col("lang").alias("path"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return site_bayes(docs, labels, sites=sites)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_language_id, op3_embedding_dedup, op4_quality_rules, op5_compaction, op6_url_filter, op7_mix, op8_site_bayes, op9_pack, op10_ngram_jaccard)}

__all__ = ["ORACLES", "QUERIES"]
