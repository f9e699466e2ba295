"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence comes from a naive Bayes model over words and word shapes, cross-fitted
in two folds and calibrated by a logistic regression. Sites add theirs: the rate of good
documents of a host is shrunk toward the corpus, that of a path toward its host, with strengths
estimated from the spread between sites, and a document's log odds move, for each of its hosts, by
what the log odds of its paths there differ from the corpus's on average.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

BUCKETS = 1 << 18
FOLDS = 2
CALIBRATION_ROWS = 200_000  # labelled documents, by hash of doc_id, that fit the calibration's five weights
SOFT = 0.25  # what an unlabelled document counts for in its site's rate
MOST_STRENGTH = 1000.0
CACHED = 400_000
FEATURES = ("words", "shapes", "repeated", "length")

_SHAPE = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"(.)\1+"), rb"\1"))


class _Words(dict):
    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = word
        for pattern, by in _SHAPE:
            shape = pattern.sub(by, shape)
        out = zlib.crc32(word.lower()) % BUCKETS, zlib.crc32(shape, 1) % BUCKETS
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = out
        return out


_words = _Words()


def _buckets(text: bytes | None) -> np.ndarray:
    """Rows: the buckets of each word and of its shape."""
    found = list(map(_words.__getitem__, (text or b"").split()))
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _count(batches):
    total = np.zeros((FOLDS, 2, 2 * BUCKETS), dtype=np.int64)
    for batch in batches:
        for text, good, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            b = _buckets(text)
            np.add.at(total[fold, int(good)], np.concatenate([b[:, 0], b[:, 1] + BUCKETS]), 1)
    fold, good, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (fold, good, bucket, total[fold, good, bucket])], ["fold", "good", "bucket", "n"])


def _tables(counts: DataFrame) -> list[np.ndarray]:
    """Log odds good to bad of every bucket: by the other fold for each fold, then by all. At most
    FOLDS * 4 * BUCKETS rows reach the driver; the tables are 6 MB, whatever the input."""
    total = np.zeros((FOLDS, 2, 2, BUCKETS))
    for row in counts.toArrow().to_batches():
        fold, good, bucket, n = (row.column(k).to_numpy() for k in range(4))
        total[fold, good, bucket // BUCKETS, bucket % BUCKETS] += n
    out = []
    for c in [total.sum(axis=0) - total[f] for f in range(FOLDS)] + [total.sum(axis=0)]:
        p = (c + 0.5) / (c.sum(axis=-1, keepdims=True) + 0.5 * BUCKETS)
        out.append((np.log(p[1]) - np.log(p[0])).astype(np.float32))
    return out


def _features(tables) -> Column:
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series, which: pd.Series) -> pd.Series:
        rows = []
        for text, k in zip(texts, which, strict=True):
            b, table = _buckets(text), tables.value[k]
            if len(b) == 0:
                rows.append([0.0, 0.0, 0.0, 0.0])
                continue
            words, shapes = table[0][b[:, 0]].mean(dtype=np.float64), table[1][b[:, 1]].mean(dtype=np.float64)
            rows.append([float(words), float(shapes), 1 - len(np.unique(b[:, 0])) / len(b), float(np.log1p(len(b)))])
        return pd.Series(rows)

    return features.asNondeterministic()


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a weak prior; the intercept comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: Column) -> float:
    """Pseudo-documents of the Beta prior by moments: the spread of rates beyond that of sampling."""
    p = F.col("k") / F.col("n")
    row = groups.where("n > 1").agg(
        F.sum(F.col("n") * (p - rate) ** 2).alias("between"),
        F.sum(rate * (1 - rate)).alias("sampling"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("scale"),
        F.sum("n").alias("n"),
    ).first()
    if not row.n or not row.scale:
        return MOST_STRENGTH
    excess = max(row.between - row.sampling, 0.0) / row.scale
    return float(min(MOST_STRENGTH, max(1.0, 1 / excess - 1))) if excess > 0 else MOST_STRENGTH


def site_bayes(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "host", path: str = "path", sites: DataFrame | None = None) -> DataFrame:
    """Score every document; labels(doc_id, good) covers some. host and path may be null (one site).
    sites(doc_id, host, path) holds all sites of the documents that stand on pages; those it has none for
    stand on their own host and path. A document counts once in each of its paths and of its hosts; its
    host_rate and path_rate are the means over them.

    Returns doc_id, evidence (the document's own probability of being good), host_rate, path_rate,
    score, kept (score >= 0.5). A null or wordless text has features 0. Documents labelled twice
    count as good only if all their labels say so. Without labels of both kinds every score is
    0.5 and every document is kept. Repeated rows each count and are scored. Other columns are
    not read. All labelled rows train the word model; the calibration reads CALIBRATION_ROWS at most.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    marks = labels.select(F.col(labels.columns[0]).alias("doc_id"), F.col("good").cast("int").alias("good")).where("good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    marked = read.join(small(marks), "doc_id", "left").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    counts = marked.where("good is not null").select("text", "good", "fold").mapInArrow(_count, "fold long, good long, bucket long, n long")
    counts = counts.groupBy("fold", "good", "bucket").agg(F.sum("n").alias("n"))
    tables = spark.sparkContext.broadcast(_tables(counts))
    which = F.when(F.col("good").isNull(), FOLDS).otherwise(F.col("fold"))
    scored = marked.withColumn("features", _features(tables)("text", which)).drop("text", "fold")
    scored = materialize(scored, "evidence")

    sample = scored.where("good is not null").orderBy(F.xxhash64("doc_id")).limit(CALIBRATION_ROWS).select("features", "good").collect()
    y = np.array([r.good for r in sample], dtype=float)
    if len(set(y)) < 2:
        flat = F.lit(0.5)
        return scored.select("doc_id", flat.alias("evidence"), flat.alias("host_rate"), flat.alias("path_rate"), flat.alias("score"), F.lit(True).alias("kept"))
    weights = _fit(np.array([r.features for r in sample]), y)
    z = F.lit(float(weights[0]))
    for k, w in enumerate(weights[1:]):
        z = z + F.col("features")[k] * float(w)
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    own = scored.select("doc_id", "host", "path", "good", z.alias("z")).withColumn("evidence", 1 / (1 + F.exp(-F.col("z"))))

    weight = F.when(F.col("good").isNull(), SOFT).otherwise(1.0)
    k = weight * F.coalesce(F.col("good").cast("double"), F.col("evidence"))
    own = own.withColumn("n", weight).withColumn("k", k)
    whole = own.agg(F.try_divide(F.sum("k"), F.sum("n")).alias("rate")).first().rate or 0.5
    whole = min(max(whole, 1e-6), 1 - 1e-6)
    if sites is None:
        sites = own.select("doc_id", "host", "path").limit(0)
    sites = sites.where("doc_id is not null").select("doc_id", F.coalesce("host", F.lit("")).alias("on_host"), F.coalesce("path", F.lit("")).alias("on_path")).distinct()
    part = sites.groupBy("doc_id", "on_host").agg((1 / F.count("*")).alias("part"))
    # part: of a document's weight on a host, what one of its paths there has.
    sites = materialize(sites.join(part, ["doc_id", "on_host"]), "sites")
    stood = own.join(small(sites), "doc_id", "left")
    at_path = F.when(F.col("on_host").isNull(), F.col("path")).otherwise(F.col("on_path"))
    stood = stood.select(F.coalesce("on_host", "host").alias("host"), at_path.alias("path"), F.coalesce("part", F.lit(1.0)).alias("part"), "n", "k")
    paths = stood.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("part")).alias("host_n"), F.sum(F.col("k") * F.col("part")).alias("host_k"))
    paths = materialize(paths, "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("host_n").alias("n"), F.sum("host_k").alias("k")), "hosts")
    paths = paths.drop("host_n", "host_k")
    m = _strength(hosts, F.lit(whole))
    hosts = hosts.select("host", ((F.col("k") + m * whole) / (F.col("n") + m)).alias("host_rate"))
    joined = paths.join(small(hosts), "host")
    m = _strength(joined, F.col("host_rate"))
    rates = joined.select("host", "path", "host_rate", ((F.col("k") + m * F.col("host_rate")) / (F.col("n") + m)).alias("path_rate"))
    rates = materialize(rates.withColumn("shift", _logit(F.col("path_rate")) - _logit(F.lit(whole))), "rates")
    told = sites.join(small(rates.withColumnsRenamed({"host": "on_host", "path": "on_path"})), ["on_host", "on_path"]).groupBy("doc_id").agg(
        (F.sum(F.col("host_rate") * F.col("part")) / F.sum("part")).alias("host_rates"),
        F.avg("path_rate").alias("path_rates"),
        F.sum(F.col("shift") * F.col("part")).alias("shifts"),
    )
    out = own.join(small(materialize(told, "told")), "doc_id", "left").join(small(rates), ["host", "path"], "left")
    score = 1 / (1 + F.exp(-(F.col("z") + F.coalesce("shifts", "shift"))))
    out = out.select("doc_id", "evidence", F.coalesce("host_rates", "host_rate").alias("host_rate"), F.coalesce("path_rates", "path_rate").alias("path_rate"), score.alias("score"))
    return out.withColumn("kept", F.col("score") >= 0.5)
