"""LM scoring by cross-entropy difference (Moore and Lewis, 2010).

Two n-gram models over all lower-cased characters of the corpus, alike in order, smoothing and
weight: the target model is counted on the target documents, the background model on all
documents, its counts scaled to the target's total. A document's score is the mean over its
tokens of target loss minus background loss, in nats; lower is nearer the target.

An n-gram is two numbers, its last character and those before it, 21 bits each. Counts and losses
are tables with a row for each n-gram that occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

ORDER = 4
START = 0x110000  # stands before a document; no code point
BITS = 21  # of a symbol
STRENGTH = 8.0  # of the Dirichlet prior that backs each order off to the next lower one
PIECE = 1 << 21  # characters handled at once
GRAMS = 4_000_000  # a model of more n-grams than this is joined by a shuffle, not a broadcast
MASK = (1 << BITS) - 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _segments(text: str):
    """The text in pieces, each after the ORDER - 1 symbols before it."""
    codes = _codes(text)
    own = np.concatenate([np.full(ORDER - 1, START, dtype=np.int64), codes])
    for at in range(0, len(codes), PIECE):
        yield own[at : at + PIECE + ORDER - 1]


def _grams(segments: list[np.ndarray]):
    """The different n-grams of some segments: heads, tails, counts, and the number of the n-gram that ends at each character."""
    own = np.concatenate(segments)
    begins = np.cumsum([0, *map(len, segments[:-1])])
    inside = np.ones(len(own), dtype=bool)
    for k in range(ORDER - 1):
        inside[begins + k] = False
    at = np.flatnonzero(inside) - (ORDER - 1)
    if len(own) < 100_000:
        symbols, local = np.unique(own, return_inverse=True)
    else:
        seen = np.zeros(START + 1, dtype=bool)
        seen[own] = True
        symbols = np.flatnonzero(seen)
        number = np.zeros(START + 1, dtype=np.int64)
        number[symbols] = np.arange(len(symbols))
        local = number[own]
    size = len(symbols)
    pair = local[:-1] * size + local[1:]
    if size**ORDER >= 1 << 63:  # number the pairs that occur
        found, pair = np.unique(pair, return_inverse=True)
        key = pair[at] * len(found) + pair[at + 2]
    else:
        key = pair[at] * size**2 + pair[at + 2]
    _, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    first = at[first]
    head = (own[first] << 2 * BITS) | (own[first + 1] << BITS) | own[first + 2]
    return head, own[first + 3], n, which


def _counter(batches):
    """The counts of n-grams in pieces of the other and of the target documents."""
    held: list[list[np.ndarray]] = [[], []]
    waiting = [0, 0]

    def flush(k):
        head, tail, n, _ = _grams(held[k])
        held[k].clear()
        waiting[k] = 0
        for at in range(0, len(n), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (head[part], tail[part], n[part], n[part] * k)], ["head", "tail", "n_all", "n_target"])

    for batch in batches:
        for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k = int(bool(target))
            for segment in _segments(text or ""):
                held[k].append(segment)
                waiting[k] += len(segment)
                if waiting[k] >= PIECE:
                    yield from flush(k)
    for k in range(2):
        if held[k]:
            yield from flush(k)


def losses(counts: np.ndarray, order: int, size: int, strength: float = STRENGTH) -> np.ndarray:
    """-ln p(last symbol | the others) for every n-gram, each order backed off to the next lower one.
    The plain definition over a dense array; _model() computes it over tables."""
    levels = [counts.reshape((size,) * order)]
    while levels[-1].ndim > 1:
        levels.append(levels[-1].sum(axis=0))
    p = np.full(size, 1.0 / size)
    for c in reversed(levels):
        p = (c + strength * p) / (c.sum(axis=-1, keepdims=True) + strength)
    return -np.log(p).reshape(-1)


def _model(counts: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """counts(head, tail, n_all, n_target) to (head, tail, target, background), the losses of every n-gram that occurs."""
    levels = [counts]
    for k in reversed(range(ORDER - 1)):
        shorter = F.col("head").bitwiseAND((1 << k * BITS) - 1).alias("head")
        levels.append(levels[-1].groupBy(shorter, "tail").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target")))
    size, n_all, n_target = levels[-1].agg(F.count("*"), F.sum("n_all"), F.sum("n_target")).first()
    scale = n_target / n_all if n_target else 1.0
    lower = None
    for k, level in enumerate(reversed(levels)):
        totals = level.groupBy("head").agg(F.sum("n_all").alias("of_all"), F.sum("n_target").alias("of_target"))
        both = level.join(totals, "head")
        if lower is None:
            both = both.withColumn("p_target", F.lit(1.0 / max(size, 1))).withColumn("p_all", F.lit(1.0 / max(size, 1)))
        else:
            both = both.withColumn("__short", F.col("head").bitwiseAND((1 << (k - 1) * BITS) - 1)).join(lower.withColumnRenamed("head", "__short"), ["__short", "tail"])
        smoothed = lambda n, of, p, by: (F.col(n) * by + strength * F.col(p)) / (F.col(of) * by + strength)
        lower = both.select("head", "tail", smoothed("n_target", "of_target", "p_target", 1.0).alias("p_target"), smoothed("n_all", "of_all", "p_all", scale).alias("p_all"))
    return lower.select("head", "tail", (-F.log("p_target")).alias("target"), (-F.log("p_all")).alias("background"))


def _scorer(model):
    """Scores by a model held in memory: heads, where the rows of each begin, tails, and losses, in order of head and tail."""

    def score(batches):
        heads, keys, tables = model.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            n, sums = np.zeros(len(texts), dtype=np.int64), np.zeros((2, len(texts)))
            held, owners, waiting = [], [], 0

            def flush():
                head, tail, _, which = _grams(held)
                row = np.searchsorted(keys, (np.searchsorted(heads, head) << BITS) | tail)
                lengths = np.array([len(x) for x in held]) - (ORDER - 1)
                np.add.at(n, owners, lengths)
                begins = np.cumsum([0, *lengths[:-1]])
                for own, table in zip(sums, tables, strict=True):
                    np.add.at(own, owners, np.add.reduceat(table[row][which], begins))
                held.clear()
                owners.clear()

            for k, text in enumerate(texts):
                for segment in _segments(text or ""):
                    held.append(segment)
                    owners.append(k)
                    waiting += len(segment)
                    if waiting >= PIECE:
                        flush()
                        waiting = 0
            if held:
                flush()
            losses_of = [pa.array(x / np.maximum(n, 1), pa.float64(), mask=n == 0) for x in (*sums, sums[0] - sums[1])]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(n, pa.int64()), *losses_of], ["__id", "n_tokens", "target_loss", "background_loss", "score"])

    return score


def _document_grams(batches):
    """(__row, __id, n_tokens, head, tail, n) for the n-grams of each document; one row without n-gram for a document without text."""
    names = ["__row", "__id", "n_tokens", "head", "tail", "n"]
    for batch in batches:
        for k, text in enumerate(batch.column("__text").to_pylist()):
            segments = list(_segments(text or ""))
            length = sum(len(x) - (ORDER - 1) for x in segments)
            parts = [_grams([x])[:3] for x in segments] or [([None], [None], [0])]
            for head, tail, n in parts:
                for at in range(0, len(n), 100_000):
                    many = len(n[at : at + 100_000])
                    own = batch.slice(k, 1).take(pa.array([0] * many))
                    yield pa.RecordBatch.from_arrays([own.column("__row"), own.column("__id"), pa.array([length] * many, pa.int64()), *(pa.array(x[at : at + 100_000], pa.int64()) for x in (head, tail, n))], names)


def lm_score(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = GRAMS) -> DataFrame:
    """Score every document; targets holds the ids of the target documents in its first column.

    Counts cover every character of every text, and every character is a symbol of its own. The
    model has a row for each different n-gram of the corpus, so it grows with it: up to `most`
    rows it is broadcast, and beyond that the n-grams of each document are joined to it.
    Returns doc_id, n_tokens, target_loss, background_loss, score. Null and empty texts count
    nothing and get 0 tokens and null losses; repeated rows are each scored; with no target
    documents the target model is uniform. Other columns are not read.
    """
    spark = docs.sparkSession
    # One name for each column we need, whatever else the table holds.
    docs = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    targets = targets.select(F.col(targets.columns[0]).alias("__id"), F.lit(True).alias("__target")).distinct()
    flagged = docs.join(small(targets), "__id", "left").select("__text", "__target")
    counts = flagged.mapInArrow(_counter, "head long, tail long, n_all long, n_target long")
    counts = materialize(counts.groupBy("head", "tail").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target")), "grams")
    model = materialize(_model(counts), "model")
    kind = docs.schema["__id"].dataType.simpleString()
    if model.limit(most + 1).count() <= most:
        rows = model.toArrow()
        head, tail, *tables = (rows.column(k).to_numpy() for k in range(4))
        order = np.lexsort((tail, head))
        heads, number = np.unique(head[order], return_inverse=True)
        held = spark.sparkContext.broadcast((heads, (number << BITS) | tail[order], [x[order] for x in tables]))
        out = docs.mapInArrow(_scorer(held), f"__id {kind}, n_tokens long, target_loss double, background_loss double, score double")
    else:
        numbered = docs.withColumn("__row", F.monotonically_increasing_id())
        grams = numbered.mapInArrow(_document_grams, f"__row long, __id {kind}, n_tokens long, head long, tail long, n long")
        mean = lambda c: F.try_divide(F.sum(F.col("n") * F.col(c)), F.col("n_tokens"))
        out = grams.join(model, ["head", "tail"], "left").groupBy("__row", "__id", "n_tokens").agg(mean("target").alias("target_loss"), mean("background").alias("background_loss"))
        out = out.select("__id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
    return out.withColumnRenamed("__id", "doc_id")
