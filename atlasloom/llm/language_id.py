"""Language ID by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300  # n-grams of a profile, and the out-of-place distance of one that is missing
PIECE = 1 << 20  # letters handled at once
UNKNOWN = "und"


@lru_cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _sequence(text: str) -> np.ndarray | None:
    """Lower-cased letters, with one space for whatever stands between words and at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    own = np.where(letter, codes, 32)[keep].astype(np.int64)
    return np.concatenate([[32], own, [32]] if own[-1] != 32 else [[32], own])


def _grams(seq: np.ndarray):
    """Letters, pairs and triples within words and their borders, 21 bits for each character."""
    for at in range(0, len(seq), PIECE):
        x = seq[at : at + PIECE + 2]
        fresh = min(PIECE, len(seq) - at)
        one = x[:fresh]
        two = (x[:-1] << 21 | x[1:])[:fresh]
        three = (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[:fresh]
        yield np.concatenate([one[one != 32], two, three[x[1 : 1 + len(three)] != 32]])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    gram, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return gram, np.bincount(where, weights=np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)


def _counts(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _merge([np.unique(g, return_counts=True) for g in _grams(seq)])


def _count_by_language(batches):
    held: dict[str, list] = {}
    waiting: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (seq := _sequence(text)) is not None:
                found = held.setdefault(lang, [])
                found.append(_counts(seq))
                waiting[lang] = waiting.get(lang, 0) + len(found[-1][0])
                if waiting[lang] > PIECE:
                    held[lang] = [_merge(found)]
                    waiting[lang] = 0
    for lang, parts in held.items():
        gram, n = _merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """For each language of docs the n-grams that are most frequent over all its texts, most
    frequent first; ties go to the smaller code. What reaches the driver is profile rows a language."""
    learn = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = learn.mapInArrow(_count_by_language, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for row in counts.withColumn("rank", rank).where(F.col("rank") <= profile).orderBy("lang", "rank").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def predict(text: Column, profiles: dict[str, list[int]], profile: int = PROFILE) -> Column:
    """struct(lang_pred, score): the language whose profile is nearest by out-of-place distance
    (ties: the first by name) and 1 minus that distance over the largest possible one."""
    langs = sorted(profiles)
    known = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
    ranks = np.full((len(langs), len(known)), -1, dtype=np.int64)
    for k, name in enumerate(langs):
        ranks[k, np.searchsorted(known, np.array(profiles[name], dtype=np.int64))] = np.arange(len(profiles[name]))

    def one(value):
        if value is None or not langs or (seq := _sequence(value)) is None:
            return UNKNOWN, 0.0
        gram, n = _counts(seq)
        top = gram[np.argsort(-n, kind="stable")[:profile]]
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        there = np.where(known[at] == top, ranks[:, at], -1)
        out_of_place = np.where(there >= 0, np.minimum(np.abs(there - np.arange(len(top))), profile), profile).sum(axis=1)
        best = int(np.argmin(out_of_place))
        return langs[best], 1.0 - float(out_of_place[best]) / (profile * len(top))

    @F.pandas_udf("lang_pred string, score double")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in texts], columns=["lang_pred", "score"])

    return nearest.asNondeterministic()(text)


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 3 (null ids: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict all of them.

    Returns doc_id, held_out, lang_pred, score for each row, repeated rows included. A null text, a
    text with no letter, or a table without labelled texts gives `und` with score 0. Whole texts
    are read; very long ones in pieces whose counts are added. Other columns are not read.
    """
    profiles = train(docs.where(~held_out(doc_id)), text, lang)
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), predict(F.col(text), profiles).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
