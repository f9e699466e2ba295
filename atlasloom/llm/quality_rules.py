"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

#: Common function words of the languages that the corpus is kept in.
STOP_WORDS = """
    the be to of and that have with a in is it for on as was by this are from at or an
    der die das und ist in den von zu mit sich auf für nicht ein eine dem des im auch er es an als
    de la que el en y a los se del las un por con no una su para es al lo
    le et les des en un une du que est pour qui dans ce il sur au pas par plus avec la
""".split()


class Rule(NamedTuple):
    """A document is rejected where value lies outside low to high; a null value passes."""

    name: str
    value: Callable[[Column], Column]
    low: float | None
    high: float | None


def _per(over: str, under: str) -> Callable[[Column], Column]:
    return lambda m: F.try_divide(m[over], m[under])


#: The method's own verdict, over the measures of a document.
RULES = (
    Rule("words", lambda m: m["n_words"], 50, None),
    Rule("repeated words", _per("n_repeat_words", "n_words"), None, 0.5),
    Rule("mean word length", _per("word_chars", "n_words"), 2, 15),
    Rule("symbols to words", _per("n_symbols", "n_words"), None, 0.1),
    Rule("repeated lines", _per("n_dup_lines", "n_lines"), None, 0.6),
    Rule("stop words", _per("n_stop_words", "n_words"), 0.02, None),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def _strings() -> Column:
    return F.array().cast("array<string>")


def _windows(w: Column) -> Column:
    """The windows of three words, with their places."""
    gram = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: i + 3 <= F.size(w)), gram)


def _repeat_words(w: Column) -> Column:
    """Words in a window of three that occurs twice or more in w."""

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | ((i < last) & (F.get(s, i + 1)["g"] == x["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(s, twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # Texts without a repeated window, which are most, are not sorted.
    return _let(_windows(w), lambda g: F.when(F.size(F.array_distinct(F.transform(g, lambda x: x["g"]))) < F.size(g), _let(F.sort_array(g), covered)).otherwise(0))


def measure(text: Column, table: tuple[Rule, ...] = RULES) -> Column:
    """A struct of a document's measures and verdicts."""
    lines = F.coalesce(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), _strings())
    stop = sorted(set(STOP_WORDS))

    def counts(w: Column, x: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", "")), F.lit(0)).cast("long").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(x).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda v: F.lower(v).isin(stop))).cast("long").alias("n_stop_words"),
        )

    def judged(m: Column) -> Column:
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        broken = []
        for r in table:
            outside = F.lit(False)
            if r.low is not None:
                outside = outside | (r.value(m) < r.low)
            if r.high is not None:
                outside = outside | (r.value(m) > r.high)
            broken.append(F.when(F.coalesce(outside, F.lit(False)), F.lit(r.name)))
        failed = F.concat_ws(", ", *broken)
        own = [m[c].alias(c) for c in COUNTS]
        return F.struct(*own[:5], base.alias("base_failed"), (~base & (failed == "")).alias("kept"), *own[5:], failed.alias("failed_rules"))

    return _let(words(text), lambda w: _let(lines, lambda x: _let(counts(w, x), judged)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measure every whole text and judge it; one narrow projection, no shuffle, no Python.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_stop_words, failed_rules. A null text has no words: it counts 0 everywhere and
    fails. Repeated rows are each judged. Other columns are not read.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), measure(F.col(text), table).alias("m")).select("doc_id", "m.*")
