"""Dictionaries as tables: building them, and the set-based joins of tokens with them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import ALIASES, CONTEXT, PHRASES
from ..functions.predicates import brand_token, correctable
from ..functions.text import fold, folded_tokens, has_digit, has_listed_mark, match_case, starts_lower, starts_upper, tokens

WINDOW = 3
LONGEST = 5
RUN = 500_000


def known_tokens(spellings: DataFrame, column: str = "spelling") -> DataFrame:
    """(token) of every folded word of the spellings, once."""
    return spellings.select(F.explode(folded_tokens(F.col(column), r"[A-Za-zÀ-ỹĐđ0-9&]+")).alias("token")).distinct()


def with_known(words: DataFrame, known: DataFrame, column: str = "word") -> DataFrame:
    """words with is_known; any size of dictionary, joined by the folded word."""
    marked = known.select(F.col("token").alias("__key"), F.lit(True).alias("is_known")).distinct()
    out = words.withColumn("__key", fold(F.col(column))).join(marked, "__key", "left")
    return out.withColumn("is_known", F.coalesce("is_known", F.lit(False))).drop("__key")


def phrase_ngrams(spellings: DataFrame, column: str = "spelling", order: str = "ordinal") -> DataFrame:
    """The best spelling of every phrase of two to five words: (key, spelling, marks). More marked words win, then the first."""
    # Words are folded and judged once a text, and the phrases of a batch of texts are reduced before they are shuffled.
    w = F.transform(tokens(F.col(column)), lambda x: F.struct(x.alias("word"), fold(x).alias("key"), has_listed_mark(x).cast("int").alias("mark"), has_digit(x).alias("digit")))
    texts = spellings.select(F.col(order).alias("o"), w.alias("w")).where(F.size("w") >= 2).select("o", F.col("w.word").alias("word"), F.col("w.key").alias("key"), F.col("w.mark").alias("mark"), F.col("w.digit").alias("digit"))
    kind = spellings.select(order).schema[0].dataType.simpleString()
    grams = texts.mapInArrow(_best_phrases, f"key string, spelling string, marks int, o {kind}, n int, i int")
    best = F.max_by(F.struct("spelling", "marks"), F.struct("marks", -F.col("o"), -F.col("n"), -F.col("i")))
    return grams.groupBy("key").agg(best.alias("b")).select("key", "b.spelling", "b.marks")


def _runs(batch):
    ends = batch.column("word").offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def _best_phrases(batches):
    """The best spelling, in each run of texts of about RUN words, of every phrase that has a marked word and no digit."""
    for batch in (part for whole in batches for part in _runs(whole)):
        lists = batch.column("word")
        n = np.diff(lists.offsets.to_numpy())
        word, key = lists.flatten(), batch.column("key").flatten()
        mark = batch.column("mark").flatten().to_numpy().astype(np.int64)
        digit = batch.column("digit").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        code = key.dictionary_encode()
        ids = code.indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(n)), n)
        ends = np.repeat(np.cumsum(n), n)
        first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        marks, digits = (np.concatenate([[0], np.cumsum(x)]) for x in (mark, digit))
        number = pc.rank(batch.column("o"), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        group = ids
        for size in range(2, LONGEST + 1):
            # The group of the first words, then the next word: numbers of what occurs, so that equal numbers are equal phrases.
            at = np.flatnonzero(np.arange(len(text)) + size <= ends)
            whole = np.full(len(text), -1, dtype=np.int64)
            whole[at] = np.unique(group[at] * len(code.dictionary) + ids[at + size - 1], return_inverse=True)[1]
            group = whole
            m = marks[at + size] - marks[at]
            good = (m > 0) & (digits[at + size] == digits[at])
            at, m = at[good], m[good]
            order = np.lexsort((first[at], number[text[at]], -m, group[at]))
            at, m = at[order], m[order]
            own = group[at]
            best = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
            at, m = at[best], m[best]
            for k in range(0, len(at), 100_000):
                part, of = at[k : k + 100_000], m[k : k + 100_000]
                joined = lambda c: pc.binary_join_element_wise(*(c.take(pa.array(part + j)).cast(pa.string()) for j in range(size)), " ")  # noqa: B023,E731
                columns = [joined(key), joined(word), pa.array(of.astype(np.int32)), batch.column("o").take(pa.array(text[part])), pa.array(np.full(len(part), size, dtype=np.int32)), pa.array(first[part].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "spelling", "marks", "o", "n", "i"])


def _rules(spark):
    flat = [(base, spelled, word) for base, spelled, near in CONTEXT for word in near]
    return spark.createDataFrame(flat, "base string, spelled string, near string")


def context_rewrites(words: DataFrame, text: str = "doc_id") -> DataFrame:
    """words(text, at, word): tokens that a context rule rewrites, as (text, at, word, spelled). A rule holds if one of its
    words stands within three tokens; the rules have different bases, so at most one fits."""
    keyed = words.withColumn("key", fold(F.col("word")))
    rules = F.broadcast(_rules(words.sparkSession))  # a few dozen built-in rows
    hits = keyed.where(~brand_token(F.col("word"))).join(rules, F.col("key") == F.col("base")).select(text, "at", "word", "spelled", "near")
    around = keyed.select(text, F.col("at").alias("other"), F.col("key").alias("near"), F.col("word").alias("other_word"))
    # By position, so that a long text costs its length and not its square.
    hits = hits.withColumn("other", F.explode(F.array(*(F.col("at") + k for k in range(-WINDOW, WINDOW + 1) if k))))
    near = hits.join(around, [text, "other", "near"])
    found = near.select(text, "at", "word", "spelled").distinct()
    before = keyed.select(text, (F.col("at") + 1).alias("at"), F.col("word").alias("previous"))
    out = found.join(before, [text, "at"], "left")
    after_capital = F.coalesce(starts_lower(F.col("word")) & starts_upper(F.col("previous")), F.lit(False))
    return out.select(text, "at", "word", F.when(after_capital, F.col("spelled")).otherwise(match_case(F.col("word"), F.col("spelled"))).alias("spelled"))


def context_rewrites_within(texts: DataFrame, text: str = "doc_id") -> DataFrame:
    """context_rewrites of texts(text, words), one row and one array of words a text: every text is read on its own, and
    nothing is shuffled. Texts without an id give nothing."""
    keyed = texts.where(F.col(text).isNotNull()).select(text, "words", F.transform("words", fold).alias("keys"))
    first = lambda i: F.greatest(i - WINDOW, F.lit(0))
    window = lambda i: F.concat(F.slice("keys", first(i) + 1, i - first(i)), F.slice("keys", i + 2, F.lit(WINDOW)))
    bases = sorted({base for base, *_ in CONTEXT})
    hit = lambda i: F.struct(i.alias("at"), F.get("words", i).alias("word"), F.get("keys", i).alias("key"), F.get("words", i - 1).alias("previous"), window(i).alias("around"))
    places = F.filter(F.transform("keys", lambda k, i: F.when(k.isin(bases), i)), lambda i: i.isNotNull())
    hits = keyed.select(text, F.explode(F.transform(places, hit)).alias("h")).select(text, "h.*").where(~brand_token(F.col("word")))
    rules = [(base, spelled, list(near)) for base, spelled, near in CONTEXT]
    rules = F.broadcast(texts.sparkSession.createDataFrame(rules, "base string, spelled string, near array<string>"))
    found = hits.join(rules, (F.col("key") == F.col("base")) & F.arrays_overlap("around", "near"))
    after_capital = F.coalesce(starts_lower(F.col("word")) & starts_upper(F.col("previous")), F.lit(False))
    return found.select(text, "at", "word", F.when(after_capital, F.col("spelled")).otherwise(match_case(F.col("word"), F.col("spelled"))).alias("spelled"))


def phrase_hits(words: DataFrame, text: str = "doc_id") -> DataFrame:
    """Where built-in phrases stand: (text, at, phrase, spelled); overlapping hits are all reported."""
    phrases = [(" ".join(s), " ".join(t), len(s)) for s, t in PHRASES]
    listed = F.broadcast(words.sparkSession.createDataFrame(phrases, "phrase string, spelled string, n int"))
    grouped = words.groupBy(text).agg(F.sort_array(F.collect_list(F.struct("at", fold(F.col("word")).alias("k"), "word"))).alias("w"))
    sized = grouped.withColumn("n", F.explode(F.array(*map(F.lit, sorted({n for *_, n in phrases}))))).where(F.col("n") <= F.size("w"))
    spans = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.slice("w", i + 1, F.col("n")))
    gram = sized.select(text, "n", F.explode(spans).alias("span")).select(text, "n", F.col("span")[0]["at"].alias("at"), "span")
    gram = gram.withColumn("phrase", F.array_join(F.transform("span", lambda x: x["k"]), " ")).where(~F.exists("span", lambda x: brand_token(x["word"])))
    return gram.join(listed, ["phrase", "n"]).select(text, "at", "phrase", "spelled")


def alias_rewrites(words: DataFrame, text: str = "doc_id") -> DataFrame:
    """Tokens that stand for a place on their own, in short texts or texts with Vietnamese marks."""
    aliases = F.broadcast(words.sparkSession.createDataFrame(list(ALIASES.items()), "key string, spelled string"))
    vietnamese = words.groupBy(text).agg((F.bool_or(has_listed_mark(F.col("word"))) | (F.count("*") <= 3)).alias("apt"))
    found = words.withColumn("key", fold(F.col("word"))).where(~brand_token(F.col("word"))).join(aliases, "key")
    return found.join(vietnamese.where("apt"), text, "left_semi").select(text, "at", "word", "spelled")


def spelling_counts(weighted: DataFrame) -> DataFrame:
    """weighted(ordinal, word, weight) to (key, weight, word): summed weights, and the first marked spelling, else the first."""
    good = weighted.where(F.col("word").rlike("^[A-Za-zÀ-ỹĐđ]{2,}$") & ~brand_token(F.col("word")))
    marked = has_listed_mark(F.col("word")).cast("int")
    return good.groupBy(fold(F.col("word")).alias("key")).agg(F.sum("weight").alias("weight"), F.max_by("word", F.struct(marked, -F.col("ordinal"))).alias("word"))


def _deletes(key: Column) -> Column:
    """key and what is left of it without one or two characters."""
    one = lambda k: F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substr(k, F.lit(1), i - 1), F.substr(k, i + 1)))
    once = one(key)
    return F.array_distinct(F.concat(F.array(key), once, F.flatten(F.transform(once, one))))


def closest_spellings(words: DataFrame, counts: DataFrame) -> DataFrame:
    """Unknown words and the one dictionary word nearest to them: (word, spelled, distance).

    Distance is at most 1 for keys of four letters or fewer, else 2. If a second word is as near and has
    four fifths of the best one's weight, there is no answer. Candidates share a form with up to two
    letters deleted, so the join is by equality.
    """
    unknown = words.select("word").distinct().where(correctable(F.col("word"))).withColumn("key", fold(F.col("word")))
    unknown = unknown.join(counts.select("key"), "key", "left_anti")
    left = unknown.select("word", "key", F.explode(_deletes(F.col("key"))).alias("form"))
    right = counts.select(F.col("key").alias("other"), "weight", F.col("word").alias("spelled"), F.explode(_deletes(F.col("key"))).alias("form"))
    pairs = left.join(right, "form").select("word", "key", "other", "weight", "spelled").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("key", "other", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.when(F.length("key") <= 4, 1).otherwise(2)))
    best = pairs.groupBy("word").agg(F.min(F.struct("distance", (-F.col("weight")).alias("less"), "other")).alias("b"))
    near = pairs.join(best, "word").where((F.col("distance") == F.col("b.distance")) & (F.col("weight") >= F.greatest(F.lit(1), F.floor(-F.col("b.less") * 0.8))))
    sole = near.groupBy("word").agg(F.count("*").alias("n"), F.min("spelled").alias("spelled"), F.min("distance").alias("distance")).where("n = 1")
    return sole.where(~brand_token(F.col("spelled"))).select("word", match_case(F.col("word"), F.col("spelled")).alias("spelled"), "distance")


