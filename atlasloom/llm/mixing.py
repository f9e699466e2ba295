"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Rates w of documents minimise sum(w ln w - w + 1) subject to w <= 2 and, for each source, to
sum(size * w) = target. The dual gives w = min(2, exp(lambda * x)) with x the document's size over
its source's mean; lambda is found by Newton's method on the gradient of the dual, kept inside a
bracket. Documents of equal source and size have equal rates, so the iterations read a
histogram, and so does the rounding: from the largest size to the smallest each class takes whole
copies so that the words taken follow the words wanted, carrying the error on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize, small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
ROUNDS = 60
BLOCK = 1000  # size classes folded at once
RANKED = 100_000  # documents of one class that one task ranks, about


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(source, source_size): adds sid and target. Weights are dealt in the order of the source names,
    null last; targets are water-filled: what a source may not take is shared among the rest.
    The windows hold one row per source."""
    named = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("double")
    named = named.withColumn("weight", weight).withColumn("most", (most * F.col("source_size")).cast("double"))
    total = Window.partitionBy()
    up = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("budget_left") / F.col("weight_left")
    return (
        named.withColumn("budget_left", share * F.sum("source_size").over(total) - F.coalesce(F.sum("most").over(up), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        # The first source that the level does not reach sets it for all.
        .withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("most"), level)).over(total))
        .withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
        .select("sid", "source", "source_size", "target")
    )


def _rate(x: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))


def balance(hist: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """hist(sid, size, n), goals(sid, target): the multiplier of each source as (sid, lam, mean)."""
    seen = hist.where("size > 0").groupBy("sid").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("s"), F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = seen.join(goals.select("sid", "target"), "sid").withColumn("mean", F.col("s") / F.col("docs"))
    step = F.col("least") / F.col("mean")
    shrink = F.log(F.greatest(F.col("target") / F.col("s"), F.lit(1e-300))) / step
    state = state.withColumn("lo", F.when(F.col("target") < F.col("s"), shrink).otherwise(0.0))
    state = state.withColumn("hi", F.when(F.col("target") > F.col("s"), math.log(most) / step).otherwise(0.0))
    lam = F.when(F.col("target") >= most * F.col("s"), F.col("hi")).otherwise(0.0)
    state = materialize(state.withColumn("lam", lam).withColumn("open", (F.col("lo") < F.col("hi")) & (F.col("target") < most * F.col("s"))).drop("least", "docs"), "state")
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("mean")
        rate = _rate(x, most)
        mass = F.col("n") * F.col("size") * rate
        sums = hist.where("size > 0").join(small(state.where("open").select("sid", "lam", "mean")), "sid")
        sums = sums.groupBy("sid").agg(F.sum(mass).alias("got"), F.sum(F.when(rate < most, mass * x).otherwise(0.0)).alias("slope"))
        after = state.join(sums, "sid", "left")
        over = F.col("got") - F.col("target")
        after = after.withColumn("lo", F.when(over < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(over > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - over / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (F.col("lo") + F.col("hi")) / 2
        after = after.withColumn("next", F.when((newton >= F.col("lo")) & (newton <= F.col("hi")), newton).otherwise(middle))
        closed = (F.abs(over) <= 1e-9 * F.col("target")) | (F.abs(F.col("next") - F.col("lam")) <= 1e-13)
        after = after.withColumn("closed", closed).withColumn("lam", F.when(F.col("open"), F.col("next")).otherwise(F.col("lam")))
        after = after.withColumn("open", F.col("open") & ~F.col("closed"))
        after = materialize(after.select(state.columns), "state")
        discard(state)
        state = after
        if state.where("open").isEmpty():
            break
    else:
        raise ArithmeticError(f"entropy balancing did not converge in {ROUNDS} rounds")
    # Sums of doubles may differ in their last bits from run to run; the multiplier must not.
    return state.select("sid", F.round("lam", 9).alias("lam"), "mean")


def _fold(classes: Column) -> Column:
    """classes: array of (size, n, want), largest size first -> array of (size, copies)."""
    kind = "struct<got:double,want:double,out:array<struct<size:bigint,copies:bigint>>>"
    start = F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("want"), F.array().cast("array<struct<size:bigint,copies:bigint>>").alias("out")).cast(kind)

    def one(acc, c):
        want = acc["want"] + c["want"]
        copies = F.greatest(F.lit(0.0), F.least(2.0 * c["n"], F.round((want - acc["got"]) / c["size"]))).cast("long")
        made = F.struct(c["size"].cast("long").alias("size"), copies.alias("copies"))
        return F.struct((acc["got"] + copies * c["size"]).cast("double").alias("got"), want.cast("double").alias("want"), F.concat(acc["out"], F.array(made)).alias("out")).cast(kind)

    def block(acc, part):
        own = F.aggregate(part, F.struct(acc["got"].alias("got"), acc["want"].alias("want"), start["out"].alias("out")).cast(kind), one)
        return F.aggregate(F.array(own), acc, lambda a, y: F.struct(y["got"].alias("got"), y["want"].alias("want"), F.concat(a["out"], y["out"]).alias("out")).cast(kind))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(classes) - 1) / BLOCK).cast("int")), lambda i: F.slice(classes, i * BLOCK + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, start, block, lambda acc: acc["out"])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source_size, target, taken, copies, rate. Null and wordless texts have size 0,
    take nothing and keep their one copy; a null source is a source, the last. Repeated rows are
    documents of their own. Ties among documents of one source and size go by a hash of doc_id, so
    reruns agree. Other columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size")), "sized")
    goals = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "goals")
    hint = small(goals)
    joined = sized.alias("d").join(hint.alias("g"), F.expr("d.source <=> g.source")).select("d.doc_id", "d.size", "g.sid", "g.source_size", "g.target")
    hist = materialize(joined.groupBy("sid", "size").agg(F.count("*").alias("n")), "hist")
    lam = materialize(balance(hist, goals), "lam")
    rated = hist.where("size > 0").join(small(lam), "sid").withColumn("rate", _rate(F.col("size") / F.col("mean"), MOST))
    wanted = F.struct("size", "n", (F.col("n") * F.col("size") * F.col("rate")).alias("want"))
    folded = rated.groupBy("sid").agg(F.sort_array(F.collect_list(wanted), asc=False).alias("classes")).select("sid", F.explode(_fold(F.col("classes"))).alias("c"))
    whole = folded.select("sid", "c.size", F.col("c.copies").alias("k")).join(rated.select("sid", "size", "n", "rate"), ["sid", "size"])
    whole = materialize(whole, "whole")

    # Within a class of n documents k copies are dealt: k div n each, one more for k mod n of them.
    lots = max(1, -(-(hist.agg(F.max("n")).first()[0] or 0) // RANKED))
    dealt = joined.withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(lots)).cast("int"))
    counts = dealt.where("size > 0").groupBy("sid", "size", "lot").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("sid", "size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share_ = counts.withColumn("before", before).join(whole, ["sid", "size"])
    share_ = share_.select("sid", "size", "lot", "rate", F.floor(F.col("k") / F.col("n")).alias("each"), (F.col("k") % F.col("n") - F.col("before")).alias("more"))
    place = F.row_number().over(Window.partitionBy("sid", "size", "lot").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))
    ranked = dealt.where("size > 0").withColumn("place", place).join(share_, ["sid", "size", "lot"])
    copies = (F.col("each") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).cast("long")
    out = ranked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "rate")
    zero = F.lit(0).cast("long")
    empty = joined.where("size = 0").select("doc_id", "size", "source_size", "target", zero.alias("taken"), F.lit(1).cast("long").alias("copies"), F.lit(1.0).alias("rate"))
    return out.unionAll(empty)
