"""URL filters: rules, then a tree of path templates judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEPTH = 4  # levels of the tree in SQL, which is the same on paths of no more segments
CUT = 4  # levels after which a table is written, so that plans stay short
SUPPORT = 20  # pages on a literal segment at least
SPREAD = 3.0  # pages per distinct segment below which all segments of a node are variable
Z = 1.96  # branches nearer than this to their pooled siblings are merged with them
PRIOR = 10.0  # labelled pages that the corpus rate counts for in a template
IMPURE = 0.5
ANY = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(__url, instr(__url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, start = text.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _typed(segment: Column) -> Column:
    """Numbers, dates, hashes and long mixed ids are variable by their form; an extension stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    variable = stem.rlike(r"^[0-9][0-9_\-]*$|^[0-9a-fA-F\-]{12,}$|^(?=.*[0-9])[A-Za-z0-9_\-]{16,}$")
    return F.when(variable, F.concat(F.lit(ANY), ending)).otherwise(segment)


def _templates(leaves: DataFrame, depth: int) -> DataFrame:
    """leaves(host, path, n, seen, bad) with the path's template, from the root to the leaves, the deepest of which have depth segments."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    out = leaves.withColumn("template", F.transform(segments, _typed))
    for k in range(depth):
        here = F.slice("template", 1, k)
        node = out.where(F.size("template") > k).groupBy("host", here.alias("head"), F.col("template")[k].alias("segment")).agg(F.sum("n").alias("n"))
        spread = node.groupBy("host", "head").agg((F.sum("n") / F.count("*")).alias("spread"))
        rare = node.join(small(spread), ["host", "head"]).where((F.col("n") < SUPPORT) | (F.col("spread") < SPREAD)).where(~F.col("segment").startswith(ANY))
        rare = materialize(rare.select("host", "head", "segment", F.lit(True).alias("rare")), "rare")
        out = out.withColumn("head", here).withColumn("segment", F.get("template", F.lit(k))).join(small(rare), ["host", "head", "segment"], "left")
        changed = F.concat(F.col("head"), F.array(F.lit(ANY)), F.slice("template", k + 2, depth))
        out = out.withColumn("template", F.when(F.col("rare"), changed).otherwise(F.col("template"))).drop("head", "segment", "rare")
        if k % CUT == CUT - 1:
            out = materialize(out, "level")
    return out


def _merged(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes(host, template, seen, bad): the template each is merged into, from the leaves to the root.
    A branch that does not differ from its siblings' pool in its share of bad pages joins it."""
    out = nodes.withColumn("into", F.col("template"))
    for k in reversed(range(depth)):
        key = F.when(F.size("into") > k, F.concat(F.slice("into", 1, k), F.array(F.lit(ANY)), F.slice("into", k + 2, depth))).otherwise(F.col("into"))
        branch = out.groupBy("host", "into").agg(F.sum("seen").alias("s"), F.sum("bad").alias("b")).withColumn("key", key)
        pool = branch.groupBy("host", "key").agg(F.sum("s").alias("ps"), F.sum("b").alias("pb"))
        both = branch.join(small(pool), ["host", "key"])
        rest, rest_bad = F.col("ps") - F.col("s"), F.col("pb") - F.col("b")
        p = (F.col("pb") + 0.5) / (F.col("ps") + 1.0)
        z = F.try_divide(F.try_divide(F.col("b"), F.col("s")) - F.try_divide(rest_bad, rest), F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), F.col("s")) + F.try_divide(F.lit(1), rest))))
        alike = F.when((F.col("s") > 0) & (rest > 0), F.abs(z) < Z).otherwise(True)
        move = materialize(both.select("host", "into", F.when(alike, F.col("key")).otherwise(F.col("into")).alias("moved")), "merge")
        out = out.join(small(move), ["host", "into"]).withColumn("into", F.col("moved")).drop("moved")
        if k % CUT == CUT - 1:
            out = materialize(out, "level")
    return out


def url_filter(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Judge every url: by the longest rule that fits, else by its path template.

    labelled(page_id, bad): labels for some pages. A template is blocked if its share of bad pages,
    smoothed by PRIOR pages at the corpus rate, reaches IMPURE. Returns page_id, host, path, rule,
    verdict, template, impurity. A null url, or one without ://, has empty host and path, no
    rule, and is judged like any template. Paths of any depth have a template of all their segments. Repeated rows are each judged. Work after the first
    aggregation is on distinct paths and tree nodes. Other columns are not read.
    """
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    parsed = read.select("page_id", host.alias("host"), path.alias("path"))
    marks = labelled.select(F.col(labelled.columns[0]).alias("page_id"), F.col("bad").cast("int").alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    leaves = parsed.join(marks, "page_id", "left").groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    leaves = materialize(leaves, "leaves")
    # As many levels as the deepest path has segments.
    depth = leaves.agg(F.max(F.size(F.filter(F.split("path", "/"), lambda s: s != "")))).first()[0] or 0
    leaves = materialize(_templates(leaves, depth), "templates")
    nodes = materialize(leaves.groupBy("host", "template").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")), "nodes")
    merged = materialize(_merged(nodes, depth), "merged")
    rate = nodes.agg(F.try_divide(F.sum("bad"), F.sum("seen"))).first()[0] or 0.0
    impurity = (F.sum("bad") + PRIOR * rate) / (F.sum("seen") + PRIOR)
    judged = merged.groupBy("host", "into").agg(impurity.alias("impurity"))
    judged = merged.select("host", "template", "into").join(judged, ["host", "into"])
    judged = leaves.select("host", "path", "template").join(judged, ["host", "template"]).select("host", "path", F.concat(F.lit("/"), F.array_join("into", "/")).alias("template"), "impurity")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("impurity") >= IMPURE, "block").otherwise("allow")
    out = parsed.join(judged, ["host", "path"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "template", "impurity")
