"""Exact Jaccard join of documents over word shingles as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are shingles. Sets that are equal are one
row. Only a prefix of each row is multiplied: under one order of all shingles, two sets with
Jaccard of at least t share one of their first n - ceil(t n) + 1 shingles. The order puts frequent
shingles last, by doublings of their counts, so columns that many documents share rarely enter the product; the order decides
cost alone, never the result. Most columns have one entry; blocks
of columns, packed as arrays, find those with several. For two sets of given sizes n and m the
overlap must reach o = ceil(t (n + m) / (1 + t)), and they share one of the first n - o + 1 shingles of
one that is among the first m - o + 1 of the other, so only such entries bring them together.

1. In rounds, some documents of each long column that still holds several components are its
   hubs; each document of another component is compared with those hubs that it shares most
   long columns with. Large groups of near copies become components at a cost linear in their size.
2. All columns that still hold several components are multiplied out between components, in tiles.

Pairs are discarded if sizes and shared prefixes rule the Jaccard out, then if the first SKETCH bits of all
shingles do, and the rest are verified on whole sets. A pair is skipped only if verified links join its documents already, so no
component is missed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, materialize, small, spread_join
from .components import components

SHINGLE = 5
PERCENT = 75
CELLS = 1 << 22  # of the frequency sketch, which only orders shingles
BLOCK = 1_000_000  # entries of the matrix in a block of columns, about
TILE = 512  # documents of one column that a task multiplies with as many others
LOT = 1000  # partners of one document that meet it in one task
PIECE = 1 << 22  # bytes of text whose words are hashed at once
LONG = 4  # documents of a column beyond which it has hubs,
HUBS = 4  # as many in each round
BEFORE = 4  # shared columns before this one by which a pair is known to have met already
ROUNDS = 3  # of hubs at most; one that finds less than a share of 1 / FEWER of the first one's links is the last
FEWER = 10
SKETCH = 16  # bits of each shingle that bound an overlap,
SKETCHED = 4096  # in sets of at most so many; larger ones are verified at once
SALTED = 100_000  # entries of one column that go to one task

_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _RNG.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(longest: int) -> np.ndarray:
    """Powers of the base. Those of words of common lengths are kept."""
    global _powers
    if longest <= len(_powers):
        return _powers
    out = np.cumprod(np.concatenate([_powers[:1], np.full(max(longest, 1 << 12) - 1, _BASE)]), dtype=np.uint64)
    if len(out) <= 1 << 16:
        _powers = out
    return out


def _word_hashes(text: bytes) -> np.ndarray:
    """A polynomial in an odd base modulo 2**64 for each word, then mixed."""
    out = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        b = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        at = end
        space = _SPACE[b]
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        place = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(b)]])))
        value = (b.astype(np.uint64) + np.uint64(1)) * _powers_to(int(place.max()) + 1)[place]
        value[space] = 0
        out.append(_mix(np.add.reduceat(value, starts)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The document's set as sorted 64-bit hashes. Two different shingles of a pair of documents of a
    thousand words meet with a chance of about 1e-13, and would then only add one to an overlap."""
    h = _word_hashes((text or b"").lower())  # of bytes: A-Z alone
    if not len(h):
        return h
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out += h[k : k + len(out)] * _ODD[k]
    return np.unique(_mix(out))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _texts(column: pa.Array):
    """Its values, one after the other."""
    for value in column:
        yield value.as_py()


def _frequent(batches):
    """Cells that are clearly above this task's mean, and their counts."""
    total, held, waiting = np.zeros(CELLS, dtype=np.int32), [], 0

    def add():
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        total[cell] += n.astype(np.int32)
        held.clear()

    for batch in batches:
        for text in _texts(batch.column(0)):
            held.append(_cell(shingles(text)))
            waiting += len(held[-1])
            if waiting > CELLS // 8:
                add()
                waiting = 0
    if held:
        add()
    mean = total.mean()
    cell = np.flatnonzero(total >= mean + 5 * np.sqrt(mean) + 4)
    for at in range(0, len(cell), 100_000):
        part = cell[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part], pa.int64())], ["cell", "n"])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _prefixes(levels, percent):
    def rows(batches):
        for batch in batches:
            n, prints, rare, common = [], [], [], []
            for text in _texts(batch.column(1)):
                own = shingles(text)
                n.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()))
                level = levels.value[_cell(own)]
                late = level > 0
                keep = len(own) + (len(own) > 0) - -(-percent * len(own) // 100)
                rare.append(own[~late][:keep])
                common.append(own[late][np.argsort(level[late], kind="stable")][: keep - len(rare[-1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), _lists(rare), _lists(common)], ["id", "n", "print", "rare", "common"])

    return rows


def _deal(blocks: int):
    """Entries of rare columns, packed by block of columns: of each document in a block its id, its size and how many
    entries it has there, and of each entry its place in the prefix and the lower half of its shingle. The upper
    half chose the block, so columns that meet by chance are about one in ten thousand; they cost a comparison."""

    def deal(batches):
        for batch in batches:
            lists = batch.column("rare")
            n = np.diff(lists.offsets.to_numpy())
            gram = lists.flatten().to_numpy().view(np.uint64)
            place = (np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            doc = np.repeat(np.arange(len(n)), n)
            block = (gram >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
            order = np.argsort(block, kind="stable")
            block, doc, place, low = block[order], doc[order], place[order], gram[order].astype(np.uint32)
            ids, sizes = batch.column("id").to_numpy(), batch.column("n").to_numpy().astype(np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
            out: dict[str, list] = {k: [] for k in ("block", "lows", "places", "ids", "sizes", "counts")}
            for i, j in zip(cuts, cuts[1:], strict=False):
                first = np.concatenate([[0], np.flatnonzero(np.diff(doc[i:j])) + 1])
                own = doc[i:j][first]
                out["block"].append(int(block[i]))
                for k, x in (("lows", low[i:j]), ("places", place[i:j]), ("ids", ids[own]), ("sizes", sizes[own]), ("counts", np.diff(np.append(first, j - i)).astype(np.int32))):
                    out[k].append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int32()), *(pa.array(x, pa.binary()) for k, x in out.items() if k != "block")], list(out))

    return deal


_PARTS = {"lows": np.uint32, "places": np.int32, "ids": np.int64, "sizes": np.int32, "counts": np.int32}


def _several(batches):
    """The columns that have several entries, one block after the other; rows come in order of their blocks."""
    now, parts = None, {k: [] for k in _PARTS}
    for batch in batches:
        for k, block in enumerate(batch.column("block").to_pylist()):
            if block != now:
                yield from _block(now, parts)
                now, parts = block, {k: [] for k in _PARTS}
            for name, kind in _PARTS.items():
                parts[name].append(np.frombuffer(batch.column(name)[k].as_py(), dtype=kind))
    yield from _block(now, parts)


def _block(block: int | None, parts: dict[str, list[np.ndarray]]):
    if block is None:
        return
    low, place, ids, sizes, counts = (np.concatenate(parts.pop(k)) for k in _PARTS)
    order = np.argsort(low, kind="stable")
    same = low[order[1:]] == low[order[:-1]]
    keep = np.zeros(len(low), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    many = np.diff(np.append(np.flatnonzero(np.concatenate([[True], ~same])), len(low))) if len(low) else np.zeros(0, dtype=np.int64)
    many = np.repeat(many, many)[keep]
    order = order[keep]
    doc = np.repeat(np.arange(len(ids)), counts)[order]
    gram, place = low[order].astype(np.int64) | block << 32, place[order]
    for at in range(0, len(gram), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram[part], ids[doc[part]], place[part], sizes[doc[part]], many[part])], ["gram", "id", "at", "n", "m"])


def _sets(batches):
    """Each document's set, and of a set that is not too large the first bits of its shingles: those that differ, and how many
    shingles have them from another."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            own = [shingles(x) for x in _texts(part.column(1))]
            first = [np.unique(x >> np.uint64(64 - SKETCH)).astype(np.uint16) for x in own]
            size = np.array([len(x) for x in own], dtype=np.int64)
            over = size > SKETCHED
            ends = np.concatenate([[0], np.cumsum(np.where(over, 0, [len(x) for x in first]))]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.uint16), *(x for x, skip in zip(first, over, strict=True) if not skip)])
            bits = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int16)))
            twins = pa.array(size - [len(x) for x in first], mask=over)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), bits, twins, _lists(own)], ["id", "n", "bits", "twins", "set"])


def _meet(at, n, other_at, m, percent: int) -> Column:
    """Whether a column that two sets share at these places lies in the prefixes that their sizes call for."""
    n, m = F.col(n), F.col(m)
    needed = _needed(n, m, percent)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.col(at) <= n - needed) & (F.col(other_at) <= m - needed)


def _attach(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Written pairs (a, b) with the structs va and vb of values (id, ...). The partners of one document are dealt in lots, so
    that no task gets all partners of a document that very many others are compared with."""
    packed = values.select("id", F.struct(*(c for c in values.columns if c != "id")).alias("v"))
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    dealt = pairs.join(lots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"))
    left = packed.join(small(lots.withColumnRenamed("a", "id"), pairs.seen["n"]), "id").select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col("v").alias("va"))
    right = packed.select(F.col("id").alias("b"), F.col("v").alias("vb")).join(small(dealt, pairs.seen["n"]), "b")
    return right.join(left, ["a", "lot"]).select("a", "b", "va", "vb")


def _possible(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sizes and prefixes allow the Jaccard asked for: beyond the shingles that two prefixes
    share, sets share no more than what follows the prefix that ends first."""
    both = _attach(pairs, shared)
    n_a, n_b = F.col("va.n"), F.col("vb.n")
    rest = F.greatest(n_a - F.col("va.p"), n_b - F.col("vb.p"))
    near = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    common = F.size(F.array_intersect("va.grams", "vb.grams")) + F.col("va.twins")
    return both.where(near & (common + rest >= _needed(n_a, n_b, percent))).select("a", "b")


def _verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets have the Jaccard asked for. Sets whose shingles begin alike share at most
    what begins alike, and of shingles that begin like another of their set the fewer."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    sets = materialize(docs.join(small(ids, 2 * pairs.seen["n"]), "id", "left_semi").mapInArrow(lean(_sets), "id long, n long, bits array<smallint>, twins long, set array<bigint>"), "sets")
    both = _attach(pairs, sets.select("id", "n", "bits", "twins"))
    common = F.size(F.array_intersect("va.bits", "vb.bits")) + F.least("va.twins", "vb.twins")
    unsure = F.col("va.twins").isNull() | F.col("vb.twins").isNull()
    near = materialize(both.where(unsure | (common >= _needed(F.col("va.n"), F.col("vb.n"), percent))).select("a", "b"), "near")
    both = _attach(near, sets.select("id", "set")).withColumn("common", F.size(F.array_intersect("va.set", "vb.set")))
    linked = both.where(100 * F.col("common") >= percent * (F.size("va.set") + F.size("vb.set") - F.col("common")))
    out = materialize(linked.select("a", "b").distinct(), "links")
    discard(sets, near)
    return out


def _needed(n, m, percent: int) -> Column:
    """The least overlap of two sets of these sizes."""
    return F.ceil((n + m) * percent / (100 + percent))


def _named(columns: DataFrame, known: DataFrame | None) -> DataFrame:
    """columns with each document's component so far."""
    if known is None:
        return columns.withColumn("component", F.col("id"))
    names = small(known.select(F.col("node").alias("id"), "component"), known.seen["n"])
    return columns.join(names, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed(columns: DataFrame, known: DataFrame | None, percent: int, *more: Column) -> DataFrame:
    """Entries (gram, id, at, own, n, m, component, ...) of columns with several components and an entry that can start a comparison;
    more are further aggregates of a column. A long column's entries are dealt in lots."""
    named = _named(columns, known)
    starts = F.col("at") <= F.col("n") - _needed(F.col("n"), F.col("n"), percent)
    lots = F.ceil(F.col("m") / SALTED).cast("int")
    per = named.groupBy("gram", "m").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or(starts).alias("any"), *more)
    per = per.where("lo < hi and any").drop("lo", "hi", "any").withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("m")
    return named.withColumn("lot", F.pmod(F.xxhash64("id"), lots).cast("int")).join(per, ["gram", "lot"]).drop("lot")


def _ask(columns: DataFrame, known: DataFrame | None, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b): each document b of a long column and the hubs a of other components that it shares most such columns
    with. The first hub is the document with the least share of rare shingles, which has least that the rest of a large
    group lacks; the others come by chance from ever more of the documents. Chance goes by id and turn, so all columns
    of a group tend to have the same hubs."""
    share = F.floor(64 * F.col("own") / (F.col("n") * (100 - percent) / 100 + 1))
    chance = lambda k: F.xxhash64("id", F.lit(turn * HUBS + k)).bitwiseAND(F.lit((1 << 40) - 1))
    hubs = [F.min_by("id", F.shiftleft(F.shiftright(share, 2 * k), 40) + chance(k)).alias(f"h{k}") for k in range(HUBS)]
    hub = F.explode(F.array_distinct(F.array(*(f"h{k}" for k in range(HUBS))))).alias("hub")
    asked = _mixed(columns, known, percent, *hubs).select("id", "component", hub).where("id <> hub")
    asked = asked.groupBy("id", "component", "hub").agg(F.count("*").alias("k"))
    # A document has at most as many hubs as its prefix has entries, times HUBS.
    best = F.slice(F.sort_array(F.collect_list(F.struct("k", "hub")), asc=False), 1, 2 * HUBS)
    asked = asked.groupBy("id", "component").agg(best.alias("best")).select("id", "component", F.explode("best.hub").alias("hub"))
    if known is not None:
        asked = asked.join(small(known.select(F.col("node").alias("hub"), F.col("component").alias("theirs")), known.seen["n"]), "hub", "left").where(F.col("component") != F.coalesce("theirs", "hub"))
    return asked.select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _near_sizes(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the Jaccard asked for."""
    size = lambda x: small(about.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")), about.seen["n"])
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(size("a"), "a").join(size("b"), "b").where(near).select("a", "b")


def _components(links: list[DataFrame], before: DataFrame | None) -> DataFrame:
    """What the links found so far join, in place of what fewer joined."""
    out = materialize(components(reduce(DataFrame.unionAll, links)), "known")
    if before is not None:
        discard(before)
    return out


def ngram_jaccard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Components of the documents under Jaccard >= percent/100 of their sets of word 5-shingles.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer than
    five words is one shingle. Returns doc_id, n_shingles, component_id (the smallest doc_id
    reachable, itself included). Null and wordless texts have 0 shingles and link with nothing;
    rows with equal texts, repeated rows too, share a component and each get a row; an empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    # Each doubling of a count is a level: else an edit that dozens share would stand among the shingles of a large group, and one of
    # these would enter the prefix of a document that is too far from all of the group.
    level = (F.floor(F.log2(F.sum("n"))) + 1).cast("byte")
    cells = docs.select("text").mapInArrow(lean(_frequent), "cell long, n long").groupBy("cell").agg(level).toArrow()
    levels = np.zeros(CELLS, dtype=np.int8)  # at most CELLS rows reach the driver, 4 MB go out
    levels[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    levels = spark.sparkContext.broadcast(levels)
    rows = materialize(docs.mapInArrow(lean(_prefixes(levels, percent)), "id long, n long, print binary, rare array<bigint>, common array<bigint>"), "rows")
    plain = materialize(rows.select("id", "n", "print"), "plain")

    # Equal sets are one row of the matrix, named by its smallest document.
    classes = materialize(plain.where("n > 0").groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "print")
    heads = rows.join(small(reps, classes.seen["n"] * 2), ["id", "print"], "left_semi")
    heads = heads.select("id", "n", (F.size("rare") + F.size("common")).alias("p"), "rare", "common")
    about = materialize(heads.select("id", "n", "p"), "about")

    entries, late = heads.agg(F.coalesce(F.sum(F.size("rare")), F.lit(0)), F.coalesce(F.sum(F.size("common")), F.lit(0))).first()
    blocks = max(1, -(-entries // BLOCK))
    dealt = heads.select("id", "rare", "n").mapInArrow(lean(_deal(blocks)), "block int, lows binary, places binary, ids binary, sizes binary, counts binary")
    rare = dealt.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(lean(_several), "gram long, id long, at int, n int, m long")
    # A column of a frequent shingle may hold a large share of all documents: counts meet, not entries.
    common = heads.select("id", "n", F.size("rare").alias("before"), F.posexplode("common").alias("at", "gram"))
    common = common.select("gram", "id", (F.col("before") + F.col("at")).alias("at"), F.col("n").cast("int").alias("n"), F.col("before").alias("own"))
    several = materialize(common.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "several")
    columns = materialize(rare.withColumn("own", F.lit(0)).unionAll(spread_join(common, several, "gram", "m", late, several.seen["n"]).select("gram", "id", "at", "n", "m", "own")), "columns")
    discard(rows, several)
    # Halves of shingles are enough to count what prefixes share at most; twins counts a document's equal halves.
    half = F.expr("cast(gram & 2147483647 as int)")
    shared = columns.groupBy("id").agg(F.collect_list(half).alias("grams")).withColumn("twins", F.size("grams") - F.size(F.array_distinct("grams")))
    shared = materialize(shared.join(small(about, about.seen["n"]), "id"), "shared")
    long = columns.where(F.col("m") > LONG)
    links, tried, known = [], [], None
    for turn in range(ROUNDS):
        asked = _near_sizes(_ask(long, known, percent, turn), about, percent)
        for before in tried:
            asked = asked.join(before, ["a", "b"], "left_anti")
        asked = materialize(asked, "asked")
        tried.append(asked)
        pairs = materialize(_possible(asked, shared, percent), "pairs")
        found = _verify(pairs, docs, percent)
        discard(pairs)
        links.append(found)
        if found.seen["n"]:
            known = _components(links, known)
        if found.seen["n"] * FEWER <= links[0].seen["n"]:
            break

    # What is left is multiplied between components.
    mixed = _mixed(columns, known, percent).withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    # A pair that shares one of the columns just before this one, in the order of both, meets there too.
    order = Window.partitionBy("id").orderBy("at")
    mixed = mixed.withColumn("before", F.array_compact(F.array(*(F.lag("gram", k).over(order) for k in range(1, BEFORE + 1)))))
    tiled = mixed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other"))
    side = lambda x: tiled.select("gram", "t1", "t2", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "at", "n", "component", "before", "tile")))
    product = side("a").join(side("b"), ["gram", "t1", "t2"]).where("component_a <> component_b and id_a < id_b and (t1 = t2 or tile_a <> tile_b)")
    product = product.where(_meet("at_a", "n_a", "at_b", "n_b", percent)).where(~F.arrays_overlap("before_a", "before_b"))
    product = materialize(product.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "product")
    second = materialize(_possible(product, shared, percent), "pairs")
    if second.seen["n"]:
        links.append(_verify(second, docs, percent))
        known = _components(links, known)
    discard(about, columns, shared, product, second, *tried, *links)
    named_class = classes.select("print", "copies", F.col("rep").alias("component"))
    if known is not None:
        names = small(known.select(F.col("node").alias("rep"), F.col("component").alias("found")), known.seen["n"])
        named_class = classes.join(names, "rep", "left").select("print", "copies", F.coalesce("found", "rep").alias("component"))
    named_class = materialize(named_class, "named")
    discard(classes, *([known] if known is not None else []))
    # Only texts with words join; the rest would all meet under the print of the empty set.
    found = spread_join(plain.where("n > 0"), named_class, "print", "copies", plain.seen["n"], classes.seen["n"] * 2).select("id", "n", "component")
    out = found.unionAll(plain.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
