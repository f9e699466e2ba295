"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Each unit vector x is held as s*q with int8 q and the exact length e of what rounding lost. For two
vectors |x.y - s_x s_y q_x.q_y| <= e_x + e_y + 3 e_x e_y, so only pairs whose quantised product comes
within that bound of the threshold are computed again in double precision. Equal vectors are one
row, strips of rows meet in pairs of strips (never all pairs of rows in one shuffle), and a task
returns counts and a spanning forest of its links, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize, spread_join
from .components import components

THRESHOLD = 0.9
STRIP = 6144  # vectors of WIDE components in a strip, on average, and fewer wider ones; a task holds two strips
WIDE = 64
TILE = 1024
SUMMED = 1040  # components whose products of int8 values sum to less than 2**24, so that single precision is exact
AGAIN = 1 << 17  # pairs computed again at once


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: int8 values, scales and error norms."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    lost = np.linalg.norm(x - scale[:, None] * q, axis=1)
    return q.astype(np.int8), scale, lost * (1 + 1e-12) + 1e-15


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of int8 values, exact for any number of components."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SUMMED):
        part = slice(at, at + SUMMED)
        out += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return out


def links(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD):
    """Pairs (i, j) of unit rows of x and y with a product >= threshold, tile by tile."""
    qx, sx, ex = quantise(x)
    qy, sy, ey = quantise(y)
    for i in range(0, len(x), TILE):
        for j in range(0, len(y), TILE):
            a, b = slice(i, i + TILE), slice(j, j + TILE)
            near = _products(qx[a], qy[b]) * sx[a][:, None] * sy[b][None, :]
            slack = ex[a][:, None] + ey[b][None, :] + 3 * ex[a][:, None] * ey[b][None, :]
            p, q = np.nonzero(near + slack + 1e-12 >= threshold)
            for at in range(0, len(p), AGAIN):
                u, v = p[at : at + AGAIN] + i, q[at : at + AGAIN] + j
                exact = np.einsum("ij,ij->i", x[u], y[v])
                yield u[exact >= threshold], v[exact >= threshold]


def _join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the components that hold linked rows; label is the smallest row of each."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        lo, hi = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(label, hi, lo)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def _strips(threshold):
    def match(batches):
        batches = [b for b in batches if b.num_rows]
        whole = pa.Table.from_batches(batches) if batches else None
        for i, j in sorted({*zip(whole.column("i").to_pylist(), whole.column("j").to_pylist(), strict=True)}) if batches else ():
            here = pc.and_(pc.equal(whole.column("i"), i), pc.equal(whole.column("j"), j))
            yield from pair(i, j, whole.filter(here)).to_batches()

    def pair(i, j, table):
        out_id, out_root, out_n = [], [], []
        size = np.array([len(e) for e in table.column("embedding")])
        for dim in np.unique(size):  # vectors of different lengths have no cosine
            part = table.filter(pa.array(size == dim)).sort_by("rep")
            rep = part.column("rep").to_numpy()
            weight = part.column("weight").to_numpy()
            strip = part.column("strip").to_numpy()
            x = part.column("embedding").combine_chunks()
            x = np.array(x.flatten(), dtype=np.float64).reshape(len(part), dim)
            x /= np.linalg.norm(x, axis=1)[:, None]
            left, right = np.flatnonzero(strip == i), np.flatnonzero(strip == j)
            n, label = np.zeros(len(part), dtype=np.int64), np.arange(len(part))
            if len(left) and len(right):
                for u, v in links(x[left], x[right], threshold):
                    u, v = left[u], right[v]
                    if i == j:
                        u, v = u[u < v], v[u < v]
                    np.add.at(n, u, weight[v])
                    np.add.at(n, v, weight[u])
                    _join_labels(label, u, v)
            some = n > 0
            out_id.append(rep[some])
            out_root.append(rep[label[some]])
            out_n.append(n[some])
        columns = [np.concatenate(c) for c in (out_id, out_root, out_n)]
        return pa.table({"rep": pa.array(columns[0], pa.int64()), "root": pa.array(columns[1], pa.int64()), "n": pa.array(columns[2], pa.int64())})

    return match


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, strip: int = STRIP) -> DataFrame:
    """Link all vectors whose cosine in double precision is at least threshold.

    Returns vec_id, n_links, component_id, kept for each row. Vectors that are null, empty, zero or hold
    a null or non-finite component link with nothing; vectors of different lengths do not
    link; repeated rows and equal vectors link with one another. Vectors may have any number of
    components. An empty table gives no rows. Other columns are not read.
    """
    kind = vectors.schema[embedding].dataType.simpleString()  # single precision travels as it is
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # Components of extreme size would overflow when squared; a cosine does not change with scale.
    top = F.array_max(F.transform("embedding", F.abs))
    rows = rows.withColumn("embedding", F.when(F.col("good") & ((top > 1e100) | (top < 1e-100)), F.transform("embedding", lambda v: v / top)).otherwise(F.col("embedding")))
    classes = materialize(rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vectors", wide=F.max(F.size("embedding")))
    count, wide = classes.seen["n"], classes.seen["wide"] or 0
    n = max(1, -(-count // max(1, strip * WIDE // max(WIDE, wide))))
    dealt = classes.withColumn("strip", F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.withColumn("i", F.least("strip", "other")).withColumn("j", F.greatest("strip", "other"))
    # A partition holds one pair of strips.
    number = (F.col("i") * (2 * n - F.col("i") - 1) / 2 + F.col("j")).cast("int")
    pairs = dealt.select("i", "j", "strip", "rep", "weight", "embedding").repartitionById(n * (n + 1) // 2, number)
    found = materialize(pairs.mapInArrow(lean(_strips(threshold)), "rep long, root long, n long"), "found")
    grouped = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("n").alias("n")).join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
    named = classes.join(counted, "rep", "left").select("embedding", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named, "named")
    discard(classes, found)
    linked = spread_join(rows.where("good"), named, "embedding", "weight", count).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))

