"""Neighbour graphs within classes, their affinities and Laplacian scatter.

A class is cut into blocks, and every block of queries meets every block of rows in a task of its own that keeps k neighbours of each
query; so a class of any size is compared without one task holding it. Ties are ordered by id, and a row is never its own
neighbour, even where others equal it. A class of one row has no edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.moments import accumulate, dense, gather
from lumenfold.operators.skew import small

BLOCK_ROWS = 4096
#: Relative accuracy of the bounds between which the exact median is sought.
MEDIAN_ACCURACY = 10_000


def _neighbours(k: int):
    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r = left["id"].to_numpy(), right["id"].to_numpy()
        i, j, dist = [], [], []
        if len(q) and len(r):
            x, y = dense(left["x"].combine_chunks()), dense(right["x"].combine_chunks())
            y2 = (y * y).sum(axis=1)
            for at in range(0, len(q), 512):
                part = x[at : at + 512]
                approx = y2[None, :] - 2 * part @ y.T
                # All rows up to the k-th distance, the query itself apart, and what rounding may hide: ties of any number stay whole.
                upto = np.partition(approx, min(k, len(r) - 1), axis=1)[:, min(k, len(r) - 1)] + 1e-9 * (1 + (part * part).sum(axis=1) + y2.max())
                for a in range(len(part)):
                    b = np.flatnonzero(approx[a] <= upto[a])
                    b = b[r[b] != q[at + a]]
                    # Distances of the candidates are recomputed by differences, which keeps ties exact.
                    d = np.sqrt(((part[a] - y[b]) ** 2).sum(axis=1))
                    best = np.lexsort((r[b], np.round(d, 10)))[:k]
                    i.append(np.full(len(best), q[at + a])), j.append(r[b[best]]), dist.append(d[best])
        cat = lambda parts, t: np.concatenate(parts) if parts else np.empty(0, t)
        return pa.table({"i": cat(i, np.int64), "j": cat(j, np.int64), "dist": cat(dist, np.float64)})

    return near


def knn_within_class(rows: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(label, i, j, dist, nth) of the min(k, class size - 1) nearest rows of the same class. rows: (id, label, x)."""
    sizes = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(small(sizes), "label")  # a registry of classes
    block, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    queries = dealt.withColumn("a", block).withColumn("b", every)
    again = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])
    index = again.withColumn("b", block).withColumn("a", every)
    found = queries.groupBy("label", "a", "b").cogroup(index.groupBy("label", "a", "b")).applyInArrow(_neighbours(k), "i long, j long, dist double")
    nth = F.row_number().over(Window.partitionBy("i").orderBy(F.round("dist", 10), "j"))
    found = found.withColumn("nth", nth).filter(F.col("nth") <= k)
    return found.join(rows.select(F.col("id").alias("i"), "label"), "i").select("label", "i", "j", "dist", "nth")


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): exact. Approximate bounds first; only the values between them, a small share of a group, are ordered."""
    low, high = 0.5 - 2 / MEDIAN_ACCURACY, 0.5 + 2 / MEDIAN_ACCURACY
    bounds = df.groupBy(key).agg(F.percentile_approx(value, F.array(F.lit(low), F.lit(high)), MEDIAN_ACCURACY).alias("b"), F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    # Values equal to a bound are counted, not listed, so ties of any number stay cheap.
    near = df.join(small(bounds), key)
    counted = near.filter((F.col(value) >= F.col("b")[0]) & (F.col(value) <= F.col("b")[1])).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    below = near.groupBy(key).agg(F.count_if(F.col(value) < F.col("b")[0]).alias("below"), F.first("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value))
    ranked = counted.join(below, key).withColumn("upto", F.col("below") + upto)
    half = lambda r: F.min(F.when(F.col("upto") >= r, F.col(value)))
    return ranked.groupBy(key).agg(((half(F.floor((F.col("n") + 1) / 2)) + half(F.floor((F.col("n") + 2) / 2))) / 2).alias("median"))


def sigma(knn: DataFrame) -> DataFrame:
    """(label, sigma): median distance of the farthest kept neighbour, plus 1e-10."""
    last = knn.groupBy("label", "i").agg(F.max("dist").alias("dist"))
    return exact_median(last, "label", "dist").select("label", (F.col("median") + 1e-10).alias("sigma"))


def affinity(knn: DataFrame, rows: DataFrame) -> DataFrame:
    """(label, i, j, w) of directed edges: heat kernel over the class size."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    both = knn.join(small(sigma(knn)), "label").join(small(sizes), "label")
    return both.select("label", "i", "j", (F.exp(-F.pow("dist", F.lit(2)) / (2 * F.pow("sigma", F.lit(2)))) / F.col("n")).alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, equal ones added up: mutual neighbours weigh double."""
    return edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))


def degree(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("i").agg(F.sum("w").alias("degree"))


def local_scatter(rows: DataFrame, edges: DataFrame, n: int) -> np.ndarray:
    """(X'DX - X'WX) / n of the symmetric graph, as the sum of w (x_i - x_j)(x_i - x_j)' over directed edges. rows: (id, x)."""
    x = rows.select("id", "x")
    pairs = edges.select("i", "j", "w").join(x.select(F.col("id").alias("i"), F.col("x").alias("a")), "i").join(x.select(F.col("id").alias("j"), F.col("x").alias("b")), "j")

    def step(b: pa.RecordBatch, state: dict) -> None:
        d = dense(b["a"]) - dense(b["b"])
        accumulate(state, "s", (d * b["w"].to_numpy()[:, None]).T @ d)

    return gather(pairs.select("a", "b", "w"), ["a", "b", "w"], step)["s"] / n
