"""One distributed pass over labelled vectors: counts, sums and Gram matrix, of all rows and of each class.

Every partition adds up its Arrow batches with matrix products and hands on one packed record; records are added up in two
levels before one of them reaches the driver, whose size is D * D + C * D whatever the number of rows. Vectors are shifted by a
fixed pivot first, so that sums of squares do not cancel.

Defined results: rows without a vector or label are left out; an empty table has no moments (ValueError); weights default to 1.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import parallelism

#: Rows whose mean is the pivot.
PIVOT_ROWS = 256
#: Classes, whose names, counts and means the driver holds and the plans name.
MAX_CLASSES = 100_000


def classes(df: DataFrame, label: str) -> list:
    """The labels of df in order; raises if there are more than MAX_CLASSES."""
    found = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in found)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def dense(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as (n, d) doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def tree_sum(parts: DataFrame, key: str | None = None) -> DataFrame:
    """Adds up packed records (column part BINARY) of each key, or of all; many records are added up in several tasks first."""

    def add(table: pa.Table) -> pa.Table:
        total: dict[str, np.ndarray] = {}
        for blob in table["part"]:
            for k, v in unpack(blob.as_py()).items():
                total[k] = total[k] + v if k in total else v
        cols = {key: table[key][:1]} if key else {}
        return pa.table({**cols, "part": pa.array([pack(total)], pa.binary())})

    keys = [key] if key else []
    schema = parts.select(*keys, "part").schema
    wide = max(2, int(np.sqrt(parallelism(parts.sparkSession))))
    some = parts.withColumn("_salt", F.pmod(F.xxhash64("part"), F.lit(wide))).groupBy(*keys, "_salt").applyInArrow(add, schema)
    return some.groupBy(*keys).applyInArrow(add, schema)


def gather(df: DataFrame, columns: list[str], step: Callable[[pa.RecordBatch, dict], None]) -> dict[str, np.ndarray]:
    """The sum over all batches of what step adds to its dictionary of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            if b.num_rows:
                step(b, state)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([pack(state)], pa.binary())], ["part"])

    got = tree_sum(df.select(*columns).mapInArrow(run, "part binary")).collect()  # one record
    if not got:
        raise ValueError("no rows with a vector and a label")
    return unpack(got[0].part)


def accumulate(state: dict, name: str, value: np.ndarray) -> None:
    state[name] = state[name] + value if name in state else value


@dataclass
class Moments:
    """labels: classes in order; counts (C), sums (C, D) and squares (C, D): of rows less pivot; gram (D, D); rows: number of rows."""

    labels: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    gram: np.ndarray
    pivot: np.ndarray
    rows: int

    @property
    def n(self) -> float:
        return float(self.counts.sum())

    @property
    def d(self) -> int:
        return len(self.pivot)

    @property
    def mean(self) -> np.ndarray:
        return self.pivot + self.sums.sum(axis=0) / self.n

    @property
    def class_means(self) -> np.ndarray:
        return self.pivot + self.sums / self.counts[:, None]

    @property
    def total(self) -> np.ndarray:
        m = self.sums.sum(axis=0) / self.n
        return self.gram / self.n - np.outer(m, m)

    @property
    def between(self) -> np.ndarray:
        keep = self.counts > 1e-10
        dev = self.class_means[keep] - self.mean
        return (dev * self.counts[keep, None]).T @ dev / self.n

    @property
    def within(self) -> np.ndarray:
        keep = self.counts > 1e-10
        s = self.sums[keep]
        return (self.gram - (s / self.counts[keep, None]).T @ s) / self.n

    @property
    def scale(self) -> np.ndarray:
        """Population deviation of each feature; 1 where it does not vary."""
        std = np.sqrt(np.maximum(np.diag(self.total), 0))
        return np.where(std < 1e-12, 1.0, std)

    def affine(self, mean: np.ndarray, matrix: np.ndarray) -> Moments:
        """The moments of (x - mean) @ matrix."""
        shift = self.pivot - mean
        ones = self.counts.sum()
        s = self.sums.sum(axis=0)
        raw = self.gram + np.outer(shift, s) + np.outer(s, shift) + ones * np.outer(shift, shift)
        sums = (self.sums + self.counts[:, None] * shift) @ matrix
        return Moments(self.labels, self.counts, sums, np.full_like(sums, np.nan), matrix.T @ raw @ matrix, np.zeros(matrix.shape[1]), self.rows)


def moments(df: DataFrame, vector: str, label: str, weight: str | None = None) -> Moments:
    good = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    head = good.select(vector).limit(PIVOT_ROWS).toArrow()
    if not head.num_rows:
        raise ValueError("no rows with a vector and a label")
    pivot = dense(head[vector].combine_chunks()).mean(axis=0)
    labels = np.array(classes(good, label))
    order = {v: i for i, v in enumerate(labels.tolist())}
    c, d = len(labels), len(pivot)

    def step(b: pa.RecordBatch, state: dict) -> None:
        x = dense(b["x"]) - pivot
        w = b["w"].to_numpy()
        at = np.fromiter((order[v] for v in b["y"].to_pylist()), np.int64, len(x))
        one = np.zeros((c, len(x)))
        one[at, np.arange(len(x))] = w
        accumulate(state, "counts", one.sum(axis=1))
        accumulate(state, "sums", one @ x)
        accumulate(state, "squares", one @ (x * x))
        accumulate(state, "gram", (x * w[:, None]).T @ x)
        accumulate(state, "rows", np.array([len(x)]))

    chosen = good.select(F.col(vector).alias("x"), F.col(label).alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    s = gather(chosen, ["x", "y", "w"], step)
    assert s["gram"].shape == (d, d)
    return Moments(labels, s["counts"], s["sums"], s["squares"], s["gram"], pivot, int(s["rows"][0]))


def fourth_moment(df: DataFrame, vector: str, label: str | None, m: Moments, scale: np.ndarray | None = None) -> float:
    """Sum of the squared squared norms of rows less their class mean (less the mean without label), divided by scale first."""
    order = {v: i for i, v in enumerate(m.labels.tolist())}
    centres = m.class_means if label else m.mean[None, :]
    size = np.ones(m.d) if scale is None else scale

    def step(b: pa.RecordBatch, state: dict) -> None:
        at = np.fromiter((order[v] for v in b["y"].to_pylist()), np.int64, b.num_rows) if label else np.zeros(b.num_rows, np.int64)
        z = (dense(b["x"]) - centres[at]) / size
        accumulate(state, "q", np.array([((z * z).sum(axis=1) ** 2).sum()]))

    good = df.filter(F.col(vector).isNotNull())
    return float(gather(good.select(F.col(vector).alias("x"), (F.col(label) if label else F.lit(0)).alias("y")), ["x", "y"], step)["q"][0])
