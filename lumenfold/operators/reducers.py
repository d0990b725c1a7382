"""Supervised and unsupervised reducers: one pass of moments, a small eigenproblem on the driver, one matrix product per batch.

Every reducer is a pyspark.ml Estimator; its model is affine, (x - mean) @ matrix. Reducer.create(name, k=...) makes one by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import linalg as la
from lumenfold.operators.moments import Moments, accumulate, dense, fourth_moment, gather, moments, pack, tree_sum, unpack
from lumenfold.operators.sampling import stratified_sample
from lumenfold.session import parallelism, stage


def project(df: DataFrame, vector: str, mean: np.ndarray, matrix: np.ndarray, out: str) -> DataFrame:
    """df with out ARRAY<DOUBLE> = (vector - mean) @ matrix; null where the vector is null."""
    schema = df.drop(out).withColumn(out, F.lit(None).cast("array<double>")).schema
    columns = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = np.flatnonzero(~b[vector].is_null().to_numpy(zero_copy_only=False))
            y = (dense(b[vector].take(pa.array(there))) - mean) @ matrix if len(there) else np.zeros((0, matrix.shape[1]))
            sizes = np.zeros(b.num_rows, np.int32)
            sizes[there] = matrix.shape[1]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(sizes == 0, False)) if matrix.shape[1] else pa.array(offsets), pa.array(y.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in columns], lists], [*columns, out])

    needed = [*columns, *([vector] if vector not in columns else [])]
    return df.select(*needed).mapInArrow(run, schema)


class AffineModel(Model):
    """A fitted reducer. mean (D), matrix (D, k)."""

    def __init__(self, mean: np.ndarray, matrix: np.ndarray, vector: str, out: str):
        super().__init__()
        self.mean, self.matrix, self.vector, self.out = mean, matrix, vector, out

    @property
    def dim(self) -> int:
        return self.matrix.shape[1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return project(dataset, self.vector, self.mean, self.matrix, self.out)


def pca(m: Moments, k: int) -> np.ndarray:
    if k > m.d:
        raise ValueError(f"{k} components of {m.d} features")
    return la.top_eigen(m.total, k)[1]


def lda(m: Moments, k: int) -> np.ndarray:
    """Fisher's discriminant: whiten the pooled within-class covariance, cut its rank, diagonalise the weighted class means."""
    c = len(m.labels)
    if k > min(c - 1, m.d):
        raise ValueError(f"{k} discriminants of {c} classes and {m.d} features")
    spread = np.sqrt(np.maximum(np.diag(m.within), 0))
    spread = np.where(spread < 1e-12, 1.0, spread)
    cov = m.within * (m.n / max(1.0, m.n - c)) / np.outer(spread, spread)
    values, vectors = np.linalg.eigh(cov)
    keep = np.sqrt(np.maximum(values, 0)) > la.RANK_TOL
    a = (vectors[:, keep] / np.sqrt(values[keep])) / spread[:, None]
    weighted = np.sqrt(m.counts / m.n)[:, None] * ((m.class_means - m.mean) @ a)
    _, s, vt = np.linalg.svd(weighted * np.sqrt(m.n / max(1, c - 1)), full_matrices=False)
    rank = int((s > la.RANK_TOL * s[0]).sum()) if len(s) else 0
    return la.canonical(a @ vt[: min(k, rank)].T)


def pca_lda(m: Moments, k: int) -> np.ndarray:
    c = len(m.labels)
    w = pca(m, int(min(m.n - c, max(4 * k, 500), m.d)))
    return w @ lda(m.affine(m.mean, w), k)


def residual(m: Moments, w: np.ndarray, n_residual: int) -> np.ndarray:
    """Main directions of what w leaves of x."""
    q = la.orthonormal(w)
    p = np.eye(m.d) - q @ q.T
    n = max(1, min(n_residual, m.d - w.shape[1] - 1))
    return p @ la.top_eigen(p @ m.total @ p, n)[1]


def residual_size(d: int) -> int:
    return 20 if d <= 576 else 25 if d <= 1280 else 30


def class_pairs(means: np.ndarray, share: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance, weight) of all pairs of classes: the closest share weighs 1 / distance, the rest a tenth of it."""
    i, j = np.triu_indices(len(means), 1)
    dist = np.linalg.norm(means[i] - means[j], axis=1)
    order = np.lexsort((j, i, dist))
    hard = np.zeros(len(dist), bool)
    hard[order[: max(1, int(len(dist) * share))]] = True
    return i, j, dist, np.where(hard, 1.0, 0.1) / (dist + 1e-6)


def margin_between(m: Moments, w: np.ndarray, share: float) -> np.ndarray:
    i, j, _, weight = class_pairs((m.class_means - m.mean) @ w, share)
    d = m.class_means[i] - m.class_means[j]
    return (d * weight[:, None]).T @ d / m.n


class Reducer(Estimator):
    """fit(df) -> AffineModel. vector and label name the columns, id a stable row id; k is the number of components."""

    REGISTRY: dict[str, tuple[str, Callable]] = {}

    def __init__(self, name: str, k: int, vector: str = "features", label: str = "label", identity: str = "sample_id", out: str = "reduced", **options):
        super().__init__()
        if name not in self.REGISTRY:
            raise KeyError(f"no reducer {name}; there are {', '.join(self.REGISTRY)}")
        self.name, self.k, self.vector, self.label, self.identity, self.out, self.options = name, k, vector, label, identity, out, options

    @classmethod
    def create(cls, name: str, k: int, **kw) -> Reducer:
        return cls(name, k, **kw)

    @property
    def category(self) -> str:
        return self.REGISTRY[self.name][0]

    def _fit(self, dataset: DataFrame) -> AffineModel:
        mean, matrix = self.REGISTRY[self.name][1](self, dataset, **self.options)
        return AffineModel(mean, matrix, self.vector, self.out)

    def moments(self, df: DataFrame, weight: str | None = None) -> Moments:
        return moments(df, self.vector, self.label, weight)


def register(name: str, category: str):
    def add(f: Callable) -> Callable:
        Reducer.REGISTRY[name] = (category, f)
        return f

    return add


@register("Full", "control")
def _full(r: Reducer, df: DataFrame):
    d = df.filter(F.col(r.vector).isNotNull()).select(F.size(r.vector)).first()[0]
    return np.zeros(d), np.eye(d)


@register("PCA", "control")
def _pca(r: Reducer, df: DataFrame):
    m = r.moments(df)
    return m.mean, pca(m, r.k)


@register("LDA", "classic")
def _lda(r: Reducer, df: DataFrame):
    m = r.moments(df)
    return m.mean, lda(m, r.k)


@register("PCA+LDA", "classic")
def _pca_lda(r: Reducer, df: DataFrame):
    m = r.moments(df)
    return m.mean, pca_lda(m, r.k)


@register("R-LDA", "classic")
def _rlda(r: Reducer, df: DataFrame, rows_per_task: int = 50_000):
    """Shrinkage discriminant: each class covariance shrunk on its standardised features, rescaled and added by share.

    Rows are spread by (class, salt), so a class of any size is several partial Gram matrices, added up per class.
    """
    m = r.moments(df)
    mean_c, n_c = m.class_means, m.counts
    var = np.maximum(m.squares / n_c[:, None] - (m.sums / n_c[:, None]) ** 2, 0)
    std = np.where(np.sqrt(var) < 1e-12, 1.0, np.sqrt(var))
    order = {v: i for i, v in enumerate(m.labels.tolist())}
    d, n = m.d, m.n
    salts = F.create_map(*[x for v, c in zip(m.labels.tolist(), n_c, strict=True) for x in (F.lit(v), F.lit(int(-(-c // rows_per_task))))])
    good = df.filter(F.col(r.vector).isNotNull() & F.col(r.label).isNotNull())
    spread = good.select(F.col(r.label).alias("y"), F.col(r.vector).alias("x"), F.pmod(F.xxhash64(r.vector), salts[F.col(r.label)]).alias("s")).repartition(parallelism(df.sparkSession), "y", "s")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            y = np.fromiter((order[v] for v in b["y"].to_pylist()), np.int64, b.num_rows)
            x = dense(b["x"]) if b.num_rows else None
            for i in np.unique(y):
                z = (x[y == i] - mean_c[i]) / std[i]
                accumulate(held.setdefault(int(i), {}), "gram", z.T @ z)
                accumulate(held[int(i)], "q", np.array([((z * z).sum(axis=1) ** 2).sum()]))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([pack(v) for v in held.values()], pa.binary())], ["c", "part"])

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for i, blob in zip(b["c"].to_pylist(), b["part"].to_pylist(), strict=True):
                p = unpack(blob)
                cov = p["gram"] / n_c[i]
                out = la.shrink(cov, la.ledoit_wolf(cov, n_c[i], p["q"][0])) * np.outer(std[i], std[i])
                accumulate(total, "sw", out * (n_c[i] / n))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], ["part"])

    by_class = tree_sum(spread.mapInArrow(partial, "c long, part binary"), "c")
    sw = unpack(tree_sum(by_class.mapInArrow(shrunk, "part binary")).first().part)["sw"]
    scale = m.scale
    corr = m.total / np.outer(scale, scale)
    alpha = la.ledoit_wolf(corr, n, fourth_moment(good, r.vector, None, m, scale))
    st = la.shrink(corr, alpha) * np.outer(scale, scale)
    return np.zeros(d), la.whitened(st - sw, sw, min(r.k, len(m.labels) - 1, d))


@register("LFDA", "local")
def _lfda(r: Reducer, df: DataFrame, neighbours: int = 7, pca_dim: int = 300):
    from lumenfold.operators import graph

    m = r.moments(df)
    mean, base = m.mean, pca(m, pca_dim) if m.d > pca_dim else np.eye(m.d)
    work = stage(project(df.filter(F.col(r.vector).isNotNull() & F.col(r.label).isNotNull()).select(F.col(r.identity).alias("id"), F.col(r.label).alias("label"), F.col(r.vector).alias("v")), "v", mean, base, "x").drop("v"), "lfda-rows")
    knn = stage(graph.knn_within_class(work, neighbours), "lfda-knn")
    local = graph.local_scatter(work, graph.affinity(knn, work), m.rows)
    own = m.affine(mean, base)
    d = base.shape[1]
    sb = own.total - local
    ridge = 1e-4 * np.trace(local) / d
    return mean, base @ la.whitened(sb, local + ridge * np.eye(d), min(r.k, len(m.labels) - 1, d - 1))


@register("NCA", "local")
def _nca(r: Reducer, df: DataFrame, pca_dim: int = 200, max_rows: int = 10_000, max_iter: int = 100):
    """Neighbourhood components on a stratified sample of at most max_rows rows, which alone reach the driver; starts from the discriminant."""
    from lumenfold.operators.nca import fit_nca

    m = r.moments(df)
    base = pca(m, pca_dim) if m.d > pca_dim else np.eye(m.d)
    good = df.filter(F.col(r.vector).isNotNull() & F.col(r.label).isNotNull())
    if m.rows > max_rows:
        good = stratified_sample(good, r.label, r.identity, 42, max(1, max_rows // len(m.labels)))
    got = good.select(r.identity, r.label, r.vector).orderBy(r.identity).toArrow()
    x = (dense(got[r.vector].combine_chunks()) - m.mean) @ base
    y = np.unique(np.array(got[r.label].to_pylist()), return_inverse=True)[1]
    k = min(r.k, base.shape[1] - 1) if base.shape[1] > 1 else 1
    own = m.affine(m.mean, base)
    start = lda(own, k) if k <= min(len(m.labels) - 1, own.d) else pca(own, k)
    if start.shape[1] < k:
        start = np.concatenate([start, pca(own, k - start.shape[1])], axis=1)
    return m.mean, base @ fit_nca(x, y, start, max_iter)


@register("RDA", "novel")
def _rda(r: Reducer, df: DataFrame, n_residual: int | None = None):
    m = r.moments(df)
    w = lda(m, r.k)
    return m.mean, np.concatenate([w, residual(m, w, n_residual or residual_size(m.d))], axis=1)


@register("DSB", "novel")
def _dsb(r: Reducer, df: DataFrame, rounds: int = 2, alpha: float = 0.05):
    """Boosted subspaces: rows that a classifier gets wrong weigh more in the next round's scatter; all rounds' directions side by side."""
    from lumenfold.operators.classify import logistic

    rows = df.filter(F.col(r.vector).isNotNull() & F.col(r.label).isNotNull()).withColumn("_w", F.lit(1.0))
    blocks, m = [], None
    for i in range(rounds):
        m = moments(rows, r.vector, r.label, "_w")
        w = la.whitened(m.between, la.shrink(m.within, alpha), min(r.k, len(m.labels) - 1, m.d))
        blocks.append((m.mean, w))
        if i < rounds - 1:
            seen = project(rows, r.vector, m.mean, w, "_p")
            judged = logistic("_p", r.label, max_iter=500).fit(seen).transform(seen).withColumn("_wrong", (F.col("prediction") != F.col("_y")).cast("double")).select(*df.columns, "_w", "_wrong")
            judged = stage(judged, "dsb-round")
            wrong, all_ = judged.agg(F.sum(F.col("_w") * F.col("_wrong")), F.sum("_w")).first()
            err = wrong / all_
            if 0 < err < 0.5:
                judged = judged.withColumn("_w", F.col("_w") * F.when(F.col("_wrong") > 0, float(np.exp(np.log((1 - err) / err + 1e-10)))).otherwise(1.0))
            rows = judged.drop("_wrong")
    plain = r.moments(df)
    mean, matrix = plain.mean, np.concatenate([w for _, w in blocks], axis=1)
    if matrix.shape[1] > r.k:
        matrix = matrix @ pca(plain.affine(mean, matrix), r.k)
    return mean, matrix


@register("RDA+SMD", "novel")
def _rda_smd(r: Reducer, df: DataFrame, n_residual: int | None = None, margin: float = 0.3, shrink_rows: int | None = None):
    """Discriminant with between scatter weighted by class margins, and the residual block of the plain one. shrink_rows: the shrinkage is that of so many rows, first by id, instead of all."""
    m = r.moments(df)
    first, part = df.filter(F.col(r.vector).isNotNull() & F.col(r.label).isNotNull()), m
    if shrink_rows:
        first = stage(first.select(r.identity, r.label, r.vector).orderBy(r.identity).limit(shrink_rows), "smd-first")
        part = moments(first, r.vector, r.label)
    alpha = la.ledoit_wolf(part.within, part.n, fourth_moment(first, r.vector, r.label, part))
    sw = la.shrink(m.within, alpha)
    k = min(r.k, len(m.labels) - 1, m.d)
    w1 = la.whitened(m.between, sw, k)
    w2 = la.whitened(margin_between(m, w1, margin), sw, k)
    return m.mean, np.concatenate([w2, residual(m, lda(m, k), n_residual or residual_size(m.d))], axis=1)
