import numpy as np
import pytest
from conftest import rows

from lumenfold.functions import linalg as la
from lumenfold.operators import classify, experiments, graph
from lumenfold.operators import reducers as r
from lumenfold.operators.moments import fourth_moment, moments
from lumenfold.operators.nca import objective

SCHEMA = "sample_id long, label int, features array<double>"


def blobs(n=300, d=5, c=3, seed=0, gap=3.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, c, n)
    means = rng.standard_normal((c, d)) * gap
    return means[y] + rng.standard_normal((n, d)) @ np.diag(np.linspace(0.5, 2, d)), y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def data(spark):
    x, y = blobs()
    return x, y, frame(spark, x, y).cache()


def test_moments_match_numpy(data):
    x, y, df = data
    m = moments(df, "features", "label")
    means = np.stack([x[y == c].mean(axis=0) for c in range(3)])
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.class_means, means) and np.allclose(m.total, np.cov(x.T, bias=True))
    assert np.allclose(m.total, m.within + m.between)
    z = x - means[y]
    assert np.allclose(m.within, z.T @ z / len(x)) and np.isclose(fourth_moment(df, "features", "label", m), ((z**2).sum(axis=1) ** 2).sum())
    w = np.random.default_rng(1).standard_normal((5, 2))
    p = m.affine(m.mean, w)
    assert np.allclose(p.total, np.cov(((x - x.mean(axis=0)) @ w).T, bias=True)) and np.allclose(p.within, w.T @ m.within @ w)


def test_moments_do_not_depend_on_partitions_and_skip_nulls(spark, data):
    x, y, df = data
    more = df.unionByName(spark.createDataFrame([(900, None, [1.0] * 5), (901, 1, None)], SCHEMA))
    a, b = moments(df.repartition(1), "features", "label"), moments(more.repartition(7), "features", "label")
    assert np.allclose(a.gram + 0, b.gram + np.outer(b.pivot - a.pivot, b.sums.sum(0)) + np.outer(b.sums.sum(0), b.pivot - a.pivot) + len(x) * np.outer(b.pivot - a.pivot, b.pivot - a.pivot))
    with pytest.raises(ValueError):
        moments(spark.createDataFrame([], SCHEMA), "features", "label")


def test_large_offset_does_not_cancel(spark):
    x, y = blobs(gap=1.0)
    m = moments(frame(spark, x + 1e7, y), "features", "label")
    assert np.allclose(m.total, np.cov(x.T, bias=True), atol=1e-5)


def test_discriminant_invariants(data):
    x, y, df = data
    m = moments(df, "features", "label")
    w = r.lda(m, 2)
    sw = w.T @ (m.within * m.n / (m.n - 3)) @ w
    assert np.allclose(sw, np.eye(2), atol=1e-8)
    v = la.whitened(m.between, m.within, 5)
    assert np.allclose(v.T @ m.within @ v, np.eye(5), atol=1e-8)
    assert (np.linalg.eigvalsh(v.T @ m.between @ v) > 1e-9).sum() == 2
    with pytest.raises(ValueError):
        r.lda(m, 3)
    with pytest.raises(KeyError):
        r.Reducer.create("LDAA", 1)


def test_two_classes_closed_form(spark):
    x, y = blobs(200, 2, 2, seed=3)
    m = moments(frame(spark, x, y), "features", "label")
    u = np.linalg.solve(m.within, m.class_means[1] - m.class_means[0])
    w = r.lda(m, 1)[:, 0]
    assert np.isclose(abs(u @ w) / np.linalg.norm(u) / np.linalg.norm(w), 1)


def test_constant_feature_and_rank(spark):
    x, y = blobs(100, 4, 3)
    x[:, 2] = 5.0
    m = moments(frame(spark, x, y), "features", "label")
    assert np.isfinite(r.lda(m, 2)).all() and np.isfinite(r.pca_lda(m, 2)).all()


@pytest.mark.parametrize("name", list(r.Reducer.REGISTRY))
def test_every_reducer(data, name):
    x, y, df = data
    model = r.Reducer.create(name, 2).fit(df)
    out = np.array([v[0] for v in rows(model.transform(df).orderBy("sample_id").select("reduced"))])
    assert np.allclose(out, (x - model.mean) @ model.matrix) and out.shape[1] == model.dim
    again = r.Reducer.create(name, 2).fit(df.repartition(5))
    if name not in ("NCA", "DSB"):
        assert np.allclose(model.matrix, again.matrix, atol=1e-6)


def test_residual_is_orthogonal(data):
    m = moments(data[2], "features", "label")
    w = r.lda(m, 2)
    assert np.allclose(la.orthonormal(w).T @ r.residual(m, w, 2), 0, atol=1e-10)


def test_rlda_matches_direct_formula(data):
    x, y, df = data
    model = r.Reducer.create("R-LDA", 2, label="label").fit(df)

    def lw(z):
        z = z - z.mean(axis=0)
        s = z.std(axis=0)
        z = z / s
        cov = z.T @ z / len(z)
        p = cov.shape[0]
        mu, norm = np.trace(cov) / p, (cov**2).sum()
        delta = (norm - p * mu**2) / p
        beta = min(delta, (((z**2).sum(axis=1) ** 2).sum() / len(z) - norm) / p / len(z))
        return ((1 - beta / delta) * cov + beta / delta * mu * np.eye(p)) * np.outer(s, s)

    sw = sum(lw(x[y == c]) * (y == c).mean() for c in range(3))
    want = la.whitened(lw(x) - sw, sw, 2)
    assert np.allclose(model.matrix, want, atol=1e-7)


def test_nca_gradient():
    rng = np.random.default_rng(0)
    x, y, w = rng.standard_normal((40, 5)), rng.integers(0, 3, 40), rng.standard_normal((5, 2))
    g = objective(x, y, w)[1]
    d = np.zeros_like(w)
    d[3, 1] = 1e-6
    assert np.isclose(g[3, 1], (objective(x, y, w + d)[0] - objective(x, y, w - d)[0]) / 2e-6, atol=1e-6)


def test_knn_blocks_ties_and_single_rows(spark):
    x = np.repeat(np.arange(30.0), 2)[:, None] * np.ones((1, 2))
    y = np.array([0] * 59 + [1])
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, label int, x array<double>")
    one, many = (sorted(rows(graph.knn_within_class(df, 3, b).select("i", "j", "nth"))) for b in (1000, 7))
    assert one == many and len(one) == 59 * 3 and all(i != j for i, j, _ in one)
    assert (4, 5, 1) in one and (4, 2, 2) in one and (4, 3, 3) in one


def test_exact_median(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal(5001), np.zeros(3000)])
    df = spark.createDataFrame([(0, float(a)) for a in v] + [(1, 1.0), (1, 2.0)], "k int, v double")
    got = dict(rows(graph.exact_median(df, "k", "v")))
    assert np.isclose(got[0], np.median(v)) and got[1] == 1.5


def test_laplacian_identity(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((12, 3))
    e = [(int(i), int(j), float(w)) for i, j, w in zip(rng.integers(0, 12, 30), rng.integers(0, 12, 30), rng.random(30), strict=True)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    edges = spark.createDataFrame(e, "i long, j long, w double")
    w = np.zeros((12, 12))
    for i, j, v in e:
        w[i, j] += v
        w[j, i] += v
    assert np.allclose(graph.local_scatter(df, edges, 12), (x.T @ np.diag(w.sum(axis=1)) @ x - x.T @ w @ x) / 12)


def test_logistic_is_at_its_optimum(data):
    x, y, df = data
    fit = classify.Logistic("features", "label", max_iter=500, tol=1e-10).fit(df)
    w, b = fit.model.coefficientMatrix.toArray(), fit.model.interceptVector.toArray()
    e = np.exp(x @ w.T + b)
    p = e / e.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    assert np.abs(p.T @ x + w).max() < 1e-3
    assert classify.accuracy(fit.transform(df)) > 85


def test_perceptron_learns(data):
    fit = classify.Perceptron("features", "label", hidden=(16,), batch=32, epochs=15).fit(data[2].repartition(2))
    assert classify.accuracy(fit.transform(data[2])) > 85


def test_failed_method_is_a_row(spark, data):
    df = data[2]
    out = experiments.table(spark, experiments.run(df, df, ["PCA", "nonsense"], 2)).collect()
    assert [(o.method, o.status) for o in out] == [("PCA", "OK"), ("nonsense", "FAILED")] and out[1].accuracy is None


def test_neighbours_keep_all_ties():
    """Of many copies the least ids count, whatever the order of the rows."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile(rng.standard_normal(6), (200, 1)), rng.standard_normal((100, 6)) + 9])
    ids = rng.permutation(300)
    t = pa.table({"id": pa.array(ids, pa.int64()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
    out = graph._neighbours(7)(t, t).to_pandas()
    assert len(out) == 300 * 7
    for i, near in out.groupby("i"):
        dist = np.round(np.sqrt(((x - x[ids == i]) ** 2).sum(axis=1)), 10)
        assert list(near["j"]) == [j for j in ids[np.lexsort((ids, dist))] if j != i][:7]


def test_training_lasts_as_surveyed():
    """C1 and C3 of the survey: 5000 iterations and 500 epochs, patience 10, unless the tolerance ends it before."""
    assert classify.CLASSIFIERS["LogReg"]("v", "y", 42).max_iter == 5000
    mlp = classify.CLASSIFIERS["MLP"]("v", "y", 42)
    assert (mlp.epochs, mlp.patience) == (500, 10)
