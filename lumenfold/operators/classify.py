"""Standardising, classifiers and their scores.

Labels of any type are indexed in order. Rows without a vector or label are left out of fitting and scoring.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.moments import Moments, classes, dense, moments, pack, tree_sum, unpack
from lumenfold.operators.reducers import project


def standardize(train: DataFrame, vector: str, label: str, out: str, m: Moments | None = None):
    """A function that adds the standardised vector (mean and population deviation of train) to a table."""
    m = m or moments(train, vector, label)
    return lambda df: project(df, vector, m.mean, np.diag(1 / m.scale), out)


class Logistic:
    """Multinomial logistic regression with L2 penalty 1 / (c * n) and an unpenalised intercept."""

    def __init__(self, vector: str, label: str, c: float = 1.0, max_iter: int = 5000, tol: float = 1e-6):
        self.vector, self.label, self.c, self.max_iter, self.tol = vector, label, c, max_iter, tol

    def fit(self, df: DataFrame):
        good = df.filter(F.col(self.vector).isNotNull() & F.col(self.label).isNotNull())
        labels = classes(good, self.label)
        n = good.count()
        index = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
        self.prepare = lambda t: t.withColumns({"_v": array_to_vector(F.col(self.vector)), "_y": index[F.col(self.label)]})
        lr = LogisticRegression(featuresCol="_v", labelCol="_y", family="multinomial", regParam=1 / (self.c * n), elasticNetParam=0.0, standardization=False, maxIter=self.max_iter, tol=self.tol)
        self.model = lr.fit(self.prepare(good).select("_v", "_y"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prepare(df)).drop("_v", "rawPrediction", "probability")


def logistic(vector: str, label: str, **kw) -> Logistic:
    return Logistic(vector, label, **kw)


class Perceptron:
    """ReLU layers and a softmax, trained by Adam in mini-batches with early stopping on a held-out tenth.

    Every partition runs an epoch from the shared weights and the results are averaged by rows, so no task needs all rows;
    with one partition this is ordinary training.
    """

    def __init__(self, vector: str, label: str, hidden: tuple[int, ...] = (256, 128), batch: int = 256, rate: float = 1e-3, epochs: int = 500, patience: int = 10, seed: int = 42):
        self.vector, self.label, self.hidden, self.batch, self.rate, self.epochs, self.patience, self.seed = vector, label, hidden, batch, rate, epochs, patience, seed

    @staticmethod
    def forward(x: np.ndarray, layers: list[np.ndarray]) -> list[np.ndarray]:
        acts = [x]
        for i in range(0, len(layers), 2):
            z = acts[-1] @ layers[i] + layers[i + 1]
            acts.append(np.maximum(z, 0) if i + 2 < len(layers) else z)
        return acts

    @classmethod
    def gradients(cls, x: np.ndarray, y: np.ndarray, layers: list[np.ndarray], penalty: float) -> list[np.ndarray]:
        acts = cls.forward(x, layers)
        e = np.exp(acts[-1] - acts[-1].max(axis=1, keepdims=True))
        delta = e / e.sum(axis=1, keepdims=True)
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        out: list[np.ndarray] = [None] * len(layers)
        for i in range(len(layers) - 2, -1, -2):
            out[i], out[i + 1] = acts[i // 2].T @ delta + penalty * layers[i] / len(y), delta.sum(axis=0)
            if i:
                delta = (delta @ layers[i].T) * (acts[i // 2] > 0)
        return out

    def fit(self, df: DataFrame):
        good = df.filter(F.col(self.vector).isNotNull() & F.col(self.label).isNotNull())
        self.labels = classes(good, self.label)
        order = {v: i for i, v in enumerate(self.labels)}
        d = good.select(F.size(self.vector)).first()[0]
        held = F.pmod(F.xxhash64(self.vector, F.lit(self.seed)), F.lit(10)) == 0
        train, valid = good.filter(~held).select(self.vector, self.label), good.filter(held).select(self.vector, self.label)
        rng = np.random.default_rng(self.seed)
        sizes = [d, *self.hidden, len(self.labels)]
        layers = []
        for a, b in zip(sizes, sizes[1:], strict=False):
            bound = np.sqrt(6 / (a + b))
            layers += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        n, zero = len(layers), [np.zeros_like(w) for w in layers]
        state = {"layers": layers, "m": zero, "v": [z.copy() for z in zero], "t": 0}
        vector, label, batch, rate, seed, cls = self.vector, self.label, self.batch, self.rate, self.seed, type(self)

        def epoch(number: int, now: dict):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                w, m, v, t = [a.copy() for a in now["layers"]], [a.copy() for a in now["m"]], [a.copy() for a in now["v"]], now["t"]
                rows, shuffle = 0, np.random.default_rng([seed, number])
                for b in batches:
                    if not b.num_rows:
                        continue
                    x, y = dense(b[vector]), np.fromiter((order[q] for q in b[label].to_pylist()), np.int64, b.num_rows)
                    perm = shuffle.permutation(len(x))
                    for at in range(0, len(x), batch):
                        i = perm[at : at + batch]
                        t += 1
                        for k, g in enumerate(cls.gradients(x[i], y[i], w, 1e-4)):
                            m[k] = 0.9 * m[k] + 0.1 * g
                            v[k] = 0.999 * v[k] + 0.001 * g * g
                            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    rows += len(x)
                if rows:
                    sums = {f"{name}{k}": a * rows for name, arrays in (("w", w), ("m", m), ("v", v)) for k, a in enumerate(arrays)}
                    yield pa.RecordBatch.from_arrays([pa.array([pack(sums | {"rows": np.array([rows]), "t": np.array([t * rows])})], pa.binary())], ["part"])

            return run

        best, self.layers, waited = -1.0, layers, 0
        for e in range(self.epochs):
            got = tree_sum(train.mapInArrow(epoch(e, state), "part binary")).first()
            if got is None:
                break
            s = unpack(got.part)
            rows = s["rows"][0]
            state = {"layers": [s[f"w{k}"] / rows for k in range(n)], "m": [s[f"m{k}"] / rows for k in range(n)], "v": [s[f"v{k}"] / rows for k in range(n)], "t": int(s["t"][0] / rows)}
            score = self._score(valid, state["layers"])
            if score > best + 1e-4:
                best, self.layers, waited = score, state["layers"], 0
            else:
                waited += 1
                if waited >= self.patience:
                    break
        return self

    def _predict(self, df: DataFrame, layers: list[np.ndarray]) -> DataFrame:
        vector, forward = self.vector, self.forward

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                top = forward(dense(b[vector]), layers)[-1].argmax(axis=1).astype(float) if b.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top)], [*b.schema.names, "prediction"])

        return df.mapInArrow(run, df.withColumn("prediction", F.lit(0.0)).schema)

    def _index(self):
        return F.create_map(*[x for i, v in enumerate(self.labels) for x in (F.lit(v), F.lit(float(i)))])[F.col(self.label)]

    def _score(self, df: DataFrame, layers: list[np.ndarray]) -> float:
        seen = self._predict(df, layers).withColumn("_y", self._index())
        return seen.agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0] or 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        return self._predict(df.filter(F.col(self.vector).isNotNull()), self.layers).withColumn("_y", self._index())


CLASSIFIERS = {"LogReg": lambda vector, label, seed: Logistic(vector, label), "MLP": lambda vector, label, seed: Perceptron(vector, label, seed=seed)}


def accuracy(predicted: DataFrame) -> float:
    return 100 * (predicted.agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0] or 0.0)


def per_class(predicted: DataFrame, label: str) -> DataFrame:
    return predicted.groupBy(label).agg((100 * F.avg((F.col("prediction") == F.col("_y")).cast("double"))).alias("class_accuracy"))


def evaluate(train: DataFrame, test: DataFrame, vector: str, label: str, classifier: str = "LogReg", seed: int = 42) -> tuple[float, float, DataFrame]:
    """(accuracy in percent, seconds, predictions on test) of a classifier on standardised vectors."""
    began = time.perf_counter()
    scaled = standardize(train, vector, label, "_s")
    model = CLASSIFIERS[classifier]("_s", label, seed).fit(scaled(train))
    predicted = model.transform(scaled(test)).drop("_s")
    return accuracy(predicted), time.perf_counter() - began, predicted
