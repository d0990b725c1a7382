"""Grids of reducers, classifiers, seeds and sample sizes over labelled vectors, one result row each.

A run that fails is a row with the status FAILED and its error, without figures; the others go on. Times are wall-clock figures
and never part of a comparison.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.classify import evaluate, per_class, standardize
from lumenfold.operators.reducers import Reducer, project
from lumenfold.operators.sampling import per_class as rows_per_class
from lumenfold.operators.sampling import permute, stratified_sample
from lumenfold.session import stage

#: Grids of the surveyed studies (fixed values).
SEEDS = [42, 123, 456, 789, 1024]
FRACTIONS = [0.1, 0.25, 0.5, 1.0]
SIGNIFICANCE_METHODS = ["Full", "PCA", "LDA", "R-LDA", "LFDA", "RDA", "DSB"]
EFFICIENCY_METHODS = ["Full", "PCA", "LDA", "DSB", "RDA"]
MLP_METHODS = ["Full", "PCA", "LDA", "R-LDA"]
METHODS = ["Full", "PCA", "LDA", "PCA+LDA", "R-LDA", "LFDA", "NCA", "RDA", "DSB", "RDA+SMD"]
RUN_SCHEMA = "method string, category string, classifier string, n_components int, seed int, dim int, accuracy double, n_train long, n_test long, time_reduce double, time_classify double, status string, error string"


def each(jobs: Iterable, work: Callable, threads: int) -> list:
    """The results of work for all jobs, in their order; several at a time leave no executor idle while the driver solves, but blur the times."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(work, jobs))


def run(train: DataFrame, test: DataFrame, methods: Iterable[str], k: int, classifiers: Iterable[str] = ("LogReg",), seeds: Iterable[int] = (42,), vector: str = "features", label: str = "label", identity: str = "sample_id", pre_standardize: bool = True, threads: int = 1) -> list[dict]:
    """Reduce once per method, then classify for each classifier and seed (the regression does not depend on the seed and runs once)."""
    if pre_standardize:
        scaled = standardize(train, vector, label, "_x")
        train, test = stage(scaled(train).select(identity, label, "_x"), "train"), stage(scaled(test).select(identity, label, "_x"), "test")
        vector = "_x"
    n_train, n_test = train.count(), test.count()

    def one(name: str) -> list[dict]:
        base = {"method": name, "category": Reducer.REGISTRY.get(name, ("unknown",))[0], "n_components": k, "n_train": n_train, "n_test": n_test}
        try:
            began = time.perf_counter()
            model = Reducer.create(name, k, vector=vector, label=label, identity=identity, out="_r").fit(train)
            small = [stage(model.transform(df).select(identity, label, "_r"), "reduced") for df in (train, test)]
            reduce_s = 0.0 if name == "Full" else time.perf_counter() - began

            def judge(job: tuple[str, int]) -> dict:
                score, seconds, _ = evaluate(*small, "_r", label, *job)
                return base | {"classifier": job[0], "seed": job[1], "dim": model.dim, "accuracy": score, "time_reduce": reduce_s, "time_classify": seconds, "status": "OK", "error": None}

            return each([(c, seed) for c in classifiers for seed in (seeds if c != "LogReg" else list(seeds)[:1])], judge, threads)
        except Exception as e:  # one failing method does not end the study
            return [base | {"classifier": c, "seed": None, "dim": None, "accuracy": None, "time_reduce": None, "time_classify": None, "status": "FAILED", "error": str(e)[:200]} for c in classifiers]

    return [row for rows in each(methods, one, threads) for row in rows]


def repeated_runs(train: DataFrame, test: DataFrame, methods: Iterable[str], k: int, seeds: Iterable[int] = tuple(SEEDS), vector: str = "features", label: str = "label", identity: str = "sample_id", threads: int = 1) -> list[dict]:
    """Every method once for each seed, on the training rows in that seed's order: the runs that paired tests and costs are made of."""
    jobs = [(seed, name) for seed in seeds for name in methods]
    orders = {seed: stage(permute(train, identity, seed), "permuted") for seed in seeds}
    return [r | {"seed": seed} for (seed, _), rows in zip(jobs, each(jobs, lambda j: run(orders[j[0]], test, [j[1]], k, ("LogReg",), (j[0],), vector, label, identity), threads), strict=True) for r in rows]


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RUN_SCHEMA)


def component_sweep(train: DataFrame, test: DataFrame, sizes: list[int], vector: str = "features", label: str = "label", identity: str = "sample_id", seeds: Iterable[int] = tuple(SEEDS[:3]), threads: int = 1) -> list[dict]:
    """Full, and LDA and PCA at several sizes: projections are nested, so each is fitted once at its largest size and cut. The regression does not depend on the seed: one result stands for all."""
    jobs = []
    for name, ks in (("Full", [None]), ("LDA", sizes), ("PCA", sizes)):
        model = Reducer.create(name, max(sizes), vector=vector, label=label, identity=identity).fit(train)
        jobs += [(name, model, k or model.dim) for k in ks]

    def one(job: tuple) -> dict:
        name, model, k = job
        cut = [project(df.select(identity, label, vector), vector, model.mean, model.matrix[:, :k], "_r") for df in (train, test)]
        score, seconds, _ = evaluate(*cut, "_r", label)
        return {"method": name, "n_components": k, "accuracy": score, "time": seconds}

    return [row | {"seed": seed} for row in each(jobs, one, threads) for seed in seeds]


def data_efficiency(train: DataFrame, test: DataFrame, fractions: list[float], seeds: list[int], methods: list[str], k: int, vector: str = "features", label: str = "label", identity: str = "sample_id", threads: int = 1) -> list[dict]:
    """Accuracy by share of the training rows, sampled by class; components shrink with the classes that are there."""
    classes, n = train.select(label).distinct().count(), train.count()

    def one(job: tuple[float, int]) -> list[dict]:
        fraction, seed = job
        part = stage(permute(train, identity, seed) if fraction >= 1 else stratified_sample(train, label, identity, seed, rows_per_class(fraction, n, classes)), "fraction")
        own = max(1, min(k, part.select(label).distinct().count() - 1))
        return [r | {"fraction": fraction, "seed": seed} for r in run(part, test, methods, own, vector=vector, label=label, identity=identity)]

    return [row for rows in each([(f, s) for f in fractions for s in seeds], one, threads) for row in rows]


def per_class_study(train: DataFrame, test: DataFrame, methods: list[str], k: int, vector: str = "features", label: str = "label", identity: str = "sample_id", threads: int = 1) -> DataFrame:
    """(method, label, class_accuracy) of every method."""
    scaled = standardize(train, vector, label, "_x")
    train, test = stage(scaled(train).select(identity, label, "_x"), "train"), stage(scaled(test).select(identity, label, "_x"), "test")

    def one(name: str) -> DataFrame:
        model = Reducer.create(name, k, vector="_x", label=label, identity=identity, out="_r").fit(train)
        predicted = evaluate(*[model.transform(df) for df in (train, test)], "_r", label)[2]
        return per_class(predicted, label).select(F.lit(name).alias("method"), F.col(label).alias("label"), "class_accuracy")

    out = None
    for part in each(methods, one, threads):
        out = part if out is None else out.unionByName(part)
    return out
