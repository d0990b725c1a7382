import datetime as dt
import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumenfold.llm import quantiles as q

RUNS = "run_id long, ingested_at timestamp, method string, accuracy double, time_total double, run_at timestamp"


def test_codes_keep_order():
    v = np.sort(np.concatenate([np.random.default_rng(0).standard_normal(2000) * 10.0 ** np.random.default_rng(1).integers(-20, 20, 2000), [0.0]]))
    code = q.encode(v)
    assert (np.diff(code.astype(np.int64)) >= 0).all()
    back = q.decode(code)
    assert (np.abs(back - v) <= np.abs(v) * 2.0**-14 + 1e-36).all()


@pytest.mark.parametrize("kind", ["normal", "tail", "ties"])
def test_error_bound(kind):
    rng = np.random.default_rng(3)
    v = {"normal": rng.normal(70, 5, 60_000), "tail": rng.lognormal(4, 2, 60_000), "ties": np.where(rng.random(60_000) < 0.34, 0.0, rng.normal(70, 5, 60_000))}[kind]
    s = q.DyadicSketch()
    for part in np.array_split(v, 7):
        s.add(q.encode(part), np.ones(len(part)))
    qs = np.linspace(0.01, 0.99, 41)
    got, order = s.quantiles(list(qs)), np.sort(v)
    low, high = np.searchsorted(order, got - np.abs(got) * 2.0**-13) / len(v), np.searchsorted(order, got + np.abs(got) * 2.0**-13, "right") / len(v)
    error = np.maximum(0, np.maximum(low - qs, qs - high))
    assert error.max() <= s.eps() and 0 < s.eps() < 0.02


def test_merge_and_delete_are_exact():
    rng = np.random.default_rng(4)
    v, w = rng.normal(0, 9, 5000), rng.normal(5, 1, 3000)
    whole, parts, both = q.DyadicSketch(), [q.DyadicSketch() for _ in range(5)], q.DyadicSketch()
    whole.add(q.encode(v), np.ones(5000))
    for s, p in zip(parts, np.array_split(v, 5), strict=True):
        s.add(q.encode(p), np.ones(len(p)))
    assert (sum(s.all for s in parts) == whole.all).all()
    both.add(q.encode(np.concatenate([v, w])), np.ones(8000))
    both.add(q.encode(w), -np.ones(3000))
    assert (both.all == whole.all).all()
    assert (q._unpack(q._pack(whole.all)) == whole.all).all()


def put(tables, n=3000):
    rng = np.random.default_rng(5)
    t = dt.datetime(2030, 1, 1)
    data = [(i, t, ["LDA", " lda (99D)", "PCA"][i % 3], float(rng.normal(70, 5)), float(rng.lognormal(4, 1)), t + dt.timedelta(days=i % 90)) for i in range(n)]
    data += [(i, t + dt.timedelta(days=1), "PCA", 1.0, 1.0, t) for i in range(0, 300, 3)]  # corrected later, and moved
    data += [(n, t, None, None, math.nan, None), (n + 1, t, "PCA", math.inf, -1.0, t), (None, t, "PCA", 5.0, 5.0, t), (n + 2, None, "X", 50.0, None, None)]
    tables("multi_seed_results", data, RUNS)
    return data


def test_queries_agree(spark, tables):
    data = put(tables)
    last = {}
    for r in data:
        if r[0] is not None and (r[0] not in last or (r[1] or dt.datetime.min) >= (last[r[0]][1] or dt.datetime.min)):
            last[r[0]] = r
    got = {(r.method, r.metric, r.q): r for r in q.p3_percentiles(spark, tables.dir).collect()}
    for m in ("LDA", "PCA"):
        v = np.sort([r[3] for r in last.values() if r[2] is not None and r[2].strip().upper().split(" ")[0] == m and r[3] is not None and 0 <= r[3] <= 100])
        for p in q.QS:
            r = got[(m, "accuracy", p)]
            assert r.n == len(v)
            rank = np.searchsorted(v, r.value * (1 + 1e-4), "right") / len(v), np.searchsorted(v, r.value * (1 - 1e-4)) / len(v)
            assert rank[1] - r.rank_error <= p <= rank[0] + r.rank_error
    assert got[("X", "accuracy", 0.5)].value == pytest.approx(50.0, rel=1e-4) and ("X", "time_total", 0.5) not in got
    corrected = {(r.method, r.metric, r.q): (r.value, r.n) for r in q.p3_corrected(spark, tables.dir).collect() if r.n}
    assert corrected == {k: (r.value, r.n) for k, r in got.items()}


def test_months_add_up(spark, tables):
    put(tables)
    runs = q.counted(q.last_version(q._runs(spark, tables.dir), "run_id", "ingested_at")).withColumn("month", F.month("run_at"))
    whole = q.merge(q.sketches(runs, ["method"], q.METRICS), ["method"])
    months = q.merge(q.sketches(runs.repartition(6), ["month", "method"], q.METRICS), ["month", "method"])
    added = q.merge(months.drop("month"), ["method"])
    a, b = ({(r.method, r.metric): q._unpack(r.sketch).tolist() for r in df.collect()} for df in (whole, added))
    assert a == b


def test_many_groups_and_empty(spark, tables):
    df = spark.range(3000).select(F.when(F.col("id") % 300 > 0, F.col("id") % 300).alias("g"), F.col("id").cast("double").alias("x"))
    got = q.percentiles(q.merge(q.sketches(df, ["g"], ["x"]), ["g"]), ["g"], [0.5])
    assert got.count() == 300 and got.filter("g IS NULL AND n = 10").count() == 1
    tables("multi_seed_results", [], RUNS)
    assert rows(q.p3_percentiles(spark, tables.dir)) == [] and rows(q.p3_corrected(spark, tables.dir)) == []
