import math

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.functions import stats
from lumenfold.operators import results as op
from lumenfold.sources import results as src

RUNS = "backbone string, dataset string, method string, seed int, accuracy double, time_total double, time_reduce double, time_classify double, dim int"


def runs(spark):
    data = []
    for i, s in enumerate([42, 123, 456, 789, 1024]):
        base = 70 + 0.1 * i
        for m, a in (("LDA", base), ("Same", base), ("Shift", base + 1.0), ("Mixed", base + [0.10, -0.02, -0.03, 0.02, 0.09][i])):
            data.append(("b", "d", m, s, round(a, 3), 10.0 + i, 1.0, 2.0, 9))
    data.append(("b", "d", "Short", 42, 1.0, 1.0, 1.0, 1.0, 9))
    return spark.createDataFrame(data, RUNS)


def test_significance(spark):
    got = {r.method: r for r in op.significance(runs(spark)).collect()}
    assert set(got) == {"Same", "Shift", "Mixed"}
    assert got["Same"].w_stat == 0 and got["Same"].p_wilcoxon == 1.0 and got["Same"].t_stat is None
    assert got["Shift"].method_mean == 71.2 and got["Shift"].p_wilcoxon == 0.0625
    assert got["Mixed"].p_wilcoxon in (0.4375, 0.5)


def test_constant_difference_is_infinite(spark):
    pairs = spark.createDataFrame([("b", "d", "m", i, 1.0) for i in range(5)] + [("b", "d", "n", i, -0.5) for i in range(5)], "backbone string, dataset string, method string, seed int, d double")
    got = {r.method: (r.t_stat, r.p_ttest) for r in op.ttest(pairs).collect()}
    assert got == {"m": (math.inf, 0.0), "n": (-math.inf, 0.0)}


def test_t_pvalue_closed_form():
    t = np.array([0.0, 0.5, 1.3, 2.7, 9.0, 40.0])
    u = 1 + t**2 / 4
    closed = 2 * (0.5 - 0.375 * (t / np.sqrt(u)) * (1 - t**2 / (12 * u)))
    assert np.allclose(stats.incomplete_beta(2, 0.5, 4 / (4 + t**2)), closed, atol=1e-10)
    assert np.allclose(stats.incomplete_beta(0.5, 0.5, 1 / (1 + t**2)), 1 - 2 * np.arctan(t) / np.pi, atol=1e-8)


def test_wilcoxon_enumeration(spark):
    import itertools

    ranks = [1.5, 1.5, 3.0, 4.0, 5.0, 6.0]
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=6)]
    from pyspark.sql import functions as F

    for w in (0.0, 3.0, 7.5):
        assert stats.signed_rank_p(np.array(ranks), w) == min(1.0, 2 * sum(s <= w for s in sums) / 64)
    # The same differences as an array: sizes 2, 2, 3, 4, 5, 6 and two zeros.
    got = spark.range(1).select(stats.wilcoxon(F.array(*[F.lit(x) for x in (2.0, -2.0, 3.0, 0.0, -4.0, 5.0, 6.0, 0.0)]))).first()[0]
    assert got.w == 5.5 and got.p == min(1.0, 2 * sum(s <= 5.5 for s in sums) / 64)
    assert tuple(spark.range(1).select(stats.wilcoxon(F.array(F.lit(0.0)))).first()[0]) == (0.0, 1.0)
    many = {0: 1}
    for r in range(1, 31):  # exact far beyond what can be listed
        many = {s: many.get(s, 0) + many.get(s - r, 0) for s in range(r * (r + 1) // 2 + 1)}
    assert abs(stats.signed_rank_p(np.arange(1.0, 31), 120) - 2 * sum(n for s, n in many.items() if s <= 120) / 2**30) < 1e-12
    assert abs(stats.signed_rank_p(np.arange(1.0, 51), 400) - stats.signed_rank_p(np.arange(1.0, 52), 420)) < 0.05


def test_pareto_definitions(spark):
    data = [("b", "d", "a", 80.0, 10.0), ("b", "d", "b", 80.0, 10.0), ("b", "d", "c", 79.0, 10.0), ("b", "d", "e", 80.0, 12.0), ("b", "d", "f", 85.0, 12.0), ("b", "d", "g", 60.0, 5.0), ("b", "d", "h", 60.0, 6.0)]
    df = spark.createDataFrame(data, "backbone string, dataset string, method string, mean_accuracy double, mean_time double")
    flagged = {r.method for r in op.pareto(df).filter("is_pareto").collect()}
    assert flagged == {r.method for r in op.pareto_pairwise(df).collect()} == {"a", "b", "f", "g"}
    assert {r.method for r in op.frontier(df, op.CONFIG, "mean_accuracy", "mean_time").collect()} == {"a", "f", "g"}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=12))
def test_pareto_property(spark, points):
    df = spark.createDataFrame([("b", "d", f"m{i}", float(a), float(t)) for i, (a, t) in enumerate(points)], "backbone string, dataset string, method string, mean_accuracy double, mean_time double")
    want = {f"m{i}" for i, (a, t) in enumerate(points) if not any(b >= a and u <= t and (b > a or u < t) for b, u in points)}
    assert {r.method for r in op.pareto(df).filter("is_pareto").collect()} == want


def test_keep_last_and_rank(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 3, None), ("a", 2, 7.0), (None, 1, 1.0), (None, 2, 2.0)], "method string, seq int, accuracy double")
    assert sorted(rows(op.keep_last(df, ["method"], ["seq"])), key=str) == [("a", 3, None), (None, 2, 2.0)]
    ranked = op.rank_methods(df.filter("method = 'a'"), [], tie="seq")
    assert [r.seq for r in ranked.orderBy("rank_no").collect()] == [2, 1, 3]


def test_csv_sources(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("DSB (2 rounds, 99D)", 1.5), ("x", None)], "method string, accuracy double")
    src.write_csv(df, path)
    assert sorted(rows(src.read_csv(spark, path, df.schema))) == sorted(rows(df))
    assert dict(src.read_csv(spark, path).dtypes)["accuracy"] == "double"
    assert src.read_csv(spark, str(tmp_path / "none"), df.schema).count() == 0
    sink = str(tmp_path / "sink")
    for a in (1.0, 2.0):
        src.append_config(spark.createDataFrame([("x", a)], df.schema), sink, ["method"])
    src.append_config(spark.createDataFrame([("y", 3.0)], df.schema), sink, ["method"])
    assert sorted(r.accuracy for r in spark.read.parquet(sink).collect()) == [2.0, 3.0]


def test_half_up_sql():
    assert stats.half_up_sql("SELECT round(avg(round(x, 2)), 3)") == "SELECT round(avg(round(x + 1e-9 * sign(x), 2)) + 1e-9 * sign(avg(round(x + 1e-9 * sign(x), 2))), 3)"


@pytest.mark.parametrize("name", ["rank_methods", "significance_report", "cost_analysis", "config_grid", "dedupe_keep_last"])
def test_empty_tables(spark, tables, name):
    from lumenfold.plans import results as plans

    big = "/root/testdata/sf0.001"
    for t in ("multi_seed_results", "all_results", "all_benchmarks", "cifar100_benchmark"):
        try:
            schema = spark.read.parquet(f"{big}/{t}.parquet").schema
        except Exception:
            pytest.skip("no test data")
        tables(t, [], schema)
    assert plans.QUERIES[name](spark, tables.dir).count() == 0
