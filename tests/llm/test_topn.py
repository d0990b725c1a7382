import datetime as dt
import math

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import topn

RESULTS = "result_id long, ingested_at timestamp, backbone string, dataset string, method string, accuracy_mean double, time_total double, status string"


def brute(data, n, key=lambda r: (-(r[1] if r[1] is not None else -math.inf), r[2] is None, r[2] or "", r[3])):
    out = []
    for g in {r[0] for r in data}:
        out += [(*r, i + 1) for i, r in enumerate(sorted((r for r in data if r[0] == g), key=key)[:n])]
    return sorted(out, key=str)


VALUES = st.sampled_from([None, -1e300, -1.5, -0.0, 0.0, 1e-300, 2.5, 70.125, 70.126])
ROWS = st.lists(st.tuples(st.sampled_from([None, "a", "b"]), VALUES, st.sampled_from([None, "", "é", "z", "zebra", "zebr", "Z"])), max_size=40)


@settings(max_examples=8, deadline=None)
@given(ROWS, st.integers(1, 6), st.sampled_from([0, 3, 1024]))
def test_against_sorting(spark, data, n, end_rows):
    data = [(*r, i) for i, r in enumerate(data)]
    df = spark.createDataFrame(data, "g string, a double, m string, id long")
    got = topn.top_n(df, ["g"], [("a", False), ("m", True), ("id", True)], n, fanout=4, end_rows=end_rows)
    want = brute([(g, None if a is None else a + 0.0, m, i) for g, a, m, i in data], n, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[2] is None, (r[2] or "").encode(), r[3]))
    assert sorted(((g, None if a is None else a + 0.0, m, i, k) for g, a, m, i, k in rows(got)), key=str) == want


def test_hot_group_of_ties(spark):
    df = spark.range(0, 20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.lit(1.0).alias("a"), "id")
    got = rows(topn.top_n(df, ["g"], [("a", False), ("id", True)], 4).filter("g = 'hot'").orderBy("rank_no").select("id"))
    assert got == [(1,), (2,), (4,), (5,)]
    assert topn.top_n(df, ["g"], [("a", False), ("id", True)], 4).groupBy("g").count().filter("count > 4").count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", 1.0, 7, 5, 6)] * 9, "g string, a double, id long, _need int, _w0 int")
    for end_rows in (0, 1024):
        got = rows(topn.top_n(df, ["g"], [("a", False), ("id", True)], 4, end_rows=end_rows))
    assert len(got) == 4 and sorted(r[-1] for r in got) == [1, 2, 3, 4] and {r[:5] for r in got} == {("x", 1.0, 7, 5, 6)}


def test_n_by_group(spark):
    df = spark.createDataFrame([(g, i, n) for g, n in (("a", 3), ("b", 0), ("c", None), ("d", 99)) for i in range(10)], "g string, i long, n int")
    got = topn.select_top(df, ["g"], [("i", False)], F.col("n"))
    assert sorted(rows(got.groupBy("g").agg(F.count("*"), F.min("i")))) == [("a", 3, 7), ("d", 10, 0)]


def test_types_keep_their_order(spark):
    values = {"long": [-(2**62), -1, 0, 5, 2**62], "date": [dt.date(1969, 1, 1), dt.date(2030, 1, 1)], "timestamp": [dt.datetime(1960, 1, 1), dt.datetime(2030, 1, 1, 1)], "boolean": [False, True], "double": [-math.inf, -1.0, 0.0, 1.0, math.inf, math.nan]}
    for kind, vs in values.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)] + [(-1, None)], f"i int, v {kind}")
        for asc in (False, True):
            want = [*(range(len(vs)) if asc else reversed(range(len(vs)))), -1]
            got = [r.i for r in topn.top_n(df, [], [("v", asc), ("i", True)], 99).orderBy("rank_no").collect()]
            assert got == want, (kind, asc)
            some = {r.i for r in topn.top_n(df, [], [("v", asc), ("i", True)], 2, fanout=4, end_rows=0).collect()}
            assert some == set(want[:2]), (kind, asc)


def test_long_strings(spark):
    stem = "é" * 30_000
    df = spark.createDataFrame([(i, stem + t) for i, t in enumerate(["b", "a", "a\0", "", "c"])], "i int, s string")
    got = [r.i for r in topn.top_n(df, [], [("s", True), ("i", True)], 3, end_rows=5).orderBy("rank_no").collect()]
    assert got == [3, 1, 2]
    short = spark.createDataFrame([(i, "prefix of " + t) for i, t in enumerate(["beta", "alpha", "alpha\0", "", "alphabet"])], "i int, s string")
    got = {r.i for r in topn.top_n(short, [], [("s", True), ("i", True)], 3, end_rows=0).collect()}
    assert got == {3, 1, 2}


def test_found_rules(spark, tables):
    t = lambda d: dt.datetime(2030, 1, d)
    data = [
        (1, t(1), " ResNet18 ", "cifar", "LDA", 99.0, 1.0, "OK"), (1, t(2), "resnet18", "cifar100", "LDA", 70.0, 1.0, " ok "), (1, t(2), "resnet18", "cifar100", "LDA", 70.0, 1.0, " ok "),
        (2, t(1), "resnet18", "cifar", "LDA", 70.0, None, "OK"), (3, t(1), "resnet18", "cifar100", "DSB", 70.0, 1.0, "OK"), (4, t(1), "resnet18", "cifar100", None, 100.0, 1.0, "FAILED"),
        (5, t(1), "resnet18", "cifar100", "A", 100.5, 1.0, "OK"), (6, t(1), "resnet18", "cifar100", "A", math.nan, 1.0, "OK"), (7, t(1), "resnet18", "cifar100", "A", None, 1.0, "OK"), (8, None, None, None, None, None, None, None),
        (9, t(1), "resnet18", "cifar_s1", "A", 1.0, 1.0, "OK"), (None, t(1), "resnet18", "cifar100", "A", 100.0, 1.0, "OK"), (10, t(1), "resnet18", "cifar100", "Z", 10.0, 1.0, "OK"),
    ]
    tables("all_results", data, RESULTS)
    assert sorted(rows(topn.p2_found(spark, tables.dir))) == [("resnet18", "cifar100", 1, 3), ("resnet18", "cifar100", 2, 1), ("resnet18", "cifar100", 3, 2), ("resnet18", "cifar100_s1", 1, 9)]
    tables("all_results", [], RESULTS)
    assert rows(topn.p2_found(spark, tables.dir)) == []
