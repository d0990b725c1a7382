import glob
import math
import os

import pytest

import __spark_entry__ as entry
from lumenfold.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
        return ""
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(plain, r)) for r in pdf[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    assert table(got) == table(duck.sql(catalogue.oracles()[name]).df())


@pytest.mark.parametrize("name", ["pca_reduce", "stream_reduce", "p6_table", "p6_failed_casts"])
def test_query_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_studies(spark):
    """Small grids of the studies: a row for each cell, the same figure where nothing differs but the order of the rows."""
    from lumenfold.operators import experiments as x
    from lumenfold.plans import features

    train, test = features.train_test(spark, DATA)
    rows = x.data_efficiency(train, test, [0.25, 1.0], [1], ["LDA", "nonsense"], 3, threads=2)
    assert [(r["method"], r["fraction"], r["status"]) for r in rows] == [(m, f, s) for f in (0.25, 1.0) for m, s in (("LDA", "OK"), ("nonsense", "FAILED"))]
    assert rows[0]["n_train"] < rows[2]["n_train"] == train.count()
    again = x.repeated_runs(train, test, ["LDA"], 3, [1, 2], threads=2)
    assert [r["seed"] for r in again] == [1, 2] and all(abs(r["accuracy"] - rows[2]["accuracy"]) < 1e-9 for r in again)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["method", "dim", "accuracy", "n_train", "n_test", "rank_no"] and df.count() == 3


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    from lumenfold.operators.reducers import Reducer

    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    model = Reducer.create("PCA", 2, vector="embedding", identity="vec_id").fit(df)
    want = {r.vec_id: [round(x, 9) for x in r.reduced] for r in model.transform(df).collect()}
    got = {r.vec_id: [round(x, 9) for x in r.reduced] for r in catalogue.queries()["stream_reduce"](spark, DATA).collect()}
    assert got == want


def test_command_line(spark, tmp_path, capsys):
    from lumenfold import cli

    cli.main(["--list"])
    assert "cost_analysis" in capsys.readouterr().out
    cli.main(["class_counts", "--data", DATA, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("vec_id sample_id", "if(vec_id % 5 = 0, 'test', 'train') split", "label", "embedding features")
    rows.write.parquet(str(tmp_path / "f"))
    cli.main(["--features", str(tmp_path / "f"), "--methods", "PCA", "--out", str(tmp_path / "r")])
    assert spark.read.parquet(str(tmp_path / "r")).first().status == "OK"
    spark.read.parquet(str(tmp_path / "f")).selectExpr("*", "'b' backbone", "if(sample_id % 2 = 0, 'd', 'e') dataset").write.parquet(str(tmp_path / "g"))
    for study in ("repeated", "sweep", "per-class"):
        cli.main(["--features", str(tmp_path / "g"), "--backbone", "b", "--dataset", "d", "--study", study, "--methods", "PCA", "--components", "2", "--seeds", "1", "2", "--out", str(tmp_path / study)])
        got = spark.read.parquet(str(tmp_path / study))
        assert got.count() == {"sweep": 10, "repeated": 2, "per-class": 10}[study]
