import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from lumenfold.operators import drift as d

FILES = "file_id long, folder string, table_name string, seq_no int, file_name string, delimiter string, written_at timestamp"
LINES = "file_id long, line_no int, line_text string"


def put(tables, files, texts):
    tables("result_files", [(i, f, t, s, "x", e, dt.datetime(2030, 1, 1)) for i, f, t, s, e in files], FILES)
    tables("result_lines", [(i, n, line) for i, text in texts.items() for n, line in enumerate(text)], LINES)


def changes(spark, tables):
    return sorted(rows(d.p6_found(spark, tables.dir)))


def test_split_line():
    assert d.split_line('﻿"a" , "b ""q"", c",  ,d', ",") == ["a", 'b "q", c', "", "d"]
    assert d.split_line("a\t\tb", "\t") == ["a", "", "b"]
    assert d.split_line("", ",") == [""]
    assert len(d.split_line('"' + "x," * 200_000 + '"', ",")) == 1


def test_kinds_of_changes(spark, tables):
    put(
        tables,
        [(1, "f", "all_results", 1, ","), (2, "f", "all_results", 3, None), (3, "f", "all_results", 3, ","), (4, "f", "all_results", 7, ";")],
        {
            1: ["run_id,acc,note,gone", "1,70,x,a", "2,71,NaN,b", ""],
            2: ["﻿\"note\";run_id;accuracy;new", "x;1;70.0;q", "na;2;7.1e1;w", "y;3;0.5;w", "   "],
            3: ["run_id,zzz", "1,2"],  # a second copy of seq 3 with a larger id does not count
            4: ["run_id;note;accuracy;new;a", "1;x;n/a;true;1"],
        },
    )
    assert changes(spark, tables) == [(2, "accuracy", "renamed"), (2, "accuracy", "retyped"), (2, "gone", "removed"), (2, "new", "added"), (4, "a", "added"), (4, "accuracy", "retyped"), (4, "new", "retyped")]
    table = {(r.file_id, r.line_no): r for r in d.Drift(spark, tables.dir).typed({"run_id": "bigint", "accuracy": "double"}).collect()}
    assert table[(2, 2)].accuracy == 71.0 and table[(4, 1)].accuracy is None and [tuple(f) for f in table[(4, 1)].failed_casts] == [("accuracy", "accuracy", "n/a")]


def test_column_order_and_no_shared_runs(spark, tables):
    put(tables, [(1, "f", "t", 1, ","), (2, "f", "t", 2, ","), (3, "g", "t", 1, ","), (4, "g", "t", 2, ",")], {1: ["run_id,a,b", "1,2,3"], 2: ["b,run_id,a", "3,1,2"], 3: ["run_id,a", "1,2"], 4: ["run_id,b", "9,2"]})
    assert changes(spark, tables) == [(4, "a", "removed"), (4, "b", "added")]


def test_equal_columns_pair_one_to_one(spark, tables):
    put(tables, [(1, "f", "t", 1, ","), (2, "f", "t", 2, ",")], {1: ["run_id,a,b", "1,5,5", "1,5,5"], 2: ["run_id,c", "1,5"]})
    assert changes(spark, tables) == [(2, "b", "removed"), (2, "c", "renamed")]


def test_nulls_and_empties(spark, tables):
    put(tables, [(1, None, None, None, None), (2, "f", "t", 1, "|"), (3, "f", "t", 2, ",")], {2: [None, "1,2"], 3: ["run_id,a,a", "1", "2,3,4,5"]})
    assert changes(spark, tables) == [(3, "a", "added"), (3, "run_id", "added")]
    put(tables, [], {})
    assert changes(spark, tables) == []
    assert d.p6_table(spark, tables.dir).count() == 0 and d.p6_failed_casts(spark, tables.dir).count() == 0


def test_hot_chain_and_long_cells(spark, tables):
    files = [(i, "hot", "t", i, ",") for i in range(1, 40)]
    put(tables, files, {i: [f"run_id,{'a' if i % 2 else 'b'}", f"1,{'v' * 50_000}"] for i in range(1, 40)})
    got = changes(spark, tables)
    assert len(got) == 38 and {k for _, _, k in got} == {"renamed"}


def test_table_holds_every_field(spark, tables):
    put(
        tables,
        [(1, "f", "all_results", 1, ","), (2, "f", "all_benchmarks", 1, ","), (3, "f", "cifar100_benchmark", 1, ",")],
        {3: ["run_id,lr", "1,0.5"], 1: ["run_id,classifier,accuracy_std,n_components,n_seeds,status,lr,file_id,", "1,LogReg,0.5,9,3,OK,0.1,77,z", "2,MLP,x,9,many,FAILED,3,78,"], 2: ["run_id,Lr,is_pareto,notes,NOTES", "1,low,true,a,b"]},
    )
    df = d.p6_table(spark, tables.dir)
    assert dict(df.dtypes)["lr"] == "double" and dict(df.dtypes)["is_pareto"] == "boolean"
    got = {(r.file_id, r.line_no): r for r in df.collect()}
    a, b, c = got[1, 1], got[1, 2], got[2, 1]
    assert (a.classifier, a.accuracy_std, a.n_components, a.n_seeds, a.status, a.lr, a.file_id_value, a.other_values) == ("LogReg", 0.5, 9, 3, "OK", 0.1, 77, {"": "z"})
    assert (b.accuracy_std, b.n_seeds, b.lr, b.status, b.other_values) == (None, None, 3.0, "FAILED", {"accuracy_std": "x", "n_seeds": "many"})
    assert (c.lr, c.is_pareto, c.notes, c.other_values) == (None, True, "a", {"Lr": "low", "NOTES": "b"})
    assert sorted(rows(d.p6_failed_casts(spark, tables.dir))) == [("all_benchmarks", 2, 1, "lr", "Lr", "low"), ("all_results", 1, 2, "accuracy_std", "accuracy_std", "x"), ("all_results", 1, 2, "n_seeds", "n_seeds", "many")]


def test_every_rename_is_followed_in_its_table(spark, tables):
    put(
        tables,
        [(1, "f", "all_benchmarks", 1, ","), (2, "f", "all_benchmarks", 2, ","), (3, "f", "all_results", 1, ","), (4, "f", "all_results", 2, ","), (5, "g", "all_results", 1, ","), (6, "f", "all_benchmarks", 3, ",")],
        {
            1: ["run_id,accuracy,dim,lr", "1,70,9,5", "2,71,8,6"],
            2: ["run_id,accuracy_mean,out_dim,rate", "1,70,9,5", "2,71,8,6", "3,72,7,7"],
            3: ["run_id,accuracy_mean,dim", "1,60,9"],
            4: ["run_id,accuracy,dim", "1,60,9", "2,61,9"],
            5: ["run_id,accuracy,out_dim,rate", "4,62,5,8"],
            6: ["run_id,accuracy_mean,out_dim,lr", "3,72,7,7"],
        },
    )
    got = {(r.file_id, r.line_no): r for r in d.p6_table(spark, tables.dir).collect()}
    assert all(not r.other_values for r in got.values())
    assert [(got[2, i].accuracy, got[2, i].accuracy_mean, got[2, i].dim, got[2, i].lr) for i in (1, 2, 3)] == [(70, None, 9, 5), (71, None, 8, 6), (72, None, 7, 7)]
    assert (got[4, 2].accuracy, got[4, 2].accuracy_mean) == (None, 61)
    assert (got[5, 1].accuracy, got[5, 1].accuracy_mean, got[5, 1].dim, got[5, 1].lr) == (None, 62, 5, 8)


def test_against_plain_loops(spark):
    import os

    import brute_drift
    import pytest

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    got = rows(d.p6_found(spark, data))
    assert len(got) == len(set(got)) and set(got) == brute_drift.changes(data)


def test_casts_neither_cut_nor_guess(spark):
    df = spark.createDataFrame([(v,) for v in ["7", "+7", "7.0", "7.5", "1e3", "7f", "inf", "yes", "TRUE", "99999999999999999999", "", None]], "v string")
    got = [tuple(r) for r in df.select(*[d.cast_cell(F.col("v"), k) for k in ("bigint", "double", "boolean", "string")]).collect()]
    assert got[:6] == [(7, 7.0, None, "7"), (7, 7.0, None, "+7"), (7, 7.0, None, "7.0"), (None, 7.5, None, "7.5"), (1000, 1000.0, None, "1e3"), (None, None, None, "7f")]
    assert got[6:] == [(None, None, None, "inf"), (None, None, None, "yes"), (None, None, True, "TRUE"), (None, 1e20, None, "9" * 20), (None, None, None, ""), (None,) * 4]


def test_a_name_is_followed_in_its_own_chain(spark, tables):
    """acc is accuracy in one chain, dim in another, and comes up again for a third thing; a chain that says nothing follows the others."""
    put(
        tables,
        [(1, "f", "all_benchmarks", 1, ","), (2, "f", "all_benchmarks", 2, ","), (3, "g", "all_benchmarks", 1, ","), (4, "g", "all_benchmarks", 2, ","), (5, "g", "all_benchmarks", 3, ","), (6, "g", "all_benchmarks", 4, ","), (7, "h", "all_benchmarks", 1, ","), (8, "i", "all_benchmarks", 1, ","), (9, "i", "all_benchmarks", 2, ",")],
        {1: ["run_id,accuracy", "1,70"], 2: ["run_id,acc", "1,70"], 3: ["run_id,dim", "1,9"], 4: ["run_id,acc", "1,9"], 5: ["run_id,size", "1,9"], 6: ["run_id,size,acc", "1,9,5"], 7: ["run_id,acc", "1,3"], 8: ["run_id,accuracy", "1,71"], 9: ["run_id,acc", "1,71"]},
    )
    got = {r.file_id: r for r in d.p6_table(spark, tables.dir).collect()}
    assert [got[i].accuracy for i in (1, 2, 7, 8, 9)] == [70, 70, 3, 71, 71] and [got[i].dim for i in (3, 4, 5, 6)] == [9, 9, 9, 9]
    assert all(not r.other_values for r in got.values())


def test_no_value_is_lost(spark):
    """Every cell with a value is in its column, or among the values that are in none; what fails its cast is reported; lines of descent and types are those of plain loops."""
    import os

    import brute_drift
    import pytest

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    drift = d.Drift(spark, data)
    column = {(r.file_id, r.field_name): r.column for r in drift.fields(d.TARGETS).collect()}
    table_of, descent = brute_drift.descent(data)
    for root in set(descent.values()):
        fields = [f for f, r in descent.items() if r == root]
        own = {n for f, n in fields} & d.OWN[table_of[root[0]]]
        assert len({column[f] for f in fields}) == 1 and (not own or column[fields[0]] in own)
    assert set(column) == set(descent)
    found = drift.typed(d.TARGETS, added=True)
    types, table = dict(found.dtypes), {(r.file_id, r.line_no): r for r in found.collect()}
    reported = {(r.file_id, r.line_no, r.column, r.field_name): r.value for r in d.p6_failed_casts(spark, data).collect()}

    def whole(v):
        if not float(v).is_integer():
            raise ValueError
        return int(float(v))

    parse = {"bigint": whole, "double": float, "boolean": lambda v: {"true": True, "false": False}[v.lower()], "string": str}
    assert types["accuracy"] == "double" and types["run_id"] == "bigint" and types["backbone"] == "string"
    cells, failed = 0, 0
    lines = brute_drift.lines(data)
    assert set(lines) == set(table)
    for key, row in lines.items():
        held: dict = {}
        for n in row:
            c = column[key[0], n]
            held[c] = min(held.get(c, (2,)), (n.lower() != c.lower(), n != c, n))
        for n, v in row.items():
            if v is None:
                continue
            cells, c = cells + 1, column[key[0], n]
            try:
                want = parse[types[c]](v) if held[c][2] == n else None
            except (KeyError, ValueError):
                want = None
                assert reported.pop((*key, c, n)) == v
                failed += 1
            if want is None:
                assert table[key].other_values[n] == v
            else:
                assert table[key][c] == want and n not in table[key].other_values
    assert not reported and cells > 30_000 and failed > 0


def test_hot_file(spark, tables):
    """One file holds most of the lines: its lines are dealt to several tasks, and nothing of it is lost."""
    lines = [f"{i},{i * 2},x" for i in range(3000)]
    put(tables, [(1, "f", "t", 1, ","), (2, "f", "t", 2, ","), (3, "g", "t", 1, ",")], {1: ["run_id,a,b", *lines], 2: ["run_id,c,b", *lines[:50]], 3: ["run_id,a,b", "1,2,x"]})
    assert d.Drift(spark, tables.dir).hot.collect()[0][0] == 1
    assert changes(spark, tables) == [(2, "c", "renamed")]
    table = d.p6_table(spark, tables.dir)
    assert table.count() == 3051 and table.filter("size(other_values) > 0").count() == 0 and table.filter("a IS NULL").count() == 0
