"""Delimited result files whose columns drift: one consistent table, and every change between the files of a chain.

Lines are loaded as maps from field name to raw value; per file and field the raw types are counted; files are compared with
the one before them in their chain; typed columns are projected from the maps, and values that do not cast are reported.

A field is followed through its chain from the file in which it comes up: its line of descent is the names it is renamed from and
to there, found by doubling the steps of a pointer. A line that bears the name of one of its table's columns is that column. Only
a line without such a name takes its column from what other chains call its names. A column's type is the one that at least half
of its values in all files are of.

Defined results: a file without a header has no fields; a value beyond the header is dropped and a missing one is no value;
of equal names in a header the first counts; a field without any value is a bigint (the narrowest type fits vacuously);
two fields are renamed only if the files share a run; of several fields with equal cells, the first gone pairs with the first new.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.skew import frequent, lookup, small
from lumenfold.session import parallelism, stage

DELIMITERS = [",", ";", "\t", "|"]
NO_VALUE = ["", "na", "null", "nan"]
BIGINT = r"^[+-]?[0-9]+$"
DOUBLE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
BLANKS = " \t\r\n﻿"


def chains(files: DataFrame) -> DataFrame:
    """files without second copies, with prev_file_id: the file with the next smaller seq_no of the same (folder, table_name)."""
    chain = ["folder", "table_name"]
    firsts = files.groupBy(*chain, "seq_no").agg(F.min(F.struct("file_id", "delimiter")).alias("f")).select(*chain, "seq_no", "f.*")
    return firsts.withColumn("prev_file_id", F.lag("file_id").over(Window.partitionBy(*chain).orderBy("seq_no")))


def with_headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """files with header (text or null) and delimiter; an undeclared or unused delimiter is the one that splits the header most."""
    heads = lines.filter("line_no = 0").groupBy("file_id").agg(F.min("line_text").alias("header"))
    parts = lambda d: F.length("header") - F.length(F.replace(F.col("header"), F.lit(d), F.lit("")))
    most = F.greatest(*[F.struct(parts(d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    used = F.col("delimiter").isNotNull() & (F.length("delimiter") == 1) & F.contains(F.col("header"), F.col("delimiter"))
    return files.join(heads, "file_id", "left").withColumn("delimiter", F.when(used, F.col("delimiter")).otherwise(most["d"]))


def _clean(cell: str) -> str:
    cell = cell.strip(BLANKS)
    if len(cell) > 1 and cell[0] == cell[-1] == '"':
        cell = cell[1:-1].replace('""', '"').strip(BLANKS)
    return cell


def split_line(text: str, delimiter: str) -> list[str]:
    """The cells of a line without byte order mark, quotes and surrounding blanks."""
    if '"' not in text:
        return [c.strip(BLANKS) for c in text.split(delimiter)]
    csv.field_size_limit(sys.maxsize)
    cells = next(csv.reader([text.replace("\0", "").replace("\r", " ").replace("\n", " ").lstrip(BLANKS if delimiter != "\t" else " \r\n﻿")], delimiter=delimiter, skipinitialspace=delimiter != " "), [])
    return [_clean(c) for c in cells]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = set(NO_VALUE)

    @lru_cache(maxsize=4096)
    def names(header: str, delimiter: str) -> list[str]:
        return split_line(header, delimiter)

    for b in batches:
        out = []
        for header, delimiter, text in zip(b["header"].to_pylist(), b["delimiter"].to_pylist(), b["line_text"].to_pylist(), strict=True):
            row: dict[str, str | None] = {}
            cells = split_line(text, delimiter)
            for i, name in enumerate(names(header, delimiter)):
                if name not in row:
                    row[name] = cells[i] if i < len(cells) and cells[i].lower() not in empty else None
            out.append(list(row.items()))
        yield pa.RecordBatch.from_arrays([b["file_id"], b["line_no"], pa.array(out, pa.map_(pa.string(), pa.string()))], ["file_id", "line_no", "cells"])


def load_cells(files: DataFrame, lines: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(file_id, line_no, cells MAP<STRING, STRING>) of each line that holds a non-blank; cells without a value are null.

    Line 0 holds the header mapped to itself, so that fields of files without data are known. hot: file_ids of very many lines.
    """
    known = files.filter(F.col("header").isNotNull()).select("file_id", "header", "delimiter")
    rows = lookup(lines.filter(F.col("line_text").rlike(r"[^ \t\r\n]")).select("file_id", "line_no", "line_text"), known, "file_id", hot, F.col("line_no"))
    return rows.select("file_id", "line_no", "line_text", "header", "delimiter").mapInArrow(_parse, "file_id long, line_no int, cells map<string,string>")


def field_types(cells: DataFrame) -> DataFrame:
    """(file_id, field_name, position, n_values, n_bigint, n_double, n_boolean, type): how many values are of which type, and the narrowest type that fits all values of a field in a file."""
    long = cells.select("file_id", "line_no", F.posexplode("cells").alias("position", "field_name", "value"))
    value, data = F.col("value"), F.col("line_no") > 0
    fits = lambda test: F.count_if(data & value.isNotNull() & test).alias
    stats = long.groupBy("file_id", "field_name").agg(
        F.min("position").alias("position"), fits(F.lit(True))("n_values"), fits(value.rlike(BIGINT))("n_bigint"), fits(value.rlike(DOUBLE))("n_double"), fits(F.lower(value).isin("true", "false"))("n_boolean"),
    )
    kind = F.when(F.col("n_bigint") == F.col("n_values"), "bigint").when(F.col("n_double") == F.col("n_values"), "double").when(F.col("n_boolean") == F.col("n_values"), "boolean").otherwise("string")
    return stats.select("file_id", "field_name", "position", "n_values", "n_bigint", "n_double", "n_boolean", kind.alias("type"))


def cast_cell(value: Column, kind: str) -> Column:
    """The value in a type that it is written in; null for any other, as a plain cast would cut or guess. A bigint may be written as a decimal without a fraction."""
    if kind == "bigint":
        whole = value.try_cast("double")
        return F.when(value.rlike(BIGINT), value.try_cast("bigint")).when(value.rlike(DOUBLE) & (whole == F.floor(whole)) & (F.abs(whole) < float(1 << 53)), whole.try_cast("bigint"))
    fits = {"double": value.rlike(DOUBLE), "boolean": F.lower(value).isin("true", "false")}
    return F.when(fits[kind], value.try_cast(kind)) if kind in fits else value


def _comparable(value: Column) -> Column:
    """Equal for cells that count as equal: numbers by value, other text as it is, and no value."""
    return F.when(value.isNull(), "-").when(value.rlike(DOUBLE), F.concat(F.lit("n"), (value.cast("double") + F.lit(0.0)).cast("string"))).otherwise(F.concat(F.lit("t"), value))


def _signatures(cells: DataFrame, fields: DataFrame, own: str, step: str, other_runs: DataFrame) -> DataFrame:
    """Order-free digest of each field's cells over the runs that both files of a step hold. own: column of fields with the file that holds it.

    Lines that the other file has no run of are dropped before any cell is taken out, and only the cells of fields are.
    """
    wanted = fields.groupBy(*{own, step}).agg(F.collect_list(F.struct("field_name", "position")).alias("wanted"))  # at most the names of a header
    lines = cells.filter(F.col("line_no") > 0).select(F.col("file_id").alias(own), _comparable(F.col("cells")["run_id"]).alias("run"), "cells").filter(F.col("run") != "-")
    narrow = lines.join(small(wanted, 200_000), own).select(step, "run", F.transform("wanted", lambda w: F.struct(w["field_name"].alias("field_name"), w["position"].alias("position"), F.col("cells")[w["field_name"]].alias("value"))).alias("wanted"))
    shared = narrow.join(other_runs, [step, "run"], "left_semi")
    long = shared.select(step, "run", F.inline("wanted")).withColumn("value", _comparable(F.col("value"))).distinct()
    h = F.xxhash64("run", "value")
    return long.groupBy(step, "field_name", "position").agg(F.struct(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(run, value = '-'))")).alias("signature"))


def changes(files: DataFrame, cells: DataFrame, types: DataFrame) -> DataFrame:
    """(file_id, field_name, change_kind, old_name) of each file against the one before it in its chain."""
    steps = files.filter(F.col("prev_file_id").isNotNull()).select("file_id", "prev_file_id")
    now = steps.join(types, "file_id").select("file_id", "prev_file_id", "field_name", F.col("type").alias("new_type"), F.col("position").alias("new_position"))
    before = types.withColumnRenamed("file_id", "prev_file_id").join(steps, "prev_file_id").select("file_id", "prev_file_id", "field_name", F.col("type").alias("old_type"), F.col("position").alias("old_position"))
    both = stage(now.join(before, ["file_id", "prev_file_id", "field_name"], "full"), "drift-fields")
    gone, new = both.filter("new_type IS NULL"), both.filter("old_type IS NULL")
    # Only steps with gone and new names can hold renames; their cells are digested once each, and equal digests joined.
    open_steps = gone.select("file_id").distinct().join(new.select("file_id").distinct(), "file_id", "left_semi")
    runs = cells.filter("line_no > 0").select(F.col("file_id").alias("f"), _comparable(F.col("cells")["run_id"]).alias("run")).filter(F.col("run") != "-")
    in_now = runs.withColumnRenamed("f", "file_id")
    in_before = runs.join(steps.withColumnRenamed("prev_file_id", "f"), "f").select("file_id", "run")
    gone_sig = _signatures(cells, gone.join(open_steps, "file_id", "left_semi").withColumnRenamed("old_position", "position"), "prev_file_id", "file_id", in_now)
    new_sig = _signatures(cells, new.join(open_steps, "file_id", "left_semi").withColumnRenamed("new_position", "position"), "file_id", "file_id", in_before)
    nth = F.row_number().over(Window.partitionBy("file_id", "signature").orderBy("position", "field_name"))
    pairs = gone_sig.withColumn("nth", nth).withColumnRenamed("field_name", "old_name").drop("position").join(new_sig.withColumn("nth", nth).drop("position"), ["file_id", "signature", "nth"])
    renames = stage(pairs.select("file_id", "field_name", "old_name"), "drift-renames")
    old_types = before.select("file_id", F.col("field_name").alias("old_name"), "old_type")
    renamed = renames.join(now.select("file_id", "field_name", "new_type"), ["file_id", "field_name"]).join(old_types, ["file_id", "old_name"])
    out = lambda df, kind, old=None: df.select("file_id", "field_name", F.lit(kind).alias("change_kind"), (F.col(old) if old else F.lit(None).cast("string")).alias("old_name"))
    taken = renames.select("file_id", F.col("old_name").alias("field_name"))
    return (
        out(renames, "renamed", "old_name")
        .unionByName(out(gone.join(taken, ["file_id", "field_name"], "left_anti"), "removed"))
        .unionByName(out(new.join(renames, ["file_id", "field_name"], "left_anti"), "added"))
        .unionByName(out(both.filter("old_type <> new_type"), "retyped"))
        .unionByName(out(renamed.filter("old_type <> new_type"), "retyped", "old_name"))
    )


#: Distinct names, or distinct renames, of all files; they are held on the driver.
MAX_NAMES = 100_000
#: Columns of the consistent table.
MAX_COLUMNS = 1000
#: The columns of the three tables, and their types where no file holds a value of them.
TARGETS = {
    "run_id": "bigint", "backbone": "string", "dataset": "string", "method": "string", "category": "string", "classifier": "string", "accuracy": "double", "accuracy_mean": "double", "accuracy_std": "double",
    "dim": "bigint", "feature_dim": "bigint", "n_classes": "bigint", "n_components": "bigint", "time_reduce": "double", "time_classify": "double", "time_total": "double", "n_seeds": "bigint", "status": "string",
}
#: What the tables have of them: where a table has only one of accuracy and accuracy_mean, the other is a rename of it.
_BENCH = {"run_id", "backbone", "dataset", "method", "category", "accuracy", "dim", "time_reduce", "time_classify", "time_total"}
OWN = {"all_benchmarks": _BENCH, "cifar100_benchmark": _BENCH | {"n_classes", "feature_dim"}, "all_results": set(TARGETS) - {"accuracy"}}


class Drift:
    """The parts of a drift study over manifest files and their lines."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        lines = spark.read.parquet(f"{sf_dir}/result_lines.parquet")
        hot = frequent(lines, "file_id", parallelism(spark))  # at most four times as many as tasks
        self.hot = spark.createDataFrame([(h,) for h in hot], "file_id long") if hot else None
        self.files = stage(with_headers(chains(spark.read.parquet(f"{sf_dir}/result_files.parquet")), lines), "drift-files")
        self.cells = stage(load_cells(self.files, lines, self.hot), "drift-cells")
        self.types = stage(field_types(self.cells), "drift-types")

    def changes(self) -> DataFrame:
        return changes(self.files, self.cells, self.types)

    def lines_of_descent(self, steps: DataFrame) -> DataFrame:
        """(file_id, field_name, table_name, root_file, root_name): the file and name with which the field of a file began in its chain. steps: changes."""
        files = self.files.select("file_id", "folder", "table_name", "seq_no", "prev_file_id")
        began = steps.filter("change_kind IN ('renamed', 'added')").select("file_id", "field_name", "old_name", F.lit(True).alias("new"))
        nodes = self.types.select("file_id", "field_name").join(files, "file_id").join(began, ["file_id", "field_name"], "left")
        # A field goes on until a file of its chain holds it anew; a running last value needs no memory of the chain.
        along = Window.partitionBy("folder", "table_name", "field_name").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        nodes = nodes.withColumn("start", F.last(F.when(F.col("new") | F.col("prev_file_id").isNull(), F.col("file_id")), ignorenulls=True).over(along))
        nodes = stage(nodes.select("file_id", "field_name", "table_name", "prev_file_id", "old_name", "start"), "drift-nodes")
        before = nodes.select(F.col("file_id").alias("prev_file_id"), F.col("field_name").alias("old_name"), F.col("start").alias("root_file"))
        up = stage(nodes.filter("old_name IS NOT NULL").join(before, ["prev_file_id", "old_name"]).select(F.col("file_id").alias("start"), "field_name", "root_file", F.col("old_name").alias("root_name")), "drift-up")
        while True:
            on = up.select(F.col("start").alias("root_file"), F.col("field_name").alias("root_name"), F.col("root_file").alias("next_file"), F.col("root_name").alias("next_name"))
            up = stage(up.join(on, ["root_file", "root_name"], "left").select("start", "field_name", F.coalesce("next_file", "root_file").alias("root_file"), F.coalesce("next_name", "root_name").alias("root_name"), F.col("next_file").isNotNull().alias("moved")), "drift-up")
            if not up.filter("moved").head(1):
                break
        return nodes.join(up.drop("moved"), ["start", "field_name"], "left").select("file_id", "field_name", F.coalesce("table_name", F.lit("")).alias("table_name"), F.coalesce("root_file", "start").alias("root_file"), F.coalesce("root_name", "field_name").alias("root_name"))

    def names(self, targets: list[str], fields: set[tuple[str, str]], steps: DataFrame) -> dict[tuple[str, str], str]:
        """(table_name, name) -> column of each of the lower-case names in fields, by the renames of all chains: the target that they lead to, else the name itself or the first of those it was renamed from or to.

        Every rename counts, those of the table itself before those of other tables and frequent ones before rare ones; only one
        that would join two of the table's own targets does not. Works on distinct names, not on files.
        """
        files = self.files.select("file_id", F.coalesce("table_name", F.lit("")).alias("table_name"))
        renames = steps.filter("change_kind = 'renamed'").join(files, "file_id").groupBy("table_name", "old_name", "field_name").agg(F.count(F.lit(1)).alias("n")).limit(MAX_NAMES + 1).collect()
        if len(renames) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} distinct renames")
        edges = sorted((-r.n, r.old_name.lower(), r.field_name.lower(), r.table_name) for r in renames)

        def joined(own: set[str], some: list[tuple]) -> dict[str, list[str]]:
            """name -> the names that some of the edges join it with."""
            groups: dict[str, list[str]] = {}
            for _, a, b, _ in some:
                x, y = groups.setdefault(a, [a]), groups.setdefault(b, [b])
                if x is not y and not (own & set(x) and own & set(y)):
                    x += y
                    groups.update(dict.fromkeys(y, x))
            return groups

        out = {}
        low = {t.lower(): t for t in targets}
        # Added fields bear one name in all tables.
        common = joined(set(low), edges)
        for table in {t for t, _ in fields}:
            own = set(low) & OWN.get(table, set(low))
            groups = joined(own, [e for e in edges if e[3] == table] + [e for e in edges if e[3] != table])
            for name in {n for t, n in fields if t == table}:
                group = groups.get(name, [name])
                first = [t for t in low if t in own and t in group] or [name for _ in [0] if name in low] or [t for t in low if t in group]
                out[table, name] = low[first[0]] if first else min(common.get(name, [name]))
        return out

    def fields(self, targets: dict[str, str]) -> DataFrame:
        """(file_id, field_name, column) of every field of every file."""
        steps = stage(self.changes(), "drift-changes")
        nodes = stage(self.lines_of_descent(steps), "drift-descent")
        found = nodes.select("table_name", "field_name").distinct().limit(MAX_NAMES + 1).collect()
        if len(found) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} distinct fields")
        to = self.names(list(targets), {(r.table_name, r.field_name.lower()) for r in found}, steps)
        order = {t: i for i, t in enumerate(targets)}
        low = {t.lower(): t for t in targets}
        named = []
        for t, n in sorted((r.table_name, r.field_name) for r in found):
            own = low.get(n.lower()) if n.lower() in OWN.get(t, set(low)) else None
            column = own or to[t, n.lower()]
            named.append((t, n, 0 if own else 1, order.get(column, len(order)), column))
        table = self.cells.sparkSession.createDataFrame(named, "table_name string, field_name string, foreign int, nth int, column string")
        known = nodes.join(small(table), ["table_name", "field_name"])
        root = ["root_file", "root_name"]
        best = known.groupBy(*root).agg(F.min(F.struct("foreign", "nth", "column")).alias("best"))
        return known.select("file_id", "field_name", *root).join(best, root).select("file_id", "field_name", F.col("best.column").alias("column"))

    def columns(self, fields: DataFrame, targets: dict[str, str]) -> dict[str, str]:
        """column -> type of the columns of all files: the targets, then the others. At least half of a column's values in all files are of its type, else it is a string; a number is a bigint if all its numbers are."""
        sums = fields.join(self.types, ["file_id", "field_name"]).filter("column <> ''").groupBy("column").agg(*[F.sum(f"n_{k}").alias(k) for k in ("values", "bigint", "double", "boolean")])
        found = {r.column: r for r in sums.limit(MAX_COLUMNS + 1).collect()}
        if len(found) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} columns")
        types = {}
        for column in [*targets, *sorted(set(found) - set(targets))]:
            r = found.get(column)
            if r is None or not r["values"]:
                types[column] = targets.get(column, "string")
            else:
                types[column] = ("bigint" if r.bigint == r.double else "double") if 2 * r.double >= r["values"] else "boolean" if 2 * r.boolean >= r["values"] else "string"
        return types

    def typed(self, targets: dict[str, str], added: bool = False) -> DataFrame:
        """One row per data line: file_id, line_no, the target columns (added: those of all other fields too), failed_casts (column, field, value as it is) and other_values, the values that are in no column as they are.

        Of several fields of a file that lead to one column the one of its name, else the first by name counts.
        """
        fields = stage(self.fields(targets), "drift-columns")
        types = self.columns(fields, targets)
        types = types if added else {t: types[t] for t in targets}
        firsts = fields.filter(F.col("column").isin(list(types))).groupBy("file_id", "column").agg(F.min(F.struct(F.lower("field_name") != F.lower("column"), F.col("field_name") != F.col("column"), F.col("field_name").alias("n"))).alias("f"))
        held = firsts.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "f.n"))).alias("held"))
        rows = lookup(self.cells.filter("line_no > 0"), held, "file_id", self.hot, F.col("line_no"), "left")
        raw = {t: F.col("cells")[F.col("held")[t]] for t in types}
        cast = {t: cast_cell(raw[t], kind) for t, kind in types.items()}
        failed = F.array_compact(F.array(*[F.when(raw[t].isNotNull() & cast[t].isNull(), F.struct(F.lit(t).alias("column"), F.col("held")[t].alias("field_name"), raw[t].alias("value"))) for t in types]))
        kept = F.array_compact(F.array(*[F.when(cast[t].isNotNull(), F.col("held")[t]) for t in types]))
        rest = F.map_filter("cells", lambda k, v: v.isNotNull() & ~F.array_contains("_kept", k))
        out = lambda t: t if t not in ("file_id", "line_no", "failed_casts", "other_values") else f"{t}_value"
        return rows.withColumn("_kept", kept).select("file_id", "line_no", *[c.alias(out(t)) for t, c in cast.items()], failed.alias("failed_casts"), rest.alias("other_values"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, field_name, change_kind) of every change along the chains."""
    return Drift(spark, sf_dir).changes().select("file_id", "field_name", "change_kind")


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all files as one table with a typed column for every field of any file; other_values holds, as they are, values that do not cast and those of a second field of one column."""
    return Drift(spark, sf_dir).typed(TARGETS, added=True).drop("failed_casts")


def p6_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, file_id, line_no, column, field_name, value): every value that does not cast to its column's type, where it stands and as it is."""
    drift = Drift(spark, sf_dir)
    rows = drift.typed(TARGETS, added=True).select("file_id", "line_no", F.inline("failed_casts"))
    return rows.join(small(drift.files.select("file_id", "table_name")), "file_id").select("table_name", "file_id", "line_no", "column", "field_name", "value")


QUERIES = {"p6_found": p6_found, "p6_table": p6_table, "p6_failed_casts": p6_failed_casts}
_BLANKS_SQL = r"E' \t\r\n﻿'"
# A cell is a run of quoted parts and of characters that are neither quotes nor the delimiter.
_SPLIT_SQL = "CASE d " + " ".join(rf"""WHEN {q} THEN regexp_extract_all({{0}} || {q}, '((?:"[^"]*"|[^"{r}])*){e}', 1)""" for q, r, e in ((r"','", ",", ","), (r"';'", ";", ";"), (r"chr(9)", r"\t", r"\t"), (r"'|'", "|", r"\|"))) + " END"
_CLEAN_SQL = rf"""list_transform(list_transform({{0}}, lambda c: trim(c, {_BLANKS_SQL})), lambda c: CASE WHEN length(c) > 1 AND starts_with(c, '"') AND ends_with(c, '"') THEN trim(replace(substr(c, 2, length(c) - 2), '""', '"'), {_BLANKS_SQL}) ELSE c END)"""
_NUMBER_SQL = r"'^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$'"
_CELLS_SQL = rf"""WITH firsts AS (SELECT folder, table_name, seq_no, min(file_id) AS file_id, arg_min(delimiter, file_id) AS delimiter FROM result_files GROUP BY ALL),
chain AS (SELECT *, lag(file_id) OVER (PARTITION BY folder, table_name ORDER BY seq_no) AS prev FROM firsts),
heads AS (SELECT file_id, min(line_text) AS header FROM result_lines WHERE line_no = 0 GROUP BY file_id),
known AS (SELECT file_id, prev, header, CASE WHEN length(delimiter) = 1 AND contains(header, delimiter) THEN delimiter ELSE list_sort([{", ".join(f"{{'n': length(header) - length(replace(header, {q}, '')), 'i': -{i}, 'd': {q}}}" for i, q in enumerate(("','", "';'", "chr(9)", "'|'")))}], 'DESC')[1].d END AS d FROM chain JOIN heads USING (file_id) WHERE header IS NOT NULL),
named AS (SELECT *, {_CLEAN_SQL.format(_SPLIT_SQL.format("header"))} AS names FROM known),
long AS (SELECT file_id, line_no, names[i] AS field_name, i, CASE WHEN lower(cells[i]) NOT IN ('', 'na', 'null', 'nan') THEN cells[i] END AS value FROM (SELECT file_id, line_no, names, {_CLEAN_SQL.format(_SPLIT_SQL.format("line_text"))} AS cells, unnest(range(1, len(names) + 1)) AS i FROM named JOIN result_lines USING (file_id) WHERE regexp_matches(line_text, '[^ \t\r\n]'))),
cells AS (SELECT file_id, line_no, field_name, min(i) AS position, arg_min(coalesce(value, '-'), i) AS v, CASE WHEN arg_min(value IS NULL, i) THEN NULL ELSE arg_min(coalesce(value, ''), i) END AS value FROM long GROUP BY ALL),
types AS (SELECT file_id, field_name, min(position) AS position, CASE WHEN bool_and(value IS NULL OR line_no = 0 OR regexp_matches(value, '^[+-]?[0-9]+$')) THEN 'bigint' WHEN bool_and(value IS NULL OR line_no = 0 OR regexp_matches(value, {_NUMBER_SQL})) THEN 'double' WHEN bool_and(value IS NULL OR line_no = 0 OR lower(value) IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS type FROM cells GROUP BY ALL),
step AS (SELECT file_id, prev FROM chain WHERE prev IS NOT NULL),
now AS (SELECT s.file_id, field_name, type, position FROM step s JOIN types t ON t.file_id = s.file_id),
before AS (SELECT s.file_id, field_name, type, position FROM step s JOIN types t ON t.file_id = s.prev),
gone AS (SELECT * FROM before ANTI JOIN now USING (file_id, field_name)),
fresh AS (SELECT * FROM now ANTI JOIN before USING (file_id, field_name)),
comparable AS (SELECT file_id AS own, line_no, field_name, CASE WHEN value IS NULL THEN '-' WHEN regexp_matches(value, {_NUMBER_SQL}) THEN 'n' || CAST(CAST(value AS DOUBLE) + 0.0 AS VARCHAR) ELSE 't' || value END AS c FROM cells WHERE line_no > 0),
runs AS (SELECT own, line_no, c AS run FROM comparable WHERE field_name = 'run_id' AND c <> '-'),
both_runs AS (SELECT DISTINCT s.file_id, a.run FROM step s JOIN runs a ON a.own = s.file_id JOIN runs b ON b.own = s.prev AND b.run = a.run),
old_signs AS (SELECT g.file_id, g.field_name, g.position, list(DISTINCT r.run || '=' || c.c ORDER BY r.run || '=' || c.c) AS signs FROM gone g JOIN step s USING (file_id) JOIN comparable c ON c.own = s.prev AND c.field_name = g.field_name JOIN runs r ON r.own = c.own AND r.line_no = c.line_no JOIN both_runs b ON b.file_id = g.file_id AND b.run = r.run GROUP BY ALL),
new_signs AS (SELECT g.file_id, g.field_name, g.position, list(DISTINCT r.run || '=' || c.c ORDER BY r.run || '=' || c.c) AS signs FROM fresh g JOIN comparable c ON c.own = g.file_id AND c.field_name = g.field_name JOIN runs r ON r.own = c.own AND r.line_no = c.line_no JOIN both_runs b ON b.file_id = g.file_id AND b.run = r.run GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id, signs ORDER BY position, field_name) AS nth FROM old_signs), n AS (SELECT *, row_number() OVER (PARTITION BY file_id, signs ORDER BY position, field_name) AS nth FROM new_signs),
renames AS (SELECT n.file_id, n.field_name, o.field_name AS old_name FROM o JOIN n USING (file_id, signs, nth)),
"""
ORACLES: dict[str, str] = {
    "p6_found": _CELLS_SQL
    + """retyped AS (SELECT file_id, field_name FROM now JOIN before USING (file_id, field_name) WHERE now.type <> before.type UNION ALL SELECT r.file_id, r.field_name FROM renames r JOIN now ON now.file_id = r.file_id AND now.field_name = r.field_name JOIN before ON before.file_id = r.file_id AND before.field_name = r.old_name WHERE now.type <> before.type)
SELECT file_id, field_name, 'renamed' AS change_kind FROM renames UNION ALL SELECT file_id, field_name, 'retyped' FROM retyped
UNION ALL SELECT g.file_id, g.field_name, 'removed' FROM gone g ANTI JOIN renames r ON r.file_id = g.file_id AND r.old_name = g.field_name UNION ALL SELECT g.file_id, g.field_name, 'added' FROM fresh g ANTI JOIN renames r USING (file_id, field_name)"""
}
