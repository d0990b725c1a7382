"""Result tables: clean views of the delivered ones, and typed CSV files.

Defined results: labels count trimmed and without regard to case; of rows with equal id the one ingested last counts; an
accuracy in (0, 1] is a share and becomes a percentage; accuracies that are then not in (0, 100] and times that are negative, NaN
or infinite are null; a run without an accuracy has the status FAILED.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.labels import dataset_label, label, last_version, method_label
from lumenfold.functions.stats import half_up

_KEYS = [("backbone", T.StringType()), ("dataset", T.StringType()), ("method", T.StringType())]
_TIMES = [(c, T.DoubleType()) for c in ("time_reduce", "time_classify", "time_total")]
_MEANS = [("accuracy_mean", T.DoubleType()), ("accuracy_std", T.DoubleType())]


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


#: Explicit schemas of the CSV result tables.
SCHEMAS = {
    "academic": _schema(*_KEYS, ("category", T.StringType()), ("accuracy", T.DoubleType()), ("dim", T.IntegerType()), *_TIMES),
    "extended": _schema(*_KEYS, ("category", T.StringType()), ("classifier", T.StringType()), *_MEANS, *[(c, T.IntegerType()) for c in ("dim", "feature_dim", "n_classes", "n_components")], *_TIMES, ("n_seeds", T.IntegerType()), ("status", T.StringType())),
    "mlp": _schema(*_KEYS, ("classifier", T.StringType()), *_MEANS, ("dim", T.IntegerType()), *_TIMES, ("n_seeds", T.IntegerType())),
    "multi_seed": _schema(*_KEYS, ("label", T.StringType()), ("seed", T.IntegerType()), ("accuracy", T.DoubleType()), ("dim", T.IntegerType()), *_TIMES),
    "component_sweep": _schema(("backbone", T.StringType()), ("method", T.StringType()), ("n_components", T.IntegerType()), ("seed", T.IntegerType()), ("accuracy", T.DoubleType()), ("time", T.DoubleType())),
    "data_efficiency": _schema(*_KEYS, ("fraction", T.DoubleType()), ("n_train_samples", T.IntegerType()), ("seed", T.IntegerType()), ("accuracy", T.DoubleType()), ("dim", T.IntegerType()), ("time_total", T.DoubleType())),
}


def percentage(c: str) -> Column:
    full = F.when((F.col(c) > 0) & (F.col(c) <= 1), F.col(c) * 100).otherwise(F.col(c))
    return F.when((full > 0) & (full <= 100), full)


def duration(c: str) -> Column:
    return F.when((F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c))


def seeded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """multi_seed_results as one clean row per run."""
    raw = spark.read.parquet(f"{sf_dir}/multi_seed_results.parquet").select("run_id", "ingested_at", "backbone", "dataset", "method", "seed", "accuracy", "dim", "time_reduce", "time_classify", "time_total")
    rows = last_version(raw, "run_id", "ingested_at")
    return rows.select(
        "run_id", label("backbone").alias("backbone"), dataset_label("dataset").alias("dataset"), method_label("method").alias("method"), "seed", percentage("accuracy").alias("accuracy"), "dim",
        *[duration(c).alias(c) for c in ("time_reduce", "time_classify", "time_total")], F.when(percentage("accuracy").isNotNull(), "OK").otherwise("FAILED").alias("status"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (backbone, dataset, method, seed): mean accuracy (3 decimals), time_total (2) and dim of its successful runs."""
    ok = seeded_runs(spark, sf_dir).filter("status = 'OK'")
    return ok.groupBy("backbone", "dataset", "method", "seed").agg(half_up(F.avg("accuracy"), 3).alias("accuracy"), half_up(F.avg("time_total"), 2).alias("time_total"), half_up(F.avg("time_reduce"), 2).alias("time_reduce"), half_up(F.avg("time_classify"), 2).alias("time_classify"), F.max("dim").alias("dim"))


def final_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all_results as one clean row per result, failed ones included."""
    cols = ["result_id", "ingested_at", "backbone", "dataset", "method", "category", "classifier", "accuracy_mean", "dim", "time_total", "status", "written_at"]
    rows = last_version(spark.read.parquet(f"{sf_dir}/all_results.parquet").select(*cols), "result_id", "ingested_at")
    status = F.when((F.upper(label("status")) == "OK") & percentage("accuracy_mean").isNotNull(), "OK").otherwise("FAILED")
    return rows.select("result_id", label("backbone").alias("backbone"), dataset_label("dataset").alias("dataset"), method_label("method").alias("method"), label("category").alias("category"), label("classifier").alias("classifier"), percentage("accuracy_mean").alias("accuracy"), "dim", duration("time_total").alias("time_total"), status.alias("status"), "written_at")


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all_benchmarks and cifar100_benchmark as one table; columns that one of them lacks are null. Spelling is kept."""
    a = spark.read.parquet(f"{sf_dir}/all_benchmarks.parquet").withColumn("origin", F.lit("all_benchmarks"))
    b = spark.read.parquet(f"{sf_dir}/cifar100_benchmark.parquet").withColumn("origin", F.lit("cifar100_benchmark"))
    return a.unionByName(b, allowMissingColumns=True)


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """Typed scan of headed CSV files; without a schema the types are inferred. Paths that match nothing give a warning and an empty table (of the schema, or without columns)."""
    from pyspark.errors import AnalysisException

    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    try:
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no files at {paths}", stacklevel=2)
        return spark.createDataFrame([], schema or T.StructType([]))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_rows(df: DataFrame, path: str, places: int = 2) -> None:
    """Row-append sink: adds headed CSV rows to what is there, fractions with a fixed number of decimals."""
    fixed = [F.format_string(f"%.{places}f", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema.fields]
    write_csv(df.select(*fixed), path, "append")


def append_config(df: DataFrame, path: str, keys: list[str]) -> None:
    """Crash-safe incremental sink: replaces only the partitions (configurations) that df holds, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def merge_scan(spark: SparkSession, pattern: str, schema: T.StructType, exclude: str) -> DataFrame:
    """All CSV files of a glob but those whose name contains exclude, with seq, which follows the files' names."""
    rows = read_csv(spark, pattern, schema).withColumn("seq", F.input_file_name())
    return rows.filter(~F.contains(F.regexp_extract("seq", r"[^/]*$", 0), F.lit(exclude)))


def keyed_scan(spark: SparkSession, pattern: str, schema: T.StructType, keys: list[str], exclude: str = "_all") -> DataFrame:
    """One row for each key of all CSV files of a glob: that of the last file by name, in it the largest."""
    rows = merge_scan(spark, pattern, schema, exclude)
    rest = [c for c in rows.columns if c not in keys and c != "seq"]
    last = rows.groupBy(*keys).agg(F.max(F.struct(F.regexp_extract("seq", r"[^/]*$", 0).alias("f"), *rest)).alias("v"))
    return last.select(*keys, *[F.col("v")[c].alias(c) for c in rest])


#: The same views in SQL, for the oracles.
_PCT = "CASE WHEN NOT isfinite({0}) THEN NULL WHEN {0} > 0 AND {0} <= 1 THEN {0} * 100 WHEN {0} > 0 AND {0} <= 100 THEN {0} END"
_DUR = "CASE WHEN isfinite({0}) AND {0} >= 0 THEN {0} END"
_LABEL = r"lower(trim({0}, E' \t\r\n'))"
_DATASET = r"regexp_replace(lower(trim({0}, E' \t\r\n')), '^cifar(_s.*)?$', 'cifar100\1')"
_METHOD = r"upper(trim(regexp_replace({0}, '\([^)]*\)', '', 'g'), E' \t\r\n'))"
RUNS_SQL = f"""runs AS (SELECT run_id, {_LABEL.format("backbone")} AS backbone, {_DATASET.format("dataset")} AS dataset, {_METHOD.format("method")} AS method, seed, {_PCT.format("accuracy")} AS accuracy, dim, {_DUR.format("time_reduce")} AS time_reduce, {_DUR.format("time_classify")} AS time_classify, {_DUR.format("time_total")} AS time_total,
  CASE WHEN {_PCT.format("accuracy")} IS NULL THEN 'FAILED' ELSE 'OK' END AS status
  FROM (SELECT * FROM multi_seed_results WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC NULLS LAST, backbone DESC NULLS LAST, dataset DESC NULLS LAST, method DESC NULLS LAST, seed DESC NULLS LAST, accuracy DESC NULLS LAST) = 1))"""
CELLS_SQL = RUNS_SQL + """, cells AS (SELECT backbone, dataset, method, seed, round(avg(accuracy), 3) AS accuracy, round(avg(time_total), 2) AS time_total, round(avg(time_reduce), 2) AS time_reduce, round(avg(time_classify), 2) AS time_classify, max(dim) AS dim FROM runs WHERE status = 'OK' GROUP BY ALL)"""
FINAL_SQL = f"""finals AS (SELECT result_id, {_LABEL.format("backbone")} AS backbone, {_DATASET.format("dataset")} AS dataset, {_METHOD.format("method")} AS method, {_LABEL.format("category")} AS category, {_LABEL.format("classifier")} AS classifier, {_PCT.format("accuracy_mean")} AS accuracy, dim, {_DUR.format("time_total")} AS time_total,
  CASE WHEN upper(trim(status, E' \\t\\r\\n')) = 'OK' AND {_PCT.format("accuracy_mean")} IS NOT NULL THEN 'OK' ELSE 'FAILED' END AS status, written_at
  FROM (SELECT * FROM all_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST, backbone DESC NULLS LAST, dataset DESC NULLS LAST, method DESC NULLS LAST, category DESC NULLS LAST, classifier DESC NULLS LAST, accuracy_mean DESC NULLS LAST) = 1))"""
