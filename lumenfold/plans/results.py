"""Queries on the result tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.stats import half_up, half_up_sql
from lumenfold.operators import results as op
from lumenfold.session import stage_path
from lumenfold.sources import results as src

DATASETS = ["cifar100", "cub200", "tiny_imagenet"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = half_up_sql(sql)
        return f

    return add


_METHODS = "WITH " + src.FINAL_SQL + ", methods AS (SELECT backbone, dataset, method, category, round(max(accuracy), 3) AS accuracy, round(min(time_total), 2) AS time_total FROM finals WHERE status = 'OK' AND category IS NOT NULL GROUP BY ALL) "


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best accuracy of each method and category in each configuration of all_results."""
    ok = src.final_results(spark, sf_dir).filter("status = 'OK' AND category IS NOT NULL")
    return ok.groupBy("backbone", "dataset", "method", "category").agg(half_up(F.max("accuracy"), 3).alias("accuracy"), half_up(F.min("time_total"), 2).alias("time_total"))


@query(_METHODS + "SELECT backbone, dataset, method, category, accuracy, CAST(row_number() OVER (PARTITION BY backbone, dataset ORDER BY accuracy DESC NULLS LAST, method || '/' || category) AS INTEGER) AS rank_no FROM methods")
def rank_methods(spark, sf_dir):
    rows = _methods(spark, sf_dir).drop("time_total").withColumn("tie", F.concat_ws("/", "method", "category"))
    return op.rank_methods(rows, tie="tie").drop("tie")


@query(_METHODS + "SELECT backbone, dataset, category, method, accuracy FROM methods QUALIFY row_number() OVER (PARTITION BY backbone, dataset, category ORDER BY accuracy DESC NULLS LAST, method) = 1")
def best_per_category(spark, sf_dir):
    return op.best_per(_methods(spark, sf_dir).drop("time_total"), ["backbone", "dataset", "category"])


@query(_METHODS + "SELECT backbone, dataset, method, accuracy FROM methods WHERE accuracy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY backbone, dataset ORDER BY accuracy DESC, method) = 1")
def idxmax_per_group(spark, sf_dir):
    return op.argmax(_methods(spark, sf_dir), op.CONFIG, "accuracy", "method")


_CELLS = "WITH " + src.CELLS_SQL
_MEANS = _CELLS + ", means AS (SELECT backbone, dataset, method, round(avg(accuracy), 3) AS accuracy, round(avg(time_total), 2) AS time_total FROM cells GROUP BY ALL) "


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.cells(spark, sf_dir).groupBy("backbone", "dataset", "method").agg(half_up(F.avg("accuracy"), 3).alias("accuracy"), half_up(F.avg("time_total"), 2).alias("time_total"))


@query("WITH " + src.RUNS_SQL + " SELECT backbone, dataset, method, seed, count(*) AS runs, round(avg(accuracy), 6) AS mean_accuracy, round(coalesce(stddev_samp(accuracy), 0), 6) AS std_sample, round(stddev_pop(accuracy), 6) AS std_population FROM runs WHERE status = 'OK' GROUP BY ALL")
def seed_statistics(spark, sf_dir):
    """Mean and both deviations over the runs of a seed."""
    ok = src.seeded_runs(spark, sf_dir).filter("status = 'OK'")
    return ok.groupBy("backbone", "dataset", "method", "seed").agg(F.count(F.lit(1)).alias("runs"), half_up(F.avg("accuracy"), 6).alias("mean_accuracy"), half_up(F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)), 6).alias("std_sample"), half_up(F.stddev_pop("accuracy"), 6).alias("std_population"))


@query(_MEANS + "SELECT backbone, dataset, method, accuracy, round(accuracy - max(accuracy) FILTER (method = 'LDA') OVER w, 6) AS gain_lda, round(accuracy - max(accuracy) FILTER (method = 'FULL') OVER w, 6) AS gain_full FROM means WINDOW w AS (PARTITION BY backbone, dataset)")
def gain_over_baseline(spark, sf_dir):
    both = op.with_baseline(op.with_baseline(_means(spark, sf_dir), "LDA"), "FULL")
    return both.select("backbone", "dataset", "method", "accuracy", half_up(F.col("accuracy") - F.col("lda_accuracy"), 6).alias("gain_lda"), half_up(F.col("accuracy") - F.col("full_accuracy"), 6).alias("gain_full"))


@query(_MEANS + ", g AS (SELECT backbone, dataset, max(accuracy) FILTER (method = 'LDA') - max(accuracy) FILTER (method = 'FULL') AS gain FROM means GROUP BY ALL) SELECT backbone, " + ", ".join(f"round(coalesce(max(gain) FILTER (dataset = '{d}'), 0), 6) AS {d}" for d in DATASETS) + " FROM g GROUP BY backbone")
def gain_pivot(spark, sf_dir):
    return op.gain_pivot(_means(spark, sf_dir), "LDA", "FULL", DATASETS)


@query(_MEANS + ", g AS (SELECT method, accuracy - max(accuracy) FILTER (method = 'FULL') OVER (PARTITION BY backbone, dataset) AS gain FROM means) SELECT method, count(gain) AS configs, round(min(gain), 6) AS min_gain, round(max(gain), 6) AS max_gain, round(avg(gain), 6) AS mean_gain, count(*) FILTER (gain > 0) AS helps_in, round(greatest(abs(min(gain)), abs(max(gain))), 6) AS color_limit FROM g GROUP BY method")
def gain_summary(spark, sf_dir):
    g = op.with_baseline(_means(spark, sf_dir), "FULL").withColumn("gain", F.col("accuracy") - F.col("full_accuracy"))
    return g.groupBy("method").agg(F.count("gain").alias("configs"), half_up(F.min("gain"), 6).alias("min_gain"), half_up(F.max("gain"), 6).alias("max_gain"), half_up(F.avg("gain"), 6).alias("mean_gain"), F.count_if(F.col("gain") > 0).alias("helps_in"), half_up(F.greatest(F.abs(F.min("gain")), F.abs(F.max("gain"))), 6).alias("color_limit"))


_PAIRS = _CELLS + """, pairs AS (SELECT m.backbone, m.dataset, m.method, m.seed, m.accuracy, m.time_total, b.accuracy AS base, b.time_total AS base_time, m.accuracy - b.accuracy AS d FROM cells m JOIN cells b USING (backbone, dataset, seed) WHERE m.method <> 'LDA' AND b.method = 'LDA' QUALIFY count(*) OVER (PARTITION BY m.backbone, m.dataset, m.method) = 5),
t0 AS (SELECT backbone, dataset, method, avg(d) AS mean_diff, CASE WHEN max(d) = min(d) THEN CASE WHEN avg(d) > 0 THEN 'inf'::DOUBLE WHEN avg(d) < 0 THEN '-inf'::DOUBLE END ELSE avg(d) / (stddev_samp(d) / sqrt(5)) END AS t_stat FROM pairs GROUP BY ALL),
t AS (SELECT *, CASE WHEN isinf(t_stat) THEN 0 ELSE 2 * (0.5 - 0.375 * (abs(t_stat) / sqrt(1 + t_stat * t_stat / 4)) * (1 - t_stat * t_stat / (12 * (1 + t_stat * t_stat / 4)))) END AS p_ttest FROM t0),
ranked AS (SELECT *, rank() OVER (PARTITION BY backbone, dataset, method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY backbone, dataset, method, abs(d)) - 1) / 2 AS r FROM pairs WHERE d <> 0),
sums AS (SELECT backbone, dataset, method, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS minus, list(r ORDER BY r) AS ranks FROM ranked GROUP BY ALL),
signs AS (SELECT backbone, dataset, method, least(plus, minus) AS w_stat, least(1.0, 2.0 * len(list_filter(range(CAST(pow(2, len(ranks)) AS BIGINT)), lambda s: list_sum(list_transform(range(1, len(ranks) + 1), lambda i: ranks[i] * ((s >> (i - 1)) & 1))) <= least(plus, minus) + 1e-9)) / pow(2, len(ranks))) AS p_wilcoxon FROM sums),
w AS (SELECT backbone, dataset, method, coalesce(w_stat, 0) AS w_stat, coalesce(p_wilcoxon, 1) AS p_wilcoxon FROM (SELECT DISTINCT backbone, dataset, method FROM pairs) LEFT JOIN signs USING (backbone, dataset, method)) """


def _pairs(spark, sf_dir):
    return op.seed_pairs(src.cells(spark, sf_dir))


@query(_PAIRS + "SELECT backbone, dataset, method, round(mean_diff, 6) AS mean_diff, round(t_stat, 4) AS t_stat, round(p_ttest, 6) AS p_ttest FROM t")
def paired_ttest(spark, sf_dir):
    return op.ttest(_pairs(spark, sf_dir)).select("backbone", "dataset", "method", half_up("mean_diff", 6).alias("mean_diff"), half_up("t_stat", 4).alias("t_stat"), half_up("p_ttest", 6).alias("p_ttest"))


@query(_PAIRS + "SELECT backbone, dataset, method, round(w_stat, 4) AS w_stat, round(p_wilcoxon, 6) AS p_wilcoxon FROM w")
def wilcoxon_signed_rank(spark, sf_dir):
    return op.signed_rank(_pairs(spark, sf_dir)).select("backbone", "dataset", "method", half_up("w_stat", 4).alias("w_stat"), half_up("p_wilcoxon", 6).alias("p_wilcoxon"))


@query(_PAIRS + """SELECT backbone, dataset, method, method_mean, method_std, lda_mean, lda_std, round(mean_diff, 3) AS mean_diff, round(t_stat, 4) AS t_stat, round(p_ttest, 6) AS p_ttest, round(w_stat, 4) AS w_stat, round(p_wilcoxon, 6) AS p_wilcoxon, p_ttest < 0.05 AS significant_005, p_ttest < 0.01 AS significant_001, time_ratio_vs_lda
FROM (SELECT backbone, dataset, method, round(avg(accuracy), 3) AS method_mean, round(stddev_pop(accuracy), 3) AS method_std, round(avg(base), 3) AS lda_mean, round(stddev_pop(base), 3) AS lda_std, round(avg(time_total) / greatest(avg(base_time), 0.1), 2) AS time_ratio_vs_lda FROM pairs GROUP BY ALL) JOIN t USING (backbone, dataset, method) JOIN w USING (backbone, dataset, method)""")
def significance_report(spark, sf_dir):
    return op.significance(src.cells(spark, sf_dir))


@query(_PAIRS + "SELECT backbone, dataset, method, CASE WHEN p_ttest < 0.01 THEN '***' WHEN p_ttest < 0.05 THEN '**' ELSE 'ns' END AS stars FROM t")
def significance_stars(spark, sf_dir):
    return op.ttest(_pairs(spark, sf_dir)).select("backbone", "dataset", "method", op.stars(F.col("p_ttest")).alias("stars"))


@query(_MEANS + "SELECT backbone, dataset, method, CASE WHEN accuracy >= f AND method <> 'FULL' THEN 'above_full' WHEN accuracy >= l THEN 'above_lda' ELSE 'below' END AS standing FROM (SELECT *, max(accuracy) FILTER (method = 'FULL') OVER w AS f, max(accuracy) FILTER (method = 'LDA') OVER w AS l FROM means WINDOW w AS (PARTITION BY backbone, dataset))")
def label_icon(spark, sf_dir):
    both = op.with_baseline(op.with_baseline(_means(spark, sf_dir), "LDA"), "FULL")
    return both.select("backbone", "dataset", "method", op.standing(F.col("method"), F.col("accuracy"), F.col("full_accuracy"), F.col("lda_accuracy")).alias("standing"))


@query("SELECT bench_id, method, starts_with(method, 'LDA') AS is_lda, starts_with(method, 'Full') AS is_full, ends_with(method, '(FAILED)') AS is_failed FROM all_benchmarks WHERE starts_with(method, 'LDA') OR starts_with(method, 'Full')")
def prefix_filter(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/all_benchmarks.parquet").select("bench_id", "method")
    m = F.col("method")
    return rows.filter(m.startswith("LDA") | m.startswith("Full")).select("bench_id", "method", m.startswith("LDA").alias("is_lda"), m.startswith("Full").alias("is_full"), m.endswith("(FAILED)").alias("is_failed"))


_COSTS = _CELLS + ", costs AS (SELECT *, round(mean_accuracy / greatest(mean_time, 0.1), 3) AS efficiency FROM (SELECT backbone, dataset, method, round(avg(accuracy), 3) AS mean_accuracy, round(coalesce(stddev_samp(accuracy), 0), 3) AS std_accuracy, round(avg(time_total), 2) AS mean_time, round(coalesce(stddev_samp(time_total), 0), 2) AS std_time, CAST(round(avg(dim)) AS INTEGER) AS mean_dim, round(avg(time_reduce), 2) AS mean_time_reduce, round(avg(time_classify), 2) AS mean_time_classify FROM cells GROUP BY ALL)), flagged AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM costs o WHERE o.backbone = c.backbone AND o.dataset = c.dataset AND o.mean_accuracy >= c.mean_accuracy AND o.mean_time <= c.mean_time AND (o.mean_accuracy > c.mean_accuracy OR o.mean_time < c.mean_time)) AS is_pareto FROM costs c) "


@query(_COSTS + "SELECT * FROM flagged")
def cost_analysis(spark, sf_dir):
    return op.pareto(op.costs(src.cells(spark, sf_dir)))


@query(_COSTS + "SELECT backbone, dataset, method, mean_accuracy, mean_time FROM flagged WHERE is_pareto")
def pareto_pairwise(spark, sf_dir):
    return op.pareto_pairwise(op.costs(src.cells(spark, sf_dir)).select("backbone", "dataset", "method", "mean_accuracy", "mean_time"))


@query(_COSTS + "SELECT backbone, dataset, method, mean_accuracy, mean_time FROM (SELECT *, max(mean_accuracy) OVER (PARTITION BY backbone, dataset ORDER BY mean_time, mean_accuracy DESC, method ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM costs) WHERE b IS NULL OR mean_accuracy > b")
def pareto_frontier_sorted(spark, sf_dir):
    return op.frontier(op.costs(src.cells(spark, sf_dir)).select("backbone", "dataset", "method", "mean_accuracy", "mean_time"), op.CONFIG, "mean_accuracy", "mean_time")


@query(_COSTS + "SELECT method, round(avg(efficiency), 6) AS mean_efficiency, round(avg(mean_accuracy), 6) AS mean_accuracy, round(avg(mean_time), 6) AS mean_time, count(*) FILTER (is_pareto) AS pareto_in FROM flagged GROUP BY method ORDER BY mean_efficiency DESC, method")
def efficiency_ranking(spark, sf_dir):
    c = op.pareto(op.costs(src.cells(spark, sf_dir)))
    return c.groupBy("method").agg(half_up(F.avg("efficiency"), 6).alias("mean_efficiency"), half_up(F.avg("mean_accuracy"), 6).alias("mean_accuracy"), half_up(F.avg("mean_time"), 6).alias("mean_time"), F.count_if("is_pareto").alias("pareto_in")).orderBy(F.desc("mean_efficiency"), "method")


_UNION = "both_tables AS (SELECT 'all_benchmarks' AS origin, bench_id, backbone, dataset, method, accuracy, dim, NULL AS n_classes, NULL AS feature_dim, written_at FROM all_benchmarks UNION ALL SELECT 'cifar100_benchmark', bench_id, backbone, dataset, method, accuracy, dim, n_classes, feature_dim, written_at FROM cifar100_benchmark)"
_COLS = ["origin", "bench_id", "backbone", "dataset", "method", "accuracy", "dim", "n_classes", "feature_dim"]


@query(f"WITH {_UNION} SELECT {', '.join(_COLS)} FROM both_tables")
def concat_runs(spark, sf_dir):
    return src.consolidated(spark, sf_dir).select(*_COLS)


@query(f"WITH {_UNION} SELECT backbone, dataset, method, origin, bench_id, accuracy FROM both_tables QUALIFY row_number() OVER (PARTITION BY backbone, dataset, method ORDER BY written_at DESC NULLS LAST, origin DESC, bench_id DESC) = 1")
def dedupe_keep_last(spark, sf_dir):
    rows = src.consolidated(spark, sf_dir).select("written_at", "origin", "bench_id", "backbone", "dataset", "method", "accuracy")
    return op.keep_last(rows, ["backbone", "dataset", "method"], ["written_at", "origin", "bench_id"]).drop("written_at")


@query("WITH " + src.FINAL_SQL + " SELECT backbone, status, count(*) AS results, count(accuracy) AS with_figures, count(DISTINCT dataset) AS datasets FROM finals GROUP BY ALL")
def failed_runs_report(spark, sf_dir):
    return src.final_results(spark, sf_dir).groupBy("backbone", "status").agg(F.count(F.lit(1)).alias("results"), F.count("accuracy").alias("with_figures"), F.count_distinct("dataset").alias("datasets"))


@query("WITH " + src.RUNS_SQL + ", b AS (SELECT DISTINCT backbone FROM runs), d AS (SELECT DISTINCT dataset FROM runs), m AS (SELECT DISTINCT method FROM runs), s AS (SELECT DISTINCT seed FROM runs), n AS (SELECT backbone, dataset, method, seed, count(*) AS n FROM runs WHERE status = 'OK' GROUP BY ALL) SELECT backbone, dataset, method, seed, coalesce(n, 0) AS done FROM (SELECT * FROM b, d, m, s) LEFT JOIN n USING (backbone, dataset, method, seed)")
def config_grid(spark, sf_dir):
    """The grid of all registered names, with the runs done of each cell. The dimensions are registries of a few names each."""
    runs = src.seeded_runs(spark, sf_dir)
    names = ["backbone", "dataset", "method", "seed"]
    done = runs.filter("status = 'OK'").groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    grid = None
    for c in names:
        one = runs.select(c).distinct()
        grid = one if grid is None else grid.crossJoin(one)
    return grid.join(done, names, "left").select(*names, F.coalesce("n", F.lit(0)).alias("done"))


@query("WITH " + src.FINAL_SQL + ", c AS (SELECT backbone, dataset, method, avg(accuracy) FILTER (classifier = 'logreg') AS logreg, avg(accuracy) FILTER (classifier = 'mlp') AS mlp FROM finals WHERE status = 'OK' GROUP BY ALL) SELECT method, count(*) AS configs, round(avg(logreg), 6) AS logreg, round(avg(mlp), 6) AS mlp, round(min(mlp - logreg), 6) AS min_gain, round(max(mlp - logreg), 6) AS max_gain, count(*) FILTER (mlp > logreg) AS mlp_wins FROM c GROUP BY method")
def classifier_comparison(spark, sf_dir):
    """Mean accuracy of each method under both classifiers, and where the second wins."""
    ok = src.final_results(spark, sf_dir).filter("status = 'OK'")
    c = ok.groupBy("backbone", "dataset", "method").agg(*[F.avg(F.when(F.col("classifier") == n, F.col("accuracy"))).alias(n) for n in ("logreg", "mlp")])
    d = F.col("mlp") - F.col("logreg")
    return c.groupBy("method").agg(F.count(F.lit(1)).alias("configs"), half_up(F.avg("logreg"), 6).alias("logreg"), half_up(F.avg("mlp"), 6).alias("mlp"), half_up(F.min(d), 6).alias("min_gain"), half_up(F.max(d), 6).alias("max_gain"), F.count_if(d > 0).alias("mlp_wins"))


@query("SELECT CAST(bench_id AS BIGINT) AS bench_id, backbone, method, accuracy, dim FROM all_benchmarks WHERE accuracy IS NOT NULL AND NOT isnan(accuracy)")
def csv_roundtrip(spark, sf_dir):
    """Written as CSV and scanned again with an explicit schema."""
    from pyspark.sql import types as T

    path = stage_path(spark, "csv")
    src.write_csv(spark.read.parquet(f"{sf_dir}/all_benchmarks.parquet").select("bench_id", "backbone", "method", "accuracy", "dim"), path)
    schema = T.StructType([T.StructField("bench_id", T.LongType()), T.StructField("backbone", T.StringType()), T.StructField("method", T.StringType()), T.StructField("accuracy", T.DoubleType()), T.StructField("dim", T.IntegerType())])
    return src.read_csv(spark, path, schema).filter(F.col("accuracy").isNotNull() & ~F.isnan("accuracy"))


@query("WITH " + src.FINAL_SQL + " SELECT backbone, classifier, count(*) AS results, round(avg(accuracy), 6) AS mean_accuracy FROM finals WHERE backbone IS NOT NULL AND classifier IS NOT NULL GROUP BY ALL")
def incremental_sink(spark, sf_dir):
    """Each configuration is written as its own partition; writing one again replaces it alone."""
    path = stage_path(spark, "runs")
    rows = src.final_results(spark, sf_dir).filter("backbone IS NOT NULL AND classifier IS NOT NULL").select("result_id", "backbone", "classifier", "accuracy")
    src.append_config(rows, path, ["backbone", "classifier"])
    src.append_config(rows.filter("backbone = 'resnet18'"), path, ["backbone", "classifier"])
    return spark.read.schema(rows.schema).parquet(path).groupBy("backbone", "classifier").agg(F.count(F.lit(1)).alias("results"), half_up(F.avg("accuracy"), 6).alias("mean_accuracy"))


@query(_MEANS + "SELECT b.backbone, d.dataset, m.method, round(coalesce(x.accuracy - f.accuracy, 0), 6) AS gain FROM (SELECT DISTINCT backbone FROM means) b, (SELECT DISTINCT dataset FROM means) d, (SELECT unnest(['LDA', 'DSB', 'PCA']) AS method) m LEFT JOIN means x ON x.backbone = b.backbone AND x.dataset = d.dataset AND x.method = m.method LEFT JOIN means f ON f.backbone = b.backbone AND f.dataset = d.dataset AND f.method = 'FULL'")
def figure_gain(spark, sf_dir):
    """Accuracy gain over Full of three methods; missing configurations gain 0."""
    means = op.with_baseline(_means(spark, sf_dir), "FULL")
    grid = means.select("backbone").distinct().crossJoin(means.select("dataset").distinct()).crossJoin(spark.createDataFrame([("LDA",), ("DSB",), ("PCA",)], "method string"))
    return grid.join(means, ["backbone", "dataset", "method"], "left").select("backbone", "dataset", "method", half_up(F.coalesce(F.col("accuracy") - F.col("full_accuracy"), F.lit(0.0)), 6).alias("gain"))


@query(_MEANS + ", p AS (SELECT dataset, method, round(avg(accuracy), 6) AS accuracy, round(avg(time_total), 6) AS time_total FROM means GROUP BY ALL) SELECT *, coalesce(accuracy > max(accuracy) OVER (PARTITION BY dataset ORDER BY time_total, accuracy DESC, method ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS on_frontier FROM p")
def figure_pareto(spark, sf_dir):
    """Accuracy against time, averaged over backbones, and the frontier."""
    p = _means(spark, sf_dir).groupBy("dataset", "method").agg(half_up(F.avg("accuracy"), 6).alias("accuracy"), half_up(F.avg("time_total"), 6).alias("time_total"))
    before = F.max("accuracy").over(Window.partitionBy("dataset").orderBy(F.col("time_total"), F.desc("accuracy"), F.col("method")).rowsBetween(Window.unboundedPreceding, -1))
    return p.withColumn("on_frontier", F.coalesce(F.col("accuracy") > before, F.lit(True)))


@query(_MEANS + ", g AS (SELECT backbone, dataset, max(accuracy) FILTER (method = 'LDA') - max(accuracy) FILTER (method = 'FULL') AS gain FROM means GROUP BY ALL) SELECT backbone, dataset, round(gain, 6) AS gain, abs(gain) > 0.6 * max(abs(gain)) OVER () AS light_text FROM g")
def figure_heatmap(spark, sf_dir):
    """LDA less Full of each configuration, and whether its text is light on the colour scale."""
    g = _means(spark, sf_dir).groupBy("backbone", "dataset").agg((F.max(F.when(F.col("method") == "LDA", F.col("accuracy"))) - F.max(F.when(F.col("method") == "FULL", F.col("accuracy")))).alias("gain"))
    limit = F.max(F.abs("gain")).over(Window.partitionBy())  # one row per configuration
    return g.select("backbone", "dataset", half_up("gain", 6).alias("gain"), (F.abs("gain") > 0.6 * limit).alias("light_text"))


_BAND = "round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS deviation, round(avg(accuracy) - stddev_pop(accuracy), 6) AS low, round(avg(accuracy) + stddev_pop(accuracy), 6) AS high, count(*) AS runs"


@query("WITH " + src.FINAL_SQL + ", ok AS (SELECT *, regexp_replace(dataset, '_s.*$', '') AS base FROM finals WHERE status = 'OK' AND dim IS NOT NULL), line AS (SELECT backbone, base, round(avg(accuracy), 6) AS full_accuracy FROM ok WHERE method = 'FULL' GROUP BY ALL), c AS (SELECT backbone, base, method, dim, " + _BAND + " FROM ok WHERE method IN ('LDA', 'PCA') GROUP BY ALL) SELECT c.*, full_accuracy FROM c LEFT JOIN line ON c.backbone IS NOT DISTINCT FROM line.backbone AND c.base IS NOT DISTINCT FROM line.base")
def figure_sweep(spark, sf_dir):
    """Curves of LDA and PCA over the number of dimensions with a band of one deviation, and the line of Full."""
    ok = src.final_results(spark, sf_dir).filter("status = 'OK' AND dim IS NOT NULL").withColumn("base", F.regexp_replace("dataset", "_s.*$", ""))
    curves = op.band(ok.filter(F.col("method").isin("LDA", "PCA")), ["backbone", "base", "method", "dim"], "accuracy")
    line = ok.filter("method = 'FULL'").groupBy(F.col("backbone").alias("_b"), F.col("base").alias("_d")).agg(half_up(F.avg("accuracy"), 6).alias("full_accuracy"))
    return curves.join(line, F.col("backbone").eqNullSafe(F.col("_b")) & F.col("base").eqNullSafe(F.col("_d")), "left").drop("_b", "_d")


@query("WITH " + src.RUNS_SQL + " SELECT backbone, dataset, method, seed % 4 AS step, " + _BAND + " FROM runs WHERE status = 'OK' AND method IN ('FULL', 'PCA', 'LDA', 'DSB', 'RDA') GROUP BY ALL")
def figure_efficiency(spark, sf_dir):
    """Curves of five methods with a band of one deviation. The delivered runs have no fraction of the training rows; four groups of seeds stand in for it."""
    ok = src.seeded_runs(spark, sf_dir).filter("status = 'OK'").filter(F.col("method").isin("FULL", "PCA", "LDA", "DSB", "RDA"))
    return op.band(ok.withColumn("step", F.col("seed") % 4), ["backbone", "dataset", "method", "step"], "accuracy")


@query("WITH " + src.FINAL_SQL + ", ok AS (SELECT backbone, dataset, method, accuracy, time_total FROM finals WHERE status = 'OK' AND classifier = 'logreg' AND backbone IS NOT NULL AND time_total IS NOT NULL) SELECT backbone, dataset, method, max(accuracy) AS accuracy, arg_max(time_total, (accuracy, time_total)) AS time_total FROM ok GROUP BY ALL")
def csv_glob(spark, sf_dir):
    """CSV files of one classifier, found by a glob among others and a combined one, as a table with one row for each configuration and method."""
    from pyspark.sql import types as T

    path = stage_path(spark, "csv-glob")
    rows = src.final_results(spark, sf_dir).filter("status = 'OK' AND backbone IS NOT NULL AND time_total IS NOT NULL").select("backbone", "dataset", "method", "accuracy", "time_total", "classifier")
    for name, part in (("a_logreg", rows.filter("classifier = 'logreg'")), ("b_mlp", rows.filter("classifier = 'mlp'")), ("all_logreg", rows)):
        src.write_csv(part.drop("classifier").coalesce(1), f"{path}/{name}")
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in ("accuracy", "time_total") else T.StringType()) for c in ("backbone", "dataset", "method", "accuracy", "time_total")])
    return src.keyed_scan(spark, f"{path}/?_logreg", schema, ["backbone", "dataset", "method"])


@query("SELECT bench_id, method, printf('%.2f', accuracy) AS accuracy, printf('%.2f', time_total) AS time_total FROM all_benchmarks WHERE accuracy IS NOT NULL AND NOT isnan(accuracy) AND time_total IS NOT NULL AND NOT isnan(time_total)")
def row_append_sink(spark, sf_dir):
    """Rows appended in two goes to one headed CSV table, figures with two decimals."""
    from pyspark.sql import types as T

    path = stage_path(spark, "csv-rows")
    rows = spark.read.parquet(f"{sf_dir}/all_benchmarks.parquet").filter("accuracy IS NOT NULL AND NOT isnan(accuracy) AND time_total IS NOT NULL AND NOT isnan(time_total)").select("bench_id", "method", "accuracy", "time_total")
    for half in (0, 1):
        src.append_rows(rows.filter(F.col("bench_id") % 2 == half), path)
    return src.read_csv(spark, path, T.StructType([T.StructField("bench_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("method", "accuracy", "time_total")]]))


@query("WITH " + src.FINAL_SQL + " SELECT result_id, backbone, dataset, method, accuracy FROM finals WHERE status = 'OK' ORDER BY accuracy DESC, result_id LIMIT 10")
def best_results(spark, sf_dir):
    """The ten best results of all."""
    return src.final_results(spark, sf_dir).filter("status = 'OK'").orderBy(F.desc("accuracy"), "result_id").limit(10).select("result_id", "backbone", "dataset", "method", "accuracy")
