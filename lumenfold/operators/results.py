"""Operators on result tables: ranking, gains, merges, paired tests, cost and Pareto membership, plot data.

Groups are configurations (backbone, dataset); a group holds one row per method (and seed), so windows over it are small. Every
order ends with a key that is unique in its group. Null figures rank last, and rows without a baseline get a null gain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.stats import half_up, paired_t, t_pvalue, wilcoxon

CONFIG = ["backbone", "dataset"]


def rank_methods(df: DataFrame, keys: list[str] = CONFIG, score: str = "accuracy", tie: str = "method") -> DataFrame:
    """df with rank_no: 1 for the best score of a group, ties by name."""
    return df.withColumn("rank_no", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), tie)))


def best_per(df: DataFrame, keys: list[str], score: str = "accuracy", tie: str = "method") -> DataFrame:
    """The best row of each group."""
    return rank_methods(df, keys, score, tie).filter("rank_no = 1").drop("rank_no")


def argmax(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """(keys..., name, score) of the row with the largest score, the first by name among equals; aggregated map-side."""
    best = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias("b"))
    return best.select(*keys, F.col("b.n").alias(name), (-F.col("b.s")).alias(score))


def with_baseline(df: DataFrame, baseline: str, keys: list[str] = CONFIG, score: str = "accuracy", name: str = "method", out: str | None = None) -> DataFrame:
    """df with the score of the baseline's row of the same group, as a conditional window: no join."""
    return df.withColumn(out or f"{baseline.lower()}_{score}", F.max(F.when(F.col(name) == baseline, F.col(score))).over(Window.partitionBy(*keys)))


def standing(method: Column, score: Column, full: Column, lda: Column) -> Column:
    """How a method stands: above_full (as good as Full or better, and not Full), above_lda, below."""
    return F.when((score >= full) & (method != "FULL"), "above_full").when(score >= lda, "above_lda").otherwise("below")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").otherwise("ns")


def gain_pivot(df: DataFrame, method: str, baseline: str, datasets: list[str]) -> DataFrame:
    """backbone by dataset: score of method less that of baseline; a missing configuration gains 0."""
    one = df.filter(F.col("method").isin(method, baseline)).groupBy(*CONFIG).agg((F.max(F.when(F.col("method") == method, F.col("accuracy"))) - F.max(F.when(F.col("method") == baseline, F.col("accuracy")))).alias("gain"))
    return one.groupBy("backbone").pivot("dataset", datasets).agg(F.first("gain")).select("backbone", *[half_up(F.coalesce(F.col(d), F.lit(0.0)), 6).alias(d) for d in datasets])


def seed_pairs(runs: DataFrame, baseline: str = "LDA", n_seeds: int = 5) -> DataFrame:
    """(backbone, dataset, method, seed, accuracy, base, d) of runs paired with the baseline's by seed; only configurations with n_seeds pairs."""
    own = Window.partitionBy(*CONFIG, "seed")  # the methods of one seed
    of = lambda c: F.max(F.when(F.col("method") == baseline, F.col(c))).over(own)
    pairs = runs.withColumns({"base": of("accuracy"), "base_time": of("time_total"), "_paired": F.max((F.col("method") == baseline).cast("int")).over(own)})
    pairs = pairs.filter((F.col("method") != baseline) & (F.col("_paired") == 1)).drop("_paired").withColumn("d", F.col("accuracy") - F.col("base"))
    return pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*CONFIG, "method"))).filter(F.col("_n") == n_seeds).drop("_n")


_KEYS = [*CONFIG, "method"]


def ttest(pairs: DataFrame) -> DataFrame:
    t, n = paired_t(F.col("d"))
    out = pairs.groupBy(*_KEYS).agg(F.avg("d").alias("mean_diff"), t.alias("t_stat"), n.alias("n"))
    return out.withColumn("p_ttest", t_pvalue(F.col("t_stat"), F.col("n")))


def signed_rank(pairs: DataFrame) -> DataFrame:
    """(…, w_stat, p_wilcoxon) of each method and configuration. The pairs of one are its seeds, hence few."""
    tested = pairs.groupBy(*_KEYS).agg(F.collect_list("d").alias("d")).withColumn("_t", wilcoxon("d"))
    return tested.select(*_KEYS, F.col("_t.w").alias("w_stat"), F.col("_t.p").alias("p_wilcoxon"))


def significance(runs: DataFrame, baseline: str = "LDA", n_seeds: int = 5) -> DataFrame:
    """Every method against the baseline in every configuration: means, population deviations, both tests, flags by the t-test, ratio of times. One aggregation of the pairs."""
    pairs = seed_pairs(runs, baseline, n_seeds)
    t, n = paired_t(F.col("d"))
    out = pairs.groupBy(*_KEYS).agg(
        half_up(F.avg("accuracy"), 3).alias("method_mean"), half_up(F.stddev_pop("accuracy"), 3).alias("method_std"), half_up(F.avg("base"), 3).alias("lda_mean"), half_up(F.stddev_pop("base"), 3).alias("lda_std"),
        half_up(F.avg("time_total") / F.greatest(F.avg("base_time"), F.lit(0.1)), 2).alias("time_ratio_vs_lda"), F.avg("d").alias("mean_diff"), t.alias("t_stat"), n.alias("n"), F.collect_list("d").alias("d"),
    )
    out = out.withColumns({"p_ttest": t_pvalue(F.col("t_stat"), F.col("n")), "_t": wilcoxon("d")}).withColumns({"w_stat": F.col("_t.w"), "p_wilcoxon": F.col("_t.p")})
    return out.select(*_KEYS, "method_mean", "method_std", "lda_mean", "lda_std", half_up("mean_diff", 3).alias("mean_diff"), half_up("t_stat", 4).alias("t_stat"), half_up("p_ttest", 6).alias("p_ttest"), half_up("w_stat", 4).alias("w_stat"), half_up("p_wilcoxon", 6).alias("p_wilcoxon"), (F.col("p_ttest") < 0.05).alias("significant_005"), (F.col("p_ttest") < 0.01).alias("significant_001"), "time_ratio_vs_lda")


def costs(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation of accuracy and time of each method in each configuration, and its efficiency."""
    out = runs.groupBy(*CONFIG, "method").agg(
        half_up(F.avg("accuracy"), 3).alias("mean_accuracy"), half_up(F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)), 3).alias("std_accuracy"), half_up(F.avg("time_total"), 2).alias("mean_time"), half_up(F.coalesce(F.stddev_samp("time_total"), F.lit(0.0)), 2).alias("std_time"),
        half_up(F.avg("dim")).cast("int").alias("mean_dim"), half_up(F.avg("time_reduce"), 2).alias("mean_time_reduce"), half_up(F.avg("time_classify"), 2).alias("mean_time_classify"),
    )
    return out.withColumn("efficiency", half_up(F.col("mean_accuracy") / F.greatest("mean_time", F.lit(0.1)), 3))


def pareto(df: DataFrame, keys: list[str] = CONFIG, score: str = "mean_accuracy", cost: str = "mean_time", name: str = "method") -> DataFrame:
    """df with is_pareto: no row of the group is as good in both figures and better in one.

    One sorted pass: a row is dominated if some cheaper row is at least as good, or one of equal cost is better.
    """
    group = Window.partitionBy(*keys)
    equal = F.max(score).over(Window.partitionBy(*keys, cost))
    # The best score of all strictly cheaper rows: that of the rows before, less those of equal cost, by the first row of each cost.
    first = F.row_number().over(Window.partitionBy(*keys, cost).orderBy(F.desc(score), name)) == 1
    before = F.max(score).over(group.orderBy(F.col(cost), F.desc(score), F.col(name)).rowsBetween(Window.unboundedPreceding, -1))
    ranked = df.withColumn("_cheaper", F.when(first, before)).withColumn("_equal", equal)
    cheaper = F.max("_cheaper").over(Window.partitionBy(*keys, cost))
    dominated = F.coalesce(cheaper >= F.col(score), F.lit(False)) | (F.col("_equal") > F.col(score))
    return ranked.withColumn("is_pareto", ~dominated).drop("_cheaper", "_equal")


def pareto_pairwise(df: DataFrame, keys: list[str] = CONFIG, score: str = "mean_accuracy", cost: str = "mean_time") -> DataFrame:
    """The rows that no other row of their group dominates, as an anti-join within the group."""
    other = df.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col(score).alias("o_score"), F.col(cost).alias("o_cost"))
    same = [F.col(k) == F.col(f"o_{k}") for k in keys]
    dominates = (F.col("o_score") >= F.col(score)) & (F.col("o_cost") <= F.col(cost)) & ((F.col("o_score") > F.col(score)) | (F.col("o_cost") < F.col(cost)))
    return df.join(other, [*same, dominates], "left_anti")


def frontier(df: DataFrame, keys: list[str], score: str, cost: str, name: str = "method") -> DataFrame:
    """The rows that are strictly better than every row before them in order of cost (ties: better first, then by name)."""
    before = F.max(score).over(Window.partitionBy(*keys).orderBy(F.col(cost), F.desc(score), F.col(name)).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(score) > F.col("_before"))).drop("_before")


def keep_last(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The last row by seq of each key, aggregated map-side."""
    rest = [c for c in df.columns if c not in keys and c not in seq]
    return df.groupBy(*keys).agg(F.max(F.struct(*seq, *rest)).alias("v")).select(*keys, "v.*").select(*df.columns)


def extremes(df: DataFrame, score: str, name: str, k: int, keys: list[str] | None = None) -> DataFrame:
    """The k rows with the largest and the k with the smallest score: (…, side, rank_no)."""
    keys = keys or []
    top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), name))
    low = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc(score), name))
    return df.withColumn("rank_no", top).filter(F.col("rank_no") <= k).withColumn("side", F.lit("top")).unionByName(df.withColumn("rank_no", low).filter(F.col("rank_no") <= k).withColumn("side", F.lit("bottom")))


def band(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys..., mean_<score>, deviation, low, high, runs): the points of a curve and a band of one population deviation."""
    mean, sd = F.avg(score), F.stddev_pop(score)
    return df.groupBy(*keys).agg(half_up(mean, 6).alias(f"mean_{score}"), half_up(sd, 6).alias("deviation"), half_up(mean - sd, 6).alias("low"), half_up(mean + sd, 6).alias("high"), F.count(F.lit(1)).alias("runs"))
