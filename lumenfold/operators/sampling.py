"""Samples that are the same in every engine: rows are ordered by the md5 of seed and id within their class.

A class of any size is cut by WindowGroupLimit before the shuffle where the size is fixed; fractions compare a row's rank with its
class count. Null classes are a class of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw_key(identity: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string")))


def stratified_sample(df: DataFrame, label: str, identity: str, seed: int, n: int) -> DataFrame:
    """n rows of each class without replacement (all of a smaller one)."""
    nth = F.row_number().over(Window.partitionBy(label).orderBy(draw_key(identity, seed), identity))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def split(df: DataFrame, label: str, identity: str, seed: int, train_share: float) -> DataFrame:
    """df with split: train for the first share of each class in drawing order, at least one row, else test."""
    nth = F.row_number().over(Window.partitionBy(label).orderBy(draw_key(identity, seed), identity))
    n = F.count(F.lit(1)).over(Window.partitionBy(label))
    return df.withColumn("split", F.when(nth <= F.greatest(F.lit(1), F.floor(n * train_share)), "train").otherwise("test"))


def permute(df: DataFrame, identity: str, seed: int) -> DataFrame:
    """df in the drawing order of a seed, as one range-partitioned sort."""
    return df.orderBy(draw_key(identity, seed), identity)


def positions(df: DataFrame, identity: str, seed: int) -> DataFrame:
    """df with position: the place (from 0) of each row in that order. Rows are numbered inside 4,096 ranges of the key, whose counts are summed up."""
    keyed = df.withColumn("_k", draw_key(identity, seed)).withColumn("_b", F.conv(F.left("_k", F.lit(3)), 16, 10).cast("int"))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("c"))  # at most 4,096 rows
    before = counts.select("_b", (F.sum("c").over(Window.orderBy("_b")) - F.col("c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_k", identity)) - 1
    return keyed.withColumn("_i", inside).join(F.broadcast(before), "_b").withColumn("position", F.col("_before") + F.col("_i")).drop("_k", "_b", "_i", "_before")


def per_class(fraction: float, n: int, classes: int) -> int:
    """Rows of each class that a fraction of n rows stands for, at least 2."""
    return max(2, int(fraction * n / classes))
