"""Lookups by a key of which a few values may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import parallelism, stage

#: A key is hot from one such share of a task's even part on; at most this many times the tasks can be.
HOT_PER_TASK = 2


def hot_keys(counts: DataFrame, key: str, n: str, tasks: int) -> DataFrame:
    """The keys of counts (one row per key) that hold more than an even task's half of all rows.

    There are at most HOT_PER_TASK * tasks of them whatever the data, so the list may be collected or broadcast.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) * F.lit(HOT_PER_TASK * tasks) > F.lit(int(total))).select(key)


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, salt: Column, how: str = "inner") -> DataFrame:
    """rows joined to table, which has one row per key (any type, structs compare their nulls as equal).

    Rows of a hot key are spread over salts and the table's row for it is repeated once per salt; other keys are joined as they are.
    hot: from hot_keys, at most twice as many rows as tasks, hence broadcast; None if no key can be hot. salt: any column that varies within a key.
    """
    if hot is None:
        return rows.join(table, key, how)
    spread = parallelism(rows.sparkSession)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(spread))).otherwise(0).cast("int")).drop("_hot")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), spread - 1).otherwise(0)))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hot_table(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """hot_keys as a table of its own, or None if no key is hot: at most HOT_PER_TASK rows a task."""
    spark = counts.sparkSession
    found = hot_keys(counts, key, n, parallelism(spark)).collect()
    return spark.createDataFrame(found, counts.select(key).schema) if found else None


def frequent(df: DataFrame, column: str, tasks: int, least: int = 1000) -> list[int]:
    """The values of a BIGINT column that hold more than an even task's half of the rows, without a shuffle by value.

    Blocks of rows report the values that hold a fraction s / 2 of them (s: the share sought). What a value holds in blocks that do
    not report it is below s / 2 of all rows, so the reported counts of a value with the share s add up to at least s / 2 of all
    rows; that is asked of the sums. At most 2 / s = 4 * tasks values pass. Values of fewer than least rows are never hot.
    """
    share = 1 / (HOT_PER_TASK * tasks) / 2

    def report(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def block():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count >= share * count.sum()
            return pa.RecordBatch.from_arrays([pa.array(np.append(value[keep], 0)), pa.array(np.append(count[keep], count.sum())), pa.array(np.append(np.zeros(keep.sum(), bool), True))], ["value", "n", "total"])

        for b in batches:
            held.append(b[0].drop_null().to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= 200_000:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    found = stage(df.select(column).mapInArrow(report, "value long, n long, total boolean").groupBy("total", "value").agg(F.sum("n").alias("n")), "frequent")
    rows = found.agg(F.sum(F.when(F.col("total"), F.col("n")))).first()[0] or 0
    return [r.value for r in found.filter(~F.col("total") & (F.col("n") >= max(least, share * rows))).collect()]


def small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows (it is counted), else df as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
