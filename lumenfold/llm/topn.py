"""The N best rows of every group by simultaneous bisection of per-group cutoffs.

The order of the rows is a code of 64-bit words that compare like the order columns followed by the identifier (better is
larger): one word for a number and its null, a word for every seven bytes of a string. Words that are the same in all rows are
passed over, and those of a string are taken from the rows only where a group still ties in what came before. A round cuts the
open interval of every group at FANOUT - 1 midpoints at once and counts the rows above each; rows surely inside are put aside,
rows surely outside are dropped, and only the rows of the interval that holds the cutoff go on. A group ends when an interval
edge leaves exactly N rows above it, or when at most END_ROWS rows are in its open interval, which are then put in order as
they are. Only counts are shuffled by group; the rows of a hot group are spread over salts.

Defined results: null keys form groups like any other; null order values come last, NaN as the largest number; rows equal in all
order columns and the identifier are interchangeable; a group of fewer than N rows is returned whole; a null N counts as 0.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenfold.functions.labels import dataset_label, label, last_version
from lumenfold.operators.skew import hot_keys, lookup
from lumenfold.session import parallelism, stage

#: Intervals that one round cuts the open interval of a group into.
FANOUT = 64
#: Rows of an open interval that a task puts in order at once.
END_ROWS = 1024
#: Bytes of a string in one word: 56 bits are never negative.
BYTES = 7
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@F.pandas_udf(T.LongType())
def _double_code(x: pd.Series) -> pd.Series:
    """Signed 64-bit code that compares like the number; the least long is left free."""
    x = x.to_numpy(np.float64, na_value=np.nan) + 0.0
    raw = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ np.int64(_MOST), raw))


def number_words(c: Column, kind: str, ascending: bool) -> list[Column]:
    """Word columns of a column that is no string."""
    turn = F.bitwise_not if ascending else (lambda w: w)
    if kind in ("double", "float"):
        return [F.when(c.isNull(), F.lit(_LEAST)).otherwise(turn(_double_code(c.cast("double"))))]
    n = F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(c).cast("long") if kind == "date" else c.cast("long")
    return [c.isNotNull().cast("long"), F.coalesce(turn(n), F.lit(0))]


def string_word(c: Column, i: int, ascending: bool) -> Column:
    """The i-th word of a string: seven bytes, filled up with zeros."""
    bytes_ = F.hex(F.substring(c.cast("binary"), BYTES * i + 1, BYTES))
    word = F.coalesce(F.conv(F.rpad(bytes_, 2 * BYTES, "0"), 16, 10).cast("long"), F.lit(0))
    return F.bitwise_not(word) if ascending else word


def _is_number(kind: str) -> bool:
    return kind in ("double", "float", "byte", "short", "integer", "long", "date", "timestamp", "boolean", "timestamp_ntz")


def _bucket(word: str, fanout: int) -> Column:
    """Number of the interval of [_lo, _hi] that a word is in. Spans of more than 62 bits are halved, so nothing overflows."""
    half = "(shiftright(_hi, 1) - shiftright(_lo, 1))"
    wide = f"({half} >= {1 << 61})"
    span, off = f"IF({wide}, {half}, _hi - _lo)", f"IF({wide}, shiftright({word}, 1) - shiftright(_lo, 1), {word} - _lo)"
    return F.expr(f"CAST({off} div ({span} div {fanout} + 1) AS INT)")


def select_top(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], n: Column, fanout: int = FANOUT, end_rows: int = END_ROWS) -> DataFrame:
    """The n best rows of each group, exactly n where the group has as many. order: (column, ascending), most important first. n: the same in all rows of a group."""
    spark = df.sparkSession
    kinds = [df.schema[c].dataType.typeName() for c, _ in order]
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))
    static: dict[int, list[Column]] = {i: number_words(F.col(c), k, asc) for i, ((c, asc), k) in enumerate(zip(order, kinds, strict=True)) if _is_number(k)}
    # The row itself travels as one struct, so its columns cannot clash with those of the bisection; strings are read from it when they are needed.
    rows = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("_row"), group.alias("_g"), F.coalesce(n.cast("long"), F.lit(0)).alias("_need"),
        *[w.alias(f"_w{i}_{j}") for i, words in static.items() for j, w in enumerate(words)],
    )
    active = stage(rows.filter("_need > 0"), "topn-rows")
    text = {i: F.col("_row")[c].cast("string") for i, (c, _) in enumerate(order) if i not in static}
    names = [c for c in active.columns if c.startswith("_w")]
    seen = active.agg(F.count(F.lit(1)), *[f(c) for c in names for f in (F.min, F.max)], *[f for t in text.values() for f in (F.coalesce(F.max(F.octet_length(t)), F.lit(0)), F.count(t))]).first()
    if not seen[0]:
        return active.select("_row.*")
    ends = dict(zip(names, zip(seen[1 : 1 + 2 * len(names) : 2], seen[2 : 2 + 2 * len(names) : 2], strict=True), strict=True))
    lengths = dict(zip(text, zip(seen[1 + 2 * len(names) :: 2], seen[2 + 2 * len(names) :: 2], strict=True), strict=True))

    def words() -> Iterator[tuple[Column, int, int]]:
        """(word, bounds) of every word that is not the same in all rows."""
        for i, (_, ascending) in enumerate(order):
            if i in static:
                yield from ((F.col(f"_w{i}_{j}"), *ends[f"_w{i}_{j}"]) for j in range(len(static[i])) if ends[f"_w{i}_{j}"][0] < ends[f"_w{i}_{j}"][1])
                continue
            longest, there = lengths[i]
            if there < seen[0]:
                yield text[i].isNotNull().cast("long"), 0, 1
            j = 0
            while j < -(-longest // BYTES):
                if j and j % 16 == 0:
                    # What all rows that are left begin with is passed over at once.
                    least, most = active.agg(F.min(text[i]), F.max(text[i])).first()
                    j = max(j, len(os.path.commonprefix([(least or "").encode(), (most or "").encode()])) // BYTES)
                yield string_word(text[i], j, ascending), -(1 << 56), 1 << 56
                j += 1
            if longest:
                # Only strings that differ in nothing but zeros at their end are left.
                size = F.coalesce(F.octet_length(text[i]).cast("long"), F.lit(0))
                yield (-size if ascending else size), -longest, longest

    salt, tasks, hot, first = F.xxhash64("_row"), parallelism(spark), None, True
    kept, short = [], []
    for word, low, high in words():
        # The bounds of all rows serve in a word's first round; each round then takes the least and the largest word really there.
        active = active.withColumns({"_word": word, "_lo": F.lit(low).cast("long"), "_hi": F.lit(high).cast("long")})
        while True:
            active = active.withColumn("_b", _bucket("_word", fanout))
            counts = active.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("c"), F.min("_word").alias("lo"), F.max("_word").alias("hi"), F.first("_need").alias("need"))
            upto = F.sum("c").over(Window.partitionBy("_g").orderBy(F.desc("_b")))  # at most fanout rows a group
            cut = counts.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy("_g"))}).withColumn("above", F.col("upto") - F.col("c"))
            # The interval in which the count passes the need; a group smaller than its need is cut below its lowest interval.
            cut = cut.filter("above < need AND (upto >= need OR upto = n)")
            cut = cut.selectExpr("_g", "_b AS cut_b", "lo", "hi", "need - above AS left", f"CASE WHEN upto <= need THEN 'whole' WHEN c <= {end_rows} THEN 'short' WHEN lo < hi THEN 'open' ELSE 'tied' END AS state", "n")
            if first:
                cut, first = stage(cut, "topn-cut"), False
                sized = hot_keys(cut, "_g", "n", tasks).collect()  # at most twice as many as tasks
                hot = spark.createDataFrame(sized, cut.select("_g").schema) if sized else None
            joined = lookup(active, cut.drop("n"), "_g", hot, salt).filter("_b >= cut_b").withColumn("_state", F.expr("IF(_b > cut_b, 'whole', state)"))
            joined = joined.withColumns({"_need": F.col("left"), "_lo": F.col("lo"), "_hi": F.col("hi")}).drop("left", "lo", "hi", "cut_b", "state", "_b")
            joined = stage(joined, "topn-round")
            kept.append(joined.filter("_state = 'whole'").select("_row"))
            short.append(joined.filter("_state = 'short'").select("_row", "_g", "_need"))
            active = joined.filter("_state IN ('open', 'tied')")
            states = {r[0] for r in active.select("_state").distinct().collect()}
            # Tied groups wait for the next word in an interval of one value.
            if "open" not in states:
                break
        if not states:
            break
        active = active.drop("_word", "_lo", "_hi", "_state")
    else:
        kept.append(_any_of(active.select("_row", "_g", "_need"), tasks))
    # At most end_rows rows of a group, in the same order as the code's.
    by = [F.col("_row")[c].asc_nulls_last() if asc else F.col("_row")[c].desc_nulls_last() for c, asc in order]
    if short:
        nth = F.row_number().over(Window.partitionBy("_g").orderBy(*by))
        kept.append(reduce(DataFrame.unionByName, short).withColumn("_nth", nth).filter("_nth <= _need").select("_row"))
    return reduce(DataFrame.unionByName, kept).select("_row.*")


def _any_of(rows: DataFrame, tasks: int) -> DataFrame:
    """_need of the rows of each group, all of which equal each other: whichever are met first in each of several parts of it."""
    rows = stage(rows.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(tasks))), "topn-tied")
    parts = rows.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("c"), F.first("_need").alias("need"))
    before = F.sum("c").over(Window.partitionBy("_g").orderBy("_s")) - F.col("c")  # at most as many parts as tasks
    quota = parts.select("_g", "_s", F.greatest(F.col("need") - before, F.lit(0)).alias("_quota"))
    nth = F.row_number().over(Window.partitionBy("_g", "_s").orderBy(F.lit(0)))
    return rows.join(quota, ["_g", "_s"]).withColumn("_nth", nth).filter("_nth <= _quota").select("_row")


def top_n(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], n: int | Column, fanout: int = FANOUT, end_rows: int = END_ROWS) -> DataFrame:
    """The n best rows of each group with their rank_no. order: (column, ascending), most important first; end it with an identifier."""
    rows = select_top(df, keys, order, n if isinstance(n, Column) else F.lit(n), fanout, end_rows)
    by = [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in order]
    # At most n rows of a group are left.
    return rows.withColumn("rank_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def ranked_results(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/all_results.parquet").select("result_id", "ingested_at", "backbone", "dataset", "method", "accuracy_mean", "time_total", "status")
    good = (F.upper(F.regexp_replace("status", r"^[ \t\r\n]+|[ \t\r\n]+$", "")) == "OK") & F.col("accuracy_mean").between(0, 100) & ~F.isnan("accuracy_mean")
    rows = last_version(raw, "result_id", "ingested_at").filter(good).select(label("backbone").alias("backbone"), dataset_label("dataset").alias("dataset"), "method", "accuracy_mean", "time_total", "result_id")
    rows = rows.withColumn("_time", F.when(~F.isnan("time_total"), F.col("time_total")))
    return top_n(rows, ["backbone", "dataset"], [("accuracy_mean", False), ("_time", True), ("method", True), ("result_id", True)], n).drop("_time")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(backbone, dataset, rank_no, result_id) of the best three rows of each (backbone, dataset)."""
    return ranked_results(spark, sf_dir, 3).select("backbone", "dataset", "rank_no", "result_id")


def p2_top_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of each (backbone, dataset) with the method and the figure they reached."""
    return ranked_results(spark, sf_dir, 10).select("backbone", "dataset", "rank_no", "result_id", "method", "accuracy_mean")


_RANKED = r"""
WITH last AS (SELECT * FROM all_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST) = 1),
good AS (SELECT lower(trim(backbone, E' \t\r\n')) AS backbone, regexp_replace(lower(trim(dataset, E' \t\r\n')), '^cifar(_s.*)?$', 'cifar100\1') AS dataset, method, accuracy_mean, CASE WHEN isnan(time_total) THEN NULL ELSE time_total END AS t, result_id
  FROM last WHERE upper(trim(status, E' \t\r\n')) = 'OK' AND accuracy_mean BETWEEN 0 AND 100),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY backbone, dataset ORDER BY accuracy_mean DESC, t ASC NULLS LAST, method ASC NULLS LAST, result_id) AS INTEGER) AS rank_no FROM good)
"""
QUERIES = {"p2_found": p2_found, "p2_top_methods": p2_top_methods}
ORACLES = {
    "p2_found": _RANKED + "SELECT backbone, dataset, rank_no, result_id FROM ranked WHERE rank_no <= 3",
    "p2_top_methods": _RANKED + "SELECT backbone, dataset, rank_no, result_id, method, accuracy_mean FROM ranked WHERE rank_no <= 10",
}
