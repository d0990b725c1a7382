"""Percentiles per group from mergeable dyadic Count-sketches.

A value is encoded as an order-preserving 24-bit code (the top of its 32-bit float form, so two values share a code only if
they differ by less than 2**-15 of themselves). For every resolution j the code shifted right by j is counted: exactly where at
most 2**EXACT_BITS shifted codes exist, else in a Count-sketch of DEPTH signed rows of WIDTH counters. Sketches are linear: those of
parts, files or days are merged by addition, and a row with weight -1 deletes one with weight +1. A rank is inverted by
descending from the exact level, at each level into the child whose estimated count covers the rank.

Error: besides the width of a code, the returned value has a rank within eps * n of the asked one, with a probability of at least
0.995 for each value. eps is reported with it: DEVIATIONS root mean squares of a counter, its HEAVY heaviest apart, for each of the
levels descended. A row's estimate is farther off only if a heavy code collides with it (at most 1 in 32) or by Chebyshev (at most 1
in 36); the median of 7 rows needs 4 such rows, 0.0005 for each of 8 levels. eps does not depend on the size of the data.

Defined results: null values and NaN, infinite ones and those for which no group row exists are not counted; a null group is a
group; a group whose counts sum to 0 has null percentiles; an empty table has no groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.labels import last_version, method_label
from lumenfold.operators.skew import small
from lumenfold.session import parallelism, stage

CODE_BITS = 24
EXACT_BITS = 16
DEPTH = 7
WIDTH = 4096
#: Groups whose sketches a task holds before it hands them on (2.4 MB each).
HELD = 48
SEED = 20240607
#: Of the stated error: deviations of an estimate, and counters of a row that are left out of its second moment.
DEVIATIONS, HEAVY = 6, WIDTH // 32
QS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]

_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, size=(CODE_BITS, DEPTH, 2), dtype=np.uint64) | np.uint64(1)


def encode(values: np.ndarray) -> np.ndarray:
    """Order-preserving codes of finite doubles."""
    raw = (values.astype(np.float32) + np.float32(0)).view(np.uint32)
    code = np.where(raw >> np.uint32(31), ~raw, raw | np.uint32(1 << 31))
    return (code >> np.uint32(32 - CODE_BITS)).astype(np.uint64)


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of the values that share a code; 0 for what is too small to be a normal float."""
    code = ((codes.astype(np.uint64) << np.uint64(32 - CODE_BITS)) | np.uint64(1 << (31 - CODE_BITS))).astype(np.uint32)
    raw = np.where(code >> np.uint32(31), code ^ np.uint32(1 << 31), ~code)
    values = raw.astype(np.uint32).view(np.float32).astype(np.float64)
    return np.where(np.abs(values) < 2.0**-126, 0.0, values)


def _cells(codes: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of codes in a row of a level's sketch."""
    h = (codes + np.uint64(1)) * _MIX[level, row, 0]
    h ^= h >> np.uint64(31)
    h *= _MIX[level, row, 1]
    return ((h >> np.uint64(40)) % np.uint64(WIDTH)).astype(np.int64), 1 - 2 * ((h >> np.uint64(39)) & np.uint64(1)).astype(np.int64)


class DyadicSketch:
    """Counts of codes at every resolution. levels[j]: (DEPTH, WIDTH) for j < EXACT_LEVEL; exact: counts of code >> EXACT_LEVEL."""

    EXACT_LEVEL = CODE_BITS - EXACT_BITS

    def __init__(self, counters: np.ndarray | None = None):
        self.all = np.zeros(self.EXACT_LEVEL * DEPTH * WIDTH + (1 << EXACT_BITS), np.int64) if counters is None else counters
        self.levels = self.all[: self.EXACT_LEVEL * DEPTH * WIDTH].reshape(self.EXACT_LEVEL, DEPTH, WIDTH)
        self.exact = self.all[self.EXACT_LEVEL * DEPTH * WIDTH :]

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        codes, where = np.unique(codes, return_inverse=True)
        weights = np.bincount(where, weights, len(codes))
        for j in range(self.EXACT_LEVEL):
            if j:
                codes, where = np.unique(codes >> np.uint64(1), return_inverse=True)
                weights = np.bincount(where, weights, len(codes))
            for r in range(DEPTH):
                cell, sign = _cells(codes, j, r)
                self.levels[j, r] += np.bincount(cell, weights * sign, WIDTH).astype(np.int64)
        self.exact += np.bincount((codes >> np.uint64(1)).astype(np.int64), weights, 1 << EXACT_BITS).astype(np.int64)

    def estimate(self, level: int, codes: np.ndarray) -> np.ndarray:
        rows = []
        for r in range(DEPTH):
            cell, sign = _cells(codes, level, r)
            rows.append(self.levels[level, r, cell] * sign)
        return np.median(rows, axis=0)

    @property
    def n(self) -> int:
        return int(self.exact.sum())

    def eps(self) -> float:
        """Relative rank error that holds for each value with a probability of at least 0.995."""
        squares = np.sort(self.levels.astype(np.float64) ** 2, axis=2)[:, :, : WIDTH - HEAVY]
        f2 = np.median(squares.sum(axis=2), axis=1)
        return min(1.0, DEVIATIONS * float(np.sqrt(f2 / WIDTH).sum()) / max(1, self.n))

    def quantiles(self, qs: list[float]) -> np.ndarray:
        """The values at the ranks ceil(q * n), at least 1."""
        upto = np.cumsum(np.maximum(self.exact, 0))
        rank = np.maximum(1.0, np.ceil(np.asarray(qs) * self.n - 1e-9))
        top = np.minimum(np.searchsorted(upto, rank), len(upto) - 1)
        rank = rank - np.where(top > 0, upto[np.maximum(top - 1, 0)], 0)
        code, size = top.astype(np.uint64), self.exact[top].astype(np.float64)
        for j in range(self.EXACT_LEVEL - 1, -1, -1):
            left, right = code << np.uint64(1), (code << np.uint64(1)) | np.uint64(1)
            # The children's estimates are made to sum to the parent's count, which halves the error that is carried down.
            a, b = self.estimate(j, left), self.estimate(j, right)
            a = np.clip((a + size - b) / 2, 0, size)
            go = rank > a
            code, rank, size = np.where(go, right, left), np.where(go, rank - a, rank), np.where(go, size - a, a)
        return decode(code)


def _pack(counters: np.ndarray) -> bytes:
    narrow = counters.astype(np.int32) if np.abs(counters).max(initial=0) < 1 << 31 else counters
    return bytes([narrow.itemsize]) + zlib.compress(narrow.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), np.int32 if blob[0] == 4 else np.int64).astype(np.int64)


def sketches(df: DataFrame, keys: list[str], metrics: list[str], weight: Column | None = None) -> DataFrame:
    """Partial sketches (keys..., metric, sketch BINARY), one for each group and metric that a task meets. weight: +1 or -1 of a row."""
    schema = df.select(*keys).schema
    n_keys = len(keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, DyadicSketch] = {}
        waiting: dict[tuple, list] = {}
        rows = 0

        def absorb() -> None:
            for key, parts in waiting.items():
                held.setdefault(key, DyadicSketch()).add(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            waiting.clear()

        def hand_on() -> pa.RecordBatch:
            out = list(held.items())
            held.clear()
            cols = [pa.array([k[i] for k, _ in out], type_) for i, type_ in enumerate(key_types)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([k[-1] for k, _ in out], pa.string()), pa.array([_pack(s.all) for _, s in out], pa.binary())], [*keys, "metric", "sketch"])

        key_types: list[pa.DataType] = []
        for b in batches:
            key_types = [b.schema.field(i).type for i in range(n_keys)]
            frame = b.to_pandas()
            for key, g in frame.groupby(list(frame.columns[:n_keys]), dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                for m in metrics:
                    x = g[m].to_numpy(np.float64, na_value=np.nan)
                    ok = np.isfinite(x) & (np.abs(x) < 3e38)
                    if ok.any():
                        waiting.setdefault((*key, m), []).append((encode(x[ok]), g["_weight"].to_numpy(np.float64)[ok]))
            rows += len(frame)
            if len(waiting) + len(held) > HELD or rows > 500_000:
                absorb()
                rows = 0
                if len(held) > HELD:
                    yield hand_on()
        absorb()
        if held:
            yield hand_on()

    chosen = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics], (F.lit(1) if weight is None else weight).cast("double").alias("_weight"))
    return chosen.mapInArrow(build, schema.add("metric", "string").add("sketch", "binary"))


def _add_up(keys: list[str]):
    def add_up(table: pa.Table) -> pa.Table:
        total = None
        for blob in table["sketch"]:
            part = _unpack(blob.as_py())
            total = part if total is None else total + part
        return pa.table({**{k: table[k][:1] for k in keys}, "sketch": pa.array([_pack(total)], pa.binary())})

    return add_up


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch for each group and metric. Many partial sketches of one group are added up in several tasks first."""
    keys = [*keys, "metric"]
    schema = parts.select(*keys, "sketch").schema
    spread = max(1, int(np.sqrt(parallelism(parts.sparkSession))))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("sketch"), F.lit(spread)))
    some = salted.groupBy(*keys, "_salt").applyInArrow(_add_up(keys), schema)
    return some.groupBy(*keys).applyInArrow(_add_up(keys), schema)


def percentiles(merged: DataFrame, keys: list[str], qs: list[float] = QS) -> DataFrame:
    """(keys..., metric, q, value, rank_error, n) of each merged sketch; rank_error is the relative rank error eps."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = DyadicSketch(_unpack(b["sketch"][i].as_py()))
                n = s.n
                values = pa.array(s.quantiles(qs) if n > 0 else [None] * len(qs), pa.float64())
                cols = [pa.array([b[k][i].as_py()] * len(qs), b[k].type) for k in [*keys, "metric"]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(qs), values, pa.array([s.eps()] * len(qs)), pa.array([n] * len(qs), pa.int64())], [*keys, "metric", "q", "value", "rank_error", "n"])

    return merged.mapInArrow(read, merged.select(*keys, "metric").schema.add("q", "double").add("value", "double").add("rank_error", "double").add("n", "long"))


METRICS = ["accuracy", "time_total"]


def counted(df: DataFrame) -> DataFrame:
    """Runs with method in its one form and figures outside their range (sentinels such as -1) as null; failed runs at exactly 0.0 stay in."""
    return df.withColumns({"method": method_label("method"), "accuracy": F.when(F.col("accuracy").between(0, 100), F.col("accuracy")), "time_total": F.when(F.col("time_total") >= 0, F.col("time_total"))})


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/multi_seed_results.parquet").select("run_id", "ingested_at", "method", "accuracy", "time_total", "run_at")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of accuracy and time_total of each method over the last ingested version of each run."""
    runs = counted(last_version(_runs(spark, sf_dir).drop("run_at"), "run_id", "ingested_at"))
    return percentiles(merge(sketches(runs, ["method"], METRICS), ["method"]), ["method"])


def p3_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each method and month of run_at; adding the months' sketches gives those of p3_percentiles."""
    runs = counted(last_version(_runs(spark, sf_dir), "run_id", "ingested_at")).withColumn("month", F.date_format("run_at", "yyyy-MM"))
    return percentiles(merge(sketches(runs, ["month", "method"], METRICS), ["month", "method"]), ["month", "method"])


def p3_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, metric, q, n, within): for each percentile, whether the rank of its value among all rows is within the stated error, a code's width apart. Months are sketched on their own, stored, and added up."""
    runs = stage(counted(last_version(_runs(spark, sf_dir), "run_id", "ingested_at")), "p3-runs")
    months = stage(merge(sketches(runs.withColumn("month", F.date_format("run_at", "yyyy-MM")), ["month", "method"], METRICS), ["month", "method"]), "p3-months")
    found = percentiles(merge(months.drop("month"), ["method"]), ["method"])
    # A row for each method, metric and percentile: the registry of methods, hence small.
    asked = found.select("method", "metric", F.explode(F.array(F.struct("q", "value", "rank_error", "n"))).alias("a")).select("method", "metric", "a.*")
    long = runs.select("method", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])))
    width = F.abs("value") * 2.0**-14
    ranks = long.filter("x IS NOT NULL AND NOT isnan(x) AND abs(x) < 3e38").join(small(asked), (long["method"].eqNullSafe(asked["method"])) & (long["metric"] == asked["metric"]))
    ranks = ranks.groupBy(asked["method"], asked["metric"], "q", "value", "rank_error", "n").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("x") < F.col("value") - width).alias("below"), F.count_if(F.col("x") <= F.col("value") + width).alias("upto"))
    within = (F.col("below") <= F.ceil(F.col("q") * F.col("rows")) + F.col("rank_error") * F.col("rows")) & (F.col("upto") >= F.ceil(F.col("q") * F.col("rows")) - F.col("rank_error") * F.col("rows")) & (F.col("rows") == F.col("n"))
    return ranks.select("method", "metric", "q", "n", within.alias("within"))


def p3_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_percentiles, but by deletion: all deliveries are counted, then every superseded one is taken out again."""
    runs = _runs(spark, sf_dir).drop("run_at")
    last = last_version(runs, "run_id", "ingested_at")
    everything = runs.filter(F.col("run_id").isNotNull()).withColumn("_sign", F.lit(1))
    # What was delivered less what is valid is to be deleted; as sketches are linear this is: all - (all - last), summed per run.
    repeated = everything.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run_id")
    again = everything.join(repeated, "run_id", "left_semi").withColumn("_sign", F.lit(-1))
    valid = last.join(repeated, "run_id", "left_semi").withColumn("_sign", F.lit(1))
    signed = counted(everything.unionByName(again).unionByName(valid))
    return percentiles(merge(sketches(signed, ["method"], METRICS, F.col("_sign")), ["method"]), ["method"])


QUERIES = {"p3_percentiles": p3_percentiles, "p3_checked": p3_checked, "p3_monthly": p3_monthly, "p3_corrected": p3_corrected}
_CHECKED = r"""
WITH last AS (SELECT * FROM multi_seed_results WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC NULLS LAST, method DESC NULLS LAST, accuracy DESC NULLS LAST, time_total DESC NULLS LAST) = 1),
runs AS (SELECT upper(trim(regexp_replace(method, '\([^)]*\)', '', 'g'), E' \t\r\n')) AS method, CASE WHEN accuracy BETWEEN 0 AND 100 THEN accuracy END AS accuracy, CASE WHEN time_total >= 0 THEN time_total END AS time_total FROM last),
long AS (SELECT method, 'accuracy' AS metric, accuracy AS x FROM runs UNION ALL SELECT method, 'time_total', time_total FROM runs)
SELECT method, metric, q, count(*) AS n, true AS within FROM long, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS q) WHERE isfinite(x) AND abs(x) < 3e38 GROUP BY ALL"""
ORACLES = {"p3_checked": _CHECKED}
