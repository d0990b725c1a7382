"""Test statistics as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs up to which the signed-rank distribution is exact.
EXACT_PAIRS = 50


def half_up(c: Column | str, places: int = 0) -> Column:
    """Rounded half away from zero; what lies within 1e-9 of a half counts as one, whatever the order in which a mean was summed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.signum(c) * 1e-9, places)


def half_up_sql(sql: str) -> str:
    """The same for every round(...) of a SQL text."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            comma = j if c == "," and depth == 1 else comma
            j += 1
        end = comma if comma >= 0 else j - 1
        inner = half_up_sql(sql[i + 6 : end])
        out += f"{sql[at:i]}round({inner} + 1e-9 * sign({inner}){sql[end:j]}"
        at = j
    return out + sql[at:]


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    x = np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(z) + q * np.log1p(-z)) / p
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
    out = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            out = out * c * d
    value = np.where(z <= 0, 0.0, front * out)
    return np.where(swap, 1 - value, value)


@F.pandas_udf(T.DoubleType())
def _t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    out = np.full(len(t), np.nan)
    for n in df.dropna().unique():
        at = (df == n).to_numpy()
        v = t.to_numpy(float)[at]
        out[at] = np.where(np.isinf(v), 0.0, incomplete_beta(n / 2, 0.5, n / (n + v**2)))
    return pd.Series(out)


def paired_t(d: Column) -> tuple[Column, Column]:
    """Aggregates (t, p) of paired differences d: two-sided, df = n - 1; no spread gives t = +-infinity and p = 0, or null if all are zero."""
    mean, sd, n = F.avg(d), F.stddev_samp(d), F.count(d)
    flat = F.max(d) == F.min(d)
    t = F.when(n < 2, None).when(flat, F.when(mean > 0, float("inf")).when(mean < 0, float("-inf"))).otherwise(mean / (sd / F.sqrt(n)))
    return t, n


def t_pvalue(t: Column, n: Column) -> Column:
    return F.when(t.isNotNull(), _t_pvalue(t.cast("double"), (n - 1).cast("double")))


def signed_rank_p(ranks: np.ndarray, w: float) -> float:
    """Two-sided p of the signed-rank statistic w over the ranks of the differences that are not zero.

    Exact over all sign vectors up to EXACT_PAIRS ranks, beyond that by the normal approximation; 1 if there are none.
    """
    n = len(ranks)
    if n > EXACT_PAIRS:
        return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt((ranks * ranks).sum() / 4) / math.sqrt(2))
    # Ranks of ties are halves, so twice the ranks are whole: sums of all sign vectors by dynamic programming.
    twice = np.rint(2 * ranks).astype(int)
    ways = np.zeros(twice.sum() + 1)
    ways[0] = 1
    for k in twice:
        ways[k:] += ways[: len(ways) - k].copy()
    return min(1.0, 2 * ways[: int(2 * w + 1e-6) + 1].sum() / 2.0**n) if n else 1.0


@F.pandas_udf(T.StructType([T.StructField("w", T.DoubleType()), T.StructField("p", T.DoubleType())]))
def wilcoxon(d: pd.Series) -> pd.DataFrame:
    """(w, p) of the signed-rank test over an array of paired differences: zeros are dropped, ranks of equal sizes averaged."""
    out = []
    for x in d:
        x = np.asarray(x, float)
        x = x[x != 0]
        size, where, count = np.unique(np.abs(x), return_inverse=True, return_counts=True)
        rank = (np.cumsum(count) - (count - 1) / 2)[where]
        w = min(rank[x > 0].sum(), rank[x < 0].sum())
        out.append((float(w), signed_rank_p(rank, w)))
    return pd.DataFrame(out, columns=["w", "p"])
