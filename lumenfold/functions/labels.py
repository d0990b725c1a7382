"""Label spelling and versions of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"^[ \t\r\n]+|[ \t\r\n]+$"


def label(c: str | Column) -> Column:
    """A label trimmed and in lower case."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, BLANKS, ""))


def dataset_label(c: str) -> Column:
    """A dataset label in its one form: cifar and its subsets are cifar100."""
    return F.regexp_replace(label(c), r"^cifar(_s.*)?$", "cifar100$1")


def method_label(c: str) -> Column:
    """A method's label without its dimensions in brackets, trimmed and in upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), BLANKS, ""))


def last_version(df: DataFrame, key: str, at: str) -> DataFrame:
    """Of rows with equal key the one with the largest (at, other columns), aggregated map-side; a null key is a version of nothing and dropped."""
    rest = [c for c in df.columns if c not in (key, at)]
    last = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("v"))
    return last.select(key, "v.*")
