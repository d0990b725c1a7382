"""Session helpers: the folder all executors share, and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if at := sc.getCheckpointDir():
        return at.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
    return sc.getCheckpointDir().rstrip("/")


#: Paths handed out and not yet removed.
_staged: list[str] = []


def stage_path(spark: SparkSession, label: str = "stage") -> str:
    """A new path in the shared folder, removed by release or when the application ends."""
    path = f"{shared_dir(spark)}/lumenfold/{label}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    _staged.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove all that was staged, once the results that read it are written; returns how many paths there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_staged)
    while _staged:
        at = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        at.getFileSystem(conf).delete(at, True)
    return n


#: Whether the shuffle files of a query go as soon as it ends; Spark otherwise keeps them until the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files at their end."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before) if before is not None else spark.conf.unset(_TIDY)


def stage(df: DataFrame, label: str = "stage", by: str | None = None, tidy: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs nothing that was staged.

    by: column with a folder for each value, so what is filtered by it is not read. tidy: the shuffle files of the write are removed at its end.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    with tidied(spark) if tidy else nullcontext():
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Tasks that a stage should at least have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
