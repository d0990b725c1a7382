"""Extensions for streams: a fitted reducer over a stream, and tumbling-window monitors.

Scoring is stateless, so a stream is reduced by the very plan of a batch. Monitors keep one row of state per open window and key and
drop events later than the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.stats import half_up
from lumenfold.operators.reducers import AffineModel, Reducer
from lumenfold.session import stage_path


def score(stream: DataFrame, model: AffineModel) -> DataFrame:
    """The stream with its vectors reduced."""
    return model.transform(stream)


def windows(events: DataFrame, at: str, keys: list[str], value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, keys..., n, mean_value) of tumbling windows."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(value), 6).alias("mean_value"))
    return w.select(F.col("w.start").alias("window_start"), *keys, "n", "mean_value")


def run_once(df: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that is there, with its checkpoint in the shared folder, and read what it wrote."""
    path = stage_path(df.sparkSession, label)
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of its files; one that is a single file is picked out of its folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def stream_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings reduced to two components as a stream, by a model fitted on the batch."""
    path = f"{sf_dir}/embeddings.parquet"
    model = Reducer.create("PCA", 2, vector="embedding", identity="vec_id").fit(spark.read.parquet(path))
    return run_once(score(_source(spark, path).select("vec_id", "embedding"), model).select("vec_id", "reduced"), "scores")


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean value of events per hour and type, of the windows that the watermark has closed: those that end a day or more before the last event. They are appended to the shared folder, and their state is dropped."""
    events = _source(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return run_once(windows(events, "ts", ["event_type"], "value"), "windows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {"stream_reduce": stream_reduce, "stream_event_windows": stream_event_windows}
ORACLES = {"stream_event_windows": "SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value) + 1e-9 * sign(avg(value)), 6) AS mean_value FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"}
