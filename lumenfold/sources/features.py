"""Feature tables: scans, the read-through cache, metadata joins and image files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Feature lengths of the known backbones (fixed values), and their kind.
BACKBONES = {"resnet18": (512, "cnn"), "resnet50": (2048, "cnn"), "mobilenetv3": (576, "cnn"), "efficientnet": (1280, "cnn"), "vit_b16": (768, "vit"), "dinov2_vits14": (384, "vit")}


def backbones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, d, k) for n, (d, k) in BACKBONES.items()], "backbone string, feature_dim int, kind string")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_features(spark: SparkSession, path: str, **partition: str) -> DataFrame:
    """Scan of a feature cache; equalities on partition columns prune directories. A missing cache raises."""
    df = spark.read.parquet(path)
    for c, v in partition.items():
        df = df.filter(F.col(c) == v)
    return df


def cached_features(spark: SparkSession, path: str, compute: Callable[[], DataFrame], partitions: tuple[str, ...] = ("backbone", "dataset", "split")) -> DataFrame:
    """Read-through cache: a complete cache is scanned, else compute's rows are written to it first."""
    if not exists(spark, path):
        compute().write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)
    return load_features(spark, path)


def scan_pairs(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """Headless metadata lines such as "id value"."""
    return spark.read.schema(schema).option("sep", sep).csv(path)


def three_way(paths: DataFrame, labels: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """paths with label and split by key. A key that one of the others lacks raises when it is met, instead of vanishing."""
    joined = paths.join(labels, key, "left").join(splits, key, "left")
    missing = F.col("label").isNull() | F.col("is_train").isNull()
    return joined.withColumn("is_train", F.when(missing, F.raise_error(F.concat(F.lit(f"no label or split for {key} "), F.col(key).cast("string"))).cast("int")).otherwise(F.col("is_train")))


def class_index(classes: DataFrame, column: str, listed: DataFrame | None = None) -> DataFrame:
    """(column, label): classes numbered from 0 in order of their names, or as a list (line, column) of them has it. A registry of names, so one ordered pass will do."""
    from pyspark.sql.window import Window

    if listed is not None:
        return listed.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("line").cast("int").alias("label"))
    return classes.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("label", F.row_number().over(Window.orderBy(column)) - 1)


def listed_lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(line, column) of a file of one name a line, numbered from 0; the file is a registry that one task reads."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", column))
    return rows.withColumn(column, F.trim(column)).filter(F.col(column) != "")


def annotated_paths(files: DataFrame, annotations: DataFrame, name: str = "img_name", class_id: str = "class_id") -> DataFrame:
    """files (path) with their class by annotation (img_name, class_id) and new_path, where a folder for each class would hold them; files without one are left out."""
    known = annotations.groupBy(name).agg(F.min(class_id).alias(class_id))
    own = files.withColumn(name, F.substring_index("path", "/", -1)).join(known, name)
    folder = F.regexp_replace("path", r"(?:/images)?/[^/]*$", "")
    return own.withColumn("new_path", F.concat_ws("/", folder, F.col(class_id), F.lit("images"), F.col(name)))


def standardized_features(spark: SparkSession, path: str, backbone: str, dataset: str, label: str = "label") -> tuple[DataFrame, DataFrame, int, int]:
    """(train, test, number of classes, length) of one configuration of a feature cache, standardised by its training rows; an unknown configuration is a ValueError."""
    from lumenfold.operators.classify import standardize
    from lumenfold.operators.moments import moments

    rows = load_features(spark, path, backbone=backbone, dataset=dataset)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    if not train.head(1):
        raise ValueError(f"no features of {backbone} on {dataset}")
    m = moments(train, "features", label)
    scaled = standardize(train, "features", label, "features_std", m)
    return scaled(train), scaled(test), len(m.labels), m.d


def image_folder(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, class_id, content) of image files whose folder is their class."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.JPEG").option("recursiveFileLookup", True).load(pattern)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/(?:images/)?[^/]+$", 1).alias("class_id"), "content")


def decoded_images(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, height, width, channels, data) of image files, decoded on the JVM; files that are no images are left out."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(pattern)
    return images.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


#: Channel means and deviations that networks of photographs expect (fixed values).
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling of (h, w, 3) at pixel centres."""
    def weights(n: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    a, b, f = weights(image.shape[0], height)
    rows = image[a] * (1 - f)[:, None, None] + image[b] * f[:, None, None]
    a, b, f = weights(image.shape[1], width)
    return rows[:, a] * (1 - f)[None, :, None] + rows[:, b] * f[None, :, None]


def pixels(images: DataFrame, size: int = 224, shorter: int | None = None) -> DataFrame:
    """images (as decoded) with pixels ARRAY<FLOAT> instead of data: RGB channels by rows, size x size, normalised. shorter: the shorter side is brought to that length and the centre cut out, else the image is resized whole."""
    carried = [c for c in images.columns if c not in ("data", "height", "width", "channels", "pixels")]
    schema = images.select(*carried, F.lit(None).cast("array<float>").alias("pixels")).schema

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, c, data in zip(*[b[n].to_pylist() for n in ("height", "width", "channels", "data")], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c)
                x = np.repeat(x, 3, axis=2) if c == 1 else x[:, :, 2::-1]  # stored as blue, green, red
                if shorter:
                    scale = shorter / min(h, w)
                    x = resize(x.astype(float), max(size, round(h * scale)), max(size, round(w * scale)))
                    top, left = (x.shape[0] - size) // 2, (x.shape[1] - size) // 2
                    x = x[top : top + size, left : left + size]
                else:
                    x = resize(x.astype(float), size, size)
                out.append(((x / 255 - CHANNEL_MEAN) / CHANNEL_STD).transpose(2, 0, 1).reshape(-1).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in carried], pa.array(out, pa.list_(pa.float32()))], [*carried, "pixels"])

    return images.select(*carried, "height", "width", "channels", "data").mapInArrow(transform, schema)


def extract(images: DataFrame, model_factory: Callable, feature_dim: int, batch: int = 128, size: int = 224) -> DataFrame:
    """images (with pixels) with features by a frozen model: model_factory() gives a function from a batch (n, 3, size, size) to vectors, made once per worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    infer = predict_batch_udf(model_factory, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[3, size, size]])
    return images.withColumn("features", infer("pixels"))
