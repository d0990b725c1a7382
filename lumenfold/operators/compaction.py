"""Consolidating very many small files by Hilbert-curve clustering.

Every record gets a code on a Hilbert curve through the space of its (place, content) coordinates. A coordinate is the record's
bucket in the order of all records by that axis, buckets of equal depth, so the curve keeps near what is near. An exact histogram of
the codes, of what repeats nothing and in bytes as they are written, is cut into ranges of equal weight, one per output file; the
records are shuffled by range once, repeats are recognised inside a range (equal records have equal codes and equal shares of
a code, so they share it), and each range is written as one file. Source, files and repeats are compared by order-free digests.

Bytes are measured: a range of a part of a file is written first, and what its rows took, against their raw length, holds for all.
A code heavier than an eighth of a file is cut further by a hash of place and content. The copies of a record of which very many
exist are not gathered: their first one is aggregated, and they are dealt to all ranges.

Defined results: a record with a null path or checksum repeats nothing and is kept; a null arrival time counts as latest;
identities are unique; an empty table gives no rows; extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenfold.operators.skew import frequent, small
from lumenfold.session import parallelism, stage, stage_path

#: Bits of each of the two coordinates: 1,023 bounds of an axis and at most 2 ** 20 cells of the histogram are held on the driver.
AXIS_BITS = 10
#: Characters of a value that its place on an axis is told by.
AXIS_CHARS = 256
#: Points that stand for all values of an axis that a task has met; each merging moves a bound by at most one part in as many.
SUMMARY = 8192
TARGET_BYTES = 128 << 20
#: Least raw bytes of the range whose encoding is measured (a whole file, where that is less).
MEASURED_BYTES = 4 << 20
#: Units of a file in which codes are dealt to files.
UNITS = 8


def hilbert_encode(axes: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of the points axes (n, dims), each below 2**bits; dims * bits is at most 62."""
    x = [a.astype(np.uint64) for a in np.asarray(axes).T]
    zero = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(len(x)):
            on = (x[i] & np.uint64(q)) != 0
            swap = np.where(on, zero, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = zero, 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    code = zero
    for b in range(bits - 1, -1, -1):
        for a in x:
            code = (code << np.uint64(1)) | (((a ^ turn) >> np.uint64(b)) & np.uint64(1))
    return code.astype(np.int64)


def canonical_path(path: Column) -> Column:
    """The place a delivered image path names, whatever the spelling of separators, dot steps, dataset root and extension."""
    text = F.translate(F.btrim(path, F.lit(" \t\r\n")), "\\", "/")
    # Only paths with empty or dot steps are taken apart.
    odd = F.contains(F.concat(F.lit("/"), text, F.lit("/")), F.lit("//")) | F.contains(F.concat(F.lit("/"), text, F.lit("/")), F.lit("/./"))
    place = F.when(odd, F.array_join(F.filter(F.split(text, "/"), lambda s: (s != "") & (s != ".")), "/")).otherwise(text)
    a, b = "tiny-imagenet-200/", "CUB_200_2011/images/"
    inside = F.when(F.startswith(place, F.lit(a)), len(a)).when(F.startswith(place, F.lit(b)), len(b)).otherwise(0)
    place = F.substring(place, inside + 1, F.length(place))
    name = F.substring_index(place, "/", -1)
    ending = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")
    return F.concat(F.left(place, F.length(place) - F.length(ending)), F.lower(ending))


def _thin(values: list[str], weights: np.ndarray, points: int) -> tuple[list[str], np.ndarray]:
    """At most points of the sorted weighted values, at equal steps of weight, with the weight up to each."""
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, points + 1) / points - 0.5))
    return [values[i] for i in at], np.diff(upto[at], prepend=0)


def axis_bounds(df: DataFrame, axes: list[Column], buckets: int) -> list[list[str]]:
    """For each axis at most buckets - 1 values that cut all its values, nulls apart, into buckets of equal depth.

    Every task summarises what it meets, and summaries are merged in two levels: no values are left out, and buckets - 1 of them
    reach the driver.
    """
    names = [f"a{i}" for i in range(len(axes))]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[list[str]] = [[] for _ in names]
        held: list[tuple[list[str], np.ndarray]] = [([], np.empty(0)) for _ in names]

        def absorb(i: int) -> None:
            own = _thin(sorted(fresh[i]), np.ones(len(fresh[i])), SUMMARY)
            both = sorted(zip([*held[i][0], *own[0]], [*held[i][1], *own[1]], strict=True))
            held[i] = _thin([v for v, _ in both], np.array([w for _, w in both]), SUMMARY)
            fresh[i] = []

        for b in batches:
            for i in range(len(names)):
                fresh[i] += b[i].drop_null().to_pylist()
                if len(fresh[i]) > 200_000:
                    absorb(i)
        for i in range(len(names)):
            absorb(i)
            if held[i][0]:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(held[i][0]), pa.int32()), pa.array(held[i][0], pa.string()), pa.array(held[i][1], pa.float64()), pa.array([crc32(held[i][0][0].encode()) % 997] * len(held[i][0]), pa.int32())], ["axis", "value", "weight", "part"])

    def merge(points: int):
        def run(t: pa.Table) -> pa.Table:
            both = sorted(zip(t["value"].to_pylist(), t["weight"].to_pylist(), strict=True))
            v, w = _thin([x for x, _ in both], np.array([x for _, x in both]), points)
            return pa.table({"axis": pa.array([t["axis"][0].as_py()] * len(v), pa.int32()), "value": pa.array(v, pa.string()), "weight": pa.array(w, pa.float64())})

        return run

    parts = df.select(*[F.left(a.cast("string"), F.lit(AXIS_CHARS)).alias(n) for a, n in zip(axes, names, strict=True)]).mapInArrow(summarise, "axis int, value string, weight double, part int")
    wide = max(1, int(np.sqrt(parallelism(df.sparkSession))))
    some = parts.withColumn("part", F.pmod("part", F.lit(wide))).groupBy("axis", "part").applyInArrow(merge(SUMMARY), "axis int, value string, weight double")
    found = some.groupBy("axis").applyInArrow(merge(buckets), "axis int, value string, weight double").collect()
    return [sorted({r.value for r in found if r.axis == i})[: buckets - 1] for i in range(len(axes))]


def hilbert_code(axes: list[Column], bounds: list[list[str]], bits: int = AXIS_BITS) -> Column:
    """The code of the buckets that two axes' values are in; nulls are in the first."""

    @F.pandas_udf(T.LongType())
    def code(a: pd.Series, b: pd.Series) -> pd.Series:
        places = [np.fromiter((bisect_right(bound, v) if v is not None else 0 for v in s.array), np.int64, len(s)) for s, bound in ((a, bounds[0]), (b, bounds[1]))]
        return pd.Series(hilbert_encode(np.stack(places, axis=1), bits))

    return code(*[F.left(a.cast("string"), F.lit(AXIS_CHARS)) for a in axes])


def raw_bytes(row: Column, schema: T.StructType) -> Column:
    """Length of a row: that of texts and binaries as they are, 8 bytes of any other value."""
    size = {T.StringType: F.octet_length, T.BinaryType: F.octet_length, T.ArrayType: lambda c: F.size(c) * 8, T.MapType: lambda c: F.size(c) * 16}
    sized = [F.coalesce(size.get(type(f.dataType), lambda _: F.lit(8))(row[f.name]), F.lit(0)) for f in schema.fields]
    total = F.lit(1).cast("long")
    for c in sized:
        total = total + c
    return total


@dataclass(frozen=True)
class Clustered:
    """rows: every source row as _row with _code, _key (digest of what equal records share, null: nothing), _hash, _order and _weight (raw bytes), staged;
    hot: hashes of the keys of very many copies."""

    rows: DataFrame
    hot: list[int]


def cluster(rows: DataFrame, row: str, place: Column, content: Column, order: list[Column], axes_of: DataFrame | None = None) -> Clustered:
    """The rows, of which the struct column row is carried along, on the curve through place and content.

    Two rows repeat each other if content and place are equal and not null; the first by order, which ends with an identity, is the original.
    axes_of: rows as they are before what only order needs was joined to them.
    """
    bounds = axis_bounds(rows if axes_of is None else axes_of, [place, content], 1 << AXIS_BITS)
    coded = rows.select(
        F.col(row).alias("_row"),
        # 128 bits tell what equal records share.
        F.when(content.isNotNull() & place.isNotNull(), F.struct(F.xxhash64(content, place).alias("a"), F.xxhash64(F.lit(17), place, content).alias("b"))).alias("_key"),
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_order"),
        raw_bytes(F.col(row), rows.schema[row].dataType).alias("_weight"),
        hilbert_code([place, content], bounds).alias("_code"),
    )
    staged = stage(coded.withColumn("_hash", F.when(F.col("_key").isNotNull(), F.col("_key.a")).otherwise(F.xxhash64("_order"))), "compact-coded")
    return Clustered(staged, frequent(staged, "_hash", parallelism(rows.sparkSession)))


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


@dataclass(frozen=True)
class Ranges:
    """first[i]: the first unit of cell cells[i], which has units[i] of them; file[u]: the output file of unit u."""

    cells: np.ndarray
    first: np.ndarray
    units: np.ndarray
    file: np.ndarray
    n_files: int


def cut(cells: np.ndarray, weights: np.ndarray, n_files: int) -> Ranges:
    """Ranges of about equal weight: cells in order of their codes, those heavier than a unit in several units of equal weight."""
    unit = max(1.0, weights.sum() / n_files / UNITS)
    units = np.maximum(1, np.ceil(weights / unit)).astype(np.int64)
    each = np.repeat(weights / units, units)
    middle = np.cumsum(each) - each / 2
    file = np.minimum(n_files - 1, (middle / max(weights.sum(), 1) * n_files).astype(np.int64))
    return Ranges(cells, np.cumsum(units) - units, units, file.astype(np.int32), n_files)


def histogram(clustered: Clustered) -> tuple[np.ndarray, np.ndarray]:
    """(codes, raw bytes) of what repeats nothing: copies of a key count once."""
    once = clustered.rows.groupBy("_code", "_hash").agg(F.max("_weight").alias("w"))
    t = once.groupBy("_code").agg(F.sum("w").alias("w")).toArrow()  # at most 2 ** (2 * AXIS_BITS) rows
    order = np.argsort(t["_code"].to_numpy())
    return t["_code"].to_numpy()[order], t["w"].to_numpy()[order].astype(float)


def encoded_share(clustered: Clustered, columns: list[str], cells: np.ndarray, weights: np.ndarray, target: int) -> float:
    """Written bytes of a raw one, measured on a range in the middle of the curve: a sixteenth of a file, at least MEASURED_BYTES."""
    spark, upto = clustered.rows.sparkSession, np.cumsum(weights)
    size = min(float(target), max(target / 16, MEASURED_BYTES), upto[-1])
    start = int(np.searchsorted(upto, (upto[-1] - size) / 2))
    stop = min(len(cells) - 1, int(np.searchsorted(upto, (upto[-1] + size) / 2)))
    # A code of many files is thinned by the hash that would deal it to them.
    thin = max(1, int(weights[start : stop + 1].sum() // (2 * size)))
    some = clustered.rows.filter(F.col("_code").between(int(cells[start]), int(cells[stop])) & (F.pmod("_hash", F.lit(thin)) == 0))
    once = stage(some.groupBy("_code", "_hash").agg(F.first("_row").alias("_row"), F.max("_weight").alias("w")), "compact-range")
    path = stage_path(spark, "compact-measure")
    once.repartition(1).sortWithinPartitions("_code", "_hash").select(*[F.col("_row")[c].alias(c) for c in columns]).write.parquet(path)
    return written_bytes(spark, path) / max(1, once.agg(F.sum("w")).first()[0] or 1)


def place_rows(clustered: Clustered, ranges: Ranges) -> DataFrame:
    """The rows, each in the partition of its file, with _repeat."""
    n_files, cells, first, units, file = ranges.n_files, ranges.cells, ranges.first, ranges.units, ranges.file

    @F.pandas_udf(T.IntegerType())
    def to_file(code: pd.Series, key: pd.Series) -> pd.Series:
        i = np.searchsorted(cells, code.to_numpy())
        return pd.Series(file[first[i] + (key.to_numpy().astype(np.uint64) >> np.uint64(1)).astype(np.int64) % units[i]])

    rows = clustered.rows.withColumn("_file", to_file("_code", "_hash"))
    later = F.lit(None).cast("boolean")
    if clustered.hot:  # at most four times as many keys as tasks
        firsts = clustered.rows.filter(F.col("_hash").isin(clustered.hot) & F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_order").alias("_first"))
        rows = rows.join(small(stage(firsts, "compact-firsts")), "_key", "left")
        later = F.when(F.col("_first").isNotNull(), ~F.col("_order").eqNullSafe(F.col("_first")))
        rows = rows.withColumn("_file", F.when(later, F.pmod(F.xxhash64("_order"), F.lit(n_files)).cast("int")).otherwise(F.col("_file")))
    nth = F.row_number().over(Window.partitionBy("_file", "_key").orderBy("_order"))
    return rows.repartitionById(n_files, "_file").withColumn("_repeat", F.col("_key").isNotNull() & F.coalesce(later, nth > 1))


def digest(columns: list[str]) -> list[Column]:
    """Order-free digest of rows: how many, the sum and the exclusive or of their hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    return [F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in columns)}))").alias("hash_xor")]


@dataclass(frozen=True)
class Compacted:
    """The files and the repeats, as they lie in their folders; digests of source, files and repeats; number of files, and how many are of less than half a target or of more than one and a half."""

    files: DataFrame
    repeats: DataFrame
    digests: dict[str, tuple]
    n_files: int
    n_short: int
    n_long: int

    @property
    def intact(self) -> bool:
        """Whether the source is the files and the repeats together, by number, sum and exclusive or."""
        (n, s, x), (kn, ks, kx), (rn, rs, rx) = ((d[0], d[1] or 0, d[2] or 0) for d in (self.digests[k] for k in ("source", "files", "repeats")))
        return n == kn + rn and s == ks + rs and x == kx ^ rx

    @property
    def well_sized(self) -> bool:
        """Whether all files, the last one apart, are of half to one and a half targets."""
        return not self.n_long and self.n_short <= 1


def compact(source: DataFrame, clustered: Clustered, path: str, target: int = TARGET_BYTES) -> Compacted:
    """Write the rows that repeat nothing in files of about target bytes, the others as they come together, both below path, and compare them with the source."""
    spark, columns = source.sparkSession, source.columns
    cells, weights = histogram(clustered)
    role = next(n for i in range(len(columns) + 1) if (n := f"_role{i}") not in {c.lower() for c in columns})
    at = {name: f"{path}/parts/{role}={name}" for name in ("files", "repeats")}
    if len(cells):
        encoded = weights * encoded_share(clustered, columns, cells, weights, target)
        marked = place_rows(clustered, cut(cells, encoded, max(1, round(float(encoded.sum()) / target))))
        # One pass writes both.
        out = marked.withColumn(role, F.when(F.col("_repeat"), "repeats").otherwise("files")).sortWithinPartitions(role, "_code", "_order")
        out.select(*[F.col("_row")[c].alias(c) for c in columns], role).write.partitionBy(role).parquet(f"{path}/parts")
    read = lambda p: spark.read.schema(source.schema).parquet(p) if written_bytes(spark, p) else spark.createDataFrame([], source.schema)
    # The repeats of all ranges are small files once more, and brought together.
    read(at["repeats"]).coalesce(max(1, ceil(written_bytes(spark, at["repeats"]) / target))).write.parquet(f"{path}/repeats")
    parts = {"source": source, "files": read(at["files"]), "repeats": read(f"{path}/repeats")}
    digests = {name: tuple(df.agg(*digest(columns)).first()) for name, df in parts.items()}
    sizes = (0, 0, 0)
    if digests["files"][0]:
        each = parts["files"].select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("b"))
        sizes = each.agg(F.count(F.lit(1)), F.count_if(F.col("b") < 0.5 * target), F.count_if(F.col("b") > 1.5 * target)).first()
    return Compacted(parts["files"], parts["repeats"], digests, *sizes)


#: The image tables and their path columns.
IMAGE_TABLES = {"tiny_imagenet": "img_path", "cub200": "images"}


def compact_images(spark: SparkSession, sf_dir: str, table: str, target: int = TARGET_BYTES, path: str | None = None) -> Compacted:
    """The records of an image table in new files (in the shared folder, if no path is given); raises if the files and the repeats are not the source."""
    records = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    arrivals = spark.read.parquet(f"{sf_dir}/image_files.parquet").groupBy("file_id").agg(F.min("arrived_at").alias("arrived"))
    # The row itself travels as one struct, so its columns cannot clash with those of the clustering.
    placed = records.select(F.struct(*[F.col(c) for c in records.columns]).alias("row"), "file_id", canonical_path(F.col(IMAGE_TABLES[table])).alias("place"))
    rows = placed.join(small(arrivals), "file_id", "left")
    late = F.coalesce("arrived", F.lit("9999-12-31").cast(arrivals.schema["arrived"].dataType))
    content = F.lpad(F.hex(F.col("row")["checksum"].bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # hex digits in the order of the numbers
    done = compact(records, cluster(rows, "row", F.col("place"), content, [late, F.col("file_id"), F.col("row")["row_no"], F.col("row")["rec_id"]], placed), path or stage_path(spark, f"compact-{table}"), target)
    if not done.intact:
        raise ValueError(f"{table}: files and repeats are not the source")
    return done


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, rec_id) of each image record that repeats an earlier one: what compaction, once its digests agree, has put aside."""
    parts = [compact_images(spark, sf_dir, t).repeats.select(F.lit(t).alias("dataset"), "rec_id") for t in IMAGE_TABLES]
    return parts[0].unionByName(parts[1])


def p1_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact both image tables and report rows, digests and sizes per table."""
    rows = []
    for t in IMAGE_TABLES:
        done = compact_images(spark, sf_dir, t)
        rows.append((t, *[done.digests[k][0] for k in ("source", "files", "repeats")], done.intact, done.well_sized))
    return spark.createDataFrame(rows, "dataset string, source_rows long, kept_rows long, repeat_rows long, intact boolean, well_sized boolean")


_PLACE = r"""
  regexp_replace(list_aggregate(list_filter(string_split(replace(regexp_replace({p}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '\', '/'), '/'), lambda s: s <> '' and s <> '.'), 'string_agg', '/'), '^(tiny-imagenet-200|CUB_200_2011/images)/', '')"""
_IMAGES_SQL = "WITH " + ", ".join(
    rf"""{t}_place AS (SELECT r.*, f.arrived_at, {_PLACE.format(p="r." + p)} AS place FROM {t} r LEFT JOIN image_files f USING (file_id)),
{t}_marked AS (SELECT '{t}' AS dataset, rec_id, checksum IS NOT NULL AND place IS NOT NULL AND row_number() OVER (PARTITION BY checksum, regexp_replace(place, '\.[^./]+$', '') || lower(regexp_extract(place, '\.[^./]+$')) ORDER BY coalesce(arrived_at, TIMESTAMP '9999-12-31'), file_id, row_no, rec_id) > 1 AS is_repeat FROM {t}_place)"""
    for t, p in IMAGE_TABLES.items()
) + ", marked AS (SELECT * FROM tiny_imagenet_marked UNION ALL SELECT * FROM cub200_marked) "

QUERIES = {"p1_found": p1_found, "p1_compaction": p1_compaction}
ORACLES = {
    "p1_found": _IMAGES_SQL + "SELECT dataset, rec_id FROM marked WHERE is_repeat",
    "p1_compaction": _IMAGES_SQL + "SELECT dataset, count(*) AS source_rows, count(*) FILTER (NOT is_repeat) AS kept_rows, count(*) FILTER (is_repeat) AS repeat_rows, true AS intact, true AS well_sized FROM marked GROUP BY dataset",
}
