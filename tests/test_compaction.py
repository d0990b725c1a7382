import datetime as dt
import itertools

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from lumenfold.operators import compaction as c

IMAGE = "rec_id long, file_id long, row_no int, img_path string, class_id string, split string, n_bytes int, checksum long"
CUB = "rec_id long, file_id long, row_no int, img_id long, images string, label int, is_train int, n_bytes int, checksum long"
FILES = "file_id long, dataset string, arrived_at timestamp"


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        code = c.hilbert_encode(points, bits)
        assert sorted(code) == list(range(len(points)))
        walk = points[np.argsort(code)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve are neighbours in space


def test_canonical_path(spark):
    cases = {
        " ./train//w1\\images/a.JPEG\r\n": "train/w1/images/a.jpeg", "/tiny-imagenet-200/train/a.jpeg": "train/a.jpeg", "CUB_200_2011/images/001.X/b.JPG": "001.X/b.jpg",
        "CUB_200_2011/x.JPG": "CUB_200_2011/x.jpg", "a.b/C": "a.b/C", "": "", None: None, "x/Y.TaR.GZ": "x/Y.TaR.gz",
    }
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", c.canonical_path(F.col("p")))
    assert {r[0]: r[1] for r in got.collect()} == cases


def put_images(tables, images):
    tables("tiny_imagenet", images, IMAGE)
    tables("cub200", [], CUB)
    tables("image_files", [(i, "tiny_imagenet", dt.datetime(2030, 1, 10 - i)) for i in range(1, 5)], FILES)


IMAGES = [
    (1, 1, 0, "a/x.JPEG", "k", "train", 10, 7), (2, 2, 0, "./a/x.jpeg", "k", "train", 10, 7), (3, 3, 0, "a\\x.JPEG", None, None, None, 7),  # file 3 arrived first
    (4, 1, 1, "a/x.JPEG", "k", "train", 10, 8), (5, 1, 2, None, "k", "train", 10, 7), (6, 1, 3, None, "k", "train", 10, 7), (7, 2, 1, "a/x.JPEG", "k", "train", 10, None),
    (8, 99, 0, "b.jpeg", "k", "train", 10, 9), (9, 4, 0, "b.jpeg", "k", "train", -5, 9), (10, 4, 1, "", "k", "train", 10, 3), (11, 4, 2, "x" * 100_000, "k", "train", 10, 3),
]


def test_repeats(spark, tables):
    put_images(tables, IMAGES)
    assert sorted(rows(c.p1_found(spark, tables.dir))) == [("tiny_imagenet", 1), ("tiny_imagenet", 2), ("tiny_imagenet", 8)]
    report = {r.dataset: r for r in c.p1_compaction(spark, tables.dir).collect()}
    assert (report["tiny_imagenet"].source_rows, report["tiny_imagenet"].kept_rows, report["tiny_imagenet"].repeat_rows, report["tiny_imagenet"].intact) == (11, 8, 3, True)
    assert (report["cub200"].source_rows, report["cub200"].intact) == (0, True)


def test_hot_copy_and_sizes(spark, tables, tmp_path):
    """A third of the rows are copies of one record; the files are of the wanted size and each holds a part of both axes."""
    images = [(i, 1 + i % 4, i, "hot/a.JPEG", "k", "train", 100, 1) for i in range(10_000)] + [(i, 1 + i % 4, i, f"d{i % 97:02}/b{i}.JPEG", "k", "train", 100, (i * 0x9E3779B97F4A7C15) % (1 << 63)) for i in range(10_000, 40_000)]
    put_images(tables, images)
    target = 40_000
    done = c.compact_images(spark, tables.dir, "tiny_imagenet", target, str(tmp_path / "out"))
    assert done.intact and [done.digests[k][0] for k in ("source", "files", "repeats")] == [40_000, 30_001, 9_999]
    files = list((tmp_path / "out" / "parts" / "_role0=files").glob("*.parquet"))
    sizes = sorted(f.stat().st_size for f in files)
    assert len(files) == done.n_files > 8 and done.well_sized and sizes[1] > target / 2 and sizes[-1] < 1.5 * target
    assert done.files.columns == spark.read.parquet(f"{tables.dir}/tiny_imagenet.parquet").columns and done.files.select("rec_id").distinct().count() == 30_001
    assert done.files.filter("checksum = 1").first().file_id == 4  # the file that arrived first
    spans = done.files.groupBy("_metadata.file_path").agg(F.min("img_path").alias("lo"), F.max("img_path").alias("hi"), F.min("checksum").alias("a"), F.max("checksum").alias("b")).collect()
    at = lambda path: int(path[1:3]) if path[0] == "d" else 97
    # A reader that looks for one path, or one checksum, can pass over most files.
    assert sum(at(r.hi) - at(r.lo) for r in spans) / len(spans) < 97 * 0.55 and sum(r.b - r.a for r in spans) / len(spans) < 0.55 * (1 << 63)
    copies = done.repeats.filter("img_path = 'hot/a.JPEG'")
    assert copies.count() == 9_999 and len(list((tmp_path / "out" / "repeats").glob("*.parquet"))) < done.n_files


def test_axes_are_cut_evenly(spark):
    df = spark.range(0, 30_000).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.lpad(F.col("id").cast("string"), 6, "0")).alias("x"), F.lit(None).cast("string").alias("y"))
    x, y = c.axis_bounds(df, [F.col("x"), F.col("y")], 16)
    assert y == [] and x == sorted(set(x)) and 9 <= len(x) <= 15 and x[-1] == "same"
    counts = [df.filter((F.col("x") > a) & (F.col("x") <= b)).count() for a, b in zip(x, x[1:])]
    assert max(counts[:-1]) < 3000


def test_ranges_are_even():
    r = c.cut(np.array([3, 9, 11]), np.array([1.0, 1000.0, 7.0]), 10)
    loads = np.bincount(r.file, np.repeat(np.array([1.0, 1000.0, 7.0]) / r.units, r.units), 10)
    assert loads.min() > 85 and loads.max() < 115


def test_extra_columns_with_clashing_names(spark, tables):
    tables("tiny_imagenet", [(*r, 1, 2, True, "p", "r", "o") for r in IMAGES], IMAGE + ", _code int, _key int, _repeat boolean, place string, row string, _role0 string")
    tables("cub200", [], CUB)
    tables("image_files", [(i, "tiny_imagenet", dt.datetime(2030, 1, 10 - i)) for i in range(1, 5)], FILES)
    assert len(rows(c.p1_found(spark, tables.dir))) == 3
    assert c.p1_compaction(spark, tables.dir).filter("intact").count() == 2
