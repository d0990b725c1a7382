import struct
import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from lumenfold import session
from lumenfold.sources import features as f
from lumenfold.sources import results


def test_cache_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("b", "d", "train", 1, [1.0])], "backbone string, dataset string, split string, sample_id long, features array<double>")

    path = str(tmp_path / "cache")
    assert f.cached_features(spark, path, compute).count() == 1 and f.cached_features(spark, path, compute).count() == 1 and len(calls) == 1
    scan = f.load_features(spark, path, split="test")
    assert scan.count() == 0 and "PartitionFilters: [isnotnull(split" in scan._jdf.queryExecution().toString()
    with pytest.raises(AnalysisException):
        f.load_features(spark, str(tmp_path / "none"))


def test_metadata_files(spark, tmp_path):
    for name, text in (("images", "1 a/x.jpg\n2 b/y.jpg\n"), ("labels", "1 1\n2 2\n"), ("splits", "1 1\n")):
        (tmp_path / name).write_text(text)
    scan = lambda name, schema: f.scan_pairs(spark, str(tmp_path / name), schema)
    images, labels, splits = scan("images", "img_id int, path string"), scan("labels", "img_id int, label int"), scan("splits", "img_id int, is_train int")
    assert rows(f.three_way(images.filter("img_id = 1"), labels, splits, "img_id")) == [(1, "a/x.jpg", 1, 1)]
    with pytest.raises(Exception, match="no label or split"):
        f.three_way(images, labels, splits, "img_id").collect()


def test_image_folder_and_classes(spark, tmp_path):
    for c in ("n02", "n01"):
        (tmp_path / "train" / c / "images").mkdir(parents=True)
        (tmp_path / "train" / c / "images" / "x.JPEG").write_bytes(b"1")
        (tmp_path / "train" / c / "images" / "x.txt").write_bytes(b"1")
    images = f.image_folder(spark, str(tmp_path / "train"))
    assert sorted(rows(images.select("class_id"))) == [("n01",), ("n02",)]
    assert sorted(rows(f.class_index(images, "class_id"))) == [("n01", 0), ("n02", 1)]
    assert f.backbones(spark).count() == 6


def test_listed_classes_and_annotations(spark, tmp_path):
    (tmp_path / "wnids.txt").write_text("n09\n\nn01\r\nn05\n")
    listed = f.listed_lines(spark, str(tmp_path / "wnids.txt"), "class_id")
    assert sorted(rows(f.class_index(None, "class_id", listed))) == [("n01", 2), ("n05", 3), ("n09", 0)]
    files = spark.createDataFrame([("/d/val/images/a.JPEG",), ("/d/val/images/b.JPEG",)], "path string")
    notes = spark.createDataFrame([("a.JPEG", "n09"), ("z.JPEG", "n01")], "img_name string, class_id string")
    assert rows(f.annotated_paths(files, notes).select("path", "class_id", "new_path")) == [("/d/val/images/a.JPEG", "n09", "/d/val/n09/images/a.JPEG")]


def test_standardized_features(spark, tmp_path):
    data = [("b", "d", s, i, i % 2, [float(i), 1.0]) for i, s in enumerate(["train"] * 6 + ["test"] * 3)]
    spark.createDataFrame(data, "backbone string, dataset string, split string, sample_id long, label int, features array<double>").write.partitionBy("backbone", "dataset", "split").parquet(str(tmp_path / "c"))
    train, test, classes, d = f.standardized_features(spark, str(tmp_path / "c"), "b", "d")
    x = [r.features_std for r in train.collect()]
    assert (classes, d, test.count()) == (2, 2, 3) and abs(sum(v[0] for v in x)) < 1e-9 and {v[1] for v in x} == {0.0}
    with pytest.raises(ValueError, match="no features of b on other"):
        f.standardized_features(spark, str(tmp_path / "c"), "b", "other")


def png(path, image):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, c = image.shape
    raw = b"".join(b"\0" + image[i].tobytes() for i in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_to_pixels(spark, tmp_path):
    rng = np.random.default_rng(0)
    colour, grey = rng.integers(0, 256, (8, 8, 3)).astype(np.uint8), np.full((5, 9, 1), 51, np.uint8)
    png(tmp_path / "a.png", colour), png(tmp_path / "b.png", grey)
    (tmp_path / "c.png").write_bytes(b"no image")
    images = f.decoded_images(spark, str(tmp_path))
    assert sorted((r.path[-5:], r.height, r.width) for r in images.collect()) == [("a.png", 8, 8), ("b.png", 5, 9)]
    got = {r.path[-5:]: np.array(r.pixels).reshape(3, 8, 8) for r in f.pixels(images, 8).collect()}
    want = ((colour / 255 - f.CHANNEL_MEAN) / f.CHANNEL_STD).transpose(2, 0, 1)
    assert np.allclose(got["a.png"], want, atol=1e-5) and np.allclose(got["b.png"], ((0.2 - np.array(f.CHANNEL_MEAN)) / f.CHANNEL_STD)[:, None, None], atol=1e-5)
    cut = {r.path[-5:]: np.array(r.pixels) for r in f.pixels(images, 4, shorter=8).collect()}
    assert np.allclose(cut["a.png"].reshape(3, 4, 4), want[:, 2:6, 2:6], atol=1e-5) and cut["b.png"].shape == (48,)
    means = f.extract(f.pixels(images, 8), lambda: lambda x: x.mean(axis=(2, 3)), 3, size=8).select("path", "features").collect()
    assert all(len(r.features) == 3 for r in means)


def test_csv_sinks_and_scans(spark, tmp_path):
    assert results.read_csv(spark, str(tmp_path / "full"), results.SCHEMAS["academic"]).count() == 0
    with pytest.warns(UserWarning, match="no files"):
        assert results.read_csv(spark, str(tmp_path / "none")).columns == []
    df = spark.createDataFrame([("a", 1.0), ("b", 2.456)], "m string, v double")
    results.append_rows(df, str(tmp_path / "rows"))
    results.append_rows(df.limit(1), str(tmp_path / "rows"))
    assert sorted(rows(results.read_csv(spark, str(tmp_path / "rows"), T.StructType().add("m", "string").add("v", "string")))) == [("a", "1.00"), ("a", "1.00"), ("b", "2.46")]


def test_release(spark):
    path = session.stage_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert session.release(spark) >= 1 and session.release(spark) == 0
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
