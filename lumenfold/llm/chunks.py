"""Records shared between splits, by content-defined chunks.

A vector is normalised to a sequence of symbols: the signs of its coordinates in VIEWS fixed random rotations, which neither
scale nor small noise changes much. A hash that rolls over the last WINDOW symbols cuts the sequence where it hits a fixed
residue, at least MIN symbols from the cut before and from the end and at most MAX from the cut before where the end is farther,
so a changed symbol spoils only the chunks around it and every symbol is in a chunk. The lengths of the chunks that two records
share, as digests of symbols and place, add up to the fraction of the record that overlaps: of equal records 1, of both records
the same, as all of a group are of one length.

Pairs are found view by view: each view is cut as a record of its own, which meets more often than one run through all of them,
and the digests are joined across splits, a few views in a pass, whose shuffle files go before the next pass. Every row carries a
sketch of its vector, rounded coordinates, and a pair whose sketches are surely further apart than the least cosine allows ends in
the join: chance pairs, whose number grows with the square of the records, are written nowhere. The others are measured exactly.

Exact copies within a split are represented by one record and restored at the end, so a mass of copies shares no chunk more
than once. A digest that a large part of the records share (a cluster of almost equal vectors) is spread over salts.

Defined results: see vectors.usable for vectors that take no part; a record whose split is unknown takes no part; no pairs come
from an empty table or from one without both splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.labels import label
from lumenfold.llm.vectors import cosines, matrix, members_of, usable, with_digest
from lumenfold.operators.skew import frequent, lookup, small
from lumenfold.session import parallelism, stage, tidied

VIEWS = 10
WINDOW = 5
MIN, AVERAGE, MAX = 12, 6, 30
#: Least overlap of a pair that is measured: any shared chunk. A greater one would lose pairs at a cosine of 0.985.
MIN_OVERLAP = 0.0
SEED = 11
#: Vectors whose chunks are computed at a time.
BLOCK = 8192
#: Coordinates of a sketch, a byte each, and the steps of a length of 1.
SKETCH, STEPS = 16, 256
#: Views of records whose chunks are shuffled at a time, about 4 rows of 30 bytes each: more records mean more passes.
VIEWS_AT_ONCE = 1_000_000
#: Classes of copies that are broadcast to look rows up; beyond it the rows are moved.
MANY_CLASSES = 300_000


def rotations(d: int, views: int = VIEWS) -> np.ndarray:
    """(d, views * d): views random rotations side by side."""
    rng = np.random.default_rng([SEED, d])
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(views)], axis=1)


def chunk_rows(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, length) of the content-defined chunks of each row of 0/1 symbols."""
    n, length = symbols.shape
    mask = np.uint64((1 << WINDOW) - 1)
    # Which of the windows cut: one in AVERAGE, chosen by a fixed permutation.
    cuts = np.random.default_rng(SEED).permutation(1 << WINDOW) % AVERAGE == 0
    window, since = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    start, digest = np.zeros(n, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    rows, digests, lengths = [], [], []
    for i in range(length):
        bit = symbols[:, i].astype(np.uint64)
        window = ((window << np.uint64(1)) | bit) & mask
        digest = (digest ^ (bit + np.uint64(1))) * np.uint64(0x100000001B3)
        since += 1
        end = ((since >= MIN) & cuts[window.astype(np.int64)]) | (since >= MAX)
        if i >= length - MIN:
            # What would be left is too short for a chunk, many records would share it; it goes to the last one.
            end = np.full(n, i == length - 1)
        at = np.flatnonzero(end)
        if len(at):
            h = (digest[at] ^ (start[at] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
            rows.append(at), digests.append((h ^ (h >> np.uint64(29))).view(np.int64)), lengths.append(since[at])
            start[at], since[at], digest[at] = i + 1, 0, 0x9E3779B97F4A7C15
    return np.concatenate(rows), np.concatenate(digests), np.concatenate(lengths)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, matrix of their column _vector), BLOCK rows at most and all of one length."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            b = whole.slice(at, BLOCK)
            sizes = pc.list_value_length(b["_vector"]).to_numpy()
            for d in np.unique(sizes):
                if d * VIEWS >= 1 << 16:
                    raise ValueError(f"vectors of {d} elements")
                part = b.take(pa.array(np.flatnonzero(sizes == d)))
                yield part, matrix(part["_vector"])


def shared_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, the share of the symbols of all views that lies in chunks which both hold."""
    turn = rotations(a.shape[1])
    (row_a, digest_a, length_a), (row_b, digest_b, _) = (chunk_rows((x @ turn > 0).view(np.uint8)) for x in (a, b))
    key = np.dtype([("row", np.int64), ("digest", np.int64)])
    left, right = np.empty(len(row_a), key), np.empty(len(row_b), key)
    left["row"], left["digest"], right["row"], right["digest"] = row_a, digest_a, row_b, digest_b
    return np.bincount(row_a, np.where(np.isin(left, right), length_a, 0), len(a)) / turn.shape[1]


def sketches(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(n, SKETCH / 8) words of rounded coordinates of x along turn's columns. Rounding moves each by half a step at most, and what is beyond a byte's range comes only closer."""
    out = np.zeros((len(x), SKETCH), np.int8)
    out[:, : turn.shape[1]] = np.clip(np.rint(x @ turn * STEPS), -128, 127)
    return out.view("<i8")


def apart(a: str, b: str) -> Column:
    """Squared distance of the bytes of two words."""
    byte = lambda w, i: F.shiftright(F.shiftleft(w, 56 - 8 * i), 56)
    steps = [byte(a, i) - byte(b, i) for i in range(8)]
    return reduce(lambda x, y: x + y, [t * t for t in steps])


def farthest(min_cosine: float) -> int:
    """The greatest squared distance that the sketches of two vectors of that cosine can have."""
    return math.floor((STEPS * math.sqrt(max(0.0, 2 - 2 * min_cosine)) + math.sqrt(SKETCH)) ** 2) + 1


def chunks(df: DataFrame, group: str, vector: str, columns: list[str], views: range) -> DataFrame:
    """(columns..., digest, s0, s1) of the chunks of each vector's views, each cut as a record of its own, and the vector's sketch.

    A digest is 42 bits of a hash of group, view, place and symbols, the chunk's length (6 bits: below MAX + MIN) and that of all views (16).
    """
    schema = df.select(*columns).schema.add("digest", "long").add("s0", "long", False).add("s1", "long", False)
    chosen = df.select(*columns, F.xxhash64(group).alias("_group"), F.col(vector).alias("_vector"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part, x in _blocks(batches):
            n, d = x.shape
            if d not in turned:
                turn = rotations(d, VIEWS + 1)
                turned[d] = np.ascontiguousarray(turn[:, views.start * d : views.stop * d].T), turn[:, VIEWS * d :][:, :SKETCH]
            turn, last = turned[d]
            # Views side by side as rows of one place after the other.
            symbols = (turn @ x.T > 0).view(np.uint8).reshape(len(views), d, n).transpose(1, 0, 2).reshape(d, -1)
            row, digest, length = chunk_rows(symbols.T)
            view, row = views.start + row // n, row % n
            digest = (digest ^ (part["_group"].to_numpy()[row] * 31)) * (2 * view + 1)
            digest = ((digest ^ (digest >> 31)) & np.int64(-1 << 22)) | (length << 16) | VIEWS * d
            index, sketch = pa.array(row), sketches(x, last)[row]
            yield pa.RecordBatch.from_arrays([*[part[c].take(index) for c in columns], pa.array(digest), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], [*columns, "digest", "s0", "s1"])

    return chosen.mapInArrow(cut, schema)


def overlaps(left: DataFrame, right: DataFrame, hot: list[int], min_fraction: float = 0.0, min_cosine: float | None = None) -> DataFrame:
    """(id_l, id_r, overlap) of records (columns id, digest) that share at least min_fraction of the left one. hot: digests to be salted. min_cosine: only pairs whose sketches (s0, s1) can have it."""
    words = [] if min_cosine is None else ["s0", "s1"]
    a = left.select(F.col("id").alias("id_l"), "digest", *[F.col(w).alias(f"{w}_l") for w in words])
    b = right.select(F.col("id").alias("id_r"), "digest", *[F.col(w).alias(f"{w}_r") for w in words])
    if hot:
        # Of a hot digest, every left row meets every right row: left rows are dealt to salts, right rows are copied to each.
        tasks = parallelism(left.sparkSession)
        is_hot = F.col("digest").isin(hot)  # at most four times as many as tasks and views
        a = a.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id_l"), F.lit(tasks))).otherwise(0))
        b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_hot, tasks - 1).otherwise(0).cast("long"))))
    joined = a.join(b, ["digest", "salt"] if hot else ["digest"])
    if words:
        # Short enough for the JVM to compile: sketches are never null, and each is taken apart once.
        joined = joined.filter(apart("s0_l", "s0_r") + apart("s1_l", "s1_r") <= farthest(min_cosine))
    shared = joined.groupBy("id_l", "id_r").agg((F.sum(F.shiftright("digest", 16).bitwiseAND(F.lit(63))) / F.first(F.col("digest").bitwiseAND(F.lit(0xFFFF)))).alias("overlap"))
    return shared.filter((F.col("overlap") > 0) & (F.col("overlap") >= min_fraction))


def _candidates(rows: DataFrame, n: int, min_cosine: float) -> DataFrame:
    """(rep_train, rep_eval) of pairs (of n rows id, g, train, v) that share a chunk of a view and may have at least min_cosine."""
    spark = rows.sparkSession
    at_once = max(1, min(VIEWS, VIEWS_AT_ONCE // max(1, n)))
    # A record has one chunk at most of each digest, so the share of a view's rows counts.
    hot = frequent(chunks(rows, "g", "v", ["id"], range(VIEWS)), "digest", parallelism(spark) * VIEWS)
    found = None
    for at in range(0, VIEWS, at_once):
        train, evaluation = (chunks(rows.filter(F.col("train") == t), "g", "v", ["id"], range(at, min(VIEWS, at + at_once))) for t in (True, False))
        near = stage(overlaps(train, evaluation, hot, MIN_OVERLAP, min_cosine).select(F.col("id_l").alias("rep_train"), F.col("id_r").alias("rep_eval")), "split-near", tidy=True)
        found = near if found is None else found.unionByName(near)
    return found.distinct()


def _with_overlap(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with the column overlap."""
    side = lambda n: vectors.select(F.col("id").alias(f"rep_{n}"), F.col("v").alias(f"_{n}"))
    columns = pairs.columns
    both = pairs.join(side("train"), "rep_train").join(side("eval"), "rep_eval").select(*columns, "_eval", F.col("_train").alias("_vector"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([*[part[c] for c in columns], pa.array(shared_length(x, matrix(part["_eval"])))], [*columns, "overlap"])

    return both.mapInArrow(measure, pairs.select("*").schema.add("overlap", "double"))


def cross_split_pairs(df: DataFrame, group: str, identity: str, vector: str, in_train: str, min_cosine: float, overlap: bool = True) -> DataFrame:
    """(id_train, id_eval, cosine, overlap) of every pair across the splits with at least min_cosine. in_train: BOOLEAN, null takes no part. overlap: whether that column is wanted."""
    with tidied(df.sparkSession):  # it counts lengths
        rows = usable(df.filter(F.col(in_train).isNotNull()), group, vector)
    rows = stage(with_digest(rows, vector).select(F.col(identity).alias("id"), F.col(group).alias("g"), F.col(in_train).alias("train"), "_same", F.col(vector).alias("v")), "split-rows", by="train", tidy=True)
    classes = stage(rows.groupBy("g", "train", "_same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "split-classes", tidy=True)
    # Copies but the first of each class, which are few or else leave few vectors, are put aside by identity: vectors are moved only if they are very many.
    several = small(classes.filter("n > 1").drop("n"), MANY_CLASSES)
    again = stage(rows.drop("v").join(several, ["g", "train", "_same"]).filter(F.col("id") != F.col("rep")).select("id"), "split-again", tidy=True)
    distinct = rows.join(small(again), "id", "left_anti")
    near = stage(_candidates(distinct, classes.count(), min_cosine), "split-candidates", tidy=True)
    # From here on only what is in a pair is moved.
    reps = stage(near.select(F.col("rep_train").alias("id")).union(near.select("rep_eval")).distinct(), "split-reps", tidy=True)
    vectors = stage(rows.select("id", "v").join(small(reps), "id", "left_semi"), "split-vectors", tidy=True)
    near = cosines(near, vectors, "id", "v", "rep_train", "rep_eval").filter(F.col("cosine") >= min_cosine)
    near = stage(_with_overlap(near, vectors) if overlap else near, "split-pairs", tidy=True)
    paired = stage(classes.join(small(reps.withColumnRenamed("id", "rep")), "rep", "left_semi"), "split-paired", tidy=True)
    own = rows.drop("v").join(small(paired.select("g", "train", "_same"), MANY_CLASSES), ["g", "train", "_same"], "left_semi").select("id", "g", "train", "_same")
    members, many = members_of(stage(own, "split-members", tidy=True), paired, ["g", "train"], "id")
    for t, name in ((True, "train"), (False, "eval")):
        side = members.filter(F.col("train") == t).select(F.col("rep").alias(f"rep_{name}"), F.col("id").alias(f"id_{name}"))
        near = lookup(side, near, f"rep_{name}", many.toDF(f"rep_{name}") if many else None, F.col(f"id_{name}"))
    return near.select("id_train", "id_eval", "cosine", *["overlap"] * overlap)


def feature_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_features_multi with in_train: by split, for cub200 by is_train of the image."""
    rows = spark.read.parquet(f"{sf_dir}/extract_features_multi.parquet").select("sample_id", "backbone", "dataset", "split", "img_id", "features")
    cub = spark.read.parquet(f"{sf_dir}/cub200.parquet").groupBy("img_id").agg(F.max("is_train").alias("is_train"))
    by_image = label("dataset") == "cub200"
    joined = rows.withColumn("img_id", F.when(by_image, F.col("img_id"))).join(cub, "img_id", "left")
    split = label("split")
    in_train = F.when(by_image, F.when(F.col("is_train").isin(0, 1), F.col("is_train") == 1)).when(split == "train", True).when(split.isin("test", "val"), False)
    return joined.select("sample_id", "backbone", "dataset", "split", in_train.alias("in_train"), "features")


MIN_COSINE = 0.985


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of vectors in training and evaluation that are the same or almost the same."""
    pairs = cross_split_pairs(feature_splits(spark, sf_dir), "backbone", "sample_id", "features", "in_train", MIN_COSINE, overlap=False)
    return pairs.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b"))


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_train, id_eval, cosine, overlap) of those pairs. overlap: the share of either record that lies in chunks that both hold."""
    pairs = cross_split_pairs(feature_splits(spark, sf_dir), "backbone", "sample_id", "features", "in_train", MIN_COSINE)
    return pairs.select("id_train", "id_eval", F.round("cosine", 6).alias("cosine"), F.round("overlap", 6).alias("overlap"))


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_train, id_eval, cosine, whole) of those pairs: whether the overlap is whole, for pairs of equal vectors; null for others."""
    rows = feature_splits(spark, sf_dir)
    pairs = cross_split_pairs(rows, "backbone", "sample_id", "features", "in_train", MIN_COSINE)
    same = with_digest(rows, "features").select("sample_id", "_same")
    side = lambda n: same.select(F.col("sample_id").alias(f"id_{n}"), F.col("_same").alias(f"_{n}"))
    both = pairs.join(side("train"), "id_train").join(side("eval"), "id_eval")
    return both.select("id_train", "id_eval", F.round("cosine", 6).alias("cosine"), F.when(F.col("_train") == F.col("_eval"), F.col("overlap") == 1.0).alias("whole"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, split, train_dataset, records, pairs, overlapping): evaluation records that occur in training, per dataset and split of theirs and dataset of the training record."""
    rows = feature_splits(spark, sf_dir)
    pairs = cross_split_pairs(rows, "backbone", "sample_id", "features", "in_train", MIN_COSINE, overlap=False)
    about = rows.select("sample_id", label("dataset").alias("dataset"), F.coalesce(label("split"), F.lit("by image")).alias("split"))
    both = pairs.join(about.withColumnRenamed("sample_id", "id_eval"), "id_eval").join(about.select(F.col("sample_id").alias("id_train"), F.col("dataset").alias("train_dataset")), "id_train")
    return both.groupBy("dataset", "split", "train_dataset").agg(F.count_distinct("id_eval").alias("records"), F.count(F.lit(1)).alias("pairs"), F.count(F.lit(1)).alias("overlapping"))  # every pair found shares a chunk


_PAIRS = """
WITH cub AS (SELECT img_id, max(is_train) AS is_train FROM cub200 GROUP BY img_id),
rows AS (SELECT e.sample_id AS id, e.backbone, lower(trim(e.dataset)) AS dataset, coalesce(lower(trim(e.split)), 'by image') AS split, e.features AS v, len(e.features) AS d, CASE WHEN lower(trim(e.dataset)) = 'cub200' THEN CASE WHEN c.is_train IN (0, 1) THEN c.is_train = 1 END WHEN lower(trim(e.split)) = 'train' THEN true WHEN lower(trim(e.split)) IN ('test', 'val') THEN false END AS in_train
  FROM extract_features_multi e LEFT JOIN cub c ON c.img_id = e.img_id WHERE e.features IS NOT NULL AND e.backbone IS NOT NULL),
usual AS (SELECT backbone, mode(d) AS d FROM rows WHERE in_train IS NOT NULL GROUP BY backbone),
good AS (SELECT id, backbone, dataset, split, in_train, CAST(v AS DOUBLE[]) AS v FROM rows JOIN usual USING (backbone, d) WHERE in_train IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.id AS id_train, b.id AS id_eval, a.dataset AS train_dataset, b.dataset, b.split, list_cosine_similarity(a.v, b.v) AS cosine, a.v = b.v AS same FROM good a JOIN good b ON a.backbone = b.backbone AND a.in_train AND NOT b.in_train AND list_cosine_similarity(a.v, b.v) >= 0.985)
"""
QUERIES = {"p5_found": p5_found, "p5_overlaps": p5_overlaps, "p5_copies": p5_copies, "p5_report": p5_report}
ORACLES = {
    "p5_found": _PAIRS + "SELECT least(id_train, id_eval) AS id_a, greatest(id_train, id_eval) AS id_b FROM pairs",
    "p5_copies": _PAIRS + "SELECT id_train, id_eval, round(cosine, 6) AS cosine, CASE WHEN same THEN true END AS whole FROM pairs",
    "p5_report": _PAIRS + "SELECT dataset, split, train_dataset, count(DISTINCT id_eval) AS records, count(*) AS pairs, count(*) AS overlapping FROM pairs GROUP BY ALL",
}
