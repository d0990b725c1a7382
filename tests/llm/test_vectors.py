import math
import time

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from lumenfold.llm import chunks, mih
from lumenfold.operators.skew import frequent

SCHEMA = "sample_id long, backbone string, dataset string, split string, img_id long, label int, features array<float>"
CUB = "img_id long, is_train int"


def near(rng, v, cosine):
    noise = rng.standard_normal(len(v))
    noise -= noise @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


def fixture(n=400, d=32, seed=0):
    """Vectors of two backbones with near and exact copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    out, i = [], 0

    def add(b, v, split="train", dataset="cifar100", img=None):
        nonlocal i
        i += 1
        out.append((i, b, dataset, split, img, 1, None if v is None else [float(x) for x in v]))

    for b, size in (("a", d), ("b", d + 8)):
        base = rng.standard_normal((n, size))
        for k, v in enumerate(base):
            add(b, v * rng.uniform(0.1, 9))
            if k % 5 == 0:
                add(b, near(rng, v, 0.995) * 3, " TEST ")
            if k % 7 == 0:
                add(b, near(rng, v, 0.95), "val")
        for _ in range(9):
            add(b, base[3], "val")
        add(b, base[3], "train")
        for v in (None, np.zeros(size), np.full(size, np.nan), base[0][: size // 2], np.full(size, np.inf)):
            add(b, v)
        add(b, base[1], None)
        add(b, near(rng, base[2], 0.99), None, " CUB200", 1)
        add(b, near(rng, base[2], 0.99), None, "cub200", 2)
        add(b, base[2], "test", "cub200", 77)
    add(None, np.ones(d))
    return out


def brute(data, min_cosine):
    good = {r[0]: r for r in data if r[1] and r[6] is not None and len(r[6]) == {"a": 32, "b": 40}[r[1]] and np.isfinite(r[6]).all() and any(r[6])}
    unit = {i: np.float32(r[6]).astype(float) / np.linalg.norm(np.float32(r[6]).astype(float)) for i, r in good.items()}
    return good, {(i, j): c for i in good for j in good if i != j and good[i][1] == good[j][1] and (c := unit[i] @ unit[j]) >= min_cosine}


def test_nearest_pairs(spark, tables):
    data = fixture()
    tables("extract_features_multi", data, SCHEMA)
    _, cos = brute(data, 0.9)
    want = set()
    for i in {a for a, _ in cos}:
        top = sorted(((-round(c, 12), j) for (a, j), c in cos.items() if a == i))[:5]
        want |= {(min(i, j), max(i, j)) for _, j in top}
    got = rows(mih.p4_found(spark, tables.dir))
    assert len(got) == len(set(got))
    # Equal vectors differ in the last bits of their cosine between engines, so ties among ten copies may fall otherwise.
    assert set(got) <= {(min(p), max(p)) for p in cos}
    assert len(want & set(got)) >= 0.98 * len(want)


def test_hot_values_are_complete(spark, tables):
    """A third of the vectors are almost equal: one substring value holds them, and they are compared in blocks."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(32) * 10
    data = [(i, "a", "c", "train", None, 1, [float(x) for x in (centre + rng.standard_normal(32) * 0.05 if i % 3 == 0 else rng.standard_normal(32))]) for i in range(900)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.id: [n.id for n in r.neighbours] for r in mih.nearest(df, "backbone", "sample_id", "features", 5, 0.9, hot_run=40).collect()}
    _, cos = brute(data, 0.9)
    hits = total = 0
    for i in range(0, 900, 3):
        best = [j for _, j in sorted((-c, j) for (a, j), c in cos.items() if a == i)[:5]]
        hits, total = hits + len(set(best) & set(got[i])), total + 5
    assert hits >= 0.99 * total


def test_recall_without_threshold(spark, tables):
    data = fixture(800)
    tables("extract_features_multi", data, SCHEMA)
    good, cos = brute(data, -1)
    got = {}
    df = mih.scan_nearest(spark.createDataFrame(data, SCHEMA), "backbone", "sample_id", "features", F.col("sample_id") % 20 == 0, 5, shortlist=256)
    for r in df.collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    hits = 0
    for i in got:
        hits += len(got[i] & {j for _, j in sorted((-round(c, 6), j) for (a, j), c in cos.items() if a == i)[:5]})
    assert set(got) == {i for i in good if i % 20 == 0} and hits >= 0.9 * 5 * len(got)


def test_scan_is_exact_in_a_cluster(spark, tables):
    """More near and exact copies than any fixed number of codes: neighbours, cosines and the order of ties are those of all pairs."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    x = rng.standard_normal((8000, 16))
    x[::4] = centre
    x[1::4] = [near(rng, centre, 0.999) for _ in range(2000)]
    x[2::8] = [near(rng, centre, 0.95) for _ in range(1000)]
    ids = [int(i) for i in rng.permutation(8000)]
    tables("extract_features_multi", [(i, "a", "c", "train", None, 1, [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], SCHEMA)
    unit = np.float32(x).astype(float)[np.argsort(ids)]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = set()
    for i in range(0, 8000, 20):
        c = np.round(unit @ unit[i], 6)
        want |= {(i, int(j), float(c[j]), n) for n, j in enumerate([j for j in np.lexsort((np.arange(8000), -c)) if j != i][:5], 1)}
    got = rows(mih.p4_knn(spark, tables.dir))
    assert len(got) == len(want) and set(got) == want


def test_index_retrieves_the_radius():
    """Every pair of codes within 2 * PARTS - 1 bits meets in a cell, whatever the number of cells."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, (60, mih.BITS)).astype(np.uint8)
    b = a.copy()
    for r in b:
        r[rng.choice(mih.BITS, 2 * mih.PARTS - 1, replace=False)] ^= 1
    codes = np.packbits(np.concatenate([a, b]), axis=1)
    subs = codes.view(">u2").astype(np.int64)
    for bits in (0, 3):
        pairs = set()
        for s in range(mih.PARTS):
            v = subs[:, s]
            entries = [(i, int(x), False, i) for i, x in enumerate(v)] + [(i, int(x) | 1 << t, True, i) for t in range(16 - bits, 16) for i, x in enumerate(v) if not x >> t & 1]
            for cell in {e[1] >> (16 - bits) for e in entries}:
                e = [x for x in entries if x[1] >> (16 - bits) == cell]
                t = pa.table({"id": pa.array([x[0] for x in e], pa.int64()), "cell": pa.array([cell] * len(e), pa.int64()), "value": pa.array([x[1] for x in e], pa.int32()), "probe": [x[2] for x in e], "code": pa.array([codes[x[3]].tobytes() for x in e], pa.binary())})
                out = mih._near_in_cell(mih.BITS, 10**9)(t)
                pairs |= set(zip(out["id_a"].to_pylist(), out["id_b"].to_pylist(), strict=True))
        assert all((i, i + 60) in pairs for i in range(60))


def test_cross_split_pairs(spark, tables):
    data = fixture()
    tables("extract_features_multi", data, SCHEMA)
    tables("cub200", [(1, 1), (2, 0), (2, 0), (None, 1)], CUB)
    good, cos = brute(data, 0.985)

    def in_train(r):
        if r[2].strip().lower() == "cub200":
            return {1: True, 2: False}.get(r[4])
        return {"train": True, "test": False, "val": False}.get((r[3] or "").strip().lower())

    want = {(i, j) for i, j in cos if i < j and None not in (in_train(good[i]), in_train(good[j])) and in_train(good[i]) != in_train(good[j])}
    got = rows(chunks.p5_found(spark, tables.dir))
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want)
    report = chunks.p5_report(spark, tables.dir).collect()
    assert sum(r.pairs for r in report) == sum(r.overlapping for r in report) == len(got)
    copies = rows(chunks.p5_copies(spark, tables.dir).filter("whole IS NOT NULL"))
    assert len(copies) >= 18 and all(c[3] and c[2] == 1 for c in copies)
    # The overlap of a pair is the length of the chunks that both records hold, over all of their length.
    some = chunks.p5_overlaps(spark, tables.dir).limit(40).collect()
    cut = {}
    for r in some:
        for i in (r.id_train, r.id_eval):
            x = np.float32([good[i][6]]).astype(float)
            _, digest, length = chunks.chunk_rows((x / np.linalg.norm(x) @ chunks.rotations(x.shape[1]) > 0).astype(np.uint8))
            cut[i] = dict(zip(digest, length, strict=True)), length.sum()
        (a, n), (b, m) = cut[r.id_train], cut[r.id_eval]
        assert n == m and abs(r.overlap - sum(a[k] for k in a.keys() & b.keys()) / n) < 1e-6


def test_pairs_that_share_little(spark, tables):
    rng = np.random.default_rng(6)
    data = []
    for i in range(1500):
        v = rng.standard_normal(64)
        data += [(2 * i, "a", "c", "train", None, 1, [float(x) for x in v]), (2 * i + 1, "a", "c", "test", None, 1, [float(x) for x in near(rng, v, 0.9851)])]
    tables("extract_features_multi", data, SCHEMA)
    tables("cub200", [], CUB)
    got = set(rows(chunks.p5_found(spark, tables.dir)))
    assert len(got & {(2 * i, 2 * i + 1) for i in range(1500)}) >= 1497


def _spread(n, pairs, seed=12):
    """n vectors of each split, the first pairs of which are nearly the same."""
    rng = np.random.default_rng(seed)
    train, other = rng.standard_normal((n, 64)), rng.standard_normal((n, 64))
    for i in range(pairs):
        other[i] = near(rng, train[i], 0.986)
    return [(2 * i + t, "a", "c", ("train", "test")[t], None, 1, [float(x) for x in v]) for t, side in enumerate((train, other)) for i, v in enumerate(side)]


def test_chance_pairs_are_not_moved(spark, tables, monkeypatch):
    """Records that share a chunk by chance, here some 1,000 pairs and growing with the square, end in the join of digests; no shuffle file stays."""
    tables("extract_features_multi", _spread(2000, 40), SCHEMA)
    tables("cub200", [], CUB)
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    handed, before = [], files()
    measure = chunks.cosines
    monkeypatch.setattr(chunks, "cosines", lambda pairs, *a: handed.append(pairs.count()) or measure(pairs, *a))
    found = chunks.p5_found(spark, tables.dir)
    assert 40 <= handed[0] <= 60
    for _ in range(50):
        if not (left := sum(f.endswith(".data") for f in files() - before)):
            break
        time.sleep(0.2)
    assert left <= 8  # of the counts that are not staged
    assert set(rows(found)) == {(2 * i, 2 * i + 1) for i in range(40)}


def test_passes_give_the_same_pairs(spark, tables, monkeypatch):
    tables("extract_features_multi", _spread(300, 100), SCHEMA)
    tables("cub200", [], CUB)
    whole = sorted(rows(chunks.p5_found(spark, tables.dir)))
    assert whole == [(2 * i, 2 * i + 1) for i in range(100)]
    for at_once in (1, 600 * 4):  # a view in each pass; four, four and two
        monkeypatch.setattr(chunks, "VIEWS_AT_ONCE", at_once)
        assert sorted(rows(chunks.p5_found(spark, tables.dir))) == whole


def test_sketches_bound_the_distance(spark):
    rng = np.random.default_rng(5)
    for d in (3, 16, 64):
        a = rng.standard_normal((400, d)) * rng.choice([1.0, 9.0], (400, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = np.array([near(rng, v, 0.985) for v in a])
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        turn = chunks.rotations(d, 1)[:, : chunks.SKETCH]
        x, y = chunks.sketches(a, turn), chunks.sketches(b, turn)
        step = ((x.view(np.int8).astype(int) - y.view(np.int8)) ** 2).sum(axis=1)
        assert step.max() <= chunks.farthest(0.985)
        both = spark.createDataFrame(np.concatenate([x, y], axis=1).tolist(), "a0 long, a1 long, b0 long, b1 long")
        assert [r[0] for r in both.select(chunks.apart("a0", "b0") + chunks.apart("a1", "b1")).collect()] == step.tolist()


def test_chunks_cover_the_record():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2, (50, 200)).astype(np.uint8)
    row, digest, length = chunks.chunk_rows(symbols)
    assert all(length[row == i].sum() == 200 for i in range(50)) and length.max() < chunks.MAX + chunks.MIN < 64 and length.min() >= chunks.MIN
    assert [chunks.chunk_rows(symbols[:, :n])[2][0] for n in (1, 5, 13)] == [1, 5, 13]
    changed = symbols.copy()
    changed[:, 100] ^= 1
    again = chunks.chunk_rows(changed)
    shared = [len(set(digest[row == i]) & set(again[1][again[0] == i])) / (row == i).sum() for i in range(50)]
    assert np.mean(shared) > 0.5 and max(shared) < 1


def test_mass_of_copies(spark, tables):
    """A third of the vectors are copies of one in both splits: its pairs come out whole, each vector with its k least copies as neighbours."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((401, 32))
    data = [(i, "a", "c", "train" if i % 3 else "test", None, 1, [float(x) for x in (base[400] if i < 200 else base[i - 200])]) for i in range(600)]
    tables("extract_features_multi", data, SCHEMA)
    tables("cub200", [], CUB)
    got = set(rows(chunks.p5_found(spark, tables.dir)))
    assert got == {(min(i, j), max(i, j)) for i in range(200) for j in range(200) if i % 3 and not j % 3}
    found = set(rows(mih.p4_found(spark, tables.dir)))
    first = lambda i: [j for j in range(7) if j != i][:5]
    assert found == {(min(i, j), max(i, j)) for i in range(200) for j in first(i)}


def test_hot_chunk_is_salted(spark):
    key = lambda h: (h << 22) | (10 << 16) | 100
    left = spark.createDataFrame([(i, key(1 if i < 3000 else i)) for i in range(6000)], "id long, digest long")
    right = spark.createDataFrame([(i + 10_000, key(1)) for i in range(5)] + [(20_000, key(4000))], "id long, digest long")
    hot = frequent(left, "digest", 4)
    assert hot == [key(1)]
    got = chunks.overlaps(left, right, hot)
    assert got.count() == 3000 * 5 + 1 and got.select("overlap").distinct().collect()[0][0] == 0.1


def test_empty_tables(spark, tables):
    tables("extract_features_multi", [], SCHEMA)
    tables("cub200", [], CUB)
    for f in (mih.p4_found, mih.p4_knn, chunks.p5_found, chunks.p5_report):
        assert rows(f(spark, tables.dir)) == []
    tables("extract_features_multi", [(1, "a", "c", "train", None, 1, None), (2, "a", "c", "train", None, 1, [])], SCHEMA)
    for f in (mih.p4_found, mih.p4_knn, chunks.p5_found):
        assert rows(f(spark, tables.dir)) == []
