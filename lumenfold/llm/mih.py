"""The k most similar vectors of every vector, by multi-index hashing.

For each group a rotation is learned on a bounded sample (iterative quantisation: the rotation under which signs distort the
vectors least), several times from different starts, and every vector becomes a code of BITS signs. The code is split into
substrings of SUB bits, each indexed on its own: cells are the leading bits of a substring, sized to the group, and a row goes
to the cell of its own substring and, as a probe, to the cells that one flipped leading bit leads to. Within a cell every
substring is looked up with up to one bit flipped, so by the pigeonhole principle every pair of codes within Hamming distance
2 * BITS / SUB - 1 is retrieved, and most pairs well beyond. Retrieved pairs within the distance that the wanted cosine makes
likely (its mean and four deviations) are reranked with the floats.

Exact copies are represented by one vector and restored at the end. A substring value that very many vectors share is not
paired up: its vectors and those one bit away are compared in blocks, each keeping the k best of every vector.

Defined results: vectors that vectors.usable leaves out have no neighbours; equal cosines are ordered by identity; a vector
with fewer than k others that reach min_cosine has fewer neighbours; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.vectors import copies, cosines, first_members, matrix, members_of, usable, with_digest
from lumenfold.operators.skew import frequent, lookup, small
from lumenfold.session import parallelism, stage

BITS, SUB = 192, 16
PARTS = BITS // SUB
#: Vectors per group that the rotations are learned on.
SAMPLE = 4096
ROUNDS = 15
#: Vectors that a cell should hold.
CELL_ROWS = 32_768
#: A substring value of more vectors is compared in blocks of this size.
HOT_RUN = 2_048
#: Groups whose rotations (up to 150 kB each) are shipped to the tasks.
MAX_GROUPS = 1000
SEED = 5


def learn_rotation(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of unit vectors x: bits columns from independently started rotations."""
    mean = x.mean(axis=0)
    x, d, turns = x - mean, x.shape[1], []
    for start in range(ceil(bits / d)):
        r = np.linalg.qr(np.random.default_rng([SEED, start, d]).standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        turns.append(r)
    return mean, np.concatenate(turns, axis=1)[:, :bits]


def learn(vectors: DataFrame) -> dict[str, tuple[int, int, np.ndarray, np.ndarray]]:
    """group -> (number, rows, mean, projection), from SAMPLE vectors of each group, chosen by a hash of their ids."""
    sizes = {r.g: r["count"] for r in vectors.groupBy("g").count().limit(MAX_GROUPS + 1).collect()}
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of vectors")
    nth = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("id"), "id"))
    sample = vectors.withColumn("_nth", nth).filter(F.col("_nth") <= SAMPLE).select("g", "v")

    def fit(t: pa.Table) -> pa.Table:
        mean, turn = learn_rotation(matrix(t["v"].combine_chunks()))
        return pa.table({"g": t["g"][:1], "mean": pa.array([mean.tobytes()], pa.binary()), "turn": pa.array([turn.tobytes()], pa.binary())})

    fitted = sample.groupBy("g").applyInArrow(fit, "g string, mean binary, turn binary").collect()
    out = {}
    for i, r in enumerate(sorted(fitted, key=lambda r: r.g)):
        mean = np.frombuffer(r.mean)
        out[r.g] = (i, sizes[r.g], mean, np.frombuffer(r.turn).reshape(len(mean), -1))
    return out


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(n, BITS / 8) bytes: the codes of unit vectors."""
    return np.packbits((x - mean) @ turn > 0, axis=1)


def cell_bits(n: int) -> int:
    return min(SUB, max(0, ceil(log2(max(1, n) / CELL_ROWS))))


def distance_bound(min_cosine: float) -> int:
    p = acos(min_cosine) / pi
    return ceil(BITS * p + 4 * sqrt(BITS * p * (1 - p)))


_CELLS = "id long, cell long, value int, probe boolean, code binary"


def values(vectors: DataFrame, model: dict) -> DataFrame:
    """(key) of every substring of every vector: group, part and value in one number."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b["g"].to_pylist(), object)
            for g in set(names):
                number, _, mean, turn = model[g]
                subs = encode(matrix(b["v"].take(pa.array(np.flatnonzero(names == g)))), mean, turn).view(">u2").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((((number * PARTS + np.arange(PARTS)) << SUB) | subs).reshape(-1))], ["key"])

    return vectors.select("g", "v").mapInArrow(keys, "key long")


def index(vectors: DataFrame, model: dict, hot: list[int] | None = None) -> DataFrame:
    """The entries of all vectors (id, g, v): one for each substring in its own cell, and the probes that lead to other cells; none for substrings whose key is hot."""
    skip = np.array(sorted(hot or []), np.int64)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                names = np.array(b["g"].to_pylist(), object)
                for g in set(names):
                    number, n, mean, turn = model[g]
                    part = b.take(pa.array(np.flatnonzero(names == g)))
                    codes = encode(matrix(part["v"]), mean, turn)
                    subs = np.ascontiguousarray(codes).view(">u2").astype(np.int64)
                    bits = cell_bits(n)
                    where = np.repeat(np.arange(len(codes)), PARTS)
                    s, value = np.tile(np.arange(PARTS), len(codes)), subs.reshape(-1)
                    if len(skip):
                        cold = ~np.isin(((number * PARTS + s) << SUB) | value, skip)
                        where, s, value = where[cold], s[cold], value[cold]
                    rows, targets, parts, probes = [where], [value], [s], [np.zeros(len(where), bool)]
                    for t in range(SUB - bits, SUB):
                        # A pair that differs in a leading bit is found from the side where the bit is 0.
                        zero = (value >> t) & 1 == 0
                        rows.append(where[zero]), targets.append(value[zero] | (1 << t)), parts.append(s[zero]), probes.append(np.ones(zero.sum(), bool))
                    row, value, s = np.concatenate(rows), np.concatenate(targets), np.concatenate(parts)
                    cell = ((number * PARTS + s) << SUB) | (value >> (SUB - bits))
                    blob = pa.array([c.tobytes() for c in codes], pa.binary())
                    at_row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part["id"].take(at_row), pa.array(cell), pa.array(value.astype(np.int32)), pa.array(np.concatenate(probes)), blob.take(at_row)], ["id", "cell", "value", "probe", "code"])

    return vectors.select("id", "g", "v").mapInArrow(entries, _CELLS)


def _near_in_cell(radius: int, hot_run: int):
    def near(t: pa.Table) -> pa.Table:
        ids, value, probe = t["id"].to_numpy(), t["value"].to_numpy().astype(np.int64), t["probe"].to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        own = np.flatnonzero(~probe)
        own = own[np.argsort(value[own], kind="stable")]
        v = value[own]
        first, last = np.searchsorted(v, v, "left"), np.searchsorted(v, v, "right")
        hot = last - first > hot_run
        out_a, out_b = [], []

        def look(source: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            n = hi - lo
            some = np.flatnonzero(n > 0)
            upto = np.cumsum(n[some])
            start = 0
            while start < len(some):
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + 2_000_000, "right")))
                rows = some[start:stop]
                many = n[rows]
                a = np.repeat(source[rows], many)
                b = own[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[rows], many)]
                close = np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1, dtype=np.int64) <= radius
                a, b = ids[a[close]], ids[b[close]]
                out_a.append(np.minimum(a, b)), out_b.append(np.maximum(a, b))
                start = stop

        cold = ~hot
        look(own[cold], np.arange(len(own))[cold] + 1, last[cold])
        sources = [(own[cold & ((v >> t) & 1 == 0)], v[cold & ((v >> t) & 1 == 0)] | (1 << t)) for t in range(SUB)]
        # Flips of leading bits leave the cell; there they are probes, here they find nothing.
        sources.append((np.flatnonzero(probe), value[probe]))
        for source, target in sources:
            lo, hi = np.searchsorted(v, target, "left"), np.searchsorted(v, target, "right")
            look(source, lo, np.where(hi - lo > hot_run, lo, hi))
        marks = np.unique(v[hot])
        a = np.concatenate([*out_a, np.full(len(marks), -1, np.int64)]).astype(np.int64)
        b = np.concatenate([*out_b, marks]).astype(np.int64)
        part = np.full(len(a), -1, np.int64)
        part[len(a) - len(marks) :] = t["cell"][0].as_py() >> SUB
        return pa.table({"id_a": a, "id_b": b, "part": part})

    return near


def _best_in_block(k: int, min_cosine: float):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r = left["id"].to_numpy(), right["id"].to_numpy()
        out: list[tuple] = []
        if len(q) and len(r):
            x, y = matrix(left["v"].combine_chunks()), matrix(right["v"].combine_chunks())
            for at in range(0, len(q), 512):
                c = x[at : at + 512] @ y.T
                c[q[at : at + 512, None] == r[None, :]] = -2
                take = np.argpartition(-c, min(k, len(r) - 1), axis=1)[:, :k]
                value = np.take_along_axis(c, take, axis=1)
                i, j = np.nonzero(value >= min_cosine)
                out.append((q[at + i], r[take[i, j]]))
        a = np.concatenate([o[0] for o in out]) if out else np.empty(0, np.int64)
        b = np.concatenate([o[1] for o in out]) if out else np.empty(0, np.int64)
        return pa.table({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b)})

    return best


def candidates(vectors: DataFrame, model: dict, k: int, min_cosine: float, hot_run: int = HOT_RUN) -> DataFrame:
    """Distinct pairs (id_a, id_b) of vectors (id, g, v) that hold, for every vector, the k best others that the index retrieves."""
    # Values that hold much of all entries are known beforehand, so no cell is grown by one; smaller ones show in their cell.
    known = frequent(values(vectors, model), "key", parallelism(vectors.sparkSession), hot_run)
    entries = index(vectors, model, known)
    found = stage(entries.groupBy("cell").applyInArrow(_near_in_cell(distance_bound(min_cosine), hot_run), "id_a long, id_b long, part long"), "mih-pairs")
    pairs = found.filter("part < 0").select("id_a", "id_b").distinct()
    marks = found.filter("part >= 0").select(F.col("id_b").cast("int").alias("hot"), "part")
    if known:
        marks = marks.unionByName(vectors.sparkSession.createDataFrame([(k & ((1 << SUB) - 1), k >> SUB) for k in known], "hot int, part long"))
    if not marks.head(1):
        return pairs
    # Values of very many vectors: these and the vectors one bit away, in blocks of queries against blocks of rows.
    spread = marks.select("part", "hot", F.explode(F.concat(F.array(F.col("hot")), F.transform(F.sequence(F.lit(0), F.lit(SUB - 1)), lambda t: F.col("hot").bitwiseXOR(F.call_function("shiftleft", F.lit(1), t))))).alias("value"))
    members = index(vectors, model).filter("NOT probe").select("id", F.shiftright("cell", SUB).alias("part"), "value").join(spread, ["part", "value"]).select("id", "part", "hot")
    members = stage(members.join(vectors.select("id", "v"), "id"), "mih-hot")
    blocks = members.groupBy("part", "hot").agg(F.ceil(F.count(F.lit(1)) / hot_run).cast("int").alias("blocks"))
    dealt = members.join(small(blocks), ["part", "hot"])
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    queries = dealt.withColumn("i", block).withColumn("j", every).groupBy("part", "hot", "i", "j")
    again = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])
    rows = again.withColumn("j", block).withColumn("i", every).groupBy("part", "hot", "i", "j")
    hot_pairs = queries.cogroup(rows).applyInArrow(_best_in_block(k, min_cosine), "id_a long, id_b long")
    return pairs.unionByName(hot_pairs).distinct()


def nearest(df: DataFrame, group: str, identity: str, vector: str, k: int, min_cosine: float, hot_run: int = HOT_RUN) -> DataFrame:
    """(id, neighbours ARRAY<STRUCT<cosine, id>>) of every vector that has others of its group with at least min_cosine: the k best, best first."""
    rows = with_digest(usable(df, group, vector), vector).select(F.col(identity).alias("id"), F.col(group).cast("string").alias("g"), "_same", F.col(vector).alias("v"))
    rows = stage(rows, "mih-rows")
    classes = stage(copies(rows.drop("_same"), ["g"], "id", "v"), "mih-classes")
    distinct = stage(rows.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "g", "v"), "mih-distinct")
    model = learn(distinct)
    pairs = stage(cosines(candidates(distinct, model, k, min_cosine, hot_run), distinct, "id", "v").filter(F.col("cosine") >= min_cosine), "mih-reranked")
    return stage(with_copies(rows, classes, pairs, k), "mih-neighbours")


def with_copies(rows: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Neighbours of all rows (id, g, _same) from pairs of representatives: copies of a vector count as neighbours with a cosine of 1, those of its neighbours as the neighbours themselves."""
    members, many = members_of(rows.select("id", "g", "_same"), classes, ["g"], "id")
    members = stage(members.select("id", "rep"), "mih-members")
    first = first_members(members, "rep", "id", k + 1)
    both = pairs.select(F.col("id_a").alias("rep"), F.col("id_b").alias("of"), "cosine").unionByName(pairs.select(F.col("id_b").alias("rep"), F.col("id_a").alias("of"), "cosine"))
    itself = classes.filter("n > 1").select("rep", F.col("rep").alias("of"), F.lit(1.0).alias("cosine"))
    offers = both.unionByName(itself).join(first.withColumnRenamed("rep", "of"), "of").select("rep", F.round("cosine", 12).alias("c"), F.explode("first").alias("o"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("c"), "o"))
    # One row per representative with at most 2 k + 2 offers: enough for each of its copies.
    best = offers.withColumn("_nth", nth).filter(F.col("_nth") <= 2 * k + 2).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("_nth", F.col("c").alias("cosine"), F.col("o").alias("id")))).alias("offers"))
    joined = lookup(members, best, "rep", many, F.col("id"))
    others = F.slice(F.filter("offers", lambda o: o["id"] != F.col("id")), 1, k)
    return joined.select("id", F.transform(others, lambda o: F.struct(o["cosine"].alias("cosine"), o["id"].alias("id"))).alias("neighbours"))


K, MIN_COSINE = 5, 0.90
#: Rows of a block that meet a batch of queries in one matrix product. All rows do, so it bounds memory, not the result.
SHORTLIST = 2048
SCAN_ROWS = 65_536
SCAN_LEAST = 4_096
SCAN_QUERIES = 512


def _scan(k: int, shortlist: int):
    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r = left["id"].to_numpy(), right["id"].to_numpy()
        ids, others, cosine = [], [], []
        if len(q) and len(r):
            # In order of id, a later row never displaces one of equal cosine.
            order = np.argsort(r)
            x, y, r = matrix(left["v"].combine_chunks()), matrix(right["v"].combine_chunks())[order], r[order]
            for at in range(0, len(q), SCAN_QUERIES):
                part, own = x[at : at + SCAN_QUERIES], q[at : at + SCAN_QUERIES]
                rows = np.arange(len(part))
                i, o, c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                # The k-th best so far, rounded; nothing below -1 - 1e-6 exists.
                worst = np.full(len(part), -2.0)
                for p in range(0, len(r), shortlist):
                    s = part @ y[p : p + shortlist].T
                    least = worst
                    if not p and s.shape[1] > k:
                        # The query itself may be among the k + 1.
                        least = np.round(np.partition(s, -k - 1, axis=1)[:, -k - 1], 6) - 1e-6
                    a, b = np.nonzero(s > (least - 1e-6)[:, None])
                    value, other = np.round(s[a, b], 6), r[p + b]
                    better = (value > least[a]) & (other != own[a])
                    if not better.any():
                        continue
                    i, o, c = np.concatenate([i, a[better]]), np.concatenate([o, other[better]]), np.concatenate([c, value[better]])
                    best = np.lexsort((o, -c, i))
                    i, o, c = i[best], o[best], c[best]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, o, c = i[keep], o[keep], c[keep]
                    last = np.searchsorted(i, rows, "right")
                    full = last - np.searchsorted(i, rows) == k
                    worst = np.where(full, c[last - 1], -2.0)
                ids.append(own[i]), others.append(o), cosine.append(c)
        cat = lambda parts, t: np.concatenate(parts) if parts else np.empty(0, t)
        return pa.table({"id": cat(ids, np.int64), "neighbour_id": cat(others, np.int64), "cosine": cat(cosine, np.float64)})

    return scan


def scan_nearest(df: DataFrame, group: str, identity: str, vector: str, is_query, k: int, shortlist: int = SHORTLIST) -> DataFrame:
    """(id, neighbour_id, cosine, rank_no) of the k most similar vectors of the stated queries, however far: every query meets the floats of all vectors of its group, so the result is exact."""
    rows = stage(usable(df, group, vector).select(F.col(identity).alias("id"), F.col(group).cast("string").alias("g"), F.col(vector).alias("v"), is_query.alias("q")), "scan-rows")
    sizes = rows.groupBy("g").count().limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of vectors")
    # Blocks are smaller where there would be fewer of them than tasks.
    size = min(SCAN_ROWS, max(SCAN_LEAST, ceil(sum(r["count"] for r in sizes) / (2 * parallelism(df.sparkSession)))))
    blocks = {r.g: ceil(r["count"] / size) for r in sizes} or {"": 1}
    n_blocks = F.create_map(*[x for g, n in blocks.items() for x in (F.lit(g), F.lit(n))])[F.col("g")]
    index_rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    # The queries meet every block, and every vector is in one.
    queries = rows.filter("q").withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    found = queries.groupBy("g", "block").cogroup(index_rows.groupBy("g", "block")).applyInArrow(_scan(k, shortlist), "id long, neighbour_id long, cosine double")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour_id"))
    return found.withColumn("rank_no", nth).filter(F.col("rank_no") <= k)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/extract_features_multi.parquet").select("sample_id", "backbone", "features")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of vectors of one backbone of which one is among the 5 most similar of the other, with a cosine of at least 0.90."""
    near = nearest(_features(spark, sf_dir), "backbone", "sample_id", "features", K, MIN_COSINE).select("id", F.explode(F.col("neighbours.id")).alias("o"))
    return near.select(F.least("id", "o").alias("id_a"), F.greatest("id", "o").alias("id_b")).distinct()


def p4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every vector whose sample_id is divisible by 20, however similar."""
    return scan_nearest(_features(spark, sf_dir), "backbone", "sample_id", "features", F.col("sample_id") % 20 == 0, K)


_GOOD = """
WITH usual AS (SELECT backbone, mode(len(features)) AS d FROM extract_features_multi WHERE features IS NOT NULL GROUP BY backbone),
good AS (SELECT sample_id AS id, e.backbone, CAST(features AS DOUBLE[]) AS v FROM extract_features_multi e JOIN usual u ON e.backbone = u.backbone AND len(features) = u.d
  WHERE len(list_filter(features, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(features, lambda x: x <> 0)) > 0),
"""
QUERIES = {"p4_found": p4_found, "p4_knn": p4_knn}
ORACLES = {
    "p4_found": _GOOD
    + """near AS (SELECT a.id, b.id AS o, list_cosine_similarity(a.v, b.v) AS c FROM good a JOIN good b ON a.backbone = b.backbone AND a.id <> b.id),
top AS (SELECT * FROM near WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(c, 12) DESC, o) <= 5)
SELECT DISTINCT least(id, o) AS id_a, greatest(id, o) AS id_b FROM top""",
    "p4_knn": _GOOD
    + """near AS (SELECT a.id, b.id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM good a JOIN good b ON a.backbone = b.backbone AND a.id <> b.id WHERE a.id % 20 = 0)
SELECT id, neighbour_id, cosine, CAST(row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour_id) AS INTEGER) AS rank_no FROM near QUALIFY rank_no <= 5""",
}
