"""Vectors that take part in comparisons, and exact copies among them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.skew import hot_table, lookup

#: Groups (backbones) that a collection may have; their lengths and counts are held on the driver.
MAX_GROUPS = 10_000


def usable(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Rows with a group whose vector is whole: no null, NaN or infinite element, not all zero, as long as most of its group."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col(group).isNotNull() & v.isNotNull())
    lengths = rows.groupBy(group, F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.groupBy(group).agg(F.max(F.struct("n", "d")).alias("m")).select(group, F.col("m.d").alias("d")).limit(MAX_GROUPS + 1).collect()
    if len(usual) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of vectors")
    want = F.lit(None).cast("int")
    if usual:
        want = F.create_map(*[x for r in usual for x in (F.lit(r[0]), F.lit(r[1]))])[F.col(group)]
    return rows.filter((F.size(v) == want) & finite)


def copies(df: DataFrame, keys: list[str], identity: str, vector: str) -> DataFrame:
    """(keys..., _same, rep, n): one row for each distinct vector; rep is its least identity, _same a 128-bit digest of it."""
    return with_digest(df, vector).groupBy(*keys, "_same").agg(F.min(identity).alias("rep"), F.count(F.lit(1)).alias("n"))


def with_digest(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_same", F.struct(F.xxhash64(vector).alias("a"), F.xxhash64(F.lit(17), F.reverse(vector)).alias("b")))


def members_of(rows: DataFrame, classes: DataFrame, keys: list[str], identity: str) -> tuple[DataFrame, DataFrame | None]:
    """rows with the rep of their class (and without keys and _same), and the reps of very many copies. classes: from copies, staged; a mass of copies is dealt to many tasks."""
    same = F.struct(*[F.col(k) for k in keys], "_same")
    table = classes.select(same.alias("_class"), "rep", "n")
    hot = hot_table(table, "_class", "n")
    reps = lookup(table.drop("n"), F.broadcast(hot), "_class", None, F.col("rep")).select("rep") if hot else None
    return lookup(rows.withColumn("_class", same), table.drop("n"), "_class", hot, F.col(identity)).drop("_class", "_same"), reps


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as rows of doubles scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(pairs: DataFrame, vectors: DataFrame, identity: str, vector: str, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """pairs with the column cosine, computed in doubles from the vectors of both sides."""
    side = lambda p, n: vectors.select(F.col(identity).alias(p), F.col(vector).alias(n))
    both = pairs.join(side(a, "_va"), a).join(side(b, "_vb"), b)
    columns = [f for f in both.schema.fields if f.name not in ("_va", "_vb")]

    def measure(batches):
        for t in batches:
            if not t.num_rows:
                continue
            # Pairs of groups with different lengths can share a batch.
            size = pa.compute.list_value_length(t["_va"]).to_numpy()
            out = np.empty(t.num_rows)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                out[at] = np.einsum("ij,ij->i", matrix(t["_va"].take(pa.array(at))), matrix(t["_vb"].take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*[t[f.name] for f in columns], pa.array(out)], [*[f.name for f in columns], "cosine"])

    schema = pairs.select(*[f.name for f in columns]).schema.add("cosine", "double")
    return both.select(*[f.name for f in columns], "_va", "_vb").mapInArrow(measure, schema)


def first_members(members: DataFrame, rep: str, identity: str, k: int) -> DataFrame:
    """The k least identities of each class, as an array."""
    nth = F.row_number().over(Window.partitionBy(rep).orderBy(identity))
    return members.withColumn("_nth", nth).filter(F.col("_nth") <= k).groupBy(rep).agg(F.sort_array(F.collect_list(identity)).alias("first"))
