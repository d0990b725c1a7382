"""Queries on labelled vectors: statistics, scatter, graphs, samples, reducers and classifiers; and their SQL where it can say them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import linalg as la
from lumenfold.functions.labels import label as tidy
from lumenfold.functions.stats import half_up, half_up_sql
from lumenfold.operators import classify, experiments, graph, sampling
from lumenfold.operators import results as results_op
from lumenfold.operators.moments import fourth_moment, moments
from lumenfold.operators.reducers import Reducer, class_pairs, project
from lumenfold.operators.skew import small
from lumenfold.session import stage, stage_path
from lumenfold.sources import features as src

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = half_up_sql(sql)
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").alias("features"))


def _moments(spark, sf_dir):
    return moments(vectors(spark, sf_dir), "features", "label")


def _upper(spark: SparkSession, s: np.ndarray) -> DataFrame:
    """(i, j, v) of the upper triangle of a D x D matrix."""
    i, j = np.triu_indices(len(s))
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), s[i, j].tolist(), strict=True)), "i int, j int, v double").select("i", "j", half_up("v", 9).alias("v"))


_X = "x AS (SELECT vec_id AS id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_STAT = _X + ", s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM x GROUP BY i), cm AS (SELECT label, i, avg(v) AS m, count(*) AS n FROM x GROUP BY ALL)"
_PROD = _STAT + ", g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS g, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND a.i <= b.i GROUP BY ALL), cc AS (SELECT a.i, b.i AS j, sum(a.n * a.m * b.m) AS c FROM cm a JOIN cm b ON a.label = b.label AND a.i <= b.i GROUP BY ALL)"


@query(f"WITH {_X} SELECT CAST(i AS INTEGER) AS dim, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std_pop, round(stddev_samp(v), 9) AS std_samp, round(min(v), 9) AS low, round(max(v), 9) AS high FROM x GROUP BY i")
def feature_stats(spark, sf_dir):
    long = vectors(spark, sf_dir).select(F.posexplode("features").alias("dim", "f")).withColumn("v", F.col("f").cast("double"))
    return long.groupBy("dim").agg(half_up(F.avg("v"), 9).alias("mean"), half_up(F.stddev_pop("v"), 9).alias("std_pop"), half_up(F.stddev_samp("v"), 9).alias("std_samp"), half_up(F.min("v"), 9).alias("low"), half_up(F.max("v"), 9).alias("high"))


@query(f"WITH {_STAT} SELECT id AS sample_id, CAST(i AS INTEGER) AS dim, round((v - m) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END, 7) AS z FROM x JOIN s USING (i)")
def standardized_values(spark, sf_dir):
    df = vectors(spark, sf_dir)
    scaled = classify.standardize(df, "features", "label", "z")(df)
    return scaled.select("sample_id", F.posexplode("z").alias("dim", "z")).withColumn("z", half_up("z", 7))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STAT} SELECT label, CAST(i AS INTEGER) AS dim, round(m, 9) AS mean FROM cm")
def class_means(spark, sf_dir):
    m = _moments(spark, sf_dir)
    rows = [(int(c), i, float(v)) for c, means in zip(m.labels, m.class_means, strict=True) for i, v in enumerate(means)]
    return spark.createDataFrame(rows, "label int, dim int, mean double").withColumn("mean", half_up("mean", 9))


@query(f"WITH {_X}, w AS (SELECT label, i, sum(v * (1 + id % 3)) / sum(1 + id % 3) AS mean, CAST(sum(1 + id % 3) AS DOUBLE) AS weight FROM x GROUP BY ALL) SELECT label, CAST(i AS INTEGER) AS dim, round(mean, 9) AS mean, weight FROM w")
def class_weighted_means(spark, sf_dir):
    """Means under the weights 1 + id mod 3."""
    m = moments(vectors(spark, sf_dir).withColumn("w", 1 + F.col("sample_id") % 3), "features", "label", "w")
    rows = [(int(c), i, float(v), float(n)) for c, means, n in zip(m.labels, m.class_means, m.counts, strict=True) for i, v in enumerate(means)]
    return spark.createDataFrame(rows, "label int, dim int, mean double, weight double").withColumn("mean", half_up("mean", 9))


_IJ = "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round("


@query(f"WITH {_PROD} {_IJ}(g.g - c) / g.n, 9) AS v FROM g JOIN cc USING (i, j)")
def scatter_within(spark, sf_dir):
    return _upper(spark, _moments(spark, sf_dir).within)


@query(f"WITH {_PROD}, ss AS (SELECT a.i, b.i AS j, a.m * b.m AS mm FROM s a JOIN s b ON a.i <= b.i) {_IJ}c / g.n - mm, 9) AS v FROM g JOIN cc USING (i, j) JOIN ss USING (i, j)")
def scatter_between(spark, sf_dir):
    return _upper(spark, _moments(spark, sf_dir).between)


@query(f"WITH {_PROD}, ss AS (SELECT a.i, b.i AS j, a.m * b.m AS mm FROM s a JOIN s b ON a.i <= b.i) {_IJ}g.g / g.n - mm, 9) AS v FROM g JOIN ss USING (i, j)")
def scatter_total(spark, sf_dir):
    return _upper(spark, _moments(spark, sf_dir).total)


@query(f"WITH {_PROD} SELECT round(sum((g.g - c) / g.n), 9) AS trace_within, round(sum(c / g.n - m * m), 9) AS trace_between FROM g JOIN cc USING (i, j) JOIN s USING (i) WHERE g.i = g.j")
def scatter_trace(spark, sf_dir):
    m = _moments(spark, sf_dir)
    return spark.createDataFrame([(float(np.trace(m.within)), float(np.trace(m.between)))], "a double, b double").select(half_up("a", 9).alias("trace_within"), half_up("b", 9).alias("trace_between"))


@query(f"""WITH {_PROD}, sw AS (SELECT i, j, (g.g - c) / g.n AS v, g.n FROM g JOIN cc USING (i, j)),
sizes AS (SELECT sum(CASE WHEN i = j THEN v END) AS tr, sum(CASE WHEN i = j THEN v * v ELSE 2 * v * v END) AS norm, max(n) AS n, count(*) FILTER (i = j) AS p FROM sw),
q AS (SELECT sum(sq * sq) AS q FROM (SELECT id, sum((v - m) * (v - m)) AS sq FROM x JOIN cm USING (label, i) GROUP BY id)),
d AS (SELECT (norm - tr * tr / p) / p AS delta, (q / n - norm) / (p * n) AS beta FROM sizes, q)
SELECT round(CASE WHEN beta <= 0 OR delta <= 0 THEN 0 ELSE least(beta, delta) / delta END, 9) AS alpha FROM d""")
def shrinkage_alpha(spark, sf_dir):
    """Ledoit-Wolf intensity of the class-centred rows."""
    df = vectors(spark, sf_dir)
    m = moments(df, "features", "label")
    return spark.createDataFrame([(la.ledoit_wolf(m.within, m.n, fourth_moment(df, "features", "label", m)),)], "alpha double").select(half_up("alpha", 9).alias("alpha"))


# Two features and two classes: every eigenproblem has a closed form, which the SQL states.
def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample_id"), F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("features"), F.col("l_linestatus").alias("label"))


_P = """p AS (SELECT l_orderkey, l_linenumber, l_linestatus AS c, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
t AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d, count(*) AS n FROM p),
k AS (SELECT c, avg(x) AS mx, avg(y) AS my, count(*) AS n, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d FROM p GROUP BY c),
w AS (SELECT sum(n * a) / sum(n) AS a, sum(n * b) / sum(n) AS b, sum(n * d) / sum(n) AS d, max(CASE WHEN c = 'O' THEN mx END) - max(CASE WHEN c = 'F' THEN mx END) AS ux, max(CASE WHEN c = 'O' THEN my END) - max(CASE WHEN c = 'F' THEN my END) AS uy FROM k)"""
_UNIT = "f AS (SELECT fx / sqrt(fx * fx + fy * fy) * CASE WHEN abs(fx) >= abs(fy) THEN sign(fx) ELSE sign(fy) END AS fx, fy / sqrt(fx * fx + fy * fy) * CASE WHEN abs(fx) >= abs(fy) THEN sign(fx) ELSE sign(fy) END AS fy FROM f0)"
_FISHER = _P + ", f0 AS (SELECT d * ux - b * uy AS fx, a * uy - b * ux AS fy FROM w), " + _UNIT
_PCA2 = _P + ", e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l FROM t), f0 AS (SELECT b AS fx, l - a AS fy FROM e), " + _UNIT


def _direction(spark: SparkSession, w: np.ndarray) -> DataFrame:
    u = la.canonical((w[:, 0] / np.linalg.norm(w[:, 0]))[:, None])[:, 0]
    return spark.createDataFrame([(float(u[0]), float(u[1]))], "fx double, fy double").select(half_up("fx", 8).alias("fx"), half_up("fy", 8).alias("fy"))


@query(f"WITH {_PCA2} SELECT round(fx, 8) AS fx, round(fy, 8) AS fy FROM f")
def pca_2d(spark, sf_dir):
    return _direction(spark, Reducer.create("PCA", 1).fit(_plane(spark, sf_dir)).matrix)


@query(f"WITH {_FISHER} SELECT round(fx, 8) AS fx, round(fy, 8) AS fy FROM f")
def lda_2d(spark, sf_dir):
    return _direction(spark, Reducer.create("LDA", 1).fit(_plane(spark, sf_dir)).matrix)


@query(f"WITH {_P}, r AS (SELECT .95 * a + .05 * (a + d) / 2 AS a, .95 * b AS b, .95 * d + .05 * (a + d) / 2 AS d, ux, uy FROM w), f0 AS (SELECT d * ux - b * uy AS fx, a * uy - b * ux AS fy FROM r), {_UNIT} SELECT round(fx, 8) AS fx, round(fy, 8) AS fy FROM f")
def lda_shrunk_2d(spark, sf_dir):
    m = moments(_plane(spark, sf_dir), "features", "label")
    return _direction(spark, la.whitened(m.between, la.shrink(m.within, 0.05), 1))


@query(f"WITH {_FISHER} SELECT round(-fy * CASE WHEN abs(fy) >= abs(fx) THEN sign(-fy) ELSE sign(fx) END, 8) AS fx, round(fx * CASE WHEN abs(fy) >= abs(fx) THEN sign(-fy) ELSE sign(fx) END, 8) AS fy FROM f")
def rda_residual_2d(spark, sf_dir):
    """The residual direction: what the discriminant leaves of the plane is its perpendicular."""
    return _direction(spark, Reducer.create("RDA", 1, n_residual=1).fit(_plane(spark, sf_dir)).matrix[:, 1:])


@query(f"WITH {_PCA2} SELECT concat_ws('-', l_orderkey, l_linenumber) AS sample_id, round((x - mx) * fx + (y - my) * fy, 6) AS score FROM p, t, f")
def project_2d(spark, sf_dir):
    df = _plane(spark, sf_dir)
    return Reducer.create("PCA", 1).fit(df).transform(df).select("sample_id", half_up(F.col("reduced")[0], 6).alias("score"))


@query("WITH j AS (SELECT (l_quantity > 25) <> (l_linestatus = 'O') AS wrong FROM lineitem), e AS (SELECT avg(CAST(wrong AS INTEGER)) AS err, count(*) AS n FROM j), w AS (SELECT wrong, count(*) AS rows, CASE WHEN wrong AND err > 0 AND err < .5 THEN exp(ln((1 - err) / err + 1e-10)) ELSE 1 END / n AS w FROM j, e GROUP BY wrong, err, n) SELECT wrong, rows, round(err, 9) AS err, round(w / (SELECT sum(w * rows) FROM w) * 1e6, 6) AS weight_ppm FROM w, e")
def boost_weights(spark, sf_dir):
    """Error and new weights (in millionths) of rows that a threshold rule gets right or wrong."""
    j = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(((F.col("l_quantity") > 25) != (F.col("l_linestatus") == "O")).alias("wrong"))
    c = j.groupBy("wrong").agg(F.count(F.lit(1)).alias("rows"))
    all_ = Window.partitionBy()
    c = c.withColumn("n", F.sum("rows").over(all_)).withColumn("err", F.sum(F.when(F.col("wrong"), F.col("rows")).otherwise(0)).over(all_) / F.col("n"))
    gate = F.col("wrong") & (F.col("err") > 0) & (F.col("err") < 0.5)
    c = c.withColumn("w", F.when(gate, F.exp(F.log((1 - F.col("err")) / F.col("err") + 1e-10))).otherwise(1.0) / F.col("n"))
    return c.select("wrong", "rows", half_up("err", 9).alias("err"), half_up(F.col("w") / F.sum(F.col("w") * F.col("rows")).over(all_) * 1e6, 6).alias("weight_ppm"))


_PAIR = _STAT + ", pr AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM cm a JOIN cm b ON a.i = b.i AND a.label < b.label GROUP BY ALL), hard AS (SELECT *, row_number() OVER (ORDER BY round(dist, 12), i, j) <= greatest(1, CAST(floor(count(*) OVER () * 0.3) AS BIGINT)) AS hard FROM pr)"


def _pairs(spark, sf_dir):
    m = _moments(spark, sf_dir)
    i, j, dist, weight = class_pairs(m.class_means)
    rows = [(int(m.labels[a]), int(m.labels[b]), float(d), float(w), bool(w > 0.5 / (d + 1e-6))) for a, b, d, w in zip(i, j, dist, weight, strict=True)]
    return spark.createDataFrame(rows, "i int, j int, dist double, weight double, hard boolean")


@query(f"WITH {_PAIR} SELECT i, j, round(dist, 9) AS dist FROM pr")
def class_pair_distances(spark, sf_dir):
    """Distances of class means, as a join of classes i < j."""
    long = vectors(spark, sf_dir).select("label", F.posexplode("features").alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    other = long.select(F.col("label").alias("j"), "dim", F.col("m").alias("o"))
    pairs = long.withColumnRenamed("label", "i").join(other, "dim").filter("i < j")
    return pairs.groupBy("i", "j").agg(half_up(F.sqrt(F.sum((F.col("m") - F.col("o")) ** 2)), 9).alias("dist"))


@query(f"WITH {_PAIR} SELECT i, j FROM hard WHERE hard")
def hard_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).filter("hard").select("i", "j")


@query(f"WITH {_PAIR} SELECT i, j, round(CASE WHEN hard THEN 1 ELSE .1 END / (dist + 1e-6), 9) AS weight FROM hard")
def margin_weights(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", "j", half_up("weight", 9).alias("weight"))


_KNN = """v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
knn AS (SELECT a.label, a.id AS i, b.id AS j, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 10), b.id) AS nth FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id QUALIFY nth <= 7),
sg AS (SELECT label, median(d) + 1e-10 AS sigma FROM (SELECT label, i, max(dist) AS d FROM knn GROUP BY ALL) GROUP BY label),
nc AS (SELECT label, count(*) AS n FROM v GROUP BY label),
aff AS (SELECT label, i, j, exp(-dist * dist / (2 * sigma * sigma)) / n AS w FROM knn JOIN sg USING (label) JOIN nc USING (label)),
sym AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w FROM aff UNION ALL SELECT j, i, w FROM aff) GROUP BY ALL)"""


def _rows(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("sample_id").alias("id"), "label", F.col("features").alias("x"))


def _knn(spark, sf_dir):
    return graph.knn_within_class(_rows(spark, sf_dir), 7)


@query(f"WITH {_KNN} SELECT label, i, j, round(dist, 7) AS dist, CAST(nth AS INTEGER) AS nth FROM knn")
def knn_within_class(spark, sf_dir):
    return _knn(spark, sf_dir).select("label", "i", "j", half_up("dist", 7).alias("dist"), "nth")


@query(f"WITH {_KNN} SELECT label, round(sigma, 9) AS sigma FROM sg")
def lfda_sigma(spark, sf_dir):
    return graph.sigma(stage(_knn(spark, sf_dir))).select("label", half_up("sigma", 9).alias("sigma"))


@query(f"WITH {_KNN} SELECT i, j, round(w, 9) AS w FROM sym")
def lfda_affinity(spark, sf_dir):
    return graph.symmetric(graph.affinity(stage(_knn(spark, sf_dir)), _rows(spark, sf_dir))).select("i", "j", half_up("w", 9).alias("w"))


@query(f"WITH {_KNN} SELECT i, round(sum(w), 9) AS degree FROM sym GROUP BY i")
def lfda_degree(spark, sf_dir):
    return graph.degree(graph.affinity(stage(_knn(spark, sf_dir)), _rows(spark, sf_dir))).select("i", half_up("degree", 9).alias("degree"))


@query(f"WITH {_KNN}, e AS (SELECT row_number() OVER () AS e, w, list_transform(list_zip(a.v, b.v), lambda z: z[1] - z[2]) AS d FROM aff JOIN v a ON a.id = aff.i JOIN v b ON b.id = aff.j), l AS (SELECT e, w, unnest(range(len(d))) AS k, unnest(d) AS d FROM e) SELECT CAST(p.k AS INTEGER) AS i, CAST(q.k AS INTEGER) AS j, round(sum(p.w * p.d * q.d) / (SELECT count(*) FROM v), 9) AS v FROM l p JOIN l q ON p.e = q.e AND p.k <= q.k GROUP BY ALL")
def lfda_local_scatter(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _upper(spark, graph.local_scatter(rows, graph.affinity(stage(_knn(spark, sf_dir)), rows), rows.count()))


@query("SELECT vec_id AS sample_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) <= 20")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(vectors(spark, sf_dir).drop("features"), "label", "sample_id", 42, 20)


@query("WITH f AS (SELECT unnest([0.1, 0.25, 0.5]) AS fraction), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT count(DISTINCT label) AS c, count(*) AS n FROM embeddings) SELECT CAST(fraction AS DOUBLE) AS fraction, label, CAST(least(c.n, greatest(2, CAST(floor(fraction * t.n / t.c) AS BIGINT))) AS BIGINT) AS n FROM f, c, t")
def stratified_fraction_counts(spark, sf_dir):
    df = vectors(spark, sf_dir).drop("features")
    n, classes = df.count(), df.select("label").distinct().count()
    out = None
    for f in (0.1, 0.25, 0.5):
        one = sampling.stratified_sample(df, "label", "sample_id", 42, sampling.per_class(f, n, classes)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("fraction"), "label", "n")
        out = one if out is None else out.unionByName(one)
    return out


_SPLIT = "sp AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) <= greatest(1, floor(count(*) OVER (PARTITION BY label) * 0.8)) THEN 'train' ELSE 'test' END AS split FROM embeddings)"


def split_vectors(spark, sf_dir):
    """The vectors with an 80/20 split of each class."""
    return sampling.split(vectors(spark, sf_dir), "label", "sample_id", 42, 0.8)


def train_test(spark, sf_dir):
    both = stage(split_vectors(spark, sf_dir), "split")
    return both.filter("split = 'train'").drop("split"), both.filter("split = 'test'").drop("split")


@query(f"WITH {_SPLIT} SELECT id AS sample_id, label, split FROM sp")
def train_test_split(spark, sf_dir):
    return split_vectors(spark, sf_dir).select("sample_id", "label", "split")


_NC = _SPLIT + """, tx AS (SELECT id, label, unnest(range(len(v))) AS i, unnest(v) AS v FROM sp WHERE split = 'train'), ct AS (SELECT label, i, avg(v) AS m FROM tx GROUP BY ALL), cv AS (SELECT label AS c, list(m ORDER BY i) AS m FROM ct GROUP BY label),
pred AS (SELECT id, label, c AS predicted FROM sp, cv WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_distance(v, m), 10), c) = 1)"""


def _centroid_predictions(spark, sf_dir):
    """Test rows with the class whose training mean is nearest: the C x D means ride along as one matrix product per batch."""
    train, test = train_test(spark, sf_dir)
    m = moments(train, "features", "label")
    means = m.class_means
    scored = project(test, "features", np.zeros(m.d), means.T, "s")
    # ||x - m||^2 = ||x||^2 - 2 x m + ||m||^2; the first part does not change the order.
    half = F.array(*[F.lit(float(v)) for v in (means**2).sum(axis=1) / 2])
    gap = F.zip_with(half, F.col("s"), lambda h, s: F.round(h - s, 10))
    best = F.array_position(gap, F.array_min(gap)) - 1
    classes = F.array(*[F.lit(int(v)) for v in m.labels])
    return scored.select("sample_id", "label", F.get(classes, best.cast("int")).alias("predicted"))


@query(f"WITH {_NC} SELECT id AS sample_id, label, predicted FROM pred")
def nearest_centroid_predictions(spark, sf_dir):
    return _centroid_predictions(spark, sf_dir)


@query(f"WITH {_NC} SELECT count(*) AS n, round(100 * avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy FROM pred")
def accuracy_overall(spark, sf_dir):
    return _centroid_predictions(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), half_up(100 * F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query(f"WITH {_NC} SELECT label, count(*) AS n, round(100 * avg(CAST(label = predicted AS INTEGER)), 6) AS accuracy FROM pred GROUP BY label")
def accuracy_per_class(spark, sf_dir):
    return _centroid_predictions(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), half_up(100 * F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query(f"WITH {_NC} SELECT label, predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return _centroid_predictions(spark, sf_dir).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NC}, r AS (SELECT label, round(100 * (avg(CAST(label = predicted AS INTEGER)) - avg(CAST(label = (id * 7 + 3) % 10 AS INTEGER))), 6) AS diff FROM pred GROUP BY label) SELECT label, diff, 'top' AS side, CAST(row_number() OVER (ORDER BY diff DESC, label) AS INTEGER) AS rank_no FROM r QUALIFY rank_no <= 5 UNION ALL SELECT label, diff, 'bottom', CAST(row_number() OVER (ORDER BY diff, label) AS INTEGER) AS rank_no FROM r QUALIFY rank_no <= 5")
def top_bottom_classes(spark, sf_dir):
    """The 5 classes that nearest centroid helps most and least against an arbitrary rule."""
    p = _centroid_predictions(spark, sf_dir)
    hit = lambda c: F.avg(c.cast("double"))
    r = p.groupBy("label").agg(half_up(100 * (hit(F.col("label") == F.col("predicted")) - hit(F.col("label") == (F.col("sample_id") * 7 + 3) % 10)), 6).alias("diff"))
    return results_op.extremes(r, "diff", "label", 5)


# Metadata joins.
@query("WITH c AS (SELECT img_id, min(is_train) AS is_train, min(label) - 1 AS label FROM cub200 WHERE label IS NOT NULL GROUP BY img_id) SELECT e.sample_id, e.img_id, c.label, c.is_train FROM extract_features_multi e JOIN c ON c.img_id = e.img_id WHERE lower(trim(e.dataset)) = 'cub200'")
def metadata_three_way_join(spark, sf_dir):
    """Vectors of cub200 with the label (from 0) and split of their image, from two metadata tables."""
    cub = spark.read.parquet(f"{sf_dir}/cub200.parquet").filter("label IS NOT NULL")
    labels, splits = cub.groupBy("img_id").agg((F.min("label") - 1).alias("label")), cub.groupBy("img_id").agg(F.min("is_train").alias("is_train"))
    rows = spark.read.parquet(f"{sf_dir}/extract_features_multi.parquet").filter(tidy("dataset") == "cub200").select("sample_id", "img_id").join(labels.select("img_id"), "img_id", "left_semi")
    return src.three_way(rows, labels, splits, "img_id").select("sample_id", "img_id", "label", "is_train")


@query("WITH c AS (SELECT class_id, CAST(row_number() OVER (ORDER BY class_id) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT class_id FROM tiny_imagenet WHERE class_id IS NOT NULL)) SELECT rec_id, class_id, label FROM tiny_imagenet JOIN c USING (class_id)")
def class_index_lookup(spark, sf_dir):
    images = spark.read.parquet(f"{sf_dir}/tiny_imagenet.parquet").select("rec_id", "class_id")
    return images.join(small(src.class_index(images, "class_id")), "class_id").select("rec_id", "class_id", "label")


@query("SELECT lower(trim(backbone)) AS backbone, lower(trim(dataset)) AS dataset, coalesce(lower(trim(split)), 'by_image') AS split, count(*) AS n, count(DISTINCT label) AS classes, max(len(features)) AS feature_dim FROM extract_features_multi GROUP BY ALL")
def feature_cache_scan(spark, sf_dir):
    """Features through the read-through cache, partitioned by configuration and split."""
    raw = spark.read.parquet(f"{sf_dir}/extract_features_multi.parquet")
    clean = lambda: raw.select("sample_id", "label", "features", tidy("backbone").alias("backbone"), tidy("dataset").alias("dataset"), F.coalesce(tidy("split"), F.lit("by_image")).alias("split"))
    path = stage_path(spark, "cache")
    src.cached_features(spark, path, clean)
    cached = src.cached_features(spark, path, clean)
    return cached.groupBy("backbone", "dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes"), F.max(F.when(F.col("features").isNotNull(), F.size("features"))).cast("long").alias("feature_dim"))


@query(f"WITH {_X} SELECT CAST(i AS INTEGER) AS dim, round(sum(v * (1 + id % 3)) / sum(1 + id % 3), 9) AS mean FROM x GROUP BY i")
def weighted_global_mean(spark, sf_dir):
    """Mean of every feature under the weights 1 + id mod 3."""
    m = moments(vectors(spark, sf_dir).withColumn("w", 1 + F.col("sample_id") % 3), "features", "label", "w")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.mean)], "dim int, mean double").withColumn("mean", half_up("mean", 9))


@query("WITH l AS (SELECT class_id, CAST(row_number() OVER (ORDER BY md5(class_id)) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT class_id FROM tiny_imagenet WHERE class_id IS NOT NULL)) SELECT rec_id, class_id, label FROM tiny_imagenet JOIN l USING (class_id)")
def listed_class_index(spark, sf_dir):
    """Labels of image records by the line of their class in a list, which is written as a file and read again."""
    images = spark.read.parquet(f"{sf_dir}/tiny_imagenet.parquet").select("rec_id", "class_id")
    path = stage_path(spark, "wnids")
    images.select("class_id").filter("class_id IS NOT NULL").distinct().orderBy(F.md5("class_id")).coalesce(1).write.text(path)  # a registry of names
    return images.join(small(src.class_index(images, "class_id", src.listed_lines(spark, path, "class_id"))), "class_id").select("rec_id", "class_id", "label")


@query("WITH named AS (SELECT rec_id, img_path AS path, regexp_extract(img_path, '[^/]*$') AS img_name, class_id FROM tiny_imagenet WHERE img_path IS NOT NULL), notes AS (SELECT img_name, min(class_id) AS class_id FROM named WHERE class_id IS NOT NULL GROUP BY ALL) SELECT n.rec_id, notes.class_id, regexp_replace(path, '(/images)?/[^/]*$', '') || '/' || notes.class_id || '/images/' || n.img_name AS new_path FROM named n JOIN notes USING (img_name)")
def reorganized_paths(spark, sf_dir):
    """Where every image would lie if each class had its folder, by annotations of image names."""
    images = spark.read.parquet(f"{sf_dir}/tiny_imagenet.parquet").filter("img_path IS NOT NULL").select("rec_id", F.col("img_path").alias("path"), "class_id")
    notes = images.filter("class_id IS NOT NULL").select(F.substring_index("path", "/", -1).alias("img_name"), "class_id")
    return src.annotated_paths(images.drop("class_id"), notes).select("rec_id", "class_id", "new_path")


@query(f"WITH {_SPLIT}, x AS (SELECT id, split, unnest(range(len(v))) AS i, unnest(v) AS v FROM sp), s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM x WHERE split = 'train' GROUP BY i) SELECT CAST(i AS INTEGER) AS dim, count(*) AS n, round(avg((v - m) / sd), 6) AS mean, 10 AS classes, 64 AS feature_dim FROM x JOIN s USING (i) WHERE split = 'test' GROUP BY i")
def standardized_facade(spark, sf_dir):
    """Means of the test vectors of a cached configuration, standardised by its training vectors."""
    path = stage_path(spark, "cache")
    src.cached_features(spark, path, lambda: split_vectors(spark, sf_dir).withColumns({"backbone": F.lit("own"), "dataset": F.lit("embeddings")}))
    _, test, classes, d = src.standardized_features(spark, path, "own", "embeddings")
    long = test.select(F.posexplode("features_std").alias("dim", "v"))
    return long.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg("v"), 6).alias("mean")).withColumns({"classes": F.lit(classes), "feature_dim": F.lit(d)})


# Reducers over whole tables: the reduced vectors of every row.
K = 9


def _reduce(name: str):
    def reduced(spark, sf_dir):
        df = vectors(spark, sf_dir)
        scaled = classify.standardize(df, "features", "label", "features_std")(df).drop("features")
        model = Reducer.create(name, K, vector="features_std").fit(scaled)
        return model.transform(scaled).select("sample_id", "label", F.transform("reduced", lambda x: F.round(x, 6)).alias("reduced"))

    reduced.__name__ = name
    return reduced


for _name, _key in [("Full", "full"), ("PCA", "pca"), ("LDA", "lda"), ("PCA+LDA", "pca_lda"), ("R-LDA", "rlda"), ("LFDA", "lfda"), ("NCA", "nca"), ("RDA", "rda"), ("DSB", "dsb"), ("RDA+SMD", "rda_smd")]:
    QUERIES[f"{_key}_reduce"] = _reduce(_name)


#: Studies run so many of their parts at a time.
THREADS = 4


def _runs(spark, sf_dir, methods, classifiers=("LogReg",), seeds=(42,)):
    train, test = train_test(spark, sf_dir)
    return experiments.table(spark, experiments.run(train, test, methods, K, classifiers, seeds, threads=THREADS)).drop("time_reduce", "time_classify")


@query()
def logreg_eval(spark, sf_dir):
    return _runs(spark, sf_dir, ["Full", "LDA"])


@query()
def mlp_eval(spark, sf_dir):
    """Four reducers under the perceptron, for five seeds."""
    return _runs(spark, sf_dir, experiments.MLP_METHODS, ("MLP",), experiments.SEEDS)


@query()
def benchmark_table(spark, sf_dir):
    """All reducers, ranked by accuracy."""
    return results_op.rank_methods(_runs(spark, sf_dir, experiments.METHODS), [])


@query("SELECT CAST(seed AS INTEGER) AS seed, vec_id AS sample_id, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS position FROM embeddings, (SELECT unnest([42, 123, 456, 789, 1024]) AS seed)")
def row_permutation(spark, sf_dir):
    """The order of the rows under each seed of the repeated runs."""
    df, out = vectors(spark, sf_dir).select("sample_id"), None
    for seed in experiments.SEEDS:
        one = sampling.positions(df, "sample_id", seed).select(F.lit(seed).alias("seed"), "sample_id", "position")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def repeated_runs(spark, sf_dir):
    """Seven reducers for five seeds, each on the training rows in the seed's order."""
    rows = experiments.repeated_runs(*train_test(spark, sf_dir), experiments.SIGNIFICANCE_METHODS, K, threads=THREADS)
    return experiments.table(spark, rows).drop("time_reduce", "time_classify")


@query()
def component_sweep(spark, sf_dir):
    rows = experiments.component_sweep(*train_test(spark, sf_dir), [1, 2, 3, 4, 5, 7, 9], threads=THREADS)
    return spark.createDataFrame([(r["method"], r["n_components"], r["seed"], r["accuracy"]) for r in rows], "method string, n_components int, seed int, accuracy double")


@query()
def data_efficiency(spark, sf_dir):
    rows = experiments.data_efficiency(*train_test(spark, sf_dir), experiments.FRACTIONS, experiments.SEEDS[:3], experiments.EFFICIENCY_METHODS, K, threads=THREADS)
    return spark.createDataFrame([(r["method"], r["fraction"], r["seed"], r["n_train"], r["accuracy"]) for r in rows], "method string, fraction double, seed int, n_train long, accuracy double")


@query()
def per_class_study(spark, sf_dir):
    """The five classes that DSB helps and hurts most against LDA, and LDA against Full, of a study of five methods."""
    c = stage(experiments.per_class_study(*train_test(spark, sf_dir), experiments.EFFICIENCY_METHODS, K, threads=THREADS), "classes")
    out = None
    for method, baseline in (("DSB", "LDA"), ("LDA", "Full")):
        of = lambda name: F.max(F.when(F.col("method") == name, F.col("class_accuracy")))
        one = results_op.extremes(c.groupBy("label").agg((of(method) - of(baseline)).alias("diff")), "diff", "label", 5).select(F.lit(method).alias("method"), F.lit(baseline).alias("baseline"), "label", "diff", "side", "rank_no")
        out = one if out is None else out.unionByName(one)
    return out


#: What holds for the directions of each reducer (see reducer_invariants).
INVARIANTS = [
    ("Full", "keeps every vector"), ("PCA", "orthonormal"), ("PCA", "uncorrelated"), ("PCA", "captures the largest eigenvalues"), ("LDA", "whitens within"), ("LDA", "captures the largest ratios"), ("PCA+LDA", "spans what LDA spans"),
    ("R-LDA", "whitens the shrunk class covariances"), ("LFDA", "whitens its local scatter"), ("NCA", "full rank"), ("RDA", "begins with LDA"), ("RDA", "residual is orthogonal"), ("DSB", "at most k directions"), ("RDA+SMD", "whitens the shrunk within"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{i}', true)" for r, i in INVARIANTS) + ") t(reducer, invariant, holds)")
def reducer_invariants(spark, sf_dir):
    """Whether the fitted directions have the properties that define them, by formulas other than those they were found by."""
    raw = vectors(spark, sf_dir)
    df = stage(classify.standardize(raw, "features", "label", "x")(raw).select("sample_id", "label", "x"), "invariants")
    m = moments(df, "x", "label")
    sw, sb, st, c = m.within, m.between, m.total, len(m.labels)
    w = dict(zip(experiments.METHODS, experiments.each(experiments.METHODS, lambda n: Reducer.create(n, K, vector="x").fit(df).matrix, THREADS), strict=True))
    close = lambda a, b, tol=1e-6: bool(np.allclose(a, b, atol=tol * max(1.0, float(np.abs(b).max()))))
    diagonal = lambda a: close(a, np.diag(np.diag(a)))
    span = lambda a: (q := np.linalg.qr(a)[0]) @ q.T
    ratios = np.sort(np.linalg.eigvals(np.linalg.solve(sw, sb)).real)[::-1]
    ratio = lambda a: float(np.trace(np.linalg.solve(a.T @ sw @ a, a.T @ sb @ a)))
    knn = stage(graph.knn_within_class(df.select(F.col("sample_id").alias("id"), "label", "x"), 7))
    rows = df.select(F.col("sample_id").alias("id"), "label", "x")
    local = graph.local_scatter(rows, graph.affinity(knn, rows), m.rows)
    local = local + 1e-4 * np.trace(local) / m.d * np.eye(m.d)
    shrunk = la.shrink(sw, la.ledoit_wolf(sw, m.n, fourth_moment(df, "x", "label", m)))

    def shrunk_class(label) -> np.ndarray:
        own = df.filter(F.col("label") == F.lit(label))
        n = moments(own, "x", "label")
        corr = n.total / np.outer(n.scale, n.scale)
        return la.shrink(corr, la.ledoit_wolf(corr, n.n, fourth_moment(own, "x", None, n, n.scale))) * np.outer(n.scale, n.scale) * n.n / m.n

    by_class = sum(experiments.each(m.labels.tolist(), shrunk_class, THREADS))
    holds = [
        close(w["Full"], np.eye(m.d)), close(w["PCA"].T @ w["PCA"], np.eye(K)), diagonal(w["PCA"].T @ st @ w["PCA"]), close(np.trace(w["PCA"].T @ st @ w["PCA"]), np.linalg.eigvalsh(st)[-K:].sum()),
        close(w["LDA"].T @ sw @ w["LDA"] * m.n / (m.n - c), np.eye(K)), close(ratio(w["LDA"]), ratios[:K].sum()), close(span(w["PCA+LDA"]), span(w["LDA"])),
        close(w["R-LDA"].T @ by_class @ w["R-LDA"], np.eye(w["R-LDA"].shape[1])), close(w["LFDA"].T @ local @ w["LFDA"], np.eye(K), 1e-5), np.linalg.matrix_rank(w["NCA"]) == w["NCA"].shape[1], close(w["RDA"][:, :K], w["LDA"]),
        close(w["RDA"][:, K:].T @ span(w["LDA"]), np.zeros((w["RDA"].shape[1] - K, m.d))), w["DSB"].shape[1] <= K, close(w["RDA+SMD"][:, :K].T @ shrunk @ w["RDA+SMD"][:, :K], np.eye(K)),
    ]
    return spark.createDataFrame([(r, i, bool(h)) for (r, i), h in zip(INVARIANTS, holds, strict=True)], "reducer string, invariant string, holds boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduce by three methods, classify, rank: (method, dim, accuracy, n_train, n_test, rank_no)."""
    return results_op.rank_methods(_runs(spark, sf_dir, ["Full", "PCA", "LDA"]), []).select("method", "dim", "accuracy", "n_train", "n_test", "rank_no")


ORACLES["full_reduce"] = f"WITH {_STAT} SELECT id AS sample_id, label, list(round((v - m) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END, 6) ORDER BY i) AS reduced FROM x JOIN s USING (i) GROUP BY ALL"