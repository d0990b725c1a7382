"""Mixing sources to target weights, measured in tokens of a public tokenizer.

The size of a mix is the number of tokens of all documents of its sources; each source is to hold its share of it. Within a
source a document is wanted r times, r = min(max_repeats, c * weight), with c such that the source's tokens come out as its share
asks for. The whole part of r are certain copies; the fractions are inclusion odds of a fixed-size sample drawn by Pareto order
sampling: documents are ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p), and the first n, the sum of
the fractions, are in. The n are selected by the bisection of llm.topn, so a source that holds most documents is never in one task.

Defined results: sources count trimmed and in lower case; shares are scaled to sum to 1 within a mix over its sources that have
tokens, so percentages and shares that do not sum to 1 are the same thing; targets of equal source in a mix are added up, the
smallest cap holds; a source without documents is reported with no tokens; documents of sources that a mix leaves out, or without
source, are not in it; a null cap is no cap; a cap below 1, a null or non-positive share takes nothing; a null or empty text has
no tokens and is never repeated; repeated documents are documents of their own. What capped sources cannot fill is left open and
shows in the actual shares.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.labels import label
from lumenfold.llm.topn import select_top
from lumenfold.session import stage

#: Vocabulary file of ranks, and the folder that holds it.
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
SEED = 7
#: Documents weigh as their tokens to this power: longer ones are a little likelier, which steadies the sum of tokens.
SIZE_EXPONENT = 0.25
#: Rows of targets (mixes times sources) the driver may hold.
MAX_TARGETS = 100_000
#: Longest piece of a text that the tokenizer sees at once; texts are cut at white space near it.
PIECE = 1 << 20


def tokenizer_path() -> str:
    """The default vocabulary: that of the installed public_tokenizers package."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER_FILE))


def tokenizer_pattern() -> str:
    """The pattern that splits texts before that vocabulary's merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """text in pieces of about PIECE characters, cut before a space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            space = text.rfind(" ", at + 1, end)
            end = space if space > at else end
        yield text[at:end]
        at = end


def token_counts(documents: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """documents with tokens instead of their text. path: the vocabulary's file, which every executor can read."""
    carried = [c for c in documents.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for b in batches:
            n = [sum(len(encode(p)) for p in pieces(t)) if t else 0 for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in carried], pa.array(n, pa.int64())], [*carried, "tokens"])

    return documents.select(*carried, text).mapInArrow(count, documents.select(*carried).schema.add("tokens", "long"))


def shares(targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(mix_id, source, share, cap, available, wanted): wanted tokens of each source of each mix. sizes: (source, available)."""
    wanted = targets.select("mix_id", label("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf"))).alias("cap"))
    wanted = wanted.groupBy("mix_id", "source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap")).join(sizes, "source", "left").fillna(0, ["available"])
    total = wanted.withColumn("live", F.when(F.col("available") > 0, F.col("share")).otherwise(0.0))
    sums = total.groupBy("mix_id").agg(F.sum("live").alias("all_shares"), F.sum("available").alias("mix_tokens"))
    part = F.when(F.col("all_shares") > 0, F.col("live") / F.col("all_shares")).otherwise(0.0)
    return total.join(sums, "mix_id").select("mix_id", "source", part.alias("share"), "cap", "available", (part * F.col("mix_tokens")).alias("wanted"))


def scale(documents: DataFrame, plan: list) -> dict[tuple, float]:
    """(mix_id, source) -> c with sum of min(cap, c * weight) * tokens = wanted over the source's documents, at least the cap over the least weight where that is out of reach.

    In order of falling size, c is what is left to be filled over what is left to fill it, and right at the first size that it
    leaves below the cap. One aggregation by size, then running sums over the distinct sizes of a source.
    """
    spark = documents.sparkSession
    live = [r for r in plan if r.wanted > 0 and r.available > 0 and r.cap >= 1]
    if not live:
        return {}
    full = {(r.mix_id, r.source): float("inf") for r in live if r.wanted >= r.cap * r.available}
    table = spark.createDataFrame([(r.mix_id, r.source, r.cap, r.wanted) for r in live if (r.mix_id, r.source) not in full], "mix_id int, source string, cap double, wanted double")
    sizes = documents.groupBy("source", "tokens", "weight").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table), "source")
    heavier = Window.partitionBy("mix_id", "source").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    lighter = Window.partitionBy("mix_id", "source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sizes.withColumns({"above": F.coalesce(F.sum(F.col("n") * F.col("tokens")).over(heavier), F.lit(0)), "rest": F.sum(F.col("n") * F.col("weight") * F.col("tokens")).over(lighter)})
    at = at.withColumn("c", (F.col("wanted") - F.when(F.col("above") > 0, F.col("cap") * F.col("above")).otherwise(0.0)) / F.col("rest")).filter(F.col("c") * F.col("weight") <= F.col("cap"))
    found = at.groupBy("mix_id", "source").agg(F.max(F.struct("tokens", "c")).alias("best")).collect()  # a row for each target
    return full | {(r.mix_id, r.source): r.best.c for r in found}


def repeats(documents: DataFrame, targets: DataFrame, seed: int = SEED, exponent: float = SIZE_EXPONENT) -> tuple[DataFrame, list, DataFrame]:
    """Copies of the documents (identity columns, source, tokens) in each mix: (mix_id, doc_id, source, tokens, copies), the plan's rows, and the copies wanted: (mix_id, doc_id, source, tokens, cap, whole, p)."""
    spark = documents.sparkSession
    sizes = documents.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = shares(targets, sizes).limit(MAX_TARGETS + 1).collect()
    if len(plan) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    weighted = documents.filter("tokens > 0").withColumn("weight", F.pow("tokens", F.lit(exponent)))
    c = scale(weighted, plan)
    table = spark.createDataFrame([(r.mix_id, r.source, r.cap, c[(r.mix_id, r.source)]) for r in plan if (r.mix_id, r.source) in c], "mix_id int, source string, cap double, c double")
    # At most MAX_TARGETS rows.
    want = weighted.join(F.broadcast(table), "source").withColumn("r", F.least("cap", F.col("c") * F.col("weight")))
    # The hash gives 53 random bits, never 0 or 1.
    u = (F.pmod(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), F.lit(1 << 53)) + 0.5) / F.lit(float(1 << 53))
    want = want.withColumns({"whole": F.floor("r"), "p": F.col("r") - F.floor("r")})
    want = stage(want.withColumn("rank", F.log(u / (1 - u)) - F.log(F.col("p") / (1 - F.col("p")))), "mix-wanted")
    sized = want.groupBy("mix_id", "source").agg(F.round(F.sum("p")).cast("long").alias("n"))
    drawn = want.filter("p > 0").join(F.broadcast(sized), ["mix_id", "source"]).select("mix_id", "source", "doc_id", "tokens", "rank", "n")
    taken = select_top(drawn, ["mix_id", "source"], [("rank", True), ("doc_id", True)], F.col("n")).select("mix_id", "doc_id", "source", "tokens", F.lit(1).cast("long").alias("copies"))
    certain = want.filter("whole > 0").select("mix_id", "doc_id", "source", "tokens", F.col("whole").alias("copies"))
    return certain.unionByName(taken).groupBy("mix_id", "doc_id", "source", "tokens").agg(F.sum("copies").alias("copies")), plan, want


def report(copies: DataFrame, plan: list) -> DataFrame:
    """(mix_id, source, target_share, actual_share, available_tokens, mixed_tokens, documents, mean_repeats, max_copies) of every target."""
    spark = copies.sparkSession
    done = copies.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("max_copies"))
    table = spark.createDataFrame([(r.mix_id, r.source, r.share, r.available) for r in plan], "mix_id int, source string, target_share double, available_tokens long")
    both = table.join(done, ["mix_id", "source"], "left").fillna(0, ["mixed_tokens", "documents", "max_copies"])
    total = both.groupBy("mix_id").agg(F.sum("mixed_tokens").alias("total"))
    share = F.when(F.col("total") > 0, F.col("mixed_tokens") / F.col("total")).otherwise(0.0)
    return both.join(total, "mix_id").select("mix_id", "source", "target_share", share.alias("actual_share"), "available_tokens", "mixed_tokens", "documents", F.when(F.col("available_tokens") > 0, F.col("mixed_tokens") / F.col("available_tokens")).otherwise(0.0).alias("mean_repeats"), "max_copies")


def audit(copies: DataFrame, plan: list, want: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, n_exact, whole_copies, cap_kept, share_kept) of every target of a mix: whether the sample has as many
    documents as its odds sum up to, every document its whole copies or one more, none more than the cap, and the tokens are the wanted
    ones: exactly the cap times all where that is less, else within five deviations of independent draws and the largest document."""
    spark = copies.sparkSession
    both = want.select("mix_id", "source", "doc_id", "tokens", "cap", "whole", "p").join(copies.select("mix_id", "doc_id", "copies"), ["mix_id", "doc_id"], "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    extra = F.col("copies") - F.col("whole")
    seen = both.groupBy("mix_id", "source").agg(
        (F.sum(extra) == F.round(F.sum("p")).cast("long")).alias("n_exact"), F.bool_and(extra.isin(0, 1) & ((extra == 0) | (F.col("p") > 0))).alias("whole_copies"), F.bool_and(F.col("copies") <= F.col("cap")).alias("cap_kept"),
        F.sum(F.col("copies") * F.col("tokens")).alias("mixed"), F.sqrt(F.sum(F.col("p") * (1 - F.col("p")) * F.pow("tokens", F.lit(2)))).alias("deviation"), F.max("tokens").alias("largest"),
    )
    table = spark.createDataFrame([(r.mix_id, r.source, r.share, min(r.wanted, r.cap * r.available) if r.cap >= 1 and r.wanted > 0 else 0.0) for r in plan], "mix_id int, source string, target_share double, wanted double")
    kept = F.abs(F.coalesce("mixed", F.lit(0)) - F.col("wanted")) <= F.coalesce(5 * F.col("deviation") + F.col("largest"), F.lit(0.0))
    sure = lambda c: F.coalesce(c, F.lit(True)).alias(c)
    return table.join(seen, ["mix_id", "source"], "left").select("mix_id", "source", F.round("target_share", 9).alias("target_share"), sure("n_exact"), sure("whole_copies"), sure("cap_kept"), kept.alias("share_kept"))


def _mixed(spark: SparkSession, sf_dir: str, path: str | None = None) -> tuple[DataFrame, list, DataFrame]:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", label("source").alias("source"), "text")
    counted = stage(token_counts(documents, "text", path or tokenizer_path(), tokenizer_pattern()), "mix-tokens")
    targets = spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    return repeats(counted.filter(F.col("source").isNotNull()), targets)


def p8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mix_id, doc_id, source, tokens, copies): how often each document goes into each mix."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual share, tokens and repeats of every source in every mix."""
    return report(*_mixed(spark, sf_dir)[:2])


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source of every mix has the copies and tokens that its share and cap ask for."""
    copies, plan, want = _mixed(spark, sf_dir)
    return audit(stage(copies, "mix-copies"), plan, want)


QUERIES = {"p8_repeats": p8_repeats, "p8_shares": p8_shares, "p8_checked": p8_checked}
ORACLES = {
    "p8_checked": r"""
WITH known AS (SELECT DISTINCT lower(trim(source, E' \t\r\n')) AS source FROM documents WHERE text <> ''),
targets AS (SELECT mix_id, lower(trim(source, E' \t\r\n')) AS source, sum(greatest(coalesce(target_share, 0), 0)) AS share FROM mix_targets GROUP BY ALL),
live AS (SELECT t.*, CASE WHEN k.source IS NOT NULL THEN share ELSE 0 END AS own FROM targets t LEFT JOIN known k USING (source))
SELECT mix_id, source, round(coalesce(own / nullif(sum(own) OVER (PARTITION BY mix_id), 0), 0), 9) AS target_share, true AS n_exact, true AS whole_copies, true AS cap_kept, true AS share_kept FROM live""",
}
