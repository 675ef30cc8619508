"""Quality rules: plain rules, then a hashed n-gram log-likelihood ratio. Built-in functions only.

Words and word pairs are hashed into `BUCKETS` buckets. Two multinomials are counted: the raw corpus over all
documents, and the trusted target over documents named as trusted. A document's score is the mean over its
n-grams of ln(target / raw). The target is smoothed towards the raw corpus, so a bucket that the target
never saw counts against a document by a bounded amount.

Log ratios are rounded to millionths and summed as integers, so the sum and the verdict do not depend on the
order of rows: kept if sum >= threshold * n-grams. The table of ratios has `BUCKETS` numbers whatever the input.

All trusted documents count, whatever their number. Defined cases: null and blank texts have no words and fail the base rules; without trusted documents all
ratios are zero; null ids are never trusted; repeated rows count each; other columns pass through, and input
columns with the names of results are replaced. Three-word windows are equal if their 64-bit hashes are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.llm.common import SPACES, require_columns, words_column
from trackgeo.session import durable

BUCKETS = 1 << 16
MICRO = 1_000_000
PRIOR = 4 * BUCKETS
THRESHOLD = -0.08
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `_words` and the counts of the base rules."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.withColumns({"_words": words_column(F.col(f"`{text}`")), "_lines": lines})
    counted = first.withColumns({
        "_n": F.size("_words"),
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint")}).drop("_lines")
    # Windows sorted by hash: a window is repeated if a neighbour is equal.
    windows = counted.withColumn("_sorted", F.sort_array(F.when(F.col("_n") >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("_n") - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("at"))
    )).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))))
    hits = windows.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(
        (F.get("_sorted", i + 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(
        (F.get("_sorted", F.greatest(i - 1, F.lit(0)))["h"] == x["h"]) & (i > 0), F.lit(False))), lambda x: x["at"])))
    return hits.withColumn("n_repeat_words", F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda s, x: s + x)).drop("_sorted", "_at")


def grams() -> Column:
    """Buckets of all words and word pairs of `_words`."""
    ones = F.transform("_words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))
    twos = F.transform(F.slice(F.sequence(F.lit(0), F.col("_n")), 1, F.greatest(F.col("_n") - 1, F.lit(0))), lambda i: F.pmod(
        F.xxhash64(F.get("_words", i), F.get("_words", i + 1)), F.lit(BUCKETS)))
    return F.concat(ones, twos)


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str, text: str, prior: float) -> DataFrame:
    """(bucket, micro): ln(target / raw) in millionths for every bucket."""
    spark = docs.sparkSession
    named = trusted.select(F.col(trusted.columns[0]).alias("_id")).dropna().distinct().withColumn("_trusted", F.lit(1))
    source = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    # The same join at every size: the ids grow with the documents and are never broadcast.
    flagged = source.join(named.hint("merge"), "_id", "left").withColumn("_words", words_column(F.col("_text"))).withColumn("_n", F.size("_words"))
    counts = durable(flagged.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(grams()).alias("bucket")).groupBy(
        "bucket").agg(F.count("*").alias("r"), F.sum("t").alias("t")))
    raw, target = counts.agg(F.coalesce(F.sum("r"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    share = (F.coalesce("r", F.lit(0)) + 1) / F.lit(float(raw + BUCKETS))
    ratio = F.log((F.coalesce("t", F.lit(0)) + prior * share) / F.lit(target + prior) / share)
    return spark.range(BUCKETS).toDF("bucket").join(counts, "bucket", "left").select(
        "bucket", F.round(ratio * MICRO).cast("bigint").alias("micro"))


def judge_quality(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """`docs` with the base counts, `base_failed`, `score` (mean log ratio) and `kept`.

    The first column of `trusted` holds ids of trusted documents.
    """
    require_columns(docs, key, text)
    ratios = durable(log_ratios(docs, trusted, key, text, prior))
    table = ratios.agg(F.transform(
        F.sort_array(F.collect_list(F.struct("bucket", "micro"))), lambda x: x["micro"]).alias("m"))  # BUCKETS numbers
    rest = [c for c in docs.columns if c.lower() not in RESULTS]
    # Input columns travel in one struct, so no name of theirs meets one of this plan.
    based = base_columns(docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_in"), F.col(f"`{text}`").alias("_text")), "_text")
    summed = based.withColumn("_ratios", table.scalar()).withColumn("_grams", grams()).withColumns({
        "_size": F.size("_grams"),
        "_sum": F.aggregate("_grams", F.lit(0).cast("bigint"), lambda s, b: s + F.get("_ratios", b.cast("int")))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    cut = math.floor(threshold * MICRO)
    return summed.withColumns({
        "base_failed": failed,
        "score": F.when(F.col("_size") > 0, F.col("_sum") / F.col("_size") / MICRO),
        "kept": ~failed & (F.col("_sum") >= F.lit(cut).cast("bigint") * F.col("_size"))}).select(
        "_in.*", *RESULTS)
