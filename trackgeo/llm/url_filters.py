"""URL filters: host-suffix and path-prefix rules by hash-prefix equi-join. Built-in functions only.

Every distinct (host, path) is expanded into the expressions a rule could be written as: each host suffix
cut at a dot, with each path prefix. Expressions meet the rules on a short prefix of their SHA-256 digest;
the full digest confirms; the longest rule wins. Path prefixes are cut only at lengths that occur among the
rules, and suffixes at label counts that occur, so any rule text is found and nothing else is expanded.

Skew: the join runs on distinct (host, path) pairs, pre-aggregated before the shuffle, so a host with a
third of all rows counts once per path; its expressions are spread over `SALTS` copies of the rules.
The decisions return to the rows by an ordinary left join, which the adaptive planner splits.

Defined cases: a null url or one without `://` has empty host and path, fits no rule and takes the default
verdict; repeated rows stay; other columns pass through, and an input column that has the name of a result
is replaced by the result (case ignored). Null hosts, paths or verdicts in rules fit nothing. Of rules with one
expression, `block` wins. Ties in length go to the longer host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.llm.common import free_name, require_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
PREFIX_DIGITS = 8
SALTS = 16
RESULTS = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def _digest(host: Column, path: Column) -> Column:
    # A line feed cannot end a host, so two different (host, path) pairs never share a text.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _small_set(df: DataFrame, value: Column) -> list[int]:
    """Distinct small integers of the rules; at most the length of the longest rule of them."""
    return sorted(r[0] for r in df.select(value.alias("v")).distinct().collect())


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, the winning rule (`host` + `path`, null if none) and the verdict.

    `rules` has host, path and verdict (`allow` or `block`); a rule fits its host and all subdomains
    where the path starts with the rule's path. It may be of any size: nothing here is broadcast by hint.
    """
    require_columns(pages, url)
    known = rules.select(
        F.translate("host", UPPER, LOWER).alias("host"), F.col("path"), F.col("verdict")
    ).dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    labels = _small_set(known, F.size(F.split("host", r"\.")))
    lengths = _small_set(known, F.length("path"))
    source, host, path = F.col(f"`{url}`"), free_name(pages, "h_"), free_name(pages, "p_")
    judged = pages.withColumns({host: host_of(source), path: path_of(source)})
    if not labels:
        return _named(pages, judged, F.col(host), F.col(path), F.lit(None).cast("string"), F.lit(default))

    seen = judged.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct()
    suffixes = F.array_compact(F.array(*[
        F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in labels]))
    prefixes = F.array_compact(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    expressions = seen.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).select(
        "host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"),
        F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).alias("salt")
    ).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    table = known.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"),
        _digest(F.col("host"), F.col("path")).alias("full"),
        F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])).alias("salt")
    ).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    fits = expressions.join(table, ["short", "salt"]).filter("digest = full")
    best = fits.groupBy("host", "path").agg(F.max_by(
        F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_length")).alias("best"))
    of_host, of_path, won = (free_name(judged, name) for name in ("of_host", "of_path", "won"))
    joined = judged.join(
        best.toDF(of_host, of_path, won), (F.col(host) == F.col(of_host)) & (F.col(path) == F.col(of_path)), "left")
    return _named(pages, joined, F.col(host), F.col(path), F.col(won)["rule"],
                  F.coalesce(F.col(won)["verdict"], F.lit(default)))


def _named(pages: DataFrame, df: DataFrame, *values: Column) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in RESULTS]
    return df.select(*kept, *[v.alias(n) for v, n in zip(values, RESULTS, strict=True)])
