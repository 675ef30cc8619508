"""Shared small helpers of the operators: words, names, sizes."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgeo.session import durable

#: Words are maximal runs of characters other than space, tab, LF, VT, FF and CR.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
MARKS, PAGE = 1 << 24, 1 << 15  # bits of `may_match` in all (2 MB), and of one of Spark's bitmaps


def words_column(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def words_of(text: str | None) -> list[bytes]:
    """The same words inside a task. `bytes.split` breaks at just those six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the search for cycles: the tasks make millions of plain objects and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def may_match(df: DataFrame, key: Column, keys: DataFrame, known: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` that may have their `key` among the numbers `known` of `keys`, and those that cannot, found without moving rows.

    A table of `MARKS` bits, of fixed size at any number of keys, goes to all tasks; a key that is no known one passes as one
    with odds of known keys / `MARKS`. Null keys cannot match.
    """
    page = free_name(df, "page")
    bits = free_name(df, "bits")
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(MARKS))
    marks = durable(keys.filter(known.isNotNull()).select(place(known).alias("at")).groupBy(F.floor(F.col("at") / PAGE).alias(page)).agg(
        F.bitmap_construct_agg(F.col("at") % PAGE).alias(bits)))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place(key) % PAGE / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    paged = df.withColumn(page, F.floor(place(key) / PAGE)).join(F.broadcast(marks), page, "left")
    hit = key.isNotNull() & F.coalesce(F.getbit(byte, (place(key) % 8).cast("int")) == 1, F.lit(False))
    return paged.filter(hit).select(*df.columns), paged.filter(~hit).select(*df.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_count(spark: SparkSession, units: int, per_group: int) -> int:
    """Number of groups that keeps each at `per_group` units or fewer on average."""
    return max(shuffle_partitions(spark), -(-units // per_group))
