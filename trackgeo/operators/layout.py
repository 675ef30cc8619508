"""Row order at scale.

A series (one track) may hold a third of all rows, so a window partitioned by the track alone
would put that third into one task. Everything ordered in this library therefore runs on
`Ordered`, which knows two layouts of the same rows:

* whole series: every series is known to fit a task, windows partition by the series keys;
* chunked: rows carry a dense index, a chunk is `chunk_rows` consecutive indexes, bounded frames
  see a few copied border rows, and unbounded frames are a scan inside the chunk plus a scan over
  one summary row per chunk.

Both give the same values; the choice follows a count of the largest series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackgeo.session import durable

HOT_ROWS = 1_000_000
ALL = "_all"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group; reads only the key columns."""
    sizes = df.groupBy(*keys).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def fits_a_task(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> dict[str, bool]:
    """Result of one size check, to hand on to every operator that works on the same groups."""
    return {"bounded": largest_group(df, keys) <= hot_rows}


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Add one-row-per-group `stats` to every row; without keys `stats` is a single row, and two rows raise.

    A plain equi-join: the adaptive planner measures `stats`, broadcasts it when it is small and
    splits skewed partitions when it is not.
    """
    if keys:
        return df.join(stats, keys, how)
    one = stats.agg(F.count("*").alias("n"), F.first(F.struct("*")).alias("row")).filter("n > 0").select(
        F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit("statistics without keys must be one row"))).alias("row"))
    return (
        df.withColumn(ALL, F.lit(1))
        .join(F.broadcast(one.select("row.*", F.lit(1).alias(ALL))), ALL, how)
        .drop(ALL)
    )


@dataclass(frozen=True)
class Ordered:
    """Rows of many series with a dense zero-based `index` inside each series."""

    df: DataFrame
    keys: tuple[str, ...]
    index: str
    chunk_rows: int | None = None

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return self.with_df(self.df.withColumns(columns))

    def where(self, condition: Column) -> DataFrame:
        """Filtered rows as a plain table (the index is no longer dense)."""
        return self.df.filter(condition)

    def _chunk(self) -> Column:
        return F.floor(F.col(self.index) / F.lit(self.chunk_rows))

    def rolling(
        self,
        before: int,
        after: int,
        build: Callable[[WindowSpec], dict[str, Column]],
        by: tuple[str, ...] = (),
    ) -> Ordered:
        """Columns over frames reaching at most `before` rows back and `after` rows ahead.

        `by` narrows the window to rows that share more columns (a run inside the series).
        """
        if self.chunk_rows is None:
            w = Window.partitionBy(*self.keys, *by).orderBy(self.index)
            return self.with_columns(build(w))
        c, size = self._chunk(), self.chunk_rows
        if max(before, after) > size:
            raise ValueError(f"frame of {before}+{after} rows exceeds the chunk of {size}")
        offset = F.col(self.index) % size
        copies = F.array_compact(
            F.array(
                c,
                F.when((offset < after) & (c > 0), c - 1),
                F.when(offset >= size - before, c + 1),
            )
        )
        spread = self.df.withColumn("_home", c).withColumn("_chunk", F.explode(copies))
        w = Window.partitionBy(*self.keys, "_chunk", *by).orderBy(self.index)
        done = spread.withColumns(build(w)).filter("_home = _chunk").drop("_home", "_chunk")
        return self.with_df(done)

    def _scan(self, columns: dict[str, Column], kind: str, strict: bool) -> Ordered:
        order = F.col(self.index).desc() if kind == "next" else F.col(self.index)
        upto = (Window.unboundedPreceding, -1 if strict else 0)

        def over(value: Column, w: WindowSpec) -> Column:
            if kind == "sum":
                return F.coalesce(F.sum(value).over(w.rowsBetween(*upto)), F.lit(0))
            return F.last(value, ignorenulls=True).over(w.rowsBetween(*upto))

        if self.chunk_rows is None:
            w = Window.partitionBy(*self.keys).orderBy(order)
            return self.with_columns({name: over(v, w) for name, v in columns.items()})

        keys = list(self.keys)
        work = self.df.withColumn("_chunk", self._chunk()).withColumns(
            {f"_v_{name}": value for name, value in columns.items()}
        )
        pick = {"last": F.max_by, "next": F.min_by}
        summaries = []
        for name in columns:
            v = F.col(f"_v_{name}")
            if kind == "sum":
                summaries.append(F.sum(v).alias(f"_s_{name}"))
            else:
                at = F.when(v.isNotNull(), F.col(self.index))
                summaries.append(pick[kind](v, at).alias(f"_s_{name}"))
        chunks = work.groupBy(*keys, "_chunk").agg(*summaries)
        chunk_order = F.col("_chunk").desc() if kind == "next" else F.col("_chunk")
        over_chunks = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(
            Window.unboundedPreceding, -1
        )
        incoming = {
            f"_i_{name}": (
                F.sum(f"_s_{name}") if kind == "sum" else F.last(f"_s_{name}", ignorenulls=True)
            ).over(over_chunks)
            for name in columns
        }
        # Only chunks with a neighbour can receive anything: at most rows / chunk_rows of them.
        inbound = chunks.select(*keys, "_chunk", *[c.alias(n) for n, c in incoming.items()])
        inbound = inbound.filter(
            F.greatest(*[F.col(n).isNotNull().cast("int") for n in incoming], F.lit(0)) == 1
        )
        w = Window.partitionBy(*keys, "_chunk").orderBy(order)
        local = work.withColumns(
            {f"_l_{name}": over(F.col(f"_v_{name}"), w) for name in columns}
        )
        joined = local.join(inbound, [*keys, "_chunk"], "left")
        for name in columns:
            if kind == "sum":
                value = F.col(f"_l_{name}") + F.coalesce(F.col(f"_i_{name}"), F.lit(0))
            else:
                value = F.coalesce(F.col(f"_l_{name}"), F.col(f"_i_{name}"))
            joined = joined.withColumn(name, value)
        scratch = ["_chunk"] + [f"{p}{n}" for p in ("_v_", "_l_", "_i_") for n in columns]
        return self.with_df(joined.drop(*scratch))

    def carry_last(self, columns: dict[str, Column], strict: bool = False) -> Ordered:
        """Latest non-null value at or before each row (before it when `strict`)."""
        return self._scan(columns, "last", strict)

    def carry_next(self, columns: dict[str, Column], strict: bool = False) -> Ordered:
        """Earliest non-null value at or after each row (after it when `strict`)."""
        return self._scan(columns, "next", strict)

    def running_sum(self, columns: dict[str, Column], strict: bool = False) -> Ordered:
        return self._scan(columns, "sum", strict)

    def lengths(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_rows"))

    def with_length(self, name: str = "n_rows") -> Ordered:
        if self.chunk_rows is None:
            w = Window.partitionBy(*self.keys)
            return self.with_columns({name: F.count(F.lit(1)).over(w)})
        sizes = self.lengths().withColumnRenamed("n_rows", name)
        return self.with_df(attach(self.df, sizes, list(self.keys)))


def order_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    index: str = "row_ix",
    hot_rows: int = HOT_ROWS,
    chunk_rows: int | None = None,
    bounded: bool = False,
) -> Ordered:
    """Number the rows of every series by `order`, which must not tie.

    `bounded` states that a series cannot outgrow a task (one instrument column, one frame) and
    skips the size check. Above `hot_rows` the rows are range-partitioned on (keys, order), so a
    hot series spreads over as many tasks as it needs, and numbered per partition plus offset.
    """
    if not keys:
        df, keys = df.withColumn(ALL, F.lit(1)), [ALL]
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if bounded or largest_group(df, keys) <= hot_rows:
        w = Window.partitionBy(*keys).orderBy(*cols)
        numbered = df.withColumn(index, F.row_number().over(w).cast("long") - 1)
        return Ordered(numbered, tuple(keys), index)

    chunk = chunk_rows or hot_rows
    spark = df.sparkSession
    n_parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), int(df.count() // chunk) + 1
    )
    ranged = durable(
        df.repartitionByRange(n_parts, *[F.col(k) for k in keys], *cols).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A series starts an earlier partition for at most one series per partition: n_parts rows.
    offsets = (
        ranged.groupBy(*keys, "_part")
        .count()
        .select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), F.sum("count").over(before).alias("_before"))
        .filter(F.col("_before").isNotNull())
    )
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):  # rows without a key are a series too
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    w = Window.partitionBy(*keys, "_part").orderBy(*cols)
    numbered = (
        ranged.withColumn("_local", F.row_number().over(w).cast("long") - 1)
        .join(F.broadcast(offsets), same, "left")
        .withColumn(index, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_local", "_before", "_part", "_at", *[f"_key{i}" for i in range(len(keys))])
    )
    return Ordered(numbered, tuple(keys), index, chunk)
