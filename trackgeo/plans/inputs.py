"""Readings of the given tables as series, grids, frames, tiles and profiles.

Each reading stands here twice, as a Spark table and as the SQL of the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackgeo.plans.registry import table

MICROS_PER_HOUR = 3_600_000_000


def hours() -> Column:
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", start, F.col("ts")) / F.lit(float(MICROS_PER_HOUR))


def event_series(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Events of a user as a series over hours; an error event carries no measurement (`v`)."""
    return table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", hours().alias("t"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"), *more)


EV = """ev AS (
  SELECT user_id, event_id, event_type, value,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000.0::DOUBLE AS t,
         CASE WHEN event_type <> 'error' THEN value END AS v,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix
  FROM events)"""


Y_ROWS, Y_STEP, X_STEP = 100, 0.02, 0.08


def height_points(spark: SparkSession, sf: str) -> DataFrame:
    """Height grid from prices: flag = track, supplier = column, season = row, mean price = height.

    Cells without a sale are missing samples.
    """
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", "l_shipdate", "l_extendedprice")
    track = F.when(F.col("l_returnflag") == "A", 8).when(F.col("l_returnflag") == "N", 10).otherwise(14)
    y = F.floor(F.dayofyear("l_shipdate") * Y_ROWS / F.lit(367.0)).cast("int")
    # Sales meet by column once: its cells and its list are formed where they lie.
    by_column = li.select(track.alias("track_id"), F.col("l_suppkey").cast("int").alias("x_index"), y.alias("y_index"), "l_extendedprice").repartition(
        "track_id", "x_index")
    cells = by_column.groupBy("track_id", "x_index", "y_index").agg((F.avg("l_extendedprice") * 1e-6).alias("z_mm"))
    # One list entry per cell of the sensor: a column is rebuilt whole inside its group, rows without a cell behind the others.
    cell = F.when(F.col("y_index").isNotNull(), F.struct("y_index", "z_mm"))
    columns = cells.groupBy("track_id", "x_index").agg(F.collect_list(cell).alias("m"))
    empty = F.array_except(F.sequence(F.lit(0), F.lit(Y_ROWS - 1)), F.col("m.y_index"))
    return columns.select(
        "track_id", "x_index", F.inline(F.concat("m", F.transform(empty, lambda y: F.struct(y.alias("y_index"), F.lit(None).cast("double").alias("z_mm")))))
    ).select(
        "track_id", "x_index", "y_index", (100.0 - F.col("x_index") * X_STEP).alias("x_mm"),
        (F.col("y_index") * F.lit(Y_STEP)).alias("y_mm"), "z_mm")


HP = f"""cells AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 8 WHEN 'N' THEN 10 ELSE 14 END AS track_id,
         l_suppkey::INT AS x_index,
         floor(dayofyear(l_shipdate) * {Y_ROWS} / 367.0::DOUBLE)::INT AS y_index,
         avg(l_extendedprice) * 1e-6 AS z_mm
  FROM lineitem GROUP BY ALL),
hp AS (
  SELECT c.track_id, c.x_index, y.y_index, 100.0::DOUBLE - c.x_index * {X_STEP}::DOUBLE AS x_mm,
         y.y_index * {Y_STEP}::DOUBLE AS y_mm, z_mm
  FROM (SELECT DISTINCT track_id, x_index FROM cells) c
  CROSS JOIN (SELECT range::INT AS y_index FROM range({Y_ROWS})) y
  LEFT JOIN cells USING (track_id, x_index, y_index))"""


def frame_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Frames from event values: type = track, day = frame, hour = row, ten minutes = column."""
    ev = table(spark, sf, "events").select("event_type", "ts", "value")
    return ev.groupBy(
        F.col("event_type").alias("track"), F.dayofyear("ts").alias("frame_index"),
        F.hour("ts").alias("row"), F.floor(F.minute("ts") / 10).cast("int").alias("col"),
    ).agg(F.sum("value").alias("temp"))


FP = """fp AS (
  SELECT event_type AS track, dayofyear(ts)::INT AS frame_index, hour(ts)::INT AS "row",
         (minute(ts) // 10)::INT AS col, sum(value) AS temp
  FROM events GROUP BY ALL)"""


def tile_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles from line items: flag = track, line number = tile, discount = row, supplier = column."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_discount", "l_suppkey", "l_quantity")
    return li.groupBy(
        F.col("l_returnflag").alias("track"), F.col("l_linenumber").cast("int").alias("tile_index"),
        F.round(F.col("l_discount") * 100).cast("int").alias("row"), F.col("l_suppkey").alias("col"),
    ).agg(F.avg("l_quantity").alias("intensity"))


TP = """tp AS (
  SELECT l_returnflag AS track, l_linenumber::INT AS tile_index, round(l_discount * 100)::INT AS "row",
         l_suppkey AS col, avg(l_quantity) AS intensity
  FROM lineitem GROUP BY ALL)"""


def profile_table(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as profiles; elements below the noise floor of 0.01 are missing."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    raw = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(
        F.col("label").alias("track_id"), F.col("vec_id").alias("x_index"),
        (F.col("vec_id") * F.lit(0.2)).alias("x_mm"), raw.alias("full"),
        F.transform(raw, lambda v: F.when(F.abs(v) >= 0.01, v)).alias("profile"))


PR = """pr AS (
  SELECT label AS track_id, vec_id AS x_index, vec_id * 0.2::DOUBLE AS x_mm,
         list_transform(embedding, lambda v: v::DOUBLE) AS "full",
         list_transform(embedding, lambda v: CASE WHEN abs(v::DOUBLE) >= 0.01 THEN v::DOUBLE END) AS profile
  FROM embeddings)"""
