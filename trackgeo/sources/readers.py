"""Table, run and instrument-text readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackgeo.operators.contracts import ContractError, require_columns, require_rows
from trackgeo.operators.layout import attach, order_rows

DEFAULT_PIXEL_MM = 0.003982


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet",
    required: list[str] | None = None,
) -> DataFrame:
    """A table that must exist, hold rows and have the required columns; CSV needs a schema."""
    reader = spark.read
    if fmt == "csv":
        if schema is None:
            raise ContractError(f"{path}: give a schema for text tables")
        df = reader.schema(schema).option("header", True).csv(path)
    else:
        df = (reader.schema(schema) if schema else reader).format(fmt).load(path)
    require_columns(df, required or [], path)
    return require_rows(df, path)


def track_of_name(name: Column) -> Column:
    """Track number in a file name: digits set off by separators, so 1 never matches 10 or 21."""
    return F.regexp_extract(name, r"(?:^|[_\-\s])(\d+)(?:$|[_\-\s.])", 1).try_cast("int")


def natural_key(name: Column) -> Column:
    """Sort key that compares digit groups as numbers: digits padded to a fixed width."""
    digits = F.regexp_replace(F.lower(name), r"(\d+)", "\u0001$1\u0001")
    parts = F.split(digits, "\u0001")
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """File names below `pattern` with their natural order key; contents are not read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", name.alias("name"), natural_key(name).alias("sort_key"))


def file_for_track(files: DataFrame) -> DataFrame:
    """First file of each track in natural order."""
    named = files.withColumn("track_id", track_of_name(F.col("name"))).filter("track_id is not null")
    return named.groupBy("track_id").agg(F.min_by("path", F.struct("sort_key", "path")).alias("path"))


def number_tiles(files: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles of a track numbered from 1 in natural order."""
    o = order_rows(files, keys, ["sort_key", "path"], "_i", bounded=True)
    return o.df.withColumn("tile_index", (F.col("_i") + 1).cast("int")).drop("_i")


def latest_run(df: DataFrame, tag: str = "run_tag") -> DataFrame:
    """Rows of the newest run; the tag is a partition column, so older runs are not read."""
    newest = df.agg(F.max(tag)).first()[0]
    if newest is None:
        raise ContractError("no run found")
    return df.filter(F.col(tag) == F.lit(newest))


def read_per_track(spark: SparkSession, paths: dict[int, str], schema: str, fmt: str = "parquet") -> DataFrame:
    """One file or folder per expected track as one table.

    A missing path, rows of another track inside one, and a track without rows raise. The first two travel with
    the plan; the last compares expected with observed tracks before the table is returned.
    """
    if not paths:
        raise ContractError("no track expected")

    def one(track: int, path: str) -> DataFrame:
        part = spark.read.schema(schema).format(fmt).option("header", True).load(path)
        require_columns(part, ["track_id"], path)
        wrong = F.raise_error(F.lit(f"{path} holds rows of another track")).cast(part.schema["track_id"].dataType)
        return part.withColumn("track_id", F.when(F.col("track_id") == track, F.col("track_id")).otherwise(wrong))

    whole = reduce(DataFrame.unionByName, [one(t, p) for t, p in sorted(paths.items())])
    expected = spark.createDataFrame([(t,) for t in sorted(paths)], "track_id int")
    lost = expected.join(whole.select("track_id").distinct(), "track_id", "left_anti").collect()
    if lost:
        raise ContractError(f"no rows of tracks {sorted(r.track_id for r in lost)}")
    return whole


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Loadings and mean as `write_model` left them."""
    return read_table(spark, f"{path}/loadings"), read_table(spark, f"{path}/mean")


def read_height_text(spark: SparkSession, path: str, hot_rows: int = 1_000_000, chunk_rows: int | None = None) -> DataFrame:
    """Height points from profilometer text files.

    A file is a header (`X Size n`, `Y Size n`, `Pixel_size … p`), a line `RAW_DATA`, then lines
    whose third token is z in nm or `Bad`; points run along y first. Lines are split over tasks;
    a point's number is its line's rank among the data lines of its file, taken with the size-checked
    row numbering, so a large file is numbered in many tasks. Missing points at the end stay out:
    compare with `expected_points`.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.split(F.trim("value"), r"\s+").alias("t"))
    word = lambda i: F.upper(F.get("t", F.lit(i)))
    size = F.get("t", F.lit(2)).try_cast("double").cast("long")
    is_header = lambda a: (word(0) == a) & (word(1) == "SIZE")
    order = F.struct("_block", "_id")
    header = lines.groupBy("file").agg(
        F.max(F.when(is_header("X"), size)).alias("x_size"),
        F.max(F.when(is_header("Y"), size)).alias("y_size"),
        F.max(F.when(word(0) == "PIXEL_SIZE", F.element_at("t", -1).try_cast("double"))).alias("pixel"),
        F.min(F.when(word(0) == "RAW_DATA", order)).alias("_raw"))
    data = attach(lines, header, ["file"]).filter((order > F.col("_raw")) & (F.size("t") >= 3))
    o = order_rows(data, ["file"], ["_block", "_id"], "n", hot_rows, chunk_rows)
    pixel = F.coalesce("pixel", F.lit(DEFAULT_PIXEL_MM))
    z = F.get("t", F.lit(2))
    points = o.df.filter(F.col("n") < F.col("x_size") * F.col("y_size"))
    x = F.floor(F.col("n") / F.col("y_size"))
    name = F.element_at(F.split("file", "/"), -1)
    return points.select(
        track_of_name(name).alias("track_id"), "file",
        x.cast("int").alias("x_index"), (F.col("n") % F.col("y_size")).cast("int").alias("y_index"),
        (F.lit(100.0) - x * pixel).alias("x_mm"), (F.col("n") % F.col("y_size") * pixel).alias("y_mm"),
        F.when(F.lower(z) != "bad", z.cast("double") * 1e-6).alias("z_mm"),
        (F.col("x_size") * F.col("y_size")).alias("expected_points"))


def tile_extents(tiles: DataFrame, keys: list[str], index: str = "tile_index", length: float = 100.0) -> DataFrame:
    """x interval and midpoint of every tile: tile 1 starts at `length` and x steps down."""
    count = tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = length / F.col("_n")
    hi = length - (F.col(index) - 1) * step
    return attach(tiles, count, keys).withColumns({
        "x_start_mm": hi - step, "x_end_mm": hi, "x_midpoint_mm": hi - step / 2}).drop("_n")
