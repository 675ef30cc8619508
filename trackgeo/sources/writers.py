"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(df: DataFrame, path: str, run_tag: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Result table of one stage and run; runs are partitions of one table."""
    writer = df.withColumn("run_tag", F.lit(run_tag)).write.mode(mode).partitionBy("run_tag")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """Run summary or configuration as one JSON record with sorted keys."""
    names = sorted(summary)
    row = spark.range(1).select(*[F.lit(summary[n]).alias(n) for n in names])
    row.write.mode("overwrite").json(path)


def write_model(loadings: DataFrame, means: DataFrame, path: str) -> None:
    """A frozen linear model as two tables."""
    loadings.write.mode("overwrite").parquet(f"{path}/loadings")
    means.write.mode("overwrite").parquet(f"{path}/mean")


def predictions_table(
    predictions: DataFrame, identity: list[str], targets: list[str], model_name: str, alpha: float,
    feature_group: str, window: int,
) -> DataFrame:
    """Export shape: identity, predicted targets and constant model columns."""
    return predictions.select(
        *identity, *[f"predicted_{t}" for t in targets], F.lit(model_name).alias("model_name"),
        F.lit(alpha).alias("ridge_alpha"), F.lit(feature_group).alias("feature_group"), F.lit(window).alias("window_size"))
