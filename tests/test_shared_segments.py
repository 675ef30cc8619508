"""Configurations that share a baseline or components are computed once and extracted as if alone."""

from dataclasses import replace

from pyspark.sql import functions as F

from trackgeo.config import CONTROL, variants
from trackgeo.operators import grid as gr
from trackgeo.plans import pipeline as pl

BASE = replace(CONTROL, threshold_k=0.5, min_samples=2, min_width=0.015, smooth_window=3, min_run=3, ambiguity_ratio=0.97, min_score=0.5, min_baseline=5)
CONFIGS = variants(BASE, {
    "NO_WIDTH": {"width_weight": 0.0}, "NO_CENTRE": {"centre_weight": 0.0}, "HIGH": {"threshold_k": 1.0},
    "OTHER_LIMITS": {"exclusion_lo": 0.75}, "WIDE": {"smooth_window": 5, "edge_margin": 0.1}})


def profiles(spark):
    rows = [(t, x, y, 0.02 * y, None if (x * 7 + y) % 11 == 0 else float((x * 31 + y * y * 17 + t) % 23 + 40 * (40 <= y + x < 52)))
            for t in (1, 2) for x in range(5) for y in range(100)]
    return spark.createDataFrame(rows, "track_id int, position long, y_index int, y_mm double, z_um double")


def test_a_sweep_equals_its_configurations_alone(spark):
    p = profiles(spark)
    got = sorted((tuple(r) for r in pl.extract_sections(p, ["track_id"], "position", CONFIGS).collect()), key=str)
    alone = [tuple(r) for c in CONFIGS for r in pl.extract_sections(p, ["track_id"], "position", [c]).collect()]
    assert got == sorted(alone, key=str)
    assert len(got) == 60 and sum(r[-1] == "selected" for r in got) > 30


def test_rows_stand_once_per_segment(spark):
    p = profiles(spark)
    rows, comps = pl.scored_components(p, ["track_id", "position"], CONFIGS)
    assert rows.count() == 3 * p.count()  # CONTROL, HIGH and OTHER_LIMITS; the others find the components of CONTROL
    assert {r.config_name for r in comps.select("config_name").distinct().collect()} == {c.config_name for c in CONFIGS}


def test_baseline_equals_the_percentile_aggregates_in_one_shuffle(spark):
    p = profiles(spark).withColumn("z_um", F.when(F.col("position") < 4, F.col("z_um")))
    got = gr.profile_baseline(p, ["track_id", "position"], min_samples=30)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    sub = F.when(gr.substrate(), F.col("z_um"))
    want = {(r.track_id, r.position): r.m for r in p.groupBy("track_id", "position").agg(F.median(sub).alias("m")).collect()}
    assert {(r.track_id, r.position): r.baseline for r in got.collect()} == want
