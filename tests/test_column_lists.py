"""Columns of a height grid: gathered once, with the results of plain medians."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from trackgeo.operators import grid as gr
from trackgeo.plans.inputs import Y_ROWS, height_points


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _grid(spark):
    rng = np.random.default_rng(7)
    rows = [(0, x, y, 1.0 * x, y * 0.02, None if rng.random() < 0.2 or x == 3 else float(rng.normal())) for x in range(5) for y in range(100)]
    rows += [(0, None, y, 0.0, y * 0.02, 1.0) for y in range(100)]  # a column without a number has no baseline
    return rows, spark.createDataFrame(rows, "track_id int, x_index int, y_index int, x_mm double, y_mm double, z_mm double")


def test_column_baseline_gathers_a_column_once(spark):
    rows, df = _grid(spark)
    t = gr.column_baseline(df, ["track_id"], 10, bounded=True)
    assert _plan(t).count("Join") == 3  # distances and spread of the whole track, and both to the columns
    got = {r["x_index"]: r for r in t.collect()}
    assert set(got) == set(range(5)) and got[3]["fallback"] and got[3]["n_substrate"] == 0
    for x in (0, 1, 2, 4):
        s = np.array([z * 1e3 for _, i, _, _, y, z in rows if i == x and z is not None and (y < 0.65 or y > 1.35)])
        assert got[x]["n_substrate"] == len(s) and not got[x]["fallback"]
        assert np.isclose(got[x]["baseline_um"], np.median(s)) and np.isclose(got[x]["spread_um"], 1.4826 * np.median(abs(s - np.median(s))))


def test_section_metrics_gather_a_column_once(spark):
    rows, df = _grid(spark)
    fields = df.filter("x_index is not null").withColumns({
        "z_um": F.col("z_mm") * 1e3, "signed_residual": F.col("z_mm") * 1e3 - 2.0, "spread_um": F.lit(3.0), "baseline_um": F.lit(2.0), "n_substrate": F.lit(60)})
    t = gr.section_metrics(fields, ["track_id"])
    assert _plan(t).count("Join") == 1  # the ends of the track
    for r in t.collect():
        at = [(y, z * 1e3 - 2.0) for _, i, _, _, y, z in rows if i == r["x_index"] and z is not None]
        c, s = (np.array([v for y, v in at if (0.65 <= y <= 1.35) == middle]) for middle in (True, False))
        if not len(c):
            assert r["central_median"] is r["central_iqr"] is r["substrate_mad"] is r["event_strength"] is None
            continue
        want = [np.median(c), np.subtract(*np.percentile(c, [75, 25])), np.median(abs(c) / 3.0), np.median(s), 1.4826 * np.median(abs(s - np.median(s))), np.median(c) + 2.0]
        assert np.allclose([r[k] for k in ("central_median", "central_iqr", "event_strength", "substrate_median", "substrate_mad", "detrended_central_median")], want)


def test_height_points_keep_a_column_with_an_undated_sale(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [("A", 1, day, 5e6), ("A", 1, day, 7e6), ("A", 1, None, 9e6), ("A", 2, None, 9e6), ("N", 1, dt.date(2024, 12, 31), None)]
    spark.createDataFrame(rows, "l_returnflag string, l_suppkey long, l_shipdate date, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = height_points(spark, str(tmp_path)).collect()
    assert sorted((r["track_id"], r["x_index"], r["y_index"]) for r in got) == [(t, x, y) for t, x in ((8, 1), (8, 2), (10, 1)) for y in range(Y_ROWS)]
    assert [(r["track_id"], r["x_index"], r["y_index"], r["z_mm"]) for r in got if r["z_mm"] is not None] == [(8, 1, 0, 6.0)]
