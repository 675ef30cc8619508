"""Intervals of several methods side by side, unshared length, ties of the peak seed."""

from pyspark.sql import functions as F

from trackgeo.functions import intervals as iv
from trackgeo.operators import segment as sg
from trackgeo.operators.layout import order_rows


def test_unshared_length_by_counting(spark):
    pairs = [(0, 4, 2, 6), (0, 4, 5, 9), (0, 9, 3, 4), (1, 1, 1, 3), (2, 5, 2, 5), (0, 3, 3, 5)]
    df = spark.createDataFrame([(*map(float, p),) for p in pairs] + [(1.0, 2.0, None, 3.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(iv.unshared(*[F.col(c) for c in "abcd"])).collect()]
    want = [float(len(set(range(a, b)) ^ set(range(c, d)))) for a, b, c, d in pairs]
    assert got == [*want, None]


def test_every_case_keeps_a_row(spark):
    seeds = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "no_seed")], "k int, seed_status string")
    a = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.5, 2.5), (1, 4.0, 3.5), (2, 0.0, 0.5)], "k int, y_min double, y_max double")
    c = spark.createDataFrame([(1, 0.9, 2.2), (2, None, 1.0)], "k int, left_y double, right_y double")
    d = spark.createDataFrame([(1, "ok", "ok", "ok", 0.5, 3.0), (3, "no_seed", None, None, None, None)],
                              "k int, status string, left_status string, right_status string, left_y double, right_y double")
    rows = {r["k"]: r.asDict() for r in sg.method_intervals(seeds, {"A": a}, {"C": c, "D": d}, ["k"]).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1]["A_n_thresholds"], rows[1]["A_left"], rows[1]["A_right"], rows[1]["A_width"]) == (3, 1.5, 2.5, 1.0)
    assert rows[1]["D_width"] == 2.5 and rows[1]["D_left_failure"] == "ok" and "C_status" not in rows[1]
    assert rows[2]["C_left"] is None and rows[2]["C_width"] is None and rows[2]["D_status"] is None
    assert rows[3]["A_n_thresholds"] == 0 and rows[3]["A_left"] is None and rows[3]["D_status"] == "no_seed"


def test_peak_between_two_samples_takes_the_lower(spark):
    y = [0.90 + 0.02 * i for i in range(12)]
    big = {2, 3}
    df = spark.createDataFrame([(1, i, v, 9.0 if i in big else 0.1 * i) for i, v in enumerate(y)], "k int, i int, y_mm double, residual double")
    o = order_rows(df, ["k"], ["i"], "_iy", bounded=True)
    assert [round(r["seed_y"], 6) for r in sg.peak_seed(o).collect()] == [round(y[2], 6)]
