"""Series operators against pandas/NumPy, and the chunked layout against the plain one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackgeo.operators import series as sr
from trackgeo.operators.layout import attach, order_rows
from trackgeo.operators.stats import median_and_mad, percentiles


def frame(n=400, seed=3, hot=0.6):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < hot, 0, rng.integers(1, 6, n))
    value = rng.normal(size=n).round(3)
    value[rng.random(n) < 0.2] = np.nan
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n) * 0.5, "v": value})
    return pdf.sort_values(["k", "t"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def data(spark):
    pdf = frame()
    rows = [(int(r.k), float(r.t), None if np.isnan(r.v) else float(r.v)) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "k int, t double, v double").cache()
    plain = order_rows(df, ["k"], ["t"])
    chunked = order_rows(df, ["k"], ["t"], hot_rows=50, chunk_rows=16)
    assert plain.chunk_rows is None and chunked.chunk_rows == 16
    return pdf, plain, chunked


def rows(df):
    return df.orderBy("k", "t").toPandas()


def both(data, op):
    _, plain, chunked = data
    a, b = op(plain), op(chunked)
    a = rows(a.df if hasattr(a, "df") else a)
    b = rows(b.df if hasattr(b, "df") else b)
    b = b[a.columns]
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12, atol=1e-12)
    return a


def finite_runs(mask):
    idx = np.flatnonzero(mask)
    cuts = np.split(idx, np.flatnonzero(np.diff(idx) > 1) + 1)
    return [(c[0], c[-1] + 1) for c in cuts if len(c)]


def test_index(data):
    got = both(data, lambda o: o)
    want = got.groupby("k").cumcount()
    assert (got["row_ix"] == want).all()


def test_runs(data):
    got = both(data, lambda o: sr.mark_runs(o, F.col("v") > 0))
    for _, g in got.groupby("k"):
        want = finite_runs((g["v"] > 0).to_numpy())
        have = sorted(set(zip(g["run_start"].dropna(), g["run_end"].dropna() + 1)))
        assert have == want
    n_true = (got["v"] > 0).sum()
    tables = [sr.runs(o, F.col("v") > 0) for o in data[1:]]
    for table in tables:
        assert table.agg(F.sum("run_length")).first()[0] == n_true
        longest = sr.longest_run(table, ["k"]).toPandas().set_index("k")
        for k, g in got.groupby("k"):
            best = max(finite_runs((g["v"] > 0).to_numpy()), key=lambda r: (r[1] - r[0], -r[0]))
            assert (longest.loc[k, "run_start"], longest.loc[k, "run_stop"]) == best


@pytest.mark.parametrize("window,min_run", [(5, 1), (4, 3), (9, 2)])
def test_smooth(data, window, min_run):
    def op(o):
        return sr.smooth_in_runs(sr.mark_runs(o, F.col("v").isNotNull()), "v", window, min_run)

    got = both(data, op)
    w = window if window % 2 else window + 1
    for _, g in got.groupby("k"):
        z = g["v"].to_numpy(float)
        want = np.full(len(z), np.nan)
        for a, b in finite_runs(np.isfinite(z)):
            want[a:b] = z[a:b]
            if b - a >= min_run:
                padded = np.pad(z[a:b], w // 2, mode="edge")
                want[a:b] = np.convolve(padded, np.ones(w) / w, mode="valid")
        np.testing.assert_allclose(g["smooth"].to_numpy(float), want, atol=1e-12)


def test_gradient(data):
    def op(o):
        return sr.gradient_in_runs(sr.mark_runs(o, F.col("v").isNotNull()), "v", "t", 3)

    got = both(data, op)
    for _, g in got.groupby("k"):
        z, t = g["v"].to_numpy(float), g["t"].to_numpy(float)
        want = np.full(len(z), np.nan)
        for a, b in finite_runs(np.isfinite(z)):
            if b - a >= 3:
                want[a:b] = np.gradient(z[a:b], t[a:b])
        np.testing.assert_allclose(g["gradient"].to_numpy(float), want, rtol=1e-9, atol=1e-12)


def test_smoothed_target(data):
    got = both(data, lambda o: sr.smoothed_target(o, "v", "s"))
    for _, g in got.groupby("k"):
        want = (
            g["v"].astype(float)
            .interpolate(limit_direction="both")
            .rolling(11, center=True, min_periods=1)
            .mean()
        )
        np.testing.assert_allclose(g["s"].to_numpy(float), want.ffill().bfill(), atol=1e-9)


def test_windows_and_differences(data):
    got = both(data, lambda o: sr.sliding_windows(o, 5, ["t", "v"], ["k", "t"]))
    sizes = data[0].groupby("k").size()
    assert len(got) == sum(max(0, s - 4) for s in sizes)
    diff = both(data, lambda o: sr.differences(o, "v"))
    want = diff.groupby("k")["v"].transform(lambda s: s.astype(float).diff())
    np.testing.assert_allclose(diff["diff1"].to_numpy(float), want)


def test_local_maxima(data):
    got = both(data, lambda o: sr.local_maxima(o, "v", 5))
    count = 0
    for _, g in data[0].groupby("k"):
        z = g["v"].to_numpy(float)
        for a, b in finite_runs(np.isfinite(z)):
            if b - a >= 5:
                count += sum(z[i] >= z[i - 1] and z[i] >= z[i + 1] for i in range(a + 1, b - 1))
    assert len(got) == count


def test_active_interval(spark):
    score = np.r_[np.full(60, 1.0), np.full(15, 9.0), np.full(10, 1.0), np.full(90, 10.0), np.full(20, 1.0)]
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(score)], "k int, t int, s double")
    for sizes in ({}, {"hot_rows": 50, "chunk_rows": 16}):
        row = sr.active_interval(order_rows(df, ["k"], ["t"], **sizes), "s", keep_rows=40).first()
        assert (row["on_index"], row["off_index"], row["first_kept"]) == (85, 175, 135)


def test_percentiles_hot_equals_plain(data, spark):
    pdf, plain, _ = data
    df = plain.df
    a = percentiles(df, ["k"], {"v": "v", "t": "t"}, [0.05, 0.5, 0.95]).orderBy("k").toPandas()
    b = percentiles(df, ["k"], {"v": "v", "t": "t"}, [0.05, 0.5, 0.95], hot_rows=20).orderBy("k").toPandas()
    for c in ("v", "t"):
        np.testing.assert_allclose(np.stack(a[c]), np.stack(b[c]), atol=1e-12)
        want = np.stack([np.nanpercentile(g[c], [5, 50, 95]) for _, g in pdf.groupby("k")])
        np.testing.assert_allclose(np.stack(a[c]), want, atol=1e-12)
    whole = percentiles(df, [], {"v": "v"}, [0.5], hot_rows=20).first()["v"][0]
    assert abs(whole - np.nanmedian(pdf["v"])) < 1e-12
    spread = median_and_mad(df, ["k"], ["v"], hot_rows=20).orderBy("k").toPandas()
    want = [1.4826 * np.nanmedian(np.abs(g["v"] - np.nanmedian(g["v"]))) for _, g in pdf.groupby("k")]
    np.testing.assert_allclose(spread["v_mad"], want, atol=1e-9)


def test_attach_wants_one_row(spark):
    df, two = spark.range(3), spark.createDataFrame([(1.5,), (2.5,)], "m double")
    assert [r.m for r in attach(df, two.limit(1), []).collect()] == [1.5] * 3
    assert [r.m for r in attach(df, two.filter("m > 9"), []).collect()] == [None] * 3
    with pytest.raises(Exception, match="must be one row"):
        attach(df, two, []).collect()
