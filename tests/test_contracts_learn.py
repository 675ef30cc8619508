"""Negative contract tests, and closed-form models against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgeo.operators import contracts as dq
from trackgeo.operators import joins as jn
from trackgeo.operators import learn as ln
from trackgeo.operators import metrics as mt
from trackgeo.operators import profiles as pr
from trackgeo.operators import segment as sg
from trackgeo.sources import readers, writers


def test_contracts_raise(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan"))], "k int, v double")
    for check in (lambda: dq.require_columns(df, ["x"]), lambda: dq.require_unique(df, ["k"]),
                  lambda: dq.require_finite(df, ["v"]), lambda: dq.require_rows(df.filter("k = 9"))):
        with pytest.raises(dq.ContractError):
            check()
    with pytest.raises(Exception, match="sealed"):
        dq.sealed_guard(df, "k", [1]).collect()
    one = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(dq.ContractError):
        jn.one_to_one(one, df, ["k"])
    with pytest.raises(dq.ContractError):
        jn.one_to_one(one, spark.createDataFrame([(3, 1)], "k int, w int"), ["k"])
    with pytest.raises(dq.ContractError):
        jn.one_to_one(one, spark.createDataFrame([(1, 1)], "k int, w int"), ["k"], require_match=one["k"] > 0)


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(1)
    n = 240
    x = rng.normal(size=(n, 2)) * [3.0, 0.2] + [50.0, 1.0]
    y = x @ [0.5, -4.0] + rng.normal(size=n)
    rows = [(int(i % 3), int(i), float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "fold int, i int, a double, b double, y1 double")
    w = ln.training_windows(df.withColumn("track", df["fold"]), "track", ["i"], 2, ["a", "b"], ["y1"], "fold")
    m = ln.fold_models(w, df, "fold", ["a", "b"], 2, {"all": ["a", "b"]}, {"ridge": 1.0, "linear": 0})
    got = {(r["fold"], r["model"]): (np.array(r["coef"][0]), r["intercept"][0]) for r in m.collect()}
    fold = np.arange(n) % 3
    for f in range(3):
        sd = x[fold != f].std(axis=0)
        wx, wy = [], []
        for g in range(3):
            if g != f:
                xs, ys = x[fold == g], y[fold == g]
                wx += [np.r_[xs[i - 1], xs[i]] for i in range(1, len(xs))]
                wy += list(ys[1:])
        wx, wy = np.array(wx), np.array(wy)
        s = np.tile(sd, 2)
        z = (wx - wx.mean(axis=0)) / s
        for name, alpha in (("ridge", 1.0), ("linear", 0.0)):
            want = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (wy - wy.mean())) / s
            coef, b = got[f, name]
            np.testing.assert_allclose(coef, want, rtol=1e-6, atol=1e-8)
            assert abs(b - (wy.mean() - wx.mean(axis=0) @ want)) < 1e-5


def test_pca_and_similarity(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)) @ rng.normal(size=(8, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, ready array<double>")
    loadings, mean = pr.fit_pca(df)
    values = np.array([r["explained_variance"] for r in loadings.orderBy("component").collect()])
    np.testing.assert_allclose(values, np.linalg.svd(x - x.mean(axis=0))[1] ** 2 / 59, rtol=1e-9)
    errors = pr.reconstruction_errors(df, loadings, mean, ["i"], [8]).collect()
    assert max(r["rmse"] for r in errors) < 1e-6
    pair = spark.createDataFrame([([1.0, 2.0, None, 4.0, 5.0, 6.0], [2.0, 4.1, 9.0, 8.0, None, 12.0])], "a array<double>, b array<double>")
    r = pair.select(pr.similarity(pair["a"], pair["b"], 0.6, 4).alias("s")).first()["s"]
    assert r["n_shared"] == 4 and abs(r["similarity"] - np.corrcoef([1, 2, 4, 6], [2, 4.1, 8, 12])[0, 1]) < 1e-12


def test_packed_moments_merge_and_subtract(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 7)) * 0.01 + 1e6  # sums of raw squares would lose every digit
    rows = [(i % 3, [float(v) for v in r]) for i, r in enumerate(x)] + [(9, [1.0] * 7)]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(11)
    got = {r.k: r for r in pr.moments(df, ["k"], "v", max_groups_held=2).collect()}
    for k in (0, 1, 2, 9):
        part = np.array([v for kk, v in rows if kk == k])
        mean, full = pr.unpack(got[k].mean, got[k].triangle)
        assert got[k].n == len(part)
        np.testing.assert_allclose(mean, part.mean(axis=0), rtol=1e-14)
        np.testing.assert_allclose(full, (part - part.mean(axis=0)).T @ (part - part.mean(axis=0)), atol=1e-7)
    one = pr.moments(df, [], "v").collect()
    assert len(one) == 1 and one[0].n == 901
    packed = [(r.n, np.frombuffer(r.mean), np.frombuffer(r.triangle)) for r in (got[0], got[1])]
    n, mean, triangle = pr.without(pr.merged(packed), packed[0])
    assert n == packed[1][0]
    np.testing.assert_allclose(mean, packed[1][1], rtol=1e-12)
    np.testing.assert_allclose(triangle, packed[1][2], atol=1e-6)
    assert pr.moments(df.limit(0), ["k"], "v").count() == 0


def test_empty_training_set_and_missing_target_raise(spark):
    rows = [(0, i, float(i), 1.0 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "fold int, i int, a double, y1 double")
    w = ln.training_windows(df.withColumn("track", df["fold"]), "track", ["i"], 2, ["a"], ["y1"], "fold")
    with pytest.raises(Exception, match="no training rows"):
        ln.fold_models(w, df, "fold", ["a"], 2, {"all": ["a"]}, {"ridge": 1.0}).collect()
    p = spark.createDataFrame([(1, [None], 2.0)], "k int, y array<double>, predicted_y1 double")
    with pytest.raises(Exception, match="missing in an evaluation row"):
        ln.scored_long(p, ["k"], ["y1"]).collect()


def test_target_alignment(spark):
    keys = "track_id int, frame_index int, x_position_mm double"
    meta = spark.createDataFrame([(8, 1, 0.2), (8, 2, 0.4)], keys)
    rows = [(8, 1, 0.2, 0.3, True, True), (8, 2, 0.4, None, True, False), (8, 3, 0.6, 0.5, False, True)]
    data = spark.createDataFrame(rows, keys + ", smoothed_macro_width_mm double, eligible boolean, is_within_heightmap_x_coverage boolean")
    group = "smoothed_macro_width"
    good = dq.align_targets(meta.filter("frame_index = 1"), data, group).collect()
    assert [tuple(r) for r in good] == [(8, 1, 0.2, 0.3, True, True)]
    with pytest.raises(Exception, match="smoothed_macro_width_mm is missing at"):
        dq.align_targets(meta, data, group).collect()
    with pytest.raises(Exception, match="no target row at"):
        dq.align_targets(meta.withColumn("track_id", meta["track_id"] + 1), data, group).collect()
    with pytest.raises(dq.ContractError):
        dq.align_targets(meta.unionByName(meta), data, group)
    with pytest.raises(dq.ContractError):
        dq.align_targets(meta, data, "width")
    report = dq.target_group_report(data, {group: dq.TARGET_GROUPS[group]}).collect()[0]
    assert (report.n_rows, report.null_target_rows, report.flagged_rows, report.usable_rows) == (3, 1, 1, 1)


def test_model_contract_on_arrays(spark):
    loadings = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1, 6)], "component int, loading array<double>")
    mean = spark.createDataFrame([([0.0, 1.0],)], "mean array<double>")
    passed = lambda l, m, **kw: dq.model_contract(l, m, **kw).first()["passed"]
    assert passed(loadings, mean) and passed(loadings, mean, y_grid=[0.1, 0.2])
    assert not passed(loadings, mean, y_grid=[0.1]) and not passed(loadings, mean, min_components=6)
    assert not passed(loadings, mean, y_grid=[0.1, float("nan")])
    for bad in ([1.0], [1.0, float("nan")], [1.0, None], [float("inf"), 0.0]):
        assert not passed(loadings.unionByName(spark.createDataFrame([(6, bad)], "component int, loading array<double>")), mean)
    assert not passed(loadings, mean.limit(0)) and not passed(loadings.limit(0), mean)


def test_files_per_track_and_model_files(spark, tmp_path):
    for track in (8, 10):
        spark.createDataFrame([(track, 1.5)], "track_id int, v double").write.parquet(str(tmp_path / f"t{track}"))
    paths = {t: str(tmp_path / f"t{t}") for t in (8, 10)}
    read = lambda p: readers.read_per_track(spark, p, "track_id int, v double")
    assert {r.track_id for r in read(paths).collect()} == {8, 10}
    with pytest.raises(Exception, match="holds rows of another track"):
        read({8: paths[10]}).collect()
    with pytest.raises(Exception):
        read({8: paths[8], 14: str(tmp_path / "none")}).collect()
    spark.createDataFrame([], "track_id int, v double").write.parquet(str(tmp_path / "t14"))
    with pytest.raises(dq.ContractError, match="14"):
        read({8: paths[8], 14: str(tmp_path / "t14")})
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(40, 4)))], "i int, ready array<double>")
    loadings, mean = pr.fit_pca(df)
    writers.write_model(loadings, mean, str(tmp_path / "model"))
    again = readers.read_model(spark, str(tmp_path / "model"))
    score = lambda l, m: [tuple(r) for r in pr.project(df, l, m, 3).select("i", "pc1", "pc2", "pc3").orderBy("i").collect()]
    assert score(*again) == score(loadings, mean)


def test_json_object(spark):
    row = spark.range(1).select(dq.json_object(b=F.lit(1), a=F.lit(None).cast("string"), c=F.lit("x\"y")).alias("j")).first()
    assert row["j"] == '{"a":null,"b":1,"c":"x\\"y"}'


def test_metrics_of_several_levels(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k) if k < 3 else None, t, float(a), float(p)) for k, t, a, p in zip(
        rng.integers(0, 4, 400), rng.choice(["x", "y"], 400), rng.normal(size=400), rng.normal(size=400))]
    long = spark.createDataFrame(rows, "k int, target string, actual double, predicted double").repartition(5)
    got = {(r.level, r.k, r.target): r for r in mt.regression_metrics(long, ["k"], [["k"], []]).collect()}
    assert len(got) == 10
    for (level, k, target), r in got.items():
        some = np.array([(a, p) for kk, t, a, p in rows if t == target and (level == 1 or kk == k)])
        off = some[:, 1] - some[:, 0]
        want = [np.abs(off).mean(), np.sqrt((off ** 2).mean()), np.median(np.abs(off)), 1 - (off ** 2).sum() / (some[:, 0].var() * len(some))]
        assert r.n == len(some)
        np.testing.assert_allclose([r.mae, r.rmse, r.median_absolute_error, r.r2], want, rtol=1e-9)


def test_failure_counts(spark):
    rows = spark.createDataFrame([("ok", None), ("edge_of_profile", "ok"), ("edge_of_profile", "edge_of_profile")], "left_status string, right_status string")
    assert {tuple(r) for r in sg.failure_counts(rows).collect()} == {("(none)", 1, 2), ("edge_of_profile", 2, 1)}
