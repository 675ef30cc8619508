"""Regression queries: windows of events, folds of users, closed-form models and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgeo.config import feature_groups
from trackgeo.functions import scores as sc
from trackgeo.operators import forests as fr
from trackgeo.operators import learn as ln
from trackgeo.operators import metrics as mt
from trackgeo.operators.layout import order_rows
from trackgeo.plans.inputs import EV, event_series
from trackgeo.plans.registry import query, r, rounded, table
from trackgeo.session import durable

ORDER = ["t", "event_id"]
FEATURES = ["value", "gap", "hour"]
GROUPS = feature_groups(["value", "gap"], ["hour"])
MODELS = {"linear": 0, "ridge": 1.0}


def learning_rows(spark, sf):
    """Events with the gap since the last one and the hour; targets: the next value and next gap.

    The fold is the user's remainder by three, so a fold holds whole series.
    """
    o = order_rows(event_series(spark, sf).select("user_id", "event_id", "t", "value"), ["user_id"], ORDER, "ix")
    o = o.rolling(1, 1, lambda w: {
        "gap": F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0)),
        "next_value": F.lead("value").over(w), "next_gap": F.lead("t").over(w) - F.col("t")})
    rows = o.where(F.col("next_value").isNotNull())
    return rows.select("user_id", "event_id", "t", "value", "gap", (F.col("t") % 24.0).alias("hour"), "next_value", "next_gap",
                       F.pmod("user_id", F.lit(3)).alias("fold"))


LR = f"""{EV}, lr0 AS (SELECT user_id, event_id, t, value, coalesce(t - lag(t) OVER w, 0.0) AS gap, lead(value) OVER w AS next_value, lead(t) OVER w - t AS next_gap, user_id % 3 AS fold
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ix)),
lr AS (SELECT *, t % 24.0 AS hour FROM lr0 WHERE next_value IS NOT NULL)"""
TARGETS = ["next_value", "next_gap"]


def windows(spark, sf, n=5, targets=TARGETS, features=FEATURES, **kw):
    rows = durable(learning_rows(spark, sf))
    return rows, durable(ln.training_windows(rows, "user_id", ORDER, n, features, targets, "fold", **kw))


@query("train_only_scaling", f"""WITH {LR}, s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(gap) AS mg, stddev_pop(gap) AS sg FROM lr WHERE fold <> 0)
SELECT user_id, event_id, round((value - mv) / sv, 6) AS value, round((gap - mg) / sg, 6) AS gap FROM lr, s""")
def train_only_scaling(spark, sf):
    t = ln.standardise(learning_rows(spark, sf), F.col("fold") != 0, ["value", "gap"])
    return rounded(t.select("user_id", "event_id", "value", "gap"), 6)


@query("fold_scaling", f"""WITH {LR}, f AS (SELECT DISTINCT fold FROM lr) SELECT f.fold, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, round(avg(gap), 6) AS mean_gap,
  round(stddev_pop(gap), 6) AS std_gap FROM f JOIN lr ON lr.fold <> f.fold GROUP BY 1""")
def fold_scaling(spark, sf):
    return rounded(ln.scale_stats(learning_rows(spark, sf), "fold", ["value", "gap"]), 6)


@query("derived_features", f"""WITH {LR} SELECT user_id, event_id, round(sqrt(greatest(value - 50.0, 0.0)), 6) AS sqrt_excess, round((t - 60.0) / 40.0, 6) AS unit_t, round(ln(1 + greatest(gap, 0.0)), 6) AS log_gap FROM lr""")
def derived_features(spark, sf):
    """Square root of what exceeds a level, normalised position and logarithm of a gap; listed columns once each, in order."""
    rows = learning_rows(spark, sf).withColumns({
        "sqrt_excess": sc.sqrt_positive(F.col("value") - 50.0), "unit_t": sc.unit_position(F.col("t")), "log_gap": sc.log1p_positive(F.col("gap"))})
    return rounded(rows.select(*dict.fromkeys(["user_id", "event_id", "sqrt_excess", "unit_t", "sqrt_excess", "log_gap"])), 6)


# One lagged feature pair per window of one row: the ridge solve is a 2 × 2 system SQL can write.
RIDGE2 = f"""{LR}, f AS (SELECT DISTINCT fold FROM lr), m AS (SELECT f.fold, count(*) AS n, avg(value) AS mx, avg(gap) AS mg, avg(next_value) AS my, var_pop(value) AS sx, var_pop(gap) AS sg,
   covar_pop(value, gap) / sqrt(var_pop(value) * var_pop(gap)) AS c, covar_pop(value, next_value) / sqrt(var_pop(value)) AS bx, covar_pop(gap, next_value) / sqrt(var_pop(gap)) AS bg
  FROM f JOIN lr ON lr.fold <> f.fold GROUP BY 1),
w AS (SELECT *, 1.0 + a / n AS p FROM m, (VALUES ('linear', 0.0), ('ridge', 1.0)) v(model, a)),
k AS (SELECT fold, model, n, (bx * p - bg * c) / (p * p - c * c) / sqrt(sx) AS wx, (bg * p - bx * c) / (p * p - c * c) / sqrt(sg) AS wg, mx, mg, my FROM w),
md AS (SELECT fold, model, n, wx, wg, my - wx * mx - wg * mg AS b FROM k)"""


def two_feature_models(spark, sf):
    rows, w = windows(spark, sf, 1, ["next_value"], ["value", "gap"])
    return w, ln.fold_models(w, rows, "fold", ["value", "gap"], 1, {"both": ["value", "gap"]}, MODELS)


@query("loto_coefficients", f"WITH {RIDGE2} SELECT fold, model, n AS n_train, round(wx, 6) AS w_value, round(wg, 6) AS w_gap, round(b, 6) AS intercept FROM md")
def loto_coefficients(spark, sf):
    _, m = two_feature_models(spark, sf)
    at = lambda i: F.get(F.get("coef", F.lit(0)), F.lit(i))
    return rounded(m.select("fold", "model", "n_train", at(0).alias("w_value"), at(1).alias("w_gap"), F.get("intercept", F.lit(0)).alias("intercept")), 6)


PRED2 = f"""{RIDGE2}, pd AS (SELECT lr.fold, model, user_id, event_id, next_value AS y, b + wx * value + wg * gap AS yh FROM lr JOIN md USING (fold)),
ms AS (SELECT model, fold, count(*) AS n, avg(abs(yh - y)) AS mae, sqrt(avg(pow(yh - y, 2))) AS rmse, median(abs(yh - y)) AS med, 1 - sum(pow(yh - y, 2)) / (var_pop(y) * count(*)) AS r2
  FROM pd GROUP BY GROUPING SETS ((model, fold), (model)))"""


@query("loto_ridge_metrics", f"WITH {PRED2} SELECT model, fold, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(med, 6) AS median_absolute_error, round(r2, 6) AS r2 FROM ms")
def loto_ridge_metrics(spark, sf):
    """Windows, held-out scaling, closed-form models, predictions, metrics per fold and pooled."""
    w, m = two_feature_models(spark, sf)
    long = ln.scored_long(ln.predict(w, m, "fold", ["next_value"]), ["model", "fold"], ["next_value"])
    both = mt.regression_metrics(durable(long), ["model", "fold"], [["model", "fold"], ["model"]])
    return rounded(both.drop("target", "level"), 6)


@query("model_comparison_text", f"""WITH {PRED2}, a AS (SELECT r.mae - l.mae AS dm, r.rmse - l.rmse AS dr, r.r2 - l.r2 AS d2 FROM ms l, ms r WHERE l.fold IS NULL AND r.fold IS NULL AND l.model = 'linear' AND r.model = 'ridge')
SELECT round(dm, 6) AS mae_delta, round(dr, 6) AS rmse_delta, round(d2, 6) AS r2_delta, CASE WHEN abs(dm) <= 1e-6 THEN 'similar' WHEN dm < 0 THEN 'improved' ELSE 'worsened' END AS mae_change,
  CASE WHEN abs(dr) <= 1e-6 THEN 'similar' WHEN dr < 0 THEN 'improved' ELSE 'worsened' END AS rmse_change, CASE WHEN abs(d2) <= 1e-6 THEN 'similar' WHEN d2 > 0 THEN 'improved' ELSE 'worsened' END AS r2_change FROM a""")
def model_comparison_text(spark, sf):
    """Pooled errors of ridge against least squares, each change in words."""
    w, m = two_feature_models(spark, sf)
    long = ln.scored_long(ln.predict(w, m, "fold", ["next_value"]), ["model"], ["next_value"])
    both = durable(mt.regression_metrics(long, ["model"]))
    names = ["mae", "rmse", "r2"]
    d = ln.delta_to_reference(both.filter("model = 'linear'").drop("model"), both.filter("model = 'ridge'").drop("model"), ["target"], names)
    words = {f"{c}_change": sc.model_change(F.col(c), F.col(f"{c}_reference"), lower_is_better=c != "r2") for c in names}
    return rounded(d.withColumns(words).select(*[f"{c}_delta" for c in names], *words), 6)


@query("pooled_fold_ranking", f"""WITH {PRED2}, a AS (SELECT p.model, p.n, p.mae, p.rmse, p.med, p.r2, count(*) AS n_folds, avg(f.mae) AS am, stddev_pop(f.mae) AS sm, avg(f.rmse) AS ar, stddev_pop(f.rmse) AS sr, avg(f.r2) AS a2, stddev_pop(f.r2) AS s2
  FROM ms p JOIN ms f ON f.model = p.model AND f.fold IS NOT NULL WHERE p.fold IS NULL GROUP BY ALL)
SELECT model, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(med, 6) AS median_absolute_error, round(r2, 6) AS r2, n_folds, round(am, 6) AS mean_fold_mae, round(sm, 6) AS std_fold_mae,
  round(ar, 6) AS mean_fold_rmse, round(sr, 6) AS std_fold_rmse, round(a2, 6) AS mean_fold_r2, round(s2, 6) AS std_fold_r2, row_number() OVER (ORDER BY mae, rmse, med) AS model_rank FROM a""")
def pooled_fold_ranking(spark, sf):
    w, m = two_feature_models(spark, sf)
    long = durable(ln.scored_long(ln.predict(w, m, "fold", ["next_value"]), ["model", "fold"], ["next_value"]))
    _, pooled = mt.pooled_and_fold(long, ["model"], "fold")
    return rounded(mt.rank_models(pooled), 6)


@query("constant_baseline_metrics", f"""WITH {LR}, f AS (SELECT DISTINCT fold FROM lr), c AS (SELECT f.fold, avg(next_value) AS m FROM f JOIN lr ON lr.fold <> f.fold GROUP BY 1), p AS (SELECT fold, next_value AS y, m AS yh FROM lr JOIN c USING (fold))
SELECT fold, count(*) AS n, round(avg(abs(yh - y)), 6) AS mae, round(sqrt(avg(pow(yh - y, 2))), 6) AS rmse, round(median(abs(yh - y)), 6) AS median_absolute_error, round(1 - sum(pow(yh - y, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY 1""")
def constant_baseline_metrics(spark, sf):
    _, w = windows(spark, sf, 1, ["next_value"], ["value"])
    long = ln.scored_long(ln.constant_predictions(w, "fold", ["next_value"]), ["fold"], ["next_value"])
    return rounded(mt.regression_metrics(long, ["fold"]).drop("target"), 6)


@query("metrics_by_track", """WITH l AS (SELECT l_returnflag AS track, 'quantity' AS target, l_quantity AS y, l_linenumber * 7.0 AS yh FROM lineitem UNION ALL SELECT l_returnflag, 'price', l_extendedprice, 2000.0 * l_quantity FROM lineitem UNION ALL
  SELECT l_returnflag, 'flat', 1.0, l_discount FROM lineitem),
m AS (SELECT CASE WHEN grouping(track) = 1 THEN 'all' ELSE 'track' END AS scope, track, target, count(*) AS n, avg(abs(yh - y)) AS mae, sqrt(avg(pow(yh - y, 2))) AS rmse, median(abs(yh - y)) AS med,
  CASE WHEN max(y) > min(y) THEN 1 - sum(pow(yh - y, 2)) / (var_pop(y) * count(*)) END AS r2 FROM l GROUP BY GROUPING SETS ((track, target), (target)))
SELECT scope, track, target, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(med, 6) AS median_absolute_error, round(r2, 6) AS r2 FROM m UNION ALL
SELECT scope, track, '(uniform average)', max(n), round(avg(mae), 6), round(avg(rmse), 6), round(avg(med), 6), round(avg(r2), 6) FROM m GROUP BY 1, 2""")
def metrics_by_track(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("track"), "l_quantity", "l_extendedprice", "l_discount", (F.col("l_linenumber") * 7.0).alias("pq"),
        (2000.0 * F.col("l_quantity")).alias("pp"), F.lit(1.0).alias("one"))
    long = mt.pairs(li, ["track"], {"quantity": ("l_quantity", "pq"), "price": ("l_extendedprice", "pp"), "flat": ("one", "l_discount")})
    return rounded(mt.metrics_by_track(long, "track"), 6)


@query("feature_group_ablation")
def feature_group_ablation(spark, sf):
    """Thermal, SEM and both groups, least squares and ridge, held out by fold: 18 fold rows."""
    rows, w = windows(spark, sf)
    m = ln.fold_models(w, rows, "fold", FEATURES, 5, GROUPS, MODELS)
    long = durable(ln.scored_long(ln.predict(w, m, "fold", TARGETS), ["feature_group", "model", "fold"], TARGETS))
    folds, _ = mt.pooled_and_fold(long, ["feature_group", "model"], "fold")
    return rounded(folds, 4)


# Each modality alone (one feature) and both (two features), windows of one row: every solve is a line of SQL.
SELECTION = f"""{LR}, f AS (SELECT DISTINCT fold FROM lr), m AS (SELECT f.fold, count(*) AS n, avg(value) AS mx, avg(gap) AS mg, avg(next_value) AS my, var_pop(value) AS sx, var_pop(gap) AS sg,
   covar_pop(value, gap) / sqrt(var_pop(value) * var_pop(gap)) AS c, covar_pop(value, next_value) / sqrt(var_pop(value)) AS bx, covar_pop(gap, next_value) / sqrt(var_pop(gap)) AS bg
  FROM f JOIN lr ON lr.fold <> f.fold GROUP BY 1),
w AS (SELECT *, 1.0 + a / n AS p FROM m, (VALUES ('linear', 0.0), ('ridge', 1.0)) v(model, a)),
k AS (SELECT 'thermal' AS feature_group, fold, model, bx / p / sqrt(sx) AS wx, 0.0 AS wg, mx, mg, my FROM w UNION ALL SELECT 'sem', fold, model, 0.0, bg / p / sqrt(sg), mx, mg, my FROM w UNION ALL
 SELECT 'thermal_sem', fold, model, (bx * p - bg * c) / (p * p - c * c) / sqrt(sx), (bg * p - bx * c) / (p * p - c * c) / sqrt(sg), mx, mg, my FROM w),
pd AS (SELECT feature_group, model, fold, next_value AS y, my + wx * (value - mx) + wg * (gap - mg) AS yh FROM lr JOIN k USING (fold)),
ms AS (SELECT feature_group, model, fold, count(*) AS n, avg(abs(yh - y)) AS mae, sqrt(avg(pow(yh - y, 2))) AS rmse, median(abs(yh - y)) AS med, 1 - sum(pow(yh - y, 2)) / (var_pop(y) * count(*)) AS r2
  FROM pd GROUP BY GROUPING SETS ((feature_group, model, fold), (feature_group, model)))"""


@query("model_selection_closed_form", f"""WITH {SELECTION} SELECT feature_group, model, fold, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(med, 6) AS median_absolute_error, round(r2, 6) AS r2
FROM ms WHERE fold IS NOT NULL""")
def model_selection_closed_form(spark, sf):
    """The least-squares and ridge rows of the selection: 18 fold rows of one target."""
    rows, w = windows(spark, sf, 1, ["next_value"], ["value", "gap"])
    folds, _ = selection(rows, w, ["value", "gap"], 1, feature_groups(["value"], ["gap"]), ["next_value"], forests=False)
    return rounded(folds, 6)


@query("model_selection_closed_form_pooled", f"""WITH {SELECTION}, a AS (SELECT p.feature_group, p.model, p.n, p.mae, p.rmse, p.med, p.r2, count(*) AS n_folds, avg(f.mae) AS am, stddev_pop(f.mae) AS sm, avg(f.rmse) AS ar, stddev_pop(f.rmse) AS sr,
  avg(f.r2) AS a2, stddev_pop(f.r2) AS s2 FROM ms p JOIN ms f ON f.model = p.model AND f.feature_group = p.feature_group AND f.fold IS NOT NULL WHERE p.fold IS NULL GROUP BY ALL)
SELECT feature_group, model, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(med, 6) AS median_absolute_error, round(r2, 6) AS r2, n_folds, round(am, 6) AS mean_fold_mae, round(sm, 6) AS std_fold_mae,
  round(ar, 6) AS mean_fold_rmse, round(sr, 6) AS std_fold_rmse, round(a2, 6) AS mean_fold_r2, round(s2, 6) AS std_fold_r2 FROM a""")
def model_selection_closed_form_pooled(spark, sf):
    rows, w = windows(spark, sf, 1, ["next_value"], ["value", "gap"])
    _, pooled = selection(rows, w, ["value", "gap"], 1, feature_groups(["value"], ["gap"]), ["next_value"], forests=False)
    return rounded(pooled, 6)


def selection(rows, w, features, n, groups, targets, forests=True, **forest_sizes):
    """Fold rows and pooled rows of every feature group and model; `event_id` names a window."""
    keys = ["feature_group", "model", "fold"]
    m = ln.fold_models(w, rows, "fold", features, n, groups, MODELS)
    long = ln.scored_long(ln.predict(w, m, "fold", targets), keys, targets)
    if forests:
        grown, limits = fr.forest_models(w, rows, "fold", "event_id", features, n, groups, **forest_sizes)
        guess = w.join(fr.forest_predictions(w, grown, limits, "fold", "event_id", targets), "event_id")
        long = long.unionByName(ln.scored_long(guess, keys, targets))
    return mt.pooled_and_fold(durable(long), keys[:2], "fold")


@query("model_selection_folds")
def model_selection_folds(spark, sf):
    """Least squares, ridge and a forest of 300 trees on each feature group, held out by fold: 27 rows for three folds."""
    rows, w = windows(spark, sf)
    folds, _ = selection(rows, w, FEATURES, 5, GROUPS, TARGETS)
    return rounded(folds, 4)


@query("model_selection")
def model_selection(spark, sf):
    """The same run pooled over folds, with mean and deviation of the folds, ranked: 9 rows."""
    rows, w = windows(spark, sf)
    _, pooled = selection(rows, w, FEATURES, 5, GROUPS, TARGETS)
    return rounded(mt.rank_models(pooled), 4)


@query("forest_importances")
def forest_importances(spark, sf):
    """Ranked importance of every flattened feature in the forest of all features, per held-out fold."""
    from trackgeo.operators.series import window_feature_names

    rows, w = windows(spark, sf, 3)
    grown, _ = fr.forest_models(w, rows, "fold", "event_id", FEATURES, 3, {"thermal_sem": FEATURES})
    return rounded(fr.forest_importances(grown, "fold", window_feature_names(3, FEATURES)), 4)


@query("bayesian_ridge")
def bayesian_ridge(spark, sf):
    rows, w = windows(spark, sf, 3, ["next_value"])
    m = ln.fold_models(w, rows, "fold", FEATURES, 3, {"both": FEATURES}, {"bayesian_ridge": "bayes"})
    long = ln.scored_long(ln.predict(w, m, "fold", ["next_value"]), ["model", "fold"], ["next_value"])
    return rounded(mt.regression_metrics(long, ["model", "fold"]).drop("target"), 4)


@query("coordinate_augmented_ridge")
def coordinate_augmented_ridge(spark, sf):
    """Ridge with and without the normalised position, and the change of the pooled metrics."""
    out = []
    for coordinate in (None, "t"):
        rows, w = windows(spark, sf, 5, ["next_value"], ["value", "gap"], coordinate=coordinate)
        m = ln.fold_models(w, rows, "fold", ["value", "gap"], 5, {"sem": ["value", "gap"]}, {"ridge": 1.0}, 1 if coordinate else 0)
        long = ln.scored_long(ln.predict(w, m, "fold", ["next_value"]), ["model", "fold"], ["next_value"])
        out.append(durable(mt.regression_metrics(long, ["model"])))
    d = ln.delta_to_reference(out[0], out[1], ["model", "target"], ["mae", "rmse", "r2"])
    return rounded(d.withColumn("change", sc.model_change(F.col("mae"), F.col("mae_reference"))), 4)


@query("blind_predictions")
def blind_predictions(spark, sf):
    """Fit on folds 0 and 1, predict every window of the sealed fold 2 without its targets."""
    from trackgeo.sources.writers import predictions_table

    rows, w = windows(spark, sf)
    train = w.filter("fold <> 2")
    m = ln.split_models(train, rows.filter("fold <> 2"), FEATURES, 5, {"thermal_sem": FEATURES}, {"ridge": 1.0})
    sealed = w.filter("fold = 2").withColumn("y", F.lit(None).cast("array<double>"))
    p = ln.predict(sealed, m, None, TARGETS)
    return rounded(predictions_table(p, ["user_id", "event_id"], TARGETS, "Ridge", 1.0, "thermal_sem", 5), 4)


@query("random_forest_importance")
def random_forest_importance(spark, sf):
    from trackgeo.operators.series import window_feature_names

    _, w = windows(spark, sf, 3, ["next_value"])
    _, table_ = ln.forest(w.filter("fold <> 0"), w.filter("fold = 0"), ["next_value"], window_feature_names(3, FEATURES), trees=20, depth=6)
    return rounded(mt.importance_share(table_, "timestep"), 4)
