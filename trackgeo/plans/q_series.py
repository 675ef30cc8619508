"""Series queries over the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgeo.operators import series as sr
from trackgeo.operators.layout import order_rows
from trackgeo.plans.inputs import EV, event_series
from trackgeo.plans.registry import query, r, rounded

ORDER = ["t", "event_id"]


def ordered(spark, sf, *more):
    return order_rows(event_series(spark, sf, *more), ["user_id"], ORDER, "ix")


@query("sliding_windows", f"""WITH {EV}, w AS (
  SELECT user_id, event_id, ix,
         list(value) OVER f AS vs, list(t) OVER f AS ts
  FROM ev WINDOW f AS (PARTITION BY user_id ORDER BY ix ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, vs[1] AS t0_value, vs[5] AS t4_value, round(ts[1], 6) AS t0_t, round(ts[5], 6) AS t4_t,
       len(vs) * 2 AS n_features
FROM w WHERE ix >= 4""")
def sliding_windows(spark, sf):
    o = ordered(spark, sf)
    w = sr.flatten_window(sr.sliding_windows(o, 5, ["value", "t"], ["user_id", "event_id"]))
    names = sr.window_feature_names(5, ["value", "t"])
    at = lambda n: F.get("features", F.lit(names.index(n)))
    return w.select(
        "user_id", "event_id", at("t0_value").alias("t0_value"), at("t4_value").alias("t4_value"),
        r(at("t0_t")).alias("t0_t"), r(at("t4_t")).alias("t4_t"), F.size("features").alias("n_features"))


RUNS = f"""{EV}, m AS (
  SELECT user_id, ix, ix - row_number() OVER (PARTITION BY user_id ORDER BY ix) AS g
  FROM ev WHERE value > 20.0),
runs AS (SELECT user_id, min(ix) AS run_start, max(ix) + 1 AS run_stop, count(*) AS run_length
  FROM m GROUP BY user_id, g)"""


@query("finite_runs", f"WITH {RUNS} SELECT * FROM runs")
def finite_runs(spark, sf):
    return sr.runs(ordered(spark, sf), F.col("value") > 20.0)


@query("longest_run", f"""WITH {RUNS} SELECT user_id, run_start, run_stop, run_length FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run_length DESC, run_start) AS k FROM runs) WHERE k = 1""")
def longest_run(spark, sf):
    return sr.longest_run(finite_runs(spark, sf), ["user_id"])


@query("run_count", f"WITH {RUNS} SELECT user_id, count(*) AS n_runs FROM runs GROUP BY user_id")
def run_count(spark, sf):
    return sr.run_count(finite_runs(spark, sf), ["user_id"])


VRUN = f"""{EV}, k AS (
  SELECT *, ix - row_number() OVER (PARTITION BY user_id, v IS NULL ORDER BY ix) AS g FROM ev),
vr AS (SELECT *, row_number() OVER p AS rn, count(*) OVER (PARTITION BY user_id, g, v IS NULL) AS n
  FROM k WHERE v IS NOT NULL WINDOW p AS (PARTITION BY user_id, g ORDER BY ix))"""


@query("smooth_in_runs", f"""WITH {VRUN}
SELECT user_id, event_id, round(CASE WHEN n < 3 THEN v ELSE (
    sum(v) OVER f + greatest(0, 3 - rn) * first_value(v) OVER f + greatest(0, rn + 2 - n) * last_value(v) OVER f) / 5.0::DOUBLE END, 6) AS smooth
FROM vr WINDOW f AS (PARTITION BY user_id, g ORDER BY ix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def smooth_in_runs(spark, sf):
    o = sr.mark_runs(ordered(spark, sf), F.col("v").isNotNull())
    o = sr.smooth_in_runs(o, "v", 5, 3)
    return rounded(o.where(F.col("v").isNotNull()).select("user_id", "event_id", "smooth"), 6)


@query("gradient_in_runs", f"""WITH {VRUN}, n AS (
  SELECT *, lag(v) OVER p AS vp, lead(v) OVER p AS vn, t - lag(t) OVER p AS hp, lead(t) OVER p - t AS hn
  FROM vr WINDOW p AS (PARTITION BY user_id, g ORDER BY ix))
SELECT user_id, event_id, round(CASE WHEN rn = 1 THEN (vn - v) / hn WHEN rn = n THEN (v - vp) / hp
  ELSE (hp * hp * vn + (hn * hn - hp * hp) * v - hn * hn * vp) / (hp * hn * (hp + hn)) END, 4) AS gradient
FROM n WHERE n >= 3""")
def gradient_in_runs(spark, sf):
    o = sr.mark_runs(ordered(spark, sf), F.col("v").isNotNull())
    o = sr.gradient_in_runs(o, "v", "t", 3)
    return rounded(o.where(F.col("gradient").isNotNull()).select("user_id", "event_id", "gradient"), 4)


LIN = f"""{EV}, nb AS (
  SELECT *, last_value(CASE WHEN v IS NOT NULL THEN ix END IGNORE NULLS) OVER b AS pi,
         last_value(v IGNORE NULLS) OVER b AS pv,
         first_value(CASE WHEN v IS NOT NULL THEN ix END IGNORE NULLS) OVER a AS ni,
         first_value(v IGNORE NULLS) OVER a AS nv
  FROM ev WINDOW b AS (PARTITION BY user_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 a AS (PARTITION BY user_id ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lin AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv
         ELSE pv + (nv - pv) * (ix - pi) / (ni - pi)::DOUBLE END AS filled FROM nb)"""


@query("interpolate_linear", f"WITH {LIN} SELECT user_id, event_id, round(filled, 6) AS filled FROM lin")
def interpolate_linear(spark, sf):
    o = sr.interpolate_linear(ordered(spark, sf), "v", "filled")
    return rounded(o.df.select("user_id", "event_id", "filled"), 6)


@query("smoothed_target", f"""WITH {LIN} SELECT user_id, event_id, round(avg(filled) OVER (
  PARTITION BY user_id ORDER BY ix ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smoothed FROM lin""")
def smoothed_target(spark, sf):
    o = sr.smoothed_target(ordered(spark, sf), "v", "smoothed")
    return rounded(o.df.select("user_id", "event_id", "smoothed"), 6)


@query("rolling_mean", f"""WITH {EV} SELECT user_id, event_id, round(avg(v) OVER (
  PARTITION BY user_id ORDER BY ix ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS mean FROM ev""")
def rolling_mean(spark, sf):
    o = sr.rolling_mean(ordered(spark, sf), "v", 11, "mean")
    return rounded(o.df.select("user_id", "event_id", "mean"), 6)


@query("fill_forward_backward", f"WITH {LIN} SELECT user_id, event_id, coalesce(pv, nv) AS filled FROM lin")
def fill_forward_backward(spark, sf):
    return sr.fill_forward_backward(ordered(spark, sf), "v", "filled").df.select("user_id", "event_id", "filled")


@query("rank_fraction", """WITH k AS (SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank_of, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, rank_of, round(CASE WHEN n > 1 THEN (rank_of - 1) / (n - 1)::DOUBLE ELSE 0.0 END, 9) AS rank_fraction FROM k""")
def rank_fraction(spark, sf):
    ev = event_series(spark, sf).select("user_id", "event_id", "value")
    return rounded(sr.ranks(ev, ["user_id"], "value", ["event_id"]).drop("value"), 9)


@query("differences", f"""WITH {EV} SELECT user_id, event_id, round(value - lag(value) OVER p, 6) AS diff1,
  round(value - 2 * lag(value) OVER p + lag(value, 2) OVER p, 6) AS diff2
FROM ev WINDOW p AS (PARTITION BY user_id ORDER BY ix)""")
def differences(spark, sf):
    o = sr.differences(ordered(spark, sf), "value")
    return rounded(o.df.select("user_id", "event_id", "diff1", "diff2"), 6)


@query("local_maxima", f"""WITH {VRUN}, n AS (
  SELECT *, lag(v) OVER p AS vp, lead(v) OVER p AS vn FROM vr WINDOW p AS (PARTITION BY user_id, g ORDER BY ix))
SELECT user_id, event_id, v FROM n WHERE n >= 5 AND v >= vp AND v >= vn AND v > 10.0""")
def local_maxima(spark, sf):
    peaks = sr.local_maxima(ordered(spark, sf), "v", 5, F.lit(10.0))
    return peaks.select("user_id", "event_id", "v")


@query("best_with_runner_up", """WITH k AS (
  SELECT user_id, event_id, value / 100.0::DOUBLE AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY value / 100.0::DOUBLE DESC, event_id) AS rn FROM events),
b AS (SELECT user_id, max(CASE WHEN rn = 1 THEN event_id END) AS event_id, max(CASE WHEN rn = 1 THEN score END) AS score,
  max(CASE WHEN rn = 2 THEN score END) AS runner_up_score FROM k WHERE rn <= 2 GROUP BY user_id),
a AS (SELECT *, CASE WHEN runner_up_score IS NOT NULL AND score > 0 THEN runner_up_score / score ELSE 0.0 END AS ambiguity FROM b)
SELECT user_id, event_id, round(score, 9) AS score, round(runner_up_score, 9) AS runner_up_score, round(ambiguity, 9) AS ambiguity,
  CASE WHEN score < 1.5 THEN 'low_score' WHEN ambiguity >= 0.85 THEN 'ambiguous' ELSE 'selected' END AS status FROM a""")
def best_with_runner_up(spark, sf):
    ev = event_series(spark, sf).select("user_id", "event_id", (F.col("value") / 100.0).alias("score"))
    return rounded(sr.best_with_runner_up(ev, ["user_id"], "score", ["event_id"], 1.5, 0.85), 9)


@query("active_interval", f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
idle AS (SELECT * FROM n WHERE ix < greatest(5, floor(n / 10))),
m AS (SELECT user_id, median(value) AS med FROM idle GROUP BY user_id),
d AS (SELECT user_id, med, 1.4826 * median(abs(value - med)) AS mad FROM idle JOIN m USING (user_id) GROUP BY user_id, med),
s AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM ev GROUP BY user_id),
th AS (SELECT user_id, greatest(lo + 0.2::DOUBLE * (hi - lo), med + 8.0 * greatest(mad, 1e-12::DOUBLE)) AS thr FROM s JOIN d USING (user_id)),
a AS (SELECT user_id, ix, thr, ix - row_number() OVER (PARTITION BY user_id ORDER BY ix) AS g
  FROM ev JOIN th USING (user_id) WHERE value > thr),
runs AS (SELECT user_id, any_value(thr) AS thr, min(ix) AS a, max(ix) + 1 AS b, count(*) AS n FROM a GROUP BY user_id, g),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, a) AS k FROM runs)
SELECT user_id, round(thr, 6) AS active_threshold, a AS on_index, b AS off_index, greatest(0, b - 400) AS first_kept FROM best WHERE k = 1""")
def active_interval(spark, sf):
    return rounded(sr.active_interval(ordered(spark, sf), "value"), 6)


@query("cumulative_explained", """WITH c AS (
  SELECT l_linenumber::BIGINT AS component, var_pop(l_extendedprice) AS e FROM lineitem GROUP BY 1),
s AS (SELECT component, e / sum(e) OVER () AS ratio FROM c),
k AS (SELECT component, ratio, sum(ratio) OVER (ORDER BY component) AS cum FROM s),
t AS (SELECT unnest([0.5, 0.8, 0.9])::DOUBLE AS target)
SELECT target, min(component) AS n_components FROM t LEFT JOIN k ON cum >= target GROUP BY target""")
def cumulative_explained(spark, sf):
    from trackgeo.operators.layout import attach
    from trackgeo.plans.registry import table

    c = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("component")).agg(
        F.var_pop("l_extendedprice").alias("e"))
    shares = attach(c, c.agg(F.sum("e").alias("te")), []).select("component", (F.col("e") / F.col("te")).alias("explained_ratio"))
    return sr.cumulative_explained(shares, [0.5, 0.8, 0.9])[1]
