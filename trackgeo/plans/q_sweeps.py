"""Profile queries: components, edges, extraction and its sweeps, corridor, method audit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from trackgeo.config import CONTROL, variants
from trackgeo.functions import intervals as iv
from trackgeo.functions import scores as sc
from trackgeo.operators import grid as gr
from trackgeo.operators import joins as jn
from trackgeo.operators import segment as sg
from trackgeo.operators import stats as st
from trackgeo.operators.layout import attach
from trackgeo.plans import pipeline as pl
from trackgeo.plans.inputs import HP, height_points
from trackgeo.plans.q_grid import SUB
from trackgeo.plans.registry import query, r, rounded
from trackgeo.session import durable

KEYS, CASE = ["track_id"], ["track_id", "position"]
STEP, HALF = 0.16, 0.17

BASE = replace(
    CONTROL, threshold_k=0.5, min_samples=2, min_width=0.015, smooth_window=3, min_run=3, ambiguity_ratio=0.97, min_score=1.8)
THR = variants(BASE, {f"THR_{k}": {"threshold_k": k} for k in (0.25, 0.75, 1.0)})
ABLATION = variants(BASE, {
    "NO_HEIGHT": {"height_weight": 0.0}, "NO_WIDTH": {"width_weight": 0.0}, "NO_CENTRE": {"centre_weight": 0.0},
    "NO_CONTINUITY": {"continuity_weight": 0.0}, "BROAD_WIDTH": {"width_mode": "broad_range"}})

DERIVED = variants(BASE, {"DATA_WIDTH": {"width_mode": pl.DATA_DERIVED}})
PRIOR_FLOOR = 0.01

BAND = HP + f""",
sp AS (SELECT track_id, min(x_mm) AS lo, max(x_mm) AS hi FROM hp GROUP BY 1),
ct AS (SELECT track_id, unnest(range(0, floor((hi - lo) / {STEP} + 1e-9)::BIGINT + 1)) AS position, lo FROM sp),
bp AS (SELECT track_id, position, y_index, min(y_mm) AS y_mm, median(z_mm) * 1e3 AS z
  FROM ct JOIN hp USING (track_id) WHERE abs(x_mm - (lo + position * {STEP}::DOUBLE)) <= {HALF} GROUP BY ALL),
p1 AS (SELECT track_id, position, count(z) FILTER ({SUB}) AS ns, count(z) AS na, median(z) FILTER ({SUB}) AS ms, median(z) AS ma, avg((z IS NOT NULL)::INT) AS ff FROM bp GROUP BY 1, 2),
p2 AS (SELECT track_id, position, 1.4826 * median(abs(z - ms)) FILTER ({SUB}) AS ds, 1.4826 * median(abs(z - ma)) AS da FROM bp JOIN p1 USING (track_id, position) GROUP BY 1, 2),
pb AS (SELECT track_id, position, ff, CASE WHEN ns >= 30 THEN ms ELSE ma END AS baseline, greatest(CASE WHEN ns >= 30 THEN ds ELSE da END, 0.75::DOUBLE) AS spread
  FROM p1 JOIN p2 USING (track_id, position)),
rw AS (SELECT bp.*, baseline, spread, ff FROM bp JOIN pb USING (track_id, position))"""


def profiles(spark, sf):
    """Median profiles of five columns at every second column, written once."""
    pts = height_points(spark, sf)
    b = gr.band_profile(pts, gr.analysis_grid(pts, KEYS, STEP), KEYS, HALF)
    return durable(b.withColumn("z_um", F.col("z_mm") * 1e3))


def with_baseline(p):
    return attach(p, gr.profile_baseline(p, CASE, "z_um", 30), CASE)


def comp_sql(mask: str, centroid: str, n: int) -> str:
    """Components of `rw` rows under a mask, numbered in y order."""
    return f"""mk AS (SELECT *, z - baseline AS up, y_index - row_number() OVER (PARTITION BY track_id, position ORDER BY y_index) AS g FROM rw WHERE {mask}),
cp0 AS (SELECT track_id, position, min(y_index) AS a, count(*) AS n_samples, min(y_mm) AS y_min, max(y_mm) AS y_max, max(y_mm) - min(y_mm) AS width, {centroid} AS centroid,
  median(up) AS median_above, max(up) AS peak_above, median(abs(up)) AS median_abs, max(abs(up)) AS peak_abs, avg((up > 0)::INT) AS frac_pos, avg((up < 0)::INT) AS frac_neg
  FROM mk GROUP BY track_id, position, g),
cp AS (SELECT * EXCLUDE (a), row_number() OVER (PARTITION BY track_id, position ORDER BY a) - 1 AS component FROM cp0 WHERE n_samples >= {n} AND width BETWEEN 0.015 AND 1.1)"""


OUT = """SELECT track_id, position, component, n_samples, round(y_min, 9) AS y_min, round(y_max, 9) AS y_max, round(width, 9) AS width, round(centroid, 9) AS centroid,
  round(median_above, 9) AS median_above, round(peak_above, 9) AS peak_above, round(median_abs, 9) AS median_abs, round(peak_abs, 9) AS peak_abs,
  round(frac_pos, 9) AS frac_pos, round(frac_neg, 9) AS frac_neg FROM cp"""
SIZE = {"min_samples": 2, "min_width": 0.015}


@query("components_over_threshold", f"WITH {BAND}, {comp_sql('z >= baseline + 0.5 * spread', 'avg(y_mm)', 2)} {OUT}")
def components_over_threshold(spark, sf):
    o = sg.by_profile(with_baseline(profiles(spark, sf)), CASE)
    return rounded(sg.over_threshold(o, F.lit(0.5), **SIZE), 9)


@query("components_above_threshold", f"WITH {BAND}, {comp_sql('z - baseline > 0.5 * spread', 'sum(y_mm * greatest(up, 0.0)) / sum(greatest(up, 0.0))', 2)} {OUT}")
def components_above_threshold(spark, sf):
    o = sg.by_profile(with_baseline(profiles(spark, sf)), CASE)
    return rounded(sg.above_threshold(o, F.lit(0.5), **SIZE), 9)


@query("residual_candidates_signed", f"WITH {BAND}, {comp_sql('z - baseline > 0.75 * spread', '0.5 * (min(y_mm) + max(y_mm))', 2)} {OUT}")
def residual_candidates_signed(spark, sf):
    o = sg.by_profile(with_baseline(profiles(spark, sf)), CASE)
    return rounded(sg.residual_candidates(o, F.lit(0.75), False, **SIZE), 9)


@query("residual_candidates_absolute", f"WITH {BAND}, {comp_sql('abs(z - baseline) > 0.75 * spread', '0.5 * (min(y_mm) + max(y_mm))', 2)} {OUT}")
def residual_candidates_absolute(spark, sf):
    o = sg.by_profile(with_baseline(profiles(spark, sf)), CASE)
    return rounded(sg.residual_candidates(o, F.lit(0.75), True, **SIZE), 9)


def cfg_sql(configs) -> str:
    names = ["config_name", "threshold_k", "height_weight", "width_weight", "centre_weight", "continuity_weight", "width_mode"]
    rows = ", ".join("(" + ", ".join(repr(getattr(c, n)) if isinstance(getattr(c, n), str) else f"{getattr(c, n)}::DOUBLE" for n in names) + ")" for c in configs)
    return f"cfg AS (SELECT * FROM (VALUES {rows}) v({', '.join(names)}))"


def extract_sql(configs) -> str:
    """The extraction of `configs` as a chain of CTEs ending in `ex`; needs WITH RECURSIVE."""
    b = configs[0]
    return f"""{BAND}, {cfg_sql(configs)},
mk AS (SELECT config_name, rw.*, z - baseline AS up, y_index - row_number() OVER (PARTITION BY config_name, track_id, position ORDER BY y_index) AS g
  FROM cfg, rw WHERE z >= baseline + threshold_k * spread),
cp0 AS (SELECT config_name, track_id, position, min(y_index) AS a, count(*) AS n, min(y_mm) AS y_min, max(y_mm) AS y_max, max(y_mm) - min(y_mm) AS width, avg(y_mm) AS centroid,
  median(up) AS med FROM mk GROUP BY config_name, track_id, position, g),
pw0 AS (SELECT width FROM cp0 WHERE config_name = 'CONTROL' AND n >= {b.min_samples} AND width BETWEEN {b.min_width} AND {b.max_width}),
pooled AS (SELECT m AS pw, greatest({PRIOR_FLOOR}, 2.0 * 1.4826 * median(abs(width - m))) AS ps FROM pw0, (SELECT median(width) AS m FROM pw0) GROUP BY m),
cp AS (SELECT c.config_name, track_id, position, a, y_min, y_max, width, centroid,
   height_weight * tanh(greatest(med, 0.0) / 12.0) + width_weight * CASE WHEN width_mode = 'broad_range'
     THEN greatest(0.0, 1.0 - greatest({b.width_lo} - width, width - {b.width_hi}, 0.0) / {b.width_taper})
     WHEN width_mode = 'data_derived' THEN exp(-pow((width - (SELECT pw FROM pooled)) / (SELECT ps FROM pooled), 2)) ELSE exp(-pow((width - {b.preferred_width}) / {b.width_scale}, 2)) END
   + centre_weight * greatest(0.0, 1.0 - 0.5 * least(abs(centroid - 0.5 * ({b.prior_lo} + {b.prior_hi})) / (0.5 * ({b.prior_hi} - {b.prior_lo})), 2.0)) AS base
  FROM cp0 c JOIN cfg USING (config_name) WHERE n >= {b.min_samples} AND width BETWEEN {b.min_width} AND {b.max_width}),
ls AS (SELECT config_name, track_id, position, list(struct_pack(y_min := y_min, y_max := y_max, width := width, centroid := centroid, base := base) ORDER BY a) AS cs FROM cp GROUP BY 1, 2, 3),
cases AS (SELECT config_name, continuity_weight AS cw, track_id, position, coalesce(cs, []) AS cs, ff, baseline, spread, baseline + threshold_k * spread AS thr,
   row_number() OVER (PARTITION BY config_name, track_id ORDER BY position) AS ix FROM cfg CROSS JOIN pb LEFT JOIN ls USING (config_name, track_id, position)),
rec AS (
  SELECT DISTINCT config_name, track_id, 0::BIGINT AS ix, NULL::DOUBLE AS prev, NULL::DOUBLE AS best, NULL::DOUBLE AS second, NULL::BIGINT AS k, ''::VARCHAR AS status FROM cases
  UNION ALL
  SELECT config_name, track_id, ix, CASE WHEN status = 'selected' THEN cs[k].centroid ELSE prev END, best, second, k, status FROM (
    SELECT *, CASE WHEN best IS NULL THEN 'no_valid_component' WHEN best < {b.min_score} THEN 'low_score'
       WHEN len(cs) > 1 AND best > 0 AND second / best >= {b.ambiguity_ratio} THEN 'ambiguous' ELSE 'selected' END AS status FROM (
      SELECT *, list_max(tot) AS best, list_position(tot, list_max(tot))::BIGINT AS k, list_reverse_sort(tot)[2] AS second FROM (
        SELECT c.config_name, c.track_id, c.ix, r.prev, c.cs, list_transform(c.cs, lambda e: e.base + cw * CASE WHEN r.prev IS NULL THEN 0.5::DOUBLE
          ELSE exp(-abs(e.centroid - r.prev) / {b.continuity_scale}) END) AS tot
        FROM rec r JOIN cases c ON c.config_name = r.config_name AND c.track_id = r.track_id AND c.ix = r.ix + 1)))),
ex AS (SELECT config_name, track_id, position, ff, baseline, spread, thr, len(cs) AS n_candidates, best, CASE WHEN best IS NULL THEN NULL WHEN len(cs) > 1 AND best > 0 THEN second / best ELSE 0.0 END AS amb,
   status, CASE WHEN status = 'selected' THEN cs[k].y_min END AS y_lo, CASE WHEN status = 'selected' THEN cs[k].y_max END AS y_hi,
   CASE WHEN status = 'selected' THEN cs[k].width END AS width, CASE WHEN status = 'selected' THEN cs[k].centroid END AS centroid
  FROM rec JOIN cases USING (config_name, track_id, ix))"""


def extraction(spark, sf, configs):
    return pl.extract_sections(profiles(spark, sf), KEYS, "position", configs)


SEL = "round(y_lo, 9) AS segmentation_left, round(y_hi, 9) AS segmentation_right, round(width, 9) AS segmentation_width, round(centroid, 9) AS segmentation_centroid"


@query("extraction_with_continuity", f"""WITH RECURSIVE {extract_sql([BASE])} SELECT config_name, track_id, position, round(ff, 9) AS finite_fraction, round(baseline, 9) AS baseline_um,
  round(spread, 11) AS robust_spread_um, round(thr, 11) AS threshold_um, n_candidates AS n_candidate_components, round(best, 9) AS selected_component_score,
  round(amb, 9) AS ambiguity_score, status AS extraction_status, {SEL} FROM ex""")
def extraction_with_continuity(spark, sf):
    e = extraction(spark, sf, [BASE])
    e = rounded(e, 11, "robust_spread_um", "threshold_um")
    return rounded(e.select("config_name", "track_id", "position", "finite_fraction", "baseline_um", "robust_spread_um", "threshold_um", "n_candidate_components",
                            "selected_component_score", "ambiguity_score", "extraction_status", "segmentation_left", "segmentation_right", "segmentation_width", "segmentation_centroid"), 9,
                   "finite_fraction", "baseline_um", "selected_component_score", "ambiguity_score", "segmentation_left", "segmentation_right", "segmentation_width", "segmentation_centroid")


# Refined edges `o` of the selected sections of `ex`.
EDGES = f"""{extract_sql([BASE])},
vr AS (SELECT *, y_index - row_number() OVER (PARTITION BY track_id, position ORDER BY y_index) AS g FROM bp WHERE z IS NOT NULL),
vn AS (SELECT *, row_number() OVER (PARTITION BY track_id, position, g ORDER BY y_index) AS rn, count(*) OVER (PARTITION BY track_id, position, g) AS n FROM vr),
zs AS (SELECT *, CASE WHEN n < 3 THEN z ELSE (sum(z) OVER f + greatest(0, 2 - rn) * first_value(z) OVER f + greatest(0, rn + 1 - n) * last_value(z) OVER f) / 3.0 END AS s
  FROM vn WINDOW f AS (PARTITION BY track_id, position, g ORDER BY y_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
nb AS (SELECT *, lag(s) OVER p AS sp_, lead(s) OVER p AS sn, y_mm - lag(y_mm) OVER p AS hp_, lead(y_mm) OVER p - y_mm AS hn FROM zs WINDOW p AS (PARTITION BY track_id, position, g ORDER BY y_index)),
gr AS (SELECT track_id, position, y_mm, CASE WHEN rn = 1 THEN (sn - s) / hn WHEN rn = n THEN (s - sp_) / hp_ ELSE (hp_ * hp_ * sn + (hn * hn - hp_ * hp_) * s - hn * hn * sp_) / (hp_ * hn * (hp_ + hn)) END AS grad FROM nb WHERE n >= 3),
sel AS (SELECT track_id, position, y_lo, y_hi FROM ex WHERE status = 'selected'),
l AS (SELECT track_id, position, max(grad) AS ls, min_by(y_mm, round(-grad, 6)) AS ly FROM sel JOIN gr USING (track_id, position) WHERE y_mm BETWEEN y_lo - 0.08 AND y_lo + 0.08 GROUP BY 1, 2),
rr AS (SELECT track_id, position, abs(min(grad)) AS rs, min_by(y_mm, round(grad, 6)) AS ry FROM sel JOIN gr USING (track_id, position) WHERE y_mm BETWEEN y_hi - 0.08 AND y_hi + 0.08 GROUP BY 1, 2),
o AS (SELECT track_id, position, ls, rs, CASE WHEN ls >= 50 THEN ly END AS rl, CASE WHEN rs >= 50 THEN ry END AS r_r FROM sel LEFT JOIN l USING (track_id, position) LEFT JOIN rr USING (track_id, position))"""


@query("extraction_edges", f"""WITH RECURSIVE {EDGES}
SELECT track_id, position, round(ls, 3) AS left_edge_strength, round(rs, 3) AS right_edge_strength, round(rl, 6) AS refined_left, round(r_r, 6) AS refined_right,
  round(CASE WHEN r_r > rl THEN r_r - rl END, 6) AS refined_width FROM o""")
def extraction_edges(spark, sf):
    e = extraction(spark, sf, [BASE]).filter("extraction_status = 'selected'")
    e = e.select("track_id", "position", "left_edge_strength", "right_edge_strength", "refined_left", "refined_right", "refined_width")
    return rounded(rounded(e, 3, "left_edge_strength", "right_edge_strength"), 6, "refined_left", "refined_right", "refined_width")


@query("suspicion_scores", f"""WITH RECURSIVE {EDGES} SELECT track_id, position, ex.status AS extraction_status, round(1.0 - ff + coalesce(amb, 1.0) + 0.25 * (rl IS NULL OR r_r IS NULL)::INT + (ex.status <> 'selected')::INT, 6) AS suspicion_score
FROM ex LEFT JOIN o USING (track_id, position)""")
def suspicion_scores(spark, sf):
    e = extraction(spark, sf, [BASE])
    score = sc.suspicion(*[F.col(c) for c in ("finite_fraction", "ambiguity_score", "refined_left", "refined_right", "extraction_status")])
    return rounded(e.select(*CASE, "extraction_status", score.alias("suspicion_score")), 6)


@query("threshold_sweep", f"""WITH RECURSIVE {extract_sql(THR)} SELECT config_name, count(*) FILTER (status = 'selected') AS n_selected, count(*) FILTER (status = 'ambiguous') AS n_ambiguous,
  count(*) FILTER (status = 'low_score') AS n_low_score, count(*) FILTER (status = 'no_valid_component') AS n_no_valid_component, sum(n_candidates)::BIGINT AS total_candidates,
  round(median(width), 6) AS median_width, round(median(n_candidates), 6) AS median_candidates FROM ex GROUP BY 1""")
def threshold_sweep(spark, sf):
    e = extraction(spark, sf, THR)
    return rounded(st.sweep_summary(e, "config_name", "extraction_status", "segmentation_width", "n_candidate_components"), 6)


@query("sweep_instability", f"""WITH RECURSIVE {extract_sql(THR)}, k AS (SELECT track_id, position, count(DISTINCT status) AS n_statuses,
   count(DISTINCT round(y_lo, 6)::VARCHAR || '/' || round(y_hi, 6)::VARCHAR) FILTER (status = 'selected') AS n_boundaries, string_agg(status, '|' ORDER BY config_name) AS statuses FROM ex GROUP BY 1, 2)
SELECT * FROM k WHERE n_statuses > 1 OR n_boundaries > 1""")
def sweep_instability(spark, sf):
    return st.instability(extraction(spark, sf, THR), CASE, "config_name", "extraction_status", "segmentation_left", "segmentation_right")


@query("sweep_correlation", f"""WITH RECURSIVE {extract_sql(THR)}, s AS (SELECT track_id, position, threshold_k AS k, width FROM ex JOIN cfg USING (config_name) WHERE status = 'selected')
SELECT track_id, position, count(*) AS n_selected, round(CASE WHEN count(*) >= 3 AND max(width) - min(width) > 1e-9 THEN corr(k, width) END, 6) AS correlation, round(max(width) - min(width), 6) AS outcome_range FROM s GROUP BY 1, 2""")
def sweep_correlation(spark, sf):
    e = extraction(spark, sf, THR).withColumn("k", pl.param(THR, "threshold_k"))
    t = st.outcome_correlation(e, CASE, "k", "segmentation_width", F.col("extraction_status") == "selected")
    return rounded(t.withColumn("correlation", F.when(F.col("outcome_range") > 1e-9, F.col("correlation"))), 6)


STAB = f"""{extract_sql(ABLATION)}, rf AS (SELECT track_id, position, round(y_lo, 6) AS rl, round(y_hi, 6) AS rh FROM ex WHERE config_name = 'CONTROL' AND status = 'selected'),
sm AS (SELECT track_id, position, median(centroid) AS mc, median(width) AS mw FROM ex GROUP BY 1, 2),
sb AS (SELECT track_id, position, count(*) AS n_configs, avg((status = 'selected')::INT) AS fa, avg(coalesce(status = 'selected' AND round(y_lo, 6) = rl AND round(y_hi, 6) = rh, false)::INT) AS fc,
  1.4826 * median(abs(centroid - mc)) AS cm, 1.4826 * median(abs(width - mw)) AS wm,
  count(DISTINCT round(y_lo, 6)::VARCHAR || '/' || round(y_hi, 6)::VARCHAR) FILTER (status = 'selected') AS nd, bool_or(rl IS NOT NULL) AS cs_
  FROM ex LEFT JOIN rf USING (track_id, position) JOIN sm USING (track_id, position) GROUP BY 1, 2)"""


@query("sweep_stability", f"""WITH RECURSIVE {STAB} SELECT track_id, position, n_configs, round(fa, 6) AS frac_selected_any, round(fc, 6) AS frac_selected_control_exact, round(cm, 6) AS centroid_mad_mm,
  round(wm, 6) AS width_mad_mm, nd AS n_distinct_components, cs_ AS control_selected,
  CASE WHEN fa < 0.2 THEN 'consistently_invalid' WHEN fa >= 0.8 AND fc >= 0.7 AND coalesce(cm, 999) <= 0.03 AND coalesce(wm, 999) <= 0.05 THEN 'stable'
    WHEN fc < 0.4 OR coalesce(cm, 0) > 0.06 OR coalesce(wm, 0) > 0.1 OR nd >= 3 THEN 'highly_sensitive' ELSE 'moderately_sensitive' END AS stability_class,
  round((1 - fc) + 0.6 * greatest(nd - 1, 0) + 8.0 * coalesce(cm, 0) + 3.0 * coalesce(wm, 0) + 0.3 * (1 - fa), 6) AS sensitivity_score FROM sb""")
def sweep_stability(spark, sf):
    e = extraction(spark, sf, ABLATION)
    t = st.stability(e, CASE, "config_name", "CONTROL", "extraction_status", "segmentation_left", "segmentation_right", "segmentation_centroid", "segmentation_width")
    args = [F.col(c) for c in ("frac_selected_any", "frac_selected_control_exact", "centroid_mad_mm", "width_mad_mm", "n_distinct_components")]
    return rounded(t.withColumns({"stability_class": sc.stability_class(*args), "sensitivity_score": sc.sensitivity(*args)}), 6)


@query("data_derived_width", f"""WITH RECURSIVE {extract_sql(DERIVED)} SELECT config_name, track_id, position, n_candidates AS n_candidate_components, status AS extraction_status,
  round(best, 6) AS selected_component_score, round(width, 6) AS segmentation_width, round(centroid, 6) AS segmentation_centroid, round((SELECT pw FROM pooled), 9) AS preferred_width,
  round((SELECT ps FROM pooled), 9) AS width_scale FROM ex""")
def data_derived_width(spark, sf):
    """Two phases in one plan: candidates of the control give the width prior of the second configuration."""
    p = profiles(spark, sf)
    prior = durable(pl.pooled_width_prior(p, CASE, BASE, PRIOR_FLOOR))
    e = pl.extract_sections(p, KEYS, "position", DERIVED, prior).select(
        "config_name", *CASE, "n_candidate_components", "extraction_status", "selected_component_score", "segmentation_width", "segmentation_centroid")
    return rounded(rounded(attach(e, prior, []), 6, "selected_component_score", "segmentation_width", "segmentation_centroid"), 9, "preferred_width", "width_scale")


# Both sides of a profile against its own substrate: a difference beyond three spreads is flagged.
@query("side_disagreement", f"""WITH {BAND}, z AS (SELECT track_id, position, y_mm, z, min(y_mm) OVER (PARTITION BY track_id, position) + 0.55 AS yl, max(y_mm) OVER (PARTITION BY track_id, position) - 0.55 AS yr FROM bp),
a AS (SELECT track_id, position, median(z) AS wm, median(z) FILTER (y_mm <= yl) - median(z) FILTER (y_mm >= yr) AS lr FROM z GROUP BY 1, 2),
f AS (SELECT track_id, position, wm, baseline, spread, lr, ns < 30 AS fb, coalesce(abs(lr) > 3.0 * spread, false) AS flag, ff FROM a JOIN pb USING (track_id, position) JOIN p1 USING (track_id, position, ff))
SELECT track_id, count(*) AS n_profiles, sum(flag::INT)::BIGINT AS n_flagged, sum(fb::INT)::BIGINT AS n_fallback, round(median(wm - baseline), 6) AS median_difference, round(max(abs(lr) / spread), 6) AS largest_ratio FROM f GROUP BY 1""")
def side_disagreement(spark, sf):
    p = profiles(spark, sf)
    t = gr.side_disagreement(p, CASE, "z_um", 30)
    mid = st.medians(t, KEYS, {"median_difference": "difference"}, bounded=True)
    count = lambda c: F.sum(F.col(c).cast("long"))
    return rounded(t.groupBy(*KEYS).agg(
        F.count("*").alias("n_profiles"), count("sides_disagree").alias("n_flagged"), count("fallback_used").alias("n_fallback"),
        F.max(F.abs(F.col("left_minus_right")) / F.col("spread")).alias("largest_ratio")).join(mid, KEYS), 6)


@query("ablation_changes", f"""WITH RECURSIVE {extract_sql(ABLATION)}, a AS (SELECT * FROM ex WHERE config_name = 'CONTROL'), j AS (
  SELECT b.config_name, a.status AS sa, b.status AS sb, round(a.y_lo, 6) IS DISTINCT FROM round(b.y_lo, 6) OR round(a.y_hi, 6) IS DISTINCT FROM round(b.y_hi, 6) AS moved
  FROM a JOIN ex b USING (track_id, position) WHERE b.config_name <> 'CONTROL')
SELECT config_name, CASE WHEN sa <> 'selected' AND sb = 'selected' THEN 'nonselected_to_selected' WHEN sa = 'selected' AND sb <> 'selected' THEN 'selected_to_nonselected'
  WHEN sa = 'selected' AND moved THEN 'switched_selected' WHEN sa = 'selected' THEN 'same_selected' ELSE 'nonselected_to_nonselected' END AS change_class, count(*) AS n FROM j GROUP BY 1, 2""")
def ablation_changes(spark, sf):
    e = durable(extraction(spark, sf, ABLATION).select("config_name", *CASE, "extraction_status", r(F.col("segmentation_left")).alias("l"), r(F.col("segmentation_right")).alias("h")))
    a = e.filter("config_name = 'CONTROL'").select(*CASE, F.col("extraction_status").alias("sa"), F.col("l").alias("la"), F.col("h").alias("ha"))
    moved = ~(F.col("l").eqNullSafe(F.col("la")) & F.col("h").eqNullSafe(F.col("ha")))
    j = e.filter("config_name <> 'CONTROL'").join(a, CASE).withColumn("change_class", sc.change_class(F.col("sa"), F.col("extraction_status"), moved))
    return j.groupBy("config_name", "change_class").agg(F.count(F.lit(1)).alias("n"))


@query("selected_distributions", f"""WITH RECURSIVE {extract_sql(ABLATION)}, s AS (SELECT * FROM ex WHERE status = 'selected'), m AS (SELECT config_name, median(centroid) AS mc, median(width) AS mw FROM s GROUP BY 1)
SELECT config_name, round(any_value(mc), 6) AS centroid_median, round(1.4826 * median(abs(centroid - mc)), 6) AS centroid_mad, round(any_value(mw), 6) AS width_median,
  round(1.4826 * median(abs(width - mw)), 6) AS width_mad FROM s JOIN m USING (config_name) GROUP BY 1""")
def selected_distributions(spark, sf):
    e = extraction(spark, sf, ABLATION)
    return rounded(st.status_distribution(e, "config_name", "extraction_status", {"centroid": "segmentation_centroid", "width": "segmentation_width"}), 6)


@query("paired_shift", f"""WITH RECURSIVE {extract_sql(THR)}, a AS (SELECT * FROM ex WHERE config_name = 'CONTROL'), b AS (SELECT * FROM ex WHERE config_name = 'THR_0.75'),
j AS (SELECT track_id, a.status = 'selected' AS va, b.status = 'selected' AS vb, abs(a.centroid - b.centroid) AS dc, abs(a.width - b.width) AS dw FROM a JOIN b USING (track_id, position))
SELECT track_id, sum(va::INT)::BIGINT AS n_valid_reference, sum(vb::INT)::BIGINT AS n_valid_other, sum((va AND vb)::INT)::BIGINT AS n_valid_both, round(median(dc), 6) AS median_shift_centroid,
  round(median(dw), 6) AS median_shift_width, round(quantile_cont(dc, 0.95), 6) AS p95_shift_centroid, round(quantile_cont(dw, 0.95), 6) AS p95_shift_width FROM j GROUP BY 1""")
def paired_shift(spark, sf):
    e = durable(extraction(spark, sf, THR).select("config_name", *CASE, (F.col("extraction_status") == "selected").alias("valid"), F.col("segmentation_centroid").alias("centroid"), F.col("segmentation_width").alias("width")))
    part = lambda n: e.filter(F.col("config_name") == n).drop("config_name")
    return rounded(st.paired_shift(part("CONTROL"), part("THR_0.75"), CASE, KEYS, "valid", ["centroid", "width"]), 6)


@query("most_sensitive", f"""WITH RECURSIVE {STAB} SELECT track_id, position, round((1 - fc) + 0.6 * greatest(nd - 1, 0) + 8.0 * coalesce(cm, 0) + 3.0 * coalesce(wm, 0) + 0.3 * (1 - fa), 6) AS sensitivity_score
FROM sb ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def most_sensitive(spark, sf):
    t = sweep_stability(spark, sf).select(*CASE, "sensitivity_score")
    return st.top_k(t, [F.desc("sensitivity_score"), F.col("track_id"), F.col("position")], 10)


SETS = {"FULL": [0.25, 0.5, 0.75, 1.0, 1.25], "REMOVE_LOW": [0.5, 0.75, 1.0, 1.25], "REMOVE_HIGH": [0.25, 0.5, 0.75, 1.0], "INNER": [0.5, 0.75, 1.0]}


def corridor_table(spark, sf):
    return pl.corridor(profiles(spark, sf), KEYS, SETS, 30, 2, 0.015)


@query("corridor")
def corridor(spark, sf):
    return rounded(corridor_table(spark, sf), 6)


@query("corridor_robustness")
def corridor_robustness(spark, sf):
    c = durable(corridor_table(spark, sf).withColumn("centre_mm", 0.5 * (F.col("left_boundary_mm") + F.col("right_boundary_mm"))))
    full = c.filter("threshold_set = 'FULL'")
    out = None
    for name in list(SETS)[1:]:
        part = st.paired_shift(full, c.filter(F.col("threshold_set") == name), CASE, KEYS, "corridor_valid", ["centre_mm", "width_mm"]).withColumn("threshold_set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)


@query("corridor_against_control")
def corridor_against_control(spark, sf):
    p = profiles(spark, sf)
    control = pl.extract_sections(p, KEYS, "position", [BASE]).select(
        *CASE, F.col("extraction_status").alias("status"), F.col("segmentation_left").alias("left"), F.col("segmentation_right").alias("right"),
        F.col("segmentation_width").alias("width"), F.col("segmentation_centroid").alias("centroid"))
    c = pl.corridor(p, KEYS, {"FULL": SETS["FULL"]}, 30, 2, 0.015).select(
        *CASE, F.when(F.col("corridor_valid"), "selected").otherwise("no_valid_component").alias("status"), F.col("left_boundary_mm").alias("left"),
        F.col("right_boundary_mm").alias("right"), F.col("width_mm").alias("width"), (0.5 * (F.col("left_boundary_mm") + F.col("right_boundary_mm"))).alias("centroid"))
    return rounded(jn.agreement_with_control(control, c, CASE), 6)


# Length covered by exactly one of two intervals.
SYMMETRIC = "({1} - {0}) + ({3} - {2}) - 2 * greatest(0.0, least({1}, {3}) - greatest({0}, {2}))"
LEVELS = (0.5, 0.75, 1.0, 1.25)
P3 = "PARTITION BY track_id, position"
# Smoothed height `s`, gradient `grad` and activity `act` of every sample, by runs of present heights (5 samples, 5 rows at least).
ACTIVITY = f"""{BAND}, q0 AS (SELECT *, y_index - row_number() OVER ({P3} ORDER BY y_index) AS g FROM rw WHERE z IS NOT NULL),
q1 AS (SELECT *, row_number() OVER ({P3}, g ORDER BY y_index) AS rn, count(*) OVER ({P3}, g) AS n FROM q0),
q2 AS (SELECT *, CASE WHEN n < 5 THEN z ELSE (sum(z) OVER f + greatest(0, 3 - rn) * first_value(z) OVER f + greatest(0, rn + 2 - n) * last_value(z) OVER f) / 5.0 END AS s
  FROM q1 WINDOW f AS ({P3}, g ORDER BY y_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
q3 AS (SELECT *, lag(s) OVER p AS s0, lead(s) OVER p AS s1, y_mm - lag(y_mm) OVER p AS h0, lead(y_mm) OVER p - y_mm AS h1 FROM q2 WINDOW p AS ({P3}, g ORDER BY y_index)),
q4 AS (SELECT *, s - baseline AS res, CASE WHEN n < 5 THEN NULL WHEN rn = 1 THEN (s1 - s) / h1 WHEN rn = n THEN (s - s0) / h0 ELSE (h0 * h0 * s1 + (h1 * h1 - h0 * h0) * s - h1 * h1 * s0) / (h0 * h1 * (h0 + h1)) END AS grad FROM q3),
q5 AS (SELECT track_id, position, median(res) AS mr, median(abs(grad)) AS ma, median(grad) AS mg FROM q4 GROUP BY 1, 2),
q6 AS (SELECT track_id, position, 1.4826 * median(abs(res - mr)) AS dr, 1.4826 * median(abs(abs(grad) - ma)) AS da, 1.4826 * median(abs(grad - mg)) AS dg FROM q4 JOIN q5 USING (track_id, position) GROUP BY 1, 2),
sc AS (SELECT track_id, position, CASE WHEN dr > 0 THEN dr ELSE 1e-6::DOUBLE END AS rs, CASE WHEN da > 0 THEN da ELSE 1e-6::DOUBLE END AS gs, CASE WHEN dg > 0 THEN dg ELSE 1e-9::DOUBLE END AS gg FROM q6),
q7 AS (SELECT *, abs(res) / rs + 0.5 * abs(grad) / gs AS raw FROM q4 JOIN sc USING (track_id, position)),
ac AS (SELECT *, CASE WHEN raw IS NOT NULL THEN (sum(raw) OVER f + greatest(0, 3 - rn) * first_value(raw) OVER f + greatest(0, rn + 2 - n) * last_value(raw) OVER f) / 5.0 END AS act
  FROM q7 WINDOW f AS ({P3}, g ORDER BY y_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""

SEEDS = f"""{ACTIVITY}, lv AS (SELECT track_id, position, greatest(CASE WHEN count(act) < 10 THEN max(act) ELSE quantile_cont(act, 0.9) END, 1.0::DOUBLE) AS lvl FROM ac GROUP BY 1, 2),
hr AS (SELECT *, y_index - row_number() OVER ({P3} ORDER BY y_index) AS h FROM ac JOIN lv USING (track_id, position) WHERE act >= lvl),
si AS (SELECT track_id, position, min(y_index) AS a, min(y_mm) AS y_min, max(y_mm) AS y_max, sum(act) AS ia FROM hr GROUP BY track_id, position, h HAVING max(y_mm) > min(y_mm)),
rk AS (SELECT *, row_number() OVER ({P3} ORDER BY ia DESC, y_max - y_min DESC, a) AS k, lead(ia) OVER ({P3} ORDER BY ia DESC, y_max - y_min DESC, a) AS ib, count(*) OVER ({P3}) AS ni FROM si),
sd AS (SELECT track_id, position, CASE WHEN ia IS NULL THEN 'no_seed' WHEN coalesce((ia - ib) / greatest(ia, 1e-9) < 0.15, false) THEN 'ambiguous_seed' ELSE 'ok' END AS seed_status,
   y_min AS lo, y_max AS hi, 0.5 * (y_min + y_max) AS sy, ia, ia - ib AS margin, coalesce(ni, 0) AS ni
  FROM (SELECT DISTINCT track_id, position FROM rw) LEFT JOIN (SELECT * FROM rk WHERE k = 1) USING (track_id, position)),
ed AS (SELECT track_id, position, min(y_mm) AS y0, max(y_mm) AS y1 FROM rw GROUP BY 1, 2)"""

TRANSITIONS = f"""{SEEDS}, pk AS (SELECT track_id, position, y_mm, abs(grad) AS ag, gg, abs(grad) >= lag(abs(grad)) OVER p AND abs(grad) >= lead(abs(grad)) OVER p AS peak
  FROM ac WHERE grad IS NOT NULL WINDOW p AS ({P3}, g ORDER BY y_index)),
sp2 AS (SELECT track_id, position, y_mm, ag, ag / gg AS sz, unnest([CASE WHEN y_mm <= lo THEN 'left' END, CASE WHEN y_mm >= hi THEN 'right' END]) AS side, lo, hi
  FROM pk JOIN ed USING (track_id, position) JOIN sd USING (track_id, position) WHERE peak AND lo IS NOT NULL AND y_mm BETWEEN y0 + 0.1 AND y1 - 0.1),
tr AS (SELECT *, sz - 0.5 * CASE WHEN side = 'left' THEN lo - y_mm ELSE y_mm - hi END AS score FROM sp2 WHERE side IS NOT NULL),
tk AS (SELECT *, row_number() OVER o AS k, lead(score) OVER o AS second, count(*) OVER ({P3}, side) AS n FROM tr WINDOW o AS ({P3}, side ORDER BY score DESC, y_mm)),
gt AS (SELECT track_id, position, sd.seed_status, l.y_mm AS ly, l.ag AS la, l.sz AS lz, l.n AS ln, l.score - l.second AS lm, t.y_mm AS ry, t.ag AS ra, t.sz AS rz, t.n AS rn, t.score - t.second AS rm
  FROM sd LEFT JOIN (SELECT * FROM tk WHERE k = 1 AND side = 'left') l USING (track_id, position) LEFT JOIN (SELECT * FROM tk WHERE k = 1 AND side = 'right') t USING (track_id, position))"""


def _frames() -> str:
    """Windows of the return rule: centred, outward to the left, outward to the right."""
    frame = lambda back, ahead: f"({P3} ORDER BY y_mm RANGE BETWEEN {back + 1e-9}::DOUBLE PRECEDING AND {ahead + 1e-9}::DOUBLE FOLLOWING)"
    return f"c AS {frame(0.06, 0.06)}, l AS {frame(0.1, 0.0)}, r AS {frame(0.0, 0.1)}"


def _quiet(w: str, level: str) -> str:
    return f"count(s) OVER {w} = count(*) OVER {w} AND max(abs(s - {level})) OVER {w} <= 2.0 * spread AND avg(abs(grad)) OVER {w} <= 2.0 * gs"


RETURNS = f"""{SEEDS}, zz AS (SELECT track_id, position, y_mm, z, y0 + 0.55 AS yl, y1 - 0.55 AS yr FROM bp JOIN ed USING (track_id, position)),
sl AS (SELECT track_id, position, median(z) FILTER (y_mm <= yl) AS lb, median(z) FILTER (y_mm >= yr) AS rb FROM zz GROUP BY 1, 2),
rr AS (SELECT rw.track_id, rw.position, rw.y_mm, rw.spread, ac.s, ac.grad, sc.gs, coalesce(lb, rw.baseline) AS ll, coalesce(rb, rw.baseline) AS rl, lo, hi FROM rw LEFT JOIN ac USING (track_id, position, y_index)
  JOIN sc USING (track_id, position) JOIN sl USING (track_id, position) JOIN sd USING (track_id, position) WHERE seed_status = 'ok'),
fl AS (SELECT *, coalesce(count(s) OVER c >= 5 AND {_quiet('c', 'll')} AND {_quiet('l', 'll')}, false) AS okl, coalesce(count(s) OVER c >= 5 AND {_quiet('c', 'rl')} AND {_quiet('r', 'rl')}, false) AS okr FROM rr WINDOW {_frames()}),
rg AS (SELECT track_id, position, max(y_mm) FILTER (okl AND y_mm <= lo AND y_mm >= lo - 1.2) AS ly, min(y_mm) FILTER (okr AND y_mm >= hi AND y_mm <= hi + 1.2) AS ry,
   sum((y_mm BETWEEN lo AND hi AND s IS NULL)::INT) > 0 AS gap FROM fl GROUP BY 1, 2),
r1 AS (SELECT track_id, position, seed_status, coalesce(gap, false) AS gap, seed_status = 'ok' AND NOT coalesce(gap, false) AS usable, CASE WHEN NOT coalesce(gap, false) THEN ly END AS ly, CASE WHEN NOT coalesce(gap, false) THEN ry END AS ry, y0, y1, lo, hi
  FROM sd LEFT JOIN rg USING (track_id, position) LEFT JOIN ed USING (track_id, position)),
rt AS (SELECT track_id, position, CASE WHEN seed_status <> 'ok' THEN seed_status WHEN gap THEN 'missingness_or_nan_gap' WHEN ly IS NOT NULL AND ry IS NOT NULL THEN 'ok' ELSE 'partial' END AS status,
   CASE WHEN NOT usable THEN NULL WHEN ly IS NOT NULL THEN 'ok' WHEN y0 < lo - 1.2 THEN 'no_substrate_like_return' ELSE 'edge_of_profile' END AS left_status,
   CASE WHEN NOT usable THEN NULL WHEN ry IS NOT NULL THEN 'ok' WHEN y1 > hi + 1.2 THEN 'no_substrate_like_return' ELSE 'edge_of_profile' END AS right_status, ly, ry FROM r1)"""


def associated_sql(levels) -> str:
    """`ab`: the interval of each residual rule and threshold that belongs to the seed of a case; `ed` and `sd` come from `SEEDS`."""
    return f"""kk AS (SELECT unnest({[float(k) for k in levels]}::DOUBLE[]) AS k), mt AS (SELECT unnest(['A', 'B']) AS method),
mm AS (SELECT method, k, track_id, position, y_index, y_mm, y_index - row_number() OVER (PARTITION BY method, k, track_id, position ORDER BY y_index) AS g FROM rw, kk, mt WHERE CASE WHEN method = 'A' THEN z - baseline ELSE abs(z - baseline) END > k * spread),
cc AS (SELECT method, k, track_id, position, min(y_index) AS a, min(y_mm) AS y_min, max(y_mm) AS y_max, max(y_mm) - min(y_mm) AS width, 0.5 * (min(y_mm) + max(y_mm)) AS centroid FROM mm GROUP BY method, k, track_id, position, g HAVING count(*) >= 2 AND max(y_mm) - min(y_mm) BETWEEN 0.015 AND 1.1),
ab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, k, track_id, position ORDER BY NOT (y_min <= sy AND sy <= y_max), abs(centroid - sy), a) AS pick FROM cc JOIN sd USING (track_id, position) WHERE seed_status = 'ok') WHERE pick = 1)"""


def seeded(spark, sf):
    """Rows with gradient and activity, and the seed of every profile."""
    p = profiles(spark, sf)
    o = sg.smoothed_gradient(sg.by_profile(with_baseline(p), CASE), "z_um", 5, 5)
    active, _ = sg.disturbance_activity(o, 5, 5)
    rows = durable(active.df)
    o = o.with_df(rows)
    seeds = sg.pick_seed(sg.seed_intervals(o, 0.10, 1.0), rows, CASE)
    return o, durable(seeds)


@query("disturbance_seeds", f"""WITH {SEEDS} SELECT track_id, position, seed_status, round(lo, 6) AS seed_y_min, round(hi, 6) AS seed_y_max, round(sy, 6) AS seed_centroid, round(ia, 6) AS seed_activity,
  round(margin, 6) AS seed_margin, ni AS n_intervals FROM sd""")
def disturbance_seeds(spark, sf):
    return rounded(seeded(spark, sf)[1], 6)


@query("gradient_transitions", f"""WITH {TRANSITIONS} SELECT track_id, position, seed_status, round(ly, 6) AS left_y, round(la, 6) AS left_strength, round(lz, 6) AS left_strength_z, ln AS left_n, round(lm, 6) AS left_margin,
  round(ry, 6) AS right_y, round(ra, 6) AS right_strength, round(rz, 6) AS right_strength_z, rn AS right_n, round(rm, 6) AS right_margin,
  CASE WHEN ly IS NULL THEN 'no_candidate' WHEN la >= 50 THEN 'ok' ELSE 'weak' END AS left_status, coalesce(lm < 0.5, false) AS left_ambiguous,
  CASE WHEN ry IS NULL THEN 'no_candidate' WHEN ra >= 50 THEN 'ok' ELSE 'weak' END AS right_status, coalesce(rm < 0.5, false) AS right_ambiguous,
  round(CASE WHEN ly IS NOT NULL AND ry IS NOT NULL THEN greatest(0.0, ry - ly) END, 6) AS width FROM gt""")
def gradient_transitions(spark, sf):
    o, seeds = seeded(spark, sf)
    return rounded(sg.gradient_transitions(o, seeds), 6)


def levels_of(o):
    side = gr.side_baselines(o.df, CASE, "z_um", 0.55)
    spread = o.df.groupBy(*CASE).agg(F.first("spread").alias("spread"), F.first("baseline").alias("_b"))
    return side.join(spread, CASE).select(*CASE, "spread", F.coalesce("left_baseline", "_b").alias("left_level"), F.coalesce("right_baseline", "_b").alias("right_level"))


@query("substrate_return", f"""WITH {RETURNS} SELECT track_id, position, status, left_status, right_status, round(ly, 6) AS left_y, round(ry, 6) AS right_y,
  round(CASE WHEN ly IS NOT NULL AND ry IS NOT NULL THEN greatest(0.0, ry - ly) END, 6) AS width FROM rt""")
def substrate_return(spark, sf):
    o, seeds = seeded(spark, sf)
    return rounded(sg.substrate_return(o, seeds, levels_of(o)), 6)


@query("return_failure_counts", f"""WITH {RETURNS}, e AS (SELECT unnest(['left', 'right']) AS side, unnest([left_status, right_status]) AS f FROM rt)
SELECT CASE WHEN f IS NULL OR f = 'ok' THEN '(none)' ELSE f END AS failure, count(*) FILTER (side = 'left') AS left_failure_count, count(*) FILTER (side = 'right') AS right_failure_count FROM e GROUP BY 1""")
def return_failure_counts(spark, sf):
    """Failure categories of the return rule, counted for both sides."""
    o, seeds = seeded(spark, sf)
    return sg.failure_counts(sg.substrate_return(o, seeds, levels_of(o)))


@query("peak_seed", f"""WITH {ACTIVITY}, ps AS (SELECT track_id, position, count(res) AS n, quantile_cont(abs(res), 0.9) AS q, arg_min(y_mm, (-abs(res), y_mm)) FILTER (res IS NOT NULL) AS arg FROM ac GROUP BY 1, 2),
pm AS (SELECT track_id, position, CASE WHEN any_value(ps.n) < 10 THEN any_value(arg) ELSE median(y_mm) FILTER (abs(res) >= q) END AS y FROM ac JOIN ps USING (track_id, position) GROUP BY 1, 2),
pn AS (SELECT track_id, position, y_mm, row_number() OVER ({P3} ORDER BY round(abs(y_mm - y), 9), y_mm) AS k FROM rw JOIN pm USING (track_id, position))
SELECT track_id, position, round(y_mm, 6) AS seed_y FROM (SELECT DISTINCT track_id, position FROM rw) LEFT JOIN (SELECT * FROM pn WHERE k = 1) USING (track_id, position)""")
def peak_seed(spark, sf):
    o, _ = seeded(spark, sf)
    return rounded(sg.peak_seed(o), 6)


@query("method_comparison", f"""WITH {TRANSITIONS}, {RETURNS.split(SEEDS + ', ')[1]}, {associated_sql([0.75])},
al AS (SELECT track_id, position, method, y_min AS l, y_max AS r FROM ab UNION ALL SELECT track_id, position, 'C', ly, ry FROM gt UNION ALL SELECT track_id, position, 'D', ly, ry FROM rt),
ok AS (SELECT * FROM al WHERE l IS NOT NULL AND r IS NOT NULL),
pr AS (SELECT a.method AS method_a, b.method AS method_b FROM (SELECT unnest(['A', 'B', 'C', 'D']) AS method) a, (SELECT unnest(['A', 'B', 'C', 'D']) AS method) b WHERE a.method < b.method),
df AS (SELECT a.method AS method_a, b.method AS method_b, abs(a.l - b.l) AS dl, abs(a.r - b.r) AS dr, abs((a.r - a.l) - (b.r - b.l)) AS dw, greatest(0.0, least(a.r, b.r) - greatest(a.l, b.l)) AS sh, (a.r - a.l) + (b.r - b.l) AS both_
  FROM ok a JOIN ok b USING (track_id, position) WHERE a.method < b.method)
SELECT method_a, method_b, count(dl) AS n_both, round(median(dl), 6) AS median_left, round(median(dr), 6) AS median_right, round(median(dw), 6) AS median_width,
  round(median(CASE WHEN dl IS NULL THEN NULL WHEN both_ - sh > 0 THEN sh / (both_ - sh) ELSE 0.0 END), 6) AS median_iou, round(quantile_cont(dw, 0.95), 6) AS p95_width FROM pr LEFT JOIN df USING (method_a, method_b) GROUP BY 1, 2""")
def method_comparison(spark, sf):
    """Pairwise agreement of signed, absolute, gradient and return boundaries."""
    o, seeds = seeded(spark, sf)
    ok = seeds.filter("seed_status = 'ok'").select(*CASE, "seed_y_min", "seed_y_max", "seed_centroid")
    found = None
    for name, absolute in (("A", False), ("B", True)):
        cand = sg.residual_candidates(o, F.lit(0.75), absolute, **SIZE)
        best = jn.seed_association(cand, ok, CASE, "component").join(cand, [*CASE, "component"]).select(
            *CASE, F.lit(name).alias("method"), F.col("y_min").alias("left"), F.col("y_max").alias("right"))
        found = best if found is None else found.unionByName(best)
    c = sg.gradient_transitions(o, seeds).select(*CASE, F.lit("C").alias("method"), F.col("left_y").alias("left"), F.col("right_y").alias("right"))
    d = sg.substrate_return(o, seeds, levels_of(o)).select(*CASE, F.lit("D").alias("method"), F.col("left_y").alias("left"), F.col("right_y").alias("right"))
    table = durable(found.unionByName(c).unionByName(d))
    pairs = [("A", "B"), ("A", "C"), ("A", "D"), ("B", "C"), ("B", "D"), ("C", "D")]
    return rounded(jn.method_agreement(table, CASE, "method", pairs), 6)


@query("candidate_threshold_sensitivity", f"""WITH {SEEDS}, {associated_sql(LEVELS)} SELECT track_id, position, method, count(DISTINCT k) AS n_thresholds, round(max(y_min) - min(y_min), 6) AS left_spread,
  round(max(y_max) - min(y_max), 6) AS right_spread, round(max(width) - min(width), 6) AS width_spread FROM ab GROUP BY 1, 2, 3""")
def candidate_threshold_sensitivity(spark, sf):
    """Spread of the associated boundaries of both residual rules over thresholds."""
    o, seeds = seeded(spark, sf)
    ok = seeds.filter("seed_status = 'ok'").select(*CASE, "seed_y_min", "seed_y_max", "seed_centroid")
    levels = o.df.withColumn("threshold_k", F.explode(F.array(*[F.lit(k) for k in (0.5, 0.75, 1.0, 1.25)])))
    by = [*CASE, "threshold_k"]
    leveled = sg.by_profile(levels.drop("_iy"), by)
    seeds_k = ok.withColumn("threshold_k", F.explode(F.array(*[F.lit(k) for k in (0.5, 0.75, 1.0, 1.25)])))
    out = None
    for name, absolute in (("A", False), ("B", True)):
        cand = sg.residual_candidates(leveled, F.col("threshold_k"), absolute, **SIZE)
        best = jn.seed_association(cand, seeds_k, by, "component").join(cand, [*by, "component"])
        part = sg.interval_sensitivity(best, CASE).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)


@query("dense_grid_intervals", f"""WITH {TRANSITIONS}, {RETURNS.split(SEEDS + ', ')[1]}, {associated_sql(LEVELS)},
w AS (SELECT track_id, position, count(*) FILTER (method = 'A') AS na, count(*) FILTER (method = 'B') AS nb, median(y_min) FILTER (method = 'A') AS al, median(y_max) FILTER (method = 'A') AS ar,
   median(y_min) FILTER (method = 'B') AS bl, median(y_max) FILTER (method = 'B') AS br FROM ab GROUP BY 1, 2),
v AS (SELECT sd.track_id, sd.position, sd.seed_status, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, al, ar, bl, br, gt.ly AS cl, gt.ry AS cr, rt.ly AS dl, rt.ry AS dr, rt.status, rt.left_status, rt.right_status,
   coalesce(abs(lb - rb) > 3.0 * spread, false) AS flag
  FROM sd LEFT JOIN w USING (track_id, position) LEFT JOIN gt USING (track_id, position) LEFT JOIN rt USING (track_id, position) JOIN sl USING (track_id, position) JOIN pb USING (track_id, position))
SELECT track_id, position, seed_status, flag AS sides_disagree, na AS "A_n_thresholds", nb AS "B_n_thresholds", {', '.join(f'round({m}l, 6) AS "{m.upper()}_left", round({m}r, 6) AS "{m.upper()}_right", round({m}r - {m}l, 6) AS "{m.upper()}_width"' for m in 'abcd')},
  status AS "D_status", left_status AS "D_left_failure", right_status AS "D_right_failure",
  round({SYMMETRIC.format('al', 'ar', 'dl', 'dr')}, 6) AS "A_D_unshared" FROM v""")
def dense_grid_intervals(spark, sf):
    """One row per grid position: the interval of every method, medians over thresholds for the residual rules."""
    o, seeds = seeded(spark, sf)
    ok = seeds.filter("seed_status = 'ok'").select(*CASE, "seed_y_min", "seed_y_max", "seed_centroid")
    k = F.explode(F.array(*[F.lit(v) for v in LEVELS]))
    by = [*CASE, "threshold_k"]
    leveled = sg.by_profile(o.df.withColumn("threshold_k", k).drop("_iy"), by)
    asked = ok.withColumn("threshold_k", k)
    chosen = {}
    for name, absolute in (("A", False), ("B", True)):
        cand = sg.residual_candidates(leveled, F.col("threshold_k"), absolute, **SIZE)
        chosen[name] = jn.seed_association(cand, asked, by, "component").join(cand, [*by, "component"])
    sides = gr.side_disagreement(o.df, CASE, "z_um", 30).select(*CASE, "sides_disagree")
    found = {"C": sg.gradient_transitions(o, seeds), "D": sg.substrate_return(o, seeds, levels_of(o))}
    t = sg.method_intervals(seeds, chosen, found, CASE).join(sides, CASE)
    unshared = iv.unshared(*[F.col(c) for c in ("A_left", "A_right", "D_left", "D_right")])
    return rounded(t.withColumn("A_D_unshared", unshared), 6)
