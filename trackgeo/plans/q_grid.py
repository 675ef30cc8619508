"""Height-grid queries: detrending, baselines, residual fields, cross sections, descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgeo.config import CORRIDOR_MM
from trackgeo.operators import grid as gr
from trackgeo.operators.layout import fits_a_task
from trackgeo.plans.inputs import HP, height_points
from trackgeo.plans.registry import query, r, rounded
from trackgeo.session import durable

KEYS = ["track_id"]
LO, HI = CORRIDOR_MM
SUB = f"(y_mm < {LO} OR y_mm > {HI})"
MID = f"(y_mm BETWEEN {LO} AND {HI})"


def plane_sql(rule: gr.PlaneRule) -> str:
    """The rounds of a robust plane fit as a chain of CTEs ending in `plane`."""
    where = "z_mm IS NOT NULL" + (f" AND {SUB}" if rule.substrate_only else "")
    ctes = [f"k0 AS (SELECT track_id, x_mm, y_mm, z_mm FROM hp WHERE {where})"]
    for i in range(1, rule.rounds + 1):
        ctes.append(f"""m{i} AS (SELECT track_id, avg(x_mm) AS mx, avg(y_mm) AS my, avg(z_mm) AS mz, var_pop(x_mm) AS xx, var_pop(y_mm) AS yy,
  covar_pop(x_mm, y_mm) AS xy, covar_pop(x_mm, z_mm) AS xz, covar_pop(y_mm, z_mm) AS yz FROM k{i - 1} GROUP BY 1),
n{i} AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM m{i}),
c{i} AS (SELECT track_id, a, b, mz - a * mx - b * my AS c FROM n{i})""")
        pool = "k0" if rule.trim == "all" else f"k{i - 1}"
        ctes.append(f"r{i} AS (SELECT {pool}.*, z_mm - (a * x_mm + b * y_mm + c) AS r FROM {pool} JOIN c{i} USING (track_id))")
        if rule.trim == "mad":
            ctes.append(f"""d{i} AS (SELECT track_id, median(r) AS med FROM r{i} GROUP BY 1),
s{i} AS (SELECT track_id, any_value(med) AS med, 3.0 * greatest(1.4826 * median(abs(r - med)), 1e-9::DOUBLE) AS h FROM r{i} JOIN d{i} USING (track_id) GROUP BY 1),
q{i} AS (SELECT track_id, med - h AS lo, med + h AS hi FROM s{i})""")
        else:
            ctes.append(f"q{i} AS (SELECT track_id, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM r{i} GROUP BY 1)")
        base = f"k{i - 1}" if rule.trim == "kept" else "k0"
        ctes.append(f"""k{i} AS (SELECT {base}.* FROM {base} JOIN c{i} USING (track_id) JOIN q{i} USING (track_id)
  WHERE z_mm - (a * x_mm + b * y_mm + c) BETWEEN lo AND hi)""")
    last = rule.rounds
    ctes.append(f"""plane AS (SELECT track_id, a, b, c, (SELECT count(*) FROM k0 WHERE k0.track_id = c{last}.track_id) AS n_initial,
  (SELECT count(*) FROM k{last} WHERE k{last}.track_id = c{last}.track_id) AS n_final FROM c{last})""")
    return HP + ",\n" + ",\n".join(ctes)


PLANE_OUT = "SELECT track_id, round(a * 1e6, 6) AS a, round(b * 1e6, 6) AS b, round(c * 1e6, 6) AS c, n_initial, n_final FROM plane"


def plane_query(spark, sf, rule):
    p = gr.fit_planes(height_points(spark, sf), KEYS, rule)
    return p.select("track_id", *[r(F.col(c) * 1e6).alias(c) for c in "abc"], "n_initial", "n_final")


@query("plane_global", f"WITH {plane_sql(gr.GLOBAL)} {PLANE_OUT}")
def plane_global(spark, sf):
    return plane_query(spark, sf, gr.GLOBAL)


@query("plane_focused", f"WITH {plane_sql(gr.FOCUSED)} {PLANE_OUT}")
def plane_focused(spark, sf):
    return plane_query(spark, sf, gr.FOCUSED)


@query("plane_focused_mad", f"WITH {plane_sql(gr.FOCUSED_MAD)} {PLANE_OUT}")
def plane_focused_mad(spark, sf):
    return plane_query(spark, sf, gr.FOCUSED_MAD)


DET = plane_sql(gr.FOCUSED) + """,
det AS (SELECT track_id, x_index, y_index, x_mm, y_mm, z_mm - (a * x_mm + b * y_mm + c) AS z_mm FROM hp JOIN plane USING (track_id))"""


def detrended(spark, sf, pts=None):
    """Detrended grid, written once as the grid itself because every later step reads it several times."""
    pts = durable(height_points(spark, sf)) if pts is None else pts
    return durable(gr.detrend(pts, gr.fit_planes(pts, KEYS, gr.FOCUSED), KEYS))


@query("detrend_comparison", f"""WITH {DET}, u AS (SELECT track_id, 'raw' AS method, z_mm FROM hp WHERE z_mm IS NOT NULL AND {SUB}
  UNION ALL SELECT track_id, 'focused', z_mm FROM det WHERE z_mm IS NOT NULL AND {SUB}),
m AS (SELECT track_id, method, median(z_mm) AS med FROM u GROUP BY 1, 2)
SELECT track_id, method, round(any_value(med) * 1e3, 9) AS z_median, round(1.4826 * median(abs(z_mm - med)) * 1e3, 9) AS z_mad
FROM u JOIN m USING (track_id, method) GROUP BY 1, 2""")
def detrend_comparison(spark, sf):
    pts = durable(height_points(spark, sf))
    t = gr.detrend_comparison({"raw": pts, "focused": detrended(spark, sf, pts)}, KEYS)
    return t.select("track_id", "method", r(F.col("z_mm_median") * 1e3, 9).alias("z_median"), r(F.col("z_mm_mad") * 1e3, 9).alias("z_mad"))


CB = DET + f""",
sv AS (SELECT track_id, x_index, x_mm, CASE WHEN {SUB} THEN z_mm * 1e3 END AS s FROM det),
lm AS (SELECT track_id, x_index, min(x_mm) AS x_mm, count(s) AS n, median(s) AS med FROM sv GROUP BY 1, 2),
ld AS (SELECT track_id, x_index, 1.4826 * median(abs(s - med)) AS mad FROM sv JOIN lm USING (track_id, x_index) GROUP BY 1, 2),
gm AS (SELECT track_id, median(s) AS gmed FROM sv GROUP BY 1),
gd AS (SELECT track_id, any_value(gmed) AS gmed, 1.4826 * median(abs(s - gmed)) AS gmad FROM sv JOIN gm USING (track_id) GROUP BY 1),
cb AS (SELECT track_id, x_index, lm.x_mm, n AS n_substrate, CASE WHEN n >= 50 THEN med ELSE gmed END AS baseline_um,
  greatest(CASE WHEN n >= 50 THEN mad ELSE coalesce(gmad, 0.75) END, 0.75::DOUBLE) AS spread_um, n < 50 AS fallback
  FROM lm JOIN ld USING (track_id, x_index) JOIN gd USING (track_id))"""


@query("column_baseline", f"""WITH {CB} SELECT track_id, x_index, round(x_mm, 3) AS x_mm, n_substrate, round(baseline_um, 3) AS baseline_um,
  round(spread_um, 3) AS spread_um, fallback FROM cb""")
def column_baseline(spark, sf):
    return rounded(gr.column_baseline(detrended(spark, sf), KEYS), 3)


FLD = CB + """,
gk AS (SELECT *, y_index - row_number() OVER (PARTITION BY track_id, x_index, z_mm IS NULL ORDER BY y_index) AS g FROM det),
gn AS (SELECT *, row_number() OVER p AS rn, count(*) OVER (PARTITION BY track_id, x_index, g) AS n, z_mm * 1e3 AS z,
   lag(z_mm * 1e3) OVER p AS zp, lead(z_mm * 1e3) OVER p AS zn, y_mm - lag(y_mm) OVER p AS hp, lead(y_mm) OVER p - y_mm AS hn
  FROM gk WHERE z_mm IS NOT NULL WINDOW p AS (PARTITION BY track_id, x_index, g ORDER BY y_index)),
ga AS (SELECT track_id, x_index, y_index, CASE WHEN n >= 5 THEN abs(CASE WHEN rn = 1 THEN (zn - z) / hn WHEN rn = n THEN (z - zp) / hp
   ELSE (hp * hp * zn + (hn * hn - hp * hp) * z - hn * hn * zp) / (hp * hn * (hp + hn)) END) END AS ga FROM gn),
gsm AS (SELECT track_id, median(ga) AS med FROM ga GROUP BY 1),
gs AS (SELECT track_id, CASE WHEN 1.4826 * median(abs(ga - med)) > 0 THEN 1.4826 * median(abs(ga - med)) ELSE 1.0 END AS gscale FROM ga JOIN gsm USING (track_id) GROUP BY 1),
fld AS (SELECT d.track_id, x_index, y_index, d.x_mm, y_mm, z_mm, z_mm * 1e3 AS z_um, ga, baseline_um, spread_um, n_substrate, fallback,
   z_mm * 1e3 - baseline_um AS sr, ga / gscale AS gz
  FROM det d JOIN cb USING (track_id, x_index) JOIN gs ON gs.track_id = d.track_id LEFT JOIN ga USING (track_id, x_index, y_index))"""


def fields(spark, sf):
    det = detrended(spark, sf)
    how = fits_a_task(det, KEYS)
    return durable(gr.residual_fields(det, KEYS, gr.column_baseline(det, KEYS, **how), **how))


@query("residual_fields", f"""WITH {FLD} SELECT track_id, x_index, y_index, round(sr, 3) AS signed_residual, round(abs(sr), 3) AS absolute_residual,
  round(ga, 3) AS gradient_activity, round(sr / spread_um, 3) AS signed_positive_z, round(-sr / spread_um, 3) AS signed_negative_z,
  round(abs(sr) / spread_um, 3) AS absolute_residual_z, round(gz, 3) AS gradient_activity_z FROM fld""")
def residual_fields(spark, sf):
    f = fields(spark, sf).select("track_id", "x_index", "y_index", "signed_residual", "absolute_residual", "gradient_activity",
                                 "signed_positive_z", "signed_negative_z", "absolute_residual_z", "gradient_activity_z")
    return rounded(f, 3)


@query("field_summary", f"""WITH {FLD} SELECT track_id, count(*) AS n_points, max(x_index) - min(x_index) + 1 AS n_x, max(y_index) - min(y_index) + 1 AS n_y,
  round(min(x_mm), 6) AS x_min, round(max(x_mm), 6) AS x_max, round(min(y_mm), 6) AS y_min, round(max(y_mm), 6) AS y_max,
  round(avg((z_mm IS NOT NULL)::INT), 6) AS finite_fraction, round(quantile_cont(sr, 0.01), 3) AS signed_residual_p1, round(quantile_cont(sr, 0.5), 3) AS signed_residual_p50,
  round(quantile_cont(sr, 0.99), 3) AS signed_residual_p99, round(quantile_cont(ga, 0.01), 3) AS gradient_activity_p1, round(quantile_cont(ga, 0.5), 3) AS gradient_activity_p50,
  round(quantile_cont(ga, 0.99), 3) AS gradient_activity_p99 FROM fld GROUP BY 1""")
def field_summary(spark, sf):
    t = gr.field_summary(fields(spark, sf), KEYS, ["signed_residual", "gradient_activity"])
    return rounded(rounded(t, 6, "x_min", "x_max", "y_min", "y_max", "finite_fraction"), 3, *[c for c in t.columns if "_p" in c])


SM = FLD + f""",
s1 AS (SELECT track_id, x_index, min(x_mm) AS x_mm, avg((z_mm IS NOT NULL)::INT) AS finite_fraction,
  avg((sr IS NOT NULL)::INT) FILTER ({MID}) AS central_finite_fraction, avg((sr IS NOT NULL)::INT) FILTER (NOT {MID}) AS substrate_finite_fraction,
  any_value(baseline_um) AS baseline_um, any_value(spread_um) AS spread_um, any_value(n_substrate) AS n_substrate,
  median(sr) FILTER ({MID}) AS central_median, avg(sr) FILTER ({MID}) AS central_mean,
  avg((sr > 0)::INT) FILTER ({MID} AND sr IS NOT NULL) AS central_positive_fraction, avg((sr > spread_um)::INT) FILTER ({MID} AND sr IS NOT NULL) AS fraction_above_1_mad,
  avg((sr > 2.0 * spread_um)::INT) FILTER ({MID} AND sr IS NOT NULL) AS fraction_above_2_mad, avg((sr < -spread_um)::INT) FILTER ({MID} AND sr IS NOT NULL) AS fraction_below_1_mad,
  quantile_cont(sr, 0.75) FILTER ({MID}) - quantile_cont(sr, 0.25) FILTER ({MID}) AS central_iqr, max(sr) FILTER ({MID}) AS central_max, min(sr) FILTER ({MID}) AS central_min,
  median(sr) FILTER (NOT {MID}) AS substrate_median, median(abs(sr) / greatest(spread_um, 1e-9::DOUBLE)) FILTER ({MID}) AS event_strength,
  median(z_um) FILTER ({MID}) AS detrended_central_median, median(z_um) FILTER (NOT {MID}) AS detrended_substrate_median FROM fld GROUP BY 1, 2),
s2 AS (SELECT track_id, x_index, 1.4826 * median(abs(sr - substrate_median)) AS substrate_mad FROM fld JOIN s1 USING (track_id, x_index) WHERE NOT {MID} GROUP BY 1, 2),
sx AS (SELECT track_id, min(x_mm) AS lo, max(x_mm) AS hi FROM s1 GROUP BY 1),
sm AS (SELECT s1.*, substrate_mad, x_mm < lo + 2.0 OR x_mm > hi - 2.0 AS is_within_boundary_exclusion FROM s1 JOIN s2 USING (track_id, x_index) JOIN sx USING (track_id))"""


@query("section_metrics", f"""WITH {SM} SELECT track_id, x_index, n_substrate, is_within_boundary_exclusion, {', '.join(f'round({c}, 3) AS {c}' for c in (
    'x_mm', 'finite_fraction', 'central_finite_fraction', 'substrate_finite_fraction', 'baseline_um', 'spread_um', 'central_median', 'central_mean', 'central_positive_fraction',
    'fraction_above_1_mad', 'fraction_above_2_mad', 'fraction_below_1_mad', 'central_iqr', 'central_max', 'central_min', 'substrate_median', 'event_strength',
    'detrended_central_median', 'detrended_substrate_median', 'substrate_mad'))} FROM sm""")
def section_metrics(spark, sf):
    return rounded(gr.section_metrics(fields(spark, sf), KEYS), 3)


@query("descriptor_scalars", f"""WITH {SM} SELECT track_id, x_index, round(central_iqr, 3) AS amplitude_um, round(central_median, 3) AS signed_elevation_um,
  n_substrate < 50 AS fallback_baseline_required, finite_fraction >= 0.40 AND central_finite_fraction >= 0.80 AND n_substrate >= 50 AND NOT is_within_boundary_exclusion AS eligible FROM sm""")
def descriptor_scalars(spark, sf):
    t = gr.descriptor_scalars(gr.section_metrics(fields(spark, sf), KEYS))
    return rounded(t.select("track_id", "x_index", "amplitude_um", "signed_elevation_um", "fallback_baseline_required", "eligible"), 3)


@query("section_properties", f"""WITH {FLD}, c AS (SELECT *, row_number() OVER p AS rn, sr - lag(sr) OVER p AS d1, sr - 2 * lag(sr) OVER p + lag(sr, 2) OVER p AS d2,
   coalesce(sr >= lag(sr) OVER p AND sr >= lead(sr) OVER p, false) AS peak FROM fld WHERE {MID} AND sr IS NOT NULL WINDOW p AS (PARTITION BY track_id, x_index ORDER BY y_index)),
b AS (SELECT track_id, x_index, count(*) AS n_central, median(sr) AS central_median, avg(sr) AS central_mean, quantile_cont(sr, 0.75) - quantile_cont(sr, 0.25) AS amplitude_iqr,
   max(sr) - min(sr) AS peak_to_trough, avg((sr > 0)::INT) AS positive_fraction, avg((sr > spread_um)::INT) AS fraction_above_1_mad, avg((sr < -spread_um)::INT) AS fraction_below_1_mad,
   CASE WHEN count(*) FILTER (sr > 0) >= 2 THEN max(y_mm) FILTER (sr > 0) - min(y_mm) FILTER (sr > 0) ELSE 0.0 END AS positive_support_width,
   min(y_mm) FILTER (sr = mx) AS peak_y, median(sr) FILTER (y_mm <= 1.0) - median(sr) FILTER (y_mm > 1.0) AS left_minus_right,
   median(d1) AS m1, median(d2) AS m2, median(ga) AS gradient_median, median(z_um) AS detrended_central_median, any_value(n_substrate) AS n_substrate, any_value(fallback) AS fallback
  FROM (SELECT *, max(sr) OVER (PARTITION BY track_id, x_index) AS mx FROM c) GROUP BY 1, 2),
e AS (SELECT track_id, x_index, 1.4826 * median(abs(sr - central_median)) AS amplitude_mad, CASE WHEN any_value(n_central) >= 3 THEN 1.4826 * median(abs(d1 - m1)) END AS roughness,
   CASE WHEN any_value(n_central) >= 5 THEN 1.4826 * median(abs(d2 - m2)) END AS curvature FROM c JOIN b USING (track_id, x_index) GROUP BY 1, 2),
k AS (SELECT track_id, x_index, sum((peak AND sr > central_median + greatest(amplitude_mad, 1.0) AND n_central >= 5)::INT)::BIGINT AS n_prominent_maxima
  FROM c JOIN b USING (track_id, x_index) JOIN e USING (track_id, x_index) GROUP BY 1, 2),
s AS (SELECT track_id, x_index, min(x_mm) AS x_mm, avg((z_mm IS NOT NULL)::INT) AS finite_fraction, avg((sr IS NOT NULL)::INT) FILTER ({MID}) AS central_finite_fraction FROM fld GROUP BY 1, 2),
sx AS (SELECT track_id, min(x_mm) AS lo, max(x_mm) AS hi FROM s JOIN b USING (track_id, x_index) GROUP BY 1),
o AS (SELECT b.*, e.* EXCLUDE (track_id, x_index), n_prominent_maxima, s.x_mm, finite_fraction, central_finite_fraction, peak_y - 1.0 AS peak_offset,
   coalesce(amplitude_mad < 0.75, true) AS near_flat, x_mm < lo + 2.0 OR x_mm > hi - 2.0 AS is_within_boundary_exclusion
  FROM b JOIN e USING (track_id, x_index) JOIN k USING (track_id, x_index) JOIN s USING (track_id, x_index) JOIN sx USING (track_id))
SELECT track_id, x_index, n_central, n_substrate, fallback, n_prominent_maxima, near_flat, is_within_boundary_exclusion,
  central_finite_fraction >= 0.8 AND n_substrate >= 50 AND NOT is_within_boundary_exclusion AS eligible_core, {', '.join(f'round({c}, 3) AS {c}' for c in (
    'x_mm', 'central_median', 'central_mean', 'amplitude_iqr', 'peak_to_trough', 'positive_fraction', 'fraction_above_1_mad', 'fraction_below_1_mad', 'positive_support_width',
    'peak_y', 'left_minus_right', 'detrended_central_median', 'amplitude_mad', 'roughness', 'curvature', 'finite_fraction',
    'central_finite_fraction', 'peak_offset'))}, round(gradient_median, 6) AS gradient_median FROM o""")
def section_properties(spark, sf):
    t = gr.section_properties(fields(spark, sf), KEYS)
    # A median of two gradients can lie half-way at three digits.
    return rounded(t.withColumn("gradient_median", F.round("gradient_median", 6)), 3, *[
        f.name for f in t.schema.fields if f.dataType.simpleString() == "double" and f.name != "gradient_median"])


BAND = HP + """,
sp AS (SELECT track_id, min(x_mm) AS lo, max(x_mm) AS hi FROM hp GROUP BY 1),
ct AS (SELECT track_id, unnest(range(0, floor((hi - lo) / 0.8 + 1e-9)::BIGINT + 1)) AS position, lo FROM sp),
bp AS (SELECT track_id, position, lo + position * 0.8::DOUBLE AS x_at, y_index, min(y_mm) AS y_mm, median(z_mm) AS z_mm, count(z_mm) AS n_finite, avg((z_mm IS NOT NULL)::INT) AS finite_fraction
  FROM ct JOIN hp USING (track_id) WHERE abs(x_mm - (lo + position * 0.8::DOUBLE)) <= 0.18 GROUP BY ALL)"""


def band_profiles(spark, sf):
    """Median profiles over about five columns at every 0.8 mm."""
    pts = height_points(spark, sf)
    return gr.band_profile(pts, gr.analysis_grid(pts, KEYS, 0.8), KEYS, 0.18)


@query("band_profile", f"""WITH {BAND} SELECT track_id, position, y_index, round(y_mm, 6) AS y_mm, round(z_mm * 1e3, 9) AS z_um, n_finite, round(finite_fraction, 6) AS finite_fraction FROM bp""")
def band_profile(spark, sf):
    b = band_profiles(spark, sf)
    return b.select("track_id", "position", "y_index", r(F.col("y_mm")).alias("y_mm"), r(F.col("z_mm") * 1e3, 9).alias("z_um"), "n_finite", r(F.col("finite_fraction")).alias("finite_fraction"))


PB = BAND + f""",
pz AS (SELECT track_id, position, y_index, y_mm, z_mm * 1e3 AS z FROM bp),
p1 AS (SELECT track_id, position, count(z) FILTER ({SUB}) AS ns, count(z) AS na, median(z) FILTER ({SUB}) AS ms, median(z) AS ma FROM pz GROUP BY 1, 2),
p2 AS (SELECT track_id, position, 1.4826 * median(abs(z - ms)) FILTER ({SUB}) AS ds, 1.4826 * median(abs(z - ma)) AS da FROM pz JOIN p1 USING (track_id, position) GROUP BY 1, 2),
pb AS (SELECT track_id, position, CASE WHEN ns >= 30 THEN ms ELSE ma END AS baseline, CASE WHEN na > 0 THEN greatest(CASE WHEN ns >= 30 THEN ds ELSE da END, 0.75::DOUBLE) END AS spread,
  CASE WHEN ns >= 30 THEN 'substrate_outside_exclusion' WHEN na = 0 THEN 'no_finite' ELSE 'all_finite_fallback' END AS baseline_source, CASE WHEN ns >= 30 THEN ns ELSE na END AS n_baseline
  FROM p1 JOIN p2 USING (track_id, position))"""


@query("profile_baseline", f"WITH {PB} SELECT track_id, position, round(baseline, 9) AS baseline, round(spread, 9) AS spread, baseline_source, n_baseline FROM pb")
def profile_baseline(spark, sf):
    p = band_profiles(spark, sf).withColumn("z_um", F.col("z_mm") * 1e3)
    return rounded(gr.profile_baseline(p, ["track_id", "position"], "z_um", 30), 9)


@query("side_baselines", f"""WITH {BAND}, z AS (SELECT track_id, position, y_mm, z_mm * 1e3 AS z, min(y_mm) OVER (PARTITION BY track_id, position) + 0.55 AS yl,
   max(y_mm) OVER (PARTITION BY track_id, position) - 0.55 AS yr FROM bp),
a AS (SELECT track_id, position, median(z) AS wm, median(z) FILTER (y_mm <= yl) AS lb, median(z) FILTER (y_mm >= yr) AS rb, count(z) FILTER (y_mm <= yl) AS n_left, count(z) FILTER (y_mm >= yr) AS n_right FROM z GROUP BY 1, 2),
d AS (SELECT track_id, position, greatest(1.4826 * median(abs(z - lb)) FILTER (y_mm <= yl), 0.75::DOUBLE) AS ls, greatest(1.4826 * median(abs(z - rb)) FILTER (y_mm >= yr), 0.75::DOUBLE) AS rs
  FROM z JOIN a USING (track_id, position) GROUP BY 1, 2)
SELECT track_id, position, round(wm, 6) AS whole_median, round(lb, 6) AS left_baseline, round(rb, 6) AS right_baseline, n_left, n_right,
  round(CASE WHEN n_left > 0 THEN ls END, 6) AS left_spread, round(CASE WHEN n_right > 0 THEN rs END, 6) AS right_spread, round(lb - rb, 6) AS left_minus_right FROM a JOIN d USING (track_id, position)""")
def side_baselines(spark, sf):
    p = band_profiles(spark, sf).withColumn("z_um", F.col("z_mm") * 1e3)
    return rounded(gr.side_baselines(p, ["track_id", "position"]), 6)


@query("display_shear", f"""WITH {HP}, s AS (SELECT track_id, 0.5 * (min(x_mm) + max(x_mm)) AS ref FROM hp GROUP BY 1)
SELECT track_id, x_index, y_index, round(y_mm - 0.01 * (x_mm - ref), 9) AS y_sheared_mm FROM hp JOIN s USING (track_id)""")
def display_shear(spark, sf):
    return rounded(gr.shear(height_points(spark, sf), KEYS, 0.01).select("track_id", "x_index", "y_index", "y_sheared_mm"), 9)


@query("crop_and_mirror", f"""WITH {HP} SELECT track_id, count(*) AS n, round(min(x_mm), 6) AS x_first, round(max(x_mm), 6) AS x_last, count(*) FILTER ({MID}) AS n_central,
  count(*) FILTER ({MID} AND y_mm <= 1.0) AS n_left, count(*) FILTER ({MID} AND y_mm > 1.0) AS n_right FROM hp WHERE x_mm BETWEEN 20.0 AND 100.0 GROUP BY 1""")
def crop_and_mirror(spark, sf):
    p = height_points(spark, sf).withColumn("x_mm", gr.mirror_x("x_index", 0.08))
    count = lambda c: F.sum(c.cast("long"))
    return rounded(gr.crop(p, "x_mm").groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x_mm").alias("x_first"), F.max("x_mm").alias("x_last"), count(gr.central()).alias("n_central"),
        count(gr.left_half()).alias("n_left"), count(gr.right_half()).alias("n_right")), 6)
