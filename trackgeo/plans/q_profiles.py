"""Profile queries: resampling, shape, similarity, medoids, regimes, PCA, descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgeo.config import SEPARATION_EDGES_MM
from trackgeo.functions import scores as sc
from trackgeo.operators import contracts as dq
from trackgeo.operators import grid as gr
from trackgeo.operators import joins as jn
from trackgeo.operators import profiles as pr
from trackgeo.operators import similarities as si
from trackgeo.operators import stats as st
from trackgeo.operators.layout import attach
from trackgeo.plans import pipeline as pl
from trackgeo.plans.inputs import HP, PR, height_points, profile_table
from trackgeo.plans.q_grid import fields
from trackgeo.plans.registry import query, r, rounded
from trackgeo.session import durable, new_path
from trackgeo.sources.readers import read_model
from trackgeo.sources.writers import write_model

KEYS = ["track_id"]
GRID = (0.65, 1.35, 36)
LIMITS = {"min_total": 0.40, "min_central": 0.60, "min_support": 40}


@query("resampled_profiles", f"""WITH {HP}, c AS (SELECT track_id, x_index, y_mm, z_mm * 1e3 AS v, lead(y_mm) OVER w AS y2, lead(z_mm * 1e3) OVER w AS v2 FROM hp WHERE y_mm BETWEEN 0.65 AND 1.35
  WINDOW w AS (PARTITION BY track_id, x_index ORDER BY y_index)),
g AS (SELECT range AS g, 0.65::DOUBLE + range * (0.7::DOUBLE / 35) AS yg FROM range(36)),
h AS (SELECT track_id, x_index, g, min_by(v + (v2 - v) * (yg - y_mm) / (y2 - y_mm), y_mm) AS z FROM c JOIN g ON yg >= y_mm - 1e-12 AND yg <= y2 + 1e-12 WHERE v IS NOT NULL AND v2 IS NOT NULL GROUP BY 1, 2, 3)
SELECT track_id, x_index, count(*) AS n_points, round(sum(z), 3) AS total, round(min(z), 3) AS low, round(max(z), 3) AS high, min(g) AS first_g, max(g) AS last_g FROM h GROUP BY 1, 2""")
def resampled_profiles(spark, sf):
    p = height_points(spark, sf).withColumn("z_um", F.col("z_mm") * 1e3).filter(gr.central())
    prof = pr.resample(p, [*KEYS, "x_index"], "z_um", GRID)
    long = prof.select(*KEYS, "x_index", F.posexplode("profile").alias("g", "z")).filter("z is not null")
    return rounded(long.groupBy(*KEYS, "x_index").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("z").alias("total"), F.min("z").alias("low"), F.max("z").alias("high"),
        F.min("g").cast("long").alias("first_g"), F.max("g").cast("long").alias("last_g")), 3)


NORM = f"""{PR}, el AS (SELECT track_id, x_index, x_mm, unnest(profile) AS e, generate_subscripts(profile, 1) AS g FROM pr),
nm AS (SELECT track_id, x_index, count(e) AS n, count(*) AS d, median(e) AS c FROM el GROUP BY 1, 2),
ns AS (SELECT track_id, x_index, any_value(n) AS n, any_value(d) AS d, any_value(c) AS c, 1.4826 * median(abs(e - c)) AS s FROM el JOIN nm USING (track_id, x_index) GROUP BY 1, 2),
sh AS (SELECT track_id, x_index, x_mm, g, (e - c) / s AS v FROM el JOIN ns USING (track_id, x_index) WHERE s >= 0.05 AND n / d::DOUBLE >= 0.7)"""


def shaped(spark, sf):
    """Shapes with their support and status; written once for all steps of a query."""
    return durable(pr.normalise(profile_table(spark, sf), min_scale=0.05).drop("full", "profile"))


@query("normalised_shapes", f"""WITH {NORM} SELECT track_id, x_index, round(n / d::DOUBLE, 6) AS support_fraction, round(c, 9) AS shape_center, round(s, 9) AS shape_scale,
  CASE WHEN n < 5 THEN 'insufficient_support' WHEN coalesce(s, 0) < 0.05 THEN 'near_flat_or_too_low_scale' ELSE 'ok' END AS normalization_status,
  n >= 5 AND coalesce(s, 0) >= 0.05 AND n / d::DOUBLE >= 0.7 AS nonflat,
  (SELECT round(sum(v * sh.g), 3) FROM sh WHERE sh.track_id = ns.track_id AND sh.x_index = ns.x_index) AS weighted FROM ns""")
def normalised_shapes(spark, sf):
    s = shaped(spark, sf)
    weights = F.aggregate(F.transform("shape", lambda e, i: F.coalesce(e * (i + 1), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    out = s.select("track_id", "x_index", "support_fraction", "shape_center", "shape_scale", "normalization_status", "nonflat",
                   F.when(F.col("nonflat"), r(weights, 3)).alias("weighted"))
    return rounded(rounded(out, 6, "support_fraction"), 9, "shape_center", "shape_scale")


SIM = f"""{NORM}, pc AS (SELECT a.track_id, a.x_index AS i, b.x_index AS j, abs(any_value(a.x_mm) - any_value(b.x_mm)) AS sep, count(*) AS n,
   avg(a.v * b.v) AS ab, avg(a.v) AS ma, avg(b.v) AS mb, covar_pop(a.v, b.v) AS cv, var_pop(a.v) AS va, var_pop(b.v) AS vb
  FROM sh a JOIN sh b ON a.track_id = b.track_id AND a.g = b.g AND a.x_index < b.x_index WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2, 3),
ps AS (SELECT *, cv / sqrt(va * vb) AS sim FROM pc WHERE n >= greatest(0.6 * 64, 5) AND va * vb > 0)"""


PROFILE = ("x_index", "shape", "x_mm")


def within_tracks(shapes, edges=None):
    """Similarities of all pairs of profiles of a track."""
    return si.similarity_summary(shapes.filter("nonflat"), KEYS, *PROFILE, edges)


@query("similarity_summary", f"""WITH {SIM} SELECT track_id, count(*) AS n_pairs, round(quantile_cont(sim, 0.1), 6) AS p10, round(quantile_cont(sim, 0.25), 6) AS p25, round(quantile_cont(sim, 0.5), 6) AS p50,
  round(quantile_cont(sim, 0.75), 6) AS p75, round(quantile_cont(sim, 0.9), 6) AS p90, round(avg(sim), 6) AS mean FROM ps GROUP BY 1""")
def similarity_summary(spark, sf):
    return rounded(within_tracks(shaped(spark, sf)), 6)


BINS = "CASE " + " ".join(f"WHEN sep {'>=' if i == 0 else '>'} {lo} AND sep <= {hi} THEN '{lo:g}-{hi:g}'" for i, (lo, hi) in enumerate(zip(SEPARATION_EDGES_MM, SEPARATION_EDGES_MM[1:]))) + " END"


@query("similarity_by_separation", f"""WITH {SIM}, b AS (SELECT track_id, sim, {BINS.replace('sep', 'round(sep, 9)')} AS bin FROM ps)
SELECT track_id, bin, count(*) AS n_pairs, round(quantile_cont(sim, 0.1), 6) AS p10, round(quantile_cont(sim, 0.5), 6) AS p50, round(quantile_cont(sim, 0.9), 6) AS p90, round(avg(sim), 6) AS mean
FROM b WHERE bin IS NOT NULL GROUP BY 1, 2""")
def similarity_by_separation(spark, sf):
    return rounded(within_tracks(shaped(spark, sf), SEPARATION_EDGES_MM).drop("p25", "p75"), 6)


@query("between_track_similarity", f"""WITH {NORM}, pc AS (SELECT a.track_id AS group_a, b.track_id AS group_b, a.x_index AS i, b.x_index AS j, count(*) AS n, covar_pop(a.v, b.v) AS cv, var_pop(a.v) AS va, var_pop(b.v) AS vb
  FROM sh a JOIN sh b ON a.g = b.g AND ((a.track_id = 0 AND b.track_id = 1) OR (a.track_id = 0 AND b.track_id = 2) OR (a.track_id = 1 AND b.track_id = 2)) WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT group_a, group_b, count(*) AS n_pairs, round(median(cv / sqrt(va * vb)), 6) AS p50, round(avg(cv / sqrt(va * vb)), 6) AS mean FROM pc WHERE n >= greatest(0.6 * 64, 5) AND va * vb > 0 GROUP BY 1, 2""")
def between_track_similarity(spark, sf):
    b = si.between_groups(shaped(spark, sf).filter("nonflat"), "track_id", *PROFILE, [(0, 1), (0, 2), (1, 2)])
    return rounded(b.select("group_a", "group_b", "n_pairs", "p50", "mean"), 6)


MED = f"""{SIM}, en AS (SELECT track_id, i AS x_index, sim FROM ps UNION ALL SELECT track_id, j, sim FROM ps), em AS (SELECT track_id, x_index, median(sim) AS m FROM en GROUP BY 1, 2),
sz AS (SELECT track_id, count(*) AS sample_size FROM (SELECT DISTINCT track_id, x_index FROM sh) GROUP BY 1),
md AS (SELECT track_id, x_index AS medoid, m FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(m, 12) DESC, x_index) AS k FROM em) WHERE k = 1)"""


def medoid_table(shapes):
    return si.medoids(shapes.filter("nonflat"), KEYS, *PROFILE)


@query("medoids", f"""WITH {MED} SELECT track_id, sample_size, medoid, round(medoid * 0.2::DOUBLE, 6) AS medoid_position, round(m, 6) AS median_similarity FROM md JOIN sz USING (track_id)""")
def medoids(spark, sf):
    return rounded(medoid_table(shaped(spark, sf)), 6)


TOM = f"""{MED}, tm AS (SELECT a.track_id, a.x_index, any_value(a.x_mm) AS x_mm, medoid, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS n,
   covar_pop(a.v, b.v) AS cv, var_pop(a.v) FILTER (b.v IS NOT NULL) AS va, var_pop(b.v) FILTER (a.v IS NOT NULL) AS vb
  FROM sh a JOIN md ON md.track_id = a.track_id JOIN sh b ON b.track_id = a.track_id AND b.x_index = medoid AND a.g = b.g GROUP BY 1, 2, 4),
ts AS (SELECT track_id, x_index, x_mm, medoid, n, CASE WHEN n / 64.0 >= 0.6 AND n >= 5 AND va * vb > 0 THEN cv / sqrt(va * vb) END AS sim FROM tm)"""


def to_medoid(shapes, med=None):
    """Every shape against the medoid of its track; the shape itself is not carried on."""
    med = durable(medoid_table(shapes)) if med is None else med
    return durable(pr.similarity_to_medoid(shapes.filter("nonflat"), med, KEYS, "x_index", "shape").drop("shape"))


@query("similarity_to_medoid", f"WITH {TOM} SELECT track_id, x_index, medoid, round(sim, 6) AS similarity_to_medoid, round(n / 64.0::DOUBLE, 6) AS shared_fraction, n AS n_shared FROM ts")
def similarity_to_medoid(spark, sf):
    return rounded(to_medoid(shaped(spark, sf)).select("track_id", "x_index", "medoid", "similarity_to_medoid", "shared_fraction", "n_shared"), 6)


@query("low_coherence_regimes", f"""WITH {TOM}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY x_mm, x_index) - 1 AS ix FROM ts),
l AS (SELECT *, ix - row_number() OVER (PARTITION BY track_id ORDER BY ix) AS g FROM o WHERE sim < 0.2),
s AS (SELECT track_id, min(ix) AS a, min(x_mm) AS x_min, max(x_mm) AS x_max, count(*) AS n_profiles, min(sim) AS lo, median(sim) AS md FROM l GROUP BY track_id, g),
k AS (SELECT *, row_number() OVER (ORDER BY track_id, a) AS no FROM s WHERE x_max - x_min >= 1.0)
SELECT track_id, printf('track_%d_lowcoherence_%02d', track_id, no) AS regime_id, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(x_max - x_min, 6) AS x_span, n_profiles,
  round(md, 6) AS median_similarity, round(lo, 6) AS min_similarity, 0.2::DOUBLE AS threshold_used FROM k""")
def low_coherence_regimes(spark, sf):
    return rounded(pr.low_coherence(to_medoid(shaped(spark, sf)), KEYS, "x_mm", "x_index", 0.2, 1.0), 6)


REGIMES = f"""{TOM}, ro AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY x_mm, x_index) - 1 AS ix FROM ts),
rl AS (SELECT *, ix - row_number() OVER (PARTITION BY track_id ORDER BY ix) AS g FROM ro WHERE sim < 0.2),
rs AS (SELECT track_id, min(ix) AS a, min(x_mm) AS x_min, max(x_mm) AS x_max FROM rl GROUP BY track_id, g),
rg AS (SELECT track_id, x_min, x_max, printf('track_%d_lowcoherence_%02d', track_id, row_number() OVER (ORDER BY track_id, a)) AS regime_id FROM rs WHERE x_max - x_min >= 1.0)"""


def flagged(shapes):
    """Shapes with eligibility (six tenths of the points) and fallback (less than 85 %) by support."""
    return shapes.withColumns({"eligible": F.col("support_fraction") >= 0.6, "fallback": F.col("support_fraction") < 0.85})


@query("coherence_summary", f"""WITH {TOM}, fl AS (SELECT track_id, n / d::DOUBLE >= 0.6 AS el, n / d::DOUBLE < 0.85 AS fb, n >= 5 AND coalesce(s, 0) >= 0.05 AND n / d::DOUBLE >= 0.7 AS nf FROM ns),
c AS (SELECT track_id, count(*) AS n, sum(el::INT)::BIGINT AS e, sum((el AND nf)::INT)::BIGINT AS i, sum(fb::INT) AS f, sum((fb AND el)::INT) AS fe FROM fl GROUP BY 1),
m AS (SELECT track_id, quantile_cont(sim, 0.1) AS m1, median(sim) AS m5, quantile_cont(sim, 0.9) AS m9, avg(sim) AS mm FROM ts GROUP BY 1),
w AS (SELECT track_id, count(*) AS np, quantile_cont(sim, 0.1) AS w1, quantile_cont(sim, 0.25) AS w2, median(sim) AS w5, quantile_cont(sim, 0.75) AS w7, quantile_cont(sim, 0.9) AS w9, avg(sim) AS wm FROM ps GROUP BY 1)
SELECT track_id, n AS n_total, e AS n_eligible, i AS n_included, round(e / n, 6) AS eligible_fraction, round(i / n, 6) AS included_fraction, round(i / greatest(e, 1), 6) AS included_of_eligible, round(f / n, 6) AS fallback_fraction,
  round(CASE WHEN e > 0 THEN fe / e END, 6) AS fallback_of_eligible, round(m1, 6) AS medoid_p10, round(m5, 6) AS medoid_p50, round(m9, 6) AS medoid_p90, round(mm, 6) AS medoid_mean, coalesce(np, 0) AS within_n_pairs,
  round(w1, 6) AS within_p10, round(w2, 6) AS within_p25, round(w5, 6) AS within_p50, round(w7, 6) AS within_p75, round(w9, 6) AS within_p90, round(wm, 6) AS within_mean FROM c LEFT JOIN m USING (track_id) LEFT JOIN w USING (track_id)""")
def coherence_summary(spark, sf):
    s = shaped(spark, sf)
    return rounded(pr.coherence_summary(flagged(s), to_medoid(s), within_tracks(s), KEYS), 6)


def chosen_profiles(spark, sf):
    """(profiles, medoids, representatives) with regimes of similarity below 0.2."""
    s = shaped(spark, sf)
    med = durable(medoid_table(s))
    sims = to_medoid(s, med)
    p = full_profiles(spark, sf)
    return p, med, durable(pr.representatives(p, med, pr.low_coherence(sims, KEYS, "x_mm", "x_index", 0.2, 1.0), KEYS, "x_mm", "x_index"))


REPS = f"""{REGIMES}, tg AS (SELECT track_id, 'track_' || track_id || '_medoid' AS label, medoid * 0.2::DOUBLE AS x FROM md UNION ALL SELECT track_id, regime_id, 0.5 * (x_min + x_max) FROM rg),
rp AS (SELECT * FROM (SELECT track_id, label, x_index, x_mm, "full", row_number() OVER (PARTITION BY track_id, label ORDER BY abs(x_mm - x), x_index) AS k FROM tg JOIN pr USING (track_id)) WHERE k = 1)"""


@query("representative_profiles", f"""WITH {REPS} SELECT track_id, label, x_index, round(x_mm, 6) AS x_mm FROM rp""")
def representative_profiles(spark, sf):
    return rounded(chosen_profiles(spark, sf)[2], 6)


@query("representative_errors", f"""WITH {REPS}, e AS (SELECT track_id, x_index, generate_subscripts("full", 1) AS g, unnest("full") AS v FROM pr), m AS (SELECT g, avg(v) AS m FROM e GROUP BY 1)
SELECT track_id, label, 0 AS n_components, round(sqrt(avg(pow(v - m, 2))), 6) AS rmse FROM rp JOIN e USING (track_id, x_index) JOIN m USING (g) GROUP BY 1, 2 UNION ALL SELECT track_id, label, 64, 0.0::DOUBLE FROM rp""")
def representative_errors(spark, sf):
    """Error of every representative without components and with all of them."""
    p, _, reps = chosen_profiles(spark, sf)
    loadings, mean = (durable(t) for t in pr.fit_pca(p))
    e = pr.reconstruction_errors(p.join(reps.select(*KEYS, "x_index", "label"), [*KEYS, "x_index"]), loadings, mean, ["track_id", "label"], [0, 64])
    return rounded(e, 6)


@query("regime_distinctness", f"""WITH {REPS}, z AS (SELECT a.track_id, a.label, a.x_index, md.medoid, generate_subscripts(a."full", 1) AS g, unnest(a."full") AS u, unnest(b."full") AS v
  FROM rp a JOIN md USING (track_id) JOIN pr b ON b.track_id = a.track_id AND b.x_index = medoid WHERE a.label LIKE '%lowcoherence%')
SELECT track_id, label, x_index, medoid, 64 AS n_components, round(corr(u, v), 6) AS correlation, corr(u, v) < 0.5 AS remains_distinct FROM z GROUP BY 1, 2, 3, 4""")
def regime_distinctness(spark, sf):
    """Every low-coherence regime against the medoid of its track, both rebuilt from all components."""
    return rounded(preserved(spark, sf, [64]), 6)


def preserved(spark, sf, ks):
    p, med, reps = chosen_profiles(spark, sf)
    loadings, mean = (durable(t) for t in pr.fit_pca(p))
    refs = reps.filter("label like '%lowcoherence%'").drop("x_mm").join(med.select("track_id", "medoid"), KEYS)
    return pr.regime_preservation(p, loadings, mean, KEYS, "x_index", refs, ks)


@query("coherence_verdict", f"""WITH {REGIMES}, w AS (SELECT track_id, median(sim) AS wm, quantile_cont(sim, 0.1) AS w10 FROM ps GROUP BY 1), t AS (SELECT track_id, median(sim) AS mm FROM ts GROUP BY 1),
f AS (SELECT track_id, avg((n >= 5 AND coalesce(s, 0) >= 0.05 AND n / d::DOUBLE >= 0.7)::INT) AS nf FROM ns GROUP BY 1),
l AS (SELECT min(wm) AS wm, min(w10) AS w10, min(mm) AS mm, min(nf) AS nf, (SELECT count(*) FROM rg) AS n_regimes FROM w JOIN t USING (track_id) JOIN f USING (track_id))
SELECT round(wm, 6) AS wm, round(w10, 6) AS w10, round(mm, 6) AS mm, round(nf, 6) AS nf, n_regimes, CASE WHEN wm >= {sc.PAIR_STRONG} AND mm >= {sc.MEDOID_STRONG} AND nf >= {sc.NONFLAT_STRONG} AND n_regimes = 0 THEN '{sc.COHERENCE_WORDS["strong"]}'
  WHEN wm < {sc.PAIR_MIXED} AND mm < {sc.MEDOID_MIXED} THEN '{sc.COHERENCE_WORDS["mixed"]}' WHEN n_regimes > 0 OR w10 < 0.0 THEN '{sc.COHERENCE_WORDS["partial"]}' ELSE '{sc.COHERENCE_WORDS["open"]}' END AS verdict FROM l""")
def coherence_verdict(spark, sf):
    shapes = shaped(spark, sf)
    s = to_medoid(shapes)
    within = within_tracks(shapes).select("track_id", F.col("p50").alias("wm"), F.col("p10").alias("w10"))
    mid = st.medians(s, KEYS, {"mm": "similarity_to_medoid"})
    share = shapes.groupBy("track_id").agg(F.avg(F.col("nonflat").cast("double")).alias("nf"))
    regimes = pr.low_coherence(s, KEYS, "x_mm", "x_index", 0.2, 1.0).agg(F.count(F.lit(1)).alias("n_regimes"))
    worst = within.join(mid, KEYS).join(share, KEYS).agg(*[F.min(c).alias(c) for c in ("wm", "w10", "mm", "nf")])
    t = attach(worst, regimes, [])
    return rounded(t.withColumn("verdict", sc.coherence_verdict(F.col("wm"), F.col("w10"), F.col("mm"), F.col("nf"), F.col("n_regimes"))), 6)


@query("single_position_audit", f"""WITH {TOM}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(abs(x_mm - 43.244), 9), x_index) AS k FROM ts)
SELECT track_id, x_index, round(x_mm, 6) AS x_mm, round(sim, 6) AS similarity_to_medoid FROM n WHERE k = 1""")
def single_position_audit(spark, sf):
    s = to_medoid(shaped(spark, sf))
    targets = s.select("track_id").distinct().select("track_id", F.lit("audit").alias("label"), F.lit(43.244).alias("target"))
    hit = pr.nearest_item(s, targets, KEYS, "x_mm", "x_index")
    return rounded(hit.join(s.select("track_id", "x_index", "similarity_to_medoid"), [*KEYS, "x_index"]).drop("label"), 6)


@query("pca_ready_matrix", f"""WITH {NORM}, fs AS (SELECT g, avg((v IS NOT NULL)::INT) AS f FROM sh GROUP BY 1), k AS (SELECT g FROM fs WHERE f >= 0.93)
SELECT count(*) AS n_ready, (SELECT count(*) FROM k) AS n_points FROM (SELECT track_id, x_index FROM sh JOIN k USING (g) GROUP BY 1, 2 HAVING count(v) = (SELECT count(*) FROM k))""")
def pca_ready_matrix(spark, sf):
    retained, ready = pr.ready_matrix(shaped(spark, sf).filter("nonflat"), "shape", 0.93)
    return attach(ready.agg(F.count(F.lit(1)).alias("n_ready")), retained.agg(F.count(F.lit(1)).alias("n_points")), [])


def full_profiles(spark, sf):
    return profile_table(spark, sf).select("track_id", "x_index", "x_mm", F.col("full").alias("ready"))


@query("pca_explained_variance", f"""WITH {PR}, e AS (SELECT generate_subscripts("full", 1) AS g, unnest("full") AS v FROM pr)
SELECT round(sum(s), 9) AS total_variance FROM (SELECT var_samp(v) AS s FROM e GROUP BY g)""")
def pca_explained_variance(spark, sf):
    loadings, _ = pr.fit_pca(full_profiles(spark, sf))
    return rounded(loadings.agg(F.sum("explained_variance").alias("total_variance")), 9)


# Three grid points: the eigenvalues of a 3 x 3 matrix have a closed form.
SMALL = (0, 19, 39)
EIGEN = f"""{PR}, pt AS (SELECT track_id, x_index, {', '.join(f'"full"[{g + 1}] AS p{i}' for i, g in enumerate(SMALL, 1))} FROM pr),
cv AS (SELECT count(*) AS n, var_samp(p1) AS a, var_samp(p2) AS b, var_samp(p3) AS c, covar_samp(p1, p2) AS d, covar_samp(p1, p3) AS e, covar_samp(p2, p3) AS f FROM pt),
c1 AS (SELECT *, (a + b + c) / 3 AS q FROM cv), c2 AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS h FROM c1),
c3 AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / pow(h, 3) / 2))) / 3 AS w FROM c2),
c4 AS (SELECT n, q, q + 2 * h * cos(w) AS e1, q + 2 * h * cos(w + 2 * pi() / 3) AS e3 FROM c3),
eg AS (SELECT n, 3 * q AS total, unnest([1, 2, 3]) AS component, unnest([e1, 3 * q - e1 - e3, e3]) AS v FROM c4)"""


def small_model(spark, sf):
    """Profiles on three grid points and their frozen model, written and read back."""
    p = profile_table(spark, sf).select("track_id", "x_index", F.array(*[F.get("full", F.lit(g)) for g in SMALL]).alias("ready"))
    path = new_path(spark)
    write_model(*pr.fit_pca(p), path)
    return p, *read_model(spark, path)


@query("pca_explained_ratios", f"WITH {EIGEN} SELECT component, round(v, 9) AS explained_variance, round(v / total, 9) AS explained_ratio FROM eg")
def pca_explained_ratios(spark, sf):
    _, loadings, _ = small_model(spark, sf)
    return rounded(loadings.select("component", "explained_variance", "explained_ratio"), 9)


@query("pca_residual_energy", f"""WITH {EIGEN}, k AS (SELECT unnest([0, 1, 2, 3]) AS k)
SELECT k AS n_components, round(coalesce(sum(v) FILTER (component > k), 0) * any_value(n - 1), 6) AS residual_energy FROM eg, k GROUP BY 1""")
def pca_residual_energy(spark, sf):
    """Sum of squared residuals after k components, by a model that was written and read back."""
    p, loadings, mean = small_model(spark, sf)
    e = pr.reconstruction_errors(p, loadings, mean, ["track_id", "x_index"], [0, 1, 2, 3])
    return rounded(e.groupBy("n_components").agg((F.sum(F.col("rmse") * F.col("rmse")) * len(SMALL)).alias("residual_energy")), 6)


@query("model_contract", f"""WITH {PR} SELECT least(count(*) - 1, 64)::BIGINT AS n_components, 64 AS min_points, 64 AS max_points, 0::BIGINT AS bad_loadings, 64 AS n_points, 0::BIGINT AS bad_means,
  count(*) > 5 AS passed FROM pr""")
def model_contract(spark, sf):
    loadings, mean = (durable(t) for t in pr.fit_pca(full_profiles(spark, sf)))
    return dq.model_contract(loadings, mean, 5, [0.65 + 0.7 * i / 63 for i in range(64)])


@query("pca_components")
def pca_components(spark, sf):
    loadings, _ = pr.fit_pca(full_profiles(spark, sf))
    return rounded(pr.loading_summary(loadings.filter("component <= 6"), [0.65 + 0.7 * i / 63 for i in range(64)]), 6)


@query("pca_reconstruction", f"""WITH {PR}, e AS (SELECT track_id, x_index, generate_subscripts("full", 1) AS g, unnest("full") AS v FROM pr), m AS (SELECT g, avg(v) AS m FROM e GROUP BY 1),
t AS (SELECT track_id, x_index, sqrt(avg(pow(v - m, 2))) AS rmse FROM e JOIN m USING (g) GROUP BY 1, 2)
SELECT track_id, 0 AS n_components, round(median(rmse), 6) AS p50 FROM t GROUP BY 1 UNION ALL SELECT track_id, 64, 0.0::DOUBLE FROM t GROUP BY 1""")
def pca_reconstruction(spark, sf):
    """Error without any component (the spread itself) and with all of them (none)."""
    p = full_profiles(spark, sf)
    loadings, mean = (durable(t) for t in pr.fit_pca(p))
    e = pr.reconstruction_errors(p, loadings, mean, ["track_id", "x_index"], [0, 64])
    return rounded(st.medians(e, ["track_id", "n_components"], {"p50": "rmse"}), 6)


@query("pca_scores")
def pca_scores(spark, sf):
    p = full_profiles(spark, sf)
    loadings, mean = (durable(t) for t in pr.fit_pca(p))
    return rounded(pr.project(p, loadings, mean, 5).select("track_id", "x_index", *[f"pc{i}" for i in range(1, 6)]), 6)


@query("regime_preservation")
def regime_preservation(spark, sf):
    """Every low-coherence regime against the medoid of its track, rebuilt from 3, 5 and all but one components."""
    return rounded(preserved(spark, sf, [3, 5, 63]), 5)


@query("profile_eligibility")
def profile_eligibility(spark, sf):
    t = pl.profile_eligibility(fields(spark, sf), KEYS, **LIMITS)
    return rounded(t.select("track_id", "x_index", "eligible", "nonflat", "included", "normalization_status", "support_fraction", "shape_scale", "amplitude_um", "signed_elevation_um"), 4)


def descriptor_table(spark, sf):
    """Descriptors at anchors 0.2 mm apart, on a basis fitted to the complete shapes of all tracks."""
    f = fields(spark, sf)
    shapes = pl.shapes(f, KEYS, GRID)
    retained = list(range(GRID[2]))
    ready = shapes.filter("nonflat").withColumn("ready", F.col("shape")).filter(F.forall("ready", lambda e: e.isNotNull()))
    loadings, mean = (durable(t) for t in pr.fit_pca(ready))
    span = f.groupBy("track_id").agg(F.min("x_mm").alias("lo"), F.max("x_mm").alias("hi"))
    n = F.ceil((F.col("hi") - F.col("lo")) / 0.2) + 4
    anchors = span.select("track_id", "lo", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("frame_index")).select(
        "track_id", "frame_index", (F.col("lo") - 0.3 + F.col("frame_index") * 0.2).alias("x_position_mm"))
    regimes = span.select("track_id", (F.col("lo") + 1.0).alias("x_min"), (F.col("lo") + 2.5).alias("x_max"),
                          F.concat(F.lit("track_"), F.col("track_id").cast("string"), F.lit("_lowcoherence_01")).alias("regime_id"))
    default = F.concat(F.lit("track_"), F.col("track_id").cast("string"), F.lit("_coherent"))
    return anchors, pl.geometry_descriptors(anchors, f, KEYS, loadings, mean, retained, regimes, default, 1.0, GRID, **LIMITS)


@query("geometry_descriptors")
def geometry_descriptors(spark, sf):
    return rounded(descriptor_table(spark, sf)[1], 4)


@query("descriptor_null_audit")
def descriptor_null_audit(spark, sf):
    """Anchors merged one to one with their descriptors, then audited for unexpected nulls."""
    anchors, d = descriptor_table(spark, sf)
    d = durable(d)
    merged = jn.one_to_one(durable(anchors), d.drop("x_position_mm"), ["track_id", "frame_index"], require_match=F.lit(True))
    return dq.null_audit(merged, ["track_id", "frame_index"], pl.descriptor_null_rules())[0]
