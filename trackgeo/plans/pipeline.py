"""The three entry points: raw modalities to anchors, grids to descriptors, table to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.config import CONTROL, CORRIDOR_MM, Extraction
from trackgeo.functions import scores as sc
from trackgeo.operators import grid as gr
from trackgeo.operators import joins as jn
from trackgeo.operators import profiles as pr
from trackgeo.operators import segment as sg
from trackgeo.operators import stats as st
from trackgeo.operators import sequential as sq
from trackgeo.operators import structures as sx
from trackgeo.operators.layout import attach, fits_a_task
from trackgeo.sources.readers import tile_extents
from trackgeo.session import durable

# ------------------------------------------------------------------ raw modalities to anchors


def thermal_features(frames: DataFrame, keys: list[str], fallback: float = 1000.0) -> DataFrame:
    """One row per frame: peak, mean of positive pixels, and the largest hot region's moments.

    `frames` is long: keys, row, col, temp. Missing pixels count as 0.
    """
    px = frames.withColumn("temp", F.coalesce(F.nanvl("temp", F.lit(0.0)), F.lit(0.0)))
    positive = F.when(F.col("temp") > 0, F.col("temp"))
    stats = px.groupBy(*keys).agg(
        F.max("temp").alias("peak_temp"), F.avg(positive).alias("mean_temp"),
        F.percentile("temp", F.lit(0.995)).alias("frame_score"))
    limit = sx.otsu_thresholds(px.filter("temp > 0"), keys, "temp")
    hot = attach(px, limit, keys).filter(F.col("temp") > F.coalesce("threshold", F.lit(fallback)))
    cells = hot.select(*keys, F.col("col").alias("x_index"), F.col("row").alias("y_index"))
    region = sx.largest_region(sx.label(cells, keys), keys)
    t = stats.join(limit, keys, "left").join(region, keys, "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    return t.select(
        *keys, "peak_temp", "mean_temp", "frame_score", F.coalesce("threshold", F.lit(fallback)).alias("threshold"),
        zero("area", "long").alias("mp_area_px"), F.col("centroid_x").alias("mp_centroid_x"), F.col("centroid_y").alias("mp_centroid_y"),
        zero("major_axis", "double").alias("mp_length"), zero("minor_axis", "double").alias("mp_width"))


def tile_features(tiles: DataFrame, keys: list[str], index: str = "tile_index", margin: float = 0.30) -> DataFrame:
    """Texture of the outer rows of every tile, with the tile's x interval."""
    height = tiles.groupBy(*keys, index).agg((F.max("row") + 1).alias("_h"))
    m = F.floor(F.col("_h") * margin)
    outer = attach(tiles, height, [*keys, index]).filter((F.col("row") < m) | (F.col("row") >= F.col("_h") - m))
    texture = outer.groupBy(*keys, index).agg(
        F.var_pop("intensity").alias("substrate_roughness_variance"), F.avg("intensity").alias("substrate_mean_intensity"))
    every = tile_extents(height.drop("_h"), keys, index)
    return every.join(texture, [*keys, index], "left")


def unify(anchors: DataFrame, tiles: DataFrame, keys: list[str], x: str = "x_position_mm", tie: str = "frame_index", **sizes) -> DataFrame:
    """Anchors with the texture of the tile whose midpoint is nearest."""
    take = ["tile_index", "x_start_mm", "x_end_mm", "substrate_roughness_variance", "substrate_mean_intensity"]
    return jn.nearest(anchors, tiles, keys, x, "x_midpoint_mm", take, [tie], ["tile_index"], **sizes).drop("matched_x")


# ------------------------------------------------------------------ extraction with sweeps


def param(configs: list[Extraction], name: str, by: str = "config_name") -> Column:
    """A configuration parameter as a function of the `config_name` column, or of another column `by` that holds such names."""
    values = {c.config_name: getattr(c, name) for c in configs}
    if len(set(values.values())) == 1:
        return F.lit(next(iter(values.values())))
    pairs = [e for k, v in values.items() for e in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(by))


#: Parameters that decide the baseline of a profile, and with it its components.
BASELINE = ("exclusion_lo", "exclusion_hi", "min_spread", "min_baseline")
SEGMENT = (*BASELINE, "threshold_k", "min_samples", "min_width", "max_width")


def alike(configs: list[Extraction], names: tuple[str, ...]) -> dict[str, str]:
    """For every configuration the first one that has the same values of `names`."""
    first: dict[tuple, str] = {}
    return {c.config_name: first.setdefault(tuple(getattr(c, n) for n in names), c.config_name) for c in configs}


def each_of(heads: dict[str, str], by: str) -> Column:
    """Explodes a column `by`, which holds heads, into all names that have this head."""
    named = [(h, F.array(*[F.lit(n) for n, own in heads.items() if own == h])) for h in dict.fromkeys(heads.values())]
    if len(named) == 1:
        return F.explode(named[0][1])
    return F.explode(F.element_at(F.create_map(*[e for h, names in named for e in (F.lit(h), names)]), F.col(by)))


#: Width mode whose preferred width and scale come from pooled candidates of the first phase.
DATA_DERIVED = "data_derived"


def pooled_width_prior(profiles: DataFrame, case: list[str], base: Extraction, floor: float | None = None) -> DataFrame:
    """First phase: one row (`preferred_width`, `width_scale`) from the widths of all candidates under `base`.

    The scale is twice their spread, at least `floor` (the scale of `base` by default).
    """
    _, comps = scored_components(profiles, case, [base])
    return st.width_prior(comps, "width", base.width_scale if floor is None else floor, base.preferred_width)


def scored_components(
    profiles: DataFrame, case: list[str], configs: list[Extraction], prior: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Profile rows with baselines per `segment`, and the scored candidate components per configuration.

    A segment is a set of configurations that find the same components, under the name of the first; what they share is
    computed once, and so is a baseline that several segments share. `base_score` holds all terms but continuity.
    Configurations in the data-derived width mode take width and scale from the one row of `prior`, the others from
    their own parameters.
    """
    if prior is None and any(c.width_mode == DATA_DERIVED for c in configs):
        raise ValueError("the data-derived width mode needs a prior")
    p = lambda n: param(configs, n)
    bases, segments = alike(configs, BASELINE), alike(configs, SEGMENT)
    b, s = (lambda n: param(configs, n, "_base")), (lambda n: param(configs, n, "segment"))
    rows = profiles.withColumn("_base", F.explode(F.array(*[F.lit(n) for n in dict.fromkeys(bases.values())])))
    base = gr.profile_baseline(rows, ["_base", *case], "z_um", b("min_baseline"), b("min_spread"), (b("exclusion_lo"), b("exclusion_hi")))
    rows = attach(rows, base, ["_base", *case]).withColumn(
        "segment", each_of({n: bases[n] for n in dict.fromkeys(segments.values())}, "_base")).drop("_base")
    o = sg.by_profile(rows, ["segment", *case])
    comps = sg.over_threshold(o, s("threshold_k"), min_samples=s("min_samples"), min_width=s("min_width"), max_width=s("max_width"))
    comps = comps.withColumn("config_name", each_of(segments, "segment")).drop("segment")
    derived = p("width_mode") == DATA_DERIVED
    if prior is None:
        preferred, scale = p("preferred_width"), p("width_scale")
    else:
        comps = attach(comps, prior.select(F.col("preferred_width").alias("_pw"), F.col("width_scale").alias("_ps")), [])
        preferred = F.when(derived, F.col("_pw")).otherwise(p("preferred_width"))
        scale = F.when(derived, F.col("_ps")).otherwise(p("width_scale"))
    score = (
        p("height_weight") * sc.height_score(F.col("median_above"))
        + p("width_weight") * sc.width_score(F.col("width"), p("width_mode"), preferred, scale, p("width_lo"), p("width_hi"), p("width_taper"))
        + p("centre_weight") * sc.centre_score(F.col("centroid"), p("prior_lo"), p("prior_hi")))
    return rows, comps.withColumn("base_score", score).drop("_pw", "_ps")


def extract_sections(
    profiles: DataFrame, keys: list[str], position: str, configs: list[Extraction] | None = None,
    prior: DataFrame | None = None, **sizes
) -> DataFrame:
    """One extraction row per configuration, track and position.

    `profiles`: keys, position, y_index, y_mm, z_um. All configurations run in one job; `prior` feeds those with
    the data-derived width mode (`pooled_width_prior`).
    """
    configs = configs or [CONTROL]
    p = lambda n: param(configs, n)
    case = [*keys, position]
    by = ["config_name", *case]
    rows, comps = scored_components(profiles, case, configs, prior)
    comps = durable(comps)
    segments = alike(configs, SEGMENT)
    threshold = F.col("baseline") + param(configs, "threshold_k", "segment") * F.col("spread")
    summary = rows.groupBy("segment", *case).agg(
        F.avg(F.col("z_um").isNotNull().cast("double")).alias("finite_fraction"),
        F.first("baseline").alias("baseline_um"), F.first("spread").alias("robust_spread_um"), F.first(threshold).alias("threshold_um"),
        F.first("baseline_source").alias("baseline_source"),
        (F.sum((F.col("z_um") >= threshold).cast("long")) / F.greatest(F.count("z_um"), F.lit(1))).alias("fraction_finite_above_threshold"))
    summary = summary.withColumn("config_name", each_of(segments, "segment")).drop("segment")
    item = F.struct("component", "centroid", "base_score")
    lists = comps.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_c"))
    cases = summary.join(lists, by, "left").withColumn("_c", F.coalesce("_c", F.array().cast(dict(lists.dtypes)["_c"])))
    cases = cases.withColumns({
        "components": F.col("_c.component"), "centroids": F.col("_c.centroid"), "base_scores": F.col("_c.base_score"),
        "n_candidate_components": F.size("_c"), "continuity_weight": p("continuity_weight"), "continuity_scale": p("continuity_scale"),
        "min_score": p("min_score"), "ambiguity_ratio": p("ambiguity_ratio")}).drop("_c")
    picked = sq.select_in_sequence(cases, ["config_name", *keys], position, **sizes)
    picked = durable(picked.drop("continuity_weight", "continuity_scale", "min_score", "ambiguity_ratio"))
    best = comps.select(*by, "component", "y_min", "y_max", "width", "centroid")
    chosen = picked.filter("status = 'selected'").select(*by, "component").join(best, [*by, "component"])

    edges = None
    for window, run in sorted({(c.smooth_window, c.min_run) for c in configs}):
        names = [c.config_name for c in configs if (c.smooth_window, c.min_run) == (window, run)]
        mine = chosen.filter(F.col("config_name").isin(names))
        part = profiles.join(mine.select(*case), case, "left_semi")  # the gradient is the same for all of them
        o = sg.smoothed_gradient(sg.by_profile(part, case), "z_um", window, run, run)
        found = sg.refine_edges(o.df, mine, by, p("edge_margin"), p("edge_strength"))
        edges = found if edges is None else edges.unionByName(found)
    out = picked.join(chosen.drop("component"), by, "left").join(edges, by, "left")
    return out.select(
        *by, "finite_fraction", "baseline_um", "robust_spread_um", "threshold_um", "baseline_source", "fraction_finite_above_threshold",
        "n_candidate_components", F.col("score").alias("selected_component_score"), F.col("ambiguity").alias("ambiguity_score"),
        F.col("y_min").alias("segmentation_left"), F.col("y_max").alias("segmentation_right"), F.col("width").alias("segmentation_width"),
        F.col("centroid").alias("segmentation_centroid"), "refined_left", "refined_right", "refined_width", "left_edge_strength", "right_edge_strength",
        F.col("status").alias("extraction_status"))


def corridor(
    profiles: DataFrame, keys: list[str], threshold_sets: dict[str, list[float]], min_baseline: int = 200,
    min_samples: int = 8, min_width: float = 0.035, **sizes,
) -> DataFrame:
    """Best corridor per track and threshold set, one row per position.

    Components are found once for all thresholds; the sets only choose among them.
    """
    case = [*keys, "position"]
    prof = profiles.withColumn("z_um", F.col("z_mm") * 1e3)
    rows = attach(prof, gr.profile_baseline(prof, case, "z_um", min_baseline), case)
    finite = prof.groupBy(*case).agg(
        F.first("x_at").alias("x_mm"), F.avg(F.col("finite_fraction")).alias("finite_fraction"))
    levels = sorted({t for s in threshold_sets.values() for t in s})
    leveled = rows.withColumn("threshold_k", F.explode(F.array(*[F.lit(t) for t in levels])))
    o = sg.by_profile(leveled, ["threshold_k", *case])
    comps = durable(sg.above_threshold(o, F.col("threshold_k"), min_samples=min_samples, min_width=min_width))
    fams = None
    for name, chosen in threshold_sets.items():
        part = sq.families(comps.filter(F.col("threshold_k").isin(chosen)), case, chosen).withColumn("threshold_set", F.lit(name))
        fams = part if fams is None else fams.unionByName(part)
    fams = durable(fams)
    by = ["threshold_set", *keys]
    node = sq.nodes(fams.join(finite, case)).withColumn("node", F.col("family"))
    path = sq.best_path(node.withColumn("position", F.col("position").cast("long")), by, **sizes)
    counts = fams.groupBy("threshold_set", *case).agg(F.count(F.lit(1)).alias("n_competing_families"))
    total = path.groupBy(*by).agg(F.max("path_score").alias("path_score"))
    grid = finite.withColumn("threshold_set", F.explode(F.array(*[F.lit(n) for n in threshold_sets])))
    best = path.drop("path_score").join(node, [*by, "position", "node"]).select(
        *by, "position", F.col("y_min").alias("left_boundary_mm"), F.col("y_max").alias("right_boundary_mm"), F.col("width").alias("width_mm"),
        F.col("persistence").alias("persistence_fraction"), F.col("centroid_spread").alias("centroid_threshold_spread_mm"),
        F.col("width_spread").alias("width_threshold_spread_mm"), F.col("score").alias("node_score"))
    out = grid.join(best, ["threshold_set", *case], "left").join(counts, ["threshold_set", *case], "left").join(total, by, "left")
    return out.withColumns({
        "n_competing_families": F.coalesce("n_competing_families", F.lit(0)),
        "corridor_valid": F.col("left_boundary_mm").isNotNull()})


# ------------------------------------------------------------------ grids to descriptors


def shapes(fields: DataFrame, keys: list[str], grid: tuple[float, float, int] = pr.GRID) -> DataFrame:
    """Normalised shape of the central corridor of every grid column."""
    mid = fields.filter(gr.central(corridor=CORRIDOR_MM))
    return pr.normalise(pr.resample(mid, [*keys, "x_index"], "z_um", grid))


def profile_eligibility(fields: DataFrame, keys: list[str], **limits) -> DataFrame:
    """All flags of a column: scalar eligibility, shape status, inclusion in the shape study."""
    scalars = gr.descriptor_scalars(gr.section_metrics(fields, keys), **limits)
    t = scalars.join(shapes(fields, keys), [*keys, "x_index"])
    return t.withColumn("included", F.col("eligible") & F.col("nonflat"))


def geometry_descriptors(
    anchors: DataFrame, fields: DataFrame, keys: list[str], loadings: DataFrame, mean: DataFrame, retained: list[int],
    regimes: DataFrame, default_regime: Column, regime_bucket: float = 1.0, grid: tuple[float, float, int] = pr.GRID, **limits,
) -> DataFrame:
    """Descriptor row for every anchor: nearest column, scalars, shape scores, regime, status.

    The nearest column is found first, so only needed columns are resampled and projected; anchors
    outside the grid keep a row with null values and flags set.
    """
    columns = fields.select(*keys, "x_index", "x_mm").distinct()
    anchored = jn.nearest_column(anchors, columns, keys, "x_position_mm", "x_mm", "x_index", ["frame_index"], **fits_a_task(columns, keys))
    metrics = gr.descriptor_scalars(gr.section_metrics(fields, keys), **limits)
    needed = anchored.select(*keys, "x_index").distinct()
    shaped = shapes(fields.join(needed, [*keys, "x_index"], "left_semi"), keys, grid)
    kept = F.transform(F.array(*[F.lit(i) for i in retained]), lambda i: F.get("shape", i))
    shaped = shaped.withColumn("ready", kept)
    scored = pr.project(shaped, loadings, mean, 5)
    ready_share = pr.support(F.col("ready"))
    scored = scored.withColumns({"retained_pca_grid_finite_fraction": ready_share, "pca_ready": F.col("nonflat") & (ready_share == 1.0)})
    t = anchored.join(metrics.drop("x_mm"), [*keys, "x_index"], "left").join(scored, [*keys, "x_index"], "left")
    t = jn.in_interval(t, regimes, keys, ["frame_index"], "x_position_mm", "x_min", "x_max", "regime_id", "x_min", regime_bucket, default_regime)
    flag = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return t.select(
        *keys, "frame_index", "x_position_mm", F.col("x_index").alias("heightmap_x_index"), F.col("used_x").alias("heightmap_x_mm"),
        F.col("x_delta").alias("heightmap_x_delta_mm"), F.col("is_within_coverage").alias("is_within_heightmap_x_coverage"),
        flag("eligible", False).alias("eligible"), flag("nonflat", False).alias("nonflat"), flag("pca_ready", False).alias("pca_ready"),
        flag("fallback_baseline_required", True).alias("fallback_baseline_required"),
        flag("is_within_boundary_exclusion", True).alias("is_within_boundary_exclusion"),
        *[f"pc{i}" for i in range(1, 6)], "amplitude_um", "signed_elevation_um", "regime_id",
        F.when(F.col("is_within_coverage"), F.col("normalization_status")).otherwise("outside_heightmap_x_coverage").alias("normalization_status"),
        "finite_fraction", F.col("central_finite_fraction").alias("central_corridor_finite_fraction"),
        F.col("substrate_finite_fraction").alias("substrate_side_finite_fraction"), F.col("n_substrate").alias("baseline_support_count"),
        F.col("support_fraction").alias("shape_support_fraction_on_common_grid"), "retained_pca_grid_finite_fraction",
        F.col("shape_center").alias("shape_center_um_median"), F.col("shape_scale").alias("shape_scale_um_mad"))


def descriptor_null_rules() -> dict[str, Column]:
    """Where a null is expected in the merged table, per column."""
    outside = ~F.coalesce("is_within_heightmap_x_coverage", F.lit(False))
    empty = F.coalesce("central_corridor_finite_fraction", F.lit(0.0)) == 0
    rules = {c: outside for c in (
        "heightmap_x_mm", "heightmap_x_delta_mm", "finite_fraction", "central_corridor_finite_fraction", "substrate_side_finite_fraction",
        "baseline_support_count", "shape_support_fraction_on_common_grid", "retained_pca_grid_finite_fraction")}
    rules |= {f"pc{i}": ~F.coalesce("pca_ready", F.lit(False)) for i in range(1, 6)}
    rules |= {c: outside | empty for c in ("amplitude_um", "signed_elevation_um")}
    rules |= {c: outside | (F.col("normalization_status") == "insufficient_support") for c in ("shape_center_um_median", "shape_scale_um_mad")}
    return rules
