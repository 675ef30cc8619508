"""Height grids as long tables `(track, x_index, y_index, x_mm, y_mm, z_mm)`.

A grid column (one x of one track) is bounded by the instrument's sensor height; a track is not.
Statistics per column use the built-in aggregates, statistics per track the size-checked ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.config import CORRIDOR_MM, X_START_MM, X_STOP_MM
from trackgeo.operators import joins
from trackgeo.operators.layout import attach, order_rows
from trackgeo.operators.series import gradient_in_runs, mark_runs
from trackgeo.operators.stats import MAD_SCALE, median_and_mad, percentiles, percentiles_in_place
from trackgeo.session import durable


def crop(df: DataFrame, column: str, lo: float = X_START_MM, hi: float = X_STOP_MM) -> DataFrame:
    """Closed range; a plain comparison, so it reaches the scan."""
    return df.filter(F.col(column).between(lo, hi))


def mirror_x(x_index: str, pixel: float, origin: float = 100.0) -> Column:
    return F.lit(origin) - F.col(x_index) * pixel


def frame_x(stop: Column, index: Column, step: float = 0.2, end: float = 100.0) -> Column:
    """Centre of a frame counted back from the frame where the scan stops."""
    return F.lit(end) - ((stop - index) - 0.5) * step


def stride(df: DataFrame, every: dict[str, int]) -> DataFrame:
    """Every k-th row and column of a grid, for fits on a thinned grid."""
    for column, k in every.items():
        if k > 1:
            df = df.filter(F.pmod(F.col(column), F.lit(k)) == 0)
    return df


def central(y: str = "y_mm", corridor: tuple[float, float] = CORRIDOR_MM) -> Column:
    return F.col(y).between(*corridor)


def substrate(y: str = "y_mm", corridor: tuple[float, float] = CORRIDOR_MM) -> Column:
    return (F.col(y) < corridor[0]) | (F.col(y) > corridor[1])


def left_half(y: str = "y_mm", corridor: tuple[float, float] = CORRIDOR_MM) -> Column:
    return central(y, corridor) & (F.col(y) <= 0.5 * (corridor[0] + corridor[1]))


def right_half(y: str = "y_mm", corridor: tuple[float, float] = CORRIDOR_MM) -> Column:
    return central(y, corridor) & (F.col(y) > 0.5 * (corridor[0] + corridor[1]))


def shear(
    points: DataFrame, keys: list[str], slope: float, strength: float = 1.0,
    reference: float | None = None,
) -> DataFrame:
    """y corrected by strength·slope·(x − reference); the reference defaults to the middle of x."""
    if reference is not None:
        at = points.withColumn("_ref", F.lit(reference))
    else:
        span = points.groupBy(*keys).agg((0.5 * (F.min("x_mm") + F.max("x_mm"))).alias("_ref"))
        at = attach(points, span, keys)
    corrected = F.col("y_mm") - strength * slope * (F.col("x_mm") - F.col("_ref"))
    return at.withColumn("y_sheared_mm", corrected).drop("_ref")


# ------------------------------------------------------------------ plane detrending


@dataclass(frozen=True)
class PlaneRule:
    """Which samples a robust plane fit starts from and how it trims them."""

    rounds: int
    substrate_only: bool
    trim: str  # "all": p5..p95 of all samples; "kept": p5..p95 of the kept; "mad": 3 MAD
    min_samples: int = 100


GLOBAL = PlaneRule(3, False, "all")
FOCUSED = PlaneRule(3, True, "kept")
FOCUSED_MAD = PlaneRule(4, True, "mad")


#: Below this share of the larger eigenvalue the positions count as lying on one line.
LINE = 1e-12


def plane_of(m: Column) -> Column:
    """Struct `(a, b, c)`: least squares z = a·x + b·y + c of minimum slope from centred second moments.

    Positions on one line have a moment matrix M of rank one, whose pseudo-inverse is M / trace²; positions in
    one point leave a = b = 0.
    """
    trace = m["xx"] + m["yy"]
    det = m["xx"] * m["yy"] - m["xy"] * m["xy"]
    larger = trace / 2 + F.sqrt((m["xx"] - m["yy"]) * (m["xx"] - m["yy"]) / 4 + m["xy"] * m["xy"])
    full = det > LINE * larger * larger  # the smaller eigenvalue is det / larger
    line = trace > 0

    def slope(solved: Column, projected: Column) -> Column:
        return F.when(full, solved / det).when(line, projected / (trace * trace)).otherwise(F.lit(0.0))

    a = slope(m["xz"] * m["yy"] - m["yz"] * m["xy"], m["xx"] * m["xz"] + m["xy"] * m["yz"])
    b = slope(m["yz"] * m["xx"] - m["xz"] * m["xy"], m["xy"] * m["xz"] + m["yy"] * m["yz"])
    return F.struct(a.alias("a"), b.alias("b"), (m["mz"] - a * m["mx"] - b * m["my"]).alias("c"))


def plane_moments(kept: Column) -> Column:
    """Mergeable moments of the kept samples of a group."""
    x, y, z = (F.when(kept, F.col(c)) for c in ("x_mm", "y_mm", "z_mm"))
    return F.struct(
        F.count(x).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"),
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"),
        F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))


def _plane_residual(p: Column) -> Column:
    return F.col("z_mm") - (p["a"] * F.col("x_mm") + p["b"] * F.col("y_mm") + p["c"])


def fit_planes(
    points: DataFrame, keys: list[str], rule: PlaneRule = FOCUSED, corridor: tuple[float, float] = CORRIDOR_MM,
) -> DataFrame:
    """Robust plane per key over all its samples: `a, b, c, n_initial, n_final`; coefficients null when samples lack.

    A round is one mergeable aggregate over the kept samples and exact trimming limits from bucket counts
    (`percentiles_in_place`); samples are written once and never moved. The state between rounds is one row per
    key: the planes so far with their limits. A round that would keep fewer than `min_samples` ends the fit of its
    key, which stays as it was.
    """
    sample = points.filter("z_mm is not null")
    if rule.substrate_only:
        sample = sample.filter(substrate(corridor=corridor))
    sample = durable(sample.select(*keys, "x_mm", "y_mm", "z_mm"))
    history = "array<struct<plane:struct<a:double,b:double,c:double>,lo:double,hi:double>>"
    inside = lambda past: _plane_residual(past["plane"]).between(past["lo"], past["hi"])
    kept = F.forall("past", inside) if rule.trim == "kept" else F.coalesce(inside(F.get("past", F.size("past") - 1)), F.size("past") == 0)

    def solved(state: DataFrame) -> DataFrame:
        """Size and plane of the kept samples of every key, over what the state said before."""
        rows = attach(sample, state.select(*keys, "past", "stopped"), keys)
        m = rows.groupBy(*keys).agg(plane_moments(kept & ~F.col("stopped")).alias("m"))
        usable = ~F.col("stopped") & (F.col("m")["n"] >= rule.min_samples)
        return m.join(state, keys).select(
            *keys, F.when(usable, plane_of(F.col("m"))).otherwise(F.col("plane")).alias("plane"),
            F.when(usable, F.col("m")["n"]).otherwise(F.col("n_final")).alias("n_final"), "n_initial", "past", (~usable).alias("stopped"))

    def limits(rows: DataFrame) -> DataFrame:
        pool = rows.filter(~F.col("stopped")) if rule.trim == "all" else rows.filter(~F.col("stopped") & kept)
        away = pool.select(*keys, _plane_residual(F.col("plane")).alias("r"))
        if rule.trim != "mad":
            return percentiles_in_place(away, keys, "r", [0.05, 0.95]).select(
                *keys, F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
        middle = durable(percentiles_in_place(away, keys, "r", [0.5]).select(*keys, F.get("q", F.lit(0)).alias("mid")))
        off = attach(away, middle, keys).select(*keys, F.abs(F.col("r") - F.col("mid")).alias("d"))
        spread = percentiles_in_place(off, keys, "d", [0.5]).join(middle, keys)
        half = 3.0 * F.greatest(MAD_SCALE * F.get("q", F.lit(0)), F.lit(1e-9))
        return spread.select(*keys, (F.col("mid") - half).alias("lo"), (F.col("mid") + half).alias("hi"))

    first = sample.groupBy(*keys).agg(F.count("*").alias("n_initial")).select(
        *keys, F.lit(None).cast("struct<a:double,b:double,c:double>").alias("plane"), F.col("n_initial").alias("n_final"), "n_initial",
        F.array().cast(history).alias("past"), F.lit(False).alias("stopped"))
    state = durable(solved(durable(first)))
    for _ in range(rule.rounds):
        entry = F.array(F.struct("plane", "lo", "hi"))
        trimmed = durable(state.join(limits(attach(sample, state, keys)), keys, "left").withColumn(
            "past", F.when(F.col("lo").isNull(), F.col("past")).otherwise(F.concat("past", entry).cast(history))).drop("lo", "hi"))
        last = state
        state = durable(solved(trimmed))
    # The last trim is counted, but no plane is fitted to it.
    planes = last.select(*keys, "plane").join(state.select(*keys, "n_initial", "n_final"), keys)
    return planes.select(*keys, "plane.a", "plane.b", "plane.c", "n_initial", "n_final")


def detrend(points: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """Height above the fitted plane; tracks without a fit stay as they are."""
    flat = planes.select(*keys, "a", "b", "c")
    plane = F.col("a") * F.col("x_mm") + F.col("b") * F.col("y_mm") + F.col("c")
    return attach(points, flat, keys).withColumn(
        "z_mm", F.col("z_mm") - F.coalesce(plane, F.lit(0.0))
    ).drop("a", "b", "c")


def detrend_comparison(
    grids: dict[str, DataFrame], keys: list[str], corridor: tuple[float, float] = CORRIDOR_MM, **how
) -> DataFrame:
    """Substrate residual median and MAD per detrending method."""
    out = None
    for name, points in grids.items():
        part = points.filter(substrate(corridor=corridor) & F.col("z_mm").isNotNull()).select(
            *keys, F.lit(name).alias("method"), "z_mm")
        out = part if out is None else out.unionByName(part)
    return median_and_mad(out, [*keys, "method"], ["z_mm"], **how)


# ------------------------------------------------------------------ sorted lists of bounded groups


def _known(keys: list[str]) -> Column:
    """True where all `keys` are present."""
    return F.expr(" and ".join(f"`{k}` is not null" for k in keys))


def _middle(name: str) -> Column:
    """Median of the sorted list `name`, as the percentile aggregates interpolate it; null if empty."""
    at = lambda i: F.get(name, F.floor(i).cast("int"))
    n = F.size(name)
    return F.when(n % 2 == 1, at((n - 1) / 2)).otherwise(0.5 * at(n / 2 - 1) + 0.5 * at(n / 2))


def _at_share(name: str, p: float) -> Column:
    """Percentile `p` of the sorted list `name`, as the percentile aggregates interpolate it; null if empty."""
    place = F.lit(float(p)) * (F.size(name) - 1)
    low, high = (F.get(name, f(place).cast("int")) for f in (F.floor, F.ceil))
    return F.when(F.floor(place) == F.ceil(place), low).otherwise(low * (F.ceil(place) - place) + high * (place - F.floor(place)))


def _away(name: str, middle: str) -> Column:
    """Sorted distances of the list `name` from the column `middle`."""
    return F.sort_array(F.transform(name, lambda e: F.abs(e - F.col(middle))))


# ------------------------------------------------------------------ baselines and residual fields


def column_baseline(
    points: DataFrame,
    keys: list[str],
    min_samples: int = 50,
    floor_um: float = 0.75,
    corridor: tuple[float, float] = CORRIDOR_MM,
    **how,
) -> DataFrame:
    """Substrate median and spread per grid column, with the track's as fallback (µm)."""
    column = [*keys, "x_index"]
    sub = points.withColumn("_s", F.when(substrate(corridor=corridor), F.col("z_mm") * 1e3))
    # A column is bounded by the sensor height, so its values stand in one row.
    lists = sub.filter(_known(column)).groupBy(*column).agg(F.min("x_mm").alias("x_mm"), F.sort_array(F.collect_list("_s")).alias("_v"))
    local = lists.withColumns({"n_substrate": F.size("_v").cast("long"), "s_median": _middle("_v")}).withColumn(
        "_d", _away("_v", "s_median")).select(*column, "x_mm", "n_substrate", "s_median", (_middle("_d") * MAD_SCALE).alias("s_mad"))
    whole = median_and_mad(sub.filter("_s is not null"), keys, {"g": "_s"}, **how)
    table = attach(local, whole, keys)
    enough = F.col("n_substrate") >= min_samples
    floor = F.lit(floor_um)
    return table.select(
        *column, "x_mm", "n_substrate",
        F.when(enough, F.col("s_median")).otherwise(F.col("g_median")).alias("baseline_um"),
        F.greatest(
            F.when(enough, F.col("s_mad")).otherwise(F.coalesce("g_mad", floor)), floor
        ).alias("spread_um"),
        (~enough).alias("fallback"),
    )


def residual_fields(
    points: DataFrame, keys: list[str], baselines: DataFrame, min_run: int = 5, **how
) -> DataFrame:
    """Signed, absolute and gradient fields with their z-scores."""
    column = [*keys, "x_index"]
    o = order_rows(points, column, ["y_index"], "_iy", bounded=True)
    o = mark_runs(o.with_columns({"z_um": F.col("z_mm") * 1e3}), F.col("z_mm").isNotNull())
    o = gradient_in_runs(o, "z_um", "y_mm", min_run, "_g")
    # Read by both scans of its spread and by the fields.
    grad = durable(o.df.withColumn("gradient_activity", F.abs("_g")).drop(
        "_g", "_iy", "run_start", "run_end"))
    scale = median_and_mad(grad, keys, {"g": "gradient_activity"}, **how).select(
        *keys, F.when(F.col("g_mad") > 0, F.col("g_mad")).otherwise(F.lit(1.0)).alias("_gs"))
    per_column = baselines.select(*column, "baseline_um", "spread_um", "n_substrate", "fallback")
    joined = attach(attach(grad, per_column, column), scale, keys)
    signed = F.col("z_um") - F.col("baseline_um")
    return joined.withColumns({
        "signed_residual": signed,
        "absolute_residual": F.abs(signed),
        "signed_positive_z": signed / F.col("spread_um"),
        "signed_negative_z": -signed / F.col("spread_um"),
        "absolute_residual_z": F.abs(signed) / F.col("spread_um"),
        "gradient_activity_z": F.col("gradient_activity") / F.col("_gs"),
    }).drop("_gs")


def field_summary(fields: DataFrame, keys: list[str], names: list[str], **how) -> DataFrame:
    """Grid size, extents, finite share and p1/p50/p99 of each field."""
    basic = fields.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        (F.max("x_index") - F.min("x_index") + 1).alias("n_x"),
        (F.max("y_index") - F.min("y_index") + 1).alias("n_y"),
        F.min("x_mm").alias("x_min"), F.max("x_mm").alias("x_max"),
        F.min("y_mm").alias("y_min"), F.max("y_mm").alias("y_max"),
        F.avg(F.col("z_mm").isNotNull().cast("double")).alias("finite_fraction"),
    )
    q = percentiles(fields, keys, {f"q_{n}": n for n in names}, [0.01, 0.5, 0.99], **how)
    return attach(basic, q, keys).select(
        *basic.columns,
        *[F.col(f"q_{n}")[i].alias(f"{n}_p{p}") for n in names for i, p in enumerate((1, 50, 99))],
    )


# ------------------------------------------------------------------ cross sections


def _share(condition: Column, of: Column) -> Column:
    return F.avg(F.when(of, condition.cast("double")))


def boundary_flag(table: DataFrame, keys: list[str], margin: float = 2.0) -> DataFrame:
    """Marks columns closer than `margin` to either end of their track."""
    span = table.groupBy(*keys).agg(F.min("x_mm").alias("_lo"), F.max("x_mm").alias("_hi"))
    x = F.col("x_mm")
    return attach(table, span, keys).withColumn(
        "is_within_boundary_exclusion", (x < F.col("_lo") + margin) | (x > F.col("_hi") - margin)
    ).drop("_lo", "_hi")


def section_metrics(
    fields: DataFrame, keys: list[str], corridor: tuple[float, float] = CORRIDOR_MM,
    margin: float = 2.0,
) -> DataFrame:
    """Shares, residual statistics and event strength of every cross section."""
    column = [*keys, "x_index"]
    mid = central(corridor=corridor)
    r, spread = F.col("signed_residual"), F.col("spread_um")
    ok = r.isNotNull()
    c, s = F.when(mid, r), F.when(~mid, r)
    listed = lambda v: F.sort_array(F.collect_list(v))
    lists = fields.groupBy(*column).agg(
        F.min("x_mm").alias("x_mm"),
        F.avg(F.col("z_mm").isNotNull().cast("double")).alias("finite_fraction"),
        _share(ok, mid).alias("central_finite_fraction"),
        _share(ok, ~mid).alias("substrate_finite_fraction"),
        F.first("baseline_um").alias("baseline_um"),
        F.first("spread_um").alias("spread_um"),
        F.first("n_substrate").alias("n_substrate"),
        F.avg(c).alias("central_mean"),
        _share(r > 0, mid & ok).alias("central_positive_fraction"),
        _share(r > spread, mid & ok).alias("fraction_above_1_mad"),
        _share(r > 2.0 * spread, mid & ok).alias("fraction_above_2_mad"),
        _share(r < -spread, mid & ok).alias("fraction_below_1_mad"),
        F.max(c).alias("central_max"), F.min(c).alias("central_min"),
        # A column is bounded by the sensor height, so its values stand in one row.
        listed(c).alias("_c"), listed(s).alias("_s"),
        listed(F.abs(c) / F.greatest(spread, F.lit(1e-9))).alias("_e"),
        listed(F.when(mid, F.col("z_um"))).alias("_zc"), listed(F.when(~mid, F.col("z_um"))).alias("_zs"),
    )
    table = lists.withColumn("substrate_median", _middle("_s")).withColumn("_d", _away("_s", "substrate_median")).select(
        *column, "x_mm", "finite_fraction", "central_finite_fraction", "substrate_finite_fraction", "baseline_um", "spread_um", "n_substrate",
        _middle("_c").alias("central_median"), "central_mean", "central_positive_fraction", "fraction_above_1_mad", "fraction_above_2_mad",
        "fraction_below_1_mad", (_at_share("_c", 0.75) - _at_share("_c", 0.25)).alias("central_iqr"), "central_max", "central_min",
        "substrate_median", _middle("_e").alias("event_strength"), _middle("_zc").alias("detrended_central_median"),
        _middle("_zs").alias("detrended_substrate_median"), F.when(_known(column), _middle("_d") * MAD_SCALE).alias("substrate_mad"))
    return boundary_flag(table, keys, margin)


def section_properties(
    fields: DataFrame, keys: list[str], corridor: tuple[float, float] = CORRIDOR_MM,
    margin: float = 2.0, min_central: float = 0.80, min_support: int = 50, flat_mad: float = 0.75,
) -> DataFrame:
    """Amplitude, support, asymmetry, roughness and peak counts of every cross section.

    Differences run over the finite central samples put side by side, gaps closed.
    """
    column = [*keys, "x_index"]
    mid = central(corridor=corridor)
    r, y = F.col("signed_residual"), F.col("y_mm")
    shares = fields.groupBy(*column).agg(
        F.avg(F.col("z_mm").isNotNull().cast("double")).alias("finite_fraction"),
        _share(r.isNotNull(), mid).alias("central_finite_fraction"),
    )
    c = fields.filter(mid & r.isNotNull())
    o = order_rows(c, column, ["y_index"], "_ic", bounded=True)
    o = o.rolling(2, 1, lambda w: {
        "_d1": r - F.lag(r, 1).over(w),
        "_d2": r - 2 * F.lag(r, 1).over(w) + F.lag(r, 2).over(w),
        "_peak": F.coalesce((r >= F.lag(r, 1).over(w)) & (r >= F.lead(r, 1).over(w)), F.lit(False)),
    })
    q = lambda p: F.percentile(r, F.lit(p))
    pos = F.when(r > 0, y)
    basic = o.df.groupBy(*column).agg(
        F.min("x_mm").alias("x_mm"), F.count(F.lit(1)).alias("n_central"),
        F.first("n_substrate").alias("n_substrate"), F.first("fallback").alias("fallback"),
        F.first("spread_um").alias("_sp"),
        F.median(r).alias("central_median"), F.avg(r).alias("central_mean"),
        (q(0.75) - q(0.25)).alias("amplitude_iqr"),
        (F.max(r) - F.min(r)).alias("peak_to_trough"),
        F.avg((r > 0).cast("double")).alias("positive_fraction"),
        F.avg((r > F.col("spread_um")).cast("double")).alias("fraction_above_1_mad"),
        F.avg((r < -F.col("spread_um")).cast("double")).alias("fraction_below_1_mad"),
        F.when(F.count(pos) >= 2, F.max(pos) - F.min(pos)).otherwise(F.lit(0.0)).alias("positive_support_width"),
        F.min_by("y_mm", F.struct(-r, y)).alias("peak_y"),
        (F.median(F.when(left_half(corridor=corridor), r))
         - F.median(F.when(right_half(corridor=corridor), r))).alias("left_minus_right"),
        F.median("_d1").alias("_m1"), F.median("_d2").alias("_m2"),
        F.median("gradient_activity").alias("gradient_median"),
        F.median("z_um").alias("detrended_central_median"),
    )
    again = attach(o.df, basic.select(*column, "central_median", "_m1", "_m2", "n_central"), column)
    spreads = again.groupBy(*column).agg(
        (F.median(F.abs(r - F.col("central_median"))) * MAD_SCALE).alias("amplitude_mad"),
        F.when(F.first("n_central") >= 3, F.median(F.abs(F.col("_d1") - F.col("_m1"))) * MAD_SCALE).alias("roughness"),
        F.when(F.first("n_central") >= 5, F.median(F.abs(F.col("_d2") - F.col("_m2"))) * MAD_SCALE).alias("curvature"),
    )
    enough = attach(again, spreads, column)
    high = r > F.col("central_median") + F.greatest(F.col("amplitude_mad"), F.lit(1.0))
    peaks = enough.groupBy(*column).agg(
        F.sum((F.col("_peak") & high & (F.col("n_central") >= 5)).cast("long")).alias("n_prominent_maxima"))
    table = basic.join(spreads, column).join(peaks, column).join(shares, column)
    table = boundary_flag(table, keys, margin)
    middle = 0.5 * (corridor[0] + corridor[1])
    return table.withColumns({
        "peak_offset": F.col("peak_y") - middle,
        "near_flat": F.coalesce(F.col("amplitude_mad") < flat_mad, F.lit(True)),
        "eligible_core": (F.col("central_finite_fraction") >= min_central)
        & (F.col("n_substrate") >= min_support) & ~F.col("is_within_boundary_exclusion"),
    }).drop("_sp", "_m1", "_m2")


def descriptor_scalars(
    metrics: DataFrame, min_total: float = 0.40, min_central: float = 0.80, min_support: int = 50
) -> DataFrame:
    """Amplitude, elevation and eligibility of a cross section from its metrics."""
    return metrics.withColumns({
        "amplitude_um": F.col("central_iqr"),
        "signed_elevation_um": F.col("central_median"),
        "fallback_baseline_required": F.col("n_substrate") < min_support,
        "eligible": (F.col("finite_fraction") >= min_total)
        & (F.col("central_finite_fraction") >= min_central)
        & (F.col("n_substrate") >= min_support)
        & ~F.col("is_within_boundary_exclusion"),
    })


# ------------------------------------------------------------------ profiles at analysis positions


def analysis_grid(points: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Evenly spaced positions from the first to the last x of each track."""
    span = points.groupBy(*keys).agg(F.min("x_mm").alias("lo"), F.max("x_mm").alias("hi"))
    n = F.floor((F.col("hi") - F.col("lo")) / step + 1e-9)
    return span.select(*keys, "lo", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("position")).select(
        *keys, "position", (F.col("lo") + F.col("position") * step).alias("x_at"))


def band_profile(
    points: DataFrame, centres: DataFrame, keys: list[str], half: float
) -> DataFrame:
    """Median over a band of columns per y, with the finite count and share.

    The columns of a band are few, so the medians are per (position, y) groups of that size.
    """
    near = joins.band(centres, points, keys, "x_at", "x_mm", half)
    by = [*keys, "position", "x_at", "y_index"]
    return near.groupBy(*by).agg(
        F.min("y_mm").alias("y_mm"), F.sort_array(F.collect_list("z_mm")).alias("_z"),
        F.count("z_mm").alias("n_finite"),
        F.avg(F.col("z_mm").isNotNull().cast("double")).alias("finite_fraction"),
    ).select(*by, "y_mm", _middle("_z").alias("z_mm"), "n_finite", "finite_fraction")


def profile_baseline(
    profiles: DataFrame, keys: list[str], value: str = "z_um", min_samples: int = 200,
    floor: float = 0.75, corridor: tuple[float, float] = CORRIDOR_MM,
) -> DataFrame:
    """Substrate median and spread of one profile; all finite samples when those are too few.

    A profile is bounded by the sensor height, so both lists of its values stand in one row.
    """
    v = F.col(value)
    lists = profiles.filter(_known(keys)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(substrate(corridor=corridor), v))).alias("_s"), F.sort_array(F.collect_list(v)).alias("_a"))
    t = lists.withColumns({"_ms": _middle("_s"), "_ma": _middle("_a")}).withColumns({
        "_ds": F.sort_array(F.transform("_s", lambda e: F.abs(e - F.col("_ms")))),
        "_da": F.sort_array(F.transform("_a", lambda e: F.abs(e - F.col("_ma"))))}).withColumns({
            "_ns": F.size("_s").cast("long"), "_na": F.size("_a").cast("long"),
            "_ds": _middle("_ds") * MAD_SCALE, "_da": _middle("_da") * MAD_SCALE})
    enough = F.col("_ns") >= min_samples
    none = F.col("_na") == 0
    return t.select(
        *keys,
        F.when(enough, F.col("_ms")).otherwise(F.col("_ma")).alias("baseline"),
        F.when(~none, F.greatest(F.when(enough, F.col("_ds")).otherwise(F.col("_da")), F.lit(floor))).alias("spread"),
        F.when(enough, "substrate_outside_exclusion").when(none, "no_finite")
        .otherwise("all_finite_fallback").alias("baseline_source"),
        F.when(enough, F.col("_ns")).otherwise(F.col("_na")).alias("n_baseline"),
    )


def side_baselines(
    profiles: DataFrame, keys: list[str], value: str = "z_um", side_width: float = 0.55, floor: float = 0.75
) -> DataFrame:
    """Independent left and right outer baselines of each profile and their difference."""
    span = profiles.groupBy(*keys).agg(F.min("y_mm").alias("_y0"), F.max("y_mm").alias("_y1"))
    rows = attach(profiles, span, keys)
    v = F.col(value)
    left = F.when(F.col("y_mm") <= F.col("_y0") + side_width, v)
    right = F.when(F.col("y_mm") >= F.col("_y1") - side_width, v)
    first = rows.groupBy(*keys).agg(
        F.median(v).alias("whole_median"), F.median(left).alias("left_baseline"),
        F.median(right).alias("right_baseline"), F.count(left).alias("n_left"), F.count(right).alias("n_right"))
    again = attach(rows, first, keys)
    spread = again.groupBy(*keys).agg(
        F.greatest(F.median(F.abs(left - F.col("left_baseline"))) * MAD_SCALE, F.lit(floor)).alias("left_spread"),
        F.greatest(F.median(F.abs(right - F.col("right_baseline"))) * MAD_SCALE, F.lit(floor)).alias("right_spread"))
    return first.join(spread, keys).withColumns({
        "left_spread": F.when(F.col("n_left") > 0, F.col("left_spread")),
        "right_spread": F.when(F.col("n_right") > 0, F.col("right_spread")),
        "left_minus_right": F.col("left_baseline") - F.col("right_baseline"),
    })


def side_disagreement(
    profiles: DataFrame, keys: list[str], value: str = "z_um", min_samples: int = 200, spreads: float = 3.0,
) -> DataFrame:
    """Whole median, substrate baseline and side difference of each profile.

    `sides_disagree` flags a difference of the side baselines beyond `spreads` substrate spreads; profiles without
    both sides are not flagged.
    """
    base = profile_baseline(profiles, keys, value, min_samples)
    sides = side_baselines(profiles, keys, value).select(*keys, "whole_median", "left_minus_right")
    return base.join(sides, keys).select(
        *keys, "whole_median", "baseline", (F.col("whole_median") - F.col("baseline")).alias("difference"), "spread", "left_minus_right",
        (F.col("baseline_source") != "substrate_outside_exclusion").alias("fallback_used"),
        F.coalesce(F.abs("left_minus_right") > spreads * F.col("spread"), F.lit(False)).alias("sides_disagree"))
