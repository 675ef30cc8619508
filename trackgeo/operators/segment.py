"""Components, edges, seeds and boundaries on single profiles.

A profile is one cross section, `y_index, y_mm` and a height column, keyed by track and position
(and by configuration in a sweep). All functions work on `Ordered` rows keyed by profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgeo.operators.layout import Ordered, attach, order_rows
from trackgeo.operators.series import gradient_in_runs, mark_runs, smooth_in_runs
from trackgeo.operators.stats import MAD_SCALE


def by_profile(profiles: DataFrame, keys: list[str]) -> Ordered:
    return order_rows(profiles, keys, ["y_index"], "_iy", bounded=True)


def components(
    o: Ordered,
    mask: Column,
    value: str = "z_um",
    baseline: str = "baseline",
    centroid: str = "mean",
    min_samples: Column | int = 6,
    min_width: Column | float = 0.035,
    max_width: Column | float = 1.10,
    keep: list[str] | None = None,
) -> DataFrame:
    """Runs of `mask` with size limits and height statistics over the baseline.

    `centroid`: "mean" of y, "weighted" by height over the baseline, or the "midpoint".
    `component` numbers the kept runs of a profile from 0 in y order.
    """
    marked = mark_runs(o, mask)
    above = F.col(value) - F.col(baseline)
    y, weight = F.col("y_mm"), F.greatest(above, F.lit(0.0))
    middle = 0.5 * (F.min(y) + F.max(y))
    centre = {
        "mean": F.avg(y),
        "midpoint": middle,
        "weighted": F.when(F.sum(weight) > 0, F.sum(y * weight) / F.sum(weight)).otherwise(middle),
    }[centroid]
    groups = marked.where(F.col("run_start").isNotNull()).groupBy(*o.keys, "run_start").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        (F.max(y) - F.min(y)).alias("width"), centre.alias("centroid"),
        F.median(above).alias("median_above"), F.max(above).alias("peak_above"),
        F.median(F.abs(above)).alias("median_abs"), F.max(F.abs(above)).alias("peak_abs"),
        F.avg((above > 0).cast("double")).alias("frac_pos"),
        F.avg((above < 0).cast("double")).alias("frac_neg"),
        *[F.first(c).alias(c) for c in keep or []],
    )
    sized = groups.filter(
        (F.col("n_samples") >= min_samples) & F.col("width").between(min_width, max_width))
    w = Window.partitionBy(*o.keys).orderBy("run_start")
    return sized.withColumn("component", F.row_number().over(w) - 1).drop("run_start")


def over_threshold(o: Ordered, k: Column, spread: str = "spread", **how) -> DataFrame:
    """Rule with the limit included: z ≥ baseline + k·spread."""
    return components(o, F.col("z_um") >= F.col("baseline") + k * F.col(spread), **how)


def above_threshold(o: Ordered, k: Column, spread: str = "spread", **how) -> DataFrame:
    """Strict rule: z − baseline > k·spread, centroid weighted by height."""
    how = {"centroid": "weighted", "min_samples": 8, **how}
    return components(o, F.col("z_um") - F.col("baseline") > k * F.col(spread), **how)


def residual_candidates(o: Ordered, k: Column, absolute: bool, spread: str = "spread", **how) -> DataFrame:
    """Candidate intervals of signed (z > b + k·s) or absolute (|z − b| > k·s) residuals."""
    r = F.col("z_um") - F.col("baseline")
    how = {"centroid": "midpoint", "min_samples": 8, **how}
    return components(o, (F.abs(r) if absolute else r) > k * F.col(spread), **how)


def smoothed_gradient(
    o: Ordered, value: str = "z_um", window: int = 9, min_run: int = 15, grad_run: int = 5
) -> Ordered:
    """Smoothed height and its gradient inside finite runs."""
    o = mark_runs(o, F.col(value).isNotNull())
    o = smooth_in_runs(o, value, window, min_run, "z_smooth")
    o = gradient_in_runs(o, "z_smooth", "y_mm", grad_run, "gradient")
    return o.with_df(o.df.drop("run_start", "run_end"))


def refine_edges(
    rows: DataFrame, chosen: DataFrame, keys: list[str], margin: Column | float, strength: Column | float
) -> DataFrame:
    """Steepest rise near the left end and steepest fall near the right end of a chosen component.

    `rows` carry `y_mm, gradient` and some of the `keys`; `chosen` one row per key with `y_min, y_max`.
    """
    shared = [k for k in keys if k in rows.columns]
    near = attach(rows.filter("gradient is not null").select(*shared, "y_mm", "gradient"), chosen.select(*keys, "y_min", "y_max"), shared, "inner")
    y, g = F.col("y_mm"), F.col("gradient")
    left = F.when(y.between(F.col("y_min") - margin, F.col("y_min") + margin), g)
    right = F.when(y.between(F.col("y_max") - margin, F.col("y_max") + margin), g)
    best = near.groupBy(*keys).agg(
        F.max(left).alias("left_edge_strength"),
        F.min_by(y, F.when(left.isNotNull(), F.struct(-left, y))).alias("_ly"),
        F.abs(F.min(right)).alias("right_edge_strength"),
        F.min_by(y, F.when(right.isNotNull(), F.struct(right, y))).alias("_ry"),
    )
    table = chosen.select(*keys).join(best, keys, "left")
    lo = F.when(F.col("left_edge_strength") >= strength, F.col("_ly"))
    hi = F.when(F.col("right_edge_strength") >= strength, F.col("_ry"))
    return table.select(
        *keys, "left_edge_strength", "right_edge_strength",
        lo.alias("refined_left"), hi.alias("refined_right"),
        F.when(hi > lo, hi - lo).alias("refined_width"),
    )


# ------------------------------------------------------------------ seeds


def _column_mad(rows: DataFrame, keys: list[str], values: list[str], floor: float) -> DataFrame:
    """MAD per profile with a positive stand-in for flat or empty profiles."""
    mid = rows.groupBy(*keys).agg(*[F.median(v).alias(f"_m_{v}") for v in values])
    away = attach(rows, mid, keys).groupBy(*keys).agg(
        *[(F.median(F.abs(F.col(v) - F.col(f"_m_{v}"))) * MAD_SCALE).alias(f"{v}_scale") for v in values])
    return away.select(
        *keys,
        *[F.when(F.col(f"{v}_scale") > 0, F.col(f"{v}_scale")).otherwise(F.lit(floor)).alias(f"{v}_scale")
          for v in values])


def disturbance_activity(o: Ordered, window: int = 9, min_run: int = 15) -> tuple[Ordered, DataFrame]:
    """Smoothed |residual|/MAD + ½·|gradient|/MAD; returns the rows and the two scales.

    Expects `z_smooth, gradient, baseline` on the rows.
    """
    keys = list(o.keys)
    o = o.with_columns({
        "residual": F.col("z_smooth") - F.col("baseline"),
        "abs_gradient": F.abs("gradient"),
    })
    scales = _column_mad(o.df, keys, ["residual", "abs_gradient"], 1e-6)
    raw = F.abs("residual") / F.col("residual_scale") + 0.5 * F.col("abs_gradient") / F.col("abs_gradient_scale")
    o = o.with_df(attach(o.df, scales, keys)).with_columns({"_raw": raw})
    o = mark_runs(o, F.col("_raw").isNotNull())
    o = smooth_in_runs(o, "_raw", window, min_run, "activity")
    return o.with_df(o.df.drop("_raw", "run_start", "run_end")), scales


def seed_intervals(o: Ordered, top: float = 0.10, min_level: float = 2.5) -> DataFrame:
    """Runs of high activity: at least the upper quantile and the floor, with positive width."""
    keys = list(o.keys)
    a = F.col("activity")
    level = o.df.groupBy(*keys).agg(
        F.greatest(
            F.when(F.count(a) < 10, F.max(a)).otherwise(F.percentile(a, F.lit(1.0 - top))),
            F.lit(min_level)).alias("activity_threshold"))
    marked = mark_runs(o.with_df(attach(o.df, level, keys)), a >= F.col("activity_threshold"))
    spans = marked.where(F.col("run_start").isNotNull()).groupBy(*keys, "run_start").agg(
        F.min("y_mm").alias("y_min"), F.max("y_mm").alias("y_max"),
        F.sum(a).alias("integrated_activity"), F.count(a).alias("n_samples"),
        F.first("activity_threshold").alias("activity_threshold"))
    return spans.withColumns({
        "width": F.col("y_max") - F.col("y_min"),
        "centroid": 0.5 * (F.col("y_min") + F.col("y_max")),
    }).filter("width > 0")


def pick_seed(intervals: DataFrame, profiles: DataFrame, keys: list[str], margin: float = 0.15) -> DataFrame:
    """Interval with the largest integrated activity; ambiguous when the next is close."""
    w = Window.partitionBy(*keys).orderBy(F.desc("integrated_activity"), F.desc("width"), "run_start")
    two = intervals.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    n = intervals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_intervals"))
    first = lambda c: F.max(F.when(F.col("_rn") == 1, F.col(c)))
    best = two.groupBy(*keys).agg(
        first("y_min").alias("seed_y_min"), first("y_max").alias("seed_y_max"),
        first("centroid").alias("seed_centroid"), first("integrated_activity").alias("seed_activity"),
        F.max(F.when(F.col("_rn") == 2, F.col("integrated_activity"))).alias("_second"))
    table = profiles.select(*keys).distinct().join(best.join(n, keys), keys, "left")
    gap = F.col("seed_activity") - F.col("_second")
    close = F.coalesce(gap / F.greatest(F.col("seed_activity"), F.lit(1e-9)) < margin, F.lit(False))
    return table.select(
        *keys,
        F.when(F.col("seed_activity").isNull(), "no_seed").when(close, "ambiguous_seed").otherwise("ok").alias("seed_status"),
        "seed_y_min", "seed_y_max", "seed_centroid", "seed_activity", gap.alias("seed_margin"),
        F.coalesce("n_intervals", F.lit(0)).alias("n_intervals"))


def peak_seed(o: Ordered, residual: str = "residual", top: float = 0.10) -> DataFrame:
    """Sample nearest the median y of the largest residuals; the largest one in small profiles.

    Two samples equally far (to nine digits) give the lower one, as a median often lies halfway between samples.
    """
    keys = list(o.keys)
    r = F.abs(F.col(residual))
    stats = o.df.groupBy(*keys).agg(
        F.count(r).alias("_n"), F.percentile(r, F.lit(1.0 - top)).alias("_q"),
        F.min_by("y_mm", F.when(r.isNotNull(), F.struct(-r, F.col("y_mm")))).alias("_arg"))
    rows = attach(o.df, stats, keys)
    mid = rows.groupBy(*keys).agg(
        F.when(F.first("_n") < 10, F.first("_arg")).otherwise(
            F.median(F.when(r >= F.col("_q"), F.col("y_mm")))).alias("_y"))
    gap = F.abs(F.col("y_mm") - F.col("_y"))
    return attach(o.df, mid, keys).groupBy(*keys).agg(
        F.min_by("y_mm", F.when(gap.isNotNull(), F.struct(F.round(gap, 9), F.col("y_mm")))).alias("seed_y"))


# ------------------------------------------------------------------ gradient transitions, substrate return


def gradient_transitions(
    o: Ordered, seeds: DataFrame, end_margin: float = 0.10, min_strength: float = 50.0,
    ambiguous_margin: float = 0.5,
) -> DataFrame:
    """Best gradient transition on each side of the seed, with strength and ambiguity.

    Candidates are local maxima of |gradient| inside runs; they rank by strength in MADs less half
    their distance from the seed edge.
    """
    keys = list(o.keys)
    scale = _column_mad(o.df, keys, ["gradient"], 1e-9)
    span = o.df.groupBy(*keys).agg(F.min("y_mm").alias("_y0"), F.max("y_mm").alias("_y1"))
    o = o.with_columns({"_ag": F.abs("gradient")})
    o = mark_runs(o, F.col("_ag").isNotNull())
    long_run = F.col("run_end") - F.col("run_start") + 1 >= 5
    o = o.rolling(1, 1, lambda w: {"_peak": F.coalesce(
        long_run & (F.col("_ag") >= F.lag("_ag").over(w)) & (F.col("_ag") >= F.lead("_ag").over(w)),
        F.lit(False))}, by=("run_start",))
    peaks = o.where(F.col("_peak")).select(*keys, "y_mm", "_ag")
    cand = attach(attach(peaks, scale, keys), span, keys).filter(
        F.col("y_mm").between(F.col("_y0") + end_margin, F.col("_y1") - end_margin))
    cand = cand.join(seeds.filter("seed_y_min is not null").select(*keys, "seed_y_min", "seed_y_max"), keys)
    y, lo, hi = F.col("y_mm"), F.col("seed_y_min"), F.col("seed_y_max")
    sided = cand.withColumn("side", F.explode(F.array_compact(F.array(
        F.when(y <= lo, F.lit("left")), F.when(y >= hi, F.lit("right"))))))
    away = F.when(F.col("side") == "left", lo - y).otherwise(y - hi)
    z = F.col("_ag") / F.col("gradient_scale")
    ranked = sided.withColumns({"strength_z": z, "score": z - 0.5 * away}).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(F.desc("score"), "y_mm")))
    n = sided.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("n"))
    top = ranked.filter("_rn <= 2").groupBy(*keys, "side").agg(
        F.max(F.when(F.col("_rn") == 1, F.struct("y_mm", "_ag", "strength_z", "score"))).alias("b"),
        F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("second"))
    picked = top.join(n, [*keys, "side"]).select(
        *keys, "side", "n", F.col("b.y_mm").alias("y"), F.col("b._ag").alias("strength"),
        F.col("b.strength_z").alias("strength_z"), (F.col("b.score") - F.col("second")).alias("margin"))
    out = picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
        for s in ("left", "right") for c in ("y", "strength", "strength_z", "n", "margin")])
    table = seeds.select(*keys, "seed_status").join(out, keys, "left")
    for s in ("left", "right"):
        table = table.withColumn(
            f"{s}_status", F.when(F.col(f"{s}_y").isNull(), "no_candidate")
            .when(F.col(f"{s}_strength") >= min_strength, "ok").otherwise("weak")
        ).withColumn(f"{s}_ambiguous", F.coalesce(F.col(f"{s}_margin") < ambiguous_margin, F.lit(False)))
    return table.withColumn(
        "width", F.greatest(F.lit(0.0), F.col("right_y") - F.col("left_y"))
    ).withColumn("width", F.when(F.col("left_y").isNotNull() & F.col("right_y").isNotNull(), F.col("width")))


def substrate_return(
    o: Ordered, seeds: DataFrame, levels: DataFrame, window_mm: float = 0.12, persist_mm: float = 0.10,
    residual_k: float = 2.0, gradient_k: float = 2.0, max_search: float = 1.20, min_samples: int = 5,
) -> DataFrame:
    """First position outward from the seed, on each side, where the profile is substrate again.

    A sample passes when the centred and the outward window are gap-free, flat within k spreads of
    the side's baseline and quiet in gradient. `levels` holds `spread, left_level, right_level`.
    The walk is the nearest passing sample: a maximum on the left, a minimum on the right.
    """
    keys = list(o.keys)
    o = o.with_columns({"abs_gradient": F.abs("gradient")})
    scale = _column_mad(o.df, keys, ["abs_gradient"], 1e-6)
    plain = o.df.drop("abs_gradient_scale", *[c for c in levels.columns if c not in keys])
    rows = attach(attach(plain, scale, keys), levels, keys)
    rows = attach(rows, seeds.filter("seed_status = 'ok'").select(*keys, "seed_y_min", "seed_y_max"), keys, "inner")
    by = f"PARTITION BY {', '.join(keys)} ORDER BY y_mm"

    def frame(back: float, ahead: float) -> str:
        return f"OVER ({by} RANGE BETWEEN {back + 1e-9}D PRECEDING AND {ahead + 1e-9}D FOLLOWING)"

    half = 0.5 * window_mm
    frames = {"c": frame(half, half), "left": frame(persist_mm, 0.0), "right": frame(0.0, persist_mm)}

    def quiet(name: str, side: str) -> Column:
        w = frames[name]
        return F.expr(
            f"count(z_smooth) {w} = count(1) {w}"
            f" AND max(abs(z_smooth - {side}_level)) {w} <= {residual_k} * spread"
            f" AND avg(abs_gradient) {w} <= {gradient_k} * abs_gradient_scale")

    enough = F.expr(f"count(z_smooth) {frames['c']}") >= min_samples
    flagged = rows.withColumns({
        f"_ok_{s}": F.coalesce(enough & quiet("c", s) & quiet(s, s), F.lit(False)) for s in ("left", "right")
    })
    y, lo, hi = F.col("y_mm"), F.col("seed_y_min"), F.col("seed_y_max")
    table = flagged.groupBy(*keys).agg(
        F.max(F.when(F.col("_ok_left") & (y <= lo) & (y >= lo - max_search), y)).alias("left_y"),
        F.min(F.when(F.col("_ok_right") & (y >= hi) & (y <= hi + max_search), y)).alias("right_y"),
        F.min(y).alias("_y0"), F.max(y).alias("_y1"), F.first(lo).alias("_lo"), F.first(hi).alias("_hi"),
        F.sum((y.between(lo, hi) & F.col("z_smooth").isNull()).cast("long")).alias("_gaps"),
    )
    out = seeds.select(*keys, "seed_status").join(table, keys, "left")
    gap = F.coalesce(F.col("_gaps") > 0, F.lit(False))
    usable = (F.col("seed_status") == "ok") & ~gap

    def side_status(found: str, further: Column) -> Column:
        return (
            F.when(~usable, F.lit(None).cast("string")).when(F.col(found).isNotNull(), "ok")
            .when(further, "no_substrate_like_return").otherwise("edge_of_profile"))

    left = F.when(usable, F.col("left_y"))
    right = F.when(usable, F.col("right_y"))
    return out.select(
        *keys,
        F.when(F.col("seed_status") != "ok", F.col("seed_status")).when(gap, "missingness_or_nan_gap")
        .when(left.isNotNull() & right.isNotNull(), "ok").otherwise("partial").alias("status"),
        side_status("left_y", F.col("_y0") < F.col("_lo") - max_search).alias("left_status"),
        side_status("right_y", F.col("_y1") > F.col("_hi") + max_search).alias("right_status"),
        left.alias("left_y"), right.alias("right_y"),
        F.greatest(F.lit(0.0), F.when(left.isNotNull() & right.isNotNull(), right - left)).alias("_w"),
    ).withColumn("width", F.when(F.col("left_y").isNotNull() & F.col("right_y").isNotNull(), F.col("_w"))).drop("_w")


def interval_sensitivity(chosen: DataFrame, keys: list[str], k: str = "threshold_k") -> DataFrame:
    """Spread of the chosen boundaries of a case over thresholds."""
    return chosen.groupBy(*keys).agg(
        F.count_distinct(k).alias("n_thresholds"),
        (F.max("y_min") - F.min("y_min")).alias("left_spread"),
        (F.max("y_max") - F.min("y_max")).alias("right_spread"),
        (F.max("width") - F.min("width")).alias("width_spread"))


def method_intervals(
    seeds: DataFrame, chosen: dict[str, DataFrame], found: dict[str, DataFrame], keys: list[str]
) -> DataFrame:
    """Intervals of all methods side by side, one row per case of `seeds`.

    `chosen`: per method the interval associated with the seed at every threshold (`y_min, y_max`); its row holds the
    medians over thresholds and their number. `found`: per method one row per case (`left_y, right_y`), with `status,
    left_status, right_status` where the rule has one status of its own. Cases without an interval keep nulls; a width
    is the difference of both boundaries, without a floor.
    """
    table = seeds.select(*keys, "seed_status")
    for name, rows in chosen.items():
        mid = rows.groupBy(*keys).agg(
            F.count("y_min").alias(f"{name}_n_thresholds"), F.median("y_min").alias(f"{name}_left"), F.median("y_max").alias(f"{name}_right"))
        table = table.join(mid, keys, "left").withColumn(f"{name}_n_thresholds", F.coalesce(f"{name}_n_thresholds", F.lit(0)))
    for name, rows in found.items():
        more = [F.col("status").alias(f"{name}_status"), F.col("left_status").alias(f"{name}_left_failure"),
                F.col("right_status").alias(f"{name}_right_failure")] if "status" in rows.columns else []
        table = table.join(rows.select(*keys, F.col("left_y").alias(f"{name}_left"), F.col("right_y").alias(f"{name}_right"), *more), keys, "left")
    return table.withColumns({f"{m}_width": F.col(f"{m}_right") - F.col(f"{m}_left") for m in (*chosen, *found)})


def failure_counts(boundaries: DataFrame, left: str = "left_status", right: str = "right_status") -> DataFrame:
    """Profiles per failure category and side; sides that were found, or not looked for, count as `(none)`."""
    category = lambda c: F.when(F.col(c).isNull() | (F.col(c) == "ok"), "(none)").otherwise(F.col(c))
    long = boundaries.select(F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), category(c).alias("failure")) for side, c in (("left", left), ("right", right))
    ])).alias("e")).select("e.*")
    count = lambda side: F.sum((F.col("side") == side).cast("long")).alias(f"{side}_failure_count")
    return long.groupBy("failure").agg(count("left"), count("right"))
