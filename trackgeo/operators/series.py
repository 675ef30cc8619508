"""Operators along one series: runs, windows, smoothing, gradients, filling, peaks, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgeo.operators.layout import Ordered, attach, order_rows
from trackgeo.operators.stats import mad, percentiles


def mark_runs(o: Ordered, mask: Column, start: str = "run_start", end: str = "run_end") -> Ordered:
    """First and last index of the true run each row lies in; null where `mask` is not true."""
    o = o.with_columns({"_m": F.coalesce(mask, F.lit(False))})
    o = o.rolling(
        1,
        1,
        lambda w: {
            "_first": F.col("_m") & ~F.lag("_m", 1, False).over(w),
            "_last": F.col("_m") & ~F.lead("_m", 1, False).over(w),
        },
    )
    at = F.col(o.index)
    o = o.carry_last({start: F.when(F.col("_first"), at)})
    o = o.carry_next({end: F.when(F.col("_last"), at)})
    inside = F.col("_m")
    o = o.with_columns(
        {start: F.when(inside, F.col(start)), end: F.when(inside, F.col(end))}
    )
    return o.with_df(o.df.drop("_m", "_first", "_last"))


def runs(o: Ordered, mask: Column) -> DataFrame:
    """Maximal true runs as half-open `[run_start, run_stop)` with their length."""
    marked = mark_runs(o, mask)
    return marked.where(F.col(marked.index) == F.col("run_start")).select(
        *o.keys,
        "run_start",
        (F.col("run_end") + 1).alias("run_stop"),
        (F.col("run_end") + 1 - F.col("run_start")).alias("run_length"),
    )


def longest_run(run_table: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run per series; the first one wins a tie."""
    best = F.max_by(
        F.struct("run_start", "run_stop", "run_length"),
        F.struct(F.col("run_length"), -F.col("run_start")),
    )
    return run_table.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def run_count(run_table: DataFrame, keys: list[str]) -> DataFrame:
    return run_table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"))


def sliding_windows(
    o: Ordered, n: int, features: list[str], meta: list[str], name: str = "window"
) -> DataFrame:
    """Full windows of `n` consecutive rows, time-major, with the metadata of the last row."""
    row = F.array(*[F.col(c).cast("double") for c in features])
    rolled = o.rolling(
        n - 1, 0, lambda w: {name: F.collect_list(row).over(w.rowsBetween(-(n - 1), 0))}
    )
    return rolled.where(F.col(o.index) >= n - 1).select(*meta, name)


def flatten_window(df: DataFrame, window: str = "window", out: str = "features") -> DataFrame:
    return df.withColumn(out, F.flatten(window))


def window_feature_names(n: int, features: list[str]) -> list[str]:
    """Names of the flattened vector, in the order of `flatten_window`."""
    return [f"t{t}_{f}" for t in range(n) for f in features]


def smooth_in_runs(
    o: Ordered, value: str, window: int, min_run: int = 1, out: str = "smooth"
) -> Ordered:
    """Moving average inside runs of present values, run ends repeated beyond the edges.

    Expects `run_start`/`run_end` from `mark_runs`. An even window is widened by one.
    """
    width = window if window >= 3 and window % 2 == 1 else max(3, window + 1)
    half = width // 2
    i, a, b = F.col(o.index), F.col("run_start"), F.col("run_end")
    missing_left = F.greatest(F.lit(0), half - (i - a))
    missing_right = F.greatest(F.lit(0), half - (b - i))

    def build(w):
        whole = w.rowsBetween(-half, half)
        mean = (
            F.sum(value).over(whole)
            + missing_left * F.first(value).over(whole)
            + missing_right * F.last(value).over(whole)
        ) / width
        keep = (b - a + 1) < min_run
        return {out: F.when(a.isNull(), None).when(keep, F.col(value)).otherwise(mean)}

    return o.rolling(half, half, build, by=("run_start",))


def gradient_in_runs(
    o: Ordered, value: str, position: str, min_run: int = 2, out: str = "gradient"
) -> Ordered:
    """Derivative inside runs: three-point weights inside, one-sided at run ends."""
    a, b, z, y = F.col("run_start"), F.col("run_end"), F.col(value), F.col(position)

    def build(w):
        zp, zn = F.lag(value).over(w), F.lead(value).over(w)
        hp, hn = y - F.lag(position).over(w), F.lead(position).over(w) - y
        inner = (hp * hp * zn + (hn * hn - hp * hp) * z - hn * hn * zp) / (hp * hn * (hp + hn))
        grad = F.when(zp.isNull(), (zn - z) / hn).when(zn.isNull(), (z - zp) / hp).otherwise(inner)
        return {out: F.when(a.isNotNull() & (b - a + 1 >= min_run), grad)}

    return o.rolling(1, 1, build, by=("run_start",))


def interpolate_linear(o: Ordered, value: str, out: str) -> Ordered:
    """Fill gaps on the line between neighbours by row; ends take the nearest value."""
    known = F.when(
        F.col(value).isNotNull(),
        F.struct(F.col(o.index).alias("i"), F.col(value).cast("double").alias("v")),
    )
    o = o.carry_last({"_p": known}).carry_next({"_n": known})
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (F.col(o.index) - p["i"]) / (n["i"] - p["i"])
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(p.isNull(), n["v"])
        .when(n.isNull(), p["v"])
        .otherwise(line)
    )
    o = o.with_columns({out: filled})
    return o.with_df(o.df.drop("_p", "_n"))


def rolling_mean(o: Ordered, value: str, rows: int, out: str) -> Ordered:
    """Centred mean over the rows that exist."""
    half = rows // 2
    return o.rolling(
        half, half, lambda w: {out: F.avg(value).over(w.rowsBetween(-half, half))}
    )


def fill_forward_backward(o: Ordered, value: str, out: str) -> Ordered:
    o = o.carry_last({"_f": F.col(value)}).carry_next({"_b": F.col(value)})
    o = o.with_columns({out: F.coalesce("_f", "_b")})
    return o.with_df(o.df.drop("_f", "_b"))


def smoothed_target(o: Ordered, value: str, out: str, rows: int = 11) -> Ordered:
    """Interpolate, take the centred mean, fill what is left; per series."""
    o = interpolate_linear(o, value, "_lin")
    o = rolling_mean(o, "_lin", rows, "_mean")
    o = fill_forward_backward(o, "_mean", out)
    return o.with_df(o.df.drop("_lin", "_mean"))


def ranks(df: DataFrame, keys: list[str], value: str, tie: list[str], **sizes) -> DataFrame:
    """`rank_of` (from 1, ties by `tie`) and `rank_fraction` = (rank − 1)/(n − 1)."""
    o = order_rows(df.filter(F.col(value).isNotNull()), keys, [value, *tie], "_r", **sizes)
    o = o.with_length("_n")
    return o.df.select(
        *[c for c in df.columns],
        (F.col("_r") + 1).alias("rank_of"),
        F.when(F.col("_n") > 1, F.col("_r") / (F.col("_n") - 1))
        .otherwise(F.lit(0.0))
        .alias("rank_fraction"),
    )


def differences(o: Ordered, value: str) -> Ordered:
    """First and second difference to the previous rows."""

    def build(w):
        first = F.col(value) - F.lag(value, 1).over(w)
        second = F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
        return {"diff1": first, "diff2": second}

    return o.rolling(2, 0, build)


def local_maxima(
    o: Ordered, value: str, min_run: int = 5, threshold: Column | None = None
) -> DataFrame:
    """Rows inside a run (not at its ends) that are not below either neighbour."""
    o = mark_runs(o, F.col(value).isNotNull())
    inside = F.col("run_end") - F.col("run_start") + 1 >= min_run

    def build(w):
        prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
        return {"_peak": inside & (F.col(value) >= prev) & (F.col(value) >= nxt)}

    peaks = o.rolling(1, 1, build, by=("run_start",)).where(F.coalesce("_peak", F.lit(False)))
    if threshold is not None:
        peaks = peaks.filter(F.col(value) > threshold)
    return peaks.drop("_peak")


def best_with_runner_up(
    df: DataFrame,
    keys: list[str],
    score: str,
    tie: list[str],
    min_score: float,
    ambiguity_ratio: float,
) -> DataFrame:
    """Best row per case with the runner-up ratio and a status word.

    The rank filter lets Spark keep two rows per case before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    two = df.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    others = [c for c in df.columns if c not in keys]
    picked = two.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rn") == 1, F.col(c))).alias(c) for c in others],
        F.max(F.when(F.col("_rn") == 2, F.col(score))).alias("runner_up_score"),
    )
    return picked.withColumn(
        "ambiguity", ambiguity(F.col(score), F.col("runner_up_score"))
    ).withColumn("status", selection_status(F.col(score), F.col("ambiguity"), min_score, ambiguity_ratio))


def ambiguity(best: Column, second: Column) -> Column:
    return F.when(second.isNotNull() & (best > 0), second / best).otherwise(F.lit(0.0))


def selection_status(
    best: Column, ratio: Column, min_score: float | Column, ambiguity_ratio: float | Column
) -> Column:
    return (
        F.when(best.isNull(), "no_valid_component")
        .when(best < min_score, "low_score")
        .when(ratio >= ambiguity_ratio, "ambiguous")
        .otherwise("selected")
    )


def cumulative_explained(
    components: DataFrame, targets: list[float], ratio: str = "explained_ratio"
) -> tuple[DataFrame, DataFrame]:
    """Cumulative ratio per component, and the first component reaching each target."""
    table = components.withColumn(
        "cumulative_ratio", F.sum(ratio).over(Window.orderBy("component"))
    )
    reach = table.agg(
        *[
            F.min(F.when(F.col("cumulative_ratio") >= t, F.col("component"))).alias(f"k{i}")
            for i, t in enumerate(targets)
        ]
    )
    pairs = ", ".join(f"double({t}), k{i}" for i, t in enumerate(targets))
    return table, reach.selectExpr(f"stack({len(targets)}, {pairs}) as (target, n_components)")


def active_interval(
    o: Ordered,
    score: str,
    keep_rows: int = 400,
    range_share: float = 0.20,
    mad_factor: float = 8.0,
) -> DataFrame:
    """Longest stretch above the idle level of each series and its last `keep_rows` rows.

    Idle level: the first max(5, n/10) rows; threshold: the larger of min + share·range and
    idle median + factor·MAD.
    """
    keys = list(o.keys)
    sized = o.with_length("_n")
    idle = sized.where(F.col(o.index) < F.greatest(F.lit(5), F.floor(F.col("_n") / 10)))
    centre = percentiles(idle, keys, {"idle_median": score}, [0.5])
    centre = centre.select(*keys, F.col("idle_median")[0].alias("idle_median"))
    spread = mad(idle, keys, {"idle_mad": score}, scale=True)
    span = o.df.groupBy(*keys).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    limits = span.join(centre, keys).join(spread, keys)
    limits = limits.select(
        *keys,
        F.greatest(
            F.col("lo") + range_share * (F.col("hi") - F.col("lo")),
            F.col("idle_median") + mad_factor * F.greatest(F.col("idle_mad"), F.lit(1e-12)),
        ).alias("active_threshold"),
    )
    marked = o.with_df(attach(o.df, limits, keys))
    found = longest_run(runs(marked, F.col(score) > F.col("active_threshold")), keys)
    return found.join(limits, keys).select(
        *keys,
        "active_threshold",
        F.col("run_start").alias("on_index"),
        F.col("run_stop").alias("off_index"),
        F.greatest(F.lit(0), F.col("run_stop") - keep_rows).alias("first_kept"),
    )
