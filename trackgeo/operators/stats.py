"""Group statistics: exact percentiles, robust spread, summaries, bins, stability tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackgeo.operators.layout import ALL, HOT_ROWS, attach, largest_group, order_rows
from trackgeo.session import durable

MAD_SCALE = 1.4826


def _named(values: dict[str, str] | list[str]) -> dict[str, str]:
    return values if isinstance(values, dict) else {v: v for v in values}


def percentiles(
    df: DataFrame,
    keys: list[str],
    values: dict[str, str] | list[str],
    probs: list[float],
    hot_rows: int = HOT_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Exact linear-interpolated percentiles: one array column (aligned with `probs`) per value.

    `values` maps output name to input column. The built-in aggregate keeps a value map per group
    in one task, so with groups above `hot_rows` the values are written once and counted in place
    (`_percentiles_by_bucket`). `bounded` states that groups cannot outgrow a task and skips the size check.
    """
    named = _named(values)
    if not keys:
        one = percentiles(df.withColumn(ALL, F.lit(1)), [ALL], named, probs, hot_rows, bounded)
        return one.drop(ALL)
    if not bounded:
        df = durable(df.select(*keys, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(named.values())]))
        named = {n: f"_v{i}" for i, n in enumerate(named)}
    if bounded or largest_group(df, keys) <= hot_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*keys).agg(
            *[F.percentile(F.col(c).cast("double"), wanted).alias(n) for n, c in named.items()]
        )
    return _percentiles_by_bucket(df, keys, named, probs, hot_rows)


def _percentiles_by_bucket(
    df: DataFrame, keys: list[str], named: dict[str, str], probs: list[float], hot_rows: int
) -> DataFrame:
    """Percentiles of a written table by `percentiles_in_place`; by rank where one bucket alone is too large.

    Keys are held in a struct, so a key with nulls is a group as any other.
    """
    pairs = ", ".join(f"'{n}', `{c}`" for n, c in named.items())
    values = df.select(F.struct(*keys).alias("_key"), *named.values()).selectExpr("_key", f"stack({len(named)}, {pairs}) as (_name, _v)")
    marked, picks = _marked_and_picks(values, ["_key", "_name"], "_v", probs)
    if not picks.filter(F.col("_size") > hot_rows).isEmpty():
        return _percentiles_by_rank(df, keys, named, probs, hot_rows)
    q = _values_of(marked, picks, ["_key", "_name"], probs)
    wide = q.groupBy("_key").agg(*[F.max(F.when(F.col("_name") == n, F.col("q"))).alias(n) for n in named])
    every = df.select(F.struct(*keys).alias("_key")).distinct()
    return every.join(wide, "_key", "left").select("_key.*", *named)


def _percentiles_by_rank(
    df: DataFrame, keys: list[str], named: dict[str, str], probs: list[float], hot_rows: int
) -> DataFrame:
    """Percentiles from cumulative counts of distinct values, ordered over many partitions."""
    pairs = ", ".join(f"'{n}', cast(`{c}` as double)" for n, c in named.items())
    values = df.selectExpr(*keys, f"stack({len(named)}, {pairs}) as (_name, _value)")
    weights = (
        values.filter("_value is not null").groupBy(*keys, "_name", "_value").count()
    )
    full = [*keys, "_name"]
    o = order_rows(weights, full, ["_value"], "_vx", hot_rows=min(hot_rows, HOT_ROWS))
    o = o.running_sum({"_upto": F.col("count")})
    totals = weights.groupBy(*full).agg(F.sum("count").alias("_n"))
    ranked = attach(o.df, totals, full)
    low, high = F.col("_upto") - F.col("count"), F.col("_upto")

    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (low <= rank) & (rank < high)
            picks.append(F.max(F.when(inside, F.col("_value"))).alias(f"_{side}{i}"))
    picked = ranked.groupBy(*full).agg(F.max("_n").alias("_n"), *picks)

    def interpolate(i: int, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(F.floor(at) == F.ceil(at), lo).otherwise(
            lo * (F.ceil(at) - at) + hi * (at - F.floor(at))
        )

    quantiles = picked.select(
        *full, F.array(*[interpolate(i, p) for i, p in enumerate(probs)]).alias("_q")
    )
    wide = quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in named]
    )
    return df.select(*keys).distinct().join(wide, keys, "left")


#: Buckets per factor of e of a value's size; a bucket holds values within a tenth of a percent of each other.
LOG_BUCKETS = 1024


def log_bucket(value: Column) -> Column:
    """Whole number that never falls as `value` rises, with no look at the data: sign and logarithm of the size."""
    size = F.floor(F.log(F.abs(value)) * LOG_BUCKETS) + F.lit(1 << 20)
    last = F.lit(1 << 40)  # infinities, and NaN as the largest of all
    return F.when(value == 0, F.lit(0).cast("bigint")).when(F.isnan(value), last + 1).when(
        F.abs(value) == float("inf"), F.when(value > 0, last).otherwise(-last)).when(value > 0, size).otherwise(-size)


def rank_buckets(counted: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Buckets that hold the ranks around each probability, from counts `(by, _bucket, _c)`; written out."""
    upto, whole = Window.partitionBy(*by).orderBy("_bucket"), Window.partitionBy(*by)
    summed = counted.withColumns({"_upto": F.sum("_c").over(upto), "_n": F.sum("_c").over(whole)})
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank(_place(p)).alias("rank"))
        for i, p in enumerate(probs) for side, rank in (("low", F.floor), ("high", F.ceil))])).alias("w")
    before = F.col("_upto") - F.col("_c")
    return durable(summed.select("*", wanted).filter((before <= F.col("w.rank")) & (F.col("w.rank") < F.col("_upto"))).select(
        *by, "_bucket", "_n", F.col("_c").alias("_size"), "w.i", "w.side", (F.col("w.rank") - before).alias("_within")))


def _place(p: float) -> Column:
    return F.lit(float(p)) * (F.col("_n") - 1)


def values_at_ranks(values: DataFrame, picks: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Interpolated percentiles as one array `q`, from all values `(by, _bucket, _v)` of the picked buckets."""
    full = [*by, "_bucket"]
    inside = values.groupBy(*full, "_v").agg(F.count("*").alias("_c")).withColumn(
        "_upto", F.sum("_c").over(Window.partitionBy(*full).orderBy("_v")))
    found = inside.join(picks, full).filter(F.col("_within").between(F.col("_upto") - F.col("_c"), F.col("_upto") - 1))
    side = lambda i, name: F.max(F.when((F.col("i") == i) & (F.col("side") == name), F.col("_v")))
    ends = found.groupBy(*by).agg(F.max("_n").alias("_n"), *[
        side(i, name).alias(f"_{name}{i}") for i in range(len(probs)) for name in ("low", "high")])

    def between(i: int, p: float) -> Column:
        at, low, high = _place(p), F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise(low * (F.ceil(at) - at) + high * (at - F.floor(at)))

    return ends.select(*by, F.array(*[between(i, p) for i, p in enumerate(probs)]).alias("q"))


def percentiles_in_place(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact percentiles per key as one array `q`, from two scans and without moving the rows.

    The first scan counts rows by bucket of the value, a few thousand numbers a key, which name the buckets that hold
    the wanted ranks; the second scan brings only the rows of those buckets together. Works alike at every size
    of a key; keys without values are missing.
    """
    return _values_of(*_marked_and_picks(rows, keys, value, probs), keys, probs)


def _marked_and_picks(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> tuple[DataFrame, DataFrame]:
    v = F.col(value)
    marked = rows.filter(v.isNotNull()).select(*keys, v.cast("double").alias("_v")).withColumn("_bucket", log_bucket(F.col("_v")))
    return marked, rank_buckets(marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c")), keys, probs)


def _values_of(marked: DataFrame, picks: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    inside = marked.join(picks.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi")
    return values_at_ranks(inside, picks, keys, probs)


def medians(
    df: DataFrame, keys: list[str], values: dict[str, str] | list[str], **how
) -> DataFrame:
    named = _named(values)
    table = percentiles(df, keys, named, [0.5], **how)
    return table.select(*keys, *[F.col(n)[0].alias(n) for n in named])


def mad(
    df: DataFrame,
    keys: list[str],
    values: dict[str, str] | list[str],
    scale: bool = True,
    **how,
) -> DataFrame:
    """Median absolute deviation from the group median, optionally scaled to a sigma."""
    return median_and_mad(df, keys, values, scale, **how).select(
        *keys, *[F.col(f"{n}_mad").alias(n) for n in _named(values)]
    )


def median_and_mad(
    df: DataFrame,
    keys: list[str],
    values: dict[str, str] | list[str],
    scale: bool = True,
    **how,
) -> DataFrame:
    """`<name>_median` and `<name>_mad` per group."""
    named = _named(values)
    centre = medians(df, keys, {f"{n}_median": c for n, c in named.items()}, **how)
    away = attach(df, centre, keys).select(
        *keys,
        *[F.abs(F.col(c) - F.col(f"{n}_median")).alias(f"{n}_mad") for n, c in named.items()],
    )
    spread = medians(away, keys, [f"{n}_mad" for n in named], **how)
    if scale:
        spread = spread.withColumns({f"{n}_mad": F.col(f"{n}_mad") * MAD_SCALE for n in named})
    return attach(centre, spread, keys)


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "property") -> DataFrame:
    """Long form: one row per key and value column."""
    wide = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    return wide.unpivot(keys, values, name, "value")


def quantile_summary(df: DataFrame, keys: list[str], values: list[str], **how) -> DataFrame:
    """Count, p10..p90, mean, IQR and population deviation per group and property."""
    long = unpivot(df, keys, values).filter("value is not null")
    by = [*keys, "property"]
    probs = [0.10, 0.25, 0.50, 0.75, 0.90]
    q = percentiles(long, by, {"q": "value"}, probs, **how)
    basic = long.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    )
    return basic.join(q, by).select(
        *by,
        "n",
        *[F.col("q")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(probs)],
        "mean",
        (F.col("q")[3] - F.col("q")[1]).alias("iqr"),
        "std",
    )


def count_pivot(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of `column` per `row`, one column per listed value, absent ones 0."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def value_counts(df: DataFrame, column: str, missing: str = "(none)") -> DataFrame:
    """Rows per value including the null bucket."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(
        F.count(F.lit(1)).alias("n")
    )


def coverage(df: DataFrame, key: str, matched: Column, audited: list[str]) -> DataFrame:
    """Row count, matched share and null counts per `key`, plus a total row (`is_total`)."""
    hit = F.coalesce(matched, F.lit(False)).cast("long")
    return (
        df.rollup(key)
        .agg(
            F.grouping(key).cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(hit).alias("n_matched"),
            F.avg(hit.cast("double")).alias("matched_fraction"),
            *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in audited],
        )
    )


def nested_counts(df: DataFrame, key: str, status: str) -> DataFrame:
    """Status counts per key as a map, built from pre-aggregated counts."""
    counts = df.groupBy(key, F.coalesce(F.col(status), F.lit("(none)")).alias("s")).count()
    return counts.groupBy(key).agg(
        F.sum("count").alias("n_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "count")))).alias("by_status"),
    )


def fixed_bins(value: str, edges: list[float]) -> Column:
    """Text label of right-closed bins; the first bin also takes its left edge."""
    label = F.lit(None).cast("string")
    v = F.col(value)
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        above = v >= lo if i == 0 else v > lo
        label = F.when(above & (v <= hi), F.lit(f"{lo:g}-{hi:g}")).otherwise(label)
    return label


def step_bins(
    df: DataFrame, position: str, start: float, stop: float, step: float, aggs: list[Column]
) -> DataFrame:
    """Half-open bins of equal width over [start, stop); empty bins stay with nulls."""
    n = int(round((stop - start) / step))
    bins = df.sparkSession.range(n).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(start) + F.col("id") * step).alias("bin_start"),
        (F.lit(start) + (F.col("id") + 1) * step).alias("bin_stop"),
    )
    inside = df.filter((F.col(position) >= start) & (F.col(position) < stop))
    stats = inside.groupBy(F.floor((F.col(position) - start) / step).cast("int").alias("bin")).agg(
        *aggs
    )
    return bins.join(stats, "bin", "left")


def window_effect(
    df: DataFrame,
    keys: list[str],
    position: str,
    value: str,
    window: tuple[float, float],
    before: tuple[float, float],
    bin_width: float,
    min_count: int = 20,
    min_effect: float = 0.25,
    min_high_bins: int = 3,
    labelled: Column | None = None,
) -> DataFrame:
    """Shift of a window's median against the stretch before it, in units of the series MAD.

    Passes when enough values are finite, the label occurs, the effect is large and enough bins of
    the window lie above the earlier median. All medians come from one pair of scans, the spread from another.
    """
    at, v = F.col(position), F.col(value)
    inside, earlier = at.between(*window), (at >= before[0]) & (at < before[1])
    label = F.coalesce(labelled, F.lit(False)) if labelled is not None else F.lit(True)
    counts = df.groupBy(*keys).agg(
        F.count(F.when(inside, v)).alias("n_window"),
        F.max((inside & label).cast("int")).alias("has_label"),
    )
    # One row per series and part it belongs to: the whole (-3), before (-2), the window (-1) and its bins (0 ..).
    part = lambda when, n: F.when(when, F.lit(n).cast("bigint"))
    bin_of = F.when(inside, F.floor((at - window[0]) / bin_width))
    parts = F.array_compact(F.array(F.lit(-3).cast("bigint"), part(earlier, -2), part(inside, -1), bin_of))
    middles = durable(percentiles_in_place(
        df.select(*keys, v.alias("_value"), F.explode(parts).alias("_part")), [*keys, "_part"], "_value", [0.5]
    ).select(*keys, "_part", F.get("q", F.lit(0)).alias("_m")))
    pick = lambda n: F.max(F.when(F.col("_part") == n, F.col("_m")))
    centres = durable(middles.groupBy(*keys).agg(
        pick(-3).alias("_whole"), pick(-1).alias("window_median"), pick(-2).alias("before_median")))
    away = attach(df, centres.select(*keys, "_whole"), keys).select(*keys, F.abs(v - F.col("_whole")).alias("_away"))
    spread = percentiles_in_place(away, keys, "_away", [0.5]).select(
        *keys, (F.get("q", F.lit(0)) * MAD_SCALE).alias("series_mad"))
    high = (
        attach(middles.filter("_part >= 0"), centres, keys)
        .groupBy(*keys)
        .agg(F.sum((F.col("_m") > F.col("before_median")).cast("int")).alias("high_bins"))
    )
    table = counts.join(centres.drop("_whole"), keys, "left").join(spread, keys, "left").join(high, keys, "left")
    effect = F.when(
        F.col("series_mad") > 0,
        (F.col("window_median") - F.col("before_median")) / F.col("series_mad"),
    )
    table = table.withColumn("effect", effect)
    return table.withColumn(
        "passed",
        (F.col("n_window") >= min_count)
        & (F.col("has_label") == 1)
        & F.coalesce(F.abs("effect") >= min_effect, F.lit(False))
        & (F.coalesce("high_bins", F.lit(0)) >= min_high_bins),
    )


# ------------------------------------------------------------------ sweeps over configurations


def sweep_summary(df: DataFrame, config: str, status: str, width: str, n: str, **how) -> DataFrame:
    """Status counts, median width and candidate counts per configuration."""
    counts = df.groupBy(config).agg(
        *[
            F.sum((F.col(status) == s).cast("long")).alias(f"n_{s}")
            for s in ("selected", "ambiguous", "low_score", "no_valid_component")
        ],
        F.sum(n).alias("total_candidates"),
    )
    widths = df.withColumn("_w", F.when(F.col(status) == "selected", F.col(width)))
    med = medians(widths, [config], {"median_width": "_w", "median_candidates": n}, **how)
    return counts.join(med, config)


def instability(
    df: DataFrame, case: list[str], config: str, status: str, left: str, right: str
) -> DataFrame:
    """Cases whose status or selected boundaries change over the configurations.

    Lists hold one entry per configuration, so they stay as small as the sweep.
    """
    pair = F.when(
        F.col(status) == "selected",
        F.struct(F.round(left, 6).alias("l"), F.round(right, 6).alias("r")),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col(config).alias("c"), F.col(status).alias("s"))))
    table = df.groupBy(*case).agg(
        F.count_distinct(status).alias("n_statuses"),
        F.count_distinct(pair).alias("n_boundaries"),
        F.array_join(F.transform(ordered, lambda e: e["s"]), "|").alias("statuses"),
    )
    return table.filter((F.col("n_statuses") > 1) | (F.col("n_boundaries") > 1))


def outcome_correlation(
    df: DataFrame, case: list[str], parameter: str, outcome: str, selected: Column
) -> DataFrame:
    """Correlation of parameter and outcome over selected rows, from three rows on, and the range."""
    rows = df.filter(selected & F.col(outcome).isNotNull())
    product = F.stddev_pop(parameter) * F.stddev_pop(outcome)
    return rows.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.when((F.count(F.lit(1)) >= 3) & (product > 0), F.covar_pop(parameter, outcome) / product).alias("correlation"),
        (F.max(outcome) - F.min(outcome)).alias("outcome_range"),
    )


def stability(
    df: DataFrame,
    case: list[str],
    config: str,
    control: str,
    status: str,
    left: str,
    right: str,
    centroid: str,
    width: str,
    **how,
) -> DataFrame:
    """Agreement of every case with the control configuration over the whole sweep."""
    chosen = F.col(status) == "selected"
    key = F.when(chosen, F.struct(F.round(left, 6).alias("l"), F.round(right, 6).alias("r")))
    rows = df.withColumns(
        {
            "_key": key,
            "_c": F.when(chosen, F.col(centroid)),
            "_w": F.when(chosen, F.col(width)),
        }
    )
    reference = rows.filter(F.col(config) == control).select(*case, F.col("_key").alias("_ref"))
    both = rows.join(reference, case, "left")
    counts = both.groupBy(*case).agg(
        F.count(F.lit(1)).alias("n_configs"),
        F.avg(chosen.cast("double")).alias("frac_selected_any"),
        F.avg(F.coalesce(F.col("_key") == F.col("_ref"), F.lit(False)).cast("double")).alias(
            "frac_selected_control_exact"
        ),
        F.count_distinct("_key").alias("n_distinct_components"),
        F.max(F.col("_ref").isNotNull()).alias("control_selected"),
    )
    spread = mad(rows, case, {"centroid_mad_mm": "_c", "width_mad_mm": "_w"}, **how)
    return counts.join(spread, case)


def paired_shift(
    reference: DataFrame,
    other: DataFrame,
    keys: list[str],
    group: list[str],
    valid: str,
    columns: list[str],
    **how,
) -> DataFrame:
    """Median and p95 of absolute differences on rows valid in both, with the valid counts."""
    right = other.select(
        *keys, F.col(valid).alias("_valid_o"), *[F.col(c).alias(f"_o_{c}") for c in columns]
    )
    both = reference.join(right, keys)
    ok = F.col(valid) & F.col("_valid_o")
    shifts = both.withColumns(
        {f"_d_{c}": F.when(ok, F.abs(F.col(c) - F.col(f"_o_{c}"))) for c in columns}
    )
    counts = shifts.groupBy(*group).agg(
        F.sum(F.col(valid).cast("long")).alias("n_valid_reference"),
        F.sum(F.col("_valid_o").cast("long")).alias("n_valid_other"),
        F.sum(ok.cast("long")).alias("n_valid_both"),
    )
    q = percentiles(shifts, group, {f"q_{c}": f"_d_{c}" for c in columns}, [0.5, 0.95], **how)
    out = attach(counts, q, group)
    return out.select(
        *group,
        "n_valid_reference",
        "n_valid_other",
        "n_valid_both",
        *[F.col(f"q_{c}")[0].alias(f"median_shift_{c}") for c in columns],
        *[F.col(f"q_{c}")[1].alias(f"p95_shift_{c}") for c in columns],
    )


def centre_band(df: DataFrame, centroid: str, k_mad: float = 3.5, min_width: float = 0.6, **how):
    """One-row band around the pooled median; the central corridor when nothing was found."""
    stats = median_and_mad(df, [], {"c": centroid}, **how)
    half = F.greatest(k_mad * F.col("c_mad"), F.lit(0.5 * min_width))
    return stats.select(
        F.coalesce(F.col("c_median") - half, F.lit(0.65)).alias("band_lo"),
        F.coalesce(F.col("c_median") + half, F.lit(1.35)).alias("band_hi"),
        F.col("c_median").alias("pooled_median"),
        F.col("c_mad").alias("pooled_mad"),
    )


def width_prior(df: DataFrame, width: str, floor: float, fallback: float, **how) -> DataFrame:
    """One-row preferred width and scale from pooled widths."""
    stats = median_and_mad(df, [], {"w": width}, **how)
    return stats.select(
        F.coalesce("w_median", F.lit(fallback)).alias("preferred_width"),
        F.coalesce(F.greatest(F.lit(floor), 2.0 * F.col("w_mad")), F.lit(floor)).alias("width_scale"),
    )


def status_distribution(df: DataFrame, config: str, status: str, columns: list[str], **how):
    """Median and MAD of the selected rows per configuration."""
    chosen = df.filter(F.col(status) == "selected")
    return median_and_mad(chosen, [config], columns, **how)


# ------------------------------------------------------------------ ranks and representatives


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The rank filter is pushed below the shuffle, so at most k rows per task and group move."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).filter(
        F.col("rank_in_group") <= k
    )


def representatives(
    df: DataFrame,
    keys: list[str],
    item: str,
    value: str,
    pools: list[Column],
    targets: dict[str, float],
    min_rows: int = 3,
    **how,
) -> DataFrame:
    """Rows nearest to given quantiles of `value`, each row used once.

    `pools` are ever wider eligibility rules; a group takes the first one that leaves `min_rows`
    rows, else the last. Each pick is one grouped `min_by`; later picks exclude earlier ones.
    """
    sizes = df.groupBy(*keys).agg(
        *[F.sum(F.coalesce(p, F.lit(False)).cast("long")).alias(f"_n{i}") for i, p in enumerate(pools)]
    )
    level = F.lit(len(pools) - 1)
    for i in reversed(range(len(pools) - 1)):
        level = F.when(F.col(f"_n{i}") >= min_rows, F.lit(i)).otherwise(level)
    chosen = F.lit(False)
    for i, p in enumerate(pools):
        chosen = F.when(F.col("_level") == i, F.coalesce(p, F.lit(False))).otherwise(chosen)
    pool = (
        attach(df, sizes.select(*keys, level.alias("_level")), keys)
        .filter(chosen & F.col(value).isNotNull())
        .select(*keys, item, value)
    )
    probs = list(targets.values())
    q = percentiles(pool, keys, {"_q": value}, probs, **how)
    rows = attach(pool, q, keys)
    picks = None
    for i, name in enumerate(targets):
        left = rows if picks is None else rows.join(picks.select(*keys, item), [*keys, item], "left_anti")
        gap = F.abs(F.col(value) - F.col("_q")[i])
        best = left.groupBy(*keys).agg(
            F.min_by(F.struct(item, value), F.struct(gap, F.col(item))).alias("b"),
            F.max(F.col("_q")[i]).alias("target_value"),
        )
        pick = best.select(*keys, F.lit(name).alias("representative"), "b.*", "target_value")
        picks = pick if picks is None else picks.unionByName(pick)
    return picks
