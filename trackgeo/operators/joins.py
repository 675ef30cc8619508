"""Joins on position, interval and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.functions import intervals as iv
from trackgeo.operators.contracts import ContractError
from trackgeo.operators.layout import HOT_ROWS, order_rows
from trackgeo.operators.stats import medians, percentiles


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    x_left: str,
    x_right: str,
    take: list[str],
    left_tie: list[str],
    right_tie: list[str],
    hot_rows: int = HOT_ROWS,
    chunk_rows: int | None = None,
    bounded: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Each left row with the right row of its key nearest in position; ties look back.

    Both sides go through one ordering; the nearest neighbours are the last right row carried
    forward and the next one carried back, so no pair is ever formed. `left_tie` and `right_tie`
    name columns that make the order of equal positions definite.
    """
    payload = [c for c in left.columns if c not in keys]
    l_rows = left.select(
        *keys,
        F.col(x_left).cast("double").alias("_x"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(t).cast("double").alias(f"t{i}") for i, t in enumerate(left_tie)]).alias("_t")
        if len(left_tie) == len(right_tie)
        else F.lit(None).alias("_t"),
        F.struct(*payload).alias("_l"),
    )
    r_rows = right.select(
        *keys,
        F.col(x_right).cast("double").alias("_x"),
        F.lit(0).alias("_side"),
        F.struct(*[F.col(t).cast("double").alias(f"t{i}") for i, t in enumerate(right_tie)]).alias("_t"),
        F.struct(F.col(x_right).cast("double").alias("_rx"), *take).alias("_r"),
    )
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    o = order_rows(both, keys, ["_x", "_side", "_t"], "_ix", hot_rows, chunk_rows, bounded)
    o = o.carry_last({"_b": F.col("_r")}).carry_next({"_f": F.col("_r")})
    b, f, x = F.col("_b"), F.col("_f"), F.col("_x")
    back = f["_rx"].isNull() | (x - b["_rx"] <= f["_rx"] - x)
    pick = F.when(b["_rx"].isNotNull() & back, b).otherwise(f)
    out = o.where(F.col("_side") == 1).select(*keys, "_l.*", pick.alias("_p"))
    return out.select(
        *left.columns,
        *[F.col("_p")[c].alias(f"{prefix}{c}") for c in take],
        F.col("_p")["_rx"].alias(f"{prefix}matched_x"),
    )


def nearest_column(
    anchors: DataFrame,
    columns: DataFrame,
    keys: list[str],
    x_anchor: str,
    x_column: str,
    index: str,
    anchor_tie: list[str],
    **sizes,
) -> DataFrame:
    """Nearest grid column with signed offset; index −1 when the anchor is outside the grid."""
    hit = nearest(
        anchors, columns, keys, x_anchor, x_column, [index], anchor_tie, [index], prefix="_", **sizes
    )
    span = columns.groupBy(*keys).agg(F.min(x_column).alias("_lo"), F.max(x_column).alias("_hi"))
    hit = hit.join(span, keys, "left")
    inside = F.coalesce(F.col(x_anchor).between(F.col("_lo"), F.col("_hi")), F.lit(False))
    return hit.select(
        *anchors.columns,
        inside.alias("is_within_coverage"),
        F.when(inside, F.col(f"_{index}")).otherwise(F.lit(-1)).alias(index),
        F.when(inside, F.col("_matched_x")).alias("used_x"),
        F.when(inside, F.col("_matched_x") - F.col(x_anchor)).alias("x_delta"),
    )


def in_interval(
    points: DataFrame,
    spans: DataFrame,
    keys: list[str],
    point_id: list[str],
    x: str,
    lo: str,
    hi: str,
    label: str,
    priority: str,
    width: float,
    default: Column,
) -> DataFrame:
    """First interval (by `priority`) holding each point, else `default`.

    Intervals are spread over buckets of `width`, so the join is an equality on key and bucket
    with the exact test behind it, and the first match is a partial aggregate.
    """
    buckets = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    spread = spans.select(
        *keys, F.explode(buckets).alias("_b"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
        F.col(label).alias("_label"), F.col(priority).alias("_p"),
    )
    hits = (
        points.select(*keys, *point_id, x)
        .withColumn("_b", F.floor(F.col(x) / width))
        .join(spread, [*keys, "_b"])
        .filter(iv.holds(F.col("_lo"), F.col("_hi"), F.col(x)))
        .groupBy(*keys, *point_id)
        .agg(F.min_by("_label", "_p").alias("_label"))
    )
    return points.join(hits, [*keys, *point_id], "left").withColumn(
        label, F.coalesce("_label", default)
    ).drop("_label")


def band(
    centres: DataFrame, columns: DataFrame, keys: list[str], x_centre: str, x_column: str, half: float
) -> DataFrame:
    """All columns within `half` of each centre, by equality on buckets of the band width."""
    width = 2.0 * half
    low = F.floor((F.col(x_centre) - half) / width)
    high = F.floor((F.col(x_centre) + half) / width)
    spread = centres.withColumn("_b", F.explode(F.sequence(low, high)))
    return (
        columns.withColumn("_b", F.floor(F.col(x_column) / width))
        .join(spread, [*keys, "_b"])
        .filter(F.abs(F.col(x_column) - F.col(x_centre)) <= half)
        .drop("_b")
    )


def merge_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sizes, duplicate keys on both sides, unmatched left keys, unexpected right keys."""
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    nl, nr = F.coalesce("_nl", F.lit(0)), F.coalesce("_nr", F.lit(0))
    return l.join(r, keys, "full").agg(
        F.sum(nl).alias("left_rows"),
        F.sum(nr).alias("right_rows"),
        F.sum((nl > 1).cast("long")).alias("left_duplicate_keys"),
        F.sum((nr > 1).cast("long")).alias("right_duplicate_keys"),
        F.sum(((nl > 0) & (nr == 0)).cast("long")).alias("unmatched_left_keys"),
        F.sum(((nl == 0) & (nr > 0)).cast("long")).alias("unexpected_right_keys"),
        F.sum(nl * F.greatest(nr, F.lit(1))).alias("merged_rows"),
    )


def one_to_one(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    marker: str = "_descriptor_matched",
    require_match: Column | None = None,
    check: bool = True,
) -> DataFrame:
    """Left join that must neither multiply nor lose rows; `marker` tells matched rows.

    `require_match` names the left rows that must find a partner. Violations raise before the
    joined table is returned.
    """
    if check:
        row = merge_report(left, right, keys).first()
        if row["left_duplicate_keys"] or row["right_duplicate_keys"]:
            raise ContractError(f"keys {keys} are not unique: {row.asDict()}")
        if row["unexpected_right_keys"]:
            raise ContractError(f"right rows without a left row: {row.asDict()}")
        if require_match is not None:
            lost = left.filter(require_match).join(right, keys, "left_anti").limit(5)
            examples = [tuple(r[k] for k in keys) for r in lost.select(*keys).collect()]
            if examples:
                raise ContractError(f"left rows without a partner, such as {examples}")
    marked = right.withColumn("_hit", F.lit(True))
    return left.join(marked, keys, "left").withColumn(
        marker, F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def unexpected(right: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """Right rows without a left row."""
    return right.join(left.select(*keys), keys, "left_anti")


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows present in both result sets with suffixed columns and their difference b − a."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, keys).withColumns(
        {f"{c}_delta": F.col(f"{c}_b") - F.col(f"{c}_a") for c in columns}
    )


def positional_alignment(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    order_a: list[str],
    order_b: list[str],
    frame: str,
    x: str,
    tolerance: float = 1e-9,
    **sizes,
) -> DataFrame:
    """Row-by-row comparison of two sorted tables, one summary row per key."""
    oa = order_rows(a.select(*{*keys, *order_a, frame, x}), keys, list(order_a), "_i", **sizes).df
    ob = order_rows(b.select(*{*keys, *order_b, frame, x}), keys, list(order_b), "_i", **sizes).df
    left = oa.select(*keys, "_i", F.col(frame).alias("_fa"), F.col(x).alias("_xa"), F.lit(1).alias("_ina"))
    right = ob.select(*keys, "_i", F.col(frame).alias("_fb"), F.col(x).alias("_xb"), F.lit(1).alias("_inb"))
    both = left.join(right, [*keys, "_i"], "full")
    gap = F.abs(F.col("_xa") - F.col("_xb"))
    return both.groupBy(*keys).agg(
        F.count("_ina").alias("rows_a"),
        F.count("_inb").alias("rows_b"),
        (F.count("_ina") != F.count("_inb")).alias("count_mismatch"),
        F.sum((F.col("_fa") != F.col("_fb")).cast("long")).alias("frame_mismatches"),
        F.max(gap).alias("max_abs_dx"),
        F.sum((gap > tolerance).cast("long")).alias("rows_beyond_tolerance"),
    )


def seed_association(
    candidates: DataFrame, seeds: DataFrame, keys: list[str], candidate_id: str
) -> DataFrame:
    """Candidate chosen for each seed: one holding the seed centroid if any, else the nearest.

    Candidates carry `y_min, y_max, centroid`, seeds `seed_y_min, seed_y_max, seed_centroid`.
    """
    both = seeds.join(candidates, keys, "left")
    inside = F.coalesce(iv.holds(F.col("y_min"), F.col("y_max"), F.col("seed_centroid")), F.lit(False))
    away = F.abs(F.col("centroid") - F.col("seed_centroid"))
    shared = iv.overlap(*[F.col(c) for c in ("y_min", "y_max", "seed_y_min", "seed_y_max")])
    pick = F.min_by(
        F.struct(candidate_id, inside.alias("inside"), away.alias("distance"), shared.alias("overlap")),
        F.when(away.isNotNull(), F.struct(~inside, away, F.col(candidate_id))),
    )
    best = both.groupBy(*keys).agg(pick.alias("b"))
    return best.select(
        *keys,
        F.col(f"b.{candidate_id}").alias(candidate_id),
        F.when(F.col(f"b.{candidate_id}").isNull(), "no_candidates")
        .when(F.col("b.inside"), "contains_seed_centroid")
        .otherwise("nearest_centroid")
        .alias("reason"),
        F.col("b.distance").alias("distance"),
        F.col("b.overlap").alias("overlap"),
    )


def best_iou(
    chosen: DataFrame, families: DataFrame, keys: list[str], family_id: str
) -> DataFrame:
    """Family of the same position with the largest IoU to a chosen interval (`left`, `right`)."""
    score = iv.iou(F.col("left"), F.col("right"), F.col("y_min"), F.col("y_max"))
    both = chosen.join(families.select(*keys, family_id, "y_min", "y_max"), keys, "left")
    return both.groupBy(*keys).agg(
        F.max_by(family_id, F.struct(score, -F.col(family_id))).alias(family_id),
        F.max(score).alias("iou"),
    )


def agreement_with_control(
    control: DataFrame, other: DataFrame, keys: list[str],
    centre_tolerance: float = 0.10, width_tolerance: float = 0.20,
) -> DataFrame:
    """Agreement flags of two extractions at the same requested position.

    Both sides carry `status, left, right, width, centroid`; a null partner counts as invalid.
    """
    names = ["status", "left", "right", "width", "centroid"]
    a = control.select(*keys, *[F.col(n).alias(f"control_{n}") for n in names])
    b = other.select(*keys, *[F.col(n).alias(f"other_{n}") for n in names])
    both = a.join(b, keys, "left").withColumn(
        "other_status", F.coalesce("other_status", F.lit("no_valid_component"))
    )
    was, now = F.col("control_status") == "selected", F.col("other_status") == "selected"
    centre = F.col("other_centroid") - F.col("control_centroid")
    width = F.col("other_width") - F.col("control_width")
    agree = (
        was & now
        & (F.abs(centre) <= centre_tolerance)
        & (F.abs(width) / F.greatest(F.col("control_width"), F.lit(1e-9)) <= width_tolerance)
    )
    return both.withColumns(
        {
            "centre_delta": centre,
            "width_delta": width,
            "spatial_agreement": F.coalesce(agree, F.lit(False)),
            "resolves_invalid": ~was & now,
            "rejects_selected": was & ~now,
        }
    )


def method_agreement(
    intervals: DataFrame, keys: list[str], method: str, pairs: list[tuple[str, str]],
    group: list[str] | None = None, **how,
) -> DataFrame:
    """Boundary differences of named method pairs over the positions valid in both.

    Pairs are listed, so each position joins once per pair and not with itself.
    """
    group = group or []
    spark = intervals.sparkSession
    pair_table = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, method_a string, method_b string"
    )
    ok = intervals.filter(F.col("left").isNotNull() & F.col("right").isNotNull())
    a = ok.select(*keys, F.col(method).alias("method_a"), F.col("left").alias("la"), F.col("right").alias("ra"))
    b = ok.select(*keys, F.col(method).alias("method_b"), F.col("left").alias("lb"), F.col("right").alias("rb"))
    both = a.join(F.broadcast(pair_table), "method_a").join(b, [*keys, "method_b"])
    diffs = both.select(
        *group, "pair",
        F.abs(F.col("la") - F.col("lb")).alias("d_left"),
        F.abs(F.col("ra") - F.col("rb")).alias("d_right"),
        F.abs((F.col("ra") - F.col("la")) - (F.col("rb") - F.col("lb"))).alias("d_width"),
        iv.iou(F.col("la"), F.col("ra"), F.col("lb"), F.col("rb")).alias("iou"),
    )
    by = [*group, "pair"]
    counts = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_both"))
    mid = medians(diffs, by, {"median_left": "d_left", "median_right": "d_right",
                              "median_width": "d_width", "median_iou": "iou"}, **how)
    tail = percentiles(diffs, by, {"p95": "d_width"}, [0.95], **how)
    stats = counts.join(mid, by).join(tail, by).withColumn("p95_width", F.col("p95")[0]).drop("p95")
    frame = pair_table
    if group:
        frame = intervals.select(*group).distinct().withColumn("_one", F.lit(1)).join(
            F.broadcast(pair_table.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return frame.join(stats, by, "left").withColumn("n_both", F.coalesce("n_both", F.lit(0))).drop("pair")
