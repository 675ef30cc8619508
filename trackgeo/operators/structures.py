"""Two-dimensional connected structures on grids, without materialising an image anywhere.

Mask cells become vertical runs inside one grid column; runs of neighbouring columns that touch
(diagonals count) are edges; structures are the connected components of that graph. Runs meet inside strips of
`STRIP` columns first, one task each; only the strips' parts that touch across a border are contracted in rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trackgeo.functions import intervals as iv
from trackgeo.functions.scores import contact_label, morphology
from trackgeo.operators.layout import attach, order_rows
from trackgeo.operators.series import runs
from trackgeo.session import durable

ROWS_PER_COLUMN = 1 << 20  # run ids are x · 2^20 + first y; other rows raise
STRIP = 128  # columns of a strip; a column is bounded by the sensor


def vertical_runs(cells: DataFrame, keys: list[str], x: str = "x_index", y: str = "y_index") -> DataFrame:
    """Closed runs `[y_lo, y_hi]` of mask cells in each grid column, with an id per grid."""
    o = order_rows(cells.select(*keys, x, y), [*keys, x], [y], "_i", bounded=True)
    o = o.rolling(1, 0, lambda w: {
        "_new": F.coalesce(F.col(y) - F.lag(y).over(w) > 1, F.lit(True)).cast("int")})
    o = o.running_sum({"_run": F.col("_new")})
    table = o.df.groupBy(*keys, x, "_run").agg(F.min(y).alias("y_lo"), F.max(y).alias("y_hi")).drop("_run")
    fits = F.col("y_lo").between(0, ROWS_PER_COLUMN - 1)
    checked = F.when(fits, F.col("y_lo")).otherwise(F.raise_error(F.lit("y outside 0 .. 2^20 - 1")).cast("long"))
    return table.withColumn("run", F.col(x).cast("long") * ROWS_PER_COLUMN + checked)


def touching(run_table: DataFrame, keys: list[str], x: str = "x_index", node: str = "run") -> DataFrame:
    """Edges between runs of adjacent columns, at most one cell apart in y, between the nodes the runs belong to."""
    right = run_table.select(
        *keys, (F.col(x) - 1).alias(x), F.col(node).alias("v"),
        F.col("y_lo").alias("_lo"), F.col("y_hi").alias("_hi"))
    return run_table.join(right, [*keys, x]).filter(
        (F.col("y_lo") <= F.col("_hi") + 1) & (F.col("_lo") <= F.col("y_hi") + 1)
    ).select(*keys, F.col(node).alias("u"), "v")


def strip_parts(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Smallest run id of the connected part each run belongs to, among the runs of one strip."""
    by = np.lexsort((lo, x))
    span = int(hi.max()) + 3
    first, last = (x[by] - x.min()) * span + lo[by] + 1, (x[by] - x.min()) * span + hi[by] + 1
    # Runs of a column are disjoint, so those that touch a run one column to the left are consecutive.
    start, stop = np.searchsorted(last, first + span - 1), np.searchsorted(first, last + span + 1, "right")
    count = stop - start
    u = np.repeat(np.arange(len(by)), count)
    v = np.repeat(start - np.cumsum(count) + count, count) + np.arange(len(u))
    least = np.arange(len(by))
    while len(u):
        a, b = least[u], least[v]
        apart = a != b
        u, v = u[apart], v[apart]
        np.minimum.at(least, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (least[least] != least).any():
            least = least[least]
    parts = np.empty(len(by), np.int64)
    parts[by] = run[by][least]
    return parts


def _with_parts(run_table: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Runs with the `_part` of their strip; runs without a key or column touch nothing."""
    names = [*keys, x, "y_lo", "y_hi", "run"]
    known = F.forall(F.array(*[F.col(c).isNotNull() for c in (*keys, x)]), lambda e: e)

    def meet(table: pa.Table) -> pa.Table:
        numbers = [table.column(c).to_numpy().astype(np.int64) for c in (x, "y_lo", "y_hi", "run")]
        return table.select(names).append_column("_part", pa.array(strip_parts(*numbers)))

    schema = StructType([*run_table.select(*names).schema.fields, StructField("_part", LongType())])
    strips = run_table.filter(known).select(*names, F.floor(F.col(x) / STRIP).alias("_strip"))
    return strips.groupBy(*keys, "_strip").applyInArrow(meet, schema).unionByName(
        run_table.filter(~known).select(*names, F.col("run").alias("_part")))


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node id of the component for every node that has an edge.

    Alternating star contraction: each node hands its larger neighbours, then all its neighbours,
    to its smallest one. Rounds grow with the logarithm of the longest chain. Each round is a
    grouped minimum and an equi-join, so a hub is split by the adaptive skew join.
    """
    def nearest_min(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def checksum(pairs: DataFrame) -> tuple:
        row = pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    current = durable(edges.filter("u <> v").select(*keys, "u", "v").distinct())
    before = None
    while (now := checksum(current)) != before:
        before = now
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(nearest_min(both), [*keys, "u"]).filter("v > u").select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u > v")
        mins = nearest_min(down)
        small = down.join(mins, [*keys, "u"]).filter("v <> m").select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v"))
        own = mins.select(*keys, "u", F.col("m").alias("v"))
        current = durable(small.unionByName(own).filter("u <> v").distinct())
    return current.select(*keys, F.col("u").alias("run"), F.col("v").alias("root"))


def label(cells: DataFrame, keys: list[str], x: str = "x_index", y: str = "y_index") -> DataFrame:
    """Runs with the `root` of their 8-connected structure."""
    table = durable(_with_parts(vertical_runs(cells, keys, x, y), keys, x))
    at = F.pmod(F.col(x), F.lit(STRIP))
    border = table.filter((at == 0) | (at == STRIP - 1))
    roots = connected(touching(border, keys, x, "_part"), keys).withColumnRenamed("run", "_part")
    return table.join(roots, [*keys, "_part"], "left").select(
        *keys, x, "y_lo", "y_hi", "run", F.coalesce("root", "_part").alias("root"))


def largest_region(
    labelled: DataFrame, keys: list[str], x: str = "x_index"
) -> DataFrame:
    """Area, centroid and axis lengths of the largest structure per grid, from exact run sums.

    Axes are 4·sqrt of the eigenvalues of the second central moments of the cell centres.
    Coordinates: x is the column, y the row.
    """
    # Cells count from the first cell of their structure, so all sums are small whole numbers.
    n = F.col("y_hi").cast("long") - F.col("y_lo") + 1
    c = F.col(x).cast("long") - F.shiftright("root", 20)
    a, b = (F.col(e).cast("long") - F.col("root").bitwiseAND(ROWS_PER_COLUMN - 1) for e in ("y_lo", "y_hi"))
    sy = F.shiftright(n * (a + b), 1)  # n or a + b is even
    syy = F.round((b * (b + 1) * (2 * b + 1) - (a - 1) * a * (2 * a - 1)) / 6).cast("long")
    sums = labelled.groupBy(*keys, "root").agg(
        F.sum(n).alias("n"), F.sum(n * c).alias("sx"), F.sum(sy).alias("sy"),
        F.sum(n * c * c).alias("sxx"), F.sum(syy).alias("syy"), F.sum(sy * c).alias("sxy"))
    best = sums.groupBy(*keys).agg(
        F.max_by(F.struct("root", "n", "sx", "sy", "sxx", "syy", "sxy"), F.struct("n", -F.col("root"))).alias("b"))
    m = best.select(*keys, "b.*")
    size = F.col("n").cast("double")

    def centred(square: str, one: str, other: str) -> Column:
        """n² times a central moment as a whole number: exact, so a line has no width at all."""
        whole = lambda p, q: F.col(p).cast("decimal(19,0)") * F.col(q).cast("decimal(19,0)")
        return (whole("n", square) - whole(one, other)).cast("double") / (size * size)

    uxx, uyy, uxy = centred("sxx", "sx", "sx"), centred("syy", "sy", "sy"), centred("sxy", "sx", "sy")
    larger = (uxx + uyy + F.sqrt(F.pow(uxx - uyy, 2) + 4 * uxy * uxy)) / 2
    smaller = F.when(larger > 0, F.greatest(uxx * uyy - uxy * uxy, F.lit(0.0)) / larger).otherwise(0.0)
    return m.select(
        *keys, F.col("n").alias("area"), (F.shiftright("root", 20) + F.col("sx") / size).alias("centroid_x"),
        (F.col("root").bitwiseAND(ROWS_PER_COLUMN - 1) + F.col("sy") / size).alias("centroid_y"),
        (4 * F.sqrt(larger)).alias("major_axis"), (4 * F.sqrt(smaller)).alias("minor_axis"))


def otsu_thresholds(values: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Threshold of the split with the largest between-class variance of a per-group histogram.

    Bins split [min, max] evenly, the last one closed; the threshold is the centre of the best
    bin. Groups with one distinct value return it.
    """
    v = F.col(value)
    span = values.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
    counts = attach(values.filter(v.isNotNull()), span, keys).filter("_hi > _lo").groupBy(
        *keys, "_lo", "_hi", at.cast("int").alias("_bin")).count()
    # At most `bins` rows per group from here on.
    centre = F.col("_lo") + (F.col("_bin") + 0.5) * step
    o = order_rows(counts.withColumns({"_c": centre, "_w": F.col("count") * centre}), keys, ["_bin"], "_i", bounded=True)
    o = o.running_sum({"w1": F.col("count"), "s1": F.col("_w")})
    total = counts.groupBy(*keys).agg(F.sum("count").alias("n"), F.sum(F.col("count") * centre).alias("s"))
    t = attach(o.df, total, keys)
    w2, s2 = F.col("n") - F.col("w1"), F.col("s") - F.col("s1")
    gap = F.col("s1") / F.col("w1") - s2 / w2
    var = F.when(w2 > 0, F.col("w1") * w2 * gap * gap)
    best = t.groupBy(*keys).agg(
        F.max_by("_c", F.when(var.isNotNull(), F.struct(var, -F.col("_bin")))).alias("_t"))
    return span.join(best, keys, "left").select(*keys, F.coalesce("_t", "_lo").alias("threshold"))


# ------------------------------------------------------------------ attributes of structures


def gap_counts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts of finite and missing samples up each grid column."""
    o = order_rows(points.select(*keys, "x_index", "y_index", "z_mm"), [*keys, "x_index"], ["y_index"], "_i", bounded=True)
    o = o.running_sum({
        "finite_upto": F.col("z_mm").isNotNull().cast("long"),
        "missing_upto": F.col("z_mm").isNull().cast("long")})
    return o.df.select(*keys, "x_index", "y_index", "finite_upto", "missing_upto")


def _upto(rows: DataFrame, counts: DataFrame, keys: list[str], x: Column, y: Column, column: str, out: str) -> DataFrame:
    """Value of a running count at (x, y); zero below the first row of the grid."""
    at = counts.select(*keys, F.col("x_index").alias("_x"), F.col("y_index").alias("_y"), F.col(column).alias(out))
    return rows.withColumns({"_x": x, "_y": y}).join(at, [*keys, "_x", "_y"], "left").drop("_x", "_y").withColumn(
        out, F.coalesce(out, F.lit(0)))


def inventory(
    labelled: DataFrame, points: DataFrame, keys: list[str], min_cells: int = 150, min_x_span: float = 0.20,
    grid_keys: list[str] | None = None,
) -> DataFrame:
    """Extents, support, gap contact and shape words of the structures that are large enough.

    `keys` may hold more than the grid (channel, level); `grid_keys` are those of `points`.
    """
    grid = grid_keys or keys
    by = [*keys, "root"]
    n = F.col("y_hi") - F.col("y_lo") + 1
    box = labelled.groupBy(*by).agg(
        F.sum(n).alias("pixel_count"),
        F.min("x_index").alias("x0"), F.max("x_index").alias("x1"),
        F.min("y_lo").alias("y0"), F.max("y_hi").alias("y1")).filter(F.col("pixel_count") >= min_cells)
    xs = points.groupBy(*grid, "x_index").agg(F.min("x_mm").alias("x_mm"))
    ys = points.groupBy(*grid, "y_index").agg(F.min("y_mm").alias("y_mm"))
    edge = points.groupBy(*grid).agg(
        *[f(c).alias(f"_{n_}") for n_, f, c in (("gx0", F.min, "x_index"), ("gx1", F.max, "x_index"),
                                                  ("gy0", F.min, "y_index"), ("gy1", F.max, "y_index"))])

    def place(df: DataFrame, axis: DataFrame, index: str, at: str, mm: str, out: str) -> DataFrame:
        named = axis.select(*grid, F.col(index).alias(at), F.col(mm).alias(out))
        return df.join(named, [*grid, at], "left")

    for at, out in (("x0", "_xa"), ("x1", "_xb")):
        box = place(box, xs, "x_index", at, "x_mm", out)
    for at, out in (("y0", "y_min"), ("y1", "y_max")):
        box = place(box, ys, "y_index", at, "y_mm", out)
    box = box.withColumns({"x_min": F.least("_xa", "_xb"), "x_max": F.greatest("_xa", "_xb")}).drop("_xa", "_xb")
    # Boxes, their runs and the running counts are each read by several joins below.
    box = durable(box.filter(F.col("x_max") - F.col("x_min") >= min_x_span))
    kept = durable(labelled.join(box.select(*by), by, "left_semi"))
    # Median y from cell counts per y: the value map is as long as a sensor column at most.
    per_y = kept.withColumn("y_index", F.explode(F.sequence("y_lo", "y_hi"))).groupBy(*by, "y_index").count()
    mid = per_y.join(ys, [*grid, "y_index"]).groupBy(*by).agg(
        F.percentile("y_mm", F.lit(0.5), F.col("count")).alias("median_y"))
    columns = kept.select(*by, "x_index").distinct()
    starts = columns.join(columns.withColumn("x_index", F.col("x_index") + 1), [*by, "x_index"], "left_anti")
    support = columns.groupBy(*by).agg(F.count(F.lit(1)).alias("n_columns")).join(
        starts.groupBy(*by).agg(F.count(F.lit(1)).alias("fragmentation_count")), by)

    counts = durable(gap_counts(points, grid))
    wide = box.select(*by, "x0", "x1", "y0", "y1").withColumn("x_index", F.explode(F.sequence("x0", "x1")))
    wide = _upto(wide, counts, grid, F.col("x_index"), F.col("y1"), "finite_upto", "_fb")
    wide = _upto(wide, counts, grid, F.col("x_index"), F.col("y0") - 1, "finite_upto", "_fa")
    finite = wide.groupBy(*by).agg(F.sum(F.col("_fb") - F.col("_fa")).alias("box_finite"))

    edged = attach(kept, edge, grid)
    ring = edged.withColumn("_nx", F.explode(F.sequence(F.col("x_index") - 1, F.col("x_index") + 1))).withColumns({
        "_top": F.least(F.col("y_hi") + 1, F.col("_gy1")), "_below": F.col("y_lo") - 2})
    ring = ring.select(*by, "_nx", "_top", "_below")
    ring = _upto(ring, counts, grid, F.col("_nx"), F.col("_top"), "missing_upto", "_mb")
    ring = _upto(ring, counts, grid, F.col("_nx"), F.col("_below"), "missing_upto", "_ma")
    contact = ring.groupBy(*by).agg(F.max((F.col("_mb") > F.col("_ma")).cast("int")).alias("_tm"))
    at_edge = edged.groupBy(*by).agg(F.max((
        (F.col("x_index") == F.col("_gx0")) | (F.col("x_index") == F.col("_gx1"))
        | (F.col("y_lo") == F.col("_gy0")) | (F.col("y_hi") == F.col("_gy1"))).cast("int")).alias("_te"))

    mid, support, finite, contact, at_edge = [durable(part) for part in (mid, support, finite, contact, at_edge)]
    t = box.join(mid, by).join(support, by).join(finite, by).join(contact, by).join(at_edge, by)
    label_text = contact_label(F.col("_tm") == 1, F.col("_te") == 1)
    x_span, y_span = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    return t.select(
        *by, "x_min", "x_max", x_span.alias("x_span"),
        (F.col("n_columns") / (F.col("x1") - F.col("x0") + 1)).alias("x_support_fraction"),
        "y_min", "y_max", "median_y", "fragmentation_count",
        (F.col("pixel_count") / F.greatest(F.lit(1), F.col("box_finite"))).alias("finite_support_fraction"),
        (F.col("_tm") == 1).alias("touches_missing"), (F.col("_te") == 1).alias("touches_edge"),
        label_text.alias("nan_contact_summary"),
        morphology(x_span, y_span, F.col("fragmentation_count"), label_text).alias("morphology"),
        "pixel_count")


def best_overlap(
    structures: DataFrame, keys: list[str], channel: str, order: str, bucket: float
) -> DataFrame:
    """For each structure the one of another channel that shares most of its extent.

    Score: shared x over the longer span plus the product of the x and y IoU; ties and structures
    without any overlap take the first of another channel by `order`. Overlapping pairs meet in
    buckets of x, each pair in one bucket only.
    """
    s = structures.select(*keys, channel, order, "x_min", "x_max", "y_min", "y_max")
    lo, hi = F.floor(F.col("x_min") / bucket), F.floor(F.col("x_max") / bucket)
    spread = s.withColumn("_b0", lo).withColumn("_b", F.explode(F.sequence(lo, hi)))
    other = spread.select(*keys, "_b", *[F.col(c).alias(f"o_{c}") for c in (channel, order, "x_min", "x_max", "y_min", "y_max", "_b0")])
    c = F.col
    xs, xe = F.greatest("x_min", "o_x_min"), F.least("x_max", "o_x_max")
    pairs = spread.join(other, [*keys, "_b"]).filter(
        (c(channel) != c(f"o_{channel}")) & (c("_b") == F.greatest("_b0", "o__b0")) & (xe > xs))
    x = [c("x_min"), c("x_max"), c("o_x_min"), c("o_x_max")]
    y = [c("y_min"), c("y_max"), c("o_y_min"), c("o_y_max")]
    longest = F.greatest(c("x_max") - c("x_min"), c("o_x_max") - c("o_x_min"), F.lit(1e-9))
    shared, box = iv.overlap(*x) / longest, iv.iou(*x) * iv.iou(*y)
    found = pairs.groupBy(*keys, order).agg(F.max_by(
        F.struct(c(f"o_{order}").alias("other"), c(f"o_{channel}").alias("other_channel"),
                 shared.alias("shared_x"), iv.overlap(*x).alias("x_overlap"),
                 iv.overlap(*y).alias("y_overlap"), box.alias("box_iou")),
        F.struct(shared + box, -c(f"o_{order}"))).alias("p"))
    # Without any x overlap every score is 0: the first structure of another channel.
    heads = s.groupBy(*keys, channel).agg(F.min(F.struct(order, "y_min", "y_max")).alias("_h"))
    ranked = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        c(f"_h.{order}").alias("_ho"), c(channel).alias("_hc"), c("_h.y_min").alias("_hl"), c("_h.y_max").alias("_hu")
    ))).alias("_heads"))
    t = attach(s.join(found, [*keys, order], "left"), ranked, keys)
    fallback = F.filter("_heads", lambda e: e["_hc"] != c(channel))
    first = F.try_element_at(fallback, F.lit(1))
    zero = F.when(first.isNotNull(), F.lit(0.0))
    return t.select(
        *keys, order, channel,
        F.coalesce(c("p.other"), first["_ho"]).alias("other"),
        F.coalesce(c("p.other_channel"), first["_hc"]).alias("other_channel"),
        F.coalesce(c("p.shared_x"), zero).alias("shared_x"),
        F.coalesce(c("p.x_overlap"), zero).alias("x_overlap"),
        F.coalesce(
            c("p.y_overlap"),
            F.when(first.isNotNull(), iv.overlap(c("y_min"), c("y_max"), first["_hl"], first["_hu"])),
        ).alias("y_overlap"),
        F.coalesce(c("p.box_iou"), zero).alias("box_iou"))
