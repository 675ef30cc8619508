"""Frames, tiles and two-dimensional structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgeo.operators import structures as sx
from trackgeo.operators.layout import attach, order_rows
from trackgeo.plans import pipeline as pl
from trackgeo.plans.inputs import FP, TP, frame_pixels, tile_pixels
from trackgeo.plans.q_grid import FLD, fields
from trackgeo.plans.registry import query, rounded, table
from trackgeo.session import durable

FRAME = ["track", "frame_index"]

OTSU = f"""{FP}, sp AS (SELECT track, frame_index, min(temp) AS lo, max(temp) AS hi FROM fp WHERE temp > 0 GROUP BY 1, 2),
hb AS (SELECT track, frame_index, lo, hi, least(255, floor((temp - lo) / (hi - lo) * 256))::INT AS b, count(*) AS n FROM fp JOIN sp USING (track, frame_index) WHERE temp > 0 AND hi > lo GROUP BY ALL),
hc AS (SELECT *, lo + (b + 0.5) * ((hi - lo) / 256) AS c FROM hb),
hu AS (SELECT track, frame_index, b, c, sum(n) OVER f AS w1, sum(n * c) OVER f AS s1, sum(n) OVER w AS n, sum(n * c) OVER w AS s FROM hc
  WINDOW w AS (PARTITION BY track, frame_index), f AS (PARTITION BY track, frame_index ORDER BY b)),
hv AS (SELECT *, w1 * (n - w1) * pow(s1 / w1 - (s - s1) / (n - w1), 2) AS v FROM hu WHERE n > w1),
ot AS (SELECT track, frame_index, coalesce((SELECT c FROM hv WHERE hv.track = sp.track AND hv.frame_index = sp.frame_index ORDER BY round(v, 6) DESC, b LIMIT 1), lo) AS threshold FROM sp)"""


@query("otsu_threshold", f"WITH {OTSU} SELECT track, frame_index, round(threshold, 6) AS threshold FROM ot")
def otsu_threshold(spark, sf):
    return rounded(sx.otsu_thresholds(frame_pixels(spark, sf).filter("temp > 0"), FRAME, "temp"), 6)


@query("frame_statistics", f"""WITH {FP} SELECT track, frame_index, round(max(temp), 6) AS peak_temp, round(avg(temp) FILTER (temp > 0), 6) AS mean_temp,
  round(quantile_cont(temp, 0.995), 6) AS frame_score FROM fp GROUP BY 1, 2""")
def frame_statistics(spark, sf):
    positive = F.when(F.col("temp") > 0, F.col("temp"))
    return rounded(frame_pixels(spark, sf).groupBy(*FRAME).agg(
        F.max("temp").alias("peak_temp"), F.avg(positive).alias("mean_temp"), F.percentile("temp", F.lit(0.995)).alias("frame_score")), 6)


@query("frame_regions", f"""WITH RECURSIVE {OTSU}, hot AS (SELECT track, frame_index, "row" AS y, col AS x FROM fp JOIN ot USING (track, frame_index) WHERE temp > threshold),
re AS (SELECT track, frame_index, x AS ox, y AS oy, x, y FROM hot UNION
  SELECT re.track, re.frame_index, re.ox, re.oy, h.x, h.y FROM re JOIN hot h ON h.track = re.track AND h.frame_index = re.frame_index AND abs(h.x - re.x) <= 1 AND abs(h.y - re.y) <= 1),
lb AS (SELECT track, frame_index, ox, oy, min(x * 1048576::BIGINT + y) AS root FROM re GROUP BY 1, 2, 3, 4)
SELECT track, frame_index, root, count(*) AS n_cells, min(ox) AS x_first, max(ox) AS x_last, min(oy) AS y_first, max(oy) AS y_last FROM lb GROUP BY 1, 2, 3""")
def frame_regions(spark, sf):
    px = frame_pixels(spark, sf)
    limit = sx.otsu_thresholds(px.filter("temp > 0"), FRAME, "temp")
    hot = attach(px, limit, FRAME).filter("temp > threshold").select(*FRAME, F.col("col").alias("x_index"), F.col("row").alias("y_index"))
    lab = sx.label(hot, FRAME)
    # The first cell of a region by (column, row) is the first cell of its smallest run.
    return lab.groupBy(*FRAME, "root").agg(
        F.sum(F.col("y_hi") - F.col("y_lo") + 1).alias("n_cells"), F.min("x_index").alias("x_first"), F.max("x_index").alias("x_last"),
        F.min("y_lo").alias("y_first"), F.max("y_hi").alias("y_last"))


@query("melt_pool_features", f"""WITH RECURSIVE {OTSU}, hot AS (SELECT track, frame_index, "row" AS y, col AS x FROM fp JOIN ot USING (track, frame_index) WHERE temp > threshold),
re AS (SELECT track, frame_index, x AS ox, y AS oy, x, y FROM hot UNION
  SELECT re.track, re.frame_index, re.ox, re.oy, h.x, h.y FROM re JOIN hot h ON h.track = re.track AND h.frame_index = re.frame_index AND abs(h.x - re.x) <= 1 AND abs(h.y - re.y) <= 1),
lb AS (SELECT track, frame_index, ox, oy, min(x * 1048576::BIGINT + y) AS root FROM re GROUP BY 1, 2, 3, 4),
ag AS (SELECT track, frame_index, root, count(*) AS n, avg(ox) AS cx, avg(oy) AS cy, var_pop(ox) AS uxx, var_pop(oy) AS uyy, covar_pop(ox, oy) AS uxy FROM lb GROUP BY 1, 2, 3),
bg AS (SELECT *, row_number() OVER (PARTITION BY track, frame_index ORDER BY n DESC, root) AS k, sqrt(pow(uxx - uyy, 2) + 4 * uxy * uxy) AS d FROM ag),
st AS (SELECT track, frame_index, max(temp) AS pk, avg(temp) FILTER (temp > 0) AS mn, quantile_cont(temp, 0.995) AS fs FROM fp GROUP BY 1, 2)
SELECT track, frame_index, round(pk, 6) AS peak_temp, round(mn, 6) AS mean_temp, round(fs, 6) AS frame_score, round(coalesce(threshold, 1000.0), 6) AS threshold, coalesce(n, 0) AS mp_area_px, round(cx, 6) AS mp_centroid_x, round(cy, 6) AS mp_centroid_y,
  round(coalesce(4 * sqrt(greatest((uxx + uyy + d) / 2, 0)), 0.0), 5) AS mp_length, round(coalesce(4 * sqrt(greatest((uxx + uyy - d) / 2, 0)), 0.0), 5) AS mp_width
FROM st LEFT JOIN ot USING (track, frame_index) LEFT JOIN (SELECT * FROM bg WHERE k = 1) USING (track, frame_index)""")
def melt_pool_features(spark, sf):
    t = pl.thermal_features(frame_pixels(spark, sf), FRAME)
    return rounded(rounded(t, 6, "peak_temp", "mean_temp", "frame_score", "threshold", "mp_centroid_x", "mp_centroid_y"), 5, "mp_length", "mp_width")


TILES = f"""{TP}, th AS (SELECT track, tile_index, max("row") + 1 AS h FROM tp GROUP BY 1, 2), tn AS (SELECT track, count(*) AS n FROM th GROUP BY 1),
tx AS (SELECT track, tile_index, var_pop(intensity) AS v, avg(intensity) AS m FROM tp JOIN th USING (track, tile_index) WHERE "row" < floor(h * 0.3) OR "row" >= h - floor(h * 0.3) GROUP BY 1, 2),
ti AS (SELECT track, tile_index, 100.0::DOUBLE / n AS step, 100.0 - (tile_index - 1) * (100.0::DOUBLE / n) AS hi, v, m FROM th JOIN tn USING (track) LEFT JOIN tx USING (track, tile_index))"""


@query("tile_texture", f"""WITH {TILES} SELECT track, tile_index, round(hi - step, 6) AS x_start_mm, round(hi, 6) AS x_end_mm, round(hi - step / 2, 6) AS x_midpoint_mm,
  round(v, 6) AS substrate_roughness_variance, round(m, 6) AS substrate_mean_intensity FROM ti""")
def tile_texture(spark, sf):
    return rounded(pl.tile_features(tile_pixels(spark, sf), ["track"]), 6)


@query("unified_anchors", f"""WITH {TILES}, a AS (SELECT l_returnflag AS track, l_orderkey * 10 + l_linenumber AS frame_index, l_quantity * 2.0 AS x, row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_returnflag, l_quantity, l_partkey, l_suppkey) AS k FROM lineitem),
a1 AS (SELECT track, frame_index, x FROM a WHERE k = 1),
d AS (SELECT track, frame_index, x, tile_index, hi - step / 2 AS mid, row_number() OVER (PARTITION BY frame_index ORDER BY round(abs(x - (hi - step / 2)), 9), tile_index DESC) AS rn FROM a1 JOIN ti USING (track))
SELECT track, frame_index, x AS x_position_mm, tile_index, round(v, 6) AS substrate_roughness_variance, round(m, 6) AS substrate_mean_intensity FROM d JOIN ti USING (track, tile_index) WHERE rn = 1""")
def unified_anchors(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("track"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_index"),
        (F.col("l_quantity") * 2.0).alias("x_position_mm"), "l_partkey", "l_suppkey")
    first = li.groupBy("frame_index").agg(F.min(F.struct("track", "x_position_mm", "l_partkey", "l_suppkey")).alias("f"))
    anchors = first.select("f.track", "frame_index", "f.x_position_mm")
    tiles = pl.tile_features(tile_pixels(spark, sf), ["track"])
    u = pl.unify(anchors, tiles, ["track"])
    return rounded(u.select("track", "frame_index", "x_position_mm", "tile_index", "substrate_roughness_variance", "substrate_mean_intensity"), 6, "substrate_roughness_variance", "substrate_mean_intensity")


LEVELS = {"signed_positive": [0.5, 1.0], "signed_negative": [0.5, 1.0], "absolute_residual": [1.0], "gradient_activity": [0.5]}


def channel_cells(f):
    """Cells of every channel at every saliency level."""
    items = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(v).alias("level"), F.col(f"{c}_z").alias("z")) for c, vs in LEVELS.items() for v in vs])
    return f.select("track_id", "x_index", "y_index", F.explode(items).alias("e")).select("track_id", "e.*", "x_index", "y_index").filter("z >= level")


CH_SQL = " UNION ALL ".join(
    f"SELECT track_id, '{c}' AS channel, {v}::DOUBLE AS level, x_index AS x, y_index AS y FROM fld WHERE {e} >= {v}"
    for c, e in (("signed_positive", "sr / spread_um"), ("signed_negative", "-sr / spread_um"), ("absolute_residual", "abs(sr) / spread_um"), ("gradient_activity", "gz"))
    for v in LEVELS[c])


@query("structure_cells", f"WITH {FLD}, ch AS ({CH_SQL}) SELECT track_id, channel, level, count(*) AS n_cells, count(DISTINCT x) AS n_columns FROM ch GROUP BY 1, 2, 3")
def structure_cells(spark, sf):
    cells = channel_cells(fields(spark, sf))
    return cells.groupBy("track_id", "channel", "level").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("x_index").alias("n_columns"))


BY = ["track_id", "channel", "level"]


def structure_table(spark, sf, min_cells=5, min_span=0.1):
    f = fields(spark, sf)
    lab = durable(sx.label(channel_cells(f), BY))
    return sx.inventory(lab, f, BY, min_cells, min_span, ["track_id"])


@query("structure_inventory")
def structure_inventory(spark, sf):
    return rounded(structure_table(spark, sf), 6)


@query("structure_overlap")
def structure_overlap(spark, sf):
    """Numbered structures with their best partner of another channel."""
    inv = structure_table(spark, sf)
    o = order_rows(inv, ["track_id"], ["channel", "level", "root"], "structure_no")
    return rounded(sx.best_overlap(durable(o.df), ["track_id"], "channel", "structure_no", 1.0), 6)
