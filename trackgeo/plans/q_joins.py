"""Joins on position, interval and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgeo.functions import intervals as iv
from trackgeo.operators import joins as jn
from trackgeo.plans.inputs import EV, event_series
from trackgeo.plans.registry import query, r, rounded, table


@query("nearest_asof", f"""WITH {EV}, u AS (
  SELECT user_id, t, event_id, 1 AS side, NULL::BIGINT AS rid, NULL::DOUBLE AS rt FROM ev WHERE event_type = 'click' UNION ALL
  SELECT user_id, t, event_id, 0, event_id, t FROM ev WHERE event_type = 'view'),
n AS (SELECT *, last_value(rt IGNORE NULLS) OVER b AS bt, last_value(rid IGNORE NULLS) OVER b AS bid,
       first_value(rt IGNORE NULLS) OVER a AS ft, first_value(rid IGNORE NULLS) OVER a AS fid FROM u
  WINDOW b AS (PARTITION BY user_id ORDER BY t, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY user_id ORDER BY t, side, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN bid ELSE fid END AS view_id,
  round(3600 * abs(t - CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN bt ELSE ft END), 6) AS gap_seconds FROM n WHERE side = 1""")
def nearest_asof(spark, sf):
    ev = event_series(spark, sf)
    clicks = ev.filter("event_type = 'click'").select("user_id", "event_id", "t")
    views = ev.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("t").alias("vt"))
    out = jn.nearest(clicks, views, ["user_id"], "t", "vt", ["view_id"], ["event_id"], ["view_id"])
    return out.select("user_id", "event_id", "view_id", r(3600 * F.abs(F.col("t") - F.col("matched_x"))).alias("gap_seconds"))


@query("nearest_column", f"""WITH {EV}, a AS (SELECT event_type, event_id, t FROM ev WHERE value > 100.0),
c AS (SELECT event_type, floor(t / 6.0) AS x_index, min(t) AS x_mm FROM ev WHERE value <= 20.0 GROUP BY ALL),
s AS (SELECT event_type, min(x_mm) AS lo, max(x_mm) AS hi FROM c GROUP BY 1),
u AS (SELECT event_type, t AS x, event_id, 1 AS side, NULL::DOUBLE AS ci, NULL::DOUBLE AS cx FROM a UNION ALL
      SELECT event_type, x_mm, x_index::BIGINT, 0, x_index, x_mm FROM c),
n AS (SELECT *, last_value(cx IGNORE NULLS) OVER b AS bx, last_value(ci IGNORE NULLS) OVER b AS bi,
       first_value(cx IGNORE NULLS) OVER f AS fx, first_value(ci IGNORE NULLS) OVER f AS fi FROM u
  WINDOW b AS (PARTITION BY event_type ORDER BY x, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY event_type ORDER BY x, side, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (SELECT event_type, event_id, x, CASE WHEN bx IS NOT NULL AND (fx IS NULL OR x - bx <= fx - x) THEN bi ELSE fi END AS i,
       CASE WHEN bx IS NOT NULL AND (fx IS NULL OR x - bx <= fx - x) THEN bx ELSE fx END AS ux FROM n WHERE side = 1)
SELECT event_type, event_id, x BETWEEN lo AND hi AS is_within_coverage, CASE WHEN x BETWEEN lo AND hi THEN i::BIGINT ELSE -1 END AS x_index,
  round(3600 * CASE WHEN x BETWEEN lo AND hi THEN ux - x END, 6) AS x_delta FROM p JOIN s USING (event_type)""")
def nearest_column(spark, sf):
    ev = event_series(spark, sf)
    anchors = ev.filter(F.col("value") > 100.0).select("event_type", "event_id", "t")
    columns = ev.filter(F.col("value") <= 20.0).groupBy("event_type", F.floor(F.col("t") / 6.0).alias("x_index")).agg(F.min("t").alias("x_mm"))
    out = jn.nearest_column(anchors, columns, ["event_type"], "t", "x_mm", "x_index", ["event_id"])
    return out.select("event_type", "event_id", "is_within_coverage", "x_index", r(3600 * F.col("x_delta")).alias("x_delta"))


BINS = "SELECT n_regionkey, n_nationkey, n_name, n_nationkey * 400.0 - 1000.0 AS lo, n_nationkey * 400.0 + 800.0 AS hi FROM nation"


@query("interval_lookup", f"""WITH b AS ({BINS}), h AS (
  SELECT c_custkey, min_by(b.n_name, b.n_nationkey) AS regime FROM customer JOIN nation n ON n.n_nationkey = c_nationkey
  JOIN b ON b.n_regionkey = n.n_regionkey AND c_acctbal BETWEEN lo AND hi GROUP BY 1)
SELECT c_custkey, n_regionkey, coalesce(regime, 'default_' || n_regionkey) AS regime
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN h USING (c_custkey)""")
def interval_lookup(spark, sf):
    nation = table(spark, sf, "nation")
    spans = nation.select("n_regionkey", "n_nationkey", F.col("n_name").alias("regime"),
                          (F.col("n_nationkey") * 400.0 - 1000.0).alias("lo"), (F.col("n_nationkey") * 400.0 + 800.0).alias("hi"))
    points = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("n_nationkey")).join(
        nation.select("n_nationkey", "n_regionkey"), "n_nationkey")
    out = jn.in_interval(points, spans, ["n_regionkey"], ["c_custkey"], "c_acctbal", "lo", "hi", "regime", "n_nationkey", 500.0,
                         F.concat(F.lit("default_"), F.col("n_regionkey").cast("string")))
    return out.select("c_custkey", "n_regionkey", "regime")


@query("band_join", f"""WITH {EV}, c0 AS (SELECT event_type, unnest(range(0, floor(max(t) / 24.0)::BIGINT + 2)) AS position FROM ev GROUP BY 1),
c AS (SELECT event_type, position, position * 24.0::DOUBLE AS x_at FROM c0)
SELECT event_type, position, count(*) AS n, round(median(value), 6) AS median_value, round(min(abs(t - x_at)), 6) AS closest
FROM c JOIN ev USING (event_type) WHERE abs(t - x_at) <= 3.0 GROUP BY ALL""")
def band_join(spark, sf):
    ev = event_series(spark, sf).select("event_type", "t", "value")
    last = ev.groupBy("event_type").agg((F.floor(F.max("t") / 24.0) + 1).cast("long").alias("last"))  # one position past the end
    centres = last.select("event_type", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("position")).withColumn(
        "x_at", F.col("position") * F.lit(24.0))
    near = jn.band(centres, ev, ["event_type"], "x_at", "t", 3.0)
    from trackgeo.operators.stats import medians

    keys = ["event_type", "position"]
    basic = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.abs(F.col("t") - F.col("x_at"))).alias("closest"))
    return rounded(basic.join(medians(near, keys, {"median_value": "value"}), keys), 6)


PER_ORDER = "per AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1)"


def per_order(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), r(F.sum("l_extendedprice"), 2).alias("price"))


@query("one_to_one_join", f"""WITH {PER_ORDER} SELECT o_orderkey, o_orderstatus, n_lines, price, n_lines IS NOT NULL AS _descriptor_matched
FROM orders LEFT JOIN per USING (o_orderkey)""")
def one_to_one_join(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return jn.one_to_one(orders, per_order(spark, sf), ["o_orderkey"])


@query("merge_report", """WITH l AS (SELECT o_orderkey AS k, count(*) AS nl FROM orders GROUP BY 1), r AS (SELECT l_orderkey AS k, count(*) AS nr FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(nl, 0) AS nl, coalesce(nr, 0) AS nr FROM l FULL JOIN r USING (k))
SELECT sum(nl)::BIGINT AS left_rows, sum(nr)::BIGINT AS right_rows, sum((nl > 1)::INT)::BIGINT AS left_duplicate_keys, sum((nr > 1)::INT)::BIGINT AS right_duplicate_keys,
  sum((nl > 0 AND nr = 0)::INT)::BIGINT AS unmatched_left_keys, sum((nl = 0 AND nr > 0)::INT)::BIGINT AS unexpected_right_keys,
  sum(nl * greatest(nr, 1))::BIGINT AS merged_rows FROM j""")
def merge_report(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return jn.merge_report(table(spark, sf, "orders").select("o_orderkey"), li, ["o_orderkey"])


@query("unexpected_rows", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def unexpected_rows(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    c = table(spark, sf, "customer").filter(F.col("c_acctbal") > 9900).select(F.col("c_nationkey").alias("s_nationkey"))
    return jn.unexpected(s, c, ["s_nationkey"])


@query("compare_runs", """WITH a AS (SELECT l_suppkey, sum(l_quantity) AS q, avg(l_discount) AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
b AS (SELECT l_suppkey, sum(l_quantity) AS q, avg(l_discount) AS d FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT l_suppkey, round(a.q, 6) AS q_a, round(b.q, 6) AS q_b, round(a.d, 9) AS d_a, round(b.d, 9) AS d_b, round(b.q - a.q, 6) AS q_delta, round(b.d - a.d, 9) AS d_delta
FROM a JOIN b USING (l_suppkey)""")
def compare_runs(spark, sf):
    li = table(spark, sf, "lineitem")
    part = lambda s: li.filter(F.col("l_linestatus") == s).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    out = jn.compare_runs(part("F"), part("O"), ["l_suppkey"], ["q", "d"])
    return rounded(rounded(out, 6, "q_a", "q_b", "q_delta"), 9, "d_a", "d_b", "d_delta")


@query("positional_alignment", f"""WITH {EV}, a AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
b AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ev WHERE event_type <> 'signup'),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.event_id AS fa, b.event_id AS fb, a.t AS xa, b.t AS xb
  FROM a FULL JOIN b ON a.user_id = b.user_id AND a.i = b.i)
SELECT user_id, count(xa) AS rows_a, count(xb) AS rows_b, count(xa) <> count(xb) AS count_mismatch, sum((fa <> fb)::INT)::BIGINT AS frame_mismatches,
  round(max(abs(xa - xb)), 6) AS max_abs_dx, sum((abs(xa - xb) > 1e-9)::INT)::BIGINT AS rows_beyond_tolerance FROM j GROUP BY 1""")
def positional_alignment(spark, sf):
    ev = event_series(spark, sf).select("user_id", "event_id", "t", "event_type")
    b = ev.filter("event_type <> 'signup'")
    out = jn.positional_alignment(ev, b, ["user_id"], ["t", "event_id"], ["event_id"], "event_id", "t")
    return rounded(out, 6)


CAND = """cand AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS cid, l_quantity AS y_min, l_quantity + 400.0 * l_discount AS y_max,
  l_quantity + 200.0 * l_discount AS centroid FROM lineitem WHERE l_returnflag = 'R'),
c1 AS (SELECT l_suppkey, cid, min(y_min) AS y_min, min(y_max) AS y_max, min(centroid) AS centroid FROM cand GROUP BY 1, 2),
seed AS (SELECT s_suppkey AS l_suppkey, 10.0 + s_nationkey AS seed_y_min, 14.0 + s_nationkey AS seed_y_max, 12.0 + s_nationkey AS seed_centroid FROM supplier)"""


def candidates_and_seeds(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    cand = li.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cid"), F.col("l_quantity").alias("y_min"),
                     (F.col("l_quantity") + 400.0 * F.col("l_discount")).alias("y_max"), (F.col("l_quantity") + 200.0 * F.col("l_discount")).alias("centroid"))
    cand = cand.groupBy("l_suppkey", "cid").agg(*[F.min(c).alias(c) for c in ("y_min", "y_max", "centroid")])
    n = F.col("s_nationkey")
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (n + 10.0).alias("seed_y_min"),
                                                (n + 14.0).alias("seed_y_max"), (n + 12.0).alias("seed_centroid"))
    return cand, seeds


@query("seed_association", f"""WITH {CAND}, j AS (SELECT s.*, cid, y_min, y_max, centroid, coalesce(seed_centroid BETWEEN y_min AND y_max, false) AS inside,
    abs(centroid - seed_centroid) AS away, greatest(0.0, least(y_max, seed_y_max) - greatest(y_min, seed_y_min)) AS ov
  FROM seed s LEFT JOIN c1 USING (l_suppkey)), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY (NOT inside)::INT, away, cid) AS rn FROM j)
SELECT l_suppkey, cid, CASE WHEN cid IS NULL THEN 'no_candidates' WHEN inside THEN 'contains_seed_centroid' ELSE 'nearest_centroid' END AS reason,
  round(away, 6) AS distance, round(ov, 6) AS overlap FROM k WHERE rn = 1""")
def seed_association(spark, sf):
    cand, seeds = candidates_and_seeds(spark, sf)
    return rounded(jn.seed_association(cand, seeds, ["l_suppkey"], "cid"), 6)


@query("best_iou", f"""WITH {CAND}, j AS (SELECT s.l_suppkey, cid, CASE WHEN greatest(0.0, least(y_max, seed_y_max) - greatest(y_min, seed_y_min)) IS NULL THEN NULL
    WHEN (y_max - y_min) + (seed_y_max - seed_y_min) - greatest(0.0, least(y_max, seed_y_max) - greatest(y_min, seed_y_min)) > 0
    THEN greatest(0.0, least(y_max, seed_y_max) - greatest(y_min, seed_y_min)) / ((y_max - y_min) + (seed_y_max - seed_y_min) - greatest(0.0, least(y_max, seed_y_max) - greatest(y_min, seed_y_min)))
    ELSE 0.0 END AS iou FROM seed s LEFT JOIN c1 USING (l_suppkey)), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(iou, 12) DESC, cid) AS rn FROM j)
SELECT l_suppkey, cid, round(iou, 9) AS iou FROM k WHERE rn = 1""")
def best_iou(spark, sf):
    cand, seeds = candidates_and_seeds(spark, sf)
    chosen = seeds.select("l_suppkey", F.col("seed_y_min").alias("left"), F.col("seed_y_max").alias("right"))
    return rounded(jn.best_iou(chosen, cand, ["l_suppkey"], "cid"), 9)


EXTRACT = """x AS (SELECT l_suppkey, l_linestatus, median(l_quantity) AS w, avg(l_quantity) AS c, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT l_suppkey, l_linestatus, CASE WHEN w >= 25 THEN 'selected' ELSE 'low_score' END AS status,
  CASE WHEN w >= 25 THEN c - w / 2 END AS "left", CASE WHEN w >= 25 THEN c + w / 2 END AS "right",
  CASE WHEN w >= 25 THEN w END AS width, CASE WHEN w >= 25 THEN c END AS centroid FROM x)"""


def extraction(spark, sf):
    from trackgeo.operators.stats import medians

    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", "l_quantity")
    keys = ["l_suppkey", "l_linestatus"]
    x = medians(li, keys, {"w": "l_quantity"}).join(li.groupBy(*keys).agg(F.avg("l_quantity").alias("c")), keys)
    ok = F.col("w") >= 25
    return x.select(*keys, F.when(ok, "selected").otherwise("low_score").alias("status"),
                    F.when(ok, F.col("c") - F.col("w") / 2).alias("left"), F.when(ok, F.col("c") + F.col("w") / 2).alias("right"),
                    F.when(ok, F.col("w")).alias("width"), F.when(ok, F.col("c")).alias("centroid"))


@query("agreement_with_control", f"""WITH {EXTRACT}, a AS (SELECT * FROM e WHERE l_linestatus = 'F'), b AS (SELECT * FROM e WHERE l_linestatus = 'O'),
j AS (SELECT a.l_suppkey, a.status AS control_status, coalesce(b.status, 'no_valid_component') AS other_status, b.centroid - a.centroid AS cd, b.width - a.width AS wd, a.width AS aw
  FROM a LEFT JOIN b USING (l_suppkey))
SELECT l_suppkey, control_status, other_status, round(cd, 6) AS centre_delta, round(wd, 6) AS width_delta,
  coalesce(control_status = 'selected' AND other_status = 'selected' AND abs(cd) <= 0.5 AND abs(wd) / greatest(aw, 1e-9) <= 0.2, false) AS spatial_agreement,
  control_status <> 'selected' AND other_status = 'selected' AS resolves_invalid, control_status = 'selected' AND other_status <> 'selected' AS rejects_selected FROM j""")
def agreement_with_control(spark, sf):
    e = extraction(spark, sf)
    part = lambda s: e.filter(F.col("l_linestatus") == s).drop("l_linestatus")
    out = jn.agreement_with_control(part("F"), part("O"), ["l_suppkey"], centre_tolerance=0.5)
    return rounded(out.select("l_suppkey", "control_status", "other_status", "centre_delta", "width_delta", "spatial_agreement", "resolves_invalid", "rejects_selected"), 6)


@query("method_agreement", f"""WITH x AS (SELECT l_suppkey, l_returnflag AS method, min(l_quantity) + avg(l_discount) AS lo, max(l_quantity) - avg(l_tax) AS hi FROM lineitem
    WHERE l_extendedprice > 60000 GROUP BY 1, 2 HAVING count(*) >= 10),
p AS (SELECT unnest([{{'a': 'A', 'b': 'N'}}, {{'a': 'A', 'b': 'R'}}, {{'a': 'N', 'b': 'R'}}, {{'a': 'A', 'b': 'Z'}}]) AS p),
d AS (SELECT p.a AS method_a, p.b AS method_b, abs(a.lo - b.lo) AS dl, abs(a.hi - b.hi) AS dr, abs((a.hi - a.lo) - (b.hi - b.lo)) AS dw,
    (least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS ov, a.hi - a.lo AS wa, b.hi - b.lo AS wb
  FROM p JOIN x a ON a.method = p.a JOIN x b ON b.method = p.b AND a.l_suppkey = b.l_suppkey),
s AS (SELECT method_a, method_b, count(*) AS n, median(dl) AS ml, median(dr) AS mr, median(dw) AS mw, median(greatest(ov, 0.0) / (wa + wb - greatest(ov, 0.0))) AS mi,
    quantile_cont(dw, 0.95) AS pw FROM d GROUP BY 1, 2)
SELECT p.a AS method_a, p.b AS method_b, coalesce(n, 0) AS n_both, round(ml, 6) AS median_left, round(mr, 6) AS median_right, round(mw, 6) AS median_width,
  round(mi, 6) AS median_iou, round(pw, 6) AS p95_width FROM p LEFT JOIN s ON s.method_a = p.a AND s.method_b = p.b""")
def method_agreement(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_extendedprice") > 60000)
    x = li.groupBy("l_suppkey", F.col("l_returnflag").alias("method")).agg(
        (F.min("l_quantity") + F.avg("l_discount")).alias("left"), (F.max("l_quantity") - F.avg("l_tax")).alias("right"), F.count(F.lit(1)).alias("n"))
    out = jn.method_agreement(x.filter("n >= 10").drop("n"), ["l_suppkey"], "method", [("A", "N"), ("A", "R"), ("N", "R"), ("A", "Z")])
    return rounded(out, 6)


@query("interval_arithmetic", """WITH x AS (SELECT o_orderkey, o_totalprice / 1000.0 AS a0, o_totalprice / 1000.0 + o_custkey % 97 AS a1,
  (o_orderkey % 500)::DOUBLE AS b0, (o_orderkey % 500)::DOUBLE + 50.0 AS b1 FROM orders),
y AS (SELECT *, greatest(0.0, least(a1, b1) - greatest(a0, b0)) AS ov FROM x)
SELECT o_orderkey, round(ov, 6) AS overlap, round(CASE WHEN (a1 - a0) + (b1 - b0) - ov > 0 THEN ov / ((a1 - a0) + (b1 - b0) - ov) ELSE 0.0 END, 9) AS iou,
  a0 <= b0 AND a1 >= b1 AS a_contains_b, a0 <= b0 + 25.0 AND b0 + 25.0 <= a1 AS holds_middle, round(0.5 * (a0 + a1), 6) AS midpoint FROM y""")
def interval_arithmetic(spark, sf):
    o = table(spark, sf, "orders")
    x = o.select("o_orderkey", (F.col("o_totalprice") / 1000.0).alias("a0"), (F.col("o_totalprice") / 1000.0 + F.col("o_custkey") % 97).alias("a1"),
                 (F.col("o_orderkey") % 500).cast("double").alias("b0"), ((F.col("o_orderkey") % 500).cast("double") + 50.0).alias("b1"))
    ab = [F.col(c) for c in ("a0", "a1", "b0", "b1")]
    return x.select("o_orderkey", r(iv.overlap(*ab)).alias("overlap"), r(iv.iou(*ab), 9).alias("iou"), iv.contains(*ab).alias("a_contains_b"),
                    iv.holds(ab[0], ab[1], ab[2] + 25.0).alias("holds_middle"), r(iv.midpoint(ab[0], ab[1])).alias("midpoint"))


@query("distinct_union_of_grids", """SELECT DISTINCT x FROM (SELECT round(l_quantity * 2.0, 3) AS x FROM lineitem UNION ALL SELECT round(p_size * 3.0, 3) FROM part)""")
def distinct_union_of_grids(spark, sf):
    a = table(spark, sf, "lineitem").select(r(F.col("l_quantity") * 2.0, 3).alias("x"))
    b = table(spark, sf, "part").select(r(F.col("p_size") * 3.0, 3).alias("x"))
    return a.union(b).distinct()
