"""Contract checks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgeo.config import ROW_IDENTITY
from trackgeo.operators import contracts as dq
from trackgeo.plans.inputs import EV, event_series
from trackgeo.plans.registry import query, r, rounded, table
from trackgeo.session import new_path
from trackgeo.sources.readers import read_per_track


@query("key_report", """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS n_rows, 0::BIGINT AS null_key_rows, sum((n > 1)::INT)::BIGINT AS duplicate_keys, sum(n - 1)::BIGINT AS surplus_rows FROM g""")
def key_report(spark, sf):
    return dq.key_report(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_examples", """SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5""")
def duplicate_examples(spark, sf):
    return dq.duplicate_examples(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("finite_report", f"""WITH {EV}, e AS (SELECT v, CASE WHEN value > 200 THEN 'NaN'::DOUBLE ELSE value END AS n, value FROM ev)
SELECT 'v' AS column_name, sum((v IS NULL)::INT)::BIGINT AS n_not_finite FROM e UNION ALL
SELECT 'n', sum(isnan(n)::INT)::BIGINT FROM e UNION ALL SELECT 'value', sum((value IS NULL)::INT)::BIGINT FROM e""")
def finite_report(spark, sf):
    ev = event_series(spark, sf).withColumn("n", F.when(F.col("value") > 200, F.lit(float("nan"))).otherwise(F.col("value")))
    return dq.finite_report(ev, ["v", "n", "value"])


@query("clean_non_finite", """WITH e AS (SELECT event_type, CASE WHEN value > 200 THEN NULL WHEN value < 1 THEN NULL ELSE value END AS v FROM events)
SELECT event_type, count(v) AS n, round(median(v), 6) AS med, round(avg(v), 6) AS mean FROM e GROUP BY 1""")
def clean_non_finite(spark, sf):
    v = F.when(F.col("value") > 200, F.lit(float("nan"))).when(F.col("value") < 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    ev = dq.clean(table(spark, sf, "events").select("event_type", v.alias("v")), ["v"])
    from trackgeo.operators.stats import medians

    basic = ev.groupBy("event_type").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return rounded(basic.join(medians(ev, ["event_type"], {"med": "v"}), "event_type"), 6)


@query("group_sizes", """SELECT n_nationkey AS c_nationkey, 60 AS expected_rows, coalesce(n, 0) AS n_rows, coalesce(n, 0) = 60 AS as_expected
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def group_sizes(spark, sf):
    expected = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(60).alias("expected_rows"))
    return dq.group_sizes(table(spark, sf, "customer"), ["c_nationkey"], expected)


AUDIT = f"""{EV}, a AS (SELECT event_id, event_type, v, CASE WHEN value < 150 THEN value END AS w, lag(v) OVER (PARTITION BY user_id ORDER BY ix) AS p FROM ev),
cells AS (SELECT event_id, 'v' AS column_name, v IS NULL AS miss, event_type = 'error' AS okay FROM a UNION ALL
  SELECT event_id, 'w', w IS NULL, event_type = 'purchase' FROM a UNION ALL SELECT event_id, 'p', p IS NULL, false FROM a)"""


def audited(spark, sf):
    from pyspark.sql import Window

    from trackgeo.operators.layout import order_rows

    o = order_rows(event_series(spark, sf), ["user_id"], ["t", "event_id"], "ix")
    o = o.rolling(1, 0, lambda w: {"p": F.lag("v").over(w)})
    a = o.df.withColumn("w", F.when(F.col("value") < 150, F.col("value")))
    return dq.null_audit(a, ["event_id"], {
        "v": F.col("event_type") == "error", "w": F.col("event_type") == "purchase", "p": F.lit(False)})


@query("null_audit", f"""WITH {AUDIT} SELECT column_name, sum(miss::INT)::BIGINT AS nulls, sum((miss AND okay)::INT)::BIGINT AS expected_nulls,
  sum((miss AND NOT okay)::INT)::BIGINT AS unexpected_nulls FROM cells GROUP BY 1""")
def null_audit(spark, sf):
    return audited(spark, sf)[0]


@query("unexpected_nulls", f"WITH {AUDIT} SELECT event_id, column_name FROM cells WHERE miss AND NOT okay")
def unexpected_nulls(spark, sf):
    return audited(spark, sf)[1]


@query("target_validity", f"""WITH {EV} SELECT count(*) AS n_rows, sum((v IS NULL OR value IS NULL)::INT)::BIGINT AS null_target_rows,
  sum((NOT value > 5.0)::INT)::BIGINT AS not_ready_rows FROM ev""")
def target_validity(spark, sf):
    ev = event_series(spark, sf).withColumn("pca_ready", F.col("value") > 5.0)
    return dq.target_validity(ev, ["v", "value"], "pca_ready")


@query("sealed_guard", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1")
def sealed_guard(spark, sf):
    ev = table(spark, sf, "events").select("event_type").filter("event_type <> 'signup'")
    return dq.sealed_guard(ev, "event_type", ["signup"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("missing_groups", "SELECT n_nationkey AS s_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000)")
def missing_groups(spark, sf):
    expected = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return dq.missing_groups(expected, table(spark, sf, "supplier").filter(F.col("s_acctbal") > 2000), ["s_nationkey"])


@query("order_contract", f"""WITH {EV}, s AS (SELECT event_id, CASE WHEN value > 100 THEN t + 1e-6 ELSE t END AS t FROM ev WHERE ix >= 4),
src AS (SELECT event_id, t AS st FROM ev WHERE event_type <> 'view')
SELECT count(*) AS n_samples, sum((st IS NULL)::INT)::BIGINT AS without_source, sum((abs(t - st) > 1e-12)::INT)::BIGINT AS drifted FROM s LEFT JOIN src USING (event_id)""")
def order_contract(spark, sf):
    from trackgeo.operators.layout import order_rows

    ev = event_series(spark, sf)
    o = order_rows(ev, ["user_id"], ["t", "event_id"], "ix")
    samples = o.where(F.col("ix") >= 4).withColumn("t", F.when(F.col("value") > 100, F.col("t") + 1e-6).otherwise(F.col("t")))
    return dq.order_contract(samples.select("event_id", "t"), ev.filter("event_type <> 'view'"), ["event_id"], "t")


CHECKS = """k AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d, sum((o_totalprice IS NULL)::INT) AS z FROM orders),
li AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS d FROM lineitem),
checks AS (SELECT 'orders_unique' AS name, n = d AS passed FROM k UNION ALL SELECT 'orders_finite', z = 0 FROM k UNION ALL SELECT 'lines_unique', n = d FROM li)"""


@query("overall_pass", f"WITH {CHECKS} SELECT min(passed::INT) = 1 AS passed, sum((NOT passed)::INT)::BIGINT AS n_failed, count(*) AS n_checks FROM checks")
def overall_pass(spark, sf):
    orders, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    a = dq.key_report(orders, ["o_orderkey"]).select(F.lit("orders_unique").alias("name"), (F.col("duplicate_keys") == 0).alias("passed"))
    b = dq.finite_report(orders, ["o_totalprice"]).select(F.lit("orders_finite").alias("name"), (F.col("n_not_finite") == 0).alias("passed"))
    c = dq.key_report(li, ["l_orderkey", "l_linenumber"]).select(F.lit("lines_unique").alias("name"), (F.col("duplicate_keys") == 0).alias("passed"))
    return dq.overall(a.unionByName(b).unionByName(c))


# Rows of `events` in the shape of the final table: a window of a user is a row of a track.
FINAL = f"""{EV}, ft AS (SELECT user_id AS track_id, event_id AS frame_index, t AS x_position_mm, value AS amplitude_um, -value AS signed_elevation_um,
  CASE WHEN value > 2.0 THEN value / 10 END AS smoothed_macro_width_mm, {', '.join(f'CASE WHEN value > 1.0 THEN value * {i} END AS pc{i}' for i in range(1, 6))},
  value > 2.0 AS eligible, value > 3.0 AS nonflat, value > 4.0 AS pca_ready, CASE WHEN value > 3.0 THEN 'ok' ELSE 'near_flat_or_too_low_scale' END AS normalization_status,
  value / 200 AS shape_support_fraction_on_common_grid, CASE WHEN event_type <> 'error' THEN 1.0 END AS retained_pca_grid_finite_fraction, true AS _descriptor_matched,
  event_type <> 'signup' AS is_within_heightmap_x_coverage, 0.9 AS central_corridor_finite_fraction, 0.8 AS finite_fraction,
  ix AS baseline_support_count, ix < 4 AS fallback_baseline_required FROM ev)"""


def final_table(spark, sf):
    from trackgeo.operators.layout import order_rows

    v = F.col("value")
    ev = order_rows(event_series(spark, sf), ["user_id"], ["t", "event_id"], "ix").df
    return ev.select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_index"), F.col("t").alias("x_position_mm"), "event_type",
        v.alias("amplitude_um"), (-v).alias("signed_elevation_um"), F.when(v > 2.0, v / 10).alias("smoothed_macro_width_mm"),
        *[F.when(v > 1.0, v * i).alias(f"pc{i}") for i in range(1, 6)],
        (v > 2.0).alias("eligible"), (v > 3.0).alias("nonflat"), (v > 4.0).alias("pca_ready"),
        F.when(v > 3.0, "ok").otherwise("near_flat_or_too_low_scale").alias("normalization_status"),
        (v / 200).alias("shape_support_fraction_on_common_grid"), F.when(F.col("event_type") != "error", F.lit(1.0)).alias("retained_pca_grid_finite_fraction"),
        F.lit(True).alias("_descriptor_matched"), (F.col("event_type") != "signup").alias("is_within_heightmap_x_coverage"),
        F.lit(0.9).alias("central_corridor_finite_fraction"), F.lit(0.8).alias("finite_fraction"),
        F.col("ix").alias("baseline_support_count"), (F.col("ix") < 4).alias("fallback_baseline_required"))


@query("target_groups", f"""WITH {FINAL}, g AS (
  SELECT 'pca_shape' AS target_group, pc1 IS NULL OR pc2 IS NULL OR pc3 IS NULL OR pc4 IS NULL OR pc5 IS NULL AS nt, retained_pca_grid_finite_fraction IS NULL AS nv, eligible AND nonflat AND pca_ready AS held FROM ft
  UNION ALL SELECT 'amplitude', amplitude_um IS NULL, false, eligible AND is_within_heightmap_x_coverage FROM ft
  UNION ALL SELECT 'signed_elevation', signed_elevation_um IS NULL, false, eligible AND is_within_heightmap_x_coverage FROM ft
  UNION ALL SELECT 'smoothed_macro_width', smoothed_macro_width_mm IS NULL, false, eligible AND is_within_heightmap_x_coverage FROM ft)
SELECT target_group, count(*) AS n_rows, sum(nt::INT)::BIGINT AS null_target_rows, sum(nv::INT)::BIGINT AS null_validity_rows, sum(held::INT)::BIGINT AS flagged_rows,
  sum((held AND NOT nt)::INT)::BIGINT AS usable_rows FROM g GROUP BY 1""")
def target_groups(spark, sf):
    return dq.target_group_report(final_table(spark, sf))


@query("target_alignment", f"""WITH {FINAL} SELECT f.track_id, f.frame_index, f.x_position_mm, amplitude_um, eligible, is_within_heightmap_x_coverage, central_corridor_finite_fraction::DOUBLE AS central_corridor_finite_fraction,
  finite_fraction::DOUBLE AS finite_fraction, baseline_support_count, fallback_baseline_required, _descriptor_matched FROM ft f JOIN ev ON ev.event_id = f.frame_index WHERE event_type = 'purchase'""")
def target_alignment(spark, sf):
    whole = final_table(spark, sf)
    meta = whole.filter("event_type = 'purchase'").select(*ROW_IDENTITY)
    return dq.align_targets(meta, whole, "amplitude")


@query("object_column", """SELECT o_orderkey, CAST(json_object('comment', CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END,
  'customer', o_custkey, 'open', o_orderstatus = 'O') AS VARCHAR) AS details FROM orders""")
def object_column(spark, sf):
    o, c = table(spark, sf, "orders"), F.col
    return o.select("o_orderkey", dq.json_object(
        open=c("o_orderstatus") == "O", customer=c("o_custkey"),
        comment=F.when(c("o_custkey") % 3 > 0, c("o_orderpriority"))).alias("details"))


@query("tracks_from_files", """SELECT CASE l_returnflag WHEN 'A' THEN 8 WHEN 'N' THEN 10 ELSE 14 END AS track_id, count(*) AS n_rows, sum(l_quantity)::DOUBLE AS quantity
FROM lineitem GROUP BY 1""")
def tracks_from_files(spark, sf):
    """One folder per track, read back against the expected tracks."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("quantity"))
    path, paths = new_path(spark), {}
    for flag, track in (("A", 8), ("N", 10), ("R", 14)):
        paths[track] = f"{path}/track_{track}"
        lines.filter(F.col("l_returnflag") == flag).select(F.lit(track).alias("track_id"), "quantity").write.parquet(paths[track])
    whole = read_per_track(spark, paths, "track_id int, quantity double")
    return whole.groupBy("track_id").agg(F.count("*").alias("n_rows"), F.sum("quantity").alias("quantity"))
