"""Group statistics over line items, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackgeo.config import SEPARATION_EDGES_MM
from trackgeo.operators import stats as st
from trackgeo.operators.layout import order_rows
from trackgeo.operators.profiles import evenly_spaced
from trackgeo.plans.inputs import EV, event_series
from trackgeo.plans.registry import query, r, rounded, table


@query("robust_mad", """WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(any_value(med), 6) AS price_median, round(1.4826 * median(abs(l_extendedprice - med)), 6) AS price_mad
FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1""")
def robust_mad(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    return rounded(st.median_and_mad(li, ["l_suppkey"], {"price": "l_extendedprice"}), 6)


@query("percentiles", """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.995), 4) AS p99_5,
  round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(avg(l_extendedprice), 4) AS mean
FROM lineitem GROUP BY 1, 2""")
def percentiles(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    q = st.percentiles(li, keys, {"q": "l_extendedprice"}, [0.05, 0.25, 0.75, 0.995])
    t = q.join(li.groupBy(*keys).agg(F.avg("l_extendedprice").alias("mean")), keys)
    return rounded(t.select(*keys, F.col("q")[0].alias("p5"), F.col("q")[1].alias("p25"), F.col("q")[3].alias("p99_5"),
                            (F.col("q")[2] - F.col("q")[1]).alias("iqr"), "mean"), 4)


@query("quantile_summary", """WITH long AS (
  SELECT l_returnflag, 'l_quantity' AS property, l_quantity AS value FROM lineitem UNION ALL
  SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL
  SELECT l_returnflag, 'l_discount', l_discount FROM lineitem)
SELECT l_returnflag, property, count(*) AS n, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.25), 4) AS p25,
  round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90,
  round(avg(value), 4) AS mean, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(stddev_pop(value), 4) AS std
FROM long GROUP BY 1, 2""")
def quantile_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(st.quantile_summary(li, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"]), 4)


@query("count_pivot", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'X') AS "X" FROM orders GROUP BY 1""")
def count_pivot(spark, sf):
    return st.count_pivot(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"])


@query("value_counts", """SELECT coalesce(kind, '(none)') AS kind, count(*) AS n FROM (
  SELECT CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events) GROUP BY 1""")
def value_counts(spark, sf):
    ev = table(spark, sf, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return st.value_counts(ev, "kind")


@query("coverage_rollup", """WITH e AS (SELECT event_type, value > 20.0 AS hit, CASE WHEN event_type <> 'error' THEN value END AS v,
  CASE WHEN value < 300.0 THEN value END AS w FROM events)
SELECT event_type, grouping(event_type) AS is_total, count(*) AS n_rows, sum(hit::INT)::BIGINT AS n_matched,
  round(avg(hit::INT), 9) AS matched_fraction, sum((v IS NULL)::INT)::BIGINT AS null_v, sum((w IS NULL)::INT)::BIGINT AS null_w
FROM e GROUP BY ROLLUP (event_type)""")
def coverage_rollup(spark, sf):
    ev = event_series(spark, sf).withColumn("w", F.when(F.col("value") < 300.0, F.col("value")))
    return rounded(st.coverage(ev, "event_type", F.col("value") > 20.0, ["v", "w"]), 9)


@query("nested_counts", """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, sum(n)::BIGINT AS n_rows, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS by_status
FROM c GROUP BY 1""")
def nested_counts(spark, sf):
    t = st.nested_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    text = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return t.select("o_orderpriority", "n_rows", text.alias("by_status"))


BIN_CASE = "CASE " + " ".join(
    f"WHEN d {'>=' if i == 0 else '>'} {lo} AND d <= {hi} THEN '{lo:g}-{hi:g}'"
    for i, (lo, hi) in enumerate(zip(SEPARATION_EDGES_MM, SEPARATION_EDGES_MM[1:]))) + " END"


@query("fixed_bins", f"""WITH d AS (SELECT l_quantity AS d, l_extendedprice AS p FROM lineitem), b AS (SELECT *, {BIN_CASE} AS bin FROM d)
SELECT bin, count(*) AS n, round(median(p), 4) AS p50, round(avg(p), 4) AS mean FROM b WHERE bin IS NOT NULL GROUP BY 1""")
def fixed_bins(spark, sf):
    li = table(spark, sf, "lineitem").select(
        st.fixed_bins("l_quantity", SEPARATION_EDGES_MM).alias("bin"), F.col("l_extendedprice").alias("p")).filter("bin is not null")
    mid = st.medians(li, ["bin"], {"p50": "p"})
    return rounded(li.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean")).join(mid, "bin"), 4)


@query("step_bins", """WITH b AS (SELECT range::INT AS bin FROM range(11)),
s AS (SELECT floor((l_quantity - 40.0) / 2.0)::INT AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem
  WHERE l_quantity >= 40.0 AND l_quantity < 62.0 GROUP BY 1)
SELECT bin, (40.0 + bin * 2.0)::DOUBLE AS bin_start, (40.0 + (bin + 1) * 2.0)::DOUBLE AS bin_stop, n, mean FROM b LEFT JOIN s USING (bin)""")
def step_bins(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    return st.step_bins(li, "l_quantity", 40.0, 62.0, 2.0, [F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), 4).alias("mean")])


@query("window_effect", f"""WITH {EV},
m AS (SELECT event_type, median(v) AS med FROM ev GROUP BY 1),
s AS (SELECT event_type, 1.4826 * median(abs(v - med)) AS mad FROM ev JOIN m USING (event_type) GROUP BY 1),
c AS (SELECT event_type, count(v) FILTER (t BETWEEN 240 AND 480) AS n_window,
        max((t BETWEEN 240 AND 480 AND value > 100.0)::INT) AS has_label,
        median(v) FILTER (t BETWEEN 240 AND 480) AS wm, median(v) FILTER (t >= 0 AND t < 240) AS bm FROM ev GROUP BY 1),
b AS (SELECT event_type, floor((t - 240) / 24.0) AS bin, median(v) AS bmed FROM ev WHERE t BETWEEN 240 AND 480 GROUP BY ALL),
h AS (SELECT event_type, sum((bmed > bm)::INT)::BIGINT AS high_bins FROM b JOIN c USING (event_type) GROUP BY 1),
e AS (SELECT event_type, n_window, has_label, wm, bm, mad, high_bins, CASE WHEN mad > 0 THEN (wm - bm) / mad END AS effect
  FROM c JOIN s USING (event_type) LEFT JOIN h USING (event_type))
SELECT event_type, n_window, has_label, round(wm, 6) AS window_median, round(bm, 6) AS before_median, round(mad, 6) AS series_mad,
  high_bins, round(effect, 6) AS effect,
  n_window >= 20 AND has_label = 1 AND coalesce(abs(effect) >= 0.25, false) AND coalesce(high_bins, 0) >= 3 AS passed FROM e""")
def window_effect(spark, sf):
    t = st.window_effect(event_series(spark, sf), ["event_type"], "t", "v", (240.0, 480.0), (0.0, 240.0), 24.0, labelled=F.col("value") > 100.0)
    return rounded(t, 6)


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return st.top_k(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query("top_k_per_group", """SELECT o_orderpriority, o_orderkey, o_totalprice, rank_in_group FROM (SELECT *, row_number() OVER (
  PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank_in_group FROM orders) WHERE rank_in_group <= 10""")
def top_k_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return st.top_k_per_group(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query("multi_key_sort", """SELECT l_returnflag, l_suppkey, round(sum(l_extendedprice), 2) AS revenue,
  row_number() OVER (ORDER BY l_returnflag, l_suppkey DESC) AS ordinal FROM lineitem GROUP BY 1, 2""")
def multi_key_sort(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(r(F.sum("l_extendedprice"), 2).alias("revenue"))
    o = order_rows(t, [], ["l_returnflag", F.desc("l_suppkey")], "ordinal")
    return o.df.select("l_returnflag", "l_suppkey", "revenue", (F.col("ordinal") + 1).alias("ordinal")).orderBy("ordinal")


@query("representatives", """WITH c AS (SELECT c_mktsegment, c_custkey, c_acctbal, c_acctbal > 5000 AS strict, c_acctbal > 0 AS loose FROM customer),
n AS (SELECT c_mktsegment, sum(strict::INT) AS ns, sum(loose::INT) AS nl FROM c GROUP BY 1),
pool AS (SELECT c.* FROM c JOIN n USING (c_mktsegment) WHERE CASE WHEN ns >= 3 THEN strict WHEN nl >= 3 THEN loose ELSE true END),
q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.1) AS q1, quantile_cont(c_acctbal, 0.5) AS q5, quantile_cont(c_acctbal, 0.9) AS q9 FROM pool GROUP BY 1),
a AS (SELECT c_mktsegment, 'quiet' AS representative, min_by(c_custkey, abs(c_acctbal - q1)) AS k, any_value(q1) AS tv FROM pool JOIN q USING (c_mktsegment) GROUP BY 1),
b AS (SELECT c_mktsegment, 'moderate' AS representative, min_by(c_custkey, abs(c_acctbal - q5)) AS k, any_value(q5) AS tv FROM pool JOIN q USING (c_mktsegment)
  WHERE (c_mktsegment, c_custkey) NOT IN (SELECT c_mktsegment, k FROM a) GROUP BY 1),
d AS (SELECT c_mktsegment, 'strong' AS representative, min_by(c_custkey, abs(c_acctbal - q9)) AS k, any_value(q9) AS tv FROM pool JOIN q USING (c_mktsegment)
  WHERE (c_mktsegment, c_custkey) NOT IN (SELECT c_mktsegment, k FROM a UNION ALL SELECT c_mktsegment, k FROM b) GROUP BY 1)
SELECT x.c_mktsegment, representative, k AS c_custkey, c.c_acctbal, round(tv, 4) AS target_value
FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d) x JOIN customer c ON c.c_custkey = x.k""")
def representatives(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    t = st.representatives(
        c, ["c_mktsegment"], "c_custkey", "c_acctbal",
        [F.col("c_acctbal") > 5000, F.col("c_acctbal") > 0, F.lit(True)],
        {"quiet": 0.1, "moderate": 0.5, "strong": 0.9})
    return rounded(t, 4, "target_value")


@query("centre_band", """WITH m AS (SELECT median(l_discount) AS med FROM lineitem), d AS (SELECT any_value(med) AS med, 1.4826 * median(abs(l_discount - med)) AS mad FROM lineitem, m),
h AS (SELECT *, greatest(3.5 * mad, 0.3::DOUBLE) AS half FROM d)
SELECT round(med - half, 6) AS band_lo, round(med + half, 6) AS band_hi, round(med, 6) AS pooled_median, round(mad, 6) AS pooled_mad FROM h""")
def centre_band(spark, sf):
    return rounded(st.centre_band(table(spark, sf, "lineitem").select("l_discount"), "l_discount"), 6)


@query("width_prior", """WITH m AS (SELECT median(l_quantity) AS med FROM lineitem), d AS (SELECT any_value(med) AS med, 1.4826 * median(abs(l_quantity - med)) AS mad FROM lineitem, m)
SELECT round(med, 6) AS preferred_width, round(greatest(0.3::DOUBLE, 2.0 * mad), 6) AS width_scale FROM d""")
def width_prior(spark, sf):
    return rounded(st.width_prior(table(spark, sf, "lineitem").select("l_quantity"), "l_quantity", 0.3, 0.32), 6)


@query("evenly_spaced_sample", """WITH k AS (SELECT o_orderpriority, o_orderkey,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS ix, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
w AS (SELECT DISTINCT o_orderpriority, round_even(i * (n - 1) / 99.0::DOUBLE, 0)::BIGINT AS ix
  FROM (SELECT DISTINCT o_orderpriority, n FROM k) CROSS JOIN (SELECT range AS i FROM range(100)))
SELECT o_orderpriority, o_orderkey FROM k JOIN w USING (o_orderpriority, ix)""")
def evenly_spaced_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey")
    return evenly_spaced(o, ["o_orderpriority"], ["o_orderkey"], 100)


@query("stride_sample", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_suppkey % 4 = 0 AND l_linenumber % 2 = 0")
def stride_sample(spark, sf):
    from trackgeo.operators.grid import stride

    li = stride(table(spark, sf, "lineitem"), {"l_suppkey": 4, "l_linenumber": 2})
    return li.agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_extendedprice"), 2).alias("price"))
