"""Coherence summary and representatives on tracks with missing flags, without profiles and with ties."""

from trackgeo.operators import profiles as pr


def test_summary_keeps_every_track(spark):
    table = spark.createDataFrame(
        [(1, True, False, True), (1, True, True, True), (1, False, True, True), (1, True, None, None), (2, None, True, False)],
        "track_id int, eligible boolean, fallback boolean, nonflat boolean")
    sims = spark.createDataFrame([(1, 0.2), (1, 0.8), (1, None)], "track_id int, similarity_to_medoid double")
    pairs = spark.createDataFrame([(1, 1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.3)], "track_id int, n_pairs long, p10 double, p25 double, p50 double, p75 double, p90 double, mean double")
    got = {r["track_id"]: r for r in pr.coherence_summary(table, sims, pairs, ["track_id"]).collect()}
    a, b = got[1], got[2]
    assert (a["n_total"], a["n_eligible"], a["n_included"], a["within_n_pairs"]) == (4, 3, 2, 1)
    assert (a["eligible_fraction"], a["included_fraction"], a["fallback_fraction"]) == (0.75, 0.5, 0.5)
    assert abs(a["fallback_of_eligible"] - 1 / 3) < 1e-12 and abs(a["medoid_p50"] - 0.5) < 1e-12 and abs(a["medoid_mean"] - 0.5) < 1e-12
    assert (b["n_eligible"], b["included_of_eligible"], b["fallback_of_eligible"], b["medoid_p50"], b["within_n_pairs"]) == (0, 0.0, None, None, 0)


def test_representatives_by_brute_force(spark):
    places = {1: [0.0, 1.0, 2.0, 2.0, 7.0], 2: [5.0]}
    p = spark.createDataFrame([(t, i, x) for t, xs in places.items() for i, x in enumerate(xs)], "track_id int, x_index int, x_mm double")
    med = spark.createDataFrame([(1, 2.1), (2, 0.0), (3, 1.0)], "track_id int, medoid_position double")
    spans = [(1, "a", 0.0, 1.0), (1, "b", 3.0, 6.5), (1, "c", 0.0, 1.0), (2, "d", 90.0, 99.0)]
    regimes = spark.createDataFrame(spans, "track_id int, regime_id string, x_min double, x_max double")
    got = {(r["track_id"], r["label"]): r["x_mm"] for r in pr.representatives(p, med, regimes, ["track_id"], "x_mm", "x_index").collect()}
    asked = [(1, "track_1_medoid", 2.1), (2, "track_2_medoid", 0.0)] + [(t, n, 0.5 * (a + b)) for t, n, a, b in spans]
    assert got == {(t, n): min(places[t], key=lambda x: (abs(x - at), x)) for t, n, at in asked}
    assert pr.representatives(p.filter("false"), med, regimes, ["track_id"], "x_mm", "x_index").count() == 0
