"""Recurrences along a track against plain loops, whole and in chunks."""

import numpy as np
import pytest

from trackgeo.operators import sequential as sq


def test_selection_with_continuity(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in (1, 2):
        for x in range(70):
            n = int(rng.integers(0, 4))
            rows.append((k, x, list(range(n)), [float(v) for v in rng.uniform(0.6, 1.4, n)],
                         [float(v) for v in rng.uniform(1.0, 2.0, n)], 0.6, 0.18, 1.7, 0.97))
    ddl = ("k int, x int, components array<int>, centroids array<double>, base_scores array<double>, "
           "continuity_weight double, continuity_scale double, min_score double, ambiguity_ratio double")
    df = spark.createDataFrame(rows, ddl)
    want = {}
    for k in (1, 2):
        prev = None
        for _, x, ids, cs, bs, w, s, low, amb in sorted(r for r in rows if r[0] == k):
            if not ids:
                want[k, x] = ("no_valid_component", None)
                continue
            tot = [b + w * (0.5 if prev is None else np.exp(-abs(c - prev) / s)) for b, c in zip(bs, cs)]
            i = int(np.argmax(tot))
            ratio = sorted(tot)[-2] / tot[i] if len(tot) > 1 else 0.0
            word = "low_score" if tot[i] < low else "ambiguous" if ratio >= amb else "selected"
            if word == "selected":
                prev = cs[i]
            want[k, x] = (word, i)
    for sizes in ({}, {"hot_rows": 20, "chunk_rows": 9}):
        got = sq.select_in_sequence(df, ["k"], "x", **sizes).collect()
        assert {(r["k"], r["x"]): (r["status"], r["component"]) for r in got} == want


def test_selection_repairs_only_changed_chunks(spark, monkeypatch):
    """Forty chunks; a long empty stretch hands one centroid on over many of them, a round each."""
    rng = np.random.default_rng(11)
    rows = []
    for k, length in ((1, 200), (None, 15)):
        for x in range(length):
            n = 0 if 60 <= x < 100 else int(rng.integers(1, 4))
            rows.append((k, x, list(range(n)), [float(v) for v in rng.uniform(0.6, 1.4, n)],
                         [float(v) for v in rng.uniform(1.0, 2.0, n)], 0.9, 0.1, 1.5, 0.99))
    ddl = ("k int, x int, components array<int>, centroids array<double>, base_scores array<double>, "
           "continuity_weight double, continuity_scale double, min_score double, ambiguity_ratio double")
    df = spark.createDataFrame(rows, ddl)
    pick = lambda r: (r["k"], r["x"], r["status"], r["component"], round(r["score"] or 0, 9))
    whole = {pick(r) for r in sq.select_in_sequence(df, ["k"], "x").collect()}
    written = []
    cut = sq.durable
    monkeypatch.setattr(sq, "durable", lambda d: (lambda t: (written.append(t), t)[1])(cut(d)))
    got = [pick(r) for r in sq.select_in_sequence(df, ["k"], "x", 20, 5).collect()]
    assert len(got) == 215 and set(got) == whole
    walked = [t.count() for t in written if "_leaves" in t.columns]
    assert len(walked) > 8 and walked[0] == 215 and max(walked[2:]) <= 50  # later rounds hold few chunks


def test_recurrences_of_empty_tables(spark):
    ddl = ("k int, x int, components array<int>, centroids array<double>, base_scores array<double>, "
           "continuity_weight double, continuity_scale double, min_score double, ambiguity_ratio double")
    assert sq.select_in_sequence(spark.createDataFrame([], ddl), ["k"], "x").count() == 0


def brute_path(nodes):
    nodes = sorted(nodes, key=lambda n: (n[1], n[2]))
    w = list(sq.MOVE_WEIGHTS.values())
    best, came = [], []
    for i, a in enumerate(nodes):
        b, c = a[3], None
        for j in range(i):
            p = nodes[j]
            gap = a[1] - p[1]
            if 1 <= gap <= sq.MAX_GAP:
                cost = sum(v * abs(p[4 + q] - a[4 + q]) for q, v in enumerate(w))
                cand = best[j] + a[3] - cost - (sq.GAP_OPEN + sq.GAP_STEP * (gap - 1))
                if cand > b:
                    b, c = cand, j
        best.append(b), came.append(c)
    i = int(np.argmax(best))
    total, path = best[i], set()
    while i is not None:
        path.add((nodes[i][0], nodes[i][1], nodes[i][2]))
        i = came[i]
    return total, path


@pytest.mark.parametrize("seed", [1, 2])
def test_best_path(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in (1, 2):
        for x in range(3, 63):
            if rng.random() < 0.3 or (k == 2 and 20 < x < 29):
                continue
            for node in range(int(rng.integers(1, 4))):
                lo, width = float(rng.uniform(0.5, 1.0)), float(rng.uniform(0.1, 0.4))
                rows.append((k, x, node, float(rng.uniform(0.5, 3.0)), lo + width / 2, lo, lo + width, width))
    df = spark.createDataFrame(rows, "k int, position long, node long, score double, centroid double, y_min double, y_max double, width double")
    for sizes in ({}, {"hot_positions": 20, "chunk_positions": 11}):
        got = sq.best_path(df, ["k"], **sizes).collect()
        for k in (1, 2):
            total, path = brute_path([r for r in rows if r[0] == k])
            mine = [r for r in got if r["k"] == k]
            assert {(r["k"], r["position"], r["node"]) for r in mine} == path
            assert all(abs(r["path_score"] - total) < 1e-9 for r in mine)


def test_families(spark):
    rows = [  # threshold, component, y_min, y_max, centroid, width, median, peak
        (3.0, 0, 0.80, 0.90, 0.85, 0.10, 5.0, 9.0), (2.0, 0, 0.78, 0.95, 0.86, 0.17, 4.0, 9.0),
        (2.0, 1, 1.30, 1.40, 1.35, 0.10, 3.0, 4.0), (1.0, 0, 0.70, 1.00, 0.85, 0.30, 3.0, 9.0), (1.0, 1, 1.29, 1.45, 1.37, 0.16, 2.0, 4.0)]
    df = spark.createDataFrame([(1, 7, *r) for r in rows], "k int, position int, threshold_k double, component int, y_min double, y_max double, centroid double, width double, median_above double, peak_above double")
    got = {r["family"]: r for r in sq.families(df, ["k", "position"], [1.0, 2.0, 3.0]).collect()}
    assert len(got) == 2
    assert got[0]["persistence"] == 1.0 and got[0]["y_min"] == 0.78 and got[0]["threshold_high"] == 3.0
    assert abs(got[1]["persistence"] - 2 / 3) < 1e-12 and got[1]["width"] == 0.10
