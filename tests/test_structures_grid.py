"""Connected structures, plane fits and text grids against small brute-force answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackgeo.operators import grid as gr
from trackgeo.operators import stats as st
from trackgeo.operators import structures as sx
from trackgeo.sources import readers, writers


def flood(mask):
    todo, out = {tuple(c) for c in np.argwhere(mask)}, []
    while todo:
        stack, cells = [todo.pop()], set()
        while stack:
            r, c = stack.pop()
            cells.add((r, c))
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & todo
            todo -= near
            stack += near
        out.append(cells)
    return out


def test_labels_inventory_and_region(spark):
    rng = np.random.default_rng(0)
    mask = rng.random((14, 18)) < 0.42  # [y, x]
    z = np.where(mask | (rng.random(mask.shape) < 0.8), 1.0, np.nan)
    pts = [(1, x, y, x * 0.1, y * 0.05, None if np.isnan(z[y, x]) else 1.0, bool(mask[y, x])) for y in range(14) for x in range(18)]
    df = spark.createDataFrame(pts, "k int, x_index int, y_index int, x_mm double, y_mm double, z_mm double, hot boolean")
    lab = sx.label(df.filter("hot"), ["k"])
    cells = lab.select("root", "x_index", F.explode(F.sequence("y_lo", "y_hi")).alias("y")).collect()
    have = {}
    for r in cells:
        have.setdefault(r["root"], set()).add((r["y"], r["x_index"]))
    want = flood(mask)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want))

    inv = {r["pixel_count"]: r for r in sx.inventory(lab, df, ["k"], 4, 0.1).collect()}
    big = [c for c in want if len(c) >= 4 and max(x for _, x in c) > min(x for _, x in c)]
    assert sorted(inv) == sorted({len(c) for c in big})
    c = max(want, key=len)
    row = inv[len(c)]
    ys, xs = [y for y, _ in c], [x for _, x in c]
    box = z[min(ys):max(ys) + 1, min(xs):max(xs) + 1]
    assert abs(row["finite_support_fraction"] - len(c) / np.isfinite(box).sum()) < 1e-12
    assert abs(row["median_y"] - np.median(np.array(ys) * 0.05)) < 1e-12 and row["fragmentation_count"] == 1
    ring = {(y + i, x + j) for y, x in c for i in (-1, 0, 1) for j in (-1, 0, 1)}
    ring = {(y, x) for y, x in ring if 0 <= y < 14 and 0 <= x < 18}
    assert row["touches_missing"] == any(np.isnan(z[y, x]) for y, x in ring)
    region = sx.largest_region(lab, ["k"]).first()
    assert region["area"] == len(c) and abs(region["centroid_y"] - np.mean(ys)) < 1e-9
    eig = np.linalg.eigvalsh(np.cov(np.array([xs, ys]), bias=True))
    assert abs(region["major_axis"] - 4 * np.sqrt(eig[1])) < 1e-6


def test_structures_over_strip_borders(spark, monkeypatch):
    """Parts of narrow strips make the structures of the whole grid, from few edges; runs without a key stay alone."""
    rng = np.random.default_rng(1)
    mask = rng.random((12, 40)) < 0.45
    mask[3, :] = True  # one structure through all strips
    rows = [(k, int(x), int(y)) for k in (1, None) for y, x in np.argwhere(mask)]
    monkeypatch.setattr(sx, "STRIP", 5)
    edges = []
    whole = sx.connected
    monkeypatch.setattr(sx, "connected", lambda e, keys: edges.append(e.count()) or whole(e, keys))
    lab = sx.label(spark.createDataFrame(rows, "k int, x_index int, y_index int"), ["k"]).collect()
    have = {}
    for r in lab:
        if r["k"] == 1:
            have.setdefault(r["root"], set()).update((y, r["x_index"]) for y in range(r["y_lo"], r["y_hi"] + 1))
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, flood(mask)))
    assert all(root == min(x * sx.ROWS_PER_COLUMN + y for y, x in cells) for root, cells in have.items())
    assert all(r["root"] == r["run"] for r in lab if r["k"] is None)
    assert edges[0] < sum(r["k"] == 1 for r in lab) / 2  # rounds see the seven borders, not every column


def brute_plane(x, y, z, rule):
    """All rounds over plain arrays, with the minimum-norm slope of centred positions."""
    keep, plane = np.ones(len(z), bool), None
    for _ in range(rule.rounds):
        if keep.sum() < rule.min_samples:
            break
        mean = [v[keep].mean() for v in (x, y, z)]
        a, b = np.linalg.pinv(np.column_stack([x[keep] - mean[0], y[keep] - mean[1]]), rcond=1e-9) @ (z[keep] - mean[2])
        plane = (a, b, mean[2] - a * mean[0] - b * mean[1])
        off = z - a * x - b * y - plane[2]
        if rule.trim == "mad":
            mid = np.median(off[keep])
            half = 3 * max(1.4826 * np.median(np.abs(off[keep] - mid)), 1e-9)
            lo, hi = mid - half, mid + half
        else:
            lo, hi = np.percentile(off if rule.trim == "all" else off[keep], [5, 95])
        tighter = (off >= lo) & (off <= hi) & (keep if rule.trim == "kept" else True)
        if tighter.sum() < rule.min_samples:
            break
        keep = tighter
    return plane, len(z), int(keep.sum())


@pytest.mark.parametrize("rule", [gr.GLOBAL, gr.FOCUSED, gr.FOCUSED_MAD])
def test_planes_equal_brute_force(spark, rule):
    rng = np.random.default_rng(2)
    rows = []
    for k, slope in ((1, 0.01), (2, -0.02)):
        for x in range(24):
            for y in range(20):
                z = slope * x * 0.5 + 0.03 * y * 0.1 + 0.2 + rng.normal() * 1e-3 + (0.5 if rng.random() < 0.02 else 0)
                rows.append((k, x * 0.5, y * 0.1, float(z)))
    for i in range(400):  # positions on one line, outside the corridor on both ends
        rows.append((3, 0.01 * i, 0.02 * i - 3, float(0.8 * 0.01 * i + 1.6 * 0.02 * i + rng.normal() * 1e-4)))
    rows += [(4, 1.0, 0.5, float(v)) for v in rng.normal(size=150)]  # all in one point
    rows += [(5, float(i), 0.1, 1.0) for i in range(99)]  # too few
    rows += [(6, float(i % 50), 0.1 * (i % 3), 2.0) for i in range(300)]  # all residuals equal
    rows += [(7, float(rng.normal()), float(rng.normal()), float(rng.normal())) for _ in range(112)]  # one trim leaves too few
    df = spark.createDataFrame([(k, 0, 0, *r) for k, *r in rows], "k int, x_index int, y_index int, x_mm double, y_mm double, z_mm double")
    got = {r.k: r for r in gr.fit_planes(df.repartition(5), ["k"], rule).collect()}
    for k in range(1, 8):
        x, y, z = (np.array(v) for v in zip(*[r for kk, *r in rows if kk == k]))
        if rule.substrate_only:
            out = (y < gr.CORRIDOR_MM[0]) | (y > gr.CORRIDOR_MM[1])
            x, y, z = x[out], y[out], z[out]
        plane, n, final = brute_plane(x, y, z, rule)
        assert got[k].n_initial == n
        if k != 6:  # residuals that are rounding alone may fall on either side of a limit
            assert got[k].n_final == final, k
        if plane is None:
            assert got[k].a is None and got[k].b is None and got[k].c is None
        else:
            np.testing.assert_allclose((got[k].a, got[k].b, got[k].c), plane, atol=1e-9)


def test_percentiles_in_place(spark):
    rng = np.random.default_rng(4)
    groups = {1: rng.normal(size=3001), 2: np.repeat([0.0, -2.5, 7.0], [5, 9, 4]), 3: np.array([4.5]), 4: rng.integers(-3, 4, 500) * 1.0,
              5: np.exp(rng.normal(size=1000) * 9) * rng.choice([-1, 1], 1000)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    probs = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    got = {r.k: r.q for r in st.percentiles_in_place(df, ["k"], "v", probs).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(vs, probs), rtol=1e-12, atol=1e-300)


def test_exact_plane_and_short_sample(spark):
    rows = [(1, x, y, float(x), y * 0.1, 0.5 * x - 2.0 * y * 0.1 + 3) for x in range(20) for y in range(20)] + [(2, 0, y, 0.0, y * 0.1, 1.0) for y in range(20)]
    df = spark.createDataFrame(rows, "k int, x_index int, y_index int, x_mm double, y_mm double, z_mm double")
    flat = gr.detrend(df, gr.fit_planes(df, ["k"], gr.GLOBAL), ["k"])
    assert flat.filter("k = 1").agg(F.max(F.abs("z_mm"))).first()[0] < 1e-9
    assert flat.filter("k = 2").agg(F.min("z_mm")).first()[0] == 1.0


def test_text_grid_round_trip(spark, tmp_path):
    lines = ["profile export", "X Size 3", "Y Size 4", "Pixel_size 0.5", "RAW_DATA"]
    values = [None if i == 5 else i * 1000.0 for i in range(12)]
    lines += [f"{i // 4} {i % 4} {'Bad' if v is None else v}" for i, v in enumerate(values)]
    lines.insert(9, "broken")
    (tmp_path / "track_8_height.asc").write_text("\n".join(lines))
    (tmp_path / "track_18_height.asc").write_text("\n".join(lines))
    got = readers.read_height_text(spark, str(tmp_path)).filter("track_id = 8").orderBy("x_index", "y_index").collect()
    assert [(r["x_index"], r["y_index"]) for r in got] == [(i // 4, i % 4) for i in range(12)]
    assert [r["z_mm"] for r in got] == [None if v is None else pytest.approx(v * 1e-6) for v in values]
    assert got[11]["x_mm"] == 99.0 and got[11]["y_mm"] == 1.5
    files = readers.file_for_track(readers.list_files(spark, str(tmp_path / "*.asc")))
    assert {r["track_id"] for r in files.collect()} == {8, 18}


def test_runs_and_tiles(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "v")
    writers.write_run(df, str(tmp_path / "t"), "20240101_000000")
    writers.write_run(df.filter("v > 2"), str(tmp_path / "t"), "20240102_000000")
    assert readers.latest_run(spark.read.parquet(str(tmp_path / "t"))).count() == 2
    writers.write_summary(spark, {"b": 1, "a": "x"}, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["a"] == "x"
    names = spark.createDataFrame([(1, f"/p/tile{n}.png") for n in (10, 2, 1)], "k int, path string")
    tiles = readers.number_tiles(names.withColumn("sort_key", readers.natural_key(F.col("path"))), ["k"])
    assert [r["path"] for r in tiles.orderBy("tile_index").collect()] == ["/p/tile1.png", "/p/tile2.png", "/p/tile10.png"]
    x = readers.tile_extents(tiles, ["k"]).orderBy("tile_index").first()
    assert x["x_end_mm"] == 100.0 and x["x_start_mm"] == pytest.approx(100 - 100 / 3)


def test_hot_percentiles_keep_null_keys_and_ends(spark):
    """Groups over `hot_rows` equal the built-in aggregate, with a null key, infinities, NaN and a group without values."""
    rows = [(k, float(v)) for k in (None, 1) for v in [*range(-40, 60), 0.5, "inf", "-inf", "nan"]] + [(2, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = [0.0, 0.01, 0.333, 0.5, 1.0]
    want = {r.k: r.q for r in st.percentiles(df, ["k"], {"q": "v"}, probs).collect()}
    got = {r.k: r.q for r in st.percentiles(df, ["k"], {"q": "v"}, probs, hot_rows=50).collect()}
    ranked = {r.k: r.q for r in st.percentiles(df.filter("k = 1"), ["k"], {"q": "v"}, probs, hot_rows=1).collect()}
    assert str(got) == str(want) and str(ranked[1]) == str(want[1])
