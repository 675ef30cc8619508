"""Similarities and medoids equal brute force over all profiles, with and without missing points."""

import time

import numpy as np
import pytest

from trackgeo.operators import similarities as si

SCHEMA = "track_id bigint, x_index bigint, x_mm double, shape array<double>"
WHERE = (["track_id"], "x_index", "shape", "x_mm")


def table(spark, tracks):
    rows = [(t, i, 0.2 * i, [None if np.isnan(v) else float(v) for v in row]) for t, x in tracks.items() for i, row in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def brute(x):
    r = si.block_similarity(x, x, si.MIN_SHARE, si.MIN_POINTS)
    np.fill_diagonal(r, np.nan)
    return r


def coherent(rng, n, d=12, noise=0.4):
    """Profiles around one shape, with a second family and some noise."""
    base = np.sin(np.linspace(0, 3, d)) * 3
    x = base + rng.normal(0, noise, (n, d))
    x[: n // 5] = np.cos(np.linspace(0, 5, d)) * 3 + rng.normal(0, noise, (n // 5, d))
    return x


@pytest.mark.parametrize("gaps", [3, 150])
def test_medoids_and_summaries_equal_brute_force(spark, gaps):
    rng = np.random.default_rng(gaps)
    tracks = {0: coherent(rng, 400), 1: coherent(rng, 90), 2: rng.normal(size=(3, 12)), 3: np.ones((2, 12)), 4: rng.normal(size=(1, 12))}
    for k in range(gaps):
        tracks[0][k, rng.integers(0, 12, 3)] = np.nan
    tracks[1][5] = 4.0  # flat
    df = table(spark, tracks)
    got = {m.track_id: m for m in si.medoids(df, *WHERE, block=64, anchors=16).collect()}
    summary = {m.track_id: m for m in si.similarity_summary(df, *WHERE, block=64).collect()}
    binned = {(m.track_id, m.bin): m for m in si.similarity_summary(df, *WHERE, edges=[0.0, 1.0, 7.0], block=64).collect()}
    for t, x in tracks.items():
        r = brute(x)
        assert got[t].sample_size == len(x)
        if np.isfinite(r).any():
            mid = np.array([np.nanmedian(row) if np.isfinite(row).any() else -9 for row in r])
            assert abs(got[t].median_similarity - mid.max()) < 1e-12 and mid[got[t].medoid] >= mid.max() - 1e-12
            assert got[t].medoid_position == pytest.approx(0.2 * got[t].medoid)
            i, j = np.nonzero(np.triu(np.isfinite(r), 1))
            s = summary[t]
            assert s.n_pairs == len(i)
            np.testing.assert_allclose([s.p10, s.p25, s.p50, s.p75, s.p90, s.mean],
                                       [*np.quantile(r[i, j], si.SUMMARY), r[i, j].mean()], atol=1e-12)
            apart = np.round(0.2 * (j - i), 9)
            for name, ok in (("0-1", apart <= 1.0), ("1-7", (apart > 1.0) & (apart <= 7.0))):
                if ok.any():
                    assert binned[t, name].n_pairs == ok.sum()
                    np.testing.assert_allclose(binned[t, name].p50, np.median(r[i, j][ok]), atol=1e-12)
        else:
            assert got[t].medoid == 0 and got[t].median_similarity is None and t not in summary


def test_between_groups(spark):
    rng = np.random.default_rng(9)
    tracks = {0: coherent(rng, 150), 1: coherent(rng, 70), 2: coherent(rng, 5)}
    got = {(m.group_a, m.group_b): m for m in si.between_groups(
        table(spark, tracks), "track_id", "x_index", "shape", "x_mm", [(0, 1), (0, 2), (0, 7)], block=32).collect()}
    assert set(got) == {(0, 1), (0, 2)}
    for (a, b), m in got.items():
        r = si.block_similarity(tracks[a], tracks[b], si.MIN_SHARE, si.MIN_POINTS).ravel()
        assert m.n_pairs == r.size
        np.testing.assert_allclose([m.p10, m.p50, m.p90, m.mean], [*np.quantile(r, [0.1, 0.5, 0.9]), r.mean()], atol=1e-12)


def test_medoid_of_a_long_track(spark):
    """5,000 profiles: equal to brute force, and most of them are settled by bounds."""
    rng = np.random.default_rng(5)
    x = coherent(rng, 5_000, 24, 0.8)
    df = table(spark, {0: x})
    df.count()
    start = time.perf_counter()
    got = si.medoids(df, *WHERE).collect()[0]
    mid = np.nanmedian(brute(x), axis=1)
    assert got.medoid == int(mid.argmax()) and abs(got.median_similarity - mid.max()) < 1e-9
    assert time.perf_counter() - start < 60


def test_medoid_writes_few_rows_a_profile(spark, monkeypatch):
    """What the search writes grows with the profiles, not with their pairs; the first of equal copies is the medoid."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 24))
    written = []

    def counted(df, write=si.durable):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(si, "durable", counted)
    got = si.medoids(table(spark, {0: np.vstack([x, x])}), *WHERE, block=200, anchors=8).collect()[0]
    mid = np.nanmedian(brute(np.vstack([x, x])), axis=1)
    assert got.medoid == int(np.round(mid, 12).argmax()) < 300 and abs(got.median_similarity - mid.max()) < 1e-12
    assert sum(written) < 30 * 600
