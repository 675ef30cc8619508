"""Profiles as arrays on a common grid: resampling, shape, similarity, PCA, descriptors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackgeo.operators.joins import nearest
from trackgeo.operators.layout import HOT_ROWS, attach, order_rows
from trackgeo.operators.series import longest_run, mark_runs, runs  # noqa: F401
from trackgeo.operators.stats import MAD_SCALE, medians, percentiles

GRID = (0.65, 1.35, 176)


# ------------------------------------------------------------------ resampling and shape


def resample(
    points: DataFrame, keys: list[str], value: str = "z_um", grid: tuple[float, float, int] = GRID,
    out: str = "profile",
) -> DataFrame:
    """Profile on a common y grid, interpolated inside finite runs of two samples or more.

    Every pair of neighbouring finite samples covers the grid points between them, so a gap covers
    none; a grid point hit by two pairs is an exact sample and has the same value in both.
    """
    lo, hi, n = grid
    step = (hi - lo) / (n - 1)
    o = order_rows(points, keys, ["y_index"], "_iy", bounded=True)
    y, v = F.col("y_mm"), F.col(value)
    o = o.rolling(0, 1, lambda w: {"_y2": F.lead(y).over(w), "_v2": F.lead(v).over(w)})
    pairs = o.where(v.isNotNull() & F.col("_v2").isNotNull() & (F.col("_y2") >= lo) & (y <= hi))
    first = F.greatest(F.lit(0), F.floor((y - lo) / step)).cast("int")
    last = F.least(F.lit(n - 1), F.ceil((F.col("_y2") - lo) / step)).cast("int")
    hits = pairs.filter(first <= last).select(
        *keys, y.alias("_y1"), "_y2", v.alias("_v1"), "_v2", F.explode(F.sequence(first, last)).alias("g"))
    at = F.lit(lo) + F.col("g") * step
    line = F.col("_v1") + (F.col("_v2") - F.col("_v1")) * (at - F.col("_y1")) / (F.col("_y2") - F.col("_y1"))
    cells = hits.filter((at >= F.col("_y1") - 1e-12) & (at <= F.col("_y2") + 1e-12)).groupBy(*keys, "g").agg(
        F.min_by(line, F.col("_y1")).alias("v"))
    sparse = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("g", "v"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda g: F.try_element_at("m", g))
    empty = F.array_repeat(F.lit(None).cast("double"), n)
    every = points.select(*keys).distinct()
    return every.join(sparse, keys, "left").select(
        *keys, F.when(F.col("m").isNull(), empty).otherwise(full).alias(out))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, also when used inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_median(values: Column) -> Column:
    """Median of the non-null elements; null when there are none."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2)

    return let(F.array_sort(F.filter(values, lambda e: e.isNotNull())), middle)


def array_mad(values: Column, centre: Column) -> Column:
    return let(centre, lambda c: array_median(F.transform(values, lambda e: F.abs(e - c))) * MAD_SCALE)


def support(values: Column) -> Column:
    """Share of grid points with a value."""
    return F.size(F.filter(values, lambda e: e.isNotNull())) / F.size(values)


def normalise(
    profiles: DataFrame, column: str = "profile", min_points: int = 5, min_scale: float = 0.75,
    min_support: float = 0.70, out: str = "shape",
) -> DataFrame:
    """Shape (value − median)/MAD with its status; null elements where nothing is known."""
    v = F.col(column)
    stats = let(array_median(v), lambda c: let(array_mad(v, c), lambda s: F.struct(
        c.alias("c"), s.alias("s"), F.transform(v, lambda e: (e - c) / s).alias("shape"))))
    n = F.size(F.filter(v, lambda e: e.isNotNull()))
    t = profiles.withColumns({"support_fraction": support(v), "_n": n, "_st": stats})
    enough = F.col("_n") >= min_points
    flat = enough & (F.coalesce("_st.s", F.lit(0.0)) < min_scale)
    t = t.withColumns({
        "normalization_status": F.when(~enough, "insufficient_support")
        .when(flat, "near_flat_or_too_low_scale").otherwise("ok"),
        "shape_center": F.when(enough, F.col("_st.c")),
        "shape_scale": F.when(enough, F.col("_st.s")),
    })
    nonflat = (F.col("normalization_status") == "ok") & (F.col("support_fraction") >= min_support)
    blank = F.transform(v, lambda e: F.lit(None).cast("double"))
    return t.withColumns({
        "nonflat": nonflat, out: F.when(nonflat, F.col("_st.shape")).otherwise(blank),
    }).drop("_n", "_st")


def similarity(a: Column, b: Column, min_share: float = 0.60, min_points: int = 5) -> Column:
    """Struct `(similarity, shared_fraction, n_shared)`: Pearson over the points both profiles have."""
    both = F.filter(
        F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    zero = F.lit(0.0)

    def around(pairs: Column, m: Column) -> Column:
        start = F.struct(zero.alias("xx"), zero.alias("yy"), zero.alias("xy"))
        sums = F.aggregate(pairs, start, lambda s, p: F.struct(
            (s["xx"] + (p["x"] - m["x"]) * (p["x"] - m["x"])).alias("xx"),
            (s["yy"] + (p["y"] - m["y"]) * (p["y"] - m["y"])).alias("yy"),
            (s["xy"] + (p["x"] - m["x"]) * (p["y"] - m["y"])).alias("xy")))
        share = m["n"] / F.greatest(F.size(a), F.lit(1))
        ok = (share >= min_share) & (m["n"] >= min_points)
        return let(sums, lambda s: F.struct(
            F.when(ok & (s["xx"] * s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])).alias("similarity"),
            share.alias("shared_fraction"), m["n"].alias("n_shared")))

    def centred(pairs: Column) -> Column:
        total = F.aggregate(pairs, F.struct(zero.alias("x"), zero.alias("y")), lambda s, p: F.struct(
            (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
        n = F.size(pairs)
        means = let(total, lambda t: F.struct(F.try_divide(t["x"], n).alias("x"), F.try_divide(t["y"], n).alias("y"), n.alias("n")))
        return let(means, lambda m: around(pairs, m))

    return let(both, centred)


# ------------------------------------------------------------------ samples and medoids


def evenly_spaced(
    df: DataFrame, keys: list[str], order: list[str], max_n: int, hot_rows: int = HOT_ROWS, chunk_rows: int | None = None
) -> DataFrame:
    """All rows of small groups; of larger ones the rounded positions of an even spread of `max_n`."""
    o = order_rows(df, keys, order, "_ix", hot_rows, chunk_rows).with_length("_n")
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(max_n - 1)),
        lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max_n - 1))).cast("long"))
    sizes = o.df.select(*o.keys, "_n").distinct().filter(F.col("_n") > max_n)
    wanted = sizes.select(*o.keys, F.explode(F.array_distinct(spaced)).alias("_ix"))
    small = o.df.filter(F.col("_n") <= max_n)
    picked = o.df.filter(F.col("_n") > max_n).join(wanted, [*o.keys, "_ix"], "left_semi")
    return small.unionByName(picked).select(*df.columns)


def similarity_to_medoid(
    profiles: DataFrame, medoid_table: DataFrame, keys: list[str], item: str, shape: str
) -> DataFrame:
    """Every profile against the medoid of its track; one medoid row per track is attached."""
    heads = medoid_table.select(*keys, "medoid").join(
        profiles.select(*keys, F.col(item).alias("medoid"), F.col(shape).alias("_m")), [*keys, "medoid"])
    both = attach(profiles, heads, keys)
    return both.withColumn("_s", similarity(F.col(shape), F.col("_m"))).select(
        *profiles.columns, "medoid",
        F.col("_s.similarity").alias("similarity_to_medoid"),
        F.col("_s.shared_fraction").alias("shared_fraction"), F.col("_s.n_shared").alias("n_shared"))


def low_coherence(
    sims: DataFrame, keys: list[str], position: str, item: str, threshold: float = 0.50, min_span: float = 1.0, **sizes
) -> DataFrame:
    """Stretches of included profiles with low similarity to the medoid, numbered over all tracks."""
    o = order_rows(sims, keys, [position, item], "_ix", **sizes)
    o = mark_runs(o, F.col("similarity_to_medoid") < threshold)
    rows = o.where(F.col("run_start").isNotNull())
    by = [*keys, "run_start"]
    spans = rows.groupBy(*by).agg(
        F.min(position).alias("x_min"), F.max(position).alias("x_max"), F.count(F.lit(1)).alias("n_profiles"),
        F.min("similarity_to_medoid").alias("min_similarity"))
    wide = spans.withColumn("x_span", F.col("x_max") - F.col("x_min")).filter(F.col("x_span") >= min_span)
    mid = medians(rows.join(wide.select(*by), by, "left_semi"), by, {"median_similarity": "similarity_to_medoid"}, **{
        k: v for k, v in sizes.items() if k == "hot_rows"})
    kept = wide.join(mid, by)
    numbered = order_rows(kept, [], [*keys, "run_start"], "_number").df
    name = F.format_string("track_%s_lowcoherence_%02d", F.col(keys[0]).cast("string"), (F.col("_number") + 1).cast("int"))
    return numbered.select(
        *keys, name.alias("regime_id"), "x_min", "x_max", "x_span", "n_profiles", "median_similarity",
        "min_similarity", F.lit(threshold).alias("threshold_used"))


def coherence_summary(table: DataFrame, sims: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per track: eligibility and fallback shares, similarity to the medoid, similarity of all pairs.

    `table` holds a row per profile with `eligible`, `fallback` and `nonflat`; a profile is included if it is eligible and
    not flat. `sims` holds the similarity to the medoid of the included ones, `pairs` the summary of all pairs. Missing
    flags count as false; a track without included profiles keeps its row.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = lambda c: c.cast("long")
    share = lambda a, b: F.when(b > 0, a / b)
    counts = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(one(flag("eligible"))).alias("n_eligible"),
        F.sum(one(flag("eligible") & flag("nonflat"))).alias("n_included"), F.sum(one(flag("fallback"))).alias("_fb"),
        F.sum(one(flag("fallback") & flag("eligible"))).alias("_fbe"))
    n, e, i = (F.col(c) for c in ("n_total", "n_eligible", "n_included"))
    names = ("p10", "p50", "p90")
    spread = percentiles(sims, keys, {"_q": "similarity_to_medoid"}, [0.1, 0.5, 0.9]).join(
        sims.groupBy(*keys).agg(F.avg("similarity_to_medoid").alias("medoid_mean")), keys)
    within = pairs.select(*keys, F.col("n_pairs").alias("within_n_pairs"), *[
        F.col(c).alias(f"within_{c}") for c in ("p10", "p25", "p50", "p75", "p90", "mean")])
    return counts.join(spread, keys, "left").join(within, keys, "left").select(
        *keys, "n_total", "n_eligible", "n_included", (e / n).alias("eligible_fraction"), (i / n).alias("included_fraction"),
        (i / F.greatest(e, F.lit(1))).alias("included_of_eligible"), (F.col("_fb") / n).alias("fallback_fraction"),
        share(F.col("_fbe"), e).alias("fallback_of_eligible"),
        *[F.get("_q", F.lit(k)).alias(f"medoid_{name}") for k, name in enumerate(names)], "medoid_mean",
        F.coalesce("within_n_pairs", F.lit(0)).alias("within_n_pairs"), *[f"within_{c}" for c in ("p10", "p25", "p50", "p75", "p90", "mean")])


def representatives(
    profiles: DataFrame, medoid_table: DataFrame, regimes: DataFrame, keys: list[str], position: str, item: str, **sizes
) -> DataFrame:
    """`(keys, label, item, position)`: the profile nearest to each medoid and to the middle of each regime.

    `profiles` are those that may stand for others. Middles are matched by an ordered scan, so a track may have many
    regimes. A track without profiles has no representatives.
    """
    name = F.concat(F.lit("track_"), F.col(keys[0]).cast("string"), F.lit("_medoid"))
    heads = medoid_table.select(*keys, name.alias("label"), F.col("medoid_position").alias("target"))
    middles = regimes.select(*keys, F.col("regime_id").alias("label"), (0.5 * (F.col("x_min") + F.col("x_max"))).alias("target"))
    hit = nearest(heads.unionByName(middles), profiles.select(*keys, item, position), keys, "target", position, [item], ["target"], [item], prefix="_", **sizes)
    return hit.filter(F.col(f"_{item}").isNotNull()).select(*keys, "label", F.col(f"_{item}").alias(item), F.col("_matched_x").alias(position))


# ------------------------------------------------------------------ second moments and PCA


def ready_matrix(
    profiles: DataFrame, shape: str = "shape", min_share: float = 0.95
) -> tuple[DataFrame, DataFrame]:
    """Grid points present in enough profiles, and the profiles complete on all of them."""
    long = profiles.select(F.posexplode(shape).alias("y_index", "v"))
    shares = long.groupBy("y_index").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("finite_share"))
    retained = shares.filter(F.col("finite_share") >= min_share)
    # At most one row per grid point.
    order = retained.agg(F.array_sort(F.collect_list("y_index")).alias("_kept"))
    rows = attach(profiles, order, []).withColumn(
        "ready", F.transform("_kept", lambda i: F.get(F.col(shape), i)))
    return retained, rows.filter(F.forall("ready", lambda e: e.isNotNull()) & (F.size("ready") > 0)).drop("_kept")


SALTS = 64


def unpack(mean: bytes, triangle: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and full matrix of centred products from their packed forms."""
    m = np.frombuffer(mean)
    full = np.zeros((len(m), len(m)))
    full[np.triu_indices(len(m))] = np.frombuffer(triangle)
    return m, full + np.triu(full, 1).T


def merged(parts) -> tuple[int, np.ndarray, np.ndarray]:
    """One (n, mean, packed triangle) from several, each centred on its own mean."""
    n, mean, triangle = 0, None, None
    for k, m, t in parts:
        if not k:
            continue
        if not n:
            n, mean, triangle = k, m.copy(), t.copy()
            continue
        off = m - mean
        triangle += t + np.outer(off, off)[np.triu_indices(len(off))] * (n * k / (n + k))
        mean += off * (k / (n + k))
        n += k
    return n, mean, triangle


def without(whole: tuple, part: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, packed triangle) of `whole` less a part of it."""
    (n, mean, triangle), (k, m, t) = whole, part
    rest = n - k
    centre = (n * mean - k * m) / rest
    off = centre - m
    return rest, centre, triangle - t - np.outer(off, off)[np.triu_indices(len(off))] * (k * rest / n)


def _held_rows(held: dict, keys: list[str], kinds: list[pa.DataType], salt: int | None) -> pa.RecordBatch:
    head = [pa.array([key[i] for key in held], kind) for i, kind in enumerate(kinds)]
    salts = [] if salt is None else [pa.array([salt] * len(held), pa.int64())]
    tail = [pa.array([v[0] for v in held.values()], pa.int64()), *[pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in (1, 2)]]
    return pa.RecordBatch.from_arrays([*head, *salts, *tail], names=[*keys, *(["_salt"] if salts else []), "n", "mean", "triangle"])


def moments(df: DataFrame, keys: list[str], vector: str, max_groups_held: int = 64) -> DataFrame:
    """`(keys, n, mean, triangle)`: count, mean vector and centred product matrix of a vector column per key.

    A matrix is one value, its upper triangle packed as doubles. Each task adds up its own rows around their own mean
    (flushed when many groups are open); tasks' partial matrices merge by (key, salt), then by key, and are never
    taken apart, so rows do not move and no sum cancels.
    """
    everything = not keys
    if everything:
        df, keys = df.withColumn("_everything", F.lit(1)), ["_everything"]
    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("_v"))
    key_fields = rows.schema.fields[:-1]
    kinds = to_arrow_schema(StructType(key_fields)).types

    def add_up(batches):
        from pyspark import TaskContext

        held, salt = {}, TaskContext.get().partitionId() % SALTS
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
            order: dict = {}
            for i, name in enumerate(names):
                order.setdefault(name, []).append(i)
            for name, at in order.items():
                part = x[at]
                mean = part.mean(axis=0)
                products = (part - mean).T @ (part - mean)
                held[name] = merged([*([held[name]] if name in held else []), (len(at), mean, products[np.triu_indices(len(mean))])])
            if len(held) > max_groups_held:
                yield _held_rows(held, keys, kinds, salt)
                held = {}
        if held:
            yield _held_rows(held, keys, kinds, salt)

    salted = StructType([*key_fields]).add("_salt", "long").add("n", "long").add("mean", "binary").add("triangle", "binary")
    out = merge_moments(rows.mapInArrow(add_up, salted), keys)
    return out.drop("_everything") if everything else out


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge partial moments by (keys, `_salt`), then by keys; without keys everything is one row."""
    by = keys or ["_one"]
    if not keys:
        parts = parts.withColumn("_one", F.lit(1))
    fields = [f for f in parts.schema.fields if f.name in by]
    types = to_arrow_schema(StructType(fields)).types

    def level(grouped: list[str], kinds: list[pa.DataType]):
        def add(table: pa.Table) -> pa.Table:
            columns = [table.column(c).to_pylist() for c in ("n", "mean", "triangle")]
            one = merged((n, np.frombuffer(m), np.frombuffer(t)) for n, m, t in zip(*columns))
            name = tuple(table.column(c)[0].as_py() for c in grouped)
            return pa.Table.from_batches([_held_rows({name: one}, grouped, kinds, None)])

        return add

    salted = StructType([*fields]).add("_salt", "long")
    tail = lambda head: StructType(head.fields).add("n", "long").add("mean", "binary").add("triangle", "binary")
    first = parts.groupBy(*by, "_salt").applyInArrow(level([*by, "_salt"], [*types, pa.int64()]), tail(salted))
    whole = first.groupBy(*by).applyInArrow(level(by, types), tail(StructType(fields)))
    return whole if keys else whole.drop("_one")


def fit_pca(ready: DataFrame, vector: str = "ready") -> tuple[DataFrame, DataFrame]:
    """Loadings `(component, explained_variance, explained_ratio, loading array)` and the mean row.

    One pass of second moments; the eigen-decomposition of that one matrix (dimension of the grid)
    runs in a task. Signs: the largest loading of a component is positive.
    """
    m = moments(ready, [], vector)

    def solve(batches):
        for pdf in batches:
            for n, packed_mean, triangle in zip(pdf["n"], pdf["mean"], pdf["triangle"]):
                centre, centred = unpack(packed_mean, triangle)
                d = len(centre)
                values, vectors = np.linalg.eigh(centred)
                order = np.argsort(values)[::-1]
                values, vectors = np.clip(values[order], 0, None), vectors[:, order]
                top = np.abs(vectors).argmax(axis=0)
                vectors = vectors * np.sign(vectors[top, np.arange(d)])
                k = min(n - 1, d) if n > 1 else 0
                total = values.sum()
                yield pd.DataFrame({
                    "component": np.arange(1, k + 1), "explained_variance": values[:k] / max(n - 1, 1),
                    "explained_ratio": values[:k] / total if total > 0 else np.zeros(k),
                    "loading": list(vectors[:, :k].T), "mean": [centre.tolist()] * k})

    fitted = m.mapInPandas(
        solve, "component long, explained_variance double, explained_ratio double, loading array<double>, mean array<double>")
    return fitted.drop("mean"), fitted.filter("component = 1").select("mean")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)


def project(
    profiles: DataFrame, loadings: DataFrame, mean: DataFrame, n: int = 5, vector: str = "ready", prefix: str = "pc"
) -> DataFrame:
    """Scores on a frozen basis; null unless every retained point is present.

    The basis is `n` arrays of grid length, attached as a single row.
    """
    basis = loadings.filter(F.col("component") <= n).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "loading"))), lambda e: e["loading"]).alias("_basis"))
    both = attach(attach(profiles, basis, []), mean.select(F.col("mean").alias("_mean")), [])
    v = F.col(vector)
    complete = v.isNotNull() & F.forall(v, lambda e: e.isNotNull()) & (F.size(v) > 0)
    centred = F.zip_with(v, "_mean", lambda x, m: x - m)
    return both.withColumn("_x", F.when(complete, centred)).withColumns({
        f"{prefix}{i + 1}": F.when(complete, dot(F.col("_x"), F.get("_basis", F.lit(i)))) for i in range(n)
    }).drop("_x", "_basis", "_mean")


def reconstruction_errors(
    ready: DataFrame, loadings: DataFrame, mean: DataFrame, keys: list[str], ks: list[int], vector: str = "ready"
) -> DataFrame:
    """RMSE of each profile rebuilt with k components: residual energy after the first k scores."""
    k_max = max(ks)
    scored = project(ready, loadings, mean, k_max, vector, "_pc")
    scored = attach(scored, mean.select(F.col("mean").alias("_mean")), [])
    energy = F.aggregate(F.zip_with(vector, "_mean", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, e: s + e)
    scores = F.array(*[F.col(f"_pc{i + 1}") for i in range(k_max)])
    t = scored.withColumns({"_e": energy, "_s": scores, "_d": F.size(vector)})
    used = lambda k: F.aggregate(F.slice("_s", 1, k), F.lit(0.0), lambda s, e: s + F.coalesce(e, F.lit(0.0)) * F.coalesce(e, F.lit(0.0)))
    rows = t.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(k).alias("n_components"),
                 F.sqrt(F.greatest(F.col("_e") - used(k), F.lit(0.0)) / F.col("_d")).alias("rmse")) for k in ks])).alias("e"))
    return rows.select(*keys, "e.*")


def rebuild(scores: Column, basis: Column, mean: Column) -> Column:
    """Profile rebuilt from scores on the first basis arrays."""
    start = mean
    pairs = F.arrays_zip(scores.alias("s"), F.slice(basis, 1, F.size(scores)).alias("b"))
    return F.aggregate(pairs, start, lambda acc, p: F.zip_with(acc, p["b"], lambda a, b: a + b * p["s"]))


def regime_preservation(
    ready: DataFrame, loadings: DataFrame, mean: DataFrame, keys: list[str], item: str,
    references: DataFrame, ks: list[int], vector: str = "ready", distinct_below: float = 0.5,
) -> DataFrame:
    """Correlation of rebuilt regime and medoid profiles for several numbers of components.

    `references` lists per key the items to compare: `label, item, medoid`.
    """
    k_max = max(ks)
    scored = project(ready, loadings, mean, k_max, vector, "_pc")
    s = scored.select(*keys, item, F.array(*[F.col(f"_pc{i + 1}") for i in range(k_max)]).alias("_s"))
    left = references.join(s.withColumnRenamed("_s", "_a"), [*keys, item])
    right = left.join(s.select(*keys, F.col(item).alias("medoid"), F.col("_s").alias("_b")), [*keys, "medoid"])
    basis = loadings.filter(F.col("component") <= k_max).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "loading"))), lambda e: e["loading"]).alias("_basis"))
    both = attach(attach(right, basis, []), mean.select(F.col("mean").alias("_mean")), [])
    rows = both.withColumn("n_components", F.explode(F.array(*[F.lit(k) for k in ks])))
    cut = lambda c: rebuild(F.slice(F.col(c), F.lit(1), F.col("n_components")), F.col("_basis"), F.col("_mean"))
    rows = rows.withColumn("_r", similarity(cut("_a"), cut("_b"), 0.0, 2)["similarity"])
    return rows.select(*keys, "label", item, "medoid", "n_components", F.col("_r").alias("correlation"),
                       (F.col("_r") < distinct_below).alias("remains_distinct"))


def loading_summary(loadings: DataFrame, y: list[float]) -> DataFrame:
    """Left, right, centre and edge means and sign changes of each component."""
    centre = 0.5 * (y[0] + y[-1])
    table = loadings.select("component", "explained_ratio", F.posexplode("loading").alias("i", "v"))
    at = F.get(F.array(*[F.lit(float(v)) for v in y]), F.col("i"))
    o = order_rows(table.withColumn("y", at), ["component"], ["i"], "_i", bounded=True)
    o = o.rolling(1, 0, lambda w: {"_flip": F.coalesce((F.signum("v") != F.signum(F.lag("v").over(w))).cast("int"), F.lit(0))})
    mid = F.col("y").between(centre - 0.10, centre + 0.10)
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    return o.df.groupBy("component").agg(
        F.first("explained_ratio").alias("explained_ratio"),
        mean(F.col("y") <= centre).alias("left_mean"), mean(F.col("y") > centre).alias("right_mean"),
        mean(mid).alias("center_mean"), mean(~mid).alias("edge_mean"), F.sum("_flip").alias("sign_changes"))


def grid_alignment(retained_y: DataFrame, full_y: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row: retained grid points against the full grid by index."""
    both = retained_y.select("y_index", F.col("y_mm").alias("_r")).join(full_y.select("y_index", F.col("y_mm").alias("_f")), "y_index", "left")
    gap = F.abs(F.col("_r") - F.col("_f"))
    return both.agg(F.count(F.lit(1)).alias("n_points"), F.max(gap).alias("max_gap"),
                    F.coalesce(F.min((gap <= tolerance).cast("int")) == 1, F.lit(False)).alias("aligned"))


def nearest_item(profiles: DataFrame, targets: DataFrame, keys: list[str], position: str, item: str) -> DataFrame:
    """Item nearest to each labelled target position; a target is compared with its own track only.

    Targets are a handful of named positions per track.
    """
    both = profiles.select(*keys, item, position).join(targets, keys)
    gap = F.abs(F.col(position) - F.col("target"))
    return both.groupBy(*keys, "label").agg(
        F.min_by(F.struct(item, position), F.struct(gap, F.col(item))).alias("b")).select(*keys, "label", "b.*")
