"""Regression on windows of tables: leave-one-group-out folds from one pass of second moments.

Least squares, ridge and Bayesian ridge need the windows only through their second moments. Those
are summed once per fold group; the training moments of a fold are the total less its own group,
every feature group is a sub-block, every model a small solve on the same matrix. Solves run in
tasks, one per fold; predictions are a projection of the windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.functions.scores import unit_position
from trackgeo.operators.contracts import ContractError
from trackgeo.operators.layout import attach, order_rows
from trackgeo.operators.profiles import SALTS, dot, merge_moments, moments, unpack, without
from trackgeo.operators.series import flatten_window, sliding_windows
from trackgeo.session import durable


def training_windows(
    rows: DataFrame, track: str, order: list[str], n: int, features: list[str], targets: list[str],
    fold: str, ready: str | None = None, coordinate: str | None = None, **sizes,
) -> DataFrame:
    """Windows with flattened features `x` and the last row's targets `y`.

    `ready` filters rows before windowing; `coordinate` appends the last row's normalised
    position to the vector.
    """
    if ready:
        rows = rows.filter(F.coalesce(F.col(ready), F.lit(False)))
    o = order_rows(rows, [track], order, "_ix", **sizes)
    y = F.array(*[F.col(t).cast("double") for t in targets]) if targets else F.array().cast("array<double>")
    o = o.with_columns({"y": y})
    meta = list(dict.fromkeys([track, fold, *order, *([coordinate] if coordinate else []), "y"]))
    flat = flatten_window(sliding_windows(o, n, features, meta), out="x").drop("window")
    if coordinate:
        flat = flat.withColumn("x", F.concat("x", F.array(unit_position(F.col(coordinate)))))
    return flat


def scale_stats(rows: DataFrame, fold: str, features: list[str]) -> DataFrame:
    """Mean and population deviation of each feature over the rows outside each fold group."""
    centre = rows.agg(*[F.avg(f).alias(f"_o_{f}") for f in features])
    d = attach(rows.select(fold, *features), centre, [])
    gap = {f: F.col(f) - F.col(f"_o_{f}") for f in features}
    sums = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        sums += [F.sum(gap[f]).alias(f"_s_{f}"), F.sum(gap[f] * gap[f]).alias(f"_q_{f}")]
    own = d.groupBy(fold).agg(*sums)
    total = own.agg(*[F.sum(c).alias(f"t{c}") for c in own.columns if c != fold])
    t = attach(attach(own, total, []), centre, [])
    left = F.col("t_n") - F.col("_n")
    n = F.when(left > 0, left).otherwise(F.raise_error(F.lit("no training rows outside a fold")).cast("bigint"))
    out = [F.col(fold)]
    for f in features:
        s, q = F.col(f"t_s_{f}") - F.col(f"_s_{f}"), F.col(f"t_q_{f}") - F.col(f"_q_{f}")
        m = s / n
        sd = F.sqrt(F.greatest(q / n - m * m, F.lit(0.0)))
        out += [(F.col(f"_o_{f}") + m).alias(f"mean_{f}"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"std_{f}")]
    return t.select(*out)


def standardise(rows: DataFrame, train: Column, features: list[str]) -> DataFrame:
    """Features scaled with the mean and population deviation of the training rows only."""
    stats = rows.filter(train).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_d_{f}") for f in features])
    scaled = attach(rows, stats, [])
    return scaled.withColumns({
        f: (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_d_{f}") > 0, F.col(f"_d_{f}")).otherwise(1.0)
        for f in features
    }).drop(*[f"_{k}_{f}" for k in "md" for f in features])


def _bayesian_ridge(gram: np.ndarray, xy: np.ndarray, yy: float, n: int) -> np.ndarray:
    """Evidence-maximised ridge from second moments (MacKay's updates, weak Gamma priors)."""
    eig, vec = np.linalg.eigh(gram)
    eig = np.clip(eig, 0, None)
    rotated = vec.T @ xy
    noise, weight, prior = n / max(yy, 1e-300), 1.0, 1e-6
    old = None
    for _ in range(300):
        w = vec @ (rotated / (eig + weight / noise))
        rss = max(yy - 2 * w @ xy + w @ gram @ w, 0.0)
        used = np.sum(noise * eig / (weight + noise * eig))
        weight = (used + 2 * prior) / (w @ w + 2 * prior)
        noise = (n - used + 2 * prior) / (rss + 2 * prior)
        if old is not None and np.abs(old - w).sum() < 1e-3:
            break
        old = w
    return vec @ (rotated / (eig + weight / noise))


def solve_models(
    n: int, mean: np.ndarray, centred: np.ndarray, d: int, sigma: np.ndarray,
    groups: dict[str, list[int]], models: dict[str, float | str],
) -> list[tuple]:
    """Coefficients on the raw features for every feature group and model of one fold.

    `models` maps a name to a ridge penalty (0 is least squares with minimum norm) or "bayes".
    The intercept is not penalised: everything runs on centred moments.
    """
    gxx = centred[:d, :d] / np.outer(sigma, sigma)
    gxy = centred[:d, d:] / sigma[:, None]
    yy = np.diag(centred)[d:]
    out = []
    for group, at in groups.items():
        a, b = gxx[np.ix_(at, at)], gxy[at]
        for name, penalty in models.items():
            if penalty == "bayes":
                w = np.column_stack([_bayesian_ridge(a, b[:, j], yy[j], n) for j in range(b.shape[1])])
            elif penalty == 0:
                w = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
            else:
                w = np.linalg.solve(a + penalty * np.eye(len(at)), b)
            full = np.zeros((d, b.shape[1]))
            full[at] = w / sigma[at][:, None]
            out.append((group, name, full.T.tolist(), (mean[d:] - mean[:d] @ full).tolist()))
    return out


def _group_indexes(groups: dict[str, list[str]], features: list[str], n: int, extra: int) -> dict[str, list[int]]:
    k = len(features)
    out = {}
    for name, members in groups.items():
        missing = set(members) - set(features)
        if missing:
            raise ContractError(f"feature group {name} lacks {sorted(missing)}")
        at = [features.index(m) for m in members]
        out[name] = [t * k + i for t in range(n) for i in at] + [n * k + e for e in range(extra)]
    return out


def _solve_rows(fold: str, fold_type: str, d: int, k: int, n_steps: int, extra: int, groups, models):
    ddl = f"`{fold}` {fold_type}, feature_group string, model string, coef array<array<double>>, intercept array<double>, n_train long"

    def solve(batches):
        for pdf in batches:
            rows = []
            for key, sd, n, mean, triangle, tn, tmean, ttriangle in zip(*[pdf[c] for c in (
                    fold, "sigma", "n", "mean", "triangle", "tn", "tmean", "ttriangle")]):
                if tn == n:
                    raise ValueError(f"no training rows outside {fold} {key}")
                sigma = np.r_[np.tile(np.asarray(sd, float), n_steps), np.ones(extra)]
                own = (n, np.frombuffer(mean), np.frombuffer(triangle))
                whole = (tn, np.frombuffer(tmean), np.frombuffer(ttriangle))
                n_train, centre, packed = without(whole, own) if n else whole
                centre, centred = unpack(centre.tobytes(), packed.tobytes())
                for g, m, coef, b in solve_models(int(n_train), centre, centred, d, sigma, groups, models):
                    rows.append((key, g, m, coef, b, int(n_train)))
            yield pd.DataFrame(rows, columns=[fold, "feature_group", "model", "coef", "intercept", "n_train"])

    return solve, ddl


def fold_models(
    windows: DataFrame, rows: DataFrame, fold: str, features: list[str], n_steps: int,
    groups: dict[str, list[str]], models: dict[str, float | str], extra: int = 0,
) -> DataFrame:
    """One coefficient row per held-out group, feature group and model."""
    k, d = len(features), len(features) * n_steps + extra
    own = durable(moments(windows.withColumn("_xy", F.concat("x", "y")), [fold], "_xy"))
    total = merge_moments(own.drop(fold).withColumn("_salt", F.pmod(F.xxhash64("mean"), F.lit(SALTS))), [])
    stats = scale_stats(rows, fold, features)
    sigma = stats.select(fold, F.array(*[F.col(f"std_{f}") for f in features]).alias("sigma"))
    train = attach(own, total.toDF("tn", "tmean", "ttriangle"), []).join(sigma, fold)
    at = _group_indexes(groups, features, n_steps, extra)
    solve, ddl = _solve_rows(fold, dict(windows.dtypes)[fold], d, k, n_steps, extra, at, models)
    return train.mapInPandas(solve, ddl)


def split_models(
    train_windows: DataFrame, train_rows: DataFrame, features: list[str], n_steps: int,
    groups: dict[str, list[str]], models: dict[str, float | str], extra: int = 0,
) -> DataFrame:
    """Coefficients fitted on all given windows (a fixed split); `split` is always 0."""
    k, d = len(features), len(features) * n_steps + extra
    m = moments(train_windows.withColumn("_xy", F.concat("x", "y")), [], "_xy")
    sd = train_rows.agg(F.array(*[
        F.when(F.stddev_pop(f) > 0, F.stddev_pop(f)).otherwise(F.lit(1.0)) for f in features]).alias("sigma"))
    at = _group_indexes(groups, features, n_steps, extra)
    solve, ddl = _solve_rows("split", "int", d, k, n_steps, extra, at, models)
    none = {"n": F.lit(0).cast("long"), "mean": F.lit(b""), "triangle": F.lit(b"")}
    whole = attach(m.toDF("tn", "tmean", "ttriangle"), sd, []).withColumns({"split": F.lit(0), **none})
    return whole.mapInPandas(solve, ddl)


def predict(windows: DataFrame, models: DataFrame, fold: str | None, targets: list[str]) -> DataFrame:
    """Predicted targets of every window by the models of its fold (or of the only split)."""
    m = models.select(*([fold] if fold else []), "feature_group", "model", "coef", "intercept")
    if fold:
        both = windows.join(m, fold)
    else:
        one = m.agg(F.collect_list(F.struct("feature_group", "model", "coef", "intercept")).alias("_m"))
        both = attach(windows, one, []).withColumn("_e", F.explode("_m")).select("*", "_e.*").drop("_m", "_e")
    return both.withColumns({
        f"predicted_{t}": dot(F.get("coef", F.lit(i)), F.col("x")) + F.get("intercept", F.lit(i))
        for i, t in enumerate(targets)
    }).drop("coef", "intercept")


def scored_long(predictions: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """Long `(keys, target, actual, predicted)` from predictions that still carry `y`; a missing target raises."""
    items = F.array(*[
        F.struct(F.lit(t).alias("target"), F.coalesce(F.get("y", F.lit(i)), F.raise_error(F.lit(f"{t} is missing in an evaluation row")))
                 .alias("actual"), F.col(f"predicted_{t}").alias("predicted")) for i, t in enumerate(targets)])
    return predictions.select(*keys, F.explode(items).alias("e")).select(*keys, "e.*")


def constant_predictions(windows: DataFrame, fold: str, targets: list[str]) -> DataFrame:
    """Predict the mean target of the training groups: total less the held-out group."""
    long = windows.select(fold, F.posexplode("y").alias("i", "v"))
    own = long.groupBy(fold, "i").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    total = own.groupBy("i").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    mean = own.join(total, "i").select(fold, "i", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("m"))
    wide = mean.groupBy(fold).agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"predicted_{t}") for i, t in enumerate(targets)])
    return attach(windows, wide, [fold])


def forest(
    train: DataFrame, evaluate: DataFrame, targets: list[str], names: list[str], trees: int = 300,
    min_leaf: int = 2, depth: int = 12, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Random forest per target; predictions and the importance of every flattened feature.

    Importances are averaged over targets and ranked.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    spark = train.sparkSession
    data = train.withColumn("_features", array_to_vector("x"))
    out = evaluate.withColumn("_features", array_to_vector("x"))
    weights = []
    for i, t in enumerate(targets):
        model = RandomForestRegressor(
            featuresCol="_features", labelCol="_label", predictionCol=f"predicted_{t}", numTrees=trees,
            minInstancesPerNode=min_leaf, maxDepth=depth, featureSubsetStrategy="all", seed=seed,
        ).fit(data.withColumn("_label", F.get("y", F.lit(i))))
        out = model.transform(out)
        weights.append(model.featureImportances.toArray())
    mean = np.mean(weights, axis=0)
    order = np.argsort(-mean, kind="stable")
    table = spark.createDataFrame(
        [(r + 1, names[j], names[j].split("_", 1)[1], int(names[j].split("_", 1)[0][1:]), float(mean[j])) for r, j in enumerate(order)],
        "importance_rank int, flattened_feature string, feature_name string, timestep int, importance double")
    return out.drop("_features"), table


def modality(feature: str, thermal: list[str]) -> Column:
    return F.when(F.col(feature).isin(thermal), "thermal").otherwise("sem")


def check_importances(table: DataFrame, n_expected: int) -> DataFrame:
    """One row: importances complete, finite and summing to one."""
    v = F.col("importance")
    return table.agg(
        F.count(F.lit(1)).alias("n_features"), F.sum(v).alias("importance_sum"),
        ((F.count(F.lit(1)) == n_expected) & (F.sum(F.isnan(v).cast("int")) == 0) & (F.abs(F.sum(v) - 1.0) < 1e-6)).alias("passed"))


def delta_to_reference(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Metric differences b − a of two model tables on the same keys."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_reference") for c in names])
    right = b.select(*keys, *[F.col(c).alias(c) for c in names])
    return left.join(right, keys).withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_reference") for c in names})
