"""Data contracts: checks that raise, and audits that return tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.config import ROW_IDENTITY, TARGET_GROUPS
from trackgeo.operators.layout import attach


class ContractError(ValueError):
    """A table breaks a rule the next step relies on."""


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities become null, so that every aggregate skips them."""
    return df.withColumns({c: finite_or_null(F.col(c)) for c in columns})


def finite_or_null(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"{what} lacks columns {missing}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if not df.limit(1).count():
        raise ContractError(f"{what} is empty")
    return df


def key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, rows with a null key, keys that repeat, surplus rows."""
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).alias("null_key_rows"),
        F.coalesce(F.sum((F.col("_n") > 1).cast("long")), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
    )


def duplicate_examples(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """First `k` repeated keys in key order, for an error message."""
    return df.groupBy(*keys).count().filter("count > 1").orderBy(*keys).limit(k)


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    row = key_report(df, keys).first()
    if row["null_key_rows"] or row["duplicate_keys"]:
        examples = [tuple(r)[:-1] for r in duplicate_examples(df, keys).collect()]
        raise ContractError(f"{what}: {row.asDict()}, such as {examples}")
    return df


def finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per column that are missing or not finite, from one pass."""
    counts = df.agg(
        *[
            F.sum(finite_or_null(F.col(c)).isNull().cast("long")).alias(c)
            for c in columns
        ]
    )
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, n_not_finite)")


def require_finite(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    bad = [tuple(r) for r in finite_report(df, columns).filter("n_not_finite > 0").collect()]
    if bad:
        raise ContractError(f"{what}: not finite {bad}")
    return df


def group_sizes(df: DataFrame, keys: list[str], expected: DataFrame | int) -> DataFrame:
    """Rows per group against the expected number; missing groups show with 0."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    if isinstance(expected, int):
        table = counts.withColumn("expected_rows", F.lit(expected))
    else:
        table = expected.join(counts, keys, "left").withColumn(
            "n_rows", F.coalesce("n_rows", F.lit(0))
        )
    return table.withColumn("as_expected", F.col("n_rows") == F.col("expected_rows"))


def null_audit(
    df: DataFrame, keys: list[str], allowed: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Nulls per column split by a rule that says where they may occur, and the offending cells.

    `allowed` maps each audited column to the condition under which a null is expected.
    """
    flags = df.select(
        *keys,
        *[
            F.struct(
                F.col(c).isNull().alias("missing"),
                F.coalesce(rule, F.lit(False)).alias("expected"),
            ).alias(c)
            for c, rule in allowed.items()
        ],
    )
    cells = flags.unpivot(keys, list(allowed), "column_name", "cell")
    missing, expected = F.col("cell.missing"), F.col("cell.expected")
    report = cells.groupBy("column_name").agg(
        F.sum(missing.cast("long")).alias("nulls"),
        F.sum((missing & expected).cast("long")).alias("expected_nulls"),
        F.sum((missing & ~expected).cast("long")).alias("unexpected_nulls"),
    )
    return report, cells.filter(missing & ~expected).select(*keys, "column_name")


def target_validity(df: DataFrame, targets: list[str], ready: str | None) -> DataFrame:
    """One row: rows with a null target, and rows that are not flagged ready."""
    any_null = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in targets])
    not_ready = ~F.coalesce(F.col(ready), F.lit(False)) if ready else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(any_null.cast("long")).alias("null_target_rows"),
        F.sum(not_ready.cast("long")).alias("not_ready_rows"),
    )


def sealed_guard(df: DataFrame, key: str, sealed: list[int], what: str = "table") -> DataFrame:
    """Reject rows of sealed groups when they are read: the check travels with the plan."""
    message = F.lit(f"{what} holds rows of a sealed group")
    return df.withColumn(
        key, F.when(F.col(key).isin(sealed), F.raise_error(message)).otherwise(F.col(key))
    )


def missing_groups(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def order_contract(
    samples: DataFrame, source: DataFrame, keys: list[str], position: str, tolerance: float = 1e-12
) -> DataFrame:
    """One row: sample count, samples without a source row, position drift beyond `tolerance`."""
    src = source.select(*keys, F.col(position).alias("_src"))
    both = samples.join(src, keys, "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(F.col("_src").isNull().cast("long")).alias("without_source"),
        F.sum((F.abs(F.col(position) - F.col("_src")) > tolerance).cast("long")).alias("drifted"),
    )


def align_targets(
    meta: DataFrame, dataset: DataFrame, group: str, keys: list[str] = ROW_IDENTITY,
    groups: dict[str, tuple[list[str], list[str]]] = TARGET_GROUPS,
) -> DataFrame:
    """`meta` with the targets and validity columns of one target group, joined on the exact row identity.

    Raises where a key repeats on either side, a row of `meta` has no target row, or a target is null.
    """
    if group not in groups:
        raise ContractError(f"unknown target group {group}; there are {sorted(groups)}")
    targets, validity = groups[group]
    require_columns(meta, keys, "metadata")
    require_columns(dataset, [*keys, *targets, *validity], "target table")
    require_unique(meta, keys, "metadata")
    require_unique(dataset, keys, "target table")
    wanted = dataset.select(*keys, *targets, *validity, F.lit(True).alias("_hit"))
    joined = meta.drop(*targets, *validity).join(wanted, keys, "left")
    complain = lambda what: F.raise_error(F.concat(F.lit(f"{what} at "), F.to_json(F.struct(*keys))))
    found = F.coalesce(F.col("_hit"), complain("no target row").cast("boolean"))
    return joined.withColumns({
        t: F.when(found, F.coalesce(F.col(t), complain(f"{t} is missing").cast(joined.schema[t].dataType))) for t in targets}).drop("_hit")


def target_group_report(
    dataset: DataFrame, groups: dict[str, tuple[list[str], list[str]]] = TARGET_GROUPS
) -> DataFrame:
    """Per target group: rows, rows with a null target, rows with a null validity column, rows whose flags all hold."""
    any_null = lambda names: reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    kinds = dict(dataset.dtypes)

    def held(names: list[str]) -> Column:
        flags = [F.col(n) for n in names if kinds[n] == "boolean" and n != "fallback_baseline_required"]
        return F.coalesce(reduce(lambda a, b: a & b, flags, F.lit(True)), F.lit(False))

    rows = dataset.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("target_group"), any_null(t).alias("no_target"), any_null(v).alias("no_validity"), held(v).alias("held"))
        for g, (t, v) in groups.items()])).alias("e")).select("e.*")
    total = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("target_group").agg(
        F.count("*").alias("n_rows"), total(F.col("no_target")).alias("null_target_rows"),
        total(F.col("no_validity")).alias("null_validity_rows"), total(F.col("held")).alias("flagged_rows"),
        total(F.col("held") & ~F.col("no_target")).alias("usable_rows"))


def model_contract(
    loadings: DataFrame, mean: DataFrame, min_components: int = 5, y_grid: list[float] | None = None
) -> DataFrame:
    """One row of checks on a frozen linear model of arrays (`loading` per component, one `mean`).

    Counts, widths against the mean (and the grid, where given), and finite values everywhere; a missing mean fails.
    """
    bad = lambda c: F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    width = F.size("loading")
    shape = loadings.agg(
        F.count(F.lit(1)).alias("n_components"), F.countDistinct("component").alias("n_distinct"),
        F.min(width).alias("min_points"), F.max(width).alias("max_points"),
        F.coalesce(F.sum(F.coalesce(bad("loading"), F.lit(True)).cast("long")), F.lit(0)).alias("bad_loadings"))
    centre = mean.agg(
        F.count(F.lit(1)).alias("n_means"), F.max(F.size("mean")).alias("n_points"),
        F.coalesce(F.sum(F.coalesce(bad("mean"), F.lit(True)).cast("long")), F.lit(0)).alias("bad_means"))
    table = attach(shape, centre, [])
    on_grid = F.lit(True) if y_grid is None else (F.col("n_points") == len(y_grid)) & F.lit(all(map(math.isfinite, y_grid)))
    ok = ((F.col("n_components") >= min_components) & (F.col("n_distinct") == F.col("n_components"))
          & (F.col("min_points") == F.col("n_points")) & (F.col("max_points") == F.col("n_points"))
          & (F.col("bad_loadings") == 0) & (F.col("n_means") == 1) & (F.col("bad_means") == 0) & on_grid)
    return table.withColumn("passed", F.coalesce(ok, F.lit(False))).drop("n_distinct", "n_means")


def json_object(**columns: Column) -> Column:
    """The named values as one JSON text with sorted names; missing values show as null."""
    return F.to_json(F.struct(*[columns[n].alias(n) for n in sorted(columns)]), {"ignoreNullFields": "false"})


def overall(checks: DataFrame, passed: str = "passed") -> DataFrame:
    """All checks passed, with the number that did not."""
    return checks.agg(
        F.min(F.col(passed).cast("int")).cast("boolean").alias("passed"),
        F.sum((~F.col(passed)).cast("long")).alias("n_failed"),
        F.count(F.lit(1)).alias("n_checks"),
    )
