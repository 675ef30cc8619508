"""Similarities between all profiles of a track or of two tracks, and the medoid, without a row per pair.

Profiles are dealt into chunks, and two chunks meet as matrix products of `BLOCK` rows a side in one task. A key has
`CHUNKS` chunks once it is longer than that many blocks of `SIDE_ROWS`, so a profile is sent a few times whatever the length of
its key, until chunks reach `MOST_ROWS`. What leaves the task is counts of similarities by bucket. The counts of all tasks name the
buckets that hold the wanted ranks, and a second product lets out only the values in these, so percentiles are exact.
Buckets get finer with the longest key, so these values grow with the rows. Products grow with the square of a track, as
a percentile over pairs asks for; rows do not.

The medoid needs the median of few profiles. A few heads get exact medians. Against the best of them each other profile counts two
numbers, its similarities and those that reach the best; a profile for which fewer than half reach it cannot be the medoid. The
rest is the next field of candidates, from which heads are drawn until none is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackgeo.operators.layout import attach
from trackgeo.operators.stats import rank_buckets, values_at_ranks
from trackgeo.session import durable

BLOCK, HEADS = 1024, 32
CHUNKS, SIDE_ROWS, MOST_ROWS = 4, 8192, 65536
STEPS, HEAD_STEPS = 4096, 128  # buckets per unit of similarity: of all pairs, of the few heads
TIE = 1e-12  # medians this close are equal
MIN_SHARE, MIN_POINTS = 0.60, 5
SUMMARY = (0.10, 0.25, 0.50, 0.75, 0.90)


# ------------------------------------------------------------------ inside a task


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, NaN where an element is missing."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def block_similarity(a: np.ndarray, b: np.ndarray, min_share: float, min_points: int) -> np.ndarray:
    """Masked Pearson of every row of `a` with every row of `b`; NaN where support lacks."""
    fa, fb = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
    za, zb = np.where(fa > 0, a, 0.0), np.where(fb > 0, b, 0.0)
    n = fa @ fb.T
    with np.errstate(invalid="ignore", divide="ignore"):
        sa, sb, sab = za @ fb.T, fa @ zb.T, za @ zb.T
        va = (za * za) @ fb.T - sa * sa / n
        vb = fa @ (zb * zb).T - sb * sb / n
        r = (sab - sa * sb / n) / np.sqrt(va * vb)
    ok = (n / a.shape[1] >= min_share) & (n >= min_points) & (va > 1e-12) & (vb > 1e-12)
    return np.where(ok, r, np.nan)


def _sides(table: pa.Table, params: dict) -> tuple[pa.Table, pa.Table, bool]:
    """Rows of both sides, and whether they are one chunk that meets itself."""
    side = table.column("_side").to_numpy()
    a = table.filter(pa.array(side == 0))
    within = params["within"] and bool(a.num_rows) and table.column("_a")[0] == table.column("_b")[0]
    return a, a if within else table.filter(pa.array(side == 1)), within


def _products(a: pa.Table, b: pa.Table, params: dict):
    """(first row of `a`, first row of `b`, similarities) of the blocks of two sides."""
    if not a.num_rows or not b.num_rows:
        return
    xa, xb = _matrix(a.column("_shape")), _matrix(b.column("_shape"))
    for i in range(0, len(xa), BLOCK):
        for j in range(0, len(xb), BLOCK):
            yield i, j, block_similarity(xa[i:i + BLOCK], xb[j:j + BLOCK], params["min_share"], params["min_points"])


def _labelled(table: pa.Table, params: dict):
    """(a side, how many labels it has, blocks of local label and similarity of every defined pair)."""
    a, b, within = _sides(table, params)
    labels = {"item": a.num_rows, "separation": len(params["edges"] or ()) - 1, "none": 1}[params["label"]]

    def blocks():
        for i, j, r in _products(a, b, params):
            if within and j < i:
                continue
            if within and i == j:
                r = np.where(np.triu(np.ones(r.shape, bool), 1), r, np.nan)
            m, n = slice(i, i + r.shape[0]), slice(j, j + r.shape[1])
            if params["label"] == "item":
                r = np.where(a.column("_item").to_numpy()[m, None] == b.column("_item").to_numpy()[None, n], np.nan, r)
                label = np.broadcast_to(np.arange(i, i + r.shape[0])[:, None], r.shape)
            elif params["label"] == "separation":
                edges = np.array(params["edges"])
                apart = np.round(np.abs(b.column("_x").to_numpy()[None, n] - a.column("_x").to_numpy()[m, None]), 9)
                label = np.searchsorted(edges, apart, side="left") - 1
                label = np.where(apart == edges[0], 0, label)
                r = np.where((label >= 0) & (label < len(edges) - 1), r, np.nan)
            else:
                label = np.zeros(r.shape, np.int64)
            fit = np.isfinite(r)
            yield label[fit].astype(np.int64), r[fit]

    return a, labels, blocks()


def _bucket(r: np.ndarray, steps: int) -> np.ndarray:
    return np.clip(np.floor((r + 1) * steps), 0, 2 * steps).astype(np.int64)


COUNTED = {"label": pa.int64(), "_bucket": pa.int64(), "_c": pa.int64(), "total": pa.float64()}
VALUES = {"label": pa.int64(), "_bucket": pa.int64(), "_v": pa.float64()}
REACHED = {"_item": pa.int64(), "_n": pa.int64(), "_reach": pa.int64(), "_above": pa.int64()}


def _nothing(table: pa.Table, keys: list[str], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.schema([*[table.schema.field(k) for k in keys], *kinds.items()]).empty_table()


def _rows(table: pa.Table, keys: list[str], columns: dict[str, np.ndarray]) -> pa.Table:
    n = len(next(iter(columns.values())))
    head = {k: pa.repeat(table.column(k)[0], n) for k in keys}
    return pa.table({**head, **{c: pa.array(v) if isinstance(v, np.ndarray) else v for c, v in columns.items()}})


def _counter(keys: list[str], params: dict):
    steps, span = params["steps"], 2 * params["steps"] + 1

    def count(table: pa.Table) -> pa.Table:
        a, labels, blocks = _labelled(table, params)
        c, total = np.zeros(labels * span, np.int64), np.zeros(labels * span)
        for label, r in blocks:
            code = label * span + _bucket(r, steps)
            c += np.bincount(code, minlength=len(c))
            total += np.bincount(code, weights=r, minlength=len(c))
        code = np.flatnonzero(c)
        if not len(code):
            return _nothing(table, keys, COUNTED)
        local = code // span
        return _rows(table, keys, {
            "label": a.column("_item").take(pa.array(local)) if params["label"] == "item" else local, "_bucket": code % span,
            "_c": c[code], "total": total[code]})

    return count


def _picker(keys: list[str], params: dict):
    steps, span = params["steps"], 2 * params["steps"] + 1

    def pick(table: pa.Table) -> pa.Table:
        a, labels, blocks = _labelled(table, params)
        wanted = np.zeros(labels * span, bool)
        want = a.column("_want").to_pylist()
        if params["label"] == "item":
            wanted[[n * span + w for n, some in enumerate(want) for w in some or ()]] = True
        elif want:
            wanted[list(want[0] or ())] = True
        codes, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for label, r in blocks:
            code = label * span + _bucket(r, steps)
            hit = wanted[code]
            codes.append(code[hit])
            values.append(r[hit])
        code = np.concatenate(codes)
        if not len(code):
            return _nothing(table, keys, VALUES)
        local = code // span
        return _rows(table, keys, {
            "label": a.column("_item").take(pa.array(local)) if params["label"] == "item" else local,
            "_bucket": code % span, "_v": np.concatenate(values)})

    return pick


def _reacher(keys: list[str], params: dict):
    """Similarities of each row, those that reach the best median (in `_x`), and those above it; of both sides if all meet all."""

    def reach(table: pa.Table) -> pa.Table:
        a, b, within = _sides(table, params)
        both = params["within"] and not within
        found = [np.zeros((3, t.num_rows), np.int64) for t in (a, b)]
        best = a.column("_x")[0].as_py() if a.num_rows else None
        if best is None or not b.num_rows:
            return _nothing(table, keys, REACHED)
        for i, j, r in _products(a, b, params):
            m, n = slice(i, i + r.shape[0]), slice(j, j + r.shape[1])
            r = np.where(a.column("_item").to_numpy()[m, None] == b.column("_item").to_numpy()[None, n], np.nan, r)
            for k, hit in enumerate((np.isfinite(r), r >= best - TIE, r > best + TIE)):
                found[0][k, m] += hit.sum(axis=1)
                if both:
                    found[1][k, n] += hit.sum(axis=0)
        sides = [(a, found[0]), (b, found[1])] if both else [(a, found[0])]
        return pa.concat_tables([_rows(table, keys, {
            "_item": t.column("_item"), "_n": f[0], "_reach": f[1], "_above": f[2]}) for t, f in sides])

    return reach


# ------------------------------------------------------------------ chunks that meet


def _chunked(profiles: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows with `_chunk` of `_chunks` by their item: `block` rows each, more where a key would have over `CHUNKS` chunks."""
    n = F.count("*")
    rows = F.least(F.greatest(F.ceil(n / F.lit(CHUNKS)), F.lit(block)), F.lit(max(block, MOST_ROWS)))
    sizes = durable(profiles.groupBy(*keys).agg(F.ceil(n / rows).alias("_chunks"), n.alias("_size")))
    return attach(profiles, sizes, keys).withColumn("_chunk", F.pmod(F.xxhash64("_item"), F.col("_chunks")))


def _steps(chunked: DataFrame) -> int:
    """Buckets per unit of similarity, in proportion to the longest key."""
    most = chunked.agg(F.max("_size")).first()[0] or 0
    return STEPS * max(1, -(-most // SIDE_ROWS))


def _named(profiles: DataFrame, keys: list[str], item: str, shape: str, position: str) -> DataFrame:
    return profiles.select(
        *keys, F.col(item).cast("bigint").alias("_item"), F.col(position).cast("double").alias("_x"), F.col(shape).cast("array<double>").alias("_shape"),
        F.array().cast("array<bigint>").alias("_want"))


def _each(n: Column | str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))


SIDE = ["_item", "_x", "_shape", "_want", "_side", "_a", "_b"]


def _all_with_all(chunked: DataFrame, keys: list[str]) -> DataFrame:
    met = chunked.withColumn("_other", _each("_chunks")).withColumns({
        "_a": F.least("_chunk", "_other"), "_b": F.greatest("_chunk", "_other")})
    return met.withColumn("_side", (F.col("_chunk") != F.col("_a")).cast("int")).select(*keys, *SIDE)


def _some_with_all(chunked: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """`queries` (chunked too) as side 0 against all rows of their keys as side 1."""
    parts = lambda df: durable(df.select(*keys, F.col("_chunks").alias("_others")).distinct())
    rows = attach(chunked, parts(queries), keys, "inner").withColumns({"_a": _each("_others"), "_b": F.col("_chunk"), "_side": F.lit(1)})
    asked = attach(queries, parts(chunked), keys, "inner").withColumns({"_b": _each("_others"), "_a": F.col("_chunk"), "_side": F.lit(0)})
    return asked.select(*keys, *SIDE).unionByName(rows.select(*keys, *SIDE))


def _distribution(meet, keys: list[str], fields: list, params: dict, probs: list[float]) -> tuple[DataFrame, DataFrame]:
    """(counts by label and bucket, exact percentiles `q` by label). `meet` gives the rows that meet, with or without `_want`."""
    group, by = [*keys, "_a", "_b"], [*keys, "label"]
    counts = durable(meet(None).groupBy(*group).applyInArrow(
        _counter(keys, params), _typed(fields, keys, "label bigint, _bucket bigint, _c bigint, total double")).groupBy(*by, "_bucket").agg(
        F.sum("_c").alias("_c"), F.sum("total").alias("total")))
    picks = rank_buckets(counts.select(*by, "_bucket", "_c"), by, probs)
    values = meet(picks).groupBy(*group).applyInArrow(_picker(keys, params), _typed(fields, keys, "label bigint, _bucket bigint, _v double"))
    return counts, values_at_ranks(values, picks, by, probs)


def _typed(fields: list, keys: list[str], rest: str) -> StructType:
    return StructType([*[f for f in fields if f.name in keys], *StructType.fromDDL(rest).fields])


def _with_wants(rows: DataFrame, picks: DataFrame | None, keys: list[str], span: int) -> DataFrame:
    """Rows with the codes (label, bucket) wanted of their key."""
    if picks is None:
        return rows
    codes = durable(picks.groupBy(*keys).agg(F.collect_set(F.col("label") * span + F.col("_bucket")).alias("_want")))
    return attach(rows.drop("_want"), codes, keys)


# ------------------------------------------------------------------ operators


def similarity_summary(
    profiles: DataFrame, keys: list[str], item: str, shape: str, position: str, edges: list[float] | None = None,
    min_share: float = MIN_SHARE, min_points: int = MIN_POINTS, block: int = SIDE_ROWS,
) -> DataFrame:
    """Count, p10 .. p90 and mean of the similarities of all pairs of a key, with `edges` by right-closed separation `bin`."""
    chunked = durable(_chunked(_named(profiles, keys, item, shape, position), keys, block))
    steps = _steps(chunked)
    params = {"label": "separation" if edges else "none", "edges": edges, "within": True, "min_share": min_share, "min_points": min_points, "steps": steps}
    counts, q = _distribution(
        lambda picks: _all_with_all(_with_wants(chunked, picks, keys, 2 * steps + 1), keys), keys, chunked.schema.fields, params, list(SUMMARY))
    out = _summary(counts, q, keys)
    if not edges:
        return out.drop("label")
    names = F.array(*[F.lit(f"{lo:g}-{hi:g}") for lo, hi in zip(edges, edges[1:])])
    return out.withColumn("bin", F.get(names, F.col("label").cast("int"))).select(*keys, "bin", *out.columns[len(keys) + 1:])


def between_groups(
    profiles: DataFrame, key: str, item: str, shape: str, position: str, pairs: list[tuple],
    min_share: float = MIN_SHARE, min_points: int = MIN_POINTS, block: int = SIDE_ROWS,
) -> DataFrame:
    """Count, p10 .. p90 and mean of similarities between all profiles of chosen pairs of groups."""
    spark = profiles.sparkSession
    chunked = durable(_chunked(_named(profiles, [key], item, shape, position), [key], block))
    steps = _steps(chunked)
    params = {"label": "none", "edges": None, "within": False, "min_share": min_share, "min_points": min_points, "steps": steps}
    kind = dict(chunked.dtypes)[key]
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"pair int, group_a {kind}, group_b {kind}")

    def side(group: str) -> DataFrame:
        named = table.select("pair", F.col(group).alias(key))
        return chunked.join(F.broadcast(named), key).drop(key)  # a listed table

    def meet(picks: DataFrame | None) -> DataFrame:
        return _some_with_all(side("group_b"), _with_wants(side("group_a"), picks, ["pair"], 2 * steps + 1), ["pair"])

    counts, q = _distribution(meet, ["pair"], table.schema.fields, params, list(SUMMARY))
    return _summary(counts, q, ["pair"]).join(F.broadcast(table), "pair").drop("pair", "label")


def _summary(counts: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    basic = counts.groupBy(*keys, "label").agg(F.sum("_c").alias("n_pairs"), (F.sum("total") / F.sum("_c")).alias("mean"))
    return basic.join(q, [*keys, "label"]).select(
        *keys, "label", "n_pairs", *[F.get("q", F.lit(i)).alias(f"p{round(100 * p)}") for i, p in enumerate(SUMMARY)], "mean")


def _medians(chunked: DataFrame, queries: DataFrame, keys: list[str], params: dict, block: int) -> DataFrame:
    """`(keys, _item, median_similarity)` of the few `queries` against all rows of their keys."""
    asked = durable(_chunked(queries, keys, block))

    def meet(picks: DataFrame | None) -> DataFrame:
        if picks is None:
            return _some_with_all(chunked, asked, keys)
        wants = picks.groupBy(*keys, F.col("label").alias("_item")).agg(F.collect_set("_bucket").alias("_want"))
        return _some_with_all(chunked, asked.drop("_want").join(wants, [*keys, "_item"], "left").select(*asked.columns), keys)

    _, q = _distribution(meet, keys, chunked.schema.fields, params, [0.5])
    return durable(q.select(*keys, F.col("label").alias("_item"), F.get("q", F.lit(0)).alias("median_similarity")))


def _best(known: DataFrame, keys: list[str]) -> DataFrame:
    """The first head of the highest median of each key, as `b`."""
    score = F.struct(F.round("median_similarity", 12), -F.col("_x"), -F.col("_item"))
    return known.groupBy(*keys).agg(F.max_by(F.struct("_item", "_x", "median_similarity"), score).alias("b"))


def medoids(
    profiles: DataFrame, keys: list[str], item: str, shape: str, position: str,
    min_share: float = MIN_SHARE, min_points: int = MIN_POINTS, block: int = SIDE_ROWS, anchors: int = HEADS,
) -> DataFrame:
    """Profile with the highest median similarity to all others of its key; the first one on ties.

    A round draws about `anchors` heads of each key at random with the first one by position, or all candidates left if they
    are at most eight times as many; the next round draws twice as many, so rounds are few whatever the ties.
    """
    params = {"label": "item", "edges": None, "within": False, "min_share": min_share, "min_points": min_points, "steps": HEAD_STEPS}
    named = _named(profiles, keys, item, shape, position)
    chunked = durable(_chunked(named, keys, block))
    sizes = durable(chunked.groupBy(*keys).agg(F.count("*").alias("sample_size"), F.min(F.struct("_x", "_item")).alias("first")))
    places = chunked.select(*keys, "_item", "_x")
    plain = chunked.drop("_chunk", "_chunks", "_size")
    left, top, salt = durable(places.distinct()), None, 0
    while True:
        salt += 1
        heads = durable(_drawn(left, keys, anchors, salt))
        few = plain.join(heads.select(*keys, "_item"), [*keys, "_item"], "left_semi").select(*plain.columns)
        known = _medians(chunked, few, keys, params, block).join(heads, [*keys, "_item"])
        if top is not None:
            known = known.unionByName(top.select(*keys, "b.*"))
        top = durable(_best(known, keys))
        rest = durable(left.join(heads.select(*keys, "_item"), [*keys, "_item"], "left_anti").select(*left.columns))
        if rest.isEmpty():
            break
        left = durable(_candidates(chunked, rest if salt > 1 else None, top, keys, params, block).join(rest, [*keys, "_item"]).select(
            *left.columns, "_n", "_reach", "_above").join(top, keys, "left").filter(
            (F.col("_n") > 0) & ((2 * F.col("_above") >= F.col("_n")) | (2 * F.col("_reach") >= F.col("_n"))
                                 & (F.struct("_x", "_item") < F.struct(F.col("b._x").alias("_x"), F.col("b._item").alias("_item"))))).select(*left.columns))
        if left.isEmpty():
            break
    kind = dict(profiles.dtypes)[item]
    return sizes.join(top, keys, "left").select(
        *keys, "sample_size", F.coalesce("b._item", "first._item").cast(kind).alias("medoid"),
        F.coalesce("b._x", "first._x").alias("medoid_position"), "b.median_similarity")


def _drawn(left: DataFrame, keys: list[str], anchors: int, salt: int) -> DataFrame:
    """Heads of the next round from the candidates `left`; each round draws twice as many as the one before."""
    n = anchors << (salt - 1)
    sizes = durable(left.groupBy(*keys).agg(F.count("*").alias("_left"), F.min(F.struct("_x", "_item")).alias("_first")))
    return attach(left, sizes, keys).filter(
        (F.col("_left") <= 8 * n) | (F.struct("_x", "_item") == F.col("_first")) | (F.pmod(F.xxhash64("_item", F.lit(salt)), F.col("_left")) < n)
    ).select(*left.columns)


def _candidates(
    chunked: DataFrame, some: DataFrame | None, top: DataFrame, keys: list[str], params: dict, block: int
) -> DataFrame:
    """(keys, _item, _n, _reach, _above) against the best head of their key: of all rows, or of `some` items."""
    best = top.select(*keys, F.col("b.median_similarity").alias("_x"))
    rows = attach(chunked.drop("_x"), best, keys).withColumn("_x", F.coalesce("_x", F.lit(-9.0)))  # no head has a median: all are open
    if some is None:
        meet = _all_with_all(rows, keys)
    else:
        asked = rows.join(some.select(*keys, "_item"), [*keys, "_item"], "left_semi")
        meet = _some_with_all(rows, durable(_chunked(asked.drop("_chunk", "_chunks", "_size"), keys, block)), keys)
    return meet.groupBy(*keys, "_a", "_b").applyInArrow(
        _reacher(keys, params | {"within": some is None}), _typed(chunked.schema.fields, keys, "_item bigint, _n bigint, _reach bigint, _above bigint")).groupBy(
        *keys, "_item").agg(*[F.sum(c).alias(c) for c in ("_n", "_reach", "_above")])
