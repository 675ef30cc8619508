"""Recurrences along a track: selection with continuity, families over thresholds, best path.

The recurrences run in grouped functions over chunks of consecutive positions, never over a whole
track longer than `WALK_ROWS`: a chunk takes its incoming state from the chunk before it. For the selection
the state is one number, guessed empty; chunks that were entered by another number are walked again, and only
their rows are written, under the number of the round, until no entry changes. For the best path the state is
the scores of the last few nodes, on which a chunk acts as a (max, +) matrix, so one small scan fixes all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackgeo.functions.scores import node_score
from trackgeo.operators.layout import order_rows
from trackgeo.session import durable

#: Rows that one grouped walk in Python covers at most: about a second's work.
WALK_ROWS = 10_000


def _field_ddl(df: DataFrame, names: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {types[n]}" for n in names)


# ------------------------------------------------------------------ selection with continuity


def _select_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk the cases of one chunk; only a selected centroid becomes the next reference."""
    pdf = pdf.sort_values("_ix").reset_index(drop=True)
    prev = pdf["_prev"].iloc[0]
    chosen, scores, seconds, words = [], [], [], []
    for row in pdf.itertuples(index=False):
        base = np.asarray(row.base_scores, dtype=float)
        if base.size == 0:
            chosen.append(None), scores.append(np.nan), seconds.append(np.nan)
            words.append("no_valid_component")
            continue
        centres = np.asarray(row.centroids, dtype=float)
        near = 0.5 if prev is None or np.isnan(prev) else np.exp(-np.abs(centres - prev) / row.continuity_scale)
        total = base + row.continuity_weight * near
        best = int(np.argmax(total))
        second = np.max(np.delete(total, best)) if total.size > 1 else np.nan
        ratio = second / total[best] if total.size > 1 and total[best] > 0 else 0.0
        if total[best] < row.min_score:
            word = "low_score"
        elif ratio >= row.ambiguity_ratio:
            word = "ambiguous"
        else:
            word, prev = "selected", centres[best]
        chosen.append(row.components[best]), scores.append(total[best]), seconds.append(second)
        words.append(word)
    out = pdf.drop(columns=["components", "centroids", "base_scores", "_prev"])
    out["component"] = pd.array(chosen, dtype="Int64")
    out["score"], out["runner_up_score"], out["status"] = scores, seconds, words
    out["_leaves"] = prev
    return out


def _repaired(rows: DataFrame, group: list[str], walk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every chunk of `rows` as it was walked last, each from what the chunk before it leaves.

    A round walks the chunks whose entry changed and writes their rows alone. What is rewritten every round is one
    border row per chunk: how it was entered, what it leaves, and the round that says so. The borders pick the valid
    rows once, at the end.
    """
    none, number = F.lit(None).cast("double"), 0
    rounds, changed = [], None
    borders = None
    while True:
        entered = rows.withColumn("_prev", none) if changed is None else rows.join(changed, group)
        rounds.append(durable(walk(entered).withColumn("_round", F.lit(number))))
        left = rounds[-1].groupBy(*group).agg(F.max("_leaves").alias("_left"), F.max("_round").alias("_round"))
        if borders is None:
            borders = left.withColumn("_prev", none)
        else:  # chunks of this round replace their border rows
            borders = borders.join(changed.select(*group), group, "left_anti").unionByName(left.join(changed, group))
        borders = durable(borders)
        follows = borders.select(*group[:-1], (F.col("_chunk") + 1).alias("_chunk"), F.col("_left").alias("_now"))
        changed = durable(borders.join(follows, group, "left").filter(~F.col("_now").eqNullSafe(F.col("_prev"))).select(
            *group, F.col("_now").alias("_prev")))
        if changed.isEmpty():
            break
        number += 1
    done = reduce(DataFrame.unionByName, rounds)
    return done.join(borders.select(*group, "_round"), [*group, "_round"]).drop("_round")


def select_in_sequence(
    cases: DataFrame, keys: list[str], position: str, hot_rows: int = WALK_ROWS, chunk_rows: int | None = WALK_ROWS
) -> DataFrame:
    """Best component per case where closeness to the previous selected case counts.

    `cases` carry per position the aligned arrays `components, centroids, base_scores` (empty when
    there is none) and the columns `continuity_weight, continuity_scale, min_score,
    ambiguity_ratio`.
    """
    o = order_rows(cases, keys, [position], "_ix", hot_rows, chunk_rows)
    chunk = F.lit(0).cast("long") if o.chunk_rows is None else F.floor(F.col("_ix") / o.chunk_rows)
    # The series as one text, so that null keys meet in joins too.
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = o.df.withColumns({"_series": series, "_chunk": chunk})
    group = ["_series", "_chunk"]
    rest = [c for c in rows.columns if c not in ("components", "centroids", "base_scores")]
    ddl = (
        _field_ddl(rows, rest)
        + ", component long, score double, runner_up_score double, status string, _leaves double"
    )

    def run(part: DataFrame) -> DataFrame:
        done = part.groupBy(*group).applyInPandas(_select_chunk, ddl)
        return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("score", "runner_up_score", "_leaves")})

    none = F.lit(None).cast("double")
    if o.chunk_rows is None:
        done = run(rows.withColumn("_prev", none))
    else:
        done = _repaired(durable(rows), group, run)
    ratio = F.when(F.col("runner_up_score").isNotNull() & (F.col("score") > 0),
                   F.col("runner_up_score") / F.col("score")).otherwise(F.lit(0.0))
    return done.withColumn("ambiguity", F.when(F.col("score").isNotNull(), ratio)).drop("_ix", "_series", "_chunk", "_leaves")


# ------------------------------------------------------------------ families over thresholds

FAMILY_IOU, FAMILY_BONUS, FAMILY_DISTANCE = 0.10, 0.20, 0.25


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _family_of(components: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Family number of each component of one position, highest threshold first."""
    for batch in components:
        out = []
        for items in batch:
            last, numbers = [], []  # last member of every family so far
            for c in items:
                if last:
                    lo = np.array([m["y_min"] for m in last])
                    hi = np.array([m["y_max"] for m in last])
                    gap = np.abs(np.array([m["centroid"] for m in last]) - c["centroid"])
                    shared = np.clip(np.minimum(hi, c["y_max"]) - np.maximum(lo, c["y_min"]), 0, None)
                    union = (hi - lo) + (c["y_max"] - c["y_min"]) - shared
                    iou = np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)
                    inside = ((lo <= c["y_min"]) & (hi >= c["y_max"])) | ((lo >= c["y_min"]) & (hi <= c["y_max"]))
                    fits = (gap <= FAMILY_DISTANCE) & ((iou >= FAMILY_IOU) | inside)
                    score = np.where(fits, iou + FAMILY_BONUS * inside - 0.5 * gap / FAMILY_DISTANCE, -np.inf)
                    best = int(np.argmax(score))
                    if fits[best]:
                        last[best] = c
                        numbers.append(best)
                        continue
                numbers.append(len(last))
                last.append(c)
            out.append(numbers)
        yield pd.Series(out)


def families(components: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Components of one position tied together over thresholds.

    A position has a few components per threshold, so its list is short.
    """
    fields = ["threshold_k", "component", "y_min", "y_max", "centroid", "width", "median_above", "peak_above"]
    item = F.struct((-F.col("threshold_k")).alias("o"), F.col("component").alias("i"), *fields[:1], *fields[2:])
    lists = components.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    small = F.transform("c", lambda e: F.struct(e["y_min"].alias("y_min"), e["y_max"].alias("y_max"), e["centroid"].alias("centroid")))
    numbered = lists.withColumn("f", _family_of(small))
    rows = numbered.select(*keys, F.explode(F.arrays_zip("c", "f")).alias("e")).select(
        *keys, F.col("e.f").alias("family"), "e.c.*")
    middle = sorted(thresholds)[len(thresholds) // 2]
    order = F.struct("o", "i")
    at_middle = F.when(F.col("threshold_k") == middle, order)
    rep = F.struct("y_min", "y_max", "centroid", "width")
    strongest = F.struct(F.col("peak_above"), F.col("median_above"), -F.col("o"), -F.col("i"))
    table = rows.groupBy(*keys, "family").agg(
        F.count_distinct("threshold_k").alias("n_thresholds"),
        F.coalesce(F.min_by(rep, at_middle), F.max_by(rep, strongest)).alias("rep"),
        F.min("threshold_k").alias("threshold_low"), F.max("threshold_k").alias("threshold_high"),
        (F.max("centroid") - F.min("centroid")).alias("centroid_spread"),
        (F.max("width") - F.min("width")).alias("width_spread"),
        F.median("median_above").alias("median_height"), F.max("peak_above").alias("peak_height"),
    )
    return table.select(
        *keys, "family", "rep.*",
        (F.col("n_thresholds") / F.lit(float(len(thresholds)))).alias("persistence"),
        "threshold_low", "threshold_high", "centroid_spread", "width_spread", "median_height", "peak_height")


def nodes(families_with_coverage: DataFrame, min_persistence: float = 0.5, min_finite: float = 0.10) -> DataFrame:
    """Families strong enough to take part in the path, with their score."""
    gated = families_with_coverage.filter(
        (F.col("persistence") >= min_persistence) & (F.col("finite_fraction") >= min_finite))
    return gated.withColumn("score", node_score(*[F.col(c) for c in (
        "persistence", "median_height", "peak_height", "centroid_spread", "width_spread", "finite_fraction")]))


# ------------------------------------------------------------------ best path with gaps

# Weights of the path cost.
MAX_GAP, GAP_OPEN, GAP_STEP = 5, 1.0, 1.5
MOVE_WEIGHTS = {"centroid": 2.0, "y_min": 1.0, "y_max": 1.0, "width": 0.5}


class _Chunk:
    """Nodes of one chunk in (position, node) order, led by copies of the nodes before it."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["position", "node"], kind="stable").reset_index(drop=True)
        self.at = pdf["position"].to_numpy(np.int64)
        self.node = pdf["node"].to_numpy(np.int64)
        self.score = pdf["score"].to_numpy(float)
        self.shape = pdf[list(MOVE_WEIGHTS)].to_numpy(float)
        self.weights = np.array(list(MOVE_WEIGHTS.values()))
        own = pdf["_own"].to_numpy(bool)
        self.n_before = int((~own).sum())  # copies sort first: their positions are smaller
        self.first_reachable = np.searchsorted(self.at, self.at - MAX_GAP, side="left")
        self.first_same = np.searchsorted(self.at, self.at, side="left")
        stop = int(pdf["_stop"].iloc[0])
        self.leaving = np.flatnonzero(own & (self.at >= stop - MAX_GAP))

    def moves(self, i: int) -> tuple[int, int, np.ndarray]:
        """Earlier nodes within reach of node `i` and the cost of coming from each."""
        lo, hi = self.first_reachable[i], self.first_same[i]
        steps = self.at[i] - self.at[lo:hi]
        change = np.abs(self.shape[lo:hi] - self.shape[i]) @ self.weights
        return lo, hi, change + GAP_OPEN + GAP_STEP * (steps - 1)

    def gains(self) -> np.ndarray:
        """Best gain from every node before the chunk (and from a fresh start, last column)."""
        h = self.n_before
        table = np.full((len(self.at), h + 1), -np.inf)
        table[np.arange(h), np.arange(h)] = 0.0
        for i in range(h, len(self.at)):
            lo, hi, cost = self.moves(i)
            table[i, h] = self.score[i]
            if hi > lo:
                reached = (table[lo:hi] - cost[:, None]).max(axis=0) + self.score[i]
                table[i] = np.maximum(table[i], reached)
        return table

    def walk(self, incoming: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score ending at each node and the node it came from (−1: path starts here)."""
        h = self.n_before
        best, came = np.full(len(self.at), -np.inf), np.full(len(self.at), -1)
        best[:h] = incoming
        for i in range(h, len(self.at)):
            lo, hi, cost = self.moves(i)
            best[i] = self.score[i]
            if hi > lo:
                reached = best[lo:hi] + self.score[i] - cost
                j = int(np.argmax(reached))
                if reached[j] > best[i]:
                    best[i], came[i] = reached[j], lo + j
        return best, came


def _keys_of(pdf: pd.DataFrame, keys: list[str], n: int) -> dict:
    return {k: [pdf[k].iloc[0]] * n for k in keys}


def best_path(
    node_table: DataFrame, keys: list[str], hot_positions: int = WALK_ROWS, chunk_positions: int | None = None
) -> DataFrame:
    """Nodes on the best path of each track, with the path's total score.

    `node_table` holds per position of a regular grid the competing `node`s with `score` and the
    interval columns of `MOVE_WEIGHTS`. A step may skip up to `MAX_GAP` positions; a path may start
    and end anywhere; ties keep the earliest choice.
    """
    needed = node_table.select(*keys, "position", "node", "score", *MOVE_WEIGHTS)
    extent = needed.groupBy(*keys).agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    longest = extent.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    whole = longest <= hot_positions
    size = int(longest) + 1 if whole else max(chunk_positions or hot_positions, MAX_GAP)
    based = needed.join(extent.select(*keys, F.col("lo").alias("_lo")), keys).withColumn(
        "_p", F.col("position") - F.col("_lo"))
    home = F.floor(F.col("_p") / size)
    copies = F.array_compact(F.array(home, F.when(F.col("_p") % size >= size - MAX_GAP, home + 1)))
    rows = based.withColumn("_home", home).withColumn("_chunk", F.explode(copies)).withColumn(
        "_own", F.col("_home") == F.col("_chunk")
    ).withColumn("_stop", F.col("_lo") + (F.col("_chunk") + 1) * size).drop("_p", "_home", "_lo")
    kddl = _field_ddl(rows, keys)
    group = [*keys, "_chunk"]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        """Forward walk with known incoming scores, then back from the given exit node."""
        c = _Chunk(pdf)
        own = pdf[pdf["_own"]]
        incoming = np.full(c.n_before, -np.inf)
        known = pdf["_incoming"].iloc[0]
        if known is not None and c.n_before:
            incoming = np.asarray(known, dtype=float)
        best, came = c.walk(incoming)
        if not len(own):
            return pd.DataFrame(columns=[*keys, "position", "node", "path_score"])
        exit_at, exit_node = pdf["_exit_at"].iloc[0], pdf["_exit_node"].iloc[0]
        if pd.isna(exit_at):
            i = c.n_before + int(np.argmax(best[c.n_before:]))
        else:
            i = int(np.flatnonzero((c.at == exit_at) & (c.node == exit_node))[0])
        total = pdf["_total"].iloc[0]
        total = best[i] if pd.isna(total) else total
        picked = []
        while i >= c.n_before:
            picked.append(i)
            i = came[i]
        out = _keys_of(pdf, keys, len(picked))
        return pd.DataFrame({**out, "position": c.at[picked], "node": c.node[picked], "path_score": total})

    ddl = kddl + ", position long, node long, path_score double"
    nothing = {"_incoming": F.lit(None).cast("array<double>"), "_exit_at": F.lit(None).cast("double"),
               "_exit_node": F.lit(None).cast("double"), "_total": F.lit(None).cast("double")}
    if whole:
        return rows.withColumns(nothing).groupBy(*group).applyInPandas(finish, ddl)

    rows = durable(rows)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(pdf)
        table = c.gains()
        ends = table[c.n_before:].max(axis=0) if len(c.at) > c.n_before else np.full(c.n_before + 1, -np.inf)
        return pd.DataFrame({
            **_keys_of(pdf, keys, 1), "_chunk": [pdf["_chunk"].iloc[0]],
            "before": [[f"{p}:{n}" for p, n in zip(c.at[:c.n_before], c.node[:c.n_before])]],
            "leaving": [[f"{c.at[i]}:{c.node[i]}" for i in c.leaving]],
            "gains": [[table[i].tolist() for i in c.leaving]], "ends": [ends.tolist()],
        })

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        """Carry the scores of the border nodes from chunk to chunk."""
        pdf = pdf.sort_values("_chunk")
        state, last, out = {}, None, []
        columns = [pdf[c] for c in ("_chunk", "before", "leaving", "gains", "ends")]
        for chunk, before, leaving, gains, ends in zip(*columns):
            if last is None or chunk != last + 1:
                state = {}
            last = chunk
            incoming = np.array([state.get(b, -np.inf) for b in before] + [0.0])
            state = {
                name: float(np.max(incoming + np.asarray(g, dtype=float)))
                for name, g in zip(leaving, gains)
            }
            end = float(np.max(incoming + np.asarray(ends, dtype=float)))
            out.append((last, incoming[:-1].tolist(), end))
        table = pd.DataFrame(out, columns=["_chunk", "_incoming", "end"])
        return pd.concat([pd.DataFrame(_keys_of(pdf, keys, len(table))), table], axis=1)

    sums = durable(rows.groupBy(*group).applyInPandas(
        summarise, kddl + ", _chunk long, before array<string>, leaving array<string>, "
        "gains array<array<double>>, ends array<double>"))
    entering = durable(sums.groupBy(*keys).applyInPandas(scan, kddl + ", _chunk long, _incoming array<double>, end double"))
    ends = entering.groupBy(*keys).agg(
        F.max("end").alias("_total"), F.min_by("_chunk", F.struct(-F.col("end"), F.col("_chunk"))).alias("_last"))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        """For every node a path may leave by, the copied node it entered by."""
        c = _Chunk(pdf)
        known = pdf["_incoming"].iloc[0]
        incoming = np.asarray(known if known is not None else [], dtype=float)
        best, came = c.walk(incoming if c.n_before else np.array([]))
        if len(c.at) == c.n_before:
            return pd.DataFrame(columns=[*keys, "_chunk", "exit", "enter", "is_end"])
        end = c.n_before + int(np.argmax(best[c.n_before:]))
        out = []
        for i in [*c.leaving, end]:
            j = i
            while j >= c.n_before:
                j = came[j]
            out.append((f"{c.at[i]}:{c.node[i]}", f"{c.at[j]}:{c.node[j]}" if j >= 0 else None))
        table = pd.DataFrame(out, columns=["exit", "enter"])
        table["is_end"] = [False] * len(c.leaving) + [True]
        table["_chunk"] = pdf["_chunk"].iloc[0]
        return pd.concat([pd.DataFrame(_keys_of(pdf, keys, len(table))), table], axis=1)

    withscores = rows.join(entering.select(*group, "_incoming"), group)
    maps = withscores.groupBy(*group).applyInPandas(exits, kddl + ", _chunk long, exit string, enter string, is_end boolean")

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exit node of every chunk on the path, from the last chunk back."""
        chunk = int(pdf["_last"].iloc[0])
        leave = pdf[(pdf["_chunk"] == chunk) & pdf["is_end"]]["exit"].iloc[0]
        enter = {(c, e): n for c, e, n in zip(pdf["_chunk"], pdf["exit"], pdf["enter"])}
        out = []
        while leave is not None and not pd.isna(leave):
            at, node = leave.split(":")
            out.append((chunk, float(at), float(node)))
            leave, chunk = enter[(chunk, leave)], chunk - 1
        table = pd.DataFrame(out, columns=["_chunk", "_exit_at", "_exit_node"])
        table["_total"] = pdf["_total"].iloc[0]
        return pd.concat([pd.DataFrame(_keys_of(pdf, keys, len(table))), table], axis=1)

    path = durable(maps.join(ends, keys).groupBy(*keys).applyInPandas(
        trace, kddl + ", _chunk long, _exit_at double, _exit_node double, _total double"))
    return withscores.join(path, group).groupBy(*group).applyInPandas(finish, ddl)
