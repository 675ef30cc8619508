"""Periodic runs of words: maximal stretches whose words repeat at a smallest period, three times or more.

A run is a stretch [start, end) with smallest period q and length >= max(MIN_LENGTH, MIN_TIMES * q) that no neighbouring
word extends. Enumeration is by harmonic grid: a stretch of period p and such a length has max(MIN_LENGTH, MIN_TIMES * p) - p
consecutive places where a word equals the one p later, so a grid of that step has a point among
them. From each grid point the stretch follows by two longest common extensions (LCE), to the right and to the left, and
all grid points together are fewer than n log n. Of equal stretches the smallest period is kept: it divides the others.

LCE by difference cover: `COVER` holds for every residue d two members d apart modulo `MODULUS`, so any two positions
reach two sampled ones after fewer than MODULUS equal words. These words are compared one by one, which settles
nearly all pairs. Only for texts where a pair gets through are the sampled suffixes sorted (6 in 31 positions: first
blocks of MODULUS words, then doubling), and common prefixes of neighbours in that order, under a sparse table
of minima, answer the rest. The left side is the same over the reversed words.

Texts of a task are worked on together, up to `WORDS_AT_ONCE` words, each closed by a word of its own that stops every
extension; a longer text is worked on alone, its grid in slices. Nothing is shuffled, and memory is linear in the longest text.

Defined cases: null and blank texts have no words and no runs; repeated rows and ids, null ids included, come out
each; an empty table gives no rows; ties of the best run go to the smallest start, then period; other columns pass
through, and input columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgeo.llm.common import free_name, no_cycles, require_columns, words_of

MIN_LENGTH, MIN_TIMES = 24, 3
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)  # a perfect difference set
WORDS_AT_ONCE, PAIRS_AT_ONCE, PAIRS_SLICE = 200_000, 1 << 18, 1 << 20
FEW = 8  # a stretch has 16 or more equal words around a grid point, so 8 or more on one side
BEST = ("start", "length", "period", "exponent_milli")
RESULTS = f"n_runs bigint, {', '.join(f'{b} bigint' for b in BEST)}, runs array<struct<start:bigint,length:bigint,period:bigint>>"


def _shifts() -> np.ndarray:
    """For residues (i, j) the smallest shift that brings both into the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    ahead = (np.arange(MODULUS)[:, None] + np.arange(MODULUS)[None]) % MODULUS  # residue, shift
    hit = inside[ahead]
    return (hit[:, None, :] & hit[None, :, :]).argmax(axis=2)


class Extensions:
    """Longest common extensions of `words` (whole numbers from 0; no two suffixes equal).

    The suffixes at sampled places are sorted once; `lce` of sampled places is a minimum over their neighbours.
    """

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        places = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        m = self.size = len(places)
        self.rank = np.full(n + 1, -1, np.int64)  # by place; the end ranks below everything
        levels = [self._blocks(places)]
        width = MODULUS
        while m and levels[-1].max() < m - 1:
            # names of twice the width from pairs of names, the second one `width` places on
            known = np.full(n + 1, -1, np.int64)
            known[places] = levels[-1]
            pair = levels[-1] * (m + 1) + known[np.minimum(places + width, n)] + 1
            levels.append(np.unique(pair, return_inverse=True)[1].reshape(-1))
            width *= 2
        order = np.argsort(levels[-1]) if m else places
        self.rank[places] = levels[-1] if m else 0
        self.table = self._minima(self._neighbours(places, order, levels))

    def _blocks(self, places: np.ndarray) -> np.ndarray:
        """Names, in order, of the MODULUS words at each place (three words of 21 bits a key)."""
        padded = np.concatenate([self.words.astype(np.int64) + 1, np.zeros(MODULUS + 2, np.int64)])
        if len(padded) and padded.max() >= 1 << 21:  # many distinct words: number those there are
            padded = np.unique(padded, return_inverse=True)[1].reshape(-1)
        bits = max(1, int(padded.max()).bit_length()) if len(padded) else 1
        each = 62 // bits
        keys = []
        for at in range(0, MODULUS, each):
            key = np.zeros(len(places), np.int64)
            for t in range(at, min(at + each, MODULUS)):
                key = key << bits | padded[places + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(places), bool)
        for key in keys:
            new[1:] |= np.diff(key[order]) != 0
        names = np.empty(len(places), np.int64)
        names[order] = np.cumsum(new)
        return names

    def _neighbours(self, places: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix lengths of neighbours in suffix order, from the widest equal names down."""
        n = len(self.words)
        if len(order) < 2:
            return np.zeros(0, np.int64)
        a, b = places[order[:-1]].copy(), places[order[1:]].copy()
        length = np.zeros(len(a), np.int64)
        index = np.full(n + 1, -1, np.int64)
        index[places] = np.arange(len(places))
        for k in range(len(levels) - 1, -1, -1):
            names = np.append(levels[k], -1)
            ia, ib = index[np.minimum(a, n)], index[np.minimum(b, n)]
            same = (ia >= 0) & (ib >= 0) & (names[ia] == names[ib])
            step = MODULUS << k
            a[same] += step
            b[same] += step
            length[same] += step
        return length + direct(self.words, a, b, MODULUS)

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values]
        width = 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of sampled places i <> j."""
        low, high = np.sort(np.stack([self.rank[i], self.rank[j]]), axis=0)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def direct(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Equal words from i and j on, one by one, at most `most`. Places beyond the end match nothing."""
    n, out = len(words), np.zeros(len(i), np.int64)
    most = np.broadcast_to(most, len(i))
    alive = np.flatnonzero(most > 0)
    step = 0
    while len(alive):
        a, b = i[alive] + step, j[alive] + step
        ok = (a < n) & (b < n)
        ok[ok] = words[a[ok]] == words[b[ok]]
        alive = alive[ok]
        step += 1
        out[alive] = step
        alive = alive[most[alive] > step]
    return out


def grid(sizes: np.ndarray, begins: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid points of texts with `sizes` words from `begins` on, about `most` at a time.

    A text's periods go from 1 to a third of its words; the grid of a period has step max(24, 3p) - p.
    """
    texts = np.flatnonzero(sizes >= MIN_LENGTH)
    for at in range(0, len(texts), 4_096):
        some = texts[at:at + 4_096]
        periods = sizes[some] // MIN_TIMES
        text = np.repeat(some, periods)
        p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        step = np.maximum(MIN_LENGTH, MIN_TIMES * p) - p
        points = (sizes[text] - p - 1) // step + 1
        total = np.cumsum(points)
        edges = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], most), side="left"), len(p)))
        for low, high in zip(edges[:-1], edges[1:]):
            span = slice(low, high)
            owner = np.repeat(np.arange(low, high), points[span])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(points[span]) - points[span], points[span])
            yield begins[text[owner]] + nth * step[owner], p[owner]


def find_runs(texts: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period. Words are numbers below `n_words`."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.append(0, np.cumsum(sizes + 1))[:-1]
    words = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for i, (t, b) in enumerate(zip(texts, begins)):
        words[b:b + len(t)] = t
        words[b + len(t)] = n_words + i  # a word of its own closes each text
    shifts, found = _shifts(), []
    backward = words[::-1].copy()
    last = len(words)
    held: dict[bool, Extensions] = {}

    def reach(turned: bool, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        side = backward if turned else words
        shift = shifts[i % MODULUS, j % MODULUS]
        out = direct(side, i, j, shift)
        through = np.flatnonzero(out == shift)
        a, b = i[through] + shift[through], j[through] + shift[through]
        go = (a < last) & (b < last)
        go[go] = side[a[go]] == side[b[go]]  # the sampled places themselves are compared before anything is sorted
        through, a, b = through[go], a[go], b[go]
        if len(through):
            if turned not in held:
                held[turned] = Extensions(side)
            out[through] += held[turned].lce(a, b)
        return out

    for i, p in grid(sizes, begins, PAIRS_SLICE if len(texts) == 1 else PAIRS_AT_ONCE):
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        if not len(i):
            continue
        need = np.maximum(MIN_LENGTH, MIN_TIMES * p) - p
        # A few words on both sides settle nearly all points before any suffix is sorted.
        maybe = (direct(words, i, i + p, FEW) == FEW) | (direct(backward, last - i, last - i - p, FEW) == FEW)
        i, p, need = i[maybe], p[maybe], need[maybe]
        if not len(i):
            continue
        right, left = reach(False, i, i + p), reach(True, last - i, last - i - p)
        good = right + left >= need
        found.append(np.stack([i - left, right + left + p, p])[:, good])
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # Of equal stretches the first has the smallest period.
    first = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[:len(start)]
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(begins, start, side="right") - 1
    return text, start - begins[text], length, period


def best_run(length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest exact length / period; the first of equals (runs come by start, then period)."""
    best = 0
    for k in range(1, len(length)):
        if int(length[k]) * int(period[best]) > int(length[best]) * int(period[k]):
            best = k
    return best


def kept_mask(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for words that some run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) == 0


def _work(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], tuple]]:
    """(rows, their words, their runs), a bounded number of words at a time; column `at` is the text."""
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            words, size, row = [], 0, first
            while row < batch.num_rows and (size < WORDS_AT_ONCE):
                words.append(words_of(batch.column(at)[row].as_py()))
                size += len(words[-1])
                row += 1
            numbers = defaultdict(count().__next__)
            texts = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words]
            yield batch.slice(first, row - first), words, find_runs(texts, len(numbers))
            first = row


def mark_runs(docs: DataFrame, text: str = "text", carry: list[str] | None = None, collapse: bool = True) -> DataFrame:
    """`docs` with the number of runs, the best run, all `runs`, and with `collapse` also `collapsed_text`.

    `carry` names the columns that pass through (all by default).
    """
    require_columns(docs, text, *(carry or []))
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(RESULTS + (", collapsed_text string" if collapse else "")).fields
    names = [f.name for f in added]
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(free_name(docs, "whole")))
    schema = StructType([*source.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            for rows, words, (owner, start, length, period) in _work(batches, len(rest)):
                edges = np.searchsorted(owner, np.arange(len(words) + 1))
                best = [(a + best_run(length[a:b], period[a:b])) if b > a else None for a, b in zip(edges[:-1], edges[1:])]
                chosen = [(None,) * 4 if k is None else (
                    int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k])) for k in best]
                pairs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                out = [*rows.columns[:-1], pa.array(np.diff(edges)), *[pa.array([c[k] for c in chosen], pa.int64()) for k in range(len(BEST))],
                       pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs)]
                if collapse:
                    kept = []
                    for w, a, b in zip(words, edges[:-1], edges[1:]):
                        if b > a:
                            stays = kept_mask(len(w), start[a:b], length[a:b], period[a:b])
                            w = [w[k] for k in np.flatnonzero(stays)]
                        kept.append(b" ".join(w))
                    out.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema([*zip([*rest, *names], [c.type for c in out])]))

    return source.mapInArrow(run, schema)


def runs_digest() -> F.Column:
    """SHA-256 of every run's `start,length,period` and a line feed, by start, then period."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))), 256)
