"""Benchmark decontamination by the q-gram lemma over diagonal bands.

An item of m characters that occurs in a text with at most k edits shares at least m - q + 1 - k q of its q-grams
with it, all inside k + 1 neighbouring diagonals (text position less item position). Shared q-grams are counted
per item in bands of 2 (k + 1) diagonals that overlap by half, so one band holds every such occurrence whole;
bands below the bound are dropped without loss, and the others are verified by a banded alignment.

k is `rate` times m, less where the bound would fall below one. Texts and items are compared lower-cased, with each
run of white space as one space; positions are those of that form.

The items are a query set: they go to the tasks in blocks of at most `BLOCK_CHARS` characters, each block
against all texts. Each document is searched on its own, so no pair join arises and no key can be hot.

Defined cases: items shorter than q characters, empty or null match nothing; null and empty texts hold nothing;
repeated rows match each; null ids are carried; of overlapping occurrences of one item in a text the
one with the fewest edits stays, then the first; an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgeo.llm.common import require_columns

Q, RATE = 8, 0.1
BLOCK_CHARS = 1_000_000
TABLE_BITS = 20
FOUND = 'doc_id bigint, item_id bigint, start int, "end" int, edits int'.replace('"', "`")
FAR = 1 << 20


def plain(text: str | None) -> np.ndarray:
    """Code points of the compared form."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def codes(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += points[i:i + n]
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


class Items:
    """q-grams of a block of items: sorted codes with the (item, position) pairs of each."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], q: int, rate: float):
        self.ids, self.points, self.q = [r[0] for r in rows], [r[1] for r in rows], q
        self.m = np.array([len(p) for p in self.points])
        self.k = np.minimum((rate * self.m).astype(int), (self.m - q) // q)
        self.need = self.m - q + 1 - self.k * q
        all_codes = np.concatenate([codes(p, q) for p in self.points])
        item = np.repeat(np.arange(len(rows)), self.m - q + 1)
        place = np.concatenate([np.arange(m - q + 1) for m in self.m])
        by = np.argsort(all_codes, kind="stable")
        self.codes, first = np.unique(all_codes[by], return_index=True)
        self.first = np.append(first, len(by))
        self.item, self.place = item[by], place[by]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def bands(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) pairs of a text whose shared q-grams reach the bound."""
        text = codes(points, self.q)
        at = np.flatnonzero(self.table[(text >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        none = np.empty(0, int), np.empty(0, int)
        if len(at) < self.need.min():
            return none
        i = np.minimum(np.searchsorted(self.codes, text[at]), len(self.codes) - 1)
        same = self.codes[i] == text[at]
        at, i = at[same], i[same]
        n = self.first[i + 1] - self.first[i]
        if n.sum() < self.need.min():
            return none
        pair = np.repeat(self.first[i] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        item = self.item[pair]
        width = self.k[item] + 1
        half = (np.repeat(at, n) - self.place[pair]) // width + FAR * 64
        key, count = np.unique(item << 40 | half, return_counts=True)
        following = np.searchsorted(key, key + 1)
        after = np.where(key[np.minimum(following, len(key) - 1)] == key + 1, count[np.minimum(following, len(key) - 1)], 0)
        enough = count + after >= self.need[key >> 40]
        # A band that starts one half earlier holds a group of hits at its upper half alone.
        return (key[enough] >> 40), (key[enough] & (1 << 40) - 1) - FAR * 64


def align(items: Items, jobs: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of the best occurrence in each (item, band, text), or null beyond the budget.

    All jobs advance together, one item character at a time; a row of the table is the band.
    """
    item = np.array([j[0] for j in jobs])
    k, m = items.k[item], items.m[item]
    low = np.array([j[1] for j in jobs]) * (k + 1) - k  # first diagonal of the widened band
    own = 2 * (k + 1) + 2 * k  # diagonals of each job; beyond them lie other bands
    span = int(own.max())
    size = np.array([len(j[2]) for j in jobs])
    length = int(m.max())
    window = np.zeros((len(jobs), length + span), np.uint32)  # 0 stands outside the text and matches nothing
    wanted = np.full((len(jobs), length), 0xFFFFFFFF, np.uint32)
    for row, (i, _, text) in enumerate(jobs):
        a, b = max(0, low[row]), min(size[row], low[row] + length + span)
        if b > a:
            window[row, a - low[row]:b - low[row]] = text[a:b]
        wanted[row, :m[row]] = items.points[i]
    step, t = np.int64(FAR), np.arange(span, dtype=np.int64)
    cost = np.tile(t, (len(jobs), 1))  # edits * FAR + start, so the least is the fewest edits, then the first start
    beyond = t >= own[:, None]
    cost[beyond] = 1 << 60
    best: list = [None] * len(jobs)
    for i in range(length):
        beside = np.full_like(cost, 1 << 60)
        beside[:, :-1] = cost[:, 1:] + step
        cost = np.minimum(cost + np.where(window[:, i:i + span] == wanted[:, i:i + 1], 0, step), beside)
        cost = np.minimum.accumulate(cost - t * step, axis=1) + t * step
        np.putmask(cost, beyond, 1 << 60)
        for row in np.flatnonzero(m == i + 1):
            end = int(np.argmin(cost[row]))
            edits, start = divmod(int(cost[row, end]), FAR)
            if edits <= k[row]:
                a = int(min(max(low[row] + start, 0), size[row]))
                b = int(min(max(low[row] + end + i + 1, a), size[row]))
                best[row] = (edits, a, b)
    return best


def _search(items: Items, target: pa.Schema):
    def settle(jobs: list[tuple]) -> list[dict]:
        rows = []
        for at in range(0, len(jobs), 256):
            some = jobs[at:at + 256]
            for (doc, nth, i, _, _), found in zip(some, align(items, [j[2:] for j in some])):
                if found:
                    rows.append((nth, items.ids[i], *found, doc))
        rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2], r[3]))
        kept: list[tuple] = []
        for r in rows:
            rivals = (x for x in reversed(kept) if x[:2] == r[:2])
            if all(r[4] <= x[3] or r[3] >= x[4] for x in rivals):
                kept.append(r)
        return [{"doc_id": r[5], "item_id": r[1], "start": r[3], "end": r[4], "edits": r[2]} for r in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                jobs = []
                for doc, text in zip(*[c.to_pylist() for c in batch.slice(begin, 200).columns]):
                    nth += 1
                    points = plain(text)
                    item, band = items.bands(points)
                    jobs += [(doc, nth, i, b, points) for i, b in zip(item.tolist(), band.tolist())]
                if jobs:
                    yield pa.RecordBatch.from_pylist(settle(jobs), schema=target)

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every occurrence of an item in a text within its edit budget."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    require_columns(docs, key, text)
    require_columns(benchmark, item, item_text)
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = _parse_datatype_string(FOUND)
    target, found = to_arrow_schema(schema), docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark.select(F.col(item).cast("bigint"), F.col(item_text)), q, block_chars):
        found = found.unionByName(source.mapInArrow(_search(Items(block, q, rate), target), schema))
    return found


def _blocks(benchmark: DataFrame, q: int, block_chars: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items in blocks of bounded size; one block at a time is on the driver."""
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        points = plain(row[1])
        if len(points) < q:
            continue
        held.append((row[0], points))
        size += len(points)
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held
