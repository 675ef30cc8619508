"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, found by bitmasks.

Components become integers floor(scale * x), so distances, sums and ties are exact and the same in every order of
rows. A vector is cut into `parts` equal parts with a codebook of at most 64 entries each.

Search (slice and intersect): for each dimension of a part the entries' coordinates are sorted, and mask i holds, as
bits of one uint64, the entries among the first i coordinates. A box of a given radius around a query is then one range
of coordinates per dimension, its entries are mask[high] & ~mask[low], and the AND over dimensions leaves
the candidates. The initial radius is half the median distance from an entry to its nearest neighbour. Whoever finds an
entry at a distance within the radius is done; one with candidates beyond it looks once more with that distance as
radius; one without any doubles the radius. The box holds the ball, so the answer is exact at any radius.

Training is `rounds` of assignment and update. Tasks send 64 sums a part, Spark adds them up, and the codebooks (parts x
64 entries, whatever the input) go out again. Vectors are read afresh each time and never move.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; the first codebook is that
of the smallest distinct keys that are not null (of rows that share a key, the one with the smallest vector), so
fewer keys than entries make a smaller codebook, and rows that have null keys alone raise; repeated rows count and
come out each; null keys and labels stay, null labels sum together; all vectors must have the same length, a
multiple of `parts` above 0, and integers under 2^26 in size, else the job raises; an empty table gives no rows; extra
columns are not carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgeo.llm.common import require_columns
from trackgeo.session import durable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26
HOT_LABELS = 1_000  # labels with more than one in so many rows get their sum by broadcast
ROWS_AT_ONCE = 20_000
NONE = np.iinfo(np.int64).max


class Slices:
    """Exact nearest entries of one codebook (entries x dimensions, integers), ties to the lower number."""

    def __init__(self, book: np.ndarray):
        if not 0 < len(book) <= 64:
            raise ValueError(f"a codebook has 1 to 64 entries, not {len(book)}")
        self.book = book
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, axis=0)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.masks = np.zeros((len(book) + 1, book.shape[1]), np.uint64)
        np.bitwise_or.accumulate(bits, axis=0, out=self.masks[1:])
        apart = ((book[:, None] - book[None]) ** 2).sum(axis=2)
        near = np.where(apart > 0, apart, NONE).min(axis=1)
        self.radius = max(1, int(np.sqrt(np.median(near))) // 2) if (near < NONE).all() else 1

    def candidates(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within `radius` of each query in every dimension."""
        found = np.full(len(queries), self.masks[-1, 0])
        for d in range(queries.shape[1]):
            low = np.searchsorted(self.sorted[:, d], queries[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], queries[:, d] + radius, side="right")
            found &= self.masks[high, d] & ~self.masks[low, d]
        return found

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest entry of each query."""
        number, best = np.zeros(len(queries), np.int64), np.full(len(queries), NONE)
        open_, radius = np.arange(len(queries)), np.full(len(queries), self.radius, np.int64)
        while len(open_):
            mask = self.candidates(queries[open_], radius[open_])
            self._closest(queries, open_, mask, number, best)
            seen = best[open_] < NONE
            beyond = best[open_] > radius[open_] ** 2
            wider = np.where(seen, np.ceil(np.sqrt(best[open_].astype(np.float64))) + 1, radius[open_] * 2.0)
            radius[open_] = wider.astype(np.int64)
            open_ = open_[beyond]
        return number, best

    def _closest(self, queries: np.ndarray, rows: np.ndarray, mask: np.ndarray, number: np.ndarray, best: np.ndarray) -> None:
        """Confirm candidates from the lowest bit up; only a smaller distance replaces an earlier one."""
        mask = mask.copy()
        best[rows] = NONE
        while len(rows):
            some = mask != 0
            rows, mask = rows[some], mask[some]
            low = mask & (~mask + np.uint64(1))
            entry = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1  # powers of two are exact
            away = ((queries[rows] - self.book[entry]) ** 2).sum(axis=1)
            closer = away < best[rows]
            best[rows[closer]], number[rows[closer]] = away[closer], entry[closer]
            mask ^= low


def integers(column: pa.Array, parts: int, scale: float) -> np.ndarray:
    """(rows x dimensions) of floor(scale * x) from a list column without nulls."""
    edges = column.offsets.to_numpy()
    sizes = np.diff(edges)
    if not len(sizes):
        return np.zeros((0, 0), np.int64)
    if (sizes != sizes[0]).any() or sizes[0] == 0 or sizes[0] % parts:
        raise ValueError(f"vectors need one length, a multiple of {parts}; found {sorted(set(sizes.tolist()))[:5]}")
    values = np.floor(column.values.to_numpy()[edges[0]:edges[-1]].astype(np.float64) * scale)
    if np.abs(values).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more in size after scaling")
    return values.astype(np.int64).reshape(len(sizes), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def keep_finite(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """(vec_id, vector, label) of the rows whose vector is whole; floats and doubles alike."""
    usable = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    return vectors.filter(usable).select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), named.alias("label"))


def first_entries(kept: DataFrame, parts: int, entries: int, scale: float) -> np.ndarray:
    """Codebooks (parts x entries x width) from the smallest distinct keys; no entries for an empty table."""
    keys = kept.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries)
    least = kept.join(F.broadcast(keys), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))  # `entries` keys
    rows = least.orderBy("vec_id").toArrow().combine_chunks()
    if not rows.num_rows:
        if kept.limit(1).count():
            raise ValueError("no row has a key, so there is no first codebook")
        return np.zeros((parts, 0, 0), np.int64)
    values = integers(rows.column("vector").chunk(0), parts, scale)
    return values.reshape(len(values), parts, -1).transpose(1, 0, 2).copy()


def train_round(kept: DataFrame, books: np.ndarray, scale: float) -> np.ndarray:
    """Codebooks after one assignment of all rows; entries that no part chose stay."""
    parts, entries, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Slices(b) for b in sent.value]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _slices(batches):
            values = integers(batch.column(0), parts, scale)
            if len(values) and values.shape[1] != parts * width:
                raise ValueError(f"vectors need one length; found {values.shape[1]} and {parts * width}")
            for p, search in enumerate(searches):
                some = values[:, p * width:(p + 1) * width]
                chosen = search.nearest(some)[0]
                count[p] += np.bincount(chosen, minlength=entries)
                np.add.at(total[p], chosen, some)
        part, entry = np.nonzero(count)
        if len(part):
            cells = np.repeat(part * entries + entry, width)
            yield pa.RecordBatch.from_arrays([
                pa.array(cells), pa.array(np.tile(np.arange(width), len(part))),
                pa.array(np.repeat(count[part, entry], width)), pa.array(total[part, entry].ravel())], names=["cell", "at", "n", "total"])

    sums = kept.select("vector").mapInArrow(run, "cell bigint, at bigint, n bigint, total bigint").groupBy("cell", "at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()  # one row a component of the codebooks
    after = books.copy()
    cell, at = sums.column("cell").to_numpy(), sums.column("at").to_numpy()
    after[cell // entries, cell % entries, at] = sums.column("total").to_numpy() // sums.column("n").to_numpy()
    return after


def train_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> np.ndarray:
    """Codebooks (parts x entries x width) after all rounds over all rows."""
    books = first_entries(kept, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = train_round(kept, books, scale)
    return books


def assign(kept: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, codes, error): codes as one byte a part, error as the exact squared distance."""
    parts, _, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Slices(b) for b in sent.value] if width else []
        for batch in _slices(batches):
            values = integers(batch.column(2), parts, scale)
            codes, error = np.zeros((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
            for p, search in enumerate(searches):
                chosen, away = search.nearest(values[:, p * width:(p + 1) * width])
                codes[:, p] = chosen
                error += away
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(error)],
                names=["vec_id", "label", "codes", "error"])

    from pyspark.sql.types import BinaryType, LongType, StructType

    out = StructType([kept.schema["vec_id"], kept.schema["label"]]).add("codes", BinaryType()).add("error", LongType())
    return kept.select("vec_id", "label", "vector").mapInArrow(run, out)


def label_errors(assigned: DataFrame) -> DataFrame:
    """`assigned` (a written table) with `label_error`, the sum of `error` over rows of the same label.

    Labels with more than a thousandth of all rows are fewer than a thousand and meet their rows by broadcast; the rest
    are joined by label, where no label is large.
    """
    sums = durable(assigned.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    rows = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marked = sums.select(F.col("label").alias("of"), "label_error", "n")
    hot, rest = marked.filter(F.col("n") > rows // HOT_LABELS).drop("n"), marked.filter(F.col("n") <= rows // HOT_LABELS).drop("n")
    same = assigned["label"].eqNullSafe(F.col("of"))
    known = assigned.join(F.broadcast(hot), same).drop("of")
    others = assigned.join(F.broadcast(hot.select("of")), same, "left_anti")
    return known.unionByName(others.join(rest, others["label"].eqNullSafe(rest["of"])).drop("of"))


def encode_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
                   parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, codes, error, label_error) of every usable row, the codebooks)."""
    require_columns(vectors, key, vector, *([label] if label else []))
    kept = keep_finite(vectors, key, vector, label)
    books = train_codebooks(kept, parts, entries, rounds, scale)
    return label_errors(durable(assign(kept, books, scale))), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
