"""Best-fit packing by exact-complement hashing.

Documents become ids plus an end id; only those longer than a sequence are cut. The plan needs the number of
pieces of each length alone, at most `capacity` counters, so it is made on the driver: from the longest piece
down, a gap is filled exactly by one, two or three lengths whose sum equals it, as often as all are available;
what is left goes best-fit into the tightest gap. Equal sequences are planned as one pattern with a
multiplicity, so the plan's size depends on `capacity` and not on the number of documents.
Pieces are then numbered within their length, in the chunks they were written in, and the number alone gives
sequence and offset: no piece meets another.

Defined cases: a null text is an empty one and has the end id alone; repeated rows and repeated ids are packed
each; null ids stay null; extra columns are not carried; an empty table packs nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackgeo.llm.common import no_cycles, require_columns
from trackgeo.llm.tokenizing import encoder
from trackgeo.session import durable

CAPACITY = 2048
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
TEXTS_AT_ONCE = 300


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 0,
             capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: ids as little-endian unsigned 32-bit integers, the end id included."""
    require_columns(docs, key, text)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(PIECES))
    stop, step = np.array([end], np.uint32).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows = []
                with no_cycles():
                    whole = [encode(t or "") + stop for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), whole):
                    rows += [{"doc_id": doc, "piece": i // step, "start": i // 4, "length": len(ids[i:i + step]) // 4,
                              "ids": ids[i:i + step]} for i in range(0, len(ids), step)]
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, PIECES)


def _fill(gap: int, left: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to `gap`, with the largest first; None if there are none."""
    if gap <= 0:
        return () if gap == 0 else None
    if left[gap]:
        return (gap,)
    there = np.flatnonzero(left[:gap])[::-1]
    if not len(there):
        return None
    rest = gap - there  # the index of pair sums: what each available length still needs
    pair = there[(left[rest] > (rest == there)) & (rest <= there)]
    if len(pair):
        return int(pair[0]), int(gap - pair[0])
    for a in there:
        need = gap - int(a)
        if need > 2 * a:
            break
        low = there[there <= min(a, need - 1)]
        c = need - low
        ok = (c <= low) & (c > 0)
        low, c = low[ok], c[ok]
        ok = (left[c] > 0) & (left[low] >= 1 + (c == low)) & (left[a] >= 1 + (low == a) + (c == a))
        if ok.any():
            return int(a), int(low[ok][0]), int(c[ok][0])
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (multiplicity, lengths) that hold every counted piece once; no pattern exceeds `capacity`."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    done: list[tuple[int, tuple[int, ...]]] = []
    rest: list[int] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1  # the piece whose gap is filled
            found = _fill(capacity - length, left)
            left[length] += 1
            if found is None:
                rest.append(length)
                break
            lengths = (length, *found)
            need = defaultdict(int)
            for x in lengths:
                need[x] += 1
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= times * n
            done.append((times, lengths))
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(set(rest), reverse=True):
        n = int(left[length])
        for gap in sorted(g for g in gaps if g >= length):
            while n and gaps[gap]:
                times, lengths = gaps[gap].pop()
                fits = min(gap // length, n)  # of this length in one such sequence
                used = min(times, n // fits)
                gaps[gap - fits * length].append((used, lengths + (length,) * fits))
                if used < times:
                    gaps[gap].append((times - used, lengths))
                n -= used * fits
        each = capacity // length
        if n >= each:
            gaps[capacity - each * length].append((n // each, (length,) * each))
        if n % each:
            gaps[capacity - n % each * length].append((1, (length,) * (n % each)))
    return done + [p for patterns in gaps.values() for p in patterns]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Runs by (length, first number): the pieces numbered from there fill `width` slots in each sequence."""
    rows, seen, base = [], defaultdict(int), 0
    for times, lengths in patterns:
        offset = 0
        for length, width in _runs(lengths):
            rows.append((length, seen[length], base, width, offset))
            seen[length] += times * width
            offset += length * width
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "base", "width", "offset"), columns, strict=True))


def _runs(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in lengths:
        out[-1:] = [(x, out[-1][1] + 1)] if out and out[-1][0] == x else [*out[-1:], (x, 1)]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (any columns with `length`) with `sequence_id` and `offset`."""
    require_columns(pieces, "length")
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    fields = pieces.select(*[F.col(f"`{c}`") for c in names]).schema.fields
    # Input columns travel in one struct, so no name of theirs meets one of this plan.
    written = durable(pieces.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("piece"), F.col("length").cast("bigint").alias("length"),
        F.monotonically_increasing_id().alias("row")))
    chunk = F.shiftright("row", 33)
    tally = written.groupBy("length", chunk.alias("chunk")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk")
    offsets = tally.withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    counts = {r[0]: r[1] for r in written.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    runs = slots(plan(counts, capacity))
    within = Window.partitionBy("length", "chunk").orderBy("row")
    numbered = written.withColumn("chunk", chunk).withColumn("nth", F.row_number().over(within) - 1)
    ranked = numbered.join(offsets, ["length", "chunk"]).select("piece", "length", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = runs["length"] << 48 | runs["first"]
        for batch in batches:
            length, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            i = np.searchsorted(key, length << 48 | rank, side="right") - 1
            past = rank - runs["first"][i]
            width = runs["width"][i]
            columns = batch.column(0).flatten()
            columns += [pa.array(runs["base"][i] + past // width), pa.array(runs["offset"][i] + past % width * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    out = StructType(fields).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves, one row per sequence (at most `capacity` ids), from pieces with `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("parts"))
