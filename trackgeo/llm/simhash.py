"""SimHash near-dedup by anchor-point covering.

Fingerprint: each word shingle (repeats included) votes with the bits of its XXH64 (seed 42); a bit is set if
set in over half the hashes. Longer fingerprints mix the same hash once per 64 bits.

Linking: a covering code chooses the anchors: blocks of seven bits with the perfect [7,4] code (radius 1), and
single bits that are their own anchors. Every point has an anchor within the radius of each block. Two
fingerprints at distance t have a point half-way, and that point's anchor lies within the radius plus t/2 of
both; so replicating each fingerprint to all anchors within radius plus t/2 brings every such pair together at
an anchor (the threshold is split between the two sides, where one side alone would need radius plus t and
twelve times the rows). Pairs are compared at their anchor only.

A fingerprint longer than one chunk is covered chunk by chunk: a pair is a candidate if some chunk is within
`chunk_distance`, and a link if the whole fingerprints are within `distance`. With one chunk nothing is lost.

Skew: equal fingerprints are one node. An anchor with more than `CELL` members is marked in the task that sees
it, its members leave the anchor and are compared at their own one-bit neighbours (65 points for 64 bits) of
that chunk. Members of a point are within two bits there: with one chunk a star links them all, with more
chunks whole fingerprints are compared with a few leaders, so work grows with members times families and no
point grows into all pairs. Links form components by alternating stars.

Defined cases: null and blank texts have fingerprint zero, linked like any other; texts with fewer words than a
shingle hash the whole sequence; null ids keep their row, and a component's id is its smallest known id (null
if it has none); rows with one id are rows of their own; an empty table gives an empty table; extra columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackgeo.llm.common import group_count, require_columns
from trackgeo.llm.components import components
from trackgeo.session import durable

SEED = 42
CELL = 64
NODES_AT_ONCE = 4_000


def _voted(hashes: np.ndarray) -> int:
    """One 64-bit word: the bits set in over half of `hashes`."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    lanes = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # byte lanes, 255 votes at most
    votes = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: str | None, shingle: int, n_words: int = 1) -> list[int]:
    """Signed 64-bit words of the fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes lower A-Z alone
    if not words:
        return [0] * n_words
    digest, size = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    hashes = np.fromiter(
        (digest(b" ".join(words[i:i + shingle]), SEED) for i in range(size)), np.uint64, size)
    out = [_voted(hashes)]
    for j in range(1, n_words):
        mixed = hashes + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(_voted(mixed ^ mixed >> np.uint64(31)))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fingerprint) of every row; the fingerprint is an array of bits / 64 signed words."""
    require_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle, bits // 64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "fingerprint"])

    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, fingerprint array<bigint>")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


# --- anchors -----------------------------------------------------------------------------------------

def _block(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor numbers, cost) by block value: cost is the distance beyond the block's covering radius."""
    if size == 1:
        return np.array([[0, 1], [0, 1]]), np.array([[0, 1], [1, 0]])
    values = np.arange(128, dtype=np.uint8)
    # Perfect [7,4] code: the positions of set bits, counted from 1, cancel out.
    syndrome = np.zeros(128, np.uint8)
    for place in range(7):
        syndrome ^= np.where(values >> place & 1, place + 1, 0).astype(np.uint8)
    codewords = values[syndrome == 0]
    distance = np.bitwise_count(values[:, None] ^ codewords[None, :]).astype(int)
    return np.tile(np.arange(16), (128, 1)), np.maximum(0, distance - 1)


def blocks_of(chunk_bits: int) -> list[int]:
    return [7] * (chunk_bits // 7) + [1] * (chunk_bits % 7)


def anchors(points: np.ndarray, chunk_bits: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors within the covering radius plus `slack` of each point."""
    row, anchor = np.arange(len(points)), np.zeros(len(points), np.int64)
    cost, at = np.zeros(len(points), int), 0
    for size in blocks_of(chunk_bits):
        numbers, extra = _block(size)
        value = (points[row] >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(int)
        total = cost[:, None] + extra[value]
        i, j = np.nonzero(total <= slack)
        row, cost, anchor = row[i], total[i, j], anchor[i] * (16 if size == 7 else 2) + numbers[value[i], j]
        at += size
    return row, anchor


def _chunks(prints: np.ndarray, chunk_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Chunks of fingerprints (rows x words); a chunk does not cross a word."""
    each = 64 // chunk_bits
    for j in range(prints.shape[1] * each):
        word = prints[:, j // each] >> np.uint64(j % each * chunk_bits)
        yield j, word & np.uint64((1 << chunk_bits) - 1)


def _replicate(chunk_bits: int, slack: int):
    """(key, node, sketch) at every anchor. Crowded anchors become a mark (node -1); members go to keys < 0,
    which hold the chunk and are spread by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, NODES_AT_ONCE):
                batch = whole.slice(at, NODES_AT_ONCE)
                node = batch.column(0).to_numpy()
                prints = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
                for j, points in _chunks(prints, chunk_bits):
                    row, anchor = anchors(points, chunk_bits, slack)
                    key = np.int64(j) << 48 | anchor
                    by = np.argsort(key, kind="stable")
                    key, row = key[by], row[by]
                    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    size = np.diff(np.append(start, len(key)))
                    crowded = np.repeat(size > CELL, size)
                    marks = key[start[size > CELL]]
                    key[crowded] = ~(np.int64(j) << 48 | node[row[crowded]] & (1 << 48) - 1)
                    keys = np.concatenate([key, marks])
                    nodes = np.concatenate([node[row], np.full(len(marks), -1)])
                    sketch = np.concatenate([prints[row, 0], np.zeros(len(marks), np.uint64)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(nodes), pa.array(sketch.view(np.int64))], names=["key", "node", "sketch"])

    return run


def _compare(limit: int):
    """Links inside each anchor, from rows sorted by (key, node); a member of a crowded anchor comes out alone,
    with -1 - chunk for a partner."""

    def cells(key, node, sketch, hot_key) -> pa.RecordBatch:
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        hot = np.repeat((size > CELL) | (node[start] == -1) | (key[start] < 0) | (key[start] == hot_key), size)
        alone = hot & (node >= 0)
        a, b = [node[alone]], [-1 - (np.where(key < 0, ~key, key)[alone] >> 48)]
        keep = ~hot & (np.repeat(size, size) > 1)
        key, node, sketch = key[keep], node[keep], sketch[keep]
        for step in range(1, CELL):
            same = key[step:] == key[:-step]
            if not same.any():
                break
            near = same & (np.bitwise_count(sketch[step:] ^ sketch[:-step]) <= limit)
            a.append(node[:-step][near])
            b.append(node[step:][near])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        hot_key = None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            key, node, sketch = (np.concatenate([x, y]) for x, y in zip(held, new))
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])  # the last anchor may go on
            if last:
                yield cells(key[:last], node[:last], sketch[:last], hot_key)
            held = [key[last:], node[last:], sketch[last:]]
            if len(held[0]) > CELL or held[1][0] == -1 or held[0][0] == hot_key:
                hot_key = held[0][0]
                yield cells(*held, hot_key)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield cells(*held, hot_key)

    return run


def _neighbours(chunk_bits: int):
    """(chunk, point, node, fingerprint) for the crowded chunk of each fingerprint and its one-bit neighbours."""
    flips = np.concatenate([[0], 1 << np.arange(chunk_bits, dtype=np.uint64)]).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, NODES_AT_ONCE):
                batch = whole.slice(at, NODES_AT_ONCE)
                chunk = batch.column(1).to_numpy()
                prints = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(len(chunk), -1)
                points = np.stack([p for _, p in _chunks(prints, chunk_bits)], axis=1)[np.arange(len(chunk)), chunk]
                near = (points[:, None] ^ flips[None, :]).ravel()
                row = pa.array(np.repeat(np.arange(len(chunk)), len(flips)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(row), pa.array(near.view(np.int64)), batch.column(0).take(row), batch.column(2).take(row)],
                    names=["chunk", "point", "node", "fingerprint"])

    return run


def _apart(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits between each of `prints` and `one`."""
    return np.bitwise_count(prints ^ one).sum(axis=-1, dtype=np.int64)


def spanning(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) at `limit` bits or fewer that connect what all such links of the group connect.

    Each row joins the first leader within the limit, or leads. Rows of two leaders can be linked only if each is
    within twice the limit of the other's leader; of those the first link is enough.
    """
    own, left = np.full(len(prints), -1), np.arange(len(prints))
    while len(left):
        near = _apart(prints[left], prints[left[0]]) <= limit
        own[left[near]] = left[0]
        left = left[~near]
    member = np.flatnonzero(own != np.arange(len(own)))
    a, b = [own[member]], [member]
    for leader in np.unique(own):
        reach = _apart(prints, prints[leader]) <= 2 * limit
        for other in np.unique(own[reach & (own > leader)]):
            here = np.flatnonzero((own == leader) & (_apart(prints, prints[other]) <= 2 * limit))
            there = np.flatnonzero(reach & (own == other))
            for i in here:
                j = there[_apart(prints[there], prints[i]) <= limit]
                if len(j):
                    a.append(np.array([i]))
                    b.append(j[:1])
                    break
    return np.concatenate(a), np.concatenate(b)


def _forest(limit: int):
    """Spanning links of each point, from rows sorted by (chunk, point)."""

    def linked(rows: pa.Table) -> pa.RecordBatch:
        chunk, point, node = (rows.column(i).to_numpy() for i in range(3))
        prints = rows.column(3).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        start = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (point[1:] != point[:-1]), [True]]))
        a, b = [node[:0]], [node[:0]]
        for k in np.flatnonzero(np.diff(start) > 1):
            i, j = spanning(prints[start[k]:start[k + 1]], limit)
            a.append(node[start[k] + i])
            b.append(node[start[k] + j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, point = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = int(np.flatnonzero((chunk == chunk[-1]) & (point == point[-1]))[0])  # the last point may go on
            if held and (last or (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (chunk[0], point[0])):
                yield linked(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield linked(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield linked(pa.Table.from_batches(held))

    return run


def links(nodes: DataFrame, distance: int, chunk_bits: int = 64, chunk_distance: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all nodes (node, fingerprint) within the distances."""
    spark = nodes.sparkSession
    chunk_distance = distance if chunk_distance is None else chunk_distance
    whole = nodes.select(F.size("fingerprint")).first()
    if whole is None:
        return spark.createDataFrame([], "a bigint, b bigint")
    n_words, slack = whole[0], -(-chunk_distance // 2)
    one = n_words * 64 == chunk_bits
    if one and chunk_distance > 2 or chunk_distance > 2:
        raise ValueError("crowded anchors are compared at one-bit neighbours, so chunks link at 2 bits or fewer")
    # Of a long fingerprint the first word filters at its mean distance plus four deviations, before the full test.
    share = distance / (64 * n_words)
    limit = distance if one else int(64 * share + 4 * (64 * share * (1 - share)) ** 0.5)
    spread = nodes.select("node", "fingerprint").mapInArrow(_replicate(chunk_bits, slack), "key bigint, node bigint, sketch bigint")
    found = durable(spread.repartition(group_count(spark, 1, 1), "key").sortWithinPartitions("key", "node").mapInArrow(
        _compare(limit), "a bigint, b bigint").distinct())
    pairs = found.filter("b >= 0")
    crowded = found.filter("b < 0").selectExpr("a AS node", "-1 - b AS chunk").join(nodes, "node")
    points = crowded.select("node", "chunk", "fingerprint").mapInArrow(
        _neighbours(chunk_bits), "chunk bigint, point bigint, node bigint, fingerprint array<bigint>")
    if one:  # all at a point are within 2 bits of each other
        least = points.groupBy("chunk", "point").agg(F.min("node").alias("a"), F.collect_set("node").alias("bs"))
        return pairs.unionByName(least.select("a", F.explode("bs").alias("b")).filter("a <> b")).distinct()
    full = nodes.select("node", "fingerprint")
    met = pairs.join(full.toDF("a", "fa"), "a").join(full.toDF("b", "fb"), "b").filter(
        hamming(F.col("fa"), F.col("fb")) <= distance).select("a", "b")
    more = points.repartition("chunk", "point").sortWithinPartitions("chunk", "point").mapInArrow(
        _forest(distance), "a bigint, b bigint")
    return met.unionByName(more).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64,
                    distance: int = 2, chunk_bits: int = 64, chunk_distance: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; the component is named by its smallest id."""
    prints = durable(fingerprints(docs, key, text, shingle, bits))
    nodes = durable(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn(
        "node", F.monotonically_increasing_id()))
    groups = components(links(nodes, distance, chunk_bits, chunk_distance))
    named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select("fingerprint", "component_id")
    return prints.join(ids, "fingerprint", "left")
