"""Exact substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

1. Each task rolls a polynomial hash (base and word hashes of 64 bits, modulo 2^64, then mixed) over the
   words of its documents, a few million windows at a time. Within such a batch only the smallest document of
   a window stays undecided; the others are decided at once. So a passage in a third of all documents
   leaves a task once, not once per document.
2. Undecided windows are dealt out by hash range as sorted, delta-packed blocks. A group of blocks gives each
   hash its smallest document; the others get the hash back, in one block per group of documents.
3. Documents meet their repeated hashes, roll again, and repeated windows merge into maximal intervals.

A window is removed in every document but the smallest `doc_id` that holds it. Windows are judged on the
input. Groups in step 2 are sized by a count of the text, so their number grows with the input. Equality is
that of 64-bit hashes: at 10^13 windows a given window is matched falsely with odds of about 5 in 10^7.

Defined cases: a null text has no words; a null id neither removes nor is removed; rows with one id are
one document for the rule (both keep, both are trimmed); texts shorter than a window stay; an empty table gives
an empty table; other columns pass through, and input columns with the names of results are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from trackgeo.llm.common import group_count, require_columns

WIDTH = 13
BASE = 0x9E3779B97F4A7C15  # odd, so that multiplication by it loses nothing
BATCH_WINDOWS = 2_000_000
GROUP_WINDOWS = 3_000_000
RESULTS = ("n_words", "n_removed", "kept_text", "removed")
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to `most` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def roll(words: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """Hash of each window of `width` words; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(BASE)
        out += h[i:i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, with as few bytes each as the largest one needs."""
    return _planes(np.diff(values, prepend=values[:1] * 0))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Integers byte by byte: all lowest bytes, then all second ones, ...; a plane is compressed if that helps."""
    need = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = [p.tobytes() for p in values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :need].T]
    short = [zstandard.ZstdCompressor(level=1).compress(p) for p in planes]
    best = [(1, s) if len(s) < 0.95 * len(p) else (0, p) for p, s in zip(planes, short)]
    return struct.pack("<BI", need, len(values)) + b"".join(struct.pack("<BI", k, len(x)) + x for k, x in best)


def _numbers(data: bytes) -> np.ndarray:
    need, n = struct.unpack_from("<BI", data)
    out, at = np.zeros((n, 8), np.uint8), 5
    for i in range(need):
        kind, size = struct.unpack_from("<BI", data, at)
        plane = data[at + 5:at + 5 + size]
        out[:, i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(plane) if kind else plane, np.uint8)
        at += 5 + size
    return out.view(np.uint64).ravel()


def packed(h: np.ndarray, owner: np.ndarray) -> dict:
    """Pairs of hash and owner, sorted by hash, as one block."""
    named, place = np.unique(owner, return_inverse=True)
    return {"hashes": pack(h), "owners": _planes(place),
            "ids": pack(named.view(np.uint64) ^ np.uint64(1 << 63))}  # ascending, as the sign bit is turned


def unpacked(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    hashes, owners = [], []
    for h, o, ids in zip(blocks["hashes"], blocks["owners"], blocks["ids"]):
        named = (unpack(ids) ^ np.uint64(1 << 63)).view(np.int64)
        hashes.append(unpack(h))
        owners.append(named[_numbers(o).astype(np.int64)])
    return np.concatenate(hashes), np.concatenate(owners)


def _to_documents(h: np.ndarray, owner: np.ndarray, groups: int) -> Iterator[dict]:
    """Decided pairs as one block per group of documents; these have the numbers -1, -2, ..."""
    mixed = owner.view(np.uint64) * np.uint64(BASE)
    group = (mixed >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    by = np.lexsort((h, group))
    edges = np.searchsorted(group[by], np.arange(groups + 1, dtype=np.uint64))
    for g in np.flatnonzero(np.diff(edges)):
        some = by[edges[g]:edges[g + 1]]
        yield {"group_no": -1 - int(g), **packed(h[some], owner[some])}


def _blocks(width: int, groups: int, target: pa.Schema):
    """Step 1: undecided windows per hash range, and decided ones per group of documents."""

    def flush(ids: list[int], hashes: list[np.ndarray]) -> Iterator[dict]:
        h, owner = np.concatenate(hashes), np.repeat(np.asarray(ids, np.int64), [len(x) for x in hashes])
        by = np.lexsort((owner, h))
        h, owner = h[by], owner[by]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        undecided, least = h[start], owner[start]
        late = owner != np.repeat(least, np.diff(np.append(start, len(h))))
        group = (undecided >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)  # ascending as the hashes are
        edges = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
        for g in np.flatnonzero(np.diff(edges)):
            some = slice(edges[g], edges[g + 1])
            yield {"group_no": int(g), **packed(undecided[some], least[some])}
        yield from _to_documents(h[late], owner[late], groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, ids, hashes, held = WordHashes(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                rolled = roll((text.as_py() or "").encode("utf-8", "surrogatepass").split(), width, known)
                if len(rolled):
                    ids.append(doc.as_py())
                    hashes.append(rolled)
                    held += len(rolled)
                if held >= BATCH_WINDOWS:
                    yield from flush(ids, hashes)
                    ids, hashes, held = [], [], 0
        if held:
            yield from flush(ids, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for row in work(batches):
            rows.append(row)
            size += len(row["hashes"])
            if size > 4_000_000 or len(rows) >= 5_000:
                yield pa.RecordBatch.from_pylist(rows, schema=target)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    return run


def _repeats(groups: int):
    """Step 2: hashes of one range that a document shares with a smaller one; decided ones pass."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        if blocks["group_no"].iat[0] < 0:
            return blocks
        h, owner = unpacked(blocks)
        by = np.argsort(h, kind="stable")
        h, owner = h[by], owner[by]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        least = np.repeat(np.minimum.reduceat(owner, start), np.diff(np.append(start, len(h))))
        late = owner > least
        return pd.DataFrame(_to_documents(h[late], owner[late], groups), columns=blocks.columns)

    return run


def _by_document(blocks: pd.DataFrame) -> pd.DataFrame:
    """Repeated hashes of each document of one group."""
    h, owner = unpacked(blocks)
    by = np.lexsort((h, owner))
    h, owner = h[by], owner[by]
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return pd.DataFrame({"doc": owner[edges], "_hashes": [
        pack(np.unique(h[a:b])) for a, b in zip(edges, np.append(edges[1:], len(owner)))]})


def intervals(hit: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Maximal intervals [start, end) of words that windows starting at `hit` positions cover."""
    if not len(hit):
        return np.empty((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(hit) > width)
    return np.stack([hit[np.append(0, cut + 1)], np.minimum(hit[np.append(cut, len(hit) - 1)] + width, n_words)], 1)


def _squeeze(text_at: int, target: pa.Schema):
    """Texts compressed for the way through the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            columns = list(batch.columns)
            columns[text_at] = pa.array([None if t is None else small.compress(t.encode("utf-8", "surrogatepass"))
                                         for t in columns[text_at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return run


def _trim(width: int, rest: list[str], text_at: int, target: pa.Schema):
    """Step 3: cut the covered words out of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, full = WordHashes(), zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out: dict[str, list] = {c: [] for c in RESULTS}
                texts = [None if t is None else full.decompress(t) for t in batch.column(f"c{text_at}").to_pylist()]
                for text, found in zip(texts, batch.column("_hashes")):
                    words = (text or b"").split()
                    spans, found = [], found.as_py()
                    if found:
                        repeated = unpack(found)
                        rolled = roll(words, width, known)
                        place = np.minimum(np.searchsorted(repeated, rolled), len(repeated) - 1)
                        spans = intervals(np.flatnonzero(repeated[place] == rolled), width, len(words)).tolist()
                    kept, last = [], 0
                    for a, b in spans:
                        kept += words[last:a]
                        last = b
                    kept += words[last:]
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(kept))
                    out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                    out["removed"].append([{"start": a, "end": b} for a, b in spans])
                columns = [batch.column(f"c{i}") for i in range(len(rest))]
                columns[text_at] = pa.array([None if t is None else t.decode("utf-8", "surrogatepass") for t in texts], pa.string())
                columns += [pa.array(out[c], type=target.field(len(rest) + i).type) for i, c in enumerate(RESULTS)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return run


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """`docs` with n_words, n_removed, kept_text (kept words, one space between) and `removed` word spans.

    `key` must be an integer column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    require_columns(docs, key, text)
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    characters = source.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = group_count(spark, characters // 6, GROUP_WINDOWS)
    block = StructType([StructField("group_no", LongType()), StructField("hashes", BinaryType()),
                        StructField("owners", BinaryType()), StructField("ids", BinaryType())])
    blocks = source.filter("doc is not null").mapInArrow(_blocks(width, groups, to_arrow_schema(block)), block)
    decided = blocks.groupBy("group_no").applyInPandas(_repeats(groups), block)
    repeats = decided.groupBy("group_no").applyInPandas(_by_document, "doc bigint, _hashes binary")

    rest = [c for c in docs.columns if c.lower() not in RESULTS]
    fields = [StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(rest)]
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept_text", StringType()), StructField("removed", SPANS)])
    named = docs.select(F.col(f"`{key}`").cast("bigint").alias("_doc"),
                        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    at = rest.index(text) + 1
    small = StructType([StructField("_doc", LongType()), *fields])
    small = StructType([StructField(f.name, BinaryType()) if i == at else f for i, f in enumerate(small.fields)])
    named = named.mapInArrow(_squeeze(at, to_arrow_schema(small)), small)
    met = named.join(repeats, named["_doc"] == repeats["doc"], "left").drop("doc", "_doc")
    out = met.mapInArrow(_trim(width, rest, rest.index(text), to_arrow_schema(schema)), schema)
    return out.toDF(*rest, *RESULTS)
