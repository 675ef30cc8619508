"""Token lists in Parquet: one row per document, with encodings, row groups and pages laid out for selective reads.

Layout under a path:

* `tokens/`: (doc_id, part, local_start, n_tokens, tokens). Documents are range-partitioned and sorted by id, and each
  partition is one file; `part` numbers the files in order. Ids are written with a dictionary (two bytes or less
  a token while a row group holds fewer than 65,536 distinct ids) or with delta encoding; the sorted number columns
  are always delta encoded. Row groups hold about `row_group_bytes`, pages `page_rows` rows at most, and the writer
  adds a page index, so a filter on `doc_id`, `part` or `local_start` reaches single pages, and a
  read of the other columns never touches the tokens.
* `files/`: (part, first_doc, n_docs, n_tokens, base), one row a file, from the number columns alone. `base` is the
  number of ids in earlier files, so a document begins at `base + local_start`. Nothing is encoded or written twice.

Range borders take the id, a hash of the text and the row, so an id, or one text, that holds a third of all rows
spreads over many files. Equal ids keep the order of their hashes; rows equal in both have equal tokens, so
every column is the same whichever comes first.

Defined cases: a null text is an empty one and has the end id alone; null ids come first and stay null; repeated
rows and ids are written each; an empty table writes no rows and reads back as none; extra columns are not
carried, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackgeo.llm.byte_level import encoder
from trackgeo.llm.common import group_count, no_cycles, require_columns

END = 2
FILE_BYTES = 128 << 20
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 1 << 20, 2_000
TEXTS_AT_ONCE = 200
ROW = "doc_id bigint, part int, local_start bigint, n_tokens bigint, tokens array<int>"


def write_token_lists(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END,
                      encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
                      page_rows: int = PAGE_ROWS, file_bytes: int = FILE_BYTES, compression: str = "snappy") -> None:
    """Write the ids of every text, closed by `end`, under `path` in ascending order of `key`."""
    require_columns(docs, key, text)
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be dictionary or delta, not {encoding}")
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = ["doc_id", "hash", "row"]
    placed = source.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(
        group_count(spark, size, file_bytes), *order).sortWithinPartitions(*order)
    listed = placed.select("doc_id", "text").mapInArrow(_encode(tokenizer, end), ROW)
    writer = listed.write.option("compression", compression).option("parquet.writer.version", "PARQUET_2_0").option(
        "parquet.block.size", row_group_bytes).option("parquet.block.size.row.check.min", 10).option(
        "parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows).option(
        "parquet.enable.dictionary", "false")
    if encoding == "dictionary":
        writer = writer.option("parquet.enable.dictionary#tokens.list.element", "true")
    writer.parquet(f"{path}/tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    spark.read.schema(ROW).parquet(f"{path}/tokens").groupBy("part").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).withColumn(
        "base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/files")


def _encode(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, stop = encoder(tokenizer), np.array([end], np.uint32).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_AT_ONCE):
                piece = batch.slice(first, TEXTS_AT_ONCE)
                with no_cycles():
                    whole = [encode(t or "") + stop for t in piece.column(1).to_pylist()]
                sizes = np.array([len(w) // 4 for w in whole], np.int64)
                edges = np.append(0, np.cumsum(sizes))
                tokens = pa.ListArray.from_arrays(
                    pa.array(edges, pa.int32()), pa.array(np.frombuffer(b"".join(whole), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + edges[:-1]), pa.array(sizes), tokens],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
                at += int(edges[-1])

    return run


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start, n_tokens) of every document; no token is read."""
    return read_token_lists(spark, path).drop("tokens")


def read_token_lists(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start, n_tokens, tokens); `start` counts the ids of all documents before."""
    files = spark.read.schema("part int, base bigint").parquet(f"{path}/files")
    rows = spark.read.schema(ROW).parquet(f"{path}/tokens")
    return rows.join(files, "part").select(
        "doc_id", "part", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Tokens at positions `first` .. `last` - 1 of the whole stream, by document: (doc_id, start, tokens).

    The table of files names the parts that overlap, and inside one part the positions; both reach the scan.
    """
    files = spark.read.parquet(f"{path}/files").filter((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first))
    low, high, base = files.agg(F.min("part"), F.max("part"), F.min("base")).first()
    rows = spark.read.schema(ROW).parquet(f"{path}/tokens").filter(F.col("part").between(low, high))
    if low == high and low is not None:
        rows = rows.filter(F.col("local_start") < last - base)
    placed = rows.join(files.select("part", "base"), "part").withColumn("start", F.col("base") + F.col("local_start"))
    begin = F.greatest(F.lit(first), F.col("start"))
    size = F.least(F.lit(last), F.col("start") + F.col("n_tokens")) - begin
    return placed.filter(size > 0).select("doc_id", begin.alias("start"), F.slice(
        "tokens", (begin - F.col("start") + 1).cast("int"), size.cast("int")).alias("tokens"))


def checksums(lists: DataFrame) -> DataFrame:
    """`lists` with `ids_crc32` (of the ids as little-endian unsigned 32-bit integers) for its `tokens`."""
    from pyspark.sql.types import LongType, StructType

    names = [c for c in lists.columns if c not in ("tokens", "ids_crc32")]
    fields = lists.select(*names).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(len(names))
            ids, edges = tokens.values.to_numpy().astype("<u4", copy=False), tokens.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*names, "ids_crc32"])

    return lists.select(*names, "tokens").mapInArrow(run, StructType([*fields]).add("ids_crc32", LongType()))
