"""Token counts of documents in flat token files, by scanning for the end-of-document id.

A file is nothing but unsigned 16-bit ids, documents one after another, each closed by the end id; there is no
index. `write_token_files` makes such files with Spark's text sink: a document's bytes are the line, and the two
bytes of the end id are the line separator. Each document opens with `HEADER` ids that spell its own id in
15-bit digits, which can never equal the end id. An end id that a text itself spells is written as `SPELT`, an id
that no word has, so it counts as the one token it is.

`scan_token_files` reads files by Spark's binary source in any store, cuts them into blocks of `BLOCK` ids and looks
for end ids in each block with one vector comparison. Blocks do not know where their first document began; a
running maximum over the earlier blocks of the file (a prefix scan of last ends) stitches them.

A file is held whole by the task that reads it, so writers keep files within the size of an input split; blocks
bound everything after that. Defined cases: null and empty texts count zero ids; null ids come back null;
repeated rows count each; ids after the last end id of a file form no document; a file whose size is odd
raises; an empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackgeo.llm.common import no_cycles, require_columns
from trackgeo.llm.tokenizing import encoder

END = 49407  # the tokenizer's end-of-text id; as bytes FF C0
SPELT = END + 1
HEADER = 5
BLOCK = 1 << 19
SEEN = "ends array<bigint>, starts array<bigint>, ids array<bigint>"


def spell(doc: int | None) -> bytes:
    """A 64-bit id or null as `HEADER` ids below 2^15."""
    value = 0 if doc is None else (doc & (1 << 64) - 1) + 1
    return np.array([value >> 15 * i & 0x7FFF for i in range(HEADER)], np.uint16).tobytes()


def read_spelt(ids: np.ndarray) -> int | None:
    value = sum(int(x) << 15 * i for i, x in enumerate(ids)) - 1
    return None if value < 0 else value - (1 << 64) if value >= 1 << 63 else value


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text under `path`, one flat file per task."""
    require_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, np.uint16), np.array([END], np.uint16).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lines = []
                with no_cycles():
                    whole = [encode(t or "") for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), whole):
                    if (np.frombuffer(ids, np.uint16) == END).any():  # only where a text spells the end mark
                        ids = np.where(np.frombuffer(ids, np.uint16) == END, np.uint16(SPELT), np.frombuffer(ids, np.uint16)).tobytes()
                    lines.append(spell(doc) + ids)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["ids"])

    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    source.mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value")).write.option(
        "lineSep", "ÿÀ").option("encoding", "ISO-8859-1").text(path)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends in each block, and the documents that begin in it with their spelt ids (positions in the file)."""
    for batch in batches:
        for file, block, data in zip(*[batch.column(i) for i in range(3)]):
            ids = np.frombuffer(data.as_py(), np.uint16)
            base = block.as_py() * BLOCK
            ends = np.flatnonzero(ids[:BLOCK] == END)
            starts = ends + 1
            if base == 0:
                starts = np.append(0, starts)
            starts = starts[starts + HEADER <= len(ids)]  # the overlap shows whole headers, but at the file's end
            yield pa.RecordBatch.from_arrays([
                pa.array([file.as_py()]), pa.array([block.as_py()], pa.int32()),
                pa.array([(ends + base).tolist()], pa.list_(pa.int64())),
                pa.array([(starts + base).tolist()], pa.list_(pa.int64())),
                pa.array([[read_spelt(ids[s:s + HEADER]) for s in starts.tolist()]], pa.list_(pa.int64()))],
                names=["file", "block", "ends", "starts", "ids"])


def scan_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, doc_id, n_tokens) of every document in the flat files under `path`."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), "length", "content").withColumn(
        "length", F.when(F.col("length") % 2 == 0, F.col("length")).otherwise(F.raise_error("a token file has an odd size")))
    blocks = files.filter("length > 0").select("file", "content", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("length") - 1) / (2 * BLOCK)).cast("int"))).alias("block")).select(
        "file", "block", F.substring("content", F.col("block") * (2 * BLOCK) + 1, F.lit(2 * (BLOCK + HEADER + 1))).alias("data"))
    seen = blocks.mapInArrow(_scan, f"file string, block int, {SEEN}")
    begun = F.transform(F.arrays_zip("starts", "ids"), lambda x: F.struct(x["starts"].alias("start"), x["ids"].alias("id")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = seen.withColumn("_begun", begun).withColumn("_last", F.max(F.get("_begun", F.size("_begun") - 1)).over(before))
    # Documents open in this block, in order; one that began earlier comes first. The n-th end closes the n-th.
    opened = F.concat(F.array_compact(F.array("_last")), "_begun")
    open_then = stitched.withColumn("_open", opened)
    return open_then.select("file", F.posexplode("ends").alias("nth", "end"), "_open").select(
        "file", F.get("_open", F.col("nth"))["start"].alias("start"), F.get("_open", F.col("nth"))["id"].alias("doc_id"),
        (F.col("end") - F.get("_open", F.col("nth"))["start"] - HEADER).alias("n_tokens"))
