"""Token counts from flat token files without an index, by a scan for end-of-document ids.

A file is a run of fixed-width ids in which an end id follows each document. It is taken in blocks, rows of a table
(file, block, data): ``read_token_files`` cuts flat files into them, ``write_token_files`` makes such a table, which any
store that Spark writes to can hold and of which many tasks read one file's blocks.
Each block is searched on its own; a prefix scan over the blocks' summaries then tells how many documents ended before a
block and how many ids of an open one it carries on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import new_path, written
from weirflow.llm.tokens import END_OF_DOCUMENT, encode_texts, vocabulary_path

BLOCK_TOKENS = 1 << 18
DTYPE = "<u2"
#: Blocks whose summaries one task of the scan's first level takes.
SCAN_BLOCKS = 1024


def write_token_files(docs: DataFrame, path: str, end_id: int = END_OF_DOCUMENT, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one token file for each partition; the table of blocks, in which rows with ``ids`` list the documents in order.

    The lists hold no places or counts. Null texts count as empty: such a document is an end id alone.
    """
    vocabulary = vocabulary or vocabulary_path()
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, listed, waiting, ids = TaskContext.get().partitionId(), 0, 0, [], []
        row = lambda n, data, ids: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, n, data, ids), schema.types, strict=True)], schema=schema)
        size = 0

        def blocks(last: bool):
            nonlocal waiting, size, block
            flat = np.concatenate(waiting) if waiting else np.zeros(0, dtype)
            whole = len(flat) if last else len(flat) // block_tokens * block_tokens
            for at in range(0, whole, block_tokens):
                yield row(block, flat[at : min(at + block_tokens, whole)].tobytes(), None)
                block += 1
            waiting, size = [flat[whole:]], len(flat) - whole

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for doc, tokens in zip(part.column(0).to_pylist(), encode_texts(part.column(1).to_pylist(), vocabulary), strict=True):
                    waiting.append(np.append(tokens, end_id).astype(dtype))
                    size += len(waiting[-1])
                    ids.append(doc)
                if size >= block_tokens:
                    yield from blocks(False)
                if len(ids) >= 4096:
                    yield row(listed, None, ids)
                    listed, ids = listed + len(ids), []
        yield from blocks(True)
        if ids:
            yield row(listed, None, ids)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    kind = "file long, block long, data binary, ids array<long>"
    source.mapInArrow(run, kind).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(kind).parquet(path)


def read_token_files(spark: SparkSession, path: str, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files, nothing but ids one after another, as blocks: path, file (a hash of it), block, data.

    A file is read by one task and cut there, so files are of a size that a task can hold (2 GB at most); a file whose size
    is no multiple of an id's is an error. An empty file has no blocks.
    """
    width = np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                if len(data) % width:
                    raise ValueError(f"{name} has {len(data)} bytes, ids have {width}")
                for at in range(0, max(1, len(data)), block_tokens * width):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // (block_tokens * width)], pa.int64()), pa.array([bytes(data[at : at + block_tokens * width])], pa.binary())], ["path", "block", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cut, "path string, block long, data binary").select("path", F.xxhash64("path").alias("file"), "block", "data")


def scan_blocks(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, dtype: str = DTYPE) -> DataFrame:
    """What each block shows: ids in it, ends in it, the place of the last, and the lengths between them.

    ``counts`` has the ids before the first end and those between ends; an empty block has none.
    """
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.int64()), ("last", pa.int64()), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(data or b"", dtype)
                at = np.flatnonzero(ids == end_id)
                counts = np.diff(at, prepend=-1) - 1
                row = (file, block, len(ids), len(at), int(at[-1]) if len(at) else None, counts.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    return blocks.select("file", "block", "data").mapInArrow(run, "file long, block long, n long, ends long, last long, counts array<int>")


def count_tokens(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, dtype: str = DTYPE, scan_blocks_at_once: int = SCAN_BLOCKS) -> DataFrame:
    """Tokens of every document of every file: file, ordinal, n_tokens, ended.

    Ids after a file's last end are a document that has not ended; a file that stops at an end has none. Two ends in
    a row make a document of no tokens. Empty blocks, files and tables are allowed.
    """
    found, _ = written(scan_blocks(blocks, end_id, dtype), "blocks")
    some = found.select("file", "block", "n", "ends", "last", F.floor(F.col("block") / scan_blocks_at_once).alias("g"))
    inner = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # First level: sums within a run of blocks; second: over the runs' totals.
    here = some.withColumns({"pos": F.coalesce(F.sum("n").over(inner), zero), "ord": F.coalesce(F.sum("ends").over(inner), zero)})
    here = here.withColumn("end_at", F.col("pos") + F.col("last"))
    here = here.withColumn("open_at", F.max("end_at").over(inner))
    runs = here.groupBy("file", "g").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("end_at").alias("end_at"))
    runs = runs.withColumns({"run_pos": F.coalesce(F.sum("n").over(outer), zero), "run_ord": F.coalesce(F.sum("ends").over(outer), zero)})
    runs = runs.withColumn("run_open", F.max(F.col("run_pos") + F.col("end_at")).over(outer))
    stitched = here.join(runs.select("file", "g", "run_pos", "run_ord", "run_open"), ["file", "g"]).select(
        "file",
        "block",
        (F.col("run_ord") + F.col("ord")).alias("ordinal"),
        # ids since the last end before this block
        (F.col("run_pos") + F.col("pos") - 1 - F.coalesce(F.col("run_pos") + F.col("open_at"), F.col("run_open"), F.lit(-1))).alias("carried"),
    )
    docs = found.select("file", "block", F.posexplode("counts").alias("k", "count")).join(stitched, ["file", "block"])
    ended = docs.select(
        "file",
        (F.col("ordinal") + F.col("k")).alias("ordinal"),
        (F.col("count") + F.when(F.col("k") == 0, F.col("carried")).otherwise(zero)).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    files = runs.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("ordinal"), F.max(F.col("run_pos") + F.col("end_at")).alias("end_at"))
    rest = files.withColumn("n_tokens", F.col("n") - 1 - F.coalesce("end_at", F.lit(-1))).filter("n_tokens > 0")
    return ended.unionByName(rest.select("file", "ordinal", "n_tokens", F.lit(False).alias("ended")))


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write the documents' token files, scan them, and give each count its document: doc_id, file, ordinal, n_tokens.

    One row for each row of ``docs``, whose ids may be null or repeat; null and empty texts have no tokens. An empty table
    gives an empty result; other columns are ignored.
    """
    table = write_token_files(docs, new_path(docs.sparkSession, "tokens"), vocabulary=vocabulary, id_col=id_col, text_col=text_col)
    counts = count_tokens(table.filter("data IS NOT NULL"))
    listed = table.filter("ids IS NOT NULL").select("file", "block", F.posexplode("ids").alias("k", "doc_id"))
    listed = listed.select("file", (F.col("block") + F.col("k")).alias("ordinal"), "doc_id")
    return listed.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
