"""Importance resampling towards a target distribution, over hashed word runs.

Documents become rows of a sparse matrix of counts, documents by buckets, kept as CSR blocks in a written table. Column
sums of it give the distribution of the corpus, those of the target's own matrix that of the target. A bucket's gain is
the log of the ratio of both, and the product of the matrix and the gains is the documents' weight. The draw is without
replacement, by the highest sums of weight and Gumbel noise that is hashed from the document's id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import written

BUCKETS, ORDER = 10_000, 3
PERCENT, MIN_WORDS, SEED = 5, 20, 42
#: Words whose runs are hashed at once, entries after which a block of the matrix ends, and blocks that are summed at once.
WINDOW, BLOCK, AT_ONCE = 1 << 17, 1 << 12, 64

#: ASCII letters, digits and all bytes beyond ASCII are parts of words, in lower case; others part them.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()

#: Arrays are little-endian: starts and counts of 32 bits, buckets of 16, or of 32 where there are more of them.
BLOCK_KIND = "doc_id array<long>, n_words array<long>, start binary, bucket binary, count binary"


def _bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def run_buckets(text: str | None, buckets: int = BUCKETS, order: int = ORDER) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of words, and the buckets of all runs of 1 to ``order`` words, of a text a window of words at a time.

    A run's bucket is the CRC-32 of its words joined by spaces; that of a run goes on from that of the run without its
    last word.
    """
    words = (text or "").encode().translate(_WORDS).split()
    for at in range(0, len(words), WINDOW):
        own = min(WINDOW, len(words) - at)
        part = words[at : at + own + order - 1]
        crc = np.fromiter(map(zlib.crc32, part), np.int64, len(part))
        found = [crc[:own]]
        spaced = [b" " + w for w in part]
        for k in range(1, order):
            crc = np.fromiter(map(zlib.crc32, spaced[k:], crc[: len(part) - k].tolist()), np.int64, max(0, len(part) - k))
            found.append(crc[:own])
        yield own, np.concatenate(found) % buckets


def csr_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER, name: str = "counts") -> DataFrame:
    """The matrix of counts as a written table, a row a block: ids and words of its documents, and its three CSR arrays.

    Row k of a block has the entries from start[k] to start[k + 1]. A text without words is a row without entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n_words, start, cols, counts = [], [], [0], [], []
        done: list[tuple] = []
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]

        def block() -> tuple:
            return ids, n_words, *(np.concatenate(x).astype(t).tobytes() for x, t in (([start], "<u4"), (cols, _bucket_type(buckets)), (counts, "<u4")))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], ["doc_id", "n_words", "start", "bucket", "count"])

        for b in (x.slice(at, AT_ONCE) for x in batches for at in range(0, x.num_rows, AT_ONCE)):
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                total, col, count = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
                for n, found in run_buckets(text, buckets, order):
                    total += n
                    col, count = _added(col, count, *np.unique(found, return_counts=True))
                ids.append(key)
                n_words.append(total)
                start.append(start[-1] + len(col))
                cols.append(col)
                counts.append(count)
                if start[-1] >= BLOCK or len(ids) >= BLOCK:
                    done.append(block())
                    ids, n_words, start, cols, counts = [], [], [0], [], []
                    if len(done) >= AT_ONCE:
                        yield table()
                        done = []
        if ids:
            done.append(block())
        yield table()

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(source.mapInArrow(run, BLOCK_KIND), f"resampling-{name}")[0]


def _added(col: np.ndarray, count: np.ndarray, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two sparse rows."""
    if not len(col):
        return more, counts
    both, at = np.unique(np.concatenate([col, more]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([count, counts])).astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all documents; what comes to the driver is a number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                col, count = (np.frombuffer(b"".join(b.column(c).slice(at, AT_ONCE).to_pylist()), t) for c, t in (("bucket", _bucket_type(buckets)), ("count", "<u4")))
                sums += np.bincount(col, count, buckets).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["bucket", "s"])

    out = np.zeros(buckets, np.int64)
    rows = blocks.select("bucket", "count").mapInArrow(run, "bucket int, s long").groupBy("bucket").agg(F.sum("s").alias("s"))
    for bucket, s in rows.collect():
        out[bucket] = s
    return out


def log_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier the target makes each bucket, one being added to all counts."""
    k, total, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1) * (total + k) / ((s + 1) * (wanted + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of the matrix: its product with the gains."""
    types = ("<u4", _bucket_type(len(gains)), "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part, sums = b.slice(at, AT_ONCE), ([], [])
                for raw in zip(*(part.column(c).to_pylist() for c in ("start", "bucket", "count")), strict=True):
                    start, col, count = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(raw, types, strict=True))
                    for out, x in zip(sums, (count, count * gains[col]), strict=True):
                        s = np.concatenate([[0], x.cumsum()])
                        out.append(s[start[1:]] - s[start[:-1]])
                arrays = [*(part.column(c).flatten() for c in ("doc_id", "n_words")), *(pa.array(np.concatenate(x), pa.int64()) for x in sums)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``scored`` with score and rank: of the rows with words enough, ``percent`` in a hundred have a rank, the highest first.

    Rows whose id is null have no noise, so no score, and are not drawn. Ties go to the smaller id; rows that share an id are
    rows of their own, in any order where all else is equal too. Ranks are places in a sort by ranges, to which the number of
    rows in the ranges before is added, so no task sees more than its range.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = scored.withColumn("score", (F.col("weight") + noise).cast("long"))
    rows = rows.withColumns({"_able": (F.col("n_words") >= min_words) & F.col("score").isNotNull(), "_row": F.monotonically_increasing_id()})
    order = [F.desc("_able"), F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed, _ = written(placed, "resampling-placed")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count_if("_able").alias("able")).orderBy("part").collect()
    drawn = percent * sum(r["able"] for r in sizes) // 100
    before = [0, *accumulate(r["rows"] for r in sizes)]
    offsets = {r["part"]: n for r, n in zip(sizes, before, strict=False) if n < drawn}
    # One number for each range that has drawn rows.
    known = placed.sparkSession.createDataFrame(list(offsets.items()), "part long, before long")
    place = F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    out = placed.withColumn("part", part).join(F.broadcast(known), "part", "left")
    return out.withColumn("rank", F.when(place <= drawn, place)).drop("_able", "_row", "_at", "part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``; rank is null for what is not drawn.

    Null texts and texts without words have no features and weigh 0. An empty target or corpus leaves all gains to the one
    that is added to each count; an empty ``docs`` gives no rows. Other columns are ignored.
    """
    counts = csr_blocks(docs, id_col, text_col, buckets, order, "corpus")
    wanted = csr_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), "doc_id", "text", buckets, order, "target")
    gains = log_gains(column_sums(counts, buckets), column_sums(wanted, buckets))
    return draw(weights(counts, gains), percent, min_words, seed)
