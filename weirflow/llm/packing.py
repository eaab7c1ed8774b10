"""Best-two-fit packing of token pieces into sequences of a fixed length.

Documents longer than a sequence are cut into whole sequences, the first piece taking what is left over. How many
pieces have each length is all that packing needs to know: at most ``seq_len`` counts, whatever the input. The plan
made from them is a list of bin patterns with the number of bins of each; pieces then take their places in it by
their rank among the pieces of their length, so no piece passes through the driver or a common task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import written
from weirflow.llm.tokens import added_tokens, encode_added, vocabulary_path

SEQ_LEN = 1024
END_ID = 2


def token_pieces(docs: DataFrame, seq_len: int = SEQ_LEN, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and their task and rank in it by length."""
    path = path or vocabulary_path()
    added = added_tokens(path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(seq_len + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows: list[tuple] = []
                for doc, ids in zip(b.column(0).to_pylist(), encode_added(b.column(1).to_pylist(), path, added), strict=True):
                    raw = np.append(ids, end_id).astype("<u4")
                    begin, stop = 0, len(raw) % seq_len or seq_len
                    k = 0
                    while begin < len(raw):
                        n = stop - begin
                        rows.append((doc, k, begin, n, zlib.crc32(raw[begin:stop].tobytes()), part, int(met[n])))
                        met[n] += 1
                        begin, stop, k = stop, stop + seq_len, k + 1
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, list[int]]]:
    """Bins for pieces of these lengths: (number of bins, lengths in each), by best-two-fit.

    A bin starts with the longest piece left and takes the longest that fits, again and again. Then, as long as it
    fills the bin better, its smallest piece gives way to the two unpacked pieces that fill the gap best. All bins
    that the pieces left allow are made alike at once.
    """
    left = np.zeros(seq_len + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while (lengths := np.flatnonzero(left)).size:
        free = left.copy()
        held = [int(lengths[-1])]
        free[held[0]] -= 1
        gap = seq_len - held[0]
        while gap and (fits := np.flatnonzero(free[: gap + 1])).size:
            held.append(int(fits[-1]))
            free[held[-1]] -= 1
            gap -= held[-1]
        while gap:
            small = min(held)
            room = gap + small
            have = np.flatnonzero(free[: room + 1])
            if not have.size:
                break
            # The longest second piece for each first one; where both have one length there must be two of it.
            second = np.searchsorted(have, room - have, side="right") - 1
            alone = (second >= 0) & (have[second] == have) & (free[have] < 2)
            second = np.where(alone, second - 1, second)
            both = np.where(second >= 0, have + have[second], 0)
            best = int(both.argmax())
            if both[best] <= small:
                break
            held.remove(small)
            free[small] += 1
            for x in (int(have[best]), int(have[second[best]])):
                held.append(x)
                free[x] -= 1
            gap = room - int(both[best])
        need = Counter(held)
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        bins.append((times, sorted(held, reverse=True)))
    return bins


def slots(bins: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, place in the bin), by length and rank."""
    rows, used, first_bin = [], Counter(), 0
    for times, held in bins:
        place = 0
        for length, n in sorted(Counter(held).items(), reverse=True):
            rows.append((length, used[length], n, first_bin, place))
            used[length] += n * times
            place += n * length
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids and ``end_id`` into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end alone. Repeated rows are packed each on its own; ids may be null or repeat. An
    empty table gives an empty result. Other columns are ignored.
    """
    pieces, _ = written(token_pieces(docs, seq_len, end_id, path, id_col, text_col), "pieces")
    short = pieces.filter(F.col("length") < seq_len)
    by_task = short.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_task, _ = written(by_task, "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under seq_len rows
    bins = plan(counts, seq_len)
    table = slots(bins)
    n_bins = sum(times for times, _ in bins)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    keys = table[:, 0] << 40 | table[:, 1]

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        slot = table[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
        nth = rank - slot[:, 1]
        return pd.DataFrame({"sequence_id": slot[:, 3] + nth // slot[:, 2], "offset": slot[:, 4] + nth % slot[:, 2] * length})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = short.join(offsets, ["length", "part"]).withColumn("at", place("length", F.col("before") + F.col("nth")))
    return placed.select(*columns, "at.sequence_id", "at.offset").unionByName(
        pieces.filter(F.col("length") == seq_len)
        .select(*columns, (F.lit(n_bins) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
