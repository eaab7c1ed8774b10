"""Document fingerprints: a homomorphic hash of the multiset of a document's paragraphs.

Each paragraph is hashed to a wide vector: whole lanes, hashed from all its bytes and added modulo 2^64, and sketch lanes,
to which each of its byte runs gives a signed one, added modulo 2^16. A document's fingerprint is the sum of its
paragraphs' vectors. So the order of paragraphs does not matter, paragraphs are inserted by adding and deleted by
subtracting, and fingerprints are equal if and, but for a chance of about 2^-512, only if the paragraphs are the same. The
sketch lanes of two fingerprints tell how much of their byte runs they share.

Paragraphs are the lines of a text without the blanks around them; empty ones do not count.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lanes modulo 2^64 of the whole paragraph, lanes modulo 2^16 of its byte runs, and bytes of a run.
WHOLE, SKETCH, RUN = 8, 256, 12
BLANKS = b" \t\n\r\x0b\x0c"
#: Bytes of runs that are hashed at once.
WINDOW = 1 << 20
#: Ranges of documents that a shuffle partition gets on average.
RANGES = 4

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


class Sum:
    """The vector of a multiset of paragraphs."""

    def __init__(self, whole: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.whole = np.zeros(WHOLE, _U) if whole is None else whole
        self.sketch = np.zeros(SKETCH, np.uint16) if sketch is None else sketch

    def __add__(self, other: Sum) -> Sum:
        return Sum(self.whole + other.whole, self.sketch + other.sketch)

    def __sub__(self, other: Sum) -> Sum:
        return Sum(self.whole - other.whole, self.sketch - other.sketch)

    def dumps(self) -> str:
        return base64.b64encode(self.whole.astype("<u8").tobytes() + self.sketch.astype("<u2").tobytes()).decode()

    @staticmethod
    def loads(text: str) -> Sum:
        raw = base64.b64decode(text)
        return Sum(np.frombuffer(raw[: 8 * WHOLE], "<u8").astype(_U), np.frombuffer(raw[8 * WHOLE :], "<u2").astype(np.uint16))

    def likeness(self, other: Sum) -> float:
        """1 for equal sums; else about twice the shared byte runs over all of both, from 0 to 1."""
        if np.array_equal(self.whole, other.whole) and np.array_equal(self.sketch, other.sketch):
            return 1.0
        a, b = (x.sketch.view(np.int16).astype(np.float64) for x in (self, other))
        size = float(a @ a + b @ b)
        return min(1.0, max(0.0, 2 * float(a @ b) / size)) if size else 0.0


def paragraphs(text: bytes) -> list[bytes]:
    return [p for line in text.split(b"\n") if (p := line.strip(BLANKS))]


_UP = np.concatenate([np.ones(1, _U), np.full(RUN - 1, _BASE, _U)]).cumprod(dtype=_U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def vector(parts: list[bytes]) -> Sum:
    """The sum of the paragraphs' vectors. Runs lie in one paragraph; one that is shorter than a run is a run itself."""
    if not parts:
        return Sum()
    digests = b"".join(hashlib.blake2b(p, digest_size=8 * WHOLE).digest() for p in parts)
    whole = np.frombuffer(digests, "<u8").reshape(-1, WHOLE).sum(0, dtype=_U)
    lanes = np.zeros(2 * SKETCH, np.int64)
    # Short paragraphs are filled up with line ends, of which runs of longer ones have none.
    raw = b"\n".join(p.ljust(RUN, b"\0") for p in parts)
    for at in range(0, max(1, len(raw) - RUN + 1), WINDOW):
        part = np.frombuffer(raw, np.uint8, min(WINDOW + RUN - 1, len(raw) - at), at)
        n = len(part) - RUN + 1
        hashed, broken = np.zeros(n, _U), np.zeros(n, bool)
        ends = part == 10
        for k in range(RUN):
            hashed += part[k : k + n].astype(_U) * _UP[k]
            broken |= ends[k : k + n]
        lanes += np.bincount((_mixed(hashed[~broken]) >> _U(55)).astype(np.int64), minlength=2 * SKETCH)
    return Sum(whole, (lanes[:SKETCH] - lanes[SKETCH:]).astype(np.uint16))


def of_text(text: str | None) -> Sum:
    return vector(paragraphs((text or "").encode()))


def replaced(old: Sum, before: str, after: str) -> Sum:
    """The fingerprint of ``after`` from that of ``before``: paragraphs that only one of them has go or come."""
    a, b = paragraphs(before.encode()), paragraphs(after.encode())
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return old - vector(a[same:]) + vector(b[same:])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column; null counts as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([of_text(t).dumps() for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def _combined(a: Column, b: Column, fn, kind: str) -> Column:
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in pairs:
            values = zip(x.to_pylist(), y.to_pylist(), strict=True)
            yield pa.array([None if u is None or v is None else fn(Sum.loads(u), Sum.loads(v)) for u, v in values], pa.float64() if kind == "double" else pa.string())

    return F.arrow_udf(run, kind)(a, b)


def inserted(mark: Column, paragraphs: Column) -> Column:
    """The fingerprint after a text's paragraphs, given by their own fingerprint, have come; null if either is null."""
    return _combined(mark, paragraphs, lambda a, b: (a + b).dumps(), "string")


def deleted(mark: Column, paragraphs: Column) -> Column:
    """The fingerprint after paragraphs, given by their own fingerprint, have gone; null if either is null."""
    return _combined(mark, paragraphs, lambda a, b: (a - b).dumps(), "string")


def likeness(a: Column, b: Column) -> Column:
    """How much two fingerprints have in common, from 0 to 1; null if either is null."""
    return _combined(a, b, lambda x, y: x.likeness(y), "double")


def total(df: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Fingerprints of groups, such as a document's pages: the sums of those of their rows, with partial sums of each task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, Sum] = {}
        for b in batches:
            for key, text in zip(zip(*(b.column(k).to_pylist() for k in names), strict=True), b.column("mark").to_pylist(), strict=True):
                if text is not None:
                    sums[key] = sums.get(key, Sum()) + Sum.loads(text)
            if len(sums) >= HELD:
                yield table(sums)
                sums = {}
        yield table(sums)

    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.col(f"`{mark}`").alias("mark"))
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema]

    def table(sums: dict[tuple, Sum]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType(fields))
        columns = [*zip(*sums, strict=True)] if sums else [()] * len(names)
        arrays = [pa.array(c, f.type) for c, f in zip([*columns, [s.dumps() for s in sums.values()]], schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    kind = T.StructType(fields)
    salted = rows.mapInArrow(fold, kind)  # at most a row a key and task, and a row more for each HELD keys
    final = salted.repartition(*names).sortWithinPartitions(*names).mapInArrow(lambda b: _runs(b, names, table), kind)
    return final.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("mark").alias("fingerprint"))


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], table) -> Iterator[pa.RecordBatch]:
    """Sums of sorted rows, a key after the other."""
    last, held, done = None, None, {}
    for b in batches:
        for key, text in zip(zip(*(b.column(k).to_pylist() for k in names), strict=True), b.column("mark").to_pylist(), strict=True):
            if held is not None and key == last:
                held = held + Sum.loads(text)
                continue
            if held is not None:
                done[last] = held
            last, held = key, Sum.loads(text)
            if len(done) >= HELD:
                yield table(done)
                done = {}
    if held is not None:
        done[last] = held
    yield table(done)


def _place(key: int | None, h: int) -> int:
    """A document's place in the descending order of ids as one number, that falls along it; null ids come last."""
    return h + (1 << 63) - (1 << 64) if key is None else (key + (1 << 63) << 64) + h + (1 << 63)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each document, that of an edited copy of it, and their likeness.

    In the edited copy the last half of the code points (of an odd number the smaller half) gives way to the first as many
    of the next document, in the descending order of ids; after the last comes the first. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty and have the fingerprint of no paragraphs. Null ids come after all others; rows with equal ids
    follow each other by a hash of their texts. One document is its own next one; an empty table gives no rows; other
    columns are ignored. Texts are shuffled once, to ranges of ids that begin at known documents: each range also gets the
    document after its last one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    wanted = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = source.select("doc_id", "h").repartitionByRange(wanted, F.desc_nulls_last("doc_id"), F.desc("h"))
    firsts = cut.select(F.spark_partition_id().alias("part"), F.struct("doc_id", "h").alias("at")).groupBy("part").agg(F.max("at").alias("at")).collect()
    heads = sorted(-_place(r["at"]["doc_id"], r["at"]["h"]) for r in firsts)
    n = len(heads)

    def where(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = set(heads)
        for keys, hashes in pairs:
            places = [-_place(k, h) for k, h in zip(keys.to_pylist(), hashes.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([bisect_right(heads, p) - 1 for p in places], pa.int32()), pa.array([p in known for p in places], pa.bool_())], ["part", "head"])

    spot = lambda part, halo: F.struct(part.cast("int").alias("part"), F.lit(halo).alias("halo"))
    own, before = spot(F.col("at.part"), False), spot(F.pmod(F.col("at.part") - 1, F.lit(max(1, n))), True)
    rows = source.withColumn("at", F.arrow_udf(where, "part int, head boolean")("doc_id", "h"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("at.head"), F.array(own, before)).otherwise(F.array(own))))
    rows = rows.select("to.part", "to.halo", "doc_id", "h", "text").repartition("part")
    rows = rows.sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), F.desc("h"))
    return rows.drop("h").mapInArrow(_edited, KIND)


HELD = 4096
KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and the one after it; the last of a range is followed by the first of the next range."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in KIND.split(", ")]
    last, out = None, []
    table = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
    for b in batches:
        for part, halo, key, text in zip(*(b.column(c).to_pylist() for c in ("part", "halo", "doc_id", "text")), strict=True):
            if halo and (last is None or last[0] != part):
                continue  # the document after the range was there already, more than once
            text = text or ""
            mark = of_text(text)
            if last is not None and last[0] == part:
                _, at, mine, sums = last
                n = len(mine)
                edited = mine[: n - n // 2] + text[: n // 2]
                other = replaced(sums, mine, edited)
                out.append((at, n, hashlib.sha256(edited.encode()).hexdigest(), sums.dumps(), other.dumps(), sums.likeness(other), sums.likeness(mark)))
            last = None if halo else (part, key, text, mark)
            if len(out) >= HELD:
                yield table()
                out = []
    yield table()
