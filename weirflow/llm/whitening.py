"""Whitening of embeddings by a tall-skinny QR.

Entries become integers, so sums over all vectors are exact whatever their order. Each partition centres its vectors by
these sums and keeps the triangular factor of their QR; the factors are stacked and factored again, a few at a time, until
one is left. Its singular values and right vectors are those of the centred vectors, so no covariance is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import written

SCALE, SHIFT = 64, 1_000_000
#: Entries of this size and beyond have no place on the grid of whole numbers and count as not finite.
LIMIT = 2.0**55
COMPONENTS = 16
#: Factors that one task stacks, and numbers of a block of vectors.
FAN_IN, BLOCK = 8, 1 << 22
SAFE = 1 << 62


def grid(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry; null if the vector is null or has an entry that is null or not finite."""
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LIMIT, F.lit(False)))
    return F.when(fits, F.transform(vector, lambda c: F.floor(c.cast("double") * float(SCALE)) + F.lit(SHIFT)))


@dataclass
class Whitening:
    """What a fit leaves: ``n`` vectors with the sums ``sums``; components as columns of ``axes`` with their ``values``.

    ``values`` are the covariance's eigenvalues and ``total`` is its trace. ``flat`` tells of components without variance,
    which have no scale: their whitened numbers are null. ``identity_error`` is the largest absolute entry of the whitened
    vectors' covariance minus the identity, over the other components.
    """

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    total: float
    flat: np.ndarray
    identity_error: float = 0.0

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.flat, 1.0, np.sqrt(np.where(self.flat, 1.0, self.values)))
        return centred(x, self.n, self.sums) @ self.axes / scale


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches and their vectors as a matrix of bounded size."""
    step = max(1, BLOCK // max(1, d))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, the whole part taken off before anything becomes a double."""
    base = np.array([s // n for s in sums], np.int64)
    return (x - base).astype(np.float64) - np.array([s % n / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int] | np.ndarray:
    """The sum over dimensions of (n * x - sums)^2 of each row, exact whatever its size."""
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
    off = x - base
    widest = n * (int(np.abs(off).max(initial=0)) + 1)
    if len(sums) * widest * widest < SAFE:
        return ((off * n - rest.astype(np.int64)) ** 2).sum(1)
    return ((off.astype(object) * n - rest) ** 2).sum(1).tolist()


def _triangle(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    d, r = len(sums), None
    for _, x in blocks(batches, d):
        block = centred(x, n, sums)
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["r"])


def _stacked(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    r = None
    for b in batches:
        for raw in b.column("r").to_pylist():
            other = np.frombuffer(raw).reshape(-1, d)
            r = other if r is None else np.linalg.qr(np.vstack([r, other]), mode="r")
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["r"])


def _partial_sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Sums of a partition, the high and the low half of the numbers apart, so that nothing overflows."""
    n, high, low = 0, [0] * d, [0] * d
    for _, x in blocks(batches, d):
        n += len(x)
        high = [a + int(b) for a, b in zip(high, (x >> 31).sum(0), strict=True)]
        low = [a + int(b) for a, b in zip(low, (x & ((1 << 31) - 1)).sum(0), strict=True)]
    if n:
        sums = [Decimal((a << 31) + b) for a, b in zip(high, low, strict=True)]
        kinds = (pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((range(d), [n] * d, sums), kinds, strict=True)], ["at", "n", "s"])


def _spread(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    """Count, means and centred products of a partition's whitened vectors, folded block by block."""
    at = None
    for _, x in blocks(batches, model.dimensions):
        w = model.project(x)[:, ~model.flat]
        mean = w.mean(0)
        at = _folded(at, (len(w), mean, (w - mean).T @ (w - mean)))
    if at is not None:
        n, mean, products = at
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], ["n", "mean", "products"])


def _folded(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def _folded_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    at = None
    for b in batches:
        for row in b.to_pylist():
            at = _folded(at, (row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["products"]).reshape(k, k)))
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1].tobytes()], pa.binary()), pa.array([at[2].tobytes()], pa.binary())], ["n", "mean", "products"])


def tree(parts: DataFrame, fold, kind: str) -> DataFrame:
    """One row of all rows, folded a few partitions at a time; the partitions' number is known without running them."""
    left = parts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(fold, kind)
    return parts


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors on the grid; None where there are none.

    Vectors that are null or have an entry that is null or not finite are left out. The space is that of the commonest
    length (of equally common ones the longest); vectors of other lengths, and empty ones, are of another space and left out.
    """
    some = df.select(grid(F.col(vector)).alias("x")).filter("x IS NOT NULL AND size(x) > 0").distinct()
    some, _ = written(some.withColumn("d", F.size("x")), "whitening-vectors")
    common = some.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    d, n = common["d"], common["n"]
    x = some.filter(F.col("d") == d).select("x")
    partial = x.mapInArrow(lambda b: _partial_sums(b, d), "at int, n long, s decimal(38,0)")
    sums = [int(r["s"]) for r in partial.groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()]
    factors = x.mapInArrow(lambda b: _triangle(b, n, sums), "r binary")
    r = np.frombuffer(tree(factors, lambda b: _stacked(b, d), "r binary").first()["r"]).reshape(-1, d)
    _, sigma, right = np.linalg.svd(r, full_matrices=True)
    sigma = np.concatenate([sigma, np.zeros(d - len(sigma))])
    k = min(components, d)
    axes = right[:k].T
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    flat = sigma[:k] <= max(sigma[0] * max(d, 2) * np.finfo(float).eps, 0.0)
    model = Whitening(n, sums, np.ascontiguousarray(axes), (sigma**2 / n)[:k], float((sigma**2).sum() / n), flat)
    kept = int((~flat).sum())
    if kept:
        kind = "n long, mean binary, products binary"
        spread = tree(x.mapInArrow(lambda b: _spread(b, model), kind), lambda b: _folded_rows(b, kept), kind).first()
        covariance = np.frombuffer(spread["products"]).reshape(kept, kept) / spread["n"]
        model.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return model


def transform(df: DataFrame, model: Whitening | None, vector: str = "embedding", into: str = "whitening") -> DataFrame:
    """The rows that the model can whiten, with a struct ``into``: n, deviation, whitened, explained, identity_error.

    ``deviation`` is a decimal of 38 digits, ``whitened`` and ``explained`` have a number for each component. Rows that
    ``fit`` would leave out go. All other columns stay, but for one of the name of ``into``, in whatever case.
    """
    columns = [c for c in df.columns if c.lower() != into.lower()]
    struct = "struct<n: bigint, deviation: decimal(38,0), whitened: array<double>, explained: array<double>, identity_error: double>"
    if model is None:
        return df.limit(0).select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast(struct).alias(into))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), grid(F.col(vector)).alias("x"))
    rows = rows.filter(f"x IS NOT NULL AND size(x) = {model.dimensions}")
    explained = [float(v) / model.total if model.total else 0.0 for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, model.dimensions):
            deviation = deviations(x, model.n, model.sums)
            exact = pa.array(deviation).cast(pa.decimal128(38, 0)) if isinstance(deviation, np.ndarray) else pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0))
            whitened = model.project(x)
            flat = np.broadcast_to(model.flat, whitened.shape).ravel()
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * whitened.shape[1], pa.array(whitened.ravel(), mask=flat))
            yield pa.RecordBatch.from_arrays([part.column("row"), exact, lists], ["row", "deviation", "whitened"])

    kind = T.StructType([rows.schema["row"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    done = rows.mapInArrow(run, kind)
    made = F.struct(
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(v) for v in explained]).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
    return done.select(*[F.col(f"row.`{c}`") for c in columns], made.alias(into))


def whitened_components(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each row of ``df`` that can be whitened and each component, of which there are as many as dimensions at most.

    Columns: vec_id, component, n, deviation, whitened, explained, identity_error. Null and repeated ids stay as they are;
    an empty table gives no rows; other columns are ignored. A deviation beyond a long is an error.
    """
    source = df.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("vector"))
    out = transform(source, fit(source, "vector", components), "vector")
    each = F.posexplode(F.arrays_zip("whitening.whitened", "whitening.explained")).alias("at", "c")
    rows = out.select("vec_id", "whitening.n", F.col("whitening.deviation").cast("long").alias("deviation"), "whitening.identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
