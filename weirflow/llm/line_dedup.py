"""Reversible line dedup: sharded cuckoo filters of repeated lines, backed by exact reference-count tables.

The state of a corpus is three tables. ``refs`` has a row for each document and each of its long lines, ``counts`` the
number of documents and the largest document of each line, and ``filters`` one cuckoo filter a shard with the lines
that at least ``min_docs`` documents hold. Inserting documents adds to the exact tables and puts the lines that become
repeated into their filters; deleting documents takes them out again, so the state is as if they had never been there.

Documents are cleaned by probing the filters with their own lines, which needs no shuffle as long as the filters are small;
what the filters let through is confirmed by the exact counts. Lines are keyed by two 64-bit hashes of their normalised form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import written

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Repeated lines in one shard's filter; bytes of all filters that are still sent to every task; refs of a shard in one task.
SHARD_LINES = 1 << 16
PASS_BYTES = 32 << 20
PROBE_ROWS = 1 << 20
SLOTS = 4
MAX_KICKS = 500
SECOND_SEED = 7


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key has two buckets, either of which tells the other."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64)
        fp = (k >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        first = (k & self.mask).astype(np.int64)
        return fp, first, self.other(first, fp)

    def other(self, bucket, fp):
        with np.errstate(over="ignore"):
            spread = (np.asarray(fp, np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)
        return (np.asarray(bucket, np.int64) ^ (spread & self.mask).astype(np.int64))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(keys)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Put distinct keys in, most of them at once; False if the filter is too full for them."""
        fp, a, b = self.places(keys)
        for second in (False, True):
            at = b if second else a
            order = np.argsort(at, kind="stable")
            s = at[order]
            new = np.append(True, s[1:] != s[:-1])[: len(s)]
            rank = np.arange(len(s)) - np.flatnonzero(new)[new.cumsum() - 1]
            free = self.table[s] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(s)), np.minimum(rank, SLOTS - 1)]
            self.table[s[fits], slot[fits]] = fp[order[fits]]
            left = order[~fits]
            fp, a, b = fp[left], a[left], b[left]
        return all(self._kick(int(f), int(x)) for f, x in zip(fp, b, strict=True))

    def _kick(self, fp: int, bucket: int) -> bool:
        for n in range(MAX_KICKS):
            row = self.table[bucket]
            if (free := np.flatnonzero(row == 0)).size:
                row[free[0]] = fp
                return True
            slot = (fp + n) % SLOTS
            fp, row[slot] = int(row[slot]), fp
            bucket = int(self.other(bucket, fp))
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take keys out that were put in before, each once."""
        for f, x, y in zip(*self.places(keys), strict=True):
            for bucket in (x, y):
                if (hit := np.flatnonzero(self.table[bucket] == f)).size:
                    self.table[bucket, hit[0]] = 0
                    break


@dataclass(frozen=True)
class LineState:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def line_refs(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's long lines, each once: doc_id, k1, k2. Repeated rows count as one document each."""
    key = lambda line: F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), key)
    long = F.array_distinct(F.filter(lines, lambda x: F.char_length(x) >= min_chars))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(long).alias("line")).select(
        "doc_id", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(SECOND_SEED), "line").alias("k2")
    )


def empty_state(spark: SparkSession, min_docs: int = 5, min_chars: int = 40) -> LineState:
    return LineState(
        spark.createDataFrame([], "doc_id long, k1 long, k2 long"),
        spark.createDataFrame([], "k1 long, k2 long, n_docs long, top_doc long"),
        spark.createDataFrame([], "shard int, filter binary"),
        0,
        min_docs,
        min_chars,
    )


def _shard(shards: int):
    return F.pmod("k1", F.lit(shards)).cast("int")


def _refilter(state: LineState, refs: DataFrame, counts: DataFrame, moved: DataFrame) -> LineState:
    """The state with new exact tables; ``moved`` has the keys that became repeated (up) or ceased to be (not up)."""
    n = counts.filter(F.col("n_docs") >= state.min_docs).count()
    shards = state.shards
    if shards and n <= shards * SHARD_LINES:

        def update(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            # A shard that held no line yet has no filter.
            f = CuckooFilter.loads(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(SHARD_LINES + SHARD_LINES // 2)
            f.delete(keys["k2"][~keys["up"]].to_numpy())
            ok = f.insert(keys["k2"][keys["up"]].to_numpy())
            return pd.DataFrame({"shard": [int(key[0])], "filter": [f.dumps() if ok else None]})

        keyed = moved.withColumn("shard", _shard(shards))
        new = state.filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(update, "shard int, filter binary")
        new, _ = written(new, "line-filters")
        if not new.filter("filter IS NULL").count():
            return LineState(refs, counts, new, shards, state.min_docs, state.min_chars)
    # The first filters, or too full ones: built anew from the exact table, with room for twice the lines.
    shards = max(1, -(-2 * n // SHARD_LINES))
    per_shard = max(64, 2 * n // shards)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, CuckooFilter] = {}
        for pdf in batches:
            for shard, keys in pdf.groupby("shard")["k2"]:
                f = made.setdefault(int(shard), CuckooFilter.sized(per_shard + per_shard // 2))
                if not f.insert(keys.to_numpy()):
                    raise ValueError("a line filter is too full")
        if made:
            yield pd.DataFrame({"shard": list(made), "filter": [f.dumps() for f in made.values()]})

    repeated = counts.filter(F.col("n_docs") >= state.min_docs).select("k2", _shard(shards).alias("shard"))
    filters, _ = written(repeated.repartition(shards, "shard").mapInPandas(build, "shard int, filter binary"), "line-filters")
    return LineState(refs, counts, filters, shards, state.min_docs, state.min_chars)


def insert(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineState:
    """The state with more documents; their ids are new to it."""
    added, _ = written(line_refs(docs, state.min_chars, id_col, text_col), "line-refs")
    known = state.counts.select("k1", "k2", "n_docs", "top_doc", F.col("n_docs").alias("before"))
    batch = added.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_doc"))
    both = known.unionByName(batch.withColumn("before", F.lit(0).cast("long"))) if state.shards else batch.withColumn("before", F.lit(0).cast("long"))
    if state.shards:
        both = both.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"), F.sum("before").alias("before"))
    table, _ = written(both, "line-counts")
    moved = table.filter((F.col("n_docs") >= state.min_docs) & (F.col("before") < state.min_docs)).select("k1", "k2", F.lit(True).alias("up"))
    refs = state.refs.unionByName(added) if state.shards else added
    return _refilter(state, refs, table.drop("before"), moved)


def delete(state: LineState, ids: DataFrame, id_col: str = "doc_id") -> LineState:
    """The state without the documents of these ids; counts, largest documents and filters are put back."""
    gone = ids.select(F.col(id_col).alias("doc_id")).distinct()
    lost, _ = written(state.refs.join(gone, "doc_id", "left_semi"), "line-refs")
    refs, _ = written(state.refs.join(gone, "doc_id", "left_anti"), "line-refs")
    touched = lost.select("k1", "k2").distinct()
    now = refs.join(touched, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_doc"))
    same = state.counts.join(touched, ["k1", "k2"], "left_anti")
    counts, _ = written(same.unionByName(now), "line-counts")
    before = state.counts.filter(F.col("n_docs") >= state.min_docs).join(touched, ["k1", "k2"], "left_semi")
    still = now.filter(F.col("n_docs") >= state.min_docs)
    moved = before.join(still, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(False).alias("up"))
    return _refilter(state, refs, counts, moved)


def _probe(state: LineState, refs: DataFrame) -> DataFrame:
    """The refs whose line's filter may hold it.

    Filters of PASS_BYTES in all go to every task. Larger ones meet the refs of their shard: a shard's refs are dealt to as
    many tasks as their number asks for, each gets the filter first and then streams the refs past it.
    """
    sizes = state.filters.agg(F.sum(F.octet_length("filter"))).first()[0]
    if not sizes:
        return refs.limit(0)
    if sizes <= PASS_BYTES:
        sent = refs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in state.filters.collect()})

        def probe(batches: Iterator[pa.RecordBatch], shards=state.shards) -> Iterator[pa.RecordBatch]:
            filters = {s: CuckooFilter.loads(b) for s, b in sent.value.items()}
            for b in batches:
                shard, k2 = b.column("k1").to_numpy() % shards, b.column("k2").to_numpy()
                hit = np.zeros(len(k2), bool)
                for s in np.unique(shard):
                    if (f := filters.get(int(s))) is not None:
                        own = np.flatnonzero(shard == s)
                        hit[own] = f.contains(k2[own])
                yield b.filter(pa.array(hit))

        return refs.mapInArrow(probe, refs.schema)

    sharded = refs.withColumn("shard", _shard(state.shards))
    parts = sharded.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("parts"))
    parts, _ = written(parts, "line-parts")
    rows = sharded.join(parts.hint("merge"), "shard").select("shard", F.pmod(F.xxhash64("doc_id", "k2"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("binary").alias("filter"), "doc_id", "k1", "k2")
    first = state.filters.join(parts.hint("merge"), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "filter", *[F.lit(None).cast(t).alias(c) for c, t in refs.dtypes])
    dealt = first.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None  # a group without a filter has no repeated line
        for b in batches:
            shard, part, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "part", "k2"))
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if at != (shard[low], part[low]):
                    held, at = None, (shard[low], part[low])
                if b.column("filter")[low].is_valid:
                    held = CuckooFilter.loads(b.column("filter")[low].as_py())
                    low += 1
                if held is not None and high > low:
                    own = b.slice(low, high - low).select(["doc_id", "k1", "k2"])
                    yield own.filter(pa.array(held.contains(own.column("k2").to_numpy())))

    return dealt.mapInArrow(stream, refs.schema)


def dropped_lines(state: LineState) -> DataFrame:
    """doc_id, k1, k2 of the repeated lines that a document of the state loses: all but the largest holding document.

    Where every holder's id is null none is larger, and all keep the line.
    """
    maybe = _probe(state, state.refs)
    repeated = state.counts.filter(F.col("n_docs") >= state.min_docs).select("k1", "k2", "top_doc")
    lost = F.col("top_doc").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("top_doc"))
    return maybe.join(repeated.hint("merge"), ["k1", "k2"]).filter(lost).select("doc_id", "k1", "k2")


def clean(state: LineState, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Documents of the state without the lines they lose: doc_id, n_lines, n_dropped, kept_sha256 (and kept_text)."""
    import xxhash

    lists = dropped_lines(state).groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("lost"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = texts.join(lists.withColumnRenamed("doc_id", "lost_id"), F.col("doc_id").eqNullSafe(F.col("lost_id")), "left").drop("lost_id")
    seed = docs.sparkSession.range(1).select(F.xxhash64(F.lit(SECOND_SEED))).first()[0] % (1 << 64)
    table, chars = str.maketrans(UPPER, LOWER), state.min_chars
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    kind = f"doc_id {dict(texts.dtypes)['doc_id']}, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                n_lines, n_dropped, digests, kept_texts = [], [], [], []
                for text, lost in zip(b.column("text").to_pylist(), b.column("lost").to_pylist(), strict=True):
                    text = text or ""
                    n = text.count("\n") + 1
                    dropped = 0
                    if lost:
                        keys = {(x["k1"], x["k2"]) for x in lost}
                        kept = []
                        for line in text.split("\n"):
                            norm = line.strip(STRIPPED)
                            if len(norm) >= chars:
                                raw = norm.translate(table).encode()
                                if (signed(xxhash.xxh64_intdigest(raw, 42)), signed(xxhash.xxh64_intdigest(raw, seed))) in keys:
                                    continue
                            kept.append(line)
                        dropped, text = n - len(kept), "\n".join(kept)
                    n_lines.append(n)
                    n_dropped.append(dropped)
                    digests.append(hashlib.sha256(text.encode()).hexdigest())
                    kept_texts.append(text)
                arrays = [b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests)]
                names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(kept_texts)], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return both.mapInArrow(run, kind)


def line_dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Clean a corpus of its own repeated lines.

    Null texts count as one empty line. Rows that repeat an id count as documents of their own and lose or keep a line
    together. A null id is smaller than any other. An empty table gives an empty result; other columns are ignored.
    """
    state = insert(empty_state(docs.sparkSession, min_docs, min_chars), docs, id_col, text_col)
    return clean(state, docs, id_col, text_col, with_text)
