"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of word shingles. Equal sets are one class, so copies cost a count each. Each class's signature is
cut into bands; classes that share a band are candidates of each other. Candidates compare their signatures batch by
batch, and a pair is dropped as soon as the posterior chance that it is similar enough falls under the miss probability.
What survives joins classes to clusters; inside each, links are confirmed on the full sets.

Buckets and clusters of any size are cut into blocks. In each block of a large one its leader, which goes to all of
them, is compared with all others; those linked to it are one component and need no comparison with each other. Only
the rest, block by block, is compared with everyone. Nothing is capped, and no list of pairs is made.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import connected_components, written

WORDS = 5
#: Links have 100 * common >= percent * all shingles.
PERCENT = 80
HASHES, BATCH = 120, 24
#: Chance that a similar pair is dropped on its signature, and that it shares no band.
MISS, MISS_BANDS = 1e-7, 1e-6
#: Classes of a bucket, and shingles of a cluster, in one block.
BUCKET_BLOCK = 512
CLUSTER_BLOCK = 1 << 18

_U = np.uint64
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1 << 62, size=HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(1 << 63, size=HASHES, dtype=np.uint64)
_C = _RNG.integers(1 << 62, size=WORDS, dtype=np.uint64) * _U(2) + _U(1)
_R = _RNG.integers(1 << 62, size=HASHES, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]).cumprod(dtype=_U) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles of five words, ascending; fewer words are one shingle."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    at, end = edge[::2], edge[1::2]
    if not len(at):
        return np.zeros(0, _U)
    up, down = _powers(1 << max(6, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, _U), ((raw.astype(_U) + _U(1)) * up[: len(raw)]).cumsum(dtype=_U)])
    word = _mixed((sums[end] - sums[at]) * down[at] + (end - at).astype(_U))
    n = len(word)
    if n < WORDS:
        whole = np.append(word * _C[:n], _U(n * _BASE % (1 << 64))).sum(dtype=_U)
        return _mixed(np.array([whole], _U))
    total = np.zeros(n - WORDS + 1, _U)
    for k in range(WORDS):
        total += word[k : n - WORDS + 1 + k] * _C[k]
    return np.unique(_mixed(total))


def signature(sets: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, (1 << 32) - 1, _U)
    for at in range(0, len(sets), 512):
        least = np.minimum(least, ((_A[:, None] * sets[None, at : at + 512] + _B[:, None]) >> _U(32)).min(1))
    return least


def band_rows(percent: int = PERCENT) -> int:
    """Hashes in a band: as many as leave a pair that is similar by ``percent`` some common band, but for MISS_BANDS."""
    fits = [r for r in range(1, 9) if HASHES % r == 0 and (1 - (percent / 100) ** r) ** (HASHES // r) <= MISS_BANDS]
    if not fits:
        raise ValueError(f"{HASHES} hashes are too few for a similarity of {percent} percent")
    return max(fits)


@functools.cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """For each number of compared bytes the fewest matches at which a pair goes on.

    Under fewer, P(similarity >= percent | matches) is below ``miss``, with an even prior and 1 byte a hash, which
    matches by chance once in 256.
    """
    s = (np.arange(2000) + 0.5) / 2000
    q = s + (1 - s) / 256
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        for m in range(k + 1):
            like = m * np.log(q) + (k - m) * np.log(1 - q)
            like = np.exp(like - like.max())
            if like[s >= percent / 100].sum() >= miss * like.sum():
                out.append((k, m))
                break
    return out


class Joined:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self, ids: np.ndarray) -> list[tuple[int, int]]:
        return [(int(ids[k]), int(ids[r])) for k in range(len(ids)) if (r := self.find(k)) != k]


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which signatures of ``x`` stay likely to be similar to their row of ``y`` (or to its only row), batch by batch."""
    y = np.broadcast_to(y, x.shape)
    on, match = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, least in least_matches(percent):
        match = match + (x[on, k - BATCH : k] == y[on, k - BATCH : k]).sum(1)
        on, match = on[match >= least], match[match >= least]
    out = np.zeros(len(x), bool)
    out[on] = True
    return out


def surviving(sketch: np.ndarray, joined: Joined, percent: int = PERCENT, first: int | None = None) -> None:
    """Join the rows whose signatures stay likely to be similar; with ``first``, so many rows with those after them only."""
    least = least_matches(percent)[0][1]
    n = len(sketch)
    for low in range(0, n - 1 if first is None else first, 32):
        start = low + 1 if first is None else first
        rows = np.arange(low, min(low + 32, n - 1 if first is None else first))
        same = (sketch[rows, None, :BATCH] == sketch[None, start:, :BATCH]).sum(2, dtype=np.uint8)
        a, b = np.nonzero(same >= least)
        a, b = rows[a], b + start
        a, b = a[b > a], b[b > a]
        if len(a):
            root = np.fromiter(map(joined.find, range(n)), np.int64, n)
            a, b = a[root[a] != root[b]], b[root[a] != root[b]]
        on = alike(sketch[a], sketch[b], percent)
        for x, y in zip(a[on].tolist(), b[on].tolist(), strict=True):
            joined.join(x, y)


def confirmed(sets: list[np.ndarray], rows: list[int], joined: Joined, percent: int = PERCENT, leader: int | None = None) -> None:
    """Join ``rows`` with all rows whose full sets are similar enough.

    Those joined to ``leader``, itself apart, are passed over: what they alone are linked to is among the other rows.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = sizes.cumsum()
    _, which, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    begin = df.cumsum() - df

    def links(x: int) -> np.ndarray:
        ids = which[ends[x] - sizes[x] : ends[x]]
        ids = ids[df[ids] > 1]
        if 100 * len(ids) < percent * sizes[x]:  # what it shares with anyone is too little
            return np.zeros(0, np.int64)
        n = df[ids]
        at = np.repeat(begin[ids] - (n.cumsum() - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero(100 * common >= percent * (sizes + sizes[x] - common))
        return near[near != x]

    for x in rows:
        if leader is None or x == leader or joined.find(x) != joined.find(leader):
            for y in links(x).tolist():
                joined.join(x, y)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, each whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[x] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


FOUND = ["a", "b", "group"]
FOUND_KIND = "a long, b long, group long"


def gathered(found: Iterator[tuple[list[tuple[int, int]], list[tuple[int, int]]]]) -> Iterator[pa.RecordBatch]:
    """Batches of the edges, and of the (group, member) that are not linked to their leader, whose ``b`` is null."""
    rows: list[tuple] = []
    for edges, still in found:
        rows += [(x, y, None) for x, y in edges]
        rows += [(x, None, group) for group, x in still]
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], FOUND)
            rows = []
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], FOUND)


def dealt(df: DataFrame, group: str, node: str, leader: str, blocks: str) -> DataFrame:
    """Rows of each group dealt to ``blocks`` blocks, one each; the group's leader to all of them."""
    every = F.sequence(F.lit(0), F.col(blocks) - 1)
    own = F.array(F.pmod(F.xxhash64(node, F.lit(3)), F.col(blocks)).cast("int"))
    out = df.withColumn("i", F.explode(F.when(F.col(node) == F.col(leader), every).otherwise(own)))
    return out.repartition(group, "i").sortWithinPartitions(group, "i", node)


def dealt_rest(df: DataFrame, still: DataFrame, group: str, node: str, blocks: str) -> DataFrame:
    """Of groups with members in ``still`` (group, a), these (``rest``) and all members dealt to pairs of their blocks."""
    sizes = still.groupBy("group").agg(F.count("*").alias("n_rest"))
    keep = [c for c in df.columns if c != "leader"]
    whole = df.join(sizes.hint("merge"), F.col(group) == F.col("group")).drop("group")
    whole, _ = written(whole.withColumn("rest_blocks", F.ceil(F.col("n_rest") * F.col(blocks) / F.col("size")).cast("int")), "near-open")
    rest = whole.join(still.hint("merge"), (F.col(group) == F.col("group")) & (F.col(node) == F.col("a")), "left_semi")
    own = lambda n: F.pmod(F.xxhash64(node, F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = rest.select(*keep, F.lit(True).alias("rest"), own("rest_blocks").alias("i"), every(blocks).alias("j"))
    rows = rest.unionByName(whole.select(*keep, F.lit(False).alias("rest"), every("rest_blocks").alias("i"), own(blocks).alias("j")))
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", F.desc("rest"), node)


def linked_pairs(found: DataFrame, rest) -> DataFrame:
    """The edges among ``found`` and those that ``rest``, called with the members not linked to their leader, finds."""
    found, _ = written(found, "near-found")
    edges, still = found.filter("b IS NOT NULL"), found.filter("b IS NULL").select("group", "a")
    return edges if not still.limit(1).count() else edges.unionByName(rest(still))


def near_dedup(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. Links are similar by ``percent`` or more.

    Null, empty and blank texts have no shingles and are linked with nothing; so are rows whose id is null, which are
    components of their own (component_id null, kept true). Rows that share an id are one document as far as links go.
    Texts are taken whole. An empty table gives an empty result; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n", "k1", "k2", "sketch", "bands"]
    n_rows = band_rows(percent)
    n_bands = HASHES // n_rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, sketch, bands = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                k1.append((key >> 64) - (1 << 63))
                k2.append((key & (1 << 64) - 1) - (1 << 63))
                if len(s):
                    sig = signature(s)
                    sketch.append((sig & _U(255)).astype(np.uint8).tobytes())
                    bands.append(_mixed((sig.reshape(n_bands, n_rows) * _R[:n_rows]).sum(1, dtype=_U) + np.arange(n_bands, dtype=_U) * _U(_BASE)).view(np.int64))
                else:
                    sketch.append(None)
                    bands.append(None)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip((n, k1, k2, sketch, bands), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names)

    signed, _ = written(source.mapInArrow(sign, "doc_id long, n long, k1 long, k2 long, sketch binary, bands array<long>"), "near-signed")
    some = signed.filter("n > 0 AND doc_id IS NOT NULL")
    top = some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "sketch", "bands")).alias("s"), F.count("*").alias("copies"))
    classes, _ = written(top.select("k1", "k2", F.col("s.doc_id").alias("rep"), "s.n", "s.sketch", "s.bands", "copies"), "near-classes")

    # Candidates: classes that share a band. Buckets of the same members count once.
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("mark")).filter("size > 1")
    buckets, _ = written(buckets.groupBy("size", "low", "mark").agg(F.min("bucket").alias("bucket")), "near-buckets")
    members = banded.join(buckets.select("bucket", "size", F.col("low").alias("leader")).hint("merge"), "bucket")
    members = members.join(classes.select("rep", "sketch").hint("merge"), "rep")
    members, _ = written(members.select("bucket", "rep", "leader", "size", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int").alias("blocks"), "sketch"), "near-members")

    def sketches(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return g.column("rep").to_numpy(), np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(len(g), HASHES)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in by_group(batches, ["bucket", "i"]):
            rep, sketch = sketches(g)
            if g.column("blocks")[0].as_py() == 1:
                joined = Joined(len(rep))
                surviving(sketch, joined, percent)
                yield joined.edges(rep), []
            else:
                leader, bucket = g.column("leader")[0].as_py(), g.column("bucket")[0].as_py()
                near = alike(sketch, sketch[rep == leader], percent)
                yield [(x, leader) for x in rep[near].tolist()], [(bucket, x) for x in rep[~near].tolist()]

    def sieve_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in by_group(batches, ["bucket", "i", "j"]):
            rep, sketch = sketches(g)
            joined = Joined(len(rep))
            surviving(sketch, joined, percent, int(pa.compute.sum(g.column("rest")).as_py()))
            yield joined.edges(rep), []

    rows = dealt(members, "bucket", "rep", "leader", "blocks").mapInArrow(lambda b: gathered(sieve(b)), FOUND_KIND)
    sieved = linked_pairs(rows, lambda still: dealt_rest(members.filter("blocks > 1"), still, "bucket", "rep", "blocks").mapInArrow(lambda b: gathered(sieve_rest(b)), FOUND_KIND))
    clusters = connected_components(sieved, "a", "b", "near-likely")
    clusters, _ = written(clusters, "near-clusters")

    # Clusters and their leaders: the class with most copies, of those the first.
    inside = classes.select("rep", "n", "copies").join(clusters.select(F.col("node").alias("rep"), "component").hint("merge"), "rep")
    heads = inside.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.max(F.struct("copies", (-F.col("rep")).alias("r"))).alias("h"))
    heads, _ = written(heads.select("component", "size", (-F.col("h.r")).alias("leader"), F.ceil(F.col("weight") / CLUSTER_BLOCK).cast("int").alias("blocks")), "near-heads")
    nodes, _ = written(inside.join(heads.hint("merge"), "component").select("rep", "component", "size", "leader", "blocks"), "near-nodes")
    # Written, as large clusters read it twice and each reading would shuffle all texts.
    full = source.join(nodes.hint("merge"), F.col("doc_id") == F.col("rep")).select("component", "rep", "size", "leader", "blocks", "text")
    full, _ = written(full, "near-full")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in by_group(batches, ["component", "i"]):
            rep = g.column("rep").to_numpy()
            leader = int(np.flatnonzero(rep == g.column("leader")[0].as_py())[0])
            whole = g.column("blocks")[0].as_py() == 1
            joined = Joined(len(rep))
            confirmed([shingles(t) for t in g.column("text").to_pylist()], [leader, *(x for x in range(len(rep)) if x != leader)] if whole else [leader], joined, percent, leader)
            component = g.column("component")[0].as_py()
            yield joined.edges(rep), [] if whole else [(component, x) for k, x in enumerate(rep.tolist()) if joined.find(k) != joined.find(leader)]

    def verify_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in by_group(batches, ["component", "i", "j"]):
            rep = g.column("rep").to_numpy()
            joined = Joined(len(rep))
            n_rest = int(pa.compute.sum(g.column("rest")).as_py())
            confirmed([shingles(t) for t in g.column("text").to_pylist()], list(range(n_rest)), joined, percent)
            yield joined.edges(rep), []

    rows = dealt(full, "component", "rep", "leader", "blocks").mapInArrow(lambda b: gathered(verify(b)), FOUND_KIND)
    confirmed_pairs = linked_pairs(rows, lambda still: dealt_rest(full.filter("blocks > 1"), still, "component", "rep", "blocks").mapInArrow(lambda b: gathered(verify_rest(b)), FOUND_KIND))
    linked = connected_components(confirmed_pairs, "a", "b", "near-links")

    named = classes.select("k1", "k2", "rep").join(linked.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    named, _ = written(named.select("k1", "k2", F.coalesce("component", "rep").alias("component")), "near-named")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = signed.select("doc_id", "n", F.when(linkable, F.col("k1")).alias("k1"), "k2").join(named.hint("merge"), ["k1", "k2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
