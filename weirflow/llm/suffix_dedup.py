"""Removal of long repeated byte strings with a sparse suffix array, built in range-partitioned buckets.

Every string of ``width`` bytes (a window) has an anchor: the place of its least hashed ``gram`` bytes. Equal windows
have equal anchors at equal offsets, so only the suffixes at anchors need sorting, about one in ``width - gram`` / 2.
Where strings of a second, shorter length are asked for too, the shorter windows have the anchors, and serve both.

* Anchors whose gram occurs once are dropped by a grouped count: none of their windows can repeat.
* The others' suffixes are dealt out by sampled splitters over their leading bytes: the first seven, then a hash of the
  gram, so that a splitter is a few numbers. The counted suffixes say how many ranges are made, up to a greatest number
  that the splitters' sample can serve. Spark orders each range by the same numbers, spilling where it has to, and its
  task takes it in buckets of bounded size, one after the other.
* Each bucket sorts its suffixes, and the bytes before the anchors backwards, by a multikey sort on words of eight
  bytes. Neighbours' common prefixes then say which suffixes agree up to any length, in both directions, and so which
  windows of a bucket are equal, byte for byte. Equal suffixes of a bucket are sorted once.
* A run of suffixes that the end of a bucket may have cut is compared across the boundary by its windows' digests.

Buckets and splitters also cut runs of equal grams (a hash of the document breaks ties), so the size of neither a bucket
nor a range depends on how many copies a passage has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import drop_path, utf8, written
from weirflow.llm.near_dedup import _mixed, _powers

WIDTH = 400
GRAM = 96
#: Suffixes in one bucket, and in one range as long as there are fewer ranges than the greatest number of them.
BUCKET_ROWS = 16_000
RANGE_ROWS = 64_000
MAX_RANGES = 20_000
#: Bytes of a text whose windows are anchored at once.
CHUNK = 1 << 19
_U = np.uint64
_LOW = _U((1 << 20) - 1)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place."""
    up, down = _powers(1 << max(6, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, _U), ((raw.astype(_U) + _U(1)) * up[: len(raw)]).cumsum(dtype=_U)])
    return _mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])


def anchors(raw: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text's windows: hash of the gram, its place, and the first and last window that it anchors."""
    out = []
    for at in range(0, max(0, len(raw) - width + 1), CHUNK):
        part = raw[at : at + CHUNK + width - 1]
        h = gram_hashes(part, gram)
        w = width - gram + 1
        # The place in the low bits: of equal grams the first counts.
        key = (h & ~_LOW) | np.arange(len(h), dtype=_U)
        n = len(h) - w + 1
        padded = np.concatenate([key, np.full(-len(key) % w, ~_U(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        p = place[first]
        out.append((h[p], p + at, first + at, last + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (_U, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of rows of bytes by a multikey sort on words of eight bytes.

    All parts that are still undecided are split by their next word at once (into as many parts as it has values, where
    multikey quicksort makes three); rows that stand alone take no more part.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8")
    order, group = np.arange(n), np.zeros(n, np.int64)  # group: place of a part's first row
    active = np.arange(n)
    for k in range(words.shape[1]):
        if len(active) < 2:
            break
        rows_now = order[active]
        word = words[rows_now, k].astype(_U)
        part = group[active]
        by = np.lexsort((word, part))
        order[active] = rows_now[by]
        word, part = word[by], part[by]
        new = np.append(True, (part[1:] != part[:-1]) | (word[1:] != word[:-1]))
        head = active[np.flatnonzero(new)][new.cumsum() - 1]
        group[active] = head
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        active = active[np.repeat(size > 1, size)]
    return order


def common_prefixes(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the order but the first, the bytes that its row shares with the one before."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    for at in range(0, len(out), 4096):
        a, b = order[at : at + 4097][:-1], order[at + 1 : at + 4097]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[at : at + len(first)] = np.minimum(first, np.minimum(lengths[a], lengths[b]))
    return out


def bytes_matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The values as rows of bytes and their lengths; filled in blocks, so the index arrays stay small.

    After their ends rows have 255, which no UTF-8 text has, so a row is the prefix of no other.
    """
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    out = np.full((len(values), width), 255, np.uint8)
    for low in range(0, len(values), 1024):
        part, n = values[low : low + 1024], lengths[low : low + 1024]
        rows = np.repeat(np.arange(low, low + len(part)), n)
        out[rows, np.arange(len(rows)) - np.repeat(n.cumsum() - n, n)] = np.frombuffer(b"".join(part), np.uint8)
    return out, lengths


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last column of the runs of true values in each row."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return row, start, stop - 1


def repeated_in_bucket(right: list[bytes], left: list[bytes], low: np.ndarray, twice: np.ndarray, lengths: tuple[int, ...], span: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, which windows of a bucket's distinct suffixes repeat in it, and which are the first of their kind.

    ``right`` has the bytes from each anchor on, ``left`` those before it, backwards; ``low`` is the least offset of a
    window's start before the anchor, the bytes of ``left`` are the greatest. Suffixes that are there ``twice`` repeat
    as they are. Columns of the results are offsets.
    """
    a, la = bytes_matrix(right, max(lengths))
    b, lb = bytes_matrix(left, max(1, span - 1))
    n = len(right)
    by_a, by_b = multikey_order(a), multikey_order(b)
    ca, cb = common_prefixes(a, la, by_a), common_prefixes(b, lb, by_b)
    out = [(np.zeros((n, span), bool), np.zeros((n, span), bool)) for _ in lengths]
    run_a, run_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(int(low.min()), int(lb.max()) + 1):
        has = (low <= d) & (d <= lb)
        run_b[by_b[1:]] = (cb < d).cumsum()
        for length, (repeated, leads) in zip(lengths, out, strict=True):
            rows = np.flatnonzero(has & (la >= length - d))
            if not len(rows):
                continue
            run_a[by_a[1:]] = (ca < length - d).cumsum()
            key = run_a[rows] * n + run_b[rows]
            _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            many = count > 1
            many |= np.bincount(which, twice[rows], len(count)) > 0
            repeated[rows, d] = many[which]
            leads[rows[first], d] = True
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, with_kept: bool = False, also: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay).

    With ``also``, a length under ``width``, a column n_repeated is added: the bytes covered by strings of that length
    that start anywhere else too. They are counted only, not removed.

    Texts are their UTF-8 bytes, null counting as empty; one shorter than ``width`` loses nothing. Matches lie within
    documents and are judged on the input. Rows that repeat a text, whatever their ids, repeat each other's strings. Ids
    may be null. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    lengths = (width,) if also is None else (width, also)
    least = min(lengths)
    span = least - gram + 1
    if not 0 < span <= 1023 or least > width:
        raise ValueError(f"lengths of {lengths} bytes don't go with a gram of {gram}")
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(utf8(F.col(text_col))).alias("k2")]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, utf8(F.col(text_col)).alias("raw"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                found = [anchors(np.frombuffer(raw, np.uint8), least, gram) for raw in b.column("raw").to_pylist()]
                n = [len(f[0]) for f in found]
                h, p, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(4))
                keys = [pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("k1", "k2")]
                packed = lo << 20 | (p - lo) << 10 | (hi - lo)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(h.view(np.int64)), pa.array(packed)], ["k1", "k2", "gram", "at"])

    every, path = written(source.select("k1", "k2", "raw").mapInArrow(find, "k1 long, k2 long, gram long, at long"), "suffix-anchors")
    twice, twice_path = written(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "suffix-grams")
    mine = every.join(twice.hint("merge"), "gram").groupBy("k1", "k2").agg(F.collect_list("at").alias("ats"))
    mine, mine_path = written(mine, "suffix-mine")
    drop_path(spark, path)
    drop_path(spark, twice_path)
    suffix_count = mine.agg(F.sum(F.size("ats"))).first()[0] or 0
    held = source.join(mine.hint("merge"), ["k1", "k2"], "left").select(
        "doc_id",
        "k1",
        "k2",
        F.octet_length("raw").cast("long").alias("n_bytes"),
        F.unhex(F.sha2("raw", 256)).alias("sha"),
        F.when(F.col("ats").isNotNull() | F.lit(with_kept), F.col("raw")).alias("raw"),
        F.array_distinct("ats").alias("ats"),
    )
    held, _ = written(held, "suffix-texts")
    drop_path(spark, mine_path)

    # ``size`` is the length of the bytes around an anchor, from its first window's start.
    out_names = ["k1", "k2", "right", "left", "at", "size", "twice"]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.bool_())
        for whole in batches:
            for low in range(0, whole.num_rows, 50):
                cols: list[list] = [[] for _ in out_names]
                b = whole.slice(low, 50)
                for k1, k2, raw, ats in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "raw", "ats")), strict=True):
                    met: dict[tuple, int] = {}
                    for at in ats:
                        lo, d, more = at >> 20, at >> 10 & 1023, at & 1023
                        part = raw[lo : lo + more + width]
                        # A text's own repeats go on as one suffix, marked; each of their windows is known to repeat.
                        if (k := met.get((part, d))) is not None:
                            cols[6][k] = True
                            cols[2].append(None)
                            cols[3].append(None)
                        else:
                            met[(part, d)] = len(cols[0])
                            cols[2].append(part[d:])
                            cols[3].append(part[:d][::-1])
                        cols[0].append(k1)
                        cols[1].append(k2)
                        cols[4].append(at)
                        cols[5].append(len(part))
                        cols[6].append(k is not None)
                    if len(cols[0]) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], out_names)
                        cols, met = [[] for _ in out_names], {}
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], out_names)

    with_anchors = held.filter("ats IS NOT NULL").select("k1", "k2", "raw", "ats")
    made = with_anchors.mapInArrow(suffixes, "k1 long, k2 long, right binary, left binary, at long, size int, twice boolean")
    word = F.conv(F.hex(F.substring("right", 1, 7)), 16, 10).cast("long")
    tie = F.xxhash64("k1", "k2", "at")
    dealt = made.withColumns({"lead": word, "spread": F.xxhash64(F.substring("right", 1, gram))})
    ranges = min(max(1, -(-suffix_count // RANGE_ROWS)), MAX_RANGES)
    ordered = dealt.repartitionByRange(ranges, "lead", "spread", tie).sortWithinPartitions("lead", "spread", tie)
    bucket_rows = BUCKET_ROWS

    found_names = ["k1", "k2", "length", "start", "stop", "digest", "n"]
    found_kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32())

    def batch(*cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, found_kinds, strict=True)], found_names)

    def spans(k1: np.ndarray, k2: np.ndarray, length: int, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
        return batch(k1, k2, np.full(len(k1), length, np.int32), starts, stops, [None] * len(k1), np.zeros(len(k1), np.int32))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        bucket, room = [], bucket_rows
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, room)
                bucket.append(part)
                at += part.num_rows
                room -= part.num_rows
                if not room:
                    yield bucket
                    bucket, room = [], bucket_rows
        if bucket:
            yield bucket

    def sort_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in buckets(batches):
            yield from sort_bucket(bucket)

    def sort_bucket(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct: dict[tuple[bytes, bytes, int], int] = {}
        own: list[list] = [[] for _ in range(4)]  # k1, k2, place and the number of the distinct suffix
        leads, twice = [], []
        for b in batches:
            gone = b.filter(b.column("right").is_null())
            if gone.num_rows:
                k1, k2, at, size = (gone.column(c).to_numpy() for c in ("k1", "k2", "at", "size"))
                lo = at >> 20
                for length in lengths:
                    stop = lo + np.minimum(size, (at & 1023) + length)
                    ok = size >= length
                    yield spans(k1[ok], k2[ok], length, lo[ok], stop[ok])
            b = b.filter(b.column("right").is_valid())
            which = np.zeros(b.num_rows, np.int64)
            at = b.column("at").to_numpy()
            least_offset = (at >> 10 & 1023) - (at & 1023)
            columns = zip(*(b.column(c).to_pylist() for c in ("right", "left", "lead", "spread", "twice")), least_offset.tolist(), strict=True)
            for k, (right, left, lead, spread, marked, low) in enumerate(columns):
                n = distinct.setdefault((right, left, low), len(twice))
                if n == len(twice):
                    twice.append(marked)
                    leads.append((lead, spread))
                else:
                    twice[n] = True
                which[k] = n
            for c, x in zip(own, (b.column("k1").to_numpy(), b.column("k2").to_numpy(), (at >> 20) + (at >> 10 & 1023), which), strict=True):
                c.append(x)
        if not twice:
            return
        k1, k2, place, which = (np.concatenate(c) for c in own)
        right, left = [x[0] for x in distinct], [x[1] for x in distinct]
        low = np.fromiter((x[2] for x in distinct), np.int64, len(distinct))
        first, last = min(leads), max(leads)
        edge = np.fromiter((x in (first, last) for x in leads), bool, len(leads))
        del distinct, own, leads
        one = np.zeros(len(right), np.int64)
        one[which[::-1]] = np.arange(len(which))[::-1]  # a row of each distinct suffix
        order = np.argsort(which, kind="stable")
        begin = np.searchsorted(which[order], np.arange(len(right) + 1))
        for length, (repeated, heads) in zip(lengths, repeated_in_bucket(right, left, low, np.array(twice, bool), lengths, span), strict=True):
            row, far, near = runs(repeated[:, ::-1])
            # Each row that has the suffix loses the same windows.
            n = (begin[1:] - begin[:-1])[row]
            at = order[np.repeat(begin[row] - (n.cumsum() - n), n) + np.arange(n.sum())]
            starts = place[at] - np.repeat(span - 1 - far, n)
            yield spans(k1[at], k2[at], length, starts, starts + np.repeat(near - far, n) + length)
            # One window of each kind, where its gram may go on in the next bucket.
            cut = np.flatnonzero(edge)
            for at in range(0, len(cut), 200):
                now = cut[at : at + 200]
                r, d = np.nonzero(heads[now])
                r = now[r]
                digests = [hashlib.blake2b(left[x][:y][::-1] + right[x][: length - y], digest_size=16).digest() for x, y in zip(r.tolist(), d.tolist(), strict=True)]
                start = place[one[r]] - d
                yield batch(k1[one[r]], k2[one[r]], np.full(len(r), length, np.int32), start, start + length, digests, np.where(repeated[r, d], 2, 1).astype(np.int32))

    found, _ = written(ordered.mapInArrow(sort_range, "k1 long, k2 long, length int, start long, stop long, digest binary, n int"), "suffix-found")
    across = found.filter("digest IS NOT NULL")
    shared, _ = written(across.groupBy("digest", "length").agg(F.sum("n").alias("all")).filter("all > 1").select("digest", "length"), "suffix-shared")
    columns = ["k1", "k2", "length", "start", "stop"]
    more = across.filter("n = 1").join(shared.hint("merge"), ["digest", "length"]).select(*columns)
    gone = found.filter("digest IS NULL").select(*columns).unionByName(more)
    gone = gone.groupBy("k1", "k2").agg(F.collect_list(F.struct("length", "start", "stop")).alias("gone"))
    last = held.select("doc_id", "k1", "k2", "n_bytes", "sha", "raw").join(gone.hint("merge"), ["k1", "k2"], "left").drop("k1", "k2")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * (also is not None) + ", kept binary" * with_kept
    names = [c.split()[0] for c in kind.split(", ")]

    def union(rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, starts and stops of the maximal runs that each row's spans cover, in order."""
        order = np.lexsort((starts, rows))
        base = rows[order] << 40  # beyond any place in the rows before
        start, reach = base + starts[order], np.maximum.accumulate(base + stops[order])
        new = np.flatnonzero(np.append(True, start[1:] > reach[:-1])[: len(start)])
        end = reach[np.append(new[1:], len(start))[: len(new)] - 1]
        return rows[order][new], starts[order][new], end - base[new]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                b = whole.slice(low, 500)
                cuts = b.column("gone")
                rows = pa.compute.list_parent_indices(cuts).to_numpy().astype(np.int64)
                of, start, stop = (pa.compute.struct_field(cuts.flatten(), c).to_numpy() for c in ("length", "start", "stop"))
                spans_of = {}
                for length in lengths:
                    own = of == length
                    spans_of[length] = union(rows[own], start[own], stop[own])
                row, start, stop = spans_of[width]
                removed = np.bincount(row, stop - start, b.num_rows).astype(np.int64)
                first = np.searchsorted(row, np.arange(b.num_rows + 1))
                digests, left = [], []
                for k, (sha, raw) in enumerate(zip(b.column("sha").to_pylist(), b.column("raw").to_pylist(), strict=True)):
                    kept = raw
                    if removed[k]:
                        parts, at = [], 0
                        for x, y in zip(start[first[k] : first[k + 1]].tolist(), stop[first[k] : first[k + 1]].tolist(), strict=True):
                            parts.append(raw[at:x])
                            at = y
                        kept = b"".join([*parts, raw[at:]])
                        sha = hashlib.sha256(kept).digest()
                    digests.append(sha.hex())
                    left.append(kept)
                arrays = [b.column("doc_id"), b.column("n_bytes"), pa.array(removed), pa.array(first[1:] - first[:-1]), pa.array(digests, pa.string())]
                if also is not None:
                    row, start, stop = spans_of[also]
                    arrays.append(pa.array(np.bincount(row, stop - start, b.num_rows).astype(np.int64)))
                if with_kept:
                    arrays.append(pa.array(left, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    return last.mapInArrow(remove, kind)
