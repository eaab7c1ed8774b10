import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weirflow.llm import near_dedup, suffix_dedup
from weirflow.llm.common import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_near(docs, percent=85):
    sets = {}
    for i, text in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    posting = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for x in s for j in posting[x])
        for x in s:
            posting[x].append(i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_near(df, percent=85):
    docs = {r.doc_id: r.text for r in df.select("doc_id", "text").collect() if r.doc_id is not None}
    want = brute_near(docs.items(), percent)
    for r in near_dedup.near_dedup(df, percent).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_near_dedup_on_documents(spark):
    check_near(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_near_dedup_edges(edge, nothing):
    check_near(edge)
    assert near_dedup.near_dedup(nothing).count() == 0


def variants(rng, n, words, most):
    """Texts that each differ from one of so many words in up to ``most`` places."""
    out = []
    for _ in range(n):
        own = list(words)
        for at in rng.choice(len(words), rng.integers(0, most), replace=False):
            own[at] = f"x{rng.integers(1000)}"
        out.append(" ".join(own))
    return out


def test_near_dedup_blocks(spark, monkeypatch):
    """Buckets and clusters that need many blocks give the same components, near their leader or far from it."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 1500)
    for most, n in ((5, 60), (14, 120)):
        docs = spark.createDataFrame(list(enumerate(variants(rng, n, base, most))), "doc_id long, text string")
        for percent in (85, 80):
            check_near(docs, percent)


def test_hot_group_is_dealt_once(spark):
    """A group of many blocks is dealt row by row, its leader to each block; the rest goes to as few as hold it."""
    rows = spark.range(1000).selectExpr("7L AS bucket", "id AS rep", "3L AS leader", "1000L AS size", "20 AS blocks")
    assert near_dedup.dealt(rows, "bucket", "rep", "leader", "blocks").count() == 999 + 20
    still = spark.range(900, 930).selectExpr("7L AS group", "id AS a")
    counts = {r.rest: r["count"] for r in near_dedup.dealt_rest(rows, still, "bucket", "rep", "blocks").groupBy("rest").count().collect()}
    assert counts == {True: 30 * 20, False: 1000}


def test_bands_miss_few():
    for percent in (85, 80, 70):
        r = near_dedup.band_rows(percent)
        assert near_dedup.HASHES % r == 0 and (1 - (percent / 100) ** r) ** (near_dedup.HASHES // r) <= 1e-6
    assert near_dedup.band_rows(85) == 5


def test_bayesian_bounds_are_careful():
    steps = near_dedup.least_matches(85)
    assert [k for k, _ in steps] == list(range(24, 121, 24))
    rng = np.random.default_rng(0)
    for k, least in steps:
        assert (rng.binomial(k, 0.85, 200_000) < least).mean() < 1e-4
    assert steps[-1][1] > 70


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 3)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100} | {200 + k: 200 for k in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_suffix(rows, width):
    count = Counter(raw[s : s + width] for raw in rows for s in range(len(raw) - width + 1))
    out = []
    for raw in rows:
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            if count[raw[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(a for a, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check_suffix(df, **kw):
    rows = [(r.text or "").encode() for r in df.select("text").collect()]
    out = suffix_dedup.suffix_dedup(df, **kw).collect()
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == brute_suffix(rows, kw.get("width", 400))
    if also := kw.get("also"):
        assert sorted((r.n_bytes, r.n_repeated) for r in out) == sorted(x[:2] for x in brute_suffix(rows, also))
    return got


def test_suffix_dedup_on_documents(spark):
    assert sum(r[1] for r in check_suffix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), also=256)) > 0


def test_suffix_dedup_edges(edge, nothing):
    check_suffix(edge)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("bucket, in_range, ranges", [(20, 20, 1000), (20, 1000, 1000), (7, 50, 3)])
def test_suffix_dedup_over_many_buckets(spark, monkeypatch, bucket, in_range, ranges):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ab\0"), n))
    passage, other = word(70), word(60)
    docs = [(k, word(rng.integers(0, 90)) + (passage if k % 2 else other) * (1 + k % 3) + word(rng.integers(0, 60))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", in_range)
    monkeypatch.setattr(suffix_dedup, "MAX_RANGES", ranges)
    check_suffix(df, width=40, gram=12)
    check_suffix(df, width=40, gram=6, also=16)
    check_suffix(df, width=40, gram=1, also=2)


def test_suffix_dedup_of_texts_longer_than_a_chunk(spark):
    """A passage lies across the place where a long text's windows are cut into chunks, another in both of two long texts."""
    rng = np.random.default_rng(6)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    chunk, passage, short = suffix_dedup.CHUNK, letters(900), letters(300)
    long = letters(chunk - 450) + passage + letters(chunk) + short
    texts = [long, letters(700) + passage + letters(50), letters(chunk - 100) + short + letters(chunk // 4), letters(500)]
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df, also=256).collect()}
    assert [(got[k].n_removed, got[k].n_spans, got[k].n_repeated) for k in range(4)] == [(900, 1, 1200), (900, 1, 900), (0, 0, 300), (0, 0, 0)]
    assert got[1].kept_sha256 == hashlib.sha256(texts[1].replace(passage, b"")).hexdigest()


def test_multikey_order():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (300, 21)).astype(np.uint8)
    rows[100:200, :15] = rows[0, :15]
    order = suffix_dedup.multikey_order(rows)
    assert sorted(order.tolist()) == list(range(300))
    texts = [rows[k].tobytes() for k in order]
    assert texts == sorted(texts)
