"""Importance resampling held against a plain version in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from weirflow.llm import resampling
from weirflow.llm.queries import op12_importance_resampling

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPLIT.findall((text or "").translate(LOWER))


def features(text):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def plain(docs, target, percent=5, min_words=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in range(10000)]
    rows = []
    for key, x in docs:
        f = features(x)
        weight = sum(gain[b] * n for b, n in f.items())
        score = None
        if key is not None:
            h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, sum(f.values()), weight, score, None])
    able = [r for r, (_, x) in zip(rows, docs, strict=True) if len(words(x)) >= min_words and r[3] is not None]
    for k, r in enumerate(sorted(able, key=lambda r: (-r[3], r[0]))[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = op12_importance_resampling(spark, sf)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(out) == plain(docs, target)


def test_edges(spark, edge, nothing):
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    docs = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    out = resampling.resample(edge, target, percent=50, min_words=3)
    rows, want = got(out), plain(docs, ["the quick brown fox"], 50, 3)
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    assert sorted(r[4] for r in rows if r[4]) == sorted(r[4] for r in want if r[4])
    assert resampling.resample(nothing, target).count() == 0
    assert got(resampling.resample(edge, target.limit(0), 50, 3).select("doc_id", "n_features", "weight", "score", "rank"))[0][1] >= 0


def test_ties_go_to_the_smaller_id(spark):
    """Ids whose noise is the same, which are searched for, and equal texts have equal scores."""
    floor = lambda i: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
    docs = [(i, " ".join(["word"] * 25)) for i in range(3000, 0, -1)]
    assert len({floor(i) for i, _ in docs}) < len(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("other words",)], "text string")
    assert got(resampling.resample(df, target, percent=90)) == plain(docs, ["other words"], 90)


def test_blocks_and_windows_of_any_size(spark, monkeypatch):
    text = " ".join(f"w{k % 37} É{k % 5}" for k in range(400))
    want = features(text)
    for window in (1, 2, 3, 50, 800, 801):
        monkeypatch.setattr(resampling, "WINDOW", window)
        found = Counter()
        for _, x in resampling.run_buckets(text):
            found.update(x.tolist())
        assert found == want, window
    blocks = resampling.csr_blocks(spark.createDataFrame([(k, "a b a b a") for k in range(5)], "doc_id long, text string").coalesce(1))
    row = blocks.first()
    start, count = (np.frombuffer(bytes(row[c]), "<u4").tolist() for c in ("start", "count"))
    assert row.doc_id == list(range(5)) and row.n_words == [5] * 5 and start == [6 * k for k in range(6)] and sum(count) == 60
    assert len(row.bucket) == 2 * start[-1]
