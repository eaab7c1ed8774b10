"""Fingerprints: round trips of inserting and deleting, and the query held against a plain version."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from weirflow.llm import fingerprints as fp
from weirflow.llm.queries import op13_document_fingerprints


def plain_vector(parts):
    """Paragraph by paragraph, run by run."""
    whole, sketch = [0] * fp.WHOLE, [0] * fp.SKETCH
    for p in parts:
        for k, x in enumerate(np.frombuffer(hashlib.blake2b(p, digest_size=8 * fp.WHOLE).digest(), "<u8").tolist()):
            whole[k] = (whole[k] + x) % 2**64
        p = p.ljust(fp.RUN, b"\0")
        for at in range(len(p) - fp.RUN + 1):
            h = sum(c * pow(fp._BASE, k, 2**64) for k, c in enumerate(p[at : at + fp.RUN])) % 2**64
            for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
                h = (h ^ (h >> shift)) * factor % 2**64
            lane = (h ^ (h >> 33)) >> 55
            sketch[lane % fp.SKETCH] += 1 if lane < fp.SKETCH else -1
    return fp.Sum(np.array(whole, np.uint64), np.array([x % 2**16 for x in sketch], np.uint16)).dumps()


def plain(docs):
    order = sorted(docs, key=lambda r: -r[0])
    out = []
    for k, (key, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        n = len(text)
        edited = text[: n - n // 2] + other[: n // 2]
        marks = [fp.of_text(x) for x in (text, edited, other)]
        out.append((key, n, hashlib.sha256(edited.encode()).hexdigest(), marks[0].dumps(), marks[1].dumps(), marks[0].likeness(marks[1]), marks[0].likeness(marks[2])))
    return sorted(out)


def test_vector_is_the_plain_sum():
    rng = random.Random(5)
    for _ in range(20):
        text = "\n".join("".join(rng.choice("ab é \t\0漢") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6)))
        parts = fp.paragraphs(text.encode())
        assert fp.vector(parts).dumps() == plain_vector(parts) == fp.Sum.loads(fp.vector(parts).dumps()).dumps()


def test_windows(monkeypatch):
    parts = [bytes([97 + k % 26]) * k for k in range(1, 80)]
    want = fp.vector(parts).dumps()
    for window in (1, 7, 64):
        monkeypatch.setattr(fp, "WINDOW", window)
        assert fp.vector(parts).dumps() == want


def test_order_inserts_and_deletes():
    a, b, c = (f"Paragraph {x} has words of its own, as {x} does." for x in ("alpha", "beta", "gamma"))
    assert fp.of_text(f"{a}\n{b}\n\n{c}").dumps() == fp.of_text(f"{c}\n {a}\n{b}\t").dumps()
    assert fp.of_text(f"{a}\n{a}").dumps() != fp.of_text(a).dumps()
    assert (fp.of_text(a) + fp.of_text(b) - fp.of_text(a)).dumps() == fp.of_text(b).dumps()
    assert fp.replaced(fp.of_text(f"{a}\n{b}"), f"{a}\n{b}", f"{a}\n{c}").dumps() == fp.of_text(f"{a}\n{c}").dumps()


def test_likeness_follows_what_is_shared():
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefghij klmnop") for _ in range(60)) for _ in range(200)]
    whole = fp.of_text("\n".join(lines[:100]))
    for shared in (0, 25, 50, 75, 100):
        other = fp.of_text("\n".join(lines[100 - shared : 200 - shared]))
        assert abs(whole.likeness(other) - shared / 100) < 0.25
    assert whole.likeness(whole) == 1.0 and fp.Sum().likeness(fp.Sum()) == 1.0 and fp.Sum().likeness(whole) == 0.0


def test_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = op13_document_fingerprints(spark, sf)
    assert sorted(map(tuple, out.collect())) == plain(docs)


def test_the_next_document_across_ranges(spark):
    docs = [(k * k % 1009, None if k % 50 == 0 else f"text {k % 9}\nof document {k}") for k in range(1, 500)]
    docs = list({k: (k, t) for k, t in docs}.values())
    for n in (1, 2, len(docs)):
        df = spark.createDataFrame(docs[:n], "doc_id long, text string").repartition(5)
        assert sorted(map(tuple, fp.fingerprints(df).collect())) == plain(docs[:n])


def test_edges(edge, nothing):
    out = fp.fingerprints(edge).collect()
    assert len(out) == edge.count()
    texts = {r.doc_id: r.text for r in edge.collect()}
    marks = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            assert r.n_chars == len(texts[r.doc_id] or "") and marks.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert sum(r.doc_id is None for r in out) == 2
    assert fp.fingerprints(nothing).count() == 0


def test_columns_and_groups(spark):
    df = spark.createDataFrame([("d", "a\nb"), ("d", "c"), ("e", "c\nb\na"), (None, "x"), ("f", None)], "doc string, text string").withColumn("mark", fp.fingerprint(F.col("text")))
    sums = {r.doc: r.fingerprint for r in fp.total(df, ["doc"], "mark").collect()}
    assert sums["d"] == sums["e"] == fp.of_text("a\nb\nc").dumps() and sums[None] == fp.of_text("x").dumps() and sums["f"] == fp.Sum().dumps()
    pair = df.select(fp.fingerprint(F.lit("a\nb")).alias("ab"), fp.fingerprint(F.lit("b")).alias("b")).limit(1)
    row = pair.select(fp.deleted(F.col("ab"), F.col("b")).alias("a"), fp.inserted(F.col("b"), F.col("b")).alias("bb"), fp.likeness(F.col("b"), F.col("b")).alias("same"), fp.likeness(F.lit(None).cast("string"), F.col("b")).alias("none")).first()
    assert row.a == fp.of_text("a").dumps() and row.bb == fp.of_text("b\nb").dumps() and row.same == 1.0 and row.none is None
    assert fp.total(df.limit(0), ["doc"], "mark").count() == 0
