import math
import warnings
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import BASE
from weirflow.llm import language_id, media, mixing, toxicity

SF = "/root/testdata/sf0.01"


def test_language_id_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = language_id.identify(docs).select("lang", "language.*").collect()
    assert np.mean([r.code == r.lang for r in out]) > 0.97
    assert np.mean([r.kept for r in out]) > 0.99


def test_language_id_without_declarations_on_half(spark):
    """Held-out accuracy: half of the documents hide their language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("text", "lang AS truth", "IF(doc_id % 2 = 0, lang, NULL) AS lang", "CAST(NULL AS STRING) AS source")
    out = language_id.identify(docs).filter("lang IS NULL").select("truth", "language.code").collect()
    assert np.mean([r.code == r.truth for r in out]) > 0.97


def test_language_id_of_pages(spark):
    pages = language_id.page_evidence(spark.read.parquet(f"{SF}/pages.parquet"))
    out = language_id.identify(pages, "text", "declared", "host", "suffix").select("declared", "suffix", "language.*").collect()
    assert {r.suffix for r in out} <= {"com", "org", "net"}
    assert np.mean([r.code == r.declared for r in out]) > 0.9


def test_host_prior_decides_where_texts_do_not(spark):
    rows = [("die der und ist nicht das ein", "de", "a.example.org")] * 30 + [("the and of is not that one", "en", "b.example.org")] * 30
    rows += [("xx", None, "a.example.org"), ("xx", None, "b.example.org")]
    out = language_id.identify(spark.createDataFrame(rows, "text string, lang string, source string")).filter("text = 'xx'").select("source", "language.code").collect()
    assert {r.source: r.code for r in out} == {"a.example.org": "de", "b.example.org": "en"}


def test_language_id_edges(edge, nothing):
    out = language_id.identify(edge)
    assert sorted(out.columns) == sorted(edge.columns)
    rows = out.select("doc_id", "text", "language.*").collect()
    assert len(rows) == edge.count()
    for r in rows:
        if not (r.text or "").strip():
            assert (r.code, r.confidence, r.kept) == ("und", 0.0, False)
    assert all(r.kept for r in rows if r.doc_id in (1, 2, 6, 7, 8))
    assert language_id.identify(nothing).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixing_meets_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = mixing.mix(docs, labels).select("doc_id", "mix.*").toPandas()
    p, n, rate = np.stack(rows["p"].to_numpy()), rows["tokens"].to_numpy(), rows["rate"].to_numpy()
    assert np.allclose(p.sum(1), 1) and rate.min() >= 0
    got = (p * (n * rate)[:, None]).sum(0) / n.sum()
    want = np.array([mixing.TARGETS[d] for d in ((0, 0), (0, 1), (1, 0), (1, 1))])
    assert np.abs(got - want).max() < 0.01
    truth = labels.selectExpr("doc_id", "2 * quality + toxic AS domain").toPandas().drop_duplicates("doc_id").merge(rows, on="doc_id")
    right = (np.stack(truth["p"].to_numpy()).argmax(1) == truth["domain"]).mean()
    assert right > truth["domain"].value_counts(normalize=True).max()


def test_mixing_posterior_by_hand(spark):
    """The posterior over the four domains is that of the shrunk naive Bayes model computed plainly, word by word."""
    docs = [(1, "sun sun moon", 1, 0), (2, "moon rain", 1, 0), (3, "mud rain mud", 0, 0), (4, "filth sun", 1, 1), (5, "filth mud", 0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int, toxic int")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        got = {r.doc_id: r.mix.p for r in mixing.mix(df, df).collect()}
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in ("sun", "moon", "rain", "mud", "filth")], "w string").select("w", mixing.buckets(F.col("w"))[0].alias("b")).collect()}
    assert len(set(bucket.values())) == 5
    vocabulary = sorted(bucket)
    words, n_docs = {}, {}
    for q in (0, 1):
        for t in (0, 1):
            own = [text.split() for _, text, *label in docs if label == [q, t]]
            words[q, t], n_docs[q, t] = Counter(sum(own, [])), len(own) + 1
    every = sum(words.values(), Counter())
    rest = 0.5 * (mixing.BUCKETS - 5)  # buckets without any word count half a word
    pooled = {w: every[w] / (every.total() + rest) for w in vocabulary}

    def alone(j, v, w):
        own = sum((c for d, c in words.items() if d[j] == v), Counter())
        return (own[w] + mixing.SMOOTHING * pooled[w]) / (own.total() + mixing.SMOOTHING)

    def alone_rest(j, v):  # of all buckets without words, together
        own = sum((c for d, c in words.items() if d[j] == v), Counter())
        return mixing.SMOOTHING * rest / (every.total() + rest) / (own.total() + mixing.SMOOTHING)

    share = {(j, v): sum(n for d, n in n_docs.items() if d[j] == v) / sum(n_docs.values()) for j in (0, 1) for v in (0, 1)}
    for i, text, *_ in docs:
        logs = []
        for q, t in ((0, 0), (0, 1), (1, 0), (1, 1)):
            mixed = {w: alone(0, q, w) * alone(1, t, w) / pooled[w] for w in vocabulary}
            whole = sum(mixed.values()) + alone_rest(0, q) * alone_rest(1, t) / (rest / (every.total() + rest))
            here = words[q, t]
            prior = n_docs[q, t] + sum(n_docs.values()) * share[0, q] * share[1, t]
            logs.append(np.log(prior) + sum(np.log((here[w] + mixing.SMOOTHING * mixed[w] / whole) / (here.total() + mixing.SMOOTHING)) for w in text.split()))
        want = np.exp(np.array(logs) - max(logs))
        assert np.allclose(got[i], want / want.sum(), atol=1e-4)


def test_a_combination_that_no_label_shows(spark):
    """No labelled document is poor and toxic; one that has the signs of both has a share of that domain nevertheless."""
    rows = [(k, " ".join([f"{'good' if k % 3 else 'poor'}{j}" for j in range(20)] + ["vile vicious nasty"] * (k % 9 == 1)), int(k % 3 > 0), int(k % 9 == 1)) for k in range(900)]
    rows.append((1000, " ".join([f"poor{j}" for j in range(20)] + ["vile vicious nasty"] * 3), None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        got = {r.doc_id: r.mix for r in mixing.mix(df, df.filter("quality IS NOT NULL")).collect()}
    assert got[1000].p[1] > 0.3 and max(m.p[1] for k, m in got.items() if k < 1000) < 0.1
    assert sum(m.rate * m.tokens * m.p[1] for m in got.values()) > 0


def test_mixing_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, None, 1), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    plain = edge.drop("mix")
    out = mixing.mix(plain, labels, rounds=20)
    assert out.count() == edge.count()
    assert set(mixing.realise(out).columns) == set(plain.columns)
    assert mixing.mix(edge, labels.limit(0)).count() == edge.count()
    assert mixing.mix(plain.limit(0), labels).count() == 0


def test_columns_that_differ_in_case_are_replaced(spark, edge):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    docs = edge.select("doc_id", "text", "lang", "source").selectExpr("*", "'x' AS Language", "'y' AS Mix")
    out = language_id.identify(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "Mix", "language"]) and out.filter("language.kept").count() > 5
    mixed = mixing.mix(docs, labels, rounds=5)
    assert sorted(mixed.columns) == sorted(["doc_id", "text", "lang", "source", "Language", "mix"])
    assert mixing.realise(mixed).columns == ["doc_id", "text", "lang", "source", "Language"]


@pytest.mark.parametrize("ids", ["CAST(NULL AS BIGINT)", "CAST(7 AS BIGINT)", "id"])
def test_realised_rows_without_ids_of_their_own(spark, ids):
    """Each row has a chance of its own: of 4000 at a rate of 2.3 about 9200 come out, and the same ones each time."""
    docs = spark.range(4000).selectExpr(f"{ids} AS doc_id", "'some text' AS text", "id AS row")
    mixed = mixing.mix(docs, spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"), targets={(1, 0): 1.0}, rounds=0)
    fixed = mixed.withColumn("mix", F.struct(F.lit(2.3).alias("rate"), F.col("mix.chance").alias("chance")))
    out = mixing.realise(fixed)
    times = Counter(r.row for r in out.collect())
    assert set(times.values()) == {2, 3} and abs(sum(times.values()) - 9200) < 200
    assert Counter(r.row for r in out.repartition(3).collect()) == times


def test_rates_against_plain_least_squares(spark):
    """On a table whose targets cannot all be met the loss is that of a plain non-negative least squares."""
    rows = [(k, " ".join([("good", "bad")[k % 2]] * 5 + [("kind", "vile")[k % 5 == 0]] * (1 + k % 7)), int(k % 2), int(k % 5 == 0)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    targets = {(0, 0): 0.05, (0, 1): 0.9, (1, 0): 0.04, (1, 1): 0.01}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        out = [r.mix for r in mixing.mix(df, df, targets=targets, rounds=100).collect()]
    n, p = np.array([m.tokens for m in out]), np.array([m.p for m in out])
    a = (n[:, None] * p).T
    goal = np.array([targets[d] for d in ((0, 0), (0, 1), (1, 0), (1, 1))]) * n.sum()
    metric = mixing.inverse((n[:, None] * p).T @ p, np.maximum(a.sum(1), 1e-6))
    loss = lambda r: (a @ r - goal) @ metric @ (a @ r - goal) / 2
    rate, at, t = np.ones(60), np.ones(60), 1.0
    gram = a.T @ metric @ a
    step = 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(20_000):
        new = np.maximum(at - step * (gram @ at - a.T @ metric @ goal), 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        rate, at, t = new, new + (t - 1) / after * (new - rate), after
    assert loss(np.array([m.rate for m in out])) <= 1.2 * loss(rate)  # after 100 rounds, of which the operator warns


def test_toxicity_without_the_label_voter(spark):
    """Labels then choose stems alone; what is left is word lists and patterns, which miss most but seldom err."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels, label_voter=False).toPandas()
    both = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    hit, clean = (both[both["toxic"] == k] for k in (1, 0))
    rank = both["score"].rank()
    auc = (rank[both["toxic"] == 1].sum() - len(hit) * (len(hit) + 1) / 2) / (len(hit) * len(clean))
    assert auc > 0.8 and (clean["predicted"] == 0).mean() > 0.98


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).toPandas()
    assert len(out) == 10_000 and out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= 0.7)).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()
    both = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    hit = both[both["toxic"] == 1]
    assert (hit["predicted"] == 1).mean() > 0.8
    assert (both[both["toxic"] == 0]["predicted"] == 0).mean() > 0.98


def test_toxicity_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(edge, labels).collect()
    assert len(out) == edge.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(edge, labels.limit(0)).count() == edge.count()
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_media_round_trip(edge, nothing):
    out = media.text_media(edge).collect()
    texts = {r.doc_id: r.text for r in edge.select("doc_id", "text").collect() if r.doc_id is not None}
    import hashlib

    for r in out:
        assert r.payload_bytes % 576 == 0 and r.payload_bytes > 0 and r.media_bytes == r.payload_bytes + 44
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            padded = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
            assert (r.n_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(padded).hexdigest())
            assert r.tail_crc32 == zlib.crc32(padded[-32:])
            times = [f.t for f in r.fingerprints]
            assert times == sorted(times)
    same = [r for r in out if r.doc_id in (1, 2)]
    assert len({(r.feature, r.media_sha256) for r in same}) == 1
    assert media.text_media(nothing).count() == 0


def brute_fingerprints(samples):
    """By a plain transform of each frame, all pairs of its bands' peaks with the strongest of this and the next two frames."""
    x = np.frombuffer(samples, np.uint8).astype(float) - 128
    x = np.pad(x, (0, max(0, 576 - len(x))))
    frames = []
    for at in range(0, len(x) - 575, 288):
        power = np.abs(np.fft.rfft(x[at : at + 576] * np.hanning(576))) ** 2
        best = [a + int(power[a:b].argmax()) for a, b in ((1, 9), (9, 33), (33, 97), (97, 289))]
        frames.append((best, max(best, key=lambda k: power[k])))
    out = []
    for t, (best, _) in enumerate(frames):
        for dt in range(3):
            if t + dt < len(frames):
                out += [(t, a << 11 | frames[t + dt][1] << 2 | dt) for a in best if dt or a != frames[t][1]]
    return sorted(out)


def test_media_columns(spark):
    data = spark.createDataFrame([(1, bytearray(BASE.encode() * 20)), (2, None), (3, bytearray())], "id long, data binary")
    made = media.encode_wav(data, "data")
    out = media.wav_fingerprints(made).orderBy("id").collect()
    assert media.wav_samples(bytes(out[0].media)) == BASE.encode() * 20
    assert [tuple(f) for f in out[0].fingerprints] == brute_fingerprints(BASE.encode() * 20)
    assert out[1].media is None and out[1].fingerprints is None
    assert media.wav_samples(bytes(out[2].media)) == b"" and len(out[2].fingerprints) == 3
    again = media.wav_fingerprints(made.selectExpr("*", "'old' AS fingerprints", "id AS t", "id AS hash")).orderBy("id")
    assert again.columns == ["id", "data", "media", "t", "hash", "fingerprints"]
    assert [r.fingerprints for r in again.collect()] == [r.fingerprints for r in out]
    assert media.wav_fingerprints(made.limit(0)).count() == 0


def test_media_of_many_frames():
    """More frames than a block of transforms takes at once give what a plain transform gives."""
    rng = np.random.default_rng(4)
    samples = rng.integers(0, 256, 288 * (media.BLOCK + 40) + 576).astype(np.uint8).tobytes()
    t, h = media.pair_fingerprints(samples)
    assert list(zip(t.tolist(), h.tolist(), strict=True)) == brute_fingerprints(samples)


def test_peaks_find_tones():
    t = np.arange(576 * 8)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / 576)).astype(np.uint8).tobytes()
    bins, power = media.peaks(tone)
    assert (bins[np.arange(len(bins)), power.argmax(1)] == 20).all()


def test_label_model_against_enumeration():
    """Posteriors are those of the model's own tables, multiplied out voter by voter; good voters are told from a bad one."""
    rng = np.random.default_rng(7)
    n, v = 4000, len(toxicity.VOTERS)
    truth = rng.random(n) < 0.2
    x = np.zeros((n, v), int)
    for j, (hit, alarm) in enumerate(((0.8, 0.02), (0.7, 0.05), (0.6, 0.03), (0.3, 0.3))):
        x[:, j] = rng.random(n) < np.where(truth, hit, alarm)
    x[:, 4] = x[:, 0]  # a voter that repeats another
    bits, count = np.unique(x @ (1 << np.arange(v)), return_counts=True)
    model = toxicity.LabelModel(bits, np.full(len(bits), -1), count)
    assert (model.parent[4] == 0) or (model.parent[0] == 4)
    got = model.posterior_of(bits, np.full(len(bits), -1))
    for pattern, p in zip(bits.tolist(), got, strict=True):
        own = [pattern >> j & 1 for j in range(v)]
        like = [model.prior[c] * np.prod([model.table[c, j, own[model.parent[j]] if model.parent[j] >= 0 else 0, own[j]] for j in range(v)]) for c in (0, 1)]
        assert np.isclose(p, like[1] / sum(like))
    rows = x @ (1 << np.arange(v))
    right = lambda p: np.mean((np.array([dict(zip(bits.tolist(), p, strict=True))[b] for b in rows.tolist()]) > 0.5) == truth)
    assert right(got) > 0.85  # no label known, a fifth of the rows toxic
    assert model.accuracy[0] > model.accuracy[3]
    # With the label of a third of the rows, of which one in twenty is wrong.
    label = np.where(rng.random(n) < 1 / 3, truth ^ (rng.random(n) < 0.05), -1)
    both, count = np.unique(np.stack([rows, label]), axis=1, return_counts=True)
    model = toxicity.LabelModel(both[0], both[1], count)
    assert right(model.posterior_of(bits, np.full(len(bits), -1))) > 0.93


def test_fit_linear_in_blocks():
    rng = np.random.default_rng(8)
    rows = [np.sort(rng.choice(40, rng.integers(0, 9), replace=False)) for _ in range(300)]
    ends, cols = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows).astype(np.int32)
    target = np.array([float(3 in r or 7 in r) for r in rows])
    for block in (1 << 20, 200):
        w, b = toxicity.fit_linear(cols, ends, 40, target, np.full(40, 1e-3), 200, block)
        assert set(np.argsort(w)[-2:]) == {3, 7}
        assert np.mean([(w[r].sum() + b > 0) == t for r, t in zip(rows, target, strict=True)]) > 0.98
