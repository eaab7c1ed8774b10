import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirflow.llm import mixing

DOMAINS = [(0, 0), (0, 1), (1, 0), (1, 1)]


@pytest.fixture(scope="module")
def scarce(spark):
    """2000 documents, two of each toxic domain: their targets of 0.02 need rates of about 20."""
    rng, rows, labels = random.Random(3), [], []
    for k in range(2000):
        toxic, quality = int(k < 4), k % 2
        vocabulary = [f"{a}{b}" for a in (("vile", "nasty") if toxic else ("calm", "plain")) for b in "abcd"] + [f"{'good' if quality else 'poor'}{b}" for b in "abcd"]
        rows.append((k, " ".join(rng.choice(vocabulary) for _ in range(60)), "en", "src0", 60))
        labels.append((k, quality, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain(p, n, goal, rounds=20_000):
    """Projected gradient on rates >= 0, one matrix in memory."""
    weight = np.linalg.pinv((p * n[:, None]).T @ p)
    rate = np.ones(len(n))
    for _ in range(rounds):
        rate = np.maximum(0, rate - p @ (weight @ (p.T @ (n * rate) - goal)))
    return p.T @ (n * rate)


def arrays(mixed):
    rows = mixed.select("mix.*").toPandas()
    return np.stack(rows["p"].to_numpy()), rows["tokens"].to_numpy(), rows["rate"].to_numpy()


def test_scarce_domains_meet_their_own_targets(scarce):
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        p, n, rate = arrays(mixing.mix(*scarce))
    goal = np.array([mixing.TARGETS[d] for d in DOMAINS]) * n.sum()
    got = p.T @ (n * rate)
    assert rate.min() >= 0 and rate.max() > 15
    assert (np.abs(got - goal) <= mixing.TOLERANCE * goal * 1.001).all()
    assert np.allclose(got, plain(p, n, goal, 200), rtol=2 * mixing.TOLERANCE)


def test_tiny_targets_are_met_too(scarce):
    targets = {(1, 0): 0.8985, (1, 1): 0.0005, (0, 0): 0.1, (0, 1): 0.001}
    p, n, rate = arrays(mixing.mix(*scarce, targets))
    goal = np.array([targets[d] for d in DOMAINS]) * n.sum()
    assert (np.abs(p.T @ (n * rate) - goal) <= mixing.TOLERANCE * goal * 1.001).all()


def test_what_cannot_be_met_is_reported(scarce):
    docs, labels = scarce
    with pytest.warns(RuntimeWarning, match="no rates meet"):
        mixing.mix(docs, labels.limit(0))
    with pytest.warns(RuntimeWarning, match="not met in 0 rounds"):
        mixing.mix(docs, labels, rounds=0)


def test_pipeline_stage_repeats_scarce_documents(spark, scarce, tmp_path):
    docs, labels = scarce
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mixture(spark, docs, str(tmp_path)).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n")).collect()
    share = {(r.quality, r.toxic): r.n / 2000 for r in out}
    assert all(abs(share[d] - w) <= 0.1 * w for d, w in mixing.TARGETS.items())
