"""Whitening held against eigenvectors of a plainly computed covariance."""

import math

import numpy as np
import pytest

from weirflow.llm import whitening
from weirflow.llm.queries import op11_embedding_whitening

KIND = "vec_id long, embedding array<double>, n string, X string, Whitening string"


def plain(rows, k=16):
    """Per row: exact deviation and, from a covariance of the distinct vectors, eigenvalues and eigenvectors."""
    grid = {i: tuple(math.floor(64 * c) + 1000000 for c in v) for i, v in rows}
    fit = sorted(set(grid.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    deviation = {i: sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True)) for i, x in grid.items()}
    centre = np.array([[(n * a - b) / n for a, b in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centre.T @ centre / n)
    order = np.argsort(-values)[:k]
    whitened = {i: np.array([(n * a - b) / n for a, b in zip(x, sums, strict=True)]) @ vectors[:, order] / np.sqrt(values[order]) for i, x in grid.items()}
    return n, deviation, whitened, values[order] / values.sum()


def made(spark, rows, parts=3):
    full = [(i, None if v is None else [None if c is None else float(c) for c in v], "n", "x", "w") for i, v in rows]
    return spark.createDataFrame(full, KIND).repartition(parts)


def held(out, rows, k):
    n, deviation, whitened, explained = plain(rows, k)
    assert len(out) == len(rows) * len(explained)
    signs = {}
    for r in sorted(out, key=lambda r: -abs(r.whitened)):
        want = whitened[r.vec_id][r.component - 1]
        assert r.n == n and r.deviation == deviation[r.vec_id]
        sign = signs.setdefault(r.component, 1.0 if want * r.whitened > 0 else -1.0)
        assert abs(sign * want - r.whitened) < 1e-8
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
        assert r.identity_error < 1e-9


def test_whitening_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(op11_embedding_whitening(spark, sf).collect(), rows, 16)


def test_repeats_are_fitted_once_and_all_returned(spark):
    rng = np.random.default_rng(3)
    rows = [(k, list(rng.normal(size=5) * [9, 3, 1, 0.5, 0.3])) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(200)]
    held(whitening.whitened_components(made(spark, rows, 9)).collect(), rows, 5)


def test_what_is_no_vector_is_left_out(spark):
    rows = [(k, [k % 7 + 0.1, k * k % 5 - 2.0, (k * 3 + k // 5) % 11]) for k in range(40)]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [math.nan, 0.0, 0.0]), (53, [math.inf, 1.0, 1.0]), (54, []), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0])]
    out = whitening.whitened_components(made(spark, rows + odd)).collect()
    held(out, rows, 3)
    nameless = whitening.whitened_components(made(spark, [*rows, (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])])).collect()
    assert len(nameless) == 3 * 42 and sum(r.vec_id is None for r in nameless) == 6


def test_far_from_zero_and_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(1 << 40) + float(a), float(b)]) for k, (a, b) in enumerate(rng.integers(0, 9, (50, 2)))]
    held(whitening.whitened_components(made(spark, rows)).collect(), rows, 2)
    wide = [(k, [math.ldexp(float(k), 30), float(k % 3)]) for k in range(8)]
    model = whitening.fit(made(spark, wide))
    got = {r.vec_id: int(r.w.deviation) for r in whitening.transform(made(spark, wide), model, into="w").collect()}
    assert got == plain(wide)[1] and max(got.values()) > 1 << 63


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_no_variance(spark, rows):
    out = whitening.whitened_components(made(spark, rows)).collect()
    assert len(out) == 2 * len(rows) and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 for r in out)


def test_flat_components_have_no_scale(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)]
    out = whitening.whitened_components(made(spark, rows)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in out) and len(out) == 27
    assert max(r.identity_error for r in out) < 1e-9


def test_columns_stay_and_empty_tables_pass(spark):
    df = made(spark, [(k, [float(k), float(k * k)]) for k in range(5)])
    model = whitening.fit(df)
    out = whitening.transform(df, model)
    assert [c for c in out.columns] == ["vec_id", "embedding", "n", "X", "whitening"] and out.count() == 5
    nothing = df.limit(0)
    assert whitening.whitened_components(nothing).count() == 0
    assert whitening.transform(nothing, whitening.fit(nothing)).columns == out.columns
