"""Similarity joins, components, joins by time and frames, each held against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_lookups import similarity
from weirflow.operators import graph, joins, rows


def test_candidates_are_few(spark):
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 20)))
    a, b = [name() for _ in range(1000)], [name() for _ in range(990)]
    b += ["x" + x[:-1] for x in a[:10]]
    pairs = joins.candidates(spark.createDataFrame([(x,) for x in a], "_value string"), spark.createDataFrame([(x,) for x in b], "_match string"), 0.8)
    found = {tuple(r) for r in pairs.distinct().collect()}
    assert len(found) < 0.05 * 1_000_000
    assert all((x, "x" + x[:-1]) in found for x in a[:10] if similarity(x, "x" + x[:-1]) >= 0.8)


@pytest.mark.parametrize("least", [0.35, 0.6, 0.75, 0.9, 1.0])
def test_no_similar_pair_is_lost(spark, least):
    """Values one or several edits apart, at every place, and shorter or longer."""
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choice("abAB ") for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 13, 14, 20)]

    def edited(x):
        x = list(x)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(x))
            kind = rng.randrange(3)
            if kind == 0:
                x.insert(at, rng.choice("abZ"))
            elif x:
                x[min(at, len(x) - 1) : min(at, len(x) - 1) + 1] = [] if kind == 1 else [rng.choice("abZ")]
        return "".join(x)

    a, b = sorted({edited(x) for x in base for _ in range(8)}), sorted({edited(x) for x in base for _ in range(8)})
    got = joins.similar(spark.createDataFrame([(x,) for x in a], "_value string"), spark.createDataFrame([(x,) for x in b], "_match string"), least)
    want = {(x, y) for x in a for y in b if similarity(x, y) >= least}
    assert {(r._value, r._match) for r in got.collect()} == want


def test_fuzzy_lookup_needs_a_least_similarity(spark):
    df = spark.createDataFrame([("a",)], "v string")
    for least in (0.0, -1.0, 1.1):
        with pytest.raises(ValueError):
            joins.fuzzy_lookup(df, df.withColumnRenamed("v", "r"), "v", "r", min_similarity=least)


def test_fuzzy_grouping_is_transitive(spark):
    chain = ["abcdefghij", "abcdefghix", "abcdefghyx", "abcdefgzyx"]
    df = spark.createDataFrame([(x,) for x in [*chain, "abcdefghyx", "other", None, None, ""]], "name string")
    out = joins.fuzzy_grouping(df, "name", 0.9)
    got = sorted(((r.name, r._group_key, r._canonical) for r in out.collect()), key=repr)
    want = [(x, "abcdefghij", "abcdefghyx") for x in [*chain, "abcdefghyx"]] + [("other", "other", "other"), (None, None, None), (None, None, None), ("", "", "")]
    assert got == sorted(want, key=repr)
    ids = {r._group_key: r._group_id for r in out.collect()}
    assert len(set(ids.values())) == len(ids)
    assert joins.fuzzy_grouping(df.limit(0), "name").count() == 0


def test_components_and_reach(spark):
    n = 40
    path = [(k, k + 1) for k in range(n)] + [(100, 101), (102, 101), (103, 103)]
    got = dict(map(tuple, graph.connected(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()))
    assert got == {**{k: 0 for k in range(n + 1)}, 100: 100, 101: 100, 102: 100}
    links = spark.createDataFrame([("a", 1, "b", 1), ("b", 1, "c", 2), ("c", 2, "a", 1), ("x", 1, "y", 1), ("b", 1, "d", 1)], "s string, t int, u string, v int")
    reach = lambda *at: sorted(map(tuple, graph.reachable(links, spark.createDataFrame([at], "s string, t int"), ["s", "t"], ["u", "v"]).collect()))
    assert reach("a", 1) == [("a", 1, 3), ("b", 1, 1), ("c", 2, 2), ("d", 1, 2)]
    assert reach("y", 1) == []


def test_as_of_join_across_bins(spark):
    rng = random.Random(3)
    left = [(rng.choice([1, 2, None]), rng.choice([None, *[x / 4 for x in range(400)]]), k) for k in range(300)]
    right = [(rng.choice([1, 2, None]), rng.choice([None, *[float(x) for x in range(0, 100, 7)]]), k) for k in range(60)]
    a, b = spark.createDataFrame(left, "k int, at double, n int"), spark.createDataFrame(right, "k int, at double, found int")
    for width, tolerance in ((1, None), (10, None), (1000, None), (3, 5.0)):
        out = joins.as_of_join(a, b, ["k"], "at", "at", ["found"], width, tolerance)
        assert out.columns == ["k", "at", "n", "found"]

        def plain(k, at):
            near = [(t, f) for x, t, f in right if k is not None and at is not None and x == k and t is not None and t <= at]
            best = max(near, default=None)
            return best[1] if best and (tolerance is None or at - best[0] <= tolerance) else None

        assert sorted((r.n, r.found) for r in out.collect()) == [(n, plain(k, at)) for k, at, n in left]
    assert joins.as_of_join(a.limit(0), b, ["k"], "at", "at", ["found"], 1).count() == 0
    assert joins.as_of_join(a, b.limit(0), ["k"], "at", "at", ["found"], 1).filter("found IS NULL").count() == 300


def test_interval_join_by_bins(spark):
    rng = random.Random(4)
    left = [(rng.choice([1, 2, None]), rng.choice([None, *range(100)]), k) for k in range(200)]
    right = [(rng.choice([1, 2, None]), s := rng.choice([None, *range(-20, 120)]), None if rng.random() < 0.2 else (s or 0) + rng.randint(-3, 50), k) for k in range(40)]
    a, b = spark.createDataFrame(left, "k int, at int, n int"), spark.createDataFrame(right, "k int, low int, high int, r int")
    want = sorted((n, r) for k, at, n in left for x, s, e, r in right if k is not None and k == x and at is not None and s is not None and s <= at and (e is None or at < e))
    for width in (1, 7, 500):
        out = joins.interval_join(a, b, ["k"], "at", "low", "high", ["r"], width)
        assert sorted((x.n, x.r) for x in out.collect()) == want
    kept = joins.interval_join(a, b, ["k"], "at", "low", "high", ["r"], 7, how="left")
    assert {x.n for x in kept.collect()} == {n for *_, n in left}
    assert joins.interval_join(a.limit(0), b, ["k"], "at", "low", "high", ["r"], 7).count() == 0


def test_row_sampling_takes_the_least_hashes(spark):
    df = spark.createDataFrame([(k if k % 9 else None, k) for k in range(500)], "k long, v long")
    order = [r.v for r in df.orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k", "v").collect()]
    for n in (0, 1, 20, 55, 56, 57, 300, 499, 500, 800):
        out = rows.row_sampling(df, "k", n)
        assert sorted(r.v for r in out["selected"].collect()) == sorted(order[:n])
        assert sorted(r.v for r in out["unselected"].collect()) == sorted(order[n:])


def test_frames_and_sets_refuse_what_they_do_not_know(spark):
    df = spark.range(3).withColumn("k", F.lit(None).cast("int"))
    assert sorted((r.k, r.n, r.grouping_id) for r in rows.grouping_sets(df, ["k"], [("id", "count_all", "n")], "rollup").collect()) == [(None, 3, 0), (None, 3, 1)]
    with pytest.raises(ValueError):
        rows.grouping_sets(df, ["k"], [("id", "count", "n")], "square")
    with pytest.raises(ValueError):
        rows.framed(df, ["k"], [("id", "asc")], [("id", "count_distinct", "n")])
    with pytest.raises(ValueError):
        rows.framed(df, ["k"], [("id", "asc")], [("id", "sum", "n")], by="groups")
