import random

import pytest
from pyspark.sql import functions as F

from weirflow.operators import joins, rows


def test_term_lookup_finds_phrases(spark):
    texts = spark.createDataFrame([(1, "The data base, a Data-Base of the data"), (2, "base data"), (3, "new york city new york"), (4, None)], "id long, text string")
    terms = spark.createDataFrame([("data base",), ("Data",), ("New York City",), ("new york",), (None,)], "term string")
    out = joins.term_lookup(texts, terms, "text", "term", "id")
    assert sorted(map(tuple, out.collect())) == [(1, "Data", 3), (1, "data base", 2), (2, "Data", 1), (3, "New York City", 1), (3, "new york", 2)]
    assert joins.term_lookup(texts, terms.limit(0), "text", "term", "id").count() == 0


def similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_fuzzy_lookup_misses_nothing(spark, least):
    rng = random.Random(5)
    names = ["".join(rng.choice("abc\u00e9\U0001f600d") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    left, right = [*names[:60], "Katherine", "same"], [*names[60:], "Catherine", ""]
    df = spark.createDataFrame([(k % 7, x) for k, x in enumerate([*left, "same", None])], "id long, name string")
    got = joins.fuzzy_lookup(df, spark.createDataFrame([(x,) for x in [*right, None]], "ref string"), "name", "ref", min_similarity=least, top=500)
    want = sorted((x, y, round(s, 9)) for x in [*left, "same"] for y in set(right) if (s := similarity(x, y)) >= least)
    assert sorted((r["name"], r["_match"], round(r["_similarity"], 9)) for r in got.collect()) == want


def test_row_sampling_keeps_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c")], "k long, v string")
    out = rows.row_sampling(df, "k", 2)
    both = [tuple(r) for part in out.values() for r in part.collect()]
    assert out["selected"].count() == 2 and sorted(both, key=repr) == sorted(map(tuple, df.collect()), key=repr)


def best_of_block(left, right, block, least, top):
    out = []
    for x in left:
        scored = sorted((-similarity(x, y), y) for y in set(right) if block(x) == block(y))
        out += [(x, y, round(-s, 9)) for s, y in scored[:top] if -s >= least]
    return sorted(out)


def lookup_in_blocks(spark, left, right, block, least, top):
    df, ref = (spark.createDataFrame([(x,) for x in values], f"{name} string") for values, name in ((left, "name"), (right, "ref")))
    got = joins.fuzzy_lookup(df, ref, "name", "ref", block=block, min_similarity=least, top=top)
    return sorted((r["name"], r["_match"], round(r["_similarity"], 9)) for r in got.collect())


@pytest.mark.parametrize("back", [False, True])
def test_fuzzy_lookup_in_a_block_does_not_try_all_pairs(spark, monkeypatch, back):
    """Names that differ in a few characters of a number find their best without being held against their whole block."""
    tried = []
    whole_block = joins.block_pairs
    monkeypatch.setattr(joins, "block_pairs", lambda a, b: tried.append(a.count()) or whole_block(a, b))
    turn = (lambda x: x) if back else (lambda x: x[::-1])
    left = [turn(f"Customer#{k:09}") for k in range(0, 40000, 97)]
    right = [turn(f"Supplier#{k:09}") for k in range(600)]
    at = (lambda x: x[-1:]) if back else (lambda x: x[:1])
    got = lookup_in_blocks(spark, left, right, lambda c: F.right(c, F.lit(1)) if back else F.left(c, F.lit(1)), 0.4, 1)
    assert not tried and got == best_of_block(left, right, at, 0.4, 1)


@pytest.mark.parametrize(("seed", "least", "top", "letters", "tail"), [(1, 0.4, 1, "ab", "-end"), (2, 0.2, 3, "abc", ""), (3, 0.5, 2, "ab\U0001f600é", "xyxyxy"), (4, 0.9, 1, "abcdefgh", "000#"), (5, 0.1, 1, "a", "aab")])
def test_fuzzy_lookup_in_blocks_misses_nothing(spark, seed, least, top, letters, tail):
    rng = random.Random(seed)

    def word(longest):
        return "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))

    left = sorted({word(7) + rng.choice([tail, tail[::-1], tail[1:], word(4)]) for _ in range(90)} | {"", "lone"})
    right = sorted({word(7) + tail for _ in range(50)} | ({"", word(14)} if seed % 2 else set()))
    got = lookup_in_blocks(spark, left, right, lambda c: F.length(c) % 2, least, top)
    assert got == best_of_block(left, right, lambda x: len(x) % 2, least, top)
    assert lookup_in_blocks(spark, left, [None], lambda c: F.length(c) % 2, least, top) == []
