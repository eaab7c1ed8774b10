"""Operators on small rows: nulls, repeated and missing keys, empty inputs, bad casts, edge dates, odd signs in texts."""

import datetime as dt

import pytest

from weirflow.functions import compile_expression
from weirflow.functions.compiler import validate
from weirflow.functions.parser import ExpressionError
from weirflow.operators import dimensions, joins, quality, rows

NOW = dt.datetime(2024, 3, 15, 10, 30)


@pytest.fixture(scope="module")
def orders(spark):
    data = [(1, "a", 10.0), (2, None, None), (None, "b", 5.0), (3, "a.b", 7.5), (3, "a.b", 7.5), (4, "x,'y'\"[z]", -1.0)]
    return spark.createDataFrame(data, "id int, name string, price double")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(1, "one"), (1, "uno"), (3, None), (None, "none"), (9, "nine")], "k int, label string")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lookup_takes_the_first_and_parts_the_rest(orders, names):
    out = joins.lookup(orders, names, [("id", "k")], [("label", "label")], "redirect")
    assert values(out["match"].select("id", "label")) == [(1, "one"), (3, None), (3, None)]
    assert values(out["no_match"].select("id")) == [(2,), (4,), (None,)]
    assert joins.lookup(orders, names.limit(0), [("id", "k")], [("label", "label")])["match"].count() == 6


def test_split_sends_each_row_once(orders):
    out = rows.conditional_split(orders, [("cheap", "price < 6"), ("named", 'name == "a.b" || price < 8')], "rest")
    assert values(out["cheap"].select("id")) == [(4,), (None,)]
    assert values(out["named"].select("id")) == [(3,), (3,)]
    assert values(out["rest"].select("id")) == [(1,), (2,)]


def test_aggregate_counts_nulls_and_nothing(orders):
    out = rows.aggregate(orders, [], [("price", "count"), ("price", "count_all", "n"), ("name", "count_distinct"), ("price", "sum")]).first()
    assert tuple(out) == (5, 6, 4, 29.0)
    assert tuple(rows.aggregate(orders.limit(0), [], [("price", "sum"), ("price", "count")]).first()) == (None, 0)
    with pytest.raises(ValueError):
        rows.aggregate(orders, [], [("price", "median_of")])


def test_sort_without_duplicates(orders):
    out = rows.sort(orders, [("id", "asc")], True).collect()
    assert [r.id for r in out] == [None, 1, 2, 3, 4]
    assert rows.sort(orders.select("id"), [("id", "desc")], True).count() == 5


def test_sampling_parts_keep_repeated_rows(orders):
    out = rows.percentage_sampling(orders, 50, key="name")
    assert out["selected"].count() + out["unselected"].filter("name IS NOT NULL").count() == 5
    out = rows.percentage_sampling(orders, 50, seed=1)
    assert out["selected"].count() + out["unselected"].count() == 6


def test_union_and_unpivot(orders, names):
    out = rows.union_all([orders, names.withColumnRenamed("k", "id")])
    assert out.columns == ["id", "name", "price", "label"] and out.count() == 11
    flat = rows.unpivot(orders.selectExpr("id", "price", "price * 2 AS twice"), ["id"], ["price", "twice"])
    assert flat.count() == 12 and rows.unpivot(orders, ["id", "name"], ["price"], drop_nulls=True).count() == 5


def test_history_ends_and_begins(spark):
    target = spark.createDataFrame([(1, "a", dt.datetime(2020, 1, 1), None, True), (2, None, dt.datetime(2020, 1, 1), None, True), (1, "z", dt.datetime(2019, 1, 1), dt.datetime(2020, 1, 1), False)], "k int, v string, EffectiveDate timestamp, ExpirationDate timestamp, IsCurrent boolean")
    source = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k int, v string")
    out = dimensions.scd2(source, target, ["k"], ["v"], NOW)
    assert values(out.select("k", "v", "IsCurrent")) == [(1, "a", False), (1, "b", True), (1, "z", False), (2, None, True), (3, "c", True)]
    assert dimensions.scd2(source.limit(0), target, ["k"], ["v"], NOW).count() == 3


def test_last_change_wins(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(1, 5, 4, "later"), (1, 4, 1, "x"), (2, 6, 1, "b"), (3, 7, 2, "new"), (3, 8, 3, "old")], "k int, lsn int, `__$operation` int, v string")
    assert values(dimensions.cdc_apply(target, changes, ["k"], ["lsn"])) == [(1, "later"), (3, "new")]
    assert values(dimensions.cdc_apply(target, changes.limit(0), ["k"], ["lsn"])) == [(1, "a"), (2, "b")]


def test_commands_as_joins(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    given = spark.createDataFrame([("x", 1), ("y", 1), ("z", 7)], "new string, id int")
    assert values(dimensions.oledb_command(target, given, "UPDATE t SET v = ? WHERE k = ?", ["new", "id"])) == [(1, "y"), (2, "b"), (None, "n")]
    with pytest.raises(ValueError):
        dimensions.oledb_command(target, given, "UPDATE t SET v = v + ? WHERE k = ?", ["new", "id"])


def test_quality_of_nothing(orders):
    empty = orders.limit(0)
    assert quality.profile(empty).filter("row_count = 0 AND distinct_count = 0").count() == 3
    assert quality.rule(empty, "unique", "id").first().passed
    assert quality.compare_records(empty, empty, ["id"]).first().match_rate == 1.0
    assert quality.rule(orders, "regex", "name", pattern="a").first().violations == 2


@pytest.fixture(scope="module")
def one(spark):
    row = [(7, 2, "a.b.c", None, dt.datetime(2024, 1, 31, 23, 59, 59), 2.5, "12 ", "abc")]
    return spark.createDataFrame(row, "i int, j int, s string, n string, at timestamp_ntz, x double, digits string, bad string")


@pytest.mark.parametrize(("text", "want"), [
    ("i / j", 3), ("i % j", 1), ("-i + 1", -6), ("i / 2.0", 3.5), ("s + \"-\" + (DT_WSTR,5)i", "a.b.c-7"), ("n + \"x\"", None),
    ("REPLACE(s, \".\", \"\")", "abc"), ("TOKEN(s, \".\", 3)", "c"), ("TOKEN(s, \".\", 4)", None), ("TOKENCOUNT(\"\", \".\")", 0), ("FINDSTRING(s, \".\", 2)", 4),
    ("FINDSTRING(s, \".\", 3)", 0), ("RIGHT(s, 99)", "a.b.c"), ("ISNULL(n) ? \"none\" : n", "none"), ("REPLACENULL(n, \"x\")", "x"), ("n == \"x\" ? 1 : 2", 2),
    ("DATEADD(\"month\", 1, at)", dt.datetime(2024, 2, 29, 23, 59, 59)), ("DATEDIFF(\"day\", at, DATEADD(\"ss\", 1, at))", 1), ("DATEDIFF(\"month\", at, DATEADD(\"ss\", 1, at))", 1),
    ("(DT_I4)digits", 12), ("i > 5 && !(j > 5)", True), ("i & 3 | 8", 11), ("ROUND(x, 0)", 3.0), ("UPPER(SUBSTRING(s, 3, 1)) + LOWER(\"Q\")", "Bq"),
])
def test_expressions(one, text, want):
    assert one.select(compile_expression(text, one.schema, {}, NOW).alias("v")).first()["v"] == want


def test_faulty_expressions(one):
    for text in ("NOSUCH(i)", "nothing + 1", "LEN()", "(i", "i +", "DATEADD(\"eon\", 1, at)", "(DT_NONE)i"):
        with pytest.raises(ExpressionError):
            compile_expression(text, one.schema)
    assert [d.severity for d in validate("NOSUCH(1)")] == ["warning"] and [d.severity for d in validate("(1")] == ["error"] and [d.severity for d in validate(" ")] == ["warning"]
    assert validate("UPPER(a) + (DT_WSTR,3)b") == []


def test_scd2_with_null_keys(spark):
    """A null key is a key like others: loads that bring nothing new change nothing."""
    import datetime as dt

    now = dt.datetime(2024, 1, 2)
    target = spark.createDataFrame([(1, "a", None, None, True), (None, "b", None, None, True), (1, "old", None, now, False)], "k int, v string, EffectiveDate timestamp, ExpirationDate timestamp, IsCurrent boolean")
    same = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    assert sorted(map(str, dimensions.scd2(same, target, ["k"], ["v"], now).collect())) == sorted(map(str, target.collect()))
    other = dimensions.scd2(spark.createDataFrame([(None, "c"), (2, None)], "k int, v string"), target, ["k"], ["v"], now)
    assert sorted((str(r.k), str(r.v), r.IsCurrent) for r in other.collect()) == [("1", "a", True), ("1", "old", False), ("2", "None", True), ("None", "b", False), ("None", "c", True)]


def test_seeded_sampling_parts_the_rows(spark):
    df = spark.range(2000).repartition(7)
    out = rows.percentage_sampling(df, 30, 1)
    a, b = ({r.id for r in out[k].collect()} for k in ("selected", "unselected"))
    assert not a & b and len(a | b) == 2000 and 450 < len(a) < 750


def test_first_by_key_counts_nulls_first(spark):
    ref = spark.createDataFrame([(1, 5), (1, None), (2, 7), (2, 6), (3, None)], "k int, v int")
    assert sorted(map(tuple, joins.first_by_key(ref, ["k"]).collect())) == [(1, None), (2, 6), (3, None)]
