"""Streams of changes: what a batch rewrites, batches that come again, new checkpoints, and registries that read the table."""

import json

import pytest

from weirflow.sources import Registry
from weirflow.sources.log import TableLog
from weirflow.streaming import apply_changes, current, detect_sources, stream_files

KIND = "k int, v string, lsn int, op int"


@pytest.fixture
def feed(spark, tmp_path):
    """Run a stream over all files of changes that have been added so far."""

    class Feed:
        target, source = str(tmp_path / "warehouse"), str(tmp_path / "in")
        schema = spark.createDataFrame([], "k int, v string").schema

        def add(self, rows):
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(self.source)

        def run(self, checkpoint, buckets=8, **more):
            stream = stream_files(spark, self.source, spark.createDataFrame([], KIND).schema)
            q = apply_changes(stream, self.target, ["k"], ["lsn"], str(tmp_path / checkpoint), self.schema, "op", buckets=buckets, **more)
            q.awaitTermination()

        def rows(self):
            return sorted(map(tuple, current(spark, self.target, self.schema).collect()), key=repr)

        def entry(self):
            return TableLog(spark, self.target).read()[1]["current"]

    return Feed()


def test_a_batch_rewrites_its_buckets_only(feed, spark):
    feed.add([(k, "a", k, 2) for k in range(100)] + [(None, "n", 1, 2)])
    feed.run("ck")
    first = feed.entry()["buckets"]
    assert len(first) == 8 and all(first.values()) and len(feed.rows()) == 101
    feed.add([(5, "b", 200, 4), (5, "c", 150, 4)])
    feed.run("ck")
    second = feed.entry()["buckets"]
    assert sum(first[k] != second[k] for k in first) == 1
    assert (5, "b") in feed.rows() and len(feed.rows()) == 101
    feed.add([(None, None, 300, 1), (7, "x", 3, 4), (8, None, 400, 3)])  # a null key goes; a late change and an old image count for nothing
    feed.run("ck")
    assert len(feed.rows()) == 100 and (7, "a") in feed.rows() and (8, "a") in feed.rows()
    assert Registry.open(spark, feed.target).sql("SELECT count(*) AS n FROM current").first()["n"] == 100


def test_a_new_checkpoint_goes_on_from_the_table(feed, spark):
    feed.add([(1, "a", 10, 2), (2, "a", 10, 2)])
    feed.run("one")
    feed.add([(2, "b", 20, 4), (3, "c", 5, 2)])
    feed.run("two")  # reads both files again
    assert feed.rows() == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(len(feed.entry()["batches"]) for _ in "x") == [2]


def test_a_batch_that_comes_again_changes_nothing(feed, spark, tmp_path):
    feed.add([(1, "a", 10, 2)])
    feed.run("ck")
    version = TableLog(spark, feed.target).latest()
    # The stream's own note of the batch is lost: it is run again.
    commits = tmp_path / "ck" / "commits"
    for f in commits.iterdir():
        f.unlink()
    feed.run("ck")
    assert TableLog(spark, feed.target).latest() == version and feed.rows() == [(1, "a")]


def test_marks_of_deleted_rows_go_in_time(feed, spark):
    feed.add([(1, "a", 10, 2), (2, "a", 10, 2), (1, None, 20, 1)])
    feed.run("ck", buckets=1, late=50)
    marks = lambda: spark.read.parquet(*[f for f in feed.entry()["buckets"].values() if f]).filter("_deleted").count()
    assert marks() == 1
    feed.add([(1, "late", 15, 4), (3, "a", 100, 2)])  # behind its deletion
    feed.run("ck", buckets=1, late=50)
    assert feed.rows() == [(2, "a"), (3, "a")] and marks() == 0 and feed.entry()["high"] == 100
    feed.add([(1, "too late", 15, 4), (4, "a", 60, 2)])  # the mark is gone, and so is what it kept away
    feed.run("ck", buckets=1, late=50)
    assert feed.rows() == [(2, "a"), (3, "a"), (4, "a")]


def test_other_tables_of_the_warehouse_stay(feed, spark):
    r = Registry.open(spark, feed.target)
    r.put("dim", spark.range(3))
    feed.add([(1, "a", 10, 2)])
    feed.run("ck")
    again = Registry.open(spark, feed.target)
    again.sql("INSERT INTO dim VALUES (9)")
    assert Registry.open(spark, feed.target).table("dim").count() == 4 and feed.rows() == [(1, "a")]
    assert json.dumps(feed.entry())


def test_no_table_yet(feed, spark):
    assert feed.rows() == []


def test_sources_by_type():
    assert detect_sources([("Data Source=x", "KAFKA"), "a servicebus", ("eventhub", "kafka")], ["Apply cdc"]) == [("kafka", "Data Source=x", 0.85), ("service_bus", "a servicebus", 0.9), ("event_hub", "eventhub", 0.85), ("cdc", "Apply cdc", 0.95)]
