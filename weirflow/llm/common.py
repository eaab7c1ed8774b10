"""Shared helpers of the training-data operators: written tables in the shared folder, UTF-8 columns, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary folder serves a session of one machine; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/weirflow/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder; the table read back, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Paths of tables written in this process and not deleted yet.
_WRITTEN: set[str] = set()


def tables() -> set[str]:
    """The paths of the tables that there are now."""
    return set(_WRITTEN)


def release(spark: SparkSession, since: set[str] = frozenset(), keep: set[str] = frozenset()) -> int:
    """Delete the tables that operators of this process have written and their results may still read; how many.

    To be called when the results have been stored. Those of ``since``, which were there before, and of ``keep`` stay.
    """
    paths = _WRITTEN - since - keep
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.discard(path)


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text, null counting as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def sha256_hex(text: Column) -> Column:
    return F.sha2(utf8(text), 256)


def connected_components(edges: DataFrame, a: str, b: str, name: str = "cc", max_rounds: int = 50) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns ``node``, ``component``.

    Alternating large-star and small-star rounds: each is a grouped minimum with map-side partials and a join
    that adaptive execution can split where one node is hot. The edges of a round are written to the shared folder.
    It is an error if the last of ``max_rounds`` rounds still changes something.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    current, path = written(both.distinct(), f"{name}-edges")

    def star(e: DataFrame, small: bool) -> tuple[DataFrame, str]:
        """Hang the larger (small star: the smaller) neighbours of each node, and itself, on its smallest neighbour.

        The minima are written, so that both sides of the join are plain shuffles, of which a hot node's can be split.
        """
        if small:
            near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        else:
            near = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, path = written(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        hung = near.join(least.hint("merge"), "u")
        if small:
            out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        else:
            out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out, out_path = written(out.filter("u <> v").distinct(), f"{name}-edges")
        drop_path(spark, path)
        return out, out_path

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = mark(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        half, half_path = star(current, False)
        step, step_path = star(half, True)
        drop_path(spark, half_path)
        after = mark(step)
        drop_path(spark, path)
        current, path = step, step_path
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
