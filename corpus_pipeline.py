"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
documents; all but the last return the columns of documents. Empty tables go through; nulls, repeated rows, ties and long
texts are treated as the operators say, and columns of the documents may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm import exact_dedup, language_id, mixing, near_dedup, packing
from weirflow.llm.common import release, sha256_hex, tables, written


def _whole(docs: DataFrame) -> Column:
    """A document as one value, so that its columns can have any names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or without a likely language go."""
    found = language_id.identify(docs.select(_whole(docs), "text", "lang", "source")).filter("language.kept")
    return found.select("_doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, however long, one document stays: that with the largest id; of rows that repeat it, one."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.select(_whole(docs), sha256_hex(F.col("text")).alias("_own"))
    both = rows.join(kept.hint("merge"), F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi")
    one = Window.partitionBy("_doc.doc_id", "_own").orderBy("_own")  # rows that repeat an id and its text
    return both.withColumn("_row", F.row_number().over(one)).filter("_row = 1").select("_doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows that repeat its id stay with it."""
    kept = near_dedup.near_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(_whole(docs))
    return rows.join(kept.hint("merge"), F.col("_doc.doc_id").eqNullSafe(F.col("_id")), "left_semi").select("_doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.realise(mixing.mix(docs.select(_whole(docs), "doc_id", "text"), labels)).select("_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents' pieces."""
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: Sequential models, components and packing are beyond SQL. Tests hold the exact and near dedup against plain versions, the
#: language and mixing stages against counts and chances, and packing's ids, cuts and places against the documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    before = tables()
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, {path})  # what the stage and the one before it have written
    return STAGES[-1][1](spark, docs, sf_dir)
