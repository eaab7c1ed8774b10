"""Tables that an operator writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder serves a session of one machine, a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weirflow/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back, so that a lost executor costs no more than the step that it was at."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least_bytes: int = 4 << 20) -> DataFrame:
    """The rows of a table in fewer splits than there are cores, dealt to all cores before costly work on each row.

    A file with one row group is read by one task however large it is. Only plain scans are dealt out, and only where they
    have so few splits; large tables have many, and stay as they are.
    """
    run = df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString() or int(str(run.optimizedPlan().stats().sizeInBytes())) < least_bytes:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
