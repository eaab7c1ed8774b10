"""Change feeds and sessions as streams, and detection of streaming sources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators.dimensions import cdc_apply
from weirflow.sources import stream_rows
from weirflow.sources.log import Conflict, TableLog

# Words of connection strings that give a streaming source away, in the order of the tests, and how sure each is.
SOURCE_WORDS = [("service_bus", "servicebus", 0.9), ("kafka", "kafka", 0.85), ("event_hub", "eventhub", 0.85)]
CDC_CONFIDENCE = 0.95
#: Parts of a table that a batch of changes rewrites one by one.
BUCKETS = 64


def source_kinds(texts: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """``texts`` with ``source_kind`` and ``confidence`` of the streaming source that a connection string tells of.

    A connection's own type, in the column ``kind``, counts as its string does, and after it.
    """
    found: Column = F.lit(None)
    for c in [c for c in (kind, text) if c]:
        for name, word, sure in reversed(SOURCE_WORDS):
            found = F.when(F.contains(F.lower(F.col(c)), F.lit(word)), F.struct(F.lit(name).alias("k"), F.lit(sure).alias("c"))).otherwise(found)
    return texts.withColumn("_found", found).select(*texts.columns, F.col("_found.k").alias("source_kind"), F.col("_found.c").alias("confidence"))


def detect_sources(connections: list[str | tuple[str, str]], task_names: list[str]) -> list[tuple[str, str, float]]:
    """(kind, where it shows, confidence) of the streaming sources that connections and task names tell of.

    A connection is its string, or its string and its type.
    """
    found = []
    for c in connections:
        text, kind = (c, "") if isinstance(c, str) else c
        found += [(name, text, sure) for part in (text, kind) for name, word, sure in SOURCE_WORDS if word in (part or "").lower()][:1]
    return found + [("cdc", name, CDC_CONFIDENCE) for name in task_names if "cdc" in name.lower()]


def readiness(found: list[tuple[str, str, float]]) -> float:
    return round(sum(c for _, _, c in found) / len(found) * 100, 1) if found else 0.0


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_changes(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, schema: T.StructType, operation: str = "__$operation", name: str = "current", buckets: int = BUCKETS, late: float | None = None):
    """Keep a table of current rows up to date with a stream of changes; the started query.

    The table is one of the warehouse ``target``, in ``buckets`` parts by a hash of the keys, of which a batch rewrites those
    that its changes fall into and takes over the others as they are. What a batch has written counts from its commit to the
    warehouse's log on, which also tells which batch of which query it was: a batch that is run again changes nothing, and
    another query, such as one with a new checkpoint, goes on from the table as it is. A deleted row stays as a mark with its
    place in the order: late or repeated changes that do not come after it are ignored. Null keys are keys like others.
    With ``late``, a distance in the first column of the order, changes further behind the largest seen before their batch are
    dropped, and so the marks of rows that were deleted so long ago go when their bucket is rewritten.

    ``current`` reads the newest version, as does a registry that opens the warehouse.
    """
    state = T.StructType([*schema.fields, T.StructField("_deleted", T.BooleanType()), *[T.StructField(f"_at_{c}", stream.schema[c].dataType) for c in order]])

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
        log = TableLog(spark, target)
        version, tables = log.read()
        entry = tables.get(name) or {"buckets": {str(k): None for k in range(buckets)}, "batches": {}}
        if number <= entry["batches"].get(query, -1):
            return
        before, top = entry.get("high"), None
        if late is not None:
            top = batch.agg(F.max(F.col(f"`{order[0]}`").cast("double"))).first()[0]
            top = max((x for x in (before, top) if x is not None), default=None)
            if before is not None:
                batch = batch.filter(F.col(f"`{order[0]}`").cast("double") >= before - late)
        n = len(entry["buckets"])
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(n)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
        folders = [f for k in touched if (f := entry["buckets"][str(k)])]
        old = spark.read.schema(state).parquet(*folders) if folders else spark.createDataFrame([], state)
        seen = old.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*[f"_at_{c}" for c in order]).alias("_seen"))
        match: Column = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        new = batch.join(seen, match, "left").filter(F.col("_seen").isNull() | (F.struct(*[F.col(c).alias(f"_at_{c}") for c in order]) > F.col("_seen")))
        new = new.select(*batch.columns).withColumns({f"_at_{c}": F.col(c) for c in order})
        out = cdc_apply(old.withColumn("_deleted", F.coalesce("_deleted", F.lit(False))), new, keys, order, operation, deleted="_deleted", tombstones=True)
        if top is not None:
            out = out.filter(~(F.col("_deleted") & (F.col(f"_at_{order[0]}").cast("double") < top - late)))
        path = f"{target.rstrip('/')}/{name}/{query}-{number}"
        out.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(path)
        # Only buckets with rows have a folder.
        made = {r[0] for r in spark.read.parquet(path).select("_bucket").distinct().collect()} if touched else set()
        entry["buckets"] |= {str(k): f"{path}/_bucket={k}" if k in made else None for k in touched}
        entry["batches"][query] = number
        entry |= {"high": top} if top is not None else {}
        entry |= {"schema": json.loads(state.json()), "columns": schema.names}
        while True:
            try:
                log.commit(version, tables | {name: entry})
                return
            except Conflict:  # another table has changed meanwhile
                was = tables.get(name)
                version, tables = log.read()
                if tables.get(name) != was:
                    raise

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, schema: T.StructType, name: str = "current", version: int | None = None) -> DataFrame:
    """The current rows of a table of changes, in its newest version or another."""
    entry = TableLog(spark, target).read(version)[1].get(name)
    return spark.createDataFrame([], schema) if entry is None else stream_rows(spark, entry)


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, keys: list[str], at: str, gap: str, late: str, aggregations: dict[str, Column]) -> DataFrame:
    """Rows grouped to sessions, which end when a key has had no row for ``gap``: keys, session_start, session_end, aggregates.

    Rows that come later than ``late`` behind the latest time seen are dropped, and a session is given out once no row can come
    to it any more. Works on tables as on streams.
    """
    window = F.session_window(F.col(at), gap)
    grouped = stream.withWatermark(at, late).groupBy(*keys, window.alias("_w")).agg(*[c.alias(n) for n, c in aggregations.items()])
    return grouped.select(*keys, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *aggregations)


def tumbling(stream: DataFrame, keys: list[str], at: str, width: str, late: str, aggregations: dict[str, Column], slide: str | None = None) -> DataFrame:
    """Aggregates of windows of fixed width, or of sliding ones: keys, window_start, window_end, aggregates."""
    window = F.window(F.col(at), width, slide) if slide else F.window(F.col(at), width)
    grouped = stream.withWatermark(at, late).groupBy(*keys, window.alias("_w")).agg(*[c.alias(n) for n, c in aggregations.items()])
    return grouped.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggregations)
