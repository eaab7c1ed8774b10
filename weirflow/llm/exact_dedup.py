"""Exact dedup by distributed most-significant-digit radix partitioning of the texts' bytes.

A text counts as the byte string (its length, then its UTF-8 bytes). Each round splits every open group by the next
digit, a run of successive bytes: rows of a group go on together as long as their digits are equal. A group is
closed when it is a singleton or when its bytes have ended; what ends together is equal, byte for byte, without
any digest. Digits widen eightfold from round to round, so that a text of n bytes takes about log8(n) rounds.

Groups of any size are only ever counted (a grouped aggregate with map-side partials) and joined to their counts (a
join that adaptive execution splits where a group is hot); no task gathers a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import drop_path, sha256_hex, utf8, written

FIRST_DIGIT = 28
WIDEN = 8


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the largest id stays; of repeated rows with that same id
    one stays; a null id is smaller than any other. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        utf8(F.col(text_col)).alias("rest"),
        F.unhex(sha256_hex(F.col(text_col))).alias("sha"),
    ).withColumns({"len": F.octet_length("rest").cast("long"), "rid": F.monotonically_increasing_id()})

    def split(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
        """Give each row the group that the next digit makes; ``rest`` loses the digit.

        Only groups of two or more are written and joined, so the join's large side is the rows alone.
        """
        digit = F.substring("rest", 1, width)
        groups, _ = written(
            rows.groupBy(*keys, digit.alias("digit"))
            .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("top"))
            .filter("n > 1")
            .select(*[F.col(k).alias(f"g_{k}") for k in keys], "digit", "n", "top"),
            "msd-groups",
        )
        same = digit == F.col("digit")
        for k in keys:
            same = same & (F.col(k) == F.col(f"g_{k}"))
        single = F.col("n").isNull()
        # Merged at every size: a broadcast would serve small inputs only.
        return rows.join(groups.hint("merge"), same, "left").select(
            "doc_id",
            "rid",
            "len",
            "sha",
            F.when(single, F.col("rid")).otherwise(F.col("top.rid")).alias("gid"),
            F.when(single, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"),
            F.expr(f"substring(rest, {width + 1})").alias("rest"),
        )

    def close(rows: DataFrame, used: int) -> tuple[DataFrame, DataFrame, str]:
        # What ends in the very first round is only told apart in the second, from row numbers that are written.
        more = (F.col("group_size") > 1) & ((F.col("len") > used) | F.lit(used == FIRST_DIGIT))
        table, path = written(
            rows.withColumn("open", more).withColumn("rest", F.when(more, F.col("rest"))), "msd", ["open"]
        )
        return table.filter("not open"), table.filter("open"), path

    used = width = FIRST_DIGIT
    closed, rows, path = close(split(base, ["len"], width), used)
    done = [closed]
    while rows.select("rid").limit(1).count():
        width *= WIDEN
        used += width
        closed, rows, new_path = close(split(rows, ["gid"], width), used)
        drop_path(spark, f"{path}/open=true")
        path = new_path
        done.append(closed)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("group_size") == 1) | (F.col("rid") == F.col("gid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
