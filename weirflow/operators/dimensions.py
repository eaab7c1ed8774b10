"""Operators that keep tables up to date: slowly changing dimensions, change capture, watermarks, row-wise commands."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(a: str, b: str, keys: list[str]) -> Column:
    """Equal keys, a null being equal to a null: a row whose key is null is met at the next load, not added again."""
    out: Column = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def change_hash(df: DataFrame, columns: list[str], name: str = "change_hash") -> DataFrame:
    """SHA-256 of the columns' texts, joined by ~; nulls count as empty.

    So a value that holds a ~ can hash as another row's two values do, and null as an empty text; targets that keep the hash
    expect it like that. Where this matters compare the columns (``scd2``), not the hash.
    """
    return df.withColumn(name, F.sha2(F.concat_ws("~", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256))


def scd1(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The target with the source's values where keys meet, and the source's new rows."""
    s, t = source.alias("s"), target.alias("t")
    both = s.join(t, _on("s", "t", keys), "full")
    return both.select(*[F.coalesce(f"s.{c}", f"t.{c}").alias(c) for c in [*keys, *columns]])


def scd2(source: DataFrame, target: DataFrame, keys: list[str], tracked: list[str], now: dt.datetime, effective: str = "EffectiveDate", expiration: str = "ExpirationDate", current: str = "IsCurrent") -> DataFrame:
    """The target's history after a load: rows as they are, versions that end now, and versions that begin now.

    A current row ends when a tracked column of its source row differs, nulls being equal to nulls, in keys too. Source keys
    are unique. Rows that are no longer current pass by; the others meet the source in one join, which gives the row that
    was, the version that begins, or both.
    """
    old = target.select(*keys, *tracked, effective, expiration, current)
    live = F.coalesce(F.col(current), F.lit(False))
    mine = old.filter(live).select(F.struct(*old.columns).alias("t"))
    theirs = source.select(F.struct(*keys, *tracked).alias("s"))
    meet: Column = F.lit(True)
    differs: Column = F.lit(False)
    for k in keys:
        meet = meet & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    for c in tracked:
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    both = mine.join(theirs, meet, "full")
    has, comes = F.col("t").isNotNull(), F.col("s").isNotNull()
    ends = has & comes & differs
    kinds = {f.name: f.dataType for f in old.schema}
    row = lambda values: F.struct(*[values[c].cast(kinds[c]).alias(c) for c in old.columns])
    was = {c: F.col(f"t.{c}") for c in old.columns} | {expiration: F.when(ends, F.lit(now)).otherwise(F.col(f"t.{expiration}")), current: ~ends}
    begins = {c: F.col(f"s.{c}") for c in [*keys, *tracked]} | {effective: F.lit(now), expiration: F.lit(None), current: F.lit(True)}
    versions = F.array_compact(F.array(F.when(has, row(was)), F.when(comes & (~has | ends), row(begins))))
    return old.filter(~live).unionByName(both.select(F.explode(versions).alias("v")).select("v.*"))


def latest_change(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key: a grouped maximum, so hot keys are folded before the shuffle."""
    rest = [c for c in changes.columns if c not in keys and c not in order]
    top = changes.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_top.`{c}`").alias(c) for c in changes.columns])


def cdc_apply(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str], operation: str = "__$operation", deleted: str | None = None, tombstones: bool = False) -> DataFrame:
    """The target after each key's last change: inserts and updates put the row, deletes take it (or flag it).

    With ``tombstones`` a delete of an unknown key leaves a flagged row, and all deletes put their own values.
    """
    values = [c for c in target.columns if c not in keys and c != deleted]
    last = latest_change(changes.filter(F.col(f"`{operation}`") != 3), keys, order)
    gone = F.col(f"c.`{operation}`") == 1
    has = F.col(f"c.`{operation}`").isNotNull()
    both = target.withColumn("_there", F.lit(True)).alias("t").join(last.alias("c"), _on("t", "c", keys), "full")
    if not deleted:
        both = both.filter(F.coalesce(~gone, F.lit(True)))
        kept = has
    else:
        if not tombstones:
            both = both.filter(~(F.coalesce(gone, F.lit(False)) & F.col("t._there").isNull()))
        kept = has if tombstones else has & ~gone
    out = [F.coalesce(f"t.{k}", f"c.{k}").alias(k) for k in keys]
    out += [F.when(kept, F.col(f"c.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in values]
    if deleted:
        out.append(F.when(has, gone).otherwise(F.col(f"t.{deleted}")).alias(deleted))
    return both.select(*out).select(*target.columns)


def lsn_range(changes: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Changes after ``low``, up to ``high``."""
    if low is not None:
        changes = changes.filter(F.col(column) > F.lit(low))
    return changes.filter(F.col(column) <= F.lit(high)) if high is not None else changes


def incremental(source: DataFrame, column: str, watermark) -> tuple[DataFrame, DataFrame]:
    """Rows past the watermark, and the next watermark as a row."""
    rows = source.filter(F.col(column) > F.lit(watermark)) if watermark is not None else source
    return rows, rows.agg(F.coalesce(F.max(column), F.lit(watermark)).alias("watermark"))


def unknown_member(dimension: DataFrame, key: str, values: dict) -> DataFrame:
    """The dimension with its unknown member, if it has none."""
    row = dimension.sparkSession.range(1).select(*[F.lit(values.get(c)).cast(dimension.schema[c].dataType).alias(c) for c in dimension.columns])
    return dimension.unionByName(row.join(dimension.select(key), key, "left_anti").select(*dimension.columns))


_UPDATE = re.compile(r"\s*UPDATE\s+([\w.\[\]]+)\s+SET\s+(.+?)\s+WHERE\s+(.+?)\s*;?\s*$", re.I | re.S)
_DELETE = re.compile(r"\s*DELETE\s+(?:FROM\s+)?([\w.\[\]]+)\s+WHERE\s+(.+?)\s*;?\s*$", re.I | re.S)
_BOUND = re.compile(r"\s*\[?(\w+)\]?\s*=\s*\?\s*$")


def oledb_command(target: DataFrame, rows: DataFrame, sql: str, parameters: list[str]) -> DataFrame:
    """The target after ``UPDATE .. SET c = ? WHERE k = ?`` or ``DELETE .. WHERE k = ?`` for each row, as one join.

    ``parameters`` are the rows' columns, in the order of the question marks. Of rows with equal keys the largest wins.
    """

    def bound(text: str, by: str) -> list[str]:
        found = [_BOUND.match(p) for p in re.split(by, text, flags=re.I)]
        if not all(found):
            raise ValueError(f"cannot be run as a set: {text}")
        return [m[1] for m in found]

    if m := _UPDATE.match(sql):
        sets, keys = bound(m[2], ","), bound(m[3], r"\s+AND\s+")
    elif m := _DELETE.match(sql):
        sets, keys = [], bound(m[2], r"\s+AND\s+")
    else:
        raise ValueError(f"only UPDATE and DELETE by key are supported: {sql}")
    names = [*sets, *keys]
    given = rows.select(*[F.col(p).alias(n) for n, p in zip(names, parameters, strict=True)])
    if not sets:
        return target.join(given, keys, "left_anti")
    one = given.groupBy(*keys).agg(F.max(F.struct(*sets)).alias("_set"))
    new = [F.when(F.col("_set").isNotNull(), F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns]
    return target.join(one, keys, "left").select(*new)
