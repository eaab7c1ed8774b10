"""Row operators: derive, convert, route, sample, reshape, aggregate, order and unite."""

from __future__ import annotations

import datetime as dt
import getpass
import socket
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from weirflow.functions import compile_expression
from weirflow.sources.shared import kept
from weirflow.types import spark_type


@dataclass
class RunContext:
    """What a run knows: variables, the clock and the names that audit columns show."""

    variables: dict[str, object] = field(default_factory=dict)
    now: dt.datetime | None = None
    package_name: str = "package"
    package_id: str = ""
    version_id: str = ""
    task_name: str = "task"
    task_id: str = ""
    execution_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    counts: dict[str, Observation] = field(default_factory=dict)
    transaction: bool = False


def expression(df: DataFrame, text: str, ctx: RunContext | None = None) -> Column:
    ctx = ctx or RunContext()
    return compile_expression(text, df.schema, ctx.variables, ctx.now)


def derived_column(df: DataFrame, columns: list[tuple[str, str | None]], ctx: RunContext | None = None) -> DataFrame:
    """Add or replace columns; every expression sees the row as it came in. No expression means null, no name is skipped."""
    made = {n: expression(df, e, ctx) if e else F.lit(None).cast("string") for n, e in columns if n}
    return df.withColumns(made) if made else df


def conditional_split(df: DataFrame, branches: list[tuple[str, str]], default: str = "default", ctx: RunContext | None = None) -> dict[str, DataFrame]:
    """Send each row to the first branch whose condition holds, or to the default; a null condition does not hold."""
    route: Column | None = None
    for k, (_, condition) in enumerate(branches):
        holds = F.coalesce(expression(df, condition, ctx), F.lit(False))
        route = F.when(holds, k) if route is None else route.when(holds, k)
    route = F.lit(-1) if route is None else route.otherwise(-1)
    out = {name: df.filter(route == k) for k, (name, _) in enumerate(branches)}
    return out | {default: df.filter(route == -1)}


def data_conversion(df: DataFrame, columns: list[tuple[str, str, str]], ignore_failure: bool = False, **sizes: tuple) -> DataFrame:
    """New columns (source, new name, type) by cast; with ``ignore_failure`` what cannot be cast is null."""
    made = {}
    for source, name, kind in columns:
        target = spark_type(kind, *sizes.get(name, ()), cast=True)
        made[name] = F.col(source).try_cast(target) if ignore_failure else F.col(source).cast(target)
    return df.withColumns(made)


def copy_column(df: DataFrame, columns: list[tuple[str, str | None]]) -> DataFrame:
    return df.withColumns({new or f"{source}_copy": F.col(source) for source, new in columns})


# Full-width forms of printable ASCII, and the kana of the two syllabaries, by code point.
WIDE = {chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)} | {" ": "　"}
HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
KATAKANA = "".join(chr(c + 0x60) for c in range(0x3041, 0x3097))


def character_map(df: DataFrame, columns: list[tuple[str, str, str | None]]) -> DataFrame:
    """(source, operation, new name): uppercase, lowercase, fullwidth, halfwidth, hiragana or katakana."""
    narrow, wide = "".join(WIDE), "".join(WIDE.values())

    def mapped(c: Column, operation: str) -> Column:
        op = operation.lower().replace(" ", "").replace("_", "")
        for name, change in (
            ("lower", F.lower),
            ("upper", F.upper),
            ("full", lambda x: F.translate(x, narrow, wide)),
            ("half", lambda x: F.translate(x, wide, narrow)),
            ("hiragana", lambda x: F.translate(x, KATAKANA, HIRAGANA)),
            ("katakana", lambda x: F.translate(x, HIRAGANA, KATAKANA)),
        ):
            if name in op:
                return change(c)
        raise ValueError(f"unknown character operation {operation}")

    return df.withColumns({new or source: mapped(F.col(source), op) for source, op, new in columns})


def audit(df: DataFrame, columns: list[tuple[str, str]] | None = None, ctx: RunContext | None = None) -> DataFrame:
    """System values as columns (name, kind), fixed for the run."""
    ctx = ctx or RunContext()
    values = {
        "ExecutionInstanceGUID": ctx.execution_id, "PackageID": ctx.package_id, "PackageName": ctx.package_name,
        "VersionID": ctx.version_id, "ExecutionStartTime": ctx.now or dt.datetime.now(), "MachineName": socket.gethostname(),
        "UserName": getpass.getuser(), "TaskName": ctx.task_name, "TaskID": ctx.task_id,
    }
    columns = columns or [(n, n) for n in ("ExecutionInstanceGUID", "PackageName", "ExecutionStartTime")]
    return df.withColumns({name: F.lit(values[kind]) for name, kind in columns})


def multicast(df: DataFrame, outputs: list[str]) -> dict[str, DataFrame]:
    return dict.fromkeys(outputs, df)


def row_count(df: DataFrame, variable: str, ctx: RunContext) -> DataFrame:
    """Count the rows as they pass; the variable has the number once a sink has run."""
    ctx.counts[variable] = Observation(variable.replace("::", "_"))
    return df.observe(ctx.counts[variable], F.count(F.lit(1)).alias("n"))


def cdc_split(df: DataFrame, operation: str = "__$operation") -> dict[str, DataFrame]:
    """Changes by kind: 2 inserts, 4 updates (after), 1 deletes; rows from before an update go."""
    op = F.col(f"`{operation}`")
    return {"insert": df.filter(op == 2), "update": df.filter(op == 4), "delete": df.filter(op == 1)}


def balanced_distributor(df: DataFrame, partitions: int = 8) -> DataFrame:
    return df.repartition(partitions)


def cache_transform(df: DataFrame, name: str | None = None) -> DataFrame:
    """Keep the rows for several readers, under a view's name if one is given."""
    out = df.persist()
    if name:
        out.createOrReplaceTempView(name)
    return out


def script_component(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return fn(df)


AGGREGATES: dict[str, Callable[[str], Column]] = {
    "count": F.count,
    "count_all": lambda c: F.count(F.lit(1)),
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count_distinct": F.countDistinct,
}
#: Aggregation codes of package files.
AGGREGATE_CODES = {0: "group_by", 1: "count", 2: "sum", 3: "avg", 4: "min", 5: "max", 7: "count_distinct"}


def aggregate(df: DataFrame, group_by: list[str], aggregations: list[tuple]) -> DataFrame:
    """(column, function[, name]); names default to column_function. Without keys there is one row."""
    made = []
    for column, function, *name in aggregations:
        fn = AGGREGATES.get(function.lower())
        if fn is None:
            raise ValueError(f"unknown aggregation {function}")
        made.append(fn(column).alias(name[0] if name else f"{column}_{function.lower()}"))
    return df.groupBy(*group_by).agg(*made) if group_by else df.agg(*made)


def sort(df: DataFrame, keys: list[tuple[str, str]], eliminate_duplicates: bool = False, limit: int | None = None) -> DataFrame:
    """Order by (column, asc or desc); of rows with equal keys one stays if asked, the first by all columns."""
    if eliminate_duplicates:
        # A grouped minimum, so that a hot key is folded before the shuffle.
        names = [k for k, _ in keys]
        rest = [c for c in df.columns if c not in names]
        one = df.groupBy(*names).agg(F.min(F.struct(*rest)).alias("_top")) if rest else df.distinct()
        df = one.select(*[F.col(f"_top.`{c}`").alias(c) if c in rest else F.col(c) for c in df.columns])
    df = df.orderBy(*[F.col(k).desc() if d.lower().startswith("desc") else F.col(k).asc() for k, d in keys])
    return df.limit(limit) if limit is not None else df


def sort_positions(positions: dict[str, int]) -> list[tuple[str, str]]:
    """Sort keys from signed positions: their size orders the keys, a minus means descending; 0 is no key."""
    keys = sorted((abs(p), c, p) for c, p in positions.items() if p)
    return [(c, "desc" if p < 0 else "asc") for _, c, p in keys]


def union_all(inputs: list[DataFrame], mappings: list[dict[str, str]] | None = None) -> DataFrame:
    """All rows by column name; columns that an input lacks are null. A mapping renames an input's columns first."""
    mappings = mappings or [{}] * len(inputs)
    renamed = [d.withColumnsRenamed(m) for d, m in zip(inputs, mappings, strict=True)]
    out = renamed[0]
    for d in renamed[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def merge(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    return sort(union_all([left, right]), keys)


def pivot(df: DataFrame, keys: list[str], pivot_column: str, values: list, value_column: str, function: str = "first") -> DataFrame:
    """A column for each listed value, so the plan needs no look at the data."""
    fn = {"first": lambda c: F.first(c, ignorenulls=True)}.get(function) or AGGREGATES[function]
    return df.groupBy(*keys).pivot(pivot_column, values).agg(fn(value_column))


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "attribute", value: str = "value", drop_nulls: bool = False) -> DataFrame:
    out = df.unpivot(keys, values, name, value)
    return out.filter(F.col(value).isNotNull()) if drop_nulls else out


def hash_percent(key: str) -> Column:
    """A number from 0 to 99 that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100


def percentage_sampling(df: DataFrame, percent: float = 10, seed: int = 42, key: str | None = None) -> dict[str, DataFrame]:
    """Rows split by chance: by a hash of ``key``, which can be repeated anywhere, or by a seeded number.

    The numbers depend on the order of the rows, so they are drawn once and written to the shared folder; each row is in one
    of the outputs.
    """
    if key:
        chosen = hash_percent(key) < percent
        return {"selected": df.filter(chosen), "unselected": df.filter(~chosen)}
    u = kept(df.withColumn("_u", F.rand(seed)), "sampling")
    return {"selected": u.filter(F.col("_u") < percent / 100).drop("_u"), "unselected": u.filter(F.col("_u") >= percent / 100).drop("_u")}


def row_sampling(df: DataFrame, key: str, rows: int = 1000) -> dict[str, DataFrame]:
    """A fixed number of rows, those with the least hashes of a key, and the rest. Rows may share a key or repeat.

    Rows are counted by the first four digits of the hash; all below the digits at which the number is reached are in, all
    above are out, and only those of these digits are put in order.
    """
    order = F.md5(F.col(f"`{key}`").cast("string").cast("binary"))
    digits = F.coalesce(F.substring(order, 1, 4), F.lit(""))  # a null key comes first, as in an order
    cut, before = None, 0
    for r in df.groupBy(digits.alias("digits")).agg(F.count(F.lit(1)).alias("n")).orderBy("digits").collect():
        if before + r["n"] > rows:
            cut = r["digits"]
            break
        before += r["n"]
    if cut is None:
        return {"selected": df, "unselected": df.limit(0)}
    at = df.filter(digits == cut)
    first = at.withColumn("_h", order).orderBy("_h", f"`{key}`", *[f"`{c}`" for c in df.columns]).limit(rows - before).drop("_h")
    return {"selected": df.filter(digits < cut).unionAll(first), "unselected": df.filter(digits > cut).unionAll(at.exceptAll(first))}


#: What a frame's aggregation can be.
FRAMED: dict[str, Callable[[str], Column]] = AGGREGATES | {"first": F.first, "last": F.last}
del FRAMED["count_distinct"]


def grouping_sets(df: DataFrame, keys: list[str], aggregations: list[tuple], sets: list[list[str]] | str = "cube") -> DataFrame:
    """Aggregates over several sets of keys at once: a list of sets, or all of a ``cube`` or a ``rollup``.

    Keys that a row's set lacks are null; ``grouping_id`` tells them from null values: a bit for each key, 1 where it is lacking.
    """
    made = []
    for column, function, *name in aggregations:
        fn = AGGREGATES.get(function.lower())
        if fn is None:
            raise ValueError(f"unknown aggregation {function}")
        made.append(fn(column).alias(name[0] if name else f"{column}_{function.lower()}"))
    if sets == "cube":
        grouped = df.cube(*keys)
    elif sets == "rollup":
        grouped = df.rollup(*keys)
    elif isinstance(sets, str):
        raise ValueError(f"unknown grouping {sets}")
    else:
        grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(*made, F.grouping_id().alias("grouping_id"))


def framed(df: DataFrame, partition_by: list[str], order_by: list[tuple[str, str]], aggregations: list[tuple], low: int | None = None, high: int | None = 0, by: str = "rows") -> DataFrame:
    """Aggregates over a frame around each row: (column, function, name), from ``low`` to ``high`` rows or values away.

    None is without bound. ``by`` is rows, or range for distances of the only column of the order.
    """
    bound = lambda x, end: end if x is None else x
    window = Window.partitionBy(*partition_by).orderBy(*[F.col(c).desc() if d.lower().startswith("desc") else F.col(c).asc() for c, d in order_by])
    ends = bound(low, Window.unboundedPreceding), bound(high, Window.unboundedFollowing)
    if by not in ("rows", "range"):
        raise ValueError(f"unknown frame {by}")
    window = window.rowsBetween(*ends) if by == "rows" else window.rangeBetween(*ends)
    made = {}
    for column, function, name in aggregations:
        if function.lower() not in FRAMED:
            raise ValueError(f"unknown aggregation {function}")
        made[name] = FRAMED[function.lower()](column).over(window)
    return df.withColumns(made)
