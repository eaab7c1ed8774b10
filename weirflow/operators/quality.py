"""Data quality on DataFrames: profiles, rules, risk, reconciliation, schema drift, record comparison, golden data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: rows, nulls, distinct values, least and greatest as texts, mean text length, shares.

    All columns are aggregated in one pass; distinct values and bounds are those of the values' texts.
    """
    columns = columns or df.columns
    made = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        made += [F.count(text).alias(f"c{k}"), F.countDistinct(text).alias(f"d{k}"), F.min(text).alias(f"a{k}"), F.max(text).alias(f"b{k}"), F.avg(F.length(text)).alias(f"l{k}")]
    kinds = dict(df.dtypes)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.col("n").alias("row_count"),
            (F.col("n") - F.col(f"c{k}")).alias("null_count"), F.col(f"d{k}").alias("distinct_count"),
            F.col(f"a{k}").alias("min_value"), F.col(f"b{k}").alias("max_value"), F.col(f"l{k}").alias("avg_length"),
        ) for k, c in enumerate(columns)
    ])
    some = F.col("row_count") > 0
    return df.agg(*made).select(F.inline(rows)).withColumns({
        "null_percentage": F.when(some, F.round(F.col("null_count") / F.col("row_count") * 100, 2)).otherwise(0.0),
        "cardinality_ratio": F.when(some, F.round(F.col("distinct_count") / F.col("row_count"), 4)).otherwise(0.0),
    })


def rule(df: DataFrame, kind: str, column: str, severity: str = "error", **options) -> DataFrame:
    """One row for a rule: rule, column_name, severity, violations, passed.

    Kinds: not_null; unique; range (low, high); regex (pattern, matched from the start); referential (ref, ref_column);
    custom (condition, a Column). Nulls break not_null alone.
    """
    c = F.col(column)
    if kind == "referential":
        ref = options["ref"].select(F.col(options.get("ref_column", column)).alias("_ref")).filter("_ref IS NOT NULL").distinct()
        count = df.filter(c.isNotNull()).join(ref, c == F.col("_ref"), "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    else:
        broken: Column | None = None
        if kind == "not_null":
            broken = c.isNull()
        elif kind == "range":
            broken = F.lit(False)
            if options.get("low") is not None:
                broken = broken | (c < F.lit(options["low"]))
            if options.get("high") is not None:
                broken = broken | (c > F.lit(options["high"]))
        elif kind == "regex":
            broken = ~c.cast("string").rlike(f"^(?:{options['pattern']})")
        elif kind == "custom":
            broken = ~options["condition"]
        elif kind != "unique":
            raise ValueError(f"unknown rule {kind}")
        made = F.count(c) - F.countDistinct(c) if broken is None else F.count_if(F.coalesce(broken, F.lit(False)))
        count = df.agg(made.alias("violations"))
    return count.select(F.lit(kind).alias("rule"), F.lit(column).alias("column_name"), F.lit(severity).alias("severity"), "violations", (F.col("violations") == 0).alias("passed"))


def risk_score(results: DataFrame) -> DataFrame:
    """Score and level of rule results: the share that passed, less ten a failed error and three a failed warning."""
    failed = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    score = F.when(F.count(F.lit(1)) == 0, 100.0).otherwise(F.count_if("passed") * 100.0 / F.count(F.lit(1)) - 10 * failed("error") - 3 * failed("warning"))
    out = results.agg(F.greatest(F.lit(0.0), F.round(score, 2)).alias("score"))
    return out.withColumn("level", F.when(F.col("score") >= 90, "LOW").when(F.col("score") >= 70, "MEDIUM").when(F.col("score") >= 50, "HIGH").otherwise("CRITICAL"))


def checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows and a checksum that does not depend on their order."""
    own = [F.col(f"`{c}`").cast("string") for c in columns or df.columns]
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.xxhash64(*own).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: counts, whether they and the checksums of common columns match, and columns on one side only."""
    common = sorted(set(source.columns) & set(target.columns))
    a = checksum(source, common).select(F.col("row_count").alias("source_rows"), F.col("checksum").alias("_a"))
    b = checksum(target, common).select(F.col("row_count").alias("target_rows"), F.col("checksum").alias("_b"))
    one = a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one")
    return one.select(
        "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("rows_match"), (F.col("_a") == F.col("_b")).alias("checksum_match"),
        F.lit(",".join(sorted(set(source.columns) - set(target.columns)))).alias("missing_columns"),
        F.lit(",".join(sorted(set(target.columns) - set(source.columns)))).alias("extra_columns"),
    )


DRIFT = "column_name string, kind string, severity string, source string, target string"


def schema_drift(spark, source: T.StructType, target: T.StructType) -> DataFrame:
    a, b = {f.name: f for f in source}, {f.name: f for f in target}
    rows = [(n, "ADDED", "INFO", None, b[n].dataType.simpleString()) for n in b if n not in a]
    rows += [(n, "REMOVED", "ERROR", a[n].dataType.simpleString(), None) for n in a if n not in b]
    for n in a:
        if n not in b:
            continue
        if a[n].dataType != b[n].dataType:
            rows.append((n, "TYPE_CHANGED", "ERROR", a[n].dataType.simpleString(), b[n].dataType.simpleString()))
        if a[n].nullable != b[n].nullable:
            rows.append((n, "NULLABILITY_CHANGED", "WARNING", str(a[n].nullable), str(b[n].nullable)))
        x, y = a[n].metadata.get("length", 0), b[n].metadata.get("length", 0)
        if x > 0 and x != y:
            rows.append((n, "LENGTH_CHANGED", "WARNING", str(x), str(y)))
    return spark.createDataFrame(rows, DRIFT)


def record_hash(columns: list[str]) -> Column:
    """The first 16 digits of the SHA-256 of the columns as JSON, by name; nulls are written."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 16)


def _matched(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """A full join by keys of which a null equals a null; ``a`` has the names, ``b`` has them with an r before."""
    on: Column = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"r{n}"))
    return a.join(b, on, "full")


def _record_hashes(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The keys of either side with the hashes of their records, ``_a`` and ``_b``; of rows with equal keys the largest."""
    columns = columns or [c for c in source.columns if c not in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    number = F.conv(record_hash(columns), 16, 10).cast("decimal(20,0)")  # of fixed width, so that hash aggregates hold it
    side = lambda d, of, n: d.groupBy(*[F.col(k).alias(f"{of}{x}") for k, x in zip(keys, names, strict=True)]).agg(F.max(number).alias(n))
    return _matched(side(source, "", "_a"), side(target, "r", "_b"), names), names


def compare_records(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row: matched, mismatched, missing and extra records, match_rate, passed. Of rows with equal keys the largest counts.

    A null key meets a null key.
    """
    both, _ = _record_hashes(source, target, keys, columns)
    out = both.agg(
        F.count_if(F.col("_a") == F.col("_b")).alias("matched"),
        F.count_if(F.col("_a") != F.col("_b")).alias("mismatched"),
        F.count_if(F.col("_b").isNull()).alias("missing"),
        F.count_if(F.col("_a").isNull()).alias("extra"),
    )
    total = F.col("matched") + F.col("mismatched") + F.col("missing")
    return out.withColumns({"match_rate": F.when(total == 0, 1.0).otherwise(F.round(F.col("matched") / total, 4)), "passed": (F.col("mismatched") == 0) & (F.col("missing") == 0)})


def mismatches(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys that differ, one row each, with what is wrong: mismatched, missing or extra. Nulls and repeats as in ``compare_records``."""
    both, names = _record_hashes(source, target, keys, columns)
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "mismatched")
    own = [F.coalesce(n, f"r{n}").alias(k) for k, n in zip(keys, names, strict=True)]
    return both.select(*own, kind.alias("kind")).filter("kind IS NOT NULL")


def save_golden(df: DataFrame, path: str, name: str, version: str = "1") -> None:
    """Write a golden dataset: its rows as Parquet, its name, version and schema as JSON beside them."""
    df.write.mode("overwrite").parquet(f"{path}/{name}/data")
    meta = json.dumps({"name": name, "version": version, "schema": json.loads(df.schema.json())})
    df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/meta")


def load_golden(spark, path: str, name: str) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/{name}/meta").first()[0])
    return spark.read.schema(T.StructType.fromJson(meta["schema"])).parquet(f"{path}/{name}/data"), meta


def consistency(source: DataFrame, target: DataFrame, keys: list[str], row_tolerance: float = 0.0, numeric_tolerance: float = 1e-4) -> DataFrame:
    """One row: whether row counts agree within a share, columns are the same, and how many values differ.

    Numbers differ by more than the relative tolerance; rows meet by key, over whole tables. Keys are unique; a null meets a null.
    """
    common = [c for c in source.columns if c in target.columns and c not in keys]
    number = {f.name for f in source.schema if isinstance(f.dataType, T.NumericType)}
    names = [f"_k{i}" for i in range(len(keys))]
    a = source.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(c).alias(f"_a_{c}") for c in common], F.lit(1).alias("_in_a"))
    b = target.select(*[F.col(k).alias(f"r{n}") for k, n in zip(keys, names, strict=True)], *[F.col(c).alias(f"_b_{c}") for c in common], F.lit(1).alias("_in_b"))
    differing = F.lit(0)
    for c in common:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        equal = x.eqNullSafe(y)
        if c in number:
            equal = equal | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= numeric_tolerance * F.greatest(F.abs(x.cast("double")), F.lit(1.0)), F.lit(False))
        differing = differing + F.when(equal, 0).otherwise(1)
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    out = _matched(a, b, names).agg(F.count("_in_a").alias("source_rows"), F.count("_in_b").alias("target_rows"), F.coalesce(F.sum(F.when(both, differing)), F.lit(0)).alias("different_values"))
    same = set(source.columns) == set(target.columns)
    return out.withColumns({"rows_ok": F.abs(F.col("source_rows") - F.col("target_rows")) <= row_tolerance * F.col("source_rows"), "columns_ok": F.lit(same)})


def compare_traces(expected: DataFrame, actual: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(kind, name, difference, expected, actual) of two runs' traces, rows of (kind, name, value).

    Kinds: ``task``, which a run has executed or not (missing, extra); ``rows``, how many a table has, which may be off by
    ``tolerance`` of those expected, none expected being no claim; ``status``, which has to be the same (changed).
    """
    a = expected.select("kind", "name", F.col("value").alias("expected"), F.lit(True).alias("_a"))
    b = actual.select("kind", "name", F.col("value").alias("actual"), F.lit(True).alias("_b"))
    both = a.join(b, ["kind", "name"], "full")
    want, got = F.col("expected").cast("double"), F.coalesce(F.col("actual").cast("double"), F.lit(0.0))
    difference = (
        F.when((F.col("kind") == "task") & F.col("_b").isNull(), "missing")
        .when((F.col("kind") == "task") & F.col("_a").isNull(), "extra")
        .when((F.col("kind") == "rows") & (want != 0) & (F.abs(got - want) / want > tolerance), "count")
        .when((F.col("kind") == "status") & ~F.col("expected").eqNullSafe(F.col("actual")), "changed")
    )
    return both.withColumn("difference", difference).filter("difference IS NOT NULL").select("kind", "name", "difference", "expected", "actual")
