"""Named queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import sources
from weirflow.functions import compile_expression
from weirflow.operators import dimensions, joins, quality, rows
from weirflow.operators.rows import RunContext
from weirflow.plans import metadata
from weirflow.plans.control import Runner
from weirflow.plans.flow import levels
from weirflow.plans.model import Component, Constraint, Package, Path_, Task
from weirflow.sources import Registry
from weirflow.sources.shared import new_folder
from weirflow.streaming import append_stream, apply_changes, current, source_kinds, stream_files
from weirflow.types import ddl

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = dt.datetime(2024, 3, 15, 10, 30, 0)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    return new_folder(spark, "q")


def d(c: str, digits: int = 2):
    return F.round(F.col(c).cast("double"), digits).alias(c)


def expressions(df: DataFrame, **made: str) -> DataFrame:
    return df.select(*[compile_expression(e, df.schema, {"User::Rate": 2, "User::Label": "x"}, NOW).alias(n) for n, e in made.items()])


# ---- sources and sinks


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_table_scan(spark, sf):
    r = Registry(spark, tables={"nation": t(spark, sf, "nation")})
    return sources.read_database(r, None, table="[dbo].[nation]").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_name, coalesce(n_regionkey, 0) AS region FROM nation WHERE n_regionkey > 1")
def src_sql_command(spark, sf):
    r = Registry(spark, tables={"nation": t(spark, sf, "nation")})
    return sources.read_database(r, None, "SELECT [n_name], ISNULL(n_regionkey, 0) AS region FROM dbo.nation WHERE n_regionkey > 1")


@query("SELECT p_partkey, p_size FROM part")
def src_csv_roundtrip(spark, sf):
    path = scratch(spark)
    sources.write_flat(t(spark, sf, "part").select("p_partkey", "p_size"), path)
    kinds = {f.name: f.dataType.simpleString() for f in t(spark, sf, "part").schema}
    return sources.read_flat(spark, path, f"p_partkey {kinds['p_partkey']}, p_size {kinds['p_size']}")


@query("SELECT r_regionkey, r_name FROM region")
def src_xml_roundtrip(spark, sf):
    path = scratch(spark)
    kind = dict(t(spark, sf, "region").dtypes)["r_regionkey"]
    t(spark, sf, "region").select("r_regionkey", "r_name").write.format("xml").option("rowTag", "row").save(path)
    return sources.read_xml(spark, path, "row", f"r_regionkey {kind}, r_name string")


@query("SELECT * FROM region")
def src_raw_file(spark, sf):
    return sources.read_raw(spark, f"{sf}/region.parquet")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def sink_append_readback(spark, sf):
    path, df = scratch(spark), t(spark, sf, "nation").select("n_nationkey", "n_name")
    sources.write_table(df, path)
    sources.write_table(df, path)
    return sources.read_raw(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def sink_overwrite_readback(spark, sf):
    path, df = scratch(spark), t(spark, sf, "nation").select("n_nationkey", "n_name")
    sources.write_table(df, path)
    sources.write_table(df, path, "overwrite")
    return sources.read_raw(spark, path)


@query('SELECT n_nationkey AS "N_NationKey", n_name AS "N_Name" FROM nation')
def copy_column_mapping(spark, sf):
    return sources.map_columns(t(spark, sf, "nation").select("n_nationkey", "n_name"), ["N_NationKey", "N_Name"])


@query("""
WITH d AS (SELECT row_number() OVER () AS k, column_name AS c, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS t FROM (DESCRIBE part))
SELECT '{"table": "part", "connectionRef": "dw", "columns": [' || string_agg('{"name": "' || c || '", "dataType": "' || t || '", "length": 0, "precision": 0, "scale": 0}', ', ' ORDER BY k) || ']}' AS manifest,
'CREATE TABLE `part` (' || string_agg('`' || c || '` ' || upper(t), ', ' ORDER BY k) || ') USING parquet' AS ddl_spark,
'CREATE TABLE [part] (' || string_agg('[' || c || '] ' || CASE t WHEN 'string' THEN 'NVARCHAR(MAX)' WHEN 'double' THEN 'FLOAT' ELSE upper(t) END, ', ' ORDER BY k) || ')' AS ddl_sql FROM d""")
def ddl_manifest(spark, sf):
    schema = t(spark, sf, "part").schema
    return spark.createDataFrame([(sources.manifest("part", "dw", schema), ddl("part", schema), ddl("part", schema, "sql"))], "manifest string, ddl_spark string, ddl_sql string")


# ---- derive, filter, route


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4)::DOUBLE AS net, upper(l_returnflag) AS mode FROM lineitem")
def derive_measures(spark, sf):
    df = rows.derived_column(t(spark, sf, "lineitem"), [("net", "ROUND((DT_R8)(l_extendedprice * (1 - l_discount)), 4)"), ("mode", "UPPER(l_returnflag)")])
    return df.select("l_orderkey", "l_linenumber", "net", "mode")


@query("SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def derive_replace_column(spark, sf):
    return rows.derived_column(t(spark, sf, "customer"), [("c_name", "UPPER(c_name)")]).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_size + 1 AS p_size, p_size * 2 AS doubled FROM part")
def derive_from_input_row(spark, sf):
    return rows.derived_column(t(spark, sf, "part"), [("p_size", "p_size + 1"), ("doubled", "p_size * 2")]).select("p_partkey", "p_size", "doubled")


SPLIT = [("big", "o_totalprice > 200000"), ("urgent", 'o_orderpriority == "1-URGENT" || o_totalprice > 100000')]


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 100000 THEN 'urgent' ELSE 'rest' END AS branch FROM orders""")
def split_first_match(spark, sf):
    out = rows.conditional_split(t(spark, sf, "orders"), SPLIT, "rest")
    return rows.union_all([df.select("o_orderkey", F.lit(name).alias("branch")) for name, df in out.items()])


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 200000) AND NOT (o_orderpriority = '1-URGENT' OR o_totalprice > 100000)")
def split_default_branch(spark, sf):
    return rows.conditional_split(t(spark, sf, "orders"), SPLIT, "rest")["rest"].select("o_orderkey")


@query("SELECT p_partkey, coalesce(nullif(p_size, 1) > 25, false) AS large FROM part")
def split_null_condition(spark, sf):
    df = t(spark, sf, "part").withColumn("s", F.nullif("p_size", F.lit(1)))
    out = rows.conditional_split(df, [("large", "s > 25")], "rest")
    return rows.union_all([out["large"].select("p_partkey", F.lit(True).alias("large")), out["rest"].select("p_partkey", F.lit(False).alias("large"))])


@query("SELECT p_partkey, p_size::VARCHAR AS size_text, p_size::BIGINT AS size_long FROM part")
def data_conversion(spark, sf):
    return rows.data_conversion(t(spark, sf, "part"), [("p_size", "size_text", "wstr"), ("p_size", "size_long", "i8")]).select("p_partkey", "size_text", "size_long")


@query("SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, try_cast(o_orderpriority AS INTEGER) AS bad FROM orders")
def data_conversion_try(spark, sf):
    df = t(spark, sf, "orders").withColumn("first", F.left("o_orderpriority", F.lit(1)))
    return rows.data_conversion(df, [("first", "rank", "i4"), ("o_orderpriority", "bad", "i4")], True).select("o_orderkey", "rank", "bad")


@query("SELECT r_regionkey, r_name, r_name AS r_name_copy, r_regionkey AS id FROM region")
def copy_column(spark, sf):
    return rows.copy_column(t(spark, sf, "region"), [("r_name", None), ("r_regionkey", "id")]).select("r_regionkey", "r_name", "r_name_copy", "id")


@query("SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up FROM customer")
def character_map(spark, sf):
    return rows.character_map(t(spark, sf, "customer"), [("c_name", "Lowercase", "low"), ("c_mktsegment", "Uppercase", "up")]).select("c_custkey", "low", "up")


@query("SELECT r_regionkey, 'run-1' AS \"ExecutionInstanceGUID\", 'package' AS \"PackageName\", '2024-03-15 10:30:00' AS \"ExecutionStartTime\" FROM region")
def audit_columns(spark, sf):
    out = rows.audit(t(spark, sf, "region").select("r_regionkey"), None, RunContext(now=NOW, execution_id="run-1"))
    return out.withColumn("ExecutionStartTime", F.date_format("ExecutionStartTime", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT 'a' AS side, count(*) AS n FROM nation UNION ALL SELECT 'b', count(*) FROM nation")
def multicast_fanout(spark, sf):
    out = rows.multicast(t(spark, sf, "nation"), ["a", "b"])
    return rows.union_all([rows.aggregate(df, [], [("n_nationkey", "count_all", "n")]).select(F.lit(k).alias("side"), "n") for k, df in out.items()])


@query("SELECT count(*) AS n FROM orders")
def row_count(spark, sf):
    ctx = RunContext()
    rows.row_count(t(spark, sf, "orders"), "User::n", ctx).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(ctx.counts["User::n"].get["n"],)], "n long")


@query("SELECT o_orderkey, o_custkey FROM orders")
def bdd_repartition(spark, sf):
    return rows.balanced_distributor(t(spark, sf, "orders"), 8).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def cache_transform(spark, sf):
    ref = rows.cache_transform(t(spark, sf, "nation").select("n_nationkey", "n_name"), "nation_cache")
    return joins.lookup(t(spark, sf, "customer"), ref, [("c_nationkey", "n_nationkey")], [("n_name", "n_name")])["match"].select("c_custkey", "n_name")


# ---- lookups and joins


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_left(spark, sf):
    return joins.lookup(t(spark, sf, "orders"), t(spark, sf, "customer"), [("o_custkey", "c_custkey")], [("c_name", "c_name")], unique=True)["match"].select("o_orderkey", "c_name")


MULTI = "SELECT l_partkey, l_suppkey, min(l_quantity) AS q FROM lineitem GROUP BY ALL"


@query(f"SELECT l.l_orderkey, l.l_linenumber, r.q::DOUBLE AS q FROM lineitem l LEFT JOIN ({MULTI}) r USING (l_partkey, l_suppkey)")
def lookup_multi_key(spark, sf):
    df = t(spark, sf, "lineitem")
    ref = df.select("l_partkey", "l_suppkey", F.col("l_quantity").alias("q"))
    out = joins.lookup(df, ref, [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")], [("q", "q")])["match"]
    return out.select("l_orderkey", "l_linenumber", F.col("q").cast("double").alias("q"))


def _customers(spark, sf):
    return t(spark, sf, "customer").filter("c_acctbal > 5000")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def lookup_match_output(spark, sf):
    return joins.lookup(t(spark, sf, "orders"), _customers(spark, sf), [("o_custkey", "c_custkey")], [("c_name", "c_name")], "redirect")["match"].select("o_orderkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def lookup_no_match_output(spark, sf):
    return joins.lookup(t(spark, sf, "orders"), _customers(spark, sf), [("o_custkey", "c_custkey")], [("c_name", "c_name")], "redirect")["no_match"].select("o_orderkey")


@query("SELECT n_nationkey, first FROM nation LEFT JOIN (SELECT c_nationkey, min(c_name) AS first FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def lookup_dedup_first(spark, sf):
    ref = t(spark, sf, "customer").select("c_nationkey", F.col("c_name").alias("first"))
    return joins.lookup(t(spark, sf, "nation"), ref, [("n_nationkey", "c_nationkey")], [("first", "first")])["match"].select("n_nationkey", "first")


@query("SELECT o_orderkey, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_cascading(spark, sf):
    df = joins.lookup(t(spark, sf, "orders"), t(spark, sf, "customer"), [("o_custkey", "c_custkey")], [("c_nationkey", "nation")], unique=True)["match"]
    df = joins.lookup(df, t(spark, sf, "nation"), [("nation", "n_nationkey")], [("n_name", "n_name"), ("n_regionkey", "region")], unique=True)["match"]
    return joins.lookup(df, t(spark, sf, "region"), [("region", "r_regionkey")], [("r_name", "r_name")], unique=True)["match"].select("o_orderkey", "n_name", "r_name")


def _joined(spark, sf, how):
    """The orders' keys are shifted, so that both sides have rows that meet none."""
    right = t(spark, sf, "orders").withColumn("key", F.col("o_custkey") + 10)
    return joins.merge_join(t(spark, sf, "customer"), right, [("c_custkey", "key")], how, [("left", "c_custkey", "c_custkey"), ("right", "o_orderkey", "o_orderkey")])


MERGE = "SELECT c_custkey, o_orderkey FROM customer {how} JOIN orders ON c_custkey = o_custkey + 10"


@query(MERGE.format(how="INNER"))
def merge_join_inner(spark, sf):
    return _joined(spark, sf, "inner")


@query(MERGE.format(how="LEFT"))
def merge_join_left(spark, sf):
    return _joined(spark, sf, "left")


@query(MERGE.format(how="FULL"))
def merge_join_full(spark, sf):
    return _joined(spark, sf, "FullOuter")


FUZZY = """
WITH a AS (SELECT c_custkey, reverse(c_name) AS name FROM customer),
b AS (SELECT DISTINCT reverse(s_name) AS name FROM supplier),
s AS (SELECT c_custkey, b.name AS matched, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS sim
      FROM a JOIN b ON substr(a.name, 1, 1) = substr(b.name, 1, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY sim DESC, matched) AS n FROM s WHERE sim >= 0.4)
SELECT c_custkey, matched, round(sim, 6) AS sim FROM r WHERE n = 1"""


@query(FUZZY)
def fuzzy_lookup_levenshtein(spark, sf):
    a = t(spark, sf, "customer").select("c_custkey", F.reverse("c_name").alias("name"))
    b = t(spark, sf, "supplier").select(F.reverse("s_name").alias("s_name"))
    out = joins.fuzzy_lookup(a, b, "name", "s_name", block=lambda c: F.left(c, F.lit(1)), min_similarity=0.4)
    return out.select("c_custkey", F.col("_match").alias("matched"), F.round("_similarity", 6).alias("sim"))


TERMS = "the|of|de|und|la"


@query(f"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents)
SELECT doc_id, term, count(*) AS frequency FROM w WHERE term IN ('{"','".join(TERMS.split("|"))}') GROUP BY ALL""")
def term_lookup_contains(spark, sf):
    terms = spark.createDataFrame([(x,) for x in TERMS.split("|")], "term string")
    return joins.term_lookup(t(spark, sf, "documents"), terms, "text", "term", "doc_id")


# ---- aggregates


@query("SELECT l_returnflag, round(sum(l_quantity)::DOUBLE, 2) AS l_quantity_sum FROM lineitem GROUP BY 1")
def agg_sum(spark, sf):
    return rows.aggregate(t(spark, sf, "lineitem"), ["l_returnflag"], [("l_quantity", "sum")]).select("l_returnflag", d("l_quantity_sum"))


@query("SELECT l_returnflag, round(avg(l_extendedprice)::DOUBLE, 2) AS l_extendedprice_avg FROM lineitem GROUP BY 1")
def agg_avg(spark, sf):
    return rows.aggregate(t(spark, sf, "lineitem"), ["l_returnflag"], [("l_extendedprice", "avg")]).select("l_returnflag", d("l_extendedprice_avg"))


@query("SELECT o_orderpriority, min(o_totalprice)::DOUBLE AS o_totalprice_min, max(o_totalprice)::DOUBLE AS o_totalprice_max FROM orders GROUP BY 1")
def agg_min_max(spark, sf):
    out = rows.aggregate(t(spark, sf, "orders"), ["o_orderpriority"], [("o_totalprice", "min"), ("o_totalprice", "max")])
    return out.select("o_orderpriority", F.col("o_totalprice_min").cast("double").alias("o_totalprice_min"), F.col("o_totalprice_max").cast("double").alias("o_totalprice_max"))


@query("SELECT event_type, count(nullif(user_id % 3, 0)) AS u_count FROM events GROUP BY 1")
def agg_count(spark, sf):
    df = t(spark, sf, "events").withColumn("u", F.nullif(F.col("user_id") % 3, F.lit(0).cast("long")))
    return rows.aggregate(df, ["event_type"], [("u", "count")])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_count_all(spark, sf):
    return rows.aggregate(t(spark, sf, "events"), ["event_type"], [("user_id", "count_all", "n")])


@query("SELECT event_type, count(DISTINCT user_id) AS user_id_count_distinct FROM events GROUP BY 1")
def agg_count_distinct(spark, sf):
    return rows.aggregate(t(spark, sf, "events"), ["event_type"], [("user_id", "count_distinct")])


@query("SELECT count(*) AS n, max(o_orderkey) AS last FROM orders")
def agg_global(spark, sf):
    return rows.aggregate(t(spark, sf, "orders"), [], [("o_orderkey", "count_all", "n"), ("o_orderkey", "max", "last")])


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS price FROM lineitem GROUP BY ALL")
def agg_multi_key(spark, sf):
    exact = t(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(18,2)"))
    out = rows.aggregate(exact, ["l_returnflag", "l_linestatus", "l_linenumber"], [("l_orderkey", "count_all", "n"), ("l_extendedprice", "sum", "price")])
    return out.select("l_returnflag", "l_linestatus", "l_linenumber", "n", F.col("price").cast("double").alias("price"))


# ---- order, union, reshape


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey")
def sort_multi_key(spark, sf):
    return rows.sort(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), rows.sort_positions({"o_orderpriority": -1, "o_orderkey": 2}))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def sort_dedup(spark, sf):
    return rows.sort(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), [("o_custkey", "asc")], True)


@query("SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf):
    return rows.sort(t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), [("o_totalprice", "desc"), ("o_orderkey", "asc")], limit=10)


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, sf):
    a, b = t(spark, sf, "customer").select("c_custkey", "c_name"), t(spark, sf, "supplier").select("s_suppkey", "s_name")
    return rows.union_all([a, b], [{"c_custkey": "k", "c_name": "name"}, {"s_suppkey": "k", "s_name": "name"}])


@query("SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def union_all_missing_columns(spark, sf):
    return rows.union_all([t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), t(spark, sf, "region").select(F.col("r_name").alias("name"))])


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region ORDER BY name")
def merge_sorted(spark, sf):
    return rows.merge(t(spark, sf, "nation").select(F.col("n_name").alias("name")), t(spark, sf, "region").select(F.col("r_name").alias("name")), [("name", "asc")])


KINDS = ("click", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def pivot_event_type(spark, sf):
    out = rows.pivot(t(spark, sf, "events"), ["user_id"], "event_type", list(KINDS), "event_id", "count")
    return out.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in KINDS])


@query("SELECT p_partkey, 'p_size' AS attribute, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice::DOUBLE FROM part")
def unpivot_measures(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return rows.unpivot(df, ["p_partkey"], ["p_size", "p_retailprice"])


# ---- sampling and text

PERCENT = "('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 100"


@query(f"SELECT c_custkey FROM customer WHERE {PERCENT} < 10")
def pct_sampling_selected(spark, sf):
    return rows.percentage_sampling(t(spark, sf, "customer"), 10, key="c_custkey")["selected"].select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE {PERCENT} >= 10")
def pct_sampling_unselected(spark, sf):
    return rows.percentage_sampling(t(spark, sf, "customer"), 10, key="c_custkey")["unselected"].select("c_custkey")


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 100")
def row_sampling(spark, sf):
    return rows.row_sampling(t(spark, sf, "customer"), "c_custkey", 100)["selected"].select("c_custkey")


@query("SELECT c_custkey FROM customer EXCEPT (SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR), c_custkey LIMIT 100)")
def row_sampling_unselected(spark, sf):
    return rows.row_sampling(t(spark, sf, "customer"), "c_custkey", 100)["unselected"].select("c_custkey")


@query("""
WITH RECURSIVE v AS (SELECT p_name || ' ' || p_brand AS v, count(*) AS n FROM part GROUP BY 1),
e AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON a.v <> b.v AND abs(length(a.v) - length(b.v)) <= 3 AND 1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v)) >= 0.9),
r AS (SELECT v AS a, v AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS v, min(b) AS k FROM r GROUP BY a),
c AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS place FROM g JOIN v USING (v))
SELECT p_partkey, g.k AS group_key, c.v AS canonical FROM part JOIN g ON g.v = p_name || ' ' || p_brand JOIN c ON c.k = g.k AND place = 1""")
def fuzzy_grouping(spark, sf):
    names = t(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    out = joins.fuzzy_grouping(names, "name", 0.9)
    return out.select("p_partkey", F.col("_group_key").alias("group_key"), F.col("_canonical").alias("canonical"))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents)
SELECT term, count(*) AS frequency, count(DISTINCT doc_id) AS documents FROM w WHERE length(term) >= 2 GROUP BY 1 HAVING count(*) >= 2""")
def term_extraction(spark, sf):
    return joins.term_extraction(t(spark, sf, "documents"), "text")


# ---- change tracking


FAR = 1_000_000_000


def _suppliers(spark, sf, key, segment: str):
    """The suppliers as further members, under keys that no customer has."""
    return t(spark, sf, "supplier").select(key.alias("c_custkey"), F.lit(segment).alias("c_mktsegment"), F.col("s_nationkey").alias("c_nationkey"))


def _dimension(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").unionByName(_suppliers(spark, sf, F.col("s_suppkey") + FAR, "GONE"))


def _load(spark, sf):
    changed = F.when(F.col("c_custkey") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))
    return t(spark, sf, "customer").select("c_custkey", changed.alias("c_mktsegment"), "c_nationkey").unionByName(_suppliers(spark, sf, -1 - F.col("s_suppkey"), "FRESH"))


DIM = f"""d AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer UNION ALL SELECT s_suppkey + {FAR}, 'GONE', s_nationkey FROM supplier),
s AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer UNION ALL SELECT -1 - s_suppkey, 'FRESH', s_nationkey FROM supplier)"""


@query(f"WITH {DIM} SELECT c_custkey, coalesce(s.c_mktsegment, d.c_mktsegment) AS c_mktsegment, coalesce(s.c_nationkey, d.c_nationkey) AS c_nationkey FROM s FULL JOIN d USING (c_custkey)")
def scd1_upsert(spark, sf):
    return dimensions.scd1(_load(spark, sf), _dimension(spark, sf), ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query(f"""WITH {DIM},
e AS (SELECT d.*, s.c_custkey IS NOT NULL AND s.c_mktsegment <> d.c_mktsegment AS ends FROM d LEFT JOIN s USING (c_custkey))
SELECT c_custkey, c_mktsegment, '2020-01-01' AS since, CASE WHEN ends THEN '2024-03-15' END AS until, NOT ends AS "IsCurrent" FROM e
UNION ALL SELECT s.c_custkey, s.c_mktsegment, '2024-03-15', NULL, true FROM s LEFT JOIN d USING (c_custkey) WHERE d.c_custkey IS NULL OR d.c_mktsegment <> s.c_mktsegment""")
def scd2_history(spark, sf):
    target = _dimension(spark, sf).select("c_custkey", "c_mktsegment", F.lit(dt.datetime(2020, 1, 1)).alias("EffectiveDate"), F.lit(None).cast("timestamp").alias("ExpirationDate"), F.lit(True).alias("IsCurrent"))
    out = dimensions.scd2(_load(spark, sf), target, ["c_custkey"], ["c_mktsegment"], NOW)
    return out.select("c_custkey", "c_mktsegment", F.date_format("EffectiveDate", "yyyy-MM-dd").alias("since"), F.date_format("ExpirationDate", "yyyy-MM-dd").alias("until"), "IsCurrent")


def _changes(spark, sf):
    """Events as changes of users: the operation from the event's number."""
    op = F.element_at(F.array(F.lit(2), F.lit(4), F.lit(1), F.lit(3)), (F.col("event_id") % 4 + 1).cast("int"))
    return t(spark, sf, "events").select("user_id", F.round("value", 2).alias("value"), "event_type", F.col("event_id").alias("__$start_lsn"), op.alias("__$operation"))


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS kind, count(*) AS n FROM events WHERE event_id % 4 <> 3 GROUP BY 1")
def cdc_split(spark, sf):
    out = rows.cdc_split(_changes(spark, sf))
    return rows.union_all([df.groupBy(F.lit(k).alias("kind")).agg(F.count(F.lit(1)).alias("n")) for k, df in out.items()])


CDC = """
WITH t AS (SELECT DISTINCT user_id + 5 AS user_id, 0.0::DOUBLE AS value, 'old' AS event_type FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 4 <> 3),
l AS (SELECT user_id, round(value, 2) AS value, event_type, event_id % 4 AS op FROM c WHERE n = 1)
SELECT coalesce(t.user_id, l.user_id) AS user_id, CASE WHEN l.op IS NOT NULL THEN l.value ELSE t.value END AS value,
       CASE WHEN l.op IS NOT NULL THEN l.event_type ELSE t.event_type END AS event_type
FROM t FULL JOIN l ON t.user_id = l.user_id WHERE l.op IS DISTINCT FROM 2"""


@query(CDC)
def cdc_apply(spark, sf):
    users = t(spark, sf, "events").select((F.col("user_id") + 5).alias("user_id")).distinct()
    target = users.select("user_id", F.lit(0.0).alias("value"), F.lit("old").alias("event_type"))
    return dimensions.cdc_apply(target, _changes(spark, sf), ["user_id"], ["__$start_lsn"])


@query("SELECT event_id, user_id FROM events WHERE event_id > 5000")
def incremental_watermark(spark, sf):
    return dimensions.incremental(t(spark, sf, "events"), "event_id", 5000)[0].select("event_id", "user_id")


@query("SELECT coalesce(max(event_id), 5000) AS watermark FROM events WHERE event_id > 5000")
def incremental_next_mark(spark, sf):
    return dimensions.incremental(t(spark, sf, "events"), "event_id", 5000)[1]


@query("SELECT c_custkey, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def oledb_command_update(spark, sf):
    target = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return dimensions.oledb_command(target, t(spark, sf, "orders"), "UPDATE dbo.customer SET c_mktsegment = ? WHERE c_custkey = ?", ["o_orderpriority", "o_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def oledb_command_delete(spark, sf):
    target = t(spark, sf, "customer").select("c_custkey")
    return dimensions.oledb_command(target, t(spark, sf, "supplier"), "DELETE FROM customer WHERE c_custkey = ?", ["s_suppkey"])


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, 'Unknown'")
def unknown_member(spark, sf):
    return dimensions.unknown_member(t(spark, sf, "region").select("r_regionkey", "r_name"), "r_regionkey", {"r_regionkey": -1, "r_name": "Unknown"})


@query("SELECT c_custkey, sha256(c_name || '~' || coalesce(c_mktsegment, '')) AS change_hash FROM customer")
def change_hash(spark, sf):
    return dimensions.change_hash(t(spark, sf, "customer"), ["c_name", "c_mktsegment"]).select("c_custkey", "change_hash")


# ---- expressions


@query("SELECT c_custkey AS k, upper(c_name) AS a, lower(c_name) AS b, trim('  ' || c_name || ' ') AS c, ltrim('  ' || c_name) AS l, rtrim(c_name || '  ') AS r, reverse(c_name) AS e, length(c_name)::INTEGER AS n, ascii(c_name) AS o FROM customer")
def expr_string_basic(spark, sf):
    return expressions(t(spark, sf, "customer"), k="c_custkey", a="UPPER(c_name)", b="LOWER(c_name)", c='TRIM("  " + c_name + " ")', l='LTRIM("  " + c_name)', r='RTRIM(c_name + "  ")', e="REVERSE(c_name)", n="LEN(c_name)", o="CODEPOINT(c_name)")


@query("SELECT c_custkey AS k, substr(c_name, 2, 4) AS a, left(c_name, 3) AS b, right(c_name, 4) AS c, right(c_name, 100) AS e FROM customer")
def expr_substring_left_right(spark, sf):
    return expressions(t(spark, sf, "customer"), k="c_custkey", a="SUBSTRING(c_name, 2, 4)", b="LEFT(c_name, 3)", c="RIGHT(c_name, 4)", e="RIGHT(c_name, 100)")


@query("""SELECT c_custkey AS k, replace(c_name, '0', '.') AS a, position('0' IN c_name)::INTEGER AS b, len(string_split(c_name, '0'))::INTEGER AS n,
CASE WHEN length(c_name) - length(replace(c_name, '0', '')) >= 2 THEN length(array_to_string(string_split(c_name, '0')[1:2], '0')) + 1 ELSE 0 END::INTEGER AS second,
string_split(c_name, '0')[2] AS token FROM customer""")
def expr_replace_find_token(spark, sf):
    return expressions(t(spark, sf, "customer"), k="c_custkey", a='REPLACE(c_name, "0", ".")', b='FINDSTRING(c_name, "0", 1)', n='TOKENCOUNT(c_name, "0")', second='FINDSTRING(c_name, "0", 2)', token='TOKEN(c_name, "0", 2)')


@query("SELECT o_orderkey AS k, nullif(o_orderkey % 2, 0) IS NULL AS a, coalesce(nullif(o_orderkey % 2, 0), 9)::BIGINT AS b, NULL::VARCHAR AS c FROM orders")
def expr_null_handling(spark, sf):
    df = t(spark, sf, "orders").withColumn("m", F.nullif(F.col("o_orderkey") % 2, F.lit(0).cast("long")))
    return expressions(df, k="o_orderkey", a="ISNULL(m)", b="REPLACENULL(m, 9)", c="NULL(DT_WSTR, 10)")


@query("SELECT o_orderkey AS k, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, quarter(o_orderdate)::INTEGER AS q, dayofyear(o_orderdate)::INTEGER AS dy, (dayofweek(o_orderdate) + 1)::INTEGER AS dw, hour(o_orderdate)::INTEGER AS h FROM orders")
def expr_date_parts(spark, sf):
    return expressions(t(spark, sf, "orders"), k="o_orderkey", y="YEAR(o_orderdate)", m="MONTH(o_orderdate)", d="DAY(o_orderdate)", q='DATEPART("qq", o_orderdate)', dy='DATEPART("dy", o_orderdate)', dw='DATEPART("dw", o_orderdate)', h='DATEPART("hh", o_orderdate)')


def _as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


@query("SELECT o_orderkey AS k, " + ", ".join(f"strftime(o_orderdate::TIMESTAMP + INTERVAL {n}, '%Y-%m-%d %H:%M:%S') AS {a}" for n, a in (("3 DAY", "d"), ("2 MONTH", "m"), ("1 YEAR", "y"), ("5 HOUR", "h"), ("2 WEEK", "w"))) + " FROM orders")
def expr_dateadd(spark, sf):
    df = expressions(t(spark, sf, "orders"), k="o_orderkey", **{a: f'DATEADD("{p}", {n}, o_orderdate)' for p, n, a in (("day", 3, "d"), ("month", 2, "m"), ("year", 1, "y"), ("hour", 5, "h"), ("week", 2, "w"))})
    return _as_text(df, "d", "m", "y", "h", "w")


@query("SELECT l_orderkey AS k, l_linenumber AS n, " + ", ".join(f"date_diff('{p}', l_shipdate::TIMESTAMP, TIMESTAMP '1998-12-01 00:00:00')::INTEGER AS {p}s" for p in ("day", "month", "quarter", "year", "hour")) + " FROM lineitem")
def expr_datediff(spark, sf):
    return expressions(t(spark, sf, "lineitem"), k="l_orderkey", n="l_linenumber", **{f"{p}s": f'DATEDIFF("{p}", l_shipdate, (DT_DBTIMESTAMP)"1998-12-01 00:00:00")' for p in ("day", "month", "quarter", "year", "hour")})


@query("SELECT p_partkey AS k, abs(-p_size) AS a, floor(p_size / 2.0::DOUBLE)::BIGINT AS f, ceil(p_size / 2.0::DOUBLE)::BIGINT AS c, round(sqrt(p_size), 6) AS s, round(ln(p_size), 6) AS l, round(power(p_size, 2), 3) AS p, sign(p_size - 25)::DOUBLE AS g, (p_size // 4)::INTEGER AS i, p_size % 4 AS m FROM part")
def expr_math(spark, sf):
    return expressions(t(spark, sf, "part"), k="p_partkey", a="ABS(-p_size)", f="FLOOR(p_size / 2.0)", c="CEILING(p_size / 2.0)", s="ROUND(SQRT(p_size), 6)", l="ROUND(LOG(p_size), 6)", p="ROUND(POWER(p_size, 2), 3)", g="SIGN(p_size - 25)", i="(DT_I4)(p_size / 4)", m="p_size % 4")


@query("SELECT p_partkey AS k, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(atan(p_size), 9) AS a, round(atan2(p_size, 2), 9) AS b, round(pi(), 9) AS p FROM part")
def expr_trig(spark, sf):
    return expressions(t(spark, sf, "part"), k="p_partkey", s="ROUND(SIN(p_size), 9)", c="ROUND(COS(p_size), 9)", t="ROUND(TAN(p_size), 6)", a="ROUND(ATAN(p_size), 9)", b="ROUND(ATAN2(p_size, 2), 9)", p="ROUND(PI(), 9)")


@query("SELECT p_partkey AS k, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, ~p_size AS n FROM part")
def expr_bitwise(spark, sf):
    return expressions(t(spark, sf, "part"), k="p_partkey", a="BITAND(p_size, 12)", o="p_size | 3", x="p_size ^ 5", n="~p_size")


@query("SELECT p_partkey AS k, p_size::VARCHAR AS s, p_size::BIGINT AS l, p_size::DOUBLE AS r, left(p_name, 5) AS w, (p_size > 10) AS b FROM part")
def expr_casts(spark, sf):
    return expressions(t(spark, sf, "part"), k="p_partkey", s="(DT_WSTR,10)p_size", l="(DT_I8)p_size", r="(DT_R8)p_size", w="(DT_STR,5,1252)p_name", b="(DT_BOOL)(p_size > 10)")


@query("SELECT p_partkey AS k, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 15 THEN 'middle' ELSE 'small' END AS c FROM part")
def expr_ternary_nested(spark, sf):
    return expressions(t(spark, sf, "part"), k="p_partkey", c='p_size > 30 ? "large" : p_size > 15 ? "middle" : "small"')


@query("SELECT p_partkey AS k, p_name || ' (' || p_size::VARCHAR || ')' AS c FROM part")
def expr_concat(spark, sf):
    return expressions(t(spark, sf, "part"), k="p_partkey", c='p_name + " (" + (DT_WSTR,10)p_size + ")"')


@query("SELECT p_partkey AS k, (p_size > 10 AND p_size < 40) OR NOT (p_size = 7) AS b FROM part")
def expr_boolean(spark, sf):
    return expressions(t(spark, sf, "part"), k="p_partkey", b="(p_size > 10 && p_size < 40) || !(p_size == 7)")


@query("SELECT p_partkey AS k, p_size * 2 AS a, 'x' || p_name AS b FROM part")
def expr_variables(spark, sf):
    return expressions(t(spark, sf, "part"), k="p_partkey", a="p_size * @[User::Rate]", b="@[User::Label] + p_name")


# ---- control flow


def _runner(spark, sf, *names, **variables):
    r = Registry(spark, tables={n: t(spark, sf, n) for n in names}, warehouse=scratch(spark))
    return Runner(r, RunContext({f"User::{k}": v for k, v in variables.items()}, NOW))


def _results(spark, out: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(out, schema)


@query("SELECT r_regionkey AS region, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def foreach_region(spark, sf):
    run, out = _runner(spark, sf, "region", "nation"), []
    run.ctx.variables["User::list"] = t(spark, sf, "region").select("r_regionkey")
    count = Task("count", "execute_sql", sql="SELECT count(*) AS n FROM nation WHERE n_regionkey = ?", parameters=[(0, "User::r")], results=[("n", "User::n")])
    loop = Task("loop", "foreach_loop", properties={"enumerator": "ado", "source": "User::list", "variables": "User::r"}, children=[count])
    class Noting(Runner):
        def one(self, task, allowed):
            state = super().one(task, allowed)
            if task is count:
                out.append((int(self.ctx.variables["User::r"]), int(self.ctx.variables["User::n"])))
            return state

    Noting(run.registry, run.ctx).run(Package("p", tasks=[loop]))
    kind = dict(t(spark, sf, "region").dtypes)["r_regionkey"]
    return _results(spark, out, f"region {kind}, n long")


@query("SELECT count(*) + count(*) FILTER (n_regionkey < 5) AS total, 5 AS i FROM nation")
def for_loop_accumulate(spark, sf):
    """A loop adds up the nations of regions 0 to 4, after all nations."""
    run = _runner(spark, sf, "nation", total=t(spark, sf, "nation").count(), i=0)
    read = Task("read", "execute_sql", sql="SELECT count(*) AS n FROM nation WHERE n_regionkey = ?", parameters=[(0, "User::i")], results=[("n", "User::n")])
    add = Task("add", "expression", expression="@[User::total] = @[User::total] + @[User::n]")
    loop = Task("loop", "for_loop", properties={"InitExpression": "@[User::i] = 0", "EvalExpression": "@[User::i] < 5", "AssignExpression": "@[User::i] = @[User::i] + 1"}, children=[read, add], constraints=[Constraint("read", "add")])
    run.run(Package("p", tasks=[loop]))
    return _results(spark, [(run.ctx.variables["User::total"], run.ctx.variables["User::i"])], "total long, i int")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000 AND o_orderpriority = '1-URGENT'")
def execute_sql_params(spark, sf):
    run = _runner(spark, sf, "orders", low=1000, kind="1-URGENT")
    run.run(Package("p", tasks=[Task("q", "execute_sql", sql="SELECT count(*) AS n FROM orders WHERE o_totalprice > ? AND o_orderpriority = ?", parameters=[(0, "User::low"), (1, "User::kind")], results=[("0", "User::n")])]))
    return _results(spark, [(run.ctx.variables["User::n"],)], "n long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def execute_package_params(spark, sf):
    flow = Task("load", "data_flow", components=[
        Component("src", "source", "src", properties={"SqlCommand": "SELECT n_nationkey, n_name, n_regionkey FROM nation"}, outputs=[{"name": "out", "columns": [], "error": False, "properties": {}}]),
        Component("split", "conditional_split", "split", outputs=[
            {"name": "wanted", "columns": [], "error": False, "properties": {"Expression": "n_regionkey == @[User::region]", "EvaluationOrder": "0"}}, {"name": "rest", "columns": [], "error": False, "properties": {}}]),
        Component("dest", "destination", "dest", properties={"OpenRowset": "picked"}, inputs=[{"name": "in", "properties": {}, "columns": [{"name": "n_nationkey", "properties": {}}, {"name": "n_name", "properties": {}}]}]),
    ], paths=[Path_("src", "out", "split", "in"), Path_("split", "wanted", "dest", "in")])
    run = _runner(spark, sf, "nation", region=2)
    run.packages = {"02_child.dtsx": Package("child", tasks=[flow])}
    run.run(Package("p", tasks=[Task("call", "execute_package", properties={"package": "02_Child.dtsx"})]))
    return run.registry.table("picked")


@query("SELECT v.*, n FROM (VALUES ('bad', 'failed'), ('good', 'skipped'), ('cleanup', 'succeeded'), ('always', 'succeeded'), ('off', 'disabled')) AS v(task, state), (SELECT count(*) AS n FROM nation)")
def precedence_branches(spark, sf):
    run = _runner(spark, sf, "region", x=1)
    ok = "INSERT INTO seen SELECT count(*) FROM nation"
    run.registry.tables |= {"nation": t(spark, sf, "nation"), "seen": spark.createDataFrame([], "n long")}
    tasks = [Task("bad", "execute_sql", sql="EXEC nothing"), Task("good", "execute_sql", sql=ok), Task("cleanup", "execute_sql", sql=ok), Task("always", "execute_sql", sql=ok), Task("off", "execute_sql", disabled=True)]
    states = run.run(Package("p", tasks=tasks, constraints=[Constraint("bad", "good"), Constraint("bad", "cleanup", "failure"), Constraint("bad", "always", "completion", "@[User::x] == 1")]))
    n = run.registry.table("seen").agg(F.max("n")).first()[0]
    return _results(spark, list(states.items()), "task string, state string").withColumn("n", F.lit(n))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount))::DOUBLE, 0) AS net, count(*) AS lines FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 0 AND l_extendedprice * (1 - l_discount) > 0 GROUP BY 1""")
def fact_load(spark, sf):
    """Lines with their order, customer and nation looked up, a measure derived, valid rows split off and summed."""
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    df = joins.lookup(df, t(spark, sf, "orders"), [("l_orderkey", "o_orderkey")], [("o_custkey", "customer")], unique=True)["match"]
    df = joins.lookup(df, t(spark, sf, "customer"), [("customer", "c_custkey")], [("c_nationkey", "nation")], unique=True)["match"]
    df = joins.lookup(df, t(spark, sf, "nation"), [("nation", "n_nationkey")], [("n_name", "n_name")], unique=True)["match"]
    df = rows.derived_column(df, [("net", "l_extendedprice * (1 - l_discount)")])
    valid = rows.conditional_split(df, [("valid", "l_quantity > 0 && net > 0 && !ISNULL(n_name)")], "invalid")["valid"]
    out = rows.aggregate(valid, ["n_name"], [("net", "sum", "net"), ("net", "count_all", "lines")])
    return out.select("n_name", d("net", 0), "lines")


# ---- quality


@query("""SELECT 'c_mktsegment' AS column_name, count(*) AS row_count, count(*) - count(c_mktsegment) AS null_count, count(DISTINCT c_mktsegment) AS distinct_count, min(c_mktsegment) AS min_value, max(c_mktsegment) AS max_value, round(avg(length(c_mktsegment)), 6) AS avg_length, 0.0::DOUBLE AS null_percentage, round(count(DISTINCT c_mktsegment) / count(*), 4) AS cardinality_ratio FROM customer
UNION ALL SELECT 'c_custkey', count(*), count(*) - count(c_custkey), count(DISTINCT c_custkey), min(c_custkey::VARCHAR), max(c_custkey::VARCHAR), round(avg(length(c_custkey::VARCHAR)), 6), 0.0::DOUBLE, round(count(DISTINCT c_custkey) / count(*), 4) FROM customer""")
def dq_profile(spark, sf):
    return quality.profile(t(spark, sf, "customer"), ["c_mktsegment", "c_custkey"]).drop("data_type").withColumn("avg_length", F.round("avg_length", 6))


RULE = "SELECT '{kind}' AS rule, '{column}' AS column_name, 'error' AS severity, {count} AS violations, {count} = 0 AS passed FROM {table}"


@query(RULE.format(kind="not_null", column="c_name", count="count(*) FILTER (c_name IS NULL)", table="customer"))
def dq_not_null(spark, sf):
    return quality.rule(t(spark, sf, "customer"), "not_null", "c_name")


@query(RULE.format(kind="unique", column="o_custkey", count="(count(o_custkey) - count(DISTINCT o_custkey))", table="orders"))
def dq_unique(spark, sf):
    return quality.rule(t(spark, sf, "orders"), "unique", "o_custkey")


@query(RULE.format(kind="range", column="c_acctbal", count="count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000)", table="customer"))
def dq_range(spark, sf):
    return quality.rule(t(spark, sf, "customer"), "range", "c_acctbal", low=0, high=9000)


@query(RULE.format(kind="regex", column="c_name", count="count(*) FILTER (NOT regexp_matches(c_name, '^(?:.*[02468])$'))", table="customer"))
def dq_regex(spark, sf):
    return quality.rule(t(spark, sf, "customer"), "regex", "c_name", pattern=".*[02468]$")


@query(RULE.format(kind="referential", column="o_custkey", count="count(*) FILTER (o_custkey NOT IN (SELECT c_custkey + 10 FROM customer))", table="orders"))
def dq_referential(spark, sf):
    ref = t(spark, sf, "customer").select((F.col("c_custkey") + 10).alias("key"))
    return quality.rule(t(spark, sf, "orders"), "referential", "o_custkey", ref=ref, ref_column="key")


@query(RULE.format(kind="custom", column="o_totalprice", count="count(*) FILTER (NOT (o_totalprice > 1000 OR o_orderstatus = 'F'))", table="orders"))
def dq_custom(spark, sf):
    return quality.rule(t(spark, sf, "orders"), "custom", "o_totalprice", condition=(F.col("o_totalprice") > 1000) | (F.col("o_orderstatus") == "F"))


@query("SELECT 37.0::DOUBLE AS score, 'CRITICAL' AS level")
def dq_risk_score(spark, sf):
    df = t(spark, sf, "customer")
    results = rows.union_all([quality.rule(df, "not_null", "c_custkey"), quality.rule(df, "range", "c_custkey", "error", low=0, high=0), quality.rule(df, "unique", "c_nationkey", "warning"), quality.rule(df, "unique", "c_custkey")])
    return quality.risk_score(results)


@query("""
WITH d AS (SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS kind FROM (DESCRIBE orders))
SELECT column_name, 'REMOVED' AS kind, 'ERROR' AS severity, kind AS source, NULL AS target FROM d WHERE column_name = 'o_orderpriority'
UNION ALL SELECT column_name, 'TYPE_CHANGED', 'ERROR', kind, 'string' FROM d WHERE column_name <> 'o_orderpriority' AND kind <> 'string'
UNION ALL SELECT column_name, 'ADDED', 'INFO', NULL, 'string' FROM (DESCRIBE customer) WHERE column_name <> 'c_custkey'""")
def schema_drift(spark, sf):
    """Orders against themselves as texts, without a column and with those of their customers."""
    orders, customers = t(spark, sf, "orders"), t(spark, sf, "customer")
    texts = lambda df, *left: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns if c not in left])
    other = texts(orders, "o_orderpriority").join(texts(customers), F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey")
    return quality.schema_drift(spark, orders.schema, other.schema)


def _pair(spark, sf):
    """Customers on both sides, some with other names; suppliers in the source alone, nations in the target alone."""
    both = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    renamed = F.when(F.col("c_custkey") % 13 == 0, "other").otherwise(F.col("c_name"))
    missing = t(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("-").alias("c_mktsegment"))
    extra = t(spark, sf, "nation").select((F.col("n_nationkey").cast("long") + FAR).alias("c_custkey"), F.col("n_name").alias("c_name"), F.lit("-").alias("c_mktsegment"))
    return both.unionByName(missing), both.withColumn("c_name", renamed).unionByName(extra)


@query("""SELECT matched, mismatched, missing, extra, round(matched / (matched + mismatched + missing), 4) AS match_rate, false AS passed
FROM (SELECT count(*) FILTER (c_custkey % 13 <> 0) AS matched, count(*) FILTER (c_custkey % 13 = 0) AS mismatched FROM customer),
(SELECT count(*) AS missing FROM supplier), (SELECT count(*) AS extra FROM nation)""")
def record_compare(spark, sf):
    return quality.compare_records(*_pair(spark, sf), ["c_custkey"])


@query(f"SELECT c_custkey, 'mismatched' AS kind FROM customer WHERE c_custkey % 13 = 0 UNION ALL SELECT -1 - s_suppkey, 'missing' FROM supplier UNION ALL SELECT n_nationkey::BIGINT + {FAR}, 'extra' FROM nation")
def record_mismatches(spark, sf):
    return quality.mismatches(*_pair(spark, sf), ["c_custkey"])


@query("SELECT count(*) AS source_rows, count(*) AS target_rows, true AS rows_match, true AS checksum_match, '' AS missing_columns, '' AS extra_columns FROM orders")
def reconcile(spark, sf):
    df = t(spark, sf, "orders")
    return quality.reconcile(df, df.repartition(3))


@query("SELECT count(*) AS matched, 0::BIGINT AS mismatched, 0::BIGINT AS missing, 0::BIGINT AS extra, 1.0::DOUBLE AS match_rate, true AS passed FROM nation")
def golden_compare(spark, sf):
    path, df = scratch(spark), t(spark, sf, "nation")
    quality.save_golden(df, path, "nation")
    return quality.compare_records(df, quality.load_golden(spark, path, "nation")[0], ["n_nationkey"])


@query("""SELECT n + missing AS source_rows, n + extra AS target_rows, different_values, missing = extra AS rows_ok, true AS columns_ok
FROM (SELECT count(*) AS n, count(*) FILTER (c_custkey % 13 = 0) AS different_values FROM customer),
(SELECT count(*) AS missing FROM supplier), (SELECT count(*) AS extra FROM nation)""")
def data_consistency(spark, sf):
    return quality.consistency(*_pair(spark, sf), ["c_custkey"])


# ---- metadata


def _port(name, *columns, **properties):
    return {"name": name, "error": False, "properties": properties, "columns": [{"name": c, "type": "", "sort": 0, "properties": p} for c, p in columns]}


def packages_of(spark, sf) -> list[Package]:
    """A package for each nation: it empties and loads the nation's fact table from its region's orders; each region reports."""
    out = []
    for n in t(spark, sf, "nation").select("n_name", "n_regionkey").orderBy("n_name").collect():
        fact = f"fact_{n.n_name}".lower()
        load = Task("load", "data_flow", components=[
            Component("src", "source", "src", properties={"OpenRowset": f"[dbo].[orders_{n.n_regionkey}]"}, outputs=[_port("out", ("price", {}), ("disc", {}))]),
            Component("calc", "derived_column", "calc", outputs=[_port("out", ("net", {"Expression": "price * (1 - disc)"}))]),
            Component("dest", "destination", "dest", properties={"OpenRowset": fact}, inputs=[_port("in", ("net", {}), ("price", {}))]),
        ], paths=[Path_("src", "out", "calc", "in"), Path_("calc", "out", "dest", "in")])
        report = Task("sum", "execute_sql", sql=f"INSERT INTO totals_{n.n_regionkey} SELECT sum(net) FROM {fact} JOIN dates ON d = k")
        out.append(Package(n.n_name, tasks=[Task("clear", "execute_sql", sql=f"TRUNCATE TABLE dbo.{fact}"), load, report]))
    return out


@query("""
SELECT n_name AS package_name, 'clear' AS task_name, 'dbo.fact_' || lower(n_name) AS table_name, 'writer' AS role FROM nation
UNION ALL SELECT n_name, 'load', 'dbo.orders_' || n_regionkey, 'reader' FROM nation UNION ALL SELECT n_name, 'load', 'fact_' || lower(n_name), 'writer' FROM nation
UNION ALL SELECT n_name, 'sum', 'fact_' || lower(n_name), 'reader' FROM nation UNION ALL SELECT n_name, 'sum', 'dates', 'reader' FROM nation
UNION ALL SELECT n_name, 'sum', 'totals_' || n_regionkey, 'writer' FROM nation""")
def table_lineage(spark, sf):
    return metadata.table_lineage(spark, packages_of(spark, sf))


@query("""
SELECT 'dbo.orders_' || n_regionkey AS source_table, s AS source_column, 'fact_' || lower(n_name) AS target_table, c AS target_column, kind AS transformation
FROM nation, (VALUES ('price', 'price', 'direct'), ('price', 'net', 'derived'), ('disc', 'net', 'derived')) AS v(s, c, kind)""")
def column_lineage(spark, sf):
    return metadata.column_lineage(spark, packages_of(spark, sf))


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (
    SELECT p_partkey AS a, p_partkey // 2 AS b FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 4 = 0 UNION SELECT 0, 5),
r AS (SELECT b FROM e, n WHERE a = n.n - 1 UNION SELECT e.b FROM r JOIN e ON e.a = r.b)
SELECT 't' || b AS table_name, 'c' || b % 5 AS column_name FROM r""")
def column_impact(spark, sf):
    """Columns of tables that are made of each other, in a chain that ends in a cycle: what depends on the last one."""
    part = t(spark, sf, "part").select("p_partkey")
    links = part.select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b")).unionByName(part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 3").alias("b")))
    links = links.unionByName(part.filter("p_partkey = 0").select(F.col("p_partkey").alias("a"), F.lit(5).cast("long").alias("b")))
    name = lambda c: [F.concat(F.lit("t"), F.col(c)), F.concat(F.lit("c"), F.col(c) % 5)]
    edges = links.select(*[x.alias(n) for x, n in zip([*name("a"), *name("b")], ["source_table", "source_column", "target_table", "target_column"], strict=True)])
    last = part.agg(F.max("p_partkey")).first()[0]
    return metadata.column_impact(edges, f"t{last}", f"c{last % 5}").select("table_name", "column_name")


@query("""
SELECT column_name, CASE WHEN regexp_matches(column_name, '(phone|mobile|cell)') THEN 'PII' WHEN regexp_matches(column_name, '(address|street|zip.?code|postal)') THEN 'PII'
       WHEN regexp_matches(column_name, '(credit.?card|card.?number|ccn|salary|income|compensation|wage)') THEN 'FINANCIAL' END AS tag
FROM (SELECT column_name FROM (DESCRIBE customer) UNION ALL SELECT column_name FROM (DESCRIBE supplier) UNION ALL SELECT column_name FROM (DESCRIBE conversations))""")
def pii_classify(spark, sf):
    names = [(c,) for table in ("customer", "supplier", "conversations") for c in t(spark, sf, table).columns]
    return metadata.classify(_results(spark, names, "column_name string"))


def _entries(spark, sf):
    """Parts as catalog entries: brand and size as tags."""
    tags = F.array(F.col("p_brand"), F.concat(F.lit("owner:"), F.col("p_size")))
    tags = F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand")).otherwise(tags)
    return t(spark, sf, "part").select(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("name"), F.col("p_type").alias("kind"), F.concat(F.lit("Sales of "), F.col("p_name")).alias("description"), tags.alias("tags"))


@query("SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_type AS kind FROM part WHERE contains(lower(p_name), 'ring') AND (p_type = 'SMALL' OR contains(lower(p_name), 'small')) AND p_brand = 'Brand#4'")
def catalog_search(spark, sf):
    return metadata.catalog_search(_entries(spark, sf), "RING of sales small", ["Brand#4"]).select("name", "kind")


@query("SELECT kind, count(*) AS entries, count(*) AS packages FROM (SELECT unnest(['package', 'data_flow']) AS kind FROM nation) GROUP BY 1 UNION ALL SELECT 'task', 2 * count(*), count(*) FROM nation UNION ALL SELECT 'component', 3 * count(*), count(*) FROM nation UNION ALL SELECT 'column', 5 * count(*), count(*) FROM nation UNION ALL SELECT 'expression', count(*), count(*) FROM nation UNION ALL SELECT 'table', 5 * count(*), count(*) FROM nation")
def catalog_build(spark, sf):
    return metadata.catalog_summary(metadata.catalog(spark, packages_of(spark, sf)))


@query("SELECT 'dbo.fact_' || lower(n_name) AS name, n_name AS package_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'fact_' || lower(n_name), n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'totals_' || n_regionkey, n_name FROM nation WHERE n_nationkey = 3")
def catalog_browse(spark, sf):
    """The tables that a nation's package writes."""
    one = t(spark, sf, "nation").filter("n_nationkey = 3").first()["n_name"]
    return metadata.browse(metadata.catalog(spark, packages_of(spark, sf)), ["WRITER"], "table", one).select("name", "package_name")


@query("""WITH u AS (SELECT DISTINCT c_nationkey AS p, c_mktsegment AS r FROM customer UNION SELECT s_nationkey, 'supplier' || s_nationkey % 4 FROM supplier)
SELECT 'n' || a.p AS left_name, 'n' || b.p AS right_name, count(*) AS shared FROM u a JOIN u b ON a.r = b.r AND 'n' || a.p < 'n' || b.p GROUP BY 1, 2""")
def dependency_matrix(spark, sf):
    """Nations as packages, the segments of their customers and the groups of their suppliers as what they use."""
    a = t(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("package_name"), F.col("c_mktsegment").alias("resource"))
    b = t(spark, sf, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("package_name"), F.concat(F.lit("supplier"), F.col("s_nationkey") % 4).alias("resource"))
    return metadata.dependency_matrix(a.unionByName(b))


@query("SELECT replace(p_name, ' ', '') AS component, count(DISTINCT p_brand) AS packages FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def shared_flows(spark, sf):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return metadata.shared_flows(t(spark, sf, "part").select(F.col("p_brand").alias("package_name"), name.alias("component")))


@query("""WITH e AS (SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_name, p_partkey FROM part)
SELECT 'prefix' AS rule, 'warning' AS severity, name FROM e WHERE NOT starts_with(name, 'red_') UNION ALL SELECT 'no bolts', 'error', name FROM e WHERE contains(p_name, 'bolt')
UNION ALL SELECT 'owner', 'error', name FROM e WHERE p_partkey % 3 = 0""")
def policy_check(spark, sf):
    rules = [("prefix", "naming", "red_.*", "warning"), ("no bolts", "forbidden", "Sales of .*bolt", "error"), ("owner", "required_tag", "owner:", "error")]
    return metadata.policy_violations(_entries(spark, sf), rules)


@query("""WITH c AS (SELECT 'c' || o_custkey AS package_name, CASE WHEN o_orderkey % 50 = 0 THEN 4 ELSE o_orderkey % 3 + 1 END AS rank FROM orders)
SELECT package_name, count(*) AS tasks, sum([0.5, 2.0, 8.0, 16.0][rank])::DOUBLE AS hours, ['LOW', 'MEDIUM', 'HIGH', 'MANUAL'][max(rank)] AS complexity FROM c GROUP BY 1""")
def effort_estimate(spark, sf):
    """Customers as packages, their orders as tasks."""
    rank = F.when(F.col("o_orderkey") % 50 == 0, 4).otherwise(F.col("o_orderkey") % 3 + 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, metadata.EFFORT_HOURS)), rank)
    return metadata.effort(t(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("package_name"), kind.alias("complexity")))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS b, n_nationkey // 2 AS a FROM nation WHERE n_nationkey > 0),
l AS (SELECT n_nationkey AS k, 0 AS level FROM nation WHERE n_nationkey = 0 UNION ALL SELECT e.b, level + 1 FROM l JOIN e ON e.a = l.k)
SELECT level, n_name AS task FROM l JOIN nation ON n_nationkey = k""")
def parallel_levels(spark, sf):
    """Nations as tasks, each after that of half its number."""
    names = {r.n_nationkey: r.n_name for r in t(spark, sf, "nation").select("n_nationkey", "n_name").collect()}
    out = [(k, n) for k, some in enumerate(levels(list(names.values()), [(names[i // 2], n) for i, n in names.items() if i])) for n in some]
    return _results(spark, out, "level int, task string")


# ---- streaming


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 4 <> 3)
SELECT user_id, round(value, 2) AS value, event_type FROM c WHERE n = 1 AND event_id % 4 <> 2""")
def stream_cdc_apply(spark, sf):
    path = scratch(spark)
    changes = _changes(spark, sf)
    changes.repartition(3).write.parquet(f"{path}/in")
    schema = changes.select("user_id", "value", "event_type").schema
    q = apply_changes(stream_files(spark, f"{path}/in", changes.schema), f"{path}/out", ["user_id"], ["__$start_lsn"], f"{path}/ck", schema)
    q.awaitTermination()
    return current(spark, f"{path}/out", schema)


@query("SELECT event_id, user_id FROM events")
def stream_append(spark, sf):
    path = scratch(spark)
    df = t(spark, sf, "events").select("event_id", "user_id")
    df.repartition(2).write.parquet(f"{path}/in")
    append_stream(stream_files(spark, f"{path}/in", df.schema), f"{path}/out", f"{path}/ck").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'service_bus' WHEN 1 THEN 'kafka' WHEN 2 THEN 'event_hub' WHEN 3 THEN 'service_bus' END AS source_kind,
CASE c_custkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.85 WHEN 2 THEN 0.85 WHEN 3 THEN 0.9 END::DOUBLE AS confidence FROM customer""")
def stream_source_detect(spark, sf):
    """Connections by their strings, and where these tell nothing by their types."""
    forms = F.array(F.lit("Endpoint=sb://x.ServiceBus.windows.net"), F.lit("kafka:9092"), F.lit("EventHub=x"), F.lit("Data Source=a"), F.lit("Data Source=b"))
    rows_ = t(spark, sf, "customer").select("c_custkey", F.concat(F.element_at(forms, (F.col("c_custkey") % 5 + 1).cast("int")), F.lit(";"), F.col("c_name")).alias("text"), F.when(F.col("c_custkey") % 5 == 3, "SERVICEBUS").alias("kind"))
    return source_kinds(rows_, "text", "kind").select("c_custkey", "source_kind", "confidence")


# ---- writes of pass-through SQL, transactions, traces


def _sql(spark, sf, *statements, **tables):
    r = Registry(spark, tables={n: df for n, df in tables.items()}, warehouse=scratch(spark))
    for s in statements:
        r.sql(s)
    return r


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def sql_insert_select(spark, sf):
    nations = t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return _sql(spark, sf, "INSERT INTO [dbo].[nations] (n_name, n_nationkey) SELECT r_name, r_regionkey + 100 FROM region", nations=nations, region=t(spark, sf, "region")).table("nations")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'OWES' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal::DOUBLE END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0")
def sql_update_delete(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return _sql(spark, sf, "UPDATE dbo.customers SET c_mktsegment = 'OWES', c_acctbal = 0 WHERE c_acctbal < 0", "DELETE FROM customers WHERE c_custkey % 7 = 0", customers=df).table("customers")


@query("SELECT count(*) AS n, 'empty' AS kind FROM nation WHERE false UNION ALL SELECT count(*), 'filled' FROM nation")
def sql_truncate_insert(spark, sf):
    r = _sql(spark, sf, "TRUNCATE TABLE dbo.target", target=t(spark, sf, "nation"), nation=t(spark, sf, "nation"))
    empty = r.table("target").agg(F.count("*").alias("n"), F.lit("empty").alias("kind"))
    r.sql("INSERT INTO dbo.target SELECT * FROM nation")
    return empty.unionByName(r.table("target").agg(F.count("*").alias("n"), F.lit("filled").alias("kind")))


@query("""
SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_mktsegment ELSE t.c_mktsegment END AS c_mktsegment
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) t FULL JOIN (SELECT c_custkey, 'new' AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0) s ON s.c_custkey = t.c_custkey
WHERE NOT (t.c_custkey IS NOT NULL AND s.c_custkey IS NOT NULL AND t.c_custkey % 10 = 0)""")
def sql_merge(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    merge = """MERGE INTO dbo.target AS t USING (SELECT c_custkey, 'new' AS c_mktsegment FROM changes WHERE c_custkey % 2 = 0) AS s ON t.c_custkey = s.c_custkey
        WHEN MATCHED AND t.c_custkey % 10 = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET t.c_mktsegment = s.c_mktsegment
        WHEN NOT MATCHED THEN INSERT (c_custkey, c_mktsegment) VALUES (s.c_custkey, s.c_mktsegment);"""
    return _sql(spark, sf, merge, target=df.filter("c_custkey % 3 <> 0"), changes=df).table("target")


@query("SELECT count(*) AS n, 'failed' AS state FROM nation")
def transaction_rollback(spark, sf):
    """A sequence that requires a transaction empties a table, then fails: the table is as before."""
    run = _runner(spark, sf, "nation")
    inside = [Task("empty", "execute_sql", sql="TRUNCATE TABLE nation"), Task("fail", "execute_sql", sql="EXEC dbo.nothing")]
    states = run.tasks([Task("all", "sequence", properties={"TransactionOption": "2"}, children=inside, constraints=[Constraint("empty", "fail")])], None)
    return run.registry.table("nation").agg(F.count("*").alias("n")).withColumn("state", F.lit(states["all"]))


@query("""
WITH a AS (SELECT l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS name, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1)
SELECT 'rows' AS kind, name, 'count' AS difference, a.n::VARCHAR AS expected, b.n::VARCHAR AS actual FROM a LEFT JOIN b USING (name) WHERE abs(coalesce(b.n, 0) - a.n) > 0.1 * a.n
UNION ALL SELECT 'task', r_name, 'missing', '1', NULL FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'task', 'other', 'extra', NULL, '1'""")
def compare_traces(spark, sf):
    lines = t(spark, sf, "lineitem")
    counts = lambda df: df.groupBy(F.lit("rows").alias("kind"), F.col("l_returnflag").alias("name")).agg(F.count("*").cast("string").alias("value"))
    tasks = t(spark, sf, "region").select(F.lit("task").alias("kind"), F.col("r_name").alias("name"), F.lit("1").alias("value"), "r_regionkey")
    wanted = counts(lines).unionByName(tasks.drop("r_regionkey"))
    other = _results(spark, [("task", "other", "1")], "kind string, name string, value string")
    got = counts(lines.filter("l_linenumber < 4")).unionByName(tasks.filter("r_regionkey > 0").drop("r_regionkey")).unionByName(other)
    return quality.compare_traces(wanted, got, 0.1)


# ---- further functions


@query("SELECT p_partkey AS k, round(exp(p_size / 100.0), 9) AS a, round(ln(p_size), 9) AS b, round(log10(p_size), 9) AS c, round(log2(p_size), 9) AS d, round(asin(p_size / 100.0), 9) AS e, round(acos(p_size / 100.0), 9) AS f, p_size::DOUBLE * p_size AS g, p_size | 9 AS h, xor(p_size, 9) AS i FROM part")
def expr_math_more(spark, sf):
    made = {"a": "EXP(p_size / 100.0)", "b": "LN(p_size)", "c": "LOG10(p_size)", "d": "LOG2(p_size)", "e": "ASIN(p_size / 100.0)", "f": "ACOS(p_size / 100.0)", "g": "SQUARE(p_size)", "h": "BITOR(p_size, 9)", "i": "BITXOR(p_size, 9)"}
    out = expressions(t(spark, sf, "part"), k="p_partkey", **made)
    return out.withColumns({c: F.round(c, 9) for c in "abcdef"} | {c: F.col(c).cast("int") for c in "hi"})


@query("SELECT p_partkey AS k, upper(to_hex(p_size)) AS h, p_name || '-' || p_name AS c, '2024-03-15' AS d FROM part")
def expr_hex_concat_now(spark, sf):
    out = expressions(t(spark, sf, "part"), k="p_partkey", h="HEX(p_size)", c='CONCATENATE(p_name, "-", p_name)', d="GETDATE()")
    return out.withColumns({"h": F.upper("h"), "d": F.date_format("d", "yyyy-MM-dd")})


@query("SELECT p_partkey AS k, p_size AS u FROM part")
def expr_random(spark, sf):
    out = expressions(t(spark, sf, "part"), k="p_partkey", u="p_size + RAND()")
    return out.select("k", F.floor("u").cast("int").alias("u"))


@query("SELECT DISTINCT event_id % 4 AS op, min(event_id) OVER (PARTITION BY event_id % 4) AS low FROM events WHERE event_id > 100 AND event_id <= 1000 AND event_id % 4 > 0")
def src_cdc_range(spark, sf):
    """The change table of a table, between two places of its log."""
    rows_ = t(spark, sf, "events").select(F.col("event_id").alias("__$start_lsn"), (F.col("event_id") % 4).alias("op")).filter("op > 0")
    r = Registry(spark, tables={"cdc.dbo_users_ct": rows_})
    return sources.read_cdc(r, None, "dbo.users", low=100, high=1000).groupBy("op").agg(F.min("__$start_lsn").alias("low"))


from weirflow.plans import further  # noqa: E402, F401, I001  (more queries, registered by the import)
