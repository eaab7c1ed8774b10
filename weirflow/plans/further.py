"""More named queries: statements of pass-through SQL, joins by similarity and by time, windows, streams of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirflow.operators import dimensions, joins, quality, rows
from weirflow.operators.rows import RunContext
from weirflow.plans.control import Runner, register_task
from weirflow.plans.flow import register_script, register_script_source, run_flow
from weirflow.plans.model import Component, Constraint, Package, Path_, Task, load_package
from weirflow.plans.queries import NOW, query, scratch, t
from weirflow.sources import Registry, read_flat, read_raw
from weirflow.streaming import sessions, stream_files, tumbling


def _registry(spark, **tables) -> Registry:
    return Registry(spark, tables=dict(tables), warehouse=scratch(spark))


def _customers(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))


# ---- statements


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 3 THEN 'where = set' ELSE c_mktsegment END AS c_mktsegment,
round(CASE WHEN c_custkey % 7 = 3 THEN c_acctbal::DOUBLE + 10.5 ELSE c_acctbal::DOUBLE END, 6) AS c_acctbal FROM customer WHERE c_custkey % 11 <> 2""")
def sql_update_params(spark, sf):
    """Parameters in SET and WHERE, in the order in which they stand; a text that holds keywords."""
    r = _registry(spark, customers=_customers(spark, sf))
    r.sql("UPDATE [dbo].[customers] SET c_mktsegment = ?, c_acctbal = c_acctbal + ? WHERE c_custkey % ? = ? -- set ? where", ["where = set", 10.5, 7, 3])
    r.sql("DELETE customers WHERE c_custkey % ? = ?", [11, 2])
    return r.table("customers").withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("""WITH o AS (SELECT o_custkey, max(o_orderpriority) AS top, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN o.n > 8 AND c_acctbal > 0 THEN top ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN o.n > 8 AND c_acctbal > 0 THEN (SELECT count(*) FROM nation)::DOUBLE ELSE c_acctbal::DOUBLE END AS c_acctbal
FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_acctbal < 0)""")
def sql_update_from(spark, sf):
    """UPDATE with a join, whose target rows are met by many source rows, and DELETE with one."""
    r = _registry(spark, customers=_customers(spark, sf), orders=t(spark, sf, "orders"), nation=t(spark, sf, "nation"), **{"stg.supplier": t(spark, sf, "supplier")})
    r.sql("""UPDATE c SET c.c_mktsegment = o.top, c_acctbal = o.nations
        FROM dbo.customers AS c INNER JOIN (SELECT o_custkey, o_orderkey, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS top, count(*) OVER (PARTITION BY o_custkey) AS n,
            (SELECT count(*) FROM nation) AS nations FROM orders WITH (NOLOCK)) o ON o.o_custkey = c.c_custkey WHERE o.n > 8 AND c.c_acctbal > 0""")
    r.sql("DELETE c FROM customers c JOIN stg.supplier s ON s.s_suppkey = c.c_custkey WHERE s.s_acctbal < 0")
    return r.table("customers")


@query("""
SELECT coalesce(t.k, s.k) AS c_custkey, CASE WHEN s.k IS NOT NULL THEN 'new' WHEN t.k % 5 = 1 THEN 'gone' ELSE t.m END AS c_mktsegment
FROM (SELECT c_custkey AS k, c_mktsegment AS m FROM customer WHERE c_custkey % 3 <> 0) t FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) s ON s.k = t.k
WHERE NOT (t.k IS NOT NULL AND s.k IS NOT NULL AND t.k % 10 = 0) AND NOT (t.k IS NOT NULL AND s.k IS NULL AND t.k % 5 = 0)""")
def sql_merge_by_source(spark, sf):
    df = _customers(spark, sf).drop("c_acctbal")
    r = _registry(spark, target=df.filter("c_custkey % 3 <> 0"), changes=df)
    r.sql("""MERGE INTO dbo.target WITH (HOLDLOCK) AS t USING (SELECT c_custkey FROM changes WHERE c_custkey % 2 = 0) AS s ON t.c_custkey = s.c_custkey
        WHEN MATCHED AND t.c_custkey % 10 = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET t.c_mktsegment = ?
        WHEN NOT MATCHED BY TARGET THEN INSERT (c_custkey, c_mktsegment) VALUES (s.c_custkey, ?)
        WHEN NOT MATCHED BY SOURCE AND t.c_custkey % 5 = 0 THEN DELETE WHEN NOT MATCHED BY SOURCE AND t.c_custkey % 5 = 1 THEN UPDATE SET c_mktsegment = 'gone';""", ["new", "new"])
    return r.table("target")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey > (SELECT avg(n_nationkey) FROM nation) UNION ALL SELECT -1, 'Unknown' UNION ALL SELECT max(n_nationkey) + 1, 'next' FROM nation")
def sql_batch(spark, sf):
    """A script: tables are emptied and filled, a variable is read, a branch is taken, and an identity is asked for."""
    nation = t(spark, sf, "nation").select("n_nationkey", "n_name")
    empty = spark.createDataFrame([(5, "old")], "id int, name string")
    r = _registry(spark, nation=nation, dim=empty, other=empty, log=spark.createDataFrame([], "at int, number long"))
    r.identities["log"] = "number"
    result = r.sql("""TRUNCATE TABLE dbo.dim; TRUNCATE TABLE dbo.other;
        DECLARE @low float, @top int = 0; SELECT @low = avg(n_nationkey), @top = max(n_nationkey) FROM nation;
        SET @top = @top + 1;
        INSERT INTO dim (name, id) SELECT n_name, n_nationkey FROM nation WHERE n_nationkey > @low;
        IF NOT EXISTS (SELECT 1 FROM dbo.dim WHERE id = -1) INSERT INTO dbo.dim (id, name) VALUES (-1, 'Unknown') ELSE DELETE FROM dim;
        IF EXISTS (SELECT 1 FROM dim WHERE id = -1) BEGIN INSERT INTO log (at) VALUES (@top); INSERT INTO dim VALUES (@top, 'next'); END;
        UPDATE STATISTICS dbo.dim WITH FULLSCAN;
        SELECT SCOPE_IDENTITY() AS last""")
    if result.first()["last"] != 1 or r.table("other").count():
        raise AssertionError("the script's log has no first number")
    return r.table("dim")


@query("SELECT r_regionkey AS region, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3) GROUP BY 1 UNION ALL SELECT -1, count(*) FROM nation")
def sql_exec(spark, sf):
    """EXEC calls registered procedures: with arguments by name and by place, an output parameter, and rows to insert."""
    r = _registry(spark, nation=t(spark, sf, "nation"), region=t(spark, sf, "region"), out=spark.createDataFrame([], "region int, n long"))

    def load(registry, regionid):
        registry.sql("INSERT INTO out SELECT ?, count(*) FROM nation WHERE n_regionkey = ?", [regionid, regionid])

    r.register_procedure("dbo.sp_LoadRegion", load)
    r.register_procedure("dbo.sp_Count", lambda registry, table: {"n": registry.table(table).count()})
    r.register_procedure("all_rows", lambda registry, n: registry.spark.range(1).select(F.lit(-1).alias("region"), F.lit(n).alias("n")))
    r.sql("EXEC dbo.sp_LoadRegion @RegionID = ?; EXECUTE [dbo].[sp_LoadRegion] 3", [1])
    r.sql("DECLARE @n bigint; EXEC sp_Count 'nation', @n OUTPUT; INSERT INTO out EXEC all_rows @n")
    return r.table("out")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def sql_warehouse_versions(spark, sf):
    """A warehouse with a log: inserts add files, a failed script leaves no trace, and a new session sees what was committed."""
    folder = scratch(spark)
    r = Registry.open(spark, folder)
    r.put("nations", t(spark, sf, "nation").select("n_nationkey", "n_name"))
    r.tables["region"] = t(spark, sf, "region")
    r.sql("INSERT INTO nations SELECT r_regionkey + 100, r_name FROM region")
    try:
        r.sql("DELETE FROM nations; INSERT INTO nations SELECT no_such_column FROM region")
    except Exception:  # the script is wrong on purpose
        return Registry.open(spark, folder).table("nations")
    raise AssertionError("a wrong statement was run")


# ---- sources


@query("SELECT o_orderkey, o_orderkey * o_orderkey AS square FROM orders")
def src_script_rows(spark, sf):
    """A script source of as many rows as there are orders, read by several tasks in a data flow."""
    n, parts = t(spark, sf, "orders").agg(F.max("o_orderkey") + 1).first()[0], 5
    register_script_source("squares", "k long, square long", lambda: [(n * i // parts, n * (i + 1) // parts) for i in range(parts)], lambda part: ((k, k * k) for k in range(*part)))
    flow = Task("load", "data_flow", components=[
        Component("squares", "script", "src", outputs=[{"name": "out", "columns": [], "error": False, "properties": {}}]),
        Component("dest", "destination", "dest", properties={"OpenRowset": "squares"}, inputs=[{"name": "in", "properties": {}, "columns": []}]),
    ], paths=[Path_("src", "out", "dest", "in")])
    r = _registry(spark)
    run_flow(flow, RunContext({}, NOW), r)
    return t(spark, sf, "orders").select("o_orderkey").join(r.table("squares"), F.col("o_orderkey") == F.col("k")).select("o_orderkey", "square")


@query("SELECT r_regionkey AS region, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 100 + count(*), count(*) FROM nation")
def foreach_tables(spark, sf):
    """A loop over the tables of a server that counts the rows of each, each region's nations being a table."""
    nation, region = t(spark, sf, "nation"), t(spark, sf, "region")
    some = {f"nations_{k.r_regionkey}": nation.filter(F.col("n_regionkey") == k.r_regionkey) for k in region.collect()}
    r = Registry(spark, tables=some | {"all_nations": nation}, warehouse=scratch(spark))
    counts = []

    def count(task, ctx, registry):
        name = ctx.variables["User::table"]
        n = registry.table(name).count()
        counts.append((int(name.removeprefix("nations_")) if name != "all_nations" else 100 + n, n))

    register_task("count_rows", count)
    loop = Task("loop", "foreach_loop", properties={"enumerator": "smo", "variables": "User::table"}, children=[Task("count", "count_rows")])
    Runner(r, RunContext({}, NOW)).run(Package("p", tasks=[loop]))
    return spark.createDataFrame(counts, "region int, n long")


# ---- similarity


@query("""
WITH a AS (SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part), b AS (SELECT DISTINCT replace(p_name, 'i', 'y') || p_brand AS name FROM part WHERE p_partkey % 3 = 0),
s AS (SELECT x.name, b.name AS matched, 1 - levenshtein(x.name, b.name) / greatest(length(x.name), length(b.name)) AS sim FROM (SELECT DISTINCT name FROM a) x, b),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sim DESC, matched) AS n FROM s WHERE sim >= 0.75)
SELECT p_partkey, matched, round(sim, 6) AS sim FROM a JOIN r USING (name) WHERE n = 1""")
def fuzzy_lookup_segments(spark, sf):
    """Every part's name held against all misspelt ones, without a block."""
    part = t(spark, sf, "part")
    a = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    b = part.filter("p_partkey % 3 = 0").select(F.concat(F.replace("p_name", F.lit("i"), F.lit("y")), "p_brand").alias("ref"))
    out = joins.fuzzy_lookup(a, b, "name", "ref", min_similarity=0.75)
    return out.select("p_partkey", F.col("_match").alias("matched"), F.round("_similarity", 6).alias("sim"))


# ---- joins by time


@query("""
WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_id % 3 = 0), p AS (SELECT user_id, ts, max(event_id) AS seen, max({'id': event_id, 't': event_type}).t AS kind FROM events WHERE event_id % 3 = 1 GROUP BY 1, 2)
SELECT e.event_id, p.seen, p.kind FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_events(spark, sf):
    """Each event with the last one of another kind that the same user had before."""
    events = t(spark, sf, "events")
    a = events.filter("event_id % 3 = 0").select("event_id", "user_id", "ts")
    b = events.filter("event_id % 3 = 1").select("user_id", "ts", F.col("event_id").alias("seen"), F.col("event_type").alias("kind"))
    return joins.as_of_join(a, b, ["user_id"], "ts", "ts", ["seen", "kind"], width=86_400).select("event_id", "seen", "kind")


HISTORY = """h AS (SELECT user_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, event_id AS version FROM events WHERE event_id % 4 = 0)"""


@query(f"WITH {HISTORY} SELECT e.event_id, h.version FROM events e JOIN h ON e.user_id = h.user_id AND e.ts >= h.since AND (h.until IS NULL OR e.ts < h.until) WHERE e.event_id % 4 = 1")
def interval_history(spark, sf):
    """Facts against the versions that a dimension's history had at their time."""
    from pyspark.sql import Window

    events = t(spark, sf, "events")
    until = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    history = events.filter("event_id % 4 = 0").select("user_id", F.col("ts").alias("since"), until.alias("until"), F.col("event_id").alias("version"))
    facts = events.filter("event_id % 4 = 1").select("event_id", "user_id", "ts")
    return joins.interval_join(facts, history, ["user_id"], "ts", "since", "until", ["version"], width=86_400).select("event_id", "version")


# ---- windows


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity)::DOUBLE, 2) AS quantity, grouping_id(l_returnflag, l_linestatus) AS grouping_id FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf):
    out = rows.grouping_sets(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [("l_quantity", "count_all", "n"), ("l_quantity", "sum", "quantity")])
    return out.withColumn("quantity", F.round(F.col("quantity").cast("double"), 2))


@query("SELECT o_orderstatus, o_orderpriority, o_custkey % 3 AS third, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority, third) AS grouping_id FROM orders GROUP BY GROUPING SETS ((o_orderstatus, third), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 3).alias("third"))
    return rows.grouping_sets(orders, ["o_orderstatus", "o_orderpriority", "third"], [("third", "count_all", "n")], [["o_orderstatus", "third"], ["o_orderpriority"], []])


@query("""SELECT o_orderkey, round(sum(o_totalprice::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders""")
def window_frames(spark, sf):
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"))
    out = rows.framed(orders, ["o_custkey"], [("o_orderkey", "asc")], [("price", "sum", "moving")], -2, 0)
    out = rows.framed(out, ["o_custkey"], [("o_orderkey", "asc")], [("price", "count_all", "near")], -1000, 1000, by="range")
    return out.select("o_orderkey", F.round("moving", 2).alias("moving"), "near")


def _event_stream(spark, sf):
    """Events in order of time as a stream of files, and a last one far later, with which all windows end."""
    path = scratch(spark)
    events = t(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{path}/in")
    end = events.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    end.write.mode("append").parquet(f"{path}/in")
    return stream_files(spark, f"{path}/in", events.schema, files_per_batch=100), path


def _streamed(spark, made, path):
    made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out").filter("user_id >= 0")


@query("""
WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER w > INTERVAL 3 HOURS AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 3 HOURS) AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    """Sessions of users, which end after three hours without an event, from a stream with a watermark."""
    stream, path = _event_stream(spark, sf)
    made = sessions(stream, ["user_id"], "ts", "3 hours", "1 day", {"n": F.count(F.lit(1))})
    out = _streamed(spark, made, path)
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    stream, path = _event_stream(spark, sf)
    made = tumbling(stream, ["user_id"], "ts", "1 hour", "1 day", {"n": F.count(F.lit(1)), "last": F.max("event_id")})
    return _streamed(spark, made, path).select("user_id", F.unix_micros("window_start").alias("window_start"), "n", "last")


# ---- null keys


def _nulls(spark, sf, other: str = "c_mktsegment"):
    """Customers of which those of one nation have no key but their nation's: (c_custkey or null, nation, segment)."""
    key = F.when(F.col("c_custkey") % 50 == 7, None).otherwise(F.col("c_custkey"))
    return t(spark, sf, "customer").select(key.alias("k"), F.when(F.col("c_custkey") % 50 == 7, F.col("c_custkey")).otherwise(0).alias("k2"), F.col(other).alias("v"))


NULLS = "c AS (SELECT CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE c_custkey END AS k, CASE WHEN c_custkey % 50 = 7 THEN c_custkey ELSE 0 END AS k2, c_mktsegment AS v, c_custkey FROM customer)"


@query(f"WITH {NULLS} SELECT k, k2, CASE WHEN c_custkey % 3 = 0 THEN 'next' ELSE v END AS v FROM c")
def scd1_null_keys(spark, sf):
    """The same load twice: a key with a null is met, not added again."""
    target = _nulls(spark, sf)
    source = target.filter((F.coalesce("k", "k2") % 3) == 0).withColumn("v", F.lit("next"))
    once = dimensions.scd1(source, target, ["k", "k2"], ["v"])
    return dimensions.scd1(source, once, ["k", "k2"], ["v"])


@query(f"""WITH {NULLS} SELECT count(*) FILTER (c_custkey % 5 <> 2) AS matched, count(*) FILTER (c_custkey % 5 = 2) AS mismatched, 0::BIGINT AS missing, 0::BIGINT AS extra,
round(count(*) FILTER (c_custkey % 5 <> 2) / count(*), 4) AS match_rate, false AS passed FROM c""")
def record_compare_null_keys(spark, sf):
    a = _nulls(spark, sf)
    return quality.compare_records(a, a.withColumn("v", F.when(F.coalesce("k", "k2") % 5 == 2, "other").otherwise(F.col("v"))), ["k", "k2"])


@query(f"WITH {NULLS} SELECT k, k2, CASE WHEN c_custkey % 4 = 0 THEN 'late' ELSE v END AS v FROM c WHERE c_custkey % 9 <> 0")
def cdc_apply_null_keys(spark, sf):
    a = _nulls(spark, sf)
    key = F.coalesce("k", "k2")
    updates = a.filter(key % 4 == 0).select("k", "k2", F.lit("late").alias("v"), F.lit(1).alias("lsn"), F.lit(4).alias("op"))
    deletes = a.filter(key % 9 == 0).select("k", "k2", F.lit("x").alias("v"), F.lit(2).alias("lsn"), F.lit(1).alias("op"))
    return dimensions.cdc_apply(a, updates.unionByName(deletes), ["k", "k2"], ["lsn"], "op")


# ---- data flows and tasks of packages


def _out(name, *columns, **properties):
    return {"name": name, "error": False, "properties": properties, "columns": [{"name": c, "type": "", "sort": 0, "properties": p} for c, p in columns]}


def _flow(spark, sf, table, *components):
    """Run components one after another over a table; the registry with what they have written."""
    source = Component("src", "source", "src", properties={"OpenRowset": f"[dbo].[{table}]"}, outputs=[_out("out")])
    every = [source, *components]
    paths = [Path_(a.ref, a.outputs[0]["name"], b.ref, "in") for a, b in zip(every, every[1:], strict=False)]
    r = _registry(spark, **{table: t(spark, sf, table)})
    run_flow(Task("load", "data_flow", components=every, paths=paths), RunContext({}, NOW), r)
    return r


@query("""SELECT o_orderstatus, count(o_custkey) AS n, round(sum(o_totalprice)::DOUBLE, 2) AS total, round(avg(o_totalprice)::DOUBLE, 4) AS mean,
min(o_custkey) AS low, max(o_custkey) AS high, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def flow_aggregate_codes(spark, sf):
    """An aggregate component by the codes of a package file: group by, count, sum, average, minimum, maximum, count distinct."""
    columns = [("o_orderstatus", "o_orderstatus", 0), ("n", "o_custkey", 1), ("total", "o_totalprice", 2), ("mean", "o_totalprice", 3), ("low", "o_custkey", 4), ("high", "o_custkey", 5), ("customers", "o_custkey", 7)]
    made = [(name, {"AggregationType": str(code), "AggregationColumnId": f"{{agg.Inputs[in].Columns[{source}]}}"}) for name, source, code in columns]
    r = _flow(spark, sf, "orders", Component("agg", "aggregate", "agg", outputs=[_out("out", *made)]), Component("dest", "destination", "dest", properties={"OpenRowset": "sums"}))
    return r.table("sums").withColumns({"total": F.round(F.col("total").cast("double"), 2), "mean": F.round(F.col("mean").cast("double"), 4)})


@query("SELECT c_custkey, upper(c_mktsegment) || '/2024-03-15' AS tag FROM customer WHERE c_acctbal > 0")
def flow_script_component(spark, sf):
    """A script component by its registered function, after a column with the time in UTC."""
    register_script("keep_solvent", lambda df: df.filter("c_acctbal > 0").drop("c_acctbal"))
    tag = _out("out", ("tag", {"FriendlyExpression": 'UPPER(c_mktsegment) + "/" + SUBSTRING((DT_WSTR, 30)GETUTCDATE(), 1, 10)'}))
    r = _flow(spark, sf, "customer", Component("tag", "derived_column", "tag", outputs=[tag]), Component("keep_solvent", "script", "script", outputs=[_out("out")]), Component("dest", "destination", "dest", properties={"OpenRowset": "tags"}))
    return r.table("tags").select("c_custkey", "tag")


@query("SELECT 'flat' AS kind, count(*) AS n, sum(n_regionkey) AS regions FROM nation UNION ALL SELECT 'raw', count(*), sum(n_regionkey) FROM nation UNION ALL SELECT 'recordset', count(*), sum(n_regionkey) FROM nation")
def flow_destinations(spark, sf):
    """A flow that fans out to a flat file, a raw file and a recordset."""
    path = scratch(spark)
    nation = t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    ctx = RunContext({}, NOW)
    outs = [Component("flat", "flat_destination", "flat", properties={"_file_path": f"{path}/flat"}), Component("raw", "raw_destination", "raw", properties={"FileName": f"{path}/raw"}), Component("set", "recordset", "set", properties={"VariableName": "User::rows"})]
    source = Component("src", "source", "src", properties={"OpenRowset": "nation"}, outputs=[_out("out")])
    run_flow(Task("load", "data_flow", components=[source, *outs], paths=[Path_("src", "out", c.ref, "in") for c in outs]), ctx, _registry(spark, nation=nation))
    found = {"flat": read_flat(spark, f"{path}/flat", nation.schema), "raw": read_raw(spark, f"{path}/raw"), "recordset": ctx.variables["User::rows"]}
    return rows.union_all([df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("n_regionkey").alias("regions")) for k, df in found.items()])


SALES = """<?xml version="1.0"?>
<DTS:Executable xmlns:DTS="www.microsoft.com/SqlServer/Dts" DTS:ObjectName="orders" DTS:ExecutableType="Microsoft.Package">
  <DTS:ConnectionManagers><DTS:ConnectionManager DTS:ObjectName="dw" DTS:DTSID="{7}" DTS:CreationName="ADO.NET"><DTS:ObjectData><DTS:ConnectionManager DTS:ConnectionString="Data Source=x"/></DTS:ObjectData></DTS:ConnectionManager></DTS:ConnectionManagers>
  <DTS:Variables><DTS:Variable DTS:Namespace="User" DTS:ObjectName="low"><DTS:VariableValue DTS:DataType="5">100000</DTS:VariableValue></DTS:Variable></DTS:Variables>
  <DTS:Executables>
    <DTS:Executable DTS:refId="Package\\clear" DTS:ObjectName="clear" DTS:ExecutableType="Microsoft.ExecuteSQLTask"><DTS:ObjectData><SqlTaskData SqlStatementSource="TRUNCATE TABLE dbo.large; TRUNCATE TABLE dbo.small;"/></DTS:ObjectData></DTS:Executable>
    <DTS:Executable DTS:refId="Package\\load" DTS:ObjectName="load" DTS:ExecutableType="Microsoft.Pipeline">
      <DTS:ObjectData><pipeline><components>
        <component refId="src" name="src" componentClassID="Microsoft.ADONETSource">
          <properties><property name="SqlCommand">SELECT o_orderkey, o_custkey, o_totalprice FROM dbo.orders</property></properties>
          <connections><connection connectionManagerID="{7}" connectionManagerRefId="Package.ConnectionManagers[dw]" name="c"/></connections>
          <outputs><output refId="src.Outputs[out]" name="out"/></outputs>
        </component>
        <component refId="split" name="split" componentClassID="Microsoft.ConditionalSplit">
          <outputs><output name="large"><properties><property name="FriendlyExpression">o_totalprice &gt;= @[User::low]</property><property name="EvaluationOrder">0</property></properties></output><output name="small"/></outputs>
        </component>
        <component refId="a" name="a" componentClassID="Microsoft.OLEDBDestination"><properties><property name="OpenRowset">dbo.large</property></properties></component>
        <component refId="b" name="b" componentClassID="Microsoft.OLEDBDestination"><properties><property name="OpenRowset">small</property></properties></component>
      </components><paths><path startId="src.Outputs[out]" endId="split.Inputs[in]"/><path startId="split.Outputs[large]" endId="a.Inputs[in]"/><path startId="split.Outputs[small]" endId="b.Inputs[in]"/></paths></pipeline></DTS:ObjectData>
    </DTS:Executable>
  </DTS:Executables>
  <DTS:PrecedenceConstraints><DTS:PrecedenceConstraint DTS:From="Package\\clear" DTS:To="Package\\load"/></DTS:PrecedenceConstraints>
</DTS:Executable>"""


@query("SELECT CASE WHEN o_totalprice >= 100000 THEN 'large' ELSE 'small' END AS kind, count(*) AS n, sum(o_custkey)::BIGINT AS customers FROM orders GROUP BY 1")
def package_file_flow(spark, sf):
    """A package read from its XML: a batch that empties two tables, then a flow that splits orders between them."""
    orders = t(spark, sf, "orders")
    none = orders.select("o_orderkey", "o_custkey", "o_totalprice").limit(3)
    r = _registry(spark, orders=orders, large=none, small=none)
    states = Runner(r, RunContext({}, NOW)).run(load_package(SALES))
    if set(states.values()) != {"succeeded"}:
        raise RuntimeError(f"the package ended with {states}")
    return rows.union_all([r.table(k).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers")) for k in ("large", "small")])


@query("SELECT r_regionkey AS region, CASE WHEN r_regionkey % 2 = 0 THEN 'failed' ELSE 'succeeded' END AS state, CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS handled, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def sequence_handlers(spark, sf):
    """For each region a package with a sequence container that counts its nations; those of even regions fail then, which a handler notes."""
    out = []
    for k in [r.r_regionkey for r in t(spark, sf, "region").collect()]:
        r = _registry(spark, nation=t(spark, sf, "nation"), noted=spark.createDataFrame([], "k int"))
        count = Task("count", "execute_sql", sql="SELECT count(*) AS n FROM nation WHERE n_regionkey = ?", parameters=[(0, "User::k")], results=[("n", "User::n")])
        then = Task("then", "execute_sql", sql="EXEC dbo.none" if k % 2 == 0 else "SELECT 1 AS one")
        inside = Task("all", "sequence", children=[count, then], constraints=[Constraint("count", "then")])
        note = Task("note", "execute_sql", sql="INSERT INTO noted VALUES (?)", parameters=[(0, "User::k")])
        ctx = RunContext({"User::k": k}, NOW)
        states = Runner(r, ctx).run(Package("p", tasks=[inside], handlers={"OnError": [note]}))
        out.append((k, states["all"], r.table("noted").count(), ctx.variables["User::n"]))
    return spark.createDataFrame(out, "region int, state string, handled long, n long")


@query("SELECT count(*) AS n, count(DISTINCT s_nationkey) AS nations FROM supplier")
def file_system_copy(spark, sf):
    """File system tasks make a folder, copy a table's files into it, move them on and delete what is left."""
    path = scratch(spark)
    t(spark, sf, "supplier").write.parquet(f"{path}/a")
    step = lambda operation, source, target="": Task(f"{operation} {source}", "file_system", properties={"operation": operation, "source": f"{path}/{source}", "target": f"{path}/{target}"})
    tasks = [step("create_directory", "b"), step("copy_directory", "a", "b/copy"), step("move_directory", "b/copy", "c"), step("delete_directory", "a")]
    states = Runner(_registry(spark), RunContext({}, NOW)).run(Package("p", tasks=tasks, constraints=[Constraint(x.name, y.name) for x, y in zip(tasks, tasks[1:], strict=False)]))
    if set(states.values()) != {"succeeded"}:
        raise RuntimeError(f"the tasks ended with {states}")
    return spark.read.parquet(f"{path}/c").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s_nationkey").alias("nations"))
