"""Statements of pass-through SQL: what they change, and what they refuse; the log of a warehouse's versions."""

import pytest
from pyspark.sql import functions as F

from weirflow.sources import Registry
from weirflow.sources.log import Conflict, TableLog
from weirflow.sources.statements import statements, tokens


@pytest.fixture
def r(spark, tmp_path):
    out = Registry(spark, warehouse=str(tmp_path))
    out.put("t", spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, 30, None)], "a int, b int, c string"))
    out.put("s", spark.createDataFrame([(1, 100), (4, 400)], "a int, b int"))
    out.put("stg.orders", spark.createDataFrame([(1, "x y")], "id int, `order name` string"))
    return out


def rows(r, name="t"):
    return sorted(map(tuple, r.table(name).collect()), key=repr)


def test_tokens_know_texts_names_and_comments():
    body = tokens("SELECT [a;b], 'it''s ; ? WHERE' /* ; */ FROM t -- ;\n WHERE x = ? AND y = ?")
    assert [x.text for x in body if x.kind == "mark"] == ["0", "1"] and len(statements(body)) == 1
    assert len(statements(tokens("a; b;; IF x BEGIN c; d END ELSE e; f"))) == 4
    with pytest.raises(ValueError):
        tokens("SELECT 'open")


@pytest.mark.parametrize(
    "sql, args, want",
    [
        ("UPDATE t SET b = ? WHERE a = ?", [5, 1], [(1, 5, "a"), (2, 20, "b"), (None, 30, None)]),
        ("UPDATE t SET b = ?, c = ? WHERE a = ? OR b = ?", [7, "z", 2, 30], [(1, 10, "a"), (2, 7, "z"), (None, 7, "z")]),
        ("UPDATE t SET c = 'x where y = z' WHERE c = 'a'", [], [(1, 10, "x where y = z"), (2, 20, "b"), (None, 30, None)]),
        ("UPDATE t SET b = (SELECT max(b) FROM s WHERE s.a < 4) WHERE a = 2", [], [(1, 10, "a"), (2, 100, "b"), (None, 30, None)]),
        ("UPDATE t SET b = b + 1, c = NULL", [], [(1, 11, None), (2, 21, None), (None, 31, None)]),
        ("UPDATE x SET b = s.b FROM t x JOIN s ON s.a = x.a", [], [(1, 100, "a"), (2, 20, "b"), (None, 30, None)]),
        ("UPDATE dbo.t SET b = s.b FROM dbo.t INNER JOIN s ON s.a = t.a WHERE s.b > ?", [50], [(1, 100, "a"), (2, 20, "b"), (None, 30, None)]),
        ("DELETE t WHERE a = 1", [], [(2, 20, "b"), (None, 30, None)]),
        ("DELETE FROM t WHERE c <> 'a'", [], [(1, 10, "a"), (None, 30, None)]),
        ("DELETE FROM t WHERE a IN (SELECT a FROM s)", [], [(2, 20, "b"), (None, 30, None)]),
        ("DELETE x FROM t AS x JOIN s ON s.a = x.a", [], [(2, 20, "b"), (None, 30, None)]),
        ("DELETE FROM t", [], []),
        ("TRUNCATE TABLE [dbo].[t];", [], []),
        ("INSERT t (c, a) VALUES ('it''s \\ n', ?)", [9], [(1, 10, "a"), (2, 20, "b"), (9, None, "it's \\ n"), (None, 30, None)]),
        ("INSERT INTO t SELECT a, b, 's' FROM s WHERE a = 4", [], [(1, 10, "a"), (2, 20, "b"), (4, 400, "s"), (None, 30, None)]),
        ("MERGE t USING s ON t.a = s.a WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.a, s.b);", [], [(1, 10, "a"), (2, 20, "b"), (4, 400, None), (None, 30, None)]),
        ("MERGE t AS x USING s AS y ON x.a = y.a WHEN MATCHED THEN UPDATE SET b = y.b + ? WHEN NOT MATCHED BY SOURCE THEN DELETE;", [1], [(1, 101, "a")]),
        ("MERGE t USING s ON t.a = s.a WHEN MATCHED AND s.b > 500 THEN DELETE WHEN MATCHED AND s.b > 50 THEN UPDATE SET c = 'm';", [], [(1, 10, "m"), (2, 20, "b"), (None, 30, None)]),
        ("SET NOCOUNT ON; DECLARE @x int = ?, @y int; SET @y = @x + 1; UPDATE t SET b = @y WHERE a = @x", [1], [(1, 2, "a"), (2, 20, "b"), (None, 30, None)]),
        ("BEGIN TRANSACTION; DELETE FROM t; ROLLBACK", [], [(1, 10, "a"), (2, 20, "b"), (None, 30, None)]),
        ("BEGIN TRAN; DELETE FROM t WHERE a = 1; COMMIT TRAN", [], [(2, 20, "b"), (None, 30, None)]),
        ("IF (SELECT count(*) FROM t) > 5 DELETE FROM t ELSE DELETE FROM t WHERE a = 2", [], [(1, 10, "a"), (None, 30, None)]),
        ("ALTER INDEX i ON dbo.t REORGANIZE; UPDATE STATISTICS t", [], [(1, 10, "a"), (2, 20, "b"), (None, 30, None)]),
    ],
)
def test_writes(r, sql, args, want):
    assert r.sql(sql, args).count() == 0
    assert rows(r) == sorted(want, key=repr)


@pytest.mark.parametrize(
    "sql",
    [
        "MERGE t USING s ON t.a = s.a WHEN MATCHED THEN UPDATE SET b = 1 OUTPUT inserted.a;",
        "MERGE t USING s ON t.a = s.a WHEN MATCHED BY SOURCE THEN DELETE;",
        "MERGE t USING (SELECT 1 AS a UNION ALL SELECT 1) s ON t.a = s.a WHEN MATCHED THEN DELETE;",
        "UPDATE t SET no_such = 1",
        "UPDATE t SET b = ? WHERE a = ?",
        "UPDATE t SET b = s.b FROM s",
        "UPDATE t b = 1",
        "INSERT INTO t (a, nothing) VALUES (1, 2)",
        "INSERT INTO t (a) VALUES (1, 2)",
        "DROP TABLE t",
        "EXEC dbo.unknown",
        "SELECT @x",
        "DELETE FROM t WHERE a = 1; DELETE FROM nowhere",
    ],
)
def test_refused_statements_change_nothing(r, sql):
    before = dict(r.tables)
    with pytest.raises(Exception, match="."):
        r.sql(sql, [1] if "?" in sql else [])
    assert r.tables == before and len(rows(r)) == 3


def test_queries(r):
    assert r.sql("SELECT TOP 1 o.[order name] FROM stg.orders o WHERE o.id = 1").first()[0] == "x y"
    assert r.sql("SELECT stg.orders.id FROM stg.orders").first()[0] == 1
    assert r.sql("WITH q AS (SELECT ISNULL(a, -1) AS a FROM t WITH (NOLOCK)) SELECT min(a) AS a FROM q").first()[0] == -1


def test_procedures_get_and_give(r):
    r.register_procedure("log.write", lambda registry, a, b=0: {"total": a + b, "return": 7})
    args = [3, None]
    r.sql("EXEC log.write ?, 4, ? OUTPUT", args)
    assert args == [3, 7]
    r.sql("DECLARE @r int, @t int; EXEC @r = log.write @b = 1, @a = 2, @total = @t OUTPUT; UPDATE t SET b = @r + @t WHERE a = 1")
    assert (1, 10, "a") in rows(r)  # 7 and 3


def test_inserts_add_files_only(r, tmp_path):
    before = r.tables["t"]
    r.sql("INSERT INTO t (a) VALUES (5)")
    r.sql("INSERT INTO t (a) VALUES (6)")
    assert r.tables["t"][0] == before and len(r.tables["t"]) == 3 and len(rows(r)) == 5


def test_select_into_makes_a_table(r):
    r.sql("SELECT a, (SELECT max(b) FROM s) AS top INTO dbo.made FROM t WHERE a IS NOT NULL")
    assert rows(r, "dbo.made") == [(1, 400), (2, 400)]
    with pytest.raises(ValueError, match="there already"):
        r.sql("SELECT 1 AS a INTO t")


def test_identity_numbers_new_rows(r, spark):
    r.put("log", spark.createDataFrame([(5, "x")], "id long, what string"))
    r.identities["log"] = "id"
    assert r.sql("INSERT INTO log (what) VALUES ('y'); SELECT SCOPE_IDENTITY() AS id").first()[0] == 6
    assert rows(r, "log") == [(5, "x"), (6, "y")]


def test_a_warehouse_shows_whole_versions(spark, tmp_path):
    df = spark.range(3).select(F.col("id").cast("int").alias("a"))
    r = Registry.open(spark, str(tmp_path))
    r.put("one", df)
    r.put("two", df)
    assert r.version == 2 and sorted(Registry.open(spark, str(tmp_path)).tables) == ["one", "two"]
    try:
        with r.transaction():
            r.sql("DELETE FROM one")
            assert Registry.open(spark, str(tmp_path)).table("one").count() == 3  # killed here, the old version is what there is
            r.sql("INSERT INTO two VALUES (9)")
            raise KeyboardInterrupt
    except KeyboardInterrupt:
        pass
    again = Registry.open(spark, str(tmp_path))
    assert again.version == 2 and again.table("one").count() == 3 and again.table("two").count() == 3
    with r.transaction():
        r.sql("DELETE FROM one")
        r.sql("INSERT INTO two VALUES (9)")
    assert r.version == 3 and Registry.open(spark, str(tmp_path)).table("two").count() == 4
    # The second of two writers is told that it comes too late, and keeps what it had.
    with pytest.raises(Conflict):
        again.sql("DELETE FROM two")
    assert again.table("two").count() == 3 and TableLog(spark, str(tmp_path)).latest() == 3
    old = TableLog(spark, str(tmp_path)).read(1)[1]
    assert list(old) == ["one"]
