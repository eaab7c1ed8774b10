"""Databases read in parts, script sources of several tasks, workbooks as streams of rows."""

import io
import zipfile

from weirflow import sources
from weirflow.sources import Connection, Registry


def test_jdbc_in_parts(spark):
    """Written to an in-memory database and read by several tasks, with bounds that are asked for."""
    df = spark.range(100).selectExpr("id AS Key", "cast(id * 2 AS int) AS twice", "CASE WHEN id % 7 = 0 THEN NULL ELSE cast(id AS double) END AS part", "concat('n', id) AS name")
    url = "jdbc:derby:memory:weirflow;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    r = Registry(spark)
    sources.write_database(df, Connection("db", url=url, options=driver), "numbers", mode="overwrite")
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    at = lambda **options: Connection("db", url=url, options=driver | options)
    plain = sources.read_database(r, at(), table="numbers")
    assert rows(plain) == rows(df) and plain.rdd.getNumPartitions() == 1
    for options, parts in (({"partitionColumn": "Key", "numPartitions": "4"}, 4), ({"partitionColumn": "auto"}, 8), ({"partitionColumn": "part", "numPartitions": "3"}, 3)):
        got = sources.read_database(r, at(**options), table="numbers")
        assert rows(got) == rows(df) and got.rdd.getNumPartitions() == parts
        sizes = [len(p) for p in got.rdd.glom().collect()]
        assert all(0 < n < 60 for n in sizes)
    some = sources.read_database(r, at(partitionColumn="Key", numPartitions="4"), query='SELECT "Key", "name" FROM numbers WHERE "twice" < 20')
    assert some.count() == 10 and some.rdd.getNumPartitions() == 4
    none = sources.read_database(r, at(partitionColumn="Key"), query='SELECT "Key" FROM numbers WHERE "twice" < 0')
    assert none.count() == 0


def test_script_source_of_several_tasks(spark):
    df = sources.script_source(spark, "My Source", "k int, v string", lambda: [0, 10, 20], lambda low: ((k, f"v{k}") for k in range(low, low + 10)))
    assert df.rdd.getNumPartitions() == 3 and sorted(r.k for r in df.collect()) == list(range(30))
    assert df.filter("k = 25").first().v == "v25"


def workbook(rows, shared=True):
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}"><sheets><sheet name="Data"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>')
        cells = "".join(f'<row><c r="A{k}"><v>{k}</v></c>' + (f'<c r="C{k}" t="inlineStr"><is><t>n{k}</t></is></c>' if k % 3 else "") + "</row>" for k in range(2, rows + 2))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_row_by_row(spark, tmp_path, monkeypatch):
    data = workbook(25)
    rows = sources.sheet_rows(data, "Data$")
    assert next(rows) == ["id", None, "name"] and next(rows) == ["2", None, "n2"] and next(rows) == ["3"]
    (tmp_path / "a.xlsx").write_bytes(data)
    (tmp_path / "b.xlsx").write_bytes(workbook(3))
    monkeypatch.setattr(sources, "SHEET_ROWS", 4)
    df = sources.read_excel(spark, str(tmp_path / "*.xlsx"), "name string, id int, gone double", "Data")
    assert sorted((r.id, r.name) for r in df.collect()) == sorted((k, f"n{k}" if k % 3 else None) for n in (25, 3) for k in range(2, n + 2))
