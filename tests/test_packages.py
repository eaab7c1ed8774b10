"""Packages from XML, run over small tables."""

import io
import zipfile

import pytest

from weirflow import sources
from weirflow.operators.rows import RunContext
from weirflow.plans.control import Runner
from weirflow.plans.flow import CycleError, register_script, topological
from weirflow.plans.model import Component, Package, Path_, Task, component_type, load_package, load_project
from weirflow.sources import Registry

PACKAGE = """<?xml version="1.0"?>
<DTS:Executable xmlns:DTS="www.microsoft.com/SqlServer/Dts" DTS:ObjectName="load_sales" DTS:ExecutableType="Microsoft.Package">
  <DTS:ConnectionManagers>
    <DTS:ConnectionManager DTS:ObjectName="dw" DTS:DTSID="{1}" DTS:CreationName="OLEDB"><DTS:ObjectData><DTS:ConnectionManager DTS:ConnectionString="Provider=SQLNCLI11;Data Source=x"/></DTS:ObjectData></DTS:ConnectionManager>
  </DTS:ConnectionManagers>
  <DTS:Variables>
    <DTS:Variable DTS:Namespace="User" DTS:ObjectName="low"><DTS:VariableValue DTS:DataType="3">2</DTS:VariableValue></DTS:Variable>
  </DTS:Variables>
  <DTS:Executables>
    <DTS:Executable DTS:refId="Package\\load" DTS:ObjectName="load" DTS:ExecutableType="Microsoft.Pipeline">
      <DTS:ObjectData><pipeline><components>
        <component refId="src" name="src" componentClassID="Microsoft.OLEDBSource">
          <properties><property name="OpenRowset">[dbo].[lines]</property></properties>
          <outputs><output refId="src.Outputs[out]" name="out"><outputColumns><outputColumn name="qty" dataType="i4"/><outputColumn name="price" dataType="r8"/></outputColumns></output></outputs>
        </component>
        <component refId="calc" name="calc" componentClassID="Microsoft.DerivedColumn">
          <inputs><input refId="calc.Inputs[in]" name="in"/></inputs>
          <outputs><output refId="calc.Outputs[out]" name="out"><outputColumns><outputColumn name="total" dataType="r8"><properties><property name="Expression">#{x}</property><property name="FriendlyExpression">qty * price</property></properties></outputColumn></outputColumns></output></outputs>
        </component>
        <component refId="split" name="split" componentClassID="Microsoft.ConditionalSplit">
          <outputs>
            <output name="many"><properties><property name="FriendlyExpression">qty &gt;= @[User::low]</property><property name="EvaluationOrder">0</property></properties></output>
            <output name="few"/>
          </outputs>
        </component>
        <component refId="tidy" name="tidy" componentClassID="Microsoft.ScriptComponentHost"><outputs><output name="out"/></outputs></component>
        <component refId="a" name="a" componentClassID="Microsoft.OLEDBDestination"><properties><property name="OpenRowset">dbo.many_lines</property></properties></component>
        <component refId="b" name="b" componentClassID="Microsoft.OLEDBDestination"><properties><property name="OpenRowset">few_lines</property></properties></component>
      </components><paths>
        <path startId="src.Outputs[out]" endId="calc.Inputs[in]"/><path startId="calc.Outputs[out]" endId="split.Inputs[in]"/>
        <path startId="split.Outputs[many]" endId="tidy.Inputs[in]"/><path startId="tidy.Outputs[out]" endId="a.Inputs[in]"/><path startId="split.Outputs[few]" endId="b.Inputs[in]"/>
      </paths></pipeline></DTS:ObjectData>
    </DTS:Executable>
    <DTS:Executable DTS:refId="Package\\count" DTS:ObjectName="count" DTS:ExecutableType="Microsoft.ExecuteSQLTask">
      <DTS:ObjectData><SqlTaskData SqlStatementSource="SELECT TOP 1 count(*) AS n FROM [dbo].[many_lines]"><ResultBinding ResultName="n" DtsVariableName="User::n"/></SqlTaskData></DTS:ObjectData>
    </DTS:Executable>
  </DTS:Executables>
  <DTS:PrecedenceConstraints><DTS:PrecedenceConstraint DTS:From="Package\\load" DTS:To="Package\\count"/></DTS:PrecedenceConstraints>
</DTS:Executable>"""


def test_package_runs(spark, tmp_path):
    lines = spark.createDataFrame([(1, 2.0), (2, 3.0), (5, None), (None, 1.0)], "qty int, price double")
    registry = Registry(spark, tables={"lines": lines}, warehouse=str(tmp_path))
    register_script("tidy", lambda df: df.fillna({"total": 0.0}))
    ctx = RunContext()
    states = Runner(registry, ctx).run(load_package(PACKAGE))
    assert states == {"load": "succeeded", "count": "succeeded"}, ctx.variables
    assert ctx.variables["User::n"] == 2
    tables = {k.rpartition(".")[2]: registry.table(k) for k in registry.tables}
    assert sorted(r.total for r in tables["many_lines"].collect()) == [0.0, 6.0]
    assert sorted(map(str, (r.qty for r in tables["few_lines"].collect()))) == ["1", "None"]


def test_profiling_task(spark):
    registry = Registry(spark, tables={"t": spark.createDataFrame([(1,), (None,)], "a int")})
    states = Runner(registry).run(Package("p", tasks=[Task("look", "data_profiling", properties={"table": "t"})]))
    assert states == {"look": "succeeded"} and registry.table("t_profile").first().null_count == 1


def test_failures_are_states(spark):
    tasks = [Task("mail", "send_mail"), Task("loop", "for_loop", properties={"EvalExpression": "1 == 2"})]
    assert Runner(Registry(spark)).run(Package("p", tasks=tasks)) == {"mail": "failed", "loop": "succeeded"}
    with pytest.raises(CycleError):
        topological(["a", "b"], [("a", "b"), ("b", "a")])


def test_dialect():
    assert sources.dialect("SELECT TOP 5 [a b], ISNULL(x, 'ISNULL(y)') FROM [dbo].[t]") == "SELECT `a b`, coalesce(x, 'ISNULL(y)') FROM `t` LIMIT 5"
    with pytest.raises(ValueError):
        sources.dialect("EXEC dbo.proc")


def test_kinds():
    assert component_type("Microsoft.PctSampling") == "percentage_sampling" and component_type("Microsoft.Cache") == "cache"
    assert component_type("{0000}") == "unknown"
    assert sources.detect_connector("OraOLEDB.Oracle") == "oracle" and sources.detect_connector("", "https://x/api") == "rest" and sources.detect_connector() == "oledb"


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Other"/><sheet name="Data"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>price</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1.5</v></c></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_excel(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(workbook())
    out = sources.read_excel(spark, str(tmp_path / "book.xlsx"), "name string, price double", "Data$").collect()
    assert [tuple(r) for r in out] == [("ab", 1.5), (None, None)]


def flow(*components, paths):
    return Package("p", tasks=[Task("flow", "data_flow", components=list(components), paths=[Path_(a, "", b, "") for a, b in paths])])


def component(name, kind, **properties):
    return Component(name, kind, name, properties=properties)


def test_row_count_at_the_end_of_a_flow(spark):
    """A count that no sink stands behind is made all the same."""
    registry = Registry(spark, tables={"t": spark.range(7).toDF("a")})
    for last in ([], [("recordset", "kept")]):
        ends = [component(n, k) for k, n in last]
        package = flow(component("src", "source", OpenRowset="t"), component("n", "row_count", VariableName="User::n"), *ends, paths=[("src", "n"), *[("n", n) for _, n in last]])
        run = Runner(registry, RunContext())
        assert run.run(package) == {"flow": "succeeded"} and run.ctx.variables["User::n"] == 7


def test_two_sinks_read_their_source_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    registry = Registry(spark, tables={"t": spark.range(50).toDF("a").mapInPandas(count, "a long")}, warehouse=str(tmp_path))
    ends = [component(n, "destination", OpenRowset=n) for n in ("one", "two")]
    package = flow(component("src", "source", OpenRowset="t"), component("both", "multicast"), *ends, paths=[("src", "both"), ("both", "one"), ("both", "two")])
    assert Runner(registry).run(package) == {"flow": "succeeded"}
    assert read.value == 50
    assert registry.table("one").count() == registry.table("two").count() == 50


def test_a_table_gets_rows_added(spark, tmp_path):
    registry = Registry(spark, tables={"dbo.kept": spark.range(3).toDF("a"), "t": spark.range(5).toDF("a")}, warehouse=str(tmp_path))
    package = flow(component("src", "source", OpenRowset="t"), component("end", "destination", OpenRowset="[dbo].[kept]"), paths=[("src", "end")])
    assert Runner(registry).run(package) == {"flow": "succeeded"}
    assert registry.table("kept").count() == 8
    package.tasks[0].properties["TransactionOption"] = "2"
    package.tasks[0].components.append(component("odd", "no such thing"))
    assert Runner(registry).run(package) == {"flow": "failed"}
    assert registry.table("kept").count() == 8


NS = 'xmlns:DTS="www.microsoft.com/SqlServer/Dts"'


def test_project(spark, tmp_path):
    """Two packages of a project: one binds a variable to the other's parameter; both see the project's."""
    params = """<SSIS:Parameters xmlns:SSIS="www.microsoft.com/SqlServer/SSIS"><SSIS:Parameter SSIS:Name="Least"><SSIS:Properties>
        <SSIS:Property SSIS:Name="DataType">Int32</SSIS:Property><SSIS:Property SSIS:Name="DesignDefaultValue">4</SSIS:Property></SSIS:Properties></SSIS:Parameter></SSIS:Parameters>"""
    (tmp_path / "Project.params").write_text(params)
    (tmp_path / "dw.conmgr").write_text(f'<DTS:ConnectionManager {NS} DTS:ObjectName="dw" DTS:DTSID="{{7}}" DTS:CreationName="OLEDB"><DTS:ObjectData><DTS:ConnectionManager DTS:ConnectionString="Data Source=x"/></DTS:ObjectData></DTS:ConnectionManager>')
    (tmp_path / "main.dtsx").write_text(f"""<DTS:Executable {NS} DTS:ObjectName="main"><DTS:Variables>
        <DTS:Variable DTS:Namespace="User" DTS:ObjectName="wanted"><DTS:VariableValue DTS:DataType="8">b</DTS:VariableValue></DTS:Variable>
        <DTS:Variable DTS:Namespace="User" DTS:ObjectName="hidden"><DTS:VariableValue DTS:DataType="8">x</DTS:VariableValue></DTS:Variable></DTS:Variables>
        <DTS:Executables><DTS:Executable DTS:ObjectName="call" DTS:ExecutableType="Microsoft.ExecutePackageTask"><DTS:ObjectData><ExecutePackageTask>
        <PackageName>child.dtsx</PackageName><ParameterAssignment><ParameterName>kind</ParameterName><BindedVariableOrParameterName>User::wanted</BindedVariableOrParameterName></ParameterAssignment>
        </ExecutePackageTask></DTS:ObjectData></DTS:Executable></DTS:Executables></DTS:Executable>""")
    (tmp_path / "child.dtsx").write_text(f"""<DTS:Executable {NS} DTS:ObjectName="child"><DTS:Executables>
        <DTS:Executable DTS:ObjectName="fill" DTS:ExecutableType="Microsoft.ExecuteSQLTask"><DTS:ObjectData><SqlTaskData SqlStatementSource="INSERT INTO dbo.target SELECT a, k FROM t WHERE k = ? AND a &gt;= ?">
        <ParameterBinding ParameterName="0" DtsVariableName="$Package::kind"/><ParameterBinding ParameterName="1" DtsVariableName="$Project::Least"/></SqlTaskData></DTS:ObjectData></DTS:Executable></DTS:Executables></DTS:Executable>""")
    project = load_project(tmp_path)
    assert sorted(project) == ["child.dtsx", "main.dtsx"] and all([c.name for c in p.connections] == ["dw"] for p in project.values())
    rows = spark.range(10).selectExpr("id AS a", "IF(id % 2 = 0, 'a', 'b') AS k")
    registry = Registry(spark, tables={"t": rows, "target": rows.limit(0)}, warehouse=str(tmp_path / "tables"))
    run = Runner(registry, RunContext(), project)
    assert run.run(project["main.dtsx"]) == {"call": "succeeded"}, run.ctx.variables
    assert sorted(r.a for r in registry.table("target").collect()) == [5, 7, 9]
    from weirflow.plans.metadata import column_lineage

    assert [tuple(r) for r in column_lineage(spark, list(project.values())).collect()] == [("@main", "User::wanted", "@call", "kind", "passthrough")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / "in" / name).write_text(name)
    assert sources.list_files(spark, str(tmp_path / "in"), "*.csv") == [str(tmp_path / "in" / n) for n in ("a.csv", "b.csv")]
    do = lambda *args: sources.file_operation(spark, *map(str, args))
    do("create_directory", tmp_path / "out")
    do("copy_file", tmp_path / "in/a.csv", tmp_path / "out/a.csv")
    do("move_file", tmp_path / "in/b.csv", tmp_path / "out/b.csv")
    assert sorted(p.name for p in (tmp_path / "out").glob("*.csv")) == ["a.csv", "b.csv"] and not (tmp_path / "in/b.csv").exists()
    do("delete_content", tmp_path / "out")
    assert not list((tmp_path / "out").glob("*.csv"))
    with pytest.raises(ValueError):
        do("fly", tmp_path / "out")


def test_nodes_and_handlers(spark):
    loop = Task("each", "foreach_loop", properties={"enumerator": "nodelist", "source": "<r><x>1</x><x>2</x></r>", "xpath": "x", "variables": "User::v"}, children=[Task("add", "expression", expression="@[User::all] = @[User::all] + @[User::v]")])
    mark = lambda name: [Task(name, "expression", expression=f'@[User::all] = @[User::all] + "{name}"')]
    package = Package("p", variables={"User::all": ""}, tasks=[loop, Task("mail", "send_mail")], handlers={"OnPreExecute": mark("("), "OnTaskFailed": mark("!"), "OnPostExecute": mark(")")})
    run = Runner(Registry(spark))
    assert run.run(package) == {"each": "succeeded", "mail": "failed"} and run.ctx.variables["User::all"] == "(12!)"


def test_impact_of_tables(spark):
    from weirflow.plans.metadata import package_tables, table_impact

    rows = [("load", "t1", "dbo.orders", "reader"), ("load", "t2", "dbo.orders", "reader"), ("load", "t1", "fact", "writer"), ("fill", "t1", "dbo.orders", "writer"), ("ask", "t1", "dbo.orders", "reader")]
    lineage = spark.createDataFrame(rows, "package_name string, task_name string, table_name string, role string")
    assert sorted(map(tuple, table_impact(lineage, "[dbo].[orders]").collect())) == [("reader", ["ask", "load"]), ("writer", ["fill"])]
    assert sorted(map(tuple, package_tables(lineage, "load").collect())) == [("reader", ["dbo.orders"]), ("writer", ["fact"])]
    assert table_impact(lineage, "none").count() == package_tables(lineage, "none").count() == 0
