"""What packages say about data: lineage, impact, classification, catalog and shared flows, as small DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.parser import ExpressionError, parse, referenced
from weirflow.operators.graph import reachable
from weirflow.plans.model import Component, Package, Task
from weirflow.sources import clean_name

# Patterns of column names, case apart, and the tag of what they hold; the first that is found counts.
TAGS = [
    ("PII", "(ssn|social.?security)"),
    ("PII", "(email|e.?mail)"),
    ("PII", "(phone|mobile|cell)"),
    ("FINANCIAL", "(credit.?card|card.?number|ccn)"),
    ("FINANCIAL", "(salary|income|compensation|wage)"),
    ("PHI", "(diagnosis|medical|health|patient)"),
    ("RESTRICTED", "(password|secret|token|api.?key)"),
    ("PII", "(address|street|zip.?code|postal)"),
    ("PII", "(birth.?date|dob|date.?of.?birth)"),
]


def classify(columns: DataFrame, name: str = "column_name") -> DataFrame:
    """Columns with ``tag``, the first pattern's that a name meets, null if none."""
    tag: Column = F.lit(None).cast("string")
    for kind, pattern in reversed(TAGS):
        tag = F.when(F.lower(F.col(name)).rlike(pattern), kind).otherwise(tag)
    return columns.withColumn("tag", tag)


def sql_tables(sql: str) -> list[str]:
    """Tables that a query reads."""
    return list(dict.fromkeys(clean_name(m) for m in re.findall(r"\b(?:FROM|JOIN)\s+([\w.\[\]`\"]+)", sql or "", re.I)))


def written_tables(sql: str) -> list[str]:
    return list(dict.fromkeys(clean_name(m) for m in re.findall(r"\b(?:INSERT\s+INTO|UPDATE|MERGE\s+INTO|MERGE|TRUNCATE\s+TABLE|DELETE\s+FROM)\s+([\w.\[\]`\"]+)", sql or "", re.I)))


def all_tasks(tasks: list[Task]):
    for t in tasks:
        yield t
        yield from all_tasks(t.children)


def _table_of(c: Component) -> str:
    return clean_name(c.properties.get("OpenRowset") or c.properties.get("TableOrViewName") or c.properties.get("TableName") or "")


def table_lineage(spark: SparkSession, packages: list[Package]) -> DataFrame:
    """(package_name, task_name, table_name, role): readers and writers of tables."""
    found = set()
    for p in packages:
        for t in all_tasks(p.tasks):
            for table in sql_tables(t.sql):
                found.add((p.name, t.name, table, "reader"))
            for table in written_tables(t.sql):
                found.add((p.name, t.name, table, "writer"))
            for c in t.components:
                role = "writer" if "destination" in c.type or c.type == "oledb_command" else "reader"
                if c.type == "oledb_command":
                    names = written_tables(c.properties.get("SqlCommand", ""))
                else:
                    names = sql_tables(c.properties["SqlCommand"]) if c.properties.get("SqlCommand") else [_table_of(c)]
                found |= {(p.name, t.name, n, role) for n in names if n}
    return spark.createDataFrame(sorted(found), "package_name string, task_name string, table_name string, role string")


def table_impact(lineage: DataFrame, table: str) -> DataFrame:
    """(role, packages): which packages read and which write a table, from the rows of ``table_lineage``."""
    own = lineage.filter(F.col("table_name") == clean_name(table))
    return own.groupBy("role").agg(F.array_sort(F.collect_set("package_name")).alias("packages"))


def package_tables(lineage: DataFrame, package: str) -> DataFrame:
    """(role, tables): which tables a package reads and which it writes."""
    own = lineage.filter(F.col("package_name") == package)
    return own.groupBy("role").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def column_lineage(spark: SparkSession, packages: list[Package]) -> DataFrame:
    """(source_table, source_column, target_table, target_column, transformation) through each data flow.

    A derived column comes from all columns that its expression refers to. What a package binds to another's parameters
    goes from @package to @task.
    """
    edges = set()
    for p in packages:
        for t in all_tasks(p.tasks):
            edges |= {(f"@{p.name}", variable, f"@{t.name}", parameter, "passthrough") for parameter, variable in t.bindings.items()}
            by_ref = {c.ref: c for c in t.components}
            state: dict[str, dict[str, set]] = {}
            from weirflow.plans.flow import topological

            links = [(x.source, x.target) for x in t.paths if x.source in by_ref and x.target in by_ref]
            for ref in topological(list(by_ref), links):
                c = by_ref[ref]
                cols: dict[str, set] = {}
                for a, b in links:
                    if b == ref:
                        for name, origins in state[a].items():
                            cols.setdefault(name, set()).update(origins)
                if c.type.endswith("source") or c.type == "lookup":
                    table = _table_of(c) or next(iter(sql_tables(c.properties.get("SqlCommand", ""))), "")
                    kind = "lookup" if c.type == "lookup" else "direct"
                    for o in c.outputs:
                        for x in o["columns"] if not o["error"] else []:
                            cols[x["name"]] = {(table, x["properties"].get("CopyFromReferenceColumn") or x["name"], kind)}
                elif c.type == "derived_column":
                    before = dict(cols)
                    for port in [*c.outputs, *c.inputs]:
                        for x in port["columns"]:
                            text = x["properties"].get("FriendlyExpression") or x["properties"].get("Expression")
                            if text:
                                try:
                                    names = referenced(parse(text))
                                except ExpressionError:
                                    names = []
                                cols[x["name"]] = {(a, b, "derived") for n in names for a, b, _ in before.get(n, ())}
                elif "destination" in c.type:
                    wanted = {x["name"] for i in c.inputs for x in i["columns"]} or set(cols)
                    for name in wanted & set(cols):
                        edges |= {(a, b, _table_of(c), name, how) for a, b, how in cols[name]}
                state[ref] = cols
    return spark.createDataFrame(sorted(edges), "source_table string, source_column string, target_table string, target_column string, transformation string")


def column_impact(edges: DataFrame, table: str, column: str, downstream: bool = True) -> DataFrame:
    """(table_name, column_name, steps) of the columns that depend on a column (or that it depends on), through any number of
    edges, of which it takes ``steps`` at least. The column itself is among them if a cycle leads back to it.
    """
    a, b = (["source_table", "source_column"], ["target_table", "target_column"])[:: 1 if downstream else -1]
    start = edges.sparkSession.createDataFrame([(table, column)], "t string, c string")
    return reachable(edges, start, a, b).toDF("table_name", "column_name", "steps")


def mermaid(edges: list[tuple[str, str]]) -> str:
    return "graph LR\n" + "".join(f"    {re.sub(r'[^0-9A-Za-z_]', '_', a)} --> {re.sub(r'[^0-9A-Za-z_]', '_', b)}\n" for a, b in edges)


# Kinds of catalog entries.
ENTRY_KINDS = ["package", "connection", "task", "data_flow", "component", "table", "column", "expression", "parameter"]


def catalog(spark: SparkSession, packages: list[Package]) -> DataFrame:
    """Entries (name, kind, package_name, description, tags) of all that packages hold.

    Tags: the kind of a connection, task or component, the table's role, and the sensitivity that a column's name tells of.
    """
    rows: list[tuple] = []
    for p in packages:
        rows.append((p.name, "package", p.name, f"{len(p.tasks)} tasks", ["package"]))
        rows += [(c.name, "connection", p.name, c.connector, ["connection", c.connector]) for c in p.connections]
        rows += [(name, "parameter", p.name, str(value), ["parameter"]) for name, value in p.variables.items()]
        for t in all_tasks(p.tasks):
            rows.append((t.name, "data_flow" if t.type == "data_flow" else "task", p.name, t.sql or t.expression or t.type, ["task", t.type]))
            for c in t.components:
                rows.append((c.name, "component", p.name, f"{c.type} in {t.name}", ["component", c.type]))
                for port in [*c.outputs, *c.inputs]:
                    for x in port["columns"]:
                        text = x["properties"].get("FriendlyExpression") or x["properties"].get("Expression")
                        rows.append((x["name"], "column", p.name, f"{c.name} in {t.name}", ["column", c.type]))
                        if text:
                            rows.append((x["name"], "expression", p.name, text, ["expression", c.type]))
    entries = spark.createDataFrame(rows, "name string, kind string, package_name string, description string, tags array<string>").distinct()
    used = table_lineage(spark, packages)
    tables = used.groupBy("table_name", "package_name").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    tables = tables.select(F.col("table_name").alias("name"), F.lit("table").alias("kind"), "package_name", F.array_join("roles", " and ").alias("description"), F.concat(F.array(F.lit("table")), "roles").alias("tags"))
    tagged = classify(entries.select(F.col("name").alias("column_name")).distinct()).filter("tag IS NOT NULL")
    marked = entries.join(tagged, (F.col("name") == F.col("column_name")) & (F.col("kind") == "column"), "left")
    marked = marked.withColumn("tags", F.when(F.col("tag").isNotNull(), F.concat("tags", F.array("tag"))).otherwise(F.col("tags")))
    return marked.select("name", "kind", "package_name", "description", "tags").unionByName(tables)


def browse(entries: DataFrame, tags: list[str] | None = None, kind: str | None = None, package_name: str | None = None) -> DataFrame:
    """The entries that have all tags, case apart, and are of a kind and of a package, as far as these are given."""
    out = entries
    is_tag = lambda want: lambda x: F.lower(x) == F.lit(want)
    for column, value in (("kind", kind), ("package_name", package_name)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    for tag in tags or []:
        out = out.filter(F.exists("tags", is_tag(tag.lower())))
    return out


def catalog_summary(entries: DataFrame) -> DataFrame:
    """(kind, entries, packages): how many entries of each kind there are, and in how many packages."""
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("package_name").alias("packages"))


def catalog_search(entries: DataFrame, query: str, tags: list[str] | None = None) -> DataFrame:
    """Entries (name, kind, description, tags) whose text has all words of the query, and all tags."""
    text = F.lower(F.concat_ws(" ", "name", "kind", "description", F.array_join("tags", " ")))
    out = entries
    for word in query.lower().split():
        out = out.filter(text.contains(word))
    for tag in tags or []:
        out = out.filter(F.array_contains("tags", tag))
    return out


def policy_violations(entries: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, severity, name) of the entries that break rules (rule, kind, pattern, severity).

    Kinds: naming, where the whole name has to match; forbidden, where no text may; required_tag, where some tag has to begin so.
    """
    text = F.concat_ws(" ", "name", "description")
    begins = lambda start: lambda tag: tag.startswith(start)
    broken: list[Column] = []
    for rule, kind, pattern, severity in rules:
        if kind == "naming":
            breaks = ~F.col("name").rlike(f"^(?:{pattern})$")
        elif kind == "forbidden":
            breaks = text.rlike(pattern)
        elif kind == "required_tag":
            breaks = ~F.exists("tags", begins(pattern))
        else:
            raise ValueError(f"unknown policy rule {kind}")
        broken.append(F.when(breaks, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))))
    found = entries.select("name", F.explode(F.array_compact(F.array(*broken))).alias("b"))
    return found.select("b.rule", "b.severity", "name")


# Hours by complexity, simplest first.
EFFORT_HOURS = {"LOW": 0.5, "MEDIUM": 2.0, "HIGH": 8.0, "MANUAL": 16.0}


def effort(tasks: DataFrame) -> DataFrame:
    """(package_name, tasks, hours, complexity) from (package_name, complexity) of tasks; a package is as complex as its worst."""
    names = F.array(*map(F.lit, EFFORT_HOURS))
    rank = F.array_position(names, F.col("complexity")).cast("int")
    hours = F.try_element_at(F.array(*map(F.lit, EFFORT_HOURS.values())), F.nullif(rank, F.lit(0)))
    out = tasks.groupBy("package_name").agg(F.count(F.lit(1)).alias("tasks"), F.sum(hours).alias("hours"), F.max(rank).alias("_worst"))
    return out.select("package_name", "tasks", "hours", F.try_element_at(names, F.nullif("_worst", F.lit(0))).alias("complexity"))


def dependency_matrix(uses: DataFrame) -> DataFrame:
    """(left_name, right_name, shared): how many resources two packages have in common, from (package_name, resource)."""
    one = uses.select("package_name", "resource").distinct()
    a, b = one.alias("a"), one.alias("b")
    pairs = a.join(b, (F.col("a.resource") == F.col("b.resource")) & (F.col("a.package_name") < F.col("b.package_name")))
    return pairs.groupBy(F.col("a.package_name").alias("left_name"), F.col("b.package_name").alias("right_name")).agg(F.count(F.lit(1)).alias("shared"))


def shared_flows(components: DataFrame) -> DataFrame:
    """(component, packages): components of one name, case and spaces apart, in more than one package."""
    name = F.lower(F.regexp_replace("component", "[\\s_]+", ""))
    return components.groupBy(name.alias("component")).agg(F.countDistinct("package_name").alias("packages")).filter("packages > 1")
