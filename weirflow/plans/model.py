"""Packages: tasks, data flows, paths, and their reading from XML files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

from weirflow.operators.rows import AGGREGATE_CODES
from weirflow.sources import Connection
from weirflow.types import field as column_field


@dataclass
class Component:
    name: str
    type: str
    ref: str = ""
    connection: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    columns: list = field(default_factory=list)  # of outputs
    inputs: list[dict] = field(default_factory=list)
    outputs: list[dict] = field(default_factory=list)


@dataclass
class Path_:
    source: str
    output: str
    target: str
    input: str


@dataclass
class Task:
    name: str
    type: str
    ref: str = ""
    disabled: bool = False
    sql: str = ""
    expression: str = ""
    connection: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    parameters: list[tuple[int, str]] = field(default_factory=list)
    results: list[tuple[str, str]] = field(default_factory=list)
    components: list[Component] = field(default_factory=list)
    paths: list[Path_] = field(default_factory=list)
    children: list[Task] = field(default_factory=list)
    constraints: list[Constraint] | None = None
    bindings: dict[str, str] = field(default_factory=dict)  # a called package's parameter to a variable here


@dataclass
class Constraint:
    source: str
    target: str
    kind: str = "success"  # success, failure, completion
    expression: str = ""


@dataclass
class Package:
    name: str
    connections: list[Connection] = field(default_factory=list)
    variables: dict[str, object] = field(default_factory=dict)
    tasks: list[Task] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    handlers: dict[str, list[Task]] = field(default_factory=dict)


# Ends of component class ids and executable types, in lower case, and the operators they name.
COMPONENTS = {
    "oledbsource": "source", "adonetsource": "source", "odbcsource": "source", "flatfilesource": "flat_source", "excelsource": "excel_source",
    "xmlsourceadapter": "xml_source", "rawsource": "raw_source", "cdcsource": "cdc_source", "oledbdestination": "destination", "adonetdestination": "destination",
    "odbcdestination": "destination", "sqlserverdestination": "destination", "flatfiledestination": "flat_destination", "exceldestination": "flat_destination",
    "rawdestination": "raw_destination", "recordsetdestination": "recordset", "datareaderdestination": "recordset", "derivedcolumn": "derived_column",
    "conditionalsplit": "conditional_split", "dataconvert": "data_conversion", "copymap": "copy_column", "charactermap": "character_map", "lineage": "audit",
    "audit": "audit", "multicast": "multicast", "rowcount": "row_count", "oledbcommand": "oledb_command", "cdcsplitter": "cdc_split", "bdd": "balanced",
    "cache": "cache", "lookup": "lookup", "mergejoin": "merge_join", "merge": "merge", "unionall": "union_all", "sort": "sort", "aggregate": "aggregate",
    "pivot": "pivot", "unpivot": "unpivot", "percentagesampling": "percentage_sampling", "pctsampling": "percentage_sampling", "rowsampling": "row_sampling",
    "scriptcomponent": "script", "scriptcomponenthost": "script", "fuzzylookup": "fuzzy_lookup", "fuzzygrouping": "fuzzy_grouping", "termlookup": "term_lookup", "termextraction": "term_extraction", "scd": "scd",
}
TASKS = {
    "pipeline": "data_flow", "executesqltask": "execute_sql", "executepackagetask": "execute_package", "expressiontask": "expression", "sequence": "sequence",
    "foreachloop": "foreach_loop", "forloop": "for_loop", "filesystemtask": "file_system", "scripttask": "script", "sendmailtask": "send_mail",
    "executeprocess": "execute_process", "ftptask": "ftp", "webservicetask": "web_service", "xmltask": "xml", "dataprofilingtask": "data_profiling",
}
JOIN_TYPES = {"0": "full", "1": "left", "2": "inner"}


def component_type(class_id: str) -> str:
    end = re.sub(r"[^a-z]", "", class_id.lower().rpartition(".")[2])
    return COMPONENTS.get(end, "unknown")


def task_type(kind: str) -> str:
    text = re.sub(r"[^a-z.]", "", kind.lower().split(",")[0])
    for end, name in TASKS.items():
        if text.rpartition(".")[2].startswith(end) or text.startswith(f"stock:{end}") or text == end or text.startswith(f"stock{end}"):
            return name
    return "unknown"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _get(e, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if _local(k).lower() == name.lower()), default)


def _all(e, name: str):
    return [x for x in e if _local(x.tag) == name]


def _typed(value: str, kind: str):
    if kind in ("3", "20", "Int32", "Int64", "16", "17", "18", "19"):
        return int(value or 0)
    if kind in ("4", "5", "Double", "Single"):
        return float(value or 0)
    if kind in ("11", "Boolean"):
        return value.strip().lower() in ("1", "-1", "true")
    return value


def load_package(source: str | Path) -> Package:
    """A package from a file's path or its XML text."""
    text = source if isinstance(source, str) and source.lstrip().startswith("<") else Path(source).read_text(encoding="utf-8-sig")
    root = ElementTree.fromstring(text)
    out = Package(_get(root, "ObjectName", "package"))
    for group in root:
        kind = _local(group.tag)
        if kind == "ConnectionManagers":
            for c in _all(group, "ConnectionManager"):
                out.connections.append(_connection(c))
        elif kind in ("Variables", "PackageParameters"):
            out.variables |= _variables(group, "$Package" if kind == "PackageParameters" else None)
        elif kind == "Executables":
            out.tasks = [_task(t) for t in _all(group, "Executable")]
        elif kind == "PrecedenceConstraints":
            out.constraints = _constraints(group)
        elif kind == "EventHandlers":
            for h in _all(group, "EventHandler"):
                for inner in _all(h, "Executables"):
                    out.handlers[_get(h, "EventName") or _get(h, "CreationName")] = [_task(t) for t in _all(inner, "Executable")]
    return out


def load_project(folder: str | Path) -> dict[str, Package]:
    """All packages under a folder by file name, each with the project's connections and parameters, where it has none of that name.

    Parameters of Project.params are variables of the namespace $Project; connections are the .conmgr files.
    """
    folder = Path(folder)
    parameters: dict[str, object] = {}
    if (file := folder / "Project.params").exists():
        for p in _all(ElementTree.fromstring(file.read_text(encoding="utf-8-sig")), "Parameter"):
            own = {_get(x, "Name"): x.text or "" for group in _all(p, "Properties") for x in _all(group, "Property")}
            parameters[f"$Project::{_get(p, 'Name')}"] = _typed(own.get("DesignDefaultValue", own.get("Value", "")), own.get("DataType", "String"))
    shared = [_connection(ElementTree.fromstring(f.read_text(encoding="utf-8-sig"))) for f in sorted(folder.rglob("*.conmgr"))]
    out = {}
    for file in sorted(folder.rglob("*.dtsx")):
        package = load_package(file)
        known = {x for c in package.connections for x in (c.id, c.name)}
        package.connections += [c for c in shared if c.id not in known and c.name not in known]
        package.variables = parameters | package.variables
        out[file.name] = package
    return out


def _connection(c) -> Connection:
    inner = next((x for x in c.iter() if _get(x, "ConnectionString")), None)
    return Connection(_get(c, "ObjectName"), _get(c, "DTSID"), "", _get(inner, "ConnectionString") if inner is not None else "", _get(c, "CreationName"))


def _variables(group, namespace: str | None) -> dict[str, object]:
    out = {}
    for v in group:
        value = next((x for x in v.iter() if _local(x.tag) == "VariableValue"), None)
        prop = next((x for x in v.iter() if _local(x.tag) == "Property" and _get(x, "Name") == "ParameterValue"), None)
        kind = _get(value, "DataType") if value is not None else _get(v, "DataType")
        text = (value if value is not None else prop).text if (value is not None or prop is not None) else ""
        out[f"{namespace or _get(v, 'Namespace', 'User')}::{_get(v, 'ObjectName')}"] = _typed(text or "", kind)
    return out


def _constraints(group) -> list[Constraint]:
    kinds = {"0": "success", "1": "failure", "2": "completion"}
    return [Constraint(_get(c, "From"), _get(c, "To"), kinds.get(_get(c, "Value", "0"), "success"), _get(c, "Expression") if _get(c, "EvalOp", "2") != "2" else "") for c in _all(group, "PrecedenceConstraint")]


def _task(e) -> Task:
    out = Task(_get(e, "ObjectName"), task_type(_get(e, "ExecutableType") or _get(e, "CreationName")), _get(e, "refId"), _get(e, "Disabled").lower() in ("true", "1", "-1"))
    for k, v in e.attrib.items():
        out.properties[_local(k)] = v
    for x in e:
        kind = _local(x.tag)
        if kind == "Executables":
            out.children = [_task(t) for t in _all(x, "Executable")]
        elif kind == "PrecedenceConstraints":
            out.constraints = _constraints(x)
        elif kind == "ObjectData":
            for y in x.iter():
                name = _local(y.tag)
                if name == "SqlTaskData":
                    out.sql, out.connection = _get(y, "SqlStatementSource"), _get(y, "Connection")
                elif name == "ParameterBinding":
                    out.parameters.append((int(_get(y, "ParameterName", "0") or 0), _get(y, "DtsVariableName")))
                elif name == "ResultBinding":
                    out.results.append((_get(y, "ResultName"), _get(y, "DtsVariableName")))
                elif name == "ExpressionTask":
                    out.expression = _get(y, "Expression")
                elif name == "PackageName":
                    out.properties["package"] = (y.text or "").strip()
                elif name == "ParameterAssignment":
                    own = {_local(z.tag): (z.text or "").strip() for z in y}
                    out.bindings[own.get("ParameterName", "")] = own.get("BindedVariableOrParameterName", "")
                elif name == "components":
                    out.components = [_component(c) for c in _all(y, "component")]
                elif name == "paths":
                    out.paths = [_path(p) for p in _all(y, "path")]
    return out


def _component(e) -> Component:
    out = Component(_get(e, "name"), component_type(_get(e, "componentClassID")), _get(e, "refId") or _get(e, "name"))
    for group in e:
        kind = _local(group.tag)
        if kind == "properties":
            out.properties = {_get(p, "name"): p.text or "" for p in _all(group, "property")}
        elif kind == "connections":
            for c in _all(group, "connection"):
                out.connection = _get(c, "connectionManagerRefId") or _get(c, "connectionManagerID")
        elif kind in ("inputs", "outputs"):
            for port in _all(group, kind[:-1]):
                made = {"name": _get(port, "name"), "columns": [], "error": _get(port, "isErrorOut") == "true", "properties": {}}
                for part in port:
                    if _local(part.tag) == "properties":
                        made["properties"] = {_get(p, "name"): p.text or "" for p in _all(part, "property")}
                    if _local(part.tag) in ("inputColumns", "outputColumns"):
                        for c in part:
                            inner = {_get(p, "name"): p.text or "" for ps in _all(c, "properties") for p in _all(ps, "property")}
                            made["columns"].append({"name": _get(c, "name") or _get(c, "cachedName"), "type": _get(c, "dataType"), "length": int(_get(c, "length", "0") or 0), "precision": int(_get(c, "precision", "0") or 0), "scale": int(_get(c, "scale", "0") or 0), "sort": int(_get(c, "cachedSortKeyPosition", "0") or 0), "properties": inner})
                (out.inputs if kind == "inputs" else out.outputs).append(made)
    out.columns = [column_field(c["name"], c["type"], c["length"], c["precision"], c["scale"]) for o in out.outputs if not o["error"] for c in o["columns"] if c["type"]]
    return out


def _path(e) -> Path_:
    def ends(text: str, word: str) -> tuple[str, str]:
        m = re.match(rf"(.*)\.{word}\[([^\]]*)\]$", text)
        return (m[1], m[2]) if m else (text, "")

    return Path_(*ends(_get(e, "startId"), "Outputs"), *ends(_get(e, "endId"), "Inputs"))


def aggregations(component: Component) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Group keys and (column, function, name) of an aggregate component, by its columns' AggregationType."""
    keys, made = [], []
    for o in component.outputs:
        for c in o["columns"]:
            fn = AGGREGATE_CODES.get(int(c["properties"].get("AggregationType", "0") or 0), "count")
            source = re.sub(r".*\[([^\]]+)\].*", r"\1", c["properties"].get("AggregationColumnId", "")) or c["name"]
            if fn == "group_by":
                keys.append(source)
            else:
                made.append((source, fn, c["name"]))
    return keys, made
