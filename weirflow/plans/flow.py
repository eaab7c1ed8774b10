"""Data flows: components wired by paths become one DataFrame plan; sinks are the only actions."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow import sources
from weirflow.operators import dimensions, joins, rows
from weirflow.operators.rows import RunContext
from weirflow.plans.model import JOIN_TYPES, Component, Task, aggregations
from weirflow.sources import Registry

#: Operators by component type: (component, inputs by name, context, registry) to outputs by name.
Operator = Callable[[Component, dict[str, DataFrame], RunContext, Registry], dict[str, DataFrame]]
OPERATORS: dict[str, Operator] = {}
HOOKS: dict[str, list[Callable]] = {}
SCRIPTS: dict[str, Callable[[DataFrame], DataFrame]] = {}
SCRIPT_SOURCES: dict[str, tuple] = {}


def register_script(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """The function that a script component of this name stands for."""
    SCRIPTS[name] = fn


def register_script_source(name: str, schema: str, split: Callable[[], list], rows: Callable) -> None:
    """What a script component of this name reads that has no input: its columns, its parts, and the rows of a part."""
    SCRIPT_SOURCES[name] = (schema, split, rows)


def discover(group: str = "weirflow.plugins") -> list[str]:
    """Load the plugins that installed packages announce; each is called and registers what it has."""
    found = entry_points(group=group)
    for point in found:
        point.load()()
    return [point.name for point in found]


def register_operator(kind: str, fn: Operator) -> None:
    """Add an operator for a component type, or put one in the place of a built-in."""
    OPERATORS[kind] = fn


def on(event: str, fn: Callable) -> None:
    """Call ``fn`` at an event: pre_run, post_run, pre_flow, post_flow."""
    HOOKS.setdefault(event, []).append(fn)


def fire(event: str, *args) -> None:
    for fn in HOOKS.get(event, []):
        fn(*args)


def operator(kind: str):
    def add(fn):
        register_operator(kind, fn)
        return fn

    return add


class CycleError(ValueError):
    pass


def topological(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Nodes in an order that the edges allow, otherwise as given; a cycle raises."""
    waiting = {n: {a for a, b in edges if b == n} for n in nodes}
    out: list[str] = []
    while waiting:
        free = [n for n in nodes if n in waiting and not waiting[n] & waiting.keys()]
        if not free:
            raise CycleError(f"a cycle of {', '.join(waiting)}")
        for n in free:
            del waiting[n]
        out += free
    return out


def levels(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Nodes that can run at once, step by step."""
    depth: dict[str, int] = {}
    for n in topological(nodes, edges):
        depth[n] = 1 + max((depth[a] for a, b in edges if b == n), default=-1)
    return [[n for n in nodes if depth[n] == k] for k in range(max(depth.values(), default=-1) + 1)]


#: Components that write what reaches them.
SINKS = ("destination", "flat_destination", "raw_destination")


def run_flow(task: Task, ctx: RunContext, registry: Registry) -> dict[str, DataFrame]:
    """Compile a data flow and run its sinks; the outputs of the recordset destinations by name.

    What several paths lead on from is computed once: its rows are kept until the flow has ended. Row counts that no sink
    stands behind are run on their own.
    """
    fire("pre_flow", task)
    by_ref = {c.ref: c for c in task.components}
    find = lambda ref: ref if ref in by_ref else next((c.ref for c in task.components if ref.endswith(c.name)), ref)
    paths = [(find(p.source), p.output, find(p.target), p.input) for p in task.paths]
    made: dict[str, dict[str, DataFrame]] = {}
    kept: dict[str, DataFrame] = {}
    held: list[DataFrame] = []
    counted: set[str] = set()
    try:
        for ref in topological(list(by_ref), [(a, b) for a, _, b, _ in paths]):
            c = by_ref[ref]
            inputs = {}
            for a, output, b, name in paths:
                if b == ref:
                    outputs = made[a]
                    inputs[name or f"input{len(inputs)}"] = outputs.get(output) if output in outputs else next(iter(outputs.values()))
            if sum(a == ref for a, *_ in paths) > 1 and inputs:
                inputs = {k: df if df.is_cached else df.persist() for k, df in inputs.items()}
                held += inputs.values()
            fn = OPERATORS.get(c.type)
            if fn is None:
                raise ValueError(f"no operator for component {c.name} ({c.type})")
            made[ref] = fn(c, inputs, ctx, registry)
            if not inputs and sum(a == ref for a, *_ in paths) > 1:
                made[ref] = {k: df.persist() for k, df in made[ref].items()}
                held += made[ref].values()
            if c.type == "row_count" or counted & {a for a, _, b, _ in paths if b == ref}:
                counted.add(ref)
                if c.type not in SINKS and not any(a == ref for a, *_ in paths):
                    for df in made[ref].values():
                        df.write.format("noop").mode("overwrite").save()
            if c.type == "recordset":
                kept[c.name] = next(iter(inputs.values()))
    finally:
        for df in held:
            df.unpersist()
    fire("post_flow", task)
    return kept


def _one(inputs: dict[str, DataFrame]) -> DataFrame:
    return next(iter(inputs.values()))


def _name(c: Component) -> str:
    return next((o["name"] for o in c.outputs if not o["error"]), "output")


@operator("source")
def _source(c, inputs, ctx, registry):
    query, table = c.properties.get("SqlCommand"), c.properties.get("OpenRowset") or c.properties.get("TableOrViewName")
    return {_name(c): sources.read_database(registry, registry.connection(c.connection), query or None, table)}


@operator("flat_source")
def _flat_source(c, inputs, ctx, registry):
    connection = registry.connection(c.connection)
    path = c.properties.get("_file_path") or (connection.connection_string if connection else "")
    from pyspark.sql.types import StructType

    return {_name(c): sources.read_flat(registry.spark, path, StructType(c.columns) if c.columns else None)}


@operator("excel_source")
def _excel_source(c, inputs, ctx, registry):
    from pyspark.sql.types import StructType

    connection = registry.connection(c.connection)
    text = c.properties.get("_file_path") or (connection.connection_string if connection else "")
    named = re.search(r"Data Source=([^;]+)", text, re.I)
    return {_name(c): sources.read_excel(registry.spark, named[1] if named else text, StructType(c.columns), c.properties.get("OpenRowset") or "Sheet1")}


@operator("script")
def _script(c, inputs, ctx, registry):
    if not inputs and c.name in SCRIPT_SOURCES:
        return {_name(c): sources.script_source(registry.spark, c.name, *SCRIPT_SOURCES[c.name])}
    fn = SCRIPTS.get(c.name)
    if fn is None:
        raise ValueError(f"no function for script component {c.name}")
    return {_name(c): rows.script_component(_one(inputs), fn)}


@operator("raw_source")
def _raw_source(c, inputs, ctx, registry):
    return {_name(c): sources.read_raw(registry.spark, c.properties["FileName"])}


@operator("xml_source")
def _xml_source(c, inputs, ctx, registry):
    return {_name(c): sources.read_xml(registry.spark, c.properties["XMLData"], c.properties.get("rowTag", "row"))}


@operator("cdc_source")
def _cdc_source(c, inputs, ctx, registry):
    return {_name(c): sources.read_cdc(registry, registry.connection(c.connection), c.properties.get("OpenRowset") or c.properties.get("TableName"), c.properties.get("SqlCommand") or None)}


@operator("destination")
def _destination(c, inputs, ctx, registry):
    table, connection = c.properties.get("OpenRowset") or c.properties.get("TableOrViewName") or c.name, registry.connection(c.connection)
    wanted = [x["name"] for i in c.inputs for x in i["columns"]]
    df = _one(inputs)
    df = sources.map_columns(df.select(*[x for x in df.columns if not wanted or x.lower() in {w.lower() for w in wanted}]), wanted)
    if connection and connection.url:
        sources.write_database(df, connection, table)
    else:
        # Inside a transaction and where versions are logged each write has a folder of its own, so that names alone tell what counts.
        path = registry.new_folder(table) if ctx.transaction or registry.log else f"{registry.folder}/{sources.clean_name(table)}"
        sources.write_table(df, path)
        registry.attach(table, path)
    return {}


@operator("flat_destination")
def _flat_destination(c, inputs, ctx, registry):
    connection = registry.connection(c.connection)
    sources.write_flat(_one(inputs), c.properties.get("_file_path") or (connection.connection_string if connection else f"{registry.folder}/{c.name}"))
    return {}


@operator("raw_destination")
def _raw_destination(c, inputs, ctx, registry):
    sources.write_table(_one(inputs), c.properties.get("FileName") or f"{registry.folder}/{c.name}", "overwrite")
    return {}


@operator("recordset")
def _recordset(c, inputs, ctx, registry):
    df = _one(inputs)
    if variable := c.properties.get("VariableName"):
        ctx.variables[variable] = df
    return {"output": df}


def _expression_of(column: dict) -> str:
    return column["properties"].get("FriendlyExpression") or column["properties"].get("Expression", "")


@operator("derived_column")
def _derived(c, inputs, ctx, registry):
    columns = [(x["name"], _expression_of(x)) for o in c.outputs if not o["error"] for x in o["columns"]]
    columns += [(x["name"], _expression_of(x)) for i in c.inputs for x in i["columns"] if _expression_of(x)]
    return {_name(c): rows.derived_column(_one(inputs), columns, ctx)}


@operator("conditional_split")
def _split(c, inputs, ctx, registry):
    ordered = sorted((o for o in c.outputs if not o["error"] and (o["properties"].get("FriendlyExpression") or o["properties"].get("Expression"))), key=lambda o: int(o["properties"].get("EvaluationOrder", 0) or 0))
    default = next((o["name"] for o in c.outputs if not o["error"] and o not in ordered), "default")
    return rows.conditional_split(_one(inputs), [(o["name"], o["properties"].get("FriendlyExpression") or o["properties"]["Expression"]) for o in ordered], default, ctx)


def _source_name(x: dict, key: str) -> str:
    return re.sub(r".*\[([^\]]+)\]\}?$", r"\1", x["properties"].get(key, "")) or x["name"]


@operator("data_conversion")
def _convert(c, inputs, ctx, registry):
    columns = [(_source_name(x, "SourceInputColumnLineageID"), x["name"], x["type"]) for o in c.outputs if not o["error"] for x in o["columns"]]
    sizes = {x["name"]: ((x["precision"], x["scale"]) if x["type"] == "numeric" else (x["scale"],)) for o in c.outputs for x in o["columns"] if x["type"] in ("numeric", "decimal")}
    return {_name(c): rows.data_conversion(_one(inputs), columns, c.properties.get("ErrorDisposition") == "IgnoreFailure", **sizes)}


@operator("copy_column")
def _copy(c, inputs, ctx, registry):
    return {_name(c): rows.copy_column(_one(inputs), [(_source_name(x, "CopyColumnId"), x["name"]) for o in c.outputs if not o["error"] for x in o["columns"]])}


@operator("character_map")
def _character(c, inputs, ctx, registry):
    return {_name(c): rows.character_map(_one(inputs), [(_source_name(x, "InputColumnLineageId"), x["properties"].get("MapFlags", "upper"), x["name"]) for o in c.outputs if not o["error"] for x in o["columns"]])}


@operator("audit")
def _audit(c, inputs, ctx, registry):
    return {_name(c): rows.audit(_one(inputs), None, ctx)}


@operator("multicast")
def _multicast(c, inputs, ctx, registry):
    return rows.multicast(_one(inputs), [o["name"] for o in c.outputs] or ["output"])


@operator("row_count")
def _row_count(c, inputs, ctx, registry):
    return {_name(c): rows.row_count(_one(inputs), c.properties.get("VariableName", c.name), ctx)}


@operator("cdc_split")
def _cdc_split(c, inputs, ctx, registry):
    out = rows.cdc_split(_one(inputs))
    return out | {o["name"]: out[k] for o in c.outputs for k in out if k in o["name"].lower()}


@operator("balanced")
def _balanced(c, inputs, ctx, registry):
    df = rows.balanced_distributor(_one(inputs), int(c.properties.get("_partitions", 8)))
    return {o["name"]: df for o in c.outputs} or {"output": df}


@operator("cache")
def _cache(c, inputs, ctx, registry):
    return {_name(c): rows.cache_transform(_one(inputs), re.sub(r"\W", "_", c.connection or c.name))}


@operator("lookup")
def _lookup(c, inputs, ctx, registry):
    df = _one(inputs)
    ref = sources.read_database(registry, registry.connection(c.connection), c.properties.get("SqlCommand") or None, c.properties.get("OpenRowset") or c.properties.get("TableName"))
    keys = [(x["name"], x["properties"]["JoinToReferenceColumn"]) for i in c.inputs for x in i["columns"] if x["properties"].get("JoinToReferenceColumn")]
    taken = [(x["properties"].get("CopyFromReferenceColumn") or x["name"], x["name"]) for o in c.outputs if not o["error"] for x in o["columns"]]
    redirect = c.properties.get("NoMatchBehavior") == "1"
    out = joins.lookup(df, ref, keys, taken, "redirect" if redirect else "ignore")
    named = {o["name"]: out["no_match" if "no match" in o["name"].lower() else "match"] for o in c.outputs if not o["error"] and ("no match" not in o["name"].lower() or redirect)}
    return named or out


@operator("merge_join")
def _merge_join(c, inputs, ctx, registry):
    sides = list(inputs.values())
    sorted_keys = [[x["name"] for x in sorted(i["columns"], key=lambda x: abs(x["sort"])) if x["sort"]] for i in c.inputs]
    kind = c.properties.get("JoinType", "2")
    columns = []
    for o in c.outputs:
        for x in o["columns"]:
            source = _source_name(x, "InputColumnID")
            side = "left" if source in sides[0].columns and "Right" not in x["properties"].get("InputColumnID", "") else "right"
            columns.append((side, source, x["name"]))
    return {_name(c): joins.merge_join(sides[0], sides[1], list(zip(*sorted_keys, strict=True)), JOIN_TYPES.get(kind, kind), columns)}


@operator("union_all")
def _union(c, inputs, ctx, registry):
    return {_name(c): rows.union_all(list(inputs.values()))}


@operator("merge")
def _merge(c, inputs, ctx, registry):
    a, b = list(inputs.values())[:2]
    keys = rows.sort_positions({x["name"]: x["sort"] for x in c.inputs[0]["columns"]}) if c.inputs else []
    return {_name(c): rows.merge(a, b, keys) if keys else rows.union_all([a, b])}


@operator("sort")
def _sort(c, inputs, ctx, registry):
    positions = {x["name"]: int(x["properties"].get("NewSortKeyPosition") or x["properties"].get("SortKeyPosition") or 0) for i in c.inputs for x in i["columns"]}
    return {_name(c): rows.sort(_one(inputs), rows.sort_positions(positions), c.properties.get("EliminateDuplicates", "").lower() == "true")}


@operator("aggregate")
def _aggregate(c, inputs, ctx, registry):
    keys, made = aggregations(c)
    return {_name(c): rows.aggregate(_one(inputs), keys, made)}


@operator("unpivot")
def _unpivot(c, inputs, ctx, registry):
    values = [x["name"] for i in c.inputs for x in i["columns"] if x["properties"].get("PivotKeyValue") or x["properties"].get("DestinationColumn")]
    df = _one(inputs)
    return {_name(c): rows.unpivot(df, [x for x in df.columns if x not in values], values)}


@operator("pivot")
def _pivot(c, inputs, ctx, registry):
    use = {x["properties"].get("PivotUsage"): x["name"] for i in c.inputs for x in i["columns"]}
    values = [x["properties"]["PivotKeyValue"] for o in c.outputs for x in o["columns"] if x["properties"].get("PivotKeyValue")]
    return {_name(c): rows.pivot(_one(inputs), [use["1"]], use["2"], values, use["3"])}


@operator("percentage_sampling")
def _percent(c, inputs, ctx, registry):
    out = rows.percentage_sampling(_one(inputs), float(c.properties.get("SamplingValue", 10)), int(c.properties.get("SamplingSeed", 42)))
    return {o["name"]: out["unselected" if "un" in o["name"].lower() else "selected"] for o in c.outputs} or out


@operator("row_sampling")
def _row_sampling(c, inputs, ctx, registry):
    df = _one(inputs)
    out = rows.row_sampling(df, c.properties.get("_key", df.columns[0]), int(c.properties.get("SamplingValue", 1000)))
    return {o["name"]: out["unselected" if "un" in o["name"].lower() else "selected"] for o in c.outputs} or out


@operator("fuzzy_lookup")
def _fuzzy_lookup(c, inputs, ctx, registry):
    ref = registry.table(c.properties["ReferenceTableName"])
    column = next(x["name"] for i in c.inputs for x in i["columns"] if x["properties"].get("JoinToReferenceColumn"))
    ref_column = next(x["properties"]["JoinToReferenceColumn"] for i in c.inputs for x in i["columns"] if x["properties"].get("JoinToReferenceColumn"))
    df = _one(inputs)
    return {_name(c): joins.fuzzy_lookup(df, ref, column, ref_column, min_similarity=float(c.properties.get("MinSimilarity", 0.5)))}


@operator("fuzzy_grouping")
def _fuzzy_grouping(c, inputs, ctx, registry):
    df = _one(inputs)
    column = next((x["name"] for i in c.inputs for x in i["columns"]), df.columns[0])
    return {_name(c): joins.fuzzy_grouping(df, column, float(c.properties.get("MinSimilarity") or 0.8))}


@operator("term_lookup")
def _term_lookup(c, inputs, ctx, registry):
    df = _one(inputs)
    return {_name(c): joins.term_lookup(df, registry.table(c.properties["RefTermTable"]), c.inputs[0]["columns"][0]["name"], c.properties["RefTermColumn"], df.columns[0])}


@operator("term_extraction")
def _term_extraction(c, inputs, ctx, registry):
    return {_name(c): joins.term_extraction(_one(inputs), c.inputs[0]["columns"][0]["name"], int(c.properties.get("FrequencyThreshold", 2)))}


@operator("oledb_command")
def _command(c, inputs, ctx, registry):
    sql, df = c.properties["SqlCommand"], _one(inputs)
    table = sources.clean_name(re.search(r"(?:UPDATE|FROM|DELETE)\s+([\w.\[\]]+)", sql, re.I)[1])
    parameters = [x["name"] for i in c.inputs for x in i["columns"]]
    registry.put(table, dimensions.oledb_command(registry.table(table), df, sql, parameters))
    return {_name(c): df}


@operator("scd")
def _scd(c, inputs, ctx, registry):
    df = _one(inputs)
    keys = [k for k in c.properties.get("_business_keys", "").split(",") if k]
    tracked = [k for k in c.properties.get("_scd2_columns", "").split(",") if k]
    target = registry.table(c.properties["_table"])
    if tracked:
        return {_name(c): dimensions.scd2(df, target, keys, tracked, ctx.now)}
    return {_name(c): dimensions.scd1(df, target, keys, [k for k in c.properties.get("_scd1_columns", "").split(",") if k])}


def literal_row(registry: Registry, values: dict) -> DataFrame:
    return registry.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
