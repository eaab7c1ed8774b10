"""Control flow: tasks in the order of their constraints, with loops, parameters, results and event handlers."""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree import ElementTree

from weirflow.functions import compile_expression
from weirflow.operators.quality import profile
from weirflow.operators.rows import RunContext
from weirflow.plans.flow import fire, run_flow, topological
from weirflow.plans.model import Constraint, Package, Task
from weirflow.sources import Registry, file_operation, list_files

TASK_HANDLERS: dict[str, Callable[[Task, RunContext, Registry], None]] = {}


def register_task(kind: str, fn: Callable[[Task, RunContext, Registry], None]) -> None:
    """Run tasks of a kind that has no meaning of its own here: mail, processes, scripts, services."""
    TASK_HANDLERS[kind] = fn


def evaluate(text: str, ctx: RunContext, registry: Registry):
    """The value of an expression of variables, by a plan of one row."""
    row = registry.spark.range(1).select("id")
    return row.select(compile_expression(text, row.schema, {k: v for k, v in ctx.variables.items() if isinstance(v, (str, int, float, bool)) or v is None or hasattr(v, "isoformat")}, ctx.now).alias("v")).first()["v"]


def plain_name(file: str) -> str:
    """A package's name without its extension and leading number, in lower case."""
    return re.sub(r"^\d+[_\-. ]*", "", re.sub(r"\.dtsx$", "", file, flags=re.I)).lower()


class Runner:
    def __init__(self, registry: Registry, ctx: RunContext | None = None, packages: dict[str, Package] | None = None):
        self.registry, self.ctx, self.packages = registry, ctx or RunContext(), packages or {}
        self.log: list[tuple[str, str]] = []

    def run(self, package: Package) -> dict[str, str]:
        """Run a package; the state of each task: succeeded, failed or skipped.

        OnPreExecute handlers run before the tasks, OnTaskFailed and OnError after a failure, OnPostExecute in the end.
        """
        fire("pre_run", package)
        for c in package.connections:
            self.registry.add(c)
        self.ctx.variables = package.variables | self.ctx.variables
        if "OnPreExecute" in package.handlers:
            self.tasks(package.handlers["OnPreExecute"], [])
        states = self.tasks(package.tasks, package.constraints)
        for event, wanted in (("OnTaskFailed", "failed"), ("OnError", "failed"), ("OnPostExecute", None)):
            if event in package.handlers and (wanted is None or wanted in states.values()):
                self.tasks(package.handlers[event], [])
        fire("post_run", package)
        return states

    def tasks(self, tasks: list[Task], constraints: list[Constraint] | None) -> dict[str, str]:
        """Without a list of constraints tasks run in turn; with one, by it, all of a task's constraints having to hold."""
        if constraints is None:
            constraints = [Constraint(a.name, b.name) for a, b in zip(tasks, tasks[1:], strict=False)]
        names = {}
        for t in tasks:
            for key in (t.ref, t.name):
                if key:
                    names.setdefault(key, t.name)
        edges = [(names.get(c.source, c.source), names.get(c.target, c.target), c) for c in constraints]
        by_name = {t.name: t for t in tasks}
        states: dict[str, str] = {}
        for name in topological(list(by_name), [(a, b) for a, b, _ in edges]):
            states[name] = self.one(by_name[name], [self.holds(states.get(a, "skipped"), c) for a, b, c in edges if b == name])
        return states

    def holds(self, state: str, c: Constraint) -> bool:
        ran = {"success": state in ("succeeded", "disabled"), "failure": state == "failed", "completion": state in ("succeeded", "failed", "disabled")}[c.kind]
        return ran and (not c.expression or bool(evaluate(c.expression, self.ctx, self.registry)))

    def one(self, task: Task, allowed: list[bool]) -> str:
        if task.disabled:
            state = "disabled"
        elif not all(allowed):
            state = "skipped"
        else:
            try:
                self.execute(task)
                state = "succeeded"
            except Exception as e:  # a task's failure is a state that constraints ask for
                self.ctx.variables["System::ErrorDescription"] = str(e)
                state = "failed"
        self.log.append((task.name, state))
        return state

    def inner(self, task: Task) -> None:
        failed = [n for n, s in self.tasks(task.children, task.constraints or []).items() if s == "failed"]
        if failed:
            raise RuntimeError(f"failed inside {task.name}: {', '.join(failed)}")

    def execute(self, task: Task) -> None:
        """Run a task; one that requires a transaction leaves no registered table changed if it fails.

        Writes make new versions of tables, so names are put back. Rows that a database has taken over JDBC stay there.
        """
        if task.properties.get("TransactionOption") not in ("2", "Required") or self.ctx.transaction:
            self.perform(task)
            return
        self.ctx.transaction = True
        try:
            with self.registry.transaction():
                self.perform(task)
        finally:
            self.ctx.transaction = False

    def perform(self, task: Task) -> None:
        ctx, registry = self.ctx, self.registry
        if task.type in TASK_HANDLERS:
            TASK_HANDLERS[task.type](task, ctx, registry)
        elif task.type == "data_flow":
            try:
                run_flow(task, ctx, registry)
            except Exception:
                ctx.counts.clear()
                raise
            for name, seen in ctx.counts.items():
                ctx.variables[name] = seen.get["n"]
            ctx.counts.clear()
        elif task.type == "execute_sql":
            args = [ctx.variables[v] for _, v in sorted(task.parameters)]
            result = registry.sql(task.sql, args)
            for (_, v), value in zip(sorted(task.parameters), args, strict=True):
                ctx.variables[v] = value  # OUTPUT parameters of procedures
            if task.results:
                row = result.first()
                for k, (name, variable) in enumerate(task.results):
                    ctx.variables[variable] = row[int(name)] if name.isdigit() else (row[name] if name in row else row[k])
        elif task.type == "expression":
            name, _, text = task.expression.partition("=")
            ctx.variables[name.strip().removeprefix("@").strip("[]")] = evaluate(text, ctx, registry)
        elif task.type == "sequence":
            self.inner(task)
        elif task.type == "for_loop":
            p = task.properties
            assign = lambda text: self.execute(Task("assign", "expression", expression=text))
            if p.get("InitExpression"):
                assign(p["InitExpression"])
            while evaluate(p.get("EvalExpression", "TRUE"), ctx, registry):
                self.inner(task)
                if p.get("AssignExpression"):
                    assign(p["AssignExpression"])
        elif task.type == "foreach_loop":
            for item in self.items(task):
                values = item if isinstance(item, tuple) else (item,)
                for variable, value in zip(task.properties.get("variables", "").split(","), values, strict=False):
                    if variable:
                        ctx.variables[variable.strip()] = value
                self.inner(task)
        elif task.type == "execute_package":
            name = plain_name(task.properties.get("package", ""))
            child = next((p for k, p in self.packages.items() if plain_name(k) == name), None)
            if child is None:
                raise ValueError(f"unknown package {name}")
            # Bound parameters and the project's own; without any bindings the child sees all that its parent has.
            given = dict(ctx.variables)
            if task.bindings:
                given = {k: v for k, v in ctx.variables.items() if k.startswith("$Project::")}
                given |= {k if "::" in k else f"$Package::{k}": ctx.variables[v if "::" in v else f"User::{v}"] for k, v in task.bindings.items()}
            inner = Runner(registry, RunContext(given, ctx.now, child.name, transaction=ctx.transaction), self.packages)
            if "failed" in inner.run(child).values():
                raise RuntimeError(f"package {name} failed")
        elif task.type == "data_profiling":
            table = task.properties["table"]
            registry.tables[task.properties.get("output", f"{table}_profile")] = profile(registry.table(table))
        elif task.type == "file_system":
            file_operation(registry.spark, task.properties.get("operation", ""), task.properties.get("source", ""), task.properties.get("target", ""))
        else:
            raise NotImplementedError(f"no handler for task {task.name} ({task.type})")

    def items(self, task: Task):
        p = task.properties
        kind = p.get("enumerator", "item")
        if kind == "file":
            return list_files(self.registry.spark, p["folder"], p.get("files", "*"))
        if kind == "nodelist":
            return [n.text or "" for n in ElementTree.fromstring(p["source"]).findall(p.get("xpath", "*"))]
        if kind == "ado":
            return (tuple(r) for r in self.ctx.variables[p["source"]].toLocalIterator())
        if kind == "smo":  # the objects of a server: here the registered tables, or the columns of one
            return sorted(self.registry.tables) if not p.get("source") else list(self.registry.table(p["source"]).columns)
        if kind == "variable":
            return list(self.ctx.variables[p["source"]])
        return [x.strip() for x in p.get("items", "").split(",") if x.strip()]
