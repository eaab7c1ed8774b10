"""Pass-through statements in T-SQL, run as Spark queries over the tables of a registry.

A batch is cut into tokens, so texts, quoted names and comments are never taken for keywords. Parameters are numbered as they
stand in the batch and bound by name, so they keep their values wherever their clause ends up. Only the frame of a statement
is read here, clause by clause; expressions and queries are handed on to Spark. What no clause takes is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>[nN]?'(?:[^']|'')*')|(?P<quoted>\[[^\]]+\]|"[^"]+"|`[^`]+`)|(?P<mark>\?)
    |(?P<variable>@@?\w+)|(?P<word>[^\W\d][\w$\#]*|\#\w+)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<sign><>|<=|>=|!=|\|\||[-+*/%=<>(),.;|&^~:!])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    """``gap`` tells of a blank or a comment before it."""

    kind: str
    text: str
    gap: bool = False

    @property
    def key(self) -> str:
        """A word in upper case, a sign as it is; empty for texts and quoted names, which are no keywords."""
        return self.text.upper() if self.kind in ("word", "sign") else ""

    @property
    def name(self) -> str:
        return self.text[1:-1] if self.kind == "quoted" else self.text


def tokens(text: str) -> list[Token]:
    """The tokens of a batch without blanks and comments; a parameter's text is its number."""
    out, at, marks, gap = [], 0, 0, False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no statement can hold {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, str(marks) if m.lastgroup == "mark" else m[0], gap))
            marks += m.lastgroup == "mark"
        gap = m.lastgroup == "space"
    return out


def depths(body: list[Token]) -> list[int]:
    """How many brackets are open at each token, its own apart."""
    out, now = [], 0
    for x in body:
        now -= x.key == ")"
        out.append(now)
        now += x.key == "("
    return out


def parted(body: list[Token], sign: str) -> list[list[Token]]:
    """The parts between signs that stand in no bracket."""
    out: list[list[Token]] = [[]]
    for x, depth in zip(body, depths(body), strict=True):
        if x.key == sign and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return out


def statements(body: list[Token]) -> list[list[Token]]:
    """The statements of a batch; what BEGIN and END enclose is one with its head."""
    out: list[list[Token]] = [[]]
    nested = 0
    for k, x in enumerate(body):
        following = body[k + 1].key if k + 1 < len(body) else ""
        nested += x.key == "CASE" or (x.key == "BEGIN" and not following.startswith("TRAN"))
        nested -= x.key == "END"
        if (x.key == ";" or x.key == "GO") and nested <= 0:
            out.append([])
        else:
            out[-1].append(x)
    # An ELSE that follows a closed branch belongs to the statement before it.
    whole: list[list[Token]] = []
    for s in out:
        if s and s[0].key == "ELSE" and whole:
            whole[-1] = [*whole[-1], *s]
        elif s:
            whole.append(s)
    return whole


class Reader:
    """A place among the tokens of a statement."""

    def __init__(self, body: list[Token]):
        self.body, self.at, self.depth = body, 0, depths(body)

    def more(self) -> bool:
        return self.at < len(self.body)

    def sees(self, *keys: str) -> bool:
        return [x.key for x in self.body[self.at : self.at + len(keys)]] == list(keys)

    def skip(self, *keys: str) -> bool:
        found = self.sees(*keys)
        self.at += len(keys) * found
        return found

    def want(self, *keys: str) -> None:
        if not self.skip(*keys):
            raise ValueError(f"{' '.join(keys)} is wanted at: {shown(self.body[self.at :])}")

    def name(self) -> str:
        """A name of one or several parts, as it is registered."""
        parts = []
        while self.more() and self.body[self.at].kind in ("word", "quoted"):
            parts.append(self.body[self.at].name)
            self.at += 1
            if not self.skip("."):
                break
        if not parts:
            raise ValueError(f"a name is wanted at: {shown(self.body[self.at :])}")
        return ".".join(parts).lower()

    def alias(self, *ends: str) -> str | None:
        """A further name, with or without AS, that is none of the keywords that may come next."""
        named = self.skip("AS")
        if self.more() and self.body[self.at].kind in ("word", "quoted") and (named or self.body[self.at].key not in ends):
            self.at += 1
            return self.body[self.at - 1].name.lower()
        return None

    def bracket(self) -> list[Token]:
        """What stands between the bracket here and the one that closes it."""
        self.want("(")
        start = self.at
        end = next((k for k in range(start, len(self.body)) if self.body[k].key == ")" and self.depth[k] == self.depth[start - 1]), None)
        if end is None:
            raise ValueError("a bracket is not closed")
        self.at = end + 1
        return self.body[start:end]

    def until(self, *ends: str) -> list[Token]:
        """Everything up to a keyword of this depth that ends a clause; CASE .. END is passed over whole."""
        start, depth, cases = self.at, self.depth[self.at] if self.more() else 0, 0
        while self.more():
            x = self.body[self.at]
            if x.key in ends and self.depth[self.at] == depth and not cases:
                break
            cases += (x.key == "CASE") - (x.key == "END")
            self.at += 1
        return self.body[start : self.at]

    def rest(self) -> list[Token]:
        out, self.at = self.body[self.at :], len(self.body)
        return out

    def end(self) -> None:
        if self.more():
            raise ValueError(f"not understood: {shown(self.body[self.at :])}")


def shown(body: list[Token]) -> str:
    return " ".join(x.text for x in body[:12]) or "the end"


#: Functions by their T-SQL name where Spark has them under another.
_RENAMED = {"ISNULL": "coalesce", "GETDATE": "current_timestamp", "SYSDATETIME": "current_timestamp", "GETUTCDATE": "current_timestamp", "NEWID": "uuid"}


@dataclass
class Session:
    """What the statements of a batch share: parameters, variables and the last identity."""

    registry: object
    args: list
    variables: dict[str, object] = field(default_factory=dict)
    identity: int | None = None
    undo: dict | None = None

    # ---- text for Spark

    def text(self, body: list[Token]) -> str:
        """The tokens in Spark's dialect; tables that they name become views."""
        out: list[str] = []
        k = 0
        while k < len(body):
            x, last = body[k], k
            if x.kind in ("word", "quoted"):
                while last + 2 < len(body) and body[last + 1].key == "." and body[last + 2].kind in ("word", "quoted"):
                    last += 2
                parts = [y.name for y in body[k : last + 1 : 2]]
                if x.key == "SCOPE_IDENTITY":
                    made, last = f"CAST({'NULL' if self.identity is None else self.identity} AS BIGINT)", last + 2
                elif x.key in _RENAMED and last == k and last + 1 < len(body) and body[last + 1].key == "(":
                    made = _RENAMED[x.key]
                else:
                    made = self.named(parts, x.kind == "word" and len(parts) == 1)
            elif x.kind == "text":
                raw = x.text[x.text.index("'") + 1 : -1].replace("''", "'")
                made = "'" + raw.replace("\\", "\\\\").replace("'", "\\'") + "'"
            elif x.kind == "mark":
                made = f":p{x.text}"
            elif x.kind == "variable":
                if x.text.lower() not in self.variables:
                    raise ValueError(f"unknown variable {x.text}")
                made = f":{_bound(x.text.lower())}"
            else:
                made = x.text
            out.append((" " if x.gap and out else "") + made)
            k = last + 1
        return _limited("".join(out))

    def named(self, parts: list[str], plain: bool) -> str:
        """A name; where its first parts are a registered table they give way to that table's view."""
        for n in range(len(parts), 0, -1):
            key = self.registry.key(".".join(parts[:n]))
            if key in self.registry.tables and (n > 1 or key == parts[0].lower() or key == f"dbo.{parts[0].lower()}"):
                return ".".join([self.view(key), *[f"`{p}`" for p in parts[n:]]])
        if len(parts) > 1 and parts[0].lower() == "dbo":
            parts, plain = parts[1:], False
        return parts[0] if plain else ".".join(f"`{p}`" for p in parts)

    def view(self, key: str) -> str:
        name = re.sub(r"\W", "_", key.removeprefix("dbo."))
        self.registry.table(key).createOrReplaceTempView(name)
        return name

    def run(self, sql: str) -> DataFrame:
        used = set(re.findall(r":(\w+)", sql))
        args = {f"p{k}": v for k, v in enumerate(self.args)} | {_bound(k): v for k, v in self.variables.items()}
        missing = [u for u in used if re.fullmatch(r"p\d+", u) and u not in args]
        if missing:
            raise ValueError(f"{len(self.args)} parameters are given, number {int(missing[0][1:]) + 1} is used")
        return self.registry.spark.sql(sql, args={k: v for k, v in args.items() if k in used})

    def value(self, body: list[Token]):
        return self.run(f"SELECT {self.text(body)} AS v").first()["v"]

    # ---- statements

    def execute(self, body: list[Token]) -> DataFrame | None:
        """Run a statement; the rows of a query, None otherwise."""
        body = _without_hints(body)
        r = Reader(body)
        if r.skip("BEGIN"):
            if r.skip("TRAN") or r.skip("TRANSACTION"):
                self.undo = dict(self.registry.tables)
                return r.end()
            inside = r.rest()
            if inside[-1].key != "END":
                raise ValueError("BEGIN without END")
            return self.all(statements(inside[:-1]))
        if r.skip("COMMIT") or r.skip("ROLLBACK"):
            if body[0].key == "ROLLBACK" and self.undo is not None:
                self.registry.tables.clear()
                self.registry.tables.update(self.undo)
            self.undo = None
            r.skip("TRAN") or r.skip("TRANSACTION")
            return r.end()
        for keys, fn in _FORMS:
            if r.skip(*keys):
                return fn(self, r)
        if not (r.sees("SELECT") or r.sees("WITH") or r.sees("(")):
            raise ValueError(f"not understood: {shown(body)}")
        return self.select(body)

    def all(self, parts: list[list[Token]]) -> DataFrame | None:
        out = None
        for s in parts:
            found = self.execute(s)
            out = out if found is None else found
        return out

    def select(self, body: list[Token]) -> DataFrame | None:
        r = Reader(body)
        if r.skip("SELECT") and r.more() and r.body[r.at].kind == "variable" and r.body[r.at + 1 : r.at + 2] and r.body[r.at + 1].key == "=":
            given = [_assignment(part) for part in parted(r.until("FROM"), ",")]
            row = self.run(f"SELECT {', '.join(f'{self.text(x)} AS _{k}' for k, (_, x) in enumerate(given))} {self.text(r.rest())}").first()
            if row is not None:
                self.variables |= {name: row[k] for k, (name, _) in enumerate(given)}
            return None
        if body[0].key == "SELECT":  # SELECT .. INTO makes a table
            r = Reader(body)
            head = r.until("INTO", "FROM")
            if r.skip("INTO"):
                name = r.name()
                if self.registry.key(name) in self.registry.tables:
                    raise ValueError(f"{name} is there already")
                self.registry.put(name, self.run(self.text([*head, *r.rest()])))
                return None
        return self.run(self.text(body))

    def declare(self, r: Reader) -> None:
        for part in parted(r.rest(), ","):
            if not part or part[0].kind != "variable":
                raise ValueError(f"not understood: DECLARE {shown(part)}")
            value = next((k for k, x in enumerate(part) if x.key == "="), None)
            self.variables[part[0].text.lower()] = None if value is None else self.value(part[value + 1 :])

    def assign(self, r: Reader) -> None:
        body = r.rest()
        if not body or body[0].kind != "variable":
            if body and body[0].key in ("NOCOUNT", "XACT_ABORT", "ANSI_NULLS", "QUOTED_IDENTIFIER"):
                return
            raise ValueError(f"not understood: SET {shown(body)}")
        name, value = _assignment(body)
        self.variables[name] = self.value(value)

    def branch(self, r: Reader) -> DataFrame | None:
        """IF a condition holds the statement after it, else that after ELSE."""
        condition = []
        depth = 0
        while r.more():
            x = r.body[r.at]
            if not depth and condition and x.key in _HEADS:
                break
            depth += (x.key == "(") - (x.key == ")")
            condition.append(x)
            r.at += 1
        then = r.until("ELSE") if not r.sees("BEGIN") else self.block(r)
        other = r.rest()[1:] if r.sees("ELSE") else []
        r.end()
        holds = self.run(f"SELECT 1 AS one WHERE {self.text(condition)}").first() is not None
        chosen = then if holds else other
        return self.execute(chosen) if chosen else None

    def block(self, r: Reader) -> list[Token]:
        start, nested = r.at, 0
        while r.more():
            key = r.body[r.at].key
            nested += key in ("BEGIN", "CASE")
            nested -= key == "END"
            r.at += 1
            if not nested:
                break
        return r.body[start : r.at]

    def call(self, r: Reader) -> DataFrame | None:
        """A registered procedure, called with the registry and its arguments, by place or by name.

        Arguments marked as OUTPUT are not passed: they take the values that the function returns by name, or else in turn.
        """
        returned = None
        if r.more() and r.body[r.at].kind == "variable" and r.at + 1 < len(r.body) and r.body[r.at + 1].key == "=":
            returned, r.at = r.body[r.at].text.lower(), r.at + 2
        name = r.name()
        fn = self.registry.procedure(name)
        placed, named, back = [], {}, []
        for part in parted(r.rest(), ","):
            if not part:
                continue
            out = part[-1].key in ("OUTPUT", "OUT")
            part = part[:-1] if out else part
            key = None
            if len(part) > 2 and part[0].kind == "variable" and part[1].key == "=":
                key, part = part[0].text.removeprefix("@").lower(), part[2:]
            if out:
                back.append((key, part[0]))
                continue
            value = None if part[0].key == "DEFAULT" else self.value(part)
            if key:
                named[key] = value
            else:
                placed.append(value)
        result = fn(self.registry, *placed, **named)
        if isinstance(result, dict):
            for k, (key, target) in enumerate(back):
                value = result.get(key) if key else list(result.values())[k]
                if target.kind == "variable":
                    self.variables[target.text.lower()] = value
                elif target.kind == "mark":
                    self.args[int(target.text)] = value
            if returned:
                self.variables[returned] = result.get("return")
            return None
        return result if isinstance(result, DataFrame) else None

    def nothing(self, r: Reader) -> None:
        """Upkeep of indexes and statistics: columnar files have none."""
        r.rest()

    def truncate(self, r: Reader) -> None:
        name = r.name()
        r.end()
        self.registry.put(name, self.registry.table(name).limit(0))

    def delete(self, r: Reader) -> None:
        r.skip("FROM")
        name = r.name()
        alias = r.alias("WHERE", "FROM", "OUTPUT")
        source = r.until("WHERE") if r.skip("FROM") else []
        where = r.rest() if r.skip("WHERE") else []
        r.end()
        if source:
            name, rows, hits, view = self.joined(name, source, where, [])
            self.registry.put(name, rows.join(hits.select("_row"), "_row", "left_anti").drop("_row"))
            return
        target = self.registry.table(name)
        if where:
            view = self.view(self.registry.key(name))
            rows = self.run(f"SELECT *, coalesce(({self.text(where)}), false) AS _hit FROM {view} {alias or ''}")
            self.registry.put(name, rows.filter("NOT _hit").select(*target.columns))
        else:
            self.registry.put(name, target.limit(0))

    def insert(self, r: Reader) -> None:
        """Rows are added as files of their own; columns that are not given are null, but for an identity."""
        r.skip("INTO")
        name = r.name()
        target = self.registry.table(name)
        given = [_column(p) for p in parted(r.bracket(), ",")] if r.sees("(") and not _is_query(r) else None
        if r.skip("EXEC") or r.skip("EXECUTE"):
            rows = self.call(r)
            if rows is None:
                raise ValueError("the procedure has no rows to insert")
        elif r.sees("VALUES") or r.sees("SELECT") or r.sees("WITH") or r.sees("("):
            rows = self.run(self.text(r.rest()))
        else:
            raise ValueError(f"not understood: INSERT INTO {name} {shown(r.rest())}")
        identity = self.registry.identities.get(self.registry.key(name), "")
        given = given or [c.lower() for c in target.columns if c.lower() != identity.lower() or len(rows.columns) == len(target.columns)]
        unknown = [c for c in given if c not in {x.lower() for x in target.columns}]
        if unknown or len(given) != len(rows.columns):
            raise ValueError(f"{name} has no column {unknown[0]}" if unknown else f"{len(given)} columns for {len(rows.columns)} values")
        place = {c: k for k, c in enumerate(given)}
        rows = rows.toDF(*[f"_{k}" for k in range(len(rows.columns))])
        values = {c: F.col(f"_{place[c.lower()]}") if c.lower() in place else F.lit(None) for c in target.columns}
        new = next((c for c in target.columns if c.lower() == identity.lower() and c.lower() not in place), None)
        if new:
            last = target.agg(F.max(new)).first()[0] or 0
            values[new] = F.monotonically_increasing_id() + F.lit(last + 1)
        made = rows.select(*[values[c].cast(target.schema[c].dataType).alias(c) for c in target.columns])
        path = self.registry.append(name, made)
        if new:
            self.identity = self.registry.spark.read.parquet(path).agg(F.max(new)).first()[0]

    def update(self, r: Reader) -> None:
        name = r.name()
        alias = r.alias("SET")
        r.want("SET")
        sets = _sets(r.until("FROM", "WHERE", "OUTPUT", "OPTION"))
        source = r.until("WHERE", "OUTPUT", "OPTION") if r.skip("FROM") else []
        where = r.rest() if r.skip("WHERE") else []
        r.end()
        if source:
            self.update_from(name, sets, source, where)
            return
        target, view = self.registry.table(name), self.view(self.registry.key(name))
        _known(sets, target.columns, name)
        hit = f"coalesce(({self.text(where)}), false)" if where else "true"
        alias = alias or view
        new = [f"CAST(CASE WHEN `{alias}`._hit THEN {self.text(sets[c.lower()])} ELSE `{alias}`.`{c}` END AS {_kind(target, c)}) AS `{c}`" if c.lower() in sets else f"`{alias}`.`{c}`" for c in target.columns]
        self.registry.put(name, self.run(f"SELECT {', '.join(new)} FROM (SELECT *, {hit} AS _hit FROM {view} `{alias}`) `{alias}`"))

    def joined(self, name: str, source: list[Token], where: list[Token], values: list[list[Token]]) -> tuple[str, DataFrame, DataFrame, str]:
        """For statements with a FROM: the target's name, its numbered rows, and the rows that are hit with one set of values.

        The target is named in FROM, by its own name or by an alias. Its rows are numbered and written first, as they are read
        twice. Where a row is hit more than once the least values count.
        """
        at, key, alias = self.target_of(name, source)
        rows = self.registry.kept(self.registry.table(key).withColumn("_row", F.monotonically_increasing_id()))
        view = "_numbered_target"
        rows.createOrReplaceTempView(view)
        before, after = self.text(source[: at[0]]), self.text(source[at[1] :])
        made = ", ".join(["0 AS _v", *[f"{self.text(x)} AS _v{k}" for k, x in enumerate(values)]])
        hits = self.run(f"SELECT `{alias}`._row, {made} FROM {before} {view} AS `{alias}` {after} {'WHERE ' + self.text(where) if where else ''}")
        one = hits.groupBy("_row").agg(F.min(F.struct("_v", *[f"_v{k}" for k in range(len(values))])).alias("_set"))
        return key, rows, one, alias

    def target_of(self, name: str, source: list[Token]) -> tuple[tuple[int, int], str, str]:
        """Where the table that is changed stands among the tokens of FROM, its key, and its alias."""
        r = Reader(source)
        ends = ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "WHERE", "WITH")
        while r.more():
            start = r.at
            if r.depth[r.at] == 0 and r.body[r.at].kind in ("word", "quoted") and (start == 0 or r.body[start - 1].key in ("JOIN", ",")):
                table = r.name()
                alias = r.alias(*ends)
                key = self.registry.key(table)
                if key in self.registry.tables and (alias == name or (self.registry.key(name) == key and not alias) or (name == table and alias)):
                    return (start, r.at), key, alias or table.rpartition(".")[2]
            else:
                r.at += 1
        raise ValueError(f"{name} is not in FROM")

    def update_from(self, name: str, sets: dict[str, list[Token]], source: list[Token], where: list[Token]) -> None:
        order = list(sets)
        key, rows, hits, _ = self.joined(name, source, where, [sets[c] for c in order])
        columns = [c for c in rows.columns if c != "_row"]
        _known(sets, columns, name)
        both = rows.join(hits, "_row", "left")
        hit = F.col("_set").isNotNull()
        new = [F.when(hit, F.col(f"_set._v{order.index(c.lower())}").cast(rows.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c.lower() in sets else F.col(f"`{c}`") for c in columns]
        self.registry.put(key, both.select(*new))

    def merge(self, r: Reader) -> None:
        """MERGE with any number of clauses, of which the first that holds acts.

        A target row that several source rows match is an error. Without clauses for matched rows only files are added.
        """
        r.skip("INTO")
        name = r.name()
        a = r.alias("USING") or name.rpartition(".")[2]
        r.want("USING")
        if r.sees("("):
            source = f"({self.text(r.bracket())})"
            b = r.alias("ON")
        else:
            table = r.name()
            source, b = self.named(table.split("."), False), r.alias("ON") or table.rpartition(".")[2]
        r.want("ON")
        on = self.text(r.until("WHEN"))
        matched, unmatched, missing = [], [], []
        while r.skip("WHEN"):
            kind = matched
            if r.skip("NOT"):
                r.want("MATCHED")
                kind = unmatched
                if r.skip("BY", "SOURCE"):
                    kind = missing
                else:
                    r.skip("BY", "TARGET")
            else:
                r.want("MATCHED")
            condition = self.text(r.until("THEN")) if r.skip("AND") else "true"
            r.want("THEN")
            if kind is unmatched:
                r.want("INSERT")
                columns = [_column(p) for p in parted(r.bracket(), ",")] if r.sees("(") else None
                r.want("VALUES")
                kind.append((condition, "insert", (columns, [self.text(p) for p in parted(r.bracket(), ",")])))
            elif r.skip("DELETE"):
                kind.append((condition, "delete", {}))
            else:
                r.want("UPDATE", "SET")
                kind.append((condition, "update", {c: self.text(x) for c, x in _sets(r.until("WHEN")).items()}))
        r.end()
        key = self.registry.key(name)
        target, view = self.registry.table(key), self.view(key)
        for _, act, sets in [*matched, *missing]:
            _known(sets if act == "update" else {}, target.columns, name)
        inserts = []
        for condition, _, (columns, values) in unmatched:
            columns = columns or [c.lower() for c in target.columns]
            _known(dict.fromkeys(columns), target.columns, name)
            if len(columns) != len(values):
                raise ValueError(f"{len(columns)} columns for {len(values)} values")
            inserts.append((condition, dict(zip(columns, values, strict=True))))
        if not matched and not missing:
            if inserts:
                cases = [f"WHEN {c} THEN {k}" for k, (c, _) in enumerate(inserts)]
                chosen = f"SELECT *, CASE {' '.join(cases)} END AS _which FROM {source} `{b}` WHERE NOT EXISTS (SELECT 1 FROM {view} `{a}` WHERE {on})"
                new = [f"CAST(CASE _which {' '.join(f'WHEN {k} THEN {x[c.lower()]}' for k, (_, x) in enumerate(inserts) if c.lower() in x) or 'WHEN -1 THEN NULL'} END AS {_kind(target, c)}) AS `{c}`" for c in target.columns]
                self.registry.append(key, self.run(f"SELECT {', '.join(new)} FROM ({chosen}) `{b}` WHERE _which IS NOT NULL"))
            return
        numbered = f"(SELECT *, monotonically_increasing_id() AS _t FROM {view}) `{a}`"
        twice = self.run(f"SELECT `{a}`._t FROM {numbered} JOIN {source} `{b}` ON {on} GROUP BY `{a}`._t HAVING count(*) > 1 LIMIT 1").first()
        if twice is not None:
            raise ValueError(f"several source rows match one row of {name}")
        # What happens to a row, as the number of its clause; -1 leaves it, -2 takes it.
        pairs = [(f"`{a}`._t AND `{b}`._s AND ({c})", act, x) for c, act, x in matched]
        pairs += [(f"`{a}`._t AND `{b}`._s IS NULL AND ({c})", act, x) for c, act, x in missing]
        pairs += [(f"`{a}`._t IS NULL AND ({c})", "insert", x) for c, x in inserts]
        acts = [f"WHEN {c} THEN {-2 if act == 'delete' else k}" for k, (c, act, _) in enumerate(pairs)]
        which = f"CASE {' '.join(acts)} WHEN `{a}`._t THEN -1 ELSE -2 END"
        new = []
        for c in target.columns:
            cases = [f"WHEN {k} THEN {x[c.lower()]}" for k, (_, act, x) in enumerate(pairs) if act != "delete" and c.lower() in x]
            blank = [f"WHEN {k} THEN NULL" for k, (_, act, x) in enumerate(pairs) if act == "insert" and c.lower() not in x]
            old = f"`{a}`.`{c}`"
            new.append(f"CAST({f'CASE {which} ' + ' '.join(cases + blank) + f' ELSE {old} END' if cases or blank else old} AS {_kind(target, c)}) AS `{c}`")
        both = f"(SELECT *, true AS _t FROM {view}) `{a}` FULL JOIN (SELECT *, true AS _s FROM {source}) `{b}` ON {on}"
        self.registry.put(key, self.run(f"SELECT {', '.join(new)} FROM {both} WHERE {which} <> -2"))


_FORMS: list[tuple[tuple[str, ...], Callable]] = [
    (("DECLARE",), Session.declare),
    (("SET",), Session.assign),
    (("IF",), Session.branch),
    (("EXEC",), Session.call),
    (("EXECUTE",), Session.call),
    (("TRUNCATE", "TABLE"), Session.truncate),
    (("DELETE",), Session.delete),
    (("INSERT",), Session.insert),
    (("UPDATE", "STATISTICS"), Session.nothing),
    (("ALTER", "INDEX"), Session.nothing),
    (("UPDATE",), Session.update),
    (("MERGE",), Session.merge),
]
_HEADS = {keys[0] for keys, _ in _FORMS} | {"SELECT", "BEGIN"}


def _bound(variable: str) -> str:
    return "v" + variable.replace("@", "_")


def _assignment(part: list[Token]) -> tuple[str, list[Token]]:
    if len(part) < 3 or part[0].kind != "variable" or part[1].key != "=":
        raise ValueError(f"not understood: {shown(part)}")
    return part[0].text.lower(), part[2:]


def _column(part: list[Token]) -> str:
    if not part or part[-1].kind not in ("word", "quoted"):
        raise ValueError(f"a column is wanted at: {shown(part)}")
    return part[-1].name.lower()


def _sets(body: list[Token]) -> dict[str, list[Token]]:
    """Column to expression, of a SET list."""
    out = {}
    for part in parted(body, ","):
        k = next((k for k, x in enumerate(part) if x.key == "="), 0)
        if not k or k + 1 == len(part):
            raise ValueError(f"not understood: SET {shown(part)}")
        out[_column(part[:k])] = part[k + 1 :]
    return out


def _known(sets: dict, columns: list[str], name: str) -> None:
    for c in sets:
        if c not in {x.lower() for x in columns}:
            raise ValueError(f"{name} has no column {c}")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _is_query(r: Reader) -> bool:
    return r.body[r.at + 1 : r.at + 2] != [] and r.body[r.at + 1].key in ("SELECT", "WITH", "(")


def _without_hints(body: list[Token]) -> list[Token]:
    """Table hints, such as WITH (NOLOCK), are left out."""
    out: list[Token] = []
    k = 0
    while k < len(body):
        if body[k].key == "WITH" and k + 1 < len(body) and body[k + 1].key == "(":
            depth = 0
            k += 1
            while k < len(body):
                depth += (body[k].key == "(") - (body[k].key == ")")
                k += 1
                if not depth:
                    break
            continue
        out.append(body[k])
        k += 1
    return out


def _limited(sql: str) -> str:
    """TOP of the outermost query as LIMIT."""
    if m := re.match(r"SELECT\s+TOP\s*(?:\(\s*)?(\d+|:\w+)(?:\s*\))?\s+(.*)", sql, re.I | re.S):
        return f"SELECT {m[2]} LIMIT {m[1]}"
    return sql


def dialect(registry, sql: str) -> str:
    """A query in Spark's dialect."""
    body = tokens(sql)
    if body and body[0].key in ("EXEC", "EXECUTE", "DECLARE"):
        raise ValueError(f"needs a registered procedure: {sql.strip()[:60]}")
    return Session(registry, []).text(_without_hints(body))


def run(registry, text: str, args: list | None = None) -> DataFrame:
    """Run a batch; the rows of its last query, or none."""
    session = Session(registry, list(args or []))
    try:
        out = session.all(statements(tokens(text)))
    except Exception:
        if session.undo is not None:
            registry.tables.clear()
            registry.tables.update(session.undo)
        raise
    if args is not None:
        args[:] = session.args
    return registry.spark.createDataFrame([], "done string") if out is None else out
