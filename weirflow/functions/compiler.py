"""Syntax trees to Spark columns, with the language's own typing rules.

A column's type comes from the input schema, so ``+`` knows text from numbers and ``/`` whole numbers from others. All
stays in built-in functions, inside generated code.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.parser import Binary, Call, Cast, ColumnRef, ExpressionError, Literal, Ternary, Unary, Variable, parse
from weirflow.types import DT_TYPES, spark_type

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Typed:
    column: Column
    type: T.DataType
    value: object = None  # of a literal

    @property
    def whole(self) -> bool:
        return isinstance(self.type, WHOLE)

    @property
    def text(self) -> bool:
        return isinstance(self.type, T.StringType)


@dataclass(frozen=True)
class Diagnostic:
    severity: str
    message: str
    at: int = 0


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


@dataclass
class Context:
    schema: T.StructType
    variables: dict[str, object]
    now: dt.datetime | None = None
    seed: int = 0


Builder = Callable[..., Typed]
FUNCTIONS: dict[str, tuple[tuple[int, ...], Builder]] = {}


def register_function(name: str, arities: int | tuple[int, ...], builder: Builder) -> None:
    """Add a function; ``builder`` takes the context and typed arguments and returns a typed column."""
    FUNCTIONS[name.upper()] = ((arities,) if isinstance(arities, int) else tuple(arities), builder)


def _text(a: Typed) -> Column:
    return a.column if a.text else a.column.cast("string")


def _simple(fn, kind: T.DataType | None, take=_text) -> Builder:
    return lambda ctx, *a: Typed(fn(*[take(x) for x in a]), kind or a[0].type)


def _number(a: Typed) -> Column:
    return a.column.cast("double")


def _literal_text(a: Typed, what: str) -> str:
    if not isinstance(a.value, str):
        raise ExpressionError(f"{what} must be a text literal")
    return a.value


def _delimited(a: Typed, delimiters: Typed) -> Column:
    signs = "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 else c for c in _literal_text(delimiters, "delimiters"))
    return F.split(_text(a), f"[{signs}]")


def _find(ctx: Context, a: Typed, s: Typed, n: Typed | None = None) -> Typed:
    text, sought = _text(a), _text(s)
    if n is None or n.value == 1:
        return Typed(F.position(sought, text), I)
    k = n.column.cast("int")
    count = F.floor((F.length(text) - F.length(F.replace(text, sought, F.lit("")))) / F.length(sought))
    before = F.call_function("substring_index", text, sought, k)
    return Typed(F.when((k >= 1) & (F.length(sought) > 0) & (count >= k), F.length(before) + 1).when(text.isNotNull() & sought.isNotNull(), 0).cast("int"), I)


def _shift(ctx: Context, part: Typed, n: Typed, at: Typed) -> Typed:
    unit = PARTS.get(_literal_text(part, "the date part").lower())
    if unit is None:
        raise ExpressionError(f"unknown date part {part.value}")
    unit = {"DAYOFYEAR": "DAY", "WEEKDAY": "DAY"}.get(unit, unit)
    stamp = at.column.cast("timestamp_ntz") if isinstance(at.type, (T.DateType, T.StringType)) else at.column
    return Typed(F.timestamp_add(unit, n.column.cast("int"), stamp), T.TimestampNTZType() if not isinstance(at.type, T.TimestampType) else at.type)


# Names of the date parts.
PARTS = {
    "year": "YEAR", "yyyy": "YEAR", "yy": "YEAR", "quarter": "QUARTER", "qq": "QUARTER", "q": "QUARTER", "month": "MONTH",
    "mm": "MONTH", "m": "MONTH", "dayofyear": "DAYOFYEAR", "dy": "DAYOFYEAR", "y": "DAYOFYEAR", "day": "DAY", "dd": "DAY",
    "d": "DAY", "week": "WEEK", "wk": "WEEK", "ww": "WEEK", "weekday": "WEEKDAY", "dw": "WEEKDAY", "w": "WEEKDAY",
    "hour": "HOUR", "hh": "HOUR", "minute": "MINUTE", "mi": "MINUTE", "n": "MINUTE", "second": "SECOND", "ss": "SECOND",
    "s": "SECOND", "millisecond": "MILLISECOND", "ms": "MILLISECOND",
}
READERS = {"YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "DAYOFYEAR": F.dayofyear, "DAY": F.dayofmonth, "WEEK": F.weekofyear, "WEEKDAY": F.dayofweek, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}


def _stamp(a: Typed) -> Column:
    return a.column.cast("timestamp_ntz") if isinstance(a.type, (T.StringType, T.DateType)) else a.column


def _part(ctx: Context, part: Typed, at: Typed) -> Typed:
    unit = PARTS.get(_literal_text(part, "the date part").lower())
    if unit == "MILLISECOND":
        return Typed((F.date_part(F.lit("SECOND"), _stamp(at)) * 1000 % 1000).cast("int"), I)
    if unit is None:
        raise ExpressionError(f"unknown date part {part.value}")
    return Typed(READERS[unit](_stamp(at)).cast("int"), I)


def _between(ctx: Context, part: Typed, a: Typed, b: Typed) -> Typed:
    """Boundaries of the part that lie between two times."""
    unit = PARTS.get(_literal_text(part, "the date part").lower())
    x, y = _stamp(a), _stamp(b)
    if unit in ("YEAR", "QUARTER", "MONTH"):
        per = {"YEAR": 1, "QUARTER": 4, "MONTH": 12}[unit]
        inner = {"YEAR": lambda c: F.lit(0), "QUARTER": F.quarter, "MONTH": F.month}[unit]
        return Typed(((F.year(y) - F.year(x)) * per + inner(y) - inner(x)).cast("int"), I)
    if unit in ("DAY", "DAYOFYEAR", "WEEKDAY"):
        return Typed(F.datediff(y.cast("date"), x.cast("date")), I)
    if unit == "WEEK":  # weeks begin on Sunday
        start = lambda c: F.date_sub(c.cast("date"), F.dayofweek(c) - 1)
        return Typed(F.floor(F.datediff(start(y), start(x)) / 7).cast("int"), I)
    if unit in ("HOUR", "MINUTE", "SECOND"):
        return Typed(F.timestamp_diff(unit, F.date_trunc(unit, x), F.date_trunc(unit, y)).cast("int"), I)
    if unit == "MILLISECOND":
        return Typed(F.timestamp_diff(unit, x, y).cast("int"), I)
    raise ExpressionError(f"unknown date part {part.value}")


def _round(ctx: Context, a: Typed, n: Typed | None = None) -> Typed:
    return Typed(F.round(a.column, n.column.cast("int") if n else F.lit(0)), a.type)


def _bits(name: str) -> Builder:
    return lambda ctx, a, b: Typed(getattr(a.column, name)(b.column), a.type if len(a.type.simpleString()) >= len(b.type.simpleString()) else b.type)


def _now(ctx: Context) -> Typed:
    return Typed(F.lit(ctx.now) if ctx.now else F.current_timestamp(), T.TimestampType())


def _utc(ctx: Context) -> Typed:
    return Typed(F.to_utc_timestamp(_now(ctx).column, F.current_timezone()), T.TimestampType())


def _either(ctx: Context, a: Typed, b: Typed) -> Typed:
    return Typed(F.coalesce(a.column, b.column.cast(a.type) if a.type != b.type and not isinstance(a.type, T.NullType) else b.column), a.type)


for _name, _fn in {"UPPER": F.upper, "LOWER": F.lower, "TRIM": F.trim, "LTRIM": F.ltrim, "RTRIM": F.rtrim, "REVERSE": F.reverse}.items():
    register_function(_name, 1, _simple(_fn, S))
register_function("LEN", 1, _simple(F.length, I))
register_function("HEX", 1, lambda ctx, a: Typed(F.hex(a.column), S))
register_function("CODEPOINT", 1, _simple(F.ascii, I))
register_function("SUBSTRING", 3, lambda ctx, a, i, n: Typed(F.substr(_text(a), i.column.cast("int"), n.column.cast("int")), S))
register_function("LEFT", 2, lambda ctx, a, n: Typed(F.left(_text(a), n.column.cast("int")), S))
register_function("RIGHT", 2, lambda ctx, a, n: Typed(F.right(_text(a), n.column.cast("int")), S))
register_function("REPLACE", 3, _simple(F.replace, S))
register_function("REPLICATE", 2, lambda ctx, a, n: Typed(F.repeat(_text(a), n.column.cast("int")), S))
register_function("FINDSTRING", (2, 3), _find)
register_function("TOKEN", 3, lambda ctx, a, d, n: Typed(F.try_element_at(_delimited(a, d), n.column.cast("int")), S))
register_function("TOKENCOUNT", 2, lambda ctx, a, d: Typed(F.when(_text(a) == "", 0).otherwise(F.size(_delimited(a, d))), I))
register_function("ISNULL", 1, lambda ctx, a: Typed(a.column.isNull(), B))
register_function("REPLACENULL", 2, _either)
register_function("GETDATE", 0, _now)
register_function("GETUTCDATE", 0, _utc)
register_function("DATEADD", 3, _shift)
register_function("DATEDIFF", 3, _between)
register_function("DATEPART", 2, _part)
for _name, _fn in {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth}.items():
    register_function(_name, 1, _simple(_fn, I, _stamp))
register_function("ABS", 1, lambda ctx, a: Typed(F.abs(a.column), a.type))
for _name, _fn in {"FLOOR": F.floor, "CEILING": F.ceil}.items():
    register_function(_name, 1, _simple(lambda c, f=_fn: f(c).cast("long"), L, _number))
for _name, _fn in {
    "SQRT": F.sqrt, "EXP": F.exp, "SIGN": F.signum, "LOG": F.log, "LN": F.log, "LOG10": F.log10, "LOG2": F.log2, "SIN": F.sin,
    "COS": F.cos, "TAN": F.tan, "ASIN": F.asin, "ACOS": F.acos, "ATAN": F.atan,
}.items():
    register_function(_name, 1, _simple(_fn, D, _number))
register_function("ATAN2", 2, _simple(F.atan2, D, _number))
register_function("POWER", 2, _simple(F.pow, D, _number))
register_function("SQUARE", 1, _simple(lambda c: F.pow(c, F.lit(2.0)), D, _number))
register_function("ROUND", (1, 2), _round)
register_function("PI", 0, lambda ctx: Typed(F.pi(), D))
register_function("RAND", 0, lambda ctx: Typed(F.rand(ctx.seed), D))
register_function("BITAND", 2, _bits("bitwiseAND"))
register_function("BITOR", 2, _bits("bitwiseOR"))
register_function("BITXOR", 2, _bits("bitwiseXOR"))
register_function("CONCATENATE", tuple(range(1, 33)), _simple(F.concat, S))

RULES: list[tuple[int, re.Pattern, str]] = []


def register_rule(pattern: str, replacement: str, priority: int = 0) -> None:
    """Rewrite matching text before an expression is read; higher priorities first."""
    RULES.append((priority, re.compile(pattern), replacement))
    RULES.sort(key=lambda r: -r[0])


def _wider(a: Typed, b: Typed) -> T.DataType:
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType]
    rank = lambda t: next((k for k, c in enumerate(order) if isinstance(t, c)), len(order))
    return a.type if rank(a.type) >= rank(b.type) else b.type


class Compiler:
    def __init__(self, ctx: Context):
        self.ctx = ctx
        self.fields = {f.name.lower(): f for f in ctx.schema}

    def visit(self, node) -> Typed:
        return getattr(self, type(node).__name__.lower())(node)

    def literal(self, n: Literal) -> Typed:
        v = n.value
        kind = {bool: B, str: S, float: D, int: I if isinstance(v, int) and abs(v) < 1 << 31 else L}.get(type(v), T.NullType())
        return Typed(F.lit(v), kind, v)

    def columnref(self, n: ColumnRef) -> Typed:
        f = self.fields.get(n.name.lower())
        if f is None:
            raise ExpressionError(f"unknown column {n.name}", n.at)
        return Typed(F.col(f"`{f.name}`"), f.dataType)

    def variable(self, n: Variable) -> Typed:
        names = {k.lower(): k for k in self.ctx.variables}
        key = n.name.lower()
        found = names.get(key) or names.get(key.rpartition("::")[2]) or next((k for low, k in names.items() if low.rpartition("::")[2] == key), None)
        if found is None:
            raise ExpressionError(f"unknown variable {n.name}", n.at)
        v = self.ctx.variables[found]
        kind = {dt.datetime: T.TimestampType(), dt.date: T.DateType()}.get(type(v))
        return Typed(F.lit(v), kind) if kind else self.literal(Literal(v))

    def cast(self, n: Cast) -> Typed:
        if n.type not in DT_TYPES and n.type not in ("DT_NUMERIC", "DT_DECIMAL"):
            raise ExpressionError(f"unknown type {n.type}", n.at)
        a = self.visit(n.operand)
        lengths = n.args if n.type in ("DT_NUMERIC", "DT_DECIMAL") else ()
        kind = spark_type(n.type, *lengths, cast=True)
        source = a.column
        if a.text and isinstance(kind, WHOLE):
            source = F.trim(source)
        if isinstance(a.type, (T.DoubleType, T.FloatType, T.DecimalType)) and isinstance(kind, WHOLE):
            source = F.round(source)
        out = source.cast(kind)
        if n.type in ("DT_STR", "DT_WSTR") and n.args and n.args[0] > 0:
            out = F.left(out, F.lit(n.args[0]))
        return Typed(out, kind)

    def call(self, n: Call) -> Typed:
        if n.name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {n.name}", n.at)
        arities, builder = FUNCTIONS[n.name]
        if len(n.args) not in arities:
            raise ExpressionError(f"{n.name} takes {' or '.join(map(str, arities))} arguments, not {len(n.args)}", n.at)
        return builder(self.ctx, *[self.visit(a) for a in n.args])

    def unary(self, n: Unary) -> Typed:
        a = self.visit(n.operand)
        return {"-": lambda: Typed(-a.column, a.type), "!": lambda: Typed(~a.column, B), "~": lambda: Typed(F.bitwise_not(a.column), a.type)}[n.op]()

    def ternary(self, n: Ternary) -> Typed:
        c, a, b = self.visit(n.condition), self.visit(n.yes), self.visit(n.no)
        kind = b.type if isinstance(a.type, T.NullType) else a.type
        if not isinstance(b.type, T.NullType) and not isinstance(a.type, T.NullType) and a.type != b.type and not (a.text or b.text):
            kind = _wider(a, b)
        return Typed(F.when(c.column, a.column.cast(kind)).otherwise(b.column.cast(kind)), kind)

    def binary(self, n: Binary) -> Typed:
        a, b = self.visit(n.left), self.visit(n.right)
        x, y = a.column, b.column
        if n.op == "+" and (a.text or b.text):
            return Typed(F.concat(_text(a), _text(b)), S)
        if n.op in ("&&", "||"):
            return Typed(x & y if n.op == "&&" else x | y, B)
        if n.op in ("==", "!=", "<", "<=", ">", ">="):
            return Typed({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[n.op], B)
        if n.op in ("&", "|", "^"):
            return Typed({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[n.op](y), _wider(a, b))
        kind = _wider(a, b)
        if n.op == "/" and a.whole and b.whole:
            return Typed(F.call_function("div", x, y).cast(kind), kind)
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[n.op]()
        return Typed(out, kind)


def compile_expression(text: str, schema: T.StructType, variables: dict[str, object] | None = None, now: dt.datetime | None = None, seed: int = 0) -> Column:
    """The column that an expression over a schema's columns means; faults raise ExpressionError with their place."""
    for _, pattern, replacement in RULES:
        text = pattern.sub(replacement, text)
    return Compiler(Context(schema, variables or {}, now, seed)).visit(parse(text)).column


def validate(text: str) -> list[Diagnostic]:
    """Faults of an expression that can be told without a schema: unknown functions and types warn, syntax is an error."""
    if not text.strip():
        return [Diagnostic("warning", "empty expression")]
    try:
        tree = parse(text)
    except ExpressionError as e:
        return [Diagnostic("error", e.message, e.at)]
    found: list[Diagnostic] = []

    def walk(n):
        if isinstance(n, Call) and n.name not in FUNCTIONS:
            found.append(Diagnostic("warning", f"unknown function {n.name}", n.at))
        if isinstance(n, Cast) and n.type not in DT_TYPES and n.type not in ("DT_NUMERIC", "DT_DECIMAL"):
            found.append(Diagnostic("warning", f"unknown type {n.type}", n.at))
        for part in n.__dict__.values():
            for x in part if isinstance(part, tuple) else (part,):
                if hasattr(x, "__dataclass_fields__"):
                    walk(x)

    walk(tree)
    return found
