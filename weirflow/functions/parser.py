"""Tokens and syntax trees of the expression language."""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""\s*(?:
      (?P<variable>@\[[^\]]+\]|@\w+)
    | (?P<lineage>\#\{[^}]*\})
    | (?P<number>0[xX][0-9A-Fa-f]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    | (?P<string>"(?:\\.|[^"\\])*")
    | (?P<bracket>\[[^\]]+\])
    | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
    | (?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:(),&|^~])
    )""",
    re.X | re.S,
)
#: Binding powers of the binary operators.
POWER = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, "<=": 7, ">": 7, ">=": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
UNARY = 10
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a"}


class ExpressionError(ValueError):
    """A fault in an expression, with its place."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(f"{message} at {at}")
        self.message, self.at = message, at


@dataclass(frozen=True)
class Literal:
    value: object
    at: int = 0


@dataclass(frozen=True)
class ColumnRef:
    name: str
    at: int = 0


@dataclass(frozen=True)
class Variable:
    name: str
    at: int = 0


@dataclass(frozen=True)
class Cast:
    type: str
    args: tuple
    operand: object
    at: int = 0


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    at: int = 0


@dataclass(frozen=True)
class Unary:
    op: str
    operand: object
    at: int = 0


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    at: int = 0


@dataclass(frozen=True)
class Ternary:
    condition: object
    yes: object
    no: object
    at: int = 0


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ExpressionError(f"unexpected {text[at : at + 1]!r}", at)
        out.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "", len(text))]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    @property
    def now(self):
        return self.tokens[self.at]

    def take(self, value: str | None = None):
        kind, text, at = self.now
        if value is not None and (kind != "op" or text != value):
            raise ExpressionError(f"expected {value!r}, found {text or 'the end'!r}", at)
        self.at += 1
        return kind, text, at

    def is_op(self, value: str, ahead: int = 0) -> bool:
        at = self.at + ahead
        return at < len(self.tokens) and self.tokens[at][:2] == ("op", value)

    def whole(self):
        if self.now[0] == "end":
            raise ExpressionError("empty expression", 0)
        out = self.ternary()
        if self.now[0] != "end":
            raise ExpressionError(f"unexpected {self.now[1]!r}", self.now[2])
        return out

    def ternary(self):
        condition = self.binary(0)
        if not self.is_op("?"):
            return condition
        _, _, at = self.take()
        yes = self.ternary()
        self.take(":")
        return Ternary(condition, yes, self.ternary(), at)

    def binary(self, least: int):
        left = self.unary()
        while self.now[0] == "op" and POWER.get(self.now[1], 0) > least:
            _, op, at = self.take()
            left = Binary(op, left, self.binary(POWER[op]), at)
        return left

    def unary(self):
        kind, text, at = self.now
        if kind == "op" and text in ("-", "!", "~", "+"):
            self.take()
            operand = self.unary()
            return operand if text == "+" else Unary(text, operand, at)
        if self.is_op("(") and self.tokens[self.at + 1][0] == "name" and self.tokens[self.at + 1][1].upper().startswith("DT_"):
            name, args = self.type_name()
            return Cast(name, args, self.unary(), at)
        return self.atom()

    def type_name(self) -> tuple[str, tuple]:
        self.take("(")
        name, args = self.take()[1].upper(), []
        while self.is_op(","):
            self.take()
            args.append(int(self.take()[1]))
        self.take(")")
        return name, tuple(args)

    def atom(self):
        kind, text, at = self.take()
        if kind == "number":
            if text[:2].lower() == "0x":
                return Literal(int(text, 16), at)
            return Literal(float(text) if set(text) & set(".eE") else int(text), at)
        if kind == "string":
            return Literal(re.sub(r"\\(x[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S), at)
        if kind == "variable":
            return Variable(text[1:].strip("[]"), at)
        if kind == "lineage":
            m = re.search(r"Columns\[([^\]]+)\]", text)
            return ColumnRef(m[1] if m else text[2:-1], at)
        if kind in ("name", "bracket"):
            name = text.strip("[]")
            if self.is_op("("):
                return self.call(name.upper(), at)
            if kind == "name" and name.upper() in ("TRUE", "FALSE"):
                return Literal(name.upper() == "TRUE", at)
            return ColumnRef(name, at)
        if (kind, text) == ("op", "("):
            inner = self.ternary()
            self.take(")")
            return inner
        raise ExpressionError(f"unexpected {text or 'end'!r}", at)

    def call(self, name: str, at: int):
        if name == "NULL":
            kind, args = self.type_name()
            return Cast(kind, args, Literal(None, at), at)
        self.take("(")
        args = []
        while not self.is_op(")"):
            args.append(self.ternary())
            if not self.is_op(")"):
                self.take(",")
        self.take(")")
        return Call(name, tuple(args), at)


def parse(text: str):
    return Parser(text).whole()


def referenced(node) -> list[str]:
    """Names of the columns that a tree refers to, in order, each once."""
    found: dict[str, None] = {}

    def walk(n):
        if isinstance(n, ColumnRef):
            found[n.name] = None
        for part in getattr(n, "__dict__", {}).values():
            for x in part if isinstance(part, tuple) else (part,):
                if hasattr(x, "__dataclass_fields__"):
                    walk(x)

    walk(node)
    return list(found)
