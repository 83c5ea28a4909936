"""The query language: text to a tree of conditions.

``level OP x``, ``[name][?] OP value`` and ``exists(name)`` combined by or, and,
not and parentheses.  Keywords are case-insensitive and end before white space,
a parenthesis or the end.  A value that only begins like a number is a string.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from ..levels import parse_level

PREDEFINED = {"message": "message", "msg": "message", "logger": "logger", "caller": "caller"}


@dataclass(frozen=True)
class Key:
    name: str
    predefined: bool = False

    @classmethod
    def of(cls, text: str) -> Key:
        """A name as written without quotes."""
        if text in PREDEFINED:
            return cls(PREDEFINED[text], True)
        return cls(text.lstrip("."))


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Level:
    op: str
    rank: int


@dataclass(frozen=True)
class Exists:
    key: Key


@dataclass(frozen=True)
class Field:
    """``op``: = != < <= > >= in over numbers; exact contains regex like in over strings."""

    key: Key
    op: str
    value: object
    numeric: bool = False
    negated: bool = False
    absent: bool = False


class QueryError(ValueError):
    def __init__(self, text: str, at: int, wanted: str):
        super().__init__(f"{wanted} expected at {at} in {text!r}")
        self.at = at


_END = r"(?=[()\s]|\Z)"
_NAME = re.compile(r"(?:[@_\-.\[\]]|[^\W_])+")
_SIMPLE = re.compile(r"(?:[@._\-:/!#%$*+?]|[^\W_])+")
_JSON = re.compile(r'"(?:[^"\\]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*"')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]{0,19})(?:\.[0-9]{0,19})?(?:[eE][+-]?[0-9]{1,4})?")
_OR, _AND, _NOT = re.compile(rf"\|\||(?i:or){_END}"), re.compile(rf"&&|(?i:and){_END}"), re.compile(rf"!|(?i:not){_END}")
_LEVEL, _EXISTS = re.compile(r"(?i:level)"), re.compile(rf"(?i:exists?){_END}")
# longest first, so that <= is not <
_COMPARE = [("<=", "<=|(?i:le)%"), (">=", ">=|(?i:ge)%"), ("!=", r"!=|(?i:not)\s+(?i:eq)%|(?i:ne)%"), ("<", "<|(?i:lt)%"), (">", ">|(?i:gt)%"), ("=", "=|(?i:eq)%")]
_MATCH = [
    ("regex", True, r"!~~=|(?i:not)\s+(?i:match(?:es)?)%"), ("regex", False, "~~=|(?i:match(?:es)?)%"),
    ("contains", True, r"!~=|(?i:not)\s+(?i:contains?)%"), ("contains", False, "~=|(?i:contains?)%"),
    ("like", True, r"(?i:not)\s+(?i:like)%"), ("like", False, "(?i:like)%"),
    ("in", True, r"(?i:not)\s+(?i:in)%"), ("in", False, "(?i:in)%"),
]


def _compiled(pattern: str) -> re.Pattern:
    return re.compile("|".join(x[:-1] + _END if x.endswith("%") else x for x in pattern.split("|")))


_COMPARE = [(op, _compiled(p)) for op, p in _COMPARE]
_MATCH = [(op, negated, _compiled(p)) for op, negated, p in _MATCH]


class _Parser:
    def __init__(self, text: str, read_set):
        self.text, self.at, self.read_set = text, 0, read_set

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
            self.at += 1

    def take(self, pattern: re.Pattern) -> str | None:
        self.space()
        m = pattern.match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[0]

    def fail(self, wanted: str):
        raise QueryError(self.text, self.at, wanted)

    def expect(self, char: str) -> None:
        self.space()
        if self.text[self.at : self.at + 1] != char:
            self.fail(repr(char))
        self.at += 1

    def whole(self):
        found = self.any_of()
        self.space()
        if self.at < len(self.text):
            self.fail("the end")
        return found

    def any_of(self):
        items = [self.all_of()]
        while self.take(_OR):
            items.append(self.all_of())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def all_of(self):
        items = [self.unary()]
        while self.take(_AND):
            items.append(self.unary())
        return items[0] if len(items) == 1 else And(tuple(items))

    def unary(self):
        if self.take(_NOT):
            return Not(self.unary())
        self.space()
        if self.text[self.at : self.at + 1] == "(":
            self.at += 1
            found = self.any_of()
            self.expect(")")
            return found
        return self.term()

    def term(self):
        begun = self.at
        if self.take(_LEVEL):
            for op, pattern in _COMPARE:
                if self.take(pattern):
                    return Level(op, parse_level(self.string()))
            self.at = begun
        if self.take(_EXISTS):
            self.space()
            if self.text[self.at : self.at + 1] == "(":
                self.at += 1
                key = self.key()
                self.expect(")")
                return Exists(key)
            self.at = begun
        return self.condition()

    def key(self) -> Key:
        if quoted := self.take(_JSON):
            return Key(json.loads(quoted))
        name = self.take(_NAME)
        return Key.of(name) if name else self.fail("a field name")

    def string(self) -> str:
        if quoted := self.take(_JSON):
            return json.loads(quoted)
        found = self.take(_SIMPLE)
        return found if found else self.fail("a string")

    def number(self) -> str | None:
        begun = self.at
        found = self.take(_NUMBER)
        if found and not _SIMPLE.match(self.text, self.at):
            return found
        self.at = begun
        return None

    def condition(self) -> Field:
        key = self.key()
        self.space()
        absent = self.text[self.at : self.at + 1] == "?"
        self.at += absent
        for op, negated, pattern in _MATCH:
            if self.take(pattern):
                if op != "in":
                    return Field(key, op, self.string(), negated=negated, absent=absent)
                numeric, values = self.members()
                return Field(key, "in", values, numeric, negated, absent)
        for op, pattern in _COMPARE:
            if self.take(pattern):
                if (number := self.number()) is not None:
                    return Field(key, op, number, True, absent=absent)
                if op in ("=", "!="):
                    return Field(key, "exact", self.string(), negated=op == "!=", absent=absent)
                self.fail("a number")
        self.fail("an operator")

    def members(self) -> tuple[bool, tuple[str, ...]]:
        self.space()
        if self.text[self.at : self.at + 1] == "@":
            self.at += 1
            return False, tuple(self.read_set(self.string()))
        self.expect("(")
        begun = self.at
        for numeric, one in ((True, self.number), (False, self.string)):
            self.at, values = begun, []
            while (value := one()) is not None:
                values.append(value)
                self.space()
                if self.text[self.at : self.at + 1] != ",":
                    break
                self.at += 1
            if values and value is not None and self.text[self.at : self.at + 1] == ")":
                self.at += 1
                return numeric, tuple(values)
        self.fail("')'")


def parse(text: str, read_set=None):
    """The tree of a query; ``read_set`` gives the members of ``in @name``."""
    from ..sources.sets import read_set as default

    return _Parser(text, read_set or default).whole()


def parse_option(text: str) -> Field:
    """A condition as ``-f`` takes it: ``k=v`` or ``k:v``, always on strings; before the sign ~~ or ~, then !, then ? may stand."""
    at = text.find("=")
    if at < 0:
        at = text.find(":")
    if at < 0:
        raise ValueError(f"{text!r} has neither = nor :")
    name, value, op = text[:at], text[at + 1 :], "exact"
    if name.endswith("~~"):
        name, op = name[:-2], "regex"
    elif name.endswith("~"):
        name, op = name[:-1], "contains"
    negated = name.endswith("!")
    name = name[:-1] if negated else name
    absent = name.endswith("?")
    return Field(Key.of(name[:-1] if absent else name), op, value, negated=negated, absent=absent)
