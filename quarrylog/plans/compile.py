"""Query trees to one Boolean Column that is never null.

A resolver says where fields are: in a record's ``nodes``, or in the columns of
a table.  All of it is built-in expressions, so filters on table columns reach
the scan and filters on records stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers
from ..functions.keys import normal, path_matches, wildcard_like
from ..functions.regexes import java_regex
from .query import And, Exists, Field, Level, Not, Or

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Severity is the other way round from rank.
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Value:
    """One value to test: its text, and its number if its column has numbers."""

    def __init__(self, text: Column, number: Column | None = None, whole: bool = False):
        self.text, self.number, self.whole = text, number, whole


class NodesResolver:
    """Fields of a record, in ``nodes`` (path, kind, text) and the predefined columns."""

    def __init__(self, nodes: str = "nodes", level_rank: str = "level_rank", message: str = "message.text", logger: str = "logger", caller: str = "caller.name"):
        self.nodes, self.rank = F.col(nodes), F.col(level_rank)
        self.columns = {"message": F.col(message), "logger": F.col(logger), "caller": F.col(caller)}

    def any(self, name: str, test: Callable[[Value], Column]) -> Column:
        return _sure(F.exists(self.nodes, lambda n: path_matches(n["path"], name) & test(Value(n["text"]))))

    def present(self, name: str) -> Column:
        return _sure(F.exists(self.nodes, lambda n: path_matches(n["path"], name)))

    def predefined(self, name: str) -> Value:
        return Value(self.columns[name])


class TableResolver:
    """Fields of a table: columns, fields of structs, elements of arrays and keys of columns that hold JSON."""

    def __init__(self, schema: T.StructType, level_rank: Column | None = None, message: Column | None = None, logger: Column | None = None, caller: Column | None = None, json: tuple[str, ...] = ()):
        self.schema, self.rank, self.json = schema, level_rank if level_rank is not None else F.lit(None).cast("int"), json
        none = F.lit(None).cast("string")
        self.columns = {"message": message if message is not None else none, "logger": logger if logger is not None else none, "caller": caller if caller is not None else none}

    def find(self, name: str) -> list[tuple[Column, T.DataType, list[str]]]:
        """Columns that the path leads to, with the array steps that are left."""
        out = []

        def walk(column, kind, rest: str):
            if not rest:
                out.append((column, kind, []))
            elif isinstance(kind, T.StructType):
                for f in kind.fields:
                    own = normal(f.name)
                    if rest == own or rest.startswith(own + "."):
                        walk(F.col(f"`{f.name}`") if column is None else column[f.name], f.dataType, rest[len(own) + 1 :])
            elif isinstance(kind, T.ArrayType) and rest.startswith("["):
                step, _, after = rest.partition("]")
                out.append((column, kind, [step[1:], after.lstrip(".")]))

        walk(None, self.schema, normal(name))
        for column in self.json:
            own = normal(column) + "."
            if normal(name).startswith(own):
                # the keys as written: normal forms of JSON keys need records
                out.append((F.col(f"`{column}`"), T.StringType(), [".", name[len(own) :]]))
        return out

    def values(self, name: str):
        """(present, apply) for each way to the field; apply gives whether it is present and any of its values passes a test."""
        for column, kind, steps in self.find(name):
            if not steps:
                yield column.isNotNull(), lambda test, c=column, v=_value(column, kind): c.isNotNull() & _sure(test(v))
            elif steps[0] == ".":
                text = F.get_json_object(column, "$." + steps[1])
                # as the one element of an array the JSON is read once, however often the test looks at it
                yield text.isNotNull(), lambda test, t=text: F.exists(F.array(t), lambda x: x.isNotNull() & _sure(test(Value(x))))
            else:
                step, after = steps
                inner = kind.elementType

                def element(x, after=after, inner=inner):
                    if not after:
                        return _value(x, inner)
                    for f in inner.fields if isinstance(inner, T.StructType) else []:
                        if normal(f.name) == after:
                            return _value(x[f.name], f.dataType)
                    return Value(F.lit(None).cast("string"))

                if step == "":
                    yield F.size(column) > 0, lambda test, c=column, e=element: F.exists(c, lambda x: _sure(test(e(x))))
                elif step.isdigit():
                    at = F.get(column, F.lit(int(step)))
                    there = F.size(column) > int(step)
                    yield there, lambda test, t=there, x=at, e=element: _sure(t) & _sure(test(e(x)))

    def any(self, name: str, test: Callable[[Value], Column]) -> Column:
        found = F.lit(False)
        for _, apply in self.values(name):
            found = found | _sure(apply(test))
        return found

    def present(self, name: str) -> Column:
        found = F.lit(False)
        for present, _ in self.values(name):
            found = found | _sure(present)
        return found

    def predefined(self, name: str) -> Value:
        return Value(self.columns[name])


def _value(column: Column, kind: T.DataType) -> Value:
    if isinstance(kind, NUMERIC):
        return Value(column.cast("string"), column)
    return Value(column if isinstance(kind, T.StringType) else column.cast("string"))


def _test(f: Field) -> Callable[[Value], Column]:
    """The value test of a condition, with its negation."""
    if f.numeric and f.op == "in":
        def test(v):
            one = (lambda x: numbers.compared_number(v.number, "=", x)) if v.number is not None else (lambda x: numbers.compared(v.text, "=", x))
            hit = F.lit(False)
            for x in f.value:
                hit = hit | one(x)
            return hit
    elif f.numeric:
        def test(v):
            return numbers.compared_number(v.number, f.op, f.value) if v.number is not None else numbers.compared(v.text, f.op, f.value)
    else:
        text = {
            "exact": lambda t: t == F.lit(f.value),
            "contains": lambda t: t.contains(F.lit(f.value)),
            "regex": lambda t: t.rlike(java_regex(f.value)),
            "like": lambda t: t.like(wildcard_like(f.value)),
            "in": lambda t: t.isin(list(f.value)),
        }[f.op]

        def test(v):
            return _sure(text(v.text))

    return (lambda v: ~test(v)) if f.negated else test


def compiled(tree, fields) -> Column:
    """The tree over the fields that the resolver ``fields`` finds."""
    match tree:
        case Or(items) | And(items):
            out = compiled(items[0], fields)
            for item in items[1:]:
                more = compiled(item, fields)
                out = out | more if isinstance(tree, Or) else out & more
            return out
        case Not(item):
            return ~compiled(item, fields)
        case Level(op, rank):
            return _sure(numbers._apply(fields.rank, FLIPPED[op], F.lit(rank)))
        case Exists(key):
            return fields.predefined(key.name).text.isNotNull() if key.predefined else fields.present(key.name)
        case Field():
            test = _test(tree)
            if tree.key.predefined:
                value = fields.predefined(tree.key.name)
                return value.text.isNotNull() & _sure(test(value))
            found = fields.any(tree.key.name, test)
            if not tree.absent:
                return found
            # a pattern with [] that no element passes counts as absent
            return F.lit(True) if "[]" in tree.key.name else found | ~fields.present(tree.key.name)
    raise TypeError(tree)
