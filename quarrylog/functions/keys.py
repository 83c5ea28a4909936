"""Field keys: normal forms, paths with array steps, and wildcard patterns."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER = str.maketrans(string.ascii_uppercase + "_", string.ascii_lowercase + "-")


def normal(key: str) -> str:
    """ASCII lower case, underscores as hyphens."""
    return key.translate(_LOWER)


def normal_column(key: Column) -> Column:
    return F.translate(key, string.ascii_uppercase + "_", string.ascii_lowercase + "-")


def pretty(key: Column) -> Column:
    return F.translate(key, "_", "-")


def wildcard_like(pattern: str) -> str:
    """A SQL LIKE pattern (escaped by backslashes) for one with ``*``, ``?`` and backslash escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
            out.append("\\" + c if c in "%_\\" else c)
        elif c == "*":
            out.append("%")
        elif c == "?":
            out.append("_")
        else:
            out.append("\\" + c if c in "%_\\" else c)
        i += 1
    return "".join(out)


def wildcard_regex(pattern: str) -> str:
    """An anchored Python regular expression for the same pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return f"(?s:{''.join(out)})\\Z"


def path_matches(path: Column, pattern: str) -> Column:
    """Whether a node's path is that of the pattern; ``[]`` stands for any element."""
    want = normal(pattern)
    if "[]" not in want:
        return path == F.lit(want)
    return path.rlike("^" + r"\[\d+\]".join(java_literal(x) for x in want.split("[]")) + r"\z")


def java_literal(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}-])", r"\\\1", text)
