"""From the query language's regular expressions to Java's."""

from __future__ import annotations

import re

_REFUSED = re.compile(r"\(\?(?:[=!]|<[=!]|>)|(?<!\\)(?:\\\\)*\\[1-9]|\\k<|[*+?}]\+")


def java_regex(pattern: str) -> str:
    """Unicode classes, ``.`` that stops at line feeds only, ``$`` at the very end; look-around and back-references are refused."""
    if _REFUSED.search(pattern):
        raise ValueError(f"look-around, back-references and possessive quantifiers are not supported: {pattern!r}")
    out, i, in_class, multiline = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif not in_class and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif not in_class and (m := re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]*)?[:)]", pattern[i:])):
            multiline = multiline or "m" in m[1]
        elif c == "$" and not in_class and not multiline:
            c = r"\z"
        out.append(c)
        i += 1
    return "(?Ud)" + "".join(out)
