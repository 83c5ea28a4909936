"""Sets of strings for ``in @name``: one a line, JSON-quoted where a line begins with a double quote."""

from __future__ import annotations

import json
import sys


def members(lines) -> list[str]:
    out = []
    for n, line in enumerate(lines, 1):
        line = line.rstrip("\r\n")
        if line.startswith('"'):
            try:
                line = json.loads(line)
            except ValueError as e:
                raise ValueError(f"line {n}: {e}") from None
        out.append(line)
    return out


def read_set(name: str) -> list[str]:
    if name == "-":
        return members(sys.stdin)
    with open(name, encoding="utf-8", newline="\n") as f:
        return members(f)
