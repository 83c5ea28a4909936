"""Which fields are shown: a tree of include and exclude rules, and empty values."""

from __future__ import annotations

import re

from ..functions.keys import normal, wildcard_regex


class Visibility:
    """Rules by key, level by level; a later pattern wins over earlier ones and evicts what it matches."""

    def __init__(self):
        self.setting: bool | None = None  # True shows, False hides
        self.children: dict[str, Visibility] = {}
        self.patterns: list[tuple[re.Pattern, Visibility]] = []

    def entry(self, key: str) -> Visibility:
        head, _, rest = key.partition(".")
        node = self._child(normal(head))
        return node.entry(rest) if rest else node

    def _child(self, key: str) -> Visibility:
        if "*" in key or "?" in key:
            pattern = re.compile(wildcard_regex(key))
            for known in [k for k in self.children if pattern.match(k)]:
                del self.children[known]
            self.patterns = [(p, n) for p, n in self.patterns if p.pattern != pattern.pattern]
            node = Visibility()
            self.patterns.append((pattern, node))
            return node
        return self.children.setdefault(key, Visibility())

    def set(self, shown: bool) -> None:
        self.setting = shown
        self.children.clear()
        self.patterns.clear()

    def get(self, key: str) -> Visibility | None:
        key = normal(key)
        if key in self.children:
            return self.children[key]
        return next((n for p, n in reversed(self.patterns) if p.match(key)), None)

    def shown(self, path: list[str]) -> bool:
        """Whether a leaf is shown: the deepest rule on its way decides."""
        node, out = self, self.setting is not False
        for key in path:
            node = node.get(key) if node else None
            if node is None:
                break
            if node.setting is not None:
                out = node.setting
        return out


def rules(options: list[str], hidden: list[str] = ()) -> Visibility:
    """From ``--hide`` options: ``k`` hides, ``!k`` reveals, ``*`` and ``!*`` all; a backslash takes a leading sign literally."""
    tree = Visibility()
    for key in hidden:
        tree.entry(key).set(False)
    for n, option in enumerate(options):
        reveal = option.startswith("!")
        key = option[1:] if reveal else option
        if key[:1] == "\\":
            key = key[1:]
        if key == "*":
            tree.set(reveal)
        else:
            if reveal and n == 0:
                tree.set(False)
            tree.entry(key).set(reveal)
    return tree


def is_empty(kind: str, text: str) -> bool:
    """Empty strings, nulls, {} and []; numbers and booleans never are."""
    return kind == "null" or kind == "string" and not text or kind in ("object", "array") and not text[1:-1].strip()
