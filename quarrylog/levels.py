"""Severity levels: names, ranks and the words that a query may use for them."""

from __future__ import annotations

#: Rank 0 is the most severe.
LEVELS = ("error", "warning", "info", "debug", "trace")
RANK = {name: i for i, name in enumerate(LEVELS)}

# The short forms that queries and options accept.
ALIASES = {
    "error": ["error", "err", "e"],
    "warning": ["warning", "warn", "wrn", "w"],
    "info": ["info", "inf", "i"],
    "debug": ["debug", "dbg", "d"],
    "trace": ["trace", "trc", "t"],
}
BY_ALIAS = {alias: name for name, aliases in ALIASES.items() for alias in aliases}


def parse_level(text: str) -> int:
    """Rank of a level word, whatever its case."""
    name = BY_ALIAS.get(text.lower())
    if name is None:
        from .functions.suggest import suggest

        near = suggest(text.lower(), BY_ALIAS)
        raise ValueError(f"{text!r} is no level" + (f"; did you mean {' or '.join(near)}?" if near else ""))
    return RANK[name]
