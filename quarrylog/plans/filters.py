"""All that selects records: level, time range, ``-f`` conditions, queries and memberships."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..levels import parse_level
from .compile import compiled
from .query import parse, parse_option

#: A side up to this many rows may be broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass
class Selection:
    """Everything given must hold: cheapest first."""

    level: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    fields: list[str] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.level or self.since or self.until or self.fields or self.queries)

    def column(self, resolver, ts: Column, read_set=None) -> Column:
        """``ts`` null passes a time range: such records can't be told to be outside."""
        parts = []
        if self.since is not None:
            parts.append(ts.isNull() | (ts >= F.lit(self.since)))
        if self.until is not None:
            parts.append(ts.isNull() | (ts <= F.lit(self.until)))
        if self.level is not None:
            parts.append(F.coalesce(resolver.rank <= parse_level(self.level), F.lit(False)))
        parts += [compiled(parse_option(x), resolver) for x in self.fields]
        parts += [compiled(parse(x, read_set), resolver) for x in self.queries]
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


def membership(rows: DataFrame, key: str, members: DataFrame, negated: bool = False) -> DataFrame:
    """Rows whose ``key`` is in (or not in) the first column of ``members``, a set too large for a literal.

    The set is broadcast only while a count shows it small; otherwise both
    sides are shuffled.  A null key is in no set and passes neither.
    """
    (name, *_) = members.columns
    some = members.select(F.col(name).alias("__member")).where("__member is not null").distinct()
    if some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    rows = rows.where(F.col(key).isNotNull())
    return rows.join(some, rows[key] == some["__member"], "left_anti" if negated else "left_semi")
