"""LogFrame: log records as a lazy plan.

A LogFrame is a DataFrame with a resolver that knows where fields are, a
timestamp and an order.  Every method returns a new one and runs nothing.
"""

from __future__ import annotations

from dataclasses import replace
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .levels import RANK
from .plans.compile import NodesResolver, TableResolver, compiled
from .plans.filters import Selection
from .plans.query import parse


def level_rank(words: dict[str, str], value: Column) -> Column:
    """Rank of a level word through a literal map; null for other words."""
    pairs = [F.lit(x) for word, level in words.items() for x in (word, RANK[level])]
    return F.element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("int")


def ordered(df: DataFrame, position: tuple[str, ...], *order) -> DataFrame:
    """``df`` sorted.  Spark samples the bounds of ranges by running the plan below the sort; where that parses text, it reads what a shuffle wrote."""
    return (df.repartition(*position) if "parse_status" in df.columns or "line" in df.columns else df).orderBy(*order)


@dataclass(frozen=True)
class LogFrame:
    df: DataFrame
    resolver: object
    ts: Column
    #: Columns of the position within all inputs.
    position: tuple[str, ...]
    #: The column that tells inputs apart.
    source: str | None = None

    @classmethod
    def from_table(cls, df: DataFrame, position: tuple[str, ...], ts: str | None = None, level: tuple[str, dict[str, str]] | None = None, message: str | None = None, logger: str | None = None, json: tuple[str, ...] = (), source: str | None = None) -> LogFrame:
        """A table's rows as records: its columns are the fields, with no way through text."""
        name = lambda c: F.col(c) if c else None
        rank = level_rank(level[1], F.col(level[0])) if level else None
        return cls(df, TableResolver(df.schema, rank, name(message), name(logger), None, json), F.col(ts) if ts else F.lit(None).cast("timestamp"), position, source)

    @classmethod
    def from_records(cls, df: DataFrame) -> LogFrame:
        return cls(df, NodesResolver(), F.col("ts"), ("input_id", "offset", "rec_no"), "input_id")

    def where(self, query: str | Selection | Column, read_set=None) -> LogFrame:
        """Records that a query, a selection or any Boolean column holds for."""
        if isinstance(query, str):
            query = compiled(parse(query, read_set), self.resolver)
        elif isinstance(query, Selection):
            query = query.column(self.resolver, self.ts, read_set)
        return replace(self, df=self.df.where(query))

    def in_order(self) -> DataFrame:
        """Input by input, as read."""
        return ordered(self.df, self.position, *self.position)

    def timed(self) -> LogFrame:
        """Records that have a time."""
        return replace(self, df=self.df.where(self.ts.isNotNull()))

    def sorted(self) -> DataFrame:
        """In the order of time; records without one are left out.  Ties are in input order."""
        return ordered(self.timed().df, self.position, *self._time(), *self.position)

    def _time(self) -> list[Column]:
        return [F.col("ts_sec"), F.col("ts_nsec")] if "ts_sec" in self.df.columns else [self.ts]

    def tail(self, n: int) -> LogFrame:
        """The last ``n`` entries of each input, whatever they hold."""
        keys = [self.source] if self.source else []
        order = [F.desc(c) for c in self.position if c not in keys]
        ranked = self.df.withColumn("__from_end", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return replace(self, df=ranked.where(f"__from_end <= {n}").drop("__from_end"))
