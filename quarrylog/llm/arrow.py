"""Arrow batches in, Arrow batches out, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows, and characters of text, that are held as Python objects at once.
SLICE_ROWS, SLICE_CHARS = 512, 4_000_000


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most ``rows`` rows and, unless one row has more, ``chars`` bytes in column ``text``."""
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.column(text).nbytes > chars:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def map_texts(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], dict | list]], text: int = 1, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> DataFrame:
    """Apply ``make()``, built once a task, to slices of ``df``; it returns columns by name in the order of ``ddl``."""
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        function = make()
        for part in slices(batches, text, rows, chars):
            columns = function(part)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)
        if hasattr(function, "rest"):
            columns = function.rest()
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    # mapInArrow does not find columns whose names need quotes; the functions know them by place
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)
