"""Numbers as texts hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?\d+\z"
REAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
#: What an unquoted text must look like to be shown as a number, and how long it may be.
NUMBER, NUMBER_BYTES = r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?\z", 39


def integer(text: Column) -> Column:
    """Exact value of an integer text, null for others and beyond 38 digits."""
    return F.when(text.rlike(INTEGER), text.try_cast("decimal(38,0)"))


def real(text: Column) -> Column:
    """Double value of any number text; null for others."""
    return F.when(text.rlike(REAL), text.try_cast("double"))


def looks_like_number(text: Column) -> Column:
    return text.rlike(NUMBER) & (F.octet_length(text) <= NUMBER_BYTES)


def compared(text: Column, op: str, literal: str) -> Column:
    """``text <op> literal``: integers exactly, anything else as doubles; false if the text is no number."""
    value = real(text)
    asked = F.lit(float(literal))
    loose = _apply(value, op, asked)
    if not any(c in literal for c in ".eE"):
        whole = integer(text)
        loose = F.when(whole.isNotNull(), _apply(whole, op, F.lit(literal).cast("decimal(38,0)"))).otherwise(loose)
    return F.coalesce(loose, F.lit(False))


def compared_number(value: Column, op: str, literal: str) -> Column:
    """The same for a numeric column, so that the comparison reaches the scan."""
    asked = F.lit(float(literal)) if any(c in literal for c in ".eE") else F.lit(int(literal))
    return F.coalesce(_apply(value, op, asked), F.lit(False))


def _apply(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
