"""Column helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words in the contracts: space and the controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str | Column) -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are no white space of ``SPACE``."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def row_key(*columns: str) -> Column:
    """A 128-bit hash of a row's columns (16 bytes); nulls differ from all values."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts)))
