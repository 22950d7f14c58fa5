"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character that counts as white space at the ends of a value.
_WS = r"\p{IsWhite_Space}"


def strip_ws(c: Column | str) -> Column:
    """Drop white space of any kind (tabs, line ends, no-break blanks) at both ends;
    Spark's ``trim`` drops blanks only."""
    return F.regexp_replace(col(c), rf"^{_WS}+|{_WS}+\z", "")


def is_blank(c: Column | str) -> Column:
    return F.length(strip_ws(c)) == 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body`` any number of times.

    A higher-order function over a one-element array: the bound expression is
    evaluated once per row and the expression tree does not repeat it, which
    keeps nested URL/text rules linear in size.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
