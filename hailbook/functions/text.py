"""Whitespace, list and de-duplication helpers: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hailbook.constants import LIST_SEPARATOR, WHITESPACE, WS

StrCol = Column | str


def col(value: StrCol) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_or_empty(value: StrCol) -> Column:
    """NULL becomes the empty string, the only "absent" value used here."""
    return F.coalesce(col(value), F.lit(""))


def strings_or_empty(values: StrCol) -> Column:
    return F.coalesce(col(values), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Expressions inside a lambda get no common-subexpression elimination, so a
    value read several times per element is bound as a lambda variable: the
    start of an aggregate over no elements, whose last step is ``body``. That
    makes no array, unlike a transform of an array of one.
    """
    none = F.array().cast("array<int>")
    return F.aggregate(none, value, lambda bound, _: bound, body)


def strip(value: StrCol) -> Column:
    """Trim Unicode whitespace from both ends."""
    return F.btrim(text_or_empty(value), F.lit(WHITESPACE))


def clean_whitespace(value: StrCol) -> Column:
    """Collapse each whitespace run to one blank and trim the ends."""
    return F.regexp_replace(strip(value), F.lit(WS + "+"), F.lit(" "))


def unique_in_order(values: StrCol) -> Column:
    """Distinct array elements in first-seen order."""
    return F.array_distinct(strings_or_empty(values))


def unique_non_empty(values: StrCol, normalize: Callable[[Column], Column]) -> Column:
    """Normalise every element, drop the empty ones, keep first-seen order."""
    cleaned = F.transform(strings_or_empty(values), normalize)
    return F.array_distinct(F.filter(cleaned, lambda v: v != ""))


def join_unique(values: StrCol, separator: str = LIST_SEPARATOR) -> Column:
    """Whitespace-clean, de-duplicate and join array elements."""
    return F.array_join(unique_non_empty(values, clean_whitespace), separator)


def as_list(value: StrCol) -> Column:
    """A scalar string becomes a one-element array, NULL an empty one."""
    value = col(value)
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def as_array(values: StrCol) -> Column:
    """An array column with NULL read as the empty array."""
    return strings_or_empty(values)
