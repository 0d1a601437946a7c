"""Field rules as Column functions: how text, numbers, flags and lists of a record become values.

All leaves of a record are parsed as strings; what is missing, empty or malformed is decided here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Missing or empty text is ''; text is never trimmed."""
    return F.coalesce(c, F.lit(""))


def strict_int(c: Column) -> Column:
    """Missing or empty is NULL; anything but a 32-bit integer fails the query (ANSI cast)."""
    return F.nullif(c, F.lit("")).cast("int")


def int_or_zero(c: Column) -> Column:
    """Missing, empty or malformed is 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def flag(c: Column) -> Column:
    """NULL when absent; present text is compared with 'true', so '' is false."""
    return c == F.lit("true")


def flag_or_null(c: Column) -> Column:
    """Missing or empty is NULL, else whether it is 'true'."""
    return F.when(F.nullif(c, F.lit("")).isNotNull(), c == F.lit("true"))


def flag_or_false(c: Column) -> Column:
    """Missing is false."""
    return F.coalesce(c == F.lit("true"), F.lit(False))


def text_list(c: Column) -> Column:
    """Missing list is []; missing and empty items go, blank ones stay."""
    return F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != F.lit(""))), F.array().cast("array<string>"))


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != F.lit("")


def named(c: Column, name: str = "name") -> Column:
    """Items of an array of structs whose name is not empty."""
    return F.filter(c, lambda x: present(x[name]))


def joined(containers: Column, item: str) -> Column:
    """Items of repeated containers, in order: an array of structs of arrays becomes one array."""
    return F.flatten(F.filter(F.transform(containers, lambda x: x[item]), lambda x: x.isNotNull()))


def json_strings(column: str) -> Column:
    """Items of a text column that holds a JSON array of strings."""
    return F.explode(F.from_json(F.col(column), "array<string>"))
