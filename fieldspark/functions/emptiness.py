"""When a JSON value counts as empty: six predicates over its JSON text, which differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDERS = ("not available", "not found", "pending", "unknown", "null", "none", "na", "n/a")
_BLANK = r'(?U)^"(\s|\\[tnrf])*"$'


def empty_strict(v: Column) -> Column:
    """Null, empty string, list or object. Zero and false are values."""
    return v.isNull() | v.isin("null", '""', "[]", "{}")


def empty_blank(v: Column) -> Column:
    """As strict, and strings of white space."""
    return empty_strict(v) | v.rlike(_BLANK)


def empty_placeholder(v: Column) -> Column:
    """As strict, and a placeholder such as N/A, in any case but without blanks around it."""
    return empty_strict(v) | F.lower(v).isin(*[f'"{p}"' for p in PLACEHOLDERS])


def empty_pass(v: Column) -> Column:
    """Null, empty string or list; an empty object is a value."""
    return v.isNull() | v.isin("null", '""', "[]")


def falsy(v: Column) -> Column:
    """As strict, and zero and false."""
    return empty_strict(v) | v.isin("0", "0.0", "-0.0", "false")


def required_empty(v: Column) -> Column:
    """Absent, null or an empty string."""
    return v.isNull() | v.isin("null", '""')


PREDICATES = {f.__name__: f for f in (empty_strict, empty_blank, empty_placeholder, empty_pass, falsy, required_empty)}
