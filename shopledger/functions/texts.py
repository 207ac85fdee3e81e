"""Text expressions (FLT-02, FN-11..13, FN-18..20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings that count as a set flag.
TRUE_WORDS = ["1", "Y", "y", "true", "TRUE", "True"]


def norm_blank(col: Column) -> Column:
    """FLT-02: NULL, '' and blanks become one empty bucket."""
    return F.trim(F.coalesce(col, F.lit("")))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def before(col: Column, mark: str) -> Column:
    """FN-12: text before the first separator, the whole text if absent."""
    return F.trim(F.substring_index(col, mark, 1))


def squeeze(col: Column) -> Column:
    """FN-13: collapse runs of white space."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def class_tail(col: Column) -> Column:
    """FN-13: last part of a dotted name."""
    return F.regexp_replace(col, r"^.*\.", "")


def fallback(*cols: Column) -> Column:
    """FN-18: first value that is known."""
    return F.coalesce(*cols)


def truthy(col: Column) -> Column:
    """FN-19: text flag as a boolean."""
    return F.coalesce(col.isin(TRUE_WORDS), F.lit(False))


def json_get(col: Column, path: str) -> Column:
    """FN-20: one field of a JSON text."""
    return F.get_json_object(col, path)
