"""Type repair column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_int_zero(c) -> Column:
    """To number, truncate, bad or null -> 0 (pandas to_numeric + fillna(0))."""
    return F.coalesce(_c(c).cast("string").try_cast("double").try_cast("int"), F.lit(0))


def explicit_flag(c, dtype: DataType | None = None) -> Column:
    """Booleans -> 0/1; anything else through B5 (text 'True' -> 0)."""
    if isinstance(dtype, BooleanType):
        return F.coalesce(_c(c).cast("int"), F.lit(0))
    if isinstance(dtype, NumericType):
        return F.coalesce(_c(c).cast("int"), F.lit(0))
    return coerce_int_zero(c)


def year_prefix(c) -> Column:
    """Leading four digits as int, else null."""
    return F.nullif(F.regexp_extract(_c(c).cast("string"), r"^(\d{4})", 1), F.lit("")).try_cast("int")


def year_from_date_prefix(c) -> Column:
    """release_year = first four characters of release_date (as text)."""
    return F.substring(_c(c).cast("string"), 1, 4)


def release_year_or_zero(c) -> Column:
    """Q1/Q2: year from the 4-digit prefix, unknown -> 0 (recommender rule)."""
    return F.coalesce(year_prefix(c), F.lit(0))
