"""Column builders for missing values, numbers and truth words in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An optional sign, ASCII digits with at most one decimal point, an optional exponent.
NUMBER = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
TRUE_WORDS = ("1", "true", "yes", "y", "refused", "unsafe")
FALSE_WORDS = ("0", "false", "no", "n", "non_refusal", "safe")


def filled(c: Column) -> Column:
    """Neither NULL nor empty nor plain spaces only; never NULL itself."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def missing(c: Column) -> Column:
    return ~filled(c)


def is_number(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(NUMBER), F.lit(False))


def number(c: Column) -> Column:
    """The value as double where the text is a number, else NULL."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def truth(c: Column) -> Column:
    """Truth words to true or false, anything else NULL."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)
