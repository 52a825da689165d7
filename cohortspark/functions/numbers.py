"""Numbers out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain or scientific number, and nothing that only a cast would accept ('1d', 'NaN', 'Inf'). Each function names its
# text once: a filter on the result is pushed below the projection, and would otherwise repeat a costly text.
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _extracted(text: Column, tail: str) -> Column:
    return F.regexp_extract(text, f"(?s)^({_NUMBER}){tail}$", 1).try_cast("double")


def as_number(text: Column) -> Column:
    """The text as a double, NULL where it is not one."""
    return _extracted(text, "")


def first_word_number(text: Column) -> Column:
    """The text before the first space as a double: '4.50 uIU/mL' is 4.5, '<0.01' is NULL."""
    return _extracted(text, "(?: .*)?")


def stripped_number(text: Column) -> Column:
    """The digits, points and minus signs of the text as a double: '<0.01' is 0.01."""
    return as_number(F.regexp_replace(text, "[^0-9.-]", ""))
