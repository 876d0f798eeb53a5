"""Scalar cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_label(c: Column) -> Column:
    """Stripped, without trailing dots, in lower case."""
    return F.lower(F.regexp_replace(stripped(c), r"\.+$", ""))


def as_number(c: Column) -> Column:
    """Double; null where the text is no number."""
    return c.try_cast("double")


def filled(c: Column) -> Column:
    """Text with a level of its own for nulls."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def null_like(c: Column) -> Column:
    """Text; null also for the words that stand for it."""
    text = c.cast("string")
    return F.when(~text.isin("nan", "<NA>", "None"), text)


def attack_flag(label: Column, normal: str = "normal") -> Column:
    """1 where a cleaned label is not the normal one; a null label gives 0."""
    return F.coalesce((label != normal).cast("int"), F.lit(0))


def numeric_flag(c: Column) -> Column:
    """A 0/1 label from text; what is no number gives 0."""
    return F.coalesce(as_number(c).try_cast("int"), F.lit(0))


def r6(c: Column) -> Column:
    """Rounded to six places."""
    return F.round(c.cast("double"), 6)
