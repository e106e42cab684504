"""Column helpers for operators that stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the contracts call a word: everything between x20 and x09-x0D.
WORD = r"[^\x20\x09-\x0D]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_of(text: Column, character_class: str) -> Column:
    """How many characters of a class (written without brackets) a text has."""
    return F.length(F.regexp_replace(text, f"[^{character_class}]+", "")).cast("long")


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
