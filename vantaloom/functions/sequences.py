"""Sequence, string and calendar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unique_copy(a: Column) -> Column:
    """An array without repeats of the entry before."""
    return F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1) != x), x)), lambda x: x.isNotNull())


def merged(a: Column, b: Column) -> Column:
    """Two arrays as one sorted array."""
    return F.sort_array(F.concat(a, b))


def count_equal(a: Column, value: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == value))


def rotated(a: Column, n: int) -> Column:
    """An array with its first n entries moved to its end."""
    return F.concat(F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0))), F.slice(a, 1, n))


def is_sorted(a: Column) -> Column:
    return F.sort_array(a) == a


def replaced(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x == old, new).otherwise(x))


def tokens(text: Column, separators: str = r"[\s,;]+") -> Column:
    """Non-empty pieces between separators."""
    return F.filter(F.split(text, separators), lambda x: x != "")


def nth_weekday(first_of_month: Column, weekday: int, n: int) -> Column:
    """The n-th such weekday (1 Sunday to 7 Saturday) of a month."""
    ahead = F.pmod(F.lit(weekday) - F.dayofweek(first_of_month), F.lit(7))
    return F.date_add(first_of_month, ahead + 7 * (n - 1))


def period_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """(start, end) of two half-open periods' overlap, or null."""
    start, end = F.greatest(a1, b1), F.least(a2, b2)
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))
