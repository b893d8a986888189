"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or(c: Column, default: Column) -> Column:
    """``c`` where it is finite, else ``default``; null stays null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), default).otherwise(c)


def is_finite(c: Column) -> Column:
    """True for numbers that aren't NaN or infinite; null gives null."""
    return ~(F.isnan(c) | (F.abs(c) == float("inf")))


def clamp(c: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(c, lo), hi)


def parse_or_keep(text: Column, current: Column) -> Column:
    """The text as an integer; ``current`` where it isn't one."""
    whole = F.regexp_extract(text, r"^\s*([+-]?\d{1,10})\s*$", 1)
    return F.coalesce(F.when(whole != "", whole).try_cast("int"), current)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def centre_index(lo: Column, hi: Column) -> Column:
    """The middle index, with division towards zero."""
    total = lo + hi
    return F.when(total >= 0, F.floor(total / 2)).otherwise(F.ceil(total / 2)).cast("int")


def mean_spacing(x: Column, y: Column, z: Column) -> Column:
    """The unit distance of compositing."""
    return (x + y + z) / 3


def separator_collapse(items: Column, separator: str = "--") -> Column:
    """Menu items without leading, trailing and repeated separators."""
    kept = F.filter(items, lambda x, i: (x != separator) | ((i > 0) & (F.get(items, i - 1) != separator)))
    return F.when((F.size(kept) > 0) & (F.element_at(kept, -1) == separator), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)


def window_title(name: Column, version: Column) -> Column:
    """A window's title: the file name and the first 7 characters of a revision."""
    return F.format_string("%s (%s)", F.trim(name), F.left(version, F.lit(7)))
