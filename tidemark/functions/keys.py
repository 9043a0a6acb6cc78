"""Normalised keys and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outer_trim(c: Column) -> Column:
    """Without white space of any kind at either end; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def upper_key(c: Column) -> Column:
    """Trimmed and in upper case; a blank key is null."""
    t = F.upper(outer_trim(c))
    return F.when(t != "", t)


def month_ix(c: Column) -> Column:
    """Months since year 0: ``year * 12 + month - 1``."""
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def month_text(ix: Column) -> Column:
    """``yyyy-MM`` of a month index."""
    year = F.floor(ix / F.lit(12)).cast("int")
    return F.format_string("%04d-%02d", year, F.pmod(ix, F.lit(12)) + F.lit(1))


def month_key_ix(c: Column) -> Column:
    """Month index of a ``yyyy-MM`` text; null when it isn't one."""
    ok = c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.when(ok, F.substring(c, 1, 4).try_cast("int") * 12 + F.substring(c, 6, 2).try_cast("int") - 1)
