"""Typed parsing of untyped text: blanks are null, malformed values are flagged, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def symbol(c: Column, longest: int = 64) -> Column:
    """Trimmed and upper-case; null if blank or longer than ``longest``."""
    s = F.upper(F.trim(c))
    return F.when(F.length(s).between(1, longest), s)


def whole(c: Column) -> Column:
    """A signed 64-bit whole number written as a decimal; null if it has a fraction or doesn't fit."""
    d = c.try_cast("decimal(38,9)")
    return F.when((d == F.floor(d)) & d.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")), d.try_cast("bigint"))


def finite(c: Column) -> Column:
    """A finite double, else null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def digits(c: Column, places: int = 10) -> Column:
    """A double as text with at most ``places`` digits behind the point and no trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{places}f", c), r"\.?0+$", "")


def local_to_utc(wall: Column, zone: str) -> tuple[Column, Column, Column]:
    """UTC time of a wall clock, and whether the clock skips it (gap) or shows it twice (fold)."""
    t = wall.cast("timestamp")
    utc = F.to_utc_timestamp(t, zone)
    gap = F.from_utc_timestamp(utc, zone) != t
    fold = ~gap & ((F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), zone) == t) | (F.from_utc_timestamp(utc - F.expr("INTERVAL 1 HOUR"), zone) == t))
    return F.when(~gap & ~fold, utc), gap, fold


def year_or_none(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}$"), c.cast("int"))


def content_hash(*columns: Column) -> Column:
    """SHA-256 over columns as text, nulls as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)
