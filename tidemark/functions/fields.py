"""Small rules over single fields: codes, tri-state tokens, identifiers, clocks, ages and bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divisions of the standard industrial classification, first and last code of each.
DIVISIONS = (
    ("A", 100, 999),
    ("B", 1000, 1499),
    ("C", 1500, 1799),
    ("D", 2000, 3999),
    ("E", 4000, 4999),
    ("F", 5000, 5199),
    ("G", 5200, 5999),
    ("H", 6000, 6799),
    ("I", 7000, 8999),
    ("J", 9100, 9729),
)


def division(code: Column, table=DIVISIONS) -> Column:
    """The letter whose range holds the code, or ``UNCLASSIFIED``; null for what is no number."""
    number = code.try_cast("int")
    held = F.coalesce(*(F.when(number.between(low, high), letter) for letter, low, high in table), F.lit("UNCLASSIFIED"))
    return F.when(number.isNotNull(), held)


def bracketed_code(text: Column, width: int = 4) -> Column:
    """The first bracketed number of a text, filled with zeros; empty if it has none."""
    found = F.regexp_extract(text, rf"\[(\d{{1,{width}}})\]", 1)
    return F.when(found == "", "").otherwise(F.lpad(found, width, "0"))


def truth(text: Column) -> Column:
    """``1``, ``0``, or empty for what says neither."""
    x = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(x.isin("1", "true", "yes", "y"), "1").when(x.isin("0", "false", "no", "n"), "0").otherwise("")


def match_grade(distance: Column, widest: Column) -> Column:
    """How close a matched control is, by its distance and its widest single difference."""
    return F.when((distance <= 1.0) & (widest <= 1.5), "good").when((distance <= 1.5) & (widest <= 2.5), "acceptable").otherwise("weak")


def short_id(prefix: str, *parts: Column) -> Column:
    """A name made of the parts: the prefix and 16 upper-case digits of their digest."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 16)))


def code_set(text: Column) -> Column:
    """The different condition characters of a field, sorted; white space and separators aren't codes."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s,;|/]", "")
    return F.array_sort(F.array_distinct(F.array_remove(F.split(kept, ""), "")))


def clock_micros(clock: Column) -> Column:
    """Microseconds since midnight of ``HH:MM:SS`` with any fraction; null for other shapes."""
    part = lambda k: F.regexp_extract(clock, r"^\s*(\d+):(\d+):(\d+(?:\.\d*)?)\s*$", k)
    seconds = F.round(part(3).try_cast("double") * 1e6).cast("long")
    return part(1).try_cast("long") * 3_600_000_000 + part(2).try_cast("long") * 60_000_000 + seconds


def fraction_digits(clock: Column) -> Column:
    """How many digits follow the seconds' point; none without one."""
    return F.length(F.regexp_extract(F.coalesce(clock, F.lit("")), r"^[^.]*\.(\d+)", 1))


def two_sided_age(bid: Column, ask: Column, now: Column, ahead: float = 60) -> Column:
    """Seconds since the older side; null if a side is missing or lies more than ``ahead`` in the future."""
    usable = bid.isNotNull() & ask.isNotNull() & (F.greatest(bid, ask) <= now + ahead)
    return F.when(usable, F.round(F.greatest(F.lit(0.0), now - F.least(bid, ask)), 1))


def fresh(at: Column, quoted: Column, most: float = 120) -> Column:
    """Whether a quote is at most ``most`` seconds old; one from the future isn't fresh, nor is a missing one."""
    return F.coalesce((at - quoted).between(0, most), F.lit(False))


def fraction_iv(value: Column) -> Column:
    """A volatility given as a fraction, over 0 and at most 3; others are ambiguous and give null."""
    return F.when((value > 0) & (value <= 3), F.round(value, 5))


def bar_faults(at: Column, decision: Column, opens: Column, high: Column, low: Column, close: Column, volume: Column) -> dict[str, Column]:
    """What a bar breaks, in the order that it is judged; a bar without a time, or after the decision, comes first."""
    finite = lambda c: F.coalesce((c > 0) & (c < float("inf")) & ~F.isnan(c), F.lit(False))
    return {
        "time": at.isNull() | decision.isNull() | (at > decision),
        "prices": ~(finite(opens) & finite(high) & finite(low) & finite(close)),
        "bounds": (low > F.least(opens, close)) | (high < F.greatest(opens, close)),
        "volume": F.coalesce((volume < 0) | (volume != F.floor(volume)), F.lit(True)),
    }


def earliest_start(packed: Column) -> Column:
    """Minute of the day at which the first of ``HH:MM-HH:MM;...`` starts; parts of other shapes don't count."""
    start = lambda s, k: F.regexp_extract(s, r"^\s*(\d{1,2}):(\d{1,2})\s*-", k).try_cast("int")
    return F.array_min(F.transform(F.split(packed, ";"), lambda s: start(s, 1) * 60 + start(s, 2)))
