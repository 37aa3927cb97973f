"""Vendor identifiers, clocks and condition codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import clock_micros

#: Fixed value: option month codes are A to L for calls and M to X for puts, January first.
LAST_CALL = "L"
#: Fixed value: two-digit years up to it are of this century.
CENTURY_PIVOT = 72
#: Fixed value: what follows the point of an option's code.
OPTION_EXCHANGE = "U"
#: The two forms of a vendor's dates.
DATE_FORMS = ((r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"))


def option_symbol(code: Column) -> dict[str, Column]:
    """Root, kind, expiry and strike of ``ROOT`` + month code + day + year + strike (5 characters) + ``.U``.

    A lower-case month code means a strike in tenths, else it is in hundredths. Codes of another shape or
    exchange, days that aren't in the calendar and strikes that aren't above 0 give nulls everywhere.
    """
    shape = r"^\s*(\S.*?)([A-Xa-x])(\d{2})(\d{2})([\d.]{5})\." + OPTION_EXCHANGE + r"\s*$"
    part = lambda k: F.regexp_extract(code, shape, k)
    month = F.upper(part(2))
    number = (F.ascii(month) - 65) % 12 + 1
    year = part(4).try_cast("int")
    expiry = F.try_to_date(F.concat_ws("-", (F.when(year <= CENTURY_PIVOT, 2000).otherwise(1900) + year).cast("string"), F.lpad(number.cast("string"), 2, "0"), part(3)), "yyyy-MM-dd")
    strike = part(5).try_cast("double") / F.when(part(2) == F.lower(part(2)), 10.0).otherwise(100.0)
    fits = F.coalesce(code.rlike(shape) & expiry.isNotNull() & (strike > 0), F.lit(False))
    return {"root": F.when(fits, part(1)), "kind": F.when(fits, F.when(month <= LAST_CALL, "call").otherwise("put")), "expiry": F.when(fits, expiry), "strike": F.when(fits, strike)}


def vendor_date(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(*(F.when(t.rlike(shape), F.try_to_date(t, form)) for shape, form in DATE_FORMS))


def _moment(day: Column, micros: Column, offset_hours: Column) -> Column:
    shift = F.coalesce(offset_hours.cast("double"), F.lit(0.0)) * 3_600_000_000
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + micros + F.round(shift).cast("long")).cast("timestamp_ntz")


def quote_moment(day: Column, vendor_clock: Column, quote_clock: Column, offset_hours: Column) -> Column:
    """When a quote was made: its own clock, or the vendor's where it has none, on the vendor's day.

    Clocks over 23 hours apart lie on both sides of midnight; the quote is then on the day before or after. The offset
    from GMT (blank: 0) is added. Null without a date or the vendor's clock.
    """
    vendor, own = clock_micros(vendor_clock), clock_micros(F.when(F.coalesce(F.trim(quote_clock), F.lit("")) == "", vendor_clock).otherwise(quote_clock))
    gap, most, day_long = vendor - own, 23 * 3_600_000_000, 24 * 3_600_000_000
    gap = F.when(gap > most, gap - day_long).when(gap < -most, gap + day_long).otherwise(gap)
    return _moment(vendor_date(day), vendor - gap, offset_hours)


def trade_moment(trade_day: Column, vendor_day: Column, exchange_clock: Column, offset_hours: Column) -> Column:
    """When a trade was made: the exchange's clock on the trade's day, or the vendor's where that is blank, moved by the offset."""
    day = F.when(F.coalesce(F.trim(trade_day), F.lit("")) == "", vendor_day).otherwise(trade_day)
    return _moment(vendor_date(day), clock_micros(exchange_clock), offset_hours)


def flags(tags: Column, names: dict[str, str]) -> list[Column]:
    """A boolean for each wanted tag of a ``;`` list; blanks and case don't count, null has none."""
    held = F.transform(F.split(F.coalesce(tags, F.lit("")), ";"), lambda x: F.upper(F.trim(x)))
    return [F.array_contains(held, tag).alias(name) for name, tag in names.items()]


def epoch_seconds(number: Column) -> Column:
    """Seconds of a time given in seconds or in milliseconds; null for other magnitudes."""
    inside = lambda low, high: (number >= low) & (number < high)
    return F.when(inside(1e9, 1e11), number).when(inside(1e12, 1e14), number / 1000)


def expiry_bucket(days: Column) -> Column:
    """0DTE, 1DTE or 7-21DTE; null for all other days to expiry."""
    return F.when(days == 0, "0DTE").when(days == 1, "1DTE").when(days.between(7, 21), "7-21DTE")


def quote_flags(bid: Column, ask: Column, wide: float) -> dict[str, Column]:
    """What is odd about a quote; rows are kept, whatever is."""
    good = (bid > 0) & (ask > 0)
    return {"no_bid": ~(bid > 0), "no_ask": ~(ask > 0), "crossed": good & (bid > ask), "locked": good & (bid == ask), "wide": good & (ask - bid > wide * (ask + bid) / 2)}


#: The shape of an exchange's option contract (root, day, right, strike in thousandths), and of a streamed one.
OCC = r"^([A-Z]{1,6}) *(\d{6})([CP])(\d{8})$"
STREAMED = r"^\.?([A-Z][A-Z0-9]*?)(\d{6})([CP])(\d*\.?\d+)$"


def occ_parts(code: Column) -> dict[str, Column]:
    """Root, expiration, right (C or P) and strike of a contract's code; nulls for other shapes and days that aren't in the calendar."""
    part = lambda k: F.regexp_extract(code, OCC, k)
    expiry = F.try_to_date(part(2), "yyMMdd")
    fits = F.coalesce(code.rlike(OCC) & expiry.isNotNull(), F.lit(False))
    return {"root": F.when(fits, part(1)), "expiration": F.when(fits, expiry), "right": F.when(fits, part(3)), "strike": F.when(fits, part(4).try_cast("long") / 1000)}


def occ_symbol(root: Column, expiration: Column, right: Column, strike: Column) -> Column:
    """The code of a contract; null unless its root has 1 to 6 letters, its right is C or P and its strike is above 0 in whole thousandths."""
    mills = F.round(strike.cast("double") * 1000).cast("long")
    ok = root.rlike("^[A-Z]{1,6}$") & right.isin("C", "P") & (mills > 0) & (mills < 10**8) & expiration.isNotNull()
    return F.when(ok, F.concat(root, F.date_format(expiration, "yyMMdd"), right, F.lpad(mills.cast("string"), 8, "0")))


def contract_reason(code: Column, root: Column, expiration: Column, right: Column, strike: Column) -> Column:
    """What a contract's code and the row about it disagree on: shape, root, expiration, right, strike; null if nothing."""
    own = occ_parts(code)
    rules = [("shape", own["root"].isNotNull()), ("root", own["root"] == root), ("expiration", own["expiration"] == expiration), ("right", own["right"] == right), ("strike", F.round(own["strike"] * 1000) == F.round(strike.cast("double") * 1000))]
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules))


def streamed_parts(code: Column) -> dict[str, Column]:
    """The same of a streamed symbol, whose strike is written out; case and spaces around it don't count."""
    text = F.upper(F.trim(code))
    part = lambda k: F.regexp_extract(text, STREAMED, k)
    expiry = F.try_to_date(part(2), "yyMMdd")
    fits = F.coalesce(text.rlike(STREAMED) & expiry.isNotNull(), F.lit(False))
    return {"root": F.when(fits, part(1)), "expiration": F.when(fits, expiry), "right": F.when(fits, part(3)), "strike": F.when(fits, part(4).try_cast("double"))}
