"""Sessions, clipped windows and event grids as column expressions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(anchor: Column, opens: Column, closes: Column, before: int, after: int) -> tuple[Column, Column]:
    """First and last whole minute of the window around an anchor, inside the session."""
    minute = lambda c: F.date_trunc("minute", c).cast("timestamp_ntz")
    return minute(F.greatest(anchor - F.make_dt_interval(mins=F.lit(before)), opens)), minute(F.least(anchor + F.make_dt_interval(mins=F.lit(after)), closes))


def inclusive_minutes(start: Column, end: Column) -> Column:
    """Minutes from start to end, both counted; none if they are the wrong way round."""
    return F.greatest(F.timestamp_diff("MINUTE", start, end) + 1, F.lit(0))


def beyond(start: Column, end: Column, closes: Column, extension: int) -> Column:
    """How many minutes of a window lie so late that ``extension`` minutes more pass the close."""
    last = closes - F.make_dt_interval(mins=F.lit(extension))
    return F.least(inclusive_minutes(start, end), F.greatest(F.timestamp_diff("MINUTE", F.greatest(start - F.make_dt_interval(mins=F.lit(1)), F.date_trunc("minute", last).cast("timestamp_ntz")), end), F.lit(0)))


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday (Monday is 0) of a month; -1 is the last."""
    if n < 0:
        last = date(year, month + 1, 1) - timedelta(days=1)
        return last - timedelta(days=(last.weekday() - weekday) % 7)
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def _observed(day: date) -> date:
    """Saturdays are observed on the Friday before, Sundays on the Monday after."""
    return day + timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def federal_holidays(first: int, last: int) -> list[date]:
    """Days on which US federal holidays of the years from ``first`` to ``last`` are observed."""
    out = []
    for y in range(first, last + 1):
        out += [_observed(d) for d in (date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25))]
        out += [_nth(y, 2, 0, 3), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 10, 0, 2), _nth(y, 11, 3, 4)]
        out += [_nth(y, 1, 0, 3)] if y >= 1986 else []
        out += [_observed(date(y, 6, 19))] if y >= 2021 else []
    return sorted(out)


def _neighbour(day: Column, holidays: list[date], step: int) -> Column:
    """The nearest business day strictly after (or before) a day: the first of ten that is no weekend and no holiday."""
    days = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.date_add(day, k * step))
    closed = F.array(*(F.lit(d) for d in holidays)) if holidays else F.array().cast("array<date>")
    return F.get(F.filter(days, lambda d: F.dayofweek(d).between(2, 6) & ~F.array_contains(closed, d)), F.lit(0))


def next_business_day(day: Column, holidays: list[date] = ()) -> Column:
    return _neighbour(day, holidays, 1)


def previous_business_day(day: Column, holidays: list[date] = ()) -> Column:
    return _neighbour(day, holidays, -1)


def _after_noon(at: Column) -> Column:
    return at > F.to_date(at).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))


def research_open(at: Column, day: Column | None = None, holidays: list[date] = (), open_minute: int = 570) -> Column:
    """The session opening that an event is judged at: its own date's, or the next business day's if it came after 12:00:00."""
    own = F.to_date(at) if day is None else day
    chosen = F.when(_after_noon(at), next_business_day(own, holidays)).otherwise(own)
    return chosen.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(open_minute))


def sample_days(at: Column, day: Column, holidays: list[date] = ()) -> tuple[Column, Column]:
    """The last day before an event and the first after it: a date whose event came by 12:00:00 is already after."""
    before = F.when(_after_noon(at), day).otherwise(previous_business_day(day, holidays))
    return before, next_business_day(before, holidays)


def quote_grids(at: Column, opens: Column) -> dict[str, Column]:
    """Five minutes to either side by seconds, and from five before to two hours after by minutes, of an event and of its opening."""
    second, minute = F.expr("INTERVAL '1' SECOND"), F.expr("INTERVAL '1' MINUTE")
    mins = lambda n: F.make_dt_interval(mins=F.lit(n))
    spans = {"1s": (5, 5, second), "1m": (5, 120, minute)}
    return {f"{name}_{unit}": F.sequence(c - mins(a), c + mins(b), step) for name, c in (("announcement", at), ("opening", opens)) for unit, (a, b, step) in spans.items()}


def trade_grid(at: Column, opens: Column, after_open: int = 30) -> Column:
    """Minutes counted from the event: from five before it until ``after_open`` past its opening, rounded up to whole ones."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    until = F.ceil((micros(opens) - micros(at)) / 60_000_000) + after_open
    last = at + F.make_dt_interval(mins=until.cast("int"))
    return F.when(until >= -5, F.sequence(at - F.make_dt_interval(mins=F.lit(5)), last, F.expr("INTERVAL '1' MINUTE"))).otherwise(F.array().cast("array<timestamp_ntz>"))


def minute_grid(start: Column, end: Column) -> Column:
    """Every minute from start to end."""
    return F.sequence(start, end, F.expr("INTERVAL '1' MINUTE"))
