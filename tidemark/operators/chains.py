"""Funnels over option chains: the first rule that a leg fails, so that every leg is counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, vendor

#: Contracts in a leg, least open interest, widest spread over the mid, oldest quote in seconds, farthest strike near the money, oldest Greeks in seconds.
LOT, LEAST_INTEREST, WIDEST, OLDEST, NEAR, OLDEST_GREEKS = 100, 100, 0.25, 120, 0.03, 5400
#: Seconds that end the bins of ages.
AGES = ((120, "age_at_most_120s"), (300, "age_121_to_300s"), (900, "age_301_to_900s"))


def _positive(c: Column) -> Column:
    d = c.cast("double")
    return F.when((d > 0) & (d < float("inf")) & ~F.isnan(d), d)


def age(bid_date: Column, ask_date: Column, now: Column) -> Column:
    """Seconds since the older side was quoted; stamps are seconds or milliseconds, ``now`` seconds."""
    return fields.two_sided_age(vendor.epoch_seconds(bid_date), vendor.epoch_seconds(ask_date), now)


def age_bin(seconds: Column) -> Column:
    out = F.when(seconds.isNull(), "age_missing_or_unparseable")
    for most, name in AGES:
        out = out.when(seconds <= most, name)
    return out.otherwise("age_over_900s")


def stage(right: Column, own: Column, lot: Column, strike: Column, bid: Column, ask: Column, interest: Column, seconds: Column, spot: Column, *, oldest: float = OLDEST) -> Column:
    """Where a leg ends: no_option, adjusted, strike, nonpositive, crossed, stale, interest, wide, in_the_money, or liquid.

    ``right`` is call or put, ``own`` whether the leg has the symbol's own root, ``seconds`` the age of its quote.
    """
    k, b, a = _positive(strike), _positive(bid), _positive(ask)
    fails = [
        ("no_option", ~F.coalesce(right.isin("call", "put"), F.lit(False))), ("adjusted", ~F.coalesce(own & (lot == LOT), F.lit(False))), ("strike", k.isNull()), ("nonpositive", b.isNull() | a.isNull()), ("crossed", a < b),
        ("stale", ~F.coalesce(seconds <= oldest, F.lit(False))), ("interest", ~F.coalesce(interest >= LEAST_INTEREST, F.lit(False))), ("wide", (a - b) / ((a + b) / 2) > WIDEST),
        ("in_the_money", F.when(right == "call", k <= spot).otherwise(k >= spot)),
    ]
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in fails), F.lit("liquid"))


def greeks_stage(right: Column, own: Column, lot: Column, strike: Column, bid: Column, ask: Column, interest: Column, seconds: Column, spot: Column, iv: Column, updated: Column, now: Column, *, oldest: float = OLDEST) -> Column:
    """Why a standard leg near the money has no usable fresh volatility: quote, iv, missing, malformed, naive, future, stale, or fresh; null for other legs.

    ``updated`` is a text with its offset from UTC (naive ones have no time), ``now`` seconds since the epoch.
    """
    k, b, a = _positive(strike), _positive(bid), _positive(ask)
    inside = right.isin("call", "put") & own & (lot == LOT) & (spot > 0) & (F.abs(k - spot) / spot <= NEAR)
    usable = (b <= a) & ((a - b) / ((a + b) / 2) <= WIDEST) & (seconds <= oldest) & (interest >= LEAST_INTEREST)
    text = F.trim(updated)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
    naive = text.rlike(shape + "$") & text.try_cast("timestamp_ntz").isNotNull()
    at = F.unix_micros(F.when(text.rlike(shape + r"(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))) / 1e6
    late = now - at
    reason = (
        F.when(~F.coalesce(usable, F.lit(False)), "quote").when(fields.fraction_iv(iv).isNull(), "iv").when(F.coalesce(text, F.lit("")) == "", "missing").when(naive, "naive").when(at.isNull(), "malformed")
        .when(late < -60, "future").when(late > OLDEST_GREEKS, "stale").otherwise("fresh")
    )
    return F.when(F.coalesce(inside, F.lit(False)), reason)


#: Seconds that a side may be older than its event, and that the sides of an event may lie apart.
MOST_SIDE_AGE, MOST_SKEW = 120, 60
_SIDES = ("short_bid", "short_ask", "long_bid", "long_ask")
_EVENTS = ("entry", "exit")


def depth_reason(asof: Column, contracts: int = 1) -> Column:
    """Why a mark and its depth record don't bear each other out, as the first rule that fails; null if they do.

    Columns of the mark are ``p_*``, of the record ``d_*``: both have short_contract and long_contract, the mark decision, and per event (entry,
    exit) its time, the time of its quote (``p_entry_quote``) and the price of each side; the record per side a size, a time (``_at``) and a
    price (``_px``). Times are seconds. Order: missing_contract, invalid_contract, mismatch, future_exit, clock, then for each
    event: clock, and for each side missing, depth, price, future, stale; then ask, crossed, skew.
    """
    c = F.col
    codes = [c(f"{side}_{leg}_contract") for side in "pd" for leg in ("short", "long")]
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    rules = [
        ("missing_contract", F.greatest(*(x.isNull() for x in codes))), ("invalid_contract", F.greatest(*(bad(x.rlike(vendor.OCC)) for x in codes))),
        ("mismatch", (codes[0] == codes[1]) | (codes[2] == codes[3]) | (codes[0] != codes[2]) | (codes[1] != codes[3])), ("future_exit", bad(c("p_exit") <= asof)), ("clock", bad((c("p_decision") <= c("p_entry")) & (c("p_entry") < c("p_exit")))),
    ]
    for event in _EVENTS:
        at, quote = c(f"p_{event}"), c(f"p_{event}_quote")
        limit = c("p_decision") if event == "entry" else at
        rules.append(("clock", bad((at <= asof) & (quote <= limit))))
        for side in _SIDES:
            size, told, price = (c(f"d_{event}_{side}{x}") for x in ("_size", "_at", "_px"))
            rules += [
                ("missing_side", size.isNull() | told.isNull() | price.isNull()), ("depth", bad(size >= contracts)), ("price", bad(price == c(f"p_{event}_{side}"))),
                ("future_side", bad((told <= quote) & (told <= limit))), ("stale_side", bad((at - told).between(0, MOST_SIDE_AGE))),
            ]
        for leg in ("short", "long"):
            bid, ask = c(f"d_{event}_{leg}_bid_px"), c(f"d_{event}_{leg}_ask_px")
            rules += [("ask", ask == 0), ("crossed", bid > ask)]
        times = [c(f"d_{event}_{side}_at") for side in _SIDES]
        rules.append(("skew", F.greatest(*times) - F.least(*times) > MOST_SKEW))
    return F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules))


def depth_audit(marks: DataFrame, records: DataFrame, key: str, asof: Column, contracts: int = 1) -> DataFrame:
    """``key`` and ``reason`` for every mark and record; besides ``depth_reason``: repeated (a key that isn't alone on its side), no_record, no_mark, bad_key."""
    one = lambda df, p: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{p}_n"), *(F.first(c).alias(f"{p}_{c}") for c in df.columns if c != key))
    both = one(marks, "p").join(one(records, "d"), key, "full")
    named = F.when(~F.coalesce(F.col(key).rlike("^[A-Za-z0-9_-]{1,48}$"), F.lit(False)), "bad_key")
    counted = F.when(F.col("d_n").isNull(), "no_record").when(F.col("p_n").isNull(), "no_mark").when((F.col("p_n") > 1) | (F.col("d_n") > 1), "repeated")
    return both.select(key, F.coalesce(named, counted, depth_reason(asof, contracts)).alias("reason"))
