"""Vendor rows of trades and quotes as typed rows with a reason where one can't be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parsing, vendor

#: Codes of a trade's flags, inside pieces that end in _TEXT] or [LSTSALCOND]; whole pieces; codes of a quote's flags.
TRADE_CODES = {
    "form_t": "T", "opening": "O", "closing": "6", "cross": "X", "sweep": "F", "next_day": "N", "bunched": "B", "prior_reference_price": "P", "extended_hours_soos": "U",
    "derivatively_priced": "4", "average_trade_price": "W", "cash_sale": "C", "sold_out_of_sequence": "Z",
}
OPENING_PIECE, ODD_LOT_PIECES = "O [CTS_QUAL]", ("ODT[IRGCOND]", "ODD[IRGCOND]")
QUOTE_CODES = {"regular": "R", "opening": "OQ", "closing": "CQ", "no_quote": "NQ"}
#: Characters that such endings take, with their bracket.
_TEXT, _LAST_SALE, _PRICE_CODE, _PRICE_THREE = 10, 12, 11, 9
#: Fixed value: trades with one of these aren't regular when they are put on a grid.
IRREGULAR = ("next_day", "prior_reference_price", "derivatively_priced", "sold_out_of_sequence")


def _pieces(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")


def _head(piece: Column, ending: int) -> Column:
    return F.substring(piece, F.lit(1), F.greatest(F.length(piece) - ending, F.lit(0)))


def _holds(heads: Column, code: str) -> Column:
    return F.exists(heads, lambda h: h.contains(code))


def trade_flags(text: Column) -> dict[str, Column]:
    """What a trade's qualifiers say; a code counts wherever it stands inside a piece of the two kinds."""
    pieces = _pieces(text)
    told = F.filter(pieces, lambda p: p.endswith("_TEXT]") | p.endswith("[LSTSALCOND]"))
    heads = F.transform(told, lambda p: F.when(p.endswith("_TEXT]"), _head(p, _TEXT)).otherwise(_head(p, _LAST_SALE)))
    out = {name: _holds(heads, code) for name, code in TRADE_CODES.items()}
    return out | {"opening": out["opening"] | F.array_contains(pieces, OPENING_PIECE), "odd_lot": F.arrays_overlap(pieces, F.array(*(F.lit(p) for p in ODD_LOT_PIECES)))}


def quote_flags(text: Column) -> dict[str, Column]:
    """What a quote's qualifiers say; a code counts only as the whole of its piece."""
    told = F.filter(_pieces(text), lambda p: p.endswith("[PRC_QL_CD]") | p.endswith("[PRC_QL3]"))
    heads = F.transform(told, lambda p: F.trim(F.when(p.endswith("[PRC_QL_CD]"), _head(p, _PRICE_CODE)).otherwise(_head(p, _PRICE_THREE))))
    return {name: F.array_contains(heads, code) for name, code in QUOTE_CODES.items()}


def regular(flags: dict[str, Column]) -> Column:
    return ~(flags[IRREGULAR[0]] | flags[IRREGULAR[1]] | flags[IRREGULAR[2]] | flags[IRREGULAR[3]])


def _typed(rows: DataFrame, kind: str, option: bool) -> DataFrame:
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) if c in have else F.lit("")
    number = lambda c: parsing.finite(F.nullif(text(c), F.lit("")))
    given = text("Date-Time")
    modern = F.when(given.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"), F.regexp_replace(given, r"(\.\d{6})\d+", "$1").try_cast("timestamp"))
    old = vendor.trade_moment(text("Trd/Qte Date"), text("Date[G]"), text("Exch Time"), F.nullif(text("GMT Offset"), F.lit(""))) if kind == "Trade" else vendor.quote_moment(text("Date[G]"), text("Time[G]"), text("Quote Time"), F.nullif(text("GMT Offset"), F.lit("")))
    stamp = F.when(given != "", modern.cast("timestamp_ntz")).otherwise(old)
    type_ = F.when(text("Type") == "", F.lit(kind)).otherwise(text("Type"))
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    price, size, bid, ask, bids, asks = (number(c) for c in ("Price", "Volume", "Bid Price", "Ask Price", "Bid Size", "Ask Size"))
    flags = trade_flags(text("Qualifiers")) if kind == "Trade" else quote_flags(text("Qualifiers"))
    economics = (price > 0) & (size > 0) if kind == "Trade" else (bid >= 0) & (ask > 0) & (bid <= ask) & (bids >= 0) & (asks >= 0)
    code = vendor.option_symbol(text("#RIC"))
    meta = {
        "underlying_symbol": F.coalesce(F.nullif(text("underlying_symbol"), F.lit("")), code["root"]), "option_symbol": F.coalesce(F.nullif(text("option_symbol"), F.lit("")), F.when(code["root"].isNotNull(), F.regexp_replace(text("#RIC"), r"\.[^.]*$", ""))),
        "expiration": F.coalesce(F.nullif(text("expiration"), F.lit("")).try_cast("date"), code["expiry"]), "strike": F.coalesce(number("strike"), code["strike"]),
        "option_type": F.coalesce(F.when(F.lower(text("option_type")).isin("c", "call"), "call").when(F.lower(text("option_type")).isin("p", "put"), "put"), F.when(text("option_type") == "", code["kind"])),
    }
    rules = [("type", type_ == kind), ("economics", economics)]
    rules = ([("metadata", F.least(*(c.isNotNull() for c in meta.values())) & (meta["strike"] > 0))] if option else []) + rules + [("timestamp", stamp.isNotNull())]
    reason = F.coalesce(*(F.when(broken(ok), F.lit(name)) for name, ok in rules))
    values = {"price": price, "size": size, "exchange": text("Ex/Cntrb.ID")} if kind == "Trade" else {"bid": bid, "ask": ask, "bid_size": bids, "ask_size": asks}
    symbol = meta["option_symbol"] if option else (F.col("historical_symbol") if "historical_symbol" in have else text("#RIC"))
    kept = [F.col(c) for c in rows.columns if c.startswith("_")]
    return rows.select(*kept, stamp.alias("timestamp"), symbol.alias("symbol"), *(c.alias(n) for n, c in values.items()), *((c.alias(n) for n, c in meta.items()) if option else ()), text("#RIC").alias("source_ric"), F.struct(*(c.alias(n) for n, c in flags.items())).alias("flags"), reason.alias("reason"))


def trades(rows: DataFrame, *, option: bool = False) -> DataFrame:
    """timestamp, symbol, price, size, exchange, flags and reason (metadata, type, economics, timestamp; null: good) of vendor rows.

    Columns have the vendor's names, missing ones count as blank; columns that begin with ``_`` are kept. A modern
    Date-Time must have its offset and then is UTC; without one the older fields make the time. Options take what their columns don't say
    from the code of the instrument.
    """
    return _typed(rows, "Trade", option)


def quotes(rows: DataFrame, *, option: bool = False) -> DataFrame:
    """The same for quotes: bid, ask and their sizes; crossed and negative ones are bad economics."""
    return _typed(rows, "Quote", option)
