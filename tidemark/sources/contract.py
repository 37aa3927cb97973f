"""Sources under contract: which file, whose columns, which clock; rows typed one by one, rejects with their reason."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import orderbook
from .files import RejectedInput, assert_clean

#: What a contract may say, and the columns of market rows and of messages before they are mapped.
KINDS = ("equity_trade", "equity_quote", "option_trade", "option_quote", "itch_decoded")
REAL, SYNTHETIC = "non_synthetic_authorized", "synthetic_fixture"
MARKET = ("timestamp", "date", "time", "symbol", "price", "size", "bid", "ask", "bid_size", "ask_size", "underlying_symbol", "option_symbol", "expiration", "strike", "option_type", "exchange", "conditions")
MESSAGES = {"type": "message_type", "order_ref": "order_reference", "new_ref": "new_order_reference", "side": "side", "symbol": "symbol", "shares": "shares", "price": "price", "match_number": "match_number", "printable": "printable"}
DELIMITERS = {"comma": ",", "pipe": "|", "tab": "\t", "\\t": "\t"}


@dataclass(frozen=True)
class Contract:
    """One source. Columns that the map doesn't name have their own names in the file."""

    source_id: str
    record_kind: str
    path: str
    data_classification: str
    license_reference: str = ""
    trade_date: str = ""
    timezone: str = "America/New_York"
    delimiter: str = ","
    encoding: str = "utf-8"
    column_map: dict[str, str] = field(default_factory=dict)


def _one(raw: dict, folder: str) -> Contract:
    text = lambda name, default="": str(raw.get(name) or default).strip()
    name = text("source_id")

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise RejectedInput(f"source {name or '?'}: {what}")

    need(bool(name), "source_id is blank")
    need(text("record_kind") in KINDS, f"record_kind {text('record_kind')!r} is unknown")
    need(raw.get("authorized") is True, "not authorized")
    need(text("data_classification") in (REAL, SYNTHETIC), "data_classification is unknown")
    need(text("data_classification") == SYNTHETIC or bool(text("license_reference")), "real data needs a license_reference")
    need(not text("trade_date") or len(text("trade_date")) == 10, "trade_date isn't a date")
    need(isinstance(raw.get("column_map") or {}, dict), "column_map isn't an object")
    need(bool(text("path")), "path is blank")
    delimiter = DELIMITERS.get(raw.get("delimiter") or ",", raw.get("delimiter") or ",")
    need(len(delimiter) == 1, "delimiter isn't one character")
    try:
        ZoneInfo(text("timezone", "America/New_York"))
    except Exception as e:
        raise RejectedInput(f"source {name}: timezone is unknown") from e
    path = text("path")
    whole = path if path.startswith("/") or "://" in path else f"{folder}/{path}"
    return Contract(name, text("record_kind"), whole, text("data_classification"), text("license_reference"), text("trade_date"), text("timezone", "America/New_York"), delimiter, text("encoding", "utf-8"), {str(k): str(v) for k, v in (raw.get("column_map") or {}).items()})


def load_contracts(spark: SparkSession, path: str) -> list[Contract]:
    """The sources of a contract file; any that breaks a rule rejects them all."""
    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    sources = found.get("sources") if isinstance(found, dict) and found.get("schema_version") == "1" else None
    if not isinstance(sources, list) or not sources or not all(isinstance(s, dict) for s in sources):
        raise RejectedInput("a contract has schema_version '1' and a list of sources")
    out = [_one(s, path.rsplit("/", 1)[0]) for s in sources]
    if len({c.source_id for c in out}) < len(out):
        raise RejectedInput("source_id repeats")
    return out


def mapped(spark: SparkSession, contract: Contract, names: dict[str, str]) -> DataFrame:
    """The file's rows as trimmed texts under our names (missing columns and blanks are empty), and where each stands in it."""
    raw = spark.read.options(header=True, sep=contract.delimiter, encoding=contract.encoding, quote='"', escape='"', mode="PERMISSIVE").csv(contract.path)
    have = set(raw.columns)
    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) if c in have else F.lit("")
    columns = {ours: contract.column_map.get(theirs, theirs) for ours, theirs in names.items()}
    places = (F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"), F.monotonically_increasing_id().alias("source_place"))
    return raw.select(*(text(c).alias(n) for n, c in columns.items()), *places, F.lit(contract.source_id).alias("source_name"))


def instant(value: Column, zone: str) -> tuple[Column, Column]:
    """UTC time of a clock text, and why it has none: unsupported, ambiguous or nonexistent. Texts with an offset keep it."""
    shape = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
    offset = value.rlike(shape + r"(Z|[+-]\d{2}:?\d{2})$")
    utc, gap, fold = parsing.local_to_utc(F.when(value.rlike(shape + "$"), value.try_cast("timestamp_ntz")), zone)
    given = F.when(offset, value.try_cast("timestamp"))
    reason = F.when(offset & given.isNotNull(), F.lit(None).cast("string")).when(gap, "timestamp: nonexistent").when(fold, "timestamp: ambiguous").when(utc.isNull(), "timestamp: unsupported")
    return F.coalesce(given, utc), reason


def market_events(spark: SparkSession, contract: Contract) -> DataFrame:
    """Typed trades or quotes, with ``reason`` null for those that are accepted.

    The first broken rule counts: symbol, underlying_symbol, price, size, quote (bid below 0, ask not above
    0), crossed, quote_size, expiration, strike, option_type, timestamp.
    """
    if contract.record_kind not in KINDS[:4]:
        raise RejectedInput(f"source {contract.source_id} has no market rows")
    option, trade = contract.record_kind.startswith("option"), contract.record_kind.endswith("trade")
    m = mapped(spark, contract, {n: n for n in MARKET})
    filled = lambda a, b: F.when(F.col(a) != "", F.col(a)).otherwise(F.col(b))
    date = F.when(F.col("date") != "", F.col("date")).otherwise(F.lit(contract.trade_date))
    stamp = F.when(F.col("timestamp") != "", F.col("timestamp")).otherwise(F.concat_ws(" ", date, "time"))
    m = m.withColumns({"_stamp": stamp, "symbol": filled("symbol", "option_symbol") if option else F.col("symbol"), "option_symbol": filled("option_symbol", "symbol") if option else F.lit(""), "underlying_symbol": F.col("underlying_symbol") if option else filled("underlying_symbol", "symbol")})
    symbols = {c: parsing.symbol(F.col(c)) for c in ("symbol", "underlying_symbol")}
    number, count = (lambda c: parsing.finite(F.nullif(F.col(c), F.lit("")))), (lambda c: parsing.whole(F.nullif(F.col(c), F.lit(""))))
    absent = lambda c: F.coalesce(count(c), F.when(F.col(c) == "", F.lit(0).cast("long")))
    none = lambda t: F.lit(None).cast(t)
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    price, size, bid, ask = number("price"), count("size"), number("bid"), number("ask")
    bid_size, ask_size = absent("bid_size"), absent("ask_size")
    expiration, strike = F.when(F.col("expiration").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("expiration", "yyyy-MM-dd")), number("strike")
    side = F.when(F.upper("option_type").isin("C", "CALL"), "C").when(F.upper("option_type").isin("P", "PUT"), "P")
    utc, clock = instant(F.col("_stamp"), contract.timezone)
    rules = [("symbol", symbols["symbol"].isNotNull()), ("underlying_symbol", symbols["underlying_symbol"].isNotNull())]
    rules += [("price", price > 0), ("size", size > 0)] if trade else [("quote", (bid >= 0) & (ask > 0)), ("crossed", bid <= ask), ("quote_size", (bid_size >= 0) & (ask_size >= 0))]
    rules += [("expiration", (F.col("expiration") == "") | expiration.isNotNull()), ("strike", strike > 0), ("option_type", side.isNotNull())] if option else []
    reason = F.coalesce(*(F.when(broken(ok), F.lit(name)) for name, ok in rules), clock)
    pick = lambda condition, c, t: c if condition else none(t)
    return m.select(
        F.lit(contract.record_kind).alias("event_kind"), utc.alias("event_ts_utc"), symbols["symbol"].alias("symbol"), symbols["underlying_symbol"].alias("underlying_symbol"), pick(trade, price, "double").alias("price"), pick(trade, size, "long").alias("size"),
        pick(not trade, bid, "double").alias("bid"), pick(not trade, ask, "double").alias("ask"), pick(not trade, bid_size, "long").alias("bid_size"), pick(not trade, ask_size, "long").alias("ask_size"),
        pick(option, parsing.symbol(F.col("option_symbol")), "string").alias("option_symbol"), pick(option, expiration, "date").alias("expiration"), pick(option, strike, "double").alias("strike"), pick(option, side, "string").alias("option_type"),
        F.upper("exchange").alias("exchange"), "conditions", "source_name", "source_file", "source_block", "source_place", reason.alias("reason"))


def rejects(events: DataFrame) -> DataFrame:
    """Rows by reason, the accepted ones under ``accepted``, with the first place of each."""
    where = F.struct("source_file", "source_block", "source_place")
    return events.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"), F.min(where).alias("first"))


def accepted(events: DataFrame, *, strict: bool = True) -> DataFrame:
    """Rows without a reason; ``strict`` refuses a load of which any row was rejected."""
    if strict:
        bad = {r.reason: r.rows for r in rejects(events).collect() if r.reason != "accepted"}  # one row per rule
        if bad:
            raise RejectedInput(f"rejected rows: {bad}")
    return events.filter("reason IS NULL").drop("reason")


def covered(events: DataFrame, day: str, symbols: list[str], zone: str = "America/New_York") -> dict:
    """Whether the accepted rows hold the market date and every required symbol (underlying ones for options)."""
    local = F.to_date(F.from_utc_timestamp("event_ts_utc", zone)) == F.lit(day).cast("date")
    own = F.when(F.col("event_kind").startswith("option"), F.col("underlying_symbol")).otherwise(F.col("symbol"))
    wanted = {s.strip().upper() for s in symbols if s.strip()}
    hit = events.filter("reason IS NULL").filter(local)
    got = {r.s for r in hit.filter(own.isin(*wanted) if wanted else F.lit(False)).select(own.alias("s")).distinct().collect()}  # at most the required ones
    rows = hit.count()
    return {"rows": rows, "missing": sorted(wanted - got), "valid": rows > 0 and wanted == got}


def messages(spark: SparkSession, contract: Contract) -> DataFrame:
    """Decoded order-book messages as ``operators.orderbook`` takes them; raises unless every one keeps its rules."""
    if contract.record_kind != "itch_decoded":
        raise RejectedInput(f"source {contract.source_id} has no messages")
    extra = {"date": "date", "time": "time", "timestamp": "timestamp", "cancelled": "cancelled_shares", "executed": "executed_shares", "paid": "execution_price"}
    m = mapped(spark, contract, MESSAGES | extra)
    first = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    date = F.when(F.col("date") != "", F.col("date")).otherwise(F.lit(contract.trade_date))
    utc, clock = instant(F.when(F.col("timestamp") != "", F.col("timestamp")).otherwise(F.concat_ws(" ", date, "time")), contract.timezone)
    run = orderbook.kind(F.col("type")) == "E"
    number = lambda text, parse: F.struct(parse(text).alias("v"), (text.isNull() | parse(text).isNotNull()).alias("ok"))
    typed = m.withColumns({"_clock": clock, "ts": utc, "_shares": number(F.when(run, first("executed", "shares")).otherwise(first("cancelled", "shares")), parsing.whole), "_price": number(F.when(run, first("paid", "price")).otherwise(first("price")), parsing.finite)})
    out = typed.select(F.lit(contract.source_id).alias("source"), F.col("source_place").alias("row"), "ts", "type", "order_ref", "new_ref", "side", "symbol", F.col("_shares.v").alias("shares"), F.col("_price.v").alias("price"), "match_number", "printable", F.col("_clock").isNull().alias("timed"), (F.col("_shares.ok") & F.col("_price.ok")).alias("numeric"))
    return assert_clean(out, timed=F.col("timed"), numeric=F.col("numeric"), **orderbook.faults()).drop("timed", "numeric")
