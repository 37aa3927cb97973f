"""Readers with declared schemas that fail closed, and sinks with manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_text = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])

#: Header columns of the delimited inputs; all are text until parsed.
SCHEMAS = {
    "equity_trades": _text("timestamp", "symbol", "price", "size", "exchange", "conditions"),
    "equity_quotes": _text("timestamp", "symbol", "bid", "ask", "bid_size", "ask_size", "exchange"),
    "option_trades": _text("timestamp", "symbol", "underlying_symbol", "option_symbol", "expiration", "strike", "option_type", "price", "size", "exchange"),
    "option_quotes": _text("timestamp", "symbol", "underlying_symbol", "option_symbol", "expiration", "strike", "option_type", "bid", "ask", "bid_size", "ask_size", "exchange"),
    "exclusions": _text("symbol", "start_ts_utc", "end_ts_utc", "reason"),
    "shares": _text("symbol", "effective_date", "shares_outstanding"),
}


class RejectedInput(ValueError):
    """A load with malformed rows or missing columns; nothing of it is used."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise RejectedInput(f"missing columns: {', '.join(missing)}")
    return df


def forbid_columns(df: DataFrame, *words: str) -> DataFrame:
    """Refuses columns whose names hold look-ahead words."""
    found = [c for c in df.columns if any(w in c.lower() for w in words)]
    if found:
        raise RejectedInput(f"look-ahead columns: {', '.join(found)}")
    return df


def read_delimited(spark: SparkSession, path: str, kind: str, *, column_map: dict[str, str] | None = None, delimiter: str = ",") -> DataFrame:
    """A delimited file by header; ``column_map`` gives the file's name of each declared column."""
    raw = spark.read.options(header=True, sep=delimiter, multiLine=False).csv(path)
    names = {n: (column_map or {}).get(n, n) for n in SCHEMAS[kind].names}
    return require_columns(raw, *names.values()).select(*(F.col(f"`{v}`").alias(n) for n, v in names.items()))


def assert_clean(df: DataFrame, **rules: Column) -> DataFrame:
    """Raises unless no row breaks a rule; all rules are counted in one pass."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items())).first().asDict()
    broken = {k: n for k, n in counts.items() if n}
    if broken:
        raise RejectedInput(f"rows that break rules: {broken}")
    return df


def quality_report(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows, and rows breaking each rule, as one row per rule."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules))
    return one.select("rows", F.explode(pairs).alias("r")).select("r.rule", "rows", "r.broken")


def write_with_manifest(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Parquet rows, and beside them one row with their count, schema and an order-free content hash."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    back = df.sparkSession.read.parquet(f"{path}/data")
    total = F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0))
    manifest = back.agg(F.count(F.lit(1)).alias("rows"), total.cast("string").alias("content"), F.lit(back.schema.simpleString()).alias("schema"))
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return back
