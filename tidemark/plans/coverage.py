"""Session calendars, windows around events and what data they require."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.primitives import merge_intervals


def sessions(spark: SparkSession, first: date, last: date, *, holidays: list[date] = (), early: list[date] = (), opens: str = "09:30:00", closes: str = "16:00:00", early_close: str = "13:00:00") -> DataFrame:
    """Weekday sessions without holidays; open and close as wall-clock times."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")).filter(F.dayofweek("day").between(2, 6))
    closed = spark.createDataFrame([(d,) for d in holidays], "day date")
    short = spark.createDataFrame([(d, True) for d in early], "day date, is_early boolean")
    at = lambda c: F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), c))
    out = days.join(closed, "day", "left_anti").join(F.broadcast(short), "day", "left").withColumn("is_early", F.coalesce("is_early", F.lit(False)))
    return out.select("day", at(F.lit(opens)).alias("opens"), at(F.when(F.col("is_early"), early_close).otherwise(closes)).alias("closes"), "is_early")


def lookback(calendar: DataFrame, events: DataFrame, day: str, n: int) -> DataFrame:
    """The ``n`` last sessions strictly before each event's day; session numbers make it an equi-join."""


    numbered = calendar.withColumn("ordinal", F.row_number().over(Window.orderBy("day")))  # one row per session
    spans = numbered.select(F.col("day").alias("_from"), F.coalesce(F.lead("day").over(Window.orderBy("day")), F.lit("9999-12-31").cast("date")).alias("_to"), "ordinal")
    placed = events.join(F.broadcast(spans), (F.col(day) > F.col("_from")) & (F.col(day) <= F.col("_to")))
    wanted = placed.withColumn("_o", F.explode(F.expr(f"sequence(greatest(1, ordinal - {n - 1}), ordinal)"))).drop("ordinal", "_from", "_to")
    return wanted.join(F.broadcast(numbered.select(F.col("ordinal").alias("_o"), F.col("day").alias("session"))), "_o").drop("_o")


def required_windows(events: DataFrame, at: str, keys: list[str], before: Column, after: Column) -> DataFrame:
    """Merged windows around events of each key."""
    spans = events.select(*keys, (F.col(at) - before).alias("start"), (F.col(at) + after).alias("end"))
    return merge_intervals(spans, keys, "start", "end")


def coverage(required: DataFrame, available: DataFrame, scope: list[str], unit: list[str]) -> DataFrame:
    """FULL, PARTIAL or UNTOUCHED per scope, by how many required units are available."""
    have = available.select(*unit).distinct().withColumn("_has", F.lit(1))
    counts = required.select(*dict.fromkeys([*scope, *unit])).distinct().join(have, unit, "left").groupBy(*scope).agg(F.count(F.lit(1)).alias("required"), F.count("_has").alias("covered"))
    return counts.withColumn("status", F.when(F.col("covered") == F.col("required"), "FULL").when(F.col("covered") == 0, "UNTOUCHED").otherwise("PARTIAL"))


def history_requirements(calendar: DataFrame, candidates: DataFrame, *, normal: int = 21, closes: int = 30) -> tuple[DataFrame, DataFrame]:
    """What data candidates need: a row per symbol and date, and the candidates that can't be placed with their reason.

    ``calendar`` comes from ``sessions``; ``candidates`` have symbol and cutoff (wall clock). A candidate needs its own
    date (the minute of its cutoff and the one before), the last ``normal`` sessions before it that hold that minute (days that
    close early may not), and the closes of the last ``closes`` sessions. Reasons: no_session, outside_session, short_history.
    Sessions are numbered, all of them and those of full length, so histories are ranges of numbers and every join is by a number.
    """
    if not 1 <= normal <= closes:
        raise ValueError("closes must be at least normal, and that at least 1")
    w = Window.orderBy("day")  # one row per session
    cal = calendar.select("day", "opens", F.col("closes").alias("shuts"), "is_early").withColumns({"n": F.row_number().over(w), "full": F.sum((~F.col("is_early")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    clock = lambda c: F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.to_date(c).cast("timestamp"))
    short = calendar.filter("is_early").agg(F.min(clock("closes"))).first()[0] or 86_400_000_000
    minute = F.date_trunc("minute", "cutoff").cast("timestamp_ntz")
    c = candidates.select("symbol", "cutoff", F.to_date("cutoff").alias("event_date"), minute.alias("minute")).distinct()
    c = c.join(F.broadcast(cal.withColumnRenamed("day", "event_date")), "event_date", "left")
    long = clock("minute") + 60_000_000 > F.lit(short)
    known = F.when(F.col("is_early"), F.col("full")).otherwise(F.col("full") - 1)  # full sessions before the day
    reason = F.when(F.col("n").isNull(), "no_session").when(~F.col("cutoff").between(F.col("opens"), F.col("shuts")), "outside_session").when((F.when(long, known).otherwise(F.col("n") - 1) < normal) | (F.col("n") - 1 < closes), "short_history")
    c = c.withColumns({"long": long, "known": known, "reason": reason})
    good = c.filter("reason IS NULL")
    text = F.date_format("minute", "HH:mm")
    own = good.select("symbol", F.col("event_date").alias("trade_date"), "event_date", F.lit("event_point").alias("role"), F.explode(F.array(F.date_format(F.col("minute") - F.make_dt_interval(mins=F.lit(1)), "HH:mm"), text)).alias("minute"))
    base = good.withColumn("k", F.explode(F.when(F.col("long"), F.sequence(F.col("known") - normal + 1, F.col("known"))).otherwise(F.sequence(F.col("n") - normal, F.col("n") - 1))))
    days = cal.filter("NOT is_early").select(F.lit(True).alias("long"), F.col("full").alias("k"), F.col("day").alias("trade_date")).union(cal.select(F.lit(False), "n", "day"))
    normals = base.join(F.broadcast(days), ["long", "k"]).select("symbol", "trade_date", "event_date", F.lit("normalization_baseline"), text)
    ends = good.withColumn("k", F.explode(F.sequence(F.col("n") - closes, F.col("n") - 1))).join(F.broadcast(cal.select(F.col("n").alias("k"), F.col("day").alias("trade_date"))), "k").select("symbol", "trade_date", "event_date", F.lit("daily_close_history"), F.lit(None).cast("string"))
    needs = own.union(normals).union(ends).groupBy("symbol", "trade_date").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ";").alias("roles"), F.count_distinct("event_date").alias("event_dates"),  # three roles, 1,440 minutes of a day at most
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "event_point", F.col("minute")))), ";").alias("event_minutes"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "normalization_baseline", F.col("minute")))), ";").alias("normal_minutes"))
    quotes = F.col("roles") != "daily_close_history"
    close = cal.select(F.col("day").alias("trade_date"), F.date_format(F.col("shuts") - F.make_dt_interval(mins=F.lit(1)), "HH:mm").alias("close_minute"))
    needs = needs.join(F.broadcast(close), "trade_date").withColumn("needs_quotes_and_shares", quotes)
    return needs, c.filter("reason IS NOT NULL").select("symbol", "cutoff", "reason")
