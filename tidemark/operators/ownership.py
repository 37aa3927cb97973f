"""What institutions held of a security before an event, from filings that were known by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: above it a share of ownership isn't believed.
MOST_RATIO = 1.25


def end_of_day(day: Column, zone: str = "America/New_York") -> Column:
    """The last second of a local day, in UTC: when a filing known by its date alone counts as available."""
    return F.to_utc_timestamp(F.concat_ws(" ", day.cast("string"), F.lit("23:59:59")).cast("timestamp"), zone).cast("timestamp_ntz")


def ownership(targets: DataFrame, names: DataFrame, submissions: DataFrame, holdings: DataFrame, shares: DataFrame) -> DataFrame:
    """symbol, event_date, cusip, report_period, available_at, institutional_shares, shares_outstanding, ratio, reason: a row per target.

    ``targets``: symbol, event_date, cutoff (UTC). ``names``: symbol, cusip, valid_from, valid_to (null: open). ``submissions``: accession, manager,
    report_period, filing_date. ``holdings``: accession, cusip, shares. ``shares``: symbol, event_date, available_at, shares.
    Of a manager's filings for a period the last one before the event's day counts, so a filing counts for events from the day after it until
    the day of the next one: which filings an event sees is a range of days, and nothing is picked per event. The latest period with
    holdings whose last filing was available by the cutoff is taken, against the last share count available by then. Reasons, where there is
    no ratio: no_name (none or several), no_holdings, no_shares, implausible.
    """
    t = targets.select("symbol", "event_date", F.col("cutoff").cast("timestamp_ntz").alias("cutoff")).distinct()
    named = t.join(names.withColumnRenamed("symbol", "_symbol"), F.expr("symbol = _symbol AND event_date >= valid_from AND (valid_to IS NULL OR event_date <= valid_to)"), "left")
    named = named.groupBy("symbol", "event_date", "cutoff").agg(F.min("cusip").alias("cusip"), F.max("cusip").alias("_other"))
    named = named.withColumn("cusip", F.when(F.col("cusip") == F.col("_other"), F.col("cusip"))).drop("_other")
    order = Window.partitionBy("manager", "report_period").orderBy("filing_date", "accession")
    # filings of one day follow each other by accession: all but the last count for no event
    filed = submissions.select("accession", "manager", "report_period", "filing_date").withColumn("until", F.lead("filing_date").over(order))
    held = holdings.join(filed, "accession").select(F.col("cusip").alias("_cusip"), "report_period", "filing_date", "until", F.col("shares").alias("_shares"))
    met = named.join(held, F.expr("cusip = _cusip AND event_date > filing_date AND (until IS NULL OR event_date <= until)"))
    # grouped with the cusip, by which the join has dealt the rows, so that a target's periods aren't shuffled again
    sums = met.groupBy("_cusip", "symbol", "event_date", "cutoff", "report_period").agg(F.sum("_shares").alias("institutional_shares")).filter("institutional_shares > 0")
    days = submissions.select(F.col("report_period").alias("_period"), F.col("filing_date").alias("_filed")).distinct()
    spans = days.withColumn("_next", F.lead("_filed").over(Window.partitionBy("_period").orderBy("_filed"))).withColumn("available_at", end_of_day(F.col("_filed")))
    # a row per period and day of filing: bounded by the calendar
    known = sums.join(F.broadcast(spans), F.expr("report_period = _period AND event_date > _filed AND (_next IS NULL OR event_date <= _next) AND available_at <= cutoff"))
    latest_of = lambda c: F.max_by(c, "report_period").alias(c)
    best = known.groupBy("_cusip", "symbol", "event_date", "cutoff").agg(latest_of("available_at"), latest_of("institutional_shares"), F.max("report_period").alias("report_period")).drop("_cusip")
    counts = shares.select("symbol", "event_date", F.col("available_at").cast("timestamp_ntz").alias("_at"), F.col("shares").alias("_n"))
    latest = t.join(counts, ["symbol", "event_date"]).filter("_at <= cutoff").groupBy("symbol", "event_date", "cutoff").agg(F.max(F.struct("_at", "_n")).alias("s"))
    key = ["symbol", "event_date", "cutoff"]
    out = named.join(best, key, "left").join(latest, key, "left")
    ratio = F.col("institutional_shares") / F.nullif(F.col("s._n"), F.lit(0))
    reason = F.when(F.col("cusip").isNull(), "no_name").when(F.col("report_period").isNull(), "no_holdings").when(ratio.isNull(), "no_shares").when(ratio > MOST_RATIO, "implausible")
    good = lambda c: F.when(reason.isNull(), c)
    return out.select("symbol", "event_date", "cusip", "report_period", "available_at", "institutional_shares", F.col("s._n").alias("shares_outstanding"), good(ratio).alias("ratio"), reason.alias("reason"))
