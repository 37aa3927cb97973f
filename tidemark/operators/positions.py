"""Positions as folds of their events, without a driver loop: the last event of each kind decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def states(events: DataFrame, key: str, kind: str, order: list[str], carry: list[str]) -> DataFrame:
    """A row per decision: first design, first admission behind it and first exit behind that, and the state they make.

    Each is a minimum over the events behind the one before, so three groupings with partial sums stand for a list of a key's events.
    """
    whole = events.select(F.col(key), F.col(kind).alias("_kind"), F.struct(*order).alias("_at"), F.struct(*carry).alias("_more"), F.struct(*order, *carry).alias("_all"))
    held = whole.groupBy(key).agg(F.min(F.when(F.col("_kind") == "design", F.col("_all"))).alias("design"))

    def behind(held: DataFrame, k: str, name: str, after) -> DataFrame:
        start = held.select(F.col(key).alias("_key"), after.alias("_after")).filter("_after IS NOT NULL")
        found = whole.filter(F.col("_kind") == k).join(start, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col("_at") > F.col("_after"))
        one = found.groupBy("_key").agg(F.min(F.struct(F.col("_at").alias("at"), F.col("_more").alias("more"))).alias(name))
        return held.join(one, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")

    held = behind(held, "admit", "admitted", F.when(F.col("design").isNotNull(), F.struct(*(F.col(f"design.{c}") for c in order))))
    held = behind(held, "exit", "left", F.col("admitted.at"))
    state = F.when(F.col("design").isNull(), "unknown").when(F.col("admitted").isNull(), "designed").when(F.col("left").isNull(), "open").otherwise("closed")
    return held.withColumn("state", state)


def overlaps(spans: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Spans that begin before an earlier one of the same key has ended."""
    w = Window.partitionBy(*keys).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("busy_until", F.max(end).over(w)).filter(F.col(start) < F.col("busy_until"))
