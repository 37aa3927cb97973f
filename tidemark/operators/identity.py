"""Who a symbol was on a date: dated claims in lanes, merged, and met with the dates that need an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import merge_intervals

#: Fields that a claim must have, none of them blank.
CLAIM_FIELDS = ("evidence_id", "security", "symbol", "market_identifier", "valid_from", "valid_through", "lane", "source_reference")
STATES = ("VERIFIED", "CONFLICT", "UNCOVERED")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def judged_claims(claims: DataFrame, known: DataFrame, lanes: list[str]) -> DataFrame:
    """Claims (texts of ``CLAIM_FIELDS`` and research_use_only) with ``reason``, null for those that count.

    The first reason that applies, in this order: id (blank or not the only one), fields, use, lane,
    unknown (security not among ``known`` (security, symbol)), symbol (not that security's), dates, reversed.
    """
    iso = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.col(c), "yyyy-MM-dd"))
    symbols = known.select(F.col("security").alias("_security"), F.upper(F.trim("symbol")).alias("_symbol")).distinct()
    held = claims.withColumn("symbol", F.upper(F.trim("symbol"))).withColumn("_same_id", F.count(F.lit(1)).over(Window.partitionBy("evidence_id")))
    held = held.join(symbols.select(F.col("_security").alias("_s1")).distinct(), F.col("security") == F.col("_s1"), "left")
    held = held.join(symbols, (F.col("security") == F.col("_security")) & (F.col("symbol") == F.col("_symbol")), "left")
    reason = (
        F.when(_blank("evidence_id") | (F.col("_same_id") > 1), "id").when(F.greatest(*(_blank(c) for c in CLAIM_FIELDS)), "fields").when(F.coalesce(F.col("research_use_only"), F.lit("")) != "1", "use")
        .when(~F.col("lane").isin(*lanes), "lane").when(F.col("_s1").isNull(), "unknown").when(F.col("_symbol").isNull(), "symbol").when(iso("valid_from").isNull() | iso("valid_through").isNull(), "dates").when(iso("valid_through") < iso("valid_from"), "reversed")
    )
    return held.select(*(c for c in claims.columns if c not in ("valid_from", "valid_through")), iso("valid_from").alias("valid_from"), iso("valid_through").alias("valid_through"), reason.alias("reason"))


def merged_claims(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Claims for the same thing whose days overlap or follow each other, as one; ``parts`` says how many."""
    return merge_intervals(claims, keys, "valid_from", "valid_through", gap=F.expr("INTERVAL '1' DAY"))


def resolved(requirements: DataFrame, claims: DataFrame, *, keys: list[str], on: str, identifier: str, precedence: list[str], expected: str | None = None) -> DataFrame:
    """Each requirement (its ``keys`` and day) with ``identifier``, ``lane``, ``claims`` and ``status``.

    All claims whose days hold the day count, whatever their lane. VERIFIED: they name one identifier, and not
    another one than ``expected`` where that is given; the lane is the first in ``precedence`` that has a claim. CONFLICT: they
    name several, or not the expected one. UNCOVERED: there are none. Requirements that repeat are answered once.
    """
    asked = requirements.groupBy(*keys, on).agg(F.max(expected).alias("_expected") if expected else F.lit(None).cast("string").alias("_expected"))
    rank = F.array_position(F.array(*(F.lit(p) for p in precedence)), F.col("lane")).cast("int")
    c = claims.filter(F.col("lane").isin(*precedence)).select(*(F.col(k).alias(f"_{k}") for k in keys), "valid_from", "valid_through", F.col(identifier).alias("_id"), rank.alias("_rank"))
    same = F.expr(" AND ".join([*(f"{k} <=> _{k}" for k in keys), f"{on} >= valid_from", f"{on} <= valid_through"]))
    met = asked.join(c, same, "left").groupBy(*keys, on, "_expected").agg(F.count("_id").alias("claims"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.min("_rank").alias("_rank"))
    one = (F.col("_lo") == F.col("_hi")) & (F.col("_expected").isNull() | (F.col("_expected") == F.col("_lo").cast("string")))
    status = F.when(F.col("claims") == 0, "UNCOVERED").when(one, "VERIFIED").otherwise("CONFLICT")
    lane = F.element_at(F.array(*(F.lit(p) for p in precedence)), F.col("_rank"))
    return met.select(*keys, on, "claims", status.alias("status"), F.when(status == "VERIFIED", F.col("_lo")).alias(identifier), F.when(F.col("claims") > 0, lane).alias("lane"))


def collisions(df: DataFrame, left: str, right: str) -> DataFrame:
    """Values on either side of what should be one to one that have several partners: side, value, partners."""
    side = lambda a, b: df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("value")).agg(F.count_distinct(b).alias("partners")).filter("partners > 1").select(F.lit(a).alias("side"), "value", "partners")
    return side(left, right).union(side(right, left))


def one_match_ahead(events: DataFrame, candidates: DataFrame, *, keys: list[str], event_id: str, at: str, candidate_at: str, days: int, published: str | None = None, cutoff: str | None = None, shown: int = 10) -> DataFrame:
    """``event_id``, candidates, matched_ts, reason, times: which later instant is an event's own.

    Candidates of the same keys later than the event and at most ``days`` later count once per instant; with
    ``published`` and ``cutoff``, only those published by the event's cutoff. Exactly one is a match; none and several
    are not, and say so (``missing_candidate``, ``ambiguous``, with the first ``shown`` instants). Both sides meet in
    buckets of that many days, so a key's whole history never meets a whole key.
    """
    width = max(days, 1) * 86_400
    seconds = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
    bucket = lambda c: F.floor(seconds(c) / width)
    end = F.col(at) + F.make_dt_interval(days=F.lit(days))
    left = events.select(event_id, *keys, F.col(at).alias("_at"), end.alias("_end"), *([F.col(cutoff).alias("_cutoff")] if cutoff else [])).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_at")), bucket(F.col("_end")))))
    right = candidates.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(candidate_at).alias("_t"), bucket(F.col(candidate_at)).alias("_b"), *([F.col(published).alias("_published")] if published else [])).filter("_t IS NOT NULL").distinct()
    rules = [*(f"{k} = _{k}" for k in keys), "_bucket = _b", "_t > _at", "_t <= _end", *(["_published <= _cutoff"] if published and cutoff else [])]
    found = left.join(right, F.expr(" AND ".join(rules))).groupBy(event_id).agg(F.count_distinct("_t").alias("candidates"), F.min("_t").alias("_first"), F.slice(F.array_sort(F.collect_set("_t")), 1, shown).alias("_times"))
    out = events.select(event_id).join(found, event_id, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    reason = F.when(F.col("candidates") == 0, "missing_candidate").when(F.col("candidates") > 1, "ambiguous")
    return out.select(event_id, "candidates", F.when(F.col("candidates") == 1, F.col("_first")).alias("matched_ts"), reason.alias("reason"), F.when(F.col("candidates") > 1, F.col("_times")).alias("times"))
