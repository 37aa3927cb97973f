"""Deterministic replay order, deferral of late rows, hash chains, exposure sweeps and drawdowns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replay(events: DataFrame, cutoff) -> DataFrame:
    """Rows with replay time ``max(event time, availability)``; those after the cutoff are deferred, not lost."""
    at = F.greatest("event_ts", "available_at")
    return events.withColumn("replay_ts", at).withColumn("deferred", at > F.lit(cutoff).cast("timestamp_ntz"))


def replay_order(events: DataFrame, by_day: str = "replay_ts") -> DataFrame:
    """Ordinals in the total order (replay time, event time, source, sequence, id), counted day by day."""
    day = events.withColumn("_day", F.to_date(by_day))
    starts = day.groupBy("_day").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_day").orderBy("replay_ts", "event_ts", "source", "sequence", "event_id")
    return day.withColumn("_rn", F.row_number().over(inside)).join(F.broadcast(starts), "_day").withColumn("ordinal", F.col("_start") + F.col("_rn")).drop("_day", "_rn", "_start")


def link(previous: str, payload_hash: str) -> str:
    return hashlib.sha256(f"{previous}|{payload_hash}".encode()).hexdigest()


def chain(df: DataFrame, key: str, order: str, payload: list[str], heads: DataFrame | None = None) -> DataFrame:
    """payload_hash, previous_hash and record_hash: each record over its payload and the record before it, so a change breaks all behind it.

    ``heads`` (``key``, record_hash) are the last records of a ledger that these rows are appended to; chains without one begin with nothing.
    A chain is read in order by one task, as a stream: what is held is its last hash.
    """
    own = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload)), 256)
    rows = df.withColumn("payload_hash", own)
    head = rows.sparkSession.createDataFrame([], f"_k {df.schema[key].dataType.simpleString()}, _head string") if heads is None else heads.select(F.col(key).alias("_k"), F.col("record_hash").alias("_head"))
    rows = rows.join(head, rows[key].eqNullSafe(head["_k"]), "left").drop("_k").repartition(key).sortWithinPartitions(key, order, "payload_hash")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = object(), ""
        for b in batches:
            previous, record = [], []
            for k, h, head in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (key, "payload_hash", "_head")), strict=True):
                if k != name:
                    name, last = k, head or ""
                previous.append(last)
                last = link(last, h)
                record.append(last)
            kept = [c for c in b.schema.names if c != "_head"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(previous, pa.string()), pa.array(record, pa.string())], names=[*kept, "previous_hash", "record_hash"])

    return rows.mapInArrow(linked, T.StructType([*(f for f in rows.schema.fields if f.name != "_head"), T.StructField("previous_hash", T.StringType()), T.StructField("record_hash", T.StringType())]))


def exposure_peak(spans: DataFrame, key: str, start: str, end: str, amount: str) -> DataFrame:
    """Largest sum of amounts open at once; at one instant exits come before entries."""
    steps = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("kind"), F.col(amount).alias("by")), F.struct(F.col(end).alias("at"), F.lit(0).alias("kind"), (-F.col(amount)).alias("by")))).alias("e")).select(key, "e.*")
    w = Window.partitionBy(key).orderBy("at", "kind", "by").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("open", F.sum("by").over(w)).groupBy(key).agg(F.max("open").alias("peak"))


def drawdown(df: DataFrame, key: str, order: list[str], gain: str) -> DataFrame:
    """Running sum and the largest fall from its running maximum, which starts at zero."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_run", F.sum(gain).over(w)).withColumn("_high", F.greatest(F.max("_run").over(w), F.lit(0)))
    return run.groupBy(key).agg(F.sum(gain).alias("total"), F.max(F.col("_high") - F.col("_run")).alias("drawdown"))
