"""The tape as a stream: deduplicated events, watermarked bars, late rows set aside and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, *, lateness: str = "10 minutes", files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files under ``path`` as a stream with UTC event times and a watermark on them."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def first_arrivals(events: DataFrame, *, key: str = "event_id") -> DataFrame:
    """Each event once, however often it is sent within the watermark's lateness."""
    return events.dropDuplicatesWithinWatermark([key])


def streaming_bars(events: DataFrame, *, symbol: str = "event_type", width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Bars per symbol and (tumbling or sliding) window; emitted once no row in time can change them."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    order = F.struct("ts", "event_id")
    return events.groupBy(window, F.col(symbol).alias("symbol")).agg(
        F.count(F.lit(1)).alias("trade_count"), F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("notional"),
    ).select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "trade_count", "open", "high", "low", "close", "notional")


def split_by_cutoff(batch: DataFrame, cutoff, kept_path: str, deferred_path: str) -> None:
    """For ``foreachBatch``: rows available by the cutoff go on, later ones are deferred, none is lost."""
    late = F.greatest("event_ts", "available_at") > F.lit(cutoff)
    batch.filter(~late).write.mode("append").parquet(kept_path)
    batch.filter(late).write.mode("append").parquet(deferred_path)


def append_once(path: str):
    """A ``foreachBatch`` sink that writes each batch under its id, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
