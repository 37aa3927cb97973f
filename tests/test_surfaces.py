"""Parsing, readers, plans and streams."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.plans import coverage
from tidemark.sources import files
from tidemark.streaming import tape as stream


def test_clock_gaps_and_folds(spark):
    walls = ["2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-07-01 12:00:00"]
    df = spark.createDataFrame([(w,) for w in walls], "w string").select(F.to_timestamp("w").alias("w"))
    utc, gap, fold = parsing.local_to_utc(F.col("w"), "America/New_York")
    out = [tuple(r) for r in df.select(utc, gap, fold).collect()]
    assert [o[1:] for o in out] == [(True, False), (False, True), (False, False)] and out[2][0] == datetime(2024, 7, 1, 16)


def test_numbers(spark):
    df = spark.createDataFrame([("9223372036854775807",), ("9223372036854775808",), ("1.5",), ("x",), ("2.0",)], "s string")
    assert [r[0] for r in df.select(parsing.whole(F.col("s"))).collect()] == [2**63 - 1, None, None, None, 2]
    assert df.select(parsing.digits(F.lit(1.25))).first()[0] == "1.25"


def test_loads_fail_closed(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Time,symbol,price,size,exchange,conditions\n2024-01-01 10:00:00, abc ,1.5,10,N,\n2024-01-01 10:00:01,abc,-1,10,N,\n")
    df = files.read_delimited(spark, str(tmp_path / "t.csv"), "equity_trades", column_map={"timestamp": "Time"})
    assert [r.report for r in files.quality_report(df, price=F.col("price").cast("double") > 0).select(F.col("broken").alias("report")).collect()] == [1]
    with pytest.raises(files.RejectedInput):
        files.assert_clean(df, price=F.col("price").cast("double") > 0)
    with pytest.raises(files.RejectedInput):
        files.read_delimited(spark, str(tmp_path / "t.csv"), "equity_trades")
    with pytest.raises(files.RejectedInput):
        files.forbid_columns(df.withColumn("future_return", F.lit(1)), "future", "outcome")


def test_manifest_follows_content_not_order(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    for name, d in (("a", df), ("b", df.repartition(7))):
        files.write_with_manifest(d, str(tmp_path / name))
    a, b = (spark.read.json(str(tmp_path / n / "manifest")).first() for n in "ab")
    assert a == b and a["rows"] == 50


def test_sessions_and_lookback(spark):
    cal = coverage.sessions(spark, date(2024, 7, 1), date(2024, 7, 8), holidays=[date(2024, 7, 4)], early=[date(2024, 7, 3)])
    rows = cal.orderBy("day").collect()
    assert [r.day.day for r in rows] == [1, 2, 3, 5, 8] and rows[2].closes == datetime(2024, 7, 3, 13)
    got = coverage.lookback(cal, spark.createDataFrame([(1, date(2024, 7, 5)), (2, date(2024, 7, 7))], "e int, d date"), "d", 2)
    assert sorted((r.e, r.session.day) for r in got.collect()) == [(1, 2), (1, 3), (2, 3), (2, 5)]


def test_streamed_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    bars = stream.streaming_bars(stream.first_arrivals(stream.event_stream(spark, str(tmp_path / "in"), events.schema)), width="1 hour")
    run = bars.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(stream.append_once(str(tmp_path / "out"))).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    both = got.join(whole, ["symbol", "start"])
    assert both.count() == got.count() > 0 and both.filter("n <> trade_count").count() == 0
