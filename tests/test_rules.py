"""Small rules on literal rows, with answers worked out by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fields, vendor
from tidemark.operators import primitives, quality
from tidemark.plans import calendar

T = lambda *x: datetime(*x)


def column(spark, values, kind, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.orderBy("k").select(f(F.col("v")).alias("x")).collect()]


def test_option_codes(spark):
    codes = ["AAPLA152405000.U", "AAPLM152405000.U", "SPXl192404500.U", "BRK.BC157212345.U", "XA157300100.U", "AAPLA1524", "AAPLA152405000", "AAPLA152405000.O", "AAPLA322405000.U", "AAPLY152405000.U", "AAPLA152400000.U", "A152405000.U", "", None]
    want = [("AAPL", "call", date(2024, 1, 15), 50.0), ("AAPL", "put", date(2024, 1, 15), 50.0), ("SPX", "call", date(2024, 12, 19), 450.0), ("BRK.B", "call", date(2072, 3, 15), 123.45), ("X", "call", date(1973, 1, 15), 1.0), *[(None,) * 4] * 9]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "k int, c string").orderBy("k")
    d = vendor.option_symbol(F.col("c"))
    assert [tuple(r) for r in df.select(d["root"], d["kind"], d["expiry"], d["strike"]).collect()] == want


def test_vendor_moments(spark):
    rows = [("03-JAN-2024", "14:30:00.5", "14:29:59.25", None), ("3-Jan-2024", "00:00:01", "23:59:59", "-5"), ("2024-01-03", "23:59:59", "00:00:01", "1.5"), ("2024-01-03", "10:00:00", "", ""), ("2024-01-03", "10:00:00", None, "0"), ("2024-01-03", "", "10:00:00", None), ("03/01/2024", "10:00:00", None, None), (None, "10:00:00", None, None), ("2024-01-03", "23:30:00", "00:29:00", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, d string, g string, q string, o string").orderBy("k")
    got = [r[0] for r in df.select(vendor.quote_moment(F.col("d"), F.col("g"), F.col("q"), F.nullif(F.col("o"), F.lit("")))).collect()]
    assert got == [T(2024, 1, 3, 14, 29, 59, 250_000), T(2024, 1, 2, 18, 59, 59), T(2024, 1, 4, 1, 30, 1), T(2024, 1, 3, 10), T(2024, 1, 3, 10), None, None, None, T(2024, 1, 4, 0, 29)]
    trades = [("2024-01-02", "2024-01-03", "10:00:00", "2"), (" ", "2024-01-03", "10:00:00", None), (None, "2024-01-03", "23:00:00", "-1.5"), ("", "", "10:00:00", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(trades)], "k int, t string, d string, c string, o string").orderBy("k")
    assert [r[0] for r in df.select(vendor.trade_moment(F.col("t"), F.col("d"), F.col("c"), F.col("o"))).collect()] == [T(2024, 1, 2, 12), T(2024, 1, 3, 10), T(2024, 1, 3, 21, 30), None]


def test_numbers_and_buckets(spark):
    assert column(spark, [1e9, 1e11 - 1, 1e11, 1e12, 1e14 - 1, 1e14, 0.0, -5.0, None], "double", vendor.epoch_seconds) == [1e9, 1e11 - 1, None, 1e9, (1e14 - 1) / 1000, None, None, None, None]
    assert column(spark, [0, 1, 2, 6, 7, 21, 22, -1, None], "int", vendor.expiry_bucket) == ["0DTE", "1DTE", None, None, "7-21DTE", "7-21DTE", None, None, None]
    assert column(spark, [100.0, 101.0, 99.0, -20.0, -20.5, None], "double", lambda q: fields.fresh(F.lit(100.0), q)) == [True, False, True, True, False, False]


def test_bar_faults(spark):
    now = T(2024, 1, 3, 10)
    good = (T(2024, 1, 3, 10), 10.0, 12.0, 9.0, 11.0, 5.0)
    changed = lambda **x: tuple(({"at": good[0], "o": good[1], "h": good[2], "l": good[3], "c": good[4], "v": good[5]} | x).values())
    rows = [good, changed(at=None), changed(at=T(2024, 1, 3, 10, 0, 1)), changed(o=0.0), changed(c=float("nan")), changed(h=float("inf")), changed(l=10.5), changed(h=10.9), changed(v=None), changed(v=-1.0), changed(v=1.5), changed(v=0.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, at timestamp_ntz, o double, h double, l double, c double, v double").orderBy("k")
    faults = fields.bar_faults(F.col("at"), F.lit(now).cast("timestamp_ntz"), *(F.col(c) for c in "ohlcv"))
    assert [r[0] for r in df.select(quality.first_reason(faults)).collect()] == [None, "time", "time", "prices", "prices", "prices", "bounds", "bounds", "volume", "volume", "volume", None]


def test_federal_holidays():
    assert calendar.federal_holidays(2024, 2024) == [date(2024, *d) for d in ((1, 1), (1, 15), (2, 19), (5, 27), (6, 19), (7, 4), (9, 2), (10, 14), (11, 11), (11, 28), (12, 25))]
    assert date(2021, 12, 31) in calendar.federal_holidays(2022, 2022) and date(2021, 7, 5) in calendar.federal_holidays(2021, 2021)
    assert date(2020, 6, 19) not in calendar.federal_holidays(2020, 2020) and len(calendar.federal_holidays(1985, 1985)) == 9


@pytest.mark.parametrize(("at", "opens", "before", "after"), [
    (T(2024, 1, 3, 12), T(2024, 1, 3, 9, 30), date(2024, 1, 2), date(2024, 1, 3)),  # noon itself stays
    (T(2024, 1, 3, 12, 0, 0, 1), T(2024, 1, 4, 9, 30), date(2024, 1, 3), date(2024, 1, 4)),
    (T(2024, 1, 6, 9), T(2024, 1, 6, 9, 30), date(2024, 1, 5), date(2024, 1, 8)),  # a weekend morning stays on its date
    (T(2024, 1, 6, 15), T(2024, 1, 8, 9, 30), date(2024, 1, 6), date(2024, 1, 8)),
    (T(2024, 1, 12, 16), T(2024, 1, 16, 9, 30), date(2024, 1, 12), date(2024, 1, 16)),  # over a weekend and a Monday holiday
    (T(2024, 1, 16, 8), T(2024, 1, 16, 9, 30), date(2024, 1, 12), date(2024, 1, 16)),
    (T(2024, 7, 3, 17), T(2024, 7, 5, 9, 30), date(2024, 7, 3), date(2024, 7, 5)),
])
def test_openings_and_sample_days(spark, at, opens, before, after):
    closed = calendar.federal_holidays(2023, 2024)
    df = spark.createDataFrame([(at,)], "at timestamp_ntz")
    b, a = calendar.sample_days(F.col("at"), F.to_date("at"), closed)
    assert tuple(df.select(calendar.research_open(F.col("at"), holidays=closed), b, a).first()) == (opens, before, after)


def test_grids(spark):
    at, opens = T(2024, 1, 3, 16, 30, 20), T(2024, 1, 4, 9, 30)
    df = spark.createDataFrame([(at, opens)], "at timestamp_ntz, opens timestamp_ntz")
    g = calendar.quote_grids(F.col("at"), F.col("opens"))
    row = df.select(*(c.alias(n) for n, c in g.items()), calendar.trade_grid(F.col("at"), F.col("opens")).alias("trades")).first()
    assert {n: len(row[n]) for n in g} == {"announcement_1s": 601, "announcement_1m": 126, "opening_1s": 601, "opening_1m": 126}
    assert row.announcement_1m[0] == T(2024, 1, 3, 16, 25, 20) and row.opening_1m[-1] == T(2024, 1, 4, 11, 30)
    assert row.trades[0] == T(2024, 1, 3, 16, 25, 20) and row.trades[-1] == T(2024, 1, 4, 10, 0, 20) and len(row.trades) == 5 + 1020 + 30 + 1
    early = spark.createDataFrame([(T(2024, 1, 3, 11, 30), T(2024, 1, 3, 9, 30))], "at timestamp_ntz, opens timestamp_ntz")
    assert early.select(F.size(calendar.trade_grid(F.col("at"), F.col("opens")))).first()[0] == 0


def test_windows_a_minute_apart_are_one(spark):
    day = lambda h, m: T(2024, 1, 3, h, m)
    rows = [("a", day(9, 30), day(9, 40)), ("a", day(9, 41), day(9, 50)), ("a", day(9, 52), day(9, 55)), ("b", day(9, 0), day(9, 9)), ("b", day(9, 2), day(9, 3)), ("b", day(9, 9), day(9, 20))]
    df = spark.createDataFrame(rows, "k string, s timestamp_ntz, e timestamp_ntz")
    out = primitives.merge_intervals(df, ["k"], "s", "e", gap=F.expr("INTERVAL '1' MINUTE"))
    assert {tuple(r) for r in out.collect()} == {("a", day(9, 30), day(9, 50), 2), ("a", day(9, 52), day(9, 55), 1), ("b", day(9, 0), day(9, 20), 3)}
