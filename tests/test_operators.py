"""Closed-form and invariance tests of the operators."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import graph, market, primitives, statistics, tape


def test_baseline_leaves_the_current_day_out(spark):
    rows = [("A", 9, date(2024, 1, 1) + timedelta(days=i), float(i + 1)) for i in range(22)]
    out = {r.date: r for r in market.baseline(spark.createDataFrame(rows, "symbol string, slot int, date date, value double")).collect()}
    last = out[date(2024, 1, 22)]
    assert (last.history_n, last.mean, last.median, last.mad, last.status) == (21, 11.0, 11.0, 5.0, "full")
    assert out[date(2024, 1, 1)].z is None and out[date(2024, 1, 9)].status == "insufficient"


def test_baseline_ignores_later_rows(spark):
    rows = [("A", 9, date(2024, 1, 1) + timedelta(days=i), float((i * 7) % 5)) for i in range(30)]
    schema = "symbol string, slot int, date date, value double"
    whole = {r.date: r for r in market.baseline(spark.createDataFrame(rows, schema)).collect()}
    cut = {r.date: r for r in market.baseline(spark.createDataFrame(rows[:20], schema).repartition(3)).collect()}
    assert all(whole[d] == r for d, r in cut.items())


def test_asof_ties_tolerance_and_null_keys(spark):
    t = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, "a", t), (2, "a", t + timedelta(seconds=40)), (3, None, t), (4, "b", t)], "id int, k string, at timestamp")
    right = spark.createDataFrame([("a", t, 1.0), ("a", t, 2.0), ("a", t + timedelta(seconds=50), 9.0), (None, t, 5.0)], "k string, ts timestamp, v double")
    back = {r.id: r.v for r in primitives.asof_join(left, right, ["k"], "at", "ts", ["v"], tolerance_us=30_000_000).collect()}
    assert back == {1: 2.0, 2: None, 3: 5.0, 4: None}
    ahead = {r.id: r.v for r in primitives.asof_join(left, right, ["k"], "at", "ts", ["v"], forward=True).collect()}
    assert ahead[2] == 9.0 and ahead[4] is None


def test_interval_ends_are_closed_and_null_is_open(spark):
    d = date(2024, 1, 1)
    points = spark.createDataFrame([("a", d), ("a", d + timedelta(days=9)), ("b", d + timedelta(days=900))], "k string, at date")
    spans = spark.createDataFrame([("a", d, d + timedelta(days=9)), ("b", d, None)], "k string, lo date, hi date")
    assert primitives.interval_join(points, spans, ["k"], "at", "lo", "hi").count() == 3


def test_fusion_flags_disagreement_until_a_newer_value(spark):
    df = spark.createDataFrame([("x", 1, "p"), ("x", 1, "q"), ("y", 1, "p"), ("y", 1, "q"), ("y", 2, "r")], "k string, t int, v string")
    out = {r.k: (r.v, r.conflict) for r in primitives.fuse_latest(df, ["k"], "t", "v").collect()}
    assert out == {"x": (None, True), "y": ("r", False)}


def test_tick_rule_carries_the_last_sign(spark):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(seconds=i), "A", p, i) for i, p in enumerate([1.0, 1.0, 2.0, 2.0, 1.5])]
    out = market.signed_flow(spark.createDataFrame(rows, "ts timestamp, symbol string, price double, seq int")).orderBy("seq").collect()
    assert [r.sign for r in out] == [0, 0, 1, 1, -1]


def test_volatility_counts_returns_inside_the_window_only(spark):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(minutes=m), "A", p, m) for m, p in ((0, 1.0), (40, 100.0), (45, 110.0), (50, 121.0))]
    out = market.realized_volatility(spark.createDataFrame(rows, "ts timestamp, symbol string, price double, seq int"), 1800).orderBy("seq").collect()
    assert [r.points for r in out] == [1, 1, 2, 3] and out[2].volatility is None and abs(out[3].volatility) < 1e-9


def test_auc_and_threshold(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "score double, label int")
    m = statistics.ranking_metrics(scored).first()
    assert abs(m.auc - 4.5 / 6) < 1e-12
    assert statistics.threshold_at(scored, 0.0).first().score == 0.9


def test_exits_come_before_entries(spark):
    spans = spark.createDataFrame([("k", 1, 5, 10), ("k", 5, 9, 10)], "k string, a int, b int, n int")
    assert tape.exposure_peak(spans, "k", "a", "b", "n").first().peak == 10


def test_chain_breaks_where_a_record_changes(spark):
    rows = [("c", 1, "a"), ("c", 2, "b"), ("c", 3, "c")]
    good = tape.chain(spark.createDataFrame(rows, "k string, i int, v string"), "k", "i", ["v"]).orderBy("i").collect()
    bad = tape.chain(spark.createDataFrame([rows[0], ("c", 2, "x"), rows[2]], "k string, i int, v string"), "k", "i", ["v"]).orderBy("i").collect()
    assert [a.record_hash == b.record_hash for a, b in zip(good, bad)] == [True, False, False]


def test_fewest_hops_win_and_confidence_decays(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 1.0), ("a", "c", 0.1), ("c", "d", 1.0)], "src string, dst string, confidence double")
    out = {r.node: (r.hop, round(r.confidence, 6)) for r in graph.expand(e, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert out == {"a": (0, 1.0), "b": (1, 0.5), "c": (1, 0.1), "d": (2, 0.092)}


def test_replay_defers_and_orders_alike_in_any_partitioning(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(hours=i % 7), t + timedelta(hours=(i * 5) % 11), "s", i) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id int, event_ts timestamp_ntz, available_at timestamp_ntz, source string, sequence int")
    a, b = ([(r.event_id, r.ordinal) for r in tape.replay_order(tape.replay(x, "2024-01-02")).orderBy("ordinal").collect()] for x in (df, df.orderBy(F.desc("event_id")).repartition(7)))
    assert a == b and [o for _, o in a] == list(range(1, 41))
