"""Operators split by time, band or prefix against their plain forms, on ties, nulls and keys of one row."""

import math
import random
import statistics as st
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import graph, market, positions, primitives, statistics

START = datetime(2024, 1, 1, 20)


def rows(seed, n=300, keys=("a", "a", "a", "b", None, "c")):
    r = random.Random(seed)
    return [(r.choice(keys), START + timedelta(hours=r.randint(0, 140), minutes=r.choice([0, 0, 30])), k, r.choice([None, None, r.randint(0, 9)])) for k in range(n)]


@pytest.mark.parametrize(("inclusive", "forward"), [(True, False), (False, False), (True, True), (False, True)])
def test_carried_equals_one_window(spark, inclusive, forward):
    df = spark.createDataFrame(rows(1), "k string, ts timestamp_ntz, seq int, v int")
    order = [F.desc("ts"), F.desc("seq")] if forward else ["ts", "seq"]
    plain = F.last("v", ignorenulls=True).over(Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    want = {r.seq: (r.x, r.k) for r in df.withColumn("x", plain).collect()}
    out = primitives.carried(df, ["k"], ["ts", "seq"], {"x": F.col("v")}, F.to_date("ts"), inclusive=inclusive, forward=forward)
    assert out.columns == ["k", "ts", "seq", "v", "x"] and {r.seq: (r.x, r.k) for r in out.collect()} == want


@pytest.mark.parametrize(("forward", "tolerance"), [(False, None), (True, None), (False, 3_600_000_000), (True, 3_600_000_000)])
def test_split_asof_equals_whole(spark, forward, tolerance):
    left = spark.createDataFrame(rows(2), "k string, ts timestamp_ntz, seq int, v int")
    right = spark.createDataFrame([(k, t, s, v) for k, t, s, v in rows(3, 80)], "k string, rts timestamp_ntz, rs int, rv int")
    join = lambda bucket: sorted((r.seq, r.rs is None, r.rs, str(r.matched_ts)) for r in primitives.asof_join(left, right, ["k"], "ts", "rts", ["rs", "rv"], tolerance_us=tolerance, forward=forward, bucket=bucket).collect())
    whole = join(None)
    assert join(F.to_date) == whole and join(lambda t: F.lit(1)) == whole and any(not missing for _, missing, _, _ in whole)


def test_ticks_are_signed_over_midnight(spark):
    tape = spark.createDataFrame([("a", START + timedelta(hours=3 * k), k, p) for k, p in enumerate([5.0, 6.0, 6.0, 6.0, 5.0, 5.0, 7.0])] + [("b", START, 9, 1.0)], "symbol string, ts timestamp_ntz, seq int, price double")
    assert [(r.seq, r.change, r.sign) for r in market.signed_flow(tape).orderBy("seq").collect()] == [(0, None, 0), (1, 1.0, 1), (2, 0.0, 1), (3, 0.0, 1), (4, -1.0, -1), (5, 0.0, -1), (6, 2.0, 1), (9, None, 0)]


def test_volatility_of_windows(spark):
    r = random.Random(8)
    given = [("a", START + timedelta(seconds=r.randint(0, 600)), k, r.choice([0.0, -1.0, None, r.uniform(1, 50), r.uniform(1, 50)])) for k in range(150)]
    df = spark.createDataFrame(given, "symbol string, ts timestamp_ntz, seq int, price double")
    line = sorted((t, k, p) for _, t, k, p in given if p is not None and p > 0)
    for x in market.realized_volatility(df, 60).collect():
        at = next(t for t, k, _ in line if k == x.seq)
        near = [p for t, _, p in line if at - timedelta(seconds=60) <= t <= at]
        logs = [math.log(b / a) for a, b in zip(near, near[1:])]
        assert x.points == len(near) and (x.volatility is None if len(near) < 3 else abs(x.volatility - st.stdev(logs)) < 1e-8)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0, 0.01])
def test_similar_groups(spark, least):
    r = random.Random(4)
    base = [r.sample(range(40), 12) for _ in range(4)]
    groups = {k: {x for x in r.choice(base) if r.random() < 0.85} | {r.randint(0, 60)} for k in range(40)}
    members = [(g, i) for g, items in groups.items() for i in items] + [(None, 1), (1, None), (2, min(groups[2]))]
    want = {(a, b, len(groups[a] & groups[b])) for a in groups for b in groups if a < b and groups[a] & groups[b] and len(groups[a] & groups[b]) / len(groups[a] | groups[b]) >= least}
    got = graph.set_similarity(spark.createDataFrame(members, "g int, i int"), "g", "i", least).collect()
    assert {(r.a, r.b, r.shared) for r in got} == want and len(got) == len(want)


def test_pairs_within_a_caliper(spark):
    r = random.Random(9)
    t, c = ([(k, r.choice("ab"), r.choice([None, r.uniform(-5, 5), float(r.randint(-3, 3))])) for k in range(60)] for _ in range(2))
    out = statistics.within_caliper(spark.createDataFrame(t, "t int, g string, x double"), spark.createDataFrame(c, "c int, g string, y double"), ["g"], "x", "y", 0.5).collect()
    assert sorted((r.t, r.c) for r in out) == sorted((i, j) for i, g, x in t for j, h, y in c if g == h and x is not None and y is not None and abs(x - y) <= 0.5)


def test_states_of_decisions(spark):
    events = [("p", "design", 1), ("p", "admit", 2), ("p", "exit", 3), ("p", "admit", 9), ("q", "design", 5), ("q", "admit", 5), ("q", "exit", 1), ("r", "design", 1), ("r", "admit", 2), ("r", "exit", 2), ("s", "admit", 1), ("s", "exit", 2), (None, "design", 1), (None, "admit", 4), (None, "exit", 6)]
    out = {r.k: (r.state, r.admitted and r.admitted.at.at, r.left and r.left.at.at) for r in positions.states(spark.createDataFrame(events, "k string, kind string, at int"), "k", "kind", ["at"], ["kind"]).collect()}
    assert out == {"p": ("closed", 2, 3), "q": ("designed", None, None), "r": ("open", 2, None), "s": ("unknown", None, None), None: ("closed", 4, 6)}
