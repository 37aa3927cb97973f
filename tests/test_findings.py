"""What the review of round 3 found: work that must not grow faster than its tables."""

import json
import random
from datetime import date, datetime, timedelta

import pytest

from tidemark import research
from tidemark.operators import admission, graph, market, modelling, orderbook, ownership, statistics
from tidemark.sources import filings


def shuffled(spark, df) -> int:
    """Records that running ``df`` writes into shuffles."""
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()

    def total() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_pairs_of_equal_groups_are_not_shuffled(spark):  # F1
    members = spark.range(600).repartition(4).selectExpr("id AS g", "id % 3 AS i")
    out = graph.set_similarity(members, "g", "i", 0.5)
    assert out.count() == 3 * 200 * 199 // 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        assert shuffled(spark, graph.set_similarity(members, "g", "i", 0.5)) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_and_small_groups_meet(spark):  # F1
    r = random.Random(11)
    base = [r.sample(range(90), 24) for _ in range(3)]
    groups = {k: {x for x in r.choice(base) if r.random() < r.choice([0.4, 0.6, 0.95])} | {r.randint(0, 5)} for k in range(120)}
    groups |= {200 + k: groups[k] for k in range(0, 120, 7)}
    for least in (0.4, 0.5, 2 / 3):
        want = {(a, b, len(groups[a] & groups[b])) for a in groups for b in groups if a < b and len(groups[a] & groups[b]) / len(groups[a] | groups[b]) >= least}
        got = graph.set_similarity(spark.createDataFrame([(g, i) for g, items in groups.items() for i in items], "g int, i int"), "g", "i", least).collect()
        assert {(x.a, x.b, x.shared) for x in got} == want and len(got) == len(want)


def test_windows_over_time_only_grow(spark):  # F3, F6
    rows = spark.range(9).selectExpr("timestamp_seconds(id * 300) AS ts", "'a' AS symbol", "CAST(id + 1 AS DOUBLE) AS price", "id AS seq")
    for out in (market.realized_volatility(rows, 1800), market.lagged_return(rows, 900, 300), market.trailing(rows, 900, 3.0)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "specifiedwindowframe(RangeFrame, -" not in plan and "specifiedwindowframe(RangeFrame, unboundedpreceding$()" in plan


def test_trailing_by_brute_force(spark):  # F6
    r = random.Random(3)
    rows = [(datetime(2024, 1, r.choice([1, 2])) + timedelta(seconds=r.choice([r.randint(0, 7200), 300 * r.randint(0, 24)])), r.choice("ab"), r.choice([None, float(r.randint(1, 9))]), k) for k in range(300)]
    out = {x.seq: x for x in market.trailing(spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, price double, seq int"), 300, 5.0).collect()}
    assert len(out) == len(rows)
    for ts, symbol, price, k in rows:
        near = [(t, p) for t, s, p, _ in rows if s == symbol and t.date() == ts.date() and timedelta(0) <= ts - t <= timedelta(seconds=300)]
        known = [(t.timestamp() / 60, p) for t, p in near if p is not None]
        x = out[k]
        assert x.points == len(near) and x.peak == max((p for _, p in known), default=None) and x.at_least == (sum(p >= 5 for _, p in known) if known else None)
        mx, my = (sum(c) / len(known) for c in zip(*known)) if known else (0, 0)
        wide = sum((t - mx) ** 2 for t, _ in known)
        assert x.slope is None if wide < 1e-9 else abs(x.slope - sum((t - mx) * (p - my) for t, p in known) / wide) < 1e-5
        before = [p for t, p in near if t < ts and p is not None]
        assert x.acceleration is None if price is None or not before else abs(x.acceleration - (price - sum(before) / len(before))) < 1e-9


def test_nearest_controls_without_pairs(spark):  # F5
    r = random.Random(5)
    t, c = ([(k, r.choice("ab"), r.choice([None, r.uniform(-5, 5), float(r.randint(-3, 3))])) for k in range(80)] for _ in range(2))
    for cut in (3, 80):
        out = statistics.nearest_within(spark.createDataFrame(t, "t int, g string, x double"), spark.createDataFrame(c[:cut], "c int, g string, y double"), ["g"], "x", "y", 0.5, "c", 3).collect()
        want = set()
        for i, g, x in t:
            met = sorted((round(abs(x - y), 9), j) for j, h, y in c[:cut] if g == h and x is not None and y is not None and abs(x - y) <= 0.5)
            want |= {(i, n + 1, j, len(met)) for n, (_, j) in enumerate(met[:3])}
        assert {(x.t, x.rank_in_group, x.c, x.pool) for x in out} == want and len(out) == len(want)


def test_open_risk_is_kept(spark):  # F9
    class Counted(dict):
        reads = 0

        def items(self):
            Counted.reads += 1
            return super().items()

    book = admission.Book(10**9, registered=0, open=Counted())
    minute = 60_000_000
    for k in range(50):
        assert book.take(k, "ADMIT", f"d{k}", k, k + 2 * minute, None, 7) == ("ADMITTED", 7 * k)
    assert book.take(50, "ADMIT", "d3", 3, 3 + 2 * minute, None, 7) == ("REPLAY", 7 * 49)
    assert book.take(3 + 2 * minute, "EXIT", "d3", None, None, None, None) == ("CLOSED_NOW", 7 * 49)
    assert book.take(60, "EXIT", "none", None, None, None, None) == ("UNKNOWN", 7 * 49) and Counted.reads == 0


def test_folds_take_one_matrix(spark, sf_dir, monkeypatch):  # F7
    taken = []

    def instead(prepared, *_, **__):
        taken.append((prepared, prepared.is_cached))
        raise modelling.NotTrainable("enough seen")

    monkeypatch.setattr(modelling, "out_of_fold", instead)
    with pytest.raises(modelling.NotTrainable):
        research.grouped_oof_metrics(spark, sf_dir)
    ((prepared, kept),) = taken
    assert kept and not prepared.is_cached


def test_models_are_boosted_all_rounds(spark, sf_dir, monkeypatch):  # F5 of round 4
    asked = []

    def seen(rows, features, rounds, seed):
        asked.append((rounds, seed))
        raise modelling.NotTrainable("enough seen")

    monkeypatch.setattr(modelling, "_fit", seen)
    with pytest.raises(modelling.NotTrainable):
        research.grouped_oof_metrics(spark, sf_dir)
    assert {rounds for rounds, _ in asked} == {160} and {seed for _, seed in asked} == {18, 19, 20, 21}


def test_facts_are_read_once(spark):  # F8
    facts = [{"end": f"2020-01-{1 + k % 28:02}", "filed": "2020-05-01", "val": 1 + k, "accn": f"a{k}"} for k in range(600)]
    text = lambda f: json.dumps({"cik": 42, "facts": {"dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [f]}}}}})
    files = spark.createDataFrame([(f["accn"], text(f)) for f in facts], "path string, text string")
    symbols = spark.createDataFrame([("42", f"S{k}", f"2020-01-{1 + k:02}", f"2020-01-{20 + k:02}") for k in range(5)], "cik string, historical_symbol string, effective_from string, effective_to string")
    plan = filings.share_facts(files, symbols).groupBy("reason").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("parse_json") + plan.count("parseJson") == 1
    got = {(r.fact_date.day, r.historical_symbol) for r in filings.share_facts(files, symbols).collect()}
    assert got == {(d, f"S{min(4, d - 1)}" if d <= 24 else None) for d in range(1, 29)}


def test_periods_of_a_target_stay_where_they_are(spark):  # F10
    days = [date(2020, 1, 1) + timedelta(days=k) for k in range(400)]
    make = spark.createDataFrame
    targets = make([("s", d, datetime(d.year, d.month, d.day, 21)) for d in days[100:300]], "symbol string, event_date date, cutoff timestamp_ntz")
    names = make([("s", "c", days[0], None)], "symbol string, cusip string, valid_from date, valid_to date")
    filed = make([(f"a{k}", 1, days[k], days[k + 3]) for k in range(30)], "accession string, manager int, report_period date, filing_date date")
    held = make([(f"a{k}", "c", 5) for k in range(30)], "accession string, cusip string, shares long")
    counts = make([("s", d, datetime(2020, 1, 1), 10) for d in days[100:300]], "symbol string, event_date date, available_at timestamp_ntz, shares long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, ownership.ownership(targets, names, filed, held, counts)) < 4_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (row,) = ownership.ownership(targets, names, filed, held, counts).select("report_period", "institutional_shares", "ratio", "reason").distinct().collect()
    assert tuple(row) == (days[29], 5, 0.5, None)


def test_an_execution_is_shuffled_twice(spark):  # F4 of round 4
    """Once by its order's reference and once by its match number, with what it carries."""
    add = [("f", 10 * k, "A", f"o{k}", "", "B" if k % 2 else "S", "x", 5, 1.0 + k, "") for k in range(100)]
    run = [("f", 10_000 + k, "E", f"o{k % 110}", "", None, None, 1, None, f"m{k}" if k % 3 else "") for k in range(2_000)]
    off = [("f", 20_000 + k, "B", "", "", None, None, None, None, f"m{k}") for k in range(0, 2_000, 4)]
    m = spark.createDataFrame(add + run + off, "source string, row long, type string, order_ref string, new_ref string, side string, symbol string, shares long, price double, match_number string").selectExpr("*", "TIMESTAMP_NTZ '2020-01-01 00:00:00' AS ts", "'' AS printable")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, orderbook.executions(m)) < 2 * 2_000 + 1_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(10_000 + k, "B" if k % 110 % 2 else "S", 1.0 + k % 110) for k in range(2_000) if k % 110 < 100 and not (k % 4 == 0 and k % 3)}
    assert {(r.row, r.resting_side, r.execution_price) for r in orderbook.executions(m).collect()} == want
