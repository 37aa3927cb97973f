"""Vendor rows, legs of option chains and required histories on literal rows."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.functions import ticks, vendor
from tidemark.operators import chains
from tidemark.plans import coverage

T = datetime


def rows_of(spark, rows):
    names = list(dict.fromkeys(n for r in rows for n in r))
    return spark.createDataFrame([(k, *(r.get(n) for n in names)) for k, r in enumerate(rows)], ", ".join(["_k int", *(f"`{n}` string" for n in names)]))


def test_vendor_trades(spark):
    good = {"#RIC": "IBM.N", "Type": "Trade", "Price": "10.5", "Volume": "100", "Date-Time": "2024-01-03T14:30:00.123456789Z", "Qualifiers": "", "Date[G]": "03-JAN-2024", "Exch Time": "14:30:01", "GMT Offset": "-5", "Ex/Cntrb.ID": "NYS", "historical_symbol": "IBM"}
    rows = [good, good | {"Type": ""}, good | {"Type": "Quote"}, good | {"Price": "0"}, good | {"Volume": "x"}, good | {"Date-Time": "2024-01-03T14:30:00"}, good | {"Date-Time": ""}, good | {"Date-Time": None, "Exch Time": "noon"}, good | {"Date-Time": "2024-01-03T09:30:00-05:00", "Qualifiers": "T [GV4_TEXT]; 6Z[LSTSALCOND];ODD[IRGCOND]"}, good | {"Qualifiers": "O [CTS_QUAL];T[PRC_QL_CD]"}]
    out = ticks.trades(rows_of(spark, rows)).orderBy("_k").collect()
    assert [r.reason for r in out] == [None, None, "type", "economics", "economics", "timestamp", None, "timestamp", None, None]
    assert [out[k].timestamp for k in (0, 6, 8)] == [T(2024, 1, 3, 14, 30, 0, 123456), T(2024, 1, 3, 9, 30, 1), T(2024, 1, 3, 14, 30)]
    assert {n for n, on in out[8].flags.asDict().items() if on} == {"form_t", "closing", "sold_out_of_sequence", "odd_lot"} and {n for n, on in out[9].flags.asDict().items() if on} == {"opening"}
    assert (out[0].symbol, out[0].price, out[0].size, out[0].exchange) == ("IBM", 10.5, 100.0, "NYS")


def test_vendor_quotes_and_options(spark):
    good = {"#RIC": "AAPLA192405000.U", "Bid Price": "1", "Ask Price": "1.2", "Bid Size": "0", "Ask Size": "5", "Date-Time": "2024-01-03T14:30:00Z", "Qualifiers": "R[PRC_QL_CD];OQ [PRC_QL3];xNQ[PRC_QL3]", "strike": None, "option_type": None}
    rows = [good, good | {"#RIC": "AAPL"}, good | {"Bid Price": "1.3"}, good | {"Bid Price": "-1"}, good | {"Ask Size": ""}, good | {"strike": "60", "option_type": "p"}, good | {"strike": "-1"}, good | {"option_type": "x"}]
    out = ticks.quotes(rows_of(spark, rows), option=True).orderBy("_k").collect()
    assert [r.reason for r in out] == [None, "metadata", "economics", "economics", "economics", None, "metadata", "metadata"]
    assert (out[0].symbol, out[0].underlying_symbol, out[0].expiration, out[0].strike, out[0].option_type) == ("AAPLA192405000", "AAPL", date(2024, 1, 19), 50.0, "call") and (out[5].strike, out[5].option_type) == (60.0, "put")
    assert {n for n, on in out[0].flags.asDict().items() if on} == {"regular", "opening"}


def test_legs_end_at_the_first_rule_they_fail(spark):
    good = {"side": "call", "own": True, "lot": 100, "strike": 102.0, "bid": 1.0, "ask": 1.1, "interest": 100, "age": 120.0, "spot": 100.0, "iv": 0.3, "updated": "2024-01-03T14:30:00Z"}
    changes = [{}, {"side": "other"}, {"side": None}, {"own": False}, {"lot": 10}, {"strike": 0.0}, {"bid": 0.0}, {"ask": float("nan")}, {"ask": 0.9}, {"age": None}, {"age": 120.1}, {"interest": 99}, {"ask": 1.4}, {"strike": 100.0}, {"side": "put", "strike": 100.0}, {"side": "put", "strike": 99.0}, {"side": "call", "ask": 1.4, "interest": 5}]
    want = ["liquid", "no_option", "no_option", "adjusted", "adjusted", "strike", "nonpositive", "nonpositive", "crossed", "stale", "stale", "interest", "wide", "in_the_money", "in_the_money", "liquid", "interest"]
    schema = "k int, side string, own boolean, lot int, strike double, bid double, ask double, interest int, age double, spot double, iv double, updated string"
    leg = [F.col(c) for c in ("side", "own", "lot", "strike", "bid", "ask", "interest", "age", "spot")]
    df = spark.createDataFrame([(k, *(good | c).values()) for k, c in enumerate(changes)], schema)
    assert [r[0] for r in df.orderBy("k").select(chains.stage(*leg)).collect()] == want
    now = 1_704_292_200.0  # 14:30 UTC
    more = [{}, {"strike": 104.0}, {"own": False}, {"age": 121.0}, {"iv": 30.0}, {"updated": " "}, {"updated": None}, {"updated": "2024-01-03T14:30:00"}, {"updated": "soon"}, {"updated": "2024-01-03T14:31:01+00:00"}, {"updated": "2024-01-03T12:59:59Z"}, {"updated": "2024-01-03T09:30:00-05:00"}]
    df = spark.createDataFrame([(k, *(good | c).values()) for k, c in enumerate(more)], schema)
    got = [r[0] for r in df.orderBy("k").select(chains.greeks_stage(*leg, F.col("iv"), F.col("updated"), F.lit(now))).collect()]
    assert got == ["fresh", None, None, "quote", "iv", "missing", "missing", "naive", "malformed", "future", "stale", "fresh"]
    ages = spark.createDataFrame([(k, v) for k, v in enumerate([None, 0.0, 120.0, 120.5, 300.0, 900.0, 901.0])], "k int, a double").orderBy("k")
    assert [r[0] for r in ages.select(chains.age_bin(F.col("a"))).collect()] == ["age_missing_or_unparseable", *["age_at_most_120s"] * 2, *["age_121_to_300s"] * 2, "age_301_to_900s", "age_over_900s"]


def test_required_histories_skip_early_closes(spark):
    cal = coverage.sessions(spark, date(2024, 6, 24), date(2024, 7, 12), holidays=[date(2024, 7, 4)], early=[date(2024, 7, 3)])
    candidates = [("a", T(2024, 7, 8, 12, 59, 30)), ("b", T(2024, 7, 8, 13, 0)), ("c", T(2024, 7, 6, 12)), ("d", T(2024, 7, 8, 16, 0, 1)), ("e", T(2024, 6, 26, 10)), ("f", T(2024, 7, 3, 13, 30)), ("a", T(2024, 7, 8, 12, 59, 30))]
    needs, refused = coverage.history_requirements(cal, spark.createDataFrame(candidates, "symbol string, cutoff timestamp_ntz"), normal=2, closes=4)
    assert {r.symbol: r.reason for r in refused.collect()} == {"c": "no_session", "d": "outside_session", "e": "short_history", "f": "outside_session"}
    got = {(r.symbol, r.trade_date.day): r for r in needs.collect()}
    normal = lambda s: {d for (x, d), r in got.items() if x == s and "normalization_baseline" in r.roles}
    closes = lambda s: {d for (x, d), r in got.items() if x == s and "daily_close_history" in r.roles}
    assert normal("a") == {3, 5} and normal("b") == {2, 5} and closes("a") == closes("b") == {1, 2, 3, 5}
    assert (got["b", 8].event_minutes, got["b", 8].roles, got["b", 2].normal_minutes, got["a", 3].close_minute) == ("12:59;13:00", "event_point", "13:00", "12:59")
    assert not got["a", 1].needs_quotes_and_shares and got["a", 3].needs_quotes_and_shares and got["a", 5].event_dates == 1


def test_contract_codes(spark):
    rows = [("SPY240119C00450500", "SPY", date(2024, 1, 19), "C", 450.5), ("SPY   240119C00450500", "SPY", date(2024, 1, 19), "C", 450.5), ("SPY240119C00450500", "QQQ", date(2024, 1, 19), "C", 450.5), ("SPY240119C00450500", "SPY", date(2024, 1, 20), "C", 450.5), ("SPY240119C00450500", "SPY", date(2024, 1, 19), "P", 450.5), ("SPY240119C00450500", "SPY", date(2024, 1, 19), "C", 450.0), ("SPY240230C00450500", "SPY", date(2024, 2, 29), "C", 450.5), ("spy", "SPY", date(2024, 1, 19), "C", 450.5), (None, "SPY", date(2024, 1, 19), "C", 450.5)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, code string, root string, expiration date, right string, strike double").orderBy("k")
    args = [F.col(c) for c in ("root", "expiration", "right", "strike")]
    assert [r[0] for r in df.select(vendor.contract_reason(F.col("code"), *args)).collect()] == [None, None, "root", "expiration", "right", "strike", "shape", "shape", "shape"]
    assert [r[0] for r in df.select(vendor.occ_symbol(*args)).collect()][:3] == ["SPY240119C00450500"] * 2 + ["QQQ240119C00450500"]
    codes = spark.createDataFrame([(0, ".spy240119c450.5 "), (1, "SPY240119P.5"), (2, "SPY240119X1"), (3, "")], "k int, c string").orderBy("k")
    d = vendor.streamed_parts(F.col("c"))
    assert [tuple(r) for r in codes.select(d["root"], d["expiration"], d["right"], d["strike"]).collect()] == [("SPY", date(2024, 1, 19), "C", 450.5), ("SPY", date(2024, 1, 19), "P", 0.5), (None,) * 4, (None,) * 4]


def test_depth_of_marks(spark):
    legs = {"short_contract": "SPY240119C00450000", "long_contract": "SPY240119C00455000"}
    prices = {"short_bid": 2.0, "short_ask": 2.1, "long_bid": 1.0, "long_ask": 1.1}
    mark = legs | {"decision": 1000.0, "entry": 1010.0, "exit": 5000.0, "entry_quote": 999.0, "exit_quote": 4999.0} | {f"{e}_{s}": p for e in ("entry", "exit") for s, p in prices.items()}
    depth = legs | {f"{e}_{s}{x}": v for e, t in (("entry", 990.0), ("exit", 4990.0)) for s, p in prices.items() for x, v in (("_size", 5.0), ("_at", t), ("_px", p))}
    changed = [("ok", {}, {}), ("a", {"short_contract": None}, {}), ("b", {}, {"long_contract": "x"}), ("c", {"long_contract": legs["short_contract"]}, {}), ("d", {"exit": 9001.0}, {}), ("e", {"decision": 1011.0}, {}), ("f", {"entry_quote": 1001.0}, {}), ("g", {}, {"entry_long_ask_at": None}), ("h", {}, {"exit_short_bid_size": 1.0}),
        ("i", {"exit_long_bid": 1.01}, {}), ("j", {}, {"exit_long_ask_at": 4999.5}), ("k", {}, {"entry_short_ask_at": 880.0}), ("l", {"entry_short_bid": 2.2}, {"entry_short_bid_px": 2.2}), ("m", {}, {"exit_short_bid_at": 4925.0}), ("n", {"exit_long_ask": 0.0}, {"exit_long_ask_px": 0.0})]
    want = {"ok": None, "a": "missing_contract", "b": "invalid_contract", "c": "mismatch", "d": "future_exit", "e": "clock", "f": "clock", "g": "missing_side", "h": "depth", "i": "price", "j": "future_side", "k": "stale_side", "l": "crossed", "m": "skew", "n": "ask", "only mark": "bad_key", "p": "no_record", "q": "no_mark", "r": "repeated"}
    kinds = lambda row: ", ".join(["id string", *(f"{c} {'string' if c.endswith('contract') else 'double'}" for c in row)])
    marks = [(k, *(mark | m).values()) for k, m, _ in changed] + [("only mark", *mark.values()), ("p", *mark.values()), ("r", *mark.values())]
    records = [(k, *(depth | d).values()) for k, _, d in changed] + [("q", *depth.values()), ("r", *depth.values()), ("r", *depth.values())]
    out = chains.depth_audit(spark.createDataFrame(marks, kinds(mark)), spark.createDataFrame(records, kinds(depth)), "id", F.lit(9000.0), contracts=2)
    assert {r.id: r.reason for r in out.collect()} == want
