"""Readers with contracts, rejects and quarantine, on files with malformed members."""

import hashlib
import json
import zipfile
from datetime import date, datetime

import pytest

from tidemark.operators import orderbook
from tidemark.sources import contract, filings
from tidemark.sources.files import RejectedInput


def source(**more):
    return {"source_id": "s1", "record_kind": "equity_trade", "path": "t.csv", "authorized": True, "data_classification": "synthetic_fixture", "timezone": "America/New_York"} | more


def contracts(spark, folder, *sources):
    (folder / "c.json").write_text(json.dumps({"schema_version": "1", "sources": list(sources)}))
    return contract.load_contracts(spark, str(folder / "c.json"))


def test_contracts_fail_closed(spark, tmp_path):
    (c,) = contracts(spark, tmp_path, source(delimiter="pipe"))
    assert c.delimiter == "|" and c.path == f"{tmp_path}/t.csv"
    for bad in (source(authorized=False), source(record_kind="x"), source(data_classification="non_synthetic_authorized"), source(timezone="Mars/One"), source(delimiter="ab"), source(path=" "), source(source_id="")):
        with pytest.raises(RejectedInput):
            contracts(spark, tmp_path, bad)
    with pytest.raises(RejectedInput):
        contracts(spark, tmp_path, source(), source())
    with pytest.raises(RejectedInput):
        contracts(spark, tmp_path)


def test_trades_by_reason(spark, tmp_path):
    rows = ["Px,symbol,size,date,time,exchange", "1.5, abc ,10,2024-07-01,10:00:00,n", ",abc,10,2024-07-01,10:00:00,n", "nan,abc,10,2024-07-01,10:00:00,n", "1.5,,10,2024-07-01,10:00:00,n", "1.5,abc,1.5,2024-07-01,10:00:00,n", "1.5,abc,0,2024-07-01,10:00:00,n",
        "1.5,abc,1,2024-03-10,02:30:00,n", "1.5,abc,1,2024-11-03,01:30:00,n", "1.5,abc,1,2024-07-01,noon,n", '"2",abc,1,,09:30:00.25,q', f"1,{'x' * 65},1,2024-07-01,10:00:00,n", "1,abc"]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    (c,) = contracts(spark, tmp_path, source(column_map={"price": "Px"}, trade_date="2024-07-02"))
    events = contract.market_events(spark, c)
    counts = {r.reason: r.rows for r in contract.rejects(events).collect()}
    assert counts == {"accepted": 2, "price": 2, "symbol": 2, "size": 3, "timestamp: nonexistent": 1, "timestamp: ambiguous": 1, "timestamp: unsupported": 1}
    good = contract.accepted(events, strict=False).orderBy("event_ts_utc").collect()
    assert [(r.symbol, r.underlying_symbol, r.price, r.size, r.exchange, r.event_ts_utc) for r in good] == [("ABC", "ABC", 1.5, 10, "N", datetime(2024, 7, 1, 14)), ("ABC", "ABC", 2.0, 1, "Q", datetime(2024, 7, 2, 13, 30, 0, 250_000))]
    with pytest.raises(RejectedInput):
        contract.accepted(events)
    assert contract.covered(events, "2024-07-01", ["abc"]) == {"rows": 1, "missing": [], "valid": True}
    assert contract.covered(events, "2024-07-01", ["abc", "d"])["missing"] == ["D"] and not contract.covered(events, "2024-07-05", ["abc"])["valid"]


def test_option_quotes_by_reason(spark, tmp_path):
    head = "timestamp|underlying_symbol|option_symbol|expiration|strike|option_type|bid|ask|bid_size|ask_size"
    line = lambda **x: "|".join(str(v) for v in ({"t": "2024-07-01T14:00:00Z", "u": "spy", "o": "SPY1", "e": "2024-07-19", "k": "500", "c": "call", "b": "1", "a": "1.1", "bs": "", "as": "3"} | x).values())
    rows = [head, line(), line(b="-1"), line(a="0"), line(b="2"), line(bs="-1"), line(e="2024-02-30"), line(e=""), line(k="0"), line(c="x"), line(u=""), line(t="2024-07-01T10:00:00-04:00", c="P")]
    (tmp_path / "q.csv").write_text("\n".join(rows) + "\n")
    (c,) = contracts(spark, tmp_path, source(record_kind="option_quote", path="q.csv", delimiter="|"))
    events = contract.market_events(spark, c)
    assert {r.reason: r.rows for r in contract.rejects(events).collect()} == {"accepted": 3, "quote": 2, "crossed": 1, "quote_size": 1, "expiration": 1, "strike": 1, "option_type": 1, "underlying_symbol": 1}
    good = contract.accepted(events, strict=False).collect()
    assert {(r.symbol, r.option_type, r.bid_size, r.expiration, r.event_ts_utc) for r in good} == {("SPY1", "C", 0, date(2024, 7, 19), datetime(2024, 7, 1, 14)), ("SPY1", "C", 0, None, datetime(2024, 7, 1, 14)), ("SPY1", "P", 0, date(2024, 7, 19), datetime(2024, 7, 1, 14))}


def replayed(rows):
    """One message after the other, over a dictionary."""
    orders, matches, out = {}, {}, []
    for m in rows:
        kind = m["type"]
        if kind == "A":
            orders[m["order_ref"]] = (m["side"], m["symbol"], m["price"])
        elif kind == "D":
            orders.pop(m["order_ref"], None)
        elif kind == "U":
            old = orders.pop(m["order_ref"], None)
            if old and m["new_ref"]:
                orders[m["new_ref"]] = (old[0], old[1], old[2] if m["price"] is None else m["price"])
        elif kind == "E" and m["order_ref"] in orders:
            side, symbol, price = orders[m["order_ref"]]
            item = (m["row"], symbol, side, m["shares"], price if m["price"] is None else m["price"])
            out.append(item)
            if m["match_number"]:
                matches[m["match_number"]] = item
        elif kind == "B" and (gone := matches.pop(m["match_number"], None)):
            out.remove(gone)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_executions_equal_a_replay(spark, seed):
    import random

    r = random.Random(seed)
    rows = []
    for k in range(400):
        kind = r.choice("AAUUUDEEEEEBX")
        ref = lambda: f"r{r.randint(0, 14)}"
        rows.append({"source": "s", "row": k, "ts": datetime(2024, 1, 1), "type": kind, "order_ref": ref(), "new_ref": r.choice([ref(), ref(), ""]) if kind == "U" else "", "side": r.choice("BS"), "symbol": r.choice(["AB", "CD"]), "shares": r.randint(1, 9), "price": r.choice([None, float(r.randint(1, 99))]) if kind != "A" else float(r.randint(1, 99)), "match_number": r.choice(["", "m1", "m2", "m3"]) if kind in "EB" else "", "printable": ""})
    df = spark.createDataFrame(rows, "source string, row long, ts timestamp_ntz, type string, order_ref string, new_ref string, side string, symbol string, shares long, price double, match_number string, printable string")
    got = sorted((x.row, x.symbol, x.resting_side, x.executed_shares, x.execution_price) for x in orderbook.executions(df).collect())
    assert got == replayed(rows) and len(got) > 20


def test_messages_from_a_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("message_type,order_reference,side,symbol,shares,price,time,executed_shares,match_number\nA,1,b,abc,10,5,09:30:00,,\nE,1,,,,,09:30:01,4,7\n")
    (c,) = contracts(spark, tmp_path, source(record_kind="itch_decoded", path="m.csv", trade_date="2024-07-01"))
    (x,) = orderbook.executions(contract.messages(spark, c)).collect()
    assert (x.symbol, x.resting_side, x.aggressor_side, x.executed_shares, x.execution_price, x.ts) == ("ABC", "B", "S", 4, 5.0, datetime(2024, 7, 1, 13, 30, 1))
    (tmp_path / "m.csv").write_text("message_type,order_reference,side,symbol,shares,price,time\nA,1,x,abc,10,5,09:30:00\n")
    with pytest.raises(RejectedInput):
        contract.messages(spark, c)


def test_share_facts_are_quarantined_by_reason(spark, tmp_path):
    def facts(observations, cik=42):
        return {"cik": cik, "facts": {"dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": observations}}}}}

    good = {"end": "2020-03-31", "filed": "2020-05-01", "val": 1000, "form": "10-Q", "accn": "a1"}
    files = {
        "good": facts([good, good, good | {"accn": "a2"}, good | {"val": 10.5}, good | {"val": True}, good | {"val": "2000"}, good | {"val": -1}, good | {"val": None}, good | {"end": "20200331"}, good | {"filed": "2020-03-01"}, good | {"end": "1999-01-01", "filed": "1999-01-02"}, None, 5, good | {"end": "2020-02-30"}]),
        "other": facts([good], cik="0000000077"), "array": [1], "facts": {"cik": 42, "facts": []}, "units": {"cik": 42, "facts": {"dei": {"EntityCommonStockSharesOutstanding": {"units": []}}}}, "shares": facts({}), "none": {"cik": 42, "facts": {"dei": {}}}, "null": facts(None),
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{")
    symbols = spark.createDataFrame([("42", "OLD", "2000-01-01", "2020-04-30"), ("42", "NEW", "2020-01-01", ""), ("42", " ", "2020-02-01", None)], "cik string, historical_symbol string, effective_from string, effective_to string")
    out = filings.share_facts(filings.whole_files(spark, str(tmp_path / "*.json")), symbols).collect()
    kept = {(r.historical_symbol, r.fact_date, r.shares_outstanding, r.accession, r.available_at) for r in out if r.reason is None}
    end = datetime(2020, 5, 2, 3, 59, 59)
    assert kept == {("NEW", date(2020, 3, 31), "1000", "a1", end), ("NEW", date(2020, 3, 31), "1000", "a2", end), ("NEW", date(2020, 3, 31), "2000", "a1", end)}
    count = {}
    for r in out:
        count[r.reason] = count.get(r.reason, 0) + 1
    assert count == {None: 3, "container": 6, "observation": 2, "value": 4, "dates": 3, "no_symbol": 2}


def test_filings_and_holdings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"filings": {"recent": {"accessionNumber": ["x", " ", "z"], "filingDate": ["2020-01-02T00", "b", "c"], "form": ["10-k", "8-K"]}}}))
    (tmp_path / "b.json").write_text(json.dumps({"accessionNumber": ["q"], "filingDate": [None], "form": ["4"]}))
    (tmp_path / "c.json").write_text(json.dumps({"filings": {"recent": None}}))
    got = filings.recent_filings(filings.whole_files(spark, str(tmp_path / "*.json"))).collect()
    assert sorted((r.accession_number, r.filing_date, r.form) for r in got) == [("q", "", "4"), ("x", "2020-01-02", "10-K")]
    positions = spark.createDataFrame([("1", "aa", "5", "SH", None), ("1", "AA", "6", "sh", ""), ("1", "AA", "7", "PRN", None), ("1", "AA", "8", "SH", "Put"), ("2", "AA", "9", "SH", None), ("1", "BB", "x", "SH", None)], "ACCESSION_NUMBER string, CUSIP string, SSHPRNAMT string, SSHPRNAMTTYPE string, PUTCALL string")
    submissions = spark.createDataFrame([("1", "13F-HR"), ("2", "13F-NT")], "ACCESSION_NUMBER string, SUBMISSIONTYPE string")
    assert [tuple(r) for r in filings.holdings(positions, submissions).collect()] == [("1", "AA", 11)]


def test_positional_and_headerless_lines(spark, tmp_path):
    def line(symbol, exchange, shares):
        text = [" "] * 190
        for start, value in ((26, symbol), (156, exchange), (177, shares)):
            text[start : start + len(value)] = value
        return "".join(text)

    (tmp_path / "m.txt").write_text("\n".join([line("ABC", "00", "1,000"), line("OTC", "01", "5"), line("BAD", "00", "x"), line("TWO", "00", "1"), line("two", "00", "2"), "short"]) + "\n")
    assert sorted(tuple(r) for r in filings.master_lines(spark, str(tmp_path / "m.txt")).collect() if r.symbol != "TWO") == [("ABC", 1000, None), ("BAD", None, "shares"), ("OTC", None, "exchange")]
    assert {r.reason for r in filings.master_lines(spark, str(tmp_path / "m.txt")).collect() if r.symbol == "TWO"} == {"several"}
    row = lambda s, at, n, on: "|".join([at, "", s, *[""] * 13, n, on])
    (tmp_path / "f.txt").write_text("\n".join([row("x", "Effective Date", "", ""), row("abc", "7/1/2024 06:00", "1,500", "06/30/2024"), row("d", "07/01/2024", "1", "06/30/2024"), row("e", "07/01/2024 06:00:00", "0", "06/30/2024"), row("f", "07/01/2024 06:00", "1", "13/30/2024"), "a|b"]) + "\n")
    got = {r.symbol: r for r in filings.fundamentals(spark, str(tmp_path / "f.txt")).collect()}
    assert (got["ABC"].shares, got["ABC"].fact_date, got["ABC"].available_at, got["ABC"].reason) == (1500, date(2024, 6, 30), datetime(2024, 7, 1, 10), None)
    assert {s: r.reason for s, r in got.items() if s != "ABC"} == {"D": "effective", "E": "shares", "F": "shares_date"}


def test_archives(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    rows = [{"observed_minute": "1", "symbol": "A", "bid": 2}, {"observed_minute": "2", "symbol": "A", "bid": 3}]
    chunk = lambda rs: json.dumps({"extracts": [{"result": {"result": [{"results": rs}]}}]}).encode()

    def write(**chunks):
        for name, raw in chunks.items():
            (folder / name).write_bytes(raw)
        (folder / "manifest.json").write_text(json.dumps({"version": 1, "chunks": {n: {"sha256": hashlib.sha256(raw).hexdigest()} for n, raw in chunks.items()}}))

    write(one=chunk(rows), two=chunk(rows[:1]))
    assert sorted((r.observed_minute, r.symbol, json.loads(r.row)["bid"]) for r in filings.archived_rows(spark, str(folder)).collect()) == [("1", "A", 2), ("2", "A", 3)]
    write(one=chunk(rows), two=chunk([rows[0] | {"bid": 9}]))
    with pytest.raises(RejectedInput):
        filings.archived_rows(spark, str(folder))
    (folder / "one").write_bytes(chunk(rows[:1]))
    with pytest.raises(RejectedInput):
        filings.archived_rows(spark, str(folder))
    zips = tmp_path / "z"
    zips.mkdir()
    with zipfile.ZipFile(zips / "ok.zip", "w") as z:
        z.writestr("d/1.txt", "hello" * 100)
        z.writestr("2.txt", "")
    raw = bytearray((zips / "ok.zip").read_bytes())
    raw[45] ^= 255
    (zips / "torn.zip").write_bytes(raw)
    (zips / "no.zip").write_bytes(b"nothing")
    got = {(r.archive, r.member, r.bytes, r.reason) for r in filings.archive_members(spark, str(zips)).collect()}
    assert got == {("ok.zip", "d/1.txt", 500, None), ("ok.zip", "2.txt", 0, None), ("torn.zip", "d/1.txt", 500, "corrupt"), ("torn.zip", "2.txt", 0, None), ("no.zip", None, None, "unreadable")}
