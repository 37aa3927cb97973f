"""Ownership from filings against the rules said one target at a time."""

import random
from datetime import date, datetime, timedelta

from tidemark.operators.ownership import ownership

DAY = date(2020, 1, 1)


def utc_end(day):
    """23:59:59 in New York in winter."""
    return datetime(day.year, day.month, day.day, 4, 59, 59) + timedelta(days=1)


def by_target(t, names, subs, holds, shares):
    symbol, event, cutoff = t
    found = {c for s, c, a, z in names if s == symbol and a <= event and (z is None or event <= z)}
    if len(found) != 1:
        return None, None, None, None, "no_name"
    (cusip,) = found
    reports = []
    for period in {p for _, _, p, _ in subs}:
        chosen = {}
        for accession, manager, p, filed in subs:
            if p == period and filed < event and (filed, accession) > chosen.get(manager, (DAY - timedelta(days=999), "")):
                chosen[manager] = (filed, accession)
        held = sum(n for a, c, n in holds if c == cusip and a in {x for _, x in chosen.values()})
        if held > 0 and utc_end(max(f for f, _ in chosen.values())) <= cutoff:
            reports.append((period, held))
    if not reports:
        return cusip, None, None, None, "no_holdings"
    period, held = max(reports)
    counts = [(at, n) for s, e, at, n in shares if (s, e) == (symbol, event) and at <= cutoff]
    if not counts:
        return cusip, period, held, None, "no_shares"
    n = max(counts)[1]
    return cusip, period, held, n, "implausible" if held / n > 1.25 else None


def test_ownership(spark):
    r = random.Random(11)
    day = lambda: DAY + timedelta(days=r.randint(0, 60))
    names = [(f"s{k}", f"c{k}", DAY, r.choice([None, DAY + timedelta(days=30)])) for k in range(6)] + [("s0", "other", DAY, DAY + timedelta(days=10))]
    subs = [(f"a{k}", r.randint(0, 4), DAY + timedelta(days=20 * r.randint(0, 2)), day()) for k in range(40)]
    holds = [(f"a{r.randint(0, 41)}", f"c{r.randint(0, 5)}", r.randint(0, 9)) for _ in range(120)]
    targets = sorted({(f"s{r.randint(0, 7)}", e, datetime(e.year, e.month, e.day, r.choice([4, 21]))) for e in (day() for _ in range(60))})
    shares = [(s, e, c + timedelta(hours=r.choice([-5, -1, 3])), r.choice([5, 20, 100])) for s, e, c in targets for _ in range(r.randint(0, 2))]
    make = spark.createDataFrame
    out = ownership(make(targets, "symbol string, event_date date, cutoff timestamp_ntz"), make(names, "symbol string, cusip string, valid_from date, valid_to date"), make(subs, "accession string, manager int, report_period date, filing_date date"), make(holds, "accession string, cusip string, shares long"), make(shares, "symbol string, event_date date, available_at timestamp_ntz, shares long")).collect()
    got = sorted((x.symbol, str(x.event_date), x.cusip, x.report_period, x.institutional_shares, x.shares_outstanding if x.reason in (None, "implausible") else None, x.reason) for x in out)
    want = sorted((t[0], str(t[1]), *by_target(t, names, subs, holds, shares)) for t in targets)
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key) and {w[-1] for w in want} == {None, "no_name", "no_holdings", "no_shares", "implausible"}
    assert all(x.reason or abs(x.ratio - x.institutional_shares / x.shares_outstanding) < 1e-12 for x in out)
