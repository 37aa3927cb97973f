"""The graph built from events, and its features at event times, against a walk per seed."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import history

DAY, PUBLIC = datetime(2020, 1, 1), datetime(2020, 1, 20)


def test_build(spark):
    rows = [("e1", " ab ", 1, 10, DAY), ("e2", "AB", 1, 10, DAY - timedelta(days=2)), ("e1", "ab", 1, 10, DAY), ("e3", "cd", 2, 10, DAY), (None, "x", 3, 3, DAY), ("e4", "x", None, 3, DAY), ("e5", "x", 3, 3, None)]
    nodes, edges = history.build(spark.createDataFrame(rows, "event_id string, symbol string, security int, issuer int, at timestamp_ntz"), "CASE:1", PUBLIC)
    assert {tuple(r) for r in nodes.collect()} == {("CASE:1", "case", None), ("ISS:10", "issuer", None), ("SEC:1", "security", "AB"), ("SEC:2", "security", "CD"), ("EV:e1", "event", None), ("EV:e2", "event", None), ("EV:e3", "event", None)}
    e = edges.collect()
    assert len(e) == 3 * 3 + 2 and {(r.observed_at, r.public_at, r.confidence) for r in e if r.edge == "GE:IDENTITY:10:1"} == {(DAY - timedelta(days=2), DAY - timedelta(days=2), 0.9)}
    assert {r.public_at for r in e if r.edge_type == "case_contains_event"} == {PUBLIC}
    assert history.build(spark.createDataFrame([], "event_id string, symbol string, security int, issuer int, at timestamp_ntz"), "CASE:1", PUBLIC)[1].count() == 0


def small_graph(seed):
    r = random.Random(seed)
    names = [f"n{k}" for k in range(14)]
    kinds = {n: r.choice(["security", "security", "issuer", "case"]) for n in names}
    day = lambda: DAY + timedelta(days=r.randint(0, 9))
    edges = [(f"x{k}", r.choice(names), r.choice(names), r.choice("pq"), day(), day(), r.choice([None, day()]), r.choice([None, day()]), r.choice([0.5, 0.8, 1.0])) for k in range(40)]
    rows = [(n.upper(), d, r.choice([None, r.uniform(0, 4)]), r.choice([None, r.uniform(0, 4)]), None, r.uniform(0, 3)) for n in [*names, "zz"] for d in (DAY + timedelta(days=3), DAY + timedelta(days=8)) if r.random() < 0.7]
    return names, kinds, edges, rows


def seen(edges, at, live):
    return [e for e in edges if e[4] <= at and (e[6] or at) <= at <= (e[7] or at) and (not live or e[5] <= at)]


def walk(edges, start, hops):
    found, frontier = {start: (0, 1.0)}, {start: 1.0}
    for hop in range(1, hops + 1):
        step = {}
        for a, c in frontier.items():
            for _, s, d, *_, w in edges:
                for x, y in ((s, d), (d, s)):
                    if x == a and y not in found:
                        step[y] = max(step.get(y, 0), c * w * (0.92 if hop > 1 else 1))
        found |= {n: (hop, c) for n, c in step.items()}
        frontier = step
    return found


def items(edges, kinds, start, hops):
    near = [n for n, (h, _) in walk(edges, start, hops - 1).items()]
    out = set()
    for _, s, d, kind, *_ in edges:
        for x, y in ((s, d), (d, s)):
            if x in near:
                out |= {f"edge:{kind}", f"node:{kinds[y]}"}
    return out


@pytest.mark.parametrize(("seed", "live"), [(1, True), (2, False)])
def test_features_equal_a_walk_per_seed(spark, seed, live):
    names, kinds, edges, rows = small_graph(seed)
    nodes = spark.createDataFrame([(n, kinds[n], n.upper() if kinds[n] == "security" else None) for n in names], "node string, node_type string, symbol string")
    table = spark.createDataFrame(edges, "edge string, src string, dst string, edge_type string, observed_at timestamp_ntz, public_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double")
    given = spark.createDataFrame(rows, "symbol string, minute timestamp_ntz, l2 double, equity_volume_z double, option_volume_z double, spread_z double")
    cases = [n for n in names if kinds[n] == "case"]
    out = {(r.symbol, r.minute): r for r in history.features(given, nodes, table, live=live, cases=cases).collect()}
    assert len(out) == len(rows)
    values = {(s, d): x for s, d, *x in rows}
    for (symbol, minute), (l2, *_) in values.items():
        got, node = out[symbol, minute], symbol.lower()
        if kinds.get(node) != "security":
            assert got.status == "no_security_node" and got.related == 0
            continue
        visible = seen(edges, minute, live)
        related = {n: x for n, x in walk(visible, node, 2).items() if kinds[n] == "security" and n != node}
        peers = {n: values[n.upper(), minute] for n in related if (n.upper(), minute) in values}
        status = "no_related_securities" if not related else "no_peer_features" if not peers else "partial" if len(peers) < len(related) else "full"
        assert (got.status, got.related, got.direct, got.peers) == (status, len(related), sum(h == 1 for h, _ in related.values()), len(peers))
        assert abs(got.breadth - sum(c / h for h, c in related.values())) < 1e-9
        known = {n: v[0] for n, v in peers.items() if v[0] is not None}
        assert got.unusual == sum(v >= 2 for v in known.values()) and got.equity_volume_high == sum(v[1] is not None and v[1] >= 2 for v in peers.values()) and got.spread_wide == sum(v[3] >= 1.5 for v in peers.values())
        if known and l2 is not None:
            weights = {n: related[n][1] / related[n][0] for n in known}
            anomaly = sum(max(v - 2, 0) * weights[n] for n, v in known.items()) / sum(weights.values())
            assert abs(got.propagation - max(l2 - 2, 0) * anomaly) < 1e-9
        else:
            assert got.propagation is None
        own, alike = items(visible, kinds, node, 2), []
        for c in cases:
            if any(c in e[1:3] for e in visible):
                theirs = items(visible, kinds, c, 4)
                alike.append(len(own & theirs) / len(own | theirs))
        assert got.visible_cases == len(alike) and (not alike or abs(got.case_similarity_max - max(alike)) < 1e-9 and abs(got.case_similarity_mean - sum(alike) / len(alike)) < 1e-9)


def test_ambiguous_symbols_raise(spark):
    nodes = spark.createDataFrame([("a", "security", "S"), ("b", "security", "S")], "node string, node_type string, symbol string")
    rows = spark.createDataFrame([("S", DAY, 1.0, 1.0, 1.0, 1.0)], "symbol string, minute timestamp_ntz, l2 double, equity_volume_z double, option_volume_z double, spread_z double")
    edges = spark.createDataFrame([], "edge string, src string, dst string, edge_type string, observed_at timestamp_ntz, public_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double")
    with pytest.raises(history.Ambiguous):
        history.features(rows, nodes, edges)
