"""A graph of issuers, securities, events and a case, built from dated events, and features of many seeds at many times.

Edges know when they were observed and when they became public. A seed is a node and a time; all seeds walk
together, a hop is one join of the frontier with the edges of its nodes, and what an edge shows
depends on the seed's time, not on today's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut
from .graph import HOP_DECAY

#: Confidence of what a case says and of an identity; from where on a peer counts as unusual.
CASE_CONFIDENCE, IDENTITY_CONFIDENCE = 0.95, 0.90
UNUSUAL = {"l2": 2.0, "equity_volume_z": 2.0, "option_volume_z": 2.0, "spread_z": 1.5}


class Ambiguous(ValueError):
    """A symbol that names several securities of the graph."""


def build(events: DataFrame, case_id: str, case_public_at) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, node_type, symbol) and edges (edge, src, dst, edge_type, observed_at, public_at, valid_from, valid_to, confidence).

    ``events`` has event_id, symbol, security, issuer and at (UTC). What ties an event to the case, its issuer and its security was
    observed then and public with the case; that an issuer has a security is public since the first event
    that shows it. Events that repeat are one; those without an id, security or issuer are left out.
    """
    e = events.filter("event_id IS NOT NULL AND security IS NOT NULL AND issuer IS NOT NULL AND at IS NOT NULL").select("event_id", F.upper(F.trim("symbol")).alias("symbol"), "security", "issuer", F.col("at").cast("timestamp_ntz").alias("at")).distinct()
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    event, security, issuer = name("EV:", "event_id"), name("SEC:", "security"), name("ISS:", "issuer")
    none = F.lit(None).cast("timestamp_ntz")
    node = lambda df, n, kind, symbol=F.lit(None).cast("string"): df.select(n.alias("node"), F.lit(kind).alias("node_type"), symbol.alias("symbol"))
    one = e.groupBy(security.alias("node")).agg(F.lit("security").alias("node_type"), F.max("symbol").alias("symbol"))
    case = e.sparkSession.range(1).select(F.lit(case_id).alias("node"), F.lit("case").alias("node_type"), F.lit(None).cast("string").alias("symbol"))
    nodes = node(e, event, "event").union(node(e, issuer, "issuer")).distinct().union(one).union(case)
    public = F.lit(case_public_at).cast("timestamp_ntz")

    def edge(df, prefix, src, dst, kind, observed, shown, confidence):
        key = F.concat(F.lit(f"GE:{prefix}:"), F.col("key").cast("string"))
        return df.select(key.alias("edge"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), observed.alias("observed_at"), shown.alias("public_at"), none.alias("valid_from"), none.alias("valid_to"), F.lit(confidence).alias("confidence"))

    told = e.withColumn("key", F.col("event_id"))
    first = e.groupBy("issuer", "security").agg(F.min("at").alias("first_seen")).withColumn("key", F.concat_ws(":", F.col("issuer").cast("string"), F.col("security").cast("string")))
    edges = edge(told, "CASE", F.lit(case_id), event, "case_contains_event", F.col("at"), public, CASE_CONFIDENCE)
    edges = edges.union(edge(told, "ISSUER", event, issuer, "event_concerns_issuer", F.col("at"), public, CASE_CONFIDENCE)).union(edge(told, "SECURITY", event, security, "event_observed_in_security", F.col("at"), public, CASE_CONFIDENCE))
    return nodes, edges.union(edge(first, "IDENTITY", issuer, security, "issuer_has_security", F.col("first_seen"), F.col("first_seen"), IDENTITY_CONFIDENCE))


def _shown(at: Column, live: bool) -> Column:
    """Edges known and valid at a seed's time; in live surveillance also public by then."""
    ok = (F.col("observed_at") <= at) & (F.coalesce("valid_from", at) <= at) & (F.coalesce("valid_to", at) >= at)
    return ok & (F.col("public_at") <= at) if live else ok


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def reached(edges: DataFrame, seeds: DataFrame, hops: int, *, least: float = 0.0, live: bool = True) -> DataFrame:
    """seed, at, node, hop, confidence for all ``seeds`` (seed, at) at once: fewest hops, then the surest path."""
    walk = both_ways(edges)
    found = frontier = cut(seeds.select("seed", "at").distinct().select("seed", "at", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(1.0).alias("confidence")))
    for hop in range(1, hops + 1):
        step = frontier.withColumnRenamed("confidence", "so_far").join(walk, F.col("node") == F.col("src")).filter(_shown(F.col("at"), live))
        path = F.col("so_far") * F.col("confidence") * (HOP_DECAY if hop > 1 else 1.0)
        best = step.select("seed", "at", F.col("dst").alias("node"), path.alias("confidence")).filter(F.col("confidence") >= least).groupBy("seed", "at", "node").agg(F.max("confidence").alias("confidence"))
        frontier = cut(best.join(found.select("seed", "at", "node"), ["seed", "at", "node"], "left_anti").select("seed", "at", "node", F.lit(hop).alias("hop"), "confidence"))
        found = found.union(frontier)
    return found


def signatures(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, *, live: bool = True) -> DataFrame:
    """seed, at, items: the kinds of edges and nodes within ``hops`` of a seed, as it could be seen then."""
    near = reached(edges, seeds, hops - 1, live=live).select("seed", "at", "node")
    met = near.join(both_ways(edges), F.col("node") == F.col("src")).filter(_shown(F.col("at"), live))
    kinds = met.join(nodes.select(F.col("node").alias("dst"), "node_type"), "dst", "left").select("seed", "at", F.explode(F.array(F.concat(F.lit("edge:"), "edge_type"), F.concat(F.lit("node:"), "node_type"))).alias("item"))
    return kinds.filter("item IS NOT NULL").groupBy("seed", "at").agg(F.array_sort(F.collect_set("item")).alias("items"))  # at most the kinds there are


def features(rows: DataFrame, nodes: DataFrame, edges: DataFrame, *, hops: int = 2, least: float = 0.0, live: bool = True, cases: list[str] = ()) -> DataFrame:
    """Per row (symbol, minute) what its related securities did at that minute, as the graph was known then.

    ``rows`` has symbol, minute (timestamp_ntz), l2, equity_volume_z, option_volume_z and spread_z, one row for each symbol and minute.
    status: no_security_node, no_related_securities, no_peer_features, partial, full. With ``cases`` also how
    alike the row's surroundings (2 hops) and each visible case's (4 hops) are, by the kinds in them.
    """
    security = nodes.filter("node_type = 'security' AND symbol IS NOT NULL").select("symbol", F.col("node").alias("security")).distinct()
    several = security.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(rows.select("symbol").distinct(), "symbol", "left_semi").limit(1).collect()
    if several:
        raise Ambiguous(f"{several[0].symbol} names {several[0].n} securities")
    base = rows.join(security, "symbol", "left")
    seeds = base.filter("security IS NOT NULL").select(F.col("security").alias("seed"), F.col("minute").alias("at")).distinct()
    found = reached(edges, seeds, hops, least=least, live=live).filter("hop > 0").join(security.select(F.col("security").alias("node"), F.col("symbol").alias("peer")), "node")
    peers = found.join(rows.select(F.col("symbol").alias("peer"), F.col("minute").alias("at"), *UNUSUAL, F.lit(1).alias("_has")), ["peer", "at"], "left")
    odd, weight = F.col("l2") >= UNUSUAL["l2"], F.col("confidence") / F.greatest("hop", F.lit(1))
    high = lambda c: F.count_if(F.col(c) >= UNUSUAL[c])
    excess = F.when(F.col("l2").isNotNull(), F.greatest(F.col("l2") - UNUSUAL["l2"], F.lit(0.0)))
    agg = peers.groupBy("seed", "at").agg(
        F.count(F.lit(1)).alias("related"), F.count_if(F.col("hop") == 1).alias("direct"), F.count_if(F.col("hop") == 2).alias("second_hop"), F.sum(weight).alias("breadth"), F.max("confidence").alias("max_confidence"), F.avg("confidence").alias("mean_confidence"),
        F.count("_has").alias("peers"), F.count_if(odd).alias("unusual"), (F.count_if(odd) / F.nullif(F.count("l2"), F.lit(0))).alias("unusual_share"), high("equity_volume_z").alias("equity_volume_high"), high("option_volume_z").alias("option_volume_high"), high("spread_z").alias("spread_wide"),
        F.max("l2").alias("max_l2"), F.avg("l2").alias("mean_l2"), (F.sum(excess * weight) / F.nullif(F.sum(F.when(F.col("l2").isNotNull(), weight)), F.lit(0.0))).alias("peer_anomaly"), F.min(F.when(odd, F.col("hop"))).alias("min_unusual_hop"), F.avg(F.when(odd, F.col("hop"))).alias("mean_unusual_hop"))
    out = base.join(agg, (F.col("security") == F.col("seed")) & (F.col("minute") == F.col("at")), "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("related", "direct", "second_hop", "peers", "unusual", "equity_volume_high", "option_volume_high", "spread_wide")}
    status = F.when(F.col("security").isNull(), "no_security_node").when(F.col("related") == 0, "no_related_securities").when(F.col("peers") == 0, "no_peer_features").when(F.col("peers") < F.col("related"), "partial").otherwise("full")
    strength = F.when(base["l2"].isNotNull(), F.greatest(base["l2"] - UNUSUAL["l2"], F.lit(0.0)) * F.col("peer_anomaly"))
    out = out.withColumns(zero).withColumns({"breadth": F.when(F.col("security").isNotNull(), F.coalesce("breadth", F.lit(0.0))), "propagation": strength}).withColumn("status", status)
    kept = [c for c in out.columns if c not in ("seed", "at", *UNUSUAL)]
    if not cases:
        return out.select(*kept)
    own = signatures(nodes, edges, seeds, 2, live=live).select(F.col("seed").alias("security"), F.col("at").alias("minute"), F.col("items").alias("_own"))
    asked = seeds.select("at").distinct().select(F.explode(F.array(*(F.lit(c) for c in cases))).alias("seed"), "at")
    shown = signatures(nodes, edges, asked, 4, live=live).select(F.col("at").alias("minute"), F.col("items").alias("_case"))
    none = F.array().cast("array<string>")
    pairs = base.filter("security IS NOT NULL").select("security", "minute").distinct().join(own, ["security", "minute"], "left").join(shown, "minute").withColumn("_own", F.coalesce("_own", none))
    alike = F.size(F.array_intersect("_own", "_case")) / F.size(F.array_union("_own", "_case"))
    cases_seen = pairs.groupBy("security", "minute").agg(F.count(F.lit(1)).alias("visible_cases"), F.max(alike).alias("case_similarity_max"), F.avg(alike).alias("case_similarity_mean"))
    return out.select(*kept).join(cases_seen, ["security", "minute"], "left").withColumn("visible_cases", F.coalesce("visible_cases", F.lit(0)))
