"""Registered queries: admission under budgets, assignment, block intervals, calibration, identity, books of orders, filings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .catalogue import query, table
from .functions import ticks
from .operators import admission, assignment, chains, history, identity, modelling, orderbook, ownership, resampling
from .plans import coverage
from .sources import filings

#: Cents of open line value that a supplier's book may hold.
_BUDGET = 20_000_000


def _journal(spark, sf_dir):
    """Each line asks for room in its supplier's book at its order's date and leaves it when it ships."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber")))
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    base = lines.select(F.col("l_suppkey").cast("string").alias("book"), "o_orderdate", "l_shipdate", name.alias("decision_id"), number.alias("number"), cents.alias("risk"))
    step = lambda kind, at, seq: base.select("book", F.col(at).alias("received_at"), seq.alias("seq"), F.lit(kind).alias("kind"), "decision_id", F.col("o_orderdate").alias("decided_at"), F.col("l_shipdate").alias("exit_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"), "risk")
    none = lambda kind: F.lit(None).cast(kind)
    designs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string"), F.lit("1995-03-01").cast("timestamp_ntz"), F.lit(0).cast("long"), F.lit("DESIGN"), none("string"), none("timestamp_ntz"), none("timestamp_ntz"), none("timestamp_ntz"), none("long"))
    return step("ADMIT", "o_orderdate", F.col("number") * 2 + 1).union(step("EXIT", "l_shipdate", F.col("number") * 2)).union(designs)


@query(f"""WITH RECURSIVE base AS (SELECT CAST(l_suppkey AS VARCHAR) AS book, o_orderdate, l_shipdate, l_orderkey || '-' || l_linenumber AS id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS number, CAST(round(l_extendedprice * 100) AS BIGINT) AS risk FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ev AS (SELECT book, o_orderdate AS t, number * 2 + 1 AS seq, 'ADMIT' AS kind, id, o_orderdate AS decided, l_shipdate AS leave, risk FROM base UNION ALL SELECT book, l_shipdate, number * 2, 'EXIT', id, o_orderdate, l_shipdate, risk FROM base
        UNION ALL SELECT CAST(s_suppkey AS VARCHAR), TIMESTAMP '1995-03-01', 0, 'DESIGN', NULL, NULL, NULL, NULL FROM supplier),
    placed AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY t, seq, leave NULLS FIRST, risk NULLS FIRST) AS rn FROM ev),
    fold AS (SELECT book, CAST(0 AS BIGINT) AS rn, false AS registered, CAST([] AS STRUCT(id VARCHAR, leave TIMESTAMP, decided TIMESTAMP, risk BIGINT)[]) AS held, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS BIGINT) AS seq, '' AS kind, '' AS id, '' AS verdict, CAST(0 AS BIGINT) AS before FROM (SELECT DISTINCT book FROM ev)
        UNION ALL
        SELECT book, rn, registered OR kind = 'DESIGN', CASE verdict WHEN 'ADMITTED' THEN list_append(held, {{'id': id, 'leave': leave, 'decided': decided, 'risk': risk}}) WHEN 'CLOSED_NOW' THEN list_filter(held, lambda h: h.id <> id) ELSE held END,
            CASE WHEN verdict = 'CLOSED_NOW' THEN list_append(gone, id) ELSE gone END, seq, kind, id, verdict, before
        FROM (SELECT *, CASE WHEN kind = 'DESIGN' THEN CASE WHEN registered THEN 'REPLAY' ELSE 'REGISTERED' END
                WHEN kind = 'EXIT' THEN CASE WHEN list_contains(gone, id) THEN 'REPLAY' WHEN len(own) = 0 THEN 'UNKNOWN' WHEN own[1].leave <> t THEN 'LATE' ELSE 'CLOSED_NOW' END
                WHEN risk IS NULL OR risk <= 0 THEN 'INVALID' WHEN NOT registered THEN 'NO_DESIGN' WHEN leave < decided + INTERVAL 60 SECOND THEN 'BAD_EXIT' WHEN decided < TIMESTAMP '1995-03-01' THEN 'UNREGISTERED'
                WHEN list_contains(gone, id) THEN 'CLOSED' WHEN len(own) > 0 THEN CASE WHEN own[1].decided = decided AND own[1].leave = leave AND own[1].risk = risk THEN 'REPLAY' ELSE 'REWRITTEN' END
                WHEN before >= {_BUDGET} THEN 'EXHAUSTED' WHEN before + risk > {_BUDGET} THEN 'OVER_BUDGET' ELSE 'ADMITTED' END AS verdict
            FROM (SELECT f.registered, f.held, f.gone, p.*, list_filter(f.held, lambda h: h.id = p.id) AS own, coalesce(list_sum(list_transform(list_filter(f.held, lambda h: p.id IS NULL OR h.id <> p.id), lambda h: h.risk)), 0)::BIGINT AS before
                FROM fold f JOIN placed p ON p.book = f.book AND p.rn = f.rn + 1)))
    SELECT book, seq, kind, id AS decision_id, verdict, before AS open_risk FROM fold WHERE rn > 0""")
def admission_budget(spark, sf_dir):
    """Every request for room in a supplier's book and every exit, with its verdict and the open value before it."""
    return admission.admissions(_journal(spark, sf_dir), _BUDGET)


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS root, date_diff('day', o_orderdate, l_shipdate) AS dte FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) BETWEEN 7 AND 21),
    one AS (SELECT root, arg_min(dte, (abs(dte - 7), dte)) AS a FROM c GROUP BY root),
    two AS (SELECT c.root, any_value(a) AS a, arg_min(dte, (abs(dte - 14), dte)) AS b FROM c JOIN one ON c.root = one.root AND dte <> a GROUP BY c.root),
    three AS (SELECT c.root, arg_min(dte, (abs(dte - 21), dte)) AS d FROM c JOIN two ON c.root = two.root AND dte <> a AND dte <> b GROUP BY c.root)
    SELECT root, 1 AS turn, 7 AS target, CAST(a AS INT) AS dte FROM one UNION ALL SELECT root, 2, 14, CAST(b AS INT) FROM two UNION ALL SELECT root, 3, 21, CAST(d AS INT) FROM three""")
def catalog_assignment(spark, sf_dir):
    """For each supplier the lead times between 7 and 21 days that stand for one, two and three weeks, none of them twice."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    entries = lines.select(F.col("l_suppkey").alias("root"), F.datediff("l_shipdate", "o_orderdate").alias("dte")).filter("dte BETWEEN 7 AND 21")
    return assignment.nearest_without_replacement(entries, ["root"], "dte", [7, 14, 21])


def _intervals_sql(keys: str, source: str, block: str, value: str, repetitions: int, seed: int, low: str, high: str, least: int) -> str:
    """SQL of ``block_bootstrap`` over the same counter draws."""
    hexed = lambda s, n: f"CAST('0x' || substr(md5({s}), 1, {n}) AS BIGINT)"
    on = f"USING ({keys}, slot)" if keys else "USING (slot)"
    k, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    over = f"PARTITION BY {keys}" if keys else ""
    return f"""WITH v AS (SELECT {k}{block} AS block, CAST({value} AS DECIMAL(28,6)) AS v FROM {source} WHERE {value} IS NOT NULL),
    s AS (SELECT {k}block, sum(v) AS total, count(*) AS n FROM v GROUP BY {k}block),
    p AS (SELECT *, row_number() OVER ({over} ORDER BY {hexed("CAST(block AS VARCHAR)", 4)} % 64, md5(CAST(block AS VARCHAR)), block) - 1 AS slot, count(*) OVER ({over}) AS blocks FROM s),
    d AS (SELECT {k}rep, {hexed(f"'{seed}:' || rep || ':' || slot", 8)} % blocks AS slot FROM p, range({repetitions}) AS r(rep)),
    m AS (SELECT {k}rep, CAST(sum(total) AS DOUBLE) / sum(n) AS m FROM d JOIN p {on} GROUP BY {k}rep),
    e AS (SELECT {k}list_sort(list(m)) AS l, quantile_cont(m, 0.025) AS q1, quantile_cont(m, 0.975) AS q2 FROM m {group}),
    o AS (SELECT {k}count(*) AS blocks, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DOUBLE) / sum(n) AS mean FROM s {group})
    SELECT {k}blocks, n, round(mean, 6) AS mean, CASE WHEN blocks >= {least} THEN round({low}, 6) END AS low, CASE WHEN blocks >= {least} THEN round({high}, 6) END AS high FROM o {"JOIN e USING (" + keys + ")" if keys else ", e"}"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query(_intervals_sql("o_orderpriority", "orders", "isoyear(o_orderdate) * 100 + week(o_orderdate)", "o_totalprice / 1000 - 65", 1500, 7, "l[CAST(floor(0.025 * 1500) AS INT) + 1]", "l[CAST(floor(0.975 * 1500) AS INT) + 1]", 1))
def week_block_interval(spark, sf_dir):
    """Mean order value above a cost by priority, with an interval over whole ISO weeks."""
    week = F.expr("extract(YEAROFWEEK FROM o_orderdate) * 100 + extract(WEEK FROM o_orderdate)").cast("long")
    return _rounded(resampling.block_bootstrap(table(spark, sf_dir, "orders"), ["o_orderpriority"], week, F.col("o_totalprice") / 1000 - 65, repetitions=1500, seed=7))


@query(_intervals_sql("l_returnflag", "lineitem", "strftime(l_shipdate, '%Y-%m')", "10000 * (l_discount - l_tax) - 8", 1500, 102391, "l[CAST(floor(0.025 * 1499) AS INT) + 1]", "l[CAST(floor(0.975 * 1499) AS INT) + 1]", 5))
def month_block_interval(spark, sf_dir):
    """Mean discount over tax in basis points after costs by return flag, with an interval over whole months."""
    value = 10000 * (F.col("l_discount") - F.col("l_tax")) - 8
    return _rounded(resampling.block_bootstrap(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.date_format("l_shipdate", "yyyy-MM"), value, repetitions=1500, seed=102391, rule="rank_of_n_less_one", least_blocks=5))


@query(_intervals_sql("", "events", "isoyear(ts) * 100 + week(ts)", "value", 4000, 261117, "q1", "q2", 2))
def week_cluster_quantiles(spark, sf_dir):
    """Mean event value with interpolated quantiles over whole ISO weeks."""
    week = F.expr("extract(YEAROFWEEK FROM ts) * 100 + extract(WEEK FROM ts)").cast("long")
    return _rounded(resampling.block_bootstrap(table(spark, sf_dir, "events"), [], week, F.col("value"), repetitions=4000, seed=261117, rule="interpolated", least_blocks=2))


@query(_intervals_sql("event_type", "events", "strftime(ts, '%Y-%m-%d')", "value", 200, 7, "q1", "q2", 2))
def bootstrap_ci(spark, sf_dir):
    """Mean event value by type with an interval over whole days."""
    return _rounded(resampling.block_bootstrap(table(spark, sf_dir, "events"), ["event_type"], F.date_format("ts", "yyyy-MM-dd"), F.col("value"), repetitions=200, seed=7, rule="interpolated", least_blocks=2))


# --- identity -----------------------------------------------------------------------------------------

#: Claims by an order's priority come in these lanes; the last two of five priorities in none that counts.
_LANES = ["canonical", "staged"]
_CLAIMS = """ev AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS evidence_id, CAST(l_partkey AS VARCHAR) AS security, 'P' || l_partkey AS symbol, CAST(l_suppkey AS VARCHAR) AS market_identifier, CAST(o_orderdate AS DATE) AS valid_from, CAST(l_shipdate AS DATE) AS valid_through,
        CASE WHEN o_orderpriority < '3' THEN 'canonical' WHEN o_orderpriority < '4' THEN 'staged' ELSE 'lead' END AS lane, l_linestatus = 'O' AS usable FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    judged AS (SELECT ev.*, CASE WHEN count(*) OVER (PARTITION BY evidence_id) > 1 THEN 'id' WHEN NOT usable THEN 'use' WHEN lane = 'lead' THEN 'lane' WHEN p_partkey IS NULL THEN 'unknown' WHEN valid_through < valid_from THEN 'reversed' END AS reason
        FROM ev LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 45) ON security = CAST(p_partkey AS VARCHAR))"""


def _judged(spark, sf_dir):
    """Each line claims that its part came from its supplier between order and shipment."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))
    lane = F.when(F.col("o_orderpriority") < "3", "canonical").when(F.col("o_orderpriority") < "4", "staged").otherwise("lead")
    claims = lines.select(name.alias("evidence_id"), F.col("l_partkey").cast("string").alias("security"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_suppkey").cast("string").alias("market_identifier"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("valid_through"), lane.alias("lane"), F.lit("lines").alias("source_reference"), F.when(F.col("l_linestatus") == "O", "1").otherwise("0").alias("research_use_only"))
    known = table(spark, sf_dir, "part").filter("p_size <= 45").select(F.col("p_partkey").cast("string").alias("security"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))
    return identity.judged_claims(claims, known, _LANES)


@query(f"""WITH {_CLAIMS} SELECT lane, coalesce(reason, 'counts') AS reason, count(*) AS n, count(DISTINCT security) AS securities FROM judged GROUP BY ALL""")
def claim_reasons(spark, sf_dir):
    """Claims by lane and by the first rule that they break."""
    return _judged(spark, sf_dir).groupBy("lane", F.coalesce("reason", F.lit("counts")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("security").alias("securities"))


@query(f"""WITH {_CLAIMS}, flagged AS (SELECT security, market_identifier, lane, valid_from, valid_through, max(valid_through) OVER (PARTITION BY security, market_identifier, lane ORDER BY valid_from, valid_through ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM judged WHERE reason IS NULL),
    islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR valid_from > reach + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY security, market_identifier, lane ORDER BY valid_from, valid_through) AS island FROM flagged),
    merged AS (SELECT security, market_identifier, lane, min(valid_from) AS valid_from, max(valid_through) AS valid_through FROM islands GROUP BY security, market_identifier, lane, island),
    asked AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS security, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem WHERE l_returnflag = 'R'),
    met AS (SELECT a.security, trade_date, count(m.security) AS claims, min(market_identifier) AS lo, max(market_identifier) AS hi, min(list_position(['canonical', 'staged'], lane)) AS best FROM asked a LEFT JOIN merged m ON m.security = a.security AND trade_date BETWEEN valid_from AND valid_through GROUP BY ALL)
    SELECT security, trade_date, claims, CASE WHEN claims = 0 THEN 'UNCOVERED' WHEN lo = hi THEN 'VERIFIED' ELSE 'CONFLICT' END AS status, CASE WHEN lo = hi THEN lo END AS market_identifier, CASE WHEN claims > 0 THEN ['canonical', 'staged'][best] END AS lane FROM met""")
def identity_intervals(spark, sf_dir):
    """For each day that a returned part shipped on: which supplier the claims of that day name, if they agree."""
    claims = identity.merged_claims(_judged(spark, sf_dir).filter("reason IS NULL"), ["security", "market_identifier", "lane"])
    asked = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("security"), F.to_date("l_shipdate").alias("trade_date"))
    return identity.resolved(asked, claims, keys=["security"], on="trade_date", identifier="market_identifier", precedence=_LANES)


@query("""WITH p AS (SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09),
    a AS (SELECT CAST(part AS VARCHAR) AS value, count(DISTINCT supplier) AS partners FROM p GROUP BY part), b AS (SELECT CAST(supplier AS VARCHAR) AS value, count(DISTINCT part) AS partners FROM p GROUP BY supplier)
    SELECT 'part' AS side, value, partners FROM a WHERE partners > 1 UNION ALL SELECT 'supplier', value, partners FROM b WHERE partners > 1""")
def mapping_collisions(spark, sf_dir):
    """Parts with several suppliers and suppliers with several parts among the largest lines of highest discount."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49 AND l_discount >= 0.09")
    return identity.collisions(lines.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")), "part", "supplier")


@query("""WITH hits AS (SELECT a.o_orderkey, b.o_orderdate AS t FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 60 DAY AND b.o_orderdate + INTERVAL 2 DAY <= a.o_orderdate + INTERVAL 58 DAY AND b.o_orderstatus <> 'P'),
    c AS (SELECT o_orderkey, count(DISTINCT t) AS n, min(t) AS first, list_sort(list(DISTINCT t))[1:10] AS times FROM hits GROUP BY ALL)
    SELECT o.o_orderkey, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN first END AS matched_ts, CASE WHEN n IS NULL THEN 'missing_candidate' WHEN n > 1 THEN 'ambiguous' END AS reason, CASE WHEN n > 1 THEN array_to_string(list_transform(times, lambda t: strftime(t, '%Y-%m-%d')), ';') END AS times FROM orders o LEFT JOIN c USING (o_orderkey)""")
def one_match_ahead(spark, sf_dir):
    """For each order its customer's only later one within 60 days that was published two days before their end."""
    o = table(spark, sf_dir, "orders")
    days = lambda n: F.make_dt_interval(days=F.lit(n))
    later = o.filter("o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderdate").alias("t"), (F.col("o_orderdate") + days(2)).alias("published"))
    asked = o.withColumn("cutoff", F.col("o_orderdate") + days(58))
    out = identity.one_match_ahead(asked, later, keys=["o_custkey"], event_id="o_orderkey", at="o_orderdate", candidate_at="t", days=60, published="published", cutoff="cutoff")
    return out.withColumn("times", F.array_join(F.transform("times", lambda t: F.date_format(t, "yyyy-MM-dd")), ";"))


# --- order book ---------------------------------------------------------------------------------------

_MESSAGES = """line AS (SELECT *, (date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) * 100000000 + l_orderkey) * 1000000 + l_linenumber * 100000 + (l_partkey % 10000) * 10 AS base FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    msg AS (SELECT o_custkey AS source, (date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) * 100000000 + o_orderkey) * 1000000 AS row, o_orderdate AS ts, 'ADD_ORDER' AS type, CAST(o_orderkey AS VARCHAR) AS order_ref, '' AS new_ref, CASE WHEN o_orderpriority < '3' THEN 'BUY' ELSE 'S' END AS side, 'c' || o_custkey AS symbol, CAST(floor(o_totalprice / 1000) + 1 AS BIGINT) AS shares, o_totalprice AS price, '' AS match FROM orders
        UNION ALL SELECT o_custkey, base + 1, l_shipdate, 'E', CASE WHEN l_linestatus = 'F' THEN '' ELSE 'R' END || l_orderkey, '', NULL, NULL, CAST(l_quantity AS BIGINT), CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END, l_orderkey || '-' || l_linenumber FROM line WHERE l_linenumber > 1
        UNION ALL SELECT o_custkey, base + 2, l_shipdate, 'B', '', '', NULL, NULL, NULL, NULL, l_orderkey || '-' || l_linenumber FROM line WHERE l_returnflag = 'R' AND l_linenumber > 1
        UNION ALL SELECT o_custkey, base + 3, l_shipdate, 'REPLACE', CASE WHEN l_linestatus = 'F' THEN '' ELSE 'R' END || l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'R' ELSE '' END || l_orderkey, NULL, NULL, NULL, CASE WHEN l_returnflag = 'A' THEN l_extendedprice END, '' FROM line WHERE l_linenumber = 1
        UNION ALL SELECT o_custkey, base + 4, l_shipdate, 'D', CASE WHEN l_linestatus = 'F' THEN '' ELSE 'R' END || l_orderkey, '', NULL, NULL, NULL, NULL, '' FROM line WHERE l_linenumber = 7 AND l_returnflag = 'N')"""


@query(f"""WITH RECURSIVE {_MESSAGES}, placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row) AS rn FROM msg),
    fold AS (SELECT source, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(ref VARCHAR, side VARCHAR, symbol VARCHAR, price DOUBLE)[]) AS held, CAST([] AS STRUCT(match VARCHAR, row BIGINT)[]) AS run, CAST(NULL AS BIGINT) AS broken, CAST(NULL AS STRUCT(ref VARCHAR, side VARCHAR, symbol VARCHAR, price DOUBLE)) AS own FROM (SELECT DISTINCT source FROM msg)
        UNION ALL
        SELECT source, rn, CASE WHEN type = 'ADD_ORDER' THEN list_append(list_filter(held, lambda h: h.ref <> order_ref), {{'ref': order_ref, 'side': side[1], 'symbol': upper(symbol), 'price': price}}) WHEN type = 'D' THEN list_filter(held, lambda h: h.ref <> order_ref)
                WHEN type = 'REPLACE' AND own IS NOT NULL THEN list_append(list_filter(held, lambda h: h.ref <> order_ref AND h.ref <> new_ref), {{'ref': new_ref, 'side': own.side, 'symbol': own.symbol, 'price': coalesce(price, own.price)}}) ELSE held END,
            CASE WHEN type = 'E' AND own IS NOT NULL THEN list_append(list_filter(run, lambda r: r.match <> m), {{'match': m, 'row': row}}) WHEN type = 'B' THEN list_filter(run, lambda r: r.match <> m) ELSE run END,
            CASE WHEN type = 'B' THEN list_filter(run, lambda r: r.match = m)[1].row END, own
        FROM (SELECT f.held, f.run, p.source, p.rn, p.row, p.type, p.order_ref, p.new_ref, p.side, p.symbol, p.price, p.match AS m, list_filter(f.held, lambda h: h.ref = p.order_ref)[1] AS own FROM fold f JOIN placed p ON p.source = f.source AND p.rn = f.rn + 1))
    SELECT p.source, p.row, p.ts, own.symbol AS symbol, p.order_ref, p.match AS match_number, own.side AS resting_side, CASE WHEN own.side = 'S' THEN 'B' ELSE 'S' END AS aggressor_side, p.shares AS executed_shares, round(coalesce(p.price, own.price), 6) AS execution_price, 1 AS printable
    FROM fold f JOIN placed p ON p.source = f.source AND p.rn = f.rn WHERE p.type = 'E' AND own IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fold b WHERE b.source = p.source AND b.broken = p.row)""")
def book_messages(spark, sf_dir):
    """Executions signed by the side that rested, over orders that were replaced and deleted, without the broken ones."""
    o, none = table(spark, sf_dir, "orders"), lambda kind: F.lit(None).cast(kind)
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("long") * 100_000_000
    line = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("base", (day("l_shipdate") + F.col("l_orderkey")) * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey") % 10_000 * 10)
    key, first = F.col("l_orderkey").cast("string"), F.col("l_linestatus") == "F"
    ref, other = F.when(first, key).otherwise(F.concat(F.lit("R"), key)), F.when(first, F.concat(F.lit("R"), key)).otherwise(key)
    match, blank = F.concat_ws("-", key, F.col("l_linenumber").cast("string")), F.lit("")

    def step(rows, n, t, ref=blank, new=blank, shares=None, price=None, match=blank):
        return rows.select(F.col("o_custkey").alias("source"), (F.col("base") + n).alias("row"), F.col("l_shipdate").alias("ts"), F.lit(t).alias("type"), ref.alias("order_ref"), new.alias("new_ref"), none("string").alias("side"), none("string").alias("symbol"), (none("long") if shares is None else shares).alias("shares"), (none("double") if price is None else price).alias("price"), match.alias("match_number"))

    added = o.select(F.col("o_custkey"), (day("o_orderdate") + F.col("o_orderkey")) * 1_000_000, "o_orderdate", F.lit("ADD_ORDER"), F.col("o_orderkey").cast("string"), blank, F.when(F.col("o_orderpriority") < "3", "BUY").otherwise("S"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), (F.floor(F.col("o_totalprice") / 1000) + 1).cast("long"), "o_totalprice", blank)
    late = line.filter("l_linenumber > 1")
    run = step(late, 1, "E", ref, shares=F.col("l_quantity").cast("long"), price=F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")), match=match)
    rest = step(late.filter("l_returnflag = 'R'"), 2, "B", match=match).union(step(line.filter("l_linenumber = 1"), 3, "REPLACE", ref, other, price=F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")))).union(step(line.filter("l_linenumber = 7 AND l_returnflag = 'N'"), 4, "D", ref))
    messages = run.union(rest).union(added).withColumn("printable", blank)
    return orderbook.executions(messages).withColumn("execution_price", F.round("execution_price", 6))


# --- models -------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT o_custkey AS g, CAST('0x' || substr(md5('17:' || o_custkey), 1, 8) AS BIGINT) % 4 AS fold, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
    per AS (SELECT g, fold, count(*) AS n, sum(label) AS pos FROM f GROUP BY ALL), t AS (SELECT sum(n) AS rows, count(*) AS groups FROM per)
    SELECT CAST(fold AS INT) AS fold, CAST(any_value(rows) - sum(n) AS BIGINT) AS train_rows, CAST(sum(n) AS BIGINT) AS validation_rows, any_value(groups) - count(*) AS train_groups, count(*) AS validation_groups, 0 AS group_overlap, CAST(sum(pos) AS BIGINT) AS validation_positives, CAST(sum(n) - sum(pos) AS BIGINT) AS validation_negatives FROM per, t GROUP BY fold""")
def oof_fold_audit(spark, sf_dir):
    """Folds of customers: rows, groups and labels on either side, and groups in two folds (none)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("long").alias("label")).withColumn("fold", modelling.fold_of(F.col("o_custkey"), 4, 17))
    return modelling.fold_audit(o, "o_custkey", "label", 4)


@query("""WITH RECURSIVE d AS (SELECT least(1.0, n_chars / 5000.0)::DOUBLE AS s, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT s, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY s),
    it AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
        UNION ALL SELECT k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
        FROM (SELECT k, a, b, sum(pos - n * p) AS g0, sum((pos - n * p) * s) - 1e-6 * b AS g1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * s) AS h01, sum(n * p * (1 - p) * s * s) + 1e-6 AS h11
            FROM (SELECT k, a, b, s, pos, n, 1 / (1 + exp(-(a + b * s))) AS p FROM it, c WHERE k < 25) GROUP BY k, a, b))
    SELECT round(a, 6) AS intercept, round(b, 6) AS slope, round(avg((s - y) * (s - y)), 6) AS brier_before, round(avg((1 / (1 + exp(-(a + b * s))) - y) ** 2), 6) AS brier_after, count(*) AS n FROM d, it WHERE k = 25 GROUP BY a, b""")
def platt_calibration(spark, sf_dir):
    """A logistic curve from a document's length to its quality, and the Brier score before and after."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("s"), F.col("quality").cast("double").alias("y"))
    a, b = modelling.platt(d, "s", "y")
    p = modelling.calibrated(F.col("s"), (a, b))
    gap = lambda x: F.round(F.avg((x - F.col("y")) ** 2), 6)
    return d.agg(gap(F.col("s")).alias("brier_before"), gap(p).alias("brier_after"), F.count(F.lit(1)).alias("n")).select(F.lit(round(a, 6)).alias("intercept"), F.lit(round(b, 6)).alias("slope"), "brier_before", "brier_after", "n")


@query()
def grouped_oof_metrics(spark, sf_dir):
    """Whether an order is large, from its lines and date, by models that saw no order of its customer; quality of each score."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"), F.avg("l_discount").alias("discount"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + F.coalesce("quantity", F.lit(0)) * 1000 > 300_000).cast("long").alias("label"), "quantity", "lines", "discount", F.dayofyear("o_orderdate").alias("day"))
    features = ["quantity", "lines", "discount", "day"]
    kept = ["o_custkey", "label", "_label", "fold", *features, *(f"_{f}_missing" for f in features)]
    prepared = modelling.matrix(o, features, "label", "o_custkey", folds=4, seed=17).select(*kept).persist()  # else every fit joins and sums the tables anew
    try:
        oof = modelling.out_of_fold(prepared, features, "o_custkey", folds=4).select("label", "elastic", "boosted", "raw").persist()
        curve = modelling.platt(oof, "raw", "label")
        scores = {"elastic": F.col("elastic"), "boosted": F.col("boosted"), "blend": F.col("raw"), "calibrated": modelling.calibrated(F.col("raw"), curve)}
        rows = [{"model": name, **modelling.evaluated(oof.select(c.alias("score"), "label"), 0.5)} for name, c in scores.items()]
        oof.unpersist()
    finally:
        prepared.unpersist()
    return spark.createDataFrame(rows, "model string, n long, auc double, average_precision double, brier double, false_positive_rate double, recall double")


# --- graph at event times, filings --------------------------------------------------------------------


@query("""WITH l AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS event_id FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.09), first AS (SELECT l_suppkey, l_partkey, min(l_shipdate) AS seen FROM l GROUP BY ALL),
    r AS (SELECT l_partkey AS part, l_shipdate AS minute, max(l_extendedprice) / 30000 AS l2, max(l_tax) * 40 AS spread_z FROM l GROUP BY ALL),
    rel AS (SELECT DISTINCT r.part, r.minute, b.l_partkey AS peer FROM r JOIN first a ON a.l_partkey = r.part AND a.seen <= r.minute JOIN first b ON b.l_suppkey = a.l_suppkey AND b.l_partkey <> r.part AND b.seen <= r.minute),
    p AS (SELECT rel.part, rel.minute, count(*) AS related, count(q.part) AS peers, count(*) FILTER (q.l2 >= 2) AS unusual, count(*) FILTER (q.spread_z >= 1.5) AS spread_wide, max(q.l2) AS max_l2, avg(q.l2) AS mean_l2, sum(greatest(q.l2 - 2, 0)) / nullif(count(q.l2), 0) AS anomaly FROM rel LEFT JOIN r q ON q.part = rel.peer AND q.minute = rel.minute GROUP BY ALL)
    SELECT r.part, r.minute, coalesce(related, 0) AS related, coalesce(related, 0) AS second_hop, round(coalesce(related, 0) * 0.9 * 0.9 * 0.92 / 2, 6) AS breadth, CASE WHEN related > 0 THEN CAST(round(0.9 * 0.9 * 0.92, 6) AS DOUBLE) END AS mean_confidence, coalesce(peers, 0) AS peers, coalesce(unusual, 0) AS unusual, coalesce(spread_wide, 0) AS spread_wide,
        round(max_l2, 6) AS max_l2, round(mean_l2, 6) AS mean_l2, round(greatest(r.l2 - 2, 0) * anomaly, 6) AS propagation, CASE WHEN related IS NULL THEN 'no_related_securities' WHEN peers = 0 THEN 'no_peer_features' WHEN peers < related THEN 'partial' ELSE 'full' END AS status FROM r LEFT JOIN p USING (part, minute)""")
def graph_event_features(spark, sf_dir):
    """For the largest lines of highest discount: what parts of the same suppliers, known as such by then, did on that day."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49 AND l_discount >= 0.09")
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))
    events = lines.select(name.alias("event_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_partkey").alias("security"), F.col("l_suppkey").alias("issuer"), F.col("l_shipdate").alias("at"))
    nodes, edges = history.build(events, "CASE:1", "2003-01-01")
    rows = lines.groupBy("l_partkey", "l_shipdate").agg((F.max("l_extendedprice") / 30000).alias("l2"), (F.max("l_tax") * 40).alias("spread_z"))
    none = F.lit(None).cast("double")
    rows = rows.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), F.col("l_shipdate").alias("minute"), "l2", none.alias("equity_volume_z"), none.alias("option_volume_z"), "spread_z")
    f = history.features(rows, nodes, edges)
    r = lambda *names: [F.round(n, 6).alias(n) for n in names]
    return f.select(F.substring("symbol", 2, 20).cast("long").alias("part"), "minute", "related", "second_hop", *r("breadth", "mean_confidence"), "peers", "unusual", "spread_wide", *r("max_l2", "mean_l2", "propagation"), "status")


@query("""WITH o AS (SELECT o.*, c.c_acctbal < 0 AS broken, c.c_nationkey FROM orders o JOIN customer c ON o_custkey = c_custkey), f AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus, broken, c_nationkey, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS shipped FROM o),
    j AS (SELECT *, CASE WHEN o_orderstatus = 'P' AND o_totalprice <> floor(o_totalprice) THEN 'value' WHEN shipped IS NULL OR shipped < o_orderdate THEN 'dates' WHEN o_orderdate >= TIMESTAMP '2001-01-01' OR c_nationkey = 3 THEN 'no_symbol' END AS reason FROM f WHERE NOT broken)
    SELECT reason, CASE WHEN reason IS NULL THEN CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'OLD' ELSE 'NEW' END || o_custkey END AS historical_symbol, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_fact FROM j WHERE reason IS NULL GROUP BY ALL
    UNION ALL SELECT reason, NULL, count(*), min(CAST(o_orderdate AS DATE)) FILTER (reason = 'no_symbol') FROM j WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'container', NULL, count(DISTINCT (o_custkey, o_orderkey % 64)), NULL FROM f WHERE broken HAVING count(*) > 0""")
def share_fact_files(spark, sf_dir):
    """Customers' orders as nested facts files (64 of a customer at most), some with a list where an object belongs; facts by the name of their time, rejects by reason."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    # customers come last, so that their orders lie together for the files
    o = table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    value = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(F.floor("o_totalprice")).cast("decimal(18,2)")
    fact = F.to_json(F.struct(day("o_orderdate").alias("end"), day("shipped").alias("filed"), value.alias("val"), F.col("o_orderkey").cast("string").alias("accn")))
    body = F.concat_ws(",", F.collect_list(fact))
    inner = F.concat(F.lit('{"dei":{"EntityCommonStockSharesOutstanding":{"units":{"shares":['), body, F.lit("]}}}}"))
    files = o.groupBy("o_custkey", F.col("o_orderkey") % 64).agg(F.when(F.first("c_acctbal") < 0, F.lit("[]")).otherwise(inner).alias("facts"))
    files = files.select(F.col("o_custkey").cast("string").alias("path"), F.concat(F.lit('{"cik":'), F.col("o_custkey").cast("string"), F.lit(',"facts":'), "facts", F.lit("}")).alias("text"))
    spans = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, a, b in (("OLD", "", "1997-12-31"), ("NEW", "1998-01-01", "2000-12-31"))))
    symbols = table(spark, sf_dir, "customer").filter("c_nationkey <> 3").select(F.col("c_custkey").cast("string").alias("cik"), F.explode(spans).alias("s")).select("cik", F.concat("s.p", "cik").alias("historical_symbol"), F.col("s.a").alias("effective_from"), F.col("s.b").alias("effective_to"))
    out = filings.share_facts(files, symbols)
    return out.groupBy("reason", "historical_symbol").agg(F.count(F.lit(1)).alias("n"), F.min("fact_date").alias("first_fact")).withColumn("first_fact", F.when(F.coalesce(F.col("reason").isin("value", "dates"), F.lit(False)), None).otherwise(F.col("first_fact")))


# --- vendor rows, chains, required histories ----------------------------------------------------------


@query("""WITH raw AS (SELECT CASE l_linestatus WHEN 'F' THEN 'Trade' ELSE 'Quote' END AS type, CASE WHEN l_quantity > 48 THEN '' ELSE CAST(l_extendedprice AS VARCHAR) END AS price, CAST(l_quantity - 3 AS VARCHAR) AS volume,
        CASE l_returnflag WHEN 'R' THEN 'T [GV4_TEXT];X6[LSTSALCOND]' WHEN 'A' THEN ' ODD[IRGCOND] ;4[LSTSALCOND]' ELSE CASE WHEN l_tax > 0.05 THEN 'O [CTS_QUAL]' ELSE '' END END AS q, CASE WHEN l_tax = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day, strftime(l_shipdate, '%-d-%b-%Y') AS vendor_day, '1' || l_linenumber || ':00:00.5' AS clock, CAST(l_discount * 100 - 5 AS VARCHAR) AS hours FROM lineitem),
    p AS (SELECT *, list_transform(list_filter(list_transform(string_split(q, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: x) AS pieces, TRY_CAST(nullif(price, '') AS DOUBLE) AS pr, TRY_CAST(volume AS DOUBLE) AS v, CAST(CASE WHEN trim(day) = '' THEN strptime(vendor_day, '%d-%b-%Y') ELSE CAST(day AS TIMESTAMP) END AS TIMESTAMP) AS d FROM raw),
    h AS (SELECT *, list_transform(list_filter(pieces, lambda x: ends_with(x, '_TEXT]') OR ends_with(x, '[LSTSALCOND]')), lambda x: CASE WHEN ends_with(x, '_TEXT]') THEN left(x, length(x) - 10) ELSE left(x, length(x) - 12) END) AS heads,
        d + to_microseconds(CAST(split_part(clock, ':', 1) AS BIGINT) * 3600000000 + 500000) + to_microseconds(CAST(round(CAST(hours AS DOUBLE) * 3600000000) AS BIGINT)) AS told FROM p),
    f AS (SELECT CASE WHEN type <> 'Trade' THEN 'type' WHEN pr IS NULL OR v IS NULL OR pr <= 0 OR v <= 0 THEN 'economics' WHEN told IS NULL THEN 'timestamp' END AS reason, told, pr * v AS notional, len(list_filter(heads, lambda x: contains(x, 'T'))) > 0 AS form_t, len(list_filter(heads, lambda x: contains(x, '6'))) > 0 AS closing, list_contains(pieces, 'O [CTS_QUAL]') OR len(list_filter(heads, lambda x: contains(x, 'O'))) > 0 AS opening,
        list_contains(pieces, 'ODD[IRGCOND]') OR list_contains(pieces, 'ODT[IRGCOND]') AS odd_lot, len(list_filter(heads, lambda x: contains(x, 'N') OR contains(x, 'P') OR contains(x, '4') OR contains(x, 'Z'))) = 0 AS regular FROM h)
    SELECT coalesce(reason, 'good') AS reason, form_t, opening, closing, odd_lot, regular, count(*) AS n, min(told) FILTER (reason IS NULL) AS earliest, max(told) FILTER (reason IS NULL) AS latest, round(sum(notional) FILTER (reason IS NULL), 2) AS notional FROM f GROUP BY ALL""")
def vendor_trades(spark, sf_dir):
    """Lines as a vendor's trade rows, all texts: typed, flagged by their qualifiers, and rejected by reason."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    text = lambda c: F.col(c).cast("string")
    qualifiers = F.when(F.col("l_returnflag") == "R", "T [GV4_TEXT];X6[LSTSALCOND]").when(F.col("l_returnflag") == "A", " ODD[IRGCOND] ;4[LSTSALCOND]").when(F.col("l_tax") > 0.05, "O [CTS_QUAL]").otherwise("")
    rows = l.select(
        F.concat(F.lit("P"), text("l_partkey"), F.lit(".N")).alias("#RIC"), F.when(F.col("l_linestatus") == "F", "Trade").otherwise("Quote").alias("Type"), F.when(F.col("l_quantity") > 48, "").otherwise(text("l_extendedprice")).alias("Price"), (F.col("l_quantity") - 3).cast("string").alias("Volume"), qualifiers.alias("Qualifiers"),
        F.when(F.col("l_tax") == 0, "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Trd/Qte Date"), F.date_format("l_shipdate", "d-MMM-yyyy").alias("Date[G]"), F.concat(F.lit("1"), text("l_linenumber"), F.lit(":00:00.5")).alias("Exch Time"), (F.col("l_discount") * 100 - 5).cast("string").alias("GMT Offset"))
    t = ticks.trades(rows)
    good = lambda c: F.when(F.col("reason").isNull(), c)
    flags = {n: F.col(f"flags.{n}") for n in ("form_t", "opening", "closing", "odd_lot")}
    regular = ticks.regular({n: F.col(f"flags.{n}") for n in ticks.IRREGULAR})
    return t.groupBy(F.coalesce("reason", F.lit("good")).alias("reason"), *(c.alias(n) for n, c in flags.items()), regular.alias("regular")).agg(F.count(F.lit(1)).alias("n"), F.min(good(F.col("timestamp"))).alias("earliest"), F.max(good(F.col("timestamp"))).alias("latest"), F.round(F.sum(good(F.col("price") * F.col("size"))), 2).alias("notional"))


@query("""WITH l AS (SELECT CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'put' ELSE CASE WHEN l_tax < 0.02 THEN NULL ELSE 'call' END END AS side, p_size <= 45 AS own, CASE WHEN l_linenumber = 7 THEN 10 ELSE 100 END AS lot, p_retailprice AS strike, l_quantity - 2 AS bid, l_quantity - 2 + l_tax * 100 AS ask, l_extendedprice / 300 AS interest, epoch(l_shipdate) AS quoted, epoch(l_shipdate) + l_discount * 10000 AS now, o_totalprice / 260 AS spot, l_discount * 5 AS iv,
        strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN l_linestatus = 'F' THEN '+00:00' ELSE '' END AS updated FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    a AS (SELECT *, CASE WHEN quoted >= 1e9 AND quoted < 1e11 THEN CASE WHEN quoted <= now + 60 THEN round(greatest(0, now - quoted), 1) END END AS age FROM l),
    s AS (SELECT *, CASE WHEN side IS NULL THEN 'no_option' WHEN NOT (own AND lot = 100) THEN 'adjusted' WHEN NOT strike > 0 THEN 'strike' WHEN NOT (bid > 0 AND ask > 0) THEN 'nonpositive' WHEN ask < bid THEN 'crossed' WHEN age IS NULL OR age > 120 THEN 'stale' WHEN interest < 100 THEN 'interest' WHEN (ask - bid) / ((ask + bid) / 2) > 0.25 THEN 'wide' WHEN CASE side WHEN 'call' THEN strike <= spot ELSE strike >= spot END THEN 'in_the_money' ELSE 'liquid' END AS stage,
        CASE WHEN age IS NULL THEN 'age_missing_or_unparseable' WHEN age <= 120 THEN 'age_at_most_120s' WHEN age <= 300 THEN 'age_121_to_300s' WHEN age <= 900 THEN 'age_301_to_900s' ELSE 'age_over_900s' END AS age_bin,
        CASE WHEN side IS NOT NULL AND own AND lot = 100 AND abs(strike - spot) / spot <= 0.03 THEN CASE WHEN NOT (bid > 0 AND ask >= bid AND (ask - bid) / ((ask + bid) / 2) <= 0.25 AND coalesce(age, 1e9) <= 120 AND interest >= 100) THEN 'quote' WHEN NOT (iv > 0 AND iv <= 3) THEN 'iv' WHEN updated NOT LIKE '%+00:00' THEN 'naive' WHEN now - quoted > 5400 THEN 'stale' ELSE 'fresh' END END AS greeks FROM a)
    SELECT coalesce(side, 'none') AS side, stage, age_bin, coalesce(greeks, 'far') AS greeks, count(*) AS legs FROM s GROUP BY ALL""")
def chain_funnel(spark, sf_dir):
    """Lines as legs of option chains: each by the first rule that it fails, its age, and what its volatility lacks near the money."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    quoted = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double")
    legs = j.select(
        F.when(F.col("l_returnflag") == "R", "call").when(F.col("l_returnflag") == "A", "put").when(F.col("l_tax") >= 0.02, "call").alias("side"), (F.col("p_size") <= 45).alias("own"), F.when(F.col("l_linenumber") == 7, 10).otherwise(100).alias("lot"), F.col("p_retailprice").alias("strike"), (F.col("l_quantity") - 2).alias("bid"),
        (F.col("l_quantity") - 2 + F.col("l_tax") * 100).alias("ask"), (F.col("l_extendedprice") / 300).alias("interest"), quoted.alias("quoted"), (quoted + F.col("l_discount") * 10000).alias("now"), (F.col("o_totalprice") / 260).alias("spot"), (F.col("l_discount") * 5).alias("iv"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("l_linestatus") == "F", "+00:00").otherwise("")).alias("updated"))
    legs = legs.withColumn("age", chains.age(F.col("quoted"), F.col("quoted"), F.col("now")))
    leg = [F.col(c) for c in ("side", "own", "lot", "strike", "bid", "ask", "interest", "age", "spot")]
    near = chains.greeks_stage(*leg, F.col("iv"), F.col("updated"), F.col("now"))
    return legs.groupBy(F.coalesce("side", F.lit("none")).alias("side"), chains.stage(*leg).alias("stage"), chains.age_bin(F.col("age")).alias("age_bin"), F.coalesce(near, F.lit("far")).alias("greeks")).agg(F.count(F.lit(1)).alias("legs"))


_CLOSED, _SHORT = [date(2023, 11, 23), date(2023, 12, 25), date(2024, 1, 1), date(2024, 1, 15), date(2024, 2, 19)], [date(2023, 11, 24)]


@query("""WITH cal AS (SELECT day, day = DATE '2023-11-24' AS early, row_number() OVER (ORDER BY day) AS n, sum(CASE WHEN day = DATE '2023-11-24' THEN 0 ELSE 1 END) OVER (ORDER BY day) AS f FROM (SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-02-28', INTERVAL 1 DAY) AS g(d)) WHERE isodow(day) <= 5 AND day NOT IN (DATE '2023-11-23', DATE '2023-12-25', DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19')),
    c AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS event_date, date_trunc('minute', ts) AS m FROM events WHERE CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00'),
    g AS (SELECT c.*, n, f, CAST(m + INTERVAL 1 MINUTE AS TIME) > TIME '13:00:00' AS long, strftime(m, '%H:%M') AS minute FROM c JOIN cal ON event_date = day WHERE n - 1 >= 30 AND f - 1 >= 21),
    x AS (SELECT symbol, event_date AS trade_date, event_date, 'event_point' AS role, unnest([minute, strftime(m - INTERVAL 1 MINUTE, '%H:%M')]) AS minute FROM g
        UNION ALL SELECT symbol, b.day, event_date, 'normalization_baseline', minute FROM g JOIN cal b ON NOT long AND b.n BETWEEN g.n - 21 AND g.n - 1
        UNION ALL SELECT symbol, b.day, event_date, 'normalization_baseline', minute FROM g JOIN cal b ON long AND NOT b.early AND b.f BETWEEN g.f - 21 AND g.f - 1
        UNION ALL SELECT symbol, b.day, event_date, 'daily_close_history', NULL FROM g JOIN cal b ON b.n BETWEEN g.n - 30 AND g.n - 1),
    r AS (SELECT symbol, trade_date, array_to_string(list_sort(list(DISTINCT role)), ';') AS roles, count(DISTINCT event_date) AS event_dates, coalesce(array_to_string(list_sort(list(DISTINCT minute) FILTER (role = 'event_point')), ';'), '') AS event_minutes, coalesce(array_to_string(list_sort(list(DISTINCT minute) FILTER (role = 'normalization_baseline')), ';'), '') AS normal_minutes FROM x GROUP BY ALL)
    SELECT r.*, CASE WHEN early THEN '12:59' ELSE '15:59' END AS close_minute, roles <> 'daily_close_history' AS needs_quotes_and_shares FROM r JOIN cal ON trade_date = day""")
def history_needs(spark, sf_dir):
    """What market data the events of each user call for, date by date: their own minutes, baselines and closes."""
    cal = coverage.sessions(spark, date(2023, 11, 1), date(2024, 2, 28), holidays=_CLOSED, early=_SHORT)
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("ts").alias("cutoff"))
    return coverage.history_requirements(cal, events, normal=21, closes=30)[0]


@query("""WITH l AS (SELECT l_partkey AS part, l_suppkey AS manager, last_day(date_trunc('quarter', CAST(l_shipdate AS DATE)) + INTERVAL 2 MONTH) AS period, l_linestatus AS kind, CAST(l_quantity AS BIGINT) AS q, CAST(l_shipdate AS DATE) AS shipped, l_returnflag FROM lineitem),
    sub AS (SELECT DISTINCT manager, period, manager || '-' || period || '-' || kind AS accession, period + CASE kind WHEN 'F' THEN 20 ELSE 45 END AS filed FROM l), sp AS (SELECT *, lead(filed) OVER (PARTITION BY manager, period ORDER BY filed, accession) AS until FROM sub),
    h AS (SELECT manager || '-' || period || '-' || kind AS accession, part, sum(q) AS q FROM l GROUP BY ALL), t AS (SELECT DISTINCT part, shipped AS d FROM l WHERE l_returnflag = 'R'),
    n AS (SELECT t.*, CASE WHEN p_size <= 40 AND d >= DATE '1995-06-01' THEN 'C' || part END AS cusip, p_size FROM t JOIN part ON part = p_partkey),
    s AS (SELECT n.part, d, period, sum(q) AS q FROM n JOIN h ON h.part = n.part AND cusip IS NOT NULL JOIN sp ON sp.accession = h.accession AND d > filed AND (until IS NULL OR d <= until) GROUP BY ALL HAVING sum(q) > 0),
    a AS (SELECT s.*, (SELECT max(filed) FROM sub WHERE sub.period = s.period AND filed < d) AS filed FROM s), b AS (SELECT part, d, arg_max(q, period) AS q, max(period) AS period, arg_max(filed, period) AS filed FROM a GROUP BY ALL),
    j AS (SELECT n.part, n.d, cusip, period, filed, q, CASE WHEN n.d > DATE '1998-06-01' THEN p_size * 40 WHEN n.d > DATE '1996-01-01' THEN p_size * 20 END AS outstanding FROM n LEFT JOIN b ON n.part = b.part AND n.d = b.d)
    SELECT part, d AS event_date, cusip, CAST(period AS DATE) AS report_period, CAST(filed AS DATE) AS filed, CAST(q AS BIGINT) AS institutional_shares, CASE WHEN cusip IS NULL THEN 'no_name' WHEN q IS NULL THEN 'no_holdings' WHEN outstanding IS NULL THEN 'no_shares' WHEN q / outstanding > 1.25 THEN 'implausible' END AS reason,
        CASE WHEN cusip IS NOT NULL AND q / outstanding <= 1.25 THEN round(q / outstanding, 9) END AS ratio FROM j""")
def institutional_ownership(spark, sf_dir):
    """What suppliers had reported of a part by its return, by quarters and filings known then, against the count of that time."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), F.col("l_suppkey").alias("manager"), F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2)).alias("report_period"), "l_linestatus", F.col("l_quantity").cast("long").alias("q"), F.to_date("l_shipdate").alias("shipped"), "l_returnflag")
    accession = F.concat_ws("-", F.col("manager").cast("string"), F.col("report_period").cast("string"), "l_linestatus")
    l = l.withColumn("accession", accession)  # noqa: E741
    submissions = l.select("accession", "manager", "report_period", F.when(F.col("l_linestatus") == "F", F.date_add("report_period", 20)).otherwise(F.date_add("report_period", 45)).alias("filing_date")).distinct()
    holdings = l.groupBy("accession", F.concat(F.lit("C"), "symbol").alias("cusip")).agg(F.sum("q").alias("shares"))
    targets = l.filter("l_returnflag = 'R'").select("symbol", F.col("shipped").alias("event_date")).distinct()
    targets = targets.withColumn("cutoff", F.to_utc_timestamp(F.col("event_date").cast("timestamp") + F.expr("INTERVAL 16 HOURS"), "America/New_York"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), "p_size")
    names = parts.filter("p_size <= 40").select("symbol", F.concat(F.lit("C"), "symbol").alias("cusip"), F.lit(date(1995, 6, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    steps = F.array(*(F.struct(ownership.end_of_day(F.lit(d)).alias("at"), F.lit(k).alias("k")) for d, k in ((date(1996, 1, 1), 20), (date(1998, 6, 1), 40))))
    counts = targets.join(parts, "symbol").select("symbol", "event_date", "p_size", F.explode(steps).alias("s")).select("symbol", "event_date", F.col("s.at").alias("available_at"), (F.col("p_size") * F.col("s.k")).cast("long").alias("shares"))
    out = ownership.ownership(targets, names, submissions, holdings, counts)
    filed = F.to_date(F.from_utc_timestamp(F.col("available_at").cast("timestamp"), "America/New_York"))
    return out.select(F.col("symbol").cast("long").alias("part"), "event_date", "cusip", "report_period", filed.alias("filed"), "institutional_shares", "reason", F.round("ratio", 9).alias("ratio"))
