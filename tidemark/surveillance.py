"""More registered queries: source quality, metadata resolution, calendars, lineage, positions, vendor codes, planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _TAPE, _r, _tape, query, table
from .functions import vendor
from .operators import lineage, positions, primitives, quality, tape
from .plans import calendar


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


# --- source quality -----------------------------------------------------------------------------------


_ISSUES = {"canonical_duplicate": "error", "sequence_gap": "warning", "time_regression": "warning", "not_positive": "error", "over_precise": "warning", "stale_gap": "warning"}
_ISSUE_SQL = "canon > 1", "event_id - pid > 1", "ts < pts", "value <= 0", "abs(value * 10 - round(value * 10)) > 1e-6", "ts - pts > INTERVAL 6 HOUR"


@query(f"""WITH q AS (SELECT event_type AS source, event_id, ts, value, lag(ts) OVER w AS pts, lag(event_id) OVER w AS pid, row_number() OVER (PARTITION BY event_type, user_id, round(value) ORDER BY event_id) AS canon FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)),
    c AS (SELECT source, {', '.join(f"count(*) FILTER ({s}) AS {c}" for s, c in zip(_ISSUE_SQL, _ISSUES, strict=True))} FROM q GROUP BY source)
    {' UNION ALL '.join(f"SELECT source, '{c}' AS code, '{s}' AS severity, {c} AS n FROM c" for c, s in _ISSUES.items())}""")
def quality_rules(spark, sf_dir):
    """Every rule of every source in one pass; neighbours within a source and user by sequence."""
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    same = Window.partitionBy("event_type", "user_id", F.round("value")).orderBy("event_id")
    q = table(spark, sf_dir, "events").withColumns({"pts": F.lag("ts").over(w), "pid": F.lag("event_id").over(w), "canon": F.row_number().over(same)})
    tests = (F.col("canon") > 1, F.col("event_id") - F.col("pid") > 1, F.col("ts") < F.col("pts"), F.col("value") <= 0, F.abs(F.col("value") * 10 - F.round(F.col("value") * 10)) > 1e-6, F.col("ts") - F.col("pts") > F.make_dt_interval(hours=F.lit(6)))
    return quality.issues(q, "event_type", {c: (s, t) for (c, s), t in zip(_ISSUES.items(), tests, strict=True)})


@query("""WITH raw AS (SELECT event_type, CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 = 0 THEN 'n/a' WHEN event_id % 29 = 0 THEN '-' || CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS size_text, CASE WHEN user_id % 31 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS account FROM events),
    p AS (SELECT *, TRY_CAST(nullif(size_text, '') AS BIGINT) AS size FROM raw)
    SELECT event_type, CASE WHEN account IS NULL THEN 'no_account' WHEN size_text = '' THEN 'empty' WHEN size IS NULL THEN 'not_a_number' WHEN size < 0 THEN 'negative' END AS reason, count(*) AS n FROM p GROUP BY ALL""")
def reject_reasons(spark, sf_dir):
    """A typed scan of text fields: rows that parse, and rejected ones by the first rule they break."""
    e = F.col("event_id")
    text = F.when(e % 19 == 0, "").when(e % 23 == 0, "n/a").when(e % 29 == 0, F.concat(F.lit("-"), e.cast("string"))).otherwise(e.cast("string"))
    raw = table(spark, sf_dir, "events").select("event_type", text.alias("size_text"), F.when(F.col("user_id") % 31 != 0, F.col("user_id").cast("string")).alias("account"))
    rules = {"no_account": F.col("account").isNull(), "empty": F.col("size_text") == "", "not_a_number": F.col("size").isNull(), "negative": F.col("size") < 0}
    good, bad = quality.typed(raw, {"size": F.nullif(F.col("size_text"), F.lit("")).try_cast("long")}, rules)
    return good.select("event_type", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("event_type", "reason")).groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
    j AS (SELECT t.user_id, date_diff('microsecond', q.ts, t.ts) / 1e6 AS age FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts)
    SELECT user_id % 10 AS desk, count(*) FILTER (age <= 86400) AS fresh, count(*) FILTER (age > 86400) AS stale, count(*) FILTER (age IS NULL) AS no_quote, round(max(age), 3) AS oldest FROM j GROUP BY ALL""")
def stale_quote_share(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t, q = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("quote_ts"))
    age = (primitives.micros("ts") - primitives.micros("matched_ts")) / 1e6
    j = primitives.asof_join(t, q, ["user_id"], "ts", "quote_ts", []).select((F.col("user_id") % 10).alias("desk"), age.alias("age"))
    return j.groupBy("desk").agg(F.count_if(F.expr("age <= 86400")).alias("fresh"), F.count_if(F.expr("age > 86400")).alias("stale"), F.count_if(F.expr("age IS NULL")).alias("no_quote"), F.round(F.max("age"), 3).alias("oldest"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), have AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events)
    SELECT day, count(*) AS required, count(*) FILTER (NOT EXISTS (SELECT 1 FROM have h WHERE h.day = d.day AND h.user_id = u.user_id)) AS missing FROM d, u GROUP BY day""")
def coverage_probe(spark, sf_dir):
    """How many required symbols each date lacks: required and present counts, never their product."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type")
    required = e.filter("event_type = 'signup'").select("user_id").distinct()
    present = e.select("day", "user_id").distinct()
    n = required.agg(F.count(F.lit(1)).alias("required"))
    held = present.join(required.withColumn("wanted", F.lit(1)), "user_id", "left").groupBy("day").agg(F.count("wanted").alias("held"))
    return held.join(F.broadcast(n)).select("day", "required", (F.col("required") - F.col("held")).alias("missing"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(trim(text), '') AS text, role FROM conversations), f AS (SELECT conv_id, turn, CASE WHEN role IS NULL OR role NOT IN ('user', 'assistant', 'system') THEN 'role' WHEN text = '' THEN 'empty' WHEN length(text) < 20 THEN 'short' WHEN turn > 4 THEN 'late' END AS reason FROM c)
    SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM f GROUP BY ALL""")
def rule_funnel(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce(F.trim("text"), F.lit("")))
    rules = {"role": F.col("role").isNull() | ~F.col("role").isin("user", "assistant", "system"), "empty": F.col("text") == "", "short": F.length("text") < 20, "late": F.col("turn") > 4}
    return c.select("conv_id", F.coalesce(quality.first_reason(rules), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"))


# --- market panels ------------------------------------------------------------------------------------


@query(f"""WITH {_TAPE}, q AS (SELECT user_id % 20 AS book, ts, value AS mid, event_id FROM events WHERE event_type = 'view'), t AS (SELECT user_id % 20 AS book, ts, value AS price, {"CAST(json_extract_string(props, '$.k') AS BIGINT)"} AS size, event_id FROM events WHERE event_type = 'purchase'),
    b AS (SELECT t.*, q.mid FROM t ASOF LEFT JOIN (SELECT book, ts, max(mid) AS mid FROM q GROUP BY ALL) q ON t.book = q.book AND t.ts >= q.ts),
    f AS (SELECT b.*, q.mid AS later FROM b ASOF LEFT JOIN (SELECT book, ts, max(mid) AS mid FROM q GROUP BY ALL) q ON b.book = q.book AND b.ts + INTERVAL 30 MINUTE <= q.ts),
    s AS (SELECT book, date_trunc('day', ts) AS bucket, size, 2 * abs(price - mid) AS eff, 2 * sign(price - mid) * (price - later) AS realised, 2 * sign(price - mid) * (later - mid) AS impact FROM f WHERE mid IS NOT NULL)
    SELECT book, bucket, count(*) AS trades, round(sum(eff * size) / nullif(sum(size) FILTER (eff IS NOT NULL), 0), 4) AS effective, round(sum(realised * size) / nullif(sum(size) FILTER (realised IS NOT NULL), 0), 4) AS realised, round(sum(impact * size) / nullif(sum(size) FILTER (impact IS NOT NULL), 0), 4) AS impact FROM s GROUP BY ALL""")
def microstructure_panel(spark, sf_dir):
    """Size-weighted effective and realised spread and impact, against the quote before and the one 30 minutes on."""
    e = _events(spark, sf_dir).withColumn("book", F.col("user_id") % 20)
    q = e.filter("event_type = 'view'").select("book", F.col("ts").alias("q_ts"), F.col("value").alias("mid"))
    t = e.filter("event_type = 'purchase'").select("book", "ts", F.col("value").alias("price"), F.col("k").alias("size"), "event_id")
    before = primitives.asof_join(t, q, ["book"], "ts", "q_ts", ["mid"], bucket=F.to_date).drop("matched_ts").withColumn("mark", F.col("ts") + F.make_dt_interval(mins=F.lit(30)))
    best = q.groupBy("book", "q_ts").agg(F.max("mid").alias("later"))
    f = primitives.asof_join(before, best, ["book"], "mark", "q_ts", ["later"], forward=True, bucket=F.to_date).filter("mid IS NOT NULL")
    side = F.signum(F.col("price") - F.col("mid"))
    s = f.select("book", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket"), "size", (2 * F.abs(F.col("price") - F.col("mid"))).alias("eff"), (2 * side * (F.col("price") - F.col("later"))).alias("real"), (2 * side * (F.col("later") - F.col("mid"))).alias("imp"))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("size")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("size"))), F.lit(0)), 4)
    return s.groupBy("book", "bucket").agg(F.count(F.lit(1)).alias("trades"), mean("eff").alias("effective"), mean("real").alias("realised"), mean("imp").alias("impact"))


@query(f"""WITH {_TAPE}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS trades, sum(size) AS volume, arg_max(price, (ts, seq)) AS close, count(DISTINCT source) AS accounts FROM tape GROUP BY ALL),
    days AS (SELECT DISTINCT day FROM d), grid AS (SELECT s.symbol, days.day FROM (SELECT DISTINCT symbol FROM d) s, days),
    errors AS (SELECT CAST(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 50 GROUP BY ALL), calendar AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY ALL)
    SELECT g.symbol, g.day, coalesce(d.trades, 0) AS trades, CAST(coalesce(d.volume, 0) AS BIGINT) AS volume, round(lag(d.close) OVER w, 6) AS previous_close, coalesce(d.accounts, 0) AS accounts, coalesce(e.errors, 0) AS errors, coalesce(c.orders, 0) AS orders,
      round(avg(coalesce(d.volume, 0)) OVER (PARTITION BY g.symbol ORDER BY g.day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS base_volume
    FROM grid g LEFT JOIN d ON g.symbol = d.symbol AND g.day = d.day LEFT JOIN errors e ON e.day = g.day LEFT JOIN calendar c ON c.day = g.day WINDOW w AS (PARTITION BY g.symbol ORDER BY g.day)""")
def event_panel_full(spark, sf_dir):
    """A grid of symbols and dates with four inputs joined on, and each symbol's own past."""
    t = _tape(spark, sf_dir).withColumn("day", F.to_date("ts"))
    d = t.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("volume"), F.max_by("price", F.struct("ts", "seq")).alias("close"), F.count_distinct("source").alias("accounts"))
    grid = d.select("symbol").distinct().join(F.broadcast(d.select("day").distinct()))
    errors = t.filter("symbol = 'error' AND price > 50").groupBy("day").agg(F.count(F.lit(1)).alias("errors"))
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    w = Window.partitionBy("symbol").orderBy("day")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = grid.join(d, ["symbol", "day"], "left").join(errors, "day", "left").join(orders, "day", "left")
    return joined.select("symbol", "day", zero("trades"), zero("volume"), F.round(F.lag("close").over(w), 6).alias("previous_close"), zero("accounts"), zero("errors"), zero("orders"), F.round(F.avg(F.coalesce("volume", F.lit(0))).over(w.rowsBetween(-5, -1)), 4).alias("base_volume"))


@query(f"""WITH {_TAPE}, m AS (SELECT symbol, CAST(ts AS DATE) AS day, ts, seq, price, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq) AS i FROM tape),
    r AS (SELECT symbol, day, max(price) FILTER (i <= 5) AS hi, min(price) FILTER (i <= 5) AS lo, count(*) AS n FROM m GROUP BY ALL), x AS (SELECT m.*, r.hi, r.lo FROM m JOIN r USING (symbol, day) WHERE i > 5)
    SELECT symbol, day, round(any_value(hi), 6) AS hi, round(any_value(lo), 6) AS lo, min(i) FILTER (price > hi) AS broke_up, min(i) FILTER (price < lo) AS broke_down, count(*) FILTER (price BETWEEN lo AND hi) AS inside FROM x GROUP BY ALL""")
def opening_range(spark, sf_dir):
    """High and low of a day's first trades, when later ones leave that range, and how many don't."""
    day = Window.partitionBy("symbol", "day")
    m = _tape(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("i", F.row_number().over(day.orderBy("ts", "seq")))
    early = F.when(F.col("i") <= 5, F.col("price"))
    x = m.withColumns({"hi": F.max(early).over(day), "lo": F.min(early).over(day)}).filter("i > 5")
    return x.groupBy("symbol", "day").agg(*_r(hi=F.first("hi"), lo=F.first("lo")), F.min(F.expr("CASE WHEN price > hi THEN i END")).cast("long").alias("broke_up"), F.min(F.expr("CASE WHEN price < lo THEN i END")).cast("long").alias("broke_down"), F.count_if(F.expr("price BETWEEN lo AND hi")).alias("inside"))


# --- metadata resolution ------------------------------------------------------------------------------


_CLAIMS = """ev AS (SELECT o_orderkey AS event_id, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders),
    src AS (SELECT l_orderkey AS ref_id, o.o_custkey AS symbol, CAST(o.o_orderdate AS DATE) AS day, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey END AS id, l_linenumber AS line, l_shipdate AS published, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS grade FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def _claims(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    ev = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"))
    src = l.join(ev, l.l_orderkey == ev.event_id).select("symbol", "day", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_orderkey")).alias("id"), F.col("l_orderkey").alias("ref_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("published"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("grade"))
    named = src.join(ev, src.id == ev.event_id).select("event_id", F.lit(True).alias("exact"), "grade", "published", "ref_id", "line")
    loose = src.filter("id IS NULL").join(ev, ["symbol", "day"]).select("event_id", F.lit(False).alias("exact"), "grade", "published", "ref_id", "line")
    return ev, named.unionByName(loose)


_MATCHED = _CLAIMS + """, c AS (SELECT event_id, true AS exact, grade, published, ref_id, line FROM src JOIN ev ON src.id = ev.event_id UNION ALL SELECT event_id, false, grade, published, ref_id, line FROM src JOIN ev ON src.id IS NULL AND src.symbol = ev.symbol AND src.day = ev.day)"""


@query(f"WITH {_MATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY exact DESC, grade, published, ref_id, line) AS k FROM c) SELECT ev.event_id, exact, grade, ref_id, line FROM ev LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON ev.event_id = r.event_id")
def resolve_announcements(spark, sf_dir):
    """Each event's source: matched by id before symbol and date, then by grade, then by time."""
    ev, claims = _claims(spark, sf_dir)
    best = primitives.latest_per_group(claims, ["event_id"], [F.desc("exact"), F.asc("grade"), F.asc("published"), F.asc("ref_id"), F.asc("line")])
    return ev.select("event_id").join(best, "event_id", "left").select("event_id", "exact", "grade", "ref_id", "line")


@query(f"WITH {_MATCHED} SELECT event_id, count(*) AS candidates, count(*) FILTER (exact) AS exact, CAST(coalesce(date_diff('day', min(published) FILTER (exact), max(published) FILTER (exact)), 0) AS BIGINT) AS spread_days, coalesce(date_diff('day', min(published) FILTER (exact), max(published) FILTER (exact)), 0) > 60 AS disputed FROM c GROUP BY event_id")
def announcement_spread(spark, sf_dir):
    """How far the exact claims about an event lie apart."""
    _, claims = _claims(spark, sf_dir)
    at = F.when(F.col("exact"), F.col("published"))
    spread = F.coalesce(F.date_diff(F.max(at), F.min(at)), F.lit(0)).cast("long")
    return claims.groupBy("event_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.expr("exact")).alias("exact"), spread.alias("spread_days"), (spread > 60).alias("disputed"))


@query("""WITH k AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS month, count(o_orderstatus) AS claims, count(DISTINCT o_orderstatus) AS kinds, min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders GROUP BY ALL)
    SELECT o_custkey, month, claims, kinds, CASE WHEN claims = 0 THEN 'missing' WHEN kinds > 1 THEN 'conflict' WHEN claims > 1 THEN 'corroborated' ELSE 'single' END AS state FROM k""")
def exchange_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))
    return quality.conflicts(o, ["o_custkey", "month"], "o_orderstatus").select("o_custkey", "month", "claims", "kinds", "state")


@query("""WITH s AS (SELECT o_custkey AS symbol, o_orderdate AS moment, o_orderkey, o_totalprice AS shares, lag(o_totalprice) OVER w AS before, lag(o_orderdate) OVER w AS before_at FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT symbol, count(*) AS facts, count(*) FILTER (abs(shares - before) / greatest(abs(shares), abs(before), 1.0) > 0.5) AS jumps, count(*) FILTER (date_diff('day', before_at, moment) > 180) AS stale, count(*) FILTER (before_at = moment AND shares <> before) AS clashes FROM s GROUP BY symbol""")
def shares_audit(spark, sf_dir):
    """Jumps against the fact before, facts that came late, and different facts of one date."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("shares"), F.lag("o_totalprice").over(w).alias("before"), F.lag("o_orderdate").over(w).alias("before_at"))
    jump = quality.relative_difference(F.col("shares"), F.col("before")) > 0.5
    return s.groupBy("symbol").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("before").isNotNull() & jump).alias("jumps"), F.count_if(F.date_diff("at", "before_at") > 180).alias("stale"), F.count_if((F.col("before_at") == F.col("at")) & (F.col("shares") != F.col("before"))).alias("clashes"))


@query("""WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_discount) - min(l_discount) AS gap FROM lineitem GROUP BY ALL HAVING count(*) > 1)
    SELECT l_partkey % 50 AS domain, count(*) AS keys, CAST(sum(n) AS BIGINT) AS claims, count(*) FILTER (gap > 0.05) AS conflicts, round(greatest(0, 100.0 * count(*) FILTER (gap <= 0.05) / count(*) - least(10, 0.5 * count(*) FILTER (gap > 0.05))), 4) AS score FROM c GROUP BY ALL""")
def domain_quality(spark, sf_dir):
    """Control claims that disagree, and the score that leaves for each domain."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), (F.max("l_discount") - F.min("l_discount")).alias("gap")).filter("n > 1")
    bad, good = F.count_if(F.expr("gap > 0.05")), F.count_if(F.expr("gap <= 0.05"))
    return c.groupBy((F.col("l_partkey") % 50).alias("domain")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("claims"), bad.alias("conflicts"), F.round(F.greatest(F.lit(0.0), 100.0 * good / F.count(F.lit(1)) - F.least(F.lit(10.0), 0.5 * bad)), 4).alias("score"))


# --- calendars ----------------------------------------------------------------------------------------


_CLIP = """c AS (SELECT event_id, ts, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 570 MINUTE AS opens, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 960 MINUTE AS closes FROM events),
    w AS (SELECT *, date_trunc('minute', greatest(ts - INTERVAL 30 MINUTE, opens)) AS start, date_trunc('minute', least(ts + INTERVAL 60 MINUTE, closes)) AS stop FROM c)"""


def _clipped(spark, sf_dir):
    at = F.col("ts")
    midnight = F.to_date(at).cast("timestamp_ntz")
    opens, closes = midnight + F.make_dt_interval(mins=F.lit(570)), midnight + F.make_dt_interval(mins=F.lit(960))
    start, stop = calendar.clipped(at, opens, closes, 30, 60)
    return table(spark, sf_dir, "events").select("event_id", "user_id", start.alias("start"), stop.alias("stop"), closes.alias("closes"))


@query(f"""WITH {_CLIP} SELECT event_id, start, stop, greatest(date_diff('minute', start, stop) + 1, 0) AS minutes, least(greatest(date_diff('minute', start, stop) + 1, 0), greatest(date_diff('minute', greatest(start - INTERVAL 1 MINUTE, closes - INTERVAL 5 MINUTE), stop), 0)) AS without_later FROM w""")
def clipped_windows(spark, sf_dir):
    """Event windows cut to the session, their minutes, and those whose five minutes after pass the close."""
    e = _clipped(spark, sf_dir)
    return e.select("event_id", "start", "stop", calendar.inclusive_minutes(F.col("start"), F.col("stop")).alias("minutes"), calendar.beyond(F.col("start"), F.col("stop"), F.col("closes"), 5).alias("without_later"))


@query(f"""WITH {_CLIP}, x AS (SELECT c.event_id, e.user_id, start, stop FROM w c JOIN events e USING (event_id) WHERE start <= stop), m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + INTERVAL 1 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop, event_id) AS island FROM m), g AS (SELECT user_id, island, min(start) AS a, max(stop) AS b FROM i GROUP BY ALL)
    SELECT user_id, count(*) AS intervals, CAST(sum(date_diff('minute', a, b) + 1) AS BIGINT) AS minutes FROM g GROUP BY user_id""")
def interval_minutes(spark, sf_dir):
    """Minutes that the merged windows of a symbol require; windows a minute apart leave nothing between them."""
    w = _clipped(spark, sf_dir).filter("start <= stop")
    merged = primitives.merge_intervals(w.select("user_id", "start", "stop"), ["user_id"], "start", "stop", gap=F.expr("INTERVAL '1' MINUTE"))
    return merged.groupBy("user_id").agg(F.count(F.lit(1)).alias("intervals"), F.sum(calendar.inclusive_minutes(F.col("start"), F.col("stop"))).alias("minutes"))


#: US federal holidays of the winter that the events are of, as they are observed.
_WINTER = "['2023-12-25', '2024-01-01', '2024-01-15', '2024-02-19', '2024-05-27']"
_OPENS = f"""d AS (SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events),
    o AS (SELECT event_id, ts, day, CAST(CASE WHEN CAST(ts AS TIME) > TIME '12:00:00' THEN (SELECT min(x.d) FROM (SELECT CAST(unnest(generate_series(day + 1, day + 10, INTERVAL 1 DAY)) AS DATE) AS d) x WHERE dayofweek(x.d) BETWEEN 1 AND 5 AND NOT list_contains({_WINTER}, CAST(x.d AS VARCHAR))) ELSE day END AS TIMESTAMP) + INTERVAL 570 MINUTE AS opens FROM d)"""


@query(f"""WITH {_OPENS}, g AS (SELECT event_id, opens, ts, CAST(ceil((epoch_us(opens) - epoch_us(ts)) / 60000000.0) AS BIGINT) + 30 AS last FROM o)
    SELECT opens, count(*) AS events, CAST(sum(greatest(last + 6, 0)) AS BIGINT) AS points, min(ts - INTERVAL 5 MINUTE) AS first_point, max(ts + to_minutes(last)) FILTER (last >= -5) AS last_point FROM g GROUP BY opens""")
def research_grids(spark, sf_dir):
    """Minute grids from five minutes before an event to half an hour after the opening that it is judged at."""
    closed = calendar.federal_holidays(2023, 2025)
    o = table(spark, sf_dir, "events").select("ts", calendar.research_open(F.col("ts"), holidays=closed).alias("opens"))
    grid = o.select("opens", (F.col("ts") - F.make_dt_interval(mins=F.lit(5))).alias("first"), calendar.trade_grid(F.col("ts"), F.col("opens")).alias("grid"))
    return grid.groupBy("opens").agg(F.count(F.lit(1)).alias("events"), F.sum(F.size("grid")).alias("points"), F.min("first").alias("first_point"), F.max(F.array_max("grid")).alias("last_point"))


@query(f"""WITH {_OPENS}, p AS (SELECT CASE WHEN CAST(ts AS TIME) > TIME '12:00:00' THEN day ELSE (SELECT max(x.d) FROM (SELECT CAST(unnest(generate_series(day - 10, day - 1, INTERVAL 1 DAY)) AS DATE) AS d) x WHERE dayofweek(x.d) BETWEEN 1 AND 5 AND NOT list_contains({_WINTER}, CAST(x.d AS VARCHAR))) END AS before FROM o)
    SELECT before, (SELECT min(x.d) FROM (SELECT CAST(unnest(generate_series(before + 1, before + 10, INTERVAL 1 DAY)) AS DATE) AS d) x WHERE dayofweek(x.d) BETWEEN 1 AND 5 AND NOT list_contains({_WINTER}, CAST(x.d AS VARCHAR))) AS after, count(*) AS events FROM p GROUP BY ALL""")
def sample_days(spark, sf_dir):
    """Events by the last business day before them and the first after them, over weekends and holidays."""
    before, after = calendar.sample_days(F.col("ts"), F.to_date("ts"), calendar.federal_holidays(2023, 2025))
    return table(spark, sf_dir, "events").groupBy(before.alias("before"), after.alias("after")).agg(F.count(F.lit(1)).alias("events"))


@query("""WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_custkey % 5 AS venue FROM orders WHERE o_totalprice > 50000), n AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY day) AS i FROM s)
    SELECT venue, day, CAST(greatest(0, least(i - 1, 21)) AS BIGINT) AS eligible, lag(day, 21) OVER (PARTITION BY venue ORDER BY day) AS oldest, i - 1 >= 21 AS full_history FROM n""")
def eligible_baselines(spark, sf_dir):
    """How many earlier sessions each session has to be normalised by, and how far back they reach."""
    s = table(spark, sf_dir, "orders").filter("o_totalprice > 50000").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 5).alias("venue")).distinct()
    w = Window.partitionBy("venue").orderBy("day")
    i = F.row_number().over(w) - 1
    return s.select("venue", "day", F.greatest(F.lit(0), F.least(i, F.lit(21))).cast("long").alias("eligible"), F.lag("day", 21).over(w).alias("oldest"), (i >= 21).alias("full_history"))


# --- lineage and records ------------------------------------------------------------------------------


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 41 = 40 THEN -1 - p_partkey ELSE p_partkey // 3 END AS parent, p_size <> 13 AS ok FROM part),
    t AS (SELECT id, 0 AS depth, id AS root, ok AND parent IS NULL AS ok FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
      UNION ALL SELECT n.id, t.depth + 1, t.root, n.ok AND t.ok FROM n JOIN t ON n.parent = t.id)
    SELECT id, CAST(depth AS BIGINT) AS depth, root, ok, false AS cyclic FROM t""")
def lineage_closure(spark, sf_dir):
    """Artifacts that are verified with all they derive from; pointers double instead of walking."""
    p = F.col("p_partkey")
    parent = F.when(p == 0, None).when(p % 41 == 40, -1 - p).otherwise(F.floor(p / 3))
    return lineage.ancestry(table(spark, sf_dir, "part").select(p.alias("id"), parent.alias("parent"), (F.col("p_size") != 13).alias("ok")))


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, sha256(coalesce(role, '') || '|' || coalesce(text, '')) AS payload_hash FROM conversations),
    c AS (SELECT conv_id, turn, i, payload_hash, '' AS previous_hash, sha256('|' || payload_hash) AS record_hash FROM p WHERE i = 1
      UNION ALL SELECT p.conv_id, p.turn, p.i, p.payload_hash, c.record_hash, sha256(c.record_hash || '|' || p.payload_hash) FROM p JOIN c ON p.conv_id = c.conv_id AND p.i = c.i + 1),
    stored AS (SELECT conv_id, turn, i, CASE WHEN conv_id % 7 = 3 AND i = 2 THEN sha256('forged' || payload_hash) ELSE payload_hash END AS payload_hash, CASE WHEN conv_id % 11 = 5 AND i = 3 THEN 'lost' ELSE previous_hash END AS previous_hash, record_hash FROM c),
    v AS (SELECT *, CASE WHEN previous_hash <> coalesce(lag(record_hash) OVER w, '') THEN 'link' WHEN record_hash <> sha256(previous_hash || '|' || payload_hash) THEN 'hash' END AS fault FROM stored WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, fault, count(fault) OVER (PARTITION BY conv_id ORDER BY turn) = 0 AS verified FROM v""")
def chain_breaks(spark, sf_dir):
    """Stored chains with forged payloads and lost links: the break is found, and nothing behind it is trusted."""
    chained = tape.chain(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"])
    rows = chained.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "payload_hash")) - 1)
    stored = rows.withColumn("payload_hash", F.when((F.col("conv_id") % 7 == 3) & (F.col("i") == 1), F.sha2(F.concat(F.lit("forged"), "payload_hash"), 256)).otherwise(F.col("payload_hash"))).withColumn("previous_hash", F.when((F.col("conv_id") % 11 == 5) & (F.col("i") == 2), "lost").otherwise(F.col("previous_hash")))
    return lineage.chain_breaks(stored, "conv_id", "turn").select("conv_id", "turn", "fault", "verified")


@query("""WITH e AS (SELECT c_custkey AS src, c_nationkey AS dst FROM customer UNION ALL SELECT s_suppkey + 1000000, s_nationkey + CASE WHEN s_suppkey % 9 = 0 THEN 100 ELSE 0 END FROM supplier), k AS (SELECT n_nationkey FROM nation)
    SELECT CASE WHEN src >= 1000000 THEN 'supplier' ELSE 'customer' END AS class, count(*) AS edges, count(*) FILTER (dst NOT IN (SELECT n_nationkey FROM k)) AS dangling, count(DISTINCT src) AS nodes FROM e GROUP BY ALL""")
def graph_self_check(spark, sf_dir):
    """Edges without their node, and counts by class."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    e = c.select(F.lit("customer").alias("class"), F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")).unionByName(s.select(F.lit("supplier").alias("class"), F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 9 == 0, 100).otherwise(0)).alias("dst")))
    known = F.broadcast(n.select(F.col("n_nationkey").alias("dst"), F.lit(1).alias("there")))
    return e.join(known, "dst", "left").groupBy("class").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.expr("there IS NULL")).alias("dangling"), F.count_distinct("src").alias("nodes"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS at FROM orders), l AS (SELECT l_orderkey, l_suppkey, min(l_shipdate) AS seen FROM lineitem GROUP BY ALL),
    f AS (SELECT o.o_orderkey, count(DISTINCT l.l_suppkey) FILTER (l.seen <= o.at + INTERVAL 60 DAY) AS visible, count(DISTINCT l.l_suppkey) AS ever FROM o JOIN l ON l.l_orderkey = o.o_orderkey GROUP BY ALL)
    SELECT o_orderkey, visible, ever, CASE WHEN visible = 0 THEN 'NONE_VISIBLE' WHEN visible < ever THEN 'PARTIAL' ELSE 'ALL_VISIBLE' END AS status FROM f""")
def graph_visibility(spark, sf_dir):
    """Neighbours of a seed that were known at its time, against all that ever were."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").agg(F.min("l_shipdate").alias("seen"))  # noqa: E741
    f = o.join(l, "o_orderkey").groupBy("o_orderkey").agg(F.count_if(F.col("seen") <= F.col("at") + F.make_dt_interval(days=F.lit(60))).alias("visible"), F.count(F.lit(1)).alias("ever"))
    return f.withColumn("status", F.when(F.col("visible") == 0, "NONE_VISIBLE").when(F.col("visible") < F.col("ever"), "PARTIAL").otherwise("ALL_VISIBLE"))


# --- positions and evaluation -------------------------------------------------------------------------


_KINDS = "k AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'design' WHEN 'purchase' THEN 'admit' WHEN 'error' THEN 'exit' END AS kind, value FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"


@query(f"""WITH {_KINDS}, d AS (SELECT user_id, min((ts, event_id)) AS at FROM k WHERE kind = 'design' GROUP BY user_id),
    a AS (SELECT d.user_id, min((k.ts, k.event_id)) AS at, arg_min(k.value, (k.ts, k.event_id)) AS price FROM d JOIN k ON k.user_id = d.user_id AND k.kind = 'admit' AND (k.ts, k.event_id) > d.at GROUP BY d.user_id),
    x AS (SELECT a.user_id, min((k.ts, k.event_id)) AS at, arg_min(k.value, (k.ts, k.event_id)) AS price FROM a JOIN k ON k.user_id = a.user_id AND k.kind = 'exit' AND (k.ts, k.event_id) > a.at GROUP BY a.user_id)
    SELECT u.user_id, CASE WHEN d.at IS NULL THEN 'unknown' WHEN a.at IS NULL THEN 'designed' WHEN x.at IS NULL THEN 'open' ELSE 'closed' END AS state, round(a.price, 4) AS entry_price, round(x.price, 4) AS exit_price FROM (SELECT DISTINCT user_id FROM k) u LEFT JOIN d USING (user_id) LEFT JOIN a USING (user_id) LEFT JOIN x USING (user_id)""")
def position_states(spark, sf_dir):
    """Event-sourced decisions: designed, admitted after it, left after that."""
    kind = F.when(F.col("event_type") == "signup", "design").when(F.col("event_type") == "purchase", "admit").otherwise("exit")
    k = table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase', 'error')").withColumn("kind", kind)
    s = positions.states(k, "user_id", "kind", ["ts", "event_id"], ["value"])
    return s.select("user_id", "state", *_r(4, entry_price=F.col("admitted.more.value"), exit_price=F.col("left.more.value")))


@query("""WITH s AS (SELECT l_suppkey AS book, l_orderkey, l_linenumber, l_shipdate AS entry, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS leave FROM lineitem),
    b AS (SELECT *, max(leave) OVER (PARTITION BY book ORDER BY entry, l_orderkey * 10 + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM s)
    SELECT book, count(*) AS violations, min(entry) AS first_one FROM b WHERE entry < busy GROUP BY book""")
def overlapping_positions(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.col("l_shipdate").alias("entry"), (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int"))).alias("leave"))  # noqa: E741
    return positions.overlaps(l, ["book"], "entry", "leave", "n").groupBy("book").agg(F.count(F.lit(1)).alias("violations"), F.min("entry").alias("first_one"))


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority AS strategy, o_orderdate AS admitted, o_totalprice AS risk FROM orders), r AS (SELECT l_orderkey, sum(l_extendedprice * (0.05 - l_discount)) AS pnl, count(*) FILTER (l_returnflag = 'R') AS bad, max(l_shipdate) AS done FROM lineitem GROUP BY ALL),
    s AS (SELECT a.*, pnl, CASE WHEN l_orderkey IS NULL THEN 'no_outcome' WHEN done > TIMESTAMP '1999-01-01' THEN 'pending' WHEN bad > 2 THEN 'invalid' ELSE 'valid' END AS state FROM a LEFT JOIN r ON l_orderkey = o_orderkey)
    SELECT strategy, state, count(*) AS n, round(sum(pnl), 2) AS pnl, round(avg(pnl), 4) AS mean FROM s GROUP BY ALL""")
def population_states(spark, sf_dir):
    """Admissions with what became of them; none is left out for lack of an outcome."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (F.lit(0.05) - F.col("l_discount"))).alias("pnl"), F.count_if(F.expr("l_returnflag = 'R'")).alias("bad"), F.max("l_shipdate").alias("done"))
    state = F.when(F.col("done").isNull(), "no_outcome").when(F.expr("done > TIMESTAMP_NTZ '1999-01-01 00:00:00'"), "pending").when(F.col("bad") > 2, "invalid").otherwise("valid")
    s = table(spark, sf_dir, "orders").join(r, "o_orderkey", "left").withColumn("state", state)
    return s.groupBy(F.col("o_orderpriority").alias("strategy"), "state").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 2).alias("pnl"), F.round(F.avg("pnl"), 4).alias("mean"))


@query("""WITH f AS (SELECT doc_id, CAST(concat('0x', substr(md5(CAST(doc_id % 500 AS VARCHAR)), 1, 6)) AS BIGINT) % 5 AS fold, doc_id % 500 AS grp, toxic FROM labels)
    SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, count(DISTINCT grp) AS groups, CAST(sum(toxic) AS BIGINT) AS positives, round(avg(toxic), 6) AS rate FROM f GROUP BY ALL""")
def group_folds(spark, sf_dir):
    """Folds by a hash of the group, so that no group is in two."""
    grp = (F.col("doc_id") % 500).cast("string")
    fold = F.conv(F.substring(F.md5(grp), 1, 6), 16, 10).cast("long") % 5
    return table(spark, sf_dir, "labels").groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(grp).alias("groups"), F.sum("toxic").cast("long").alias("positives"), F.round(F.avg("toxic"), 6).alias("rate"))


@query("""WITH f AS (SELECT doc_id, toxic, quality, CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 6)) AS BIGINT) % 5 AS fold FROM labels), c AS (SELECT fold, quality, count(*) AS n, sum(toxic) AS p FROM f GROUP BY ALL), t AS (SELECT quality, sum(n) AS n, sum(p) AS p FROM c GROUP BY quality),
    s AS (SELECT f.*, (t.p - c.p + 1.0) / (t.n - c.n + 2.0) AS score FROM f JOIN c USING (fold, quality) JOIN t USING (quality))
    SELECT CAST(fold AS BIGINT) AS fold, quality, round(any_value(score), 8) AS score, count(*) AS n, round(avg((score - toxic) * (score - toxic)), 8) AS brier FROM s GROUP BY ALL""")
def out_of_fold_scores(spark, sf_dir):
    """Each row scored by counts of the other folds only: one total, less the row's own fold."""
    f = table(spark, sf_dir, "labels").withColumn("fold", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("long") % 5)
    own = f.groupBy("fold", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p"), F.sum(F.col("toxic") * F.col("toxic")).alias("pp"))
    w = Window.partitionBy("quality")
    s = own.withColumn("score", (F.sum("p").over(w) - F.col("p") + 1.0) / (F.sum("n").over(w) - F.col("n") + 2.0))
    return s.select("fold", "quality", F.round("score", 8).alias("score"), "n", F.round((F.col("n") * F.col("score") * F.col("score") - 2 * F.col("score") * F.col("p") + F.col("pp")) / F.col("n"), 8).alias("brier"))


@query("""WITH g AS (SELECT o_orderpriority AS grp, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS champion, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS challenger, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS fpr FROM orders GROUP BY ALL)
    SELECT grp, n, round(challenger / champion - 1, 6) AS gain, CASE WHEN n < 50 THEN 'too_few' WHEN fpr > 0.4 THEN 'false_positives' WHEN challenger / champion - 1 <= 0 THEN 'no_gain' WHEN challenger / champion - 1 < 0.01 THEN 'too_small' ELSE 'promote' END AS decision FROM g""")
def promotion_decision(spark, sf_dir):
    """Guardrails in order; a challenger is promoted only if none of them speaks."""
    o, odd = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 1
    g = o.groupBy(F.col("o_orderpriority").alias("grp")).agg(F.avg(F.when(~odd, F.col("o_totalprice"))).alias("champion"), F.avg(F.when(odd, F.col("o_totalprice"))).alias("challenger"), F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("fpr"))
    gain = F.col("challenger") / F.col("champion") - 1
    rules = {"too_few": F.col("n") < 50, "false_positives": F.col("fpr") > 0.4, "no_gain": gain <= 0, "too_small": gain < 0.01}
    return g.select("grp", "n", F.round(gain, 6).alias("gain"), F.coalesce(quality.first_reason(rules), F.lit("promote")).alias("decision"))


@query("""WITH t AS (SELECT o_orderpriority AS strategy, o_orderdate, o_orderkey, (o_totalprice - 200000) / 1e4 AS pnl FROM orders), r AS (SELECT *, sum(pnl) OVER w AS run FROM t WINDOW w AS (PARTITION BY strategy, date_trunc('year', o_orderdate) ORDER BY o_orderdate, o_orderkey)),
    h AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY strategy, date_trunc('year', o_orderdate) ORDER BY o_orderdate, o_orderkey)) - run AS fall FROM r)
    SELECT strategy, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, round(avg(pnl), 6) AS mean, round(max(fall), 4) AS drawdown FROM h GROUP BY ALL""")
def strategy_scorecard(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("strategy"), F.year("o_orderdate").alias("year"), "o_orderdate", "o_orderkey", ((F.col("o_totalprice") - 200000) / 1e4).alias("pnl"))
    w = Window.partitionBy("strategy", "year").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    h = t.withColumn("run", F.sum("pnl").over(w)).withColumn("fall", F.greatest(F.lit(0.0), F.max("run").over(w)) - F.col("run"))
    return h.groupBy("strategy", "year").agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.expr("pnl > 0")).alias("wins"), F.round(F.avg("pnl"), 6).alias("mean"), F.round(F.max("fall"), 4).alias("drawdown"))


# --- vendor codes -------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT o_orderkey, 'RT' || CASE WHEN o_orderkey % 3 = 0 THEN lower(m) ELSE m END || strftime(o_orderdate, '%d%y') || lpad(CAST(o_orderkey % 90000 AS VARCHAR), 5, '0') || CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN '.Q' ELSE '.U' END AS code FROM (SELECT *, chr(CAST(64 + month(o_orderdate) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 12 END AS INT)) AS m FROM orders)),
    p AS (SELECT o_orderkey, regexp_extract(code, '^(.+)([A-Xa-x])(\\d\\d)(\\d\\d)(\\d{5})\\.U$', ['root', 'm', 'd', 'y', 'k']) AS p FROM c),
    q AS (SELECT o_orderkey, p.root AS root, strpos('ABCDEFGHIJKLMNOPQRSTUVWX', upper(p.m)) AS n, CAST(p.k AS DOUBLE) / CASE WHEN p.m = lower(p.m) THEN 10 ELSE 100 END AS strike, CASE WHEN CAST(p.y AS INT) <= 72 THEN '20' ELSE '19' END || p.y AS y, p.d AS d FROM p WHERE p.root <> ''),
    v AS (SELECT o_orderkey, root, CASE WHEN n <= 12 THEN 'call' ELSE 'put' END AS kind, CAST(y || '-' || lpad(CAST((n - 1) % 12 + 1 AS VARCHAR), 2, '0') || '-' || d AS DATE) AS expiry, round(strike, 4) AS strike FROM q WHERE strike > 0)
    SELECT o.o_orderkey, root, kind, expiry, strike FROM orders o LEFT JOIN v USING (o_orderkey)""")
def option_identifiers(spark, sf_dir):
    """Codes of contracts decoded; those without the exchange's suffix give nulls."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    month = F.char(F.lit(64) + F.month(day) + F.when(k % 2 == 0, 0).otherwise(12))
    suffix = F.when(k % 13 == 0, "").when(k % 13 == 1, ".Q").otherwise(".U")
    code = F.concat(F.lit("RT"), F.when(k % 3 == 0, F.lower(month)).otherwise(month), F.date_format(day, "ddyy"), F.lpad((k % 90000).cast("string"), 5, "0"), suffix)
    decoded = vendor.option_symbol(F.col("code"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))
    return o.select("o_orderkey", decoded["root"].alias("root"), decoded["kind"].alias("kind"), decoded["expiry"].alias("expiry"), F.round(decoded["strike"], 4).alias("strike"))


@query("""WITH r AS (SELECT event_id, ts, user_id, ts + to_minutes(CAST(user_id % 3 AS INTEGER)) AS got, CASE WHEN event_type = 'view' THEN NULL ELSE user_id % 12 - 6 END AS hours FROM events),
    c AS (SELECT *, date_trunc('day', got) AS day, got - date_trunc('day', got) AS g, CASE WHEN event_type_blank THEN got - date_trunc('day', got) ELSE ts - date_trunc('day', ts) END AS q FROM (SELECT r.*, e.event_type = 'error' AS event_type_blank FROM r JOIN events e USING (event_id))),
    d AS (SELECT *, g - q AS gap FROM c)
    SELECT event_id, day + g - (CASE WHEN gap > INTERVAL 23 HOUR THEN gap - INTERVAL 24 HOUR WHEN gap < INTERVAL '-23 hours' THEN gap + INTERVAL 24 HOUR ELSE gap END) + to_hours(CAST(coalesce(hours, 0) AS INTEGER)) AS moment,
        date_trunc('day', CASE WHEN event_type_blank THEN got ELSE ts END) + (ts - date_trunc('day', ts)) + to_hours(CAST(coalesce(hours, 0) AS INTEGER)) AS traded FROM d""")
def wrapped_clocks(spark, sf_dir):
    """Quotes' and trades' own clocks, as texts, put on the day of receipt or the one beside it, and moved by their offset from GMT."""
    ts, got = F.col("ts"), F.col("ts") + F.make_dt_interval(mins=(F.col("user_id") % 3).cast("int"))
    clock, blank = (lambda c: F.date_format(c, "HH:mm:ss.SSSSSS")), F.col("event_type") == "error"
    offset = F.when(F.col("event_type") == "view", "").otherwise((F.col("user_id") % 12 - 6).cast("string"))
    offset = F.nullif(offset, F.lit(""))
    quote = vendor.quote_moment(F.date_format(got, "d-MMM-yyyy"), clock(got), F.when(blank, "").otherwise(clock(ts)), offset)
    trade = vendor.trade_moment(F.when(blank, " ").otherwise(F.date_format(ts, "yyyy-MM-dd")), F.date_format(got, "d-MMM-yyyy"), clock(ts), offset)
    return table(spark, sf_dir, "events").select("event_id", quote.alias("moment"), trade.alias("traded"))


@query("""WITH t AS (SELECT event_id, concat_ws(';', CASE WHEN event_id % 2 = 0 THEN ' odd ' END, CASE WHEN event_id % 5 = 0 THEN 'OPEN' END, CASE WHEN event_id % 7 = 0 THEN 'Late' END) AS tags, event_type FROM events)
    SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS odd_lot, count(*) FILTER (event_id % 5 = 0) AS opening, count(*) FILTER (event_id % 7 = 0) AS late, count(*) FILTER (event_id % 2 <> 0 AND event_id % 7 <> 0) AS regular FROM t GROUP BY ALL""")
def qualifier_flags(spark, sf_dir):
    """Condition codes of a tag list, and the trades that none of the excluded ones marks."""
    n = F.col("event_id")
    tags = F.concat_ws(";", F.when(n % 2 == 0, " odd "), F.when(n % 5 == 0, "OPEN"), F.when(n % 7 == 0, "Late"))
    f = table(spark, sf_dir, "events").select("event_type", *vendor.flags(tags, {"odd_lot": "ODD", "opening": "OPEN", "late": "LATE"}))
    return f.groupBy("event_type").agg(*(F.count_if(c).alias(c) for c in ("odd_lot", "opening", "late")), F.count_if(F.expr("NOT odd_lot AND NOT late")).alias("regular"))


@query("""WITH q AS (SELECT event_id, event_type, value AS bid, CASE WHEN event_id % 17 = 0 THEN value WHEN event_id % 11 = 0 THEN value - 1 WHEN event_id % 29 = 0 THEN 0 ELSE value + (event_id % 5) END AS ask FROM events)
    SELECT event_type, count(*) FILTER (NOT bid > 0) AS no_bid, count(*) FILTER (NOT ask > 0) AS no_ask, count(*) FILTER (bid > 0 AND ask > 0 AND bid > ask) AS crossed, count(*) FILTER (bid > 0 AND ask > 0 AND bid = ask) AS locked, count(*) FILTER (bid > 0 AND ask > 0 AND ask - bid > 0.1 * (ask + bid) / 2) AS wide FROM q GROUP BY ALL""")
def quote_anomalies(spark, sf_dir):
    n, v = F.col("event_id"), F.col("value")
    ask = F.when(n % 17 == 0, v).when(n % 11 == 0, v - 1).when(n % 29 == 0, 0.0).otherwise(v + n % 5)
    q = table(spark, sf_dir, "events").select("event_type", v.alias("bid"), ask.alias("ask"))
    marks = vendor.quote_flags(F.col("bid"), F.col("ask"), 0.1)
    return q.groupBy("event_type").agg(*(F.count_if(c).alias(name) for name, c in marks.items()))


@query("""WITH x AS (SELECT date_diff('day', o_orderdate, l_shipdate) AS dte, CASE l_linestatus WHEN 'F' THEN epoch_ms(l_shipdate) ELSE epoch_ms(l_shipdate) / 1000 END AS stamp, l_extendedprice * 1e6 AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT CASE WHEN dte = 0 THEN '0DTE' WHEN dte = 1 THEN '1DTE' WHEN dte >= 7 AND dte <= 21 THEN '7-21DTE' END AS bucket, count(*) AS n, count(*) FILTER (stamp >= 1e9 AND stamp < 1e11 OR stamp >= 1e12 AND stamp < 1e14) AS dated, count(*) FILTER (price >= 1e9 AND price < 1e11 OR price >= 1e12 AND price < 1e14) AS priced_as_date FROM x GROUP BY ALL""")
def number_guards(spark, sf_dir):
    """Seconds told from milliseconds by size, and days to shipment as the labels of expiries."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ms = primitives.micros("l_shipdate") / 1000
    stamp = F.when(F.col("l_linestatus") == "F", ms).otherwise(ms / 1000)
    bucket = vendor.expiry_bucket(F.date_diff("l_shipdate", "o_orderdate"))
    return lines.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count(vendor.epoch_seconds(stamp)).alias("dated"), F.count(vendor.epoch_seconds(F.col("l_extendedprice") * 1e6)).alias("priced_as_date"))


@query("""WITH x AS (SELECT DISTINCT o_custkey % 100 AS root, CAST(o_orderdate AS DATE) AS expiry FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-04-01'), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY expiry) AS k FROM x) SELECT root, expiry, CAST(k AS INTEGER) AS nth FROM r WHERE k <= 2""")
def nearest_expirations(spark, sf_dir):
    x = table(spark, sf_dir, "orders").filter("o_orderdate BETWEEN TIMESTAMP_NTZ '1997-01-01 00:00:00' AND TIMESTAMP_NTZ '1997-04-01 00:00:00'").select((F.col("o_custkey") % 100).alias("root"), F.to_date("o_orderdate").alias("expiry")).distinct()
    return primitives.latest_per_group(x, ["root"], [F.asc("expiry")], 2).withColumnRenamed("rank_in_group", "nth")


# --- planning and delivery ----------------------------------------------------------------------------


@query("""SELECT CAST(o_orderdate AS DATE) AS day, list_sort(list_distinct(flatten(list([o_orderstatus, o_orderpriority])))) AS kinds, count(DISTINCT o_custkey) AS symbols FROM orders GROUP BY ALL""")
def date_batches(spark, sf_dir):
    """One request a date, with the sorted kinds that any of its rows needs."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey", F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("kind"))
    return o.groupBy("day").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count_distinct("o_custkey").alias("symbols"))


@query("""WITH r AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), n AS (SELECT day, user_id, row_number() OVER (PARTITION BY day ORDER BY user_id) AS k FROM r)
    SELECT day, CAST((k - 1) // 25 AS BIGINT) AS batch, count(*) AS symbols, min(user_id) AS first_symbol, max(user_id) AS last_symbol, sha256(string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id)) AS batch_id FROM n GROUP BY ALL""")
def request_batches(spark, sf_dir):
    """Required symbols of each date in requests of 25, named by what they hold so that resending changes nothing."""
    r = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    n = r.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("day").orderBy("user_id")) - 1) / 25))
    held = F.sort_array(F.collect_list("user_id"))
    return n.groupBy("day", "batch").agg(F.count(F.lit(1)).alias("symbols"), F.min("user_id").alias("first_symbol"), F.max("user_id").alias("last_symbol"), F.sha2(F.array_join(held.cast("array<string>"), ","), 256).alias("batch_id"))


@query("""WITH w AS (SELECT o_orderkey AS id, count(*) AS wanted FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), g AS (SELECT l_orderkey AS id, count(*) AS got FROM lineitem WHERE l_linenumber % 4 <> 0 OR l_returnflag = 'N' GROUP BY ALL)
    SELECT CASE WHEN wanted IS NULL THEN 'unrequested' WHEN got IS NULL THEN 'missing' WHEN got < wanted THEN 'short' ELSE 'complete' END AS delivery, count(*) AS n, CAST(coalesce(sum(wanted), 0) AS BIGINT) AS wanted, CAST(coalesce(sum(got), 0) AS BIGINT) AS got FROM w FULL JOIN g USING (id) GROUP BY ALL""")
def delivery_reconciliation(spark, sf_dir):
    """What was asked for against what came, neither side left out."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    w = l.join(o, l.l_orderkey == o.o_orderkey).groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("wanted"))
    g = l.filter("l_linenumber % 4 <> 0 OR l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("got"))
    state = F.when(F.col("wanted").isNull(), "unrequested").when(F.col("got").isNull(), "missing").when(F.col("got") < F.col("wanted"), "short").otherwise("complete")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return w.join(g, "id", "full").groupBy(state.alias("delivery")).agg(F.count(F.lit(1)).alias("n"), total("wanted"), total("got"))


@query("""WITH b AS (SELECT p_brand, p_type, count(*) AS n, count(*) FILTER (p_size > 25) AS ready, min(p_retailprice) AS least FROM part GROUP BY ALL)
    SELECT p_brand, sum(n)::BIGINT AS required, sum(ready)::BIGINT AS ready, count(*) FILTER (ready = 0) AS blocked_lanes, CASE WHEN sum(ready) = sum(n) THEN 'READY' WHEN count(*) FILTER (ready = 0) > 0 THEN 'BLOCKED' ELSE 'PARTIAL' END AS status FROM b GROUP BY p_brand""")
def readiness_matrix(spark, sf_dir):
    """Lanes that have nothing ready block their contract."""
    b = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("p_size > 25")).alias("ready"))
    blocked = F.count_if(F.expr("ready = 0"))
    status = F.when(F.sum("ready") == F.sum("n"), "READY").when(blocked > 0, "BLOCKED").otherwise("PARTIAL")
    return b.groupBy("p_brand").agg(F.sum("n").alias("required"), F.sum("ready").alias("ready_"), blocked.alias("blocked_lanes"), status.alias("status")).withColumnRenamed("ready_", "ready")


@query("""WITH p AS (SELECT user_id, ts, event_id, max(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, value FROM events)
    SELECT user_id, count(*) AS reports, count(*) FILTER (value < high) AS regressions, round(coalesce(max(high - value), 0), 4) AS worst FROM p GROUP BY ALL""")
def progress_regressions(spark, sf_dir):
    """Reports that fall below what was reported before them on their day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    p = table(spark, sf_dir, "events").select("user_id", "value", F.max("value").over(w).alias("high"))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.expr("value < high")).alias("regressions"), F.round(F.coalesce(F.max(F.col("high") - F.col("value")), F.lit(0.0)), 4).alias("worst"))


@query("""WITH a AS (SELECT sha256(concat_ws('|', l_partkey, l_suppkey, l_quantity)) AS h, l_orderkey FROM lineitem), u AS (SELECT h, min(l_orderkey) AS first_seen, count(*) AS sent FROM a GROUP BY h)
    SELECT CAST(first_seen % 20 AS BIGINT) AS batch, count(*) AS kept, CAST(sum(sent - 1) AS BIGINT) AS no_ops FROM u GROUP BY ALL""")
def cumulative_union(spark, sf_dir):
    """Contracts of all batches by content: what was there already changes nothing."""
    key = F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey", F.col("l_quantity").cast("string")), 256)
    u = table(spark, sf_dir, "lineitem").groupBy(key.alias("h")).agg(F.min("l_orderkey").alias("first_seen"), F.count(F.lit(1)).alias("sent"))
    return u.groupBy((F.col("first_seen") % 20).alias("batch")).agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("sent") - 1).alias("no_ops"))
