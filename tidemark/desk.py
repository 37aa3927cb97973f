"""More registered queries: field rules, legs of pairs, rank and evidence gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import query, table
from .functions import fields
from .operators import quality


def _n(condition: str, name: str):
    return F.count_if(F.expr(condition)).alias(name)


@query(f"""WITH t AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'no code' ELSE 'CLASS [' || CAST((o_custkey * 37 + o_orderkey) % 10000 AS VARCHAR) || ']' END AS text FROM orders),
    c AS (SELECT lpad(nullif(regexp_extract(text, '\\[(\\d{{1,4}})\\]', 1), ''), 4, '0') AS code FROM t)
    SELECT CASE WHEN code IS NULL THEN NULL {' '.join(f"WHEN CAST(code AS INT) BETWEEN {a} AND {b} THEN '{d}'" for d, a, b in fields.DIVISIONS)} ELSE 'UNCLASSIFIED' END AS division, count(*) AS n, coalesce(min(code), '') AS first_code, coalesce(max(code), '') AS last_code FROM c GROUP BY ALL""")
def industry_divisions(spark, sf_dir):
    """Filings by the division of the code that their header gives; those without one apart."""
    number = (F.col("o_custkey") * 37 + F.col("o_orderkey")) % 10000
    text = F.when(F.col("o_orderkey") % 17 == 0, "no code").otherwise(F.concat(F.lit("CLASS ["), number.cast("string"), F.lit("]")))
    c = table(spark, sf_dir, "orders").select(fields.bracketed_code(text).alias("code"))
    return c.groupBy(fields.division(F.col("code")).alias("division")).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("first_code"), F.max("code").alias("last_code"))


@query("""WITH r AS (SELECT event_id, user_id, CASE event_id % 7 WHEN 0 THEN ' Yes' WHEN 1 THEN '0' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'n' WHEN 4 THEN 'maybe' WHEN 5 THEN '' END AS raw, (event_id % 25) / 10.0 AS distance, (user_id % 35) / 10.0 AS widest FROM events),
    t AS (SELECT CASE WHEN lower(trim(raw)) IN ('1', 'true', 'yes', 'y') THEN '1' WHEN lower(trim(raw)) IN ('0', 'false', 'no', 'n') THEN '0' ELSE '' END AS token,
        CASE WHEN distance <= 1.0 AND widest <= 1.5 THEN 'good' WHEN distance <= 1.5 AND widest <= 2.5 THEN 'acceptable' ELSE 'weak' END AS grade, 'MC-' || upper(substr(sha256(event_id || '|' || user_id), 1, 16)) AS id FROM r)
    SELECT token, grade, count(*) AS n, min(id) AS first_id FROM t GROUP BY ALL""")
def match_grades(spark, sf_dir):
    """Matches by grade and tri-state flag, named by what they join."""
    turn = F.col("event_id") % 7
    raw = F.when(turn == 0, " Yes").when(turn == 1, "0").when(turn == 2, "TRUE").when(turn == 3, "n").when(turn == 4, "maybe").when(turn == 5, "")
    grade = fields.match_grade((F.col("event_id") % 25) / 10.0, (F.col("user_id") % 35) / 10.0)
    t = table(spark, sf_dir, "events").select(fields.truth(raw).alias("token"), grade.alias("grade"), fields.short_id("MC-", F.col("event_id"), F.col("user_id")).alias("id"))
    return t.groupBy("token", "grade").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("""WITH t AS (SELECT concat(l_linestatus, ';', l_returnflag, ' ', l_linestatus, '|', CAST(l_linenumber AS VARCHAR), '/', l_returnflag) AS raw FROM lineitem)
    SELECT array_to_string(list_sort(list_distinct(string_split(regexp_replace(raw, '[\\s,;|/]', '', 'g'), ''))), '') AS codes, count(*) AS n FROM t GROUP BY ALL""")
def condition_sets(spark, sf_dir):
    """Trades by the set of their condition characters, compact or separated."""
    raw = F.concat("l_linestatus", F.lit(";"), "l_returnflag", F.lit(" "), "l_linestatus", F.lit("|"), F.col("l_linenumber").cast("string"), F.lit("/"), "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy(F.array_join(fields.code_set(raw), "").alias("codes")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT event_type, strftime(ts, '%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.123456' ELSE '.1234567' END AS clock FROM events),
    m AS (SELECT event_type, length(regexp_extract(clock, '\\.(\\d+)', 1)) AS digits, CAST(split_part(clock, ':', 1) AS BIGINT) * 3600000000 + CAST(split_part(clock, ':', 2) AS BIGINT) * 60000000 + CAST(round(CAST(split_part(clock, ':', 3) AS DOUBLE) * 1e6) AS BIGINT) AS micros FROM c)
    SELECT event_type, digits, digits > 6 AS too_fine, count(*) AS n, min(micros) AS earliest, max(micros) AS latest, count(*) FILTER (micros BETWEEN 14400000000 AND 72000000000) AS extended FROM m GROUP BY ALL""")
def clock_fractions(spark, sf_dir):
    """Clock texts as microseconds: how fine they are, and how many lie between 04:00 and 20:00."""
    turn = F.col("event_id") % 4
    clock = F.concat(F.date_format("ts", "HH:mm:ss"), F.when(turn == 0, "").when(turn == 1, ".5").when(turn == 2, ".123456").otherwise(".1234567"))
    m = table(spark, sf_dir, "events").select("event_type", fields.fraction_digits(clock).cast("long").alias("digits"), fields.clock_micros(clock).alias("micros"))
    return m.groupBy("event_type", "digits").agg((F.col("digits") > 6).alias("too_fine"), F.count(F.lit(1)).alias("n"), F.min("micros").alias("earliest"), F.max("micros").alias("latest"), _n("micros BETWEEN 14400000000 AND 72000000000", "extended"))


@query("""WITH q AS (SELECT user_id % 10 AS desk, CAST(event_id AS DOUBLE) AS bid, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id + event_id % 7 AS DOUBLE) END AS ask, CAST(event_id + event_id % 211 - 80 AS DOUBLE) AS now, (event_id % 900 - 100) / 200.0 AS iv FROM events),
    a AS (SELECT desk, ask IS NOT NULL AND now - bid BETWEEN 0 AND 120 AND now - ask BETWEEN 0 AND 120 AS recent, CASE WHEN ask IS NOT NULL AND greatest(bid, ask) <= now + 60 THEN greatest(0.0, now - least(bid, ask)) END AS age, CASE WHEN iv > 0 AND iv <= 3 THEN iv END AS iv FROM q)
    SELECT desk, count(*) AS quotes, count(*) FILTER (age IS NULL) AS unusable, count(*) FILTER (recent) AS fresh, max(age) AS oldest, count(iv) AS priced, max(iv) AS highest FROM a GROUP BY ALL""")
def two_sided_ages(spark, sf_dir):
    """Ages of two-sided quotes, the older side counting, and volatilities that are no percentages."""
    e = F.col("event_id")
    bid, ask, now = e.cast("double"), F.when(e % 13 != 0, (e + e % 7).cast("double")), (e + e % 211 - 80).cast("double")
    a = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("desk"), fields.two_sided_age(bid, ask, now).alias("age"), (fields.fresh(now, bid) & fields.fresh(now, ask)).alias("recent"), fields.fraction_iv((e % 900 - 100) / 200.0).alias("iv"))
    return a.groupBy("desk").agg(F.count(F.lit(1)).alias("quotes"), _n("age IS NULL", "unusable"), _n("recent", "fresh"), F.max("age").alias("oldest"), F.count("iv").alias("priced"), F.max("iv").alias("highest"))


@query("""WITH b AS (SELECT event_type, ts > date_trunc('hour', ts) + INTERVAL 50 MINUTE AS late, CASE WHEN event_id % 41 = 0 THEN -1.0 ELSE 100.0 + event_id % 9 END AS o, 100.0 + user_id % 9 AS c, event_id % 50 AS k, CASE WHEN event_id % 23 <> 0 THEN event_id % 60 - 1 END AS v FROM events),
    x AS (SELECT event_type, late, o, c, v, greatest(o, c) + k - 1 AS h, least(o, c) - k + 1 AS l FROM b)
    SELECT event_type, CASE WHEN late THEN 'time' WHEN NOT (o > 0 AND h > 0 AND l > 0 AND c > 0) THEN 'prices' WHEN l > least(o, c) OR h < greatest(o, c) THEN 'bounds' WHEN v IS NULL OR v < 0 THEN 'volume' ELSE 'good' END AS fault, count(*) AS n FROM x GROUP BY ALL""")
def bar_faults(spark, sf_dir):
    """Bars by the first rule that they break."""
    e, k = F.col("event_id"), F.col("event_id") % 50
    o, c = F.when(e % 41 == 0, -1.0).otherwise(100.0 + e % 9), 100.0 + F.col("user_id") % 9
    volume = F.when(e % 23 != 0, e % 60 - 1)
    decision = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(50))
    faults = fields.bar_faults(F.col("ts"), decision, o, F.greatest(o, c) + k - 1, F.least(o, c) - k + 1, c, volume)
    return table(spark, sf_dir, "events").groupBy("event_type", F.coalesce(quality.first_reason(faults), F.lit("good")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT user_id, event_id, strftime(ts, '%H:%M') AS s FROM events),
    p AS (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 'open;bad' ELSE '16:00-17:00;' || s || '-18:00;x' END AS packed, s FROM w),
    m AS (SELECT user_id, CASE WHEN packed <> 'open;bad' THEN least(960, CAST(substr(s, 1, 2) AS INT) * 60 + CAST(substr(s, 4, 2) AS INT)) END AS start FROM p)
    SELECT user_id, count(*) AS n, count(*) FILTER (start IS NULL) AS whole_days, min(start) AS earliest, max(start) AS latest FROM m GROUP BY ALL""")
def interval_cutoffs(spark, sf_dir):
    """Minute at which the earliest of a row's packed windows starts; rows without one run to the day's end."""
    packed = F.when(F.col("event_id") % 5 == 0, "open;bad").otherwise(F.concat(F.lit("16:00-17:00;"), F.date_format("ts", "HH:mm"), F.lit("-18:00;x")))
    m = table(spark, sf_dir, "events").select("user_id", fields.earliest_start(packed).alias("start"))
    return m.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), _n("start IS NULL", "whole_days"), F.min("start").alias("earliest"), F.max("start").alias("latest"))


@query("""WITH c AS (SELECT l_orderkey AS id, CAST(l_discount AS DOUBLE) / 3 AS iv, l_partkey % 150 AS at FROM lineitem WHERE l_linenumber = 1), d AS (SELECT l_orderkey AS id, CAST(l_discount AS DOUBLE) / 3 AS iv, l_partkey % 150 AS at FROM lineitem WHERE l_linenumber = 2),
    j AS (SELECT id % 10 AS desk, abs(c.iv - d.iv) <= 0.005 AS iv_ok, abs(c.at - d.at) <= 60 AS time_ok FROM c LEFT JOIN d USING (id))
    SELECT desk, count(*) AS n, count(*) FILTER (iv_ok IS NULL) AS one_sided, count(*) FILTER (iv_ok) AS iv_concordant, count(*) FILTER (time_ok) AS time_concordant, count(*) FILTER (iv_ok AND time_ok) AS corroborated FROM j GROUP BY ALL""")
def sources_agree(spark, sf_dir):
    """A chain's values against those asked for singly: within a minute, and within 0.005."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    side = lambda k, name: l.filter(F.col("l_linenumber") == k).select(F.col("l_orderkey").alias("id"), (F.col("l_discount").cast("double") / 3).alias(f"{name}_iv"), (F.col("l_partkey") % 150).alias(f"{name}_at"))
    j = side(1, "c").join(side(2, "d"), "id", "left").select((F.col("id") % 10).alias("desk"), (F.abs(F.col("c_iv") - F.col("d_iv")) <= 0.005).alias("iv_ok"), (F.abs(F.col("c_at") - F.col("d_at")) <= 60).alias("time_ok"))
    return j.groupBy("desk").agg(F.count(F.lit(1)).alias("n"), _n("iv_ok IS NULL", "one_sided"), _n("iv_ok", "iv_concordant"), _n("time_ok", "time_concordant"), _n("iv_ok AND time_ok", "corroborated"))


@query("""WITH g AS (SELECT l_orderkey, count(*) FILTER (l_linenumber <= 4) AS legs, max(l_partkey % 90) - min(l_partkey % 90) AS skew,
        max(CAST(l_quantity AS DOUBLE)) FILTER (l_linenumber = 1) AS tb, max(CAST(l_quantity AS DOUBLE)) FILTER (l_linenumber = 2) AS ts, max(CAST(l_quantity AS DOUBLE)) FILTER (l_linenumber = 3) AS cb, max(CAST(l_quantity AS DOUBLE)) FILTER (l_linenumber = 4) AS cs
        FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
    s AS (SELECT *, CASE WHEN skew > 45 THEN 'CLOCK_SKEW' WHEN legs < 4 THEN 'MISSING_LEGS' ELSE 'ALL_LEGS' END AS reason FROM g)
    SELECT reason, count(*) AS n, CASE WHEN reason = 'ALL_LEGS' THEN sum((tb + 0.5 - ts) * 100) END AS target_debit, CASE WHEN reason = 'ALL_LEGS' THEN sum((tb - ts - 0.5) * 100) END AS target_credit, CASE WHEN reason = 'ALL_LEGS' THEN sum((cb + 0.5 - cs) * 100) END AS control_debit FROM s GROUP BY reason""")
def pair_legs(spark, sf_dir):
    """Four legs by one grouping: what a pair costs and brings, if all are there and their clocks lie close."""
    l = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4")  # noqa: E741
    leg = lambda k, name: F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity").cast("double"))).alias(name)
    clock = F.col("l_partkey") % 90
    g = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("legs"), (F.max(clock) - F.min(clock)).alias("skew"), leg(1, "tb"), leg(2, "ts"), leg(3, "cb"), leg(4, "cs"))
    reason = F.when(F.col("skew") > 45, "CLOCK_SKEW").when(F.col("legs") < 4, "MISSING_LEGS").otherwise("ALL_LEGS")
    value = lambda e, name: F.sum(F.when(F.col("reason") == "ALL_LEGS", F.expr(e) * 100)).alias(name)
    return g.withColumn("reason", reason).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), value("tb + 0.5D - ts", "target_debit"), value("tb - ts - 0.5D", "target_credit"), value("cb + 0.5D - cs", "control_debit"))


@query("""WITH k AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS ranks, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem WHERE l_quantity > 5 GROUP BY ALL)
    SELECT CASE WHEN ranks < n THEN 'duplicate' WHEN low <> 1 OR high <> n THEN 'gap' ELSE 'contiguous' END AS ranking, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_in FROM k GROUP BY ALL""")
def rank_gate(spark, sf_dir):
    """Groups whose ranks are 1 to k: told by their count, least and greatest, without a list."""
    k = table(spark, sf_dir, "lineitem").filter("l_quantity > 5").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("ranks"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    ranking = F.when(F.expr("ranks < n"), "duplicate").when(F.expr("low <> 1 OR high <> n"), "gap").otherwise("contiguous")
    return k.groupBy(ranking.alias("ranking")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows_in"))


@query("""WITH r AS (SELECT o_custkey % 20 AS design, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS complete, o_orderstatus IN ('F', 'O') AS filled, o_orderstatus = 'P' AS pending FROM orders),
    g AS (SELECT design, count(*) AS selected, count(*) FILTER (filled) AS entries, count(*) FILTER (complete) AS complete, count(*) FILTER (pending) AS pending, coalesce(CAST(max(day) FILTER (complete) - min(day) FILTER (complete) AS BIGINT), 0) AS span, count(DISTINCT date_trunc('week', day)) FILTER (complete) AS weeks FROM r GROUP BY ALL)
    SELECT design, selected, entries, complete, pending, span, weeks, round(complete / nullif(entries, 0)::DOUBLE, 6) AS completion, CASE WHEN complete >= 30 AND span >= 90 AND weeks >= 12 AND complete >= 0.4 * entries AND pending = 0 THEN 'READY' ELSE 'COLLECTING' END AS state FROM g""")
def evidence_progress(spark, sf_dir):
    """How far the evidence of each design has come, against all its minima at once."""
    status, day = F.col("o_orderstatus"), F.to_date("o_orderdate")
    done = F.when(status == "F", day)
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("design")).agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(status.isin("F", "O")).alias("entries"), F.count_if(status == "F").alias("complete"), F.count_if(status == "P").alias("pending"),
        F.coalesce(F.date_diff(F.max(done), F.min(done)).cast("long"), F.lit(0).cast("long")).alias("span"), F.count_distinct(F.date_trunc("week", done)).alias("weeks"))
    ready = F.expr("complete >= 30 AND span >= 90 AND weeks >= 12 AND complete >= 0.4 * entries AND pending = 0")
    return g.withColumns({"completion": F.round(F.try_divide("complete", "entries"), 6), "state": F.when(ready, "READY").otherwise("COLLECTING")})
