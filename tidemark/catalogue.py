"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graph, market, primitives, statistics, tape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(digits: int = 6, **columns) -> list:
    return [F.round(c if not isinstance(c, str) else F.col(c), digits).alias(n) for n, c in columns.items()]


def _tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.trades(table(spark, sf_dir, "events"))


_TAPE = """tape AS (SELECT ts, event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
    event_id AS seq, user_id AS source FROM events)"""
_BARS = _TAPE + """, bars AS (SELECT symbol, date_trunc('hour', ts) AS bucket, count(*) AS trade_count, CAST(sum(size) AS BIGINT) AS volume,
    sum(price * size) AS notional, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close
    FROM tape GROUP BY ALL)"""


# --- bars and flow ------------------------------------------------------------------------------------


@query(f"WITH {_BARS} SELECT symbol, bucket, trade_count, volume, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM bars")
def bars_hourly_ohlcv(spark, sf_dir):
    return market.bars(_tape(spark, sf_dir)).select("symbol", "bucket", "trade_count", "volume", *_r(open="open", high="high", low="low", close="close"))


@query(f"WITH {_BARS} SELECT symbol, bucket, round(notional, 4) AS notional, round(notional / nullif(volume, 0), 4) AS vwap FROM bars")
def bars_vwap(spark, sf_dir):
    return market.bars(_tape(spark, sf_dir)).select("symbol", "bucket", *_r(4, notional="notional", vwap="vwap"))


@query("""SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases,
    round(coalesce(sum(value * 100) FILTER (event_type = 'purchase'), 0), 4) AS notional, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL""")
def bars_conditional_counts(spark, sf_dir):
    bought = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bought).alias("purchases"), F.round(F.coalesce(F.sum(F.when(bought, F.col("value") * 100)), F.lit(0.0)), 4).alias("notional"), F.count_distinct("event_type").alias("kinds"))


@query("""SELECT event_type AS symbol, date_trunc('hour', ts) AS bucket, count(DISTINCT user_id) AS sources, CAST(min(user_id) AS BIGINT) AS first_source FROM events GROUP BY ALL""")
def bars_distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count_distinct("user_id").alias("sources"), F.min("user_id").alias("first_source"))


@query("""SELECT event_type AS symbol, CAST(ts AS DATE) AS day, round(arg_max(value, (ts, event_id)), 6) AS last_value FROM events GROUP BY ALL""")
def bars_daily_last_value(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("last_value"))


_SIGNED = _TAPE + """, step AS (SELECT *, price - lag(price) OVER w AS change FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
    signed AS (SELECT *, coalesce(last_value(CASE WHEN change > 0 THEN 1 WHEN change < 0 THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS sign FROM step)"""


@query(f"WITH {_SIGNED} SELECT seq, symbol, CAST(sign AS INTEGER) AS sign FROM signed")
def tick_rule_sign(spark, sf_dir):
    return market.signed_flow(_tape(spark, sf_dir)).select("seq", "symbol", "sign")


@query(f"""WITH {_SIGNED} SELECT symbol, date_trunc('hour', ts) AS bucket, CAST(sum(CASE WHEN sign > 0 THEN size ELSE 0 END) AS BIGINT) AS buys, CAST(sum(CASE WHEN sign < 0 THEN size ELSE 0 END) AS BIGINT) AS sells,
    round(abs(sum(sign * size)) / nullif(sum(CASE WHEN sign <> 0 THEN size ELSE 0 END), 0), 6) AS imbalance FROM signed GROUP BY ALL""")
def order_imbalance(spark, sf_dir):
    s = market.signed_flow(_tape(spark, sf_dir))
    traded = F.sum(F.when(F.col("sign") != 0, F.col("size")).otherwise(0))
    return s.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.sum(F.when(F.col("sign") > 0, F.col("size")).otherwise(0)).alias("buys"), F.sum(F.when(F.col("sign") < 0, F.col("size")).otherwise(0)).alias("sells"), F.round(F.abs(F.sum(F.col("sign") * F.col("size"))) / F.nullif(traded, F.lit(0)), 6).alias("imbalance"))


@query("""WITH q AS (SELECT event_type AS symbol, ts AS quote_ts, min(value * 0.999) AS bid, min(value * 1.001) AS ask FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
    t AS (SELECT event_id AS seq, event_type AS symbol, ts, value AS price FROM events),
    j AS (SELECT t.*, q.quote_ts, q.bid, q.ask FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts >= q.quote_ts)
    SELECT seq, symbol, CASE WHEN ts - quote_ts <= INTERVAL 30 MINUTE THEN quote_ts END AS quote_ts,
      round(CASE WHEN ts - quote_ts <= INTERVAL 30 MINUTE THEN 2 * abs(price - (bid + ask) / 2) END, 5) AS effective_spread FROM j""")
def effective_spread(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    quotes = e.filter("event_id % 3 = 0").groupBy(F.col("event_type").alias("symbol"), F.col("ts").alias("quote_ts")).agg(F.min(F.col("value") * 0.999).alias("bid"), F.min(F.col("value") * 1.001).alias("ask"))
    trades = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))
    return market.effective_spread(trades, quotes, 30 * 60 * 1_000_000).select("seq", "symbol", F.col("matched_ts").alias("quote_ts"), F.round("effective_spread", 5).alias("effective_spread"))


# --- baselines and windows ----------------------------------------------------------------------------

_BASE = _BARS + """, slots AS (SELECT symbol, CAST(hour(bucket) AS INTEGER) AS slot, CAST(bucket AS DATE) AS date, CAST(volume AS DOUBLE) AS value FROM bars),
    h AS (SELECT *, list(value) OVER w AS history, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std FROM slots
        WINDOW w AS (PARTITION BY symbol, slot ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT *, coalesce(len(history), 0) AS history_n, list_median(history) AS median FROM h),
    b AS (SELECT *, list_median(list_transform(history, lambda x: abs(x - median))) AS mad FROM m)"""


def _baseline(spark, sf_dir):
    return market.baseline(market.daily_slots(market.bars(_tape(spark, sf_dir)), "volume"))


@query(f"""WITH {_BASE} SELECT symbol, slot, date, CAST(history_n AS INTEGER) AS history_n, round(mean, 6) AS mean, round(std, 6) AS std,
    round(CASE WHEN history_n >= 10 AND std > 0 THEN (value - mean) / std END, 5) AS z FROM b""")
def baseline_mean_std(spark, sf_dir):
    return _baseline(spark, sf_dir).select("symbol", "slot", "date", "history_n", *_r(mean="mean", std="std"), F.round("z", 5).alias("z"))


@query(f"WITH {_BASE} SELECT symbol, slot, date, round(median, 6) AS median, round(mad, 6) AS mad FROM b")
def baseline_median_mad(spark, sf_dir):
    return _baseline(spark, sf_dir).select("symbol", "slot", "date", *_r(median="median", mad="mad"))


_ROBUST = "CASE WHEN history_n >= 10 AND mad > 0 THEN 0.6744897501960817 * (value - median) / mad END"


@query(f"WITH {_BASE} SELECT symbol, slot, date, round({_ROBUST}, 5) AS robust_z, round(CASE WHEN history_n >= 10 AND mean <> 0 THEN value / mean END, 5) AS ratio FROM b")
def baseline_robust_z(spark, sf_dir):
    return _baseline(spark, sf_dir).select("symbol", "slot", "date", *_r(5, robust_z="robust_z", ratio="ratio"))


@query(f"""WITH {_BASE} SELECT symbol, CASE WHEN history_n < 10 THEN 'insufficient' WHEN history_n < 21 THEN 'partial' ELSE 'full' END AS status, count(*) AS n FROM b GROUP BY ALL""")
def baseline_status_counts(spark, sf_dir):
    return _baseline(spark, sf_dir).groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BASE} SELECT symbol, slot, date, round({_ROBUST}, 5) AS robust_z, CAST(r AS INTEGER) AS rank_in_group FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs({_ROBUST}) DESC, date, slot) AS r FROM b WHERE abs({_ROBUST}) >= 2) WHERE r <= 10""")
def baseline_outliers_topk(spark, sf_dir):
    flagged = _baseline(spark, sf_dir).filter(F.abs("robust_z") >= 2)
    return primitives.latest_per_group(flagged, ["symbol"], [F.desc(F.abs("robust_z")), F.col("date"), F.col("slot")], 10).select("symbol", "slot", "date", F.round("robust_z", 5).alias("robust_z"), "rank_in_group")


_NEAR = "WINDOW near AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW), prior AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@query(f"WITH {_TAPE} SELECT seq, symbol, count(*) OVER near AS points, round(max(price) OVER near, 6) AS peak, CAST(sum(CASE WHEN price >= 60 THEN 1 ELSE 0 END) OVER near AS BIGINT) AS at_least FROM tape {_NEAR}")
def trail_peak_count(spark, sf_dir):
    return market.trailing(_tape(spark, sf_dir), 900, 60.0, ("points", "peak", "at_least")).select("seq", "symbol", "points", F.round("peak", 6).alias("peak"), "at_least")


@query(f"""WITH {_TAPE}, w AS (SELECT seq, symbol, list(price) OVER near AS p, list(epoch_us(ts) / 6e7) OVER near AS x FROM tape {_NEAR})
    SELECT seq, symbol, round(list_sum(list_transform(p, lambda v, i: (v - list_avg(p)) * (x[i] - list_avg(x)))) / nullif(list_sum(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x)))), 0), 2) AS slope FROM w""")
def trail_slope(spark, sf_dir):
    return market.trailing(_tape(spark, sf_dir), 900, 60.0, ("slope",)).select("seq", "symbol", F.round("slope", 2).alias("slope"))


@query(f"WITH {_TAPE} SELECT seq, symbol, round(price - avg(price) OVER prior, 5) AS acceleration FROM tape {_NEAR}")
def accel_vs_prior(spark, sf_dir):
    return market.trailing(_tape(spark, sf_dir), 900, 60.0, ("acceleration",)).select("seq", "symbol", F.round("acceleration", 5).alias("acceleration"))


@query(f"""WITH {_TAPE} SELECT seq, symbol, round(price / nullif(arg_max(price, (ts, seq)) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts RANGE BETWEEN INTERVAL 20 MINUTE PRECEDING AND INTERVAL 15 MINUTE PRECEDING), 0) - 1, 5) AS lagged_return FROM tape""")
def lagged_return(spark, sf_dir):
    return market.lagged_return(_tape(spark, sf_dir), 900, 300).select("seq", "symbol", F.round("lagged_return", 5).alias("lagged_return"))


@query(f"""WITH {_TAPE}, p AS (SELECT * FROM tape WHERE price > 0), w AS (SELECT seq, symbol, list_sort(list({{'ts': ts, 'seq': seq, 'p': price}}) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW)) AS l FROM p),
    r AS (SELECT *, len(l) AS points, CASE WHEN len(l) >= 3 THEN list_transform(range(2, len(l) + 1), lambda i: ln(l[i].p / l[i - 1].p)) END AS r FROM w)
    SELECT seq, symbol, CAST(points AS INTEGER) AS points, round(list_stddev_samp(r), 5) AS volatility FROM r""")
def realized_vol(spark, sf_dir):
    return market.realized_volatility(_tape(spark, sf_dir), 1800).select("seq", "symbol", "points", F.round("volatility", 5).alias("volatility"))


@query("""WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL),
    r AS (SELECT *, ln(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0)) AS ret FROM d WHERE close > 0)
    SELECT symbol, day, round(CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) END, 5) AS annual FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def trailing_vol_annualised(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close")).filter("close > 0")
    w = Window.partitionBy("symbol").orderBy("day")
    r = d.withColumn("ret", F.log(F.col("close") / F.lag("close").over(w)))
    last = w.rowsBetween(-19, 0)
    return r.select("symbol", "day", F.round(F.when(F.count("ret").over(last) == 20, F.stddev_samp("ret").over(last) * F.sqrt(F.lit(252.0))), 5).alias("annual"))


@query(f"""WITH {_TAPE}, c AS (SELECT seq, symbol, ts, sum(size) OVER w AS cumulative, row_number() OVER w AS nth, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us FROM tape WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq))
    SELECT seq, symbol, CAST(cumulative AS BIGINT) AS cumulative, CAST(nth AS INTEGER) AS nth, gap_us FROM c""")
def cumvolume_delta(spark, sf_dir):
    t = _tape(spark, sf_dir).withColumn("us", primitives.micros("ts"))
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts", "seq")
    return t.select("seq", "symbol", F.sum("size").over(w).alias("cumulative"), F.row_number().over(w).alias("nth"), (F.col("us") - F.lag("us").over(w)).alias("gap_us"))


@query("""SELECT event_type AS symbol, CAST(ts AS DATE) AS day, round(sqrt(sum(greatest(value - 50, 0) * greatest(value - 50, 0))), 4) AS positive_l2 FROM events GROUP BY ALL""")
def positive_l2(spark, sf_dir):
    over = F.greatest(F.col("value") - 50, F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.round(F.sqrt(F.sum(over * over)), 4).alias("positive_l2"))


# --- joins --------------------------------------------------------------------------------------------

_HISTORY = "h AS (SELECT o_custkey AS k, o_orderdate, max(o_totalprice) AS price FROM orders GROUP BY ALL), p AS (SELECT o_orderkey, o_custkey AS k, o_orderdate + INTERVAL 3 DAY AS moment FROM orders)"


def _history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("k"), F.expr("o_orderdate + INTERVAL 3 DAY").alias("at")), o.groupBy(F.col("o_custkey").alias("k"), "o_orderdate").agg(F.max("o_totalprice").alias("price"))


@query(f"WITH {_HISTORY} SELECT p.o_orderkey, h.o_orderdate AS matched_ts, round(h.price, 4) AS price FROM p ASOF LEFT JOIN h ON p.k = h.k AND p.moment >= h.o_orderdate")
def asof_backward(spark, sf_dir):
    p, h = _history(spark, sf_dir)
    return primitives.asof_join(p, h, ["k"], "at", "o_orderdate", ["price"]).select("o_orderkey", "matched_ts", F.round("price", 4).alias("price"))


@query(f"""WITH {_HISTORY}, q AS (SELECT o_orderkey, k, moment - INTERVAL 4 DAY AS moment FROM p), j AS (SELECT q.*, h.o_orderdate, h.price FROM q ASOF LEFT JOIN h ON q.k = h.k AND q.moment >= h.o_orderdate)
    SELECT o_orderkey, CASE WHEN moment - o_orderdate <= INTERVAL 130 DAY THEN round(price, 4) END AS price FROM j""")
def asof_backward_tolerance(spark, sf_dir):
    p, h = _history(spark, sf_dir)
    q = p.withColumn("at", F.expr("at - INTERVAL 4 DAY"))
    return primitives.asof_join(q, h, ["k"], "at", "o_orderdate", ["price"], tolerance_us=130 * 86_400_000_000).select("o_orderkey", F.round("price", 4).alias("price"))


@query(f"WITH {_HISTORY} SELECT p.o_orderkey, h.o_orderdate AS matched_ts FROM p ASOF LEFT JOIN h ON p.k = h.k AND p.moment <= h.o_orderdate")
def asof_forward(spark, sf_dir):
    p, h = _history(spark, sf_dir)
    return primitives.asof_join(p, h, ["k"], "at", "o_orderdate", ["price"], forward=True).select("o_orderkey", "matched_ts")


@query("""WITH h AS (SELECT o_custkey AS k, o_orderpriority AS scope, o_orderdate, max(o_totalprice) AS price FROM orders GROUP BY ALL)
    SELECT o.o_orderkey, h.o_orderdate AS matched_ts FROM orders o ASOF LEFT JOIN h ON o.o_custkey = h.k AND o.o_orderpriority = h.scope AND o.o_orderdate > h.o_orderdate""")
def asof_with_scope(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    h = o.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("scope"), "o_orderdate").agg(F.max("o_totalprice").alias("price"))
    p = o.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("scope"), F.expr("o_orderdate - INTERVAL 1 MICROSECOND").alias("at"))
    return primitives.asof_join(p, h, ["k", "scope"], "at", "o_orderdate", ["price"]).select("o_orderkey", "matched_ts")


_SPANS = "s AS (SELECT l_suppkey, min(l_shipdate) AS valid_from, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE min(l_shipdate) + INTERVAL 400 DAY END AS valid_to FROM lineitem GROUP BY l_suppkey)"


def _spans(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("valid_from"))
    return first.withColumn("valid_to", F.when(F.col("l_suppkey") % 5 != 0, F.expr("valid_from + INTERVAL 400 DAY")))


@query(f"WITH {_SPANS} SELECT l.l_suppkey, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity FROM lineitem l JOIN s ON l.l_suppkey = s.l_suppkey AND l_shipdate >= valid_from AND l_shipdate <= coalesce(valid_to, l_shipdate) GROUP BY ALL")
def interval_join_open_end(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")  # noqa: E741
    return primitives.interval_join(l, _spans(spark, sf_dir), ["l_suppkey"], "l_shipdate", "valid_from", "valid_to").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("quantity"))


@query(f"""WITH {_BARS}, e AS (SELECT event_id, event_type AS symbol, date_trunc('hour', ts) AS moment FROM events WHERE event_type = 'error'),
    g AS (SELECT event_id, symbol, moment, CAST(o AS INTEGER) AS off FROM e, range(-3, 4) r(o))
    SELECT g.event_id, g.off, CAST(b.volume AS BIGINT) AS volume, b.volume IS NOT NULL AS covered FROM g LEFT JOIN bars b ON g.symbol = b.symbol AND b.bucket = g.moment + to_hours(g.off)""")
def event_panel_left_grid(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("at"))
    g = e.select("event_id", "symbol", "at", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("off")).withColumn("bucket", (F.col("at") + F.make_dt_interval(hours="off")).cast("timestamp_ntz"))
    b = market.bars(_tape(spark, sf_dir)).select("symbol", "bucket", "volume")
    return g.join(b, ["symbol", "bucket"], "left").select("event_id", "off", "volume", F.col("volume").isNotNull().alias("covered"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'label only' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'both' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def fullouter_bijection(spark, sf_dir):
    d, l = (table(spark, sf_dir, t).select("doc_id", F.lit(True).alias(f"has_{t}")) for t in ("documents", "labels"))  # noqa: E741
    state = F.when(F.col("has_documents").isNull(), "label only").when(F.col("has_labels").isNull(), "unlabelled").otherwise("both")
    return d.join(l, "doc_id", "full").select("doc_id", state.alias("state"))


@query("""SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE))""")
def anti_positive_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.join(e.filter("event_type = 'purchase'").select("user_id", "day").distinct(), ["user_id", "day"], "left_anti").select("event_id", "user_id", "day")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_required_symbols(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_semi")


_LEGS = "legs AS (SELECT p_type AS expiry, p_size AS strike, min(p_retailprice) AS ask, max(p_retailprice) * 0.99 AS bid FROM part GROUP BY ALL)"


def _legs(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("expiry"), F.col("p_size").alias("strike")).agg(F.min("p_retailprice").alias("ask"), (F.max("p_retailprice") * 0.99).alias("bid"))


@query(f"""WITH {_LEGS} SELECT a.expiry, a.strike AS k1, b.strike AS k2, round(a.ask - b.bid, 4) AS debit, CASE WHEN a.ask - b.bid <= 0 THEN 'no debit' WHEN a.ask - b.bid >= 100 * (b.strike - a.strike) THEN 'debit above width' ELSE 'kept' END AS outcome
    FROM legs a JOIN legs b ON a.expiry = b.expiry AND b.strike > a.strike AND b.strike <= a.strike + 3""")
def self_pair_width(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    near = legs.select("expiry", F.explode(F.array(F.col("strike") - 3, F.col("strike") - 2, F.col("strike") - 1)).alias("k1"), F.col("strike").alias("k2"), "bid")
    debit = F.col("ask") - F.col("bid")
    pairs = legs.select("expiry", F.col("strike").alias("k1"), "ask").join(near, ["expiry", "k1"])
    return pairs.select("expiry", "k1", "k2", F.round(debit, 4).alias("debit"), F.when(debit <= 0, "no debit").when(debit >= 100 * (F.col("k2") - F.col("k1")), "debit above width").otherwise("kept").alias("outcome"))


@query("""WITH c AS (SELECT p_type AS expiry, p_size AS strike, min(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END) AS call_ask, min(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END) AS put_ask FROM part GROUP BY ALL)
    SELECT a.expiry, a.strike AS k1, b.strike AS k2, round(a.call_ask - b.call_ask + b.put_ask - a.put_ask, 4) AS box FROM c a JOIN c b ON a.expiry = b.expiry AND b.strike - a.strike IN (1, 2)
    WHERE a.call_ask IS NOT NULL AND b.call_ask IS NOT NULL AND a.put_ask IS NOT NULL AND b.put_ask IS NOT NULL""")
def box_four_leg(spark, sf_dir):
    even = F.col("p_partkey") % 2 == 0
    c = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("expiry"), F.col("p_size").alias("strike")).agg(F.min(F.when(even, F.col("p_retailprice"))).alias("call"), F.min(F.when(~even, F.col("p_retailprice"))).alias("put")).filter("call IS NOT NULL AND put IS NOT NULL")
    high = c.select("expiry", F.explode(F.array(F.col("strike") - 1, F.col("strike") - 2)).alias("k1"), F.col("strike").alias("k2"), F.col("call").alias("call2"), F.col("put").alias("put2"))
    return c.withColumnRenamed("strike", "k1").join(high, ["expiry", "k1"]).select("expiry", "k1", "k2", F.round(F.col("call") - F.col("call2") + F.col("put2") - F.col("put"), 4).alias("box"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_review_per_case(spark, sf_dir):
    return primitives.latest_per_group(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role")


@query("""WITH n AS (SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS top FROM events)
    SELECT user_id, top AS at, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS event_type, min(event_type) <> max(event_type) AS conflict, count(*) AS sources FROM n WHERE CAST(ts AS DATE) = top GROUP BY user_id, top""")
def fuse_latest_conflict(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("at"), "event_type")
    return primitives.fuse_latest(e, ["user_id"], "at", "event_type")


@query("""WITH need AS (SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), have AS (SELECT p_partkey FROM part WHERE p_size <= 25)
    SELECT o_orderkey, count(*) AS required, count(p_partkey) AS covered, CASE WHEN count(p_partkey) = count(*) THEN 'FULL' WHEN count(p_partkey) = 0 THEN 'UNTOUCHED' ELSE 'PARTIAL' END AS scope FROM need LEFT JOIN have ON l_partkey = p_partkey GROUP BY ALL""")
def coverage_full_partial_untouched(spark, sf_dir):
    need = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct().join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    have = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("has"))
    out = need.join(have, "l_partkey", "left").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("required"), F.count("has").alias("covered"))
    return out.withColumn("scope", F.when(F.col("covered") == F.col("required"), "FULL").when(F.col("covered") == 0, "UNTOUCHED").otherwise("PARTIAL"))


@query("""WITH t AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'), c AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier),
    d AS (SELECT c_custkey, s_suppkey, abs(ln(1 + greatest(c_acctbal, 0)) - ln(1 + greatest(s_acctbal, 0))) AS distance FROM t JOIN c ON c_nationkey = s_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(distance, 9), s_suppkey) AS control_rank, count(*) OVER (PARTITION BY c_custkey) AS pool FROM d WHERE distance <= 3)
    SELECT c_custkey, s_suppkey, CAST(control_rank AS INTEGER) AS control_rank, pool, round(distance, 5) AS distance FROM r WHERE control_rank <= 3 AND pool >= 2""")
def matched_controls(spark, sf_dir):
    t = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    c = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    size = lambda x: F.log1p(F.greatest(F.col(x), F.lit(0.0)))
    d = statistics.nearest_within(t.withColumn("x", size("c_acctbal")), c.withColumn("y", size("s_acctbal")), ["nation"], "x", "y", 3.0, "s_suppkey", 3).filter("pool >= 2")
    return d.select("c_custkey", "s_suppkey", F.col("rank_in_group").alias("control_rank"), "pool", F.round("distance", 5).alias("distance"))


# --- aggregates and evaluation ------------------------------------------------------------------------


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS weighted_discount FROM lineitem WHERE l_quantity > 0 GROUP BY ALL")
def weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 0").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted_discount"))


@query("""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS g, l_quantity, l_extendedprice, l_discount FROM lineitem), u AS (UNPIVOT x ON l_quantity, l_extendedprice, l_discount INTO NAME covariate VALUE v)
    SELECT covariate, round(avg(v) FILTER (g = 1), 4) AS treated_mean, round(avg(v) FILTER (g = 0), 4) AS control_mean,
    round((avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0)) / sqrt((var_samp(v) FILTER (g = 1) + var_samp(v) FILTER (g = 0)) / 2), 5) AS smd FROM u GROUP BY covariate""")
def smd_balance(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("g", (F.col("l_returnflag") == "R").cast("int"))
    return statistics.standardized_difference(x, "g", ["l_quantity", "l_extendedprice", "l_discount"]).select("covariate", *_r(4, treated_mean="treated_mean", control_mean="control_mean"), F.round("smd", 5).alias("smd"))


@query("""WITH m AS (SELECT p_type, median(p_retailprice) AS mid, stddev_samp(p_retailprice) AS s FROM part GROUP BY ALL), d AS (SELECT p.p_type, mid, s, median(abs(p_retailprice - mid)) AS mad FROM part p JOIN m USING (p_type) GROUP BY ALL)
    SELECT p_type, round(mid, 5) AS median, round(CASE WHEN mad > 0 THEN 1.4826 * mad WHEN s > 0 THEN s END, 5) AS scale FROM d""")
def robust_scale(spark, sf_dir):
    return statistics.robust_scale(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice").select("p_type", *_r(5, median="median", scale="scale"))


_SCORED = "scored AS (SELECT o_orderkey AS id, round((o_totalprice % 1000) / 1000, 3) AS score, CASE WHEN o_orderpriority LIKE '1%' OR o_totalprice % 7 < 2 THEN 1 ELSE 0 END AS label FROM orders)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round((F.col("o_totalprice") % 1000) / 1000, 3).alias("score"), (F.col("o_orderpriority").startswith("1") | (F.col("o_totalprice") % 7 < 2)).cast("int").alias("label"))


_CURVE = _SCORED + """, per AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score),
    curve AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM per), tot AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM scored)"""


@query(f"""WITH {_CURVE} SELECT round(sum(neg * (tp - pos / 2)) / max(p * n), 6) AS auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM curve, tot""")
def auc_average_precision(spark, sf_dir):
    return statistics.ranking_metrics(_scored(spark, sf_dir)).select(*_r(auc="auc", average_precision="average_precision"))


@query(f"""WITH {_SCORED} SELECT round(avg((score - label) * (score - label)), 6) AS brier, round(avg(-ln(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1e-15))), 6) AS log_loss, CAST(sum(label) AS BIGINT) AS positives FROM scored""")
def brier_logloss(spark, sf_dir):
    return statistics.ranking_metrics(_scored(spark, sf_dir)).select(*_r(brier="brier", log_loss="log_loss"), "positives")


@query(f"WITH {_CURVE}, r AS (SELECT score, tp / p AS recall, fp / n AS fpr FROM curve, tot) SELECT round(score, 6) AS score, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM r WHERE fpr <= 0.05 ORDER BY recall DESC, score LIMIT 1")
def threshold_fpr_cap(spark, sf_dir):
    return statistics.threshold_at(_scored(spark, sf_dir), 0.05).select(*_r(score="score", recall="recall", fpr="fpr"))


@query("""WITH r AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10 / (SELECT count(*) FROM orders)) AS INTEGER) + 1 AS bin FROM orders)
    SELECT bin, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS rate FROM r GROUP BY bin""")
def quantile_bins_lift(spark, sf_dir):
    b = statistics.equal_count_bins(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 10)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("rate"))


@query("""SELECT year(l_shipdate) AS year, round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R'), 5) AS separation, count(*) AS n FROM lineitem GROUP BY ALL""")
def stability_by_dim(spark, sf_dir):
    r = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(F.round(F.avg(F.when(r, F.col("l_quantity"))) - F.avg(F.when(~r, F.col("l_quantity"))), 5).alias("separation"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT event_type, hour(ts) AS h, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, CAST(h AS INTEGER) AS hour, round(m, 5) AS mean, round(m / nullif(max(m) OVER (PARTITION BY event_type), 0), 5) AS of_peak FROM a""")
def decay_fraction_of_peak(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.avg("value").alias("m"))
    return a.select("event_type", "hour", *_r(5, mean="m", of_peak=F.col("m") / F.nullif(F.max("m").over(Window.partitionBy("event_type")), F.lit(0.0))))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 5) AS quantity_price, round(corr(l_quantity, l_discount), 5) AS quantity_discount, round(corr(l_extendedprice, l_tax), 5) AS price_tax FROM lineitem""")
def pairwise_corr(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(*_r(5, quantity_price=F.corr("l_quantity", "l_extendedprice"), quantity_discount=F.corr("l_quantity", "l_discount"), price_tax=F.corr("l_extendedprice", "l_tax")))


@query("""SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (year(o_orderdate)))""")
def grouping_sets_report(spark, sf_dir):
    table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")).createOrReplaceTempView("_orders_by_year")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM _orders_by_year GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (year))")


@query("""WITH n AS (SELECT l_suppkey, count(DISTINCT (l_partkey, date_trunc('month', l_shipdate))) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, n, round(greatest(least(n, 100), 0) * 1.0::DOUBLE + greatest(least(n, 300) - 100, 0) * 0.8::DOUBLE + greatest(n - 300, 0) * 0.5::DOUBLE, 4) AS cost FROM n""")
def tiered_pricing(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey", F.date_trunc("month", "l_shipdate")).alias("n"))
    return n.withColumn("cost", F.round(statistics.tiered_cost(n, "n", [(0, 100, 1.0), (100, 300, 0.8), (300, None, 0.5)]), 4))


@query("""WITH g AS (SELECT event_type, CASE WHEN value < 10 THEN '<10' WHEN value < 50 THEN '10-50' WHEN value < 100 THEN '50-100' ELSE '100+' END AS bin, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS fraction FROM g""")
def hist_fraction_bins(spark, sf_dir):
    v = F.col("value")
    g = table(spark, sf_dir, "events").groupBy("event_type", F.when(v < 10, "<10").when(v < 50, "10-50").when(v < 100, "50-100").otherwise("100+").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))


@query("""SELECT n_name, count(*) AS customers, round(median(c_acctbal), 4) AS median, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, round(avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0 END), 6) AS above FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def cost_summary_percentiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), *_r(4, median=F.percentile("c_acctbal", 0.5), p90=F.percentile("c_acctbal", 0.9)), F.round(F.avg((F.col("c_acctbal") > 5000).cast("double")), 6).alias("above"))


# --- sets, intervals and state ------------------------------------------------------------------------


@query("SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS kind FROM customer JOIN orders ON c_custkey = o_custkey EXCEPT SELECT s_nationkey, 'BUILDING' FROM supplier")
def required_minus_covered(spark, sf_dir):
    need = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"))
    return need.distinct().subtract(table(spark, sf_dir, "supplier").select("s_nationkey", F.lit("BUILDING")))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def pool_intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


_SHIP = "s AS (SELECT l_suppkey AS k, l_shipdate AS a, l_shipdate + to_days(CAST(l_quantity AS INTEGER) % 5) AS b FROM lineitem)"


def _ship(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("a"), (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int") % 5)).alias("b"))


@query(f"""WITH {_SHIP}, m AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a - INTERVAL 1 DAY) THEN 1 ELSE 0 END AS fresh FROM s),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT k, min(a) AS a, max(b) AS b, count(*) AS parts FROM i GROUP BY k, island""")
def merge_intervals(spark, sf_dir):
    return primitives.merge_intervals(_ship(spark, sf_dir), ["k"], "a", "b")


@query(f"""WITH {_SHIP}, e AS (SELECT k, a AS moment, 1 AS kind, 1 AS d FROM s UNION ALL SELECT k, b, 0, -1 FROM s) SELECT k, CAST(max(o) AS BIGINT) AS peak FROM (SELECT k, sum(d) OVER (PARTITION BY k ORDER BY moment, kind, d ROWS UNBOUNDED PRECEDING) AS o FROM e) GROUP BY k""")
def exposure_sweep_peak(spark, sf_dir):
    return tape.exposure_peak(_ship(spark, sf_dir).withColumn("n", F.lit(1).cast("long")), "k", "a", "b", "n")


@query("""WITH g AS (SELECT o_custkey, CAST(round((o_totalprice % 200 - 100) * 100) AS BIGINT) AS gain, o_orderdate, o_orderkey FROM orders), r AS (SELECT *, sum(gain) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM g),
    h AS (SELECT *, greatest(max(run) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS high FROM r) SELECT o_custkey, CAST(sum(gain) AS BIGINT) AS total, CAST(max(high - run) AS BIGINT) AS drawdown FROM h GROUP BY ALL""")
def drawdown(spark, sf_dir):
    g = table(spark, sf_dir, "orders").withColumn("gain", F.round((F.col("o_totalprice") % 200 - 100) * 100).cast("long"))
    return tape.drawdown(g, "o_custkey", ["o_orderdate", "o_orderkey"], "gain")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
    SELECT user_id, CAST(count(*) FILTER (gap > 3600000000) AS BIGINT) AS gaps, CAST(count(*) FILTER (gap = 0) AS BIGINT) AS duplicates FROM g GROUP BY ALL""")
def gap_duplicate_counts(spark, sf_dir):
    us = primitives.micros("ts")
    g = table(spark, sf_dir, "events").select("user_id", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap"))
    return g.groupBy("user_id").agg(F.count_if(F.col("gap") > 3_600_000_000).alias("gaps"), F.count_if(F.col("gap") == 0).alias("duplicates"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), n AS (SELECT day, lag(day, 3) OVER (ORDER BY day) AS prior_3, dense_rank() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM d)
    SELECT day, prior_3, CASE WHEN r <= floor(n * 0.7) THEN 'development' WHEN r <= floor(n * 0.7) + 2 THEN 'embargo' ELSE 'holdout' END AS part FROM n""")
def session_prior_n(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    w = Window.orderBy("day")  # one row per calendar day
    n = d.select("day", F.lag("day", 3).over(w).alias("prior_3"), F.dense_rank().over(w).alias("r"), F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    cut = F.floor(F.col("n") * 0.7)
    return n.select("day", "prior_3", F.when(F.col("r") <= cut, "development").when(F.col("r") <= cut + 2, "embargo").otherwise("holdout").alias("part"))


_REPLAY = "e AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS source, ts + to_hours(CAST(event_id % 50 AS INTEGER)) AS available FROM events), x AS (SELECT *, greatest(ts, available) AS replay_ts FROM e)"


def _replayed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_ts"), F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("sequence"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 50).cast("int"))).alias("available_at"))
    return tape.replay(e, "2024-01-25 00:00:00")


@query(f"WITH {_REPLAY} SELECT event_id, replay_ts, row_number() OVER (ORDER BY replay_ts, ts, source, event_id) AS ordinal FROM x WHERE replay_ts <= TIMESTAMP '2024-01-25'")
def tape_order(spark, sf_dir):
    return tape.replay_order(_replayed(spark, sf_dir).filter("NOT deferred")).select("event_id", "replay_ts", "ordinal")


@query(f"WITH {_REPLAY} SELECT source, count(*) FILTER (replay_ts > TIMESTAMP '2024-01-25') AS deferred, count(*) AS n FROM x GROUP BY ALL")
def tape_deferral(spark, sf_dir):
    return _replayed(spark, sf_dir).groupBy("source").agg(F.count_if("deferred").alias("deferred"), F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn, sha256(coalesce(role, '') || '|' || coalesce(text, '')) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sha256(coalesce(role, '') || '|' || coalesce(text, ''))) AS i FROM conversations),
    c AS (SELECT conv_id, turn, i, '' AS previous_hash, sha256('|' || h) AS record_hash FROM p WHERE i = 1 UNION ALL SELECT p.conv_id, p.turn, p.i, c.record_hash, sha256(c.record_hash || '|' || p.h) FROM p JOIN c ON p.conv_id = c.conv_id AND p.i = c.i + 1)
    SELECT conv_id, turn, previous_hash, record_hash FROM c""")
def hash_chain_verify(spark, sf_dir):
    """The ledger of each conversation: every record over the one before it."""
    return tape.chain(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"]).select("conv_id", "turn", "previous_hash", "record_hash")


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn, sha256(coalesce(role, '') || '|' || coalesce(text, '')) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sha256(coalesce(role, '') || '|' || coalesce(text, ''))) AS i FROM conversations),
    c AS (SELECT conv_id, i, sha256('|' || h) AS record_hash FROM p WHERE i = 1 UNION ALL SELECT p.conv_id, p.i, sha256(c.record_hash || '|' || p.h) FROM p JOIN c ON p.conv_id = c.conv_id AND p.i = c.i + 1)
    SELECT conv_id, arg_max(record_hash, i) AS head, max(i) AS records FROM c GROUP BY conv_id""")
def ledger_append(spark, sf_dir):
    """The last record of each conversation's ledger, its replies appended in a second load to what the first left behind."""
    c = table(spark, sf_dir, "conversations")
    last = lambda df: df.groupBy("conv_id").agg(F.max_by("record_hash", F.struct("turn", "payload_hash")).alias("record_hash"), F.count(F.lit(1)).alias("n"))
    half = c.groupBy("conv_id").agg((F.max("turn") / 2).alias("half"))
    parted = c.join(half, "conv_id")
    first = last(tape.chain(parted.filter("turn <= half"), "conv_id", "turn", ["role", "text"]))
    then = last(tape.chain(parted.filter("turn > half"), "conv_id", "turn", ["role", "text"], heads=first))
    both = first.withColumnsRenamed({"record_hash": "old", "n": "was"}).join(then, "conv_id", "full")
    return both.select("conv_id", F.coalesce("record_hash", "old").alias("head"), (F.coalesce("was", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("records"))


_NBBO = ", ".join(f"last_value(CASE WHEN venue = '{v}' THEN bid END IGNORE NULLS) OVER w AS bid_{v}, last_value(CASE WHEN venue = '{v}' THEN ask END IGNORE NULLS) OVER w AS ask_{v}" for v in ("click", "error", "view"))


@query(f"""WITH q AS (SELECT event_id, user_id, ts, event_type AS venue, value * 0.99 AS bid, value * 1.02 AS ask FROM events WHERE event_type IN ('click', 'error', 'view')),
    s AS (SELECT event_id, {_NBBO} FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT event_id, greatest(bid_click, bid_error, bid_view) AS best_bid, least(ask_click, ask_error, ask_view) AS best_ask FROM s)
    SELECT event_id, round(best_bid, 5) AS best_bid, round(best_ask, 5) AS best_ask, CASE WHEN best_bid > best_ask THEN 'crossed' WHEN best_bid = best_ask THEN 'locked' ELSE 'regular' END AS state FROM b""")
def nbbo_best(spark, sf_dir):
    q = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error", "view")).select("event_id", "user_id", "ts", F.col("event_type").alias("venue"), (F.col("value") * 0.99).alias("bid"), (F.col("value") * 1.02).alias("ask"))
    best = market.best_quotes(q, "user_id", ["ts", "event_id"], ["click", "error", "view"])
    return best.select("event_id", *_r(5, best_bid="best_bid", best_ask="best_ask"), "state")


@query()
def order_book_exec(spark, sf_dir):
    """Executions of a price-level book per user: adds rest, purchases execute against them, errors cancel."""
    kind = F.when(F.col("event_type") == "purchase", "execute").when(F.col("event_type") == "error", "cancel").otherwise("add")
    steps = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("size"), "value")
    return market.book_executions(steps, "user_id")


@query()
def lr_scores(spark, sf_dir):
    """Logistic regression of returned lines on earlier years, scored on later ones."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", (F.col("l_returnflag") == "R").cast("double").alias("label"))  # noqa: E741
    return statistics.time_split_logistic(l, "l_shipdate", "1996-01-01", ["l_quantity", "l_extendedprice", "l_discount"], ["l_orderkey", "l_linenumber"])


@query("""WITH d AS (SELECT o_custkey, o_orderdate, o_totalprice, lag(o_totalprice) OVER w AS prior, lead(o_totalprice) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    t AS (SELECT CASE WHEN o_totalprice > prior THEN 'up' ELSE 'down' END AS signal, later / o_totalprice - 1 AS outcome FROM d WHERE prior IS NOT NULL AND later IS NOT NULL), c AS (SELECT unnest([0.0, 5.0, 10.0]) AS bps)
    SELECT signal, CAST(bps AS INTEGER) AS bps, count(*) AS n, round(avg(outcome - bps / 1e4), 5) AS mean, round(avg(CASE WHEN outcome > bps / 1e4 THEN 1.0 ELSE 0 END), 6) AS win FROM t, c GROUP BY ALL""")
def scenario_cube(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = table(spark, sf_dir, "orders").withColumns({"prior": F.lag("o_totalprice").over(w), "later": F.lead("o_totalprice").over(w)}).filter("prior IS NOT NULL AND later IS NOT NULL")
    t = d.select(F.when(F.col("o_totalprice") > F.col("prior"), "up").otherwise("down").alias("signal"), (F.col("later") / F.col("o_totalprice") - 1).alias("outcome"), F.explode(F.array(F.lit(0), F.lit(5), F.lit(10))).alias("bps"))
    return t.groupBy("signal", "bps").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("outcome") - F.col("bps") / 1e4), 5).alias("mean"), F.round(F.avg((F.col("outcome") > F.col("bps") / 1e4).cast("double")), 6).alias("win"))


@query("""SELECT conv_id, string_agg(role || '@' || turn, ';' ORDER BY turn) AS packed, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def packed_points(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"), F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return c.select("conv_id", F.array_join(F.transform("l", lambda x: F.concat(x["role"], F.lit("@"), x["turn"].cast("string"))), ";").alias("packed"), "turns", "first_turn", "last_turn")


@query("""SELECT c_mktsegment, count(*) AS n, bool_and(c_acctbal > -1000) AS all_above, bool_or(c_acctbal > 9000) AS any_rich, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS negative FROM customer GROUP BY ALL""")
def gate_conjunctions(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("c_acctbal") > -1000).alias("all_above"), F.bool_or(F.col("c_acctbal") > 9000).alias("any_rich"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))


# --- graph --------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 0.9 AS c FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.8 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.7 FROM supplier),
    b AS (SELECT src, dst, max(c) AS c FROM (SELECT src, dst, c FROM e UNION ALL SELECT dst, src, c FROM e) GROUP BY ALL),
    h1 AS (SELECT dst AS node, c AS conf FROM b WHERE src = 'r0'), h2 AS (SELECT dst AS node, max(conf * c * 0.92) AS conf FROM h1 JOIN b ON src = node WHERE dst <> 'r0' AND dst NOT IN (SELECT node FROM h1) GROUP BY dst)
    SELECT 'r0' AS node, 0 AS hop, 1.0::DOUBLE AS confidence UNION ALL SELECT node, 1, round(conf::DOUBLE, 6) FROM h1 UNION ALL SELECT node, 2, round(conf::DOUBLE, 6) FROM h2""")
def bfs_khop(spark, sf_dir):
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    e = c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit(0.9).alias("confidence")).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit(0.8))).union(s.select(name("s", "s_suppkey"), name("n", "s_nationkey"), F.lit(0.7)))
    return graph.expand(e, spark.createDataFrame([("r0",)], "node string"), 2).select("node", "hop", F.round("confidence", 6).alias("confidence"))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS g, date_trunc('month', o_orderdate) AS i FROM orders WHERE o_orderpriority LIKE '1%'), n AS (SELECT g, count(*) AS n FROM m GROUP BY g),
    s AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM m a JOIN m b ON a.i = b.i AND a.g < b.g GROUP BY ALL)
    SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS similarity FROM s JOIN n x ON a = x.g JOIN n y ON b = y.g WHERE shared / (x.n + y.n - shared) >= 0.5""")
def jaccard_sig(spark, sf_dir):
    m = table(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("g"), F.date_trunc("month", "o_orderdate").alias("i"))
    return graph.set_similarity(m, "g", "i", 0.5).withColumn("similarity", F.round("similarity", 6))


# --- TPC-H shapes -------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


from . import desk, research, surveillance  # noqa: E402, F401  register their queries
