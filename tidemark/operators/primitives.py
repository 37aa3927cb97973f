"""The relational primitives that point-in-time operators are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps count as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def carried(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], bucket: Column, *, inclusive: bool = True, forward: bool = False) -> DataFrame:
    """The last value that isn't null up to each row in ``order`` (from it on, with ``forward``), of each of ``values``.

    A key's rows are split by ``bucket``, which must follow the order: what a bucket ends with is one row, those rows
    are carried along per key, and each bucket starts from what the earlier ones left. So a key of any length is
    spread over as many tasks as it has buckets. ``inclusive`` counts the row itself. Null keys are a key.
    """
    near = Window.partitionBy(*keys, "_b").orderBy(*([F.desc(c) for c in order] if forward else order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    parted = df.withColumn("_b", bucket).withColumns({f"_at_{n}": c for n, c in values.items()})
    inside = parted.withColumns({f"_in_{n}": F.last(f"_at_{n}", ignorenulls=True).over(near) for n in values})
    latest = F.min if forward else F.max
    ends = parted.groupBy(*keys, "_b").agg(*(latest(F.when(F.col(f"_at_{n}").isNotNull(), F.struct(*order, F.col(f"_at_{n}").alias("_v")))).alias(f"_end_{n}") for n in values))
    before = Window.partitionBy(*keys).orderBy(F.desc("_b") if forward else "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), *(F.last(f"_end_{n}", ignorenulls=True).over(before)["_v"].alias(f"_start_{n}") for n in values))
    same = F.expr(" AND ".join([*(f"`{k}` <=> _k{i}" for i, k in enumerate(keys)), "_b <=> _kb"]))
    out = inside.join(starts, same).withColumns({n: F.coalesce(f"_in_{n}", f"_start_{n}") for n in values})
    return out.drop("_b", "_kb", *(f"_k{i}" for i in range(len(keys))), *(f"_{x}_{n}" for n in values for x in ("at", "in", "start")))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], *, tolerance_us: int | None = None, forward: bool = False, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each left row the latest right row at or before it (or the first at or after), per key.

    One shuffle: both sides are put in one order per key and the last right row is carried along, so a
    join condition never widens. Of right rows at one instant the largest ``columns`` holds. Rows farther
    than ``tolerance_us`` match nothing. Adds ``columns`` and ``matched_ts``; null keys match null keys.
    Where few keys hold many rows, ``bucket`` (of a timestamp, such as ``F.to_date``) splits them; see ``carried``.
    """
    side = F.struct(F.col(right_ts).alias("matched_ts"), *columns)
    r = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(1 if forward else 0).alias("_side"), side.alias("_hit"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    a = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(0 if forward else 1).alias("_side"), F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"), F.struct("*").alias("_row"))
    both = r.unionByName(a)
    if bucket is None:
        order = [F.desc("_ts"), F.desc("_side"), F.desc("_hit")] if forward else ["_ts", "_side", "_hit"]
        out = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        out = carried(both.withColumnRenamed("_hit", "_own"), keys, ["_ts", "_side", "_own"], {"_hit": F.col("_own")}, bucket(F.col("_ts")), forward=forward)
    out = out.filter("_row IS NOT NULL")
    if tolerance_us is not None:
        close = F.abs(micros("_ts") - micros(F.col("_hit.matched_ts"))) <= tolerance_us
        out = out.withColumn("_hit", F.when(close, F.col("_hit")))
    return out.select("_row.*", "_hit.*")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points within closed spans of the same key; a null end is open."""
    s = spans.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [points[k] == s[f"_{k}"] for k in keys]
    inside = (points[at] >= s[start]) & (points[at] <= F.coalesce(s[end], points[at]))
    condition = inside
    for c in same:
        condition = condition & c
    return points.join(s, condition, how).drop(*(f"_{k}" for k in keys))


def latest_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group in ``order``; Catalyst cuts groups before the shuffle."""
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank_in_group") <= k)


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: Column | None = None) -> DataFrame:
    """Overlapping or touching closed intervals of each key as one; so are those at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.col("_before") if gap is None else F.col("_before") + gap
    marked = df.withColumn("_before", before).withColumn("_new", F.when(F.col("_before").isNull() | (F.col(start) > reach), 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("_island")


def fuse_latest(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Each key's value at its latest time; null and flagged where sources disagree at that time."""
    newest = df.withColumn("_top", F.max(ts).over(Window.partitionBy(*keys))).filter(F.col(ts) == F.col("_top"))
    out = newest.groupBy(*keys).agg(F.max(ts).alias(ts), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("sources"))
    clash = F.col("_lo") != F.col("_hi")
    return out.select(*keys, ts, F.when(~clash, F.col("_lo")).alias(value), F.coalesce(clash, F.lit(False)).alias("conflict"), "sources")


def median(values: Column) -> Column:
    """Median of an array of doubles (mean of the two middle ones); null of an empty one."""
    a, n = F.array_sort(values), F.size(values)
    low, high = F.get(a, F.floor((n - 1) / 2).cast("int")), F.get(a, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)
