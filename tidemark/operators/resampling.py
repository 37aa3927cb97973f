"""Intervals of means by resampling whole blocks of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How the two ends are read off the sorted means of the repetitions.
RULES = ("rank_of_n", "rank_of_n_less_one", "interpolated")


def draw(seed: int, repetition: Column, slot: Column, n: Column) -> Column:
    """A whole number below ``n`` from a counter: the first 32 bits of an MD5 over seed, repetition and slot."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(seed), repetition.cast("string"), slot.cast("string"))), 1, 8)
    return F.pmod(F.conv(hexed, 16, 10).cast("long"), n)


def numbered_blocks(blocks: DataFrame, keys: list[str], block: str, parts: int = 64) -> DataFrame:
    """``slot`` from 0 in order of hash and block, and ``blocks``, how many there are of each key; no key is ordered in one task."""
    parted = blocks.withColumn("_h", F.md5(F.col(block).cast("string"))).withColumn("_part", F.pmod(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), F.lit(parts)))
    counts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*keys)  # at most ``parts`` rows of a key
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(whole).alias("blocks"))
    inside = parted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", block)) - 1)
    return inside.join(starts, [*keys, "_part"]).withColumn("slot", F.col("_start") + F.col("_r")).drop("_h", "_part", "_r", "_start")


def block_bootstrap(df: DataFrame, keys: list[str], block: Column, value: Column, *, repetitions: int, seed: int, rule: str = "rank_of_n", least_blocks: int = 1, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``keys``, blocks, n, mean, low, high: a row per key.

    Each repetition draws as many blocks as there are, with replacement, and takes the mean of all their
    values. Only (sum, count) of a block travels; every block makes one draw per repetition, which meets the block
    of that number by an equi-join. Ends are null where a key has fewer than ``least_blocks`` blocks. Null values count nowhere;
    sums are kept as decimals of six places, so that reruns and other partitions agree.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    keyed = keys or ["_all"]
    given = df if keys else df.withColumn("_all", F.lit(1))
    sums = given.select(*keyed, block.alias("_block"), value.cast("double").cast("decimal(28,6)").alias("_v")).filter("_v IS NOT NULL").groupBy(*keyed, "_block").agg(F.sum("_v").cast("decimal(38,6)").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    placed = numbered_blocks(sums, keyed, "_block")
    draws = placed.select(*keyed, "blocks", "slot", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("_rep"))
    draws = draws.select(*keyed, "_rep", draw(seed, F.col("_rep"), F.col("slot"), F.col("blocks")).alias("slot"))
    means = draws.join(placed.select(*keyed, "slot", "_sum", "_n"), [*keyed, "slot"]).groupBy(*keyed, "_rep").agg((F.sum("_sum").cast("double") / F.sum("_n")).alias("_m"))
    if rule == "interpolated":
        ends = means.groupBy(*keyed).agg(F.percentile("_m", low).alias("low"), F.percentile("_m", high).alias("high"))
    else:
        last = repetitions if rule == "rank_of_n" else repetitions - 1
        ranked = means.withColumn("_r", F.row_number().over(Window.partitionBy(*keyed).orderBy("_m")) - 1)  # one row per repetition
        at = lambda q: F.max(F.when(F.col("_r") == int(q * last), F.col("_m")))
        ends = ranked.groupBy(*keyed).agg(at(low).alias("low"), at(high).alias("high"))
    observed = sums.groupBy(*keyed).agg(F.count(F.lit(1)).alias("blocks"), F.sum("_n").alias("n"), (F.sum("_sum").cast("double") / F.sum("_n")).alias("mean"))
    enough = lambda c: F.when(F.col("blocks") >= least_blocks, F.col(c)).alias(c)
    return observed.join(ends, keyed).select(*keys, "blocks", "n", "mean", enough("low"), enough("high"))
