"""Greedy assignment without replacement: targets take turns, each the nearest value still free."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_without_replacement(candidates: DataFrame, keys: list[str], value: str, targets: list[int]) -> DataFrame:
    """``keys``, turn (from 1), target and ``value``: what each target takes, in order of the targets.

    Distances tie to the smaller value; a value is taken once per key however often it occurs; null values
    take no part, and a target that finds nothing left gives no row. A target can only take one of the
    nearest values that are as many as the targets before it and itself, so at most ``len(targets) ** 2``
    candidates of a key are gathered, however many it has.
    """
    free = candidates.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).distinct()
    goals = F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(t).alias("target")) for i, t in enumerate(targets, 1)))
    asked = free.withColumn("_g", F.explode(goals)).withColumn("_far", F.abs(F.col("_v") - F.col("_g.target")))
    near = asked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_g.turn").orderBy("_far", "_v"))).filter(F.col("_rank") <= len(targets))
    sets = near.groupBy(*keys).agg(F.array_sort(F.collect_set("_v")).alias("_free"))

    def take(state, goal):
        best = F.array_min(F.transform(state["free"], lambda v: F.struct(F.abs(v - goal["target"]).alias("far"), v.alias("v"))))["v"]
        return F.struct(F.filter(state["free"], lambda v: v != best).alias("free"), F.when(best.isNull(), state["taken"]).otherwise(F.concat(state["taken"], F.array(F.struct(goal["turn"].alias("turn"), goal["target"].alias("target"), best.alias("v"))))).alias("taken"))

    kind = free.schema["_v"].dataType.simpleString()
    none = F.array().cast(f"array<struct<turn:int,target:int,v:{kind}>>")
    taken = F.aggregate(goals, F.struct(F.col("_free").alias("free"), none.alias("taken")), take, lambda s: s["taken"])
    return sets.select(*keys, F.explode(taken).alias("_t")).select(*keys, "_t.turn", "_t.target", F.col("_t.v").alias(value))
