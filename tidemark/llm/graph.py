"""Connected components of a link table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (its component's smallest node) for every node of ``links`` (a, b; 64-bit).

    Alternates two star contractions: every node hands its larger neighbours to the smallest one it sees,
    then its smaller ones. Each round is two aggregations and joins on slim rows and is written down.
    """
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    last = None
    for i in range(1, rounds + 1):
        both = edges.union(edges.select("v", "u"))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = scratch.keep(small, f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == last or not now.n:
            break
        last = now
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` after more links: only the links between different labels are contracted again."""
    if links.isEmpty():
        return labels
    ends = links.select("a", "b")
    for side in ("a", "b"):
        known = labels.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
        ends = ends.join(known, side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    top = scratch.keep(components(ends, scratch, name), f"{name}-top")
    up = top.select(F.col("node").alias("root"), F.col("root").alias("_root"))
    old = labels.join(up, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    new = top.join(labels.select("node"), "node", "left_anti").select("node", "root")
    return scratch.keep(old.union(new), f"{name}-labels")
