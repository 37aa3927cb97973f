"""Verification of recorded history: ancestors of artifacts, and hash chains against their stored links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def ancestry(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """``id``, depth, root, ok, cyclic for nodes (id, parent, ok): a node is ok if it and all above it are.

    Pointers double: each round a node takes over what its pointer knows and points twice as far, so a
    line of d ancestors needs log2(d) joins on slim rows. What still points somewhere after more rounds
    than any acyclic line needs stands in, or under, a cycle. A parent that isn't listed makes a node not ok.
    """
    known = nodes.select("id").withColumnRenamed("id", "parent").withColumn("_there", F.lit(True))
    now = nodes.join(known, "parent", "left").select(
        "id", F.when(F.col("_there"), F.col("parent")).alias("up"), (F.col("ok") & (F.col("parent").isNull() | F.coalesce("_there", F.lit(False)))).alias("ok"),
        F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("depth"), F.coalesce(F.when(F.col("_there"), F.col("parent")), F.col("id")).alias("root"),
    )
    total = now.count()
    for i in range(rounds):
        if now.filter("up IS NOT NULL").isEmpty() or 1 << i > 2 * total:
            break
        above = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("ok").alias("_ok"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        now = cut(now.join(above, "up", "left").select(
            "id", F.col("_up").alias("up"), (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root").alias("root")
        ))
    cyclic = F.col("up").isNotNull()
    return now.select("id", F.when(~cyclic, F.col("depth")).alias("depth"), F.when(~cyclic, F.col("root")).alias("root"), (F.col("ok") & ~cyclic).alias("ok"), cyclic.alias("cyclic"))


def chain_breaks(records: DataFrame, key: str, order: str, payload: str = "payload_hash", previous: str = "previous_hash", record: str = "record_hash") -> DataFrame:
    """Each stored record of a chain with what is wrong with it; nothing behind a break counts as verified.

    The link must be the stored hash of the record before it (the first one's is empty), and the hash that of
    the stored link and the payload.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.lag(record).over(w), F.lit(""))
    link = F.coalesce(F.col(previous), F.lit("")) == before
    own = F.sha2(F.concat_ws("|", F.coalesce(F.col(previous), F.lit("")), F.col(payload)), 256) == F.col(record)
    marked = records.withColumn("fault", F.when(~link, "link").when(~F.coalesce(own, F.lit(False)), "hash"))
    return marked.withColumn("verified", F.count("fault").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0)
