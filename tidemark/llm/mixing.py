"""Mixing sources to target weights by entropy balancing.

A document i of source s gets a rate between 0 and ``cap`` that is as close as possible, in relative
entropy to one copy of each document, to what the token constraint of its source asks for:
``sum(rate_i * size_i) = target_s``. The convex dual has one multiplier per source, and its solution is
an exponential tilt by size, ``rate = cap * e^h / (cap - 1 + e^h)`` with ``h = lambda_s * size / mean_s``.
Each Newton step is one distributed aggregation over the histogram of sizes; only one number per
source meets on the driver. Rates are then rounded to whole copies: running sums of the rates, in order
of size, are cut at whole numbers, and what is left is repaired with ever smaller documents.

Defined cases: null text has size 0 and is taken 0 times its size; a null source is a source of its
own, last in order; rows that share a doc_id count as separate documents; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, slices, word_counts

#: Parts a class of documents (one source, one size) is split into, so that no group is one task's.
SALTS = 256
#: Sources the driver holds numbers for; each costs about 100 bytes.
MOST_SOURCES = 200_000
#: Sums are kept in millionths of a word, as whole numbers.
PARTS = 1_000_000
#: Sizes tried when a source's large documents leave its words off target.
MOST_TRIED = 64


def shares(sizes: Sequence[int], weights: Sequence[float], fraction: float, cap: float) -> list[float]:
    """Targets by weight of ``fraction`` of all sizes, none above ``cap`` times its size."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), fraction * sum(sizes)
    while free:
        per = left / sum(weights[i] for i in free)
        full = {i for i in free if per * weights[i] >= cap * sizes[i]}
        for i in full or free:
            targets[i] = float(cap * sizes[i]) if full else per * weights[i]
        left -= sum(targets[i] for i in full)
        if not full:
            break
        free -= full
    return targets


def _tilted(h, cap: float):
    return cap / (1 + (cap - 1) * np.exp(-np.clip(h, -700, 700)))


def _solve(hist: DataFrame, sources: list[dict], cap: float, tolerance: float, steps: int) -> None:
    """Newton's method on the dual, kept inside a bracket; sets ``tilt`` of each source."""
    spark = hist.sparkSession
    exact = lambda term: F.sum(F.round(term * PARTS).cast("decimal(38,0)"))  # noqa: E731  the same in any order of rows
    open_ = {s["sid"]: s for s in sources if 0 < s["target"] < cap * s["total"]}
    for s in sources:
        s |= {"tilt": math.inf if s["total"] and s["target"] >= cap * s["total"] else -math.inf if s["target"] <= 0 else 0.0, "low": -math.inf, "high": math.inf}
    for _ in range(steps):
        if not open_:
            return
        now = spark.createDataFrame([(k, float(s["tilt"]), float(s["mean"])) for k, s in open_.items()], "sid int, tilt double, mean double")
        x = F.col("size") / F.col("mean")
        h = F.least(F.greatest(F.col("tilt") * x, F.lit(-700.0)), F.lit(700.0))
        rate = F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-h))
        rows = (
            hist.join(F.broadcast(now), "sid")
            .select("sid", "n", "size", x.alias("x"), rate.alias("r"))
            .groupBy("sid")
            .agg(exact(F.col("n") * F.col("size") * F.col("r")).alias("words"), exact(F.col("n") * F.col("size") * F.col("x") * F.col("r") * (1 - F.col("r") / cap)).alias("slope"))
            .collect()
        )
        for row in rows:
            s = open_[row.sid]
            words, slope = float(row.words) / PARTS, float(row.slope) / PARTS
            gap = words - s["target"]
            if abs(gap) <= tolerance * max(1.0, s["target"]):
                del open_[row.sid]
                continue
            s["high" if gap > 0 else "low"] = s["tilt"]
            step = s["tilt"] - (gap / slope if slope > 0 else math.copysign(1.0, gap))
            if not s["low"] < step < s["high"]:
                low, high = s["low"], s["high"]
                step = (low + high) / 2 if math.isfinite(low + high) else s["tilt"] - math.copysign(2 * abs(s["tilt"]) + 1, gap)
            s["tilt"] = min(max(step, s["tilt"] - 20), s["tilt"] + 20)


def round_rates(size: np.ndarray, n: np.ndarray, rate: np.ndarray, target: float, cap: int) -> np.ndarray:
    """Whole copies for each class of ``n`` documents of one size; the sum of words comes near ``target``."""
    whole = np.floor(np.cumsum(n * rate) + 0.5)
    copies = np.clip(np.diff(whole, prepend=0.0), 0, cap * n).astype(np.int64)
    copies, gap = _repaired(size, n, copies, int(round(target)) - int((copies * size).sum()), cap)
    if abs(gap) > 0.002 * target:  # a few large documents: try one more or one less of each size
        best = (abs(gap), copies)
        for i in np.argsort(np.abs(size - abs(gap)), kind="stable")[:MOST_TRIED].tolist():
            for step in (1, -1):
                if 0 <= copies[i] + step <= cap * n[i]:
                    other = copies.copy()
                    other[i] += step
                    tried, left = _repaired(size, n, other, gap - step * int(size[i]), cap)
                    best = min(best, (abs(left), tried), key=lambda b: b[0])
        copies = best[1]
    return copies


def _repaired(size: np.ndarray, n: np.ndarray, copies: np.ndarray, gap: int, cap: int) -> tuple[np.ndarray, int]:
    """``copies`` with ever smaller documents added or taken away until ``gap`` words are made up for."""
    copies = copies.copy()
    for i in range(len(size) - 1, -1, -1):
        if not 0 < size[i] <= abs(gap):
            continue
        step = min(abs(gap) // int(size[i]), int(cap * n[i] - copies[i]) if gap > 0 else int(copies[i]))
        copies[i] += step if gap > 0 else -step
        gap -= (step if gap > 0 else -step) * int(size[i])
    return copies, gap


def entropy_mix(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), fraction: float = 1.0, cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tolerance: float = 1e-9, steps: int = 60, carry_hash: bool = False) -> DataFrame:
    """``id_col``, ``source_col``, size, source_size, target, rate, copies, taken; a row per input row.

    ``carry_hash`` adds ``_hash``, ``xxhash64(id, text)``, to find the rows again.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(word_counts(b.column(2)), pa.int64())], names=["_id", "_source", "_hash", "size"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_hash"))
    kind = docs.schema[id_col].dataType.simpleString()
    sized = scratch.keep(slim.mapInArrow(measure, f"_id {kind}, _source string, _hash bigint, size bigint"), "sized")

    totals = sized.groupBy("_source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them before mixing")
    totals.sort(key=lambda r: (r._source is None, r._source or ""))
    targets = shares([r.total for r in totals], [weights[i % len(weights)] for i in range(len(totals))], fraction, cap)
    sources = [{"sid": i, "source": r._source, "total": r.total, "mean": max(r.total / r.docs, 1e-9), "target": t} for i, (r, t) in enumerate(zip(totals, targets, strict=True))]

    names = spark.createDataFrame([(s["sid"], s["source"]) for s in sources], "sid int, _name string")
    keyed = sized.join(F.broadcast(names), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name").withColumn("salt", F.pmod(F.col("_hash"), F.lit(SALTS)).cast("int"))
    parts = scratch.keep(keyed.groupBy("sid", "size", "salt").agg(F.count(F.lit(1)).alias("c")), "parts")
    hist = scratch.keep(parts.groupBy("sid", "size").agg(F.sum("c").alias("n")), "hist", 8)
    _solve(hist, sources, cap, tolerance, steps)

    known = {s["sid"]: (s["tilt"], s["mean"], s["target"]) for s in sources}
    shared = spark.sparkContext.broadcast(known)

    def rounded(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tilt, mean, target = shared.value[key[0]]
        pdf = pdf.sort_values("size", ignore_index=True)
        size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        rate = np.full(len(size), float(cap) if tilt > 0 else 0.0) if math.isinf(tilt) else _tilted(tilt * size / mean, cap)
        return pdf.assign(rate=rate, whole=round_rates(size, n, rate, target, cap))

    classes = hist.groupBy("sid").applyInPandas(rounded, "sid int, size bigint, n bigint, rate double, whole bigint")
    classes = scratch.keep(classes, "classes", 8)
    before = Window.partitionBy("sid", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        parts.withColumn("off", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .join(classes, ["sid", "size"])
        .select("sid", "size", "salt", "rate", F.expr("whole div n").alias("base"), F.expr("whole % n - off").alias("more"))
    )
    place = Window.partitionBy("sid", "size", "salt").orderBy("_hash", "_id")
    of = spark.createDataFrame([(s["sid"], int(s["total"]), float(s["target"])) for s in sources], "sid int, source_size bigint, target double")
    return (
        keyed.withColumn("_rn", F.row_number().over(place))
        .join(quota, ["sid", "size", "salt"])
        .join(F.broadcast(of), "sid")
        .withColumn("copies", F.col("base") + (F.col("_rn") <= F.col("more")).cast("long"))
        .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["_hash"] if carry_hash else []))
    )
