"""Exact top-k by inner product: a Voronoi join.

Both sides are grouped by their nearest pivot. A group of candidates is summarised by its radius around
the pivot; for a query q and a group with pivot p and radius r no inner product exceeds
``q . p + |q| r``. Each query first finds k candidates in the groups that this bound ranks highest, whose
k-th score is a floor; it then goes only to the groups whose bound reaches the floor. Groups are cut
into parts by hash, and so are the queries that ask one, so that no task holds more than about ``PART_ROWS``
candidates and ``ASK_ROWS`` queries; it solves its part with matrix products and returns at most k candidates per query.

Pivots come from a bounded sample, as many as the root of the rows between ``PIVOTS`` and ``MOST_PIVOTS``; they decide
how much is replicated, never what is found. Vectors are compared as whole numbers, ``floor(scale * x)``, and travel
packed at the least width that holds them all. Where bounds are weak a query asks every cell, so tasks hold bounds of
a few queries at a time and send their rows in pieces.

Defined cases: vectors that are null or hold null or non-finite components take no part; ties go to the smaller
id; fewer candidates than k give all; an empty table gives no rows. Rows that share an id are rows of their own:
each asks, with a list of its own under that id, and each is a candidate for the others. Vectors of different
dimensions raise, as do scores that whole numbers of 53 bits can't hold, and ids that aren't whole numbers. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

PIVOTS, MOST_PIVOTS = 64, 4096
PART_ROWS, ASK_ROWS, QUERY_ROWS = 2048, 4096, 512
#: Numbers of a table of vectors by pivots that a task holds, and rows that it sends at once.
TABLE, SENT_ROWS = 1 << 20, 1 << 14
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    """A binary value for each row, of whole numbers of ``kind``."""
    raw, width = x.astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def _matrix(column: pa.Array | pd.Series, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column.tolist()), kind).reshape(-1, dim).astype(np.float64)


def _some(batches: Iterator[pa.RecordBatch], pivots: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a number for each row and pivot stays within ``TABLE``."""
    step = max(1, TABLE // max(1, pivots))
    for b in batches:
        for s in range(0, b.num_rows, step):
            yield b.slice(s, step)


def _best(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of scores its k best (places, scores), ties to the smaller id, without the query itself."""
    scores = np.where(rows[None, :] == own[:, None], -np.inf, scores)
    out = []
    for row in scores:
        if len(row) > k:
            floor = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero((row >= floor) & np.isfinite(row))
        else:
            at = np.flatnonzero(np.isfinite(row))
        at = at[np.lexsort((rows[at], ids[at], -row[at]))][:k]
        out.append((at, row[at]))
    return out


def voronoi_topk(table: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, pivots: int | None = None, part_rows: int = PART_ROWS, ask_rows: int = ASK_ROWS) -> DataFrame:
    """query_id, rank, ``id_col``, score: every query's k best other rows."""
    of = table.schema[id_col].dataType.simpleString()
    if of not in _WHOLE:
        raise TypeError(f"{id_col} must be a whole number, not {of}")
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False)) & F.col(id_col).isNotNull()
    whole = table.filter(good).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"), F.monotonically_increasing_id().alias("row"))
    whole = scratch.keep(whole, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    seen = whole.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(square).alias("square"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top")).first()
    if not seen.n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint").withColumnRenamed("vec_id", id_col)
    if seen.least != seen.most:
        raise ValueError(f"vectors have {seen.least} to {seen.most} dimensions")
    if seen.square >= 2.0**53:  # no product of two of them is larger
        raise ValueError("scores don't fit whole numbers of 53 bits; use a smaller scale")
    dim, kind = seen.most, next(k for k in ("<i1", "<i2", "<i4", "<i8") if seen.top <= np.iinfo(k).max)
    count = pivots or int(min(MOST_PIVOTS, max(PIVOTS, seen.n**0.5)))
    sample = whole.select("v").orderBy(F.xxhash64("v"), "id").limit(count).collect()
    points = spark.sparkContext.broadcast(np.unique(np.array([r.v for r in sample], np.float64), axis=0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = points.value
        for b in _some(batches, len(p)):
            x = b.column(2).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            gaps = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0)
            cell = gaps.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], _packed(x, kind), b.column(3), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(gaps[np.arange(len(x)), cell]))], names=["id", "q", "v", "row", "cell", "gap"])

    celled = scratch.keep(whole.mapInArrow(assign, "id bigint, q boolean, v binary, row bigint, cell int, gap double"), "cells")
    summary = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()  # one row per pivot
    cells = {r.cell: (r.n, r.radius) for r in summary}
    parts = {c: max(1, -(-n // part_rows)) for c, (n, _) in cells.items()}
    queries = celled.filter("q").select("id", "v", "row")

    def route(floors: bool):
        """Without floors: the cells of the highest bounds that hold k candidates. With: all others that may matter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = points.value
            known = np.array(sorted(cells))
            n, radius = (np.array([cells[c][i] for c in known], float) for i in (0, 1))
            each = np.array([parts[c] for c in known])
            for b in _some(batches, len(known)):
                x = _matrix(b.column(1), dim, kind)
                bound = x @ p[known].T + np.sqrt((x * x).sum(1))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-6
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros_like(bound, bool)
                np.put_along_axis(first, order, before <= k, axis=1)
                if floors:
                    floor = b.column(3).to_numpy(zero_copy_only=False)
                    take = ~first & (bound >= np.nan_to_num(floor, nan=-np.inf)[:, None])
                else:
                    floor, take = np.full(len(x), np.nan), first
                row, at = np.nonzero(take)
                many = each[at]
                row, at = np.repeat(row, many), np.repeat(at, many)
                part = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(many)))[:-1], many)
                for s in range(0, len(row), SENT_ROWS):  # a query may ask every cell
                    to, at_, part_ = (c[s : s + SENT_ROWS] for c in (row, at, part))
                    yield pa.RecordBatch.from_arrays([pa.array(known[at_].astype(np.int32)), pa.array(part_.astype(np.int32)), *(b.column(i).take(pa.array(to)) for i in range(3)), pa.array(floor[to])], names=["cell", "part", "id", "v", "row", "floor"])

        return run

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, held = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        out = []
        if len(ask) and len(held):
            y, ids, rows = _matrix(held["v"], dim, kind), held["id"].to_numpy(), held["row"].to_numpy()
            for s in range(0, len(ask), QUERY_ROWS):
                some = ask.iloc[s : s + QUERY_ROWS]
                for q, own, floor, (at, score) in zip(some["id"].to_numpy(), some["row"].to_numpy(), some["floor"].to_numpy(), _best(_matrix(some["v"], dim, kind) @ y.T, rows, ids, some["row"].to_numpy(), k)):
                    ok = score >= floor if floor == floor else np.ones(len(score), bool)
                    n = int(ok.sum())
                    out.append((np.full(n, q), np.full(n, own), ids[at[ok]], rows[at[ok]], score[ok]))
        return pd.DataFrame(dict(zip(("query_id", "query_row", "id", "row", "score"), ((np.concatenate(x) if out else np.zeros(0)).astype(np.int64) for x in (zip(*out) if out else [()] * 5)), strict=True)))

    shape = "cell int, part int, id bigint, v binary, row bigint, floor double"
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "id", "row")

    def answers(asked: DataFrame, name: str) -> DataFrame:
        """Candidates from the parts that are asked; queries of a cell are dealt to as many turns as they need, its parts go to each."""
        asked = scratch.keep(asked, f"{name}-asked")
        askers = {r.cell: -(-r.n // parts[r.cell]) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pivot
        cut = F.broadcast(spark.createDataFrame([(c, parts[c], -(-n // ask_rows)) for c, n in askers.items()], "cell int, parts int, turns int"))
        mine = asked.join(cut.drop("parts"), "cell").select("cell", "part", F.pmod(F.xxhash64("row"), F.col("turns")).cast("int").alias("turn"), "id", "v", "row", F.lit(True).alias("ask"), "floor")
        held = celled.join(cut, "cell").select("cell", F.pmod(F.xxhash64("id", "row"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id", "v", "row", F.lit(False).alias("ask"), F.lit(None).cast("double").alias("floor"))
        return mine.unionByName(held).groupBy("cell", "part", "turn").applyInPandas(solve, "query_id bigint, query_row bigint, id bigint, row bigint, score bigint")

    first = scratch.keep(answers(queries.mapInArrow(route(False), shape), "first").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "first")
    floors = first.filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    again = queries.join(floors, "row", "left").select("id", "v", "row", "floor").mapInArrow(route(True), shape)
    both = first.drop("rank").unionByName(answers(again, "again"))
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
