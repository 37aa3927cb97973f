"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors lexicographically by their concatenated random hashes: the signs of the
centred vector's projections on ``BITS`` random directions. Vectors at a small angle share long prefixes and
come to stand close together. Each is compared with the ``window`` rows before it, block by block as matrix
products, and the pairs that reach the threshold are verified in double precision. Passes come in rounds of
``PASSES`` with fresh directions. Their pairs are united to components, and rounds go on until one joins
less than a thousandth of what all have joined, so dense regions, where one order tells less, get more of
them. The mean is taken off before projecting (of the direction, not of what is compared), so that a
direction which all vectors share doesn't fill their first bits.

Places in an order come from a range sort of slim rows and counts of its ranges, so a window never ends at
the border of a task, and a block is two windows at most whatever the density. A block returns spanning links
only. Last, the vectors of each component are cut into blocks, and every pair of blocks is compared, so that
``n_links`` counts all direct links inside a component, also those that no pass had in one window. Vectors of
different components that no pass brought together stay apart: the recall is that of the passes (measured
by tests against all pairs, also on a dense table).

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing;
vectors of different dimension never link; equal vectors are one and count as often as they occur; rows
that share a vec_id are separate rows of one id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, merged
from .scratch import Scratch

#: Passes of a round, hash bits of a pass, and rows before its own that a vector is compared with.
PASSES, BITS, WINDOW = 6, 62, 4096
#: A round that joins a smaller share of all joined so far is the last.
SETTLED = 0.001
#: Rows of a block of a component.
BLOCK = 2048
#: Rows of a task that sorts hashes.
SORTED_ROWS = 1 << 18


def unit_rows(data: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of length 1; the largest component is divided out first, so that no square overflows or vanishes."""
    x = np.asarray(data, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least, other) that connect what the pairs connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(i):
        least = np.minimum(root[i], root[j])
        if (least == root[i]).all() and (least == root[j]).all():
            break
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def _units(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose cosine reaches the threshold: single precision finds them, double decides close calls."""
    slack = np.float32(4e-7 * (x.shape[1] + 8))
    low, us, vs = y.astype(np.float32).T.copy(), [], []
    for k in range(0, len(x), 256):
        near = x[k : k + 256].astype(np.float32) @ low
        u, v = np.nonzero(near >= threshold - slack)
        ok = near[u, v] >= threshold + slack
        doubt = np.flatnonzero(~ok)
        for d in (doubt[n : n + 65536] for n in range(0, len(doubt), 65536)):
            ok[d] = np.einsum("ij,ij->i", x[k + u[d]], y[v[d]]) >= threshold
        us.append(k + u[ok])
        vs.append(v[ok])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def _hashes(dim: int, middle: np.ndarray, first: int, count: int):
    """The concatenated hashes of each vector in each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.random.default_rng([dim, p]).standard_normal((dim, BITS)) for p in range(first, first + count)]
        weigh = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            x = _units(b.column(1), dim) - middle
            for p, plane in enumerate(planes):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), first + p, np.int32)), pa.array((x @ plane >= 0).astype(np.int64) @ weigh), b.column(0)], names=["pass", "hash", "c"])

    return run


def _windowed(dim: int, window: int, threshold: float):
    """Links of one block of an order: its own rows with each other and with the window before them."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        x, c, place = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(-1, dim), pdf["c"].to_numpy(), pdf["place"].to_numpy()
        own = int(np.searchsorted(place, key[1] * window))
        u, v = near_pairs(x[own:], x, threshold)
        ok = (v < own + u) & (own + u - v <= window)
        a, b = _spanning(c[own + u[ok]], c[v[ok]])
        return pd.DataFrame({"a": a, "b": b})

    return run


def _pass_links(vectors: DataFrame, scratch: Scratch, name: str, *, dim: int, total: int, middle: np.ndarray, first: int, threshold: float, window: int) -> DataFrame:
    """Spanning links of one round of passes."""
    slim = vectors.mapInArrow(_hashes(dim, middle, first, PASSES), "pass int, hash bigint, c bigint")
    ranges = max(slim.sparkSession.sparkContext.defaultParallelism, PASSES * total // SORTED_ROWS)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.arange(at, at + b.num_rows))], names=["pass", "c", "range", "inside"])
            at += b.num_rows

    ordered = slim.repartitionByRange(ranges, "pass", "hash", "c").sortWithinPartitions("pass", "hash", "c")
    ordered = scratch.keep(ordered.select("pass", "c", F.spark_partition_id().alias("range")).mapInArrow(number, "pass int, c bigint, range int, inside bigint"), f"{name}-order")
    before, starts, done = {}, {}, 0
    for r in sorted(ordered.groupBy("range", "pass").agg(F.count(F.lit(1)).alias("n"), F.min("inside").alias("low")).collect()):
        starts.setdefault(r["pass"], done)
        before[r.range, r["pass"]] = done - r.low - starts[r["pass"]]
        done += r.n
    offsets = slim.sparkSession.createDataFrame([(*k, v) for k, v in before.items()], "range int, pass int, off bigint")
    placed = ordered.join(F.broadcast(offsets), ["range", "pass"]).select("pass", "c", (F.col("inside") + F.col("off")).alias("place"))
    block = F.floor(F.col("place") / window)
    both = placed.join(vectors, "c").select("pass", F.explode(F.array(block, block + 1)).alias("block"), "place", "c", "v").filter(F.col("block") <= (total - 1) // window)
    links = both.groupBy("pass", "block").applyInPandas(_windowed(dim, window, threshold), "a bigint, b bigint").distinct()
    return scratch.keep(links, f"{name}-links")


def embedding_links(vectors: DataFrame, scratch: Scratch, *, dim: int, total: int, threshold: float, window: int) -> DataFrame:
    """``node``, ``root``: components of the vectors (c, v: unit doubles as bytes) that the passes link."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(dim)
        for b in batches:
            held += _units(b.column(1), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(held)], names=["i", "s"])

    middle = np.zeros(dim)
    for r in vectors.mapInArrow(sums, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        middle[r.i] = round(r.s / total, 6)  # rounded, so that reruns hash alike
    labels, joined, i = None, 0, 0
    while True:
        name = f"d{dim}-round{i}"
        links = _pass_links(vectors, scratch, name, dim=dim, total=total, middle=middle, first=i * PASSES, threshold=threshold, window=window)
        labels = scratch.keep(components(links, scratch, f"{name}-cc"), f"{name}-first") if labels is None else merged(labels, links, scratch, name)
        scratch.drop(f"{name}-order")
        now = labels.filter("node <> root").count()
        if now - joined <= SETTLED * now or total <= window:
            return labels
        joined, i = now, i + 1


def _link_counts(held: DataFrame, labels: DataFrame, scratch: Scratch, dim: int, threshold: float) -> DataFrame:
    """``c``, ``k``: how many rows the vector links with, from all pairs of its component's blocks."""
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    cut = held.join(sizes, "root").withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[["root", "block", "blocks"]].iloc[:1].reset_index(drop=True)
        return first.assign(cs=[pdf["c"].to_numpy("<i8").tobytes()], ns=[pdf["n"].to_numpy("<i8").tobytes()], xs=[b"".join(pdf["v"])])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in pdf.groupby(["root", "i", "j"], sort=False):
            (c, n, x), (d, m, y) = ((np.frombuffer(r["cs"], "<i8"), np.frombuffer(r["ns"], "<i8"), np.frombuffer(r["xs"], np.float64).reshape(-1, dim)) for r in (part.iloc[0], part.iloc[-1]))
            u, v = near_pairs(x, y, threshold)
            apart = c[u] != d[v]
            u, v = u[apart], v[apart]
            out.append((c, np.bincount(u, m[v], minlength=len(c))))
            if i != j:
                out.append((d, np.bincount(v, n[u], minlength=len(d))))
        return pd.DataFrame({"c": np.concatenate([o[0] for o in out]), "k": np.concatenate([o[1] for o in out]).astype(np.int64)})

    blocks = scratch.keep(cut.groupBy("root", "block").applyInPandas(pack, "root bigint, block bigint, blocks bigint, cs binary, ns binary, xs binary"), f"d{dim}-blocks")
    pairs = blocks.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    part = F.when(F.col("blocks") > 1, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(1024)))
    return pairs.groupBy(part.alias("part")).applyInPandas(compare, "c bigint, k bigint").groupBy("c").agg(F.sum("k").alias("k"))


def embedding_dedup(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, window: int = WINDOW) -> DataFrame:
    """``id_col``, n_links, component_id, kept; a row per input row."""
    scratch = Scratch(table.sparkSession, "vectors")
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("_id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048)):
                size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
                out: list[bytes | None] = [None] * b.num_rows
                for dim in np.unique(size[size > 0]).tolist():
                    at = np.flatnonzero(size == dim)
                    x = unit_rows(b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dim)
                    for i, row in zip(at.tolist(), x):
                        out[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), pa.array(out, pa.binary())], names=["_id", "dim", "v"])

    kind = table.schema[id_col].dataType.simpleString()
    same = F.sha2("v", 256)
    rows = scratch.keep(rows.mapInArrow(units, f"_id {kind}, dim int, v binary").withColumn("same", same), "rows")
    grouped = rows.filter("v IS NOT NULL").groupBy("same").agg(F.first("dim").alias("dim"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("_id").alias("least"))
    classes = scratch.keep(grouped.withColumn("c", F.xxhash64("same")), "classes")
    if not classes.groupBy("c").count().filter("count > 1").isEmpty():
        raise ValueError("two different vectors have one 64-bit number; number them anew")
    dims = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = None
    for dim, total in sorted(dims.items()):
        own = classes.filter(F.col("dim") == dim)
        labels = embedding_links(own.select("c", "v"), scratch, dim=dim, total=total, threshold=threshold, window=window)
        held = own.join(labels, F.col("c") == F.col("node")).select("root", "c", "n", "least", "v")
        linked = _link_counts(held, labels, scratch, dim, threshold)
        least = held.groupBy("root").agg(F.min("least").alias("component"))
        named = labels.join(least, "root").select(F.col("node").alias("c"), "component")
        found = own.join(linked, "c", "left").join(named, "c", "left").select("same", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("k"), F.coalesce("component", "least").alias("component"))
        of = found if of is None else of.unionByName(found)
    done = rows.select("_id", "same").join(of, "same", "left") if of is not None else rows.select("_id", F.lit(0).alias("k"), F.col("_id").alias("component"))
    component = F.coalesce("component", "_id")
    return done.select(F.col("_id").alias(id_col), F.coalesce("k", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))
