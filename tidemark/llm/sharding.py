"""K-d tree sharding: leaves of near-equal bytes over the metadata of documents.

Points are groups of equal texts, which always stay together (a group that outweighs a shard makes its leaf
larger than the rest). Each node is cut along the dimension (source, language,
size, id) in which it is widest, at the weighted place that gives both sides their share of shards. The
place is found by narrowing histograms: each round is one distributed sum over at most ``BINS`` ranges of
each open node, so the driver holds at most shards x BINS numbers. Ties along a dimension are cut by hash. Where points are large
for a leaf, cuts can't be even; the leaves are then repaired: the driver sees the ``MOVABLE`` largest points of
each leaf that may help and moves them from full leaves to empty ones as long as that evens them out.

Defined cases: null text weighs as empty text, with checksum 0; null metadata counts as the empty string,
a null id as 0; repeated rows are kept as rows; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, numbered

BINS, TIE_BITS, GRID_BITS = 512, 38, 24
#: Points of a leaf that one round of repair may move, and rounds.
MOVABLE, REPAIRS = 48, 4
#: Bytes a row weighs besides its text.
ROW_BYTES = 16
DIMENSIONS = ("d_source", "d_lang", "d_size", "d_id")


@dataclass
class Node:
    shards: int
    first: int
    dim: str | None = None
    cut: int | None = None  # points with a key below it go left
    low: "Node | None" = None
    high: "Node | None" = None
    number: int = 0


def _code(text: Column) -> Column:
    """The first seven bytes of a string as a number in the same order."""
    return F.conv(F.rpad(F.substring(F.hex(F.coalesce(text.cast("string"), F.lit(""))), 1, 14), 14, "0"), 16, 10).cast("double")


def _leaf(node: Node) -> Column:
    if node.low is None:
        return F.lit(node.number)
    return F.when(F.col(f"k_{node.dim}") < F.lit(node.cut), _leaf(node.low)).otherwise(_leaf(node.high))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.low is None else _leaves(node.low) + _leaves(node.high)


def _place(points: DataFrame, nodes: list[Node], totals: dict[int, int], slack: float) -> None:
    """Set the cut of each node where the weight left of it is nearest its share."""
    span = 1 << (GRID_BITS + TIE_BITS)
    open_ = {n.number: [0, span, 0] for n in nodes}  # low end, high end, weight below the low end
    want = {n.number: totals[n.number] * (n.shards // 2) / n.shards for n in nodes}
    by = {n.number: n for n in nodes}
    while open_:
        spark = points.sparkSession
        now = spark.createDataFrame([(k, by[k].dim, lo, max(1, -(-(hi - lo) // BINS))) for k, (lo, hi, _) in open_.items()], "node int, dim string, lo long, step long")
        key = "coalesce(" + ", ".join(f"CASE WHEN dim = '{d}' THEN k_{d} END" for d in DIMENSIONS) + ")"
        held = points.join(F.broadcast(now), "node").withColumn("bin", F.expr(f"({key} - lo) div step"))
        found: dict[int, dict[int, tuple[int, int]]] = {}
        for r in held.filter(f"{key} >= lo AND bin < {BINS}").groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).collect():
            found.setdefault(r.node, {})[r.bin] = (r.w, r.n)
        for k, (lo, hi, below) in list(open_.items()):
            step, got = max(1, -(-(hi - lo) // BINS)), found.get(k, {})
            for b in sorted(got):
                w, n = got[b]
                if below + w >= want[k]:
                    if w <= slack or n == 1 or step == 1:
                        over = below + w - want[k] < want[k] - below
                        by[k].cut = lo + step * (b + over)
                        del open_[k]
                    else:
                        open_[k] = [lo + step * b, min(hi, lo + step * (b + 1)), below]
                    break
                below += w
            else:
                by[k].cut = hi
                del open_[k]


def grow(points: DataFrame, shards: int) -> Node:
    """The tree over points with ``weight``, coordinates ``k_<dimension>`` and ``n`` rows each."""
    root = Node(shards, 0)
    while True:
        leaves = _leaves(root)
        for i, leaf in enumerate(leaves):
            leaf.number = i
        split = [x for x in leaves if x.shards > 1]
        if not split:
            return root
        placed = points.withColumn("node", _leaf(root))
        rows = placed.groupBy("node").agg(F.sum("weight").alias("w"), *(F.max(f"k_{d}").alias(f"hi_{d}") for d in DIMENSIONS), *(F.min(f"k_{d}").alias(f"lo_{d}") for d in DIMENSIONS)).collect()
        spread = {r.node: r for r in rows}
        live = [x for x in split if x.number in spread]
        for x in split:
            x.dim, x.cut = DIMENSIONS[0], 0
        for x in live:
            r = spread[x.number]
            x.dim = max(DIMENSIONS, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"])
        if live:
            total = sum(r.w for r in rows)
            _place(placed, live, {x.number: spread[x.number].w for x in live}, total / shards / 2000)
        for x in split:
            x.low, x.high = Node(x.shards // 2, x.first), Node(x.shards - x.shards // 2, x.first + x.shards // 2)


def moves(weights: dict[int, int], points: dict[int, list[tuple[int, int]]]) -> dict[int, int]:
    """Which points (weight, key) go to which leaf so that the leaves' weights come closer."""
    weights, where, found = dict(weights), {k: sorted(v) for k, v in points.items()}, {}
    while True:
        order = sorted(weights, key=lambda k: (weights[k], k))
        best = None
        for full in order[::-1][:4]:
            for bare in order[:4]:
                gap = weights[full] - weights[bare]
                at = bisect_left(where.get(full, []), (gap // 2 + 1, -(1 << 63)))
                for i in (at - 1, at):
                    if 0 <= i < len(where.get(full, [])) and 0 < where[full][i][0] < gap:
                        w = where[full][i][0]
                        gain = weights[full] ** 2 + weights[bare] ** 2 - (weights[full] - w) ** 2 - (weights[bare] + w) ** 2
                        best = max(best or (0,), (gain, full, bare, i))
        if not best:
            return found
        _, full, bare, i = best
        w, key = where[full].pop(i)
        weights[full] -= w
        weights[bare] += w
        insort(where.setdefault(bare, []), (w, key))
        found[key] = bare


def _repaired(placed: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """Points (pid, weight, shard) with a better shard for some."""
    for i in range(REPAIRS):
        weights = {k: 0 for k in range(shards)} | {r.shard: int(r.w) for r in placed.groupBy("shard").agg(F.sum("weight").alias("w")).collect()}
        mean = sum(weights.values()) / shards
        if max(abs(w - mean) for w in weights.values()) <= 0.002 * mean:
            break
        spare = placed.sparkSession.createDataFrame([(k, w - min(weights.values())) for k, w in weights.items()], "shard int, spare long")
        able = placed.join(F.broadcast(spare), "shard").filter("weight < spare")
        sizes = Window.partitionBy("shard").orderBy(F.desc("weight"), "pid")
        spread = Window.partitionBy("shard").orderBy(F.xxhash64("pid", F.lit(i)), "pid")
        points: dict[int, list[tuple[int, int]]] = {}
        for window in (sizes, spread):
            for r in able.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= MOVABLE).collect():
                points.setdefault(r.shard, []).append((r.weight, r.pid))
        found = moves(weights, {k: list(set(v)) for k, v in points.items()})
        if not found:
            break
        to = placed.sparkSession.createDataFrame(list(found.items()), "pid long, _to int")
        placed = scratch.keep(placed.join(F.broadcast(to), "pid", "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to"), f"repaired-{i}")
    return placed


def kd_shards(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard; a row per input row."""
    scratch = Scratch(docs.sparkSession, "shard")
    body = F.coalesce(F.col(text_col), F.lit(""))
    number = F.coalesce(F.col(id_col).cast("double"), F.lit(0.0)) if isinstance(docs.schema[id_col].dataType, T.NumericType) else F.xxhash64(F.col(id_col)).cast("double")
    slim = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("th"),
        _code(F.col(source_col)).alias("d_source"), _code(F.col(lang_col)).alias("d_lang"), number.alias("d_id"),
    )
    slim = scratch.keep(slim.withColumn("d_size", F.log2(F.col("size"))).withColumn("pid", F.xxhash64("th", "text_crc32", "size")), "slim")
    groups = scratch.keep(slim.groupBy("pid").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"), *(F.min(d).alias(d) for d in DIMENSIONS)), "groups")
    ends = groups.agg(*(F.min(d).alias(f"lo_{d}") for d in DIMENSIONS), *(F.max(d).alias(f"hi_{d}") for d in DIMENSIONS)).first()
    grid, keys = (1 << GRID_BITS) - 1, {}
    for d in DIMENSIONS:
        low, wide = ends[f"lo_{d}"] or 0.0, (ends[f"hi_{d}"] or 0.0) - (ends[f"lo_{d}"] or 0.0)
        at = F.least(F.greatest((F.col(d) - low) / wide, F.lit(0.0)), F.lit(1.0)) if wide > 0 else F.lit(0.0)
        keys[f"k_{d}"] = F.floor(at * grid).cast("long") * (1 << TIE_BITS) + F.pmod(F.xxhash64("pid", F.lit(d)), F.lit(1 << TIE_BITS))
    points = scratch.keep(groups.withColumns(keys).select("pid", "weight", "n", *(f"k_{d}" for d in DIMENSIONS)), "points")
    placed = _repaired(scratch.keep(points.select("pid", "weight", _leaf(grow(points, shards)).alias("shard")), "leaves"), shards, scratch)
    joined = slim.select("_id", "size", "text_crc32", "th", "pid").join(placed.select("pid", "shard"), "pid")
    return numbered(joined, ["shard"], ["_id", "th"], "slot").select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
