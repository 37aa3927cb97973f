"""Best-fit packing of token sequences into a fixed context.

The pieces are described by a histogram of lengths, at most one entry per length. The configuration
linear program over it (one variable per way to fill a sequence) is solved by multiplicative weights:
each round prices the lengths by how far they are covered, a knapsack dynamic program finds the best
filling around each length still in need, and those fillings gain mass. Rounding takes the whole parts;
what they leave over goes in best-fit-decreasing order. All of this sees the histogram only and has
bounds in the context length. Pieces then find their places by number within their length, in parallel.

Defined cases: null and empty texts are one end token; rows that share a doc_id are packed one by one;
longer documents are cut into full pieces and a rest; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, numbered, slices
from .tokens import VOCABULARY, token_ids

CONTEXT, END_ID = 2048, 0
Config = tuple[tuple[int, int], ...]  # (length, how often), longest first


def _price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each capacity, and the length last added (0: none)."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gains = value[1 : c + 1] + best[c - 1 :: -1]
        i = int(gains.argmax())
        if gains[i] > best[c - 1]:
            best[c], choice[c] = gains[i], i + 1
        else:
            best[c], choice[c] = best[c - 1], choice[c - 1] and -1
    return best, choice


def _fill(seed: int, choice: np.ndarray, capacity: int, left: np.ndarray) -> dict[int, int]:
    """The priced filling around ``seed``, with no length more often than is left of it."""
    used, c = {seed: 1}, capacity - seed
    while c > 0 and (item := int(choice[c])) != 0:
        if item < 0 or used.get(item, 0) >= left[item]:
            c -= 1
            continue
        used[item] = used.get(item, 0) + 1
        c -= item
    return used


def solve(histogram: dict[int, int], capacity: int = CONTEXT, rounds: int = 24, rate: float = 4.0) -> list[tuple[Config, int]]:
    """Fillings and how many sequences use each; every length is placed as often as it occurs."""
    need = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        need[length] = n
    lengths = np.flatnonzero(need)
    base = np.arange(capacity + 1) / capacity
    covered, mass = np.zeros(capacity + 1), {}
    for t in range(1, rounds + 1):
        lag = np.zeros(capacity + 1)
        lag[lengths] = t / rounds - covered[lengths] / need[lengths]
        value = np.where(need > 0, base * np.exp(rate * np.clip(lag, -1, 1) / rounds), -1.0)
        choice = _price(value, capacity)[1]
        for seed in lengths[::-1]:
            short = need[seed] * t / rounds - covered[seed]
            if short <= 0:
                continue
            used = _fill(int(seed), choice, capacity, need)
            step = min(short / used[int(seed)], *(need[k] / n for k, n in used.items()))
            config = tuple(sorted(used.items(), reverse=True))
            mass[config] = mass.get(config, 0.0) + step
            for k, n in used.items():
                covered[k] += step * n
    left, plan = need.copy(), []
    for config, x in sorted(mass.items(), key=lambda m: (-m[1], m[0])):
        times = int(min(np.floor(x), *(left[k] // n for k, n in config)))
        if times > 0:
            plan.append((config, times))
            for k, n in config:
                left[k] -= n * times
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing over a histogram; sequences filled alike are handled as one."""
    free: list[int] = []
    bins: dict[int, list[list]] = {}

    def put(room: int, filling: tuple, times: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(free, room)
        bins[room].append([filling, times])

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            i = bisect_left(free, length)
            if i == len(free):
                put(capacity - length, ((length, 1),), n)
                n = 0
                continue
            room = free[i]
            filling, times = bins[room].pop()
            took = min(times, n)
            if took < times:
                bins[room].append([filling, times - took])
            if not bins[room]:
                del bins[room], free[i]
            more = (*filling[:-1], (length, filling[-1][1] + 1)) if filling[-1][0] == length else (*filling, (length, 1))
            put(room - length, more, took)
            n -= took
    return [(filling, times) for held in bins.values() for filling, times in held]


def places(plan: list[tuple[Config, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first number of each run of places, its first sequence, places per sequence, offset."""
    runs: dict[int, list[list[int]]] = {}
    sequence = 0
    for config, times in plan:
        offset = 0
        for length, n in config:
            run = runs.setdefault(length, [[], [], [], [], [0]])
            for column, v in zip(run, (run[4][0], sequence, n, offset), strict=False):
                column.append(v)
            run[4][0] += n * times
            offset += length * n
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in run[:4]) for k, run in runs.items()}


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token pieces of every document: id, piece, start, length, ids_crc32, and a hash that tells rows apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            take, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(token_ids(b.column(1), vocabulary)):
                ids += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * context)):
                    part = ids[at : at + 4 * context]
                    take.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, sequence_id, offset: a row per piece."""
    spark = docs.sparkSession
    held = Scratch(spark, "pack").keep(pieces(docs, id_col=id_col, text_col=text_col, context=context, vocabulary=vocabulary), "pieces")
    histogram = {r.length: r.n for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(solve(histogram, context)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            length, number = b.column(names.index("length")).to_numpy(), b.column(names.index("pos")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, first = np.unique(length[order], return_index=True)
            for k, a, z in zip(kinds.tolist(), first, [*first[1:], len(order)], strict=True):
                rows = order[a:z]
                starts, sequences, each, at = table.value[k]
                run = np.searchsorted(starts, number[rows], side="right") - 1
                inside = number[rows] - starts[run]
                sequence[rows] = sequences[run] + inside // each[run]
                offset[rows] = at[run] + inside % each[run] * k
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in ("_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = numbered(held, ["length"], ["_id", "piece", "ids_crc32", "start"], salts=256)
    return ranked.mapInArrow(place, f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").withColumnRenamed("_id", id_col)
