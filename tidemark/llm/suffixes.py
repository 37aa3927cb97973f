"""Suffix-array dedup: long byte strings that occur more than once, found by longest-previous-factor arrays.

A string of ``length`` bytes is judged by a window. Each window is assigned to an anchor, the smallest
hash among the shorter grams inside it, so equal windows have equal anchors wherever they stand, and the
windows of one anchor form a run. A run's bytes are its context. Contexts that occur more than once settle
all their windows by counting. What is left are contexts that share an anchor with a different one, where
a repeated passage begins or ends. Those are brought together by anchor, a suffix array orders them, and
each window's longest previous (or next) factor comes from the previous and next smaller positions in
suffix order. An anchor with more contexts than one array takes is refined first: its windows are dealt by
where the anchor stands in them to ranges, half as wide in each round, and the bytes that all windows of a
range share become a longer anchor. Contexts that only had the short one in common part there, those equal
within a range settle by counting, and each round has at most two rows for one of the round before.

``keep="first"`` removes later copies (order: id, then place) and keeps the first; ``keep="none"`` removes
every copy. Strings are judged on the input; matches never cross documents.

With ``words``, the unit is a word and not a byte: each word becomes a hash of ``CODE`` bytes, the arrays run
over these, and passages of at least that many equal words go, however long or spaced their words are.

Defined cases: null text is empty; texts shorter than the length lose nothing; rows that are equal in id
and text hold each other's strings when every copy goes, and count as one row when the first stays; a null
id is first in order; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import mix, powers, prefix_hash
from .scratch import Scratch, flat, release, slices, words as words_of

LENGTH, GRAM = 400, 100
#: Different contexts of one anchor that one suffix array takes; with more, the anchor is refined.
MOST_CONTEXTS = 1024
#: Bytes of one suffix array, and of the contexts that one task gets.
ARRAY_BYTES, TASK_BYTES = 512 << 10, 8 << 20
#: Bytes of a word's hash.
CODE = 6
_SLICE, _PLACE = 1 << 18, np.uint64((1 << 28) - 1)


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: anchor hash, context hash, row, first and last window, place of the anchor in the first."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    sums, down = prefix_hash(data), powers(n + 1)[1]
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1], 31)
    place = np.arange(len(grams), dtype=np.uint64)
    chosen = (_least((grams & ~_PLACE) | place, length - gram + 1) & _PLACE).astype(np.int64)
    room = np.maximum(np.diff(at) - length + 1, 0)
    starts = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(room)))[:-1], room) + np.arange(int(room.sum()))
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    p = chosen[starts]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
    i = np.flatnonzero(new)
    first, last, p = starts[i], starts[np.append(i[1:], len(p)) - 1], p[i]
    shape = ((p - first) * 4096 + (last - first)).astype(np.uint64)
    context = mix((sums[last + length] - sums[first]) * down[first] + mix(shape, 32), 33)
    return grams[p], context, np.searchsorted(at, first, side="right") - 1, first, last, p - first


def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all places by their next 8, 16, ... bytes and at last by ``length``; equal strings, equal rank."""
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    wide = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        wide = (wide << np.uint64(8)) | padded[k : len(padded) - 7 + k].astype(np.uint64)
    rank, depth, levels = np.unique(wide, return_inverse=True)[1].astype(np.uint64), 8, []
    levels.append((depth, rank))
    while depth < length:
        ahead = min(depth, length - depth)
        key = rank[: len(rank) - ahead] * np.uint64(len(rank) + 1) + rank[ahead:]
        rank, depth = np.unique(key, return_inverse=True)[1].astype(np.uint64), depth + ahead
        levels.append((depth, rank))
    return levels


def _smaller(order: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest earlier entry with a smaller value, or -1."""
    values = np.append(order, -1)
    near = np.arange(-1, len(order) - 1)
    todo = np.flatnonzero(values[near] > order)
    while len(todo):
        near[todo] = near[near[todo]]
        todo = todo[values[near[todo]] > order[todo]]
    return near


def previous_factor(levels: list[tuple[int, np.ndarray]], starts: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest previous factor, up to the depth of ``levels``, of the suffixes at ``starts``.

    ``position`` gives their order in the text. In suffix order only the previous and the next entry of
    smaller position can hold the longest earlier match; its length is read off the ranks, longest first.
    """
    suffix = np.lexsort((position, levels[-1][1][starts]))
    held, place = position[suffix], starts[suffix]
    best = np.zeros(len(starts), np.int64)
    back = _smaller(held)
    ahead = len(held) - 1 - _smaller(held[::-1])[::-1]
    for near in (back, np.where(ahead >= len(held), -1, ahead)):
        i, j = place, np.where(near >= 0, place[near], 0)
        match, ok = np.zeros(len(i), np.int64), near >= 0
        for depth, rank in levels[::-1]:
            x, y = np.minimum(i + match, len(rank) - 1), np.minimum(j + match, len(rank) - 1)
            same = ok & (match + depth <= levels[-1][0]) & (rank[x] == rank[y])
            match[same] += depth
        best = np.maximum(best, np.where(ok, match, 0))
    out = np.empty_like(best)
    out[suffix] = best
    return out


def _runs(windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted window starts as runs of covered bytes."""
    if not len(windows):
        return windows, windows
    cut = np.flatnonzero(np.diff(windows) > 1)
    return windows[np.append(0, cut + 1)], windows[np.append(cut, len(windows) - 1)] + length


def _repeats(length: int, keep: str):
    """Covered bytes within the contexts of a hash range, by suffix arrays over whole anchors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["ah", "ch"]).sort_values(["ah", "ord", "dk", "s0"], ignore_index=True)
        sizes, ah = pdf["ctx"].str.len().to_numpy(np.int64), pdf["ah"].to_numpy()
        bounds = np.append(np.flatnonzero(np.concatenate(([True], ah[1:] != ah[:-1]))), len(ah))
        out, lo = [], 0
        while lo < len(bounds) - 1:
            hi = lo + 1
            while hi < len(bounds) - 1 and sizes[bounds[lo] : bounds[hi + 1]].sum() <= ARRAY_BYTES:
                hi += 1
            a, z = bounds[lo], bounds[hi]
            part = pdf.iloc[a:z]
            data = np.frombuffer(b"".join(part["ctx"]), np.uint8)
            count = sizes[a:z] - length + 1
            base = np.concatenate(([0], np.cumsum(sizes[a:z])))[:-1]
            which = np.repeat(np.arange(z - a), count)
            inside = np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
            starts = base[which] + inside
            order = part[["ord", "dk", "s0"]].to_numpy(np.int64)
            position = np.empty(len(starts), np.int64)
            position[np.lexsort((order[which, 2] + inside, order[which, 1], order[which, 0]))] = np.arange(len(starts))
            levels = suffix_ranks(data, length)
            hit = previous_factor(levels, starts, position) >= length
            if keep == "none":
                hit |= previous_factor(levels, starts, len(starts) - 1 - position) >= length
            rows, spots = which[hit], inside[hit]
            for k in np.unique(rows).tolist():
                s, e = _runs(spots[np.searchsorted(rows, k) : np.searchsorted(rows, k, side="right")], length)
                out.append((np.full(len(s), order[k, 1]), s + order[k, 2], e + order[k, 2]))
            lo = hi
        dk, s, e = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        release()
        return pd.DataFrame({"dk": dk, "s": s, "e": e})

    return run


def _halves(length: int, gram: int, width: int):
    """Contexts cut by where the anchor stands in a window, ``width`` places to a range, with the longer anchor of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ctx", _SLICE):
            data, at = flat(b.column(4))
            sums, down = prefix_hash(data), powers(len(data) + 1)[1]
            most = b.column(3).to_numpy().astype(np.int64)
            least = most - (np.diff(at) - length)
            ranges = most // width - least // width + 1
            r = np.repeat(np.arange(b.num_rows), ranges)
            low = (least[r] // width + np.arange(len(r)) - np.repeat(np.concatenate(([0], np.cumsum(ranges)))[:-1], ranges)) * width
            high, zero = low + width - 1, at[r] + most[r]
            first, last = np.minimum(most[r], high), np.maximum(least[r], low)
            inner = np.minimum(high, length - gram)
            anchor = mix((sums[zero + length - inner] - sums[zero - low]) * down[zero - low] + mix((low * 4096 + inner).astype(np.uint64), 36), 37)
            start, end = zero - first, zero - last + length
            context = mix((sums[end] - sums[start]) * down[start] + mix((first * 4096 + last).astype(np.uint64), 38), 39)
            held = data.tobytes()
            dk, order, s0 = (b.column(k).to_numpy()[r] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (anchor.view(np.int64), context.view(np.int64), dk, order, s0 + start - at[r], first)), pa.array([held[i:j] for i, j in zip(start.tolist(), end.tolist())], pa.binary())],
                names=["ah", "ch", "dk", "ord", "s0", "x", "ctx"],
            )

    return run


def repeated_spans(slim: DataFrame, scratch: Scratch, *, length: int, gram: int, keep: str, most: int = MOST_CONTEXTS, units=flat) -> DataFrame:
    """``dk``, ``s``, ``e``: byte ranges to remove; ``slim`` has dk (64-bit row key), ord and _text.

    ``units`` gives the bytes that are judged and their offsets, from a column of texts. It runs inside the
    task that uses them, so that a task never holds two Python workers.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", _SLICE):
            data, at = units(b.column(2))
            ah, ch, row, first, last, x = anchors(data, at, length, gram)
            dk, order = (b.column(k).to_numpy()[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(dk), pa.array(order), *(pa.array(v.astype(np.int32)) for v in (first - at[row], last - at[row], x))], names=["ah", "ch", "dk", "ord", "s0", "s1", "x"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", _SLICE):
            data, at = units(b.column(0))
            held, wanted = data.tobytes(), b.column(1)
            row = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy())
            k, ah, ch, dk, order, s0, s1, x = (v.to_numpy() for v in wanted.flatten().flatten())
            start, end = at[row] + s0, at[row] + s1 + length
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v.astype(np.int64)) for v in (k, ah, ch, dk, order, s0, x)), pa.array([held[i:j] for i, j in zip(start.tolist(), end.tolist())], pa.binary())], names=["k", "ah", "ch", "dk", "ord", "s0", "x", "ctx"]
            )

    def equal(rows: DataFrame, kinds: DataFrame, end) -> DataFrame:
        """Spans of the contexts that occur more than once."""
        whole = rows.join(kinds.filter("c > 1").select("ch", "lead"), "ch")
        if keep == "first":
            whole = whole.filter("struct(ord, dk, s0) <> struct(lead.ord, lead.dk, lead.s0)")
        return whole.select("dk", F.col("s0").cast("long").alias("s"), end.cast("long").alias("e"))

    def grouped(kinds: DataFrame, name: str) -> tuple[DataFrame, int, bool]:
        """Anchors with several different contexts; how many contexts arrays will take; whether any anchor has too many."""
        shared = scratch.keep(kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), name)
        n = shared.agg(F.sum(F.when(F.col("k") <= most, F.col("k"))).alias("few"), F.max("k").alias("top")).first()
        return shared, n.few or 0, (n.top or 0) > most

    shape = "ah bigint, ch bigint, dk bigint, ord bigint, s0 bigint, x bigint, ctx binary"
    runs = scratch.keep(slim.mapInArrow(mark, "ah bigint, ch bigint, dk bigint, ord bigint, s0 int, s1 int, x int"), "runs")
    kinds = scratch.keep(runs.groupBy("ch").agg(F.first("ah").alias("ah"), F.count(F.lit(1)).alias("c"), F.min(F.struct("ord", "dk", "s0", "s1", "x")).alias("lead")), "kinds")
    spans = scratch.keep(equal(runs, kinds, F.col("s1") + F.lit(length)), "equal")
    scratch.drop("runs")
    shared, few, crowded = grouped(kinds, "shared")
    wanted = kinds.join(shared, "ah").select("lead.dk", F.struct("k", "ah", "ch", "lead.dk", "lead.ord", "lead.s0", "lead.s1", "lead.x").alias("w")).groupBy("dk").agg(F.collect_list("w").alias("wanted"))
    contexts = scratch.keep(slim.select("dk", "_text").join(wanted, "dk").select("_text", "wanted").mapInArrow(fetch, f"k bigint, {shape}"), "contexts")
    scratch.drop("kinds", "shared")

    width, level, last = 1 << max(0, ((length - gram) // 2).bit_length() - 1), 0, "contexts"
    while True:
        parts = max(slim.sparkSession.sparkContext.defaultParallelism, few * 2 * length // TASK_BYTES)
        arrays = contexts.filter(F.col("k") <= most).groupBy(F.pmod(F.xxhash64("ah"), F.lit(parts)).alias("part"))
        spans = spans.union(scratch.keep(arrays.applyInPandas(_repeats(length, keep), "dk bigint, s bigint, e bigint"), f"found-{level}"))
        if not crowded:
            scratch.drop(last)
            return spans
        crowd = contexts.filter(F.col("k") > most).dropDuplicates(["ah", "ch"]).select("dk", "ord", "s0", "x", "ctx")
        finer = scratch.keep(crowd.mapInArrow(_halves(length, gram, width), shape), f"finer-{level}")
        scratch.drop(last)
        kinds = scratch.keep(finer.groupBy("ch").agg(F.first("ah").alias("ah"), F.count(F.lit(1)).alias("c"), F.min(F.struct("ord", "dk", "s0")).alias("lead")), f"kinds-{level}")
        spans = spans.union(scratch.keep(equal(finer, kinds, F.col("s0") + F.octet_length("ctx")), f"equal-{level}"))
        shared, few, crowded = grouped(kinds, f"shared-{level}")
        first = kinds.join(shared, "ah").select("ch", "k", F.col("lead.dk").alias("dk"), F.col("lead.s0").alias("s0"))
        last = f"contexts-{level}"
        contexts = scratch.keep(finer.join(first, ["ch", "dk", "s0"]).select("k", "ah", "ch", "dk", "ord", "s0", "x", "ctx"), last)
        scratch.drop(f"finer-{level}", f"kinds-{level}", f"shared-{level}")
        width, level = max(1, width // 2), level + 1


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text as hashes, one after the other, and the offsets of the texts."""
    data, at = flat(column)
    if not len(data):
        return data, at
    starts, ends, rows = words_of(data, at)
    sums, down = prefix_hash(data), powers(len(data) + 1)[1]
    codes = np.ascontiguousarray(mix((sums[ends] - sums[starts]) * down[starts], 35).view(np.uint8).reshape(-1, 8)[:, :CODE]).ravel()
    return codes, np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(at) - 1) * CODE)))


def _bytes_of(raw: bytes, s: list[int], e: list[int]) -> tuple[list[int], list[int]]:
    """Ranges of word hashes as byte ranges of the text; a hash counts if it's whole."""
    starts = np.append(words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], len(raw))
    pairs = [(-(-a // CODE), z // CODE) for a, z in zip(s, e)]
    return [int(starts[a]) for a, z in pairs if z > a], [int(starts[z]) for a, z in pairs if z > a]


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: str = "first", carry: tuple[str, ...] = (), words: int | None = None, most: int = MOST_CONTEXTS) -> DataFrame:
    """``id_col``, ``carry``, n_bytes, n_removed, n_spans, kept (text), kept_sha256; a row per input row."""
    scratch = Scratch(docs.sparkSession, "suffix")
    kind = docs.schema[id_col].dataType
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))) if isinstance(kind, T.IntegralType) else F.xxhash64(F.col(id_col))
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.xxhash64(id_col, text_col).alias("dk"), order.alias("ord"), F.struct(*[F.col(c) for c in carry], F.lit(1).alias("_one")).alias("_more"))
    slim = base.select("dk", "ord", "_text")
    if words:
        length, gram = words * CODE, max(1, words // 4) * CODE
    slim = slim.filter(F.octet_length("_text") >= (2 * words - 1 if words else length))
    spans = repeated_spans(slim, scratch, length=length, gram=gram, keep=keep, most=most, units=_coded if words else flat)
    cuts = scratch.keep(spans.groupBy("dk").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("cuts")), "cuts")
    scratch.only("cuts")
    listed = base.join(cuts, "dk", "left").select("_id", "_text", "_more", F.col("cuts.s").alias("s"), F.col("cuts.e").alias("e"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], "_text"):
                rows = []
                for text, s, e in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    raw, kept, removed, spans, done = text.encode("utf-8"), [], 0, 0, 0
                    i = 0
                    if s and words:
                        s, e = _bytes_of(raw, s, e)
                    while s and i < len(s):
                        start, end = s[i], e[i]
                        while i + 1 < len(s) and s[i + 1] <= end:
                            i += 1
                            end = max(end, e[i])
                        kept.append(raw[done:start])
                        removed, spans, done, i = removed + end - start, spans + 1, end, i + 1
                    kept.append(raw[done:])
                    left = b"".join(kept)
                    rows.append((len(raw), removed, spans, left.decode("utf-8", "ignore"), hashlib.sha256(left).hexdigest()))
                n, removed, spans, left, sha = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(left, pa.string()), pa.array(sha, pa.string())], names=["_id", "_more", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    schema = T.StructType([listed.schema["_id"], listed.schema["_more"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    out = listed.mapInArrow(cut, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_more.{c}") for c in carry), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
