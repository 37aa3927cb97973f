"""Jaccard join of documents on sets of word shingles: tiles by size, bitmap bounds, exact intersection.

Equal sets are one class, known by a 64-bit sum of mixed hashes. Two sets with similarity t or more share
one of the first ``n - ceil(t n) + 1`` members of each in any fixed order; the order here puts members
that many documents hold last, so boilerplate makes no candidates where anything rarer can. The sets that
share such a member are a group, cut into tiles of compatible sizes. What a cluster of near copies costs
must not grow with the square of its size, so links come in rounds, and each looks only at what the ones
before left apart:

1. every set is compared with one other, the smallest of a tile that it meets in most groups;
2. every two sets that are a group by themselves, of which there are no more than members shared;
3. twice, every set that its group's largest part lacks is compared with the group's medoid, the set
   nearest to the majority of all bitmaps;
4. every pair that still is apart, of which one isn't in the largest part of their group. Pairs are taken
   in blocks, so that no task holds a whole group.

The second and the last round leave no pair out. In each, a pair's overlap is first bounded from above by hashed parity
bitmaps, whose bits differ at most as often as the sets do, then counted exactly on the sorted arrays. The
result is components and the links that span them, not the whole join: pairs that are linked already
through others are skipped.

Sets take more room than their texts, so none is written but those of likely pairs: texts are hashed once
for sizes and bitmaps, once for postings, and again where an overlap is counted. Postings travel as blocks
of binary arrays by hash range, as many ranges as the texts' size asks for; a member that very many sets
hold is dealt to several ranges.

Defined cases: null, empty and blank texts have no set and link with nothing; a text with fewer words
than a shingle is one shingle; rows that share a doc_id keep their own sets; ties and repeated rows share
a class; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, merged
from .hashing import mix, shingle_sets
from .scratch import Scratch, flat, release, slices

#: Members held by more than this many documents come last in the order; at most MOST_COMMON such codes are broadcast.
COMMON, MOST_COMMON = 64, 1 << 20
#: Postings a task gathers before it sends a round of blocks.
FLUSH = 1 << 19
#: Text for each hash range of postings, in bytes, and postings of one member in a range.
RANGE_BYTES, CHUNK = 16 << 20, 1 << 17
#: Rows of a group that one medoid is chosen from; rows of a block of sets apart and of a block of all sets.
MEDOID_ROWS, APART_ROWS, ALL_ROWS = 1 << 16, 1 << 12, 1 << 14
#: Rows that a task of the later rounds gets, about.
TASK_ROWS = 1 << 15
#: Keys that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20
SMALLEST_MAP, LARGEST_MAP = 64, 1 << 13
_CAP = 0x7FFF


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def short_prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Enough for the smaller set of a pair, whose overlap is at least 2t / (1 + t) of it."""
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def parity_maps(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set a bitmap twice as wide as its size class; a member flips the bit that its hash names."""
    width = np.clip(2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), SMALLEST_MAP, LARGEST_MAP)
    first = np.concatenate(([0], np.cumsum(width)))
    at = np.repeat(first[:-1], n) + (mix(h, 21) % np.repeat(width, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(first[-1])) & 1).astype(np.uint8), bitorder="little")
    ends = (first // 8).tolist()
    held = packed.tobytes()
    return [held[a:b] for a, b in zip(ends, ends[1:])]


def most_overlap(a: bytes, b: bytes, na: int, nb: int) -> int:
    """Upper bound of the intersection: the wider map is folded to the narrower one's width."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    width = 8 * len(a)
    while width > 8 * len(b):
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    return (na + nb - (x ^ int.from_bytes(b, "little")).bit_count()) // 2


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, rows = shingle_sets(batch.column(batch.schema.names.index("_text")), width)
    return h, rows, np.bincount(rows, minlength=batch.num_rows).astype(np.int64)


def _keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of mixed members and the size, mixed again; 0 for empty sets."""
    keys, full = np.zeros(len(n), np.uint64), n > 0
    if full.any():
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        keys[full] = np.add.reduceat(mix(h, 5), first[full])
        keys[full] = mix(keys[full] + n[full].astype(np.uint64), 6)
    return keys.view(np.int64)


def _cut(codes: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted 64-bit hashes pass from one of ``parts`` equal ranges to the next."""
    return np.searchsorted(codes, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64))


_SEEN = ("_id", "n", "key", "bitmap", "bucket", "codes")


def _digest(width: int, percent: int, parts: int):
    """Per document its size, class and bitmap; in blocks, 32 bits of each prefix member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None

        def batch(count: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(count, k)) for c, k in zip(_SEEN, kinds)], names=list(_SEEN))

        def blocks() -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            runs = np.split((codes & np.uint64(0xFFFFFFFF)).astype("<u4"), _cut(codes, parts))
            full = [i for i, x in enumerate(runs) if len(x)]
            return batch(len(full), {"bucket": pa.array(full, pa.int32()), "codes": pa.array([runs[i].tobytes() for i in full], pa.binary())})

        for b in slices(batches, "_text", 1 << 20):
            kind = b.column(0).type
            h, _, n = _sets(b, width)
            yield batch(b.num_rows, {"_id": b.column(0), "n": pa.array(n), "key": pa.array(_keys(h, n)), "bitmap": pa.array(parity_maps(h, n), pa.binary())})
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            held.append(mix(h[place < np.repeat(prefix_length(n, percent), n)], 9))
            size += len(held[-1])
            if size >= FLUSH:
                yield blocks()
                held, size = [], 0
        if size:
            yield blocks()

    return run


def _members(width: int):
    """The class of each text that has a set, and the set's sorted members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 1 << 20):
            h, _, n = _sets(b, width)
            cuts, raw, full = np.concatenate(([0], np.cumsum(n))), h.astype("<u8").tobytes(), np.flatnonzero(n)
            held = [raw[8 * s : 8 * e] for s, e in zip(cuts[full].tolist(), cuts[full + 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(_keys(h, n)[full]), pa.array(held, pa.binary())], names=["key", "members"])

    return run


def _postings(width: int, percent: int, parts: int, common, chunk: int):
    """Blocks of (member, class, size) of the prefixes in the order that puts common members last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, often = common.value
        held, size = [], 0

        def blocks() -> pa.RecordBatch:
            sig, key, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((key, sig))
            sig, key, n = sig[order], key[order], n[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
            sig, key, n = sig[new], key[new], n[new]
            cuts = [0, *_cut(sig, parts).tolist(), len(sig)]
            low = (sig & np.uint64(0xFFFFFFFF)).astype("<u4")
            full = [i for i in range(parts) if cuts[i] < cuts[i + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()) for x in (low, key, n))], names=["bucket", "sig", "key", "n"])

        for b in slices(batches, "_text", 1 << 20):
            h, rows, n = _sets(b, width)
            key = _keys(h, n)
            member = mix(h, 9)
            low = (member & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            spot = np.minimum(np.searchsorted(codes, low), max(0, len(codes) - 1))
            late = codes[spot] == low if len(codes) else np.zeros(len(low), bool)
            order = np.lexsort((h, late, rows))
            place = np.arange(len(h)) - (np.cumsum(n) - n)[rows]
            inside = place < prefix_length(n, percent)[rows]
            short = np.where(n < _CAP, short_prefix_length(n, percent), prefix_length(n, percent))  # at the cap the smaller of two isn't known
            brief = place < short[rows]
            size16 = (np.minimum(n[rows], _CAP) | (brief.astype(np.int64) << 15)).astype("<u2")
            sig, keys = member[order], key[rows]
            if len(codes):  # a member of more than ``chunk`` sets: its sets are dealt to ranges by their class
                ways = np.where(late, -(-often[spot] // chunk), 1)[order].astype(np.uint64)
                many = ways > 1
                way = mix(keys.view(np.uint64), 16)[many] % ways[many]
                sig[many] = (sig[many] & np.uint64(0xFFFFFFFF)) | (mix(sig[many] + way, 17) & np.uint64(0xFFFFFFFF00000000))
            held.append((sig[inside], keys[inside], size16[inside]))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield blocks()
                held, size = [], 0
        if size:
            yield blocks()

    return run


def _tiles(percent: int, common, chunk: int):
    """One hash range: each tile's smallest set with the others, in how many tiles they meet and whether in one of just the two; larger groups also as a whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, often = common.value
        split = codes[often > chunk]
        sig = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["sig"]])
        key = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["key"]])
        n16 = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["n"]]).astype(np.int64)
        order = np.lexsort((n16, key, sig))
        sig, key, n16 = sig[order], key[order], n16[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, n16 = sig[new], key[new], n16[new]
        count = np.diff(np.append(np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))), len(sig)))
        shared = np.repeat(count > 1, count)
        if len(split):
            shared |= np.isin(sig, split)
        sig, key, n16 = sig[shared], key[shared], n16[shared]
        n, brief = n16 & _CAP, n16 >> 15
        order = np.lexsort((key, n, sig))
        sig, key, n, brief = sig[order], key[order], n[order], brief[order]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, int)
        last = np.concatenate((first[1:], [len(sig)])) if len(sig) else first
        hot = set(np.flatnonzero(np.isin(sig[first], split)).tolist()) if len(split) else set()
        a, b, groups = [], [], {}
        two = (last - first) == 2
        two[list(hot)] = False
        i = first[two]
        ok = (100 * n[i] >= percent * n[i + 1]) & (brief[i] == 1)
        a.append(key[i[ok]])
        b.append(key[i[ok] + 1])
        for at_, (s, e) in zip(np.flatnonzero(~two).tolist(), zip(first[~two].tolist(), last[~two].tolist())):
            size, at = n[s:e], 0
            while at < e - s:
                end = int(np.searchsorted(percent * size, 100 * size[at], side="right"))
                if brief[s + at] and end > at + 1:
                    a.append(np.full(end - at - 1, key[s + at]))
                    b.append(key[s + at + 1 : s + end])
                at = max(end, at + 1)
            part = hash_of(key[s:e])
            groups[int(sig[s]) if at_ in hot else part, part] = (at_ in hot, int(key[s]), key[s:e].astype("<i8").tobytes())
        just = len(a[0])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs, of, votes = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True, return_counts=True) if len(a) else (np.zeros((0, 2), np.int64), *np.zeros((2, 0), np.int64))
        alone = np.zeros(len(pairs), bool)
        alone[of.ravel()[:just]] = True
        none = [None] * len(pairs)
        release()
        return pd.DataFrame({
            "a": pd.array([*pairs[:, 0].tolist(), *(x[1] for x in groups.values())], "Int64"), "b": pd.array([*pairs[:, 1].tolist(), *[None] * len(groups)], "Int64"),
            "votes": pd.array([*votes.tolist(), *[None] * len(groups)], "Int64"), "g": pd.array([*none, *(g for g, _ in groups)], "Int64"), "part": pd.array([*none, *(p for _, p in groups)], "Int64"),
            "hot": [*none, *(x[0] for x in groups.values())], "keys": [*none, *(x[2] for x in groups.values())], "alone": [*alone.tolist(), *[None] * len(groups)],
        })

    return run


def hash_of(keys: np.ndarray) -> int:
    x = mix(np.sort(keys).view(np.uint64), 13)
    return int(np.bitwise_xor.reduce(mix(x + np.arange(len(x), dtype=np.uint64), 14)).view(np.int64))


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` bits; wider ones are folded to it, narrower ones stay empty."""
    out = np.zeros((len(maps), width // 64), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, "<u8")
        if 64 * len(x) >= width:
            out[i] = np.bitwise_xor.reduce(x.reshape(-1, width // 64), axis=0)
    return out


def _bound(n: np.ndarray, width: np.ndarray, tables: dict[int, np.ndarray], u: int, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of set ``u`` with ``others``: the wider map of two is folded to the other's width."""
    differ = np.zeros(len(others), np.int64)
    narrow = np.minimum(width[others], width[u])
    for w in np.unique(narrow).tolist():
        of = narrow == w
        differ[of] = np.bitwise_count(tables[w][others[of]] ^ tables[w][u]).sum(axis=1)
    return (n[others] + n[u] - differ) // 2


def _columns(pdf: pd.DataFrame):
    maps = pdf["bitmap"].tolist()
    width = np.array([8 * len(m) for m in maps])
    return pdf["key"].to_numpy(), pdf["full"].to_numpy(), pdf["label"].to_numpy(), width, {w: _folded(maps, w) for w in np.unique(width).tolist()}


def _cuts(*columns: np.ndarray) -> list[tuple[int, int]]:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.append(np.flatnonzero(new), len(new)).tolist()
    return list(zip(at, at[1:]))


def _medoids(percent: int):
    """Sets outside their group's largest part, each with the medoid of the group and of those outside, the likelier one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "i", "full", "key"], ignore_index=True)
        key, n, label, width, tables = _columns(pdf)
        odd, out = pdf["odd"].to_numpy(), []
        for s, e in _cuts(pdf["g"].to_numpy(), pdf["i"].to_numpy()):
            at = s
            while at < e:
                end = int(np.searchsorted(percent * n[at:e], 100 * n[at], side="right")) + at
                tile = np.arange(at, end)
                for some in (tile, tile[odd[tile]]):
                    if len(some) < 2 or not odd[tile].any():
                        continue
                    maps = tables[int(width[some].min())][some]
                    ones = sum(np.unpackbits(maps[k : k + 1024].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(maps), 1024))
                    majority = np.packbits(2 * ones > len(some)).view(np.uint64)
                    medoid = int(some[np.bitwise_count(maps ^ majority).sum(axis=1).argmin()])
                    others = tile[odd[tile] & (label[tile] != label[medoid])]
                    overlap = _bound(n, width, tables, medoid, others)
                    total = n[others] + n[medoid]
                    ok = (100 + percent) * overlap >= percent * total
                    out.append(np.stack([key[others[ok]], np.full(int(ok.sum()), key[medoid]), 1_000_000 * overlap[ok] // total[ok]], 1))
                at = end
        pairs = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
        release()
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "likely": pairs[:, 2]})

    return run


def _apart(percent: int):
    """All pairs of a block of sets apart and a block of all sets whose labels differ and whose sizes and bitmaps allow the similarity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "i", "j", "asks", "full", "key"], ignore_index=True)
        key, n, label, width, tables = _columns(pdf)
        asks, odd, out = pdf["asks"].to_numpy(), pdf["odd"].to_numpy(), []
        for s, e in _cuts(*(pdf[c].to_numpy() for c in ("g", "i", "j"))):
            middle = s + int((~asks[s:e]).sum())
            for u in range(middle, e):
                lo = s + int(np.searchsorted(100 * n[s:middle], percent * n[u], side="left"))
                hi = s + int(np.searchsorted(percent * n[s:middle], 100 * n[u], side="right"))
                others = np.arange(lo, hi)
                others = others[(label[lo:hi] != label[u]) & (~odd[lo:hi] | (key[lo:hi] > key[u]))]
                if len(others):
                    others = others[(100 + percent) * _bound(n, width, tables, u, others) >= percent * (n[others] + n[u])]
                    out.append(np.stack([np.full(len(others), key[u]), key[others]], 1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        release()
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


class JaccardJoin:
    """One run over a table: ``documents`` (a row per row), spanning ``links`` between classes (of what is
    connected, not every pair at the threshold), ``labels`` of classes."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, chunk: int = CHUNK, block: int = APART_ROWS):
        self.spark, self.width, self.percent, self.block = docs.sparkSession, width, percent, block
        self.scratch = Scratch(self.spark, "jaccard")
        kind = docs.schema[id_col].dataType.simpleString()
        slim = self.texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        parts = max(8, (slim.agg(F.sum(F.octet_length("_text").cast("long")).alias("n")).first().n or 0) // RANGE_BYTES)
        seen = self.scratch.keep(slim.mapInArrow(_digest(width, percent, parts), f"_id {kind}, n bigint, key bigint, bitmap binary, bucket int, codes binary"), "seen")
        self.documents = seen.filter("bucket IS NULL").select("_id", "n", "key")
        full = seen.filter("bucket IS NULL AND n > 0")
        self.classes = self.scratch.keep(full.groupBy("key").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "classes")
        common = self.spark.sparkContext.broadcast(self._common(seen.filter("bucket IS NOT NULL").select("bucket", "codes")))
        blocks = slim.select("_text").mapInArrow(_postings(width, percent, parts, common, chunk), "bucket int, sig binary, key binary, n binary")
        found = self.scratch.keep(blocks.groupBy("bucket").applyInPandas(_tiles(percent, common, chunk), "a bigint, b bigint, votes bigint, g bigint, part bigint, hot boolean, keys binary, alone boolean"), "found")

        stars = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum("votes").alias("votes"))
        most = stars.groupBy("b").agg(F.max(F.struct("votes", "a")).alias("x")).select("x.a", "b")
        split = found.filter("hot").select("g", "a")
        across = split.join(split.groupBy("g").agg(F.min("a").alias("b")), "g").filter("a <> b").select("a", "b")
        links = [self._verified(most.union(across).distinct(), "first")]
        self.labels = self.scratch.keep(components(links[0], self.scratch, "one"), "one-labels")
        self.groups = self.scratch.keep(found.filter("g IS NOT NULL").select("g", "part", "keys").dropDuplicates(["g", "part"]).select("g", "keys"), "groups")
        links.append(self._verified(self._left(found.filter("alone").select("a", "b").distinct()), "two"))
        self.labels = merged(self.labels, links[-1], self.scratch, "two")
        self.scratch.drop("found")
        for name, propose in (("second", self._nearest), ("third", self._nearest), ("rest", self._rest)):
            rows = self._mixed(f"{name}-rows")
            if rows is None:
                break
            links.append(self._verified(propose(rows), name))
            self.labels = merged(self.labels, links[-1], self.scratch, name)
            self.scratch.drop(f"{name}-rows")
        self.links = functools.reduce(DataFrame.union, links)

    def _common(self, blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Codes that many documents hold, in order, and by how many."""
        total = blocks.agg(F.coalesce(F.sum(F.octet_length("codes").cast("long")), F.lit(0)).alias("n")).first().n // 4
        least = max(COMMON, total // MOST_COMMON + 1)

        def often(pdf: pd.DataFrame) -> pd.DataFrame:
            codes, n = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in pdf["codes"]]), return_counts=True)
            return pd.DataFrame({"codes": [codes[n > least].astype("<u4").tobytes()], "counts": [n[n > least].astype("<i8").tobytes()]})

        rows = blocks.groupBy("bucket").applyInPandas(often, "codes binary, counts binary").filter(F.octet_length("codes") > 0).collect()
        if not rows:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        codes, n = (np.concatenate([np.frombuffer(bytes(r[i]), t) for r in rows]) for i, t in ((0, "<u4"), (1, "<i8")))
        order = np.argsort(codes, kind="stable")
        codes, first = np.unique(codes[order], return_index=True)
        return codes, np.add.reduceat(n[order], first)

    def _left(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the links so far leave apart."""
        for side in ("a", "b"):
            pairs = pairs.join(self.labels.select(F.col("node").alias(side), F.col("root").alias(f"_{side}")), side, "left")
        return pairs.filter("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")

    def _nearest(self, rows: DataFrame) -> DataFrame:
        proposed = rows.groupBy(self._dealt("g", "i")).applyInPandas(_medoids(self.percent), "a bigint, b bigint, likely bigint")
        return proposed.groupBy("a").agg(F.max(F.struct("likely", "b")).alias("x")).select("a", "x.b")

    def _rest(self, rows: DataFrame) -> DataFrame:
        slim = ("g", "key", "full", "label", "bitmap", "odd")
        place = lambda seed, of: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(of))
        every = lambda of: F.explode(F.expr(f"sequence(0L, {of} - 1)"))
        held = rows.select(*slim, F.lit(False).alias("asks"), every("apart").alias("i"), place(1, "blocks").alias("j"))
        asking = rows.filter("odd").select(*slim, F.lit(True).alias("asks"), place(2, "apart").alias("i"), every("blocks").alias("j"))
        return held.unionByName(asking).groupBy(self._dealt("g", "i", "j")).applyInPandas(_apart(self.percent), "a bigint, b bigint").distinct()

    def _mixed(self, name: str) -> DataFrame | None:
        """Sets of the groups that the links so far leave apart, and whether they are outside the largest part; None without any."""

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "keys"):
                data, at = flat(b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), np.diff(at) // 8)), pa.array(data.view("<i8"))], names=["g", "key"])

        rows = self.groups.select("g", "keys").mapInArrow(members, "g bigint, key bigint")
        known = rows.join(self.labels, rows.key == self.labels.node, "left").select("g", "key", F.coalesce("root", "key").alias("label"))
        parts = known.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
        mixed = parts.groupBy("g").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top")).filter("m > top.c").select("g", F.col("top.label").alias("largest"), "m", F.col("top.c").alias("c"))
        maps = self.classes.select("key", F.col("n").alias("full"), "bitmap")
        out = known.join(mixed, "g").select(
            "g", "key", "label", (F.col("label") != F.col("largest")).alias("odd"), F.ceil((F.col("m") - F.col("c")) / self.block).alias("apart"), F.ceil(F.col("m") / (self.block * ALL_ROWS // APART_ROWS)).alias("blocks"),
            F.pmod(F.xxhash64("key", F.lit(3)), F.ceil(F.col("m") / MEDOID_ROWS)).alias("i"),
        )
        kept = self.scratch.keep(out.join(maps, "key"), name)
        count = kept.count()
        self.tasks = max(self.spark.sparkContext.defaultParallelism, count // TASK_ROWS)
        return kept if count else None

    def _dealt(self, *columns: str):
        return F.pmod(F.xxhash64(*columns), F.lit(4 * self.tasks)).alias("part")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that reach the similarity: bitmaps bound the overlap, sorted arrays settle it."""
        percent = self.percent

        def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb, ma, mb = (batch.column(i).to_pylist() for i in range(2, 6))
                ok = [(100 + percent) * most_overlap(x, y, m, n) >= percent * (m + n) for m, n, x, y in zip(na, nb, ma, mb)]
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

        left = self.classes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
        right = self.classes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
        wide = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb")
        likely = self.scratch.keep(wide.mapInArrow(bounded, "a bigint, b bigint"), f"{name}-likely")
        keys = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(self.classes.select("key", F.xxhash64("rep").alias("row")), "key")
        keys = self.scratch.keep(keys, f"{name}-keys")
        few = keys.count() <= BROADCAST_KEYS
        wanted = lambda c: F.broadcast(keys.select(c)) if few else keys.select(c)
        texts = self.texts.withColumn("row", F.xxhash64("_id")).join(wanted("row"), "row", "left_semi").select("_text")
        sets = texts.mapInArrow(_members(self.width), "key bigint, members binary").join(wanted("key"), "key", "left_semi").dropDuplicates(["key"])
        sets = self.scratch.keep(sets, f"{name}-sets")

        def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])
            release()

        both = likely.join(sets.select(F.col("key").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
        links = self.scratch.keep(both.select("a", "b", "x", "y").mapInArrow(settled, "a bigint, b bigint"), f"{name}-links")
        self.scratch.drop(f"{name}-likely", f"{name}-keys", f"{name}-sets")
        return links


def ngram_jaccard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, chunk: int = CHUNK, block: int = APART_ROWS) -> DataFrame:
    """``id_col``, n_shingles, component_id: the smallest id reachable by links, itself included."""
    run = JaccardJoin(docs, id_col=id_col, text_col=text_col, width=width, percent=percent, chunk=chunk, block=block)
    named = run.classes.join(run.labels, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    of = named.join(smallest, "root").select("key", "component")
    rows = run.documents.join(of.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    result = run.scratch.keep(rows.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id")), "result")
    run.scratch.only("result")
    return result
