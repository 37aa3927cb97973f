"""Ids of whole texts by a merge-type piece vocabulary, and texts from ids.

Every symbol of a text starts as one character. An agenda holds the adjacent pairs whose joined string is
a piece; the pair of the best score is merged first, the leftmost one among equals, until none is left.
Characters that are no piece become bytes. Two neighbours that stand side by side in no piece are never
merged, nor is anything across them, so a text falls into units there and each distinct unit is merged
once per worker: short units all in step (a merge of each per round), long ones with a heap.

Each unit's ids and surface are compared with the published library's where a worker first meets the unit, inside
the same Arrow batch, and a difference raises. In a task's first slice the whole row that holds the unit is encoded
and decoded by the library too; later the new units of a slice are, set apart by a character that no longer piece
holds, and not the known ones around them. Without such a character all rows with a new unit are read whole. A unit
that was compared before, and not forgotten since, isn't compared again. What the agenda doesn't know raises as
well: a vocabulary without byte pieces, one with unused pieces, or one whose normal form changes texts.

Defined cases: null and empty texts are the end id alone; rows that repeat are encoded each on its own;
columns carried along keep their names unless an output has the name; an empty table gives no rows. A
text is held whole by one worker, with its ids (four bytes each).
"""

from __future__ import annotations

import codecs
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import BATCH_BYTES, BATCH_SETTING, SPARKS_LIMIT, flat, slices
from .tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units that a worker remembers, the longest one of them in characters, and the longest that is merged in step.
MOST_UNITS, LONGEST_UNIT, LONG = 300_000, 64, 48
#: New units in one text that the library reads.
TOGETHER = 512
_NONE = np.iinfo(np.int64).max

codecs.register_error("byte by byte", lambda e: ("�", e.start + 1))
_codecs: dict[str, "PieceCodec"] = {}


class PieceCodec:
    """One vocabulary: its pieces, the pairs that make them, and what was encoded before."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = s = SentencePieceProcessor(model_file=path)
        self.size, self.end = s.vocab_size(), s.eos_id()
        known = {s.id_to_piece(i): i for i in range(self.size) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i))}
        raw = [s.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(s.is_byte(i) for i in raw) or any(s.is_unused(i) for i in known.values()):
            raise ValueError(f"{path} is no vocabulary with byte pieces and all pieces in use")
        self.bytes = np.array(raw, np.int32)
        self._pairs(known)
        self._surfaces(known, raw)
        single = [c for c in map(chr, range(128)) if c != SPACE and not any(c in p for p in known if len(p) > 1)]
        alone = "".join(map(re.escape, single))
        #: A character that is a unit wherever it stands; None if the vocabulary has none.
        self.apart = next(iter(single), None)
        self.unit = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}

    def _pairs(self, known: dict[str, int]) -> None:
        """Numbers of the symbols, the pairs of symbols that make a piece, and the order of the pieces."""
        number, beside = dict(known), set()
        for piece in known:
            for c in piece:
                number.setdefault(c, self.size + len(number) - len(known))
            beside.update(ord(a) << 21 | ord(b) for a, b in zip(piece, piece[1:]))
        made = {number[p[:k]] << 24 | number[p[k:]]: i for p, i in known.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.made, self.slots = made, max(8, (4 * len(made)).bit_length())
        self.key, self.piece = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, -1, np.int64)
        for k, i in made.items():
            at = int(self._slot(np.array([k], np.int64))[0])
            while self.key[at] >= 0:
                at = (at + 1) & ((1 << self.slots) - 1)
            self.key[at], self.piece[at] = k, i
        self.beside = np.array(sorted(beside), np.int64)
        scores = np.array([self.library.get_score(i) for i in range(self.size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.symbol = np.full(0x110000, -1, np.int64)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i

    def _surfaces(self, known: dict[str, int], raw: list[int]) -> None:
        self.surface = [b""] * self.size
        self.spaced = [False] * self.size
        for piece, i in known.items():
            self.surface[i], self.spaced[i] = piece.replace(SPACE, " ").encode(), piece.startswith(SPACE)
        for b, i in enumerate(raw):
            self.surface[i] = bytes([b])
        #: Ids without a text of their own; they end a run of bytes.
        self.silent = frozenset(i for i in range(self.size) if self.library.is_control(i))
        unknown = self.library.unk_id()
        self.surface[unknown] = self.library.decode([unknown]).encode()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.slots)).astype(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none; symbols below 0 are in no pair."""
        key = left << 24 | right
        at = self._slot(key)
        held = self.key[at]
        out = np.where(held == key, self.piece[at], -1)
        further = np.flatnonzero((held != key) & (held >= 0))
        while len(further):
            at[further] = (at[further] + 1) & ((1 << self.slots) - 1)
            held = self.key[at[further]]
            hit = held == key[further]
            out[further[hit]] = self.piece[at[further[hit]]]
            further = further[~hit & (held >= 0)]
        return np.where((left < 0) | (right < 0), -1, out)

    def _in_step(self, symbol: np.ndarray, of: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge runs of symbols (``of`` names the run): each round takes the head of every run's agenda."""
        pair = np.full(len(symbol), -1, np.int64)
        inner = np.flatnonzero(of[:-1] == of[1:])
        pair[inner] = self._found(symbol[inner], symbol[inner + 1])
        while len(symbol):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            agenda = np.where(pair < 0, _NONE, self.rank[pair] << 32 | np.arange(len(pair)))
            head = np.minimum.reduceat(agenda, first)
            open_runs = head < _NONE
            alive = np.repeat(open_runs, np.diff(np.r_[first, len(symbol)]))
            if not alive.all():
                yield start[~alive], symbol[~alive]
            at = head[open_runs] & 0xFFFFFFFF
            symbol[at] = pair[at]
            alive[at + 1] = False
            place = np.cumsum(alive)[at] - 1
            symbol, of, start, pair = symbol[alive], of[alive], start[alive], pair[alive]
            for changed in (place, place[place > 0] - 1):
                last = changed + 1 >= len(symbol)
                after = np.where(last, changed, changed + 1)
                joined = ~last & (of[changed] == of[after])
                pair[changed] = np.where(joined, self._found(symbol[changed], symbol[after]), -1)

    def _by_heap(self, symbol: list[int]) -> tuple[list[int], list[int]]:
        """Merge one long run with a heap of pairs; entries whose symbols have changed since are passed over."""
        n, made, rank = len(symbol), self.made, self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j < n and (piece := made.get(symbol[i] << 24 | symbol[j])) is not None:
                heapq.heappush(heap, (int(rank[piece]), i, j, symbol[i], symbol[j], piece))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, i, j, left, right, piece = heapq.heappop(heap)
            if symbol[i] != left or symbol[j] != right or after[i] != j:
                continue
            symbol[i], symbol[j] = piece, -2
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            propose(before[i], i)
            propose(i, after[i])
        left = [i for i in range(n) if symbol[i] != -2]
        return left, [symbol[i] for i in left]

    def merge(self, units: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each unit."""
        letters = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        symbol = self.symbol[letters]
        beside = letters[:-1] << 21 | letters[1:]
        joins = self.beside[np.minimum(np.searchsorted(self.beside, beside), len(self.beside) - 1)] == beside if len(self.beside) else np.zeros(len(beside), bool)
        cut = np.r_[True, ~joins]
        cut[ends[:-1]] = True
        of = np.cumsum(cut) - 1
        long = np.diff(np.r_[np.flatnonzero(cut), len(letters)]) > LONG
        short = ~long[of]
        places, found = [], []
        for place, ids in self._in_step(symbol[short], of[short], np.flatnonzero(short)):
            places.append(place)
            found.append(ids)
        firsts = np.r_[np.flatnonzero(cut), len(letters)]
        for k in np.flatnonzero(long).tolist():
            left, ids = self._by_heap(symbol[firsts[k] : firsts[k + 1]].tolist())
            places.append(np.array(left, np.int64) + firsts[k])
            found.append(np.array(ids, np.int64))
        place, ids = np.concatenate(places), np.concatenate(found)
        order = np.argsort(place, kind="stable")
        place, ids = place[order], ids[order]
        plain = (ids >= 0) & (ids < self.size)
        letter = letters[place]
        width = np.where(plain, 1, 1 + (letter > 0x7F) + (letter > 0x7FF) + (letter > 0xFFFF))
        at = np.cumsum(width) - width
        out = np.full(int(width.sum()), -1, np.int32)
        out[at[plain]] = ids[plain]
        rest = np.frombuffer(letter[~plain].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[out < 0] = self.bytes[rest]
        stops = np.r_[at, len(out)][np.searchsorted(place, ends)].tolist()
        data = out.astype("<i4").tobytes()
        return [data[4 * a : 4 * z] for a, z in zip([0, *stops], stops)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end id."""
        return self.encode_new(texts)[0]

    def encode_new(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """The same, and which texts hold a unit that wasn't known before."""
        return self.encode_units(texts)[:2]

    def encode_units(self, texts: list[str]) -> tuple[list[bytes], list[int], dict[str, bytes]]:
        """The same, and these units with their ids."""
        split = [self.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > MOST_UNITS:
            self.known = {}
        fresh = set().union(*split).difference(self.known)
        own = dict(zip(fresh, self.merge(list(fresh)), strict=True)) if fresh else {}
        self.known.update(own)
        coded = [b"".join(map(self.known.__getitem__, units)) for units in split]
        for u in own:
            if len(u) > LONGEST_UNIT:
                del self.known[u]
        return coded, [n for n, units in enumerate(split) if not fresh.isdisjoint(units)], own

    def set_apart(self, own: dict[str, bytes]) -> Iterator[tuple[str, bytes]]:
        """Texts made of units only, a character between them that joins neither, and the ids that they must have."""
        mark, before = self.merge([self.apart])[0], self.merge([SPACE])[0]
        units = list(own)
        for k in range(0, len(units), TOGETHER):
            some = units[k : k + TOGETHER]
            yield self.apart + self.apart.join(some), before + mark + mark.join([own[u] for u in some])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: a space before the first piece goes, each byte that is no UTF-8 becomes U+FFFD."""
        surface = self.surface
        runs, last = [], -1
        for i in self.silent.intersection(ids) and [k for k, i in enumerate(ids) if i in self.silent]:
            runs.append(ids[last + 1 : i])
            last = i
        runs = [r for r in [*runs, ids[last + 1 :]] if r]
        skip = int(bool(runs) and self.spaced[runs[0][0]])
        return "".join([b"".join([surface[i] for i in r]).decode("utf-8", "byte by byte") for r in runs])[skip:]


def codec(model: str = MODEL) -> PieceCodec:
    """The worker's own codec; found by name on the worker, as each machine has its own files."""
    path = model if os.path.sep in model else vocabulary_path(model)
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _texts(column: pa.Array) -> list[str]:
    data, at = flat(column)
    held, at = data.tobytes(), at.tolist()
    return [held[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def _checked(what: str, own: object, library: object) -> None:
    if own != library:
        raise ValueError(f"the agenda and the library differ on {what}")


def _in_batches(df: DataFrame) -> None:
    if df.sparkSession.conf.get(BATCH_SETTING) == SPARKS_LIMIT:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def encode_pieces(df: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", model: str = MODEL, end_id: bool = True) -> DataFrame:
    """``carry``, ids (array of int) and decoded (the text of the ids): a row for each row of ``df``."""
    _in_batches(df)
    carry = tuple(c for c in carry if c not in ("ids", "decoded"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for place, b in enumerate(slices(batches, "_text")):
            texts = _texts(b.column(len(carry)))
            tail = int(own.end).to_bytes(4, "little") if end_id else b""
            coded, new, units = own.encode_units(texts)
            data = [ids + tail for ids in coded]
            values = np.frombuffer(b"".join(data), "<i4")
            decoded = [own.decode(np.frombuffer(ids, "<i4").tolist()) for ids in data]
            if place and own.apart:
                read = [(t, ids + tail, own.decode(np.frombuffer(ids, "<i4").tolist())) for t, ids in own.set_apart(units)]
            else:
                read = [(texts[n], data[n], decoded[n]) for n in new]
            library = own.library.encode([t for t, _, _ in read], add_eos=end_id, num_threads=1)
            try:
                for (_, wanted, _), ids in zip(read, library, strict=True):
                    _checked("ids", wanted, np.array(ids, "<i4").tobytes())
                _checked("decoded texts", [t for _, _, t in read], own.library.decode(library, num_threads=1) if read else [])
            except ValueError:
                own.known = {}  # not taken as compared if this worker goes on
                raise
            stops = np.cumsum([0, *(len(ids) // 4 for ids in data)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(stops), pa.array(values)), pa.array(decoded, pa.string())], names=[*carry, "ids", "decoded"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(*carry, df[text_col].alias("_text")).mapInArrow(encoded, f"{kinds}{', ' if carry else ''}ids array<int>, decoded string")


def decode_pieces(df: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``carry`` and decoded: the text of each row's ids (null: empty; ids outside the vocabulary raise)."""
    _in_batches(df)
    carry = tuple(c for c in carry if c != "decoded")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            rows = [[i for i in x or () if i is not None] for x in b.column(len(carry)).to_pylist()]
            if any(not 0 <= i < own.size for x in rows for i in x):
                raise ValueError("an id is outside the vocabulary")
            texts = [own.decode(x) for x in rows]
            _checked("decoded texts", texts, own.library.decode(rows, num_threads=1) if rows else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*carry, "decoded"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(*carry, df[ids_col].alias("_ids")).mapInArrow(decoded, f"{kinds}{', ' if carry else ''}decoded string")
