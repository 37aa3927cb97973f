"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and beginnings of words (4 to 8 bytes, which also catch inflected forms). A bounded sample
of labelled rows, ``MOST_TOXIC`` and ``MOST_CLEAN`` at most, chooses the vocabulary and gives the examples.
The vocabulary is a ranking and has no least count or score, so that it depends on neither the size of the
sample nor the share of a language: of the terms whose rate in toxic texts is over three times that in
clean ones, the ``TERMS`` of highest phi-square (chi-square by the size of the sample). Document frequencies
come from all documents. Every document becomes a TF-IDF vector over that vocabulary, each term times the
square of its phi-square, so that chance terms of few texts weigh little, and over one axis more, ``PLAIN``
times the root of its words: the length that these words would have as terms of one occurrence and one weight
each. So a long text with one telling term isn't near a text full of them, and every text with words is
compared. The examples, sorted so that alike ones stand together, are indexed by term in blocks; each block
keeps its largest weight of every term. A query visits blocks by their bound, the sum of its weights times
those maxima, until none can reach its k-th cosine, so the nearest examples are exact. Examples without a
telling term all lie on the last axis and tie; they stand in no block, and those that come among the nearest
vote with their mean. Votes are powers of cosines, weighted so that the sample's classes count as in all
labels, and there is a prior; the share of votes is the score.

Defined cases: null and empty texts get the smoothed rate of the examples without a telling term, and so do
texts without one, whose nearest examples are all of these; a null doc_id is held out; a doc_id labelled twice counts with its
larger label; without labels of both classes every score is the rate known; repeated rows score alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import LOWER, mix, powers, prefix_hash
from .scratch import Scratch, flat, slices, words

MOST_TOXIC, MOST_CLEAN = 4000, 8000
TERMS = 2048
#: Weight of a word on the axis of all words; terms have up to about a tenth.
PLAIN = 0.002
NEIGHBOURS, BLOCK, POWER, PRIOR = 24, 64, 4, 0.5
BEGINNINGS = range(4, 9)
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and beginnings, their row, and the words of each row; a word's length is part of its hash."""
    data, at = flat(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    data = LOWER[data]
    starts, ends, rows = words(data, at)
    for _ in range(3):  # marks around a word aren't part of it
        ends = ends - ((ends > starts) & _MARKS[data[ends - 1]])
        starts = starts + ((ends > starts) & _MARKS[data[np.minimum(starts, len(data) - 1)]])
    full = ends > starts
    starts, ends, rows = starts[full], ends[full], rows[full]
    sums, down = prefix_hash(data), powers(len(data) + 1)[1][starts]
    out, of = [mix((sums[ends] - sums[starts]) * down, 40)], [rows]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        s = starts[long]
        out.append(mix((sums[s + n] - sums[s]) * down[long], 41))
        of.append(rows[long])
    return np.concatenate(out), np.concatenate(of), np.bincount(rows, minlength=len(column))


class Vocabulary:
    """Sorted term hashes; a bit table rejects most others before the search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << 18, bool)
        self.table[(self.hashes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms found, and their rows."""
        may = np.flatnonzero(self.table[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if not len(may) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[may]
        return at[ok], rows[may][ok]

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Terms, how often each occurs, and the number of words, by row."""
        h, row, length = terms(column)
        term, row = self.find(h, row)
        key, n = np.unique(row * len(self.hashes) + term, return_counts=True) if len(term) else (term, term)
        cuts = np.searchsorted(key, np.arange(len(column) + 1) * max(1, len(self.hashes)))
        return [(key[a:b] % max(1, len(self.hashes)), n[a:b], w) for a, b, w in zip(cuts, cuts[1:], length.tolist())]


class BlockMaxIndex:
    """Unit vectors of examples by term, in blocks of ``BLOCK`` examples with each term's largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, label: np.ndarray, weight: np.ndarray, ids: np.ndarray, lengths: np.ndarray | None = None):
        self.idf = idf
        units = [self.unit(*v, length) if len(v[0]) else v for v, length in zip(vectors, np.zeros(len(vectors)) if lengths is None else lengths)]
        order = sorted((i for i, u in enumerate(units) if len(u[0])), key=lambda i: (units[i][0][np.argsort(-units[i][1])].tolist(), units[i][1].tolist(), i))
        none = [i for i, u in enumerate(units) if not len(u[0])]
        toxic = float(sum(weight[i] * label[i] for i in range(len(label))))
        self.rate = toxic / float(weight.sum()) if len(weight) and weight.sum() else 0.0
        empty = float(sum(weight[i] for i in none))
        self.empty = (float(sum(weight[i] * label[i] for i in none)) + PRIOR * self.rate) / (empty + PRIOR) if empty + PRIOR else 0.0
        self.label, self.weight, self.ids = label[order].astype(float), weight[order], ids[order]
        #: Examples that lie on the axis of all words alone: how many, their mean weight, and the first of them.
        self.plain, self.plain_weight, self.plain_ids = len(none), empty / max(1, len(none)), ids[none][:3].tolist()
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([units[i][0] for i in order]) if order else np.zeros(0, np.int64)
        value = np.concatenate([units[i][1] for i in order]) if order else np.zeros(0)
        place = np.repeat(np.arange(len(order)), [len(units[i][0]) for i in order]) if order else np.zeros(0, np.int64)
        by = np.lexsort((place, term))
        self.term, self.value, self.place = term[by], value[by], place[by]
        cells, first = np.unique(self.term * max(1, self.blocks) + self.place // BLOCK, return_index=True)
        self.cells, self.first = cells, np.append(first, len(self.term))
        self.top = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.known: dict[bytes, tuple[float, list]] = {}

    def unit(self, term: np.ndarray, n: np.ndarray, length: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their weights; the last is the axis of all words, numbered after the terms."""
        w = (1 + np.log(n)) * self.idf[term]
        if length:
            term, w = np.append(term, len(self.idf)), np.append(w, PLAIN * math.sqrt(length))
        size = math.sqrt(float(w @ w)) if len(w) else 0.0
        return (term, w / size) if size else (term[:0], w[:0])

    def nearest(self, term: np.ndarray, value: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (ties: index order) and their cosines; only those above ``floor``."""
        lo = np.searchsorted(self.cells, term * self.blocks)
        hi = np.searchsorted(self.cells, (term + 1) * self.blocks)
        cell = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
        weight = np.repeat(value, hi - lo)
        block = self.cells[cell] % max(1, self.blocks)
        bound = np.bincount(block, self.top[cell] * weight, minlength=self.blocks)
        visit = np.argsort(-bound, kind="stable")
        by_block = np.argsort(block, kind="stable")
        cell, weight, starts = cell[by_block], weight[by_block], np.searchsorted(block[by_block], np.arange(self.blocks + 1))
        least, found, scores, at, size = floor, [], [], 0, 4
        while at < len(visit) and bound[visit[at]] > 0 and bound[visit[at]] >= floor - 1e-12:
            some = visit[at : at + size]
            some = some[(bound[some] > 0) & (bound[some] >= floor - 1e-12)]
            at, size = at + size, 2 * size
            held = starts[some + 1] - starts[some]
            c = np.repeat(starts[some] - np.concatenate(([0], np.cumsum(held)))[:-1], held) + np.arange(int(held.sum()))
            of, w, c = np.repeat(np.arange(len(some)), held), weight[c], cell[c]
            n = self.first[c + 1] - self.first[c]
            p = np.repeat(self.first[c] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
            got = np.bincount(np.repeat(of, n) * BLOCK + self.place[p] % BLOCK, self.value[p] * np.repeat(w, n), minlength=len(some) * BLOCK)
            hit = np.flatnonzero(got > max(least, floor - 1e-12))
            found.append(some[hit // BLOCK] * BLOCK + hit % BLOCK)
            scores.append(got[hit])
            total = np.concatenate(scores)
            if len(total) >= k:
                floor = max(least, float(np.partition(total, len(total) - k)[len(total) - k]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        i, s = np.concatenate(found), np.concatenate(scores)
        s = np.round(s, 12)
        best = np.lexsort((i, -s))[:k]
        return i[best], s[best]

    def score(self, term: np.ndarray, n: np.ndarray, length: int) -> tuple[float, list[int]]:
        """Share of toxic votes, and the ids of the three nearest examples."""
        if not len(term):
            return self.empty, self.plain_ids if length else []
        key = hashlib.blake2b(term.tobytes() + n.tobytes() + length.to_bytes(8, "little"), digest_size=16).digest()
        if key not in self.known:
            t, w = self.unit(term, n, length)
            tie = float(w[-1]) if self.plain else 0.0  # the cosine to every example without a telling term
            i, cosine = self.nearest(t, w, NEIGHBOURS, tie if self.plain >= NEIGHBOURS else 0.0)
            above = int((cosine > tie).sum())
            plain = min(self.plain, NEIGHBOURS - above)
            i, cosine = i[: NEIGHBOURS - plain], cosine[: NEIGHBOURS - plain]
            vote, rest = cosine**POWER * self.weight[i], plain * tie**POWER * self.plain_weight
            answer = float((vote @ self.label[i] + rest * self.empty + PRIOR * self.rate) / (vote.sum() + rest + PRIOR))
            seen = self.ids[i[:above]].tolist() + self.plain_ids[:plain] + self.ids[i[above:]].tolist()
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = (answer, seen[:3])
        return self.known[key]


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, label_col: str) -> tuple[Vocabulary, BlockMaxIndex]:
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    known = scratch.keep(known.join(slim.select("_id").distinct(), "_id"), "known")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    sample = scratch.keep(slim.join(F.broadcast(some[0].union(some[1])), "_id"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many toxic and in how many clean texts of a batch each term occurs."""
        for b in slices(batches, "_text"):
            h, r, _ = terms(b.column(0))
            h, r = np.unique(np.stack([r.astype(np.uint64), h]), axis=1)[::-1] if len(h) else (h, r)
            toxic = b.column(1).to_numpy(zero_copy_only=False)[r.astype(np.int64)] == 1
            h, of = np.unique(h, return_inverse=True)
            n = [np.bincount(of[y], minlength=len(h)) for y in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, n)], names=["h", "a", "b"])

    p, q = (min(counts.get(y, 0), most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)))
    by_term = sample.select("_text", "y").mapInArrow(count, "h bigint, a bigint, b bigint").groupBy("h").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    phi = F.pow(a * (q - b) - b * (p - a), F.lit(2)) / F.greatest(F.lit(1.0), float(p) * q * (a + b) * (p + q - a - b))
    best = {r.h: r.phi * r.phi for r in by_term.filter(a * q > 3 * b * p).select("h", phi.alias("phi")).orderBy(F.desc("phi"), "h").limit(TERMS).collect()}
    vocabulary = Vocabulary(np.array(list(best), np.int64).view(np.uint64))
    strength = np.array([best[h] for h in vocabulary.hashes.view(np.int64).tolist()])
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(shared.value.hashes) + 1, np.int64), 0
        for b in slices(batches, "_text"):
            term, row = shared.value.find(*terms(b.column(1))[:2])
            if len(term):
                total[:-1] += np.bincount(np.unique(row * len(total) + term) % len(total), minlength=len(total))[:-1]
            rows += b.num_rows
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    df = np.zeros(len(vocabulary.hashes) + 1)
    for r in slim.mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * strength

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            v = shared.value.vectors(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([x[i].astype(np.int64) for x in v], pa.list_(pa.int64())) for i in (0, 1)), pa.array([x[2] for x in v], pa.int64())], names=["_id", "y", "t", "n", "words"])

    held = sample.select("_id", "_text", "y").mapInArrow(examples, "_id bigint, y int, t array<bigint>, n array<bigint>, words bigint").toPandas().sort_values("_id", kind="stable")
    label = held["y"].to_numpy(np.int64)
    weight = np.where(label == 1, counts.get(1, 0) / max(1, p), counts.get(0, 0) / max(1, q))
    vectors = [(np.asarray(t, np.int64), np.asarray(n, np.int64)) for t, n in zip(held["t"], held["n"])]
    return vocabulary, BlockMaxIndex(vectors, idf, label, weight, held["_id"].to_numpy(np.int64), held["words"].to_numpy(np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted, nearest (ids of examples); a row per input row.

    A column of ``docs`` with one of these four names gives way to them. Ids are whole numbers.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    given = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted", "nearest")]
    model = spark.sparkContext.broadcast(fit(docs, labels, Scratch(spark, "toxic"), id_col, text_col, label_col))
    packed = docs.select(F.struct(*given).alias("_row"), F.col(text_col).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = model.value
        for b in slices(batches, "_text"):
            found = [index.score(*v) for v in vocabulary.vectors(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["_row", "score", "nearest"])

    schema = T.StructType([packed.schema["_row"], T.StructField("score", T.DoubleType()), T.StructField("nearest", T.ArrayType(T.LongType()))])
    out = packed.mapInArrow(score, schema)
    return out.select("_row.*", held_out(f"_row.{id_col}").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest")
