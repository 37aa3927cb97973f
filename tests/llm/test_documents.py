"""The document operators against brute force on an awkward table, and on an empty one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm.jaccard import ngram_jaccard
from tidemark.llm.mixing import entropy_mix, shares
from tidemark.llm.packing import best_fit_pack, solve
from tidemark.llm.rollups import TokenRollup, counted, token_rollup
from tidemark.llm.scratch import Scratch
from tidemark.llm.sharding import kd_shards
from tidemark.llm.suffixes import suffix_dedup
from tidemark.llm.tokens import encoder, vocabulary_path

from .conftest import awkward


def test_mixing_meets_targets(docs):
    out = entropy_mix(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(x[0] for x in awkward())
    size = {x[0]: len((x[1] or "").encode().split()) for x in awkward()}
    by = defaultdict(list)
    for r in out:
        assert r.size == size[r.doc_id] and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    totals = [sum(r.size for r in by[s]) for s in order]
    for s, total, target in zip(order, totals, shares(totals, [1, 2, 3, 1, 2, 3][: len(order)], 1.0, 3)):
        assert by[s][0].source_size == total and abs(by[s][0].target - target) < 1e-6
        assert abs(sum(r.taken for r in by[s]) - target) <= max(3, 0.02 * target)
    assert Counter(map(tuple, out)) == Counter(map(tuple, entropy_mix(docs.repartition(5)).collect()))


def test_shares_are_capped_and_reshared():
    assert shares([10, 100, 1000], [1, 1, 1], 1.0, 3) == pytest.approx([30, 300, 780])


def test_packing_is_whole_and_tight(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    out = best_fit_pack(docs).collect()
    want = Counter()
    for x in awkward():
        ids = t.encode(x[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(x[0], k // 2048, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in out) // 2048) + 1


def test_fillings_place_every_length_once():
    for histogram in ({}, {2048: 3}, {1: 5000}, {1500: 7, 548: 7, 30: 100, 700: 11}):
        plan = solve(histogram)
        placed = Counter()
        for config, times in plan:
            assert sum(k * n for k, n in config) <= 2048
            for k, n in config:
                placed[k] += n * times
        assert placed == Counter(histogram)


def test_words_encode_as_whole_texts_do():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    texts = ["It's DON'T 's 'S x'y", "a.b,c!? (é)É. ΑΣ ΑΣ. İ", "<|endoftext|> a<|startoftext|>.", "\x1cx\x1f \x85 \xa0y　z", "x" * 90 + " 12.5%", "é ́a", "日本語。"]
    assert [x for x in encoder().encode([x.encode() for x in texts])] == [b"".join(i.to_bytes(4, "little") for i in t.encode(x, add_special_tokens=False).ids) for x in texts]


def shingles(text):
    w = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def clusters():
    """A base with many variants that are alike only through it, chains of near copies, and shared boilerplate."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(150)], []

    def changed(words, n):
        out = list(words)
        for i in r.sample(range(len(out)), n):
            out[i] = word()
        return out

    rows += [changed(base, 3) for _ in range(90)] + [base]
    for _ in range(6):
        now = [word() for _ in range(120)]
        for _ in range(8):
            now = changed(now, 2)
            rows.append(now)
    line = [word() for _ in range(60)]
    rows += [line + [word() for _ in range(r.randint(5, 60))] for _ in range(60)] + [line + [word()] for _ in range(40)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("table", "chunk", "block"), [(awkward, 1 << 17, 4096), (clusters, 1 << 17, 4096), (clusters, 40, 16)])
def test_jaccard_components(spark, table, chunk, block):
    given = [(x[0], x[1]) for x in table()]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    rows = [(i, shingles(t)) for i, t in given]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(rows))
    assert Counter(map(tuple, ngram_jaccard(docs, chunk=chunk, block=block).collect())) == want


def test_jaccard_follows_every_pair_that_is_a_group_by_itself(spark):  # F6
    """A text and its two ends share one prefix member each, so no group holds all three."""
    texts = [" ".join(f"c{c}w{i}" for i in range(*ends)) for c in (131, 228, 340, 493) for ends in ((0, 12), (0, 11), (1, 12))]
    rows, sets = list(enumerate(texts)), [shingles(t) for t in texts]
    assert all(100 * len(sets[3 * k] & sets[3 * k + e]) >= 80 * len(sets[3 * k] | sets[3 * k + e]) for k in range(4) for e in (1, 2))
    got = {r.doc_id: r.component_id for r in ngram_jaccard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i // 3 * 3 for i in range(12)}


def test_jaccard_writes_only_the_sets_it_compares(spark, monkeypatch):
    """Sets take more room than texts: of those without a likely partner none is written."""
    r = random.Random(21)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([text() for _ in range(60)] * 2 + ["a " * 9] * 3)] + [(900, x := text()), (901, x + " more")], "doc_id bigint, text string")
    written, keep = {}, Scratch.keep

    def counted(self, df, table, partitions=None):
        kept = keep(self, df, table, partitions)
        if "members" in kept.columns:
            written[table] = kept.count()
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    got = {x.doc_id: x.component_id for x in ngram_jaccard(docs).collect()}
    assert got == {i: i % 60 for i in range(120)} | {120: 120, 121: 120, 122: 120, 900: 900, 901: 900}
    assert written and max(written.values()) <= 2, written


def crowded():
    """Short lines and passages that many documents share, at all places."""
    r = random.Random(12)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, passage, block = prose(60), prose(84), prose(150)
    rows = [(2 * k, prose(r.randint(0, 120)) + r.choice([line, passage, block, block[20:110], line + passage]) + prose(r.randint(0, 120))) for k in range(150)]
    return rows + [(1, passage), (3, "y" * 500), (5, "y" * 300)]


@pytest.mark.parametrize(("keep", "most", "table"), [("none", 1024, awkward), ("first", 1024, awkward), ("none", 2, awkward), ("first", 2, awkward), ("none", 3, crowded), ("first", 3, crowded)])
def test_repeated_strings(spark, keep, most, table):
    length = 80
    given = [(x[0], x[1]) for x in table()]
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    rows = sorted({(i if i is not None else -1, t or "") for i, t in given})
    seen = defaultdict(list)
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]].append((d, t, i))
    covered = {r: bytearray(len(r[1].encode())) for r in rows}
    for places in seen.values():
        if len(places) > 1:
            for d, t, i in places if keep == "none" else sorted(places)[1:]:
                covered[(d, t)][i : i + length] = b"\1" * length
    want = set()
    for (d, t), marks in covered.items():
        kept = bytes(x for x, m in zip(t.encode(), marks) if not m)
        spans = sum(1 for i in range(len(marks)) if marks[i] and (not i or not marks[i - 1]))
        want.add((d, len(marks), sum(marks), spans, hashlib.sha256(kept).hexdigest()))
    out = suffix_dedup(docs, length=length, gram=20, keep=keep, most=most).collect()
    assert len(out) == len(given)
    assert {(r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want


def test_shards(docs):
    out = kd_shards(docs, shards=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((x[0], len((x[1] or "").encode()) + 16, zlib.crc32((x[1] or "").encode())) for x in awkward())
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(map(tuple, out)) == Counter(map(tuple, kd_shards(docs.repartition(3), shards=5).collect()))


def test_shards_are_even_and_keep_equal_texts(spark):
    r = random.Random(9)
    texts = ["z" * r.choice([20, 60, 150, 400, 900]) + str(k) for k in range(300)] + ["same" * 40] * 30 + ["y" * 2500, None, ""]
    docs = spark.createDataFrame([(k, t, r.choice("ab"), r.choice(["en", None])) for k, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string")
    shards, weight = defaultdict(set), Counter()
    for x in kd_shards(docs, shards=12).collect():
        shards[texts[x.doc_id] or ""].add(x.shard)
        weight[x.shard] += x.size
    assert all(len(s) == 1 for s in shards.values())
    mean = sum(weight.values()) / 12
    assert len(weight) == 12 and max(abs(w - mean) for k, w in weight.items() if k not in shards["same" * 40]) <= 0.12 * mean
    even = sorted(weight.values())
    assert even[-2] - even[0] <= 0.05 * mean


def test_rollup_batches(spark, docs):
    rollup = TokenRollup(spark, Scratch(spark, "test-rollup").root)
    schema = "op string, seq int, doc_id bigint, source string, lang string, text string"
    first = spark.createDataFrame([("insert", 0, i, s, "en", t) for i, s, t in ((1, "a", "x y"), (2, "a", "z"), (3, None, None), (None, "a", "w"))], schema)
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    total = lambda: {(r.source, r.lang): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert total() == {("a", "en"): (3, 4), (None, "en"): (1, 0)}
    second = [("revise", 1, 1, "b", "en", "x y z"), ("delete", 1, 2, None, None, None), ("delete", 1, 99, None, None, None), ("revise", 2, 1, "b", "en", "q")]
    assert rollup.commit("b2", spark.createDataFrame(second, schema))
    assert total() == {("a", "en"): (1, 1), ("b", "en"): (1, 1), (None, "en"): (1, 0)}
    rollup.compact()
    assert total() == {("a", "en"): (1, 1), ("b", "en"): (1, 1), (None, "en"): (1, 0)}
    assert rollup.commit("b3", spark.createDataFrame([("delete", 0, 1, None, None, None), ("insert", 0, 3, "c", "en", "x y")], schema))
    assert total() == {("a", "en"): (1, 1), ("c", "en"): (1, 2)}
    want = sum(len(e) // 4 for e in encoder().encode([(x[1] or "").encode() for x in awkward()]))
    assert counted(docs.select("doc_id", "source", "lang", "text")).agg({"tokens": "sum"}).first()[0] == want


def test_rollup_of_a_table(spark, docs):
    """Older versions, drafts and deletions leave nothing behind: the totals are those of the table, one row for each id."""
    rows = {(x[0] if x[0] is not None else -k): x for k, x in enumerate(awkward(), 1)}
    want = defaultdict(lambda: [0, 0, 0])
    for x in rows.values():
        of, raw = want[x[3], x[2], "word_bpe_49k.json"], (x[1] or "").encode()
        of[0] += 1
        of[1] += len(encoder().encode([raw])[0]) // 4
        of[2] += len(raw)
    assert {(r.source, r.lang, r.tokenizer): [r.documents, r.tokens, r.bytes] for r in token_rollup(docs).collect()} == want
    assert token_rollup(docs.limit(0)).count() == 0


def test_empty_tables(empty):
    for out in (entropy_mix(empty), best_fit_pack(empty), ngram_jaccard(empty), suffix_dedup(empty), kd_shards(empty)):
        assert out.count() == 0
