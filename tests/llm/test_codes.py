"""Piece ids, Merkle manifests and infilling against the library, brute force and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.infill import draws, fill_in_middle, restored
from tidemark.llm.merkle import merkle_manifest, row_digest
from tidemark.llm.pieces import codec, decode_pieces, encode_pieces

from .conftest import awkward

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def own_ids(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in codec().encode(texts)]


def test_agenda_equals_the_library_on_any_text():
    r, library = random.Random(7), codec().library
    letters = "abcdefghij eeett  ▁▁\n\t0123éß日本語の中国人 ﬁ😀\x00​هذا Привет"
    texts = ["", " ", "   ", "▁", "a", "\n", "<s></s><unk><0x41>", "\x00", "é́", "=" * 300, " " * 100 + "x" + " " * 17, "ab" * 400]
    for _ in range(600):
        s = "".join(r.choice(letters) for _ in range(r.choice([1, 3, 10, 50, 400])))
        texts.append(s.replace(" ", "") if r.random() < 0.3 else s)
    assert own_ids(texts) == library.encode(texts, num_threads=1)
    for s in texts[:200]:  # one by one, in another order, with what was remembered
        assert own_ids([s]) == [library.encode(s)]


def test_long_units_go_through_the_heap():
    r = random.Random(2)
    text = "".join(r.choice("etaoinshrdl") for _ in range(20_000))
    assert own_ids([text]) == [codec().library.encode(text)]


def test_the_library_reads_rows_with_new_units_only():
    from tidemark.llm import pieces

    c = pieces.PieceCodec(pieces.vocabulary_path(pieces.MODEL))
    texts = ["one two three", "", "three two one one", "one " * 50 + "quattuor", "two " + "x" * 200, "two " + "x" * 200]
    assert c.encode_new(texts[:2])[1] == [0]
    coded, new = c.encode_new(texts)
    assert new == [3, 4, 5] and [np.frombuffer(x, "<i4").tolist() for x in coded] == c.library.encode(texts)
    assert c.encode_new(texts)[1] == [4, 5]  # long units aren't remembered


def test_units_set_apart_equal_the_library_and_differences_raise(spark, monkeypatch):
    """After a task's first slice the library reads the new units alone; a wrong one raises in either slice."""
    r, c = random.Random(11), codec()
    read = []

    class Reader:
        def encode(self, texts, **more):
            read.append(sum(map(len, texts)))
            return held.encode(texts, **more)

        def decode(self, *a, **more):
            return held.decode(*a, **more)

    held = c.library
    monkeypatch.setattr(c, "library", Reader())
    monkeypatch.setattr(c, "known", {})
    df = spark.createDataFrame([], "doc_id bigint, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    run = encode_pieces(df)
    common = ["".join(r.choice("etaoin") for _ in range(5)) for _ in range(300)]
    word = lambda: r.choice(common) if r.random() < 0.9 else "".join(r.choice("abcé▁語\n\x00 🙂") for _ in range(r.randint(1, 9)))
    slices = [[" ".join(word() for _ in range(400)) for _ in range(60)] for _ in range(3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(x, pa.string())], names=["doc_id", "_text"]) for x in slices]
    got = [b.column(1).to_pylist() for b in run(iter(batches))]
    assert got == [held.encode(x, add_eos=True, num_threads=1) for x in slices]
    assert read[0] > 0.9 * sum(map(len, slices[0])) and all(0 < n < 0.5 * sum(map(len, x)) for n, x in zip(read[1:], slices[1:]))
    merge = c.merge
    monkeypatch.setattr(c, "merge", lambda units: [ids + ids if len(u) > 1 else ids for u, ids in zip(units, merge(units))])
    for at in (0, 1):
        monkeypatch.setattr(c, "known", {})
        first = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["a"] if at else ["new words"], pa.string())], names=["doc_id", "_text"])
        with monkeypatch.context() as m:
            if at:  # the first slice is right
                m.setattr(c, "known", dict(zip(units := c.unit.findall("▁a"), merge(units))))
            with pytest.raises(ValueError, match="differ on ids"):
                list(run(iter([first, batches[0]])))


def test_decoding_equals_the_library_on_any_ids():
    r, c = random.Random(5), codec()
    for _ in range(2000):
        ids = [r.randrange(c.size) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(0, 30))]
        assert c.decode(ids) == c.library.decode(ids)


def test_what_is_remembered_is_bounded(monkeypatch):
    from tidemark.llm import pieces

    monkeypatch.setattr(pieces, "MOST_UNITS", 50)
    r, c = random.Random(1), pieces.PieceCodec(pieces.vocabulary_path(pieces.MODEL))
    for _ in range(20):
        texts = [" ".join(f"w{r.randint(0, 900)}" for _ in range(30)) for _ in range(5)]
        assert [np.frombuffer(x, "<i4").tolist() for x in c.encode(texts)] == c.library.encode(texts)
    assert len(c.known) < 50 + 500


def test_pieces_of_a_table(spark, docs, empty):
    c, want = codec(), Counter()
    for x in awkward():
        ids = c.library.encode(x[1] or "", add_eos=True)
        want[x[0], tuple(ids), c.library.decode(ids)] += 1
    coded = encode_pieces(docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")), carry=("doc_id", "ids", "decoded", "lang"))
    assert coded.columns == ["doc_id", "lang", "ids", "decoded"]
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in coded.collect()) == want
    back = decode_pieces(coded.drop("decoded"), carry=("doc_id",)).collect()
    assert Counter((r.doc_id, r.decoded) for r in back) == Counter((d, t) for (d, _, t), n in want.items() for _ in range(n))
    without = encode_pieces(docs, carry=(), end_id=False).collect()
    assert Counter(tuple(r.ids) for r in without) == Counter(tuple(i[:-1]) for (_, i, _), n in want.items() for _ in range(n))
    assert encode_pieces(empty).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 5])], "doc_id int, ids array<int>")
    assert [r.decoded for r in decode_pieces(odd).orderBy("doc_id").collect()] == ["", "", c.library.decode([5])]
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode_pieces(spark.createDataFrame([(1, [32000])], "doc_id int, ids array<int>")).collect()


def H(*parts):
    return sha("".join(parts))


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, fanout):
    """Rows (id, group, leaf, found): (id, leaf, subroot, root, proof, folded), level by level over lists."""
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))

    def paths(nodes):
        up = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
            for i, a in enumerate(at):
                run, k = runs[a // fanout], a % fanout
                up[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            nodes, at = [H(*run) for run in runs], [a // fanout for a in at]
        return nodes[0], up

    inside = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[2]))
        inside[g] = paths([r[2] for r in groups[g]])
    root, above = paths([inside[g][0] for g in order])
    for g, top in zip(order, above):
        for r, up in zip(groups[g], inside[g][1]):
            node = r[3] or r[2]
            for left, right in up + top:
                node = H(left, node, right)
            out.append((r[0], r[2], inside[g][0], root, H(*(a + b for a, b in up + top)), node))
    return out


@pytest.mark.parametrize(("fanout", "levels", "tile"), [(16, 2, 4096), (2, 2, 8), (3, 1, 5), (2, 3, 1)])
def test_manifest(spark, docs, fanout, levels, tile):
    leaf = row_digest(F.col("doc_id"), F.col("source"), F.col("text"))
    changed = F.when(F.col("doc_id") % 3 == 0, row_digest(F.col("doc_id"), F.col("source"), F.upper("text")))
    rows = [(x[0], x[3], H(field(x[0]), field(x[3]), field(x[1])), H(field(x[0]), field(x[3]), field(x[1] if x[1] is None else x[1].upper())) if x[0] is not None and x[0] % 3 == 0 else None) for x in awkward()]
    out = merkle_manifest(docs.withColumn("leaf", F.lit(1)).withColumn("group", F.lit("x")), leaf, changed=changed, fanout=fanout, levels=levels, tile=tile).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in out) == Counter(brute(rows, fanout))
    assert all(r.verified == (r.folded_root == r.root) for r in out) and {r.verified for r in out} == {True, False}


def test_manifests_of_one_row_and_none(spark, empty):
    leaf = row_digest(F.col("doc_id"))
    (r,) = merkle_manifest(spark.createDataFrame([(5, None)], "doc_id long, source string"), leaf).collect()
    assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (sha("1:5"), sha("1:5"), sha("1:5"), sha(""), sha("1:5"), True)
    assert merkle_manifest(empty, leaf).count() == 0
    same = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("source"))
    out = merkle_manifest(same, leaf, tile=16).collect()
    want = brute([(7, "a", sha("1:7"), None)] * 300, 16)
    assert Counter((r.proof_sha256, r.folded_root) for r in out) == Counter((w[4], w[5]) for w in want)
    with pytest.raises(TypeError):
        merkle_manifest(spark.createDataFrame([(1.5, "a")], "doc_id double, source string"), leaf)


def test_manifest_query_reruns_alike(spark, sf_dir):
    a, b = (sorted(map(tuple, queries.op12_merkle_manifest(spark, sf_dir).collect())) for _ in range(2))
    assert a == b


def middle(doc_id, text):
    """The contract's rules over one text."""
    n = len(text)
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [64, 3])
def test_infilling(spark, docs, empty, block):
    r = random.Random(3)
    extra = [(1000 + k, "".join(r.choice(["a", "é", "日", "😀", "\n", "<", "P>", "<S", ">"]) for _ in range(r.choice([1, 2, 63, 64, 65, 128, 300])))) for k in range(60)] + [(2000, "has <M> in it"), (2001, "<P"), (2002, "a<S"), (2003, " \r\n\x00")]
    given = [(x[0], x[1]) for x in awkward()] + extra
    df = spark.createDataFrame(given, "doc_id bigint, text string").withColumns({"row": F.lit(1), "n": F.lit("n"), "a": F.lit(2)})
    out = fill_in_middle(df, block=block)
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got) == Counter((d, *middle(d, t or "")) for d, t in given)
    assert all(x.back == x.text for x in got) and {x.form for x in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(empty).count() == 0


def test_infilling_by_words(spark):
    pattern, texts = r"\S+\s*|\s+", [(k, " ".join(f"w{j}" * (1 + j % 3) for j in range(k % 7 * 9))) for k in range(60)]
    got = {r.doc_id: r for r in fill_in_middle(spark.createDataFrame(texts, "doc_id bigint, text string"), unit=pattern, plain_share=0, block=4).collect()}
    for d, t in texts:
        words = [w + " " for w in t.split(" ")] if t else []
        words = words and [*words[:-1], words[-1][:-1]]
        h = [int(sha(f"1:{d}")[8 * k : 8 * k + 8], 16) for k in range(2)]
        a, b = sorted(x % (len(words) + 1) for x in h)
        assert got[d].n == len(words)
        if words:
            assert (got[d].prefix_chars, got[d].middle_chars) == (len("".join(words[:a])), len("".join(words[a:b])))
    with pytest.raises(Exception, match="cover"):
        fill_in_middle(spark.createDataFrame([(1, "ab cd")], "doc_id bigint, text string"), unit=r"[a-z]+").collect()


def test_draws(spark):
    row = spark.range(5, 6).select(*draws(F.col("id"))).first()
    assert list(row) == [int(sha("1:5")[8 * k : 8 * k + 8], 16) for k in range(4)]


def test_digests_of_the_queries(spark, sf_dir):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    c = codec()
    for r in queries.op11_piece_codes(spark, sf_dir).collect():
        ids = c.library.encode(rows[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(c.library.decode(ids)))
    for r in queries.op13_fill_in_middle(spark, sf_dir).collect():
        n, form, a, m, output = middle(r.doc_id, rows[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, m, sha(output), sha(rows[r.doc_id]))
    found = queries.op12_merkle_manifest(spark, sf_dir).collect()
    assert len(found) == len(rows) and all(r.verified for r in found if zlib.crc32(str(r.doc_id).encode()) % 5) and not all(r.verified for r in found)
