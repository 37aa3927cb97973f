"""The pipeline's stages on the smallest table, each judged on its own input."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.mixing import shares
from tidemark.llm.scratch import Scratch
from tidemark.llm.suffixes import suffix_dedup

from .conftest import awkward
from .test_documents import shingles


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "mixing", "packing"]
    scratch = Scratch(spark, "test-pipeline")
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(scratch.keep(stage(spark, tables[-1], sf_dir), name))
    docs, clean, single, cut, mixed, packed = (t.collect() for t in tables)
    assert all(t.columns == tables[0].columns for t in tables[1:5])

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs} - {r.doc_id for r in clean}
    assert sum(labels.get(d) == 0 for d in gone) <= 0.02 * len(docs)
    assert sum(labels.get(d) == 1 for d in gone) >= 0.8 * sum(labels.get(r.doc_id) == 1 for r in docs)

    sets = {r.doc_id: shingles(r.text) for r in clean}
    left = {r.doc_id for r in single}
    close = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    ids = sorted(left)
    assert not any(close(sets[a], sets[b]) for i, a in enumerate(ids) for b in ids[:i])
    assert all(any(close(sets[d], sets[o]) for o in sets if o != d) for d in set(sets) - left)

    before = {r.doc_id: r.text for r in single}
    held = lambda t: [tuple(w[i : i + 51]) for w in [re.findall(r"[^ \t-\r]+", t)] for i in range(len(w) - 50)]
    seen, after = (Counter(p for r in rows for p in held(r.text)) for rows in (single, cut))
    assert max(seen.values()) > 1 and max(after.values(), default=1) == 1
    assert {r.doc_id for r in cut} == set(before)
    for r in cut:
        if all(seen[p] == 1 for p in held(before[r.doc_id])):
            assert r.text == before[r.doc_id]
        assert r.n_chars == len(r.text)

    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= set(before)
    length = lambda t: len(re.findall(r"[^ \t-\r]+", t))
    order = sorted({r.source for r in cut}, key=lambda s: (s is None, s or ""))
    whole, taken = ([sum(length(r.text) for r in rows if r.source == s) for s in order] for rows in (cut, mixed))
    for n, target in zip(taken, shares(whole, [1, 2, 3] * len(order), 1.0, 3)):
        assert abs(n - target) <= max(20, 0.02 * target)

    assert sum(r.piece == 0 for r in packed) == len(mixed)
    assert tables[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_chains_of_near_copies_leave_one(spark, sf_dir):  # F7 of round 4
    """A text and its two ends, which meet two by two only, are one group."""
    texts = [" ".join(f"c{c}w{i}" for i in range(*ends)) for c in (131, 228, 340, 493) for ends in ((0, 12), (0, 11), (1, 12))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == {0, 3, 6, 9}


def test_short_words_repeat_too(spark, sf_dir):
    """A passage of 51 words in under 400 bytes goes from the later document, one of 50 stays, whatever the spaces."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short = prose(51), prose(50)
    assert len(long) < 400
    rows = [(1, f"{prose(80)} {long} {prose(80)}"), (2, a := f"{prose(30)} {short} {prose(70)}"), (3, f"{(head := prose(60))} {long.replace(' ', '  ')} {(tail := prose(40))}"), (4, b := f"{prose(90)} {short} {prose(20)}"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, sf_dir).collect()}
    assert out == {1: rows[0][1], 2: a, 3: f"{head} {tail}", 4: b, 5: ""}


def test_repeated_words_against_brute_force(spark):
    rows = sorted({(x[0] if x[0] is not None else -1, x[1] or "") for x in awkward()})
    split = [re.split(r"[ \t-\r]+", t.strip(" \t\n\v\f\r")) for _, t in rows]
    seen, gone = set(), {}
    for (d, t), w in zip(rows, split):
        marks = [False] * len(w)
        for i in range(len(w) - 50):
            if tuple(w[i : i + 51]) in seen:
                marks[i : i + 51] = [True] * 51
            seen.add(tuple(w[i : i + 51]))
        gone[(d, t)] = [x for x, m in zip(w, marks) if not m]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string")
    assert {(r.doc_id, tuple(r.kept.split())) for r in suffix_dedup(docs, words=51).collect()} == {(d, tuple(x for x in w if x)) for (d, _), w in gone.items()}


def test_no_task_of_the_passages_holds_two_python_workers(spark, sf_dir, monkeypatch):
    """A worker that codes words beside one that marks them is what took the executor's memory."""
    plans, keep = {}, Scratch.keep

    def seen(self, df, table, partitions=None):
        plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, table, partitions)

    monkeypatch.setattr(Scratch, "keep", seen)
    docs = spark.createDataFrame(awkward(), "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, _text string")
    corpus_pipeline.repeated_passages(spark, docs, sf_dir)
    assert {"runs", "contexts"} <= set(plans) and all(len(re.findall("MapInArrow|InPandas", p)) <= 1 for p in plans.values())


def test_copies_go_without_a_shuffle_of_texts(spark, docs, sf_dir):
    """The ids that go are counted and broadcast, whatever Spark's own limit for that is."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        left = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
        plan = left._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
