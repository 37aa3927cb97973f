"""Empty tables of every operator and stage, and the suffix operator at its contract's length."""

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.html import main_text
from tidemark.llm.infill import fill_in_middle
from tidemark.llm.merkle import merkle_manifest, row_digest
from tidemark.llm.neighbours import embedding_dedup
from tidemark.llm.pieces import encode_pieces
from tidemark.llm.rollups import token_rollup
from tidemark.llm.scratch import Scratch
from tidemark.llm.topk import voronoi_topk
from tidemark.llm.toxicity import toxicity


def test_empty_tables_give_no_rows(spark, empty):
    make = spark.createDataFrame
    labels, vectors = make([], "doc_id bigint, quality int, toxic int"), make([], "vec_id bigint, embedding array<float>")
    for out in (
        toxicity(empty, labels), token_rollup(empty), main_text(make([], "page_id bigint, url string, html string")), embedding_dedup(vectors), voronoi_topk(vectors, F.lit(True)),
        encode_pieces(empty), merkle_manifest(empty, row_digest(F.col("doc_id"))), fill_in_middle(empty),
    ):
        assert out.count() == 0


def test_stages_take_empty_tables(spark, tmp_path):
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_strings_of_400_bytes(spark, sf_dir):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    seen = Counter(raw[i : i + 400] for _, raw in rows for i in range(len(raw) - 399))
    want = {}
    for doc_id, raw in rows:
        marks = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if seen[raw[i : i + 400]] > 1:
                marks[i : i + 400] = b"\1" * 400
        spans = sum(1 for i, m in enumerate(marks) if m and (not i or not marks[i - 1]))
        want[doc_id] = (len(raw), sum(marks), spans, hashlib.sha256(bytes(x for x, m in zip(raw, marks) if not m)).hexdigest())
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, sf_dir).collect()}
    assert out == want and any(w[1] for w in want.values())


def test_only_the_named_tables_stay(spark):
    scratch = Scratch(spark, "test-only")
    for name in ("a", "b", "c"):
        scratch.keep(spark.range(3), name)
    scratch.only("b")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(scratch.root)
    assert [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)] == ["b"]
