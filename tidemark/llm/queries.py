"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import main_text
from .infill import fill_in_middle, restored
from .jaccard import ngram_jaccard
from .merkle import merkle_manifest, row_digest
from .mixing import entropy_mix
from .neighbours import embedding_dedup
from .packing import best_fit_pack
from .pieces import encode_pieces
from .rollups import token_rollup
from .sharding import kd_shards
from .suffixes import suffix_dedup
from .topk import voronoi_topk
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed 1 : 2 : 3 : 1 ... by words; no document more than three times."""
    return entropy_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048 tokens."""
    return best_fit_pack(_table(spark, sf_dir, "documents"))


def op3_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every twentieth vector by inner product of whole numbers."""
    return voronoi_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text, learnt from four of five folds of the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, _table(spark, sf_dir, "labels")).drop("text")


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by source, language and tokenizer version, kept by signed batches."""
    return token_rollup(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets reach a Jaccard similarity of 0.8."""
    return ngram_jaccard(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document when every repeated 400-byte string goes."""
    return suffix_dedup(_table(spark, sf_dir, "documents"), keep="none")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    return kd_shards(_table(spark, sf_dir, "documents"), shards=40)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(_table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors among all vectors with cosine 0.95 or more."""
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op11_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, with an end id, and the text that they decode to."""
    coded = encode_pieces(_table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, proofs and checks of all documents, a fifth of them with their capitals lost."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, row_digest(*fields, lowered))
    return merkle_manifest(_table(spark, sf_dir, "documents"), row_digest(*fields, F.col("text")), changed=changed)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut at two code points, with its middle last, and restored from that."""
    cut = fill_in_middle(_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_mix": op1_entropy_mix,
    "op2_best_fit_pack": op2_best_fit_pack,
    "op3_voronoi_topk": op3_voronoi_topk,
    "op4_toxicity": op4_toxicity,
    "op5_token_rollup": op5_token_rollup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_kd_shards": op8_kd_shards,
    "op9_html_text": op9_html_text,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_piece_codes": op11_piece_codes,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op3_voronoi_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op12_merkle_manifest": """
        WITH RECURSIVE crc AS (
            SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                lambda acc, b: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(acc, b)), 4294967295)) % 5 = 0 AS hit
            FROM (SELECT DISTINCT doc_id FROM documents)),
        fields AS (
            SELECT d.doc_id, source, text, hit,
                list_aggregate(list_transform([CAST(d.doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
                    lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), 'string_agg', '') AS head,
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
            FROM documents d JOIN crc ON d.doc_id IS NOT DISTINCT FROM crc.doc_id),
        leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                sha256(head || CASE WHEN hit THEN coalesce(octet_length(encode(low)) || ':' || low, '-') ELSE coalesce(octet_length(encode(text)) || ':' || text, '-') END) AS found
            FROM fields),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
                dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS source_no FROM leaves),
        inner_tree AS (
            SELECT 0 AS level, source_no, pos, leaf AS node, n FROM placed
            UNION ALL
            SELECT level + 1, source_no, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM inner_tree WHERE n > 1 GROUP BY level, source_no, pos // 16, n),
        subroots AS (SELECT source_no, node AS subroot, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
        outer_tree AS (
            SELECT 0 AS level, source_no AS pos, subroot AS node, n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM outer_tree WHERE n > 1 GROUP BY level, pos // 16, n),
        inner_runs AS (SELECT level, source_no, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS s FROM inner_tree WHERE n > 1 GROUP BY ALL),
        outer_runs AS (SELECT level, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS s FROM outer_tree WHERE n > 1 GROUP BY ALL),
        steps AS (
            SELECT p.source_no, p.pos, r.level AS step, substr(s, 1, 64 * (p.pos // CAST(pow(16, r.level) AS BIGINT) % 16)) AS l, substr(s, 64 * (p.pos // CAST(pow(16, r.level) AS BIGINT) % 16) + 65) AS r
            FROM placed p JOIN inner_runs r ON r.source_no = p.source_no AND r.run = p.pos // CAST(pow(16, r.level + 1) AS BIGINT)
            UNION ALL
            SELECT p.source_no, p.pos, 100 + r.level, substr(s, 1, 64 * (p.source_no // CAST(pow(16, r.level) AS BIGINT) % 16)), substr(s, 64 * (p.source_no // CAST(pow(16, r.level) AS BIGINT) % 16) + 65)
            FROM placed p JOIN outer_runs r ON r.run = p.source_no // CAST(pow(16, r.level + 1) AS BIGINT)),
        proofs AS (SELECT source_no, pos, list(l || '|' || r ORDER BY step) AS path, string_agg(l || r, '' ORDER BY step) AS siblings FROM steps GROUP BY ALL),
        folded AS (
            SELECT p.*, s.subroot, sha256(coalesce(siblings, '')) AS proof_sha256,
                list_reduce(coalesce(path, []), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2)), found) AS folded_root
            FROM placed p JOIN subroots s USING (source_no) LEFT JOIN proofs q ON q.source_no = p.source_no AND q.pos = p.pos)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded, (SELECT node AS root FROM outer_tree WHERE n = 1)""",
    "op13_fill_in_middle": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('1:' || doc_id), i, 8) AS BIGINT)) AS h FROM documents),
        cut AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM drawn),
        parts AS (
            SELECT doc_id, text, n, a, b, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                     WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
        made AS (
            SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts),
        split AS (SELECT *, string_split_regex(output, '<P>|<S>|<M>') AS p FROM made)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256,
            sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN p[2] || p[4] || p[3] ELSE p[3] || p[4] || p[2] END) AS restored_sha256
        FROM split""",
}
