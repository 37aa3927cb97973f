"""Token counts as delta-maintained rollups.

A batch is a set of changes to documents: ``insert`` and ``revise`` carry a text, ``delete`` none. Against
the ledger, which holds each document's last counted state, a batch becomes signed rows: what was counted
is taken off the totals of its source, language and tokenizer version, what is new is put on. A batch writes
three tables: the state that it leaves its documents in (the ledger's next layer), the signed rows, and
their sums by group. Totals add the sums of batches, one row for each group of a batch, and never read a
document's row again; ``compact`` folds layers and sums into one.

A batch is committed by creating one numbered file in the log, with its name and folder. Creating fails if
the number is taken, so of two writers one is told to try again; a name that is in the log isn't counted
again, and a batch that broke off before is in no log, so resending is safe.

Defined cases: null text has no tokens; null source or language is a group of its own; a null id can't be
revised or deleted, its inserts add up; within a batch the last change (by ``seq``) of an id holds, ties by
a hash of text, source and language, then by ``op``; inserting a known id revises it; deleting an unknown
one does nothing; empty batches commit nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, slices
from .tokens import VOCABULARY, token_ids

GROUP = ("source", "lang", "tokenizer")
MEASURES = ("documents", "tokens", "bytes")
#: The tokenizer version that the query revises some documents from.
OLDER = "byte_bpe_50k.json"
#: The log's name for a layer that stands for all before it.
COMPACTED = "*compacted*"


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the tokenizer version, tokens and bytes."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            ids = token_ids(b.column(1), vocabulary)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["_row", "tokens"])

    packed = docs.select(F.struct(*rest, F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("bytes")).alias("_row"), F.col(text_col).alias("_text"))
    out = packed.mapInArrow(run, T.StructType([packed.schema["_row"], T.StructField("tokens", T.LongType())]))
    return out.select("_row.*", "tokens", F.lit(vocabulary).alias("tokenizer"))


class TokenRollup:
    """A rollup at a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id"):
        self.spark, self.path, self.id = spark, path.rstrip("/"), id_col
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _file(self, name: str):
        p = self.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def log(self) -> list[tuple[str, str]]:
        """Name and folder of every committed batch, in order."""
        system, p = self._file("log")
        if not system.exists(p):
            return []
        rows = self.spark.read.text(f"{self.path}/log/*").select(F.col("_metadata.file_name").alias("file"), "value").orderBy("file").collect()
        held = [tuple(r.value.split("\t")) for r in rows]
        if len(held) != len(system.listStatus(p)):
            raise RuntimeError(f"a file of {self.path}/log is empty: its writer broke off; remove it and send the batch again")
        return held

    def _layers(self, table: str, log: list[tuple[str, str]]) -> DataFrame | None:
        start = max((i for i, (name, _) in enumerate(log) if name == COMPACTED), default=0)
        folders = [f"{self.path}/batches/{folder}/{table}" for _, folder in log[start:]]
        return self.spark.read.parquet(*folders) if folders else None

    def _commit(self, name: str, number: int, folder: str) -> bool:
        system, p = self._file(f"log/{number:010d}")
        try:
            out = system.create(p, False)
        except Py4JJavaError:
            if system.exists(p):
                return False
            raise
        out.write(bytearray(f"{name}\t{folder}\n".encode()))
        out.close()
        return True

    def commit(self, name: str, changes: DataFrame, vocabulary: str = VOCABULARY) -> bool:
        """Count a batch (op, seq, id, source, lang, text); false if a batch of this name is in already."""
        log = self.log()
        if any(name == known for known, _ in log):
            return False
        gone, has_id = F.col("op") == "delete", F.col(self.id).isNotNull()
        known = changes.select("op", "seq", self.id, "source", "lang", "text").withColumn("h", F.xxhash64("text", "source", "lang"))
        # Counting comes before the shuffle, so that no text goes through it.
        count = lambda df: counted(df.withColumn("text", F.when(~gone, F.col("text"))), vocabulary, self.id)
        rest = ("op", *GROUP, *MEASURES[1:])
        keyed = count(known.filter(has_id)).groupBy(self.id).agg(F.max(F.struct("seq", "h", *rest)).alias("x")).select(self.id, *(f"x.{c}" for c in rest))
        loose = count(known.filter(~has_id & ~gone)).select(self.id, *rest)
        folder = uuid.uuid4().hex
        at = f"{self.path}/batches/{folder}"
        keyed.unionByName(loose).select(self.id, *GROUP, F.when(gone, 0).otherwise(1).cast("long").alias("documents"), "tokens", "bytes", F.lit(len(log)).alias("batch")).write.parquet(f"{at}/state")
        now = self.spark.read.parquet(f"{at}/state")
        signed = now.filter("documents > 0").drop("batch")
        held = self._layers("state", log)
        if held is not None:
            ids = now.filter(F.col(self.id).isNotNull()).select(self.id)
            before = held.join(ids, self.id, "left_semi").groupBy(self.id).agg(F.max(F.struct("batch", *GROUP, "documents", *MEASURES[1:])).alias("x"))
            minus = before.select(self.id, "x.*").filter("documents > 0").select(self.id, *GROUP, *((-F.col(m)).alias(m) for m in MEASURES))
            signed = signed.unionByName(minus)
        signed.write.parquet(f"{at}/signed")
        self.spark.read.parquet(f"{at}/signed").groupBy(*GROUP).agg(*(F.sum(m).alias(m) for m in MEASURES)).write.parquet(f"{at}/sums")
        if not self._commit(name, len(log), folder):
            raise RuntimeError(f"another writer committed batch {len(log)} first; send {name} again")
        return True

    def compact(self) -> None:
        """One layer for all: the last state of each id, and the totals."""
        log, folder = self.log(), uuid.uuid4().hex
        held = self._layers("state", log)
        if held is None:
            return
        keyed = held.filter(F.col(self.id).isNotNull()).groupBy(self.id).agg(F.max(F.struct("batch", *GROUP, *MEASURES)).alias("x")).select(self.id, "x.*").filter("documents > 0")
        keyed.select(held.columns).unionByName(held.filter(F.col(self.id).isNull())).write.parquet(f"{self.path}/batches/{folder}/state")
        self.totals().write.parquet(f"{self.path}/batches/{folder}/sums")
        if not self._commit(COMPACTED, len(log), folder):
            raise RuntimeError("another writer committed first; compact again")

    def totals(self) -> DataFrame:
        """Documents, tokens and bytes by source, language and tokenizer version."""
        held = self._layers("sums", self.log())
        if held is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, documents bigint, tokens bigint, bytes bigint")
        return held.groupBy(*GROUP).agg(*(F.sum(m).alias(m) for m in MEASURES)).filter("documents <> 0")


def token_rollup(docs: DataFrame, vocabulary: str = VOCABULARY, older: str = OLDER, again: int = 16) -> DataFrame:
    """All documents through every kind of change, ending in the table's own state; the totals by group.

    One in ``again`` of the ids comes first with an older tokenizer version, another with a draft of its text;
    the load that follows inserts all documents and so revises these. One in ``again`` is inserted under an
    id of its own and deleted. The load is sent twice.
    """
    spark = docs.sparkSession
    rollup = TokenRollup(spark, Scratch(spark, "rollup").root)
    slim = docs.select(F.col("doc_id").cast("string"), "source", "lang", "text")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(again))
    batch = lambda df, op, seq, text="text": df.select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), "doc_id", "source", "lang", F.expr(text).alias("text"))
    known = slim.filter("doc_id IS NOT NULL")
    extra = known.filter(turn == 2).withColumn("doc_id", F.concat(F.lit("extra-"), F.col("doc_id")))
    rollup.commit("older", batch(known.filter(turn == 0), "insert", 0), older)
    rollup.commit("drafts", batch(known.filter(turn == 1), "insert", 0, "concat(text, ' draft')").unionByName(batch(extra, "insert", 0)), vocabulary)
    load = batch(slim, "insert", 1).unionByName(batch(extra, "delete", 2, "cast(null AS string)"))
    rollup.commit("load", load, vocabulary)
    rollup.commit("load", load, vocabulary)
    return rollup.totals()
