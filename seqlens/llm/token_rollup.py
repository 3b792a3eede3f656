"""Token counts as delta-maintained rollups.

A rollup keeps additive totals by source, language and tokenizer version. Every
batch of changes is a set of signed rows: an insert adds its count, a delete
subtracts it, a revised count subtracts the old and adds the new one. A batch is
pre-aggregated to one delta per key, and committed under its batch id: its folder
counts once its ``_SUCCESS`` marker is there, so an attempt that died leaves
nothing behind, and a batch that is sent again changes nothing. Totals are the
sum of the committed deltas.

All state lies in the shared folder; only folder names reach the driver.

Defined cases: null source or language is a key of its own; a null count is 0;
an empty batch commits without deltas; keys whose documents are all gone have no
row; extra columns of a change are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm.common import hash_spans, pieces, raw_text, scratch_path, scratch_table, table, word_spans
from seqlens.llm.quality_rules import PIECE_BYTES, encoder_of, vocabulary_path

KEYS = ["source", "lang", "tokenizer_version"]
CHANGE = [*KEYS, "sign", "tokens"]
DELTA = "source string, lang string, tokenizer_version string, documents bigint, tokens bigint"


def signed(rows: DataFrame, sign: int, version: str, tokens: str) -> DataFrame:
    """Changes from counted documents (source, lang and a count column)."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).alias("sign"),
                       F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"))


def inserts(rows: DataFrame, version: str, tokens: str) -> DataFrame:
    return signed(rows, 1, version, tokens)


def deletes(rows: DataFrame, version: str, tokens: str) -> DataFrame:
    return signed(rows, -1, version, tokens)


def revisions(rows: DataFrame, version: str, old: str, new: str) -> DataFrame:
    return deletes(rows, version, old).union(inserts(rows, version, new))


class TokenRollup:
    """A rollup in a folder that all executors share. Batches of one rollup are
    committed by one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, '.', '_' and '-' only")
        return f"{self.path}/batch-{batch_id}"

    def is_committed(self, batch_id: str) -> bool:
        fs, marker = self._files(f"{self._batch(batch_id)}/_SUCCESS")
        return fs.exists(marker)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it has been committed before."""
        if self.is_committed(batch_id):
            return False
        sign = F.col("sign").cast("bigint")
        delta = changes.groupBy(*KEYS).agg(F.sum(sign).alias("documents"),
                                           F.sum(sign * F.coalesce("tokens", F.lit(0))).alias("tokens"))
        delta.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._batch(batch_id))
        return True

    def committed(self) -> list[str]:
        fs, root = self._files(self.path)
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        return [n[6:] for n in names if n.startswith("batch-") and self.is_committed(n[6:])]

    def totals(self) -> DataFrame:
        """One row per key that still has documents."""
        paths = [self._batch(b) for b in self.committed()]
        deltas = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return deltas.groupBy(*KEYS).agg(F.sum("documents").alias("n_documents"), F.sum("tokens").alias("n_tokens")) \
            .where("n_documents <> 0 or n_tokens <> 0")


COUNTS = "struct<n_bytes:bigint,n_words:bigint,n_tokens:bigint>"


def counter(model: str | None = None):
    """Arrow function text -> bytes, words and tokens of a SentencePiece
    vocabulary (each distinct word of a piece of the batch encoded once)."""
    def run(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(model or vocabulary_path())
        buf, off = raw_text(texts)
        n = len(off) - 1
        words, tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for at, stop in pieces(buf, off, PIECE_BYTES):
            s, e = word_spans(buf, off, at, stop)
            row = np.searchsorted(off, s, "right") - 1
            distinct, where, index = np.unique(hash_spans(buf, s, e), return_index=True, return_inverse=True)
            _, lens = encoder.encode(distinct, lambda k: buf[s[where[k]]:e[where[k]]].tobytes())
            words += np.bincount(row, minlength=n)
            tokens += np.bincount(row, lens[index], minlength=n).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(np.diff(off)), pa.array(words), pa.array(tokens)],
                                          names=["n_bytes", "n_words", "n_tokens"])

    return F.arrow_udf(run, COUNTS)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents, as two versions: the vocabulary's counts and word
    counts. Before them provisional counts (a quarter of the bytes) are inserted
    under a version of their own, revised to the vocabulary's counts, and deleted
    whole, so that no row of them is left. The revision is sent twice, and counts
    once."""
    documents = table(spark, sf_dir, "documents").select("source", "lang", counter()(F.col("text")).alias("c"))
    counted = scratch_table(documents.select("source", "lang", (F.col("c.n_bytes") / 4).cast("bigint").alias("provisional"),
                                             "c.n_words", "c.n_tokens"), "counted")
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("insert-provisional", inserts(counted, "provisional", "provisional"))
    for _ in range(2):
        rollup.commit("revise", revisions(counted, "provisional", "provisional", "n_tokens"))
    rollup.commit("delete-provisional", deletes(counted, "provisional", "n_tokens"))
    rollup.commit("insert-tokens", inserts(counted, "piece_bpe_32k", "n_tokens"))
    rollup.commit("insert-words", inserts(counted, "words", "n_words"))
    return rollup.totals()
