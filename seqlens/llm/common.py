"""Helpers shared by the corpus operators: reading, scratch tables in the
shared folder, fixed-size bit filters, and hashing of raw UTF-8 columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.session import ensure_checkpoint_dir

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the session names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/{name}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage, survives lost executors, and later readers share one result."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: inside higher-order
    functions an inlined expression would run again for every element."""
    return F.transform(F.array(value), body)[0]


# --- fixed-size bit filter over 64-bit hashes --------------------------------------------

def bit_filter(df: DataFrame, column: str, log2_bits: int = 26) -> np.ndarray:
    """Bytes of a two-probe Bloom filter of ``2**log2_bits`` bits (8 MB by
    default, whatever the input size) over a column of uniform 64-bit hashes.

    Built by native bitmap aggregates; only the fixed-size bitmap reaches the
    driver. A full filter lets more rows through and never loses one.
    """
    mask, c = (1 << log2_bits) - 1, F.col(column)
    probes = F.array(c.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(c, 37).bitwiseAND(F.lit(mask)))
    rows = (df.select(F.explode(probes).alias("p")).withColumn("p", F.col("p") + 1)  # buckets of positive values start at 1
            .groupBy(F.bitmap_bucket_number("p").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")))
    out = np.zeros(max((1 << log2_bits) // 8, 4096), np.uint8)
    for r in rows.toLocalIterator():
        out[(r.b - 1) * 4096:r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return out


def bit_filter_has(bits: np.ndarray, hashes: np.ndarray, log2_bits: int = 26) -> np.ndarray:
    mask = U64((1 << log2_bits) - 1)
    out = np.ones(len(hashes), bool)
    for p in (hashes & mask, (hashes >> U64(37)) & mask):
        p = p.astype(np.int64)
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def least_of(hashes: Column, wanted: Column | int, distinct: Column | int) -> Column:
    """Whether a signed 64-bit hash lies in the lowest part of the hash range,
    where a set of about ``distinct`` different hashes has ``wanted`` of them twice
    over: a cut from a count, so no task sees all hashes to find the least ones."""
    wanted, distinct = (F.lit(x) if isinstance(x, int) else x for x in (wanted, distinct))
    return hashes.cast("double") <= (wanted * 2 + 100) / F.greatest(distinct, F.lit(1)) * 2.0**64 - 2.0**63


# --- raw text columns ------------------------------------------------------------------

def raw_text(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def bounded_batches(batches: Iterator[pa.RecordBatch], column: str | int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take about ``size`` bytes; a longer
    text is a batch of its own. Bounds what a worker makes of one batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(int(np.searchsorted(ends, before + size, "right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread all 64 bits (finaliser of a multiply-xorshift generator)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


BYTE_HASH = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0xD1342543DE82EF95)  # odd: its powers are invertible modulo 2**64


def powers(n: int, base: int = int(BASE)) -> np.ndarray:
    out = np.full(n, U64(base), U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def pieces(buf: np.ndarray, off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that end where a text ends or, within a
    longer text, before white space; so no word is cut."""
    at, end = 0, int(off[-1])
    while at < end:
        stop = int(off[max(np.searchsorted(off, at + size, "right") - 1, 0)])
        if stop <= at:  # one text longer than ``size``
            row_end = int(off[np.searchsorted(off, at, "right")])
            stop = min(at + size, row_end)
            while stop < row_end:
                space = np.flatnonzero(SPACE[buf[stop:stop + size]])
                if len(space):
                    stop += int(space[0])
                    break
                stop = min(stop + size, row_end)
        yield at, stop
        at = stop


def word_spans(buf: np.ndarray, off: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (within the whole buffer) of the words
    ``[^\\x20\\x09-\\x0D]+`` of one piece; a word never spans two texts."""
    inside = ~SPACE[buf[at:stop]]
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[np.searchsorted(off, at):np.searchsorted(off, stop)] - at
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    return starts + at, np.flatnonzero(inside & ~after) + 1 + at


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table_=BYTE_HASH) -> np.ndarray:
    """64-bit polynomial hashes of the byte strings ``buf[start:end]``
    (non-overlapping, ascending, none empty)."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    flat = np.arange(int(lens.sum())) - np.repeat(first - starts, lens)
    place = flat - np.repeat(starts, lens)
    total = np.add.reduceat(table_[buf[flat]] * powers(int(lens.max()))[place], first)
    return mix64(total + lens.astype(U64) * U64(0x9E3779B97F4A7C15))


def words_of(buf: np.ndarray, off: np.ndarray, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word of every text: hashes, starts, lengths, and row offsets."""
    out = [[np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for at, stop in pieces(buf, off, size):
        s, e = word_spans(buf, off, at, stop)
        for o, x in zip(out, (hash_spans(buf, s, e), s, e - s)):
            o.append(x)
    hashes, starts, lens = map(np.concatenate, out)
    return hashes, starts, lens, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the words' row offsets."""
    hashes, _, _, bounds = words_of(buf, off)
    return hashes, bounds


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs ``start .. start + len``."""
    return np.arange(int(lens.sum())) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def row_ids(off: np.ndarray) -> np.ndarray:
    """Row number of each item, from row offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
