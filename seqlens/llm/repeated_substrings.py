"""Removal of long repeated byte strings by a distributed suffix sort.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts
anywhere else (in another text or the same one). The suffixes that could be
repeated are found first, so that few of them are sorted:

1. Every window of ``LENGTH`` bytes picks the least of its 161 40-byte grams
   under a hash order. Equal windows pick the same gram, so windows whose gram
   occurs once are unique. Neighbouring windows share a gram, which leaves about
   one gram for 80 bytes to be counted; a gram's windows are one context.
2. Grams that occur twice go into fixed-size bit filters, and a second scan
   makes suffixes of their windows. Where all occurrences of a gram have one and
   the same context, the context is one suffix, sent as a hash. Else the context
   itself is sent, to meet the gram's other contexts; but the windows of a gram
   that occurs more than ``HOT`` times are suffixes of their own. Equal suffixes
   within a batch are settled there, and one of them goes on.
3. Suffixes are range-partitioned with sampled splitters on their leading bytes,
   then a hash; each bucket is sorted by multikey quicksort, and equal neighbours
   are repeated (contexts are cut into their windows first). Splitters are whole
   keys, so a run of equal suffixes ends with its bucket: across a boundary keys
   are compared by the splitters themselves.
4. The covered ranges of a text are gathered by the text's 128-bit hash, and cut
   out of each copy.

False hits of the bit filters only add suffixes; a suffix counts as repeated
when its first eight bytes, and a 64-bit hash of all of it, are equal.

Defined cases: null is an empty text; texts below ``LENGTH`` bytes keep all;
repeated rows and exact copies remove each other; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import (BASE, BYTE_HASH, U64, bit_filter, bit_filter_has, mix64, powers, ragged, raw_text,
                                scratch_table, table)

LENGTH, GRAM = 200, 40
CHUNK = 1 << 20
BUCKET_ROWS = 100_000
#: Occurrences of a gram whose contexts may meet in one bucket; beyond, the
#: windows of a hotter gram are suffixes of their own, spread over all buckets.
HOT = 5_000
_POW = powers(CHUNK + 1)
INVERSE = pow(int(BASE), -1, 1 << 64)
_INV = powers(CHUNK + 1, INVERSE)


def chunks(off: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most ``CHUNK``: whole texts together, or parts of one
    long text that overlap so that every window is in exactly one part."""
    row, n = 0, len(off) - 1
    while row < n:
        last = max(int(np.searchsorted(off, off[row] + CHUNK, "right")) - 1, row + 1)
        at, end = int(off[row]), int(off[last])
        while end - at > CHUNK:
            yield at, at + CHUNK
            at += CHUNK - length + 1
        yield at, end
        row = last


class Windows:
    """The windows of one chunk, by the gram that each picks."""

    def __init__(self, part: np.ndarray, at: int, off: np.ndarray, length: int):
        n, self.part = len(part), part
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_HASH[part] * _POW[:n], dtype=U64)))
        starts = np.zeros(max(n - length + 1, 0) + 1, np.int64)
        rows = np.arange(np.searchsorted(off, at, "right") - 1, np.searchsorted(off, at + n))
        first, end = np.maximum(off[rows] - at, 0), np.minimum(off[rows + 1] - at, n) - length + 1
        some = end > first
        np.add.at(starts, first[some], 1)
        np.add.at(starts, end[some], -1)
        v = np.flatnonzero(np.cumsum(starts[:-1]))
        if not len(v):
            self.lo = self.hi = self.place = np.zeros(0, np.int64)
            self.gram = self.context = np.zeros(0, U64)
            return
        grams = mix64((self.sums[GRAM:] - self.sums[:-GRAM]) * _INV[:n - GRAM + 1])
        place = np.arange(len(grams), dtype=U64)
        wide = length - GRAM + 1
        key = (grams & ~U64(CHUNK * 2 - 1)) | place
        padded = np.full(-(-len(key) // wide) * wide, U64(2**64 - 1))
        padded[:len(key)] = key
        blocks = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        picked = (np.minimum(behind[v], ahead[v + wide - 1]) & U64(CHUNK * 2 - 1)).astype(np.int64)
        cut = np.flatnonzero((picked[1:] != picked[:-1]) | (v[1:] != v[:-1] + 1)) + 1
        a = np.concatenate(([0], cut))
        self.lo, self.hi = v[a], v[np.concatenate((cut, [len(v)])) - 1]
        self.place = picked[a]
        self.gram = grams[self.place]
        self.context = self.hashes(self.lo, self.hi + length)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * _INV[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))

    def leads(self, start: np.ndarray) -> np.ndarray:
        """The first eight bytes as a number in byte order."""
        return self.part[start[:, None] + np.arange(8)].astype(np.uint8).view(">u8").ravel().astype(U64)


def count_grams(column, length: int) -> pa.RecordBatch:
    """Per gram of one batch: occurrences, least and greatest context hash."""
    buf, off = raw_text(column)
    grams, contexts = [np.zeros(0, U64)], [np.zeros(0, U64)]
    for at, end in chunks(off, length):
        w = Windows(buf[at:end], at, off, length)
        grams.append(w.gram)
        contexts.append(w.context)
    grams, contexts = np.concatenate(grams), np.concatenate(contexts).view(np.int64)
    order = np.lexsort((contexts, grams))
    grams, contexts = grams[order], contexts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(grams))
    return pa.RecordBatch.from_arrays(
        [pa.array(grams[first].view(np.int64)), pa.array(ends - first), pa.array(contexts[first]),
         pa.array(contexts[ends - 1] if len(first) else contexts)], ["gram", "n", "low", "high"])


def multikey_order(lead: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Order by lead, then tail: ties of the first key alone are sorted by the second."""
    order = np.argsort(lead, kind="stable")
    same = lead[order][1:] == lead[order][:-1]
    tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    sub = order[tied]
    order[tied] = sub[np.lexsort((tail[sub], lead[sub]))]
    return order


def equal_runs(lead: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey order, the starts of its runs of equal keys, and their lengths."""
    if not len(lead):
        return (np.zeros(0, np.int64),) * 3
    order = multikey_order(lead, tail)
    a, b = lead[order], tail[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return order, first, np.diff(np.append(first, len(order)))


SUFFIX = "lead bigint, tail bigint, twice boolean, k1 bigint, k2 bigint, start int, stop int, context binary"


def suffixes(batch: pa.RecordBatch, length: int, whole: np.ndarray, mixed: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Suffix rows of one batch (columns k1, k2, text). Rows with a null lead
    are ranges already known to be repeated; a row that is ``twice`` stands for
    those and has no text of its own."""
    buf, off = raw_text(batch.column(2))
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for at, end in chunks(off, length):
        w = Windows(buf[at:end], at, off, length)
        in_hot = bit_filter_has(hot, w.gram)
        in_mixed = bit_filter_has(mixed, w.gram) & ~in_hot
        one = np.flatnonzero(bit_filter_has(whole, w.gram) & ~in_mixed & ~in_hot)
        some, each = np.flatnonzero(in_mixed), np.flatnonzero(in_hot)
        single = ragged(w.lo[each], w.hi[each] - w.lo[each] + 1)
        start = np.concatenate((w.lo[one], w.lo[some], single))
        stop = np.concatenate((w.hi[one], w.hi[some], single)) + length
        if len(start):
            lead, tail = w.leads(start), w.hashes(start, stop)
            kind = np.repeat([0, 1, 0], [len(one), len(some), len(single)])
            # a mixed context is sorted by the suffix that starts at its gram
            lead[kind == 1] = w.leads(w.place[some])
            for o, x in zip(out, (lead, tail, start + at, stop + at, np.where(kind == 1, gram_of(w, one, some, single), U64(0)))):
                o.append(x)
    if out[0]:
        lead, tail, start, stop, gram = map(np.concatenate, out)
    else:
        lead = tail = gram = np.zeros(0, U64)
        start = stop = np.zeros(0, np.int64)
    row = np.searchsorted(off, start, "right") - 1
    k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
    order, first, runs = equal_runs(lead, tail)
    alone, again = order[first[runs == 1]], order[first[runs > 1]]
    found = order[np.repeat(runs, runs) > 1]
    # one range for each run of touching ranges of a text; copies of a text give it once
    a, b, r = merge(row[found], (start - off[row])[found], (stop - off[row])[found])
    _, keep = np.unique(np.stack([k1[r], k2[r], a]), axis=1, return_index=True) if len(r) else (0, np.zeros(0, np.int64))
    a, b, r = a[keep], b[keep], r[keep]
    n, m, d = len(alone), len(again), len(r)
    sent = np.concatenate((alone, again))
    tail = np.where(gram != 0, gram, tail)  # occurrences of one mixed gram meet
    none = lambda k: np.zeros(k, np.int64)
    settled = np.concatenate((np.zeros(n + m, bool), np.ones(d, bool)))
    shared = np.concatenate((np.zeros(n, bool), np.ones(m, bool), np.zeros(d, bool)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((x[sent].view(np.int64), none(d))), mask=settled) for x in (lead, tail)] + [pa.array(shared)]
        + [pa.array(np.concatenate((k[row[alone]], none(m), k[r])), mask=shared) for k in (k1, k2)]
        + [pa.array(np.concatenate(((x - off[row])[alone], none(m), y)).astype(np.int32), mask=shared) for x, y in ((start, a), (stop, b))]
        + [pa.array([buf[start[i]:stop[i]].tobytes() if gram[i] else None for i in sent] + [None] * d, pa.binary())],
        ["lead", "tail", "twice", "k1", "k2", "start", "stop", "context"])


def gram_of(w: Windows, one: np.ndarray, some: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Gram hashes (never 0) of the mixed contexts among a chunk's suffixes."""
    return np.concatenate((np.zeros(len(one), U64), w.gram[some] | U64(1), np.zeros(len(single), U64)))


def merge(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching ranges of a row made one: starts, stops, rows."""
    if not len(row):
        return start, stop, row
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    shift = row * (int(stop.max()) + 2)  # rows apart, so that one running maximum serves all
    reach = np.maximum.accumulate(stop + shift)
    first = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(first)[1:], len(row)) - 1
    return start[first], reach[last] - shift[last], row[first]


def compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One bucket: multikey sort, and the ranges of equal neighbours. Contexts of
    a mixed gram are cut into their windows here."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    lead, tail = (t[c].to_numpy().view(U64) for c in ("lead", "tail"))
    twice, context = t["twice"].to_numpy(), t["context"].combine_chunks()
    is_context = context.is_valid().to_numpy(zero_copy_only=False)
    start, stop = (t[c].fill_null(0).to_numpy() for c in ("start", "stop"))
    k1, k2 = (t[c].fill_null(0).to_numpy() for c in ("k1", "k2"))
    whole = np.flatnonzero(~is_context)
    found = [(whole[hit], start[whole[hit]], stop[whole[hit]]) for hit in [equal_rows(lead[whole], tail[whole], twice[whole])]]
    held = np.flatnonzero(is_context)
    for group in runs_of(multikey_order(lead[held], tail[held]), lead[held], tail[held]):
        rows = held[group]
        raw = [context[int(i)].as_py() for i in rows]
        off = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        buf = np.frombuffer(b"".join(raw), np.uint8)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_HASH[buf] * powers(len(buf)), dtype=U64)))
        count = np.diff(off) - length + 1
        at = ragged(off[:-1], count)
        row = np.repeat(np.arange(len(rows)), count)
        hashes = mix64((sums[at + length] - sums[at]) * powers(int(off[-1]), INVERSE)[at])
        gram = np.repeat(np.searchsorted(np.unique(tail[rows]), tail[rows]), count).astype(U64)
        hit = equal_rows(gram, hashes, np.repeat(twice[rows], count))
        a = at[hit] - off[row[hit]] + start[rows][row[hit]]
        found.append((rows[row[hit]], a, a + length))
    row, a, b = (np.concatenate(x) for x in zip(*found))
    own = ~twice[row]
    a, b, row = merge(row[own].astype(np.int64), a[own].astype(np.int64), b[own].astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                                     ["k1", "k2", "start", "stop"])


def equal_rows(lead: np.ndarray, tail: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Rows whose key occurs in two texts at least (a ``twice`` row counts as two)."""
    order, first, runs = equal_runs(lead, tail)
    if not len(order):
        return order
    hit = np.add.reduceat(twice[order].astype(np.int64), first) + runs > 1
    return order[np.repeat(hit, runs)]


def runs_of(order: np.ndarray, lead: np.ndarray, tail: np.ndarray, rows: int = 4096) -> Iterator[np.ndarray]:
    """Sorted rows in parts of about ``rows`` that end where the key changes."""
    a, b = lead[order], tail[order]
    ends = np.append(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, len(order)) if len(order) else []
    at = 0
    for end in ends:
        if end - at >= rows or end == len(order):
            yield order[at:end]
            at = end


def covered(documents: DataFrame, text: str, length: int) -> DataFrame:
    """(k1, k2, ranges) of every text with repeated strings; the keys are two
    hashes of the text."""
    spark = documents.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))

    def count(batches):
        for b in batches:
            yield count_grams(b.column(0), length)

    grams = (documents.select(t.alias("text")).mapInArrow(count, "gram bigint, n bigint, low bigint, high bigint").groupBy("gram")
             .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
             .where("n > 1").select("gram", F.when(F.col("low") == F.col("high"), 0).when(F.col("n") <= HOT, 1).otherwise(2).alias("kind")))
    grams = scratch_table(grams, "grams")
    sent = spark.sparkContext.broadcast([bit_filter(grams.where(F.col("kind") == kind), "gram") for kind in range(3)])

    def cut(batches):
        for b in batches:
            yield suffixes(b, length, *sent.value)

    rows = scratch_table(documents.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(length), t).alias("k2"), t.alias("text"))
                         .mapInArrow(cut, SUFFIX), "suffixes")
    def sort(batches):
        return compare(batches, length)

    to_sort = rows.where("lead is not null")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-to_sort.count() // BUCKET_ROWS))
    found = to_sort.repartitionByRange(buckets, "lead", "tail").mapInArrow(sort, "k1 bigint, k2 bigint, start int, stop int")
    every = found.union(rows.where("lead is null").select("k1", "k2", "start", "stop"))
    return every.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


RESULT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,spans:array<struct<start:bigint,stop:bigint>>>"
_ARROW = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def removal(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts, ranges):
        raw, spans = (text.as_py() or "").encode(), []
        for r in sorted((r["start"], r["stop"]) for r in found.as_py() or ()):
            if spans and r[0] <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], r[1])
            else:
                spans.append(list(r))
        kept, at = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        out.append({"n_bytes": len(raw), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans),
                    "kept_sha256": kept.hexdigest(), "spans": [{"start": a, "stop": b} for a, b in spans]})
    return pa.array(out, _ARROW)


def repeated_spans(documents: DataFrame, text: str = "text", length: int = LENGTH, into: str = "repeats") -> DataFrame:
    """``documents`` with a struct ``into``: n_bytes, n_removed, n_spans,
    kept_sha256 and the removed spans (byte offsets)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = documents.withColumns({"__k1": F.xxhash64(t), "__k2": F.xxhash64(F.lit(length), t)})
    found = covered(documents, text, length).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "ranges": "__ranges"})
    return rows.join(found, ["__k1", "__k2"], "left").withColumn(into, F.arrow_udf(removal, RESULT)(F.col(text), F.col("__ranges"))) \
        .drop("__k1", "__k2", "__ranges")


def op8_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    done = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", *[F.col(f"repeats.{x}").alias(x) for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
