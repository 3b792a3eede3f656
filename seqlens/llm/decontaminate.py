"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items (13 consecutive normalised words; a shorter
item is one window) form one automaton over word numbers. Every text is
normalised and scanned once, and hits are mapped back to character offsets of
the original text.

The automaton is broadcast. Its size is bounded: items are packed into shards
of at most ``shard_words`` words. Each shard is a pass of its own over the documents,
written to the shared folder for the next, so a larger benchmark means more passes,
never a larger broadcast or automaton (0.75 GB measured for a million words; built
once in a worker, which keeps two at most). Nothing is shuffled.

Defined cases: a null or wordless text has no words, no hits and is not
contaminated; an item without words has no window; repeated items count
as one item by their id; a null item_id is no item but its windows hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm.common import scratch_table, table

WINDOW = 13
SHARD_WORDS = 1_000_000

#: Word characters: digits, letters after lower-casing A-Z, and all non-ASCII.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                for c in range(256))

RESULT = ("struct<n_words:bigint,n_hit:bigint,items:array<string>,"
          "spans:array<struct<start:bigint,end:bigint>>>")
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


def shards(benchmark: DataFrame, shard_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in shards of bounded size, streamed to the driver."""
    shard, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        w = words(text)
        if shard and size + len(w) > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((item, w))
        size += len(w)
    yield shard


class Matcher:
    """Automaton over the numbered words of one shard's windows."""

    def __init__(self, items, window: int):
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        found: dict[tuple[int, ...], set[int]] = {}
        for n, (_, item) in enumerate(items):
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in item)
            for k in range(max(len(w) - window, 0) + 1 if w else 0):
                found.setdefault(w[k:k + window], set()).add(n)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, owners in found.items():
            self.automaton.add_word(w, (len(w), owners))
        self.automaton.make_automaton()
        self.empty = not found

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs [first, end) of hit words (overlapping windows made one), and the items that occur."""
        if self.empty or not w:
            return [], set()
        get = self.number.get
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        for last, (n, owners) in self.automaton.iter(tuple([get(x, 0) for x in w])):
            items |= owners
            first = last + 1 - n
            while runs and runs[-1][1] > first:  # a longer window may start before earlier runs
                first = min(first, runs.pop()[0])
            runs.append((first, last + 1))
        return runs, items


def offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Character spans in the original text of runs of words."""
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in runs]


#: Automata of a worker process by the name of their scan: the last two.
_BUILT: dict[str, Matcher] = {}


def matcher_of(name: str, sent, window: int) -> Matcher:
    """A shard's automaton, built once in a worker."""
    if name not in _BUILT:
        if len(_BUILT) == 2:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = Matcher(sent.value, window)
    return _BUILT[name]


def scanner(spark: SparkSession, items, window: int):
    """Scan function for one shard of items."""
    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def scan(texts: pa.Array) -> pa.Array:
        m, out = matcher_of(name, sent, window), []
        for text in texts.to_pylist():
            w = words(text)
            runs, found = m.scan(w)
            ids = {m.ids[i] for i in found} - {None}
            out.append({"n_words": len(w), "n_hit": sum(b - a for a, b in runs), "items": sorted(ids),
                        "spans": offsets(text, runs) if runs else []})
        return pa.array(out, _ARROW)

    return F.arrow_udf(scan, RESULT)


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                  shard_words: int = SHARD_WORDS, into: str = "contamination") -> DataFrame:
    """``documents`` with a struct column ``into``: n_words, n_hit (document
    words inside any occurrence of a window), items (sorted ids that occur),
    n_items, spans (hit runs as character offsets of the original text) and
    contaminated (n_hit > 0 and at least a twentieth of the words)."""
    out, parts = documents, []
    for k, rows in enumerate(shards(benchmark, shard_words)):
        if k:  # a pass of its own: a worker holds one shard at a time
            out = scratch_table(out, f"shard-{k}")
        out = out.withColumn(f"{into}_{k}", scanner(documents.sparkSession, rows, window)(F.col(text)))
        parts.append(F.col(f"{into}_{k}"))
    n_hit, items, spans = (parts[0][x] for x in ("n_hit", "items", "spans"))
    if len(parts) > 1:
        items = F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in parts]))))
        spans = _union(F.flatten(F.array(*[p["spans"] for p in parts])))
        n_hit = _hit_words(F.col(text), spans)
    n_words = parts[0]["n_words"]
    result = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), items.alias("items"),
                      F.size(items).cast("bigint").alias("n_items"), spans.alias("spans"),
                      ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"))
    return out.withColumn(into, result).drop(*[f"{into}_{k}" for k in range(len(parts))])


def _union(spans):
    """Overlapping character spans merged; spans start and end at words."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        F.array_sort(spans), F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                       F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                                                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))


def _hit_words(text, spans):
    """Words of the text inside the spans."""
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + F.regexp_count(
        F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.lit(word)).cast("bigint"))


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    done = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", *[F.col(f"contamination.{x}").alias(x) for x in ("n_words", "n_hit", "n_items")],
                       F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
                       "contamination.contaminated")
