"""N-gram Jaccard join over a token-group matrix.

Documents with one and the same shingle set form a class. Classes that agree on
their least shared token under a second hash order and on their size band form a
group of similar documents (split into groups of about ``GROUP`` classes). The matrix
holds, per token, the groups whose members have it among the tokens that a
linked document must share: the first ``n - ceil(t n) + 1`` of the set in one
global order, rare tokens first. Documents are counted for a sample of the
tokens; a token that occurs once is in no one else's set and needs no row.

A query class meets a group only through the matrix. In the group's block the
union of the members' prefixes bounds the overlap with every member; a group
below the bound is never opened. Only classes that qualify have their texts
shuffled, and are verified exactly.

Dense clusters cost no pair per pair of copies: the first round compares every
class with its own group and with one centre group for each of its tokens;
components follow. The second round goes on among the holders of tokens that still
span components: their tokens are counted once more, all of them and among the
holders only, so that a text with more than a few tokens of its own has a prefix of
those alone and drops out, however common the passage is that it shares; classes of
groups that then share a token, and are in different components, are compared. Links
inside a known component are not needed, so the result holds components, not the
number of links.

Defined cases: null, empty and wordless texts have no shingles and are linked
with nothing; a text with fewer words than a shingle is one shingle; repeated
rows each get a row; a null doc_id is larger than any (a component of such rows
alone has a null id). Classes are told apart by 64-bit set digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlens.llm.common import (LOWER, U64, bit_filter, bit_filter_has, bounded_batches, mix64, raw_text, scratch_table, table,
                                word_hashes)
from seqlens.llm.components import components

GROUP = 64
#: Queries compared with one copy of a group's members in one block.
BLOCK = 256
#: Share of all tokens whose documents are counted, as a multiple of the share
#: that a prefix takes; and the count from which a token is looked at last. Both
#: change only the order of tokens, never the result.
SAMPLE, FREQUENT = 2.0, 32


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its k-word shingles."""
    buf, off = raw_text(column)
    words, bounds = word_hashes(LOWER[buf], off)
    n = max(len(words) - k + 1, 0)
    run = np.zeros(n, U64)
    for j in range(k):
        run = mix64(run * U64(0x9E3779B97F4A7C15) + words[j:j + n])
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            s = np.sort(run[a:b - k + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            one = np.full(min(b - a, 1), b - a, U64)  # the whole sequence, if any
            for w in words[a:b]:
                one = mix64(one * U64(31) + w)
            sets.append(one)
    return sets


def digest(s: np.ndarray) -> np.uint64:
    return mix64(mix64(s ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64, keepdims=True) + U64(len(s)))[0]


def sampled(s: np.ndarray, share: float) -> int:
    """How many of a set's sorted tokens lie below ``share`` of the hash range."""
    return int(np.searchsorted(s, U64(min(int(share * 2**64), 2**64 - 1))))


def shared_tokens(documents: DataFrame, text: str, k: int, share: float) -> list[np.ndarray]:
    """Bit filters of the sampled tokens that occur in two documents at least,
    and in ``FREQUENT`` at least. What is in neither occurs once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 0):
            sets = [s[:sampled(s, share)] for s in shingle_sets(batch.column(0), k)]
            tok, n = np.unique(np.concatenate([np.zeros(0, U64)] + sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(n)], ["tok", "n"])

    found = (documents.select(text).mapInArrow(count, "tok bigint, n bigint").groupBy("tok").agg(F.sum("n").alias("n")).where("n > 1"))
    found = scratch_table(found, "shared-tokens")
    return [bit_filter(found, "tok"), bit_filter(found.where(F.col("n") >= FREQUENT), "tok")]


def signatures(documents: DataFrame, text: str, id_col: str, k: int, num: int, den: int, share: float | None = None) -> DataFrame:
    """One row per document: id, n, cid (set digest; null without shingles),
    lead (least shared token in a second order), rest (tokens after the prefix) and
    prefix (the prefix's tokens that may occur elsewhere).

    The global order of tokens: sampled tokens that occur once, sampled shared
    ones, sampled frequent ones, then the others; by hash within each. ``share``:
    of the tokens to sample, by default ``SAMPLE`` prefixes' worth."""
    share = share or min(1.0, SAMPLE * (den - num) / den)
    sent = documents.sparkSession.sparkContext.broadcast(shared_tokens(documents, text, k, share))
    schema = (T.StructType().add("doc_id", documents.schema[id_col].dataType).add("n", "long").add("cid", "long")
              .add("lead", "long").add("rest", "long").add("prefix", T.ArrayType(T.LongType())))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, often = sent.value
        for batch in bounded_batches(batches, 1):
            cid, lead, rest, prefix, sizes = [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n = len(s)
                sizes.append(n)
                if not n:
                    for x in (cid, lead, rest, prefix):
                        x.append(None)
                    continue
                cid.append(int(digest(s).view(np.int64)))
                p, m = n - -(-num * n // den) + 1, sampled(s, share)
                rest.append(n - p)
                level = np.full(n, 3)
                level[:m] = bit_filter_has(twice, s[:m]).astype(int) + bit_filter_has(often, s[:m])
                first = np.argsort(level, kind="stable")[:p]
                common = s[level[:m].nonzero()[0]] if level[:m].any() else s
                lead.append(int(mix64(common ^ U64(0xC3C3C3C33C3C3C3C)).min().view(np.int64)))
                prefix.append(s[first[level[first] > 0]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(cid, pa.int64()), pa.array(lead, pa.int64()),
                 pa.array(rest, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], schema.names)

    return documents.select(id_col, text).mapInArrow(sign, schema)


def texts_of(documents: DataFrame, text: str, k: int, need: DataFrame) -> DataFrame:
    """(cid, text) of the classes in ``need``: a fixed-size filter of their ids
    thins the second scan, so only these texts are shuffled."""
    sent = documents.sparkSession.sparkContext.broadcast(bit_filter(need, "cid"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 0):
            sets = shingle_sets(batch.column(0), k)
            cid = np.array([digest(s) for s in sets], U64)
            seen: set[int] = set()
            keep = [i for i in np.flatnonzero(bit_filter_has(sent.value, cid))
                    if len(sets[i]) and not (cid[i] in seen or seen.add(cid[i]))]
            yield pa.RecordBatch.from_arrays([pa.array(cid[keep].view(np.int64)), batch.column(0).take(pa.array(keep, pa.int64()))],
                                             ["cid", "text"])

    return documents.select(text).mapInArrow(pick, "cid bigint, text string").groupBy("cid").agg(F.first("text").alias("text"))


class TokenUnion:
    """The token union of a group's members, with the members that hold each token."""

    def __init__(self, sets: list[np.ndarray]):
        self.members = len(sets)
        sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), sizes)[order]
        self.union, first = np.unique(tokens[order], return_index=True)
        self.first = np.append(first, len(tokens))

    def find(self, query: np.ndarray) -> np.ndarray:
        """Places in the union of the query's tokens."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        return at[self.union[at] == query]

    def overlaps(self, at: np.ndarray) -> np.ndarray:
        """Per member, the number of the found tokens it holds."""
        lens = self.first[at + 1] - self.first[at]
        hit = np.arange(int(lens.sum())) + np.repeat(self.first[at] - (np.cumsum(lens) - lens), lens)
        return np.bincount(self.owner[hit], minlength=self.members)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by (gid, block), cut so that no group spans two tables, with
    the bounds of the groups in each."""
    def starts(t: pa.Table) -> np.ndarray:
        gid, block = (t[c].to_numpy() for c in ("gid", "block"))
        return np.concatenate(([0], np.flatnonzero((gid[1:] != gid[:-1]) | (block[1:] != block[:-1])) + 1))

    held = None
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            at = starts(t)
            held = t.slice(at[-1])
            if at[-1]:
                yield t.slice(0, at[-1]).combine_chunks(), at
    if held is not None:
        yield held.combine_chunks(), np.append(starts(held), held.num_rows)


def bounded(t: pa.Table, bounds: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows may have a link within their block, by their prefixes alone.

    With prefixes in one global order, two sets share at most (shared prefix
    tokens) + max(tokens after the prefix). A query whose prefix meets the
    group's token union too seldom for any member does not open the group."""
    keep = np.zeros(t.num_rows, bool)
    lists = t["prefix"].combine_chunks()
    tokens, off = lists.values.to_numpy(), lists.offsets.to_numpy()
    n, rest, member, comp, first = (t[c].to_numpy() for c in ("n", "rest", "member", "comp", "first"))
    for a, b in zip(bounds[:-1], bounds[1:]):
        inside = a + np.flatnonzero(member[a:b])
        asking = a + np.flatnonzero(~member[a:b] | first[a:b])
        if not len(inside) or len(inside) + len(asking) < 2 or not sum(off[i + 1] - off[i] for i in inside):
            continue
        group = TokenUnion([tokens[off[i]:off[i + 1]] for i in inside])
        for q in asking:
            need = np.maximum(-(-num * (n[q] + n[inside]) // (num + den)) - np.maximum(rest[q], rest[inside]), 1)
            size = off[q + 1] - off[q]
            need[(den * n[inside] < num * n[q]) | (den * n[q] < num * n[inside]) | (comp[inside] == comp[q])] = size + 1
            least = need.min()
            if least > size:
                continue
            at = group.find(tokens[off[q]:off[q + 1]])
            if len(at) >= least:
                near = inside[group.overlaps(at) >= need]
                keep[near] = True
                keep[q] |= len(near) > 0
    return keep


def linked(t: pa.Table, bounds: np.ndarray, k: int, num: int, den: int) -> tuple[list[int], list[int]]:
    """Links between each block's members and its queries, exactly, as a forest:
    what is already connected is not verified again."""
    sets = shingle_sets(t["text"], k)
    cid, comp = t["cid"].to_pylist(), t["comp"].to_pylist()
    member, first = t["member"].to_numpy(), t["first"].to_numpy()
    sizes = np.array([len(s) for s in sets])
    us, vs = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        inside = a + np.flatnonzero(member[a:b])
        if not len(inside) or b - a < 2:
            continue
        group = TokenUnion([sets[i] for i in inside])
        parent = {c: c for c in comp[a:b]}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for q in a + np.flatnonzero(~member[a:b] | first[a:b]):
            at = group.find(sets[q])
            if len(at) * den < num * sizes[q]:  # the whole group cannot reach the needed overlap
                continue
            shared = group.overlaps(at)
            for m in inside[den * shared >= num * (sizes[q] + sizes[inside] - shared)]:
                x, y = root(comp[q]), root(comp[m])
                if x != y:
                    parent[x] = y
                    us.append(cid[q])
                    vs.append(cid[m])
    return us, vs


PARTS = "gid bigint, block int, cid bigint, comp bigint, member boolean, first boolean"


def qualifying(queries: DataFrame, classes: DataFrame, comp: DataFrame | None, within: bool, num: int, den: int) -> DataFrame:
    """The classes to open, by group and block: ``queries`` (cid, gid of the
    group) whose overlap bound allows a link, and the members they may link to;
    ``within``: also members that may link among themselves. A group with many
    queries is copied to several blocks."""
    blocks = queries.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = classes.select("cid", "gid", "alike")
    if within:
        members = members.join(blocks, "gid", "left").where("blocks is not null or alike > 1")
    else:
        members = members.join(blocks, "gid")
    members = members.select("cid", "gid", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"),
                             F.lit(True).alias("member"))
    asked = queries.join(blocks, "gid").select("cid", "gid", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"),
                                               F.lit(False).alias("member"))
    rows = members.union(asked)
    if comp is None:
        rows = rows.withColumn("comp", F.col("cid"))
    else:
        rows = rows.join(comp, rows["cid"] == comp["node"], "left").select(rows["*"], F.coalesce("comp", "cid").alias("comp"))
    rows = rows.withColumn("first", F.col("member") & F.lit(within) & (F.col("block") == 0)).join(classes.select("cid", "n", "rest", "prefix"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches):
            out = t.select(["gid", "block", "cid", "comp", "member", "first"]).filter(pa.array(bounded(t, bounds, num, den)))
            yield from out.combine_chunks().to_batches()

    return by_block(rows, run, PARTS)


def opened(parts: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (u, v) among the qualifying classes, verified on whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(bounded_batches(batches, "text")):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in linked(t, bounds, k, num, den)], ["u", "v"])

    return by_block(parts.join(texts, "cid"), run, "u bigint, v bigint")


def by_block(rows: DataFrame, run, schema: str) -> DataFrame:
    """Blocks dealt to tasks whole, and streamed in order."""
    return rows.repartition("gid", "block").sortWithinPartitions("gid", "block").mapInArrow(run, schema)


def jaccard_components(documents: DataFrame, text: str = "text", id_col: str = "doc_id", shingle_words: int = 3,
                       threshold: tuple[int, int] = (9, 10)) -> tuple[DataFrame, DataFrame]:
    """The join, as (signatures, classes).

    signatures: one row per document (doc_id, n, cid). classes: one row per
    distinct set (cid, root: its smallest doc_id, comp, component_id: the
    smallest doc_id reachable by links of Jaccard similarity >= num/den)."""
    k, (num, den) = shingle_words, threshold
    documents = documents.select(id_col, text)
    signed = scratch_table(signatures(documents, text, id_col, k, num, den), "signatures")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))
    classes = (signed.where("cid is not null").groupBy("cid")
               .agg(F.min("doc_id").alias("root"), F.first("n").alias("n"), F.first("lead").alias("lead"),
                    F.first("rest").alias("rest"), F.first("prefix").alias("prefix")).withColumn("band", band))
    sizes = classes.groupBy("lead", "band").agg(F.count("*").alias("alike")).where("alike > 1")
    sizes = scratch_table(sizes, "alike")
    classes = classes.join(sizes, ["lead", "band"], "left").select(
        "cid", "root", "n", "rest", "prefix", F.coalesce("alike", F.lit(1)).alias("alike"),
        F.xxhash64("lead", "band", F.pmod(F.xxhash64("cid"), F.ceil(F.coalesce("alike", F.lit(1)) / GROUP))).alias("gid"))
    classes = scratch_table(classes, "classes")

    def verified(queries: DataFrame, classes: DataFrame, comp: DataFrame | None, within: bool) -> DataFrame:
        parts = scratch_table(qualifying(queries, classes, comp, within, num, den), "qualifying")
        texts = texts_of(documents, text, k, parts.select("cid"))
        return scratch_table(opened(parts, texts, k, num, den), "links")

    matrix = classes.select(F.explode("prefix").alias("tok"), "cid", "gid")
    centres = matrix.groupBy("tok").agg(F.min("gid").alias("centre"), F.max("gid").alias("top")).where("centre < top")
    shared = scratch_table(matrix.join(centres.drop("top"), "tok"), "shared")
    asked = scratch_table(shared.where("gid <> centre").select("cid", F.col("centre").alias("gid")).distinct(), "asked")
    links = verified(asked, classes, None, True)
    comp = scratch_table(components(links, rounds=2), "components")

    # Classes that share a token and are not yet in one component. Two classes that
    # still may link both hold an open token, so the search goes on among the holders
    # alone, with an order of tokens of their own: every token is now counted, and one
    # that no other holder has needs no row.
    def still_open(shared: DataFrame) -> DataFrame:
        known = shared.select("tok", "cid", "gid").join(comp, shared["cid"] == comp["node"], "left") \
            .select("tok", "cid", "gid", F.coalesce("comp", "cid").alias("comp"))
        tokens = known.groupBy("tok").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("tok")
        return known.join(tokens, "tok")

    holders = scratch_table(still_open(shared).select("cid").distinct(), "holders")
    again = scratch_table(texts_of(documents, text, k, holders).join(holders, "cid", "left_semi"), "again")
    anew = signatures(again, "text", "cid", k, num, den, share=1.0).select("cid", "rest", "prefix")
    held = scratch_table(classes.drop("rest", "prefix").join(anew, "cid"), "held")
    left = scratch_table(still_open(held.select(F.explode("prefix").alias("tok"), "cid", "gid"))
                         .join(held.select("cid", "n"), "cid"), "open")
    groups = left.groupBy("tok", "gid").agg(F.min("n").alias("least"), F.max("n").alias("most"),
                                            F.min("comp").alias("low"), F.max("comp").alias("high"))
    one, other = groups.alias("a"), groups.alias("b")
    pairs = one.join(other, "tok").where("a.gid > b.gid and (a.low <> b.high or a.high <> b.low)") \
        .where((F.col("a.most") * den >= F.col("b.least") * num) & (F.col("b.most") * den >= F.col("a.least") * num)) \
        .select(F.col("a.gid").alias("gid"), F.col("b.gid").alias("g")).distinct()
    rest = left.select("cid", "gid").distinct().join(pairs, "gid").select("cid", F.col("g").alias("gid")) \
        .join(asked, ["cid", "gid"], "left_anti")
    more = verified(scratch_table(rest, "rest"), held, comp, False)
    comp = components(links.union(more))

    classes = scratch_table(classes.select("cid", "root").join(comp, F.col("cid") == F.col("node"), "left")
                            .select("cid", "root", F.coalesce("comp", "cid").alias("comp")), "classes")
    low = classes.groupBy("comp").agg(F.min("root").alias("component_id"))
    return signed.select("doc_id", "n", "cid"), classes.join(low, "comp").select("cid", "root", "comp", "component_id")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    signed, classes = jaccard_components(table(spark, sf_dir, "documents"))
    return signed.join(classes, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
