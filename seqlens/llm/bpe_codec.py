"""BPE encoding and decoding: speculate, verify, merge only where that fails.

*Speculate*: a word is cut greedily into the longest tokens of the vocabulary.
*Verify*: a cut is what merging by rank gives if and only if no two neighbours would
have been merged across their border, so every pair of neighbours of every new word
is tested, all at once in numpy: the merges inside both tokens are undone, latest
first, and a merge across the border that ranks before the one undone refutes the
pair. *Merge*: the words with a refuted pair, and only they, are merged exactly.
Greedy cuts use only tokens that merging gives for their own bytes.

Words are encoded once while a worker's bounded table holds them; texts are then
rows of numbers in that table. Text is read as the vocabulary's file says: special
tokens are found first, in the raw text; the rest is put in NFC and in lower case
and split into letters, single digits, contractions and runs of other characters.
For text of the first 256 code points that is done here; the parts between spaces
that hold others go through the ``tokenizers`` library's own normaliser and
splitter, whose Unicode tables then decide.

Every text is a row of an Arrow batch on its own: no shuffle, no state between
tasks. Memory: a batch, the bounded table, and one piece (``PIECE_CHARS``) of words.

Defined cases: null is the empty text, which has no tokens and decodes to the empty
text. Repeated rows are encoded alike. Other columns take no part, whatever their
names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import ragged, table

VOCABULARY = "word_bpe_49k.json"
#: Words and tokens of a worker's table, at most; it then starts anew.
TABLE_WORDS, TABLE_TOKENS = 400_000, 4_000_000
#: Bytes from which a word is merged by a heap.
LONG_WORD = 100
#: Characters whose words are held at once.
PIECE_CHARS = 1 << 20

# letters and digits among the first 256 code points, in lower case
_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r\x20\x85\xa0"
_WORD = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:[stmd]|re|ve|ll)|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_BLANKS = re.compile("[ \t\n\r\f\v]+")
_HIGH = re.compile("[^\x00-\xff]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the
    others, in order, for the letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Vocabulary tables, and the table of the words seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        self.suffix = model["end_of_word_suffix"]
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._tables(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.tokens = pa.array([t for t, _ in sorted([*model["vocab"].items(), *self.special.items()], key=lambda x: x[1])])
        self.forget()

    def _tables(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        letters, n = byte_letters(), max(vocab.values()) + 1
        # bytes as tokens: inside a word, and at its end
        self.leaves = [[vocab[c] for c in letters], [vocab[c + self.suffix] for c in letters]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.made = made.tolist()
        self.pair_rank_of = {p: r for r, p in enumerate(zip(left.tolist(), right.tolist()))}
        # pair -> rank, for lookups of many pairs
        key = left << 32 | right
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], order
        # token -> the merge that makes it (the first, if several do), -1 for single bytes
        self.rank = np.full(n, -1, np.int64)
        self.part = np.tile(np.arange(n), (2, 1))
        for r in range(len(merges) - 1, -1, -1):
            self.rank[made[r]], self.part[0, made[r]], self.part[1, made[r]] = r, left[r], right[r]
        # tokens that merging gives for their own bytes
        sound = self.rank < 0
        alone = self.compatible(left, right, own=np.arange(len(merges)))
        for r in range(len(merges)):
            if self.rank[made[r]] == r:
                sound[made[r]] = alone[r] and sound[left[r]] and sound[right[r]]
        byte_of = {c: b for b, c in enumerate(letters)}
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for t, i in vocab.items():
            if sound[i]:
                ends = t.endswith(self.suffix) and len(t) > len(self.suffix)
                (self.last if ends else self.inner)[bytes(byte_of[c] for c in (t.removesuffix(self.suffix) if ends else t))] = i
        self.longest = max(map(len, self.inner))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a large number where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether merging by rank leaves the border between tokens ``a`` and ``b``.

        Seen from the end, the merges on either side are undone, the later one
        first; at equal rank the left of two places is merged first. In between,
        the tokens at the border stand side by side until the merge undone last
        takes one of them away: a merge across the border that comes before that
        one is made instead. ``own``: ranks of merges across the border that are
        meant, and only come last."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        until = np.full(len(a), (1 << 40) - 1) if own is None else own - 1  # merges up to this rank come before
        while len(live):
            bad = self.ranks(a, b) <= until
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            # the right token's merge stands to the right of the border, so at equal rank it comes after it
            undo_left = ra > rb
            until = np.where(undo_left, ra - 1, rb)
            a, b = np.where(undo_left, self.part[1, a], a), np.where(undo_left, b, self.part[0, b])
        return ok

    # --- words ---------------------------------------------------------------------

    def greedy(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        while at < n:
            found = self.last.get(word[at:])
            if found is not None:
                out.append(found)
                return out
            for end in range(min(at + self.longest, n - 1), at, -1):
                found = self.inner.get(word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of the lowest rank first, the leftmost of equal ones."""
        if len(word) > LONG_WORD:
            return self._merged_by_heap(word)
        rank, made, none = self.pair_rank_of, self.made, len(self.made)
        ids = [*map(self.leaves[0].__getitem__, word[:-1]), self.leaves[1][word[-1]]]
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:
            k = ranks.index(r)
            ids[k:k + 2] = [made[r]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank.get((ids[k], ids[k + 1]), none)
        return ids

    def _merged_by_heap(self, word: bytes) -> list[int]:
        """The same in n log n steps, for long words."""
        n, rank = len(word), self.pair_rank_of
        ids = [*map(self.leaves[0].__getitem__, word[:-1]), self.leaves[1][word[-1]]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], k, *p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged elsewhere
            ids[k], ids[j] = self.made[r], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (p := (ids[x], ids[after[x]])) in rank:
                    heapq.heappush(heap, (rank[p], x, *p))
        return [i for i in ids if i >= 0]

    def speculate(self, words: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """Greedy cuts, and whether each is verified."""
        cuts = [self.greedy(w) for w in words]
        lens = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter(chain.from_iterable(cuts), np.int64, int(lens.sum()))
        row = np.repeat(np.arange(len(cuts)), lens)
        pairs = np.flatnonzero(row[1:] == row[:-1])
        good = np.ones(len(cuts), bool)
        good[row[pairs[~self.compatible(flat[pairs], flat[pairs + 1])]]] = False
        return cuts, good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8") for w in words]
        cuts, good = self.speculate(raw)
        for k in np.flatnonzero(~good).tolist():
            cuts[k] = self.merged(raw[k])
        return cuts

    # --- texts ---------------------------------------------------------------------

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.high: dict[str, list[str]] = {}
        self._learn(self.special, [[i] for i in self.special.values()])

    def _learn(self, words: Iterable[str], ids: list[list[int]]) -> None:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
        self.lens, self.flat = np.concatenate((self.lens, lens)), np.concatenate((self.flat, new))
        for w in words:
            self.slot[w] = len(self.slot)

    def _plain_words(self, text: str) -> list[str]:
        if not _HIGH.search(text):
            return _WORD.findall(text.lower())
        out: list[str] = []
        for part in _BLANKS.split(text):  # no word, and no composition, reaches over white space
            if not _HIGH.search(part):
                out += _WORD.findall(part.lower())
                continue
            words = self.high.get(part)
            if words is None:
                clean = self.normalise(part)
                words = self.high[part] = [clean[i:j] for _, (i, j) in self.split(clean)]
            out += words
        return out

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._plain_words(text)
        return [w for k, part in enumerate(self.special_pattern.split(text)) for w in ([part] if k % 2 else self._plain_words(part))]

    def _text_pieces(self, text: str) -> Iterator[str]:
        """The text cut before white space, in pieces of about ``PIECE_CHARS``."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = _BLANKS.search(text, at + PIECE_CHARS)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Token ids of every text."""
        out, counts, held, held_of, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            if len(self.slot) > TABLE_WORDS or len(self.flat) > TABLE_TOKENS or len(self.high) > TABLE_WORDS:
                self.forget()
            new = list(set().union(*held).difference(self.slot))
            if new:
                self._learn(new, self.encode_words(new))
            lens = [len(w) for w in held]
            slots = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(held)), np.int64, sum(lens))
            n = self.lens[slots]
            out.append(self.flat[ragged(self.starts[slots], n)] if len(slots) else np.zeros(0, np.int32))
            counts[:] += np.bincount(np.repeat(held_of, lens), n, len(texts)).astype(np.int64)

        for k, text in enumerate(texts):
            for piece in self._text_pieces(text or ""):
                held.append(self.words(piece))
                held_of.append(k)
                size += len(piece)
                if size >= PIECE_CHARS:
                    flush()
                    held, held_of, size = [], [], 0
        if held:
            flush()
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens joined by single spaces, as the vocabulary names no decoder."""
        names = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))
        return pc.binary_join(names, " ")


@lru_cache(maxsize=4)
def codec_of(path: str) -> Codec:
    """One codec for each vocabulary and worker."""
    return Codec(path)


def _flat(ids: pa.Array) -> pa.ListArray:
    """The list array without a slice's leading and trailing values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))), pa.int32()),
                                    pc.list_flatten(ids).cast(pa.int32()))


def encoded(text: Column, path: str | None = None) -> Column:
    """Token ids (array of int) of a text column; none for null."""
    def run(texts: pa.Array) -> pa.Array:
        return codec_of(path or vocabulary_path()).encode(texts.to_pylist())

    return F.arrow_udf(run, "array<int>")(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of a column of token ids, special tokens included."""
    def run(lists: pa.Array) -> pa.Array:
        return codec_of(path or vocabulary_path()).decode(_flat(lists))

    return F.arrow_udf(run, "string")(ids)


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, into: str = "bpe") -> DataFrame:
    """``docs`` with a struct ``into`` of the text's ``ids`` and what they decode
    to, ``decoded``: both in one pass through the worker."""
    def run(texts: pa.Array) -> pa.Array:
        codec = codec_of(path or vocabulary_path())
        ids = codec.encode(texts.to_pylist())
        return pa.StructArray.from_arrays([ids, codec.decode(ids)], names=["ids", "decoded"])

    return docs.withColumn(into, F.arrow_udf(run, "struct<ids:array<int>,decoded:string>")(F.col(text)))


def op12_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Every document's token ids and decoded text, as digests."""
    trips = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.col("bpe.ids")
    return trips.select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"))
