"""Quality rules: tokeniser fertility of a public vocabulary.

Every text is cut into words, and each distinct word of a batch is encoded once
by a SentencePiece vocabulary with byte fallback. Three measures come of it:

- characters per token (word characters over tokens),
- byte-fallback share (fallback tokens over tokens),
- token entropy (bits per token of the text's own token distribution).

A text is rejected when a base rule fails (fewer than 50 words, or more than
half of the words in repeated 3-word windows), when a measure leaves the wide
band of its dominant script (``BANDS``), or when it leaves the fences of its
group: language (where the table has one), script and length to a power of two.
Fences are the median of the group and a multiple of its robust spread
(``FENCES``), over all distinct texts that pass the base rules; a group takes both
partly from its language, script and all texts, the more the fewer texts it has
(``PARENT_WEIGHT``), so every text is judged alike at any size. Length is part of the
group, for the entropy of clean text grows with it.

Texts are measured once, and the measures written to the shared folder; no text
is shuffled. The statistics are aggregates over values of two or three decimals,
so their state is bounded; the fences, one row per group, are joined to the texts'
measures. Defined cases:
null and wordless texts have zero counts and fail; words are not lower-cased; a
text of one huge word is encoded whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import U64, hash_spans, mix64, pieces, ragged, raw_text, row_ids, scratch_table, table, word_spans

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PIECE_BYTES = 1 << 20
CACHE_WORDS = 200_000
#: Texts measured at a time, which bounds the arrays of their words.
SLICE_ROWS = 2000
#: Words longer than this are encoded, but not kept in the worker's cache.
CACHE_WORD_BYTES = 64
VOCABULARY = "piece_bpe_32k.model"

#: Dominant script -> (least and most characters per token, most byte-fallback
#: share, least token entropy in bits).
BANDS = {
    "latin": (1.15, 9.0, 0.30, 3.0),
    "greek": (0.60, 8.0, 0.60, 3.0),
    "cyrillic": (0.80, 8.0, 0.50, 3.0),
    "semitic": (0.50, 8.0, 0.70, 3.0),
    "east_asian": (0.25, 6.0, 0.97, 3.0),
    "other": (0.20, 9.0, 0.99, 3.0),
}
SCRIPTS = list(BANDS)

#: Measure -> (values per unit in the statistics, least spread, spreads allowed
#: below the median, spreads allowed above it). A high entropy or a low share
#: is no fault.
FENCES = {
    "chars_per_token": (100, 0.02, 5.0, 5.0),
    "fallback_share": (1000, 0.02, None, 5.0),
    "token_entropy": (100, 0.10, 4.0, None),
}
#: Texts that a group's parent (its language, script, then all) counts for.
PARENT_WEIGHT = 5
#: Up to this many groups the fences are broadcast, beyond it joined by group.
MAX_BROADCAST_GROUPS = 100_000
_PLACES = (0.1, 0.25, 0.5, 0.75, 0.9)

RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
          "n_repeat_words:bigint,n_tokens:bigint,n_fallback:bigint,token_entropy:double,script:string>")
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_fallback"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
# script by the first byte of a character: ASCII letters and Latin supplements
# C3-C9, Greek CD-CF, Cyrillic D0-D4, Hebrew to Thaana D6-DE, CJK E3-ED
_SCRIPT = np.full(256, -1, np.int8)
for _first, _last, _name in ((0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xC9, "latin"),
                             (0xCD, 0xCF, "greek"), (0xD0, 0xD4, "cyrillic"), (0xD6, 0xDE, "semitic"),
                             (0xE0, 0xE2, "other"), (0xE3, 0xED, "east_asian"), (0xEE, 0xF4, "other")):
    _SCRIPT[_first:_last + 1] = SCRIPTS.index(_name)


class Encoder:
    """Token ids of words, each distinct word encoded once while it is cached."""

    def __init__(self, model: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.fallback = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.cache: dict[int, list[int]] = {}

    def encode(self, hashes: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given distinct words, flat, and each word's number of ids.
        ``spell(k)`` gives the bytes of word ``k``."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        keys = hashes.tolist()
        found = [self.cache.get(h) for h in keys]
        new = [k for k, ids in enumerate(found) if ids is None]
        spelt = [spell(k) for k in new]
        for k, w, ids in zip(new, spelt, self.sp.encode([w.decode() for w in spelt], num_threads=1)):
            found[k] = ids
            if len(w) <= CACHE_WORD_BYTES:
                self.cache[keys[k]] = ids
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(lens.sum())), lens


def repeated_windows(words: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, words inside 3-word windows that occur twice or more in it."""
    if len(words) < 3:
        return np.zeros(n_rows, np.int64)
    h = mix64(words[:-2] * U64(3) + mix64(words[1:-1] * U64(5) + mix64(words[2:] + row[2:].astype(U64))))
    whole = row[:-2] == row[2:]
    order = np.argsort(h[whole], kind="stable")
    at = np.flatnonzero(whole)[order]
    same = h[at][1:] == h[at][:-1]
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[at[1:][same] + k] = True
        hit[at[:-1][same] + k] = True
    return np.bincount(row[hit], minlength=n_rows)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(column, encoder: Encoder) -> pa.Array:
    buf, off = raw_text(column)
    n = len(off) - 1
    out = {k: np.zeros(n, np.int64) for k in _COUNTS}
    scripts = np.zeros((n, len(SCRIPTS)), np.int64)
    entropy = np.zeros(n)
    words, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    token_keys: list[np.ndarray] = []

    def close(upto: int | None = None) -> None:
        """Entropy of the rows before ``upto``, whose tokens are all known."""
        if not token_keys:
            return
        keys = np.concatenate(token_keys)
        now = np.ones(len(keys), bool) if upto is None else keys >> 20 < upto
        kept = keys[~now]
        key, count = np.unique(keys[now], return_counts=True)
        entropy[:] += np.bincount(key >> 20, count * np.log2(count), minlength=n)
        token_keys[:] = [kept] if len(kept) else []

    for at, stop in pieces(buf, off, PIECE_BYTES):
        part = buf[at:stop]
        first, last = np.searchsorted(off, at, "right") - 1, np.searchsorted(off, stop)
        cuts = np.clip(off[first:last + 1], at, stop) - at
        for name, flags in (("word_chars", ~(SPACE_OR_CONTINUES[part])), ("n_symbols", _SYMBOL[part])):
            seen = np.concatenate(([0], np.cumsum(flags)))
            out[name][first:last] += np.diff(seen[cuts])
        kind = _SCRIPT[part]
        rows = np.repeat(np.arange(first, last), np.diff(cuts))
        known = kind >= 0
        scripts += np.bincount(rows[known] * len(SCRIPTS) + kind[known],
                               minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
        s, e = word_spans(buf, off, at, stop)
        h = hash_spans(buf, s, e)
        words.append(h)
        places.append(s)
        row = np.searchsorted(off, s, "right") - 1
        distinct, where, index = np.unique(h, return_index=True, return_inverse=True)
        ids, lens = encoder.encode(distinct, lambda k: buf[s[where[k]]:e[where[k]]].tobytes())
        run = lens[index]
        out["n_tokens"] += np.bincount(row, run, minlength=n).astype(np.int64)
        strange = np.concatenate(([0], np.cumsum(encoder.fallback[ids])))
        ends = np.cumsum(lens)
        out["n_fallback"] += np.bincount(row, (strange[ends] - strange[ends - lens])[index], minlength=n).astype(np.int64)
        tokens = ids[ragged((ends - lens)[index], run)]
        token_keys.append((np.repeat(row, run) << 20) + tokens)
        close(np.searchsorted(off, stop, "right") - 1)
    close()
    words, places = np.concatenate(words), np.concatenate(places)
    bounds = np.searchsorted(places, off)
    row = row_ids(bounds)
    out["n_words"] = np.diff(bounds)
    out["n_repeat_words"] = repeated_windows(words, row, n)
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    for r in np.flatnonzero(lines[off[1:]] > lines[off[:-1]]):
        out["n_dup_lines"][r] = duplicate_lines(buf[off[r]:off[r + 1]].tobytes())
    total = np.maximum(out["n_tokens"], 1)
    entropy = np.where(out["n_tokens"] > 0, np.log2(total) - entropy / total, 0.0)
    names = np.array(SCRIPTS, object)[np.where(scripts.sum(1) > 0, scripts.argmax(1), len(SCRIPTS) - 1)]
    return pa.StructArray.from_arrays(
        [pa.array(out[k].astype(np.int64)) for k in _COUNTS] + [pa.array(np.maximum(entropy, 0.0)), pa.array(list(names), pa.string())],
        names=_COUNTS + ["token_entropy", "script"])


SPACE_OR_CONTINUES = _CONTINUES.copy()
SPACE_OR_CONTINUES[[0x20, 9, 10, 11, 12, 13]] = True


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary, where the package that ships them is installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder_of(model: str) -> Encoder:
    """One encoder for each Python worker and model."""
    return Encoder(model)


def measures(model: str | None = None):
    """Arrow function text -> measures. ``model``: path of a SentencePiece model
    that every executor can open; by default the installed public vocabulary,
    looked up on the executor."""
    def run(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(model or vocabulary_path())
        return pa.concat_arrays([measure(texts.slice(a, SLICE_ROWS), encoder) for a in range(0, max(len(texts), 1), SLICE_ROWS)])

    return F.arrow_udf(run, RESULT)


def in_band(m: Column, bands: dict = BANDS) -> Column:
    """The method's verdict for a measures struct."""
    tokens = F.greatest(m["n_tokens"], F.lit(1))
    ok = F.lit(False)
    for script, (low, high, fallback, least) in bands.items():
        ok = F.when(m["script"] == script,
                    (m["word_chars"] >= low * tokens) & (m["word_chars"] <= high * tokens)
                    & (m["n_fallback"] <= fallback * tokens) & (m["token_entropy"] >= least)).otherwise(ok)
    return ok


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def measured(documents: DataFrame, text: str = "text", model: str | None = None, into: str = "quality") -> DataFrame:
    """``documents`` with a struct column ``into``: the measures,
    chars_per_token, fallback_share, base_failed, and the text's group and hash."""
    out = documents.withColumn(into, measures(model)(F.col(text)))
    m = F.col(into)
    tokens = F.greatest(m["n_tokens"], F.lit(1))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in documents.columns else F.lit("")
    length = F.length(F.bin(m["n_words"]))
    return out.withColumn(into, F.struct(
        f"{into}.*", (m["word_chars"] / tokens).alias("chars_per_token"),
        (m["n_fallback"] / tokens).alias("fallback_share"), base_failed(m).alias("base_failed"),
        F.struct(m["script"].alias("script"), lang.alias("lang"), length.alias("length")).alias("group"), F.xxhash64(text).alias("hash")))


def fences(done: DataFrame, into: str = "quality", weight: int = PARENT_WEIGHT) -> DataFrame:
    """(group, low, high): least and greatest value of every measure of ``FENCES``,
    from all distinct texts that pass the base rules.

    Centre and spread are estimated for all texts, per script, per language in it and
    per length in that; a level of n texts takes them as n / (n + ``weight``) of its own
    and the rest of the level above, so small groups are judged by their parents."""
    m = F.col(into)
    values = [F.round(m[name] * units).alias(name) for name, (units, *_) in FENCES.items()]
    texts = done.where(~m["base_failed"]).select(m["group"].alias("group"), m["hash"].alias("hash"), *values)
    distinct = texts.groupBy("group", "hash").agg(*(F.min(name).alias(name) for name in FENCES))
    keys = ["script", "lang", "length"]
    stats = distinct.select("group.*", *FENCES).rollup(*keys).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), *(F.percentile(name, list(_PLACES)).alias(name) for name in FENCES))
    for name, (units, least, _, _) in FENCES.items():
        p10, p25, centre, p75, p90 = (F.col(name)[k] / units for k in range(len(_PLACES)))
        spread = F.greatest(F.lit(least), (p75 - p25) / 1.349, (p90 - p10) / 2.563)
        stats = stats.withColumn(name, F.struct(centre.alias("centre"), spread.alias("spread")))
    stats = scratch_table(stats.withColumn("top", F.lit(0)), "statistics")
    found = stats.where("level = 7").select("top", *FENCES)
    own = F.col("n") / (F.col("n") + weight)
    for k, level in enumerate((3, 1, 0)):
        above = found.select("top", *keys[:k], *(F.col(name).alias(f"above_{name}") for name in FENCES))
        found = stats.where(F.col("level") == level).join(above, ["top", *keys[:k]]).select("top", *keys[:k + 1], *(
            F.struct(*((F.col(name)[x] * own + F.col(f"above_{name}")[x] * (1 - own)).alias(x) for x in ("centre", "spread"))).alias(name)
            for name in FENCES))
    low, high = (F.array(*(F.col(name)["centre"] + sign * part * F.col(name)["spread"] if part else F.lit(sign * np.inf)
                           for name, part in ((name, f[place]) for name, f in FENCES.items()))) for sign, place in ((-1, 2), (1, 3)))
    return found.select(F.struct(*keys).alias("group"), low.alias("low"), high.alias("high"))


def in_fences(m: Column, low: Column, high: Column) -> Column:
    """True where no measure leaves its group's fences."""
    inside = F.lit(True)
    for n, name in enumerate(FENCES):
        inside = inside & (m[name] >= low[n]) & (m[name] <= high[n])
    return F.coalesce(inside, F.lit(True))


def judged(done: DataFrame, into: str = "quality", bands: dict = BANDS) -> DataFrame:
    """Measured documents with the verdict ``kept``; ``done`` is read twice."""
    m = F.col(into)
    found = scratch_table(fences(done, into), "fences")
    # one row per language, script and length: broadcast only after the count
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST_GROUPS else found
    found = found.select(F.col("group").alias("__group"), F.struct("low", "high").alias("__fences"))
    kept = ~m["base_failed"] & in_band(m, bands) & in_fences(m, F.col("__fences.low"), F.col("__fences.high"))
    return done.join(found, m["group"] == F.col("__group"), "left").select(
        *(m.withField("kept", kept).dropFields("group", "hash").alias(into) if c == into else F.col(f"`{c}`") for c in done.columns))


def quality(documents: DataFrame, text: str = "text", model: str | None = None, bands: dict = BANDS,
            into: str = "quality") -> DataFrame:
    """``documents`` with a struct column ``into``: the measures,
    chars_per_token, fallback_share, base_failed and kept."""
    return judged(scratch_table(measured(documents, text, model, into), "measured"), into, bands)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    narrow = [c for c in ("doc_id", "lang") if c in documents.columns]
    done = judged(scratch_table(measured(documents.select(*narrow, "text")).select("doc_id", "quality"), "measured"))
    return done.select("doc_id", "quality.*").drop("n_tokens", "n_fallback")
