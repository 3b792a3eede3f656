"""Quality classifier by positive-unlabelled learning.

A small network is fitted by the non-negative risk estimator

    R = p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

with trusted positives (label 1), unlabelled texts (any text, its label unseen)
and the class prior p, estimated from the labels of the learning fold. Features
are shares and ratios of whole texts: symbols, case, digits, repetition, word
and line lengths.

Training uses bounded samples by hash order (``MAX_POSITIVE``,
``MAX_UNLABELLED`` rows); executors make the features, and the driver fits the
network on these fixed-size vectors. Scoring is one Arrow function: no shuffle.

Defined cases: null and empty texts have all-zero features and a score; with no
positive label every score is the prior; repeated labels of a document are
averaged (positive from one half up); a null doc_id has no label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import SPACE, U64, least_of, mix64, pieces, raw_text, row_ids, table, words_of
from seqlens.llm.quality_rules import repeated_windows

MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000
HIDDEN, STEPS, RATE, DECAY = 16, 600, 0.02, 1e-4
CUT = 0.3

_KINDS = {
    "symbol": [ord(c) for c in "#*$%&|<>@^~_=+\\{}[]`"],
    "stop": [ord(c) for c in ".,;:?"],
    "shout": [ord("!")],
    "digit": range(48, 58),
    "upper": range(65, 91),
    "lower": range(97, 123),
    "wide": range(128, 256),
}
_FLAGS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}
NAMES = [*_KINDS, "log_words", "word_length", "short_words", "distinct_words", "echoed_words", "repeated_windows", "repeated_lines", "words_per_line"]


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per row, the number of distinct keys."""
    _, first = np.unique(mix64(keys + row.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(row[first], minlength=n)


def features(column) -> np.ndarray:
    buf, off = raw_text(column)
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)), np.float32)
    size = np.maximum(np.diff(off), 1)
    letters = np.zeros(n)
    for at, stop in pieces(buf, off, 1 << 20):
        part = buf[at:stop]
        first, last = np.searchsorted(off, at, "right") - 1, np.searchsorted(off, stop)
        cuts = np.clip(off[first:last + 1], at, stop) - at
        for k, name in enumerate(_KINDS):
            out[first:last, k] += np.diff(np.concatenate(([0], np.cumsum(_FLAGS[name][part])))[cuts])
        letters[first:last] += np.diff(np.concatenate(([0], np.cumsum(~SPACE[part])))[cuts])
    words, starts, lens, bounds = words_of(buf, off)
    row = row_ids(bounds)
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    short = np.bincount(row[lens <= 3], minlength=n)
    same = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    lines, line_row = line_hashes(words, row, np.searchsorted(np.flatnonzero(buf == 10), starts))
    n_lines = np.bincount(line_row, minlength=n)
    out[:, :len(_KINDS)] /= size[:, None]
    k = len(_KINDS)
    for j, v in enumerate((np.log1p(count), letters / some, short / some, _distinct(words, row, n) / some,
                           np.bincount(row[1:][same], minlength=n) / some, repeated_windows(words, row, n) / some,
                           1 - _distinct(lines, line_row, n) / np.maximum(n_lines, 1), np.log1p(count / np.maximum(n_lines, 1)))):
        out[:, k + j] = v
    out[np.diff(off) == 0] = 0
    return out


def line_hashes(words: np.ndarray, row: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every line that has a word, by its words in order."""
    if not len(words):
        return words, row
    first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (row[1:] != row[:-1]))))
    place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
    return np.add.reduceat(mix64(words + place.astype(U64) * U64(0x632BE59BD9B4E019)), first), row[first]


class Network:
    """One hidden layer on standardised features."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11):
        self.prior = float(np.clip(prior, 0.05, 0.95))
        self.mean, self.scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.3, (unlabelled.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self._fit(self._scaled(positive), self._scaled(unlabelled))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def _backward(self, x: np.ndarray, h: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(dg, self.p[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]

    def _fit(self, pos: np.ndarray, unl: np.ndarray) -> None:
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        soft = lambda g: np.logaddexp(0, g)
        for t in range(1, STEPS + 1):
            hp, gp = self._forward(pos)
            hu, gu = self._forward(unl)
            negative = soft(gu).mean() - self.prior * soft(gp).mean()
            if negative >= 0:
                dp = self.prior * (sig(gp) - 1) / len(gp) - self.prior * sig(gp) / len(gp)
                du = sig(gu) / len(gu)
            else:  # the estimate overfits: step back along the negative part alone
                dp, du = self.prior * sig(gp) / len(gp), -sig(gu) / len(gu)
            grads = [a + b + DECAY * p for a, b, p in zip(self._backward(pos, hp, dp), self._backward(unl, hu, du), self.p)]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self._scaled(x))[1], -30, 30)))


def sample(rows: DataFrame, text: str, limit: int) -> np.ndarray:
    """Features of at most ``limit`` different texts, the first by a hash of the
    text. Their number, by a sketch of fixed size, gives a cut; only the texts
    below it move, each once."""
    vector = F.arrow_udf(lambda t: pa.array([v.tobytes() for v in features(t)], pa.binary()), "binary")
    rows = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64(F.lit(3), F.col("text")))
    distinct = rows.agg(F.approx_count_distinct("h")).first()[0]
    picked = rows.where(least_of(F.col("h"), limit, distinct)).groupBy("h").agg(F.first("text").alias("text")).orderBy("h").limit(limit)
    got = picked.select(vector("text").alias("v")).toArrow()
    return np.frombuffer(b"".join(v.as_py() for v in got["v"]), np.float32).reshape(-1, len(NAMES)).astype(np.float64)


def train(documents: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Network | float:
    """Learn from ``documents`` and the ``labels`` given; the prior alone if
    there is nothing to fit."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        (F.avg(label) >= 0.5).alias("__positive"))
    n, good = known.agg(F.count("*"), F.sum(F.col("__positive").cast("int"))).first()
    prior = (good or 0) / n if n else 0.5
    # the hashes of the trusted texts are joined to the labels, not the texts
    narrow = documents.select(F.col(id_col).alias("__id"), F.xxhash64(F.lit(3), F.coalesce(F.col(text), F.lit(""))).alias("__h"))
    hashes = narrow.join(known.where("__positive"), "__id").select("__h").distinct().orderBy("__h").limit(max_positive)
    chosen = [r[0] for r in hashes.collect()]
    trusted = documents.where(F.xxhash64(F.lit(3), F.coalesce(F.col(text), F.lit(""))).isin(chosen)) if chosen else documents.limit(0)
    pos, unl = sample(trusted, text, max_positive), sample(documents, text, max_unlabelled)
    return Network(pos, unl, prior) if len(pos) and len(unl) else prior


def scored(documents: DataFrame, model: Network | float, text: str = "text", into: str = "score") -> DataFrame:
    """``documents`` with a score from 0 to 1."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        if isinstance(sent.value, float):
            return pa.array(np.full(len(texts), sent.value))
        return pa.array(np.concatenate([np.zeros(0)] + [sent.value.score(features(texts.slice(a, 1000)).astype(np.float64))
                                                        for a in range(0, len(texts), 1000)]))

    return documents.withColumn(into, F.arrow_udf(run, "double")(F.col(text)))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(documents.where(fold != 0), labels.select("doc_id", "quality").where(fold != 0))
    done = scored(documents, model)
    return done.select("doc_id", (fold == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
