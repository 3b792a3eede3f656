"""Language identification by hierarchical discrimination.

A first set of one-versus-one linear support vector machines tells language
families apart; within the predicted family, a second set tells its languages
apart. Features are hashed byte n-grams (1 to 3) of the whole text, with ASCII
letters lower-cased and other ASCII characters taken as spaces.

Training uses a bounded sample of labelled rows (``MAX_ROWS`` in all, the same
number of each language, taken by hash order). Features of the sample are made
by the executors; only these fixed-size vectors reach the driver, which fits the
machines. Prediction is one Arrow function: no shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; an
empty training table gives ``und`` everywhere; with one language learned, it is
predicted with score 1; a language without a known family is its own family.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqlens.llm.common import LOWER, least_of, pieces, raw_text, scratch_table, table

DIMENSIONS = 1 << 11
MAX_ROWS = 4000
PIECE_BYTES = 1 << 20
STEPS, RIDGE = 200, 1e-4

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "hellenic": "el",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indo_aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "malayic": "id jv ms su tl",
    "tai": "lo th",
    "vietic": "vi",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_CLEAN = LOWER.copy()
for _c in range(128):
    if not (97 <= _CLEAN[_c] <= 122):
        _CLEAN[_c] = 32
RESULT = "struct<lang_pred:string,score:double,family:string>"


def features(column, dims: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors: square roots of hashed n-gram counts of whole texts."""
    buf, off = raw_text(column)
    n = len(off) - 1
    out = np.zeros((n, dims), np.float32)
    for at, stop in pieces(buf, off, PIECE_BYTES):
        part = _CLEAN[buf[at:stop]].astype(np.uint32)
        first, last = np.searchsorted(off, at, "right") - 1, np.searchsorted(off, stop)
        row = np.repeat(np.arange(last - first), np.diff(np.clip(off[first:last + 1], at, stop)))
        h = np.zeros(len(part), np.uint32)
        blank = np.ones(len(part), bool)
        for size in (1, 2, 3):
            m = len(part) - size + 1
            if m <= 0:
                break
            h = (h[:m] + part[size - 1:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            blank = blank[:m] & (part[size - 1:] == 32)
            ok = ~blank & (row[:m] == row[size - 1:])
            at_row = row[:m][ok]
            np.add(out[first:last], np.bincount(at_row * dims + (h[ok] % np.uint32(dims)).astype(np.int64),
                                                minlength=(last - first) * dims).reshape(-1, dims), out=out[first:last], casting="unsafe")
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OneVersusOne:
    """Linear support vector machines (squared hinge, accelerated gradient
    descent) for every pair of classes."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.classes = sorted(set(y))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        y = np.array(y)
        fits = [self._fit(x[(y == self.classes[a]) | (y == self.classes[b])],
                          np.where(y[(y == self.classes[a]) | (y == self.classes[b])] == self.classes[a], 1.0, -1.0))
                for a, b in self.pairs]
        self.w = np.stack([w for w, _ in fits], 1).astype(np.float32) if fits else np.zeros((x.shape[1], 0), np.float32)
        self.b = np.array([b for _, b in fits], np.float32)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
        w = last = np.zeros(x.shape[1])
        for t in range(STEPS):
            ahead = w + t / (t + 3) * (w - last)
            slack = np.maximum(0, 1 - y * (x @ ahead))
            last, w = w, ahead - ((RIDGE * ahead) - 2 * (x.T @ (weight * slack * y))) / (4 + RIDGE)
        return w[:-1], float(w[-1])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and, per class, its mean soft vote."""
        n = len(self.classes)
        votes, soft = np.zeros((len(x), n)), np.zeros((len(x), n))
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones((len(x), 1))
        p = 1 / (1 + np.exp(-np.clip(4 * (x @ self.w + self.b), -30, 30)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += p[:, k] >= 0.5
            votes[:, b] += p[:, k] < 0.5
            soft[:, a] += p[:, k]
            soft[:, b] += 1 - p[:, k]
        soft /= n - 1
        return (votes + soft / 2).argmax(1), soft


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: list[str], family_of: dict[str, str] = FAMILY_OF):
        kinds = [family_of.get(c, c) for c in langs]
        self.families = OneVersusOne(x, kinds)
        self.within = {}
        for f in self.families.classes:
            rows = [i for i, k in enumerate(kinds) if k == f]
            self.within[f] = OneVersusOne(x[rows], [langs[i] for i in rows])

    def predict(self, x: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        which, soft = self.families.predict(x)
        langs, score = np.empty(len(x), object), soft[np.arange(len(x)), which]
        for f, model in enumerate(self.within[c] for c in self.families.classes):
            rows = np.flatnonzero(which == f)
            if len(rows):
                best, inner = model.predict(x[rows])
                langs[rows] = np.array(model.classes, object)[best]
                score[rows] *= inner[np.arange(len(rows)), best]
        return list(langs), [self.families.classes[i] for i in which], score


def training_rows(labelled: DataFrame, text: str, lang: str, max_rows: int, dims: int) -> tuple[np.ndarray, list[str]]:
    """Features and languages of the bounded sample."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    # different texts per language, by a sketch of fixed size; equal ones count once
    sizes = scratch_table(rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("distinct")), "languages")
    n = sizes.count()
    if not n:
        return np.zeros((0, dims), np.float32), []
    vector = F.arrow_udf(lambda t: pa.array([v.tobytes() for v in features(t, dims)], pa.binary()), "binary")
    sizes = F.broadcast(sizes) if n <= max_rows else sizes  # one row for each of the n languages
    each = max(1, max_rows // n)
    # only texts below the cut move, each once: some 2 * each + 100 of a language
    low = rows.join(sizes, "lang").where(least_of(F.col("order"), each, F.col("distinct"))) \
        .groupBy("lang", "order").agg(F.first("text").alias("text"))
    picked = low.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("order"))).where(F.col("rank") <= each)
    got = picked.orderBy("lang", "order").limit(max_rows).select("lang", vector("text").alias("v")).toArrow()
    x = np.frombuffer(b"".join(v.as_py() for v in got["v"]), np.float32).reshape(-1, dims)
    return x, got["lang"].to_pylist()


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, dims: int = DIMENSIONS) -> Hierarchy | None:
    x, langs = training_rows(labelled, text, lang, max_rows, dims)
    return Hierarchy(x, langs) if langs else None


def identify(documents: DataFrame, model: Hierarchy | None, text: str = "text", into: str = "language", dims: int = DIMENSIONS) -> DataFrame:
    """``documents`` with a struct ``into``: lang_pred, score (0 to 1), family."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array, letters: pa.Array) -> pa.Array:
        langs, kinds, score = [], [], np.zeros(0)
        if sent.value is None:
            langs, kinds, score = [None] * len(texts), [None] * len(texts), np.zeros(len(texts))
        for a in range(0, len(texts) if sent.value else 0, 500):
            got = sent.value.predict(features(texts.slice(a, 500), dims))
            langs, kinds, score = langs + got[0], kinds + got[1], np.append(score, got[2])
        known = [bool(k) and x is not None for k, x in zip(letters.to_pylist(), langs)]
        return pa.StructArray.from_arrays([pa.array([x if k else "und" for x, k in zip(langs, known)], pa.string()),
                                           pa.array(np.where(known, np.clip(score, 0, 1), 0.0), pa.float64()),
                                           pa.array([x if k else None for x, k in zip(kinds, known)], pa.string())],
                                          names=["lang_pred", "score", "family"])

    t = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumn(into, F.arrow_udf(run, RESULT)(t, t.rlike(r"\p{L}")))


def fold(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(fold(3) != 1).select("text", "lang"))
    done = identify(documents.select("doc_id", "text"), model)
    return done.select("doc_id", (fold(3) == 1).alias("held_out"), "language.lang_pred", "language.score")
