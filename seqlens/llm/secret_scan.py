"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds are found by themselves: ``assign`` (a keyword assigned a value of
12 or more characters), ``access`` (access key identifiers) and ``hex`` (16 or
more hexadecimal digits). Weak kinds mean nothing alone: ``user`` (an account
name assignment), ``key40`` (a bare 40-character key) and ``endpoint`` (a URL).
A weak span is reported only when its complement lies within ``SCOPE``
characters in the same text:

- ``user`` needs a secret (assign, hex or key40),
- ``key40`` needs an identifier (access or user) or an endpoint,
- ``endpoint`` needs both an identifier and a secret.

The link is an interval join without pairs: parts are dealt into bins as wide
as the scope, each bin keeps only the least and greatest start per role, and a
weak part looks at its own bin and the two beside it.

Defined cases: null is an empty text without spans; repeated rows get the same
result each; a null doc_id is kept. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import let, scratch_table, table

SCOPE = 200
KINDS = ["assign", "access", "hex", "user", "key40", "endpoint"]
#: kind -> (pattern, least length of the first group; 0: no such test)
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0),
    "hex": (r"[0-9a-f]{16,}", 0),
    "user": (r"""(?i:user_?name|user|login|account_?id|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 3),
    "key40": (r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", 0),
    "endpoint": (r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+""", 0),
}
BASE, WEAK = KINDS[:3], KINDS[3:]
ROLE = {"assign": "secret", "hex": "secret", "key40": "secret", "access": "identifier", "user": "identifier",
        "endpoint": "endpoint"}
SPANS = "array<struct<start:int,kind:int,end:int>>"
_RUN = 256


def _starts(gaps: Column, matches: Column) -> Column:
    """Start of each match: the running length of all gaps and matches before
    it, summed by runs so that very many matches stay cheap."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    lens = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))

    def with_lens(lens_: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(lens_) / _RUN).cast("int")),
                           lambda b: total(F.slice(lens_, b * _RUN + 1, _RUN)))
        bases = lambda runs_: F.transform(runs_, lambda _, b: total(F.slice(runs_, F.lit(1), b)))
        return let(runs, lambda r: let(bases(r), lambda base: F.transform(
            gaps, lambda g, i: base[F.floor(i / _RUN).cast("int")]
            + total(F.slice(lens_, F.floor(i / _RUN).cast("int") * _RUN + 1, i % _RUN)) + F.length(g))))

    return let(lens, with_lens)


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of one kind as (start, kind, end). A
    match whose value is too short is dropped after it has been consumed."""
    pattern, least = PATTERNS[kind]
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)")
    parts = [F.regexp_extract_all(text, whole, F.lit(g)) for g in ((1, 2, 3) if least else (1, 2))]

    def build(p: Column) -> Column:
        value = p["value"] if least else p["match"]
        return let(_starts(p["gap"], p["match"]), lambda at: F.filter(
            F.transform(p["match"], lambda m, i: F.struct(
                at[i].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at[i] + F.length(m)).alias("end"),
                (F.length(value[i]) >= max(least, 1)).alias("ok"))),
            lambda s: s["ok"]))

    found = let(F.struct(*[p.alias(n) for p, n in zip(parts, ("gap", "match", "value"))]), build)
    found = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def row_key(id_col: str, text: str) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit(""))))


def parts(documents: DataFrame, text: str, key: Column) -> DataFrame:
    """One narrow row per document: key, base spans, weak spans. Weak kinds are
    looked for only where a complement can exist."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = documents.select("*", key.alias("__key"), F.concat(*[spans_of(t, k) for k in BASE]).alias("__base"))
    has = {r: F.arrays_overlap(F.transform("__base", lambda s: s["kind"]), F.array(*[F.lit(i) for i, k in enumerate(BASE) if ROLE[k] == r]))
           for r in ("secret", "identifier")}
    user, key40, url = (t.rlike(PATTERNS[k][0]) for k in WEAK)
    linked = ((has["secret"] | key40) & (has["identifier"] | user)) | (key40 & url)
    return out.withColumn("__weak", F.when(linked, F.concat(*[spans_of(t, k) for k in WEAK])).otherwise(F.array().cast(SPANS)))


def linked_spans(found: DataFrame) -> DataFrame:
    """(_key, _linked): the weak spans that have their complement in scope."""
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])]), F.col("s.kind"))
    some = found.where(F.size("__weak") > 0).select("__key", "__base", "__weak").dropDuplicates(["__key"])
    every = some.select("__key", F.explode(F.concat("__base", "__weak")).alias("s")) \
        .select("__key", "s", role.alias("role"), F.floor(F.col("s.start") / SCOPE).alias("bin"))
    bins = every.groupBy("__key", "bin", "role").agg(F.min("s.start").alias("least"), F.max("s.start").alias("most"))
    weak = every.where(F.col("s.kind") >= len(BASE)).withColumn("bin", F.explode(F.array([F.col("bin") + d for d in (-1, 0, 1)])))
    near = weak.join(bins.withColumnRenamed("role", "other"), ["__key", "bin"]).where(
        (F.abs(F.col("least") - F.col("s.start")) <= SCOPE) | (F.abs(F.col("most") - F.col("s.start")) <= SCOPE))
    seen = near.groupBy("__key", "s", "role").agg(*[F.max(F.when(F.col("other") == r, 1).otherwise(0)).alias(r)
                                                   for r in ("secret", "identifier", "endpoint")])
    ok = (F.when(F.col("role") == "identifier", F.col("secret") == 1)
          .when(F.col("role") == "secret", (F.col("identifier") == 1) | (F.col("endpoint") == 1))
          .otherwise((F.col("identifier") == 1) & (F.col("secret") == 1)))
    return seen.where(ok).groupBy("__key").agg(F.collect_set("s").alias("__linked"))


def secret_spans(documents: DataFrame, text: str = "text", id_col: str = "doc_id", into: str = "secrets") -> DataFrame:
    """``documents`` without the text, with ``into``: array of (start, kind
    number, end) by start and kind, base spans and linked weak spans."""
    found = scratch_table(parts(documents, text, row_key(id_col, text)).drop(text), "parts")
    return found.join(linked_spans(found), "__key", "left").select(
        *[c for c in documents.columns if c != text],
        F.array_sort(F.concat("__base", F.coalesce("__linked", F.array().cast(SPANS)))).alias(into))


def redacted(documents: DataFrame, text: str = "text", id_col: str = "doc_id", mark: str = "<secret>") -> DataFrame:
    """``documents`` with every reported span replaced by ``mark``; texts without
    spans are unchanged."""
    key = row_key(id_col, text)
    found = scratch_table(parts(documents.select(id_col, text), text, key).where((F.size("__base") > 0) | (F.size("__weak") > 0))
                          .select("__key", "__base", "__weak").dropDuplicates(["__key"]), "parts")
    cut = found.join(linked_spans(found), "__key", "left").select("__key", F.array_sort(
        F.concat("__base", F.coalesce("__linked", F.array().cast(SPANS)))).alias("__cut")).where(F.size("__cut") > 0)
    cut = scratch_table(cut, "cut")
    kind = "struct<at:int,text:string>"

    def rebuild(t: Column, spans: Column) -> Column:
        kept = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")).cast(kind), lambda acc, s: F.when(
            s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
                acc["text"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("text")))
            .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["text"].alias("text"))))
        return let(kept, lambda k: F.concat(k["text"], F.substring(t, k["at"] + 1, F.length(t))))

    out = documents.withColumn("__key", key).join(cut, "__key", "left")
    return out.withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(rebuild(F.col(text), F.col("__cut")))) \
        .select(*documents.columns)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    done = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    return done.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                       joined(F.col("secrets")).alias("spans"))
