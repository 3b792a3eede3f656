"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised.
Exponent 1 keeps the natural shares, 0 makes them equal. The exponent is
bisected (``WAYS`` probes for each pass over the small table of sources):

- entropy target: the largest exponent whose weights have at least the target
  share of the greatest possible entropy;
- repetition limit: the exponent is raised, if need be, until no source is
  repeated more than ``max_repeats`` times within the budget.

The weights are realised in blocks. Every source's documents are dealt by hash
into blocks of about ``total / BLOCKS`` tokens; each epoch is a permutation of
the source's blocks, and blocks are taken until the source's share of the token
budget is used (within one block). The stream interleaves the sources' blocks by
the fraction of their share that came before.

The schedule has at most ``BLOCKS`` + (number of sources) blocks for an epoch,
whatever the input. Documents meet it by (source, block), so a hot source is
spread over its many blocks.

Defined cases: null is a source of its own; texts without tokens follow their
block; sources without tokens get no weight; an empty table gives no rows;
repeated rows are dealt to one block and each drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqlens.llm.common import scratch_table, table

BLOCKS = 1 << 14
WAYS, PASSES = 16, 5
COLUMNS = ["mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_position"]
ENTROPY, MAX_REPEATS = 0.97, 4.0


def token_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_totals(documents: DataFrame, text: str, source: str) -> DataFrame:
    """(source, tokens), one row per source, pre-aggregated before the shuffle."""
    return documents.select(F.col(source).alias("source"), token_count(text).alias("tokens")) \
        .groupBy("source").agg(F.sum("tokens").alias("tokens"))


def exponent(totals: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS,
             budget: int | None = None) -> tuple[float, float]:
    """The exponent in [0, 1], and the sum of the powers that normalises the
    weights. Only sums over sources reach the driver."""
    totals = totals.where("tokens > 0")
    all_, sources, least = totals.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    if not sources:
        return 1.0, 1.0
    budget = all_ if budget is None else budget

    def probe(points: list[float]) -> list[tuple[float, float]]:
        """(entropy, repeats of the most repeated source) of each exponent."""
        row = totals.agg(*_powers(all_, points), *[F.sum(_power(all_, a) * F.log(_share(all_))) for a in points]).first()
        z, s = row[:len(points)], row[len(points):]
        # weight / share falls with the share for exponents up to 1: the least source repeats most
        return [(math.log(z_) - a * s_ / z_, budget / all_ * (least / all_) ** (a - 1) / z_)
                for a, z_, s_ in zip(points, z, s)]

    def bisect(ok) -> tuple[float, float]:
        """Bracket (low, high) of the exponent up to which ``ok`` holds."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * k / WAYS for k in range(WAYS + 1)]
            good = sum(ok(*v) for v in probe(points[1:-1]))
            low, high = points[good], points[good + 1]
        return low, high

    # Comparisons are rounded, so that the order of float sums cannot turn them.
    rich = lambda h, _: round(h, 9) >= round((entropy or 0) * math.log(sources), 9)
    worn = lambda _, r: round(r, 9) > (max_repeats or math.inf)
    out = 1.0
    if sources > 1 and not rich(*probe([1.0])[0]):
        out = bisect(rich)[0]
    if worn(*probe([out])[0]):
        out = bisect(worn)[1]
    return out, totals.agg(*_powers(all_, [out])).first()[0]


def _share(all_: int) -> Column:
    return F.col("tokens") / F.lit(float(all_))


def _power(all_: int, a: float) -> Column:
    return F.pow(_share(all_), F.lit(a))


def _powers(all_: int, points: list[float]) -> list[Column]:
    return [F.sum(_power(all_, a)) for a in points]


def mix(documents: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
        entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: int | None = None,
        seed: int = 7) -> DataFrame:
    """``documents`` as drawn: each row once for every time its block is drawn,
    with mix_tokens (its tokens), mix_weight (its source's weight), mix_epoch,
    mix_block and mix_position (the block's place in the stream, in [0, 1)).
    ``budget``: tokens to draw; by default as many as the corpus has. Without a
    repetition limit the schedule grows with the repeats of the least source."""
    totals = scratch_table(source_totals(documents, text, source), "sources")
    all_, sources = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    budget = all_ if budget is None else budget
    power, z = exponent(totals, entropy, max_repeats, budget)
    block_tokens = max(1, -(-all_ // BLOCKS))
    plan = totals.where("tokens > 0").select(
        "source", "tokens", F.ceil(F.col("tokens") / block_tokens).alias("blocks"),
        F.round(_power(max(all_, 1), power) / z, 12).alias("mix_weight"))
    plan = checked(scratch_table(plan, "plan"), sources)
    dealt = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.col(text)))

    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])

    def dealt_out(keep: Column) -> DataFrame:
        rows = documents.select(keep.alias("__row"), F.col(source).alias("__source"), token_count(text).alias("mix_tokens"),
                                dealt.alias("__hash"))
        return rows.join(plan, F.col("__source").eqNullSafe(F.col("source"))).select(
            "__row", "__source", "mix_tokens", "mix_weight", F.pmod("__hash", "blocks").alias("mix_block"))

    blocks = dealt_out(F.lit(0)).groupBy("__source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens"))
    drawn = checked(scratch_table(schedule(blocks, plan, budget, seed), "schedule"), sources + BLOCKS)
    out = dealt_out(row).join(drawn, F.col("__source").eqNullSafe(F.col("source")) & (F.col("mix_block") == F.col("block")))
    return out.select(*[F.col("__row")[c].alias(c) for c in documents.columns if c not in COLUMNS], *COLUMNS)


def schedule(blocks: DataFrame, plan: DataFrame, budget: int, seed: int) -> DataFrame:
    """(source, block, mix_epoch, mix_position) of every drawn block: whole
    epochs, then a part of one more permutation up to the source's budget."""
    rows = blocks.join(plan, F.col("__source").eqNullSafe(F.col("source"))).withColumn("quota", F.col("mix_weight") * budget)
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.floor(F.col("quota") / F.col("tokens")).cast("int"))))
    shuffled = W.partitionBy("source", "mix_epoch").orderBy(F.xxhash64(F.lit(seed), "source", "mix_epoch", "mix_block"), "mix_block")
    before = F.sum("block_tokens").over(shuffled.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0)) + F.col("mix_epoch") * F.col("tokens"))
    return rows.where(F.col("before") + F.col("block_tokens") / 2 <= F.col("quota")).select(
        "source", F.col("mix_block").alias("block"), "mix_epoch", (F.col("before") / F.col("quota")).alias("mix_position"))


def checked(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast a side whose number of rows (for one epoch) has been counted
    and is small; beyond the limit Spark picks the join by its own statistics."""
    return F.broadcast(df) if rows <= limit else df


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    done = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.drop("text")
