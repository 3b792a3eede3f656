"""Per-entity event ordinal and total (``ROW_NUMBER`` / ``COUNT(*)`` over entity).

A window partition cannot be split, so a window over the whole entity would put
an entity with a third of all rows into one task. Entities with more rows than a
task should hold are therefore numbered by ranges of their own order:

1. a sample tells which entities are that large, and the sampled rows of such an
   entity give splitters over ``order + tiebreak``;
2. the rows are dealt once, by (entity, range); every other entity is one range;
3. that exchange feeds the row numbers inside each range and, for the split
   entities, the rows of each range; running sums of the latter (one row per
   range) give every range the rows before it and the entity's total.

The splitters run over the whole order key, so rows of one instant, or without a
time, are spread as well. The plan is the same for every entity and every size,
and nothing runs while it is built. Where only the first k ordinals are needed,
``first_k`` keeps the plain window, whose per-entity limit is applied before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one entity that a task takes: larger entities are split into ranges of
#: about half of it.
ROWS_PER_RANGE = 2_000_000
#: Ranges of an entity, at most, and ranges under one coarse splitter.
MAX_RANGES, FINE = 1024, 32
#: Every task gives its first rows to the sample, and later ones with falling
#: probability: about ``HEAD * (1 + ln(rows / HEAD))`` of them, whatever its size.
HEAD = 16
#: Sampled rows below which no entity is taken for large: bounds the table of
#: splitters by an eighth of the sample.
LEAST_SAMPLED = 8
_SEED = 11


def whole(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df``, with all its columns kept up to here. Several branches over it then
    need the same columns below, whatever each of them reads, so Spark runs the
    exchanges below once and reuses them. (A condition that is always true, and
    that the optimizer neither removes nor moves, as it is not deterministic.)"""
    return df.filter((F.monotonically_increasing_id() >= 0) | (F.xxhash64(*(columns or df.columns)) == 0))


def weighted_sample(df: DataFrame) -> DataFrame:
    """Rows of every task with ``_weight``, the number of rows each stands for."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.greatest(place / F.lit(float(HEAD)), F.lit(1.0)).alias("_weight")
    return df.select("*", weight).filter(F.rand(_SEED) * F.col("_weight") < 1)


def _splitters(rows: DataFrame, keys: list[str], at: Column, rows_per_range: int) -> DataFrame:
    """``keys, _cuts`` of the large entities: their splitters in groups of
    ``FINE``."""
    per = weighted_sample(rows).groupBy(*keys).agg(
        F.sum("_weight").alias("_rows"), F.count(F.lit(1)).alias("_sampled"),
        F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("_weight").alias("w")))).alias("_keys"))
    large = (F.col("_rows") > rows_per_range) & (F.col("_sampled") >= LEAST_SAMPLED)
    step = F.greatest(F.lit(rows_per_range / 2.0), F.col("_rows") / F.lit(float(MAX_RANGES)))
    # a splitter wherever the running weight passes a multiple of the step
    start = F.struct(F.lit(0.0).alias("s"), F.filter(F.transform("_keys", lambda k: k.at), lambda k: F.lit(False)).alias("cuts"))
    cuts = F.aggregate("_keys", start, lambda a, k: F.struct(
        (a.s + k.w).alias("s"),
        F.when(F.floor((a.s + k.w) / step) > F.floor(a.s / step), F.concat(a.cuts, F.array(k.at))).otherwise(a.cuts).alias("cuts")),
        lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a.cuts) - 1) / FINE).cast("int")),
                              lambda g: F.slice(a.cuts, g * FINE + 1, FINE)))
    return per.filter(large).select(*keys, cuts.alias("_cuts"))


def _range_of(at: Column) -> Column:
    """Number of the range that ``at`` falls into: splitters not above it, looked
    up among the groups' first ones and then in one group; 0 for an entity that is not split."""
    group = F.size(F.filter("_cuts", lambda g: F.get(g, F.lit(0)) <= at))
    inside = F.size(F.filter(F.get("_cuts", group - 1), lambda s: s <= at))
    return F.when(F.col("_cuts").isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * FINE + inside)


_KEYS, _RANGED = ["_e", "_e_null"], ["_e", "_e_null", "_range"]


def dealt_by_range(df: DataFrame, entity: str, order: list[str], tiebreak: list[str],
                   rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows, dealt by entity and range: with NULL-safe keys of the entity
    (``_e, _e_null``), the number of the row's ``_range``, and ``_split``, whether
    the entity has more than one."""
    names = df.columns
    rows = whole(df.select("*", F.coalesce(F.col(entity).cast("string"), F.lit("")).alias("_e"), F.col(entity).isNull().alias("_e_null")),
                 [*names, *_KEYS])
    at = F.struct(*order, *tiebreak)
    # at most one row per LEAST_SAMPLED sampled ones
    cuts = F.broadcast(_splitters(rows, _KEYS, at, rows_per_range))
    ranged = rows.join(cuts, _KEYS, "left").select(*names, *_KEYS, _range_of(at).alias("_range"), F.col("_cuts").isNotNull().alias("_split"))
    return whole(ranged.repartition(*_RANGED), [*names, *_RANGED, "_split"])


def sequence(df: DataFrame, entity: str, order: list[str], tiebreak: list[str],
             ordinal: str = "ordinal", total: str | None = "n",
             rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``ordinal`` (1-based position of the row in its entity's
    ``order, tiebreak`` sequence, NULLs first) and ``total`` (rows of the
    entity). ``order + tiebreak`` must be unique within an entity; a NULL entity
    is an entity of its own. ``df`` should hold only the columns needed: all of
    them are dealt.

    The result does not depend on ``rows_per_range``, which only sets how many
    rows of one entity a task takes."""
    dealt = dealt_by_range(df, entity, order, tiebreak, rows_per_range)
    # one row per range of a split entity: MAX_RANGES of one entity at most
    sizes = dealt.filter("_split").groupBy(*_RANGED).agg(F.count(F.lit(1)).alias("_rows"))
    along = Window.partitionBy(*_KEYS).orderBy("_range")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    carry = sizes.select(*_RANGED, F.coalesce(F.sum("_rows").over(along.rowsBetween(first, -1)), F.lit(0)).alias("_before"),
                         F.sum("_rows").over(along.rowsBetween(first, last)).alias("_total"))
    inside = Window.partitionBy(*_RANGED).orderBy(*order, *tiebreak)
    here = [F.count(F.lit(1)).over(inside.rowsBetween(first, last)).alias("_here")] if total else []
    ranked = dealt.select("*", F.row_number().over(inside).alias("_rank"), *here)
    place = (F.coalesce("_before", F.lit(0)) + F.col("_rank")).alias(ordinal)
    return ranked.join(F.broadcast(carry), _RANGED, "left").select(
        *df.columns, place, *([F.coalesce("_total", "_here").alias(total)] if total else []))


def first_k(df: DataFrame, entity: str, order: list[str], tiebreak: list[str], k: int,
            ordinal: str = "ordinal") -> DataFrame:
    """The first ``k`` rows of each entity, numbered. The row-number filter is a
    per-entity limit below the exchange (``WindowGroupLimit``), so an entity
    sends at most ``k`` rows per task."""
    w = Window.partitionBy(entity).orderBy(*order, *tiebreak)
    return df.withColumn(ordinal, F.row_number().over(w).cast("bigint")).filter(F.col(ordinal) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (NULLs least; end it
    with a unique column to break ties). For tables that keep history, such as
    past owners of a token, before they are joined.

    A partial aggregate (``max_by`` over the row), not a window: a key with many
    versions costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)
