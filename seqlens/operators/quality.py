"""Data-quality checks the reports depend on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.constants import VALID_SCORE_MAX, VALID_SCORE_MIN
from seqlens.functions.scalars import normalise_address


def key_uniqueness(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table: ``rows``, distinct ``keys`` and ``duplicate_keys`` (keys on
    more than one row). The token-id joins assume one row per key; a
    duplicate would silently inflate ordinals and counts."""
    parts = []
    for name, (df, keys) in tables.items():
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
        parts.append(per_key.agg(
            F.lit(name).alias("table_name"),
            F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("rows"),
            F.count(F.lit(1)).alias("keys"),
            F.count(F.when(F.col("_c") > 1, 1)).alias("duplicate_keys"),
        ))
    return reduce(DataFrame.unionByName, parts)


def duplicate_tokens(games: DataFrame) -> DataFrame:
    """``id, copies`` of the tokens that are several games because a token table
    has more than one row for them. Counted on the joins' own partitioning, with
    no other scan or exchange."""
    return games.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def score_class(score: str = "score", sc: str = "sc", lo: int = VALID_SCORE_MIN,
                hi: int = VALID_SCORE_MAX):
    canonical = F.col(score).rlike("^0x[0-9a-f]{16}$")
    return (F.when(F.col(score).isNull(), F.lit("null"))
             .when(~canonical, F.lit("malformed"))
             .when(F.col(sc) < lo, F.lit("too_small"))
             .when(F.col(sc) > hi, F.lit("too_large"))
             .otherwise(F.lit("valid")))


def score_quality(games: DataFrame, lo: int = VALID_SCORE_MIN, hi: int = VALID_SCORE_MAX) -> DataFrame:
    """Rows per score class over in-scope games: ``score_class, games``."""
    return games.groupBy(score_class(lo=lo, hi=hi).alias("score_class")) \
        .agg(F.count(F.lit(1)).alias("games"))


def address_class(address: str = "owner"):
    a = F.col(address)
    return (F.when(a.isNull(), F.lit("null"))
             .when(normalise_address(a).isNull(), F.lit("malformed"))
             .when(normalise_address(a) == a, F.lit("canonical"))
             .otherwise(F.lit("other_spelling")))


def address_quality(df: DataFrame, address: str = "owner") -> DataFrame:
    """Rows per address class: ``address_class, rows``. Malformed addresses are
    no players."""
    return df.groupBy(address_class(address).alias("address_class")).agg(F.count(F.lit(1)).alias("rows"))


def sequence_load(games: DataFrame, entity: str = "owner") -> DataFrame:
    """One row: entities, rows, the largest entity's rows and its share.

    The largest share shows how skewed the per-entity numbering is."""
    per = games.groupBy(entity).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.count(F.lit(1)).alias("players"),
                   F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("games"),
                   F.max("_c").alias("max_games"),
                   F.round(F.try_divide(F.max("_c"), F.sum("_c")), 6).alias("max_share"))
