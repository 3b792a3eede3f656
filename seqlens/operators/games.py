"""The game fact: scope filter, token-id joins, decode, per-player numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions.constants import (OFFICIAL_MINTER, OFFICIAL_SETTINGS_ID,
                                         VALID_SCORE_MAX, VALID_SCORE_MIN)
from seqlens.functions.scalars import decode_hex_score, normalise_address
from seqlens.operators.sequence import first_k, sequence


def scoped_metadata(metadata: DataFrame, settings_id: int = OFFICIAL_SETTINGS_ID,
                    minter: str | None = OFFICIAL_MINTER, registry: DataFrame | None = None,
                    minter_address: str | None = None) -> DataFrame:
    """Token ids in scope. The minter is given either as its registry index
    (``minter``) or as an address resolved through ``registry``
    (``index, address``); both predicates reach the metadata scan."""
    m = metadata.filter(F.col("settings_id") == settings_id)
    if registry is not None and minter_address is not None:
        idx = registry.filter(normalise_address("address") == normalise_address(F.lit(minter_address))) \
            .select(F.col("index").alias("_minter_index"))
        m = m.join(idx, F.col("minted_by") == F.col("_minter_index"), "left_semi")
    else:
        m = m.filter(F.col("minted_by") == minter)
    return m.select("id")


def official_games(metadata: DataFrame, scores: DataFrame, owners: DataFrame,
                   settings_id: int = OFFICIAL_SETTINGS_ID, minter: str | None = OFFICIAL_MINTER,
                   registry: DataFrame | None = None, minter_address: str | None = None,
                   decode_mode: str = "reference", keep_text: bool = False,
                   duplicates: str = "keep") -> DataFrame:
    """``owner, id, executed_at, sc`` for every in-scope game; with
    ``keep_text`` also the score as written (``score``).

    Both joins are on the token id: all three inputs are hash-partitioned on
    it once, and the second join reuses the first join's partitioning. Tables
    bucketed on the id join without any exchange. Scores are decoded before the
    joins, so the text is not shuffled.

    A token with more than one row in a table would be several games and inflate
    ordinals and counts. With ``duplicates="refuse"`` the query fails when it meets
    such a token: the joined rows are counted per id on the partitioning that the
    joins left, without another scan or exchange.
    """
    m = scoped_metadata(metadata, settings_id, minter, registry, minter_address)
    text = ["score"] if keep_text else []
    s = scores.select("id", "executed_at", *text, decode_hex_score("score", mode=decode_mode).alias("sc"))
    o = owners.select(F.col("token_id").alias("id"), "owner")
    g = m.join(s, "id").join(o, "id").select("owner", "id", "executed_at", *text, "sc")
    if duplicates == "keep":
        return g
    if duplicates != "refuse":
        raise ValueError(f"duplicates: 'keep' or 'refuse', not {duplicates!r}")
    twice = F.raise_error(F.concat(F.lit("more than one row of a token table for token "), F.col("id")))
    counted = g.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("id")))
    return counted.filter(F.when(F.col("_copies") > 1, twice.cast("boolean")).otherwise(F.lit(True))).drop("_copies")


def game_sequence(games: DataFrame, ordinal: str = "game_no", total: str | None = "n") -> DataFrame:
    """Number each owner's games by time (token id breaks ties) over all
    in-scope games — invalid scores included — and add the owner's total."""
    return sequence(games, "owner", ["executed_at"], ["id"], ordinal=ordinal, total=total)


def first_games(games: DataFrame, k: int, ordinal: str = "game_no") -> DataFrame:
    """Each owner's first ``k`` games, numbered (no owner total)."""
    return first_k(games, "owner", ["executed_at"], ["id"], k, ordinal=ordinal)


def is_valid(sc: Column | str = "sc", lo: int = VALID_SCORE_MIN, hi: int = VALID_SCORE_MAX) -> Column:
    c = F.col(sc) if isinstance(sc, str) else sc
    return c.between(lo, hi)


def valid(df: DataFrame, sc: str = "sc", lo: int = VALID_SCORE_MIN,
          hi: int = VALID_SCORE_MAX) -> DataFrame:
    """Keep rows with a score in ``[lo, hi]``; apply after numbering."""
    return df.filter(is_valid(sc, lo, hi))


def scoped_games(tables, before_numbering=None, **scope) -> DataFrame:
    """official_games of the three tables, without the score text.

    ``before_numbering``: optional ``DataFrame -> DataFrame`` applied to the
    game rows before they are numbered (e.g. removing whole owners)."""
    g = official_games(tables.metadata, tables.scores, tables.owners, **scope)
    return g if before_numbering is None else before_numbering(g)


def sequenced_games(tables, total: str | None = "n", before_numbering=None, **scope) -> DataFrame:
    """scoped_games + game_sequence."""
    return game_sequence(scoped_games(tables, before_numbering, **scope), total=total)


__all__ = ["scoped_metadata", "official_games", "game_sequence", "first_games", "is_valid", "valid",
           "scoped_games", "sequenced_games"]
