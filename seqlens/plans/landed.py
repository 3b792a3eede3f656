"""The reports over landed tables (the user's own data, not the test tables).

    tables = read_landed(spark, metadata=".../meta", scores=".../scores", owners=".../owners")
    out = report_set(tables, members=read_members(spark, ".../members.json"))
    out["skill_persistence"].show()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqlens.functions import constants as K
from seqlens.operators.cohorts import drop_members, mint_players, mint_summary
from seqlens.operators.games import first_games, game_sequence, official_games
from seqlens.operators.quality import (address_quality, duplicate_tokens, key_uniqueness,
                                       score_quality, sequence_load)
from seqlens.operators.reuse import entity_table
from seqlens.plans import reports
from seqlens.sources.fixture import TokenTables
from seqlens.sources.readers import (read_token_metadata, read_token_owners,
                                     read_token_scores)


def read_landed(spark: SparkSession, metadata: str, scores: str, owners: str,
                fmt: str = "parquet") -> TokenTables:
    return TokenTables(read_token_metadata(spark, metadata, fmt),
                       read_token_scores(spark, scores, fmt),
                       read_token_owners(spark, owners, fmt))


def report_set(tables: TokenTables, members: DataFrame | None = None,
               mint_events: DataFrame | None = None, share: bool = True, decode_mode: str = "reference",
               mints: dict | None = None, duplicates: str = "refuse", **scope) -> dict[str, DataFrame]:
    """Every report. ``members`` (``addr``) feeds the cohort reports; without
    it, and with ``mint_events``, the member list is derived from the event log
    (players who also received a mint).

    The numbered game fact feeds about ten reports: with ``share`` it is written
    once to the session's shared folder (one job, now), in buckets by owner, so that the
    reports by player read it without another exchange of games; otherwise every report
    computes it. ``scope``: arguments of ``games.scoped_metadata``; ``mints``: of
    ``cohorts.mint_receivers``. ``duplicates``: a token with several rows in a
    table makes the reports fail (``"refuse"``) or counts as several games
    (``"keep"``); ``duplicate_tokens`` of the result names such tokens."""
    mints = mints or {}
    three = (tables.metadata, tables.scores, tables.owners)
    games = official_games(*three, decode_mode=decode_mode, keep_text=True, **scope)
    fact = official_games(*three, decode_mode=decode_mode, duplicates=duplicates, **scope)
    seq = game_sequence(fact)
    by_owner = seq
    if share:
        by_owner = entity_table(seq, "owner", "game_no", "n", "numbered-games")
        seq = by_owner.rows
    firsts = seq if share else first_games(fact, K.COHORT_FIRST_K)
    if members is None and mint_events is not None:
        members = reports.derived_members(tables, mint_events, mints, **scope)
    out = {
        "experience_tiers": reports.experience_tiers(seq),
        "learning_curve": reports.learning_curve(seq),
        "within_player_improvement": reports.within_player_improvement(by_owner),
        "skill_persistence": reports.skill_persistence(by_owner),
        "persistence_correlation": reports.persistence_correlation(by_owner),
        "population_summary": reports.population_summary(seq if share else fact),
        "score_distribution": reports.score_distribution(seq if share else fact),
        "retention_split": reports.retention_split(seq),
        "early_vs_later_improvement": reports.early_vs_later_improvement(by_owner),
        "lifetime_total_tiers": reports.lifetime_total_tiers(seq),
    }
    # checks that tell whether the reports can be trusted and how skewed they are
    out["key_uniqueness"] = key_uniqueness({
        "token_metadata": (tables.metadata, ["id"]),
        "token_scores": (tables.scores, ["id"]),
        "token_owners": (tables.owners, ["token_id"]),
    })
    out["duplicate_tokens"] = duplicate_tokens(games)
    out["score_quality"] = score_quality(games)
    out["address_quality"] = address_quality(tables.owners)
    out["sequence_load"] = sequence_load(games)
    if members is not None:
        out["cohort_first_games"] = reports.cohort_first_games(firsts, members)
        # membership is by owner, so non-members keep their ordinals
        out["cohort_learning_curve"] = reports.learning_curve(drop_members(seq, "owner", members))
    if mint_events is not None:
        out["mint_event_players"] = mint_summary(mint_players(mint_events, **mints))
        out["veteran_overlap"] = reports.derived_members(tables, mint_events, mints, **scope).orderBy("addr")
    return out
