"""Registered queries over the generated test tables.

Every entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame computed
from the whole of the tables in ``sf_dir`` (through ``sources.fixture``).
Column names equal those of the matching oracle query in
``seqlens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.functions import constants as K
from seqlens.functions.scalars import decode_hex_score, normalise_address
from seqlens.operators.cohorts import (mint_players, mint_summary, overlap_counts, scope_players,
                                       tag_members)
from seqlens.operators.games import (first_games, official_games, scoped_games, scoped_metadata,
                                     sequenced_games, valid)
from seqlens.operators.median import grouped_median
from seqlens.operators.quality import (address_quality, duplicate_tokens, key_uniqueness,
                                       score_quality, sequence_load)
from seqlens.operators.ranking import quantile_tiers
from seqlens.operators.sequence import latest_per_key
from seqlens.plans import landing, reports
from seqlens.sources import fixture

Query = Callable[[SparkSession, str], DataFrame]


def _seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced_games(fixture.token_tables(spark, sf_dir))


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_games(_games(spark, sf_dir), K.COHORT_FIRST_K)


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped_games(fixture.token_tables(spark, sf_dir))


# --- composite reports ----------------------------------------------------------

def experience_tiers(spark, d):
    return reports.experience_tiers(_seq(spark, d))


def learning_curve(spark, d):
    return reports.learning_curve(_seq(spark, d))


def within_player_improvement(spark, d):
    return reports.within_player_improvement(_seq(spark, d))


def cohort_first_games(spark, d):
    return reports.cohort_first_games(_firsts(spark, d), fixture.members(spark, d))


def cohort_learning_curve(spark, d):
    return reports.cohort_learning_curve(fixture.token_tables(spark, d), fixture.members(spark, d))


def skill_persistence(spark, d):
    return reports.skill_persistence(_seq(spark, d))


def distinct_players(spark, d):
    t = fixture.token_tables(spark, d)
    return scope_players(scoped_metadata(t.metadata), t.owners).select("owner")


def mint_event_players(spark, d):
    return mint_summary(mint_players(fixture.mint_events(spark, d)))


def veteran_overlap(spark, d):
    t = fixture.token_tables(spark, d)
    return reports.derived_members(t, fixture.mint_events(spark, d)).orderBy("addr")


def cohort_first_games_derived(spark, d):
    """The cohort report with members taken from the event-log overlap."""
    t = fixture.token_tables(spark, d)
    members = reports.derived_members(t, fixture.mint_events(spark, d))
    return reports.cohort_first_games(_firsts(spark, d), members)


def veteran_overlap_counts(spark, d):
    t = fixture.token_tables(spark, d)
    players = scope_players(scoped_metadata(t.metadata), t.owners)
    og = mint_players(fixture.mint_events(spark, d))
    return overlap_counts(players, og)


# --- atomic operators ------------------------------------------------------------

def decode_hex_score_q(spark, d):
    s = fixture.token_tables(spark, d).scores
    return s.select("id", "score", decode_hex_score("score").alias("sc"))


def official_games_q(spark, d):
    return _games(spark, d).select("id", "owner", "sc")


def registry_scope(spark, d):
    """The game fact with the minter given by address, resolved through the registry."""
    t = fixture.token_tables(spark, d)
    g = official_games(t.metadata, t.scores, t.owners, registry=fixture.registry(spark, d),
                       minter_address=fixture.REGISTRY_MINTER_ADDRESS)
    return g.select("id", "owner", "sc")


def game_sequence_q(spark, d):
    return _seq(spark, d).select("owner", "id", "game_no", "n")


def valid_scores(spark, d):
    return valid(_seq(spark, d)).select("owner", "id", "game_no", "sc")


def grouped_median_q(spark, d):
    v = valid(_games(spark, d)).withColumnRenamed("owner", "player")
    return grouped_median(v, ["player"], "sc", median="median_score", count="games")


def skill_tiers(spark, d):
    return reports.skill_tiers(_seq(spark, d))


def cohort_tag(spark, d):
    owners = _games(spark, d).select("owner").distinct()
    return tag_members(owners, "owner", fixture.members(spark, d))


def normalise_address_q(spark, d):
    ev = fixture.mint_events(spark, d)
    raw = F.get(F.col("keys"), 2)
    return ev.select("block_number", raw.alias("addr"), normalise_address(raw).alias("addr_norm"))


def half_medians(spark, d):
    return reports.half_medians(_seq(spark, d))


def first_k_games(spark, d):
    return _firsts(spark, d).select("owner", "id", "game_no", "sc")


# --- statistics stated in prose --------------------------------------------------

def persistence_correlation(spark, d):
    return reports.persistence_correlation(_seq(spark, d))


def population_summary(spark, d):
    return reports.population_summary(_games(spark, d))


def score_distribution(spark, d):
    return reports.score_distribution(_games(spark, d))


def retention_split(spark, d):
    return reports.retention_split(_seq(spark, d))


def early_vs_later_improvement(spark, d):
    return reports.early_vs_later_improvement(_seq(spark, d))


def lifetime_total_tiers(spark, d):
    return reports.lifetime_total_tiers(_seq(spark, d))


def tiers_ordered(spark, d):
    return reports.tiers_ordered(reports.skill_persistence(_seq(spark, d)))


# --- quality ---------------------------------------------------------------------

def key_uniqueness_q(spark, d):
    t = fixture.token_tables(spark, d)
    return key_uniqueness({
        "token_metadata": (t.metadata, ["id"]),
        "token_scores": (t.scores, ["id"]),
        "token_owners": (t.owners, ["token_id"]),
        "lineitem": (fixture.lineitem(spark, d), ["l_orderkey", "l_linenumber"]),
    })


def duplicate_tokens_q(spark, d):
    """Tokens that are several games: the owners of purchases are listed twice."""
    t = fixture.token_tables(spark, d)
    return duplicate_tokens(official_games(t.metadata, t.scores, fixture.twice_owned(spark, d)))


def score_quality_q(spark, d):
    t = fixture.token_tables(spark, d)
    return score_quality(official_games(t.metadata, t.scores, t.owners, keep_text=True))


# --- text in every spelling ---------------------------------------------------------

def decode_spellings(spark, d):
    """The three decodes of damaged score text (as text: 64-bit unsigned values)."""
    s = fixture.spelt_scores(spark, d)
    return s.select("id", "score", *[decode_hex_score("score", mode=m).cast("string").alias(m)
                                     for m in ("reference", "strict", "full")])


def score_quality_spellings(spark, d):
    t = fixture.token_tables(spark, d)
    scores = fixture.spelt_scores(spark, d).join(t.scores.select("id", "executed_at"), "id")
    return score_quality(official_games(t.metadata, scores, t.owners, keep_text=True))


def address_quality_q(spark, d):
    return address_quality(fixture.spelt_owners(spark, d))


def distinct_players_spellings(spark, d):
    """Players by address value, whatever the spelling; text that is no address
    is no player."""
    t = fixture.token_tables(spark, d)
    return scope_players(scoped_metadata(t.metadata), fixture.spelt_owners(spark, d))


# --- every branch of the bucketed reports -------------------------------------------

def skill_persistence_short(spark, d):
    """Persistence with windows that the test players' histories fill."""
    return reports.skill_persistence(_seq(spark, d), windows=[15, 20, 30, 50])


def retention_split_short(spark, d):
    return reports.retention_split(_seq(spark, d), buckets=[(36, "up to 36"), (44, "37-44")], rest="45+")


def lifetime_tiers_short(spark, d):
    return reports.lifetime_total_tiers(_seq(spark, d), buckets=[(33, "up to 33"), (37, "34-37"), (41, "38-41"), (45, "42-45")], rest="46+")


def histogram_median(spark, d):
    """Exact medians per event type by running counts over value ranges."""
    ev = fixture.events(spark, d)
    return grouped_median(ev, ["event_type"], "value", median="median_value", count="rows", method="histogram")


def price_medians(spark, d):
    """Exact medians of a continuous value, by radix narrowing."""
    items = fixture.lineitem(spark, d)
    return grouped_median(items, ["l_returnflag"], "l_extendedprice", median="median_price", count="rows", method="histogram")


def price_deciles(spark, d):
    """NTILE(10) of every line by its price, a continuous value, and its key."""
    items = fixture.lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice")
    return quantile_tiers(items, 10, "l_extendedprice", ["l_orderkey", "l_linenumber"], tier="decile")


def latest_event(spark, d):
    """Each user's latest event (the event id breaks ties)."""
    ev = fixture.events(spark, d).select("user_id", "ts", "event_id", "event_type")
    return latest_per_key(ev, ["user_id"], ["ts", "event_id"]).drop("ts")


def sequence_load_q(spark, d):
    return sequence_load(_games(spark, d))


QUERIES: dict[str, Query] = {
    "experience_tiers": experience_tiers,
    "learning_curve": learning_curve,
    "within_player_improvement": within_player_improvement,
    "cohort_first_games": cohort_first_games,
    "cohort_learning_curve": cohort_learning_curve,
    "skill_persistence": skill_persistence,
    "distinct_players": distinct_players,
    "mint_event_players": mint_event_players,
    "veteran_overlap": veteran_overlap,
    "veteran_overlap_counts": veteran_overlap_counts,
    "cohort_first_games_derived": cohort_first_games_derived,
    "decode_hex_score": decode_hex_score_q,
    "official_games": official_games_q,
    "registry_scope": registry_scope,
    "game_sequence": game_sequence_q,
    "valid_scores": valid_scores,
    "grouped_median": grouped_median_q,
    "skill_tiers": skill_tiers,
    "cohort_tag": cohort_tag,
    "normalise_address": normalise_address_q,
    "half_medians": half_medians,
    "first_k_games": first_k_games,
    "persistence_correlation": persistence_correlation,
    "population_summary": population_summary,
    "score_distribution": score_distribution,
    "retention_split": retention_split,
    "early_vs_later_improvement": early_vs_later_improvement,
    "lifetime_total_tiers": lifetime_total_tiers,
    "tiers_ordered": tiers_ordered,
    "key_uniqueness": key_uniqueness_q,
    "duplicate_tokens": duplicate_tokens_q,
    "score_quality": score_quality_q,
    "sequence_load": sequence_load_q,
    "decode_spellings": decode_spellings,
    "score_quality_spellings": score_quality_spellings,
    "address_quality": address_quality_q,
    "distinct_players_spellings": distinct_players_spellings,
    "skill_persistence_short": skill_persistence_short,
    "retention_split_short": retention_split_short,
    "lifetime_tiers_short": lifetime_tiers_short,
    "histogram_median": histogram_median,
    "price_medians": price_medians,
    "price_deciles": price_deciles,
    "latest_event": latest_event,
    "landed_experience_tiers": landing.landed_experience_tiers,
    "landed_counts": landing.landed_counts,
    "landed_mint_players": landing.landed_mint_players,
    "half_medians_shared": landing.half_medians_shared,
    "skill_persistence_shared": landing.skill_persistence_shared,
}
