"""User-level reports over the numbered game fact.

Input of most reports: the output of ``operators.games.sequenced_games`` —
``owner, id, executed_at, sc, game_no, n`` with ``game_no``/``n``
counted over all in-scope games (invalid scores included). Validity is
applied here, after numbering.

Reports that make one row per player also take the ``EntityTable`` that
``operators.reuse.entity_table`` writes, and then exchange no games.

Plan notes. After numbering the rows are dealt by owner, large owners by ranges.
Medians are partial aggregates (see ``operators.median``): an owner or tier with
most of the rows costs one partial map per task, not one task.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions import constants as K
from seqlens.functions.scalars import bucketize
from seqlens.operators.cohorts import (drop_members, mint_players, overlap, scope_players,
                                      tag_members)
from seqlens.operators.games import is_valid, scoped_metadata, sequenced_games
from seqlens.operators.median import median_of
from seqlens.operators.ranking import quantile_tiers
from seqlens.operators.reuse import EntityTable, per_entity


def _r1(c: Column) -> Column:
    return F.round(c, 1)


def _median_report(df: DataFrame, keys: list[str | Column], count_name: str,
                   median_name: str = "median_score") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name),
                                 _r1(median_of("sc")).alias(median_name))


# --- Q1 -------------------------------------------------------------------

def experience_tiers(seq: DataFrame, tiers=K.EXPERIENCE_TIERS, rest: str = K.EXPERIENCE_REST
                     ) -> DataFrame:
    """Median valid score by the game's place in the player's own sequence."""
    order, label = bucketize("game_no", tiers, rest)
    b = seq.filter(is_valid()).select(order.alias("_ord"), label.alias("experience"), "sc")
    return _median_report(b, ["_ord", "experience"], "games").orderBy("_ord").drop("_ord")


# --- Q2 / Q5 ----------------------------------------------------------------

def learning_curve(seq: DataFrame, min_players: int = K.LEARNING_CURVE_MIN_PLAYERS) -> DataFrame:
    """Median valid score of every player's Nth game; ordinals with at least
    ``min_players`` valid games."""
    r = _median_report(seq.filter(is_valid()), ["game_no"], "players")
    return r.filter(F.col("players") >= min_players).orderBy("game_no")


def cohort_learning_curve(tables, members: DataFrame,
                          min_players: int = K.LEARNING_CURVE_MIN_PLAYERS,
                          **scope) -> DataFrame:
    """The learning curve of non-members only. Membership depends only on the
    owner, so members' tokens are removed from the owners table: their games are
    neither joined nor shuffled with the others nor numbered."""
    others = replace(tables, owners=drop_members(tables.owners, "owner", members))
    seq = sequenced_games(others, total=None, **scope)
    return learning_curve(seq, min_players)


# --- Q3 ---------------------------------------------------------------------

def half_medians(seq: DataFrame | EntityTable, min_games: int = K.WITHIN_PLAYER_MIN_GAMES) -> DataFrame:
    """Per player with ``n >= min_games``: median valid score of the first half
    (``game_no <= n div 2``) and of the second half. One aggregate grouped by
    owner (no exchange after the numbering window)."""
    first = F.col("game_no") <= F.floor(F.col("n") / 2)
    medians = [median_of(F.when(first, F.col("sc"))).alias("first_med"),
               median_of(F.when(~first, F.col("sc"))).alias("second_med")]
    return per_entity(seq, "owner", medians, (F.col("n") >= min_games) & is_valid()).withColumnRenamed("owner", "player")


def _improvement(p: DataFrame, first: str, second: str, first_name: str,
                 second_name: str, uplift: bool = False) -> DataFrame:
    both = p.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    better = F.col(second) > F.col(first)
    aggs = [
        F.count(F.lit(1)).alias("players"),
        F.count(F.when(better, 1)).alias("improved"),
        _r1(F.try_divide(F.lit(100.0) * F.count(F.when(better, 1)), F.count(F.lit(1))))
        .alias("pct_improved"),
        _r1(F.avg(first)).alias(first_name),
        _r1(F.avg(second)).alias(second_name),
    ]
    if uplift:
        aggs.append(_r1(F.lit(100.0) * (F.try_divide(F.avg(second), F.avg(first)) - 1))
                    .alias("uplift_pct"))
    return both.agg(*aggs)


def within_player_improvement(seq: DataFrame | EntityTable, min_games: int = K.WITHIN_PLAYER_MIN_GAMES
                              ) -> DataFrame:
    """Players whose second-half median beats their first-half median."""
    return _improvement(half_medians(seq, min_games), "first_med", "second_med",
                        "avg_first_half_median", "avg_second_half_median")


# --- Q4 ---------------------------------------------------------------------

def cohort_first_games(firsts: DataFrame, members: DataFrame, k: int = K.COHORT_FIRST_K) -> DataFrame:
    """Median valid score over each player's first ``k`` games, members vs the
    rest. ``firsts``: numbered games; those after the k-th are left out."""
    tagged = tag_members(firsts.filter((F.col("game_no") <= k) & is_valid()), "owner", members)
    return _median_report(tagged, ["cohort"], f"first{k}_games", f"median_score_first_{k}_games")


# --- Q6 ---------------------------------------------------------------------

def skill_tiers(seq: DataFrame | EntityTable, min_games: int = K.PERSISTENCE_MIN_GAMES,
                early: int = K.PERSISTENCE_EARLY_GAMES, k: int = K.PERSISTENCE_TIERS
                ) -> DataFrame:
    """``player, e10, skill_tier``: median valid score over ordinals
    ``<= early`` of players with ``n >= min_games``, cut into ``k`` NTILE tiers
    (ties broken by player)."""
    keep = (F.col("n") >= min_games) & is_valid() & (F.col("game_no") <= early)
    em = per_entity(seq, "owner", [median_of("sc").alias("e10")], keep).withColumnRenamed("owner", "player")
    return quantile_tiers(em, k, "e10", "player", tier="skill_tier")


def skill_persistence(seq: DataFrame | EntityTable, min_games: int = K.PERSISTENCE_MIN_GAMES,
                      early: int = K.PERSISTENCE_EARLY_GAMES, k: int = K.PERSISTENCE_TIERS,
                      windows=K.PERSISTENCE_WINDOWS) -> DataFrame:
    """Median valid score per (early-skill tier, later window of ordinals).

    One pass over the numbered games: each player becomes one row, with the early
    median and the later scores by window (at most ``windows[-1]`` of them). The
    tiers are cut over the players, which carry their scores along, so no game is
    joined to a tier; the scores of a (tier, window) then meet as value -> count
    maps, one per task."""
    keep = (F.col("n") >= min_games) & is_valid() & (F.col("game_no") <= windows[-1])
    win, _ = bucketize("game_no", [(w, str(w)) for w in windows[:-1]], str(windows[-1]))
    is_early = F.col("game_no") <= early
    later = F.when(~is_early, F.struct(win.cast("bigint").alias("w"), "sc"))
    players = per_entity(seq, "owner", [median_of(F.when(is_early, F.col("sc"))).alias("e10"), F.collect_list(later).alias("later")],
                         keep).withColumnRenamed("owner", "player")
    tiers = quantile_tiers(players.filter(F.col("e10").isNotNull()), k, "e10", "player", tier="skill_tier")
    cells = tiers.select("skill_tier", F.explode("later").alias("g")).select("skill_tier", F.col("g.w").alias("later_window"), "g.sc")
    return _median_report(cells, ["skill_tier", "later_window"], "games") \
        .orderBy("skill_tier", "later_window")


def tiers_ordered(persistence: DataFrame) -> DataFrame:
    """Per later window: do the tier medians never decrease with the tier?"""
    w = Window.partitionBy("later_window").orderBy("skill_tier")
    prev = F.lag("median_score").over(w)
    step = persistence.withColumn("_ok", prev.isNull() | (F.col("median_score") >= prev))
    return step.groupBy("later_window").agg(F.bool_and("_ok").alias("tiers_ordered"))


def persistence_correlation(seq: DataFrame | EntityTable, min_games: int = K.PERSISTENCE_MIN_GAMES,
                            early: int = K.PERSISTENCE_EARLY_GAMES) -> DataFrame:
    """Pearson r between each player's early median and later median."""
    is_early = F.col("game_no") <= early
    p = per_entity(seq, "owner", [median_of(F.when(is_early, F.col("sc"))).alias("x"),
                                  median_of(F.when(~is_early, F.col("sc"))).alias("y")],
                   (F.col("n") >= min_games) & is_valid())
    both = p.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("players"),
                    F.round(F.corr("x", "y"), 6).alias("r"))


# --- prose statistics ---------------------------------------------------------

def population_summary(games: DataFrame) -> DataFrame:
    """``games`` need no numbering here."""
    v = games.filter(is_valid())
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return v.agg(F.count(F.lit(1)).alias("games"),
                 F.count_distinct("owner").alias("players"),
                 F.date_format(F.min("executed_at"), fmt).alias("first_game"),
                 F.date_format(F.max("executed_at"), fmt).alias("last_game"))


def score_distribution(games: DataFrame) -> DataFrame:
    v = games.filter(is_valid())
    return v.agg(F.round(F.percentile("sc", 0.5), 4).alias("median_score"),
                 F.round(F.percentile("sc", 0.99), 4).alias("p99_score"),
                 F.max("sc").alias("max_score"),
                 F.round(F.avg("sc"), 4).alias("mean_score"))


RETENTION_BUCKETS = [(1, "1 game"), (49, "2-49 games")]
RETENTION_REST = "50+ games"


def retention_split(seq: DataFrame, k: int = K.COHORT_FIRST_K, buckets=RETENTION_BUCKETS,
                    rest: str = RETENTION_REST) -> DataFrame:
    """Median of the first ``k`` games by the player's eventual total."""
    order, label = bucketize("n", buckets, rest)
    f = seq.filter((F.col("game_no") <= k) & is_valid()).select(order.alias("_ord"),
                                                       label.alias("retention"), "sc")
    return _median_report(f, ["_ord", "retention"], f"first{k}_games").orderBy("_ord").drop("_ord")


def early_vs_later_improvement(seq: DataFrame | EntityTable, min_games: int = 50, cut: int = 50) -> DataFrame:
    """Players with more than ``min_games`` games: median of games ``<= cut``
    vs games after it; share improving and relative uplift of the means."""
    early = F.col("game_no") <= cut
    p = per_entity(seq, "owner", [median_of(F.when(early, F.col("sc"))).alias("early_med"),
                                  median_of(F.when(~early, F.col("sc"))).alias("later_med")],
                   (F.col("n") > min_games) & is_valid())
    return _improvement(p, "early_med", "later_med", "avg_early_median", "avg_later_median",
                        uplift=True)


LIFETIME_BUCKETS = [(1, "1 game"), (5, "2-5 games"), (20, "6-20 games"), (50, "21-50 games")]
LIFETIME_REST = "51+ games"


def lifetime_total_tiers(seq: DataFrame, buckets=LIFETIME_BUCKETS, rest: str = LIFETIME_REST
                         ) -> DataFrame:
    """Median valid score pooled by the player's lifetime total (the confounded axis)."""
    order, label = bucketize("n", buckets, rest)
    b = seq.filter(is_valid()).select(order.alias("_ord"), label.alias("lifetime"), "sc")
    return _median_report(b, ["_ord", "lifetime"], "games").orderBy("_ord").drop("_ord")


# --- member list derived from the event log -------------------------------------

def derived_members(tables, mint_events: DataFrame, mints: dict | None = None, **scope) -> DataFrame:
    """``addr``: in-scope players who also received a mint of the earlier
    contract (matched on the normalised address), in the players' own
    spelling. This is the list the cohort reports take as members. ``mints``:
    arguments of ``cohorts.mint_receivers``; ``scope``: of ``games.scoped_metadata``."""
    players = scope_players(scoped_metadata(tables.metadata, **scope), tables.owners)
    return overlap(players, mint_players(mint_events, **(mints or {}))).select(F.col("owner").alias("addr"))
