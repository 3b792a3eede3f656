import datetime as dt

from seqlens.operators.games import game_sequence
from seqlens.plans import reports

T0 = dt.datetime(2025, 9, 1)


def _games(spark, players):
    """players: {owner: [score, ...]} in time order -> numbered game fact."""
    rows, i = [], 0
    for owner, scores in players.items():
        for k, sc in enumerate(scores):
            i += 1
            rows.append((owner, i, T0 + dt.timedelta(minutes=k), sc))
    df = spark.createDataFrame(rows, "owner string, id long, executed_at timestamp_ntz, sc long")
    return game_sequence(df)


def test_experience_tier_edges(spark):
    seq = _games(spark, {"p": list(range(1, 61))})   # ordinal k has score k
    out = [(r.experience, r.games, r.median_score) for r in reports.experience_tiers(seq).collect()]
    assert out == [("1st game", 1, 1.0), ("2nd-5th game", 4, 3.5), ("6th-20th game", 15, 13.0),
                   ("21st-50th game", 30, 35.5), ("51st+ game", 10, 55.5)]


def test_invalid_scores_keep_ordinals(spark):
    # ordinals 1..6; games 1 (score 0) and 2 (3001) are invalid but keep their
    # ordinals: tier 2-5 holds the valid 7, 8, 9 and tier 6-20 holds 10
    seq = _games(spark, {"p": [0, 3001, 7, 8, 9, 10]})
    out = {r.experience: (r.games, r.median_score) for r in reports.experience_tiers(seq).collect()}
    assert out == {"2nd-5th game": (3, 8.0), "6th-20th game": (1, 10.0)}


def test_learning_curve_support(spark):
    players = {f"p{i:02d}": [10 + i] for i in range(29)}
    seq = _games(spark, players)
    assert reports.learning_curve(seq).count() == 0
    players["p29"] = [100]
    out = reports.learning_curve(_games(spark, players)).collect()
    assert [(r.game_no, r.players) for r in out] == [(1, 30)]


def test_half_split_odd_total(spark):
    # n = 11: first half is games 1..5, second 6..11
    seq = _games(spark, {"p": [1, 2, 3, 4, 5, 100, 100, 100, 100, 100, 100]})
    r = reports.half_medians(seq).collect()[0]
    assert (r.first_med, r.second_med) == (3.0, 100.0)


def test_half_without_valid_score_drops_player(spark):
    seq = _games(spark, {"a": [0] * 5 + [50] * 5, "b": [10] * 5 + [20] * 5,
                         "c": [30] * 5 + [20] * 5, "d": [5] * 9})   # d: n < 10
    r = reports.within_player_improvement(seq).collect()[0]
    assert (r.players, r.improved, r.pct_improved) == (2, 1, 50.0)
    assert (r.avg_first_half_median, r.avg_second_half_median) == (20.0, 20.0)


def test_cohort_first_games(spark):
    seq = _games(spark, {"v": [100, 200, 300, 400], "n1": [1, 2, 3, 4], "n2": [5, 0, 7]})
    members = spark.createDataFrame([("v",), ("x",)], "addr string")
    out = {r.cohort: (r.first3_games, r.median_score_first_3_games)
           for r in reports.cohort_first_games(seq, members).collect()}
    assert out == {"og_veteran": (3, 200.0), "genuinely_new": (5, 3.0)}


def test_skill_persistence_shape_and_ties(spark):
    # 8 players, equal early medians: tiers come from the player tie-break, 2 each
    players = {f"p{i}": [100] * 10 + [10 * (i + 1)] * 110 for i in range(8)}
    seq = _games(spark, players)
    tiers = {r.player: r.skill_tier for r in reports.skill_tiers(seq).collect()}
    assert tiers == {"p0": 1, "p1": 1, "p2": 2, "p3": 2, "p4": 3, "p5": 3, "p6": 4, "p7": 4}
    out = reports.skill_persistence(seq).collect()
    assert [(r.skill_tier, r.later_window) for r in out] == \
        [(t, w) for t in range(1, 5) for w in range(1, 5)]
    # window sizes: 11-20, 21-40, 41-70, 71-120 -> 10, 20, 30, 50 games per player
    assert [r.games for r in out[:4]] == [20, 40, 60, 100]
    assert [r.median_score for r in out if r.later_window == 1] == [15.0, 35.0, 55.0, 75.0]
    ordered = {r.later_window: r.tiers_ordered
               for r in reports.tiers_ordered(reports.skill_persistence(seq)).collect()}
    assert ordered == {1: True, 2: True, 3: True, 4: True}


def test_persistence_min_games_boundary(spark):
    players = {"p19": [50] * 19, "p20": [60] * 20}
    seq = _games(spark, players)
    assert [r.player for r in reports.skill_tiers(seq).collect()] == ["p20"]
    out = reports.skill_persistence(seq).collect()
    assert [(r.skill_tier, r.later_window, r.games) for r in out] == [(1, 1, 10)]


def test_correlation_and_distribution(spark):
    players = {f"p{i}": [i + 1] * 10 + [2 * (i + 1)] * 10 for i in range(5)}
    seq = _games(spark, players)
    r = reports.persistence_correlation(seq).collect()[0]
    assert (r.players, r.r) == (5, 1.0)
    d = reports.score_distribution(seq).collect()[0]
    assert d.max_score == 10


def test_valid_score_boundaries(spark):
    seq = _games(spark, {"p": [0, 1, 3000, 3001]})
    d = reports.score_distribution(seq).collect()[0]
    assert d.max_score == 3000
    pop = reports.population_summary(seq).collect()[0]
    assert (pop.games, pop.players) == (2, 1)


def test_later_window_last_edge(spark):
    # ordinals 120 and 121: 120 is in window 4, 121 is outside every window
    scores = [50] * 10 + [60] * 109 + [70, 999]
    seq = _games(spark, {"p": scores})
    out = {r.later_window: r.games for r in reports.skill_persistence(seq).collect()}
    assert out == {1: 10, 2: 20, 3: 30, 4: 50}
