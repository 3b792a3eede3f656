import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from plain import window_median, window_ntile, window_sequence
from seqlens.functions.constants import (MINT_FROM_BLOCK, MINT_TO_BLOCK, OFFICIAL_MINTER,
                                         OFFICIAL_MINTER_ADDRESS, OG_CONTRACT, TRANSFER_SELECTOR)
from seqlens.operators import (drop_members, global_positions, grouped_median, key_uniqueness,
                               mint_players, mint_summary, official_games, overlap,
                               overlap_counts, quantile_tiers, scoped_metadata, sequence,
                               tag_members)
from seqlens.operators.games import game_sequence
from seqlens.operators.median import order_key
from seqlens.operators.sequence import first_k, latest_per_key
from seqlens.operators.sequence import dealt_by_range as sequence_ranges
from seqlens.sources import fixture


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# --- sequencing ------------------------------------------------------------------

@pytest.fixture(scope="module")
def games(spark):
    t = fixture.token_tables(spark, SF01)
    return official_games(t.metadata, t.scores, t.owners)


def test_sequence_equals_plain_window(spark, games):
    cols = ["owner", "id", "game_no", "n"]
    plain = _rows(window_sequence(games, "owner", ["executed_at"], ["id"], ordinal="game_no"), cols)
    assert _rows(game_sequence(games), cols) == plain


def test_hot_entity_is_spread_over_tasks(spark):
    """A third of the rows belong to one owner: all in one week, all at one
    instant, or without a time. Its ranges lie in many partitions, none of
    which is much larger than asked for."""
    for when in ("timestamp_seconds(1735689600 + id * 7919 % 600000)", "timestamp_seconds(1735689600)", "cast(null as timestamp)"):
        df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 500)).alias("owner"),
                                        F.concat(F.lit("0x0000"), F.col("id")).alias("id"), F.expr(when).cast("timestamp_ntz").alias("ts"))
        out = sequence(df, "owner", ["ts"], ["id"], rows_per_range=1000)
        cols = ["owner", "id", "ordinal", "n"]
        assert _rows(out, cols) == _rows(window_sequence(df, "owner", ["ts"], ["id"]), cols)
        dealt = sequence_ranges(df, "owner", ["ts"], ["id"], rows_per_range=1000).filter("owner = 'hot'").groupBy("_range").count().collect()
        assert len(dealt) >= 10 and max(r["count"] for r in dealt) <= 3000
        assert sequence_ranges(df, "owner", ["ts"], ["id"], rows_per_range=1000).filter("owner <> 'hot' and _range <> 0").count() == 0


def test_first_k_equals_plain_window(spark, games):
    cols = ["owner", "id", "game_no"]
    plain = window_sequence(games, "owner", ["executed_at"], ["id"], ordinal="game_no").filter("game_no <= 3")
    assert _rows(first_k(games, "owner", ["executed_at"], ["id"], 3, ordinal="game_no"), cols) == _rows(plain, cols)


def test_sequence_nulls_and_ties(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("a", 1, t0), ("a", 2, None), ("a", 3, t0), ("a", 4, t0 + dt.timedelta(30)),
            (None, 5, t0), (None, 6, None), ("b", 7, t0), ("", 8, t0)]
    df = spark.createDataFrame(rows, "owner string, id long, ts timestamp_ntz")
    out = sequence(df, "owner", ["ts"], ["id"]).collect()
    # NULL time first, id breaks ties; a NULL owner is not the empty one
    assert {r.id: r.ordinal for r in out} == {2: 1, 1: 2, 3: 3, 4: 4, 6: 1, 5: 2, 7: 1, 8: 1}
    assert {r.id: r.n for r in out} == {1: 4, 2: 4, 3: 4, 4: 4, 5: 2, 6: 2, 7: 1, 8: 1}


def test_latest_per_key(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("t1", "old", t0), ("t1", "new", t0 + dt.timedelta(1)), ("t2", "a", None), ("t2", "b", t0),
            ("t3", "x", t0), ("t3", "y", t0)]
    df = spark.createDataFrame(rows, "token_id string, owner string, since timestamp_ntz")
    out = latest_per_key(df, ["token_id"], ["since", "owner"])
    assert out.columns == df.columns
    assert _rows(out, ["token_id", "owner"]) == [("t1", "new"), ("t2", "b"), ("t3", "y")]


def test_corrupt_first_game_keeps_ordinals(spark):
    rows = [("p", 1, dt.datetime(2025, 1, 1), 18000675), ("p", 2, dt.datetime(2025, 1, 2), 100)]
    df = spark.createDataFrame(rows, "owner string, id long, executed_at timestamp_ntz, sc long")
    out = game_sequence(df).filter(F.col("sc").between(1, 3000)).collect()
    assert [(r.id, r.game_no, r.n) for r in out] == [(2, 2, 2)]


# --- ranking ---------------------------------------------------------------------

@pytest.mark.parametrize("n,parts", [(0, 4), (1, 4), (2, 4), (3, 4), (5, 3), (8, 8), (9, 2),
                                     (150, 8), (151, 5), (153, 1)])
def test_quantile_tiers_equal_ntile(spark, n, parts):
    rnd = random.Random(n)
    # heavy ties: a third of the rows share one value
    rows = [(f"p{i:04d}", 7.5 if i % 3 == 0 else float(rnd.randrange(20))) for i in range(n)]
    df = spark.createDataFrame(rows, "player string, e10 double")
    a = _rows(quantile_tiers(df.repartition(parts), 4, "e10", "player"), ["player", "tier"])
    b = _rows(window_ntile(df, 4, ["e10", "player"]), ["player", "tier"])
    assert a == b


def test_global_positions_exact(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 0, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long")
    out = global_positions(df, "k", "i", total="tot", ranges=7)
    ref = df.withColumn("p", F.row_number().over(Window.orderBy("k", "i")) - 1)
    got = {(r.k, r.i): (r._pos, r.tot) for r in out.collect()}
    assert all(got[(r.k, r.i)] == (r.p, 500) for r in ref.collect())


# --- medians ---------------------------------------------------------------------

def test_median_methods_agree(spark):
    rnd = random.Random(11)
    rows = []
    for g in range(60):
        size = rnd.choice([1, 2, 3, 4, 7, 10, 31])
        rows += [(g, rnd.randrange(1, 3001)) for _ in range(size)]
    rows += [(99, None), (99, 5)]
    df = spark.createDataFrame(rows, "g long, sc long")
    exact = _rows(grouped_median(df, ["g"], "sc"), ["g", "rows", "median"])
    hist = _rows(grouped_median(df, ["g"], "sc", method="histogram"), ["g", "rows", "median"])
    win = _rows(window_median(df, ["g"], "sc"), ["g", "rows", "median"])
    assert exact == hist == win


def test_histogram_median_of_odd_values(spark):
    """Signs, zeros, subnormals, powers of two, infinities and NaN keep their order."""
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.0, -1.0, 2.0, 3.0, 4.0, 0.1, 0.3, 1e300, -1e300, 8.0, 7.999999999999999,
              8.000000000000002, 2.0 ** 1023, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), None, 1024.0, 1 / 3]
    rnd = random.Random(5)
    rows = [(g, rnd.choice(values)) for g in range(40) for _ in range(rnd.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g long, v double")
    keyed = df.filter("v is not null").select("v", order_key(df, "v").alias("k")).collect()
    for a in keyed:
        for b in keyed[:60]:
            less = b.v != b.v and a.v == a.v or a.v < b.v
            assert (a.k < b.k) == less
    finite = df.filter("v is null or (not isnan(v) and abs(v) < 1e299)")
    exact = _rows(grouped_median(finite, ["g"], "v").filter("rows > 0"), ["g", "rows", "median"])
    assert _rows(grouped_median(finite, ["g"], "v", method="histogram"), ["g", "rows", "median"]) == exact


def test_histogram_median_of_many_values_in_one_group(spark):
    """A million distinct values, nearly all within one power of two, in one of
    two groups, one of them without a name."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 1000 == 0, "small").alias("g"), (1 + F.col("id") / 2e6).alias("v"))
    assert _rows(grouped_median(df, ["g"], "v", method="histogram").filter("g is null"), ["rows", "median"]) == \
        [tuple(df.filter("g is null").agg(F.count("v"), F.percentile("v", 0.5)).first())]


def test_global_positions_of_ties(spark):
    """One value for nearly all rows, tie-breaks with a common beginning, NULLs."""
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.lit(7.25)).alias("v"),
                                  F.concat(F.lit("0x" + "0" * 40), F.lpad(F.col("id").cast("string"), 6, "0")).alias("p"))
    out = {r.p: r._pos for r in global_positions(df, "v", "p", ranges=13).collect()}
    ref = df.withColumn("n", F.row_number().over(Window.orderBy("v", "p")) - 1).collect()
    assert out == {r.p: r.n for r in ref}
    dealt = global_positions(df, "v", "p", ranges=13).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 10 and max(r["count"] for r in dealt) < 1000


def test_median_even_and_odd(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (2, 20), (2, 90), (3, 5)],
                               "g long, sc long")
    got = dict(_rows(grouped_median(df, ["g"], "sc", count=None), ["g", "median"]))
    assert got == {1: 15.0, 2: 20.0, 3: 5.0}


# --- scope, registry, key check ----------------------------------------------------

def test_scope_and_registry(spark):
    meta = spark.createDataFrame(
        [(1, 1, OFFICIAL_MINTER), (2, 0, OFFICIAL_MINTER), (3, 1, "0x0000000000000007"),
         (4, 1, OFFICIAL_MINTER)], "id long, settings_id int, minted_by string")
    registry = spark.createDataFrame(
        [(OFFICIAL_MINTER, OFFICIAL_MINTER_ADDRESS.upper().replace("0X", "0x")),
         ("0x0000000000000007", "0x1234")], "index string, address string")
    by_index = sorted(r.id for r in scoped_metadata(meta).collect())
    by_addr = sorted(r.id for r in scoped_metadata(
        meta, registry=registry, minter_address=OFFICIAL_MINTER_ADDRESS).collect())
    assert by_index == by_addr == [1, 4]


def test_key_uniqueness_catches_fanout(spark):
    owners = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "token_id long, owner string")
    out = key_uniqueness({"owners": (owners, ["token_id"])}).collect()[0]
    assert (out.rows, out.keys, out.duplicate_keys) == (3, 2, 1)


# --- cohorts ---------------------------------------------------------------------

def test_tag_and_drop_members(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "owner string, v long")
    members = spark.createDataFrame([("a",), ("a",), (None,)], "addr string")
    tagged = dict((r.v, r.cohort) for r in tag_members(df, "owner", members).collect())
    assert tagged == {1: "og_veteran", 2: "genuinely_new", 3: "genuinely_new"}
    kept = sorted(r.v for r in drop_members(df, "owner", members).collect())
    assert kept == [2, 3]


def test_mint_players_filters(spark):
    def ev(block, keys, addr=OG_CONTRACT):
        return (addr, block, keys)
    good = [TRANSFER_SELECTOR, "0x0", "0x0550ABcd", "0x1", "0x0"]
    rows = [
        ev(MINT_FROM_BLOCK - 1, good), ev(MINT_FROM_BLOCK, good), ev(MINT_TO_BLOCK, good),
        ev(MINT_TO_BLOCK + 1, good),
        ev(MINT_FROM_BLOCK, [TRANSFER_SELECTOR, "0x1", "0x9", "0x1", "0x0"]),   # not a mint
        ev(MINT_FROM_BLOCK, ["0xabc", "0x0", "0x9", "0x1", "0x0"]),            # other event
        ev(MINT_FROM_BLOCK, good, addr="0x1"),                                  # other contract
        ev(MINT_FROM_BLOCK, [TRANSFER_SELECTOR, "0x0", "550abcd"]),             # same player
        ev(MINT_FROM_BLOCK, [TRANSFER_SELECTOR, "0x0"]),                        # short keys
    ]
    df = spark.createDataFrame(rows, "address string, block_number long, keys array<string>")
    s = mint_summary(mint_players(df)).collect()[0]
    assert (s.mints, s.players) == (4, 1)


def test_overlap(spark):
    players = spark.createDataFrame([("0x" + "a".rjust(64, "0"), "0xA"), ("0x" + "b".rjust(64, "0"), "0xb")],
                                    "addr_norm string, owner string")
    other = spark.createDataFrame([("0x" + "a".rjust(64, "0"),), ("0x" + "a".rjust(64, "0"),)],
                                  "addr_norm string")
    assert [r.owner for r in overlap(players, other).collect()] == ["0xA"]
    c = overlap_counts(players, other).collect()[0]
    assert (c.players, c.veterans, c.genuinely_new) == (2, 1, 1)


def test_hot_owner_is_spread_over_tasks(spark):
    """An owner with a third of all rows is dealt to several tasks by ranges of
    time, and numbered right."""
    t0 = dt.datetime(2025, 1, 1)
    rows = [("hot", i, t0 + dt.timedelta(hours=i)) for i in range(3000)]
    rows += [(f"o{i % 300:03d}", 10_000 + i, t0 + dt.timedelta(hours=i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "owner string, id long, ts timestamp_ntz")
    plan = sequence(df, "owner", ["ts"], ["id"], rows_per_range=500)
    hot = plan.filter(F.col("owner") == "hot").agg(F.min("ordinal"), F.max("ordinal"), F.max("n")).first()
    assert tuple(hot) == (1, 3000, 3000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = sequence(df, "owner", ["ts"], ["id"], rows_per_range=500).withColumn("task", F.spark_partition_id())
        per = {r.task: r["count"] for r in tasks.groupBy("task").count().collect()}
        assert tasks.filter("owner = 'hot'").select("task").distinct().count() >= 4
        assert max(per.values()) <= 2 * 9000 / len(per)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_address_quality(spark):
    from seqlens.operators import address_quality
    df = spark.createDataFrame([("0x" + "1".rjust(64, "0"),), ("0x1",), ("",), ("0x",), ("xyz",), (None,)], "owner string")
    assert dict(_rows(address_quality(df), ["address_class", "rows"])) == \
        {"canonical": 1, "other_spelling": 1, "malformed": 3, "null": 1}


def test_mints_match_by_value(spark):
    """Spellings of contract, selector and sender that mean one number."""
    rows = []
    for n, (c, s, z) in enumerate([(OG_CONTRACT, TRANSFER_SELECTOR, "0x0"),
                                   ("0x" + OG_CONTRACT[3:], "0x00" + TRANSFER_SELECTOR[2:], "0x00"),
                                   (OG_CONTRACT.upper(), TRANSFER_SELECTOR.upper(), "0x" + "0" * 64),
                                   (OG_CONTRACT[2:], TRANSFER_SELECTOR, "0")]):
        rows.append((c, MINT_FROM_BLOCK, [s, z, f"0x{n + 1}"]))
    df = spark.createDataFrame(rows, "address string, block_number long, keys array<string>")
    assert tuple(mint_summary(mint_players(df)).first()) == (4, 4)


def test_histogram_median_has_no_percentile(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "cast(id * 1000 AS double) AS v")
    plan = grouped_median(df, ["g"], "v", method="histogram")._jdf.queryExecution().toString()
    assert "percentile" not in plan
