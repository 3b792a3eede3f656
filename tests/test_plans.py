"""Plan shape checks: no Python in the plan, no global window over players,
per-owner limit for first-k, pruned scans."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF001
from seqlens.plans.catalog import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plan(spark, name):
    p = _plan(E.queries()[name](spark, SF001))
    for op in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
               "MapInPandas"):
        assert op not in p


def test_tiers_do_not_use_a_global_ntile(spark):
    p = _plan(E.queries()["skill_tiers"](spark, SF001)).lower()
    assert " ntile(" not in p and "[ntile(" not in p


def test_first_k_is_limited_per_owner(spark):
    p = _plan(E.queries()["first_k_games"](spark, SF001))
    assert "WindowGroupLimit" in p


def test_scans_read_only_needed_columns(spark):
    df = E.queries()["experience_tiers"](spark, SF001)
    p = _plan(df)
    assert "props" not in p
    assert "user_id" in p


def test_median_is_an_aggregate(spark):
    p = _plan(E.queries()["experience_tiers"](spark, SF001))
    assert "partial_percentile(sc" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_single_partition_exchanges_only_carry_aggregates(spark, name):
    """A SinglePartition exchange may only move partial aggregates or the
    per-range size table, never row-level or per-player data."""
    lines = _plan(E.queries()[name](spark, SF001)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            assert "Aggregate" in child, (name, line, child)


def test_scope_filter_reaches_landed_parquet(spark, tmp_path):
    """On landed token tables the scope predicates are parquet filters and
    the scans read only the joined columns."""
    from seqlens.operators.games import official_games
    from seqlens.sources import fixture, readers
    t = fixture.token_tables(spark, SF001)
    for name, df in (("m", t.metadata), ("s", t.scores), ("o", t.owners)):
        df.write.parquet(str(tmp_path / name))
    g = official_games(readers.read_token_metadata(spark, str(tmp_path / "m")),
                       readers.read_token_scores(spark, str(tmp_path / "s")),
                       readers.read_token_owners(spark, str(tmp_path / "o")))
    p = _plan(g)
    assert "EqualTo(settings_id,1)" in p
    assert "EqualTo(minted_by,0x" in p      # the plan string shortens the literal
    assert "ReadSchema: struct<id:string,settings_id:int,minted_by:string>" in p
    assert g.count() == g.filter("sc is not null").count() > 0


def test_bucketed_token_tables_join_without_exchange(spark, tmp_path):
    from seqlens.operators.games import official_games
    from seqlens.sources import fixture, sinks
    t = fixture.token_tables(spark, SF001)
    names = {}
    for name, df, key in (("meta", t.metadata, "id"), ("scores", t.scores, "id"),
                          ("owners", t.owners, "token_id")):
        names[name] = f"bucket_test_{name}"
        sinks.write_bucketed(df, names[name], key, 4, str(tmp_path / name))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = official_games(spark.table(names["meta"]), spark.table(names["scores"]),
                           spark.table(names["owners"]))
        p = _plan(g)
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert g.count() == official_games(t.metadata, t.scores, t.owners).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for n in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_block_window_prunes_landed_partitions(spark, tmp_path):
    from seqlens.operators.cohorts import mint_players
    from seqlens.sources import fixture, readers, sinks
    sinks.land_mint_events(fixture.mint_events(spark, SF001), str(tmp_path / "ev"))
    pruned = mint_players(readers.read_landed_mints(spark, str(tmp_path / "ev")))
    p = _plan(pruned)
    assert "PartitionFilters: [isnotnull(block_range" in p and "block_range" in p.split("PartitionFilters")[1][:200]
    direct = mint_players(fixture.mint_events(spark, SF001))
    cols = ["addr_norm", "mints"]
    assert sorted(tuple(r) for r in pruned.select(cols).collect()) == \
        sorted(tuple(r) for r in direct.select(cols).collect())


def test_members_are_removed_before_the_joins(spark):
    """The anti join reads the owners table, below both token joins."""
    lines = _static_plan(spark, lambda: E.queries()["cohort_learning_curve"](spark, SF001))
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    joins = [(i, depth(x)) for i, x in enumerate(lines) if "SortMergeJoin" in x]
    anti = [i for i, x in enumerate(lines) if "LeftAnti" in x]
    assert len(anti) == 1
    above = [j for j in joins if j[0] < anti[0] and j[1] < depth(lines[anti[0]])]
    assert above and not any("LeftAnti" in lines[i] for i, _ in above)
    below = lines[anti[0] + 1:]
    assert not any("SortMergeJoin" in x and depth(x) > depth(lines[anti[0]]) for x in below[:next((k for k, x in enumerate(below) if depth(x) <= depth(lines[anti[0]])), len(below))])


def test_duplicate_guard_adds_no_exchange(spark):
    """The guard, and the report of duplicates, use the joins' partitioning."""
    from seqlens.operators import duplicate_tokens, official_games
    from seqlens.sources import fixture
    t = fixture.token_tables(spark, SF001)
    for make in (lambda: official_games(t.metadata, t.scores, t.owners, duplicates="refuse"),
                 lambda: duplicate_tokens(official_games(t.metadata, t.scores, t.owners))):
        lines = _static_plan(spark, make)
        assert len(_ran(lines, " Exchange |-Exchange ")) <= 3  # those of the token joins, or fewer


def test_score_text_is_decoded_before_the_joins(spark):
    """Above the scan of the scores only the decoded number is carried."""
    for name in ("experience_tiers", "cohort_first_games", "skill_persistence"):
        p = E.queries()[name](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        lines = [x for x in p.splitlines() if "Join " in x]
        assert lines and not any("score" in x for x in lines)


def _static_plan(spark, make):
    """The physical plan without broadcasts of inputs and without runtime changes:
    every branch is in it, and an exchange that is read again shows as reused."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [x for x in _plan(make()).splitlines()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def _ran(lines, what):
    return [x for x in lines if re.search(what, x) and "ReusedExchange" not in x]


@pytest.mark.parametrize("name", ["experience_tiers", "learning_curve", "half_medians", "game_sequence", "retention_split"])
def test_numbering_shuffles_the_games_once(spark, name):
    """The joined games are dealt once, by owner and range; the sample below and
    the range counts above read exchanges that ran already: each token table is
    scanned and shuffled once, whoever reads it."""
    lines = _static_plan(spark, lambda: E.queries()[name](spark, SF001))
    assert len(_ran(lines, "REPARTITION_BY_COL")) == 1
    assert len([x for x in lines if "FileScan parquet" in x]) == 3
    assert len(_ran(lines, r"Exchange hashpartitioning\(id#")) == 3
    assert len([x for x in lines if "ReusedExchange" in x and "REPARTITION_BY_COL" in x]) == 1


def _adaptive_plan(spark, make):
    """The plan that ran, without broadcasts of inputs: no node that turned out
    to have no rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make()
        df.collect()
        return _plan(df).split("Initial Plan")[0].splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_persistence_is_one_pass(spark):
    """Players, not games, meet the tiers: the only sort-merge joins are those of
    the three token tables."""
    make = lambda: E.queries()["skill_persistence"](spark, SF001)
    static, ran = _static_plan(spark, make), _adaptive_plan(spark, make)
    for lines in (static, ran):
        assert len([x for x in lines if "FileScan parquet" in x]) == 3
        assert len(_ran(lines, "REPARTITION_BY_COL")) == 1
    assert len([x for x in ran if "SortMergeJoin" in x]) == 2
    assert len(_ran(ran, r" Exchange ")) <= 10


def test_no_window_without_a_key_sees_rows(spark):
    """NTILE: the window without a key runs over range sizes, and the rows are
    dealt by range once."""
    lines = _static_plan(spark, lambda: E.queries()["price_deciles"](spark, SF001))
    assert len(_ran(lines, "Exchange rangepartitioning")) == 1 and len([x for x in lines if "FileScan" in x]) == 1
    windows = [i for i, x in enumerate(lines) if "Window [" in x]
    assert len(windows) == 1
    below = " ".join(lines[windows[0]:windows[0] + 5])
    assert "SinglePartition" in below and "HashAggregate(keys=[_groupingexpression" in below


def test_histogram_median_shuffles_counts(spark):
    """Values are counted before any exchange; the passes read counts."""
    lines = _static_plan(spark, lambda: E.queries()["price_medians"](spark, SF001))
    for i, x in enumerate(lines):
        if "Exchange hashpartitioning(l_returnflag" in x and "_bin" in x and "Reused" not in x:
            assert "partial_count" in lines[i + 1]


def test_bucketed_sink_writes_one_file_per_bucket(spark, tmp_path):
    from seqlens.sources import sinks
    df = spark.range(10_000).selectExpr("cast(id AS string) AS id").repartition(20)
    sinks.write_bucketed(df, "bucket_files", "id", 4, str(tmp_path / "b"))
    try:
        assert len(list((tmp_path / "b").glob("part-*"))) <= 4
    finally:
        spark.sql("DROP TABLE IF EXISTS bucket_files")


def _stored_games(spark, **how):
    from seqlens.operators import entity_table, sequenced_games
    from seqlens.sources import fixture
    return entity_table(sequenced_games(fixture.token_tables(spark, SF001)), "owner", "game_no", "n", "stored-games", **how)


def test_stored_games_are_read_without_an_exchange(spark):
    """Per-player reports over the stored games exchange no row; with players in
    several buckets, only partial aggregates of those."""
    from seqlens.plans import reports
    fact = _stored_games(spark)
    assert not fact.has_large
    lines = _static_plan(spark, lambda: reports.half_medians(fact))
    assert not [x for x in lines if "Exchange" in x] and any("Bucketed: true" in x for x in lines)
    split = _stored_games(spark, rows_per_piece=3)
    assert split.has_large
    lines = _static_plan(spark, lambda: reports.half_medians(split))
    at = [i for i, x in enumerate(lines) if "Exchange" in x]
    assert len(at) == 1 and "partial_percentile" in lines[at[0] + 1]
    assert len([x for x in lines if "Bucketed: true" in x]) >= 1
    for f in (fact, split):
        f.drop()


def test_a_large_player_is_stored_in_several_buckets(spark):
    """One player with half of the rows: pieces of bounded size, dealt over the
    buckets; the aggregates are those of the plain rows, without players too."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from seqlens.operators import entity_table, median_of, per_entity
    df = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 'big' WHEN id % 100 = 1 THEN NULL ELSE concat('p', id % 97) END AS owner",
                                      "id * 37 % 1009 AS sc")
    w = Window.partitionBy("owner")
    numbered = df.withColumn("game_no", F.row_number().over(w.orderBy("sc"))).withColumn("n", F.count("*").over(w))
    stored = entity_table(numbered, "owner", "game_no", "n", "large", buckets=8, rows_per_piece=100)
    sizes = stored.stored.groupBy("owner", "_piece").count().collect()
    assert stored.has_large and max(r["count"] for r in sizes) <= 100
    assert len({r["_piece"] for r in sizes if r["owner"] == "big"}) == 20
    files = stored.stored.filter("owner = 'big'").select(F.input_file_name()).distinct().count()
    assert files >= 4
    aggs = [median_of("sc").alias("m"), F.count("*").alias("c")]
    keep = F.col("sc") > 5
    key = lambda r: (str(r["owner"]), r["m"], r["c"])
    want = sorted(map(key, per_entity(numbered, "owner", aggs, keep).collect()))
    assert sorted(map(key, per_entity(stored, "owner", aggs, keep).collect())) == want
    stored.drop()


def test_no_stored_games(spark):
    """An empty table is stored and read."""
    from pyspark.sql import functions as F
    from seqlens.operators import entity_table, per_entity
    none = spark.createDataFrame([], "owner string, sc int, game_no bigint, n bigint")
    stored = entity_table(none, "owner", "game_no", "n", "none")
    assert not stored.has_large and stored.rows.columns == none.columns
    assert per_entity(stored, "owner", [F.max("sc").alias("m")], F.lit(True)).collect() == []
    stored.drop()
