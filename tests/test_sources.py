import glob
import json
import os
import tempfile

import pytest

from pyspark.sql import types as T

from conftest import SF001
from seqlens.sources import fixture, readers, schemas, sinks
from seqlens.functions.constants import MINT_FROM_BLOCK, MINT_TO_BLOCK


def _tmp():
    return tempfile.mkdtemp(prefix="seqlens-test-")


def test_members_json_array_and_lines(spark):
    d = _tmp()
    addrs = ["0x" + f"{i:x}".rjust(64, "0") for i in (5, 3, 9)]
    with open(os.path.join(d, "list.json"), "w") as f:
        json.dump(addrs, f)                         # one JSON array on one line
    got = sorted(r.addr for r in readers.read_members(spark, os.path.join(d, "list.json"),
                                                      fmt="json_array").collect())
    assert got == sorted(addrs)
    with open(os.path.join(d, "lines.json"), "w") as f:
        f.write("\n".join(json.dumps({"addr": a}) for a in addrs))
    got = sorted(r.addr for r in readers.read_members(spark, os.path.join(d, "lines.json")).collect())
    assert got == sorted(addrs)


def test_report_roundtrip_with_sorted_keys(spark):
    d = _tmp()
    df = spark.createDataFrame([("first", 11, 5.5), ("second", 22, 6.5), ("third", 33, 7.5)],
                               "experience string, games long, median_score double").coalesce(1)
    sinks.write_report(df, os.path.join(d, "r"))       # three objects in one file
    lines = [json.loads(l) for p in sorted(glob.glob(os.path.join(d, "r", "part-*")))
             for l in open(p)]
    assert all(list(o) == sorted(o) for o in lines)
    schema = T.StructType([T.StructField("experience", T.StringType()),
                           T.StructField("games", T.LongType()),
                           T.StructField("median_score", T.DoubleType())])
    back = readers.read_result_rows(spark, os.path.join(d, "r"), schema)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_read_result_rows_json_array(spark):
    d = _tmp()
    rows = [{"cohort": "a", "first3_games": 12, "median_score_first_3_games": 1.5},
            {"cohort": "b", "first3_games": 34, "median_score_first_3_games": 2.5}]
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump(rows, f)
    schema = T.StructType([T.StructField("cohort", T.StringType()),
                           T.StructField("first3_games", T.LongType()),
                           T.StructField("median_score_first_3_games", T.DoubleType())])
    back = readers.read_result_rows(spark, os.path.join(d, "a.json"), schema, fmt="json_array")
    assert sorted(r.first3_games for r in back.collect()) == [12, 34]


def test_sorted_list_sink(spark):
    d = _tmp()
    vals = [f"0x{i:064x}" for i in range(200, 0, -1)]
    df = spark.createDataFrame([(v,) for v in vals], "addr string").repartition(5)
    sinks.write_sorted_list(df, "addr", os.path.join(d, "l"))
    got = [json.loads(l)["addr"] for p in sorted(glob.glob(os.path.join(d, "l", "part-*")))
           for l in open(p)]
    assert got == sorted(vals)


def test_list_array_sink(spark):
    d = _tmp()
    odd = ['say "x"', "a]", "[b", "c,", "line\nbreak", "0x3", "é", ""]
    df = spark.createDataFrame([(x,) for x in [*odd, None]], "addr string").repartition(3)
    for _ in range(2):  # a second write replaces the first
        sinks.write_list_array(df, "addr", os.path.join(d, "a"))
    files = [f for f in glob.glob(os.path.join(d, "a", "*")) if not os.path.basename(f).startswith((".", "_SUCCESS"))]
    assert len(files) == 1 and json.load(open(files[0])) == sorted(odd)
    assert sorted(r.addr for r in readers.read_members(spark, os.path.join(d, "a"), fmt="json_array").collect()) == sorted(odd)
    sinks.write_list_array(df.limit(0), "addr", os.path.join(d, "none"))
    assert json.load(open(os.path.join(d, "none", "part-00000.json"))) == []
    assert readers.read_members(spark, os.path.join(d, "none"), fmt="json_array").count() == 0


def test_list_array_of_any_length(spark):
    d = _tmp()
    df = spark.range(250_000).selectExpr("concat('0x', lpad(hex((id * 7919) % 250007), 64, '0')) AS addr")
    sinks.write_list_array(df, "addr", d)
    listed = json.load(open(os.path.join(d, "part-00000.json")))
    assert len(listed) == 250_000 and listed == sorted(listed)
    assert readers.read_members(spark, d, fmt="json_array").distinct().count() == 250_000


def test_members_array_on_many_lines(spark):
    d = _tmp()
    with open(os.path.join(d, "list.json"), "w") as f:
        json.dump(["0x1", "a]", "b,"], f, indent=2)
    assert sorted(r.addr for r in readers.read_members(spark, d, fmt="json_array").collect()) == ["0x1", "a]", "b,"]


def test_landing_describes_itself(spark):
    """The range size comes from the manifest; another one is an error, not a
    smaller result."""
    from seqlens.operators.cohorts import mint_players
    d = _tmp()
    events = fixture.mint_events(spark, SF001)
    want = sorted(map(tuple, mint_players(events).collect()))
    for size in (1000, 30_000, sinks.BLOCK_RANGE):
        at = os.path.join(d, str(size))
        sinks.land_mint_events(events, at, block_range=size)
        landed = readers.read_landed_mints(spark, at)
        assert sorted(map(tuple, mint_players(landed).collect())) == want
        assert sorted(map(tuple, mint_players(landed, block_range=size).collect())) == want
        with pytest.raises(ValueError):
            mint_players(landed, block_range=size + 1)
        with pytest.raises(ValueError):
            mint_players(spark.read.parquet(at), block_range=size)
        assert sorted(map(tuple, mint_players(spark.read.parquet(at)).collect())) == want  # unpruned, and right
        m = readers.landing_manifest(spark, at)
        lo, hi, n = events.selectExpr("min(block_number)", "max(block_number)", "count(*)").first()
        assert m == {"block_range": size, "canonical": True, "rows": n, "first_block": lo, "last_block": hi}
    with pytest.raises(ValueError):
        sinks.land_mint_events(events, os.path.join(d, "1000"), block_range=5, mode="append")
    sinks.land_mint_events(events, os.path.join(d, "1000"), block_range=1000, mode="append")
    assert readers.landing_manifest(spark, os.path.join(d, "1000"))["rows"] == 2 * n
    events.write.parquet(os.path.join(d, "plain"))
    with pytest.raises(ValueError):
        readers.read_landed_mints(spark, os.path.join(d, "plain"))


def test_text_ids_survive(spark):
    d = _tmp()
    with open(os.path.join(d, "m.json"), "w") as f:
        f.write('{"id": "0xff", "settings_id": 1, "minted_by": "0x6"}\n')
    assert [r.id for r in readers.read_token_metadata(spark, os.path.join(d, "m.json"), "json").collect()] == ["0xff"]


def test_get_session_leaves_a_running_session_alone(spark):
    from seqlens.session import get_session
    spark.conf.set("spark.sql.shuffle.partitions", "77")
    try:
        assert get_session() is spark and spark.conf.get("spark.sql.shuffle.partitions") == "77"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_token_table_readers(spark):
    d = _tmp()
    t = fixture.token_tables(spark, SF001)
    t.metadata.write.parquet(os.path.join(d, "m"))
    t.scores.write.parquet(os.path.join(d, "s"))
    t.owners.write.parquet(os.path.join(d, "o"))
    m = readers.read_token_metadata(spark, os.path.join(d, "m"))
    s = readers.read_token_scores(spark, os.path.join(d, "s"))
    o = readers.read_token_owners(spark, os.path.join(d, "o"))
    assert m.schema.names == schemas.TOKEN_METADATA.names
    assert s.schema.names == schemas.TOKEN_SCORES.names
    assert o.schema.names == schemas.TOKEN_OWNERS.names
    assert m.count() == s.count() == o.count() == 1000


def test_fixture_shapes(spark):
    t = fixture.token_tables(spark, SF001)
    assert t.scores.filter(~t.scores.score.rlike("^0x[0-9a-f]{16}$")).count() == 0
    assert t.owners.filter(~t.owners.owner.rlike("^0x[0-9a-f]{64}$")).count() == 0
    ev = fixture.mint_events(spark, SF001)
    lo, hi = ev.selectExpr("min(block_number)", "max(block_number)").first()
    assert lo >= MINT_FROM_BLOCK and hi > MINT_TO_BLOCK   # the upper bound cuts some events


def test_export_reports(spark):
    from seqlens.plans.export import export_reports
    d = _tmp()
    paths = export_reports(spark, SF001, d, ["experience_tiers", "skill_persistence"])
    rows = [json.loads(l) for p in sorted(glob.glob(os.path.join(paths["experience_tiers"], "part-*")))
            for l in open(p)]
    assert rows and all(list(r) == ["experience", "games", "median_score"] for r in rows)
    assert sum(r["games"] for r in rows) > 0


def test_reports_on_landed_tables_equal_the_registered_queries(spark):
    import __spark_entry__ as E
    from seqlens.plans.landed import read_landed, report_set
    d = _tmp()
    t = fixture.token_tables(spark, SF001)
    for name, df in (("m", t.metadata), ("s", t.scores), ("o", t.owners)):
        df.write.parquet(os.path.join(d, name))
    fixture.members(spark, SF001).write.json(os.path.join(d, "members"))
    fixture.mint_events(spark, SF001).write.parquet(os.path.join(d, "mints"))
    tables = read_landed(spark, os.path.join(d, "m"), os.path.join(d, "s"), os.path.join(d, "o"))
    out = report_set(tables, readers.read_members(spark, os.path.join(d, "members")),
                     readers.read_mint_events(spark, os.path.join(d, "mints")))
    for name in ("experience_tiers", "within_player_improvement", "skill_persistence",
                 "cohort_first_games", "cohort_learning_curve", "mint_event_players",
                 "veteran_overlap", "retention_split", "score_quality", "sequence_load"):
        want = E.queries()[name](spark, SF001)
        cols = sorted(want.columns)
        assert sorted(map(tuple, out[name].select(cols).collect())) == \
            sorted(map(tuple, want.select(cols).collect())), name


def test_report_set_scope_reaches_the_derived_members(spark):
    """With another minter, players and members are that minter's."""
    from seqlens.functions.constants import OG_CONTRACT, TRANSFER_SELECTOR
    from seqlens.plans.landed import report_set
    other = "0x0000000000000009"
    meta = spark.createDataFrame([("1", 1, "0x0000000000000006"), ("2", 1, other), ("3", 1, other)],
                                 schemas.TOKEN_METADATA)
    scores = spark.createDataFrame([(i, "0x0000000000000064", None) for i in "123"], schemas.TOKEN_SCORES)
    owners = spark.createDataFrame([("1", "0xaa"), ("2", "0xbb"), ("3", "0xcc")], schemas.TOKEN_OWNERS)
    mints = spark.createDataFrame([(OG_CONTRACT, MINT_FROM_BLOCK, [TRANSFER_SELECTOR, "0x0", a]) for a in ("0xaa", "0xbb")],
                                  schemas.MINT_EVENTS)
    out = report_set(fixture.TokenTables(meta, scores, owners), mint_events=mints, minter=other)
    assert [r.addr for r in out["veteran_overlap"].collect()] == ["0xbb"]
    assert {r.cohort: r.first3_games for r in out["cohort_first_games"].collect()} == {"og_veteran": 1, "genuinely_new": 1}


def test_report_set_shared_and_not_agree(spark):
    from seqlens.plans.landed import report_set
    t = fixture.token_tables(spark, SF001)
    members = fixture.members(spark, SF001)
    a = report_set(t, members)
    b = report_set(t, members, share=False)
    for name in ("experience_tiers", "cohort_first_games", "skill_persistence"):
        cols = sorted(a[name].columns)
        assert sorted(map(tuple, a[name].select(cols).collect())) == \
            sorted(map(tuple, b[name].select(cols).collect())), name


def test_report_set_refuses_duplicate_tokens(spark):
    """One owner row more makes the reports fail, and is named; on request it counts."""
    from seqlens.plans.landed import report_set
    t = fixture.token_tables(spark, SF001)
    scoped = t.metadata.filter("settings_id = 1 and minted_by = '0x0000000000000006'")
    token = scoped.first().id
    twice = fixture.TokenTables(t.metadata, t.scores, t.owners.union(t.owners.filter(t.owners.token_id == token)))
    assert [tuple(r) for r in report_set(twice, share=False)["duplicate_tokens"].collect()] == [(token, 2)]
    with pytest.raises(Exception, match=f"token {token}"):
        report_set(twice, share=False)["population_summary"].collect()
    kept = report_set(twice, share=False, duplicates="keep")["sequence_load"].first().games
    assert kept == report_set(t, share=False)["sequence_load"].first().games + 1


def test_report_set_key_check(spark):
    from seqlens.plans.landed import report_set
    t = fixture.token_tables(spark, SF001)
    rows = {r.table_name: (r.rows, r.duplicate_keys)
            for r in report_set(t, share=False)["key_uniqueness"].collect()}
    assert rows == {"token_metadata": (1000, 0), "token_scores": (1000, 0), "token_owners": (1000, 0)}
