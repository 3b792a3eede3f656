"""Every registered query equals its DuckDB oracle on the sf0.01 tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001, SF01
from seqlens.plans.catalog import QUERIES

TABLES = ["customer", "orders", "lineitem", "events", "supplier"]
NAMES = sorted(QUERIES)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) & set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF01)
    cols = sorted(df.columns)
    got = _sorted([tuple(_norm(r[c]) for c in cols) for r in df.collect()])
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = _sorted([tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()])
    assert got == want


def test_entry_smoke(spark):
    assert os.path.isdir(SF001)
    df = E.entry(spark)
    assert df.columns == ["skill_tier", "later_window", "games", "median_score"]
    assert df.count() > 0


#: Queries that write landed files while they are built.
LANDING = {"landed_experience_tiers", "landed_counts", "landed_mint_players", "half_medians_shared", "skill_persistence_shared"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LANDING))
def test_building_a_query_starts_no_job(spark, name):
    sc = spark.sparkContext
    group = f"build-{name}"
    sc.setJobGroup(group, group)
    try:
        E.queries()[name](spark, SF001)
        assert sc.statusTracker().getJobIdsForGroup(group) in (None, [], ())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_no_query_leaves_a_cached_table(spark):
    for name in ("skill_persistence", "skill_tiers", "experience_tiers"):
        E.queries()[name](spark, SF001).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_every_class_occurs(spark):
    """The rows that show the branches really hold them."""
    q = E.queries()
    assert {r.score_class for r in q["score_quality_spellings"](spark, SF01).collect()} == \
        {"null", "malformed", "valid", "too_small"} | {r.score_class for r in q["score_quality"](spark, SF01).collect()}
    assert {r.address_class for r in q["address_quality"](spark, SF01).collect()} == \
        {"null", "malformed", "canonical", "other_spelling"}
    assert q["skill_persistence_short"](spark, SF01).count() == 16
    assert q["retention_split_short"](spark, SF01).count() == 3
    assert q["lifetime_tiers_short"](spark, SF01).count() == 5
