"""Round trips through landed files: the fixture's tables are written to the
session's shared folder in the forms users land them, and read back through the
readers. Building these queries runs the writes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlens.operators.cohorts import mint_players, mint_summary
from seqlens.operators.games import official_games, sequenced_games
from seqlens.operators.reuse import entity_table
from seqlens.plans import reports
from seqlens.plans.landed import read_landed
from seqlens.session import ensure_checkpoint_dir
from seqlens.sources import fixture, readers, sinks

TIERS = T.StructType([T.StructField("experience", T.StringType()), T.StructField("games", T.LongType()),
                      T.StructField("median_score", T.DoubleType())])


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex[:12]}"


def _land_tokens(spark, sf_dir: str, at: str, fmt: str) -> fixture.TokenTables:
    t = fixture.token_tables(spark, sf_dir)
    for name, df in (("metadata", t.metadata), ("scores", t.scores), ("owners", t.owners)):
        df.write.format(fmt).save(f"{at}/{name}")
    return read_landed(spark, *[f"{at}/{n}" for n in ("metadata", "scores", "owners")], fmt=fmt)


def landed_experience_tiers(spark, sf_dir: str) -> DataFrame:
    """The first report over landed token tables, written as JSON lines in one
    file and read back."""
    at = _folder(spark)
    tables = _land_tokens(spark, sf_dir, at, "parquet")
    sinks.write_report(reports.experience_tiers(sequenced_games(tables)).coalesce(1), f"{at}/report")
    return readers.read_result_rows(spark, f"{at}/report", TIERS)


def landed_counts(spark, sf_dir: str) -> DataFrame:
    """Rows that come back from every landed form: ``item, rows``."""
    at = _folder(spark)
    tables = _land_tokens(spark, sf_dir, at, "json")
    members, mints = fixture.members(spark, sf_dir), fixture.mint_events(spark, sf_dir)
    sinks.write_sorted_list(members, "addr", f"{at}/members")
    sinks.write_list_array(members, "addr", f"{at}/members-array")
    sinks.land_mint_events(mints, f"{at}/mints")
    found = mint_summary(mint_players(readers.read_landed_mints(spark, f"{at}/mints")))
    games = official_games(tables.metadata, tables.scores, tables.owners)
    items = {
        "metadata": tables.metadata, "scores": tables.scores, "owners": tables.owners, "games": games,
        "members": readers.read_members(spark, f"{at}/members").distinct(),
        "members_array": readers.read_members(spark, f"{at}/members-array", fmt="json_array").distinct(),
    }
    parts = [df.agg(F.lit(name).alias("item"), F.count(F.lit(1)).alias("rows")) for name, df in items.items()]
    parts += [found.select(F.lit(c).alias("item"), F.col(c).alias("rows")) for c in ("mints", "players")]
    return reduce(DataFrame.unionAll, parts)


def landed_mint_players(spark, sf_dir: str) -> DataFrame:
    """The mint report over a landing with ranges of another size, which its
    manifest tells the report."""
    at = _folder(spark)
    sinks.land_mint_events(fixture.mint_events(spark, sf_dir), f"{at}/mints", block_range=30_000)
    return mint_summary(mint_players(readers.read_landed_mints(spark, f"{at}/mints")))


def half_medians_shared(spark, sf_dir: str) -> DataFrame:
    """Half medians over the numbered games stored in buckets by player; players of
    more than 50 games lie in several buckets."""
    seq = sequenced_games(fixture.token_tables(spark, sf_dir))
    return reports.half_medians(entity_table(seq, "owner", "game_no", "n", "numbered-games", rows_per_piece=50))


def skill_persistence_shared(spark, sf_dir: str) -> DataFrame:
    """Skill persistence over the numbered games stored in buckets by player."""
    seq = sequenced_games(fixture.token_tables(spark, sf_dir))
    return reports.skill_persistence(entity_table(seq, "owner", "game_no", "n", "numbered-games"))
