"""Cohorts: membership tags, exclusion, event-log players and set overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.constants import (COHORT_MEMBER, COHORT_OTHER, MINT_FROM,
                                         MINT_FROM_BLOCK, MINT_TO_BLOCK, OG_CONTRACT,
                                         TRANSFER_SELECTOR)
from seqlens.functions.scalars import canonical_address, normalise_address, same_number
from seqlens.sources.readers import LANDING


def _member_side(members: DataFrame, member_col: str) -> DataFrame:
    """Distinct members; Spark picks the join by the side's size at run time."""
    return members.select(F.col(member_col).alias("_member")).filter(F.col("_member").isNotNull()).distinct()


def tag_members(df: DataFrame, key: str, members: DataFrame, member_col: str = "addr",
                out: str = "cohort", yes: str = COHORT_MEMBER, no: str = COHORT_OTHER) -> DataFrame:
    """Add ``out`` = ``yes`` when ``key`` is in the member list, else ``no``
    (a NULL key is not a member). Exact string match, as in the original."""
    side = _member_side(members, member_col).withColumn("_is_member", F.lit(True))
    tagged = df.join(side, df[key] == side["_member"], "left")
    return tagged.withColumn(out, F.when(F.col("_is_member"), F.lit(yes)).otherwise(F.lit(no))) \
        .drop("_member", "_is_member")


def drop_members(df: DataFrame, key: str, members: DataFrame, member_col: str = "addr") -> DataFrame:
    """Rows whose ``key`` is not in the list (NULL keys are kept: not members)."""
    side = _member_side(members, member_col)
    return df.join(side, df[key] == side["_member"], "left_anti")


def mint_receivers(events: DataFrame, contract: str = OG_CONTRACT,
                   selector: str = TRANSFER_SELECTOR, from_block: int = MINT_FROM_BLOCK,
                   to_block: int = MINT_TO_BLOCK, mint_from: str = MINT_FROM,
                   block_range: int | None = None) -> DataFrame:
    """One row per mint event (transfer from ``mint_from``) of ``contract`` in
    the block window (inclusive): ``receiver`` = ``keys[2]`` as written.

    Contract, selector and sender are compared by value, whatever their
    spelling. Events of ``readers.read_landed_mints`` bring the manifest of their
    landing along: its range size turns the window into a filter of partition
    folders, and where it says that the text is canonical the predicates reach the
    scan as they are. ``block_range`` only states the range size that the caller
    counts on: if the landing has another, or has no manifest, that is an error."""
    wanted = (contract, selector, mint_from)
    manifest = events.schema["block_range"].metadata.get(LANDING) if "block_range" in events.columns else None
    if block_range is not None and block_range != (manifest or {}).get("block_range"):
        raise ValueError(f"the events are landed by ranges of {manifest['block_range']} blocks, not {block_range}" if manifest else
                         "these events have no landing manifest: read them by readers.read_landed_mints")
    if manifest:
        size = manifest["block_range"]
        events = events.filter(F.col("block_range").between(from_block // size, to_block // size))
    landed = bool(manifest and manifest["canonical"])
    columns = [F.col("address"), F.get(F.col("keys"), 0), F.get(F.col("keys"), 1)]
    match = F.col("block_number").between(from_block, to_block)
    for column, value in zip(columns, wanted):
        match = match & (column == canonical_address(value) if landed else same_number(column, value))
    return events.filter(match).select(F.get(F.col("keys"), 2).alias("receiver"))


def mint_players(events: DataFrame, **filters) -> DataFrame:
    """Distinct receivers of mints: ``addr_norm, mints``.

    Events are first counted per receiver spelling (map-side combined, so a
    receiver with a huge share of the events costs one row per task); only
    the distinct spellings are normalised and merged."""
    per_spelling = mint_receivers(events, **filters).groupBy("receiver") \
        .agg(F.count(F.lit(1)).alias("_n"))
    return per_spelling.groupBy(normalise_address("receiver").alias("addr_norm")) \
        .agg(F.sum("_n").alias("mints"))


def mint_summary(players: DataFrame) -> DataFrame:
    """``mints`` (events) and ``players`` (distinct receivers; a missing
    receiver is not a player) from ``mint_players``."""
    return players.agg(F.coalesce(F.sum("mints"), F.lit(0)).cast("bigint").alias("mints"),
                       F.count("addr_norm").alias("players"))


def scope_players(scoped_ids: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct owners of in-scope tokens, de-duplicated on the normalised
    address; one spelling is kept per address (the greatest, so it is
    deterministic). Text that is no address is no player
    (``quality.address_quality`` counts it). Columns ``addr_norm, owner``.

    Owners are made distinct first (map-side combined), so the address is
    normalised once per spelling, not once per token."""
    o = owners.select(F.col("token_id").alias("id"), "owner")
    spellings = scoped_ids.join(o, "id").select("owner").distinct()
    return spellings.groupBy(normalise_address("owner").alias("addr_norm")) \
        .agg(F.max("owner").alias("owner")).filter(F.col("addr_norm").isNotNull())


def overlap(players: DataFrame, other: DataFrame, key: str = "addr_norm") -> DataFrame:
    """Rows of ``players`` whose normalised key also occurs in ``other``
    (a semi join: duplicates in ``other`` do not multiply rows)."""
    return players.join(other.select(key), key, "left_semi")


def overlap_counts(players: DataFrame, other: DataFrame, key: str = "addr_norm") -> DataFrame:
    """One row: ``players``, ``veterans`` (also in ``other``) and
    ``genuinely_new`` (the rest)."""
    flags = other.select(key).distinct().withColumn("_in_other", F.lit(1))
    j = players.select(key).join(flags, key, "left")
    return j.agg(F.count(F.lit(1)).alias("players"),
                 F.count("_in_other").alias("veterans")) \
        .withColumn("genuinely_new", F.col("players") - F.col("veterans"))
