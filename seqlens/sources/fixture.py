"""Adapter from the generated test tables to the library's input tables.

The analysis consumes three token tables joined on the token id, a
membership list and a contract event log. The test folder holds generic
tables instead; this module derives the inputs from them, row for row
(every row of the source tables is used):

=================  =====================================================
token_metadata     events: id = event_id as text; settings_id = 0 for
                   ``error`` events else 1; minted_by = the third-party
                   minter for ``signup`` events, else the official one
token_scores       events: id = event_id as text; score = 16-digit hex of
                   floor(value * 10); executed_at = ts
token_owners       events: token_id = event_id as text; owner = 64-digit hex
                   address of user_id
members            customer rows in segment BUILDING: 64-digit address of
                   c_custkey (same id range as user_id)
registry           supplier: index = 16-digit hex of s_suppkey (the form of
                   minted_by), address = 64-digit hex address of s_suppkey
mint_events        orders: contract = the earlier game's contract;
                   block_number = days since 1970 of o_orderdate * 150;
                   keys = [transfer selector, zero (mint) when
                   o_orderstatus = 'F' else ``0x1``, short hex of
                   o_custkey (unpadded), short hex of o_orderkey, ``0x0``].
                   Contract, selector and zero are spelt in four ways, by
                   o_orderkey: as stated, without the zero after ``0x``,
                   in upper case, and padded to 64 digits
spelt_scores       events: the score text damaged in seven ways by event_id:
                   intact, upper case, without prefix, last digit missing,
                   NULL, top digits set, a character that is no digit
spelt_owners       events: the owner in five ways by event_id: padded, short,
                   upper case, ``0x`` alone, NULL
=================  =====================================================

The three token tables are projected from ``events`` separately so the two
token-id joins really run. The same mapping, in DuckDB SQL, is the prefix of
every oracle query (``seqlens.plans.oracle``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.functions.constants import (MINT_FROM, OFFICIAL_MINTER, OG_CONTRACT,
                                         TRANSFER_SELECTOR)
from seqlens.functions.scalars import encode_address, encode_hex_score, short_hex
from seqlens.sources.schemas import TEST_TABLES

OTHER_MINTER = "0x0000000000000007"
# In the derived registry the official index 0x...06 belongs to address 6;
# written unpadded so the lookup also exercises address normalisation.
REGISTRY_MINTER_ADDRESS = "0x6"
MEMBER_SEGMENT = "BUILDING"
BLOCKS_PER_DAY = 150


@dataclass(frozen=True)
class TokenTables:
    metadata: DataFrame
    scores: DataFrame
    owners: DataFrame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TEST_TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def token_tables(spark: SparkSession, sf_dir: str) -> TokenTables:
    ev = _table(spark, sf_dir, "events")
    metadata = ev.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.lit(1)).alias("settings_id"),
        F.when(F.col("event_type") == "signup", F.lit(OTHER_MINTER))
         .otherwise(F.lit(OFFICIAL_MINTER)).alias("minted_by"),
    )
    scores = ev.select(
        F.col("event_id").cast("string").alias("id"),
        encode_hex_score(F.floor(F.col("value") * 10)).alias("score"),
        F.col("ts").alias("executed_at"),
    )
    owners = ev.select(
        F.col("event_id").cast("string").alias("token_id"),
        encode_address("user_id").alias("owner"),
    )
    return TokenTables(metadata, scores, owners)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _table(spark, sf_dir, "customer")
    return cust.filter(F.col("c_mktsegment") == MEMBER_SEGMENT) \
        .select(encode_address("c_custkey").alias("addr"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = _table(spark, sf_dir, "supplier")
    return sup.select(encode_hex_score("s_suppkey").alias("index"),
                      encode_address("s_suppkey").alias("address"))


def _spelt(value: str):
    """One of four spellings of a hex constant, by o_orderkey."""
    digits = value[2:].lstrip("0")
    spellings = [value, f"0x{digits or '0'}", f"0x{(digits or '0').upper()}", f"0x{digits:0>64}"]
    return F.element_at(F.array(*[F.lit(x) for x in spellings]), (F.col("o_orderkey") % 4 + 1).cast("int"))


def mint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return orders.select(
        _spelt(OG_CONTRACT).alias("address"),
        (days.cast("bigint") * F.lit(BLOCKS_PER_DAY)).alias("block_number"),
        F.array(
            _spelt(TRANSFER_SELECTOR),
            F.when(F.col("o_orderstatus") == "F", _spelt(MINT_FROM)).otherwise(F.lit("0x1")),
            short_hex("o_custkey"),
            short_hex("o_orderkey"),
            F.lit("0x0"),
        ).alias("keys"),
    )


def spelt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    score, way = encode_hex_score(F.floor(F.col("value") * 10)), F.col("event_id") % 7
    damaged = (F.when(way == 0, score).when(way == 1, F.upper(score)).when(way == 2, F.substring(score, 3, 16))
               .when(way == 3, F.substring(score, 1, 17)).when(way == 5, F.concat(F.lit("0xffff"), F.substring(score, 7, 12)))
               .when(way == 6, F.concat(F.substring(score, 1, 16), F.lit("g"), F.substring(score, 18, 1))))
    return ev.select(F.col("event_id").cast("string").alias("id"), damaged.alias("score"))


def spelt_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    way = F.col("event_id") % 5
    return ev.select(F.col("event_id").cast("string").alias("token_id"),
                     (F.when(way == 0, encode_address("user_id")).when(way == 1, short_hex("user_id"))
                      .when(way == 2, F.upper(encode_address("user_id"))).when(way == 3, F.lit("0x"))).alias("owner"))


def twice_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owners, with those of purchases listed twice, as after a faulty load."""
    owners = token_tables(spark, sf_dir).owners
    ev = _table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return owners.unionByName(ev.select(F.col("event_id").cast("string").alias("token_id"), encode_address("user_id").alias("owner")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem")
