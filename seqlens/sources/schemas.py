"""Explicit input and output schemas (no inference anywhere)."""

from pyspark.sql import types as T

TOKEN_METADATA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("settings_id", T.IntegerType(), True),
    T.StructField("minted_by", T.StringType(), True),
])

TOKEN_SCORES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("score", T.StringType(), True),
    T.StructField("executed_at", T.TimestampNTZType(), True),
])

TOKEN_OWNERS = T.StructType([
    T.StructField("token_id", T.StringType(), False),
    T.StructField("owner", T.StringType(), True),
])

MINTER_REGISTRY = T.StructType([
    T.StructField("index", T.StringType(), False),
    T.StructField("address", T.StringType(), False),
])

MEMBERS = T.StructType([T.StructField("addr", T.StringType(), True)])

MINT_EVENTS = T.StructType([
    T.StructField("address", T.StringType(), True),
    T.StructField("block_number", T.LongType(), True),
    T.StructField("keys", T.ArrayType(T.StringType()), True),
])

# Generated test tables: the columns the adapter reads (a partial schema reads
# only these columns and skips schema inference).
TEST_TABLES = {
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
    "supplier": T.StructType([
        T.StructField("s_suppkey", T.LongType()),
    ]),
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
    ]),
}
