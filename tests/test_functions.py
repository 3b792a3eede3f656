import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqlens.functions import (bucketize, decode_hex_score, encode_address, encode_hex_score,
                               normalise_address, ntile_of_position)


def _one(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


@pytest.mark.parametrize("score,expected", [
    ("0x00000000000001bb", 443),
    ("0xffff0000000001bb", 443),            # top 16 bits ignored
    ("0x00000000000001BB", 239),            # unknown digits count -1
    ("0x01bb", 0),                          # missing digits count 0
    ("0x", 0),
    ("", 0),
    ("00000000000001bb", 113408),           # no prefix: window shifts
    ("0x00000000000zz1bb", -69189),
    (None, None),
])
def test_decode_reference(spark, score, expected):
    got = _one(spark, [(score,)], "s string", decode_hex_score("s"))
    assert got == [expected]


def test_decode_strict_and_full(spark):
    rows = [("0x00000000000001bb",), ("0xffff0000000001bb",), ("0x00000000000001BB",),
            ("0x01bb",), (None,)]
    assert _one(spark, rows, "s string", decode_hex_score("s", mode="strict")) == \
        [443, 443, None, None, None]
    full = _one(spark, rows, "s string", decode_hex_score("s", mode="full"))
    assert [None if v is None else int(v) for v in full] == \
        [443, 0xffff0000000001bb, None, None, None]


def test_decode_encode_roundtrip(spark):
    rnd = random.Random(7)
    vals = [0, 1, 443, 3000, 2 ** 48 - 1] + [rnd.randrange(0, 2 ** 48) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    out = df.select("v", decode_hex_score(encode_hex_score("v")).alias("d")).collect()
    assert all(r.v == r.d for r in out)


def test_normalise_address(spark):
    rows = [("0x0550ABcd",), ("0x550abcd",), ("550abcd",), ("0x0",), (None,), ("  0X0550abcd ",)]
    got = _one(spark, rows, "a string", normalise_address("a"))
    canon = "0x" + "550abcd".rjust(64, "0")
    assert got == [canon, canon, canon, "0x" + "0" * 64, None, canon]
    long = "0x" + "1" * 66
    assert _one(spark, [(long,)], "a string", normalise_address("a")) == [long]


def test_encode_address(spark):
    got = _one(spark, [(5,), (255,)], "v long", encode_address("v"))
    assert got == ["0x" + "5".rjust(64, "0"), "0x" + "ff".rjust(64, "0")]


def test_bucketize_boundaries(spark):
    bounds = [(1, "a"), (5, "b"), (20, "c"), (50, "d")]
    vals = [1, 2, 5, 6, 20, 21, 50, 51, 1000]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    o, lab = bucketize("v", bounds, "e")
    got = [(r.o, r.l) for r in df.select(o.alias("o"), lab.alias("l")).collect()]
    assert got == [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c"), (4, "d"), (4, "d"),
                   (5, "e"), (5, "e")]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 13])
def test_ntile_formula_matches_ntile(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "i long")
    w = Window.orderBy("i")
    out = df.select(F.ntile(4).over(w).alias("a"),
                    ntile_of_position(F.col("i"), F.lit(n), 4).alias("b")).collect()
    assert all(r.a == r.b for r in out)


def test_decode_column_and_name_agree(spark):
    rows = [("0x00000000000001bb",), ("0xffff0000000001bb",), ("0x00000000000001BB",),
            ("0x01bb",), ("",), ("00000000000001bb",), ("0x00000000000zz1bb",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    out = df.select(decode_hex_score("s").alias("a"), decode_hex_score(F.col("s")).alias("b")).collect()
    assert all(r.a == r.b for r in out)


def test_same_number_takes_hex_text_only(spark):
    from seqlens.functions.constants import OG_CONTRACT
    from seqlens.functions.scalars import same_number
    digits = OG_CONTRACT[2:].lstrip("0")
    texts = [OG_CONTRACT, f"0x{digits}", digits.upper(), f"  0x000{digits} ", f"x00x{digits}", f"xxx{digits}", f"0x0x{digits}", f"0x{digits}g", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [bool(r.s) for r in df.select(same_number("t", OG_CONTRACT).alias("s")).collect()] == [True] * 4 + [False] * 5
