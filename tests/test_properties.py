"""Property tests (random inputs): the distributed forms equal the plain ones,
and results do not depend on row order or partition count."""

import datetime as dt

from hypothesis import given, settings, strategies as st

from seqlens.operators import grouped_median, quantile_tiers, sequence
from plain import window_ntile, window_sequence

T0 = dt.datetime(2025, 1, 1)

players = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None]),
                             st.integers(0, 20), st.integers(0, 4000)),
                   min_size=0, max_size=60)


def _rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))


@settings(max_examples=8, deadline=None)
@given(players, st.integers(1, 6))
def test_sequence_equals_window(spark, rows, parts):
    # minute 0 stands for a missing time (NULLs sort first)
    data = [(o, i, None if m == 0 else T0 + dt.timedelta(minutes=m), sc)
            for i, (o, m, sc) in enumerate(rows)]
    df = spark.createDataFrame(data, "owner string, id long, ts timestamp_ntz, sc long")
    cols = ["owner", "id", "ordinal", "n"]
    plain = _rows(window_sequence(df, "owner", ["ts"], ["id"]), cols)
    # ranges of about two rows: many for each owner
    split = _rows(sequence(df.repartition(parts), "owner", ["ts"], ["id"], rows_per_range=4), cols)
    assert plain == split == _rows(sequence(df, "owner", ["ts"], ["id"]), cols)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 8), min_size=0, max_size=70), st.integers(1, 4),
       st.integers(1, 7))
def test_tiers_equal_ntile(spark, values, k, parts):
    df = spark.createDataFrame([(f"p{i:03d}", float(v) / 2) for i, v in enumerate(values)],
                               "player string, e10 double")
    a = _rows(quantile_tiers(df.repartition(parts), k, "e10", "player"),
              ["player", "tier"])
    b = _rows(window_ntile(df, k, ["e10", "player"]), ["player", "tier"])
    assert a == b


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 3000)), min_size=1, max_size=80),
       st.integers(1, 5))
def test_median_methods_and_partitioning(spark, rows, parts):
    df = spark.createDataFrame(rows, "g long, sc long")
    base = _rows(grouped_median(df, ["g"], "sc"), ["g", "rows", "median"])
    assert base == _rows(grouped_median(df.repartition(parts), ["g"], "sc", method="histogram"),
                         ["g", "rows", "median"])
    # the median is the mean of the middle rows
    for g, c, m in base:
        vals = sorted(sc for gg, sc in rows if gg == g)
        assert c == len(vals)
        assert m == (vals[(c + 1) // 2 - 1] + vals[(c + 2) // 2 - 1]) / 2


HEX = "0123456789abcdef"


def _positional(s):
    """The positional decode evaluated in Python (characters 7..18)."""
    if s is None:
        return None
    total = 0
    for pos in range(7, 19):
        ch = s[pos - 1:pos]
        digit = 0 if ch == "" else HEX.find(ch)     # unknown character -> -1
        total += digit * 16 ** (18 - pos)
    return total


texts = st.one_of(
    st.none(),
    st.text(alphabet=HEX, min_size=16, max_size=16).map(lambda t: "0x" + t),      # canonical
    st.text(alphabet=HEX + "ABCDEFxz ", min_size=0, max_size=20).map(lambda t: "0x" + t),
    st.text(alphabet=HEX + "X", min_size=0, max_size=20),
)


@settings(max_examples=10, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40))
def test_decode_fast_path_equals_positional(spark, values):
    from pyspark.sql import functions as F
    from seqlens.functions import decode_hex_score
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r.d for r in df.select(decode_hex_score("s").alias("d")).collect()]
    got_col = [r.d for r in df.select(decode_hex_score(F.col("s")).alias("d")).collect()]
    want = [_positional(v) for v in values]
    assert got == want and got_col == want
