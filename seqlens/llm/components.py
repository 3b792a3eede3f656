"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node (pre-aggregated before the shuffle) and a join,
so a node with very many links is no unbounded group. Steps are cut by tables
in the shared folder; only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import scratch_table


FILE_EDGES = 500_000


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _step(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    e = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return (e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))).distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``edges``: two 64-bit node columns ``u``, ``v``. Returns (node, comp) for
    every linked node; comp is the smallest node of its component, and is a
    node of its own row. Self-links and repeated links are ignored; no edges
    give no rows.

    With ``rounds`` only so many steps are made: nodes of one comp are then in
    one component, but a component may still have several."""
    e = scratch_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "edges")
    state, done = _state(e), 0
    while state[0] and done != rounds:
        # small graphs in few files; never fewer than a few tasks
        e = scratch_table(_step(e).coalesce(max(8, state[0] // FILE_EDGES)), "edges")
        done += 1
        before, state = state, _state(e)
        if state == before:
            break
    comp = e.groupBy("u").agg(F.min("v").alias("v")) if rounds else e
    return comp.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        comp.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
