"""Writing out an intermediate result that several reports read."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.operators.sequence import ROWS_PER_RANGE
from seqlens.session import ensure_checkpoint_dir

PIECE = "_piece"


@dataclass(frozen=True)
class EntityTable:
    """Rows stored in buckets of (entity, piece), sorted by both. An ordinary entity
    is piece 0 and lies in one bucket; an entity with more rows than a task should
    hold has pieces 1, 2, ... in several buckets (``has_large``: there is one)."""

    table: str
    stored: DataFrame
    entity: str
    has_large: bool

    @property
    def rows(self) -> DataFrame:
        return self.stored.drop(PIECE)

    def drop(self) -> None:
        """Forget the table; its files stay in the shared folder."""
        self.stored.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def entity_table(df: DataFrame, entity: str, ordinal: str, total: str, name: str, buckets: int | None = None,
                 rows_per_piece: int = ROWS_PER_RANGE) -> EntityTable:
    """Write numbered rows once, laid out by entity, as an external table in the
    session's shared folder. ``total`` (rows of the entity) tells which entities are
    cut into pieces, and ``ordinal`` where, so nothing is counted for it. ``buckets``: by default
    as many as the session has shuffle partitions."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece = F.when(F.col(total) > rows_per_piece, 1 + F.floor((F.col(ordinal) - 1) / rows_per_piece)).otherwise(0)
    rows = df.withColumn(PIECE, piece.cast("int"))
    unique = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{unique}"
    keys = [entity, PIECE]
    rows.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys) \
        .option("path", path).saveAsTable(unique)
    stored = spark.table(unique)
    # the footers' bounds of the piece tell which row groups can be passed over
    return EntityTable(unique, stored, entity, not stored.filter(F.col(PIECE) > 0).isEmpty())


def per_entity(rows: DataFrame | EntityTable, entity: str, aggregates: list[Column], keep: Column) -> DataFrame:
    """``entity`` and ``aggregates`` over its rows that meet ``keep``.

    Over an ``EntityTable`` an ordinary entity is aggregated where it is stored, with
    no exchange: its piece is a constant, so (entity, piece), by which the buckets are
    cut, groups it whole. The pieces of a large entity are aggregated where they are
    stored, and only their partial results are exchanged."""
    if not isinstance(rows, EntityTable):
        return rows.filter(keep).groupBy(entity).agg(*aggregates)
    kept = rows.stored.filter(keep)
    if not rows.has_large:
        return kept.groupBy(entity, PIECE).agg(*aggregates).drop(PIECE)
    ordinary = kept.filter(F.col(PIECE) == 0).groupBy(entity, PIECE).agg(*aggregates).drop(PIECE)
    return ordinary.unionAll(kept.filter(F.col(PIECE) > 0).groupBy(entity).agg(*aggregates))
