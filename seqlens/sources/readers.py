"""Readers for landed tables.

Every reader passes an explicit schema, so scans never infer and parquet
pushes filters and prunes columns straight from the declared fields.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlens.sources import schemas


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "json":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "orc":
        return reader.orc(path)
    return reader.format(fmt).load(path)


def read_token_metadata(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.TOKEN_METADATA, fmt)


def read_token_scores(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.TOKEN_SCORES, fmt)


def read_token_owners(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.TOKEN_OWNERS, fmt)


def read_minter_registry(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.MINTER_REGISTRY, fmt)


def read_mint_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Contract events in a plain folder. ``read_landed_mints`` reads a landing that
    is partitioned by block range, and prunes it."""
    return _read(spark, path, schemas.MINT_EVENTS, fmt)


#: Folder of a landing's manifest, and the name under which its content stands in
#: the metadata of the partition column.
MANIFEST, LANDING = "_landing", "landing"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that holds ``path``."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def landing_manifest(spark: SparkSession, path: str) -> dict | None:
    """What ``sinks.land_mint_events`` wrote about the landing; None without it."""
    at = f"{path.rstrip('/')}/{MANIFEST}"
    if not file_system(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)):
        return None
    return json.loads(spark.read.text(at).first().value)


def read_landed_mints(spark: SparkSession, path: str) -> DataFrame:
    """Events as ``sinks.land_mint_events`` landed them. The partition column
    ``block_range`` carries the landing's manifest in its metadata, so whoever gets
    the DataFrame knows the range size and the spelling."""
    manifest = landing_manifest(spark, path)
    if manifest is None:
        raise ValueError(f"{path} has no manifest of sinks.land_mint_events; read_mint_events takes folders without one")
    events = spark.read.schema(T.StructType([*schemas.MINT_EVENTS.fields, T.StructField("block_range", T.LongType())])).parquet(path)
    return events.withMetadata("block_range", {LANDING: manifest})


def read_members(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A membership list as ``addr STRING`` rows.

    ``fmt``: ``"json"`` for JSON lines ``{"addr": ...}``, ``"parquet"``, or
    ``"json_array"`` for one JSON array of strings per file (the form the
    original list is committed in), on one line or on many; the lines are read in
    parallel, so a list of an item a line may have any length.
    """
    if fmt == "json_array":
        # a line holds whole items: JSON text has no line break inside a string
        items = F.regexp_replace("value", r"^\s*[\[,]?\s*|\s*[\],]?\s*$", "")
        lines = spark.read.text(path).select(items.alias("items")).filter(F.col("items") != "")
        return lines.select(F.explode(F.from_json(F.concat(F.lit("["), "items", F.lit("]")), "array<string>")).alias("addr"))
    return _read(spark, path, schemas.MEMBERS, fmt)


def read_result_rows(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """A saved report. ``fmt``: ``"json"`` for JSON lines (one object per line,
    as ``sinks.write_report`` writes), or ``"json_array"`` for one JSON array of
    flat objects per file (the form the original publishes)."""
    if fmt == "json_array":
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return _read(spark, path, schema, fmt)
