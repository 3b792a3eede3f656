"""Sinks: reports and member lists as JSON records or parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqlens.functions.scalars import normalise_address
from seqlens.sources import readers
from seqlens.sources.readers import file_system


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write a report with its columns in alphabetical order (one object per row).

    Reports are small aggregates; they are written by the executors, never
    collected to the driver.
    """
    out = df.select(*sorted(df.columns))
    out.write.mode(mode).format(fmt).save(path)


def write_sorted_list(df: DataFrame, column: str, path: str, fmt: str = "json",
                      mode: str = "overwrite") -> None:
    """Write one column sorted ascending. The global sort is a range-partitioned
    shuffle, so a list of any size is written in parallel, in order across
    the part files."""
    df.select(column).orderBy(column).write.mode(mode).format(fmt).save(path)


def write_list_array(df: DataFrame, column: str, path: str) -> None:
    """Write one column as one sorted JSON array of strings in one file, an item a
    line: the form in which member lists are published, for lists of any length.

    The items are sorted and encoded in parallel, in range-partitioned parts. The
    parts are then copied, in order, into one file by a stream of the file system
    with a fixed buffer; nothing is parsed or held on the way."""
    spark = df.sparkSession
    items = df.select(F.col(column).cast("string").alias("item")).filter(F.col("item").isNotNull()).orderBy("item")
    encoded = F.to_json(F.array("item"))
    # every line begins with the comma that parts it from the line before
    lines = items.select(F.concat(F.lit(","), F.substring(encoded, F.lit(2), F.length(encoded) - 2)).alias("value"))
    parts = f"{path.rstrip('/')}/_parts"
    lines.write.mode("overwrite").text(parts)
    fs, jvm = file_system(spark, path), spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    names = sorted(s.getPath().getName() for s in fs.listStatus(place(parts)) if s.getPath().getName().startswith("part-") and s.getLen())
    out = fs.create(place(f"{path.rstrip('/')}/part-00000.json"), True)
    try:
        out.write(bytearray(b"["))
        for k, name in enumerate(names):
            part = fs.open(place(f"{parts}/{name}"))
            try:
                if k == 0:
                    part.read()  # the comma before the first item
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
        out.write(bytearray(b"]"))
    finally:
        out.close()
    fs.delete(place(parts), True)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str,
                   mode: str = "overwrite") -> None:
    """Land a token table bucketed and sorted by its join key, as an external
    table at ``path``. Token tables landed with the same key and bucket count
    join on the token id with no exchange at all. The rows are dealt by bucket
    first, so each bucket is one file."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode(mode).format("parquet") \
        .option("path", path).saveAsTable(table)


# Mint events are landed in folders of this many blocks, so a block window
# reads only the folders it overlaps.
BLOCK_RANGE = 100_000


def land_mint_events(events: DataFrame, path: str, block_range: int = BLOCK_RANGE,
                     mode: str = "overwrite") -> None:
    """Land contract events partitioned by ``block_range = block_number div
    block_range``, with contract, selector and sender in canonical text, and a
    manifest that says so: the range size, the spelling, the rows and the least and
    greatest block. ``readers.read_landed_mints`` reads both, and
    ``cohorts.mint_receivers`` then turns its block window into a partition filter
    without being told the size.

    Appending to a landing of another range size raises."""
    spark = events.sparkSession
    before = readers.landing_manifest(spark, path) if mode == "append" else None
    if before and before["block_range"] != block_range:
        raise ValueError(f"{path} is landed by ranges of {before['block_range']} blocks, not {block_range}")
    keys = F.transform("keys", lambda k, i: F.when(i < 2, normalise_address(k)).otherwise(k))
    out = events.withColumns({"block_range": F.floor(F.col("block_number") / block_range).cast("bigint"),
                              "address": normalise_address("address"), "keys": keys})
    # the bounds are observed while the rows are written
    seen = Observation()
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("block_number").alias("first"), F.max("block_number").alias("last"))
    out.write.mode(mode).partitionBy("block_range").parquet(path)
    manifest = {"block_range": block_range, "canonical": True, "rows": seen.get["rows"],
                "first_block": seen.get["first"], "last_block": seen.get["last"]}
    if before:
        manifest["rows"] += before["rows"]
        for name, pick in (("first_block", min), ("last_block", max)):
            known = [m[name] for m in (before, manifest) if m[name] is not None]
            manifest[name] = pick(known) if known else None
    # a name with an underscore: no reader takes the manifest for data
    text = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{readers.MANIFEST}")
