"""Merkle manifest of a dataset, built and folded by slot pivots.

Every row is a leaf: the digest of its named columns, each written as ``-`` for
null, else as its UTF-8 byte count, ``:`` and the value. Within a group (source)
the leaves stand in key order; every ``FANOUT`` consecutive nodes become their
digest, level by level, until one node is left: the group's subroot. The subroots,
in the groups' order, become the root in the same way.

*Up*: a conditional aggregate per slot spreads the children of each parent into
``FANOUT`` columns; the concatenated columns are hashed. *Down*: the same pivoted
rows give every child its siblings, which are the columns but its own; the path of
a node is its own siblings followed by its parent's path, so a leaf gets its whole
proof with one join per level, of a table ``FANOUT`` times smaller each time.

Scale: texts are read once and never shuffled; the leaves travel as digests. The
place of a leaf in its group comes from ``operators.sequence``, which splits a
group that holds a large share of the rows; from there on the key is (group,
parent), so a hot group is spread evenly. The number of levels is the logarithm of
the largest group's size, the only figure, next to the root, that the driver
reads. Each level is a table in the shared folder, which lost executors don't take
with them.

Defined cases: a null key sorts first, rows with the same key stand in the order of
their digests, equal rows are leaves of their own. A null group is a group and
stands first. A null or an empty text has a digest of its own. A table without rows
has an empty manifest. Columns that are not named take no part, whatever their
names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import scratch_table, table
from seqlens.operators.sequence import sequence

#: Children of a node.
FANOUT = 16
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenation; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def framed(column: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*[framed(c) for c in columns])


def _slots(payload: Column, fanout: int) -> list[Column]:
    return [F.max(F.when(F.col("slot") == j, payload)).alias(f"c{j}") for j in range(fanout)]


def _pivoted(nodes: DataFrame, fanout: int, extra: list[str], name: str) -> DataFrame:
    """Nodes ``grp, i, n, h, *extra`` of groups with more than one -> a row for
    each parent: ``grp, i, n`` (parent's place, parents in the group), the
    children as structs ``c0 ..`` and the parent's digest ``h``."""
    placed = nodes.where("n > 1").withColumns({"slot": F.col("i") % fanout, "i": F.floor(F.col("i") / fanout),
                                               "n": F.ceil(F.col("n") / fanout)})
    wide = placed.groupBy("grp", "i", "n").agg(*_slots(F.struct("h", *extra), fanout))
    return scratch_table(wide.withColumn("h", digest(*[F.col(f"c{j}.h") for j in range(fanout)])), name)


def build_levels(leaves: DataFrame, fanout: int = FANOUT, extra: list[str] | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Leaves ``grp, i, n, h, *extra`` (place in the group, size of the group) ->
    the pivoted levels, lowest first, and the groups' top nodes ``grp, h``."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops, nodes, extra = [], [], leaves, extra or []
    while most > 1:
        tops.append(nodes.where("n = 1").select("grp", "h"))
        levels.append(_pivoted(nodes, fanout, extra, f"level-{len(levels)}"))
        nodes, extra, most = levels[-1].select("grp", "i", "n", "h"), [], -(-most // fanout)
    tops.append(nodes.where("n = 1").select("grp", "h"))
    return levels, reduce(DataFrame.unionAll, tops)


def _children(level: DataFrame, parents: DataFrame, fanout: int, extra: list[str]) -> DataFrame:
    """The children of a level with their paths: ``grp, i, h, *extra, path``, own
    siblings first. ``parents``: ``grp, i, path`` of the level above."""
    columns = [f"c{j}" for j in range(fanout)]
    wide = level.join(parents, ["grp", "i"]).select("grp", "i", "path", F.array(*[f"{c}.h" for c in columns]).alias("hs"),
                                                    F.posexplode(F.array(*columns)).alias("slot", "c")).where("c is not null")
    own = F.array(F.struct(F.array_join(F.slice("hs", 1, F.col("slot")), "").alias("left"),
                           F.array_join(F.slice("hs", F.col("slot") + 2, fanout), "").alias("right")))
    return wide.select("grp", (F.col("i") * fanout + F.col("slot")).alias("i"), F.col("c.h").alias("h"),
                       *[F.col(f"c.{x}").alias(x) for x in extra], F.concat(own, "path").alias("path"))


def leaf_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT,
               extra: list[str] | None = None) -> DataFrame:
    """Every leaf with its path (array of the concatenated siblings left and right
    of it, level by level). ``tops``: ``grp, path`` of the groups' top nodes."""
    extra = extra or []
    top = tops.select("grp", F.lit(0).cast("bigint").alias("i"), "path")
    paths = top  # of the nodes of the level above
    for k in range(len(levels) - 1, -1, -1):
        own = extra if k == 0 else []
        parents = levels[k].where("n = 1").select("grp", "i").join(top, ["grp", "i"])
        if k < len(levels) - 1:
            parents = parents.unionAll(paths.select("grp", "i", "path"))
        paths = _children(levels[k], parents, fanout, own)
        if k:
            paths = scratch_table(paths, f"paths-{k}")
    single = leaves.where("n = 1").select("grp", "i", "h", *extra).join(tops.select("grp", "path"), "grp")
    single = single.select("grp", "i", "h", *extra, "path")
    return single.unionAll(paths.select(single.columns)) if levels else single


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p.left, p.right)), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with its siblings."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p.left, h, p.right), 256))


def manifest(rows: DataFrame, group: str, key: str, columns: list[str], tampered: dict[str, Column] | None = None,
             where: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """``key, leaf, subroot, root, path, folded_root`` of every row. The rows where
    ``where`` holds are folded from the digest of the ``tampered`` columns instead
    of their own, which shows whether the manifest notices the change."""
    changed = [(tampered or {}).get(c, F.col(c)) for c in columns]
    alter = F.when(F.lit(False) if where is None else where, leaf_digest(changed))
    grp = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = scratch_table(rows.select(grp.alias("grp"), F.col(key).alias("k"),
                                       leaf_digest([F.col(c) for c in columns]).alias("h"), alter.alias("other")), "leaves")
    placed = sequence(leaves, "grp", ["k", "h"], ["other"], ordinal="place", total="n")
    extra = ["k", "other"]
    placed = scratch_table(placed.select("grp", (F.col("place") - 1).alias("i"), "n", "h", *extra), "placed")
    levels, subroots = build_levels(placed, fanout, extra)
    subroots = scratch_table(subroots, "subroots")
    # the subroots are the leaves of one more tree, whose single group is all of them
    all_groups = sequence(subroots.select(F.lit("").alias("all"), "grp", "h"), "all", ["grp"], ["h"], ordinal="place", total="n")
    crowns = scratch_table(all_groups.select(F.col("all").alias("grp"), (F.col("place") - 1).alias("i"), "n", "h",
                                             F.col("grp").alias("of")), "crowns")
    upper, top = build_levels(crowns, fanout, ["of"])
    root = top.first()
    to_root = leaf_paths(crowns, upper, top.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path")),
                         fanout, ["of"])
    to_root = scratch_table(to_root.select(F.col("of").alias("grp"), F.col("h").alias("subroot"), "path"), "to-root")
    out = leaf_paths(placed, levels, to_root.select("grp", "path"), fanout, extra).join(to_root.select("grp", "subroot"), "grp")
    return out.select(F.col("k").alias(key), F.col("h").alias("leaf"), "subroot",
                      F.lit(root.h if root else None).cast("string").alias("root"), "path",
                      fold(F.coalesce("other", "h"), F.col("path")).alias("folded_root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, folded anew with the texts of every fifth
    document (by the checksum of its id) in lower case."""
    documents = table(spark, sf_dir, "documents").select(*LEAF_COLUMNS)
    proofs = manifest(documents, "source", "doc_id", LEAF_COLUMNS,
                      tampered={"text": F.translate("text", UPPER, UPPER.lower())},
                      where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
