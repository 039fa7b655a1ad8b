"""A manifest of a dataset as a tree of digests, built level by level as DataFrames.

Every row is a leaf: the digest of its fields. Leaves of a group (here of a language) are numbered in order by two levels
of row numbers, so no group gathers its rows. A level's nodes go to parents by their index divided by the
fanout, floored; a parent keeps its sorted children's digests, and its own digest is that of their hex texts one
after another. Groups end at their subroots, and the subroots, in order of their groups, are the leaves of a tree of
the same kind, which ends at the root. Then the levels are joined from the top down: a node's path is the digests
beside it in its run, put before its parent's path. So each level is one shuffle up and one join down,
each a `fanout`-th of the level below it; a row's whole path is shipped once.

A leaf is checked by folding it with its path: the result must be the root.

Defined cases: a null field is `-`; null groups come first; null orders come first; rows of equal order follow
each other by their digests (rows equal in all fields are leaves of their own); a lone leaf is its group's subroot; one
group's subroot is the root; an empty table gives no rows; columns that aren't named are ignored, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordered import dense_rank_of
from lectern.session import materialise

#: Levels whose joins follow each other before rows are written.
TOGETHER = 5
_DIGEST = 32


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def _hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def field(value: Column) -> Column:
    """A leaf's field: `-` if null, else the number of its UTF-8 bytes, a colon, and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes above those of groups that still have several: grp, idx, n (the group's nodes on this level), digest, children."""
    runs = level.filter("n > 1").groupBy("grp", F.floor(F.col("idx") / fanout).alias("idx"))
    met = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "digest")))["digest"].alias("digests"), F.max("n").alias("n"))
    text = F.array_join(F.transform("digests", _hex), "")
    return met.select("grp", "idx", F.ceil(F.col("n") / fanout).alias("n"), F.unhex(digest(text)).alias("digest"), F.unhex(text).alias("children"))


def _tree(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels from the leaves (grp, idx, n, digest, ...) up, each written, and the groups' tops: grp, level, top, children."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(materialise(_parents(levels[-1], fanout), "level"))
        most = -(-most // fanout)
    tops = None
    for k, level in enumerate(levels):
        mine = level.filter("n = 1").select("grp", F.lit(k).alias("level"), F.col("digest").alias("top"), (F.col("children") if k else F.lit(None).cast("binary")).alias("children"))
        tops = mine if tops is None else tops.unionByName(mine)
    return levels, materialise(tops, "tops")


def _paths(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves with top and path, from tops (grp, level, top, children, path)."""
    at = (F.pmod("idx", F.lit(fanout)) * _DIGEST).cast("int")
    beside = F.struct(F.substring(F.col("above"), F.lit(1), at).alias("before"), F.substring(F.col("above"), at + _DIGEST + 1, F.lit(fanout * _DIGEST)).alias("after"))
    path = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat(F.array(beside), F.col("path")))
    held = None
    for k in reversed(range(len(levels))):
        mine = tops.filter(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("idx"), "children", "top", "path")
        if not k:
            held = mine if held is None else held.unionByName(mine)
        parents = None if held is None else held.select("grp", F.col("idx").alias("up"), F.col("children").alias("above"), "top", "path")
        if parents is not None:
            level = (levels[k].filter("n > 1") if k else levels[k]).withColumn("up", F.floor(F.col("idx") / fanout) if k else F.when(F.col("n") > 1, F.floor(F.col("idx") / fanout)).otherwise(0))
            held = level.join(parents, ["grp", "up"]).withColumn("path", path).drop("up", "above")
        if k:
            held = mine if held is None else held.select(*mine.columns).unionByName(mine)
            if k % TOGETHER == 0:
                held = materialise(held, "paths")
    return held


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's hex digest and a path lead to."""
    return F.aggregate(path, start, lambda acc, p: digest(F.concat(_hex(p["before"]), acc, _hex(p["after"]))))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(_hex(p["before"]), _hex(p["after"]))), ""))


def manifest(docs: DataFrame, fields: list[str], order: str, group: str, fanout: int = 2, claimed: Column | None = None) -> DataFrame:
    """order, leaf, subroot, root (hex), path (array of struct(before, after), from the leaf to the root) of each row.

    `claimed` is a leaf that is to be checked in a row's place, from the same columns; where it isn't null it comes as hex in `claimed`.
    """
    group_name = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("-"))  # `-` sorts before `v`
    said = docs.select(group_name.alias("grp"), F.col(order).alias("key"), F.unhex(leaf(*[F.col(f) for f in fields])).alias("digest"), F.unhex(F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    rows = materialise(said.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    rows = rows.select("grp", "key", "digest", "claimed", F.struct("key", "digest", "nth").alias("place"))
    levels, tops = _tree(materialise(dense_rank_of(rows, "place", "idx", ["grp"], total="n").drop("place"), "level"), fanout)
    upper = dense_rank_of(tops.select("grp", F.col("top").alias("digest"), "level", "children"), "grp", "idx", total="n")
    upper = materialise(upper.select(F.col("grp").alias("of"), F.lit("").alias("grp"), "idx", "n", "digest", "level", "children"), "level")
    upper_levels, found = _tree(upper.drop("level", "children"), fanout)
    root = found.first()
    if root is None:
        return docs.select(F.col(order), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "claimed")], F.array(F.struct(F.lit(b"").alias("before"), F.lit(b"").alias("after"))).alias("path")).limit(0)
    beside = _paths(upper_levels, found.withColumn("path", F.array().cast("array<struct<before:binary,after:binary>>")), fanout)
    named = materialise(beside.select(F.col("of").alias("grp"), "path").join(tops, "grp"), "subroots")
    out = _paths(levels, named, fanout)
    return out.select(F.col("key").alias(order), _hex(F.col("digest")).alias("leaf"), _hex(F.col("top")).alias("subroot"), F.lit(root["top"].hex()).alias("root"), _hex(F.col("claimed")).alias("claimed"), "path")


def verified(rows: DataFrame) -> DataFrame:
    """`manifest`'s rows with proof_sha256, folded_root (from the claimed leaf, else the row's own) and verified, instead of path and claimed."""
    start = F.coalesce("claimed", "leaf")
    out = rows.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(start, F.col("path"))}).drop("path", "claimed")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
