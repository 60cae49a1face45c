"""Hash-tree digests over sorted keys: SHA-256 leaves, parent = SHA-256 of both hex digests, an odd node pairs with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha
from ..runtime import discard, materialize, scratch

#: Levels that one shuffle climbs: groups of 2**LEVELS nodes are reduced inside one row.
LEVELS = 10
_ROW_BITS = 33


def leaves(keys: DataFrame, leaf: Column | None = None) -> DataFrame:
    """``i, h`` in key order. Keys are range-partitioned; an index is its partition's offset plus its place there."""
    spark = keys.sparkSession
    sorted_ = keys.select("key", (sha("key") if leaf is None else leaf).alias("h")).repartitionByRange("key").sortWithinPartitions("key")
    placed = materialize(sorted_.select("h", F.monotonically_increasing_id().alias("m")), "leaves")
    part = F.shiftright("m", _ROW_BITS)
    offsets, at = [], 0
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row per partition
        offsets.append((r["p"], at))
        at += r["count"]
    table = spark.createDataFrame(offsets, "p long, at long")
    return placed.withColumn("p", part).join(F.broadcast(table), "p").select((F.col("at") + F.col("m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("i"), "h")


def _climb(nodes: Column, levels: int) -> Column:
    """The nodes ``levels`` levels up of an array of neighbouring nodes."""

    def up(a: Column, _: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: sha(F.concat(F.get(a, i * 2), F.coalesce(F.get(a, i * 2 + 1), F.get(a, i * 2)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), nodes, up) if levels else nodes


def root(keys: DataFrame, leaf: Column | None = None) -> DataFrame:
    """``root`` of the tree; no row for no keys."""
    with scratch(keys.sparkSession) as kept:
        level = materialize(leaves(keys, leaf), "level")
        kept.append(level)
    n = level.count()
    while n > 1:
        steps = LEVELS if n > 1 << LEVELS else (n - 1).bit_length()
        group = F.shiftright("i", steps)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])  # at most 2**LEVELS
        grouped = level.groupBy(group.alias("g")).agg(ordered.alias("a"))
        above = materialize(grouped.select(F.col("g").alias("i"), F.get(_climb(F.col("a"), steps), 0).alias("h")), "level")
        discard(level)
        level, n = above, -(-n // (1 << steps))
    return level.select(F.col("h").alias("root"))


def compare(a: DataFrame, b: DataFrame, leaf: Column | None = None) -> DataFrame:
    """One row: both roots (null for no keys), ``equal`` (empty trees are equal to empty ones only), and ``skip``.

    Anti-entropy skips a peer where the roots are equal or either tree is empty.
    """
    mine, theirs = (root(keys, leaf).agg(F.max("root").alias("root")) for keys in (a, b))  # one row each
    both = mine.select(F.col("root").alias("mine"), theirs.scalar().alias("theirs")).withColumn("equal", F.col("mine").eqNullSafe(F.col("theirs")))
    return both.withColumn("skip", F.col("equal") | F.col("mine").isNull() | F.col("theirs").isNull())


def equal(a: DataFrame, b: DataFrame, leaf: Column | None = None) -> bool:
    """Are both trees the same? Empty trees are equal only to empty ones."""
    return compare(a, b, leaf).first()["equal"]
