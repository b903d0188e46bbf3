"""Connected components by alternating stars, and the groups of rows that share an external id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.session import cut, shuffled

# Spellings that stand for "no id" or "not known", after trimming and lower-casing.
NOBODY = ["n/a", "na", "n/k", "nk", "tbc", "tbd", "unknown", "none", "null", "nan", "nil", "missing", "x", "xx", "xxx"]


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node with an edge to another.

    Alternates large and small stars until the edges stop changing, which takes a number of rounds logarithmic in the
    longest chain. Minima are combined before the shuffle, so a hub of any degree stays cheap, and each round is cut
    into the shared checkpoint folder. Null ends and loops are ignored; no edges give no rows.
    """
    e = cut(
        edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(least), "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").filter("u > v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def identifies(text: Column) -> Column:
    """Whether an id, trimmed and lower-cased, identifies somebody: it has a letter or digit other than 0 and is no filler."""
    return text.rlike("[1-9a-z]") & ~text.isin(NOBODY)


def id_groups(rows: DataFrame, row: str = "player_id", ids: str = "source_ids") -> DataFrame:
    """``node`` and ``component`` of rows linked, directly or through others, by the same id of the same source.

    Case and outer spaces of ids don't matter; null maps, null ids and ids that identify nobody link nothing.
    """
    each = rows.select(F.col(row).alias("n"), F.explode(ids).alias("source", "id")).select("n", "source", F.lower(F.trim("id")).alias("id"))
    each = each.filter(identifies(F.col("id")) & F.col("n").isNotNull()).distinct()
    first = each.groupBy("source", "id").agg(F.min("n").alias("first"), F.max("n").alias("last")).filter("first < last").drop("last")
    return components(each.join(shuffled(first), ["source", "id"]), "n", "first")
