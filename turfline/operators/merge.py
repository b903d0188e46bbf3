"""Upserts on immutable tables: the merged table is computed as a whole and committed (``sources.store``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.scalars import merged_maps
from turfline.session import cut


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], update: Sequence[str], maps: Sequence[str] = (), keep_known: bool = False) -> DataFrame:
    """``old`` with the rows of ``new``: on equal keys the columns ``update`` are replaced and ``maps`` merged, other rows are added.

    ``new`` must hold each key once. Values become null where the new ones are, unless ``keep_known``. Columns that
    ``new`` lacks are null in added rows. One full outer join on the key.
    """
    key = list(key)
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns], F.lit(True).alias("__new"))
    o = old.withColumn("__old", F.lit(True))
    joined = o.join(n, [F.col(k) == F.col(f"__n_{k}") for k in key], "full_outer")
    hit, added = F.col("__old") & F.col("__new"), F.col("__old").isNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        fresh = F.col(f"__n_{c}")
        if c in maps:
            return F.when(hit, merged_maps(F.col(c), fresh)).when(added, fresh).otherwise(F.col(c))
        if c in update:
            return F.when(hit, F.coalesce(fresh, F.col(c)) if keep_known else fresh).when(added, fresh).otherwise(F.col(c))
        return F.when(added, fresh).otherwise(F.col(c))

    return joined.select(*[value(c).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it doesn't hold; a key repeated in ``new`` is added once, its smallest row."""
    rest = [c for c in old.columns if c not in key]
    once = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, "__r.*") if rest else new.select(*key).distinct()
    return old.unionByName(once.join(old.select(*key), list(key), "left_anti").select(*old.columns))


def once(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; of equal ones any."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__r"))
    return first.select(*key, "__r.*").select(*rows.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents in ``gone`` and their children."""
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids.select(F.col(key).alias(child_key)), child_key, "left_anti")


def first_match(rows: DataFrame, targets: DataFrame, keys: Sequence[Mapping[str, str]], row: str, target: str) -> DataFrame:
    """``row`` and the ``target`` it matches by the first set of equal columns that finds one (row column to target column).

    A disjunction of keys as one equi-join each instead of a nested loop; of several targets the smallest counts.
    """
    out = rows.select(row, *sorted({c for k in keys for c in k}))
    for i, on in enumerate(keys):
        side = targets.select(F.col(target).alias(f"__t{i}"), *[F.col(t).alias(f"__k{i}_{r}") for r, t in on.items()])
        side = side.groupBy(*[f"__k{i}_{r}" for r in on]).agg(F.min(f"__t{i}").alias(f"__t{i}"))
        out = out.join(side, [F.col(r) == F.col(f"__k{i}_{r}") for r in on], "left")
    return out.select(row, F.coalesce(*[f"__t{i}" for i in range(len(keys))]).alias(target))


def with_ids(new: DataFrame, old: DataFrame, order: Sequence[str], column: str = "id") -> DataFrame:
    """New rows with ids that follow the largest old one, in the given order.

    Numbers are given per sorted range of rows: only one count per range is gathered, no single task sees all rows.
    """
    start = old.agg(F.coalesce(F.max(column), F.lit(0)).alias("m")).first()["m"]
    parts = cut(new.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))  # ranges are drawn once
    sizes = {r["__p"]: r["n"] for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, start + before))
        before += sizes[p]
    shift = F.broadcast(new.sparkSession.createDataFrame(offsets or [(-1, 0)], "__p int, __o long"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.withColumn("__n", place).join(shift, "__p").withColumn(column, (F.col("__o") + F.col("__n")).cast("int")).drop("__p", "__n", "__o")
