"""A stated set of query rows against all rows of a table, in pairs of blocks of bounded size.

Neither side is broadcast or collected: each block of one side meets each block of the other in one task, whatever the
sizes. A comparison keeps only what may be among the best of its block, so that what is shuffled afterwards is bounded by
queries, blocks and the number asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a block of queries and of the table, and rows of a block of queries that is small.
QUERY_BLOCK, ROW_BLOCK, SMALL_BLOCK = 2_048, 16_384, 128


def in_blocks(queries: DataFrame, rows: DataFrame, query: str, row: str, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``compare(asked, there)`` over all pairs of a block of ``queries`` and a block of ``rows``.

    Blocks are drawn by the hash of the columns ``query`` and ``row``; rows whose one is null take no part. An empty side
    gives no rows. Columns of ``rows`` reach ``compare`` under their own names.
    """
    queries, rows = queries.filter(F.col(query).isNotNull()), rows.filter(F.col(row).isNotNull())
    asked, there = queries.count(), rows.count()
    row_blocks = max(1, -(-there // ROW_BLOCK))
    cores = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    query_blocks = max(1, -(-asked // QUERY_BLOCK), min(-(-cores // row_blocks), -(-asked // SMALL_BLOCK)))
    left = queries.withColumn("__j", F.pmod(F.xxhash64(query), F.lit(query_blocks)).cast("int")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = rows.select(*[F.col(c).alias(f"__r_{c}") for c in rows.columns])
    right = right.withColumn("__ri", F.pmod(F.xxhash64(f"__r_{row}"), F.lit(row_blocks)).cast("int")).withColumn("__rj", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    tasks = min(query_blocks * row_blocks, 4_096)

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame()
        return compare(a.drop(columns=["__i", "__j"]).reset_index(drop=True), b.drop(columns=["__ri", "__rj"]).rename(columns=lambda c: c.removeprefix("__r_")).reset_index(drop=True))

    left, right = left.repartition(tasks, "__i", "__j"), right.repartition(tasks, "__ri", "__rj")
    return left.groupBy("__i", "__j").cogroup(right.groupBy("__ri", "__rj")).applyInPandas(one, schema)


def best_of(found: DataFrame, query: str, order: Sequence, k: int) -> DataFrame:
    """The first k rows of each query over all blocks, with their ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def leading(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest entries of each row, of equal ones the first columns; -inf never counts."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    above, equal = scores > least, scores == least
    places = k - above.sum(axis=1)[:, None]
    return np.nonzero((above | (equal & (np.cumsum(equal, axis=1) <= places))) & (scores > -np.inf))
