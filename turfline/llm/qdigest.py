"""Percentiles of large numeric columns by mergeable dyadic-tree digests with a deterministic rank error.

Values are quantized to a bounded ordered universe of 2**BITS cells. A digest holds counts at nodes of the binary tree
over the universe; compression moves small counts to parents, and no node that is moved holds more than n // k counts, so
the rank of any cell is known to within BITS * (n // k). Digests of slices merge by adding nodes of equal id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.operators.peers import running_counts
from turfline.session import cut

#: The universe: a sign, 128 binary exponents and 256 steps within each.
BITS, EXPONENTS, STEPS = 16, 64, 256
NODE = "node long, count long"


def quantize(value: Column) -> Column:
    """Cell of a double, from 0 to 2**BITS - 1, never decreasing in the value; null and NaN give null.

    The cell keeps sign, binary exponent and the first 8 binary digits: a relative width of 1/256. Magnitudes below
    2**-64 share the cells of zero, those of 2**64 and more the outermost cells.
    """
    v = value.cast("double")
    size = F.least(F.abs(v), F.lit(2.0**EXPONENTS))
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.0 ** -(EXPONENTS + 2)))))
    # the logarithm may miss by one at a power of two; powers of two and divisions by them are exact
    low = F.pow(F.lit(2.0), guess)
    exponent = F.when(low > size, guess - 1).when(low * 2 <= size, guess + 1).otherwise(guess)
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    top = 2 ** (BITS - 1) - 1
    magnitude = F.when(exponent < -EXPONENTS, F.lit(0)).otherwise(F.least((exponent + EXPONENTS) * STEPS + step + 1, F.lit(top)))
    cell = F.when(v < 0, -magnitude - 1).otherwise(magnitude) + 2 ** (BITS - 1)
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(cell, F.lit(0)).cast("int"))


def cell_bounds(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest value of each cell, up to the cell's open end."""
    signed = cells.astype(np.int64) - 2 ** (BITS - 1)
    magnitude = np.where(signed < 0, -signed - 1, signed)
    inner = np.maximum(magnitude - 1, 0)
    low = np.where(magnitude > 0, np.ldexp(1 + (inner % STEPS) / STEPS, inner // STEPS - EXPONENTS), 0.0)
    high = np.where(magnitude > 0, np.ldexp(1 + (inner % STEPS + 1) / STEPS, inner // STEPS - EXPONENTS), 2.0**-EXPONENTS)
    return np.where(signed < 0, -high, low), np.where(signed < 0, -low, high)


def compress(nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (root 1, children 2i and 2i + 1, leaves 2**BITS + cell) with counts moved up where a family is small."""
    limit = counts.sum() // k
    depth = np.floor(np.log2(nodes)).astype(int)
    for level in range(BITS, 0, -1):
        at = depth == level
        if not at.any():
            continue
        parents, where = np.unique(nodes[at] >> 1, return_inverse=True)
        order = np.argsort(nodes)
        place = order[np.minimum(np.searchsorted(nodes, parents, sorter=order), len(nodes) - 1)]
        own = np.where(nodes[place] == parents, counts[place], 0)
        family = np.bincount(where, counts[at], len(parents)).astype(np.int64) + own
        small = family <= limit
        gone = np.isin(nodes, parents[small]) | (at & np.isin(nodes >> 1, parents[small]))
        nodes = np.concatenate([nodes[~gone], parents[small]])
        counts = np.concatenate([counts[~gone], family[small]])
        depth = np.floor(np.log2(nodes)).astype(int)
    order = np.argsort(nodes)
    return nodes[order], counts[order]


def spans(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last cell below each node."""
    height = BITS - np.floor(np.log2(nodes)).astype(np.int64)
    first = (nodes << height) - 2**BITS
    return first, first + (np.int64(1) << height) - 1


def below(nodes: np.ndarray, counts: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts surely below each cell, and counts possibly below it or in it."""
    first, last = spans(nodes)
    by_last, by_first = np.argsort(last), np.argsort(first)
    total = lambda order: np.concatenate([[0], np.cumsum(counts[order])])
    sure = total(by_last)[np.searchsorted(last[by_last], cells, "left")]
    possible = total(by_first)[np.searchsorted(first[by_first], cells, "right")]
    return sure, possible


def cell_counts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys, ``cell`` and ``count``: at most 2**BITS rows a key, counted before the shuffle. Null and NaN count nowhere."""
    return rows.select(*keys, quantize(F.col(value)).alias("cell")).filter("cell is not null").groupBy(*keys, "cell").agg(F.count("*").alias("count"))


def digests(rows: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Digest of ``value`` per key: keys, ``node``, ``count``. Null keys are a group; an empty table gives no rows.

    ``k`` is the compression: the rank error is at most ``BITS * (n // k)`` and a digest holds at most about 3 k nodes.
    """
    leaves = cell_counts(rows, keys, value).select(*keys, (F.col("cell") + 2**BITS).cast("long").alias("node"), "count")
    return compressed(leaves, keys, k)


def compressed(nodes: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Compress per key; a key has at most 2**(BITS + 1) nodes, whatever the number of rows behind them."""
    keys = list(keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in keys), NODE])

    columns = [c for c in nodes.columns if c in keys]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        node, count = compress(group["node"].to_numpy(), group["count"].to_numpy(), k)
        return pd.DataFrame({**{c: pd.Series([group[c].iloc[0]] * len(node), dtype=group[c].dtype) for c in columns}, "node": node, "count": count})

    return nodes.select(*keys, "node", "count").groupBy(*keys).applyInPandas(one, schema)


def merge(parts: Sequence[DataFrame], keys: Sequence[str], k: int) -> DataFrame:
    """Digests of slices as one: counts of equal nodes are added, then compressed. The rank errors of the parts add up to
    at most that of the whole."""
    both = parts[0].select(*keys, "node", "count")
    for part in parts[1:]:
        both = both.unionByName(part.select(*keys, "node", "count"))
    return compressed(both.groupBy(*keys, "node").agg(F.sum("count").alias("count")), keys, k)


def quantiles(digest: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Keys, ``probability``, ``estimate``, ``low``, ``high``, ``rank_error``, ``n``: the value of rank ceil(p n) lies
    in [low, high], and ``rank_error`` rows are those the digest can't place below or above the estimate's cell."""
    keys = list(keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in digest.schema if f.name in keys), "probability double, estimate double, low double, high double, rank_error long, n long"])
    columns = [c for c in digest.columns if c in keys]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        node, count = group["node"].to_numpy(), group["count"].to_numpy()
        n = int(count.sum())
        rank = np.maximum(np.ceil(np.array(probabilities) * n - 1e-9), 1)
        first, last = spans(node)
        cells = np.unique(np.concatenate([first, last]))
        sure, _ = below(node, count, cells + 1)
        _, possible = below(node, count, cells)
        lowest = cells[np.minimum(np.searchsorted(possible, rank, "left"), len(cells) - 1)]
        highest = cells[np.minimum(np.searchsorted(sure, rank, "left"), len(cells) - 1)]
        by = np.lexsort((first, last))
        middle = last[by][np.minimum(np.searchsorted(np.cumsum(count[by]), rank, "left"), len(by) - 1)]
        low, high = cell_bounds(lowest)[0], cell_bounds(highest)[1]
        estimate = np.clip(sum(cell_bounds(middle)) / 2, low, high)
        # counts at inner nodes over the cell are all that the digest doesn't place
        over = (first[None, :] <= middle[:, None]) & (middle[:, None] <= last[None, :]) & (first < last)[None, :]
        error = (over * count[None, :]).sum(axis=1)
        out = pd.DataFrame({"probability": list(probabilities), "estimate": estimate, "low": low, "high": high, "rank_error": error, "n": n})
        for c in reversed(columns):
            out.insert(0, c, pd.Series([group[c].iloc[0]] * len(out), dtype=group[c].dtype))
        return out

    return digest.select(*keys, "node", "count").groupBy(*keys).applyInPandas(one, schema)


def rank_bounds(rows: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """Keys, ``cell``, ``before``, ``below``, ``upto``, ``n``: of each cell of ``value``, by the digest, the count that is
    surely below the cell and the most that may be below or in it; any rank in the cell lies between. ``before`` is the
    exact count below the cell, for an exact check that follows."""
    keys = list(keys)
    cells = cell_counts(rows, keys, value)
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), "cell int, before long, below long, upto long, n long"])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        cell, count = group["cell"].to_numpy().astype(np.int64), group["count"].to_numpy()
        node, weight = compress(cell + 2**BITS, count, k)
        sure, possible = below(node, weight, cell)
        order = np.argsort(cell)
        before = np.empty(len(cell), np.int64)
        before[order] = np.cumsum(count[order]) - count[order]
        out = group[[*keys, "cell"]].copy()
        out["before"], out["below"], out["upto"], out["n"] = before, sure, possible, int(count.sum())
        return out

    return cells.groupBy(*keys).applyInPandas(one, schema)


def compression(tolerance: float) -> int:
    """The k whose rank error is at most half of ``tolerance`` percent of the rows: small enough that groups larger than k are
    compressed, and tight enough that most rows are decided by their bounds."""
    return math.ceil(200 * BITS / tolerance)


def misranked(
    rows: DataFrame, keys: Sequence[str], value: str, stored: str, lower_is_better: Column, tolerance: float = 10.0, k: int | None = None
) -> DataFrame:
    """Rows whose stored percentile differs by more than ``tolerance`` from their percentile among the rows of their keys.

    The percentile is the average rank (ties share it, worst value first) by the number of rows, times 100. Repeated rows
    count once; rows with null or NaN value count nowhere; a null stored percentile is no difference. The digest, of ``k``
    (by default ``compression`` of the tolerance), bounds every rank; a row whose bounds decide is taken or left, and only
    rows in between are ranked exactly, within their cell, whose values are pre-counted. Columns of ``rows`` are kept.
    """
    decided, exact = judged_ranks(rows, keys, value, stored, lower_is_better, tolerance, k or compression(tolerance))
    return decided.filter("__sure").select(*rows.columns).unionByName(exact.select(*rows.columns))


def judged_ranks(rows: DataFrame, keys: Sequence[str], value: str, stored: str, lower_is_better: Column, tolerance: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may be off, ``__sure`` being those the digest's bounds decide, and of the others those that are off, ranked
    exactly. Rows that are surely within the tolerance are in neither."""
    keys = list(keys)
    counted = cut(rows.distinct().filter(F.col(value).isNotNull() & ~F.isnan(value)))  # read for cells, rows and values
    renamed = [F.col(c).alias(f"__{c}") for c in keys]
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    bounds = rank_bounds(counted, keys, value, k).select(
        *renamed, F.col("cell").alias("__c"), F.col("before").alias("__before"), F.col("below").alias("__below"), F.col("upto").alias("__upto"), F.col("n").alias("__n")
    )
    judged = counted.filter(F.col(stored).isNotNull()).withColumn("__cell", quantize(F.col(value)))
    percent = lambda rank: F.when(lower_is_better, F.col("__n") + 1 - rank).otherwise(rank) * 100.0 / F.col("__n")
    ends = [percent(F.col("__below") + 1), percent(F.col("__upto"))]
    off = F.col(stored).cast("double")
    wide = judged.join(bounds, [*same, F.col("__cell") == F.col("__c")])
    wide = wide.filter(F.greatest(*[F.abs(off - e) for e in ends]) > tolerance)  # all others are surely within
    inside = off.between(F.least(*ends), F.greatest(*ends))
    sure = ~inside & (F.least(*[F.abs(off - e) for e in ends]) > tolerance)
    wide = cut(wide.withColumn("__sure", sure))  # read for the decided rows, the open ones and their cells: digests are made once
    open_rows = wide.filter("not __sure")
    cells = open_rows.select(*renamed, F.col("__c").alias("__k")).distinct()
    values = (
        counted.withColumn("__cell", quantize(F.col(value))).join(cells, [*same, F.col("__cell") == F.col("__k")], "left_semi")
        .groupBy(*keys, "__cell", value).agg(F.count("*").alias("__eq"))
        .withColumn("__less", F.sum("__eq").over(Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__eq"))
        .select(*[F.col(c).alias(f"__v_{c}") for c in keys], F.col(value).alias("__v"), "__eq", "__less")
    )
    on = [F.col(c).eqNullSafe(F.col(f"__v_{c}")) for c in keys]
    rank = F.col("__before") + F.col("__less") + (F.col("__eq") + 1) / 2
    return wide, open_rows.join(values, [*on, F.col(value) == F.col("__v")]).filter(F.abs(off - percent(rank)) > tolerance)


def checked_quantiles(rows: DataFrame, digest: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """``quantiles`` of the digest beside the exact ones: ``exact``, whether it lies ``inside`` [low, high], and whether the
    estimate's ``rank_off``, its distance in rows from the rank asked for, keeps to the rank error and the rows of its cell.
    """
    keys = list(keys)
    counts = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("__eq"))
    ranks = running_counts(counts.withColumn(value, F.col(value) + 0.0).groupBy(*keys, value).agg(F.sum("__eq").alias("__eq")), keys, value, "__eq")
    wanted = ranks.withColumn("probability", F.explode(F.array(*[F.lit(p) for p in probabilities])))
    wanted = wanted.withColumn("__rank", F.greatest(F.ceil(F.col("probability") * F.col("__all") - 1e-9), F.lit(1)))
    exact = wanted.filter(F.col("__upto") >= F.col("__rank")).groupBy(*keys, "probability").agg(F.min(value).alias("exact"), F.max("__rank").alias("__rank"))
    renamed = exact.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("probability").alias("__p"), "exact", "__rank")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    both = quantiles(digest, keys, probabilities).join(renamed, [*on, F.col("probability") == F.col("__p")])
    # rows surely below and possibly up to the cell of the estimate
    cells = ranks.select(*[F.col(c).alias(f"__r_{c}") for c in keys], quantize(F.col(value)).alias("__cell"), "__eq", "__upto")
    cells = cells.groupBy(*[f"__r_{c}" for c in keys], "__cell").agg(F.min(F.col("__upto") - F.col("__eq")).alias("__below"), F.max("__upto").alias("__to"))
    near = both.join(cells, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys]).withColumn("__e", quantize(F.col("estimate")))
    below = F.max(F.when(F.col("__cell") < F.col("__e"), F.col("__to")).otherwise(0))
    upto = F.max(F.when(F.col("__cell") <= F.col("__e"), F.col("__to")).otherwise(0))
    out = near.groupBy(*keys, "probability", "estimate", "low", "high", "rank_error", "n", "exact", "__rank").agg(below.alias("__below"), upto.alias("__to"))
    off = F.greatest(F.col("__below") + 1 - F.col("__rank"), F.col("__rank") - F.col("__to"), F.lit(0))
    return out.select(*keys, "probability", "n", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("inside"), "rank_error", off.cast("long").alias("rank_off"))
