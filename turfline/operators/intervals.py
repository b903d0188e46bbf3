"""Overlapping and gapped intervals by a sweep line.

Every interval becomes a plus event at its start and a minus event at its end. Events of one
instant are netted before they are shuffled, a prefix sum gives the number of active intervals,
and the instants where it leaves or reaches zero bound the covered periods and the gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.text import clock_seconds

T, D = "__t", "__d"


def sweep(intervals: DataFrame, keys: Sequence[str], start: str, end: str, bucket: float | None = None) -> DataFrame:
    """One row per instant at which the number of active intervals changes.

    Columns: the keys, ``at``, ``active`` (from ``at`` on), ``period_start`` (start of the covered period that ``at``
    belongs to) and ``previous_end`` (end of the covered period before it, null for the first).

    Rows with a null key are a group of their own; rows with a null bound, or whose end does not exceed their start,
    take no part; equal intervals count once; extra columns are ignored; an empty input gives no row. Without ``bucket``
    one window per key is used, right where a key has a bounded number of distinct instants. With ``bucket``, the width
    of a time slice, a key of any size is spread: prefix sums run per slice and slices pass on their totals.
    """
    keys = list(keys)
    rows = intervals.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"))
    rows = rows.filter(F.col("__e") > F.col("__s")).distinct()
    events = (
        rows.select(*keys, F.explode(F.array(F.struct(F.col("__s").alias(T), F.lit(1).alias(D)), F.struct(F.col("__e").alias(T), F.lit(-1).alias(D)))).alias("__x"))
        .select(*keys, f"__x.{T}", f"__x.{D}")
        .groupBy(*keys, T)
        .agg(F.sum(D).alias(D))
        .filter(F.col(D) != 0)
    )
    starts = F.when((F.col("active") - F.col(D) == 0), F.col(T))
    ends = F.when(F.col("active") == 0, F.col(T))
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(T)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        out = events.withColumn("active", F.sum(D).over(upto)).select(
            *keys, F.col(T).alias("at"), "active",
            F.last(starts, True).over(upto).alias("period_start"), F.last(ends, True).over(before).alias("previous_end"),
        )
        return out

    events = events.withColumn("__b", F.floor(F.col(T) / F.lit(bucket)))
    slices = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy(*keys, "__b").orderBy(T)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)

    def equal(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.select(*[F.col(c).alias(f"__r_{c}" if c in [*keys, "__b"] else c) for c in right.columns])
        on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in [*keys, "__b"]]
        return left.join(named, on).drop(*[f"__r_{c}" for c in [*keys, "__b"]])

    totals = events.groupBy(*keys, "__b").agg(F.sum(D).alias("__total"))
    totals = totals.withColumn("__carry", F.coalesce(F.sum("__total").over(slices), F.lit(0))).drop("__total")
    active = equal(events, totals).withColumn("active", F.col("__carry") + F.sum(D).over(upto))
    marks = active.groupBy(*keys, "__b").agg(F.max(starts).alias("__ls"), F.max(ends).alias("__le"))
    marks = marks.select(*keys, "__b", F.last("__ls", True).over(slices).alias("__cs"), F.last("__le", True).over(slices).alias("__ce"))
    return equal(active, marks).select(
        *keys, F.col(T).alias("at"), "active",
        F.coalesce(F.last(starts, True).over(upto), "__cs").alias("period_start"),
        F.coalesce(F.last(ends, True).over(before), "__ce").alias("previous_end"),
    )


def covered_periods(swept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Continuous periods of ``sweep``: keys, ``period_start``, ``period_end``, ``most_active``."""
    return swept.groupBy(*keys, "period_start").agg(F.max("at").alias("period_end"), F.max("active").alias("most_active"))


def gaps(swept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Times between consecutive covered periods: keys, ``gap_start``, ``gap_end``."""
    return swept.filter((F.col("at") == F.col("period_start")) & F.col("previous_end").isNotNull()).select(
        *keys, F.col("previous_end").alias("gap_start"), F.col("at").alias("gap_end")
    )


def stint_seconds(lineups: DataFrame, matches: DataFrame) -> DataFrame:
    """Stints of ``lineups.positions`` in whole seconds played since kick-off: match_id, player_id, start_s, end_s.

    A missing ``from_period`` is 1, a missing or unreadable ``from`` the start of its period. A stint lasts to the end of
    the last period up to 4 if ``to`` or ``to_period`` is missing, or ``to_period`` precedes ``from_period`` or follows
    that last period. Stints that start in period 5, or in a period the match doesn't have, don't count. Null and empty
    position lists, and rows of unknown matches, give nothing.
    """
    second = lambda x: F.round(x * 60).cast("int")
    periods = F.array_sort(F.filter(F.map_keys("period_end"), lambda k: k <= 4))
    length = lambda k: second(F.col("period_end")[k]) - second(F.col("period_start")[k])
    clocks = matches.select(
        "match_id",
        F.transform_values("period_start", lambda _, v: second(v)).alias("__clock"),
        F.map_from_arrays(
            periods, F.transform(periods, lambda p: F.aggregate(F.filter(periods, lambda k: k < p), F.lit(0), lambda a, k: a + length(k)))
        ).alias("__before"),
        F.aggregate(periods, F.lit(0), lambda a, k: a + length(k)).alias("__whole"),
        F.array_max(periods).alias("__last"),
    )
    stints = lineups.select("match_id", "player_id", F.explode("positions").alias("__p")).select(
        "match_id", "player_id",
        F.coalesce(F.col("__p.from_period"), F.lit(1)).alias("__fp"), F.col("__p.to_period").alias("__tp"),
        clock_seconds(F.col("__p.from")).alias("__from"), clock_seconds(F.col("__p.to")).alias("__to"),
    )
    played = lambda clock, period: F.col("__before")[period] + clock - F.col("__clock")[period]
    fp, tp = F.col("__fp"), F.col("__tp")
    open_end = F.col("__to").isNull() | tp.isNull() | (tp < fp) | (tp > F.col("__last"))
    return stints.filter(fp < 5).distinct().join(clocks, "match_id").select(
        "match_id", "player_id",
        F.when(F.col("__from").isNull(), F.col("__before")[fp]).otherwise(played(F.col("__from"), fp)).alias("start_s"),
        F.when(open_end, F.col("__whole")).otherwise(played(F.col("__to"), tp)).alias("end_s"),
    )


def merged_and_gaps(lineups: DataFrame, matches: DataFrame) -> DataFrame:
    """Merged continuous times and the gaps between continuous times per match and player.

    Columns match_id, player_id, kind (``merged``: a continuous time in which two stints share more than 0 seconds;
    ``gap``), start_s, end_s. A match lasts at most a few thousand seconds, so a key has a bounded number of instants
    however many rows it holds: equal stints and equal instants are combined before the shuffle.
    """
    keys = ["match_id", "player_id"]
    swept = sweep(stint_seconds(lineups, matches), keys, "start_s", "end_s")
    # both results come from one pass over the swept instants
    first = F.col("at") == F.col("period_start")
    by_period = swept.groupBy(*keys, "period_start").agg(
        F.max("at").alias("__end"), F.max("active").alias("__most"), F.max(F.when(first, F.col("previous_end"))).alias("__gap")
    )
    kinds = F.array(
        F.struct(F.lit("merged").alias("kind"), F.col("period_start").alias("start_s"), F.col("__end").alias("end_s"), (F.col("__most") >= 2).alias("is")),
        F.struct(F.lit("gap").alias("kind"), F.col("__gap").alias("start_s"), F.col("period_start").alias("end_s"), F.col("__gap").isNotNull().alias("is")),
    )
    out = by_period.select(*keys, F.explode(kinds).alias("__k")).filter("__k.is")
    return out.select(*keys, "__k.kind", F.col("__k.start_s").cast("int").alias("start_s"), F.col("__k.end_s").cast("int").alias("end_s"))
