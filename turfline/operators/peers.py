"""Peer groups over neighbouring seasons and tie-averaged percentiles in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.scalars import percentile_of, season_year
from turfline.registry import LOWER_IS_BETTER, MIN_MINUTES, POSITION_LABELS, SEASON_SPAN
from turfline.session import cut

#: Values of a group that one task ranks, about, and most ranges of a group.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 1_000


def one_row_each(stats: DataFrame) -> DataFrame:
    """Long metrics with one row per player, season, position, tier and metric: several clubs are weighted by minutes.

    ``stats``: player_id, season, position_group, tier, minutes, metrics. Null and NaN values give no row.
    """
    long = stats.select("player_id", "season", "position_group", "tier", "minutes", F.explode("metrics").alias("metric", "value"))
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("value", F.col("value") + 0.0)  # no negative zero
    one = F.count("*") == 1
    return long.groupBy("player_id", "season", "position_group", "tier", "metric").agg(
        F.when(one, F.first("value")).otherwise(F.round(F.sum(F.col("value") * F.col("minutes")) / F.sum("minutes"), 6)).alias("raw_value")
    )


def centred(rows: DataFrame, span: int = SEASON_SPAN) -> DataFrame:
    """Every row once per peer group it belongs to: ``centre`` is the season in the middle of the group.

    The band |year - centre| <= span is an equi-join: a row is repeated for the 2 span + 1 years it reaches and joined with
    the seasons that exist for its position and tier.
    """
    seasons = rows.select("position_group", "tier", F.col("season").alias("centre"), season_year(F.col("season")).alias("__y")).distinct()
    reach = rows.withColumn("__y", F.explode(F.sequence(season_year(F.col("season")) - span, season_year(F.col("season")) + span)))
    return reach.join(seasons, ["position_group", "tier", "__y"]).drop("__y")


def group_id() -> Column:
    return F.concat_ws("|", F.col("position_group"), F.concat(F.lit("tier"), F.col("tier").cast("string")), F.col("centre"))


def label() -> Column:
    labels = F.create_map(*[F.lit(x) for pair in POSITION_LABELS.items() for x in pair])
    return F.concat(labels[F.col("position_group")], F.lit(" · Niveau "), F.col("tier").cast("string"), F.lit(" · "), F.col("centre"))


def peer_groups(stats: DataFrame, min_minutes: int = MIN_MINUTES, span: int = SEASON_SPAN) -> DataFrame:
    """Groups with their number of members: peer_group_id, label, position_group, season, min_minutes, sample_size."""
    members = stats.filter(F.col("minutes") >= min_minutes).select("player_id", "season", "position_group", "tier").distinct()
    return centred(members, span).groupBy("position_group", "tier", "centre").agg(F.count("*").cast("int").alias("sample_size")).select(
        group_id().alias("peer_group_id"), label().alias("label"), "position_group", F.col("centre").alias("season"), F.lit(min_minutes).alias("min_minutes"), "sample_size"
    )


def running_counts(values: DataFrame, key: Sequence[str], value: str, count: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``values`` with ``__upto``, the sum of ``count`` up to each value within its key, and ``__all``, the sum of its key.

    A key of any number of values is spread: its values are cut into ranges of about ``bucket_rows`` at approximate quantiles,
    sums run within a range, and only the totals of the at most ``MOST_BUCKETS`` ranges of a key are summed up in one place.
    Null keys are a group; ``value`` must be unique within its key.
    """
    steps = F.array(*[F.lit(i / MOST_BUCKETS) for i in range(1, MOST_BUCKETS)])
    cuts = values.groupBy(*key).agg(F.count("*").alias("__m"), F.percentile_approx(value, steps, F.lit(10 * MOST_BUCKETS)).alias("__cuts"))
    # every so many of the cuts, as few as the number of values needs
    wanted = F.least(F.ceil(F.col("__m") / bucket_rows), F.lit(MOST_BUCKETS))
    keep = F.filter("__cuts", lambda c, i: F.floor((i + 1) * wanted / MOST_BUCKETS) > F.floor(i * wanted / MOST_BUCKETS))
    cuts = cuts.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.array_distinct(keep).alias("__cuts"))
    rows = values.join(cuts, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key]).drop(*[f"__k_{k}" for k in key])
    rows = rows.withColumn("__b", F.aggregate("__cuts", F.lit(0), lambda n, c: n + F.when(c < F.col(value), 1).otherwise(0))).drop("__cuts")
    ranges = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "__b").agg(F.sum(count).alias("__t"))
    totals = totals.select(*[F.col(k).alias(f"__t_{k}") for k in key], F.col("__b").alias("__tb"), F.coalesce(F.sum("__t").over(ranges), F.lit(0)).alias("__before"), F.sum("__t").over(Window.partitionBy(*key)).alias("__all"))
    within = Window.partitionBy(*key, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.sum(count).over(within))
    rows = rows.join(totals, [*[F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in key], F.col("__b") == F.col("__tb")])
    return rows.withColumn("__upto", F.col("__before") + F.col("__in")).select(*values.columns, "__upto", "__all")


def percentiles(stats: DataFrame, min_minutes: int = MIN_MINUTES, span: int = SEASON_SPAN) -> DataFrame:
    """Percentile rows: player_id, season, peer_group_id, metric, raw_value, percentile.

    Equal values are counted before they are ranked (``running_counts``), and the ranks are joined back.
    """
    once = cut(one_row_each(stats.filter(F.col("minutes") >= min_minutes)))  # read for seasons, values and rows
    rows = centred(once, span)
    rows = rows.select("player_id", "season", group_id().alias("peer_group_id"), "metric", "raw_value")
    key = ["peer_group_id", "metric"]
    good = F.when(F.col("metric").isin(LOWER_IS_BETTER), -F.col("raw_value")).otherwise(F.col("raw_value"))
    values = rows.groupBy(*key, "raw_value").agg(F.count("*").alias("eq")).withColumn("good", good)
    counted = running_counts(values, key, "good", "eq")
    rank = F.col("__upto") - F.col("eq") + (F.col("eq") + 1) / 2
    ranked = counted.select(*key, "raw_value", percentile_of(rank, F.col("__all")).alias("percentile"))
    return rows.join(ranked, [*key, "raw_value"]).select("player_id", "season", *key, "raw_value", "percentile")


def own_group(rows: DataFrame) -> DataFrame:
    """Percentiles of the group centred on the row's own season: the one of several that sheets and vectors use."""
    return rows.filter(F.substring_index("peer_group_id", "|", -1) == F.col("season"))


def percentile_map(rows: DataFrame) -> DataFrame:
    """``percentiles`` by metric per player and season; repeated rows count once, of different ones the largest."""
    once = rows.groupBy("player_id", "season", "metric").agg(F.max("percentile").alias("percentile"))
    return once.groupBy("player_id", "season").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "percentile")))).alias("percentiles"))
