"""Queries on percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.qdigest import BITS, checked_quantiles, compression, digests, judged_ranks, merge, misranked, quantiles
from turfline.registry import LOWER_IS_BETTER
from turfline.session import table

TOLERANCE = 10.0
#: Compression of the digests, from the tolerance of stored percentiles: a rank error of at most 5 % of the rows.
K = compression(TOLERANCE)
PROBABILITIES = (0.1, 0.25, 0.5, 0.75, 0.9)
KEYS = ["peer_group_id", "metric"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "player_percentiles")
    found = misranked(rows, KEYS, "raw_value", "percentile", F.col("metric").isin(LOWER_IS_BETTER), TOLERANCE, K)
    return found.select("player_id", "season", *KEYS).distinct()


def p6_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may be off per metric, and how many of them the digests' bounds decide."""
    rows = table(spark, sf_dir, "player_percentiles")
    wide, _ = judged_ranks(rows, KEYS, "raw_value", "percentile", F.col("metric").isin(LOWER_IS_BETTER), TOLERANCE, K)
    return wide.groupBy("metric").agg(F.count("*").alias("may_be_off"), F.count_if("__sure").alias("decided"))


def _sliced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of percentiles, and the digests of their groups merged from one digest per season."""
    rows = table(spark, sf_dir, "player_percentiles").distinct()
    slices = digests(rows.withColumn("slice", F.col("season")), [*KEYS, "slice"], "raw_value", K)
    return rows, merge([slices.drop("slice")], KEYS, K)


def p6_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of raw_value per peer group and metric, from one digest per season slice, merged."""
    return quantiles(_sliced(spark, sf_dir)[1], KEYS, PROBABILITIES)


def _seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "player_season_stats").select("player_id", "season", "competition_id", "club_id", F.explode("metrics").alias("metric", "value")).distinct()


def p6_season_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the season metrics per season and metric; repeated rows count once."""
    return quantiles(digests(_seasons(spark, sf_dir), ["season", "metric"], "value", K), ["season", "metric"], PROBABILITIES)


def _checked(rows: DataFrame, digest: DataFrame, keys: list[str], value: str) -> DataFrame:
    out = checked_quantiles(rows, digest, keys, value, PROBABILITIES)
    # digests of slices are compressed twice
    return out.select(*keys, "probability", "n", (F.round("exact", 6) + 0.0).alias("exact"), "inside", (F.col("rank_off") <= F.col("rank_error")).alias("error_kept"), (F.col("rank_error") <= 2 * BITS * F.floor(F.col("n") / K)).alias("error_bound"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of raw_value, and whether the merged digests' bounds hold them."""
    rows, digest = _sliced(spark, sf_dir)
    return _checked(rows, digest, KEYS, "raw_value")


def p6_season_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the season metrics, and whether the digests' bounds hold them."""
    rows = _seasons(spark, sf_dir)
    return _checked(rows, digests(rows, ["season", "metric"], "value", K), ["season", "metric"], "value")


QUERIES = {
    "p6_found": p6_found, "p6_decided": p6_decided, "p6_quantiles": p6_quantiles, "p6_season_quantiles": p6_season_quantiles,
    "p6_checked": p6_checked, "p6_season_checked": p6_season_checked,
}

EXACT_SQL = """v AS (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY x) AS r, count(*) OVER (PARTITION BY {0}) AS n FROM w WHERE x IS NOT NULL AND NOT isnan(x))
SELECT {0}, p AS probability, n, round(x, 6) + 0.0 AS exact, TRUE AS inside, TRUE AS error_kept, TRUE AS error_bound FROM v, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS p)
WHERE r = greatest(CAST(ceil(p * n - 1e-9) AS BIGINT), 1)"""
ORACLES = {
    "p6_checked": f"WITH w AS (SELECT DISTINCT * RENAME (raw_value AS x) FROM player_percentiles), {EXACT_SQL.format('peer_group_id, metric')}",
    "p6_season_checked": f"""WITH w AS (SELECT DISTINCT player_id, season, competition_id, club_id, unnest(map_keys(metrics)) AS metric, unnest(map_values(metrics)) AS x FROM player_season_stats),
{EXACT_SQL.format('season, metric')}""",
    "p6_found": """
WITH r AS (SELECT DISTINCT * FROM player_percentiles WHERE raw_value IS NOT NULL AND NOT isnan(raw_value)),
w AS (
  SELECT *, CASE WHEN metric IN ('fouls_committed','yellow_cards','red_cards') THEN -raw_value ELSE raw_value END AS v FROM r),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY peer_group_id, metric ORDER BY v) AS lo,
    count(*) OVER (PARTITION BY peer_group_id, metric, v) AS eq, count(*) OVER (PARTITION BY peer_group_id, metric) AS n FROM w)
SELECT DISTINCT player_id, season, peer_group_id, metric FROM ranked
WHERE abs(percentile - (lo + (eq - 1) / 2.0) * 100.0 / n) > 10""",
}
