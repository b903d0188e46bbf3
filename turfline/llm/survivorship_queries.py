"""Queries on duplicate groups of players."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.graph import id_groups
from turfline.llm.survivorship import player_fields, survivors
from turfline.session import table


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = table(spark, sf_dir, "players").select("player_id", "market_value_eur", "contract_until", "position_group", "updated_at", "source_ids")
    groups = id_groups(players).select(F.col("node").alias("player_id"), F.col("component").alias("group_id"))
    return survivors(players.join(groups, "player_id"), "group_id", "player_id", "updated_at", player_fields())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).select("group_id", "field", "player_id")


def p5_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built record per group, field by field."""
    of = lambda name, column: F.max(F.when(F.col("field") == name, F.col(column)))
    return _survivors(spark, sf_dir).groupBy("group_id").agg(
        of("market_value_eur", "value").cast("bigint").alias("market_value_eur"),
        of("contract_until", "value").cast("date").alias("contract_until"),
        of("position_group", "value").alias("position_group"),
        F.countDistinct("player_id").cast("bigint").alias("rows_used"),
    )


QUERIES = {"p5_found": p5_found, "p5_golden": p5_golden}

SURVIVORS_SQL = """
WITH RECURSIVE ids AS (
  SELECT DISTINCT player_id, k, lower(trim(v)) AS v FROM (
    SELECT player_id, unnest(map_keys(source_ids)) AS k, unnest(map_values(source_ids)) AS v FROM players)
  WHERE regexp_matches(lower(trim(v)), '[1-9a-z]') AND lower(trim(v)) NOT IN
    ('n/a','na','n/k','nk','tbc','tbd','unknown','none','null','nan','nil','missing','x','xx','xxx')),
links AS (SELECT DISTINCT a.player_id AS a, b.player_id AS b FROM ids a JOIN ids b ON a.k = b.k AND a.v = b.v AND a.player_id <> b.player_id),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
grp AS (SELECT a AS player_id, least(a, min(b)) AS group_id FROM reach GROUP BY a),
vals AS (
  SELECT group_id, 'market_value_eur' AS field, player_id, updated_at, CAST(market_value_eur AS VARCHAR) AS v FROM players JOIN grp USING (player_id)
    WHERE market_value_eur BETWEEN 25000 AND 500000000
  UNION ALL SELECT group_id, 'contract_until', player_id, updated_at, CAST(contract_until AS VARCHAR) FROM players JOIN grp USING (player_id)
    WHERE year(contract_until) BETWEEN 2015 AND 2040
  UNION ALL SELECT group_id, 'position_group', player_id, updated_at, upper(trim(position_group)) FROM players JOIN grp USING (player_id)
    WHERE upper(trim(position_group)) IN ('GK','DC','FB','DM','CM','AM','W','ST')),
best AS (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY updated_at DESC, player_id) AS rn FROM vals)
"""

ORACLES = {
    "p5_found": f"{SURVIVORS_SQL} SELECT group_id, field, player_id FROM best WHERE rn = 1",
    "p5_golden": f"""{SURVIVORS_SQL} SELECT group_id,
  CAST(max(v) FILTER (WHERE field = 'market_value_eur') AS BIGINT) AS market_value_eur,
  CAST(max(v) FILTER (WHERE field = 'contract_until') AS DATE) AS contract_until,
  max(v) FILTER (WHERE field = 'position_group') AS position_group,
  count(DISTINCT player_id) AS rows_used FROM best WHERE rn = 1 GROUP BY group_id""",
}
