"""Queries on the loads: what becomes of every record, and the tables after a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.operators import events as E
from turfline.operators import jobs
from turfline.plans import binding as B
from turfline.plans.metric_queries import RATE, TOTALS_SQL
from turfline.registry import METRIC_KEYS
from turfline.session import table


def _now():
    return F.lit("2025-07-01 00:00:00").cast("timestamp")


def competition_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The 23 season metrics of outfield players from events, line-ups and matches."""
    rows = E.competition_metrics(B.match_events(spark, d), table(spark, d, "lineups"), table(spark, d, "matches"))
    return rows.select("player_id", "season", "competition_id", "team_id", "player_name", "country", "position_group", F.round("minutes", 6).alias("minutes"), "matches_played", *[F.round(k, 9).alias(k) for k in METRIC_KEYS])


def competition_load(spark: SparkSession, d: str) -> DataFrame:
    """Season rows loaded from events, line-ups and matches, with the names of their competition and team."""
    known = B.clean_players(spark, d).select(F.col("player_id").alias("alias_id"), "player_id", F.lit("statsbomb").alias("source"), F.col("player_id").cast("string").alias("source_id"))
    load = jobs.load_competition(B.warehouse(spark, d, aliases=known), B.match_events(spark, d), table(spark, d, "lineups"), table(spark, d, "matches"), _now())
    t = load.tables
    names = lambda name, key, out: t[name].select(F.col("id").alias(key), F.col("name").alias(out))
    stats = t["player_season_stats"].filter("source = 'statsbomb' and ingested_at = timestamp '2025-07-01 00:00:00'").join(names("competitions", "competition_id", "competition"), "competition_id").join(names("clubs", "club_id", "club"), "club_id")
    who = t["player_aliases"].filter("source = 'statsbomb'").select("player_id", "source_id").join(load.outcomes.select("source_id", "outcome"), "source_id")
    stats = stats.join(who, "player_id").join(t["players"].select(F.col("id").alias("player_id"), "position_group"), "player_id")
    return stats.select("source_id", "outcome", "position_group", "season", "competition", "club", "minutes", "matches_played", F.round(F.col("metrics")["tackles_won"], 9).alias("tackles_won"), F.round(F.col("metrics")["xa"], 9).alias("xa"))


def _market(spark: SparkSession, d: str) -> jobs.Load:
    market = B.market(spark, d)
    clubs = market.select(F.col("current_club_id").alias("club_id"), F.concat(F.lit("CLUB "), F.col("current_club_id").cast("string")).alias("name")).distinct()
    return jobs.ingest_market(B.warehouse(spark, d), market, clubs, _now())


def market_load(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every market record."""
    return _market(spark, d).outcomes


def market_load_players(spark: SparkSession, d: str) -> DataFrame:
    """The players after the market records are loaded."""
    t = _market(spark, d).tables
    clubs = t["clubs"].select(F.col("id").alias("current_club_id"), F.col("normalized_name").alias("club"))
    rows = t["players"].join(clubs, "current_club_id", "left")
    return rows.select("id", "normalized_name", "birth_date", "foot", F.col("height_cm").cast("int").alias("height_cm"), "contract_until", "market_value_eur", F.col("source_ids")["transfermarkt"].alias("market_id"), "club")


def season_stats_load(spark: SparkSession, d: str) -> DataFrame:
    """Season rows loaded from season-stat records, with the names of their competition and team."""
    t = jobs.ingest_season_stats(B.warehouse(spark, d), B.provider_stats(spark, d), _now()).tables
    names = lambda name, key, out: t[name].select(F.col("id").alias(key), F.col("name").alias(out))
    stats = t["player_season_stats"].filter("source = 'fbref' and ingested_at = timestamp '2025-07-01 00:00:00'")
    stats = stats.join(names("competitions", "competition_id", "competition"), "competition_id").join(names("clubs", "club_id", "club"), "club_id")
    return stats.select("player_id", "season", "competition", "club", "minutes", "matches_played", F.round(F.col("metrics")["goals"], 9).alias("goals"))


QUERIES = {
    "competition_metrics": competition_metrics, "competition_load": competition_load, "market_load": market_load, "market_load_players": market_load_players,
    "season_stats_load": season_stats_load,
}

MADE_SQL = """
al AS (SELECT source_id, min(player_id) AS player_id FROM player_aliases WHERE source = 'transfermarkt' AND player_id IS NOT NULL GROUP BY source_id),
made AS (SELECT CAST(query_id AS VARCHAR) AS source_id, CASE WHEN al.player_id IS NOT NULL THEN 'already_known' WHEN score >= 0.92 THEN 'auto_resolved' WHEN score >= 0.6 THEN 'needs_review' ELSE 'new' END AS outcome,
  CASE WHEN al.player_id IS NOT NULL THEN al.player_id WHEN score >= 0.92 THEN tp.player_id END AS player_id FROM tp LEFT JOIN al ON al.source_id = CAST(query_id AS VARCHAR) WHERE place = 1)
"""
ORACLES = {
    "competition_metrics": f"""WITH {TOTALS_SQL}
SELECT player_id, season, competition_id, team_id, player_name, country, position_group, round(minutes, 6) AS minutes, matches_played, {", ".join(f"round({v}, 9) AS {k}" for k, v in RATE.items())} FROM tot""",
    "competition_load": f"""WITH {TOTALS_SQL}, last AS (SELECT DISTINCT ON (player_id) player_id, position_group FROM tot ORDER BY player_id, season DESC, competition_id),
cn AS (SELECT competition_id, arg_min(competition_name, match_id) AS competition FROM matches GROUP BY competition_id),
tn AS (SELECT id, arg_min(name, match_id) AS club FROM (SELECT home_team_id AS id, home_team AS name, match_id FROM matches UNION ALL SELECT away_team_id, away_team, match_id FROM matches) GROUP BY id),
nm AS (SELECT trim({B.FOLD_SQL.format("club")}) AS n, arg_min(club, id) AS club FROM tn GROUP BY 1)
SELECT CAST(player_id AS VARCHAR) AS source_id, CASE WHEN upper(trim(p.position_group)) IN {B.GROUPS_SQL} THEN 'already_known' ELSE 'new' END AS outcome, last.position_group, season, cn.competition, nm.club,
  CAST(round_even(minutes, 0) AS INT) AS minutes, matches_played, round({RATE["tackles_won"]}, 9) AS tackles_won, round({RATE["xa"]}, 9) AS xa
FROM tot JOIN last USING (player_id) JOIN cn USING (competition_id) JOIN tn ON tn.id = team_id JOIN nm ON nm.n = trim({B.FOLD_SQL.format("tn.club")}) LEFT JOIN players p USING (player_id)""",
    "market_load": f"WITH RECURSIVE {B.MARKET_SQL}, {MADE_SQL} SELECT source_id, outcome, player_id FROM made",
    "market_load_players": f"""WITH RECURSIVE {B.MARKET_SQL}, {MADE_SQL},
rec AS (SELECT CAST(market_player_id AS VARCHAR) AS source_id, trim({B.FOLD_SQL.format("name")}) AS n, {B.BORN_SQL} AS birth_date, CASE WHEN lower(trim(foot)) IN ('left','right','both') THEN lower(trim(foot)) END AS foot,
  CAST(trunc(height_in_cm) AS INT) AS height_cm, TRY_CAST(left(contract_expiration_date, 10) AS DATE) AS contract_until, CAST(trunc(market_value_in_eur) AS BIGINT) AS market_value_eur, 'club ' || current_club_id AS club FROM market_players),
up AS (SELECT made.player_id, rec.* FROM made JOIN rec USING (source_id) WHERE made.player_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY made.player_id ORDER BY source_id) = 1)
SELECT p.player_id AS id, p.normalized_name, CASE WHEN u.source_id IS NULL THEN p.birth_date ELSE u.birth_date END AS birth_date, CASE WHEN u.source_id IS NULL THEN p.foot ELSE u.foot END AS foot,
  CAST(CASE WHEN u.source_id IS NULL THEN p.height_cm ELSE u.height_cm END AS INT) AS height_cm, CASE WHEN u.source_id IS NULL THEN p.contract_until ELSE u.contract_until END AS contract_until,
  CASE WHEN u.source_id IS NULL THEN p.market_value_eur ELSE u.market_value_eur END AS market_value_eur, coalesce(u.source_id, p.source_ids['transfermarkt']) AS market_id,
  CASE WHEN u.source_id IS NULL THEN 'club ' || p.current_club_id ELSE u.club END AS club FROM players p LEFT JOIN up u USING (player_id)
UNION ALL SELECT CAST((SELECT max(player_id) FROM players) + row_number() OVER (ORDER BY source_id) AS INT), n, birth_date, foot, height_cm, contract_until, market_value_eur, source_id, club FROM made JOIN rec USING (source_id) WHERE outcome = 'new'""",
    "season_stats_load": f"""WITH RECURSIVE pv AS (SELECT *, league || '|' || season || '|' || team || coalesce('|' || trim({B.FOLD_SQL.format("player")}), '') AS source_id FROM ({B.PROVIDER_SQL}) WHERE pt_min > 0),
rec AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY player NULLS FIRST, pt_min, pt_mp NULLS FIRST) = 1),
qs AS (SELECT source_id AS query_id, CAST(NULL AS DATE) AS q_birth, CAST([] AS VARCHAR[]) AS q_nations, {B.tokens_sql(B.FOLD_SQL.format("player"))} AS x FROM rec), {B.RESOLVE_SQL},
fd AS (SELECT tp.player_id, rec.* FROM rec JOIN tp ON tp.query_id = source_id AND place = 1 AND score >= 0.92)
SELECT player_id, season, substring(league, 5) AS competition, team AS club, CAST(pt_min AS INT) AS minutes, CAST(pt_mp AS SMALLINT) AS matches_played, round(CASE WHEN perf_gls IS NULL OR isnan(perf_gls) THEN 0 ELSE perf_gls END / pt_90s, 9) AS goals
FROM fd QUALIFY row_number() OVER (PARTITION BY player_id, season, league, team ORDER BY source_id DESC) = 1""",
}
