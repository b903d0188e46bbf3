"""Views of the test tables in the shape the operators take, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.operators.ingest import fitted
from turfline.registry import LEAGUE_TIERS, POSITION_LABELS
from turfline.schema import TABLES
from turfline.session import table

#: Competitions of the second tier in the test tables.
SECOND_TIER = [12, 14, 16]
AS_OF = "2025-07-01"
GROUPS_SQL = "('GK','DC','FB','DM','CM','AM','W','ST')"


def competitions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "matches").select("competition_id", "competition_name", F.col("competition_country_name").alias("country")).distinct()
    return rows.withColumn("tier", F.when(F.col("competition_id").isin(SECOND_TIER), 2).otherwise(1))


def stats_only(spark: SparkSession, d: str) -> DataFrame:
    """Season stats, every key once: the row of the last load, of equal times that of most minutes, then matches."""
    key = ["player_id", "season", "competition_id", "club_id"]
    rows = table(spark, d, "player_season_stats")
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("ingested_at", "minutes", "matches_played")).alias("__r"))
    return last.select(*key, "__r.*").select(*rows.columns)


def clean_players(spark: SparkSession, d: str) -> DataFrame:
    """Players with a known position group."""
    players = table(spark, d, "players").withColumn("position_group", F.upper(F.trim("position_group")))
    return players.filter(F.col("position_group").isin(list(POSITION_LABELS)))


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Season stats with position group and tier."""
    tier = F.when(F.col("competition_id").isin(SECOND_TIER), 2).otherwise(1)
    return stats_only(spark, d).join(clean_players(spark, d).select("player_id", "position_group"), "player_id").withColumn("tier", tier)


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "player_percentiles").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors without NaN, every row once."""
    clean = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: F.isnan(x))
    return table(spark, d, "player_vectors").distinct().filter(clean("style_vec") & clean("quality_vec"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event log as match events: a day is a match, a user a player, the kinds of events stand for kinds of play."""
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = table(spark, d, "events").select("*", k.alias("k"), kinds[F.col("event_type")].alias("type"))
    of = lambda kind, value: F.when(F.col("type") == kind, value)
    return rows.select(
        F.col("event_id").cast("string").alias("id"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("bigint").alias("match_id"),
        F.col("user_id").cast("double").alias("player_id"), "type",
        F.least((F.floor(F.hour("ts") / 5) + 1).cast("int"), F.lit(5)).alias("period"), F.minute("ts").alias("minute"), F.second("ts").alias("second"),
        of("Shot", F.when(F.col("value") > 50, "Goal").otherwise("Saved")).alias("shot_outcome"),
        of("Shot", F.when(F.col("k") % 10 == 0, "Penalty")).alias("shot_type"), of("Shot", F.col("value") / 1000).alias("shot_statsbomb_xg"),
        of("Pass", F.when(F.col("k") % 3 == 0, True)).alias("pass_shot_assist"), of("Pass", F.when(F.col("k") % 7 == 0, True)).alias("pass_goal_assist"),
        of("Pass", (F.col("event_id") + 1).cast("string")).alias("pass_assisted_shot_id"),
        of("Dribble", F.when(F.col("k") % 2 == 0, "Complete").otherwise("Incomplete")).alias("dribble_outcome"),
        of("Duel", F.lit("Tackle")).alias("duel_type"), of("Duel", F.when(F.col("k") % 4 == 0, "Won").when(F.col("k") % 4 == 1, "Success Out").otherwise("Lost")).alias("duel_outcome"),
        of("Foul Committed", F.when(F.col("k") % 5 == 0, "Yellow Card").when(F.col("k") % 11 == 0, "Second Yellow")).alias("foul_committed_card"),
        F.lit(None).cast("string").alias("bad_behaviour_card"),
    )


def match_events(spark: SparkSession, d: str) -> DataFrame:
    """The event log as events of the matches: seven events in a row belong to one match, a user is one of its line-up."""
    m = F.broadcast(table(spark, d, "matches").agg(F.min("match_id").alias("first"), F.count("*").alias("n")))
    lines = table(spark, d, "lineups").filter("player_id is not null").groupBy("match_id").agg(F.sort_array(F.collect_set("player_id")).alias("ids"))
    rows = events(spark, d).withColumn("user", F.col("player_id").cast("bigint")).drop("match_id", "player_id").crossJoin(m)
    rows = rows.withColumn("match_id", F.col("first") + F.floor(F.col("id").cast("bigint") / 7) % F.col("n")).join(lines, "match_id")
    return rows.withColumn("player_id", F.get("ids", (F.col("user") % F.size("ids")).cast("int")).cast("double")).drop("first", "n", "ids", "user")


def clock_events(spark: SparkSession, d: str) -> DataFrame:
    """The starts and ends of the periods of the matches, as events."""
    m = table(spark, d, "matches")
    kind = lambda column, name: m.select("match_id", F.explode(column).alias("period", "at"), F.lit(name).alias("type"))
    second = F.round(F.col("at") * 60).cast("int")
    rows = kind("period_start", "Half Start").unionByName(kind("period_end", "Half End"))
    return rows.select("match_id", "period", "type", F.floor(second / 60).cast("int").alias("minute"), (second % 60).alias("second"))


def market(spark: SparkSession, d: str) -> DataFrame:
    """Market records under the source's column names."""
    return table(spark, d, "market_players").withColumnRenamed("market_player_id", "player_id")


def provider_stats(spark: SparkSession, d: str) -> DataFrame:
    """Season stats as records of the season-stat provider: the competitions stand for its leagues, a club has a name."""
    rows = stats_only(spark, d).join(table(spark, d, "players").select("player_id", F.col("full_name").alias("player")), "player_id")
    league = F.element_at(F.array(*[F.lit(x) for x in LEAGUE_TIERS]), F.col("competition_id") % len(LEAGUE_TIERS) + 1)
    units = F.col("minutes") / 90.0
    of = lambda k: F.col("metrics")[k] * units
    return rows.select(
        league.alias("league"), "season", F.concat(F.lit("Team "), F.col("club_id").cast("string")).alias("team"), "player", F.col("minutes").cast("double").alias("pt_min"), units.alias("pt_90s"),
        F.col("matches_played").cast("double").alias("pt_mp"), of("goals").alias("perf_gls"), of("assists").alias("perf_ast"), of("yellow_cards").alias("perf_crdy"), of("red_cards").alias("perf_crdr"),
        of("shots").alias("std_sh"), of("xg").alias("exp_xg"), of("npxg").alias("exp_npxg"),
    )


def warehouse(spark: SparkSession, d: str, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """The warehouse tables of the test tables: clubs by number, competitions of the matches, an empty review queue."""
    empty = {name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()}
    players = table(spark, d, "players").withColumnRenamed("player_id", "id")
    clubs = players.select(F.col("current_club_id").alias("id")).filter("id is not null").distinct()
    clubs = clubs.select("id", F.concat(F.lit("Club "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("club "), F.col("id").cast("string")).alias("normalized_name"), F.lit(False).alias("is_national_team"))
    names = competitions(spark, d).select(F.col("competition_id").alias("id"), F.col("competition_name").alias("name"), "country", "tier")
    aliases = table(spark, d, "player_aliases") if aliases is None else aliases
    real = {"players": players, "clubs": clubs, "competitions": names, "player_aliases": aliases.withColumnRenamed("alias_id", "id"), "player_season_stats": stats_only(spark, d)}
    return empty | {name: fitted(rows, empty[name]) for name, rows in real.items()}


KINDS = {"click": "Pass", "view": "Dribble", "purchase": "Shot", "signup": "Duel", "error": "Foul Committed"}

EVENTS_SQL = """
ev AS (SELECT event_id, CAST(event_id AS VARCHAR) AS id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS match_id, user_id AS player_id,
  CASE event_type WHEN 'click' THEN 'Pass' WHEN 'view' THEN 'Dribble' WHEN 'purchase' THEN 'Shot' WHEN 'signup' THEN 'Duel' ELSE 'Foul Committed' END AS type,
  least(hour(ts) // 5 + 1, 5) AS period, value, CAST(props->>'k' AS INT) AS k FROM events)
"""
STATS_SQL = f"""
stats AS (SELECT DISTINCT ON (s.player_id, s.season, s.competition_id, s.club_id) s.player_id, s.season, s.competition_id, s.club_id, s.minutes, s.matches_played,
  s.metrics, upper(trim(p.position_group)) AS position_group, CASE WHEN s.competition_id IN (12,14,16) THEN 2 ELSE 1 END AS tier
  FROM player_season_stats s JOIN players p USING (player_id) WHERE upper(trim(p.position_group)) IN {GROUPS_SQL} ORDER BY s.ingested_at DESC, s.minutes DESC, s.matches_played DESC NULLS LAST)
"""
COMPETITIONS_SQL = """
comps AS (SELECT DISTINCT competition_id, competition_name, competition_country_name AS country, CASE WHEN competition_id IN (12,14,16) THEN 2 ELSE 1 END AS tier FROM matches)
"""
MEMBERS_SQL = """
long AS (SELECT player_id, season, position_group, tier, minutes, unnest(map_keys(metrics)) AS metric, unnest(map_values(metrics)) AS value FROM stats WHERE minutes >= 600),
one AS (SELECT player_id, season, position_group, tier, metric,
  CASE WHEN count(*) = 1 THEN any_value(value) ELSE round(sum(value * minutes) / sum(minutes), 6) END AS raw_value
  FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
seasons AS (SELECT DISTINCT position_group, tier, season AS centre FROM one),
member AS (SELECT o.player_id, o.season, o.metric, o.raw_value, o.position_group || '|tier' || o.tier || '|' || centre AS peer_group_id
  FROM one o JOIN seasons s ON o.position_group = s.position_group AND o.tier = s.tier
  WHERE abs(CAST(left(o.season, 4) AS INT) - CAST(left(centre, 4) AS INT)) <= 2),
pct AS (SELECT player_id, season, peer_group_id, metric, raw_value,
  CAST(greatest(least(round_even((rank() OVER (PARTITION BY peer_group_id, metric ORDER BY g) + (count(*) OVER (PARTITION BY peer_group_id, metric, g) - 1) / 2.0)
    / count(*) OVER (PARTITION BY peer_group_id, metric) * 100, 0), 100), 0) AS INT) AS percentile
  FROM (SELECT *, CASE WHEN metric IN ('fouls_committed','yellow_cards','red_cards') THEN -raw_value ELSE raw_value END AS g FROM member))
"""
PEER_GROUPS_SQL = """
mem AS (SELECT DISTINCT player_id, season, position_group, tier FROM stats WHERE minutes >= 600),
cen AS (SELECT DISTINCT position_group, tier, season AS centre FROM mem),
pgs AS (SELECT m.position_group || '|tier' || m.tier || '|' || centre AS peer_group_id,
  CASE m.position_group WHEN 'GK' THEN 'Gardiens' WHEN 'DC' THEN 'Défenseurs centraux' WHEN 'FB' THEN 'Latéraux' WHEN 'DM' THEN 'Milieux défensifs' WHEN 'CM' THEN 'Milieux centraux'
    WHEN 'AM' THEN 'Milieux offensifs' WHEN 'W' THEN 'Ailiers' ELSE 'Attaquants' END || ' · Niveau ' || m.tier || ' · ' || centre AS label,
  m.position_group, centre AS season, 600 AS min_minutes, CAST(count(*) AS INT) AS sample_size
FROM mem m JOIN cen c ON m.position_group = c.position_group AND m.tier = c.tier AND abs(CAST(left(m.season, 4) AS INT) - CAST(left(centre, 4) AS INT)) <= 2
GROUP BY m.position_group, m.tier, centre)
"""
FOLD_SQL = "replace(replace(replace(replace(replace(replace(lower(strip_accents({0})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd')"
VECTORS_SQL = """
vecs AS (SELECT DISTINCT * FROM player_vectors WHERE style_vec IS NOT NULL AND quality_vec IS NOT NULL
  AND len(list_filter(style_vec, lambda x: isnan(x))) = 0 AND len(list_filter(quality_vec, lambda x: isnan(x))) = 0)
"""
MATCH_EVENTS_SQL = f"""
raw AS (SELECT * RENAME (match_id AS day, player_id AS usr) FROM (WITH {EVENTS_SQL} SELECT * FROM ev)),
lns AS (SELECT match_id, list_sort(list_distinct(list(player_id))) AS ids FROM lineups WHERE player_id IS NOT NULL GROUP BY match_id),
ev AS (SELECT raw.*, lns.match_id, ids[usr % len(ids) + 1] AS player_id FROM raw, (SELECT min(match_id) AS first, count(*) AS n FROM matches) m JOIN lns ON lns.match_id = first + (event_id // 7) % n)
"""
BORN_SQL = """CASE WHEN regexp_matches(trim(date_of_birth), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(left(trim(date_of_birth), 10) AS DATE)
    WHEN regexp_matches(trim(date_of_birth), '^[0-9]{4}$') THEN make_date(CAST(date_of_birth AS INT), 1, 1) END"""


def tokens_sql(name: str) -> str:
    """The sorted distinct tokens of a name."""
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array(coalesce({name}, ''), '[\\s\\p{{Z}}]+'), lambda t: t <> '')))"


#: From ``nm`` (pairs of token lists x, y) to ``ts``, their token-set ratios.
SCORE_SQL = """
df AS (SELECT *, array_to_string(list_filter(x, lambda t: list_contains(y, t)), ' ') AS i, array_to_string(list_filter(x, lambda t: NOT list_contains(y, t)), ' ') AS l,
  array_to_string(list_filter(y, lambda t: NOT list_contains(x, t)), ' ') AS r FROM nm),
lcs(l, r, k, row) AS (
  SELECT l, r, 0, list_transform(range(0, length(r) + 1), lambda j: 0::SMALLINT) FROM (SELECT DISTINCT l, r FROM df)
  UNION ALL
  SELECT l, r, k + 1, list_reduce(list_transform(range(1, length(r) + 1), lambda j: [greatest(row[j + 1], row[j] + CASE WHEN l[k + 1] = r[j] THEN 1::SMALLINT ELSE 0::SMALLINT END)::SMALLINT]),
    lambda a, b: list_append(a, greatest(a[-1], b[1])), [0::SMALLINT]) FROM lcs WHERE k < length(l)),
ln AS (SELECT df.*, length(i) AS s, CASE WHEN length(i) > 0 THEN 1 ELSE 0 END AS z, length(df.l) AS p, length(df.r) AS q, CAST(coalesce(lcs.row[-1], 0) AS INT) AS c
  FROM df JOIN lcs ON df.l = lcs.l AND df.r = lcs.r AND lcs.k = length(df.l)),
ts AS (SELECT x, y, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN s > 0 AND (p = 0 OR q = 0) THEN 1.0
  WHEN s = 0 THEN 1 - (p + q - 2 * c) / CAST(p + q AS DOUBLE)
  ELSE greatest(1 - (p + q - 2 * c) / CAST(2 * (s + z) + p + q AS DOUBLE), 1 - (z + p) / CAST(2 * s + z + p AS DOUBLE), 1 - (z + q) / CAST(2 * s + z + q AS DOUBLE)) END AS score FROM ln)
"""
#: From ``qs`` (query_id, q_birth, q_nations, x) to ``tp``: its candidates among the players with score and place.
RESOLVE_SQL = f"""
cs AS (SELECT player_id, birth_date AS c_birth, coalesce(nationality, []) AS c_nations, {tokens_sql("normalized_name")} AS y FROM players),
nm AS (SELECT * FROM (SELECT DISTINCT x FROM qs), (SELECT DISTINCT y FROM cs)),
{SCORE_SQL},
sc AS (SELECT query_id, player_id, CASE WHEN q_birth <> c_birth THEN 0.0 ELSE score * CASE WHEN len(q_nations) > 0 AND len(c_nations) > 0 AND NOT list_has_any(q_nations, c_nations) THEN 0.5 ELSE 1 END END AS score
  FROM qs JOIN ts USING (x) JOIN cs USING (y)),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, player_id) AS place FROM sc)
"""
MARKET_SQL = f"""
qs AS (SELECT market_player_id AS query_id, {BORN_SQL} AS q_birth, CASE WHEN country_of_citizenship IS NULL THEN [] ELSE [country_of_citizenship] END AS q_nations, {tokens_sql(FOLD_SQL.format("name"))} AS x FROM market_players),
{RESOLVE_SQL}
"""
PROVIDER_SQL = f"""SELECT ({list(LEAGUE_TIERS)})[s.competition_id % {len(LEAGUE_TIERS)} + 1] AS league, s.season, 'Team ' || s.club_id AS team, p.full_name AS player, CAST(s.minutes AS DOUBLE) AS pt_min, s.minutes / 90.0::DOUBLE AS pt_90s,
  s.matches_played AS pt_mp, s.metrics['goals'] * (s.minutes / 90.0::DOUBLE) AS perf_gls FROM (SELECT DISTINCT ON (player_id, season, competition_id, club_id) * FROM player_season_stats ORDER BY ingested_at DESC, minutes DESC, matches_played DESC NULLS LAST) s JOIN players p USING (player_id)"""
