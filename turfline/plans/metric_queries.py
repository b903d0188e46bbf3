"""Queries on scalars, events, peer groups and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.scalars import age_years, clock_minutes, formatted, looked_up, season_year, unit
from turfline.functions.text import normalize_name
from turfline.operators import events as E
from turfline.operators import peers, vectors
from turfline.plans import binding as B
from turfline.operators.jobs import market_records
from turfline.registry import LINEUP_POSITIONS, METRIC_KEYS, registry
from turfline.session import table


def clock_parse(spark: SparkSession, d: str) -> DataFrame:
    stints = table(spark, d, "lineups").select("match_id", "player_id", F.posexplode("positions").alias("n", "p"))
    at = lambda c: F.round(clock_minutes(F.col(c)), 6)
    return stints.select("match_id", "player_id", "n", at("p.from").alias("from_minute"), at("p.to").alias("to_minute"), F.coalesce("p.from_period", F.lit(1)).alias("period"))


def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "players").select("player_id", normalize_name(F.col("full_name")).alias("name"))


def season_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "player_season_stats").groupBy("season").agg(F.count("*").alias("n")).select("season", season_year(F.col("season")).alias("year"), "n")


def position_map(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("positions", F.lit(0))["position"]
    rows = table(spark, d, "lineups").filter(F.size("positions") > 0).select(looked_up(first, LINEUP_POSITIONS, "position").alias("position_group"))
    return rows.groupBy("position_group").agg(F.count("*").alias("n"))


def market_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Market records in the canonical form: position group, foot, dates, whole numbers, list of countries."""
    rows = market_records(B.market(spark, d))
    return rows.select("source_id", "raw_name", "position_group", "foot", "birth_date", "contract_until", "height_cm", "market_value_eur", F.array_join("nationality", ",").alias("countries"))


def age(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "players").select("player_id", age_years(F.col("birth_date"), F.lit(B.AS_OF).cast("date")).alias("age"))


def metric_format(spark: SparkSession, d: str) -> DataFrame:
    rows = B.percentiles(spark, d).filter(~F.isnan("raw_value"))
    return rows.join(F.broadcast(registry(spark)), F.col("metric") == F.col("key")).select(
        "player_id", "season", "peer_group_id", "metric", formatted(F.col("raw_value"), F.col("format")).alias("shown")
    )


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n"))


def period_clock(spark: SparkSession, d: str) -> DataFrame:
    """Periods of matches with start and end, from their start and end events."""
    m = E.period_clocks(B.clock_events(spark, d)).select("match_id", "last_period", F.explode("period_start").alias("period", "start"), "period_end")
    return m.select("match_id", "last_period", "period", F.round("start", 6).alias("start"), F.round(F.col("period_end")[F.col("period")], 6).alias("end"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = E.event_counters(B.events(spark, d))
    return counted.select("match_id", "player_id", *[F.round(c, 6).alias(c) for c in E.COUNTERS])


def event_per90(spark: SparkSession, d: str) -> DataFrame:
    """The 23 metrics over all days, ten minutes being counted for every event."""
    events = B.events(spark, d)
    minutes = events.filter("period <= 4").groupBy(F.col("player_id").cast("int").alias("player_id")).agg((F.count("*") * 10.0).alias("minutes"))
    totals = E.event_counters(events).groupBy("player_id").agg(*[F.sum(c).alias(c) for c in E.COUNTERS])
    rows = E.per90(totals.join(minutes, "player_id"))
    return rows.select("player_id", "minutes", *[F.round(k, 9).alias(k) for k in METRIC_KEYS])


def stint_minutes(spark: SparkSession, d: str) -> DataFrame:
    rows = E.appearances(table(spark, d, "lineups"), table(spark, d, "matches"))
    return rows.select("match_id", "team", "player_id", "position_group", F.round("minutes", 6).alias("minutes"))


def season_total(spark: SparkSession, d: str) -> DataFrame:
    rows = E.season_totals(E.appearances(table(spark, d, "lineups"), table(spark, d, "matches")))
    return rows.withColumn("minutes", F.round("minutes", 6))


def peer_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return peers.percentiles(B.stats(spark, d))


def peer_group(spark: SparkSession, d: str) -> DataFrame:
    return peers.peer_groups(B.stats(spark, d))


def own_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the own-season group as one text per player and season."""
    maps = peers.percentile_map(peers.own_group(B.percentiles(spark, d)))
    pairs = F.transform(F.map_entries("percentiles"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("player_id", "season", F.array_join(F.array_sort(pairs), ",").alias("percentiles"))


def _style(spark: SparkSession, d: str) -> DataFrame:
    return vectors.scaled(vectors.complete_rows(B.stats(spark, d)))


def scaled_metrics(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in sorted(METRIC_KEYS)])
    rows = _style(spark, d).select("player_id", "season", "competition_id", "club_id", F.explode(F.arrays_zip(keys.alias("k"), F.col("x"))).alias("e"))
    return rows.select("player_id", "season", "competition_id", "club_id", F.col("e.k").alias("metric"), (F.round("e.x", 5) + 0.0).alias("scaled"))


def style_units(spark: SparkSession, d: str) -> DataFrame:
    """First entries and length of the unit vectors."""
    x = unit(F.col("x"))
    rows = _style(spark, d).select("player_id", "season", "competition_id", "club_id", x.alias("u"))
    return rows.select("player_id", "season", "competition_id", "club_id", (F.round(F.col("u")[0], 5) + 0.0).alias("first"), (F.round(F.col("u")[22], 5) + 0.0).alias("last"))


def svd_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors recomputed from season stats and stored percentiles."""
    maps = peers.percentile_map(peers.own_group(B.percentiles(spark, d)))
    return vectors.player_vectors(B.stats(spark, d), maps)


def _similar(spark: SparkSession, d: str, vector: str) -> DataFrame:
    """The ten most similar rows of other players for the first season of each player whose id is divisible by 50."""
    rows = B.vectors(spark, d)
    found = vectors.similar_to(rows, vectors.earliest(rows.filter("player_id % 50 = 0")), vector, 10)
    return found.select("target", "player_id", "season", "place", F.round("similarity", 6).alias("similarity"))


def style_similar(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, "style_vec")


def quality_similar(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, "quality_vec")


def embedding_similar(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar embeddings of each one whose id is divisible by 50."""
    rows = table(spark, d, "embeddings")
    found = vectors.similar_to(rows, rows.filter("vec_id % 50 = 0"), "embedding", 10, row="vec_id")
    return found.select("target", "vec_id", "place", F.round("similarity", 6).alias("similarity"))


QUERIES = {
    "clock_parse": clock_parse, "name_normalise": name_normalise, "season_year": season_years, "position_map": position_map, "market_normalise": market_normalise,
    "age_years": age, "format_metric": metric_format, "json_extract": json_extract, "period_clocks": period_clock, "event_counts": event_counts,
    "per90_metrics": event_per90, "stint_minutes": stint_minutes, "season_totals": season_total, "peer_percentiles": peer_percentiles, "peer_groups": peer_group,
    "own_group_percentiles": own_percentiles, "scaled_metrics": scaled_metrics, "style_unit_vectors": style_units, "svd_vectors": svd_vectors,
    "style_similarity_topk": style_similar, "quality_similarity_topk": quality_similar, "embedding_topk": embedding_similar,
}

CLOCK = "CASE WHEN regexp_matches(trim({0}), '^[0-9]+:[0-9]+$') THEN CAST(split_part(trim({0}), ':', 1) AS INT) + CAST(split_part(trim({0}), ':', 2) AS INT) / 60.0 END"
COUNT = "CAST(count(*) FILTER (WHERE {0}) AS DOUBLE)"
COUNTERS_SQL = f"""
play AS (SELECT e.*, s.value AS shot_value FROM ev e LEFT JOIN (SELECT match_id, event_id, value FROM ev WHERE type = 'Shot' AND period <= 4) s
  ON e.type = 'Pass' AND s.match_id = e.match_id AND s.event_id = e.event_id + 1 WHERE e.period <= 4),
cnt AS (SELECT match_id, CAST(player_id AS INT) AS player_id,
  {COUNT.format("type='Shot' AND value > 50")} AS goals, {COUNT.format("type='Shot' AND value > 50 AND k % 10 <> 0")} AS np_goals, {COUNT.format("type='Shot'")} AS shots,
  coalesce(sum(value / 1000) FILTER (WHERE type='Shot'), 0) AS xg, coalesce(sum(value / 1000) FILTER (WHERE type='Shot' AND k % 10 <> 0), 0) AS npxg,
  {COUNT.format("type='Pass' AND k % 3 = 0")} AS key_passes, {COUNT.format("type='Pass' AND k % 7 = 0")} AS assists,
  coalesce(sum(shot_value / 1000) FILTER (WHERE type='Pass' AND k % 3 = 0), 0) AS xa,
  {COUNT.format("type='Dribble'")} AS dribbles_attempted, {COUNT.format("type='Dribble' AND k % 2 = 0")} AS dribbles_completed,
  {COUNT.format("type='Duel'")} AS tackles_attempted, {COUNT.format("type='Duel' AND k % 4 IN (0, 1)")} AS tackles_won,
  0.0::DOUBLE AS interceptions, 0.0::DOUBLE AS clearances, 0.0::DOUBLE AS blocks, 0.0::DOUBLE AS ball_recoveries,
  {COUNT.format("type='Foul Committed'")} AS fouls_committed, 0.0::DOUBLE AS fouls_won,
  {COUNT.format("type='Foul Committed' AND (k % 5 = 0 OR k % 11 = 0)")} AS yellow_cards, {COUNT.format("type='Foul Committed' AND k % 5 <> 0 AND k % 11 = 0")} AS red_cards
  FROM play GROUP BY match_id, player_id)
"""
COUNTS_SQL = f"{B.EVENTS_SQL}, {COUNTERS_SQL}"
PLAYED_SQL = f"""
m AS (SELECT match_id, season, period_start AS ps, period_end AS pe, least(list_max(map_keys(period_end)), 4) AS last, competition_id, home_team, home_team_id, away_team, away_team_id FROM matches),
l AS (SELECT row_number() OVER () AS rid, * FROM lineups WHERE len(positions) > 0),
s AS (SELECT rid, l.match_id, unnest(positions) AS p, generate_subscripts(positions, 1) AS n FROM l),
t AS (SELECT rid, n, m.last, coalesce(p.from_period, 1) AS fp, {CLOCK.format('p."from"')} AS f, {CLOCK.format('p."to"')} AS u, ps, pe,
  (p."to" IS NULL OR p.to_period IS NULL OR p.to_period < coalesce(p.from_period, 1) OR p.to_period > m.last) AS open FROM s JOIN m USING (match_id)),
c AS (SELECT rid, n, fp > last AS late, open, CASE WHEN fp > last THEN 0 ELSE
  greatest(coalesce(CASE WHEN open THEN coalesce(pe[last], 0) ELSE u END, 0) - coalesce(f, ps[fp], 0), 0) END AS mins FROM t),
stops AS (SELECT rid, min(n) AS stop FROM c WHERE late OR open GROUP BY rid),
mins AS (SELECT c.rid, sum(mins) AS minutes FROM c LEFT JOIN stops USING (rid) WHERE stop IS NULL OR n <= stop GROUP BY c.rid),
app AS (SELECT l.match_id, l.team, CASE WHEN l.team = home_team THEN home_team_id WHEN l.team = away_team THEN away_team_id END AS team_id, l.player_id, l.player_name, l.country, m.season, competition_id,
  minutes, pos, CASE
  WHEN pos = 'Goalkeeper' THEN 'GK' WHEN pos IN ('Center Back','Left Center Back','Right Center Back') THEN 'DC'
  WHEN pos IN ('Left Back','Right Back','Left Wing Back','Right Wing Back') THEN 'FB' WHEN pos LIKE '%Defensive Midfield' THEN 'DM'
  WHEN pos IN ('Left Center Midfield','Right Center Midfield') THEN 'CM' WHEN pos LIKE '%Attacking Midfield' THEN 'AM'
  WHEN pos IN ('Left Midfield','Right Midfield','Left Wing','Right Wing') THEN 'W' WHEN pos LIKE '%Center Forward' THEN 'ST' END AS position_group
  FROM (SELECT *, positions[1].position AS pos FROM l) l JOIN m USING (match_id) JOIN mins USING (rid) WHERE minutes > 0)
"""
#: Of the most frequent team and position of players, the smallest; and totals per player, season and competition.
MODE = "SELECT player_id, season, competition_id, {0} AS v, row_number() OVER (PARTITION BY player_id, season, competition_id ORDER BY count(*) DESC, {0}) AS n FROM app WHERE {0} IS NOT NULL GROUP BY player_id, season, competition_id, {0}"
GROUP_SQL = """CASE WHEN pos = 'Goalkeeper' THEN 'GK' WHEN pos IN ('Center Back','Left Center Back','Right Center Back') THEN 'DC'
  WHEN pos IN ('Left Back','Right Back','Left Wing Back','Right Wing Back') THEN 'FB' WHEN pos LIKE '%Defensive Midfield' THEN 'DM'
  WHEN pos IN ('Left Center Midfield','Right Center Midfield') THEN 'CM' WHEN pos LIKE '%Attacking Midfield' THEN 'AM'
  WHEN pos IN ('Left Midfield','Right Midfield','Left Wing','Right Wing') THEN 'W' WHEN pos LIKE '%Center Forward' THEN 'ST' END"""
TOTALS_SQL = f"""{B.MATCH_EVENTS_SQL}, {COUNTERS_SQL}, {PLAYED_SQL},
mp AS ({MODE.format("pos")}), mt AS ({MODE.format("team_id")}),
tot AS (SELECT *, {GROUP_SQL} AS position_group FROM (SELECT a.player_id, a.season, a.competition_id, sum(minutes) AS minutes, count(DISTINCT match_id) AS matches_played,
  first(player_name ORDER BY match_id, player_name) FILTER (WHERE player_name IS NOT NULL) AS player_name, first(country ORDER BY match_id, country) FILTER (WHERE country IS NOT NULL) AS country,
  any_value(mt.v) AS team_id, any_value(mp.v) AS pos, {", ".join(f"sum(coalesce(cnt.{c}, 0)) AS {c}" for c in E.COUNTERS)}
  FROM app a LEFT JOIN cnt USING (match_id, player_id) LEFT JOIN mp ON mp.player_id = a.player_id AND mp.season = a.season AND mp.competition_id = a.competition_id AND mp.n = 1
  LEFT JOIN mt ON mt.player_id = a.player_id AND mt.season = a.season AND mt.competition_id = a.competition_id AND mt.n = 1 GROUP BY a.player_id, a.season, a.competition_id) WHERE pos <> 'Goalkeeper')
"""
RATE = {k: f"{k} / (minutes / 90)" for k in E.COUNTERS} | {
    "xg_per_shot": "CASE WHEN shots > 0 THEN xg / shots ELSE 0 END", "np_goals_minus_npxg": "(np_goals - npxg) / (minutes / 90)",
    "dribble_success_rate": "CASE WHEN dribbles_attempted > 0 THEN dribbles_completed / dribbles_attempted ELSE 0 END",
}
KEYS = sorted(METRIC_KEYS)
SCALED_SQL = f"""{B.STATS_SQL},
kept AS (SELECT * FROM stats WHERE {" AND ".join(f"metrics['{k}'] IS NOT NULL AND NOT isnan(metrics['{k}'])" for k in KEYS)}),
lng AS (SELECT player_id, season, competition_id, club_id, position_group, k AS metric,
  metrics[k] * CASE WHEN k IN ('fouls_committed','yellow_cards','red_cards') THEN -1 ELSE 1 END AS v FROM kept, (SELECT unnest({KEYS}) AS k)),
sds AS (SELECT position_group, metric, stddev_pop(v) AS sd FROM lng GROUP BY ALL),
scl AS (SELECT lng.*, CASE WHEN sd > 0 THEN v / sd ELSE v END AS x FROM lng JOIN sds USING (position_group, metric))
"""


def _similar_sql(vector: str) -> str:
    return f"""WITH {B.VECTORS_SQL}, vv AS (SELECT player_id, season, CAST({vector} AS DOUBLE[]) AS v FROM vecs),
target AS (SELECT DISTINCT ON (player_id) player_id AS target, v AS t FROM vv WHERE player_id % 50 = 0 ORDER BY player_id, season),
sim AS (SELECT target, player_id, season, round(list_dot_product(v, t) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(t, t))), 9) AS c FROM vv, target WHERE player_id <> target)
SELECT target, player_id, season, CAST(row_number() OVER w AS INT) AS place, round(c, 6) AS similarity FROM sim WHERE NOT isnan(c) WINDOW w AS (PARTITION BY target ORDER BY c DESC, player_id, season) QUALIFY row_number() OVER w <= 10"""


ORACLES = {
    "clock_parse": f"""SELECT match_id, player_id, CAST(n - 1 AS INT) AS n, round({CLOCK.format('p."from"')}, 6) AS from_minute, round({CLOCK.format('p."to"')}, 6) AS to_minute,
  coalesce(p.from_period, 1) AS period FROM (SELECT match_id, player_id, unnest(positions) AS p, generate_subscripts(positions, 1) AS n FROM lineups)""",
    "name_normalise": f"SELECT player_id, trim({B.FOLD_SQL.format('full_name')}) AS name FROM players",
    "season_year": "SELECT season, CAST(regexp_extract(season, '[0-9]{4}') AS INT) AS year, count(*) AS n FROM player_season_stats GROUP BY season",
    "position_map": f"""WITH raw AS (SELECT positions[1].position AS pos FROM lineups WHERE len(positions) > 0)
SELECT CASE WHEN pos = 'Goalkeeper' THEN 'GK' WHEN pos IN ('Center Back','Left Center Back','Right Center Back') THEN 'DC'
  WHEN pos IN ('Left Back','Right Back','Left Wing Back','Right Wing Back') THEN 'FB' WHEN pos LIKE '%Defensive Midfield' THEN 'DM'
  WHEN pos IN ('Left Center Midfield','Right Center Midfield') THEN 'CM' WHEN pos LIKE '%Attacking Midfield' THEN 'AM'
  WHEN pos IN ('Left Midfield','Right Midfield','Left Wing','Right Wing') THEN 'W' WHEN pos LIKE '%Center Forward' THEN 'ST' END AS position_group, count(*) AS n
FROM raw GROUP BY 1""",
    "market_normalise": f"""SELECT CAST(market_player_id AS VARCHAR) AS source_id, name AS raw_name,
  CASE sub_position WHEN 'Goalkeeper' THEN 'GK' WHEN 'Centre-Back' THEN 'DC' WHEN 'Left-Back' THEN 'FB' WHEN 'Right-Back' THEN 'FB'
  WHEN 'Defensive Midfield' THEN 'DM' WHEN 'Central Midfield' THEN 'CM' WHEN 'Attacking Midfield' THEN 'AM' WHEN 'Second Striker' THEN 'AM' WHEN 'Centre-Forward' THEN 'ST'
  ELSE CASE WHEN sub_position IS NOT NULL THEN 'W' END END AS position_group,
  CASE WHEN lower(trim(foot)) IN ('left','right','both') THEN lower(trim(foot)) END AS foot, {B.BORN_SQL} AS birth_date,
  TRY_CAST(left(contract_expiration_date, 10) AS DATE) AS contract_until, CAST(trunc(height_in_cm) AS SMALLINT) AS height_cm, CAST(trunc(market_value_in_eur) AS BIGINT) AS market_value_eur,
  coalesce(country_of_citizenship, '') AS countries FROM market_players""",
    "age_years": f"SELECT player_id, CAST(date_part('year', age(DATE '{B.AS_OF}', birth_date)) AS INT) AS age FROM players",
    "format_metric": """SELECT player_id, season, peer_group_id, metric, CASE WHEN metric = 'dribble_success_rate' THEN CAST(CAST(floor(raw_value * 100 + 0.5) AS BIGINT) AS VARCHAR) || ' %'
  ELSE printf('%.2f', floor(raw_value * 100 + 0.5) / 100) END AS shown FROM (SELECT DISTINCT * FROM player_percentiles) WHERE raw_value IS NULL OR NOT isnan(raw_value)""",
    "json_extract": "SELECT event_type, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS sum_k, count(props->>'k') AS n FROM events GROUP BY event_type",
    "period_clocks": """SELECT match_id, CAST(least(list_max(map_keys(period_end)), 4) AS INT) AS last_period, p AS period, round(period_start[p], 6) AS start, round(period_end[p], 6) AS "end"
FROM (SELECT match_id, unnest(map_keys(period_start)) AS p, period_start, period_end FROM matches)""",
    "event_counts": f"WITH {COUNTS_SQL} SELECT match_id, player_id, {', '.join(f'round({c}, 6) AS {c}' for c in E.COUNTERS)} FROM cnt",
    "per90_metrics": f"""WITH {COUNTS_SQL}, mins AS (SELECT CAST(player_id AS INT) AS player_id, count(*) * 10.0::DOUBLE AS minutes FROM ev WHERE period <= 4 GROUP BY 1),
tot AS (SELECT player_id, minutes, {', '.join(f'sum({c}) AS {c}' for c in E.COUNTERS)} FROM cnt JOIN mins USING (player_id) GROUP BY ALL)
SELECT player_id, minutes, {', '.join(f'round({v}, 9) AS {k}' for k, v in RATE.items())} FROM tot""",
    "stint_minutes": f"WITH {PLAYED_SQL} SELECT match_id, team, player_id, position_group, round(minutes, 6) AS minutes FROM app",
    "season_totals": f"""WITH {PLAYED_SQL}, mp AS (SELECT player_id, season, pos, row_number() OVER (PARTITION BY player_id, season ORDER BY count(*) DESC, pos) AS n FROM app WHERE pos IS NOT NULL GROUP BY player_id, season, pos),
mt AS (SELECT player_id, season, team_id, row_number() OVER (PARTITION BY player_id, season ORDER BY count(*) DESC, team_id) AS n FROM app WHERE team_id IS NOT NULL GROUP BY player_id, season, team_id)
SELECT a.player_id, a.season, round(sum(minutes), 6) AS minutes, count(DISTINCT match_id) AS matches_played,
  first(player_name ORDER BY match_id, player_name) FILTER (WHERE player_name IS NOT NULL) AS player_name, first(country ORDER BY match_id, country) FILTER (WHERE country IS NOT NULL) AS country,
  any_value(mt.team_id) AS team_id, any_value(mp.pos) AS position, any_value({GROUP_SQL.replace("pos ", "mp.pos ")}) AS position_group
FROM app a LEFT JOIN mp ON a.player_id = mp.player_id AND a.season = mp.season AND mp.n = 1 LEFT JOIN mt ON a.player_id = mt.player_id AND a.season = mt.season AND mt.n = 1 GROUP BY a.player_id, a.season""",
    "peer_percentiles": f"WITH {B.STATS_SQL}, {B.MEMBERS_SQL} SELECT player_id, season, peer_group_id, metric, raw_value + 0.0 AS raw_value, percentile FROM pct",
    "peer_groups": f"WITH {B.STATS_SQL}, {B.PEER_GROUPS_SQL} SELECT * FROM pgs",
    "own_group_percentiles": """WITH o AS (SELECT player_id, season, metric, max(percentile) AS percentile FROM player_percentiles WHERE split_part(peer_group_id, '|', 3) = season GROUP BY ALL)
SELECT player_id, season, string_agg(metric || '=' || percentile, ',' ORDER BY metric || '=' || percentile) AS percentiles FROM o GROUP BY player_id, season""",
    "scaled_metrics": f"WITH {SCALED_SQL} SELECT player_id, season, competition_id, club_id, metric, round(x, 5) + 0.0 AS scaled FROM scl",
    "style_unit_vectors": f"""WITH {SCALED_SQL}, nrm AS (SELECT player_id, season, competition_id, club_id, sqrt(sum(x * x)) AS n FROM scl GROUP BY ALL)
SELECT player_id, season, competition_id, club_id, round(max(CASE WHEN metric = '{KEYS[0]}' THEN x END) / any_value(CASE WHEN n > 0 THEN n ELSE 1 END), 5) + 0.0 AS first,
  round(max(CASE WHEN metric = '{KEYS[-1]}' THEN x END) / any_value(CASE WHEN n > 0 THEN n ELSE 1 END), 5) + 0.0 AS last
FROM scl JOIN nrm USING (player_id, season, competition_id, club_id) GROUP BY ALL""",
    "style_similarity_topk": _similar_sql("style_vec"),
    "quality_similarity_topk": _similar_sql("quality_vec"),
    "embedding_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS target, e.vec_id, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 9) AS c FROM e, e q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT target, vec_id, CAST(row_number() OVER w AS INT) AS place, round(c, 6) AS similarity FROM s WINDOW w AS (PARTITION BY target ORDER BY c DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}
