"""Queries on identity, search, sheets, lists and upserts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.scalars import french_date, labelled, millions, percent
from turfline.functions.text import normalize_name
from turfline.operators import identity, ingest, merge, peers, search
from turfline.plans import binding as B
from turfline.registry import POSITION_LABELS, SEARCH_RADAR, SHEET_RADAR, STATUS_LABELS
from turfline.schema import TABLES
from turfline.session import table

def alias_first(spark: SparkSession, d: str) -> DataFrame:
    """Market records with the player their alias names, or as unknown."""
    records = table(spark, d, "market_players").select(F.lit("transfermarkt").alias("source"), F.col("market_player_id").cast("string").alias("source_id"))
    known, rest = identity.with_aliases(records, table(spark, d, "player_aliases"))
    return known.select("source_id", "player_id", "outcome").unionByName(rest.select("source_id", F.lit(None).cast("int").alias("player_id"), F.lit("unknown").alias("outcome")))


# -- search and sheets

FILTERS = search.Filters(positions=("CM", "DM", "ST"), foot="right", age_min=18, age_max=32, minutes_min=600, contract_before="2030-12-31", market_value_max=20_000_000, tier=1)


def _search(spark: SparkSession, d: str, filters: search.Filters, before: bool = False) -> DataFrame:
    facts = B.stats_only(spark, d).select("player_id", "season", "competition_id", "club_id", "minutes")
    as_of = F.lit(B.AS_OF).cast("date")
    return search.search(facts, B.clean_players(spark, d), B.competitions(spark, d), B.percentiles(spark, d), filters, as_of, before)


def search_basic(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, FILTERS)


def _threshold() -> search.Filters:
    return search.Filters.parse({"positions": "CM,DM,ST", "metric": "xg", "percentileMin": "60", "minutesMin": 600})


def search_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, _threshold())


def search_threshold_first(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, _threshold(), True)


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """A saved search for every position group and foot of the players, the criteria as JSON."""
    pairs = B.clean_players(spark, d).filter("foot in ('left', 'right', 'both')").select("position_group", "foot").distinct()
    new = pairs.select(F.concat_ws(" ", "position_group", "foot").alias("name"), F.array("position_group").alias("positions"), "foot", F.lit(27).alias("ageMax"), F.lit("0").alias("minutesMin"))
    empty = spark.createDataFrame([], TABLES["saved_searches"])
    return ingest.save_search(empty, new, F.lit("2025-01-01 00:00:00").cast("timestamp"))


def saved_searches(spark: SparkSession, d: str) -> DataFrame:
    """Saved searches after those of left feet are deleted and those of strikers touched, the newest first."""
    rows = _saved(spark, d)
    rows = ingest.delete_searches(rows, rows.filter("name like '% left'"))
    rows = ingest.touch_searches(rows, rows.filter("name like 'ST %'"), F.lit("2025-07-01 00:00:00").cast("timestamp"))
    shown = search.newest_first(rows, "created_at", "id").select("id", "name", F.from_json("filters", "positions array<string>, foot string, ageMax int, minutesMin string").alias("f"), "last_checked_at")
    return shown.select("id", "name", F.array_join("f.positions", ",").alias("positions"), "f.foot", F.col("f.ageMax").alias("age_max"), french_date(F.col("last_checked_at")).alias("checked"))


def saved_search(spark: SparkSession, d: str) -> DataFrame:
    """The stored search of right-footed strikers, run again from its JSON."""
    stored = _saved(spark, d).filter("name = 'ST right'").select("filters").first()  # the criteria shape the plan
    return _search(spark, d, search.Filters.parse(json.loads(stored[0]) if stored else {}))


def search_radar(spark: SparkSession, d: str) -> DataFrame:
    rows = search.radars(_search(spark, d, FILTERS), B.percentiles(spark, d).groupBy("player_id", "season", "metric").agg(F.max("percentile").alias("percentile")), SEARCH_RADAR)
    pairs = F.transform("radar", lambda e: F.concat(e["metric"], F.lit("="), e["percentile"].cast("string")))
    return rows.select("player_id", "season", F.array_join(pairs, ",").alias("radar"))


def players_list(spark: SparkSession, d: str) -> DataFrame:
    """Season rows with names, those of most minutes first."""
    rows = B.stats_only(spark, d).join(table(spark, d, "players"), "player_id").join(B.competitions(spark, d), "competition_id")
    rows = rows.select("player_id", "full_name", "season", "competition_name", "club_id", "minutes", "matches_played")
    return rows.orderBy(F.desc_nulls_last("minutes"), "player_id", "season", "club_id")


def player_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Radar metrics of the seasons of every player, in the group of the season itself, with the group's label and size."""
    rows = peers.own_group(B.percentiles(spark, d)).filter(F.col("metric").isin(SHEET_RADAR))
    rows = search.with_groups(rows, peers.peer_groups(B.stats(spark, d)))
    return rows.select("player_id", "season", "peer_group_id", "metric", F.round("raw_value", 6).alias("raw_value"), "percentile", "label", "sample_size").distinct()


def percentile_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows and largest percentile of every player by label of peer group."""
    rows = search.with_groups(B.percentiles(spark, d), peers.peer_groups(B.stats(spark, d)))
    return rows.groupBy("player_id", "label").agg(F.count("*").alias("n"), F.max("percentile").alias("best"), F.max("sample_size").alias("sample_size"))


def report_latest(spark: SparkSession, d: str) -> DataFrame:
    """Report of every player: last season, radar, rating from the confidence of its aliases, verdicts from the lists."""
    aliases = table(spark, d, "player_aliases").filter("player_id is not null")
    notes = aliases.select(F.col("alias_id").alias("id"), "player_id", "created_at", F.col("confidence").cast("double").alias("rating"))
    out = search.report(B.stats_only(spark, d).drop("metrics"), peers.own_group(B.percentiles(spark, d)), notes, _entries(spark, d))
    text = lambda c, key, value: F.array_join(F.transform(c, lambda e: F.concat(e[key].cast("string"), F.lit("="), e[value].cast("string"))), ",")
    return out.select("player_id", "season", "minutes", "club_id", "eligible", text("radar", "metric", "percentile").alias("radar"), "rating", text("verdicts", "shortlist_id", "status").alias("verdicts"))


def display_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of players as they are shown."""
    p = table(spark, d, "players")
    return p.select("player_id", millions(F.col("market_value_eur")).alias("value"), french_date(F.col("contract_until")).alias("until"), F.array_join("nationality", ", ").alias("countries"),
                    labelled(F.upper(F.trim("position_group")), POSITION_LABELS).alias("position"))


def notes_list(spark: SparkSession, d: str) -> DataFrame:
    """Aliases as notes, the newest first."""
    rows = table(spark, d, "player_aliases").filter("player_id is not null")
    return search.newest_first(rows, "created_at", "alias_id").select("alias_id", "player_id", french_date(F.col("created_at")).alias("day"), percent(F.col("confidence").cast("double")).alias("rating"))


def latest_value(spark: SparkSession, d: str) -> DataFrame:
    """Last known confidence per player, in time order of its aliases."""
    aliases = table(spark, d, "player_aliases").filter("player_id is not null")
    return search.latest_known(aliases, ["player_id"], "confidence", "created_at", "alias_id").select("player_id", F.col("confidence").cast("double").alias("confidence"))


def radar_polygon(spark: SparkSession, d: str) -> DataFrame:
    rows = B.percentiles(spark, d).filter(F.col("metric").isin(SHEET_RADAR) & (F.substring_index("peer_group_id", "|", -1) == F.col("season")))
    return search.radar_points(rows.groupBy("player_id", "season", "metric").agg(F.max("percentile").alias("percentile")))


# -- lists: a club is a shortlist, its players are the entries


def _entries(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "players").filter("current_club_id is not null")
    return p.select(F.col("current_club_id").alias("shortlist_id"), "player_id", F.when(F.col("player_id") % 3 > 0, F.col("player_id") % 7).cast("int").alias("rank"), F.col("updated_at").alias("added_at"), F.element_at(F.array(*[F.lit(x) for x in STATUS_LABELS]), F.coalesce(F.col("height_cm").cast("int"), F.lit(0)) % 4 + 1).alias("status"))


def shortlist_counts(spark: SparkSession, d: str) -> DataFrame:
    """Shortlists with their number of entries, empty ones too."""
    clubs = table(spark, d, "market_players").select(F.col("current_club_id").alias("shortlist_id")).filter("shortlist_id is not null").distinct()
    n = _entries(spark, d).groupBy("shortlist_id").agg(F.count("player_id").alias("n"))
    return clubs.join(n, "shortlist_id", "left").select("shortlist_id", F.coalesce("n", F.lit(0)).alias("n"))


def shortlist_order(spark: SparkSession, d: str) -> DataFrame:
    return search.ordered_entries(_entries(spark, d)).select("shortlist_id", "player_id", "place", F.col("rank").cast("int").alias("rank"))


def shortlist_detail(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the lists with their players, in order."""
    rows = search.listed(_entries(spark, d), table(spark, d, "players"))
    return rows.select("shortlist_id", "place", "player_id", "full_name", "position_group", labelled(F.col("status"), STATUS_LABELS).alias("status"))


def shortlist_move(spark: SparkSession, d: str) -> DataFrame:
    """The lowest player id of every list moves one place up."""
    entries = _entries(spark, d)
    moves = entries.groupBy("shortlist_id").agg(F.min("player_id").alias("player_id")).withColumn("step", F.lit(-1))
    return search.moved_entries(entries, moves).select("shortlist_id", "player_id", F.col("rank").cast("int").alias("rank"))


COUNTED = ["players", "player_aliases", "market_players", "matches", "lineups", "player_season_stats", "player_percentiles", "player_vectors", "documents", "eval_items", "mix_targets"]


def health_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.counts({t: table(spark, d, t) for t in COUNTED})


def last_run(spark: SparkSession, d: str) -> DataFrame:
    """The latest load per source and the latest of all."""
    rows = table(spark, d, "player_season_stats").groupBy("source").agg(F.max("ingested_at").alias("ingested_at"), F.count("*").alias("n"))
    return rows.orderBy(F.desc("ingested_at"), "source").limit(1)


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return alias_first(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


# -- upserts


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """Market records of resolved aliases as updates of players: the smallest record per player."""
    alias = table(spark, d, "player_aliases").filter("source = 'transfermarkt' and player_id is not null").select("player_id", F.trim("source_id").cast("int").alias("mid"))
    first = alias.groupBy("player_id").agg(F.min("mid").alias("mid"))
    m = table(spark, d, "market_players")
    return m.join(first, m["market_player_id"] == first["mid"]).select(
        "player_id", F.col("name").alias("full_name"), F.col("height_in_cm").cast("smallint").alias("height_cm"), F.col("market_value_in_eur").cast("bigint").alias("market_value_eur"),
        F.create_map(F.lit("transfermarkt"), F.col("mid").cast("string")).alias("source_ids"),
    )


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Players updated from market records, unknown values overwriting known ones, and records of ids beyond them added."""
    old = table(spark, d, "players").select("player_id", "full_name", "height_cm", "market_value_eur", "source_ids")
    added = _updates(spark, d).withColumn("player_id", F.col("player_id") + 1_000_000)
    out = merge.upsert(old, _updates(spark, d).unionByName(added), ["player_id"], ["height_cm", "market_value_eur"], ["source_ids"])
    return out.select("player_id", "full_name", "height_cm", "market_value_eur", F.col("source_ids")["transfermarkt"].alias("market_id"), F.size("source_ids").alias("ids"))


def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Ids of players after merging the ids of their aliases, as one text."""
    new = table(spark, d, "player_aliases").filter("player_id is not null").groupBy("player_id", "source").agg(F.max("source_id").alias("id"))
    new = new.groupBy("player_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "id")))).alias("source_ids"))
    old = table(spark, d, "players").select("player_id", "source_ids")
    out = merge.upsert(old, new, ["player_id"], [], ["source_ids"])
    pairs = F.transform(F.map_entries("source_ids"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?"))))
    return out.select("player_id", F.array_join(F.array_sort(pairs), ",").alias("ids"))


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Aliases and those market records whose (source, source_id) is not among them."""
    old = table(spark, d, "player_aliases").groupBy("source", "source_id").agg(F.min("raw_name").alias("raw_name"))
    new = table(spark, d, "market_players").select(F.lit("transfermarkt").alias("source"), F.col("market_player_id").cast("string").alias("source_id"), F.col("name").alias("raw_name"))
    return merge.insert_missing(old, new, ["source", "source_id"]).select("source", "source_id", "raw_name")


def club_match_or(spark: SparkSession, d: str) -> DataFrame:
    """Market records matched to a player of the same club and height, else of the same name."""
    left = table(spark, d, "market_players").select("market_player_id", F.col("current_club_id").alias("club"), F.col("height_in_cm").cast("int").alias("height"), normalize_name(F.col("name")).alias("name"))
    right = table(spark, d, "players").select("player_id", F.col("current_club_id").alias("club_id"), F.col("height_cm").cast("int").alias("height_cm"), normalize_name(F.col("full_name")).alias("full"))
    return merge.first_match(left, right, [{"club": "club_id", "height": "height_cm"}, {"name": "full"}], "market_player_id", "player_id")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left after the matches of one competition are deleted with their line-ups."""
    m, l = table(spark, d, "matches"), table(spark, d, "lineups")
    kept, lines = merge.delete_cascade(m.select("match_id", "competition_id"), l.select("match_id", "player_id"), m.filter("competition_id = 11"), "match_id", "match_id")
    return search.counts({"matches": kept, "lineups": lines})


QUERIES = {
    "alias_first": alias_first, "search_basic": search_basic, "search_threshold": search_threshold, "search_threshold_first": search_threshold_first,
    "saved_search_rerun": saved_search, "saved_searches": saved_searches, "search_radar": search_radar, "players_list": players_list, "player_sheet": player_sheet,
    "percentile_groups": percentile_groups, "report_latest": report_latest, "display_values": display_values, "notes_list": notes_list,
    "latest_known_value": latest_value, "radar_points": radar_polygon, "shortlist_counts": shortlist_counts, "shortlist_order": shortlist_order, "shortlist_detail": shortlist_detail,
    "shortlist_move": shortlist_move, "health_counts": health_counts, "last_run": last_run, "outcome_counts": outcome_counts, "upsert_merge": upsert_merge,
    "map_merge": map_merge, "insert_ignore": insert_ignore, "club_match_or": club_match_or, "cascade_delete": cascade_delete,
}

COLUMNS = "player_id, full_name, position_group, season, minutes, club_id, competition_name, contract_until, market_value_eur"
FOUND_SQL = f"""{B.COMPETITIONS_SQL},
st AS (SELECT DISTINCT ON (player_id, season, competition_id, club_id) * FROM player_season_stats ORDER BY ingested_at DESC, minutes DESC, matches_played DESC NULLS LAST),
pl AS (SELECT * REPLACE (upper(trim(position_group)) AS position_group) FROM players WHERE upper(trim(position_group)) IN {B.GROUPS_SQL}),
base AS (SELECT player_id, full_name, position_group, foot, season, minutes, club_id, competition_name, contract_until, market_value_eur, tier, date_part('year', age(DATE '{B.AS_OF}', birth_date)) AS years FROM st JOIN pl USING (player_id) JOIN comps USING (competition_id))
"""
ORDER = "ORDER BY minutes DESC NULLS LAST, player_id, season, club_id, competition_name LIMIT 200"
BASIC = "position_group IN ('CM','DM','ST') AND foot = 'right' AND years >= 18 AND years <= 32 AND minutes >= 600 AND contract_until <= DATE '2030-12-31' AND market_value_eur <= 20000000 AND tier = 1"
ABLE = "(player_id, season) IN (SELECT player_id, season FROM player_percentiles WHERE metric = 'xg' AND percentile >= 60)"
ENTRIES_SQL = "en AS (SELECT current_club_id AS shortlist_id, player_id, CASE WHEN player_id % 3 > 0 THEN CAST(player_id % 7 AS INT) END AS rank, updated_at AS added_at, (['a_observer','observe','prioritaire','ecarte'])[coalesce(height_cm, 0) % 4 + 1] AS status FROM players WHERE current_club_id IS NOT NULL)"
PLACED_SQL = f"{ENTRIES_SQL}, od AS (SELECT *, row_number() OVER (PARTITION BY shortlist_id ORDER BY rank NULLS LAST, added_at, player_id) - 1 AS place FROM en), ex AS (SELECT *, coalesce(rank, place) AS r FROM od)"
UPDATES_SQL = """
fi AS (SELECT player_id, min(CAST(trim(source_id) AS INT)) AS mid FROM player_aliases WHERE source = 'transfermarkt' AND player_id IS NOT NULL GROUP BY player_id),
up AS (SELECT player_id, mid, name, CAST(trunc(height_in_cm) AS SMALLINT) AS h, CAST(trunc(market_value_in_eur) AS BIGINT) AS v FROM fi JOIN market_players ON mid = market_player_id)
"""
SHEET = ", ".join(f"'{k}'" for k in SHEET_RADAR)

ORACLES = {
    "alias_first": """SELECT CAST(m.market_player_id AS VARCHAR) AS source_id, a.player_id, CASE WHEN a.player_id IS NULL THEN 'unknown' ELSE 'already_known' END AS outcome
FROM market_players m LEFT JOIN (SELECT source_id, min(player_id) AS player_id FROM player_aliases WHERE source = 'transfermarkt' AND player_id IS NOT NULL GROUP BY source_id) a
  ON a.source_id = CAST(m.market_player_id AS VARCHAR)""",
    "outcome_counts": """SELECT CASE WHEN a.source_id IS NULL THEN 'unknown' ELSE 'already_known' END AS outcome, count(*) AS n
FROM market_players m LEFT JOIN (SELECT DISTINCT source_id FROM player_aliases WHERE source = 'transfermarkt' AND player_id IS NOT NULL) a
  ON a.source_id = CAST(m.market_player_id AS VARCHAR) GROUP BY 1""",
    "search_basic": f"WITH {FOUND_SQL} SELECT {COLUMNS} FROM base WHERE {BASIC} {ORDER}",
    "search_threshold": f"WITH {FOUND_SQL} SELECT * FROM (SELECT {COLUMNS} FROM base WHERE position_group IN ('CM','DM','ST') AND minutes >= 600 {ORDER}) WHERE {ABLE}",
    "search_threshold_first": f"WITH {FOUND_SQL} SELECT {COLUMNS} FROM base WHERE position_group IN ('CM','DM','ST') AND minutes >= 600 AND {ABLE} {ORDER}",
    "saved_search_rerun": f"WITH {FOUND_SQL} SELECT {COLUMNS} FROM base WHERE position_group = 'ST' AND foot = 'right' AND years <= 27 AND minutes >= 0 {ORDER}",
    "saved_searches": f"""WITH pr AS (SELECT DISTINCT upper(trim(position_group)) AS g, foot FROM players WHERE upper(trim(position_group)) IN {B.GROUPS_SQL} AND foot IN ('left','right','both')),
nm AS (SELECT *, CAST(row_number() OVER (ORDER BY g || ' ' || foot) AS INT) AS id FROM pr)
SELECT id, g || ' ' || foot AS name, g AS positions, foot, 27 AS age_max, CASE WHEN g = 'ST' THEN '01/07/2025' END AS checked FROM nm WHERE foot <> 'left'""",
    "search_radar": f"""WITH {FOUND_SQL}, fd AS (SELECT DISTINCT player_id FROM (SELECT {COLUMNS} FROM base WHERE {BASIC} {ORDER})),
rd AS (SELECT player_id, season, metric, max(percentile) AS percentile FROM player_percentiles WHERE player_id IN (SELECT player_id FROM fd)
  AND metric IN ({", ".join(f"'{k}'" for k in SEARCH_RADAR)}) GROUP BY ALL)
SELECT player_id, season, string_agg(metric || '=' || percentile, ',' ORDER BY metric) AS radar FROM rd GROUP BY player_id, season""",
    "players_list": f"""WITH {B.COMPETITIONS_SQL}, st AS (SELECT DISTINCT ON (player_id, season, competition_id, club_id) * FROM player_season_stats ORDER BY ingested_at DESC, minutes DESC, matches_played DESC NULLS LAST)
SELECT player_id, full_name, season, competition_name, club_id, minutes, matches_played FROM st JOIN players USING (player_id) JOIN comps USING (competition_id)""",
    "player_sheet": f"""WITH {B.STATS_SQL}, {B.PEER_GROUPS_SQL}
SELECT DISTINCT player_id, season, peer_group_id, metric, round(raw_value, 6) AS raw_value, percentile, label, sample_size FROM player_percentiles JOIN (SELECT peer_group_id, label, sample_size FROM pgs) USING (peer_group_id)
WHERE metric IN ({SHEET}) AND split_part(peer_group_id, '|', 3) = season""",
    "percentile_groups": f"""WITH {B.STATS_SQL}, {B.PEER_GROUPS_SQL}
SELECT player_id, label, count(*) AS n, max(percentile) AS best, max(sample_size) AS sample_size FROM (SELECT DISTINCT * FROM player_percentiles) JOIN pgs USING (peer_group_id) GROUP BY player_id, label""",
    "report_latest": f"""WITH {ENTRIES_SQL}, st AS (SELECT DISTINCT ON (player_id, season, competition_id, club_id) * FROM player_season_stats ORDER BY ingested_at DESC, minutes DESC, matches_played DESC NULLS LAST),
la AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY season DESC, minutes DESC, competition_id, club_id) = 1),
bm AS (SELECT player_id, season, metric, max(percentile) AS p FROM player_percentiles WHERE split_part(peer_group_id, '|', 3) = season AND metric IN ({SHEET}) GROUP BY ALL),
ra AS (SELECT player_id, season, string_agg(metric || '=' || p, ',' ORDER BY metric) AS radar FROM bm GROUP BY player_id, season),
rt AS (SELECT player_id, CAST(arg_max(confidence, (created_at, alias_id)) FILTER (WHERE confidence IS NOT NULL) AS DOUBLE) AS rating FROM player_aliases WHERE player_id IS NOT NULL GROUP BY player_id),
ve AS (SELECT player_id, string_agg(shortlist_id || '=' || status, ',' ORDER BY shortlist_id, status) AS verdicts FROM (SELECT DISTINCT player_id, shortlist_id, status FROM en) GROUP BY player_id)
SELECT player_id, season, minutes, club_id, minutes >= 600 AS eligible, radar, rating, coalesce(verdicts, '') AS verdicts FROM la LEFT JOIN ra USING (player_id, season) LEFT JOIN rt USING (player_id) LEFT JOIN ve USING (player_id)""",
    "display_values": """SELECT player_id, CASE WHEN market_value_eur IS NOT NULL THEN CASE WHEN market_value_eur <= -50000 THEN '-' ELSE '' END || ((abs(market_value_eur) + 50000) // 100000) // 10 || '.' || ((abs(market_value_eur) + 50000) // 100000) % 10 || ' M€' END AS value,
  strftime(contract_until, '%d/%m/%Y') AS until, CASE WHEN nationality IS NOT NULL THEN coalesce(array_to_string(nationality, ', '), '') END AS countries,
  CASE upper(trim(position_group)) WHEN 'GK' THEN 'Gardiens' WHEN 'DC' THEN 'Défenseurs centraux' WHEN 'FB' THEN 'Latéraux' WHEN 'DM' THEN 'Milieux défensifs' WHEN 'CM' THEN 'Milieux centraux'
    WHEN 'AM' THEN 'Milieux offensifs' WHEN 'W' THEN 'Ailiers' WHEN 'ST' THEN 'Attaquants' ELSE upper(trim(position_group)) END AS position FROM players""",
    "notes_list": "SELECT alias_id, player_id, strftime(created_at, '%d/%m/%Y') AS day, CAST(floor(CAST(confidence AS DOUBLE) * 100 + 0.5) AS BIGINT) || ' %' AS rating FROM player_aliases WHERE player_id IS NOT NULL",
    "latest_known_value": """SELECT player_id, CAST(arg_max(confidence, (created_at, alias_id)) FILTER (WHERE confidence IS NOT NULL) AS DOUBLE) AS confidence
FROM player_aliases WHERE player_id IS NOT NULL GROUP BY player_id""",
    "radar_points": f"""WITH r AS (SELECT player_id, season, metric, max(percentile) AS p FROM player_percentiles WHERE metric IN ({SHEET}) AND split_part(peer_group_id, '|', 3) = season GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY metric) - 1 AS i, count(*) OVER (PARTITION BY player_id, season) AS n FROM r)
SELECT player_id, season, metric, round(cos(-pi() / 2 + 2 * pi() * i / n) * (greatest(least(p, 100), 0) / 100.0 * 100), 4) + 0.0 AS x,
  round(sin(-pi() / 2 + 2 * pi() * i / n) * (greatest(least(p, 100), 0) / 100.0 * 100), 4) + 0.0 AS y FROM i WHERE n >= 3""",
    "shortlist_counts": f"""WITH {ENTRIES_SQL} SELECT c.shortlist_id, count(e.player_id) AS n FROM (SELECT DISTINCT current_club_id AS shortlist_id FROM market_players WHERE current_club_id IS NOT NULL) c
LEFT JOIN en e USING (shortlist_id) GROUP BY c.shortlist_id""",
    "shortlist_order": f"WITH {PLACED_SQL} SELECT shortlist_id, player_id, CAST(place AS INT) AS place, CAST(r AS INT) AS rank FROM ex",
    "shortlist_detail": f"""WITH {PLACED_SQL} SELECT shortlist_id, CAST(place AS INT) AS place, player_id, full_name, position_group,
  CASE status WHEN 'a_observer' THEN 'À observer' WHEN 'observe' THEN 'Observé' WHEN 'prioritaire' THEN 'Prioritaire' ELSE 'Écarté' END AS status FROM ex JOIN players USING (player_id)""",
    "shortlist_move": f"""WITH {PLACED_SQL}, mv AS (SELECT shortlist_id, min(player_id) AS player_id FROM en GROUP BY shortlist_id),
sw AS (SELECT x.shortlist_id, x.place AS a, y.place AS b, x.r AS ra, y.r AS rb FROM ex x JOIN mv USING (shortlist_id, player_id) JOIN ex y ON y.shortlist_id = x.shortlist_id AND y.place = x.place - 1)
SELECT ex.shortlist_id, ex.player_id, CAST(CASE WHEN sw.a IS NULL THEN ex.rank WHEN ex.place = sw.a THEN rb WHEN ex.place = sw.b THEN ra ELSE ex.r END AS INT) AS rank
FROM ex LEFT JOIN sw USING (shortlist_id)""",
    "health_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in COUNTED),
    "last_run": "SELECT source, max(ingested_at) AS ingested_at, count(*) AS n FROM player_season_stats GROUP BY source ORDER BY 2 DESC, 1 LIMIT 1",
    "upsert_merge": f"""WITH {UPDATES_SQL}
SELECT p.player_id, p.full_name, CASE WHEN u.player_id IS NOT NULL THEN h ELSE height_cm END AS height_cm, CASE WHEN u.player_id IS NOT NULL THEN v ELSE market_value_eur END AS market_value_eur,
  coalesce(CAST(mid AS VARCHAR), source_ids['transfermarkt']) AS market_id,
  CAST(CASE WHEN u.player_id IS NULL THEN cardinality(source_ids) ELSE coalesce(cardinality(source_ids), 0) + CASE WHEN list_contains(map_keys(source_ids), 'transfermarkt') THEN 0 ELSE 1 END END AS INT) AS ids
FROM players p LEFT JOIN up u USING (player_id)
UNION ALL SELECT player_id + 1000000, name, h, v, CAST(mid AS VARCHAR), 1 FROM up""",
    "map_merge": """WITH nw AS (SELECT player_id, source AS k, max(source_id) AS v FROM player_aliases WHERE player_id IS NOT NULL GROUP BY ALL),
od AS (SELECT player_id, unnest(map_keys(source_ids)) AS k, unnest(map_values(source_ids)) AS v FROM players),
al AS (SELECT * FROM nw UNION ALL SELECT o.* FROM od o LEFT JOIN nw USING (player_id, k) WHERE nw.player_id IS NULL),
kn AS (SELECT player_id, string_agg(k || '=' || coalesce(v, '?'), ',' ORDER BY k || '=' || coalesce(v, '?')) AS ids FROM al GROUP BY player_id)
SELECT player_id, coalesce(ids, CASE WHEN source_ids IS NOT NULL THEN '' END) AS ids FROM players LEFT JOIN kn USING (player_id)
UNION ALL SELECT player_id, ids FROM kn WHERE player_id NOT IN (SELECT player_id FROM players)""",
    "insert_ignore": """WITH od AS (SELECT source, source_id, min(raw_name) AS raw_name FROM player_aliases GROUP BY ALL)
SELECT * FROM od UNION ALL SELECT 'transfermarkt', CAST(market_player_id AS VARCHAR), name FROM market_players m
WHERE NOT EXISTS (SELECT 1 FROM od WHERE source = 'transfermarkt' AND source_id = CAST(m.market_player_id AS VARCHAR))""",
    "club_match_or": f"""WITH l AS (SELECT market_player_id, current_club_id AS club, CAST(trunc(height_in_cm) AS INT) AS height, trim({B.FOLD_SQL.format('name')}) AS name FROM market_players),
r AS (SELECT player_id, current_club_id AS club, CAST(height_cm AS INT) AS height, trim({B.FOLD_SQL.format('full_name')}) AS name FROM players),
a AS (SELECT club, height, min(player_id) AS p FROM r GROUP BY ALL), b AS (SELECT name, min(player_id) AS p FROM r GROUP BY ALL)
SELECT market_player_id, coalesce(a.p, b.p) AS player_id FROM l LEFT JOIN a ON l.club = a.club AND l.height = a.height LEFT JOIN b ON l.name = b.name""",
    "cascade_delete": """SELECT 'matches' AS name, count(*) AS n FROM matches WHERE competition_id <> 11
UNION ALL SELECT 'lineups', count(*) FROM lineups WHERE match_id NOT IN (SELECT match_id FROM matches WHERE competition_id = 11)""",
}
