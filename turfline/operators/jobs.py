"""The three loads, from source rows to the warehouse tables that replace the old ones.

Each takes the tables by name (``schema.TABLES``) and gives those that changed, the outcome of every record and how many
season rows or players it wrote; ``sources.store`` commits them together.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.functions.scalars import foot_of, lenient_date, looked_up
from turfline.functions.text import normalize_name
from turfline.operators.events import competition_metrics, provider_metrics
from turfline.operators.ingest import insert_players, league_competitions, resolve, update_players, upsert_clubs, upsert_competitions, upsert_season_stats
from turfline.operators.merge import once
from turfline.registry import MARKET_POSITIONS, METRIC_KEYS
from turfline.session import cut


class Load(NamedTuple):
    """``tables`` that replace the old ones, ``outcomes`` (source_id, outcome, player_id) and the rows ``written``."""

    tables: dict[str, DataFrame]
    outcomes: DataFrame
    written: DataFrame  # one row, one column ``n``

    def counts(self) -> DataFrame:
        """``outcome`` and number ``n`` of records."""
        return self.outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def metrics_map(keys: list[str]) -> Column:
    return F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k).cast("double"))]), lambda _, v: v.isNotNull())


def load_competition(tables: Mapping[str, DataFrame], events: DataFrame, lineups: DataFrame, matches: DataFrame, now: Column) -> Load:
    """Matches of one or more competitions and seasons: their competitions, national teams, outfield players and season rows.

    Of several names of a competition or team id the one of the smallest match counts. A player known by alias gets position and
    nationality of the last season, another is added with an alias; line-ups of teams of neither side give no season row.
    """
    source = "statsbomb"
    rows = cut(competition_metrics(events, lineups, matches).filter("team_id is not null"))
    named = once(
        matches.select("competition_id", F.col("competition_name").alias("name"), F.col("competition_country_name").alias("country"), "match_id"), ["competition_id"], ["match_id"]
    ).drop("match_id")
    new = named.select("name", "country", F.lit(1).alias("tier"), F.create_map(F.lit(source), F.col("competition_id").cast("string")).alias("source_ids"), "competition_id")
    competitions = cut(upsert_competitions(tables["competitions"], new, order=["competition_id"]))
    ids = named.join(competitions.select(F.col("id").alias("__comp"), "name", "country"), ["name", "country"]).select("competition_id", "__comp")
    sides = [matches.select(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_team").alias("name"), "match_id", "competition_id") for s in ("home", "away")]
    teams = once(sides[0].unionByName(sides[1]).filter("team_id is not null"), ["team_id"], ["match_id", "name"]).join(ids, "competition_id")
    teams = teams.select(
        "team_id", "name", normalize_name(F.col("name")).alias("normalized_name"), F.col("name").alias("country"), F.col("__comp").alias("competition_id"), F.lit(True).alias("is_national_team"),
        F.create_map(F.lit(f"{source}_team"), F.col("team_id").cast("string")).alias("source_ids"),
    )
    key = ["normalized_name", "is_national_team"]
    clubs = cut(upsert_clubs(tables["clubs"], teams, [key], order=["team_id"]))
    club_of = teams.select("team_id", *key).join(clubs.groupBy(*key).agg(F.min("id").alias("__club")), key).select("team_id", "__club")
    people = rows.withColumn("source_id", F.col("player_id").cast("string")).drop("player_id")
    latest = _latest(people)
    nations = F.filter(F.array("country"), lambda c: c.isNotNull())
    latest = latest.select(F.lit(source).alias("source"), "source_id", F.col("player_name").alias("raw_name"), nations.alias("nationality"), "position_group")
    alias = tables["player_aliases"].filter((F.col("source") == source) & F.col("player_id").isNotNull()).groupBy("source", "source_id").agg(F.min("player_id").alias("player_id"))
    found = cut(latest.join(alias, ["source", "source_id"], "left"))
    players = update_players(tables["players"], found.filter("player_id is not null"), ["position_group", "nationality"], now)
    players, aliases = insert_players(players, tables["player_aliases"], found.filter("player_id is null").drop("player_id"), now)
    players, aliases = cut(players), cut(aliases)
    who = aliases.filter(F.col("source") == source).groupBy("source_id").agg(F.min("player_id").alias("player_id"))
    stats = people.join(who, "source_id").join(ids, "competition_id").join(club_of, "team_id")
    stats = stats.select(
        "player_id", "season", F.col("__comp").alias("competition_id"), F.col("__club").alias("club_id"), F.rint("minutes").cast("int").alias("minutes"),
        F.col("matches_played").cast("smallint").alias("matches_played"), metrics_map(METRIC_KEYS).alias("metrics"), F.lit(source).alias("source"), now.alias("ingested_at"),
    )
    stats = once(stats, ["player_id", "season", "competition_id", "club_id"], ["minutes"])
    outcomes = found.select("source_id", F.when(F.col("player_id").isNull(), "new").otherwise("already_known").alias("outcome"), "player_id")
    changed = {"competitions": competitions, "clubs": clubs, "players": players, "player_aliases": aliases, "player_season_stats": upsert_season_stats(tables["player_season_stats"], stats)}
    return Load(changed, outcomes, stats.agg(F.count("*").alias("n")))


def _latest(people: DataFrame) -> DataFrame:
    """The row of each player's last season and smallest competition."""
    rest = [c for c in people.columns if c != "source_id"]
    return people.groupBy("source_id").agg(F.max_by(F.struct(*rest), F.struct("season", -F.col("competition_id"))).alias("__r")).select("source_id", "__r.*")


def market_records(market: DataFrame) -> DataFrame:
    """Market records in the canonical form of players, with ``source``, ``source_id`` and ``raw_name``.

    The country is a list of one or none; unreadable dates are null, unknown positions an error; the club stays the source's.
    """
    nation = F.col("country_of_citizenship")
    return market.filter("player_id is not null").select(
        F.lit("transfermarkt").alias("source"), F.col("player_id").cast("string").alias("source_id"), F.col("name").alias("raw_name"), lenient_date(F.col("date_of_birth")).alias("birth_date"),
        F.when(nation.isNotNull(), F.array(nation)).otherwise(F.array().cast("array<string>")).alias("nationality"), foot_of(F.col("foot")).alias("foot"),
        F.col("height_in_cm").cast("smallint").alias("height_cm"), looked_up(F.col("sub_position"), MARKET_POSITIONS, "sub_position").alias("position_group"),
        lenient_date(F.col("contract_expiration_date")).alias("contract_until"), F.col("market_value_in_eur").cast("bigint").alias("market_value_eur"), F.col("current_club_id").alias("__club"),
    )


def ingest_market(tables: Mapping[str, DataFrame], market: DataFrame, clubs: DataFrame, now: Column) -> Load:
    """Market-data players and clubs: clubs by id or name, players resolved; found ones are updated, even to unknown values,
    new ones added, doubtful ones queued. ``written`` counts the players found or added."""
    source, club_source = "transfermarkt", "transfermarkt_club"
    new = clubs.filter("club_id is not null").select(
        F.col("club_id").alias("__tm"), "name", normalize_name(F.col("name")).alias("normalized_name"), F.create_map(F.lit(club_source), F.col("club_id").cast("string")).alias("source_ids")
    )
    all_clubs = cut(upsert_clubs(tables["clubs"], new, [["normalized_name"]], True, club_source, order=["__tm"]))
    by_id = all_clubs.select(F.col("source_ids")[club_source].try_cast("int").alias("__tm"), F.col("id").alias("__i")).filter("__tm is not null").groupBy("__tm").agg(F.min("__i").alias("__i"))
    by_name = all_clubs.groupBy("normalized_name").agg(F.min("id").alias("__n"))
    club_of = new.join(by_id, "__tm", "left").join(by_name, "normalized_name", "left").groupBy("__tm").agg(F.min(F.coalesce("__i", "__n")).alias("current_club_id"))
    records = market_records(market).join(club_of, F.col("__club") == F.col("__tm"), "left").drop("__club", "__tm")
    payload = F.to_json(F.struct(
        F.col("raw_name").alias("full_name"), F.col("birth_date").cast("string").alias("birth_date"), "nationality", "foot", "height_cm", "position_group",
        F.col("contract_until").cast("string").alias("contract_until"), "market_value_eur", "current_club_id",
    ))
    resolved = resolve(records.withColumn("raw_payload", payload), tables["players"], tables["player_aliases"], tables["resolution_queue"], now)
    rows = cut(resolved.rows.drop("raw_payload"))
    ids = F.map_from_arrays(F.array("source"), F.array("source_id"))
    found = rows.filter(F.col("outcome").isin("already_known", "auto_resolved")).withColumn("source_ids", ids)
    columns = ["birth_date", "foot", "height_cm", "current_club_id", "contract_until", "market_value_eur"]
    players = update_players(tables["players"], found, columns, now)
    players, aliases = insert_players(players, resolved.aliases, rows.filter("outcome = 'new'").drop("outcome", "player_id"), now)
    changed = {"clubs": all_clubs, "players": players, "player_aliases": aliases, "resolution_queue": resolved.queue}
    return Load(changed, rows.select("source_id", "outcome", "player_id"), rows.filter("outcome <> 'needs_review'").agg(F.count("*").alias("n")))


def ingest_season_stats(tables: Mapping[str, DataFrame], stats: DataFrame, now: Column) -> Load:
    """Season-stat provider rows (``sources.files.season_stats``): names resolved, competitions and clubs added, season rows of
    the players found upserted with their source.

    Records that are doubtful or new write no season row; doubtful ones are queued. Of several records for one season row that
    of the largest source id counts.
    """
    source = "fbref"
    metrics = ["goals", "assists", "yellow_cards", "red_cards", "shots", "xg", "npxg", "xg_per_shot"]
    rows = provider_metrics(stats).withColumn("metrics", metrics_map(metrics)).drop(*metrics).withColumn("source", F.lit(source))
    rows = rows.withColumn("raw_name", F.col("player")).withColumn("birth_date", F.lit(None).cast("date")).withColumn("nationality", F.lit(None).cast("array<string>"))
    rows = cut(rows.withColumn("raw_payload", F.to_json(F.struct("source_id", "raw_name", F.col("team").alias("team_name"), "league", "season", "minutes", "matches_played", "metrics"))))
    resolved = resolve(rows, tables["players"], tables["player_aliases"], tables["resolution_queue"], now)
    judged = cut(resolved.rows.drop("raw_payload"))
    found = judged.filter("player_id is not null")
    competitions = cut(upsert_competitions(tables["competitions"], league_competitions(found), keep_ids=True))
    leagues = league_competitions(found).join(competitions.select("id", "name", "country"), ["name", "country"]).select(F.col("source_ids")[source].alias("league"), F.col("id").alias("competition_id"))
    placed = found.join(leagues, "league").withColumn("normalized_name", normalize_name(F.col("team")))
    teams = placed.select(F.col("team").alias("name"), "normalized_name", "competition_id", F.lit(False).alias("is_national_team")).distinct()
    key = ["normalized_name", "competition_id"]
    clubs = cut(upsert_clubs(tables["clubs"], teams, [key]))
    placed = placed.join(clubs.groupBy(*key).agg(F.min("id").alias("club_id")), key).withColumn("ingested_at", now)
    last = ["player_id", "season", "competition_id", "club_id"]
    rest = [c for c in placed.columns if c not in last]
    fresh = placed.groupBy(*last).agg(F.max_by(F.struct(*rest), "source_id").alias("__r")).select(*last, "__r.*")
    changed = {
        "competitions": competitions, "clubs": clubs, "player_aliases": resolved.aliases, "resolution_queue": resolved.queue,
        "player_season_stats": upsert_season_stats(tables["player_season_stats"], fresh, set_source=True),
    }
    return Load(changed, judged.select("source_id", "outcome", "player_id"), found.agg(F.count("*").alias("n")))
