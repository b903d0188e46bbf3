"""Schemas of the warehouse tables and checks of their keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the warehouse tables and of the source files.
TABLES = {
    "competitions": "id int, name string, country string, tier int, strength_coef decimal(5,3), strength_coef_low decimal(5,3), strength_coef_high decimal(5,3), uefa_coef decimal(6,3), source_ids map<string,string>",
    "clubs": "id int, name string, normalized_name string, country string, competition_id int, is_national_team boolean, source_ids map<string,string>",
    "players": "id int, full_name string, normalized_name string, birth_date date, nationality array<string>, foot string, height_cm smallint, position_group string, position_detail string, current_club_id int, contract_until date, market_value_eur bigint, source_ids map<string,string>, updated_at timestamp",
    "player_aliases": "id int, player_id int, source string, source_id string, raw_name string, confidence decimal(4,3), resolved_manually boolean, created_at timestamp",
    "resolution_queue": "id int, source string, source_id string, raw_name string, raw_payload string, candidates array<struct<playerId:int,score:double>>, created_at timestamp, resolved_at timestamp",
    "player_season_stats": "player_id int, season string, competition_id int, club_id int, minutes int, matches_played smallint, nineties decimal(6,2), metrics map<string,double>, source string, ingested_at timestamp",
    "peer_groups": "id string, label string, position_group string, season string, min_minutes int, sample_size int, computed_at timestamp",
    "player_percentiles": "player_id int, season string, peer_group_id string, metric string, raw_value double, percentile smallint",
    "saved_searches": "id int, name string, filters string, created_at timestamp, last_checked_at timestamp",
    "player_vectors": "player_id int, season string, style_vec array<float>, quality_vec array<float>, model_version string",
    "shortlists": "id int, name string, brief string, created_at timestamp",
    "shortlist_entries": "shortlist_id int, player_id int, status string, rank int, added_at timestamp",
    "scout_notes": "id int, player_id int, observed_at date, context string, body string, rating smallint, created_at timestamp",
    "ingestion_runs": "id int, source string, scope string, started_at timestamp, finished_at timestamp, rows_written int, status string, error string",
}
KEYS = {
    "competitions": ["name", "country"], "clubs": ["id"], "players": ["id"], "player_aliases": ["source", "source_id"],
    "resolution_queue": ["source", "source_id"], "player_season_stats": ["player_id", "season", "competition_id", "club_id"], "peer_groups": ["id"],
    "player_percentiles": ["player_id", "season", "peer_group_id", "metric"], "saved_searches": ["id"], "player_vectors": ["player_id", "season"],
    "shortlists": ["id"], "shortlist_entries": ["shortlist_id", "player_id"], "scout_notes": ["id"], "ingestion_runs": ["id"],
}
#: Column of a child table and the parent table whose ``id`` it names.
PARENTS = {
    "clubs": {"competition_id": "competitions"}, "players": {"current_club_id": "clubs"}, "player_aliases": {"player_id": "players"},
    "player_season_stats": {"player_id": "players", "competition_id": "competitions", "club_id": "clubs"},
    "player_percentiles": {"player_id": "players", "peer_group_id": "peer_groups"}, "player_vectors": {"player_id": "players"},
    "shortlist_entries": {"shortlist_id": "shortlists", "player_id": "players"}, "scout_notes": {"player_id": "players"},
}
#: Values allowed: a row for which the condition is false breaks it; null passes.
CHECKS = {
    "peer_groups": "sample_size > 0",
    "player_percentiles": "percentile between 0 and 100",
    "scout_notes": "rating between 1 and 10",
    "players": "position_group in ('GK','DC','FB','DM','CM','AM','W','ST') and (foot is null or foot in ('left','right','both'))",
    "player_aliases": "source in ('statsbomb','transfermarkt','fbref','manual')",
    "shortlist_entries": "status in ('a_observer','observe','prioritaire','ecarte')",
}


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their number of rows ``n``."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose non-null ``column`` names no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def violations(name: str, rows: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rule`` and number of offending rows ``n`` of a table: its key, its parents, its allowed values; rules kept are left out."""
    found = [duplicates(rows, KEYS[name]).agg(F.lit("key").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))]
    for column, parent in PARENTS.get(name, {}).items():
        if parents and parent in parents:
            found.append(orphans(rows, column, parents[parent]).agg(F.lit(f"parent of {column}").alias("rule"), F.count("*").alias("n")))
    if name in CHECKS:
        found.append(rows.filter(~F.expr(CHECKS[name])).agg(F.lit("values").alias("rule"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, found).filter("n > 0")


def nineties(minutes: Column) -> Column:
    """Stored 90-minute units, rounded to two digits."""
    return F.round(minutes / 90, 2).cast("decimal(6,2)")
