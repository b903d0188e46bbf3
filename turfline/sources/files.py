"""Readers of source files: explicit schemas, checked columns, absent columns as nulls."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the match-data files, the market-data files and the season-stat tables.
STINT = "struct<position:string,`from`:string,`to`:string,from_period:int,to_period:int,start_reason:string,end_reason:string>"
MATCHES = "match_id bigint, competition_id int, competition_name string, competition_country_name string, season string, home_team string, home_team_id int, away_team string, away_team_id int"
EVENTS = (
    "id string, match_id bigint, player_id double, type string, period int, minute int, second int, shot_outcome string, shot_type string, shot_statsbomb_xg double, "
    "pass_shot_assist boolean, pass_goal_assist boolean, pass_assisted_shot_id string, dribble_outcome string, duel_type string, duel_outcome string, "
    "foul_committed_card string, bad_behaviour_card string"
)
LINEUPS = f"player_id int, player_name string, country string, positions array<{STINT}>, __team string"
MARKET_PLAYERS = (
    "player_id int, name string, date_of_birth string, country_of_citizenship string, sub_position string, foot string, height_in_cm double, "
    "contract_expiration_date string, market_value_in_eur double, current_club_id int"
)
MARKET_CLUBS = "club_id int, name string, domestic_competition_id string"
SEASON_INDEX = ["league", "season", "team", "player"]
STANDARD = "league string, season string, team string, player string, pt_min double, pt_90s double, pt_mp double, perf_gls double, perf_ast double, perf_crdy double, perf_crdr double"
SHOOTING = "league string, season string, team string, player string, std_sh double, std_sot double, exp_xg double, exp_npxg double"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def require_columns(rows: DataFrame, expected: list[str], what: str) -> DataFrame:
    """The same rows, or an error that names the missing columns."""
    missing = sorted(set(expected) - set(rows.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return rows


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Files of JSON arrays or objects; columns that a file doesn't carry are null."""
    return spark.read.schema(struct(ddl)).json(path, multiLine=True)


def cached_json(spark: SparkSession, path: str, fetch: Callable[[], list[dict]], ddl: str) -> DataFrame:
    """The JSON file at ``path``; if there is none, ``fetch`` gives its records and they are written there first, raw.

    What one call fetches, a match or a list of matches, is small; the transformation is run again from the files.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        staged = hadoop.Path(f"{path}.part")
        stream = fs.create(staged, True)
        stream.write(bytearray(json.dumps(fetch(), ensure_ascii=False).encode()))
        stream.close()
        fs.rename(staged, target)
    return read_json(spark, path, ddl)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, MATCHES)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of one file per match; a match_id that a file doesn't carry is its name."""
    return _with_match(read_json(spark, path, EVENTS))


def read_lineups(spark: SparkSession, path: str) -> DataFrame:
    """Line-ups of one file per match, the team being a column."""
    rows = read_json(spark, path, LINEUPS).withColumn("match_id", F.lit(None).cast("bigint"))
    return _with_match(rows).withColumnRenamed("__team", "team")


def _with_match(rows: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).try_cast("bigint")
    return rows.withColumn("match_id", F.coalesce("match_id", name))


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A CSV file with header; missing files and columns are errors, unreadable values null, extra columns dropped."""
    schema = struct(ddl)
    raw = require_columns(spark.read.option("header", True).option("enforceSchema", False).csv(path), schema.names, path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def read_market_players(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, f"{folder}/players.csv", MARKET_PLAYERS)


def read_market_clubs(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, f"{folder}/clubs.csv", MARKET_CLUBS)


def season_stats(standard: DataFrame, shooting: DataFrame) -> DataFrame:
    """The two season-stat tables, columns checked, joined on their index; rows without shooting keep nulls."""
    one = require_columns(standard, struct(STANDARD).names, "standard").select(*struct(STANDARD).names)
    two = require_columns(shooting, struct(SHOOTING).names, "shooting").select(*struct(SHOOTING).names)
    return one.join(two, SEASON_INDEX, "left")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of an integer key; needs the database's driver on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options)
    return reader.load()
