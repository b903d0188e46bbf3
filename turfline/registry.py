"""Metric catalogue and the fixed vocabularies of the domain."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# Eligibility and the season span of a peer group.
MIN_MINUTES, SEASON_SPAN, VECTOR_SIZE = 600, 2, 32
# Thresholds and penalty of identity resolution.
AUTO_SCORE, REVIEW_SCORE, NATIONALITY_PENALTY = 0.92, 0.60, 0.5
# Position groups with the labels shown.
POSITION_LABELS = {
    "GK": "Gardiens", "DC": "Défenseurs centraux", "FB": "Latéraux", "DM": "Milieux défensifs",
    "CM": "Milieux centraux", "AM": "Milieux offensifs", "W": "Ailiers", "ST": "Attaquants",
}
# Group of each position label of line-ups.
LINEUP_POSITIONS = {
    "Goalkeeper": "GK", "Center Back": "DC", "Left Center Back": "DC", "Right Center Back": "DC",
    "Left Back": "FB", "Right Back": "FB", "Left Wing Back": "FB", "Right Wing Back": "FB",
    "Center Defensive Midfield": "DM", "Left Defensive Midfield": "DM", "Right Defensive Midfield": "DM",
    "Left Center Midfield": "CM", "Right Center Midfield": "CM",
    "Center Attacking Midfield": "AM", "Left Attacking Midfield": "AM", "Right Attacking Midfield": "AM",
    "Left Midfield": "W", "Right Midfield": "W", "Left Wing": "W", "Right Wing": "W",
    "Center Forward": "ST", "Left Center Forward": "ST", "Right Center Forward": "ST",
}
# Group of each position label of market records.
MARKET_POSITIONS = {
    "Goalkeeper": "GK", "Centre-Back": "DC", "Left-Back": "FB", "Right-Back": "FB", "Defensive Midfield": "DM", "Central Midfield": "CM",
    "Attacking Midfield": "AM", "Second Striker": "AM", "Left Midfield": "W", "Right Midfield": "W", "Left Winger": "W", "Right Winger": "W", "Centre-Forward": "ST",
}
# Labels of the states of a list entry.
STATUS_LABELS = {"a_observer": "À observer", "observe": "Observé", "prioritaire": "Prioritaire", "ecarte": "Écarté"}
# Tiers of the leagues of the season-stat provider.
LEAGUE_TIERS = {"ENG-Premier League": 1, "ESP-La Liga": 1, "GER-Bundesliga": 1, "ITA-Serie A": 1, "FRA-Ligue 1": 1}


class Metric(NamedTuple):
    key: str
    label: str
    family: str
    per90: bool = True
    higher_is_better: bool = True
    format: str = "dec2"


# The metrics, for all outfield groups.
METRICS = [
    Metric("goals", "Buts", "production"),
    Metric("np_goals", "Buts hors pénalty", "production"),
    Metric("shots", "Tirs", "production"),
    Metric("xg", "xG", "production"),
    Metric("npxg", "npxG", "production"),
    Metric("xg_per_shot", "xG / tir", "production", per90=False),
    Metric("np_goals_minus_npxg", "Buts (hors pen.) − npxG", "production"),
    Metric("key_passes", "Passes clés", "creation"),
    Metric("assists", "Passes décisives", "creation"),
    Metric("xa", "xA", "creation"),
    Metric("dribbles_attempted", "Dribbles tentés", "possession"),
    Metric("dribbles_completed", "Dribbles réussis", "possession"),
    Metric("dribble_success_rate", "Taux de réussite dribbles", "possession", per90=False, format="pct"),
    Metric("tackles_attempted", "Tacles tentés", "defense"),
    Metric("tackles_won", "Tacles réussis", "defense"),
    Metric("interceptions", "Interceptions", "defense"),
    Metric("clearances", "Dégagements", "defense"),
    Metric("blocks", "Contres", "defense"),
    Metric("ball_recoveries", "Ballons récupérés", "defense"),
    Metric("fouls_committed", "Fautes commises", "discipline", higher_is_better=False),
    Metric("fouls_won", "Fautes obtenues", "discipline"),
    Metric("yellow_cards", "Cartons jaunes", "discipline", higher_is_better=False),
    Metric("red_cards", "Cartons rouges", "discipline", higher_is_better=False),
]
METRIC_KEYS = [m.key for m in METRICS]
LOWER_IS_BETTER = [m.key for m in METRICS if not m.higher_is_better]
# Metrics of the radar of a search row and of a sheet.
SEARCH_RADAR = ["goals", "xg", "key_passes", "dribbles_completed", "tackles_won", "interceptions"]
SHEET_RADAR = ["goals", "xg", "key_passes", "xa", "dribbles_completed", "tackles_won", "interceptions", "ball_recoveries"]


def registry(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of 23 rows."""
    return spark.createDataFrame([tuple(m) for m in METRICS], "key string, label string, family string, per90 boolean, higher_is_better boolean, format string")
