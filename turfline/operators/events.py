"""Match events to minutes, counters, per-90 metrics and season totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.functions.scalars import clock_minutes, looked_up, safe_ratio
from turfline.functions.text import normalize_name
from turfline.registry import LINEUP_POSITIONS, METRIC_KEYS

# Outcomes and cards as events name them.
WON = ["Won", "Success In Play", "Success Out"]
YELLOW, RED = ["Yellow Card", "Second Yellow"], ["Red Card", "Second Yellow"]
# Counters that only count events of a type.
TYPES = {"interceptions": "Interception", "clearances": "Clearance", "blocks": "Block", "ball_recoveries": "Ball Recovery", "fouls_committed": "Foul Committed", "fouls_won": "Foul Won"}


def period_clocks(events: DataFrame) -> DataFrame:
    """Per match: ``period_start`` and ``period_end`` in minutes of the match clock, and ``last_period``, 4 at most.

    A period starts at its first start event and ends at its last end event, 0 at least. One pass over the events.
    """
    at = F.col("minute") + F.col("second") / 60
    by = events.groupBy("match_id", "period").agg(
        F.min(F.when(F.col("type") == "Half Start", at)).alias("s"), F.max(F.when(F.col("type") == "Half End", at)).alias("e")
    )
    pairs = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(v).isNotNull(), F.struct("period", F.greatest(F.col(v), F.lit(0.0)).alias("v"))))))
    return by.groupBy("match_id").agg(pairs("s").alias("period_start"), pairs("e").alias("period_end"), F.least(F.max("period"), F.lit(4)).alias("last_period"))


def minutes_played(positions: Column, start: Column, end: Column, last: Column) -> Column:
    """Minutes of a list of stints in order, 0 for an empty or null list.

    A stint without end, or whose end period is missing, precedes its start period or follows ``last``, lasts to the end
    of play, and nothing after it counts; so does a stint that starts after ``last`` count for nothing and end the list.
    """
    def step(total: Column, x: Column) -> Column:
        from_period = F.coalesce(x["from_period"], F.lit(1))
        open_end = x["to"].isNull() | x["to_period"].isNull() | (x["to_period"] < from_period) | (x["to_period"] > last)
        until = F.when(open_end, F.coalesce(end[last], F.lit(0.0))).otherwise(clock_minutes(x["to"]))
        since = F.coalesce(clock_minutes(x["from"]), start[from_period], F.lit(0.0))
        late = total["stop"] | (from_period > last)
        return F.struct(
            F.when(late, total["sum"]).otherwise(total["sum"] + F.greatest(F.coalesce(until, F.lit(0.0)) - since, F.lit(0.0))).alias("sum"), (late | open_end).alias("stop")
        )

    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("stop"))
    return F.coalesce(F.aggregate(positions, begin, step, lambda t: t["sum"]), F.lit(0.0))


def appearances(lineups: DataFrame, matches: DataFrame) -> DataFrame:
    """Line-ups with ``minutes``, ``position`` of the first stint and its ``position_group``, ``team_id``, season and competition.

    ``matches`` carries ``period_start`` and ``period_end`` (``period_clocks`` makes them from events). Rows without positions
    or minutes are left out, a team that is neither side of its match has no id.
    """
    side = [c for c in ("home_team", "home_team_id", "away_team", "away_team_id", "competition_id") if c in matches.columns]
    last = F.col("last_period") if "last_period" in matches.columns else F.least(F.array_max(F.map_keys("period_end")), F.lit(4))
    clocks = matches.select("match_id", "season", "period_start", "period_end", last.alias("__last"), *side)
    rows = lineups.join(clocks, "match_id").withColumn("minutes", minutes_played(F.col("positions"), F.col("period_start"), F.col("period_end"), F.col("__last")))
    rows = rows.filter((F.col("minutes") > 0) & (F.size("positions") > 0)).withColumn("position", F.col("positions")[0]["position"])
    known = {"home_team", "home_team_id", "away_team", "away_team_id"} <= set(side)
    team = F.when(F.col("team") == F.col("home_team"), F.col("home_team_id")).when(F.col("team") == F.col("away_team"), F.col("away_team_id")) if known else F.lit(None).cast("int")
    competition = F.col("competition_id") if "competition_id" in side else F.lit(None).cast("int")
    group = looked_up(F.col("position"), LINEUP_POSITIONS, "position")
    return rows.select(
        "match_id", "team", team.alias("team_id"), "player_id", "player_name", "country", "season", competition.alias("competition_id"), "minutes", "position", group.alias("position_group")
    )


def event_counters(events: DataFrame) -> DataFrame:
    """The 20 raw totals per match and player in one pass over the events, shoot-outs excluded.

    Events without player count for nobody; a missing shot type is no penalty. Expected assists look the shot up that a
    key pass names, in the same match, before the one aggregation.
    """
    play = events.filter((F.col("period") <= 4) & F.col("player_id").isNotNull()).withColumn("player_id", F.col("player_id").cast("int"))
    shots = events.filter((F.col("type") == "Shot") & (F.col("period") <= 4)).select("match_id", F.col("id").alias("pass_assisted_shot_id"), F.col("shot_statsbomb_xg").alias("__xg"))
    play = play.join(shots, ["match_id", "pass_assisted_shot_id"], "left")
    kind = F.col("type")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    shot, passed = kind == "Shot", kind == "Pass"
    goal = shot & (F.col("shot_outcome") == "Goal")
    open_play = ~F.col("shot_type").eqNullSafe("Penalty")
    tackle = (kind == "Duel") & (F.col("duel_type") == "Tackle")
    key_pass = passed & yes("pass_shot_assist")
    foul, bad = kind == "Foul Committed", kind == "Bad Behaviour"
    card = lambda cards: (foul & F.col("foul_committed_card").isin(cards)) | (bad & F.col("bad_behaviour_card").isin(cards))
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0.0))
    count = lambda test: F.count_if(test).cast("double")
    xg = F.col("shot_statsbomb_xg")
    return play.groupBy("match_id", "player_id").agg(
        count(goal).alias("goals"), count(goal & open_play).alias("np_goals"), count(shot).alias("shots"),
        total(shot, xg).alias("xg"), total(shot & open_play, xg).alias("npxg"),
        count(key_pass).alias("key_passes"), count(passed & yes("pass_goal_assist")).alias("assists"), total(key_pass, F.col("__xg")).alias("xa"),
        count(kind == "Dribble").alias("dribbles_attempted"), count((kind == "Dribble") & (F.col("dribble_outcome") == "Complete")).alias("dribbles_completed"),
        count(tackle).alias("tackles_attempted"), count(tackle & F.col("duel_outcome").isin(WON)).alias("tackles_won"),
        *[count(kind == t).alias(name) for name, t in TYPES.items()],
        count(card(YELLOW)).alias("yellow_cards"), count(card(RED)).alias("red_cards"),
    )


COUNTERS = [m for m in METRIC_KEYS if m not in ("xg_per_shot", "np_goals_minus_npxg", "dribble_success_rate")]


def per90(totals: DataFrame, minutes: str = "minutes") -> DataFrame:
    """Raw totals to the 23 metrics, by unrounded 90-minute units; rows without minutes are left out, other columns kept."""
    units = F.col(minutes) / 90
    metric = {c: F.col(c) / units for c in COUNTERS}
    metric["xg_per_shot"] = safe_ratio(F.col("xg"), F.col("shots"))
    metric["np_goals_minus_npxg"] = (F.col("np_goals") - F.col("npxg")) / units
    metric["dribble_success_rate"] = safe_ratio(F.col("dribbles_completed"), F.col("dribbles_attempted"))
    others = [c for c in totals.columns if c not in COUNTERS]
    return totals.filter(F.col(minutes) > 0).select(*others, *[metric[k].alias(k) for k in METRIC_KEYS])


def season_totals(played: DataFrame, counters: DataFrame | None = None, by: Sequence[str] = ("player_id", "season")) -> DataFrame:
    """Per player and season: minutes, matches, totals, first known name and country (in match order), most frequent team and
    position, and its group.

    Players without events have zero totals. Of equally frequent teams and positions the smallest is taken.
    """
    rows = played if counters is None else played.join(counters, ["match_id", "player_id"], "left").fillna(0.0, COUNTERS)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("match_id", c)))
    sums = [] if counters is None else [F.sum(c).alias(c) for c in COUNTERS]
    out = rows.groupBy(*by).agg(
        F.sum("minutes").alias("minutes"), F.countDistinct("match_id").alias("matches_played"), first("player_name").alias("player_name"),
        first("country").alias("country"), F.mode("team_id", True).alias("team_id"), F.mode("position", True).alias("position"), *sums,
    )
    return out.withColumn("position_group", looked_up(F.col("position"), LINEUP_POSITIONS, "position"))


def with_clocks(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Matches with the ``period_clocks`` of their events; matches without events are left out."""
    stored = [c for c in ("period_start", "period_end", "last_period") if c in matches.columns]
    return matches.drop(*stored).join(period_clocks(events), "match_id")


def competition_metrics(events: DataFrame, lineups: DataFrame, matches: DataFrame) -> DataFrame:
    """Season metrics per player, season and competition: clocks, minutes, counters and totals of all matches, by 90 minutes.

    Matches that carry no ``period_start`` get their clocks from the events. Goalkeepers and players without minutes are left
    out. Minutes stay unrounded.
    """
    clocked = matches if "period_start" in matches.columns else with_clocks(matches, events)
    totals = season_totals(appearances(lineups, clocked), event_counters(events), ("player_id", "season", "competition_id"))
    return per90(totals.filter("position_group <> 'GK'"))


def provider_metrics(stats: DataFrame) -> DataFrame:
    """Season-stat rows to the 8 metrics they carry, by the provider's own 90-minute units, and their ``source_id``.

    Rows without minutes are left out; missing counts are 0, and so is a ratio without denominator; without numerator it is null.
    """
    units = F.col("pt_90s")
    known = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    rate = lambda c: F.try_divide(F.coalesce(known(F.col(c)), F.lit(0.0)), units)
    source_id = F.concat_ws("|", "league", "season", "team", normalize_name(F.col("player")))
    return stats.filter((F.col("pt_min") > 0) & ~F.isnan("pt_min")).select(
        "league", "season", "team", "player", source_id.alias("source_id"), F.col("pt_min").cast("int").alias("minutes"), known(F.col("pt_mp")).cast("smallint").alias("matches_played"),
        rate("perf_gls").alias("goals"), rate("perf_ast").alias("assists"), rate("perf_crdy").alias("yellow_cards"), rate("perf_crdr").alias("red_cards"),
        rate("std_sh").alias("shots"), rate("exp_xg").alias("xg"), rate("exp_npxg").alias("npxg"),
        safe_ratio(known(F.col("exp_xg")), known(F.col("std_sh"))).alias("xg_per_shot"),
    )
