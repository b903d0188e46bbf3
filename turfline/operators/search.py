"""Multi-criteria search, player sheets and lists."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.scalars import age_years
from turfline.registry import MIN_MINUTES, POSITION_LABELS, SEARCH_RADAR, SHEET_RADAR

LIMIT = 200


@dataclass(frozen=True)
class Filters:
    """Criteria of a search; those left out don't restrict. A bound of 0 is a bound."""

    positions: Sequence[str] = ()
    foot: str | None = None
    age_min: int | None = None
    age_max: int | None = None
    minutes_min: int | None = None
    contract_before: str | None = None
    market_value_max: int | None = None
    tier: int | None = None
    metric: str | None = None
    percentile_min: int | None = None

    @classmethod
    def parse(cls, raw: Mapping[str, object]) -> Filters:
        """From request parameters or stored JSON: repeated or comma-separated positions, numbers as text or number.

        Unknown positions and feet, and what doesn't begin with a number, are left out.
        """
        one = lambda k: raw.get(k)[0] if isinstance(raw.get(k), list) and raw.get(k) else (None if isinstance(raw.get(k), list) else raw.get(k))

        def number(key: str) -> int | None:
            text = str(one(key)).strip() if one(key) is not None else ""
            sign, digits = (text[:1] if text[:1] in "+-" else ""), ""
            for c in text[len(sign) :]:
                if not c.isdigit():
                    break
                digits += c
            return int(sign + digits) if digits else None

        many = raw.get("positions") or []
        many = many.split(",") if isinstance(many, str) else many
        foot = one("foot")
        return cls(
            positions=tuple(p for p in many if p in POSITION_LABELS and p != "GK"), foot=foot if foot in ("left", "right", "both") else None,
            age_min=number("ageMin"), age_max=number("ageMax"), minutes_min=number("minutesMin"), contract_before=one("contractBefore") or None,
            market_value_max=number("marketValueMax"), tier=number("tier"), metric=one("metric") or None, percentile_min=number("percentileMin"),
        )

    def to_json(self) -> str:
        """The criteria as stored JSON; ``parse`` of it gives them back."""
        names = {
            "positions": list(self.positions) or None, "foot": self.foot, "ageMin": self.age_min, "ageMax": self.age_max, "minutesMin": self.minutes_min,
            "contractBefore": self.contract_before, "marketValueMax": self.market_value_max, "tier": self.tier, "metric": self.metric, "percentileMin": self.percentile_min,
        }
        return json.dumps({k: v for k, v in names.items() if v is not None}, ensure_ascii=False)

    def condition(self, as_of: Column) -> Column:
        """The criteria as one predicate that pushes down to the scans; unknown values fail, as in SQL."""
        age = age_years(F.col("birth_date"), as_of)
        parts = [
            F.col("position_group").isin(list(self.positions)) if self.positions else None,
            F.col("foot") == self.foot if self.foot else None,
            age >= self.age_min if self.age_min is not None else None,
            age <= self.age_max if self.age_max is not None else None,
            F.col("minutes") >= self.minutes_min if self.minutes_min is not None else None,
            F.col("contract_until") <= F.lit(self.contract_before).cast("date") if self.contract_before else None,
            F.col("market_value_eur") <= self.market_value_max if self.market_value_max is not None else None,
            F.col("tier") == self.tier if self.tier is not None else None,
        ]
        return reduce(Column.__and__, [p for p in parts if p is not None], F.lit(True))


def search(
    stats: DataFrame, players: DataFrame, competitions: DataFrame, percentiles: DataFrame, filters: Filters, as_of: Column,
    threshold_before_limit: bool = False, limit: int = LIMIT,
) -> DataFrame:
    """The rows of most minutes that meet the criteria.

    The percentile threshold (in any peer group) is a semi-join. By default it thins out the rows found, as the search
    always did; before the limit it fills them up.
    """
    rows = stats.join(players, "player_id").join(competitions, "competition_id").filter(filters.condition(as_of))
    keep = ["player_id", "full_name", "position_group", "season", "minutes", "club_id", "competition_name", "contract_until", "market_value_eur"]
    rows = rows.select(*keep)
    top = lambda r: r.orderBy(F.desc_nulls_last("minutes"), "player_id", "season", "club_id", "competition_name").limit(limit)
    if filters.metric is None or filters.percentile_min is None:
        return top(rows)
    able = percentiles.filter((F.col("metric") == filters.metric) & (F.col("percentile") >= filters.percentile_min)).select("player_id", "season")
    if threshold_before_limit:
        return top(rows.join(able, ["player_id", "season"], "left_semi"))
    return top(rows).join(able, ["player_id", "season"], "left_semi")


def radars(found: DataFrame, percentiles: DataFrame, keys: Sequence[str] = tuple(SEARCH_RADAR)) -> DataFrame:
    """``radar`` (metric, percentile) per player and season of the players found, sorted."""
    ids = found.select("player_id").distinct()
    rows = percentiles.filter(F.col("metric").isin(list(keys))).join(ids, "player_id", "left_semi")
    return rows.groupBy("player_id", "season").agg(F.array_sort(F.collect_list(F.struct("metric", "percentile"))).alias("radar"))


def latest_season(stats: DataFrame) -> DataFrame:
    """The row of each player's last season; of several clubs the one of most minutes."""
    place = F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("season"), F.desc("minutes"), "competition_id", "club_id"))
    return stats.withColumn("__n", place).filter("__n = 1").drop("__n")


def latest_known(rows: DataFrame, group: Sequence[str], value: str, at: str, tie: str) -> DataFrame:
    """Per group the last value that isn't null, by time, then ``tie``."""
    return rows.groupBy(*group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(at, tie))).alias(value))


def ordered_entries(entries: DataFrame) -> DataFrame:
    """Entries with their ``place`` in the list, from 0: by rank, those without one last by time added; and an explicit ``rank``."""
    w = Window.partitionBy("shortlist_id").orderBy(F.asc_nulls_last("rank"), "added_at", "player_id")
    return entries.withColumn("place", F.row_number().over(w) - 1).withColumn("rank", F.coalesce("rank", "place"))


def moved_entries(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """Entries after each list's move (``shortlist_id``, ``player_id``, ``step`` of -1 or 1): the two neighbours swap ranks.

    A move beyond an end, or of an entry that isn't there, changes nothing, not even missing ranks.
    """
    rows = ordered_entries(entries.withColumn("__old", F.col("rank")))
    own = rows.join(moves, ["shortlist_id", "player_id"]).select("shortlist_id", F.col("place").alias("__a"), (F.col("place") + F.col("step")).alias("__b"))
    there = rows.select("shortlist_id", F.col("place").alias("__b"), F.lit(True).alias("__ok"))
    swaps = own.join(there, ["shortlist_id", "__b"])
    ranks = rows.select("shortlist_id", F.col("place").alias("__p"), F.col("rank").alias("__r"))
    swaps = swaps.join(ranks, "shortlist_id").groupBy("shortlist_id", "__a", "__b").agg(
        F.max(F.when(F.col("__p") == F.col("__a"), F.col("__r"))).alias("__ra"), F.max(F.when(F.col("__p") == F.col("__b"), F.col("__r"))).alias("__rb")
    )
    joined = rows.join(swaps, "shortlist_id", "left")
    rank = F.when(F.col("place") == F.col("__a"), F.col("__rb")).when(F.col("place") == F.col("__b"), F.col("__ra")).when(F.col("__a").isNotNull(), F.col("rank"))
    return joined.withColumn("rank", F.when(F.col("__a").isNotNull(), rank).otherwise(F.col("__old"))).select(*entries.columns)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``name`` and number of rows ``n`` of each table, in one plan."""
    return reduce(DataFrame.unionByName, [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()])


def radar_points(rows: DataFrame, radius: float = 100.0, least: int = 3) -> DataFrame:
    """Corners ``x``, ``y`` of the radar polygon of each player and season: metrics in name order, from the top clockwise."""
    part = Window.partitionBy("player_id", "season")
    i, n = F.row_number().over(part.orderBy("metric")) - 1, F.count("*").over(part)
    angle = -F.pi() / 2 + 2 * F.pi() * F.col("i") / F.col("n")
    reach = F.greatest(F.least(F.col("percentile"), F.lit(100)), F.lit(0)) / 100.0 * radius
    rows = rows.withColumn("i", i).withColumn("n", n).filter(F.col("n") >= least)
    return rows.select("player_id", "season", "metric", (F.round(F.cos(angle) * reach, 4) + 0.0).alias("x"), (F.round(F.sin(angle) * reach, 4) + 0.0).alias("y"))


def with_groups(percentiles: DataFrame, groups: DataFrame) -> DataFrame:
    """Percentile rows with ``label`` and ``sample_size`` of their peer group; rows of unknown groups are left out."""
    named = groups.select(F.col("peer_group_id"), "label", "sample_size")
    return percentiles.join(named, "peer_group_id")


def listed(entries: DataFrame, players: DataFrame) -> DataFrame:
    """Entries of lists with name and position group of their player, in the order of their ``place``."""
    rows = ordered_entries(entries).join(players.select("player_id", "full_name", "position_group"), "player_id")
    return rows.orderBy("shortlist_id", "place")


def open_entries(queue: DataFrame) -> DataFrame:
    """Entries of the review queue that nobody has settled."""
    return queue.filter(F.col("resolved_at").isNull())


def entry_candidates(entries: DataFrame, players: DataFrame) -> DataFrame:
    """``id`` of each entry, ``place`` (from 0), ``player_id`` and ``score`` of its candidates, and their ``full_name``; null for
    players that are gone."""
    each = entries.select("id", F.posexplode("candidates").alias("place", "c")).select("id", "place", F.col("c.playerId").alias("player_id"), F.col("c.score").alias("score"))
    return each.join(players.select("player_id", "full_name"), "player_id", "left")


def newest_first(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """Rows by falling time, those without one last."""
    return rows.orderBy(F.desc_nulls_last(at), tie)


def report(stats: DataFrame, percentiles: DataFrame, notes: DataFrame, entries: DataFrame, min_minutes: int = MIN_MINUTES) -> DataFrame:
    """One row per player with season rows: ``season`` and ``minutes`` of the last one, whether it is ``eligible``, the sheet
    ``radar`` (metric, percentile) of that season, the latest known ``rating`` and the ``verdicts`` (list, status), sorted.

    ``percentiles``: those of the own-season group; repeated ones count once, of different ones the largest. Players without
    notes or entries have null and an empty list.
    """
    last = latest_season(stats).select("player_id", "season", "minutes", "club_id")
    best = percentiles.filter(F.col("metric").isin(list(SHEET_RADAR))).groupBy("player_id", "season", "metric").agg(F.max("percentile").alias("percentile"))
    radar = best.groupBy("player_id", "season").agg(F.array_sort(F.collect_list(F.struct("metric", "percentile"))).alias("radar"))
    rating = latest_known(notes, ["player_id"], "rating", "created_at", "id")
    verdicts = entries.groupBy("player_id").agg(F.array_sort(F.collect_set(F.struct("shortlist_id", "status"))).alias("verdicts"))
    rows = last.join(radar, ["player_id", "season"], "left").join(rating, "player_id", "left").join(verdicts, "player_id", "left")
    none = F.array().cast("array<struct<shortlist_id:int,status:string>>")
    return rows.withColumn("eligible", F.col("minutes") >= min_minutes).withColumn("verdicts", F.coalesce("verdicts", none))
