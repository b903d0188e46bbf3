"""Loading sources into the warehouse tables: each step takes tables and gives the tables that replace them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.scalars import looked_up
from turfline.functions.text import fold, normalize_name
from turfline.operators import identity
from turfline.operators.merge import first_match, insert_missing, once, upsert, with_ids
from turfline.registry import LEAGUE_TIERS
from turfline.schema import nineties
from turfline.session import cut


def fitted(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows in the columns and types of a table; columns they lack are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])


def upsert_numbered(old: DataFrame, new: DataFrame, key: Sequence[str], update: Sequence[str], maps: Sequence[str] = ()) -> DataFrame:
    """Upsert by a natural key of a table whose rows are numbered: known rows keep their ``id``, others get the next ones."""
    known = new.join(old.select(*key, "id"), list(key))
    added = with_ids(new.join(old.select(*key), list(key), "left_anti"), old, key)
    both = fitted(known, old).unionByName(fitted(added, old))
    return upsert(old, both, ["id"], update, maps)


def upsert_competitions(old: DataFrame, new: DataFrame, keep_ids: bool = False, order: Sequence[str] = ("tier",)) -> DataFrame:
    """Competitions by (name, country): the tier is replaced, source ids merged, unless ``keep_ids``. Of repeated new ones the
    first by ``order`` counts."""
    return upsert_numbered(old, once(new, ["name", "country"], order), ["name", "country"], ["tier"], [] if keep_ids else ["source_ids"])


def league_competitions(stats: DataFrame) -> DataFrame:
    """Competitions of season-stat rows: the league is split at its first dash into country and name; unknown leagues are an error."""
    parts = F.split("league", "-", 2)
    return stats.select("league").distinct().select(
        parts[1].alias("name"), parts[0].alias("country"), looked_up(F.col("league"), LEAGUE_TIERS, "league").alias("tier"), F.create_map(F.lit("fbref"), F.col("league")).alias("source_ids")
    )


def upsert_clubs(old: DataFrame, new: DataFrame, keys: Sequence[Sequence[str]], merge_ids: bool = False, source: str | None = None, order: Sequence[str] = ("name",)) -> DataFrame:
    """Clubs matched by the first of the ``keys`` (sets of columns) that finds one; others are added once per first key.

    With ``source`` an id in ``source_ids`` is tried before them. A match changes nothing, or merges the source ids. Of new
    ones with an equal first key the first by ``order`` counts.
    """
    fresh = once(new, list(keys[0]), order).withColumn("__row", F.xxhash64(*keys[0]))
    sides, targets = [{k: k for k in key} for key in keys], old
    if source:
        fresh, targets = fresh.withColumn("__sid", F.col("source_ids")[source]), old.withColumn("__tid", F.col("source_ids")[source])
        sides = [{"__sid": "__tid"}, *sides]
    found = first_match(fresh, targets, sides, "__row", "id")
    joined = fresh.drop("id").join(found, "__row")
    added = with_ids(joined.filter("id is null").drop("id"), old, keys[0])
    out = old.unionByName(fitted(added, old))
    if merge_ids:
        known = joined.filter("id is not null").groupBy("id").agg(F.max_by("source_ids", "__row").alias("source_ids"))
        out = upsert(out, fitted(known, out), ["id"], [], ["source_ids"])
    return out


def upsert_season_stats(old: DataFrame, new: DataFrame, set_source: bool = False) -> DataFrame:
    """Season stats by their key: minutes, matches, metrics and load time are replaced, the source only if asked."""
    rows = fitted(new.withColumn("nineties", nineties(F.col("minutes"))), old)
    update = ["minutes", "matches_played", "nineties", "metrics", "ingested_at", *(["source"] if set_source else [])]
    return upsert(old, rows, ["player_id", "season", "competition_id", "club_id"], update)


class Resolution(NamedTuple):
    """``rows``: records with outcome and player_id; and the tables that replace aliases and queue."""

    rows: DataFrame
    aliases: DataFrame
    queue: DataFrame


def resolve(records: DataFrame, players: DataFrame, aliases: DataFrame, queue: DataFrame, now: Column) -> Resolution:
    """Records (source, source_id, raw_name, birth_date, nationality, raw_payload) against players as they are at the start.

    A known (source, source_id) comes first. Others are scored against all players: resolved ones get an alias with their
    score, doubtful ones enter the queue with their five best candidates (an entry already there is renewed, not
    reopened), new ones are left to the caller. Outcomes: already_known, auto_resolved, needs_review, new. Of records with one
    (source, source_id) the first by name and payload counts.
    """
    key = ["source", "source_id"]
    known, rest = identity.with_aliases(once(records, key, ["raw_name", "raw_payload"]), aliases)
    rest = cut(rest.withColumn("query_id", F.xxhash64(*key)))
    candidates = players.select(F.col("id").alias("player_id"), "normalized_name", "birth_date", "nationality")
    # read by the aliases, the queue and the rows: scored once
    judged = cut(rest.join(identity.outcomes(rest, identity.top_candidates(rest, candidates)), "query_id").drop("query_id"))
    auto, review = judged.filter("outcome = 'auto_resolved'"), judged.filter("outcome = 'needs_review'")
    made = auto.withColumn("confidence", F.round("confidence", 3)).withColumn("resolved_manually", F.lit(False)).withColumn("created_at", now)
    new_aliases = insert_missing(aliases, fitted(with_ids(made, aliases, key), aliases), key)
    fresh = review.select(*key, "raw_name", "raw_payload", "candidates").withColumn("created_at", now)
    new_queue = upsert_numbered(queue, fresh, key, ["raw_name", "raw_payload", "candidates"])
    columns = [*records.columns, "outcome", "player_id"]
    return Resolution(known.select(*columns).unionByName(judged.select(*columns)), new_aliases, new_queue)


def insert_players(players: DataFrame, aliases: DataFrame, new: DataFrame, now: Column, strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """Players and aliases with one player, and an alias of full confidence, for every new record (source, source_id, raw_name, ...).

    Outer white space of names is taken off the normalized name, unless ``strip`` is false, as for names settled by hand.
    """
    made = with_ids(once(new, ["source", "source_id"], ["raw_name"]), players, ["source", "source_id"]).withColumn("full_name", F.col("raw_name"))
    made = made.withColumn("normalized_name", (normalize_name if strip else fold)(F.col("raw_name"))).withColumn("updated_at", now)
    ids = F.map_from_arrays(F.array("source"), F.array("source_id"))
    alias = made.select(F.col("id").alias("player_id"), "source", "source_id", "raw_name").withColumn("confidence", F.lit(1.0)).withColumn("resolved_manually", F.lit(False)).withColumn("created_at", now)
    numbered = fitted(with_ids(alias, aliases, ["source", "source_id"]), aliases)
    return players.unionByName(fitted(made.withColumn("source_ids", ids), players)), insert_missing(aliases, numbered, ["source", "source_id"])


def update_players(players: DataFrame, found: DataFrame, columns: Sequence[str], now: Column, keep_known: bool = False) -> DataFrame:
    """Players with the ``columns`` of the records found for them (player_id, ...), unknown values overwriting known ones by default."""
    last = found.withColumn("__n", F.row_number().over(Window.partitionBy("player_id").orderBy(*[c for c in ("source", "source_id") if c in found.columns] or ["player_id"])))
    rows = last.filter("__n = 1").withColumn("id", F.col("player_id")).withColumn("updated_at", now)
    maps = ["source_ids"] if "source_ids" in found.columns else []
    keep = [c for c in ("id", *columns, *maps, "updated_at") if c in rows.columns]
    known = rows.select(*keep).join(players.select("id"), "id", "left_semi")
    return upsert(players, known, ["id"], [*columns, "updated_at"], maps, keep_known)


def settle(queue: DataFrame, aliases: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Queue and aliases after people attached entries (``id``, ``player_id``): an alias marked as manual, the entry closed."""
    entries = queue.join(decisions.select("id", "player_id"), "id")
    alias = entries.select("player_id", "source", "source_id", "raw_name").withColumn("resolved_manually", F.lit(True)).withColumn("created_at", now)
    numbered = fitted(with_ids(alias, aliases, ["source", "source_id"]), aliases)
    closed = queue.join(decisions.select("id", F.lit(True).alias("__done")), "id", "left")
    closed = closed.withColumn("resolved_at", F.when(F.col("__done"), F.coalesce("resolved_at", now)).otherwise(F.col("resolved_at")))
    return closed.select(*queue.columns), insert_missing(aliases, numbered, ["source", "source_id"])


def payload_players(entries: DataFrame) -> DataFrame:
    """Records for ``insert_players`` from the payloads of queue entries; values of a wrong type are null."""
    shape = "birth_date string, nationality array<string>, foot string, height_cm int, position_group string, contract_until string, market_value_eur bigint"
    p = F.from_json("raw_payload", shape)
    day = lambda c: p.getField(c).try_cast("date")
    return entries.select(
        "source", "source_id", "raw_name", day("birth_date").alias("birth_date"), p.getField("nationality").alias("nationality"), p.getField("foot").alias("foot"),
        p.getField("height_cm").cast("smallint").alias("height_cm"), p.getField("position_group").alias("position_group"), day("contract_until").alias("contract_until"),
        p.getField("market_value_eur").alias("market_value_eur"),
    )


def add_rows(old: DataFrame, new: DataFrame, order: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """A numbered table with rows appended (notes, searches, lists): texts are trimmed, empty ones null, rows without a required text left out."""
    texts = {f.name for f in new.schema if f.dataType.simpleString() == "string"}
    clean = new.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if c in texts else F.col(c) for c in new.columns])
    for column in required:
        clean = clean.filter(F.col(column).isNotNull())
    return old.unionByName(fitted(with_ids(clean, old, order), old))


def save_search(saved: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Saved searches with new ones (``name`` and the columns of criteria) as JSON; a search without name is left out."""
    criteria = [c for c in new.columns if c != "name"]
    rows = new.select("name", F.to_json(F.struct(*criteria)).alias("filters")).withColumn("created_at", now)
    return add_rows(saved, rows, ["name", "filters"], ["name"])


def touch_searches(saved: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Saved searches, those of ``ids`` (``id``) marked as checked now."""
    hit = saved.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return hit.withColumn("last_checked_at", F.when(F.col("__hit"), now).otherwise(F.col("last_checked_at"))).select(*saved.columns)


def delete_searches(saved: DataFrame, ids: DataFrame) -> DataFrame:
    """Saved searches without those of ``ids``."""
    return saved.join(ids.select("id").distinct(), "id", "left_anti")
