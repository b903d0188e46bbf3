import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from turfline.operators import ingest, jobs, search
from turfline.schema import TABLES

@pytest.fixture
def now(spark):
    return F.lit(datetime(2025, 1, 1))


def table(spark, name, rows=()):
    columns = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<(]*[>)])", TABLES[name])]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], TABLES[name])


def test_competitions(spark):
    old = table(spark, "competitions", [{"id": 4, "name": "Ligue 1", "country": "FRA", "tier": 2, "source_ids": {"a": "1"}}])
    stats = spark.createDataFrame([("FRA-Ligue 1",), ("ESP-La Liga",), ("FRA-Ligue 1",)], "league string")
    got = {r["name"]: (r["id"], r["country"], r["tier"], r["source_ids"]) for r in ingest.upsert_competitions(old, ingest.league_competitions(stats)).collect()}
    assert got == {"Ligue 1": (4, "FRA", 1, {"a": "1", "fbref": "FRA-Ligue 1"}), "La Liga": (5, "ESP", 1, {"fbref": "ESP-La Liga"})}


def test_clubs(spark):
    old = table(spark, "clubs", [{"id": 1, "normalized_name": "paris", "is_national_team": False, "source_ids": {"t": "583"}}, {"id": 2, "normalized_name": "lyon", "is_national_team": False}])
    new = table(spark, "clubs", [{"name": n, "normalized_name": n.lower(), "is_national_team": False, "source_ids": s} for n, s in (("PSG", {"t": "583", "u": "9"}), ("Lyon", {"t": "7"}), ("Nice", None))])
    out = {r["id"]: (r["normalized_name"], r["source_ids"]) for r in ingest.upsert_clubs(old, new, [["normalized_name"]], True, "t").collect()}
    assert out == {1: ("paris", {"t": "583", "u": "9"}), 2: ("lyon", {"t": "7"}), 3: ("nice", None)}
    named = ingest.upsert_clubs(old, new, [["normalized_name", "is_national_team"]])
    assert sorted(r["id"] for r in named.collect()) == [1, 2, 3, 4]


def test_season_stats(spark):
    old = table(spark, "player_season_stats", [{"player_id": 1, "season": "2022", "competition_id": 1, "club_id": 1, "minutes": 10, "metrics": {"goals": 1.0}, "source": "statsbomb"}])
    new = table(spark, "player_season_stats", [{"player_id": p, "season": "2022", "competition_id": 1, "club_id": 1, "minutes": 100, "metrics": {"goals": 2.0}, "source": "fbref"} for p in (1, 2)])
    got = {r["player_id"]: (r["minutes"], float(r["nineties"]), r["metrics"]["goals"], r["source"]) for r in ingest.upsert_season_stats(old, new).collect()}
    assert got == {1: (100, 1.11, 2.0, "statsbomb"), 2: (100, 1.11, 2.0, "fbref")}


PEOPLE = [{"id": 7, "full_name": "Oskar Fernhollow", "normalized_name": "oskar fernhollow", "birth_date": date(1994, 4, 4)}, {"id": 8, "normalized_name": "mirela vorn"}]


def test_resolution_and_review(spark, now):
    players = table(spark, "players", PEOPLE)
    aliases = table(spark, "player_aliases", [{"id": 1, "player_id": 8, "source": "s", "source_id": "m", "raw_name": "Mimi"}])
    queue = table(spark, "resolution_queue")
    records = spark.createDataFrame(
        [("s", i, n, None, None, p) for i, n, p in (("m", "Mimi", None), ("k", "Oskar Fernhollow", None), ("q", "O. Fernhollow", '{"foot": "left", "nationality": "x"}'), ("z", "Zuriel Ibbotson", None))],
        "source string, source_id string, raw_name string, birth_date date, nationality array<string>, raw_payload string",
    )
    r = ingest.resolve(records, players, aliases, queue, now)
    assert {x["source_id"]: (x["outcome"], x["player_id"]) for x in r.rows.collect()} == {"m": ("already_known", 8), "k": ("auto_resolved", 7), "q": ("needs_review", None), "z": ("new", None)}
    assert {(x["source_id"], x["player_id"]) for x in r.aliases.collect()} == {("m", 8), ("k", 7)}
    entry = r.queue.first()
    assert (entry["source_id"], entry["candidates"][0]["playerId"], entry["resolved_at"]) == ("q", 7, None)
    again = ingest.resolve(records, players, r.aliases, r.queue, now)
    assert again.aliases.count() == 2 and again.queue.count() == 1
    closed, settled = ingest.settle(r.queue, r.aliases, spark.createDataFrame([(entry["id"], 7)], "id int, player_id int"), now)
    assert closed.first()["resolved_at"] == datetime(2025, 1, 1) and settled.filter("resolved_manually").first()["source_id"] == "q"
    assert search.open_entries(closed).count() == 0 and search.open_entries(r.queue).count() == 1
    made = ingest.payload_players(r.queue).first()
    assert (made["foot"], made["nationality"]) == ("left", None)
    more, named = ingest.insert_players(players, r.aliases, records.filter("source_id = 'z'"), now)
    z = more.filter("id = 9").first()
    assert (z["normalized_name"], z["source_ids"]) == ("zuriel ibbotson", {"s": "z"}) and named.filter("player_id = 9").count() == 1
    by_hand, _ = ingest.insert_players(players, r.aliases, records.filter("source_id = 'z'").withColumn("raw_name", F.lit(" Élan ")), now, strip=False)
    assert by_hand.filter("id = 9").first()["normalized_name"] == " elan "
    found = spark.createDataFrame([(7, None, 178, {"t": "1"})], "player_id int, birth_date date, height_cm smallint, source_ids map<string,string>")
    u = ingest.update_players(players, found, ["birth_date", "height_cm"], now).filter("id = 7").first()
    assert (u["birth_date"], u["height_cm"], u["source_ids"], u["full_name"]) == (None, 178, {"t": "1"}, "Oskar Fernhollow")


def warehouse(spark, **rows):
    return {name: table(spark, name, rows.get(name, ())) for name in TABLES}


MARKET = "player_id int, name string, date_of_birth string, country_of_citizenship string, sub_position string, foot string, height_in_cm double, contract_expiration_date string, market_value_in_eur double, current_club_id int"


def test_market_load(spark, now):
    known = [{"id": 1, "player_id": 8, "source": "transfermarkt", "source_id": "31", "raw_name": "x"}]
    clubs = [{"id": 5, "normalized_name": "testella", "source_ids": {"u": "1"}}, {"id": 6, "normalized_name": "old name", "source_ids": {"transfermarkt_club": "72"}}]
    old = warehouse(spark, players=PEOPLE, player_aliases=known, clubs=clubs)
    market = spark.createDataFrame([
        (30, "Oskar Fernhollow", "1994-04-04", "Norway", "Left-Back", " Left", 180.0, None, 2e6, 71), (31, "Whoever", None, None, None, "both", None, "2030-06-30", None, 72),
        (32, "O. Fernhollow", None, None, None, None, None, None, None, None), (33, "Zuriel Ibbotson", "2001", "Chile", "Centre-Back", "n/k", None, None, None, 73), (None, "no id", None, None, None, None, None, None, None, None),
    ], MARKET)
    new_clubs = spark.createDataFrame([(71, "Téstella", "A"), (72, "New Name", "A"), (73, "Third", "A")], "club_id int, name string, domestic_competition_id string")
    load = jobs.ingest_market(old, market, new_clubs, now)
    assert {r["outcome"]: r["n"] for r in load.counts().collect()} == {"auto_resolved": 1, "already_known": 1, "needs_review": 1, "new": 1} and load.written.first()["n"] == 3
    assert {r["id"]: (r["normalized_name"], r["source_ids"]) for r in load.tables["clubs"].collect()} == {
        5: ("testella", {"u": "1", "transfermarkt_club": "71"}), 6: ("old name", {"transfermarkt_club": "72"}), 7: ("third", {"transfermarkt_club": "73"}),
    }
    people = {r["id"]: r for r in load.tables["players"].collect()}
    assert (people[7]["foot"], people[7]["height_cm"], people[7]["current_club_id"], people[7]["source_ids"]) == ("left", 180, 5, {"transfermarkt": "30"})
    assert (people[8]["current_club_id"], people[8]["contract_until"], people[8]["birth_date"]) == (6, date(2030, 6, 30), None)
    assert (people[9]["full_name"], people[9]["nationality"], people[9]["position_group"], people[9]["foot"], people[9]["current_club_id"]) == ("Zuriel Ibbotson", ["Chile"], "DC", None, 7)
    assert [r["source_id"] for r in load.tables["resolution_queue"].collect()] == ["32"]
    assert {r["source_id"]: (r["player_id"], float(r["confidence"] or 0)) for r in load.tables["player_aliases"].collect()} == {"31": (8, 0.0), "30": (7, 1.0), "33": (9, 1.0)}
    nothing = jobs.ingest_market(old, market.limit(0), new_clubs.limit(0), now)
    assert nothing.tables["players"].count() == 2 and nothing.written.first()["n"] == 0
    again = jobs.ingest_market(old | load.tables, market, new_clubs, now)
    assert {r["outcome"]: r["n"] for r in again.counts().collect()} == {"already_known": 3, "needs_review": 1} and again.tables["players"].count() == 3


def test_season_stats_load(spark, now):
    old = warehouse(spark, players=PEOPLE, competitions=[{"id": 3, "name": "Serie A", "country": "ITA", "tier": 2, "source_ids": {"a": "1"}}])
    row = lambda player, team, minutes, goals=1.0, league="ITA-Serie A": (league, "2030", team, player, minutes, minutes / 90, 9.0, goals, 0.0, 0.0, 0.0, 4.0, 2.0, 1.0, 1.0)
    columns = "league string, season string, team string, player string, pt_min double, pt_90s double, pt_mp double, perf_gls double, perf_ast double, perf_crdy double, perf_crdr double, std_sh double, std_sot double, exp_xg double, exp_npxg double"
    stats = spark.createDataFrame([row("Oskar Fernhollow", "Testella", 900.0), row("Fernhollow Oskar", "Testella", 450.0), row("Mirela Vorn", "Other", 90.0, league="ESP-La Liga"), row("M. Vorn", "Other", 90.0), row("Zuriel Ibbotson", "Other", 90.0), row("Mirela Vorn", "Idle", 0.0)], columns)
    load = jobs.ingest_season_stats(old, stats, now)
    assert {r["outcome"]: r["n"] for r in load.counts().collect()} == {"auto_resolved": 3, "needs_review": 1, "new": 1} and load.written.first()["n"] == 3
    assert {r["name"]: (r["id"], r["tier"], r["source_ids"]) for r in load.tables["competitions"].collect()} == {"Serie A": (3, 1, {"a": "1"}), "La Liga": (4, 1, {"fbref": "ESP-La Liga"})}
    got = {(r["player_id"], r["competition_id"]): (r["minutes"], r["source"], r["metrics"]["goals"]) for r in load.tables["player_season_stats"].collect()}
    assert got == {(7, 3): (900, "fbref", pytest.approx(0.1)), (8, 4): (90, "fbref", pytest.approx(1.0))}  # the larger source id of one key
    assert load.tables["clubs"].count() == 2 and load.tables["resolution_queue"].count() == 1
    bad = spark.createDataFrame([row("Oskar Fernhollow", "Testella", 900.0, league="XXX-Nowhere")], columns)
    with pytest.raises(Exception, match="unknown league"):
        jobs.ingest_season_stats(old, bad, now)
    assert jobs.ingest_season_stats(old, stats.limit(0), now).tables["player_season_stats"].count() == 0


def test_notes(spark):
    notes = table(spark, "scout_notes", [{"id": 3, "player_id": 1, "body": "x"}])
    new = table(spark, "scout_notes", [{"player_id": 1, "body": " good ", "context": "  "}, {"player_id": 1, "body": "  "}]).drop("id")
    out = {r["id"]: (r["body"], r["context"]) for r in ingest.add_rows(notes, new, ["player_id"], ["body"]).collect()}
    assert out == {3: ("x", None), 4: ("good", None)}


def test_saved_searches(spark, now):
    new = spark.createDataFrame([(" young ", ["ST"], 21), ("  ", ["W"], None), ("old", [], 30)], "name string, positions array<string>, ageMax int")
    saved = ingest.save_search(table(spark, "saved_searches", [{"id": 4, "name": "first", "filters": "{}"}]), new, now)
    assert {r["id"]: (r["name"], r["filters"]) for r in saved.collect()} == {4: ("first", "{}"), 5: ("old", '{"positions":[],"ageMax":30}'), 6: ("young", '{"positions":["ST"],"ageMax":21}')}
    one = spark.createDataFrame([(5,), (5,), (99,)], "id int")
    assert {r["id"]: r["last_checked_at"] for r in ingest.touch_searches(saved, one, now).collect()} == {4: None, 5: datetime(2025, 1, 1), 6: None}
    assert {r["id"] for r in ingest.delete_searches(saved, one).collect()} == {4, 6}
