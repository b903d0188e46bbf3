import glob
import json
import os
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from turfline.functions.scalars import french_date, labelled, looked_up, millions, percent
from turfline.operators import merge, search
from turfline.operators.jobs import market_records
from turfline.plans import app_queries
from turfline.registry import MARKET_POSITIONS, STATUS_LABELS
from turfline.schema import TABLES, violations
from turfline.sources import files
from turfline.sources.store import Store, replace_percentiles, replace_vectors

from .support import DATA, check_oracle


def test_filters_parse():
    f = search.Filters.parse({"positions": "W,ST,XX,GK", "foot": "gauche", "ageMax": "23x", "minutesMin": "0", "tier": "", "metric": ["xg", "y"], "percentileMin": 80})
    assert f == search.Filters(positions=("W", "ST"), age_max=23, minutes_min=0, metric="xg", percentile_min=80)
    assert search.Filters.parse({}) == search.Filters()
    assert search.Filters.parse({"minutesMin": 0}).minutes_min == 0


def test_moves_at_the_ends_change_nothing(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, 10, None, at), (1, 11, 0, at), (2, 20, None, at)]
    df = spark.createDataFrame(rows, "shortlist_id int, player_id int, rank int, added_at timestamp")
    move = lambda *m: {(r["shortlist_id"], r["player_id"]): r["rank"] for r in search.moved_entries(df, spark.createDataFrame(m, "shortlist_id int, player_id int, step int")).collect()}
    assert move((1, 11, -1), (2, 20, 1)) == {(1, 10): None, (1, 11): 0, (2, 20): None}
    assert move((1, 10, -1)) == {(1, 10): 0, (1, 11): 1, (2, 20): None}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x", {"s": "1"}), (2, "b", "y", None)], "id int, name string, v string, ids map<string,string>")
    new = spark.createDataFrame([(2, "B", None, {"t": "2"}), (3, "c", "z", None)], old.schema)
    got = {r["id"]: (r["name"], r["v"], r["ids"]) for r in merge.upsert(old, new, ["id"], ["v"], ["ids"]).collect()}
    assert got == {1: ("a", "x", {"s": "1"}), 2: ("b", None, {"t": "2"}), 3: ("c", "z", None)}
    kept = {r["id"]: r["v"] for r in merge.upsert(old, new, ["id"], ["v"], ["ids"], keep_known=True).collect()}
    assert kept[2] == "y"
    assert merge.upsert(old.limit(0), new, ["id"], ["v"]).count() == 2 and merge.upsert(old, new.limit(0), ["id"], ["v"]).count() == 2


def test_new_ids_follow_the_old(spark):
    old = spark.createDataFrame([(7,)], "id int")
    out = merge.with_ids(spark.createDataFrame([("c",), ("a",), ("b",)], "name string"), old, ["name"]).collect()
    assert sorted((r["name"], r["id"]) for r in out) == [("a", 8), ("b", 9), ("c", 10)]


def test_store_replaces_tables_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "w"))
    store.commit({"a": spark.range(3), "b": spark.range(4)})
    with pytest.raises(Exception, match="boom"):
        store.commit({"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("boom")).alias("id"))})
    assert (store.read("a").count(), store.read("b").count()) == (3, 4)
    store.commit({"a": store.read("a").unionByName(spark.range(5))})  # a table may be made from itself
    assert (store.read("a").count(), store.read("b").count()) == (8, 4)
    assert len(list((tmp_path / "w" / "a").iterdir())) == 1
    replace_percentiles(store, spark.range(2), spark.createDataFrame([("2022", 1)], "season string, player_id int"))
    replace_vectors(store, spark.range(6))
    assert (store.read("peer_groups").count(), store.read("player_percentiles").count(), store.read("player_vectors").count()) == (2, 1, 6)


def test_runs_are_logged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "w"))
    assert store.run("manual", "all", lambda: ({"a": spark.range(2)}, 2)) == 2
    with pytest.raises(ZeroDivisionError):
        store.run("manual", "all", lambda: ({"a": spark.range(1 // 0)}, 0))
    assert sorted((r["status"], r["rows_written"]) for r in store.runs().collect()) == [("failed", None), ("success", 2)]
    assert store.read("a").count() == 2


def test_csv_contract(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_market_clubs(spark, str(tmp_path / "none"))
    (tmp_path / "clubs.csv").write_text("club_id,name\n41,Testella\n")
    with pytest.raises(ValueError, match="domestic_competition_id"):
        files.read_market_clubs(spark, str(tmp_path))
    (tmp_path / "clubs.csv").write_text("name,club_id,domestic_competition_id,more\nTestella,41,T1,x\nMontvale,none,T1,x\n")
    rows = files.read_market_clubs(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(41, "Testella", "T1"), (None, "Montvale", "T1")]


def test_json_reader_fills_absent_columns(spark, tmp_path):
    (tmp_path / "77.json").write_text('[{"id": "a", "type": "Shot", "period": 1}]')
    r = files.read_events(spark, str(tmp_path / "77.json")).first()
    assert (r["match_id"], r["id"], r["shot_outcome"]) == (77, "a", None)


def test_unknown_labels_are_errors(spark):
    df = spark.createDataFrame([("Sweeper",)], "p string")
    with pytest.raises(Exception, match="unknown sub_position: Sweeper"):
        df.select(looked_up(F.col("p"), MARKET_POSITIONS, "sub_position")).collect()


def test_violations(spark):
    rows = spark.createDataFrame([(1, 5, None, None, None, 11, None), (1, 6, None, None, None, 3, None)], TABLES["scout_notes"])
    players = spark.createDataFrame([(5,)], "id int")
    got = {r["rule"]: r["n"] for r in violations("scout_notes", rows, {"players": players}).collect()}
    assert got == {"key": 2, "parent of player_id": 1, "values": 1}


STINT = {"position": "Left Wing", "from": "00:00", "to": None, "from_period": 1, "to_period": None}


def test_match_readers(spark, tmp_path):
    (tmp_path / "matches.json").write_text(json.dumps([{"match_id": 5, "competition_id": 2, "season": "2030", "home_team": "H", "home_team_id": 1, "unknown": 3}, {"match_id": 6}]))
    rows = {r["match_id"]: r for r in files.read_matches(spark, str(tmp_path / "matches.json")).collect()}
    assert (rows[5]["home_team_id"], rows[5]["away_team"], rows[6]["season"]) == (1, None, None)
    (tmp_path / "5.json").write_text(json.dumps([{"player_id": 9, "player_name": "A", "positions": [STINT], "__team": "H"}, {"player_id": 8, "positions": [], "__team": "H"}]))
    lines = {r["player_id"]: r for r in files.read_lineups(spark, str(tmp_path / "5.json")).collect()}
    assert (lines[9]["match_id"], lines[9]["team"], lines[9]["positions"][0]["from_period"], lines[8]["positions"]) == (5, "H", 1, [])


def test_market_reader(spark, tmp_path):
    header = "player_id,name,date_of_birth,country_of_citizenship,sub_position,foot,height_in_cm,contract_expiration_date,market_value_in_eur,current_club_id"
    (tmp_path / "players.csv").write_text(f'{header}\n7,"Quaye, Tamsin",2000-01-02,,Left Winger,left,,soon,1500000.0,41\n')
    r = files.read_market_players(spark, str(tmp_path)).first()
    assert (r["name"], r["country_of_citizenship"], r["height_in_cm"], r["market_value_in_eur"], r["current_club_id"]) == ("Quaye, Tamsin", None, None, 1.5e6, 41)
    record = market_records(files.read_market_players(spark, str(tmp_path))).first()
    assert (record["source_id"], record["birth_date"], record["nationality"], record["position_group"], record["contract_until"], record["market_value_eur"]) == ("7", date(2000, 1, 2), [], "W", None, 1_500_000)


def test_season_stat_tables(spark):
    one = spark.createDataFrame([("L", "S", "T", "P", 90.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 5)], files.STANDARD + ", more int")
    two = spark.createDataFrame([("L", "S", "T", "Q", 1.0, 1.0, 0.1, 0.1)], files.SHOOTING)
    r = files.season_stats(one, two).first()
    assert (r["player"], r["perf_gls"], r["std_sh"]) == ("P", 1.0, None)
    with pytest.raises(ValueError, match="exp_npxg"):
        files.season_stats(one, two.drop("exp_npxg"))


def test_cached_or_fetched(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return [{"match_id": 5, "season": "2030"}]

    for _ in range(2):
        assert files.cached_json(spark, str(tmp_path / "raw" / "m.json"), fetch, files.MATCHES).first()["season"] == "2030"
    assert len(calls) == 1


def test_shown_values(spark):
    row = spark.createDataFrame([(250_000, 0.125, datetime(2031, 2, 1), "observe", None)], "v bigint, s double, d timestamp, t string, n bigint")
    got = row.select(millions(F.col("v")), millions(F.col("n")), millions(-F.col("v")), percent(F.col("s")), french_date(F.col("d")), labelled(F.col("t"), STATUS_LABELS), labelled(F.lit("new"), STATUS_LABELS)).first()
    assert tuple(got) == ("0.3 M€", None, "-0.3 M€", "13 %", "01/02/2031", "Observé", "new")


def test_criteria_survive_storage():
    f = search.Filters(positions=("W", "ST"), foot="left", age_min=0, contract_before="2030-01-01", metric="xg", percentile_min=60)
    assert search.Filters.parse(json.loads(f.to_json())) == f
    assert search.Filters.parse(json.loads(search.Filters().to_json())) == search.Filters()


def test_sheet_shows_values_that_are_equal_as_rounded_once(spark, tmp_path):
    for path in glob.glob(f"{DATA}/*.parquet"):
        if "player_percentiles" not in path:
            os.symlink(path, tmp_path / os.path.basename(path))
    rows = f"SELECT * FROM '{DATA}/player_percentiles.parquet'"
    duckdb.sql(f"COPY ({rows} UNION ALL SELECT * REPLACE (raw_value + 1e-9 AS raw_value) FROM ({rows})) TO '{tmp_path}/player_percentiles.parquet' (FORMAT parquet)")
    check_oracle(spark, app_queries.player_sheet, app_queries.ORACLES["player_sheet"], str(tmp_path))
