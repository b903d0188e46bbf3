import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.functions.scalars import age_years, clock_minutes, cosine, formatted, merged_maps, season_year
from turfline.functions.text import normalize_name
from turfline.operators import events as E
from turfline.operators import peers, vectors
from turfline.registry import LINEUP_POSITIONS, METRIC_KEYS, POSITION_LABELS

STINTS = "array<struct<position:string,`from`:string,`to`:string,from_period:int,to_period:int>>"
# own clocks: three periods, the last one in added time
START, END = {1: 0.0, 2: 45.0, 3: 90.0}, {1: 46.5, 2: 93.25, 3: 108.0}


def walked(stints, last):
    """Minutes by walking through the stints one by one."""
    total = 0.0
    at = lambda clock: int(clock.split(":")[0]) + int(clock.split(":")[1]) / 60
    for _, start, end, p, q in stints or []:
        p = 1 if p is None else p
        if p > last:
            break
        open_end = end is None or q is None or q < p or q > last
        total += max((END.get(last, 0.0) if open_end else at(end)) - (START.get(p, 0.0) if start is None else at(start)), 0.0)
        if open_end:
            break
    return total


def test_minutes_played_against_a_walk(spark):
    rng = random.Random(11)
    clock = lambda: rng.choice([None, f"{rng.randint(0, 107):02d}:{rng.randint(0, 59):02d}"])
    stints = [[("x", clock(), clock(), rng.choice([None, 1, 2, 3, 5]), rng.choice([None, 1, 2, 3])) for _ in range(rng.randint(0, 4))] for _ in range(400)] + [None]
    rows = [(i, s, START, END, rng.choice([2, 3])) for i, s in enumerate(stints)]
    df = spark.createDataFrame(rows, f"i int, p {STINTS}, s map<int,double>, e map<int,double>, last int")
    got = {r["i"]: r["m"] for r in df.select("i", E.minutes_played(F.col("p"), F.col("s"), F.col("e"), F.col("last")).alias("m")).collect()}
    assert all(math.isclose(got[i], walked(s, last), abs_tol=1e-9) for i, s, *_, last in rows) and len({round(v) for v in got.values()}) > 50


def test_clocks_come_from_the_events(spark):
    rows = [(1, 1, "Half Start", 0, 0), (1, 1, "Half Start", 0, 5), (1, 1, "Half End", 46, 30), (1, 1, "Half End", 46, 10), (1, 2, "Half Start", 45, 0), (1, 2, "Pass", 99, 0), (1, 5, "Half Start", 0, 0), (2, 1, "Pass", 3, 3)]
    got = {r["match_id"]: r for r in E.period_clocks(spark.createDataFrame(rows, "match_id int, period int, type string, minute int, second int")).collect()}
    assert (got[1]["period_start"], got[1]["period_end"], got[1]["last_period"]) == ({1: 0.0, 2: 45.0, 5: 0.0}, {1: 46.5}, 4)
    assert (got[2]["period_start"], got[2]["last_period"]) == ({}, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "expected"), [("Zoé Ñúñez  Öztürk", "zoe nunez  ozturk"), ("ØDEGAARD Łukasz ß", "odegaard lukasz ss"), (" Æ ", "ae"), ("é", "e"), (None, None)])
def test_names_are_folded(spark, raw, expected):
    assert one(spark, normalize_name(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(("season", "year"), [("2022", 2022), ("2018-2019", 2018), ("2223", 2022), ("x 1999", 1999), (None, None)])
def test_season_year(spark, season, year):
    assert one(spark, season_year(F.lit(season).cast("string"))) == year


def test_season_without_year_is_an_error(spark):
    with pytest.raises(Exception, match="no year"):
        one(spark, season_year(F.lit("first")))


def test_small_functions(spark):
    assert one(spark, age_years(F.lit(date(2000, 2, 29)), F.lit(date(2025, 2, 28)))) == 24
    assert one(spark, clock_minutes(F.lit("64:30"))) == 64.5
    assert one(spark, clock_minutes(F.lit("64:30:99"))) == 64.5
    assert one(spark, formatted(F.lit(0.425), F.lit("pct"))) == "43 %"
    assert one(spark, formatted(F.lit(1.5), F.lit("int"))) == "2"
    assert one(spark, formatted(F.lit(1.25), F.lit("dec1"))) == "1.3"
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    a, b = F.create_map(F.lit("k"), F.lit("1"), F.lit("m"), F.lit("2")), F.create_map(F.lit("k"), F.lit("3"))
    assert one(spark, merged_maps(a, b)) == {"k": "3", "m": "2"}
    assert one(spark, merged_maps(F.lit(None).cast("map<string,string>"), b)) == {"k": "3"}


STATS = "player_id int, season string, position_group string, tier int, minutes int, metrics map<string,double>"


def ranked(spark, rows):
    out = peers.percentiles(spark.createDataFrame(rows, STATS))
    return {(r["player_id"], r["peer_group_id"], r["metric"]): r["percentile"] for r in out.collect()}


def test_percentiles_against_counting(spark):
    rng = random.Random(5)
    rows = [(i, "2030", "ST", 2, 700, {"assists": rng.choice([0.1, 0.2, round(rng.random(), 2)]), "red_cards": rng.choice([0.0, 0.5, 1.0])}) for i in range(60)]
    for (i, g, m), p in ranked(spark, rows).items():
        sign = -1 if m == "red_cards" else 1
        values, own = [sign * r[5][m] for r in rows], sign * rows[i][5][m]
        rank = sum(v < own for v in values) + (sum(v == own for v in values) + 1) / 2
        assert g == "ST|tier2|2030" and p == round(rank / 60 * 100), (i, m)


def test_a_group_in_many_ranges(spark):
    rng = random.Random(6)
    rows = [(g, float(v), 1 + v % 3) for g in ("a", None) for v in rng.sample(range(5_000), 1_500)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    for size in (7, 100, 10_000):
        got = peers.running_counts(df, ["g"], "v", "n", size).collect()
        assert len(got) == len(rows)
        for g in ("a", None):
            total, own = 0, sorted((r for r in got if r["g"] == g), key=lambda r: r["v"])
            for r in own:
                total += r["n"]
                assert r["__upto"] == total
            assert {r["__all"] for r in own} == {total}
    assert peers.running_counts(df.limit(0), ["g"], "v", "n", 7).count() == 0


def test_peer_groups_are_apart(spark):
    rows = [(1, "2022", "CM", 1, 900, {"goals": 1.0}), (2, "2022", "DC", 1, 900, {"goals": 1.0}), (3, "2022", "CM", 2, 900, {"goals": 1.0}), (4, "2025", "CM", 1, 900, {"goals": 1.0}), (5, "2023", "CM", 1, 900, {"goals": 2.0}), (6, "2022", "CM", 1, 599, {"goals": 2.0})]
    df = spark.createDataFrame(rows, STATS)
    sizes = {r["peer_group_id"]: (r["sample_size"], r["label"]) for r in peers.peer_groups(df).collect()}
    assert sizes["CM|tier1|2022"] == (2, "Milieux centraux · Niveau 1 · 2022")
    assert sizes["DC|tier1|2022"][0] == sizes["CM|tier2|2022"][0] == 1
    member = {(r["player_id"], r["season"]) for r in peers.percentiles(df).filter("peer_group_id = 'CM|tier1|2022'").collect()}
    assert member == {(1, "2022"), (5, "2023")}
    assert peers.percentiles(df.limit(0)).count() == 0


def test_null_and_nan_metrics_give_no_row(spark):
    got = ranked(spark, [(1, "2022", "CM", 1, 900, {"goals": float("nan"), "xg": None}), (2, "2022", "CM", 1, 900, {"goals": 1.0}), (3, "2022", "CM", 1, 900, None)])
    assert list(got) == [(2, "CM|tier1|2022", "goals")]


def test_two_clubs_are_weighted_by_minutes(spark):
    out = peers.one_row_each(spark.createDataFrame([(1, "2022", "CM", 1, 900, {"goals": 1.0}), (1, "2022", "CM", 1, 300, {"goals": 0.0})], STATS))
    assert out.first()["raw_value"] == 0.75


def test_vectors(spark):
    rng = np.random.default_rng(0)
    keys = [f"m{i}" for i in range(10)]
    rows = [(i, "2023", ("CM", "DC", "ST")[i % 3], dict(zip(keys, map(float, rng.random(10)))), dict(zip(keys, map(int, rng.integers(0, 101, 10))))) for i in range(50)]
    rows.append((50, "2023", "CM", {k: 3 * v for k, v in rows[0][3].items()}, rows[0][4]))  # the same profile three times as high
    df = spark.createDataFrame(rows, "player_id int, season string, position_group string, metrics map<string,double>, p map<string,int>")
    maps = df.select("player_id", "season", F.col("p").alias("percentiles"))
    out = {r["player_id"]: r for r in vectors.player_vectors(df, maps, keys).collect()}
    assert len(out) == 51
    assert all(len(r["style_vec"]) == 32 and np.isfinite(r["style_vec"]).all() and not any(r["style_vec"][10:]) for r in out.values())
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    assert cos(out[0]["style_vec"], out[50]["style_vec"]) == pytest.approx(1.0, abs=1e-5)
    a, b = np.array([list(r[3].values()) for r in rows]), np.array([r[4][k] / 100 for r in rows for k in keys]).reshape(51, 10)
    assert cos(out[3]["quality_vec"], out[7]["quality_vec"]) == pytest.approx(cos(b[3], b[7]), abs=1e-5)
    assert a.shape == (51, 10)
    assert vectors.player_vectors(df.limit(0), maps, keys).count() == 0


def test_events_to_metrics(spark):
    columns = "id string, match_id bigint, player_id double, type string, period int, minute int, second int, shot_outcome string, shot_type string, shot_statsbomb_xg double, pass_shot_assist boolean, pass_goal_assist boolean, pass_assisted_shot_id string, dribble_outcome string, duel_type string, duel_outcome string, foul_committed_card string, bad_behaviour_card string"
    blank = dict.fromkeys([c.split()[0] for c in columns.split(", ")])
    make = lambda **k: tuple((blank | {"match_id": 1, "player_id": 5.0, "period": 1, "minute": 1, "second": 0} | k).values())
    rows = [
        make(id="s1", type="Shot", shot_outcome="Goal", shot_statsbomb_xg=0.4),
        make(id="s2", type="Shot", shot_outcome="Goal", shot_type="Penalty", shot_statsbomb_xg=0.76),
        make(id="s3", type="Shot", shot_outcome="Goal", period=5, shot_statsbomb_xg=0.76),
        make(id="p", type="Pass", player_id=6.0, pass_shot_assist=True, pass_goal_assist=True, pass_assisted_shot_id="s1"),
        make(id="d", type="Dribble", dribble_outcome="Complete"), make(id="d2", type="Dribble", dribble_outcome="Incomplete"),
        make(id="t", type="Duel", duel_type="Tackle", duel_outcome="Success Out"), make(id="f", type="Foul Committed", foul_committed_card="Second Yellow"),
        make(id="b", type="Bad Behaviour", bad_behaviour_card="Yellow Card"), make(id="n", type="Clearance", player_id=None),
    ]
    got = {r["player_id"]: r for r in E.event_counters(spark.createDataFrame(rows, columns)).collect()}
    five, six = got[5], got[6]
    assert (five["goals"], five["np_goals"], five["shots"]) == (2, 1, 2)
    assert five["xg"] == pytest.approx(1.16) and five["npxg"] == pytest.approx(0.4)
    assert (five["yellow_cards"], five["red_cards"], five["tackles_won"], five["dribbles_completed"], five["clearances"]) == (2, 1, 1, 1, 0)
    assert six["xa"] == pytest.approx(0.4) and six["key_passes"] == six["assists"] == 1
    played = spark.createDataFrame([(5, 180.0), (6, 0.0)], "player_id int, minutes double")
    metrics = E.per90(E.event_counters(spark.createDataFrame(rows, columns)).drop("match_id").join(played, "player_id")).collect()
    assert [r["player_id"] for r in metrics] == [5]
    assert metrics[0]["goals"] == 1.0 and metrics[0]["dribble_success_rate"] == 0.5 and metrics[0]["xg_per_shot"] == pytest.approx(0.58)
    assert set(METRIC_KEYS) <= set(metrics[0].asDict())


def test_provider_rows(spark):
    columns = "league string, season string, team string, player string, pt_min double, pt_90s double, pt_mp double, perf_gls double, perf_ast double, perf_crdy double, perf_crdr double, std_sh double, std_sot double, exp_xg double, exp_npxg double"
    base = ("ITA-Serie A", "2019-2020", "Testella", "Órla Quént", 450.0, 5.0, 8.0, 4.0, 1.0, 2.0, 1.0, 16.0, 7.0, 2.0, 1.5)
    change = lambda **k: tuple(k.get(c.split()[0], v) for c, v in zip(columns.split(", "), base))
    run = lambda *rows: E.provider_metrics(spark.createDataFrame(list(rows), columns)).collect()
    row = run(base)[0]
    assert [row[k] for k in ("goals", "assists", "yellow_cards", "red_cards", "shots", "xg", "npxg", "xg_per_shot")] == pytest.approx([0.8, 0.2, 0.4, 0.2, 3.2, 0.4, 0.3, 0.125])
    assert (row["source_id"], row["minutes"], row["matches_played"]) == ("ITA-Serie A|2019-2020|Testella|orla quent", 450, 8)
    assert run(*[change(pt_min=m) for m in (0.0, -1.0, None, float("nan"))]) == []
    gone = run(change(pt_mp=float("nan"), perf_gls=None, perf_crdy=float("nan"), std_sh=0.0))[0]
    assert (gone["matches_played"], gone["goals"], gone["yellow_cards"], gone["xg_per_shot"]) == (None, 0.0, 0.0, 0.0)


def test_season_totals(spark):
    rows = [(2, "t", 8, 1, "B", None, "2022", 50.0, "Left Back"), (1, "t", 8, 1, None, "France", "2022", 90.0, "Center Back"), (3, "u", 9, 1, "C", "Spain", "2022", 10.0, "Right Center Back"), (4, "t", 8, 1, "D", None, "2022", 1.0, "Left Back")]
    df = spark.createDataFrame(rows, "match_id bigint, team string, team_id int, player_id int, player_name string, country string, season string, minutes double, position string")
    r = E.season_totals(df).first()
    # the most frequent label decides, though more labels name another group
    assert (r["minutes"], r["matches_played"], r["player_name"], r["country"], r["team_id"], r["position"], r["position_group"]) == (151.0, 4, "B", "France", 8, "Left Back", "FB")


def test_competition_metrics(spark):
    """Clocks, minutes and counters from events alone; goalkeepers and those who didn't play are left out."""
    columns = "id string, match_id bigint, player_id double, type string, period int, minute int, second int, shot_outcome string, shot_type string, shot_statsbomb_xg double, pass_shot_assist boolean, pass_goal_assist boolean, pass_assisted_shot_id string, dribble_outcome string, duel_type string, duel_outcome string, foul_committed_card string, bad_behaviour_card string"
    blank = dict.fromkeys([c.split()[0] for c in columns.split(", ")])
    make = lambda **k: tuple((blank | {"match_id": 7, "period": 1, "minute": 0, "second": 0} | k).values())
    events = [make(id="a", type="Half Start"), make(id="b", type="Half End", minute=45), make(id="c", type="Half Start", period=2, minute=45), make(id="d", type="Half End", period=2, minute=90),
              make(id="e", type="Clearance", player_id=1.0), make(id="f", type="Clearance", player_id=None, period=2), make(id="g", type="Clearance", player_id=2.0)]
    stint = lambda label, start="00:00", end=None: [(label, start, end, 1, 1 if end else None)]
    lineups = [(7, "Home", 1, "A", "X", stint("Left Wing", "00:00", "30:00")), (7, "Away", 2, "B", None, stint("Goalkeeper")), (7, "Away", 3, "C", None, stint("Left Wing", "20:00", "20:00")), (7, "Away", 4, "D", None, []), (7, "Away", 5, "E", None, stint("Right Wing"))]
    matches = [(7, 3, "Cup", "Land", "2030", "Home", 70, "Away", 71)]
    out = E.competition_metrics(
        spark.createDataFrame(events, columns), spark.createDataFrame(lineups, f"match_id bigint, team string, player_id int, player_name string, country string, positions {STINTS}"),
        spark.createDataFrame(matches, "match_id bigint, competition_id int, competition_name string, competition_country_name string, season string, home_team string, home_team_id int, away_team string, away_team_id int"),
    )
    got = {r["player_id"]: (r["minutes"], r["clearances"], r["team_id"], r["position_group"]) for r in out.collect()}
    assert got == {1: (30.0, 3.0, 70, "W"), 5: (90.0, 0.0, 71, "W")}


def test_position_labels():
    assert len(LINEUP_POSITIONS) == 23 and set(LINEUP_POSITIONS.values()) == set(POSITION_LABELS)


def test_similar_rows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("turfline.operators.blocks.ROW_BLOCK", 40)
    monkeypatch.setattr("turfline.operators.blocks.SMALL_BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i % 70, f"s{i // 70}", [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(130)]
    rows += [(200, "s0", None), (201, "s0", []), (202, "s0", [0.0] * 4), (203, "s0", [float("nan")] * 4), (204, "s0", [1.0]), (205, "s0", rows[3][2]), (206, "s0", rows[3][2]), (None, "s0", rows[3][2])]
    df = spark.createDataFrame(rows, "player_id int, season string, v array<float>")
    asked = vectors.earliest(df.filter("player_id % 10 = 3 or player_id >= 200"))
    got = {}
    for r in sorted(vectors.similar_to(df, asked, "v", 6).collect(), key=lambda r: r["place"]):
        got.setdefault(r["target"], []).append((r["player_id"], r["season"]))
    real = [r for r in rows if r[0] is not None and r[2] and len(r[2]) == 4 and np.isfinite(r[2]).all() and any(r[2])]
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for p, s, v in real:
        if (p % 10 == 3 or p >= 200) and s == "s0":
            assert got.pop(p) == [x[1:] for x in sorted((-cos(v, w), q, t) for q, t, w in real if q != p)[:6]]
    assert got == {}
    assert vectors.similar_to(df.limit(0), asked, "v", 6).count() == vectors.similar_to(df, asked.limit(0), "v", 6).count() == 0
