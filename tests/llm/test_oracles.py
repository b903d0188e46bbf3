import pytest

from turfline.llm import queries
from turfline.session import table

from ..support import DATA, check_oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    check_oracle(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.fixture(scope="module")
def rows(spark):
    def of(name):
        return [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]

    return of


def ids(spark, name, column):
    return {r[0] for r in table(spark, DATA, name).select(column).collect()}


def test_matches(spark, rows):
    named = {r[0] for r in table(spark, DATA, "player_aliases").filter("source = 'transfermarkt'").select("source_id").collect()}
    found, sure = rows("p1_found"), rows("p1_confidence")
    assert {(r["market_player_id"], r["player_id"]) for r in found} == {(r["market_player_id"], r["player_id"]) for r in sure} and len(found) > 5
    assert all(0 <= r["confidence"] <= 1 for r in sure) and not {str(r["market_player_id"]) for r in found} & named
    assert {r["market_player_id"] for r in found} <= ids(spark, "market_players", "market_player_id") and {r["player_id"] for r in found} <= ids(spark, "players", "player_id")


def test_spellings(spark, rows):
    found, sure = rows("p4_found"), rows("p4_confidence")
    assert {(r["alias_id"], r["player_id"]) for r in found} == {(r["alias_id"], r["player_id"]) for r in sure} and len(found) > 5
    open_aliases = {r[0] for r in table(spark, DATA, "player_aliases").filter("player_id is null").select("alias_id").collect()}
    assert {r["alias_id"] for r in found} <= open_aliases and all(0.86 <= r["confidence"] <= 1 for r in sure)


def test_quantiles(rows):
    for name in ("p6_quantiles", "p6_season_quantiles"):
        got = rows(name)
        assert len(got) > 20 and all(r["low"] <= r["estimate"] <= r["high"] and 0 <= r["rank_error"] <= r["n"] for r in got)
    assert all(0 <= r["decided"] <= r["may_be_off"] for r in rows("p6_decided"))


def test_mix(spark, rows):
    shares, taken, short = {r["source"]: r for r in rows("p8_shares")}, rows("p8_mix"), {r["source"] for r in rows("p8_found")}
    assert set(shares) == ids(spark, "mix_targets", "source") and short == {s for s, r in shares.items() if not r["reachable"]}
    longest = max(r["tokens"] for r in taken)
    for s, r in shares.items():
        own = [t for t in taken if t["source"] == s]
        assert sum(t["tokens"] for t in own) == r["mixed_tokens"] and r["repeats"] <= r["max_repeats"] and len({(t["doc_id"], t["copy"]) for t in own}) == len(own)
        assert s in short or r["mixed_tokens"] >= r["target_share"] * sum(x["mixed_tokens"] for x in shares.values()) - longest or r["repeats"] > 0
    assert sum(r["reached_share"] for r in shares.values()) == pytest.approx(1, abs=1e-4)


def test_cuts(spark, rows):
    cut, rates = {r["doc_id"] for r in rows("p9_found")}, rows("p9_rates")
    assert cut <= ids(spark, "documents", "doc_id") and sum(r["cut"] for r in rates) == len(cut)
    assert sum(r["documents"] for r in rates) == table(spark, DATA, "documents").count() and all(r["rate"] == pytest.approx(r["cut"] / r["documents"], abs=1e-6) for r in rates)


def test_every_query_has_sql_or_a_test():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"p1_found", "p1_confidence", "p4_found", "p4_confidence", "p6_quantiles", "p6_season_quantiles", "p6_decided", "p8_mix", "p8_shares", "p9_found", "p9_rates"}
