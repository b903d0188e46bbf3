import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turfline.llm import qdigest as Q
from turfline.llm import similarity as S
from turfline.llm.mixing import mix, plan, sized_documents, token_counts, tokenizer, TOKENIZER
from turfline.llm.similarity import nearest, similar_pairs
from turfline.llm.survivorship import player_fields, survivors

ROWS = "grp int, player_id int, market_value_eur bigint, contract_until date, position_group string, updated_at timestamp, kind string, n int"


def winners(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS)
    return {(r["grp"], r["field"]): (r["player_id"], r["value"]) for r in survivors(df, "grp", "player_id", "updated_at", player_fields(), **options).collect()}


def test_latest_real_value_survives(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [
        (1, 10, 50_000, date(2027, 6, 30), " cm ", t(1)), (1, 11, 999_999_999, date(9999, 12, 31), "??", t(5)), (1, 12, None, None, None, t(9)),
        (2, 20, 1, None, "XX", t(1)), (3, 31, 75_000, None, "ST", t(2)), (3, 30, 80_000, None, "W", t(2)),
        (1, 10, 50_000, date(2027, 6, 30), " cm ", t(1)), (None, 40, 50_000, None, "ST", t(1)), (4, None, 50_000, None, "ST", t(1)),
    ]
    assert winners(spark, rows) == {
        (1, "market_value_eur"): (10, "50000"), (1, "contract_until"): (10, "2027-06-30"), (1, "position_group"): (10, "CM"),
        (3, "market_value_eur"): (30, "80000"), (3, "position_group"): (30, "W"),
    }
    assert winners(spark, []) == {}


def test_learned_precedence_orders_untimed_rows(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [(g, 10 * g + k, None, None, p, t(k + 1)) for g in range(1, 8) for k, p in enumerate(("W", "AM"))]  # W becomes AM
    rows += [(50, 500, None, None, "AM", None), (50, 501, None, None, "W", None), (50, 502, None, None, "W", None)]
    rows += [(51, 510, None, None, "ST", t(3)), (51, 511, None, None, "GK", None)]  # nothing learned: the timed one
    got = winners(spark, rows)
    assert got[50, "position_group"] == (500, "AM") and got[51, "position_group"] == (510, "ST")
    assert winners(spark, rows, support=100)[50, "position_group"] == (501, "W")


def test_precedence_reaches_over_absent_classes(spark):
    t = lambda d: datetime(2024, 1, d)
    step = lambda g, a, b: [(g, 10 * g, None, None, a, t(1)), (g, 10 * g + 1, None, None, b, t(2))]
    rows = [r for g in range(1, 7) for r in step(g, "W", "AM")] + [r for g in range(11, 17) for r in step(g, "AM", "CM")]
    rows += [r for g in range(21, 27) for r in step(g, "GK", "DC") + step(g + 10, "DC", "FB") + step(g + 20, "FB", "GK")]  # a cycle
    rows += [(90, 900, None, None, "CM", None), (90, 901, None, None, "W", None), (90, 902, None, None, "W", None)]
    rows += [(91, 910, None, None, "GK", None), (91, 911, None, None, "FB", None), (91, 912, None, None, "FB", None)]
    got = winners(spark, rows)
    assert got[90, "position_group"] == (900, "CM")  # W, AM, CM, though the group has no AM
    assert got[91, "position_group"] == (911, "FB")  # in no order: that of more rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**Q.BITS - 1), min_size=1, max_size=400), st.integers(1, 60))
def test_digest_rank_error_is_bounded(cells, k):
    leaf, count = np.unique(np.array(cells) + 2**Q.BITS, return_counts=True)
    nodes, weights = Q.compress(leaf, count, k)
    assert weights.sum() == len(cells) and len(np.unique(nodes)) == len(nodes)
    sure, possible = Q.below(nodes, weights, leaf - 2**Q.BITS)
    less = np.concatenate([[0], np.cumsum(count)[:-1]])
    assert (sure <= less).all() and (less + count <= possible).all()
    assert (less - sure <= Q.BITS * (len(cells) // k)).all()


def test_quantizer_keeps_order(spark):
    rng = random.Random(1)
    values = sorted([0.0, -0.0, 1.0, 2.0, 4.0, 0.5, -1.0, 1e300, -1e300, 1e-300, math.inf, -math.inf, *[rng.uniform(-5, 5) for _ in range(500)], *[2.0**k for k in range(-70, 70)]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "v double")
    got = [(r["v"], r["c"]) for r in df.select("v", Q.quantize(F.col("v")).alias("c")).collect()]
    known = [c for v, c in got if v is not None and not math.isnan(v)]
    assert known == sorted(known) and 0 <= known[0] and known[-1] < 2**Q.BITS
    assert [c for v, c in got if v is None or math.isnan(v)] == [None, None]


def test_merged_digests_bound_the_quantiles(spark):
    rng = random.Random(2)
    rows = [(g, s, rng.choice([0.0, rng.gauss(0, 1), rng.gauss(50, 9)])) for g in ("a", "b", None) for s in range(3) for _ in range(400)] + [("a", 0, None), ("a", 0, math.nan)]
    df = spark.createDataFrame(rows, "g string, s int, v double")
    parts = [Q.digests(df.filter(F.col("s") == s), ["g"], "v", 50) for s in range(3)]
    out = Q.quantiles(Q.merge(parts, ["g"], 50), ["g"], (0.1, 0.5, 0.99)).collect()
    assert len(out) == 9
    for r in out:
        own = sorted(v for g, _, v in rows if g == r["g"] and v is not None and not math.isnan(v))
        exact = own[max(math.ceil(r["probability"] * len(own)) - 1, 0)]
        assert r["n"] == len(own) == 1200 and r["low"] <= exact <= r["high"] and r["low"] <= r["estimate"] <= r["high"]
        assert r["rank_error"] <= 2 * Q.BITS * (1200 // 50)
    assert Q.quantiles(Q.digests(df.limit(0), ["g"], "v", 50), ["g"], (0.5,)).count() == 0


@pytest.mark.parametrize("k", [4, 40, None])
def test_misranked_against_brute_force(spark, k):
    rng = random.Random(3)
    rows = [(i, g, m, rng.choice([0.0, 0.5, round(rng.random(), 3)]), rng.randint(0, 100), "clash") for i in range(300) for g in ("x", None) for m in ("goals", "red_cards")]
    rows += rows[:20] + [(1000, "x", "goals", None, 5, "c"), (1001, "x", "goals", math.nan, 5, "c"), (1002, "x", "goals", 0.5, None, "c")]
    df = spark.createDataFrame(rows, "id int, g string, m string, v double, p int, cell string")
    found = {(r["id"], r["g"], r["m"]) for r in Q.misranked(df, ["g", "m"], "v", "p", F.col("m") == "red_cards", k=k).collect()}
    once, expected = set(r for r in rows if r[3] is not None and r[3] == r[3]), set()
    for i, g, m, v, p, _ in once:
        sign = -1 if m == "red_cards" else 1
        peers = [sign * x[3] for x in once if x[1] == g and x[2] == m]
        rank = sum(x < sign * v for x in peers) + (sum(x == sign * v for x in peers) + 1) / 2
        if p is not None and abs(p - rank * 100 / len(peers)) > 10:
            expected.add((i, g, m))
    assert found == expected
    assert Q.misranked(df.limit(0), ["g", "m"], "v", "p", F.col("m") == "red_cards").count() == 0


def test_digests_decide_most_rows_where_they_are_compressed(spark):
    rng = random.Random(13)
    rows = [(i, round(rng.gauss(0, 1), 4)) for i in range(6_000)]
    place = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: r[1]))}
    stored = [(i, "g", v, min(100, max(0, round(place[i] / 60) + rng.choice([0, 0, 0, 25, -25])))) for i, v in rows]
    df = spark.createDataFrame(stored, "id int, g string, v double, p int")
    k = Q.compression(10.0)
    assert Q.digests(df, ["g"], "v", k).count() < 0.5 * df.select(Q.quantize(F.col("v"))).distinct().count()
    wide, exact = Q.judged_ranks(df, ["g"], "v", "p", F.lit(False), 10.0, k)
    decided = wide.filter("__sure").count()
    assert 0 < exact.count() + decided == sum(abs(p - place[i] / 60) > 10 for i, _, _, p in stored)  # values are distinct but for few
    assert decided > 0.5 * wide.count()
    checked = Q.checked_quantiles(df, Q.digests(df, ["g"], "v", k), ["g"], "v", (0.0, 0.1, 0.5, 1.0)).collect()
    values = sorted(v for _, v in rows)
    assert [(r["exact"], r["inside"], r["rank_off"] <= r["rank_error"] <= 2 * Q.BITS * (6_000 // k)) for r in sorted(checked, key=lambda r: r["probability"])] == [
        (values[max(math.ceil(p * 6_000) - 1, 0)], True, True) for p in (0.0, 0.1, 0.5, 1.0)
    ]


VECTORS = "kind string, player_id int, season string, v array<float>, h1 int"


def brute_neighbours(rows, k=5):
    out = {}
    clean = {(kind, p, s, tuple(v)) for kind, p, s, v, _ in rows if v and p is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for kind, p, s, v in clean:
        scored = []
        for kind2, q, t, w in clean:
            if kind2 == kind and q != p:
                n = max(len(v), len(w))
                a, b = np.array([*v, *[0.0] * (n - len(v))]), np.array([*w, *[0.0] * (n - len(w))])
                scored.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), q, t))
        out[kind, p, s] = [(q, t) for _, q, t in sorted(scored)[:k]]
    return out


def ranked(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        got.setdefault((r["kind"], r["player_id"], r["season"]), []).append((r["other_id"], r["other_season"]))
    return got


@pytest.mark.parametrize("k", [1, 5, 10])
def test_neighbours_against_brute_force(spark, k):
    rng = np.random.default_rng(4)
    rows = [("a", i, "s", [float(np.float32(x)) for x in rng.normal(size=6)], 0) for i in range(120)]
    rows += [("a", 200 + i, f"s{i % 2}", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(40)]  # copies held by many
    rows += [("a", 5, f"t{i:02}", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(14)]  # and often by one
    rows += [("a", 210, f"u{i:02}", [1.0, 0.001 * i, 0.0, 0.0, 0.0, 0.0], 0) for i in range(1, 13)]  # one owner of copies holds much that is near
    rows += [("b", i, "s", [float(i + 1), 1.0], 0) for i in range(4)] + rows[:10]
    rows += [("a", 300, "s", None, 0), ("a", 301, "s", [], 0), ("a", 302, "s", [0.0] * 6, 0), ("a", 303, "s", [float("nan")] * 6, 0), ("a", 304, "s", [None, 1.0], 0), ("a", None, "s", [1.0], 0), ("a", 305, "s", [math.inf], 0), ("a", 306, "s", [0.5, 0.5], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = ranked(nearest(df, k))
    assert got == brute_neighbours(rows, k)
    pairs = {(kind, *min((p, s), x), *max((p, s), x)) for (kind, p, s), near in got.items() for x in near}
    assert {tuple(r) for r in similar_pairs(df, k).collect()} == pairs
    assert similar_pairs(df.limit(0), k).count() == 0


def test_recall_where_a_tenth_is_visited(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 30_000)] + rng.normal(size=(30_000, 16)) * 0.6).astype(np.float32)
    df = spark.createDataFrame([("a", i, "s", v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    got = {(r["player_id"], r["other_id"]) for r in nearest(df, 5, group_probes=3, list_probes=14).collect()}
    assert 3 / S.groups_of(30_000) * 14 / (S.GROUP_ROWS / S.LIST_ROWS) < 0.1
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    asked = np.arange(0, 30_000, 50)
    similar = unit[asked] @ unit.T
    similar[np.arange(len(asked)), asked] = -2
    true = np.argsort(-similar, axis=1)[:, :5]
    recall = np.mean([(int(a), int(t)) in got for a, row in zip(asked, true) for t in row])
    assert recall >= 0.9, recall


def test_blocks_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    rng = np.random.default_rng(8)
    rows = [("a", i % 90, f"s{i}", [float(np.float32(x)) for x in rng.normal(size=5)], 0) for i in range(350)]
    assert ranked(nearest(spark.createDataFrame(rows, VECTORS))) == brute_neighbours(rows)


DOCS = "doc_id bigint, text string, source string, tokens int, copy int"
TARGETS = "source string, target_share double, max_repeats int"


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["", None, "Le joueur gagne ses duels.", "<|endoftext|>", "a" * 20_000, "é ñ ß 🙂\n\n x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.orderBy("i").select(token_counts(F.col("t")).alias("n")).collect()]
    assert got == [len(tokenizer(TOKENIZER).encode_ordinary(t)) if t else 0 for t in texts]


def test_mix(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60))), rng.choice(["Big One", "big_one", "BIG-ONE "]) if i < 400 else ("small" if i < 440 else ("tiny" if i < 445 else "other")), 1, 1) for i in range(460)]
    docs += [(1000, None, "small", 1, 1), (1001, "", None, 1, 1)]
    documents = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big_one", 0.6, 1), ("small", 0.3, 4), ("tiny", 0.05, 2), ("absent", 0.05, 9)], TARGETS)
    sized = sized_documents(documents, targets).cache()
    planned = {p.source: p for p in plan(sized, targets)}
    assert [s for s, p in planned.items() if not p.reachable] == ["tiny", "absent"]
    taken = mix(sized, list(planned.values()), block_documents=50).collect()
    total = sum(r["tokens"] for r in taken)
    for s, p in planned.items():
        rows = [r for r in taken if r["source"] == s]
        assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
        assert all(r["copy"] < p.max_repeats for r in rows)
        assert p.budget - 200 <= sum(r["tokens"] for r in rows) <= p.budget
        assert p.exhausted == (s in ("tiny", "absent"))
        for c in {r["copy"] for r in rows}:  # blocks and places are numbered without gaps, each block read in one piece
            blocks = {}
            for r in rows:
                if r["copy"] == c:
                    blocks.setdefault((r["block"], r["shuffle"]), []).append(r["position"])
            assert sorted(b for b, _ in blocks) == list(range(len(blocks))) and all(sorted(x) == list(range(len(x))) for x in blocks.values())
            assert [b for b, _ in sorted(blocks)] == [b for b, _ in sorted(blocks, key=lambda b: b[1])]
    order = {c: [r["doc_id"] for r in sorted((r for r in taken if r["source"] == "small" and r["copy"] == c), key=lambda r: (r["shuffle"], r["position"]))] for c in (0, 1)}
    assert set(order[0]) == set(order[1]) and order[0] != order[1] != sorted(order[1])  # whole copies are permuted, each in its way
    assert sum(r["tokens"] for r in taken if r["source"] == "small") / total == pytest.approx(0.3, abs=0.06)
    again = mix(sized, list(planned.values()), block_documents=50)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, taken))
    assert {(r["doc_id"], r["copy"]) for r in mix(sized, list(planned.values()), seed=5, block_documents=50).collect()} != {(r["doc_id"], r["copy"]) for r in taken}
    assert {(p.reachable, p.budget) for p in plan(sized.limit(0), targets)} == {(True, 0.0)}
    assert mix(sized.limit(0), plan(sized.limit(0), targets)).count() == 0
    assert plan(sized, targets.limit(0)) == []


def test_plan_keeps_the_limits_of_sources_that_others_push(spark):
    sized = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate([("a", 100), ("b", 300), ("c", 600)])], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.8, 2), ("b", 0.15, 1), ("c", 0.05, 9)], TARGETS)
    p = {x.source: x for x in plan(sized, targets)}
    assert (p["a"].budget, p["a"].reachable) == (200.0, False)  # used up
    assert p["b"].budget == pytest.approx(300, abs=1e-6) and p["b"].reachable and p["c"].budget == pytest.approx(500, abs=1e-6)
    assert sum(x.budget for x in p.values()) == pytest.approx(1000)
