import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from turfline.functions.text import normalize_name
from turfline.operators import identity

NAMES = ["oskar", "brandeliu", "mirela", "tamsin", "quaye", "de", "la", "vorn", "ilse", "ödegren", "o'shay", "fernhollow", "x"]
QUERIES = "query_id int, raw_name string, birth_date date, nationality array<string>, player_id string"
PLAYERS = "player_id int, normalized_name string, birth_date date, nationality array<string>, query_id string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def like(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    p, q = (" ".join(sorted(s)) for s in (x - y, y - x))
    if shared and (not p or not q):
        return 1.0
    whole = [f"{shared} {r}".strip() for r in (p, q)]
    return max(like(*whole), *(like(shared, w) for w in whole)) if shared else like(*whole)


def pair_score(q, c):
    if q[2] and c[2] and q[2] != c[2]:
        return 0.0
    mine, its = ({n for n in x[3] or () if n is not None} for x in (q, c))
    apart = mine and its and not mine & its
    return token_set(q[1] or "", c[1] or "") * (0.5 if apart else 1.0)


def drawn(rng, n):
    def name():
        text = " ".join(rng.choices(NAMES, k=rng.randint(0, 4)))
        if rng.random() < 0.5 and text:
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice("abcd ") + text[i + 1 :]
        return None if rng.random() < 0.03 else text * (40 if rng.random() < 0.03 else 1)

    return [(i, name(), rng.choice([None, date(1990, 1, 1), date(1991, 1, 1)]), rng.choice([None, [], ["a"], ["b"], ["a", "c"], [None]]), "clash") for i in range(n)]


def test_best_of_all_candidates_against_brute_force(spark, monkeypatch):
    for name, value in (("ROW_BLOCK", 60), ("QUERY_BLOCK", 30), ("SMALL_BLOCK", 20)):  # several blocks of both sides
        monkeypatch.setattr(f"turfline.operators.blocks.{name}", value)
    rng = random.Random(8)
    asked, known = drawn(rng, 90), drawn(rng, 200)
    q, c = spark.createDataFrame([*asked, (None, "oskar", None, None, "")], QUERIES), spark.createDataFrame([*known, (None, "oskar", None, None, "")], PLAYERS)
    plain = {r["query_id"]: r["n"] for r in q.select("query_id", normalize_name(F.col("raw_name")).alias("n")).collect()}
    got = {}
    for r in identity.top_candidates(q, c).orderBy("place").collect():
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["player_id"]))
    for a in asked:
        expected = sorted((-round(pair_score((a[0], plain[a[0]], a[2], a[3]), p), 9), p[0]) for p in known)[:5]
        assert got[a[0]] == [(-s, p) for s, p in expected], a
    assert len(got) == len(asked)
    assert identity.top_candidates(q.limit(0), c).count() == identity.top_candidates(q, c.limit(0)).count() == 0


def test_the_expression_scores_alike(spark):
    rng = random.Random(9)
    pairs = [(a[1], b[1]) for a, b in zip(drawn(rng, 150), drawn(rng, 150), strict=True) if a[1] is not None and b[1] is not None]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("a", "b", identity.token_set_ratio(F.col("a"), F.col("b")).alias("s"), identity.lcs(F.col("a"), F.col("b")).alias("n")).collect():
        assert r["s"] == pytest.approx(token_set(r["a"], r["b"]), abs=1e-12) and r["n"] == lcs(r["a"], r["b"])


KNOWN = [(1, "oskar brandeliu fernhollow", date(1994, 4, 4), ["Norway"], ""), (2, "mirela de la vorn", date(1988, 8, 8), ["Chile"], ""), (3, "tamsin quaye", None, ["Ghana"], "")]


@pytest.mark.parametrize(
    ("raw", "born", "nations", "outcome", "player", "score"),
    [
        ("Oskar Brandeliu Fernhollow", date(1994, 4, 4), None, "auto_resolved", 1, 1.0), ("Mirela Vorn", None, None, "auto_resolved", 2, 1.0), ("Tamsin   Quaye", None, None, "auto_resolved", 3, 1.0),
        ("T. Quaye", None, None, "needs_review", None, None), ("Zbigniew Holcomb", None, None, "new", None, None), ("Oskar Brandeliu Fernhollow", date(1990, 1, 1), None, "new", None, None),
        ("", None, None, "new", None, None), (None, None, None, "new", None, None), ("Oskra Bradneliu Fernholow", None, None, "needs_review", None, None), ("Tamsin Quaye", None, ["Peru"], "new", None, None),
    ],
)
def test_outcomes(spark, raw, born, nations, outcome, player, score):
    q = spark.createDataFrame([(9, raw, born, nations, "")], QUERIES)
    r = identity.outcomes(q, identity.top_candidates(q, spark.createDataFrame(KNOWN, PLAYERS))).first()
    assert (r["outcome"], r["player_id"], r["confidence"]) == (outcome, player, score)
    assert [c["score"] for c in r["candidates"]] == sorted((c["score"] for c in r["candidates"]), reverse=True) and len(r["candidates"]) == 3


def test_no_candidates_at_all(spark):
    q = spark.createDataFrame([(1,)], "query_id int")
    top = spark.createDataFrame([], "query_id int, player_id int, score double, place int")
    assert identity.outcomes(q, top).first().asDict() == {"query_id": 1, "outcome": "new", "player_id": None, "confidence": None, "candidates": []}


def test_similar_names_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("turfline.operators.blocks.ROW_BLOCK", 50)
    rng = random.Random(10)
    rows = [(i, n) for i, n, *_ in drawn(rng, 160)]
    df = spark.createDataFrame(rows, "player_id int, n string")

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in (name or "").lower()).split() for i in range(len(w) + 1)}

    got = {}
    for r in sorted(identity.similar_names(df, df.filter("player_id % 40 = 0"), "player_id", "n", 7).collect(), key=lambda r: r["place"]):
        got.setdefault(r["query_id"], []).append((round(r["similarity"], 9), r["player_id"]))
    for i in range(0, 160, 40):
        mine = grams(rows[i][1])
        score = lambda t, mine=mine: len(mine & t) / len(mine | t) if mine | t else 0.0
        assert got[i] == [(-s, p) for s, p in sorted((-round(score(grams(n)), 9), p) for p, n in rows)[:7]]
