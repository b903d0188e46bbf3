import random
import re
import unicodedata

import pytest

from turfline.llm.leakage import decontaminate, leaked_spans, leaks
from turfline.llm.truncation import common_signatures, ending, kinds, lengths, repaired, truncated

DOCS = "doc_id bigint, text string, source string, at int, key string, item_id int"
ITEMS = "item_id int, text string, w string"
ITEM = "Question 7. When Ostrava trades a cadence for ninety rebounds, which cadence is left with Brunél Straße?"


def plain(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text)


def brute(docs, items, n=10):
    out = set()
    for d, t, *_ in docs:
        for i, s, _ in items:
            if t and s and d is not None and i is not None:
                w, v = plain(t), plain(s)
                grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
                if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                    out.add((d, i))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choices("the team held out and then faded on transitions".split(), k=n))
    piece = " ".join(ITEM.split()[2:13])
    docs = [
        (1, f"{filler(20)}. {ITEM} {filler(9)}.", "a", 0, "k", 9), (2, f"{filler(5)} {piece.upper()} {filler(5)}", "a", 0, "k", 9), (3, " ".join(ITEM.split()[3:12]), "a", 0, "k", 9),
        (4, unicodedata.normalize("NFD", ITEM.replace(" ", "  \n")), "a", 0, "k", 9), (5, None, "a", 0, "k", 9), (6, "", "a", 0, "k", 9), (None, ITEM, "a", 0, "k", 9),
        (7, filler(60_000) + " " + ITEM, "a", 0, "k", 9), (1, f"{filler(20)}. {ITEM} {filler(9)}.", "a", 0, "k", 9), (8, filler(40), "a", 0, "k", 9),
    ]
    items = [(70, ITEM, "w"), (71, "too short to have ten words", "w"), (72, None, "w"), (None, ITEM, "w"), (73, ITEM + " And more.", "w")]
    return docs, items, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)


def test_leaks_against_brute_force(corpus):
    docs, items, d, i = corpus
    found = {(r["doc_id"], r["item_id"]) for r in leaks(d, i).collect()}
    assert found == brute(docs, items) and (7, 70) in found
    assert leaks(d.limit(0), i).count() == leaks(d, i.limit(0)).count() == 0


def test_leaks_without_broadcast(corpus, monkeypatch):
    monkeypatch.setattr("turfline.llm.leakage.BROADCAST_GRAMS", 0)
    docs, items, d, i = corpus
    assert {(r["doc_id"], r["item_id"]) for r in leaks(d, i).collect()} == brute(docs, items)


def test_spans_and_removal(corpus):
    docs, items, d, i = corpus
    span = {(r["doc_id"], r["item_id"]): r for r in leaked_spans(d, i).collect()}[2, 70]
    assert (span["first_word"], span["last_word"], span["item_first"], span["run_words"], span["item_length"]) == (5, 15, 2, 11, len(plain(ITEM)))
    once = d.filter("doc_id is not null").dropDuplicates(["doc_id"])
    clean = {r["doc_id"]: r["text"] for r in decontaminate(once, i).collect()}
    assert not brute([(k, t) for k, t in clean.items()], items) and clean[8] == next(t for k, t, *_ in docs if k == 8)
    assert plain(clean[2]) == plain(docs[1][1])[:5] + plain(docs[1][1])[-5:]
    assert {r["doc_id"] for r in decontaminate(once, i, whole=True).collect()} == {3, 5, 6, 8}
    assert decontaminate(once.limit(0), i).count() == 0 and decontaminate(once, i.limit(0)).count() == once.count()


def test_removal_without_broadcast(corpus, monkeypatch):
    docs, items, d, i = corpus
    once = d.filter("doc_id is not null").dropDuplicates(["doc_id"])
    wide = [sorted(map(tuple, decontaminate(once, i, whole=w).collect()), key=str) for w in (False, True)]
    monkeypatch.setattr("turfline.llm.leakage.BROADCAST_GRAMS", 0)
    assert [sorted(map(tuple, decontaminate(once, i, whole=w).collect()), key=str) for w in (False, True)] == wide


def test_passages_apart_are_runs_of_their_own(spark):
    item = " ".join(f"w{k}" for k in range(40))
    gap = " ".join(["filler"] * 300)
    text = f"{' '.join(item.split()[:12])} {gap} {' '.join(item.split()[20:32])} end {' '.join(item.split()[:12])}"
    found = leaked_spans(spark.createDataFrame([(1, text, "a", 0, "k", 0)], DOCS), spark.createDataFrame([(5, item, "")], ITEMS))
    assert sorted((r["first_word"], r["last_word"], r["item_first"], r["run_words"]) for r in found.collect()) == [(0, 11, 0, 12), (312, 323, 20, 12), (325, 336, 0, 12)]


def test_endings():
    state = lambda t: ending(t, frozenset({"Desk north"}))[0]
    assert [state(t) for t in ("It ended.", "It ended!", "«It ended»", "It ended (really).", "It ended.\nDesk north", "It ended\n-- The club", "It ended. #news", "It ended :)")] == ["closed"] * 8
    assert [state(t) for t in ("It was", "In minute 3.")] == ["open"] * 2
    assert [state(t) for t in ("It was...", "It was …")] == ["ellipsis"] * 2
    assert [state(t) for t in ("It was,", "caf&eac", "caf&", "caf�", "a <b", "Next:")] == ["broken"] * 6
    assert [state(t) for t in ("", "   ")] == ["none"] * 2
    assert state("." * 100_000) == "ellipsis" and state(" " * 100_000 + "x") == "open"


def test_repair_and_lengths():
    assert repaired("caf&eacute; Ã©tÃ© <b>x</b>") == "café été  x "
    assert repaired("Âme Åse") == "Âme Åse"
    assert lengths('é"\n') == [3, 4, 3, 8, 5, 10, 4, 5]
    assert kinds("In minute 3, Ana ran. Bob")[0] == ["in", "minute", "0", "N", "ran", "bob"]


def test_limits_and_cuts(spark):
    rng = random.Random(2)
    subject, verb, rest = ["the team", "our captain", "a young keeper", "the coach"], ["held out", "ran quickly", "passed well", "waited"], ["on the left wing", "after the break", "in heavy rain", "against ten men"]
    sentence = lambda: f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(rest)}.".capitalize()
    text = lambda n: " ".join(sentence() for _ in range(n))
    docs, cut = [], set()
    for i in range(900):
        source, t = ("Wire", "wire ", "post")[i % 3], text(rng.randint(2, 14))
        if source != "post" and len(t) > 300:
            t = t[:300]
            if not t.rstrip().endswith("."):
                cut.add(i)
        elif i % 50 == 2:
            t = t[: rng.randint(30, len(t) - 15)].rstrip(" .")
            words = t.split()[-2:]
            if not any(x.endswith(" ".join(words)) for x in rest):
                cut.add(i)
        elif i % 10 == 4:
            t = t[:-1] + rng.choice(["", "...", "…"])  # whole, without closing mark
        docs.append((i, t, source, 0, "k", 0))
    docs += [(2000, None, "post", 0, "k", 0), (2001, "", "post", 0, "k", 0), (2002, text(5_000), "post", 0, "k", 0), (None, "It was the", "post", 0, "k", 0), (2003, "The team held out on the", None, 0, "k", 0), (2003, "The team held out on the", None, 0, "k", 0)]
    df = spark.createDataFrame(docs, DOCS)
    judged, found = truncated(df)
    assert {r["doc_id"] for r in judged.filter("cut").collect()} == cut | {2003}
    hard = {(r["source"], r["encoding"], r["high"]) for r in found.filter("hard").collect()}
    assert ("wire", 0, 300) in hard and not any(s == "post" for s, *_ in hard)
    nothing, none = truncated(df.limit(0))
    assert nothing.count() == none.count() == 0


def test_cuts_are_the_same_without_broadcasts(spark, monkeypatch):
    docs = [(i, f"The team ran for {i} minutes. It rested on the bench." + ("" if i % 7 else " Then the tea"), "ab"[i % 2], 0, "k", 0) for i in range(120)]
    docs += [(200 + i, f"The team sat for {i} minutes.\nDesk north", "a", 0, "k", 0) for i in range(9)]
    df = spark.createDataFrame(docs, DOCS)
    wide = sorted(map(tuple, truncated(df)[0].collect()))
    monkeypatch.setattr("turfline.llm.truncation.ASKED", 0)
    monkeypatch.setattr("turfline.llm.truncation.broadcast_if_small", lambda rows, most=0: rows)
    assert sorted(map(tuple, truncated(df)[0].collect())) == wide and {r[0] for r in wide if r[4]} == {i for i in range(120) if i % 7 == 0}


def test_cut_beginnings_are_no_signatures(spark):
    docs = [(i, f"The team ran for {i} minutes.\nThe coach adv", "post", 0, "k", 0) for i in range(6)]
    docs += [(100 + i, f"The team sat for {i} minutes.\nThe coach advised {i} of them.", "post", 0, "k", 0) for i in range(40)]
    docs += [(200 + i, f"The team won after {i} minutes.\nDesk north", "post", 0, "k", 0) for i in range(6)]
    docs += [(300 + i, "The team won at last.\nNobody kn", "post", 0, "k", 0) for i in range(6)]  # one text posted again
    df = spark.createDataFrame(docs, DOCS)
    assert [r["line"] for r in common_signatures(df).collect()] == ["Desk north"]
    assert common_signatures(df.limit(0)).count() == 0
    judged, _ = truncated(df)
    assert {r["doc_id"] for r in judged.filter("cut").collect()} == {*range(6), *range(300, 306)}
