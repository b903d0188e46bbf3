"""Variant spellings of names typed by people.

Tokens are compared by the ratio of their longest common subsequence, after a light phonetic rewriting; initials, nicknames
learned from resolved aliases, split and joined tokens and reordered parts are understood. Candidates come from suffix
blocking: suffixes of tokens (and of reversed tokens, that is prefixes) from half a token to the whole are indexed, and a
key that is too common is kept only together with another part of the name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.text import words
from turfline.session import cut, shuffled

# Particles of surnames, and marks of generation, which tell no persons apart here.
PARTICLES = frozenset("al ben bin da de del della den der di do dos du el la le ten ter van von filho ii iii jr junior neto sr".split())
# Common nicknames and the given names they stand for.
NICKNAMES = {
    "alex": "alexander", "bart": "bartholomew", "ben": "benjamin", "benji": "benjamin", "beto": "roberto", "bob": "robert", "dani": "daniel",
    "danny": "daniel", "dima": "dmitri", "duda": "eduardo", "edu": "eduardo", "fede": "federico", "fran": "francisco", "fred": "frederic",
    "gabi": "gabriel", "gianni": "giovanni", "guille": "guillermo", "ibra": "ibrahim", "jacky": "jacques", "joe": "joseph", "jon": "jonathan",
    "jonny": "jonathan", "kostya": "konstantin", "leo": "leonardo", "manolo": "manuel", "manu": "manuel", "matt": "matthew", "max": "maximilian",
    "memo": "guillermo", "mike": "michael", "momo": "mohamed", "nacho": "ignacio", "nando": "fernando", "nat": "nathaniel", "nico": "nicolas",
    "nino": "giovanni", "olly": "oliver", "paco": "francisco", "pepe": "jose", "quino": "joaquin", "rafa": "rafael", "ricky": "ricardo",
    "rob": "robert", "rodri": "rodrigo", "salva": "salvador", "santi": "santiago", "sasha": "aleksander", "seba": "sebastian", "theo": "theodore",
    "tom": "thomas", "tonho": "antonio", "tony": "anthony", "vinny": "vincent", "will": "william", "ze": "jose",
}
# Spellings of one sound, in the order they are rewritten.
SOUNDS = (("ph", "f"), ("qu", "k"), ("ck", "k"), ("c", "k"), ("w", "v"), ("z", "s"), ("y", "i"), ("j", "i"), ("x", "ks"))

#: A key held by more index names than this is kept only with an outer part, beyond the second number with the class or half, of another token.
COMMON, VERY_COMMON = 5, 60
#: A text of more words is no name: it agrees with those of the very same words, in any order, and has one key for them.
MOST_TOKENS = 15
#: Share of the letters before the common ending in which two forms of a surname may differ, and what more costs.
STEM, UNLIKE = 0.34, 0.06
#: Ratios from which a surname and another token agree, and the score from which names do.
SURNAME, TOKEN, ACCEPT = 0.78, 0.74, 0.86


@lru_cache(50_000)
def sound(token: str) -> str:
    """Spelling by sound, doubled letters once."""
    for a, b in SOUNDS:
        token = token.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", token)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@lru_cache(100_000)
def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence by the sum of lengths: the better of letters and sounds."""
    if a == b:
        return 1.0
    plain = 2 * lcs_length(a, b) / (len(a) + len(b))
    if plain < 0.5:
        return plain
    x, y = sound(a), sound(b)
    return max(plain, 0.99 * 2 * lcs_length(x, y) / (len(x) + len(y)))


@lru_cache(100_000)
def letters(token: str) -> tuple[int, int, int, int]:
    """Set of letters and length of a token as typed and by sound."""
    sounds = sound(token)
    bits = lambda t: sum({1 << (ord(c) % 61) for c in t})
    return bits(token), len(token), bits(sounds), len(sounds)


def may_agree(a: str, b: str, least: float) -> bool:
    """Whether the ratio of two tokens can reach ``least``: letters that only one of them has are in no common subsequence."""
    x, n, xs, ns = letters(a)
    y, m, ys, ms = letters(b)
    if 2 * min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count()) >= least * (n + m):
        return True
    return 2 * min(ns - (xs & ~ys).bit_count(), ms - (ys & ~xs).bit_count()) >= least * (ns + ms)


def unlike_stems(a: str, b: str) -> bool:
    """Whether two tokens differ in two or more of the few letters before their common ending: alike by a usual suffix only."""
    x, y = sound(a), sound(b)
    n = 0
    while n < min(len(x), len(y)) and x[-1 - n] == y[-1 - n]:
        n += 1
    x, y = x[: len(x) - n], y[: len(y) - n]
    longer = max(len(x), len(y))
    apart = longer - lcs_length(x, y)
    return apart >= 2 and apart > STEM * longer


class Names:
    """Compares names as lists of tokens; ``short`` maps nicknames to the names they stand for."""

    def __init__(self, short: Mapping[str, Iterable[str]] = {}):
        self.of: dict[str, set[str]] = defaultdict(set)
        for nick, full in [*NICKNAMES.items(), *((n, f) for n, fs in short.items() for f in fs)]:
            self.of[nick].add(full)
            self.of[full].add(nick)
        self.classes: dict[str, str] = {}
        for token in sorted(self.of):
            if token not in self.classes:
                todo = [token]
                while todo:
                    t = todo.pop()
                    if t not in self.classes:
                        self.classes[t] = token
                        todo += self.of[t]
        self._alike = lru_cache(100_000)(self._compare)

    def class_of(self, token: str) -> str:
        return self.classes.get(token, token)

    def _compare(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        if len(a) == 1 or len(b) == 1:
            return 0.85 if a[0] == b[0] else 0.0
        if b in self.of.get(a, ()):
            return 0.98
        ratio = lcs_ratio(a, b)
        if ratio < TOKEN:  # a nickname with a slip of the pen
            near = max((lcs_ratio(n, b) for n in self.of.get(a, ()) if abs(len(n) - len(b)) < 3), default=0.0)
            near = max(near, max((lcs_ratio(a, n) for n in self.of.get(b, ()) if abs(len(n) - len(a)) < 3), default=0.0))
            return 0.9 * near if near >= 0.85 else ratio
        return ratio

    def _aligned(self, a: list[str], b: list[str]) -> tuple[list[tuple[float, str, str]], list[str], list[str]]:
        pairs = sorted(((self._alike(x, y), -len(x) - len(y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda p: (-p[0], p[1], p[2], p[3]))
        free_a, free_b = set(range(len(a))), set(range(len(b)))
        found = []
        for s, _, i, j in pairs:
            if s < TOKEN:
                break
            if i in free_a and j in free_b:
                free_a.discard(i)
                free_b.discard(j)
                found.append((s, a[i], b[j]))
        rest_a, rest_b = [a[i] for i in sorted(free_a)], [b[j] for j in sorted(free_b)]
        for one, other in ((rest_a, rest_b), (rest_b, rest_a)):  # "jm" for "jean marc"
            for token in [t for t in one if len(t) == 2]:
                hit = next((k for k in range(len(other) - 1) if len(other[k]) > 1 and token == other[k][0] + other[k + 1][0]), None)
                if hit is not None:
                    found.append((0.85, token, other[hit]))
                    one.remove(token)
                    del other[hit : hit + 2]
        return found, rest_a, rest_b

    def _score(self, a: list[str], b: list[str]) -> float:
        found, rest_a, rest_b = self._aligned(a, b)
        if len(found) < 2:
            return 0.0
        real_a, real_b = [t for t in rest_a if t not in PARTICLES], [t for t in rest_b if t not in PARTICLES]
        # each has a part that the other lacks: one name alone doesn't decide then
        apart = 0.18 if real_a and real_b else 0.0
        whole = [p for p in found if len(p[1]) >= 4 and len(p[2]) >= 4]
        names = [p for p in whole if p[1] not in self.classes and p[2] not in self.classes] or whole
        if not names:
            return 0.0
        surname = max(names, key=lambda p: (len(p[1]) + len(p[2]), p[0]))
        if surname[0] < SURNAME or any(len(t) > max(len(surname[1]), len(surname[2])) for t in real_a + real_b):
            return 0.0  # the longest part of either name stands alone
        others = [p for p in found if p is not surname and not (p[1] in PARTICLES and p[2] in PARTICLES)]
        if not others:
            return 0.0
        given = sum(p[0] for p in others) / len(others)
        apart += UNLIKE if unlike_stems(surname[1], surname[2]) else 0.0
        loose = len(rest_a) + len(rest_b) - len(real_a) - len(real_b)
        return 0.65 * surname[0] + 0.35 * given - 0.02 * (len(real_a) + len(real_b)) - 0.005 * loose - apart

    def _hope(self, x: list[str], y: list[str]) -> bool:
        """Whether ``_score`` can be above 0: some pair that agrees must be as long as the longest part of both names, which
        stands alone otherwise. Nicknames may agree with misspelt names that they stand for, whatever their letters."""
        longest = max((len(t) for t in (*x, *y) if t not in PARTICLES), default=0)
        for s in x:
            for t in y:
                if max(len(s), len(t)) >= longest and (len(s) == 1 or len(t) == 1 or s in self.of or t in self.of or may_agree(s, t, TOKEN)) and self._alike(s, t) >= TOKEN:
                    return True
        # two letters may stand for two parts, however long
        return any(len(t) == 2 and {*t} <= {o[0] for o in other} for one, other in ((x, y), (y, x)) for t in one)

    def score(self, a: str, b: str) -> float:
        """Agreement of two names, 0 to 1; tokens are separated by spaces. Empty names agree with none, and texts of more than
        ``MOST_TOKENS`` words only with those of the same words."""
        x, y = a.split(), b.split()
        if not x or not y:
            return 0.0
        if len(x) == len(y) > 1 and sorted(x) == sorted(y):
            return 1.0
        if max(len(x), len(y)) > MOST_TOKENS:
            return 0.0
        best = self._score(x, y) if self._hope(x, y) else 0.0
        if best < 0.93:  # a token may be split in two, or two joined
            for one, other in ((x, y), (y, x)):
                for i in range(len(one) - 1):
                    joined = one[i] + one[i + 1]
                    if any(abs(len(joined) - len(t)) < 4 and may_agree(joined, t, SURNAME) and lcs_ratio(joined, t) >= SURNAME for t in other):
                        best = max(best, self._score([*one[:i], joined, *one[i + 2 :]], other) - 0.02)
        return best

    def keys(self, name: str) -> list[tuple[str, list[str]]]:
        """Blocking keys of a name, each with the classes of its other tokens."""
        tokens = name.split()
        if len(tokens) > MOST_TOKENS:
            return [("#" + " ".join(sorted(tokens)), ["#"])]  # shared by all, so that it refines nothing away
        spans = [(i, i + 1, t) for i, t in enumerate(tokens)] + [(i, i + 2, tokens[i] + tokens[i + 1]) for i in range(len(tokens) - 1)]
        out: dict[str, set[str]] = defaultdict(set)
        for i, j, token in spans:
            rest = [t for k, t in enumerate(tokens) if not i <= k < j and (t not in PARTICLES or t in self.classes)]
            others = {self.class_of(t) for t in rest} | {t[0] for t in rest if t in self.classes}  # a nickname also goes by its own initial
            size = len(token)
            if size < 4 or token in self.classes or not others:
                continue
            s = sound(token)
            for n in range(max(3, len(s) // 2), len(s) + 1):  # the longer ones refine those that are common
                out["<" + s[:n]] |= others
                out[">" + s[-n:]] |= others
            if j == i + 1 and size >= 5:
                for o in others:
                    if len(o) > 1:
                        out[f"={o} {s[0]}{s[-3:]}"] |= others
        return [(k, sorted(v)) for k, v in out.items()]


def name_key(column: str) -> Column:
    """Folded words of a name, separated by one space."""
    return F.array_join(words(F.col(column)), " ")


def learned_nicknames(aliases: DataFrame, players: DataFrame, support: int = 3, most: int = 20_000) -> dict[str, list[str]]:
    """Pairs of given names that stand for each other, from resolved aliases: the only tokens in which two names differ,
    seen ``support`` times, unlike by letters, the more frequent name being the full one. At most ``most`` pairs, the most
    frequent, are fitted."""
    pair = aliases.filter("player_id is not null").select("player_id", words(F.col("raw_name")).alias("a"))
    pair = pair.join(shuffled(players.select("player_id", words(F.col("full_name")).alias("b"))), "player_id")
    pair = pair.select(F.array_except("a", "b").alias("x"), F.array_except("b", "a").alias("y"), F.arrays_overlap("a", "b").alias("o"))
    pair = pair.filter("o and size(x) = 1 and size(y) = 1").select(F.col("x")[0].alias("x"), F.col("y")[0].alias("y"))
    pair = pair.filter((F.length("x") > 1) & (F.length("y") > 1)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    counts = pair.groupBy("x", "y").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    out: dict[str, list[str]] = defaultdict(list)
    for r in counts.orderBy(F.desc("n"), "x", "y").limit(most).collect():
        if lcs_ratio(r["x"], r["y"]) < TOKEN and r["x"] not in PARTICLES - NICKNAMES.keys() and r["y"] not in PARTICLES - NICKNAMES.keys():
            out[r["x"]].append(r["y"])
    return dict(out)


def keyed(names: DataFrame, short: Mapping[str, Iterable[str]]) -> DataFrame:
    """``name``, ``key`` and ``others`` (classes of the other tokens) of distinct names."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compared = Names(short)
        for batch in batches:
            yield pd.DataFrame([(n, k, o) for n in batch["name"] for k, o in compared.keys(n)], columns=["name", "key", "others"])

    return names.select("name").mapInPandas(each, "name string, key string, others array<string>")


def refining(level: int, asked: bool) -> Column:
    """Parts of the other tokens by which a common key is refined: names agree if they share one.

    Level 1 takes the initial and the last two letters of a class; level 2 the class and its halves, and lets an initial
    of either side stand for every class it begins on the other.
    """

    def of(o: Column) -> Column:
        first, size = F.substring(o, 1, 1), F.length(o)
        if level == 1:
            return F.array(first, F.concat(F.lit(">"), F.right(o, F.lit(2))))
        mine, its = ("?", "!") if asked else ("!", "?")
        halves = F.filter(F.array(F.floor(size / 2), F.floor(size / 2) + 1), lambda n: n >= 3)
        pieces = F.transform(halves, lambda n: F.array(F.concat(F.lit("<"), F.left(o, n)), F.concat(F.lit(">"), F.right(o, n))))
        whole = F.concat(F.array(F.concat(F.lit("="), o), F.concat(F.lit(its), first)), F.flatten(pieces))
        return F.when(size == 1, F.array(F.concat(F.lit("="), o), F.concat(F.lit(mine), o))).otherwise(whole)

    return F.array_distinct(F.flatten(F.transform("others", of)))


def paired(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``ask``, ``name``, ``kind`` of key and ``held``, the index names of the key, for every key that two ``keyed`` names share.

    A key held by few index names pairs by itself; a more common one only where another token's initial or ending, and a
    very common one where another token's class, half or initial agrees too (``refining``). Of a pair dropped there, a longer
    part of the token may still agree, which is another key.
    """
    left, right = asked, index
    out = None
    for level, most in enumerate((COMMON, VERY_COMMON, None)):
        if level:
            base = F.col("key") if level == 1 else F.regexp_replace("key", r"\|[^|]*$", "")
            left, right = (
                side.select("name", "others", base.alias("base")).distinct().select("name", "others", "base", F.explode(refining(level, side is left)).alias("part"))
                .select("name", "others", F.concat_ws("|", "base", "part").alias("key"))
                for side in (left, right)
            )
            left, right = left.distinct(), right.distinct()
        held = right.groupBy("key").agg(F.count("*").alias("held"))
        few = held if most is None else held.filter(F.col("held") <= most)
        pairs = left.join(shuffled(right.join(shuffled(few), "key").select("key", "held", F.col("name").alias("found"))), "key")
        pairs = pairs.select(F.col("name").alias("ask"), F.col("found").alias("name"), F.left("key", F.lit(1)).alias("kind"), "held")
        out = pairs if out is None else out.unionByName(pairs)
        if most is not None:
            many = shuffled(held.filter(F.col("held") > most).select("key"))
            left, right = left.join(many, "key", "left_semi"), right.join(many, "key", "left_semi")
    return out


def candidates(asked: DataFrame, index: DataFrame, short: Mapping[str, Iterable[str]]) -> DataFrame:
    """Pairs ``ask``, ``name`` of names that share a blocking key; both inputs have one column ``name`` of distinct names."""
    # keys are made in Python: kept, so that every level reads them and none makes them again
    return paired(cut(keyed(asked, short)), cut(keyed(index, short))).select("ask", "name").distinct()


def scored(pairs: DataFrame, short: Mapping[str, Iterable[str]], least: float = ACCEPT) -> DataFrame:
    """``ask``, ``name`` and ``score`` of the pairs that agree."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(short)
        for batch in batches:
            batch["score"] = [names.score(a, b) for a, b in zip(batch["ask"], batch["name"], strict=True)]
            yield batch[batch["score"] >= least]

    return pairs.mapInPandas(compare, "ask string, name string, score double")


def linked_aliases(aliases: DataFrame, players: DataFrame, groups: DataFrame) -> DataFrame:
    """``alias_id``, ``player_id`` and ``confidence`` of unresolved aliases and the players rows whose person they spell.

    ``groups`` gives the person (``component``) of players rows (``node``); a row without one is a person by itself. An
    alias goes to every person whose names agree best with it, provided they agree; persons of one name all count. Null
    and empty names, and aliases no name agrees with, give no row; a repeated spelling is compared once and given to each
    of its aliases.
    """
    short = learned_nicknames(aliases, players)
    asked = aliases.filter("player_id is null").select("alias_id", name_key("raw_name").alias("ask")).filter("ask <> ''").distinct()
    persons = players.select("player_id", name_key("full_name").alias("name")).join(shuffled(groups), F.col("player_id") == F.col("node"), "left")
    persons = persons.select("player_id", "name", F.coalesce("component", "player_id").alias("person"))
    pairs = candidates(asked.select(F.col("ask").alias("name")).distinct(), persons.select("name").filter("name <> ''").distinct(), short)
    near = scored(pairs, short)
    best = near.withColumn("r", F.rank().over(Window.partitionBy("ask").orderBy(F.desc(F.round("score", 6))))).filter("r = 1")
    found = best.join(shuffled(persons.select("name", "person").distinct()), "name").groupBy("ask", "person").agg(F.max("score").alias("confidence"))
    rows = found.join(shuffled(persons.select("person", "player_id").distinct()), "person")
    return asked.join(shuffled(rows), "ask").select("alias_id", "player_id", F.round("confidence", 3).alias("confidence"))
