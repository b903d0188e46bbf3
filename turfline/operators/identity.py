"""Identity resolution of named records against known players, with three outcomes and an auditable queue."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.functions.text import normalize_name
from turfline.operators.blocks import best_of, in_blocks, leading
from turfline.registry import AUTO_SCORE, NATIONALITY_PENALTY, REVIEW_SCORE

#: Longest name compared by machine words, and queries of a step of a block.
WORD, STEP = 64, 128


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, by rows of the dynamic programme inside the JVM."""
    columns = F.split(b, "")
    first = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(before: Column, letter: Column) -> Column:
        # the best of a prefix so far is carried along the row
        reach = F.zip_with(columns, F.sequence(F.lit(1), F.length(b)), lambda c, j: F.greatest(F.element_at(before, j + 1), F.element_at(before, j) + F.when(c == letter, 1).otherwise(0)))
        start = F.array(F.lit(0))
        return F.aggregate(reach, start, lambda done, v: F.concat(done, F.array(F.greatest(F.element_at(done, -1), v))))

    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.element_at(F.aggregate(F.split(a, ""), first, row), -1)).otherwise(F.lit(0))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Ratio of two names as sets of tokens, from 0 to 1: what they share, and how alike the rest is.

    An empty name gives 0; a name that holds all tokens of the other gives 1. It needs no UDF.
    """
    tokens = lambda x: F.array_sort(F.array_distinct(F.filter(F.split(x, r"[\s\p{Z}]+"), lambda t: t != "")))
    x, y = tokens(a), tokens(b)
    shared = F.array_join(F.array_intersect(x, y), " ")
    left, right = F.array_join(F.array_sort(F.array_except(x, y)), " "), F.array_join(F.array_sort(F.array_except(y, x)), " ")
    s, p, q = F.length(shared), F.length(left), F.length(right)
    gap = F.when(s > 0, 1).otherwise(0)
    rest = 1 - F.try_divide((p + q - 2 * lcs(left, right)).cast("double"), (2 * (s + gap) + p + q).cast("double"))
    one = lambda n: 1 - F.try_divide((gap + n).cast("double"), (2 * s + gap + n).cast("double"))
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0))
        .when((s > 0) & ((p == 0) | (q == 0)), F.lit(1.0))
        .when(s == 0, rest)
        .otherwise(F.greatest(rest, one(p), one(q)))
    )


def pair_score(name_score: Column, birth: Column, other_birth: Column, nations: Column, other_nations: Column) -> Column:
    """Score of a pair: 0 if both birth dates are known and differ; disjoint known nationalities halve it."""
    apart = (F.size(nations) > 0) & (F.size(other_nations) > 0) & ~F.coalesce(F.arrays_overlap(nations, other_nations), F.lit(False))
    penalty = F.when(F.coalesce(apart, F.lit(False)), NATIONALITY_PENALTY).otherwise(1.0)
    return F.when(F.coalesce(birth != other_birth, F.lit(False)), 0.0).otherwise(name_score * penalty)


class NameTable:
    """Names of a block as sets of tokens: the sorted tokens as one text, its length, and counts of its letters."""

    def __init__(self, names: Iterable[str]):
        self.tokens = [frozenset(n.split()) for n in names]
        self.texts = [" ".join(sorted(t)) for t in self.tokens]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.fits = (self.size > 0) & (self.size <= WORD) & np.array(["\0" not in t for t in self.texts], bool)
        # code points of the texts that fit a machine word, 0 behind their end
        self.codes = np.zeros((len(self.texts), WORD), np.uint32)
        for i in np.flatnonzero(self.fits):
            self.codes[i, : self.size[i]] = np.frombuffer(self.texts[i].encode("utf-32-le"), np.uint32)

    def unary(self, width: np.ndarray) -> np.ndarray:
        """Letter counts in unary, so that an inner product counts common letters; letters of one remainder count as one."""
        counts = self.counts()
        return np.concatenate([(counts[:, [b]] > np.arange(w)[None, :]) for b, w in enumerate(width) if w], axis=1).astype(np.float32)

    def counts(self) -> np.ndarray:
        out = np.zeros((len(self.texts), 64), np.int64)
        at = np.nonzero(self.codes)
        np.add.at(out, (at[0], self.codes[at] % 64), 1)
        return out


def word_lcs(a: NameTable, b: NameTable, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Longest common subsequences of pairs of texts that fit a machine word, all pairs advancing a letter at a time."""
    letters, code = np.unique(np.concatenate([a.codes[np.unique(x)].ravel(), [0]]), return_inverse=True)
    rows, of = np.unique(x, return_inverse=True)
    masks = np.zeros((len(rows), len(letters) + 1), np.uint64)  # the last column is for letters of the other side only
    spelt = code[:-1].reshape(len(rows), WORD)
    for j in range(WORD):
        masks[np.arange(len(rows)), spelt[:, j]] |= np.uint64(1 << j)
    masks[:, 0] = 0
    place = np.minimum(np.searchsorted(letters, b.codes[y]), len(letters) - 1)
    place = np.where(letters[place] == b.codes[y], place, len(letters))
    v = np.full(len(x), 2**64 - 1, np.uint64)
    for j in range(int(b.size[y].max(initial=0))):
        u = v & masks[of, place[:, j]]
        v = (v + u) | (v - u)
    size = a.size[x]
    full = np.where(size == WORD, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(size, WORD - 1).astype(np.uint64)) - np.uint64(1))
    return size - np.bitwise_count(v & full).astype(np.int64)


def text_lcs(a: str, b: str) -> int:
    """Longest common subsequence of two texts of any length, on whole numbers as bit sets."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def shared_lengths(a: NameTable, rows: np.ndarray, holders: dict[str, np.ndarray], size: int) -> np.ndarray:
    """Letters of the tokens that names share, each counted with the space behind it; ``holders`` has the other names of a token."""
    out = np.zeros((len(rows), size), np.int64)
    for i, r in enumerate(rows):
        for t in a.tokens[r]:
            if t in holders:
                out[i, holders[t]] += len(t) + 1
    return out


def held_by(sets: Iterable[Iterable[str]]) -> dict[str, np.ndarray]:
    """Of each member of a list of sets, the places of those that hold it."""
    out: dict[str, list[int]] = {}
    for j, members in enumerate(sets):
        for t in members:
            out.setdefault(t, []).append(j)
    return {t: np.array(places) for t, places in out.items()}


def name_scores(a: NameTable, b: NameTable, x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """``token_set_ratio`` of pairs of names, ``shared`` being their ``shared_lengths``."""
    s = np.maximum(shared - 1, 0)
    gap = (shared > 0).astype(np.int64)
    p, q = np.maximum(a.size[x] - s - gap, 0), np.maximum(b.size[y] - s - gap, 0)
    common = np.zeros(len(x), np.int64)
    plain = (shared == 0) & a.fits[x] & b.fits[y]
    common[plain] = word_lcs(a, b, x[plain], y[plain])
    for i in np.flatnonzero(~plain & (p > 0) & (q > 0)):
        one, two = a.tokens[x[i]], b.tokens[y[i]]
        common[i] = text_lcs(" ".join(sorted(one - two)), " ".join(sorted(two - one)))
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = 1 - (p + q - 2 * common) / (2 * (s + gap) + p + q)
        score = np.where(s > 0, np.maximum(rest, np.maximum(1 - (gap + p) / (2 * s + gap + p), 1 - (gap + q) / (2 * s + gap + q))), rest)
    score = np.where((s > 0) & ((p == 0) | (q == 0)), 1.0, score)
    return np.where((a.size[x] == 0) | (b.size[y] == 0), 0.0, score)


def best_in_block(asked: pd.DataFrame, there: pd.DataFrame, k: int) -> pd.DataFrame:
    """``query_id``, ``player_id``, ``score`` of the k best candidates of a block for each query, by bounds that lose none.

    Letters two names have in common bound their score, and shared tokens give the other part of it exactly; only pairs
    whose bound reaches the k-th best score found so far are compared.
    """
    there = there.sort_values("player_id", kind="stable").reset_index(drop=True)  # equal scores go by it
    (a_of, a_names), (b_of, b_names) = pd.factorize(asked["q_name"]), pd.factorize(there["c_name"])
    a, b = NameTable(a_names), NameTable(b_names)
    width = np.minimum(a.counts().max(axis=0), b.counts().max(axis=0))
    a_bag, b_bag = (t.unary(width) if width.any() else np.zeros((len(t.texts), 1), np.float32) for t in (a, b))
    nations = sorted({n for side in (asked["q_nations"], there["c_nations"]) for row in side if row is not None for n in row if n is not None})
    number = {n: i for i, n in enumerate(nations)}

    def flags(column: pd.Series) -> np.ndarray:
        out = np.zeros((len(column), max(1, len(nations))), np.float32)
        for i, row in enumerate(column):
            for n in row if row is not None else ():
                if n is not None:
                    out[i, number[n]] = 1
        return out

    q_flags, c_flags = flags(asked["q_nations"]), flags(there["c_nations"])
    q_any, c_any = q_flags.any(axis=1), c_flags.any(axis=1)
    q_born, c_born = asked["q_birth"].fillna(-1).to_numpy(np.int64), there["c_birth"].fillna(-1).to_numpy(np.int64)
    q_known, c_known = asked["q_birth"].notna().to_numpy(), there["c_birth"].notna().to_numpy()
    ids, holders = there["player_id"].to_numpy(), held_by(b.tokens)
    out = []
    for start in range(0, len(asked), STEP):
        rows = np.arange(start, min(start + STEP, len(asked)))
        names, of = np.unique(a_of[rows], return_inverse=True)
        shared = shared_lengths(a, names, holders, len(b.tokens))
        la, lb = a.size[names][:, None], b.size[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = 2 * (a_bag[names] @ b_bag.T) / (la + lb)
            s = shared - 1
            for own in (la, lb):  # what one shared part says by itself
                bound = np.maximum(bound, np.where(shared > 0, 2 * s / (s + own), 0))
        bound = np.where(a.fits[names][:, None] & b.fits[None, :], bound, 1.0)  # long texts have no counts
        bound = np.where((la == 0) | (lb == 0), 0.0, bound)
        weight = np.where((q_any[rows][:, None] & c_any[None, :]) & ~((q_flags[rows] @ c_flags.T) > 0), NATIONALITY_PENALTY, 1.0)
        weight[q_known[rows][:, None] & c_known[None, :] & (q_born[rows][:, None] != c_born[None, :])] = 0.0
        most = bound[of][:, b_of] * weight + 1e-6  # a little above rounding

        def scored(i: np.ndarray, j: np.ndarray, of=of, names=names, shared=shared, weight=weight) -> np.ndarray:
            pair, back = np.unique(np.stack([of[i], b_of[j]]), axis=1, return_inverse=True)
            return name_scores(a, b, names[pair[0]], pair[1], shared[pair[0], pair[1]])[back.ravel()] * weight[i, j]

        first = min(4 * k, len(ids))
        top = np.argpartition(most, len(ids) - first, axis=1)[:, len(ids) - first :]
        i, j = np.repeat(np.arange(len(rows)), first), top.ravel()
        score = np.full(most.shape, -1.0)
        score[i, j] = scored(i, j)
        least = np.partition(score, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
        i, j = np.nonzero((most >= least[:, None]) & (score < 0) & (most > 2e-6))
        for at in range(0, len(i), 200_000):
            score[i[at : at + 200_000], j[at : at + 200_000]] = scored(i[at : at + 200_000], j[at : at + 200_000])
        # candidates that score nothing follow where others are too few
        few = (score > 0).sum(axis=1)[:, None] < k
        order = np.where(score > 0, score, np.where(few, 0.0, -np.inf))
        i, j = leading(order, k)
        out.append((asked["query_id"].to_numpy()[rows[i]], ids[j], order[i, j]))
    return pd.DataFrame(dict(zip(["query_id", "player_id", "score"], map(np.concatenate, zip(*out)), strict=True)))


def top_candidates(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``player_id``, ``score`` and ``place`` of the k best candidates of each query; equal scores go by player_id.

    Queries: query_id, raw_name, birth_date, nationality; candidates: player_id, normalized_name, birth_date, nationality; ids
    must be unique. Every query meets every candidate, at any size, in blocks (``in_blocks``), so that the best are those of all
    candidates. Null names count as empty ones, which score 0; null nationalities count nowhere; rows with a null id take no part; extra columns are ignored.
    """
    day = lambda c: F.unix_date(c).cast("int")
    q = queries.select("query_id", F.coalesce(normalize_name(F.col("raw_name")), F.lit("")).alias("q_name"), day(F.col("birth_date")).alias("q_birth"), F.col("nationality").alias("q_nations"))
    c = candidates.select("player_id", F.coalesce("normalized_name", F.lit("")).alias("c_name"), day(F.col("birth_date")).alias("c_birth"), F.col("nationality").alias("c_nations"))
    kinds = dict(q.dtypes) | dict(c.dtypes)
    found = in_blocks(q, c, "query_id", "player_id", lambda x, y: best_in_block(x, y, k), f"query_id {kinds['query_id']}, player_id {kinds['player_id']}, score double")
    return best_of(found, "query_id", [F.desc("score"), "player_id"], k)


def outcomes(queries: DataFrame, top: DataFrame) -> DataFrame:
    """``query_id``, ``outcome`` (auto_resolved, needs_review, new), ``player_id``, ``confidence``, ``candidates`` (the best, in order).

    ``top``: the ``top_candidates`` of the queries. A query without candidates is new. player_id and confidence are given for
    resolved queries only.
    """
    best = top.groupBy("query_id").agg(
        F.max("score").alias("best"), F.min_by("player_id", "place").alias("first"),
        F.array_sort(F.collect_list(F.struct("place", "player_id", "score"))).alias("five"),
    )
    score = F.coalesce("best", F.lit(0.0))
    outcome = F.when(score >= AUTO_SCORE, "auto_resolved").when(score >= REVIEW_SCORE, "needs_review").otherwise("new")
    rows = queries.select("query_id").join(best, "query_id", "left").withColumn("outcome", outcome)
    resolved = F.col("outcome") == "auto_resolved"
    return rows.select(
        "query_id", "outcome", F.when(resolved, F.col("first")).alias("player_id"), F.when(resolved, F.col("best")).alias("confidence"),
        F.transform(F.coalesce("five", F.array().cast("array<struct<place:int,player_id:int,score:double>>")), lambda x: F.struct(x["player_id"].alias("playerId"), x["score"].alias("score"))).alias("candidates"),
    )


def with_aliases(queries: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries known by their (source, source_id), with ``player_id`` and outcome ``already_known``; and the rest."""
    key = ["source", "source_id"]
    known = aliases.filter("player_id is not null").groupBy(*key).agg(F.min("player_id").alias("player_id"))
    hit = queries.join(known, key).withColumn("outcome", F.lit("already_known"))
    return hit, queries.join(known.select(*key), key, "left_anti")


def trigrams(text: Column) -> Column:
    """Set of three-letter pieces of the words of a text, each padded by two spaces before and one after."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similar_names(names: DataFrame, queries: DataFrame, row: str, name: str, k: int) -> DataFrame:
    """``query_id``, ``row``, ``similarity`` and ``place`` of the k names that share most trigrams with each query name.

    Both sides hold ``row`` and ``name``. The similarity is the number of common trigrams by that of all trigrams of the two;
    equal ones go by ``row``. Null and empty names have no trigrams and similarity 0.
    """
    grams = lambda side, key: side.select(F.col(row).alias(key), F.coalesce(trigrams(F.col(name)), F.array().cast("array<string>")).alias("grams"))
    kind = dict(names.dtypes)[row]

    def compare(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("other", kind="stable").reset_index(drop=True)
        holders, ids, size = held_by(there["grams"]), there["other"].to_numpy(), there["grams"].map(len).to_numpy()
        out = []
        for start in range(0, len(asked), STEP):
            part = asked.iloc[start : start + STEP]
            both = np.zeros((len(part), len(there)))
            for i, own in enumerate(part["grams"]):
                for g in own:
                    if g in holders:
                        both[i, holders[g]] += 1
            total = part["grams"].map(len).to_numpy()[:, None] + size[None, :] - both
            score = np.where(total > 0, both / np.maximum(total, 1), 0.0)
            i, j = leading(score, k)
            out.append((part["query_id"].to_numpy()[i], ids[j], score[i, j]))
        return pd.DataFrame(dict(zip(["query_id", "other", "similarity"], map(np.concatenate, zip(*out)), strict=True)))

    found = in_blocks(grams(queries, "query_id"), grams(names, "other"), "query_id", "other", compare, f"query_id {kind}, other {kind}, similarity double")
    return best_of(found, "query_id", [F.desc("similarity"), "other"], k).select("query_id", F.col("other").alias(row), "similarity", "place")


def trigram_similarity(a: Column, b: Column) -> Column:
    """Share of trigrams two texts have in common."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))
