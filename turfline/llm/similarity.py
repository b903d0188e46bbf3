"""The most similar vectors of every vector: inverted lists, product-quantised residuals, exact reranking.

Vectors are put into groups by centroids trained on a bounded sample, and groups are cut into blocks of bounded size. Each
block is an inverted file of its own: list centroids trained on its rows, residuals quantised by shared codebooks. A query
goes to its nearest groups, visits the nearest lists of their blocks, where asymmetric distance tables pick candidates, and
the exact cosine in double precision ranks them. No centroid of a list leaves its task, so lists grow with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.session import cut

#: Documented bounds of the training: rows of the sample per kind at least, sampled rows a group, and most groups; groups hold
#: about GROUP_ROWS until then and more beyond. Everything else covers all rows.
TRAIN_ROWS, TRAIN_EACH, GROUP_ROWS, MOST_GROUPS = 32_768, 40, 8_192, 4_096
#: Rows of a list, groups and lists of a block visited per query. On the tables of scale 1 a query sees 11 % of the rows.
LIST_ROWS, GROUP_PROBES, LIST_PROBES = 64, 5, 20
#: Dimensions of a sub-quantizer, entries of each, candidates kept per list and reranked per query, rows of a block.
#: Measured on the test vectors, whose residuals are nearly isotropic, 4 dimensions lose the neighbours and 2 keep them.
PART, ENTRIES, PER_LIST, RERANK, BLOCK = 2, 256, 24, 80, 16_384


class Index(NamedTuple):
    """Of one kind: centroids of the groups and codebooks of the parts of residuals."""

    groups: np.ndarray
    codebooks: np.ndarray


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of at most k clusters of the rows of x, by Lloyd's rounds from a random start of distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        moved = total / np.maximum(count, 1)[:, None]
        empty = count == 0
        moved[empty] = distinct[rng.choice(len(distinct), empty.sum())]
        c = moved.astype(np.float32)
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    out = np.empty(len(x), np.int64)
    step = max(1, 4_000_000 // max(1, len(c)))
    for i in range(0, len(x), step):
        out[i : i + step] = np.argmax(x[i : i + step] @ c.T - half, axis=1)
    return out


def train(sample: np.ndarray, rows: int, seed: int = 7) -> Index:
    """Fit the groups of ``rows`` vectors and the codebooks on a sample of unit vectors."""
    groups = kmeans(sample, groups_of(rows), 8, seed)
    # residuals as lists of a block leave them, on as many rows as a block has
    part = sample[:GROUP_ROWS]
    lists = kmeans(part, max(1, len(part) // LIST_ROWS), 6, seed)
    residual = part - lists[nearest_centroid(part, lists)]
    books = np.zeros((sample.shape[1] // PART, ENTRIES, PART), np.float32)
    for m in range(len(books)):
        book = kmeans(residual[:, m * PART : (m + 1) * PART], ENTRIES, 8, seed + m)
        books[m, : len(book)] = book
        books[m, len(book) :] = book[0]
    return Index(groups, books)


def groups_of(rows: int) -> int:
    return int(min(MOST_GROUPS, max(1, -(-rows // GROUP_ROWS))))


def nearest_few(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, in no order; a bounded part of the distances at a time."""
    n, half = min(n, len(c)), (c * c).sum(axis=1) / 2
    out = np.empty((len(x), n), np.int32)
    step = max(1, 4_000_000 // len(c))
    for i in range(0, len(x), step):
        near = x[i : i + step] @ c.T - half
        out[i : i + step] = np.argpartition(near, len(c) - n, axis=1)[:, len(c) - n :]
    return out


def unit(raw: np.ndarray, width: int) -> np.ndarray:
    """Rows as unit float32 vectors, padded with zeros to ``width``."""
    x = raw.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.float32)


def stacked(values: pd.Series, dim: int) -> np.ndarray:
    """The first ``dim`` entries of a column of arrays as one float32 array, short ones padded with zeros."""
    if len({len(v) for v in values}) == 1 and len(values.iloc[0]) >= dim:
        return np.stack(values.to_numpy())[:, :dim].astype(np.float32)
    out = np.zeros((len(values), dim), np.float32)
    for i, v in enumerate(values):
        out[i, : len(v)] = v[:dim]
    return out


def block_search(
    queries: np.ndarray, owners: np.ndarray, single: np.ndarray, members: np.ndarray, held: np.ndarray, players: np.ndarray, order: np.ndarray,
    index: Index, width: int, k: int, probes: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row number and exact cosine of the best rows of other owners in the nearest lists of a block.

    Members are different vectors, of which each is ``held`` by so many rows, one vector's rows after the other's; ``players``
    own the rows and ``order`` breaks their ties. A query of one owner gets its k best. One that several own (``single`` is
    false) gets the 2 k best of which no player has more than k, among which each owner has its k best.
    """
    x, q_unit = unit(members, width), unit(queries, width)
    lists = kmeans(x, max(1, -(-len(x) // LIST_ROWS)), 6, 7)
    home = nearest_centroid(x, lists)
    residual = x - lists[home]
    codes = [nearest_centroid(residual[:, m * PART : (m + 1) * PART], book) for m, book in enumerate(index.codebooks)]
    start_of = np.cumsum(held) - held
    sole = np.where(np.minimum.reduceat(players, start_of) == np.maximum.reduceat(players, start_of), players[start_of].astype(np.int64), np.iinfo(np.int64).min)  # of a vector that one player holds

    def rows_of_vectors(q: np.ndarray, m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = held[m]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(q, n), np.repeat(start_of[m], n) + within, np.repeat(c, n)

    rows_of = np.argsort(home, kind="stable")
    first = np.searchsorted(home[rows_of], np.arange(len(lists) + 1))
    q64, m64 = queries.astype(np.float64), members.astype(np.float64)
    q64, m_norm = q64 / np.sqrt((q64 * q64).sum(axis=1))[:, None], np.sqrt((m64 * m64).sum(axis=1))
    per_list, rerank = max(PER_LIST, 2 * k), max(RERANK, 8 * k)
    out = []
    asking = np.flatnonzero(single)
    for start in range(0, len(asking), 4_096):
        part = asking[start : start + 4_096]
        seen = nearest_few(q_unit[part], lists, probes)
        slots = seen.shape[1]
        value = np.full((len(part), slots * per_list), -np.inf, np.float32)
        found = np.zeros(value.shape, np.int32)
        pairs = np.argsort(seen.ravel(), kind="stable")
        ends = np.searchsorted(seen.ravel()[pairs], np.arange(len(lists) + 1))
        for which in range(len(lists)):
            own, at = rows_of[first[which] : first[which + 1]], pairs[ends[which] : ends[which + 1]]
            if not len(own) or not len(at):
                continue
            q = at // slots
            of = q_unit[part[q]]
            score = np.empty((len(own), len(q)), np.float32)
            score[:] = lists[which] @ of.T
            for m, book in enumerate(index.codebooks):  # the asymmetric distance table of a part, one row per entry
                score += (book @ of[:, m * PART : (m + 1) * PART].T)[codes[m][own]]
            mine = np.flatnonzero(np.isin(owners[part[q]], sole[own]))
            score[:, mine] = np.where(sole[own][:, None] == owners[part[q]][mine][None, :], -np.inf, score[:, mine])
            score = np.ascontiguousarray(score.T)
            top = np.argpartition(score, len(own) - per_list, axis=1)[:, len(own) - per_list :] if len(own) > per_list else np.broadcast_to(np.arange(len(own)), score.shape)
            place = (at % slots)[:, None] * per_list + np.arange(top.shape[1])
            value[q[:, None], place], found[q[:, None], place] = np.take_along_axis(score, top, axis=1), own[top]
        if value.shape[1] > rerank:
            top = np.argpartition(value, value.shape[1] - rerank, axis=1)[:, value.shape[1] - rerank :]
            value, found = np.take_along_axis(value, top, axis=1), np.take_along_axis(found, top, axis=1)
        cosine = np.empty(value.shape)
        for i in range(0, len(part), 512):
            cosine[i : i + 512] = np.einsum("qd,qrd->qr", q64[part[i : i + 512]], m64[found[i : i + 512]]) / m_norm[found[i : i + 512]]
        cosine[value == -np.inf] = -np.inf
        least = np.partition(cosine, cosine.shape[1] - min(k, cosine.shape[1]), axis=1)[:, cosine.shape[1] - min(k, cosine.shape[1])]
        i, j = np.nonzero((cosine >= least[:, None]) & (cosine > -np.inf))  # equal ones stay for the order of their rows
        q, m, c = rows_of_vectors(part[i], found[i, j], cosine[i, j])
        other = players[m] != owners[q]
        q, m, c = q[other], m[other], c[other]
        few = place_in(q, np.lexsort((order[m], -c, q))) < k
        out.append((q[few], m[few], c[few]))
    number = np.unique(players, return_inverse=True)[1].ravel()
    asking = np.flatnonzero(~single)
    for start in range(0, len(asking), 512):  # rows of one of several owners can't be passed over: all of the lists are ranked exactly
        part = asking[start : start + 512]
        seen = nearest_few(q_unit[part], lists, probes)
        visited = np.zeros((len(part), len(lists)), bool)
        visited[np.arange(len(part))[:, None], seen] = True
        cosine = np.where(visited[:, home], (q64[part] @ m64.T) / m_norm, -np.inf)
        i, j = np.nonzero(cosine > -np.inf)
        q, m, c = rows_of_vectors(i, j, cosine[i, j])
        few = place_in(q * len(players) + number[m], np.lexsort((order[m], -c, number[m], q))) < k
        q, m, c = q[few], m[few], c[few]
        few = place_in(q, np.lexsort((order[m], -c, q))) < 2 * k
        out.append((part[q[few]], m[few], c[few]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    q, m, c = (np.concatenate(x) for x in zip(*out, strict=True))
    return q, m, c


def place_in(group: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Place of each entry in its group, from 0, ``by`` sorting the entries by group first."""
    starts = np.flatnonzero(np.diff(group[by], prepend=-1))
    out = np.empty(len(group), np.int64)
    out[by] = np.arange(len(group)) - np.repeat(starts, np.diff([*starts, len(group)]))
    return out


def distinct_vectors(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``kind``, ``h1``, ``h2``, ``v`` and ``heads`` (first rows holding it, ordered) of every distinct vector that takes part.

    A vector takes part if it is not null, has an entry other than 0 and holds no null, NaN or infinity. Its heads are the
    first 2 k rows of which no player has more than k: whoever asks, they have the first k of other players. The second
    result has all rows once.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    clean = rows.filter(F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0) & F.col("player_id").isNotNull())
    keyed = clean.select("kind", "player_id", "season", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    once = keyed.groupBy("kind", "h1", "h2", "player_id", "season").agg(F.first("v").alias("v"))
    vec = ["kind", "h1", "h2"]
    few = once.withColumn("n", F.row_number().over(Window.partitionBy(*vec, "player_id").orderBy("season"))).filter(F.col("n") <= k)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy(*vec).orderBy("player_id", "season"))).filter(F.col("n") <= 2 * k)
    heads = few.groupBy(*vec).agg(F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct("player_id", "season"))).alias("heads"))
    return heads, once


def nearest(rows: DataFrame, k: int = 5, group_probes: int = GROUP_PROBES, list_probes: int = LIST_PROBES) -> DataFrame:
    """The k most similar rows of other players for every row: ``kind``, ``player_id``, ``season``, ``other_id``,
    ``other_season``, ``cosine``, ``rank``.

    ``rows``: ``kind``, ``player_id``, ``season``, ``v``; only rows of one kind are compared. Repeated rows count once;
    null, empty, all-zero and NaN- or infinity-holding vectors don't take part; shorter vectors count as padded with
    zeros; equal similarities go by player, then season. Copies of a vector are indexed and asked for once. The search is
    approximate: every row is indexed, and of the ``group_probes`` nearest groups the ``list_probes`` nearest lists of each
    block are visited.
    """
    spark = rows.sparkSession
    heads, once = distinct_vectors(rows, k)
    vectors = cut(heads)
    used = F.array_max(F.transform("v", lambda x, i: F.when(x != 0, i + 1).otherwise(0)))  # entries up to the last that isn't 0
    sizes = {r["kind"]: (r["n"], r["d"]) for r in vectors.groupBy("kind").agg(F.count("*").alias("n"), F.max(used).alias("d")).collect()}
    out_schema = "kind string, h1 long, h2 long, player_id int, season string, one boolean, other_id int, other_season string, cosine double"
    if not sizes:
        return spark.createDataFrame([], "kind string, player_id int, season string, other_id int, other_season string, cosine double, rank int")
    indexes, widths, dims = {}, {}, {}
    for kind, (n, dim) in sorted(sizes.items()):
        wanted = max(TRAIN_ROWS, TRAIN_EACH * groups_of(n))
        share = min(1.0, 1.2 * wanted / n)
        sample = vectors.filter((F.col("kind") == kind) & (F.pmod(F.col("h1"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("v").limit(wanted)
        widths[kind], dims[kind] = -(-dim // PART) * PART, dim
        indexes[kind] = train(unit(stacked(sample.toPandas()["v"], dim), widths[kind]), n)
    shared = spark.sparkContext.broadcast((indexes, widths, dims))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes, widths, dims = shared.value
        for batch in batches:
            for kind, part in batch.groupby("kind", sort=False):
                raw = stacked(part["v"], dims[kind])
                x = unit(raw, widths[kind])
                groups = indexes[kind].groups
                yield pd.DataFrame({
                    "kind": kind, "h1": part["h1"].to_numpy(), "h2": part["h2"].to_numpy(), "heads": part["heads"].to_numpy(), "v": [r.tobytes() for r in raw],
                    "g": nearest_centroid(x, groups).astype(np.int32), "gs": list(nearest_few(x, groups, group_probes)),
                })

    head_type = "array<struct<player_id:int,season:string>>"
    encoded = cut(vectors.mapInPandas(encode, f"kind string, h1 long, h2 long, heads {head_type}, v binary, g int, gs array<int>"))
    ids, seasons = F.transform("heads", lambda h: h["player_id"]), F.transform("heads", lambda h: h["season"])
    members = encoded.select("kind", "g", "h2", "v", ids.alias("ids"), seasons.alias("seasons"))
    asks = encoded.select(
        "kind", "h1", "h2", "v", F.array_min(ids).alias("player_id"), F.col("heads")[0]["season"].alias("season"),
        (F.size("heads") == 1).alias("one"), (F.array_min(ids) == F.array_max(ids)).alias("single"), F.explode("gs").alias("g"),
    )
    # blocks: at most two counts per group reach the driver's plan, and groups are bounded
    m_count = members.groupBy("kind", "g").agg(F.count("*").alias("m"))
    q_count = asks.groupBy("kind", "g").agg(F.count("*").alias("q"))
    blocks = m_count.join(q_count, ["kind", "g"]).select("kind", "g", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb"))
    planned = [(r["kind"], r["g"], r["mb"], r["qb"]) for r in blocks.collect()]
    blocks = F.broadcast(spark.createDataFrame(planned, "kind string, g int, mb int, qb int"))
    tasks = sum(mb * qb for *_, mb, qb in planned)
    key = ["kind", "g", "i", "j"]
    members = members.join(blocks, ["kind", "g"]).withColumn("i", F.pmod("h2", F.col("mb")).cast("int"))
    members = members.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).drop("mb", "qb")
    asks = asks.join(blocks, ["kind", "g"]).withColumn("j", F.pmod("h2", F.col("qb")).cast("int"))
    asks = asks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).drop("mb", "qb")

    def search(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame()
        indexes, widths, dims = shared.value
        kind = asked["kind"].iloc[0]
        matrix = lambda column: np.frombuffer(b"".join(column), np.float32).reshape(len(column), dims[kind])
        players, seasons = np.concatenate(there["m_ids"].to_numpy()), np.concatenate(there["m_seasons"].to_numpy())
        order = np.empty(len(players), np.int64)
        order[np.lexsort((seasons.astype(str), players))] = np.arange(len(players))
        q, m, c = block_search(
            matrix(asked["v"]), asked["player_id"].to_numpy(), asked["single"].to_numpy(bool), matrix(there["m_v"]), there["m_ids"].map(len).to_numpy(),
            players, order, indexes[kind], widths[kind], k, list_probes,
        )
        out = asked[["kind", "h1", "h2", "player_id", "season", "one"]].iloc[q].reset_index(drop=True)
        out["other_id"], out["other_season"], out["cosine"] = players[m], seasons[m], c
        return out if len(out) else pd.DataFrame()

    spread = max(12, min(tasks, 4096))
    # both sides come from one table: names of their own keep the columns apart
    members = members.select(*[F.col(c).alias(f"m_{c}") for c in members.columns])
    m_key = [f"m_{c}" for c in key]
    asks, members = asks.repartition(spread, *key), members.repartition(spread, *m_key)
    found = asks.groupBy(*key).cogroup(members.groupBy(*m_key)).applyInPandas(search, out_schema)
    best = ["other_id", "other_season", "cosine"]
    # the rows of vectors held more than once; one pass over what was found serves both kinds
    copied = encoded.filter(F.size("heads") > 1).select("kind", "h1", "h2")
    holders = once.join(copied, ["kind", "h1", "h2"], "left_semi").select("kind", "h1", "h2", F.col("player_id").alias("holder"), F.col("season").alias("held"))
    both = found.join(holders, ["kind", "h1", "h2"], "left").select(
        "kind", F.when(F.col("one"), F.col("player_id")).otherwise(F.col("holder")).alias("player_id"),
        F.when(F.col("one"), F.col("season")).otherwise(F.col("held")).alias("season"), *best,
    ).filter("player_id <> other_id")
    # two different vectors of one player and season are one row that asks twice
    rank = F.row_number().over(Window.partitionBy("kind", "player_id", "season").orderBy(F.desc("cosine"), "other_id", "other_season"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, k: int = 5) -> DataFrame:
    """Pairs of rows of which at least one is among the k most similar of the other, the smaller player first."""
    a, b = F.struct("player_id", "season"), F.struct(F.col("other_id").alias("player_id"), F.col("other_season").alias("season"))
    pairs = nearest(rows, k).select("kind", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return pairs.distinct().select(
        F.col("kind").alias("vec"), F.col("a.player_id").alias("player_id_a"), F.col("a.season").alias("season_a"),
        F.col("b.player_id").alias("player_id_b"), F.col("b.season").alias("season_b"),
    )
