"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfline.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that public vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Most sources of a mix; their totals are planned on the driver.
MOST_SOURCES = 10_000
#: Documents of a block, about, and most blocks of a copy of a source.
BLOCK_DOCUMENTS, MOST_BLOCKS = 1_000, 65_536


@lru_cache(4)
def tokenizer(path: str):
    """The tokenizer of a ranks file, one per Python worker; where the path doesn't exist, the file as handed to the executors."""
    import tiktoken

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of each text, special strings being ordinary text; null and empty texts have none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(path)
        for batch in batches:
            yield pd.Series([len(encode.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return count(texts)


def source_key(source: Column) -> Column:
    """Source name without case, outer spaces and differences of separators; null gives an empty name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


class Planned(NamedTuple):
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    documents: int
    budget: float
    target: float  # tokens of the target share of the mix

    @property
    def exhausted(self) -> bool:
        """Whether the mix takes all that the repetition limit allows."""
        return self.budget >= self.tokens * max(self.max_repeats, 0)

    @property
    def reachable(self) -> bool:
        """Whether the mix can hold the target: what is used up without reaching it can't."""
        return not (self.exhausted and self.budget < self.target)


def check_sources(targets: DataFrame) -> None:
    """Raise if there are more targets than may be broadcast and planned on the driver."""
    if targets.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")


def sized_documents(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source`` in the spelling of the targets (null if none of them) and ``tokens`` of every document.

    Names are matched without case, outer spaces and separators; target names must differ then. Tokenizing is one narrow
    pass over the scan.
    """
    check_sources(targets)
    if os.path.exists(path):
        documents.sparkSession.sparkContext.addFile(path)
    names = F.broadcast(targets.select(source_key(F.col("source")).alias("__key"), F.col("source").alias("__name")))
    sized = documents.select("doc_id", source_key(F.col("source")).alias("__key"), token_counts(F.col("text"), path).alias("tokens"))
    return sized.join(names, "__key", "left").select("doc_id", F.col("__name").alias("source"), "tokens")


def plan(sized: DataFrame, targets: DataFrame, size: int | None = None) -> list[Planned]:
    """Budget of tokens per source for a mix of ``size`` tokens (default: as many as all documents have).

    Sources get weights tokens^(1 - a) * share^a, normalised. At the exponent 1 these are the target shares; sources whose
    tokens times max_repeats are fewer are used up, and the rest of the mix goes to the others. While others are pushed
    over their limits by that, the exponent is bisected to the largest that keeps every limit; sources beyond theirs even at
    0 are used up too. Only one row of totals per source reaches the driver, at most ``MOST_SOURCES``. A null share counts
    as 0 and null repeats as 1; a source without documents has no budget.
    """
    check_sources(targets)
    wanted = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats"))
    totals = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    have = {r["source"]: (r["tokens"] or 0, r["n"]) for r in totals.collect()}
    rows = [(r["source"], r["share"], r["repeats"], *have.get(r["source"], (0, 0))) for r in wanted.collect()]
    whole = sum(t for t, _ in have.values())
    size = whole if size is None else size
    most = {s: t * max(r, 0) for s, _, r, t, _ in rows}
    budget = {s: float(most[s]) for s, share, *_ in rows if share * size > most[s]}
    free = [x for x in rows if x[0] not in budget and x[1] > 0 and x[3] > 0]
    while free:
        rest = max(0.0, size - sum(budget.values()))

        def weights(a: float, free: list = free) -> dict[str, float]:
            raw = {s: t ** (1 - a) * share**a for s, share, _, t, _ in free}
            return {s: v / sum(raw.values()) for s, v in raw.items()}

        over = lambda a, rest=rest, weights=weights: [s for s, w in weights(a).items() if w * rest > most[s]]
        low, high = 0.0, 1.0
        if not over(1.0):
            low = 1.0
        elif pinned := over(0.0):
            budget |= {s: float(most[s]) for s in pinned}
            free = [x for x in free if x[0] not in pinned]
            continue
        else:
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (low, middle) if over(middle) else (middle, high)
        budget |= {s: w * rest for s, w in weights(low).items()}
        break
    return [Planned(s, share, r, t, n, budget.get(s, 0.0), share * size) for s, share, r, t, n in rows]


def mix(sized: DataFrame, planned: list[Planned], seed: int = 0, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """The mix: ``doc_id``, ``source``, ``copy`` (from 0), ``tokens``, ``block``, ``position`` and ``shuffle``.

    A source is taken as often as its budget allows, each time as a permutation of its own: a hash of seed, copy and id puts
    its documents into blocks of about ``block_documents`` (at most ``MOST_BLOCKS`` a copy, larger ones then), the blocks
    of a copy come in the order of a hash (``block``, from 0), and so do the documents of a block (``position``, from 0).
    Of the last copy, blocks are taken in order while they fit the rest of the budget, and of the next block documents
    while they fit. Reading by ``shuffle``, then ``position``, gives the blocks of all sources and copies in one random
    order. Only totals of blocks are ordered per copy, and one block is sorted at a time.
    """
    spark = sized.sparkSession
    steps = [
        (p.source, int(p.budget // p.tokens), float(p.budget - p.budget // p.tokens * p.tokens), max(1, min(MOST_BLOCKS, -(-p.documents // block_documents))))
        for p in planned if p.tokens > 0
    ]
    budgets = F.broadcast(spark.createDataFrame(steps, "source string, full int, rest double, blocks int"))
    rows = sized.filter("source is not null").join(budgets, "source")
    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    rows = rows.filter(last >= 0).select("doc_id", "source", "full", "rest", "blocks", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "copy", "doc_id")).withColumn("b", F.pmod("h", "blocks"))
    key = ["source", "copy", "b"]
    sums = rows.groupBy(*key).agg(F.sum("tokens").alias("bt")).withColumn("shuffle", F.xxhash64(F.lit(seed + 1), *key))
    ordered = Window.partitionBy("source", "copy").orderBy("shuffle", "b")
    sums = sums.withColumn("block", F.row_number().over(ordered) - 1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bt").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(*key).orderBy("h", "doc_id")
    placed = rows.join(sums, key).filter((F.col("copy") < F.col("full")) | (F.col("before") < F.col("rest")))
    placed = placed.withColumn("position", F.row_number().over(inner) - 1).withColumn("upto", F.col("before") + F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter((F.col("copy") < F.col("full")) | (F.col("upto") <= F.col("rest"))).select("doc_id", "source", "copy", "tokens", "block", "position", "shuffle")


def prepared(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``sized_documents``, kept in the shared folder so that texts are tokenized once."""
    return cut(sized_documents(documents, targets, path))
