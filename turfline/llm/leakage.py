"""Evaluation texts leaking into training text.

The n-grams of the normalised test items form a hash set, broadcast where its size is checked to be small and joined by
shuffle beyond that. Every window of n words of a document is looked up in one pass over the corpus that shuffles no text;
entries of the set are the words themselves, so that a hit is verified as it is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfline.functions.text import fold, fold_table, words

#: Most n-grams of items that are broadcast; about 200 bytes each in a worker.
BROADCAST_GRAMS = 500_000
WORD = regex.compile(r"[\p{L}\p{N}]+")

Grams = dict[str, list[tuple[object, int]]]


def windows(texts: DataFrame, row: str, text: str, n: int) -> DataFrame:
    """``row``, ``at`` (place of the first word, from 0), ``key`` (a hash) and ``gram`` of every run of n words."""
    split = texts.select(row, words(F.col(text)).alias("w")).filter(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return split.select(row, F.posexplode(grams).alias("at", "gram")).withColumn("key", F.xxhash64("gram"))


def item_grams(items: DataFrame, n: int, item: str, text: str) -> Grams | None:
    """The n-grams of the items with the items and places that hold them; None if there are more than may be broadcast."""
    tests = items.select(F.col(item).alias("i"), words(F.col(text)).alias("w")).filter(F.col("i").isNotNull() & (F.size("w") >= n))
    if (tests.agg(F.sum(F.size("w"))).first()[0] or 0) > BROADCAST_GRAMS:
        return None
    out: Grams = {}
    for r in tests.collect():  # at most BROADCAST_GRAMS words
        for at in range(len(r["w"]) - n + 1):
            out.setdefault(" ".join(r["w"][at : at + n]), []).append((r["i"], at))
    return {gram: sorted(set(held)) for gram, held in out.items()}


def finder(grams: Grams, n: int) -> Callable[[str | None], list[tuple[int, object, int]]]:
    """A function that gives (word number, item, word number in the item) of the windows of a folded text that are in the set."""
    ends = {(g.split(" ")[0], g.split(" ")[-1]) for g in grams}

    def find(text: str | None) -> list[tuple[int, object, int]]:
        w = WORD.findall(text) if text else []
        # most windows are told by their first and last word
        likely = [i for i, pair in enumerate(zip(w, w[n - 1 :], strict=False)) if pair in ends]
        return [(i, item, at) for i in likely for item, at in grams.get(" ".join(w[i : i + n]), ())]

    return find


def leaks(documents: DataFrame, items: DataFrame, n: int = 10, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Windows of documents that are windows of items: ``doc``, ``at`` (word number in the document), ``item``, ``item_at``.

    Words are runs of letters and digits, compared without case and accents. Null and empty texts, and texts of fewer
    than n words, have no window; rows with a null id aren't reported; a repeated document is reported once; extra columns
    are ignored. Only hits are shuffled, unless the items hold more than ``BROADCAST_GRAMS`` words.
    """
    docs = documents.select(F.col(doc).alias("__doc"), F.col(text).alias("__text")).filter(F.col("__doc").isNotNull())
    grams = item_grams(items, n, item, text)
    if grams is None:
        tests = items.select(F.col(item).alias("__item"), F.col(text).alias("__text")).filter(F.col("__item").isNotNull())
        there = windows(tests, "__item", "__text", n).select("__item", F.col("at").alias("__item_at"), F.col("key").alias("__key"), F.col("gram").alias("__gram"))
        hits = windows(docs, "__doc", "__text", n).join(there, (F.col("key") == F.col("__key")) & (F.col("gram") == F.col("__gram")))
        return hits.select(F.col("__doc").alias(doc), "at", F.col("__item").alias(item), F.col("__item_at").alias("item_at")).distinct()
    shared = documents.sparkSession.sparkContext.broadcast(grams)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder(shared.value, n)
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch["__doc"], batch["__text"], strict=True) for hit in find(t)]
            yield pd.DataFrame(rows, columns=["doc", "at", "item", "item_at"]) if rows else pd.DataFrame()

    kinds = dict(documents.dtypes)[doc], dict(items.dtypes)[item]
    found = docs.select("__doc", fold(F.col("__text")).alias("__text")).mapInPandas(scan, f"doc {kinds[0]}, at int, item {kinds[1]}, item_at int")
    return found.select(F.col("doc").alias(doc), "at", F.col("item").alias(item), "item_at").distinct()


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = 10, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Per run of leaked words: ``doc``, ``item``, ``first_word`` and ``last_word`` in the document, ``item_first`` in the item,
    ``run_words`` and the ``item_length``. Passages that stand apart, in the document or in the item, are runs of their own.
    """
    length = items.filter(F.col(item).isNotNull()).groupBy(item).agg(F.max(F.size(words(F.col(text)))).alias("item_length"))
    hits = leaks(documents, items, n, doc, item, text).withColumn("__d", F.col("at") - F.col("item_at"))
    run = F.col("at") - F.row_number().over(Window.partitionBy(doc, item, "__d").orderBy("at"))
    runs = hits.withColumn("__run", run).groupBy(doc, item, "__d", "__run").agg(F.min("at").alias("first_word"), (F.max("at") + (n - 1)).alias("last_word"), F.min("item_at").alias("item_first"))
    runs = runs.withColumn("run_words", F.col("last_word") - F.col("first_word") + 1)
    return runs.join(length, item).select(doc, item, "first_word", "last_word", "item_first", "run_words", "item_length")


def decontaminate(documents: DataFrame, items: DataFrame, n: int = 10, whole: bool = False, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``documents`` without leaked passages: without the words of every hit, or, if ``whole``, without the documents hit.

    Other columns and documents stay as they are; documents with a null id are cleaned like others. One pass that shuffles
    nothing, unless the items hold more than ``BROADCAST_GRAMS`` words; document ids must be unique then, and those with a
    null id stay untouched.
    """
    grams = item_grams(items, n, item, text)
    source, target = fold_table()
    marks = {ord(c) for c in source[len(target) :]}

    def without(value: str, starts: set[int]) -> str:
        word = regex.compile(r"[\p{L}\p{N}\u0300-\u036f]+")
        spans = [m.span() for m in word.finditer(value) if any(ord(c) not in marks for c in m.group())]
        bad = sorted({i for s in starts for i in range(s, s + n) if i < len(spans)})
        kept, last = [], 0
        for k, i in enumerate(bad):
            if k == 0 or bad[k - 1] != i - 1:
                kept.append(value[last : spans[i][0]])
            last = spans[i][1]
        return "".join(kept) + value[last:]

    if grams is None:
        starts = leaks(documents, items, n, doc, item, text).groupBy(doc).agg(F.collect_set("at").alias("__starts"))
        if whole:
            return documents.join(starts, doc, "left_anti")

        def cut_known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                rows[text] = [without(value, set(at)) for value, at in zip(rows[text], rows["__starts"], strict=True)]
                yield rows.drop(columns="__starts")

        clean = documents.join(starts, doc).select(*documents.columns, "__starts").mapInPandas(cut_known, documents.schema)
        return documents.join(starts, doc, "left_anti").unionByName(clean)
    shared = documents.sparkSession.sparkContext.broadcast(grams)

    def cut_found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder(shared.value, n)
        for rows in batches:
            hits = [{at for at, *_ in find(folded)} for folded in rows["__folded"]]
            rows = rows.drop(columns="__folded")
            if whole:
                yield rows[[not h for h in hits]]
                continue
            rows[text] = [without(value, h) if h else value for value, h in zip(rows[text], hits, strict=True)]
            yield rows

    return documents.withColumn("__folded", fold(F.col(text))).mapInPandas(cut_found, documents.schema)
