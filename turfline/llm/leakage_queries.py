"""Queries on leaked evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.text import words
from turfline.llm.leakage import decontaminate, leaked_spans, leaks
from turfline.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document after leaked passages are removed."""
    clean = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))
    return clean.select("doc_id", F.size(words(F.col("text"))).alias("words"))


QUERIES = {"p7_found": p7_found, "p7_spans": p7_spans, "p7_clean": p7_clean}

GRAMS_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(replace(replace(replace(replace(replace(replace(lower(strip_accents(text)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd'), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(replace(replace(replace(replace(replace(replace(lower(strip_accents(text)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd'), '[\p{L}\p{N}]+') AS w FROM eval_items),
d AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM dw WHERE len(w) >= 10)),
t AS (SELECT item_id, n, i - 1 AS item_at, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) - 8)) AS i FROM iw WHERE len(w) >= 10))
"""

ORACLES = {
    "p7_found": f"{GRAMS_SQL} SELECT DISTINCT doc_id, item_id FROM d JOIN t USING (g)",
    "p7_spans": f"""{GRAMS_SQL}, h AS (SELECT DISTINCT doc_id, item_id, n, pos, item_at, pos - item_at AS d FROM d JOIN t USING (g)),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY pos) AS run FROM h)
SELECT doc_id, item_id, CAST(min(pos) AS INT) AS first_word, CAST(max(pos) + 9 AS INT) AS last_word, CAST(min(item_at) AS INT) AS item_first,
  CAST(max(pos) + 10 - min(pos) AS INT) AS run_words, CAST(max(n) AS INT) AS item_length FROM r GROUP BY doc_id, item_id, d, run""",
    "p7_clean": f"""{GRAMS_SQL}, h AS (SELECT DISTINCT doc_id, pos FROM d JOIN t USING (g)),
gone AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 10)) AS p FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) - coalesce(n, 0) AS INT) AS words FROM dw LEFT JOIN gone USING (doc_id)""",
}
