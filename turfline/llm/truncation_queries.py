"""Queries on cut texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.truncation import ENCODINGS, truncated
from turfline.session import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = truncated(table(spark, sf_dir, "documents"))
    return judged.filter("cut").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cut ones and their rate per source, with the strongest limit found."""
    judged, found = truncated(table(spark, sf_dir, "documents"))
    best = found.groupBy("source").agg(F.max(F.struct("hard", "open_texts", (-F.col("encoding")).alias("e"), "high")).alias("x"))
    name = F.element_at(F.array(*[F.lit(x) for x in ENCODINGS]), 1 - F.col("x.e"))
    rates = judged.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"))
    return rates.join(best, "source", "left").select(
        "source", "documents", "cut", F.round(F.col("cut") / F.col("documents"), 6).alias("rate"), F.col("x.high").alias("limit_length"), name.alias("limit_encoding")
    )


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates}
ORACLES: dict[str, str] = {}
