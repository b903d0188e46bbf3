"""Queries on the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.mixing import mix, plan, prepared, sized_documents
from turfline.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the mix uses up without reaching their target."""
    targets = table(spark, sf_dir, "mix_targets")
    planned = plan(sized_documents(table(spark, sf_dir, "documents"), targets), targets)
    return spark.createDataFrame([(p.source,) for p in planned if not p.reachable], "source string")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    sized = prepared(table(spark, sf_dir, "documents"), targets)
    return mix(sized, plan(sized, targets))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares really reached by the mix, per source of the targets."""
    targets = table(spark, sf_dir, "mix_targets")
    sized = prepared(table(spark, sf_dir, "documents"), targets)
    planned = plan(sized, targets)
    reached = mix(sized, planned).groupBy("source").agg(F.sum("tokens").alias("mixed"), F.max("copy").alias("last_copy"))
    all_mixed = reached.select(F.sum("mixed").alias("all"))
    have = spark.createDataFrame([(p.source, p.target_share, p.max_repeats, p.tokens, p.reachable) for p in planned], "source string, target_share double, max_repeats int, tokens long, reachable boolean")
    return have.join(F.broadcast(reached), "source", "left").crossJoin(F.broadcast(all_mixed)).select(
        "source", "target_share", "max_repeats", "tokens", F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"),
        F.round(F.coalesce(F.col("mixed") / F.col("all"), F.lit(0.0)), 6).alias("reached_share"),
        F.round(F.coalesce(F.try_divide("mixed", "tokens"), F.lit(0.0)), 6).alias("repeats"), "reachable",
    )


QUERIES = {"p8_found": p8_found, "p8_mix": p8_mix, "p8_shares": p8_shares}

# The answer doesn't depend on the tokenizer, so characters stand for tokens.
ORACLES = {
    "p8_found": """
WITH sized AS (SELECT trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') AS source, sum(length(text)) AS n FROM documents GROUP BY 1)
SELECT t.source FROM mix_targets t LEFT JOIN sized s USING (source)
WHERE coalesce(s.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM sized)""",
}
