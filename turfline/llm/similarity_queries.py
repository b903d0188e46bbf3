"""Queries on similar players."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.llm.similarity import nearest, similar_pairs
from turfline.session import table


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "player_vectors")
    kinds = [vectors.select(F.lit(kind).alias("kind"), "player_id", "season", F.col(f"{kind}_vec").alias("v")) for kind in ("style", "quality")]
    return reduce(DataFrame.unionByName, kinds)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(vector_rows(spark, sf_dir))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked neighbours of every row."""
    out = nearest(vector_rows(spark, sf_dir))
    return out.select("kind", "player_id", "season", "rank", "other_id", "other_season", F.round("cosine", 6).alias("cosine"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}

TOP_SQL = """
WITH raw AS (SELECT DISTINCT 'style' AS vec, player_id, season, CAST(style_vec AS DOUBLE[]) AS v FROM player_vectors
  UNION ALL SELECT DISTINCT 'quality', player_id, season, CAST(quality_vec AS DOUBLE[]) FROM player_vectors),
ok AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM raw WHERE v IS NOT NULL AND len(list_filter(v, lambda x: isnan(x))) = 0 AND list_dot_product(v, v) > 0),
pairs AS (SELECT a.vec, a.player_id AS p, a.season AS s, b.player_id AS q, b.season AS t, list_dot_product(a.v, b.v) / (a.n * b.n) AS c
  FROM ok a JOIN ok b ON a.vec = b.vec AND a.player_id <> b.player_id),
top AS (SELECT *, row_number() OVER (PARTITION BY vec, p, s ORDER BY c DESC, q, t) AS r FROM pairs QUALIFY r <= 5)
"""
# the search is approximate: its rows equal those of the SQL where it visits all lists, as on small tables
ORACLES = {
    "p3_found": f"""{TOP_SQL} SELECT DISTINCT vec, least(p, q) AS player_id_a, CASE WHEN p < q THEN s ELSE t END AS season_a,
  greatest(p, q) AS player_id_b, CASE WHEN p < q THEN t ELSE s END AS season_b FROM top""",
    "p3_neighbours": f"{TOP_SQL} SELECT vec AS kind, p AS player_id, s AS season, CAST(r AS INT) AS rank, q AS other_id, t AS other_season, round(c, 6) AS cosine FROM top",
}
