"""Identity queries: market records against all players, names of aliases against those of their players."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfline.functions.scalars import percent
from turfline.functions.text import normalize_name
from turfline.operators import identity
from turfline.operators.jobs import market_records
from turfline.operators.search import entry_candidates, open_entries
from turfline.plans import binding as B
from turfline.session import table


def _market(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = market_records(B.market(spark, d)).withColumn("query_id", F.col("source_id").cast("int"))
    return records, table(spark, d, "players").select("player_id", "normalized_name", "birth_date", "nationality")


def token_set_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of every resolved alias against the name of its player."""
    players = table(spark, d, "players").select("player_id", "normalized_name")
    rows = table(spark, d, "player_aliases").select("alias_id", "player_id", "raw_name").join(players, "player_id")
    return rows.select("alias_id", F.round(identity.token_set_ratio(normalize_name(F.col("raw_name")), F.col("normalized_name")), 6).alias("score"))


def identity_outcomes(spark: SparkSession, d: str) -> DataFrame:
    queries, candidates = _market(spark, d)
    out = identity.outcomes(queries, identity.top_candidates(queries, candidates))
    return out.select("query_id", "outcome", "player_id", F.round("confidence", 6).alias("confidence"))


def identity_top5(spark: SparkSession, d: str) -> DataFrame:
    top = identity.top_candidates(*_market(spark, d))
    return top.select("query_id", "player_id", "place", F.round("score", 6).alias("score"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Records to review with the names of their candidates, best first."""
    queries, candidates = _market(spark, d)
    entries = identity.outcomes(queries, identity.top_candidates(queries, candidates)).filter("outcome = 'needs_review'").withColumnRenamed("query_id", "id")
    named = entry_candidates(entries, candidates.withColumnRenamed("normalized_name", "full_name"))
    return named.select("id", "place", "player_id", F.round("score", 6).alias("score"), F.col("full_name").alias("candidate"))


def open_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Aliases as a review queue, those of a known player being settled: the open ones with the players of the very name."""
    players = table(spark, d, "players")
    same = players.groupBy("normalized_name").agg(F.slice(F.array_sort(F.collect_list("player_id")), 1, 5).alias("ids"))
    aliases = table(spark, d, "player_aliases").withColumn("normalized_name", normalize_name(F.col("raw_name")))
    queue = aliases.join(same, "normalized_name", "left").select(
        F.col("alias_id").alias("id"), F.when(F.col("player_id").isNotNull(), F.col("created_at")).alias("resolved_at"),
        F.transform("ids", lambda i: F.struct(i.alias("playerId"), F.lit(1.0).alias("score"))).alias("candidates"),
    )
    return entry_candidates(open_entries(queue), players).select("id", "place", "player_id", "full_name", percent(F.col("score")).alias("score"))


def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten players whose names share most trigrams with that of each player whose id is divisible by 50."""
    players = table(spark, d, "players").select("player_id", "normalized_name")
    found = identity.similar_names(players, players.filter("player_id % 50 = 0"), "player_id", "normalized_name", 10)
    return found.select("query_id", "player_id", "place", F.round("similarity", 6).alias("similarity"))


QUERIES = {
    "token_set_score": token_set_score, "identity_outcomes": identity_outcomes, "identity_top5": identity_top5, "review_queue": review_queue,
    "open_reviews": open_reviews, "trigram_name_search": trigram_search,
}

ORACLES = {
    "token_set_score": f"""WITH RECURSIVE pr AS (SELECT alias_id, {B.tokens_sql(B.FOLD_SQL.format("raw_name"))} AS x, {B.tokens_sql("normalized_name")} AS y
  FROM player_aliases JOIN players USING (player_id)), nm AS (SELECT DISTINCT x, y FROM pr), {B.SCORE_SQL} SELECT alias_id, round(score, 6) AS score FROM pr JOIN ts USING (x, y)""",
    "identity_outcomes": f"""WITH RECURSIVE {B.MARKET_SQL} SELECT query_id, CASE WHEN score >= 0.92 THEN 'auto_resolved' WHEN score >= 0.6 THEN 'needs_review' ELSE 'new' END AS outcome,
  CASE WHEN score >= 0.92 THEN player_id END AS player_id, CASE WHEN score >= 0.92 THEN round(score, 6) END AS confidence FROM tp WHERE place = 1""",
    "identity_top5": f"WITH RECURSIVE {B.MARKET_SQL} SELECT query_id, player_id, CAST(place AS INT) AS place, round(score, 6) AS score FROM tp WHERE place <= 5",
    "review_queue": f"""WITH RECURSIVE {B.MARKET_SQL}, op AS (SELECT query_id FROM tp WHERE place = 1 AND score >= 0.6 AND score < 0.92)
SELECT query_id AS id, CAST(place - 1 AS INT) AS place, player_id, round(score, 6) AS score, normalized_name AS candidate FROM tp JOIN op USING (query_id) JOIN players USING (player_id) WHERE place <= 5""",
    "open_reviews": f"""WITH nm AS (SELECT player_id, full_name, normalized_name, row_number() OVER (PARTITION BY normalized_name ORDER BY player_id) - 1 AS place FROM players)
SELECT a.alias_id AS id, CAST(nm.place AS INT) AS place, nm.player_id, nm.full_name, '100 %' AS score FROM player_aliases a JOIN nm ON nm.normalized_name = trim({B.FOLD_SQL.format("a.raw_name")})
WHERE a.player_id IS NULL AND nm.place < 5""",
    "trigram_name_search": r"""WITH g AS (SELECT player_id, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce(normalized_name, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS t FROM players),
s AS (SELECT q.player_id AS query_id, g.player_id, coalesce(len(list_intersect(g.t, q.t)) / nullif(len(list_distinct(list_concat(g.t, q.t))), 0), 0) AS v FROM g, g q WHERE q.player_id % 50 = 0)
SELECT query_id, player_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY v DESC, player_id) AS INT) AS place, round(v, 6) AS similarity FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, player_id) <= 10""",
}
