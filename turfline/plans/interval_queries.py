"""Queries on line-up intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turfline.operators.intervals import covered_periods, merged_and_gaps, stint_seconds, sweep
from turfline.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_and_gaps(table(spark, sf_dir, "lineups"), table(spark, sf_dir, "matches"))


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All continuous times on the pitch, merged or not."""
    keys = ["match_id", "player_id"]
    stints = stint_seconds(table(spark, sf_dir, "lineups"), table(spark, sf_dir, "matches"))
    return covered_periods(sweep(stints, keys, "start_s", "end_s"), keys)


QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods}

STINTS_SQL = r"""
clocks AS (
  SELECT match_id,
    list_filter([1,2,3,4], lambda p: list_contains(map_keys(period_end), p)) AS ps, period_start AS pst, period_end AS pen
  FROM matches),
lens AS (
  SELECT match_id, ps, pst, list_transform(ps, lambda p: CAST(round(pen[p] * 60) AS INT) - CAST(round(pst[p] * 60) AS INT)) AS len FROM clocks),
raw AS (
  SELECT DISTINCT l.match_id, l.player_id, coalesce(p.from_period, 1) AS fp, p.to_period AS tp,
    CASE WHEN regexp_matches(trim(p."from"), '^[0-9]{1,4}:[0-9]{1,2}$')
      THEN CAST(split_part(trim(p."from"), ':', 1) AS INT) * 60 + CAST(split_part(trim(p."from"), ':', 2) AS INT) END AS f,
    CASE WHEN regexp_matches(trim(p."to"), '^[0-9]{1,4}:[0-9]{1,2}$')
      THEN CAST(split_part(trim(p."to"), ':', 1) AS INT) * 60 + CAST(split_part(trim(p."to"), ':', 2) AS INT) END AS t
  FROM (SELECT match_id, player_id, unnest(positions) AS p FROM lineups) l),
timed AS (
  SELECT r.match_id, r.player_id,
    CASE WHEN list_contains(ps, fp) THEN coalesce(list_sum(len[1:fp - 1]), 0) + coalesce(f - CAST(round(pst[fp] * 60) AS INT), 0) END AS s,
    CASE WHEN t IS NULL OR tp IS NULL OR tp < fp OR tp > list_max(ps) THEN list_sum(len)
      ELSE coalesce(list_sum(len[1:tp - 1]), 0) + t - CAST(round(pst[tp] * 60) AS INT) END AS e
  FROM raw r JOIN lens USING (match_id) WHERE fp < 5),
stints AS (SELECT DISTINCT match_id, player_id, s, e FROM timed WHERE e > s),
ordered AS (
  SELECT *, max(e) OVER (PARTITION BY match_id, player_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM stints),
numbered AS (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, player_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM ordered),
islands AS (
  SELECT match_id, player_id, island, min(s) AS s, max(e) AS e, max(CASE WHEN s < pe THEN 1 ELSE 0 END) AS shared
  FROM numbered GROUP BY ALL)
"""

ORACLES = {
    "p2_found": f"""
WITH {STINTS_SQL}
SELECT match_id, player_id, 'merged' AS kind, CAST(s AS INT) AS start_s, CAST(e AS INT) AS end_s FROM islands WHERE shared = 1
UNION ALL
SELECT match_id, player_id, 'gap', CAST(pe AS INT), CAST(s AS INT) FROM (
  SELECT *, lag(e) OVER (PARTITION BY match_id, player_id ORDER BY island) AS pe FROM islands) WHERE pe IS NOT NULL
""",
    "p2_periods": f"""
WITH RECURSIVE {STINTS_SQL},
marks AS (SELECT match_id, player_id, s AS t, 1 AS d FROM stints UNION ALL SELECT match_id, player_id, e, -1 FROM stints),
active AS (
  SELECT match_id, player_id, t, sum(sum(d)) OVER (PARTITION BY match_id, player_id ORDER BY t) AS n FROM marks GROUP BY match_id, player_id, t)
SELECT i.match_id, i.player_id, CAST(i.s AS INT) AS period_start, CAST(i.e AS INT) AS period_end, CAST(max(a.n) AS BIGINT) AS most_active
FROM islands i JOIN active a ON i.match_id = a.match_id AND i.player_id = a.player_id AND a.t >= i.s AND a.t < i.e
GROUP BY i.match_id, i.player_id, i.s, i.e
""",
}
