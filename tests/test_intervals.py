import random

import pytest
from pyspark.sql import functions as F

from turfline.operators.intervals import covered_periods, gaps, merged_and_gaps, sweep

SCHEMA = "k string, s int, e int, extra string"


def brute(rows):
    """Covered periods with their largest number of active intervals, and gaps, second by second."""
    covered, empty = set(), set()
    for k in {r[0] for r in rows}:
        spans = {(s, e) for kk, s, e, _ in rows if kk == k and s is not None and e is not None and e > s}
        active = {}
        for s, e in spans:
            for t in range(s, e):
                active[t] = active.get(t, 0) + 1
        periods, start = [], None
        for t in sorted(active):
            if start is None or t != last + 1:
                if start is not None:
                    periods.append((start, last + 1))
                start = t
            last = t
        if start is not None:
            periods.append((start, last + 1))
        covered |= {(k, a, b, max(active[t] for t in range(a, b))) for a, b in periods}
        empty |= {(k, a[1], b[0]) for a, b in zip(periods, periods[1:])}
    return covered, empty


def swept(spark, rows, bucket):
    out = sweep(spark.createDataFrame(rows, SCHEMA), ["k"], "s", "e", bucket)
    return {tuple(r) for r in covered_periods(out, ["k"]).collect()}, {tuple(r) for r in gaps(out, ["k"]).collect()}


@pytest.mark.parametrize("bucket", [None, 7])
def test_random_intervals(spark, bucket):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), *(lambda s: (s, s + rng.randint(-1, 9)))(rng.randint(0, 120)), "x") for _ in range(160)]
    rows += [("c", None, 5, "x"), ("c", 3, None, "x"), ("d", 1, 4, "x"), ("d", 1, 4, "y"), ("d", 4, 6, "x")]
    assert swept(spark, rows, bucket) == brute(rows)


@pytest.mark.parametrize("bucket", [None, 7])
def test_empty_table(spark, bucket):
    assert swept(spark, [], bucket) == (set(), set())


def test_touching_nested_and_repeated_stints(spark):
    stint = "struct<position:string,`from`:string,`to`:string,from_period:int,to_period:int,start_reason:string,end_reason:string>"
    lineups = spark.createDataFrame([], f"match_id bigint, player_id int, positions array<{stint}>")
    add = lambda p, *stints: spark.createDataFrame([(1, p, [("x", *s, None, None) for s in stints])], lineups.schema)
    rows = [
        add(1, ("00:00", "45:10", 1, 1), ("45:10", None, 1, None)),  # touches: one time, not shared
        add(2, ("00:00", "60:00", 1, 2), ("10:00", "20:00", 1, 1)),  # nested
        add(3, (" 5:00 ", "10:00", None, 1), ("5:00", "10:00", 1, 1), ("50:00", "70:00", 2, 2)),  # equal stints count once, a gap
        add(4, ("00:00", "3:00", 5, 5)),  # shoot-out
        add(5, ("bad", "10:00", 1, 1), ("45:00", "50:00", 2, 1)),  # unreadable start; end period before start period
        spark.createDataFrame([(1, 6, None), (1, 7, []), (9, 1, [("x", "0:00", "1:00", 1, 1, None, None)])], lineups.schema),
    ]
    for r in rows:
        lineups = lineups.unionByName(r)
    matches = spark.createDataFrame([(1, {1: 0.0, 2: 45.0}, {1: 46.0, 2: 92.0})], "match_id bigint, period_start map<int,double>, period_end map<int,double>")
    found = {tuple(r) for r in merged_and_gaps(lineups, matches).collect()}
    assert found == {(1, 2, "merged", 0, 61 * 60), (1, 3, "gap", 600, 51 * 60), (1, 5, "gap", 600, 46 * 60)}
    again = lineups.withColumn("period_start", F.lit("clash")).withColumn("at", F.lit(1))
    assert {tuple(r) for r in merged_and_gaps(again, matches).collect()} == found
    assert merged_and_gaps(lineups.limit(0), matches).count() == 0
