"""Best representative of each duplicate group by currency reasoning.

Values are put into classes of bounded number. From groups whose rows carry timestamps the operator learns which class
tends to replace which; within a group, timestamps order the timed rows and the learned precedence orders the untimed
ones, and a topologically latest class survives.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfline.registry import POSITION_LABELS


#: Most classes of a field; their precedence is closed on the driver.
MOST_CLASSES = 256


class Field(NamedTuple):
    real: Column  # whether the row's value is real
    kind: Column  # class of a real value, of bounded number
    value: Column  # the value as text


def player_fields() -> dict[str, Field]:
    """The surviving fields of players: value range, contract range and position groups bound the number of classes."""
    value, until, position = F.col("market_value_eur"), F.col("contract_until"), F.upper(F.trim("position_group"))
    return {
        "market_value_eur": Field(value.between(25_000, 500_000_000), F.floor(F.log2(value.cast("double"))).cast("string"), value.cast("string")),
        "contract_until": Field(F.year(until).between(2015, 2040), F.year(until).cast("string"), until.cast("string")),
        "position_group": Field(position.isin(list(POSITION_LABELS)), position, position),
    }


def followers(pairs: Iterable[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Field, class and newer class of every pair that the learned (field, class, newer) order directly or through others;
    classes that follow each other both ways are in no order."""
    after: dict[tuple[str, str], set[str]] = {}
    for field, old, new in pairs:
        after.setdefault((field, old), set()).add(new)
    reach: dict[tuple[str, str], set[str]] = {}
    for field, start in after:
        seen: set[str] = set()
        todo = [start]
        while todo:
            for new in after.get((field, todo.pop()), set()) - seen:
                seen.add(new)
                todo.append(new)
        reach[field, start] = seen
    return sorted((field, old, new) for (field, old), newer in reach.items() for new in newer if old not in reach.get((field, new), ()))


def survivors(
    rows: DataFrame, group: str, row: str, updated: str, fields: Mapping[str, Field], support: int = 5, share: float = 0.6
) -> DataFrame:
    """One row per group and field with a real value: ``group``, ``field``, ``row`` (where the value is taken), ``value``.

    Where all real rows of a group and field carry a timestamp, the latest wins (equal times: the smaller row id). Where
    some carry none, the latest timed class and the untimed classes compete: a class loses if another of them is learned
    to follow it (seen in at least ``support`` groups and in ``share`` of those with both), directly or through classes
    that the group lacks; among the topologically latest a timed class, then the one of more rows, then the smallest row id
    wins. Classes that follow each other in a cycle are in no order. More than ``MOST_CLASSES`` classes of a field are an error. Null ids or groups, and rows
    whose value isn't real, take no part; a row repeated counts once; extra columns are ignored.

    A group of any size is reduced to its classes by partial aggregation before anything is paired.
    """
    each = F.array(*[
        F.when(f.real, F.struct(F.lit(name).alias("field"), f.kind.alias("kind"), f.value.alias("value"))) for name, f in fields.items()
    ])
    long = (
        rows.filter(F.col(group).isNotNull() & F.col(row).isNotNull())
        .select(F.col(group).alias("g"), F.col(row).alias("r"), F.col(updated).alias("ts"), F.explode(each).alias("f"))
        .filter(F.col("f").isNotNull() & F.col("f.kind").isNotNull())
        .select("g", "r", "ts", "f.field", "f.kind", "f.value")
        .distinct()
    )
    timed = F.col("ts").isNotNull()
    kinds = long.groupBy("g", "field", "kind").agg(
        F.max("ts").alias("ts"),
        F.max(F.when(timed, F.struct("ts", (-F.col("r")).alias("neg"), "value"))).alias("best"),
        F.min(F.when(~timed, F.struct("r", "value"))).alias("plain"),
        F.count("*").alias("n"),
    )
    # learned precedence: bounded by the classes of a field
    timed_kinds = kinds.filter(timed).select("g", "field", "kind", "ts")
    later = timed_kinds.select("g", "field", F.col("kind").alias("newer"), F.col("ts").alias("newer_ts"))
    seen = timed_kinds.join(later, ["g", "field"]).filter("newer_ts > ts").groupBy("field", "kind", "newer").agg(F.count("*").alias("n"))
    back = seen.select("field", F.col("newer").alias("kind"), F.col("kind").alias("newer"), F.col("n").alias("m"))
    learned = (
        seen.join(back, ["field", "kind", "newer"], "left")
        .filter((F.col("n") >= support) & (F.col("n") >= share * (F.col("n") + F.coalesce("m", F.lit(0)))))
        .select("field", "kind", "newer")
    )
    bound = len(fields) * MOST_CLASSES**2
    direct = learned.limit(bound + 1).collect()
    if len(direct) > bound:
        raise ValueError(f"more than {MOST_CLASSES} classes of a field")
    learned = F.broadcast(rows.sparkSession.createDataFrame(followers(map(tuple, direct)), "field string, kind string, newer string"))
    # per group: the latest timed class and all untimed ones
    per = kinds.groupBy("g", "field").agg(
        F.max("best").alias("top"), F.max_by("kind", "best").alias("top_kind"), F.max(F.col("plain").isNotNull()).alias("mixed")
    )
    plain = per.filter("not mixed").select("g", "field", (-F.col("top.neg")).alias("r"), F.col("top.value").alias("value"))
    mixed = kinds.join(per.filter("mixed"), ["g", "field"]).filter(F.col("plain").isNotNull() | (F.col("kind") == F.col("top_kind")))
    is_top = F.coalesce(F.col("kind") == F.col("top_kind"), F.lit(False))
    rivals = mixed.select(
        "g", "field", "kind", "n", is_top.alias("timed"),
        F.when(is_top, -F.col("best.neg")).otherwise(F.col("plain.r")).alias("r"),
        F.when(is_top, F.col("best.value")).otherwise(F.col("plain.value")).alias("value"),
    )
    beaten = (
        rivals.select("g", "field", "kind").join(rivals.select("g", "field", F.col("kind").alias("newer")), ["g", "field"])
        .filter("kind <> newer").join(learned, ["field", "kind", "newer"], "left_semi").select("g", "field", "kind").distinct()
    )
    ranked = rivals.join(beaten.withColumn("beaten", F.lit(True)), ["g", "field", "kind"], "left").groupBy("g", "field").agg(
        F.min(F.struct(F.coalesce("beaten", F.lit(False)).alias("b"), (~F.col("timed")).alias("u"), (-F.col("n")).alias("c"), "r", "value")).alias("x")
    )
    both = plain.unionByName(ranked.select("g", "field", "x.r", "x.value"))
    return both.select(F.col("g").alias(group), "field", F.col("r").alias(row), "value")
