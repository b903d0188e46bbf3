"""Style and quality vectors, their reduction, and similarity to a set of rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.functions.scalars import padded, unit
from turfline.operators.blocks import best_of, in_blocks, leading
from turfline.registry import LOWER_IS_BETTER, METRIC_KEYS, VECTOR_SIZE
from turfline.session import cut


def complete_rows(stats: DataFrame, keys: Sequence[str] = tuple(sorted(METRIC_KEYS))) -> DataFrame:
    """Rows whose ``metrics`` map holds every key with a real value, the values as one array ``x`` in the order of the keys."""
    x = F.array(*[F.col("metrics")[k] for k in keys])
    return stats.withColumn("x", x).filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def scaled(rows: DataFrame, group: str = "position_group", keys: Sequence[str] = tuple(sorted(METRIC_KEYS))) -> DataFrame:
    """``x`` divided, entry by entry, by its standard deviation in the group, lower-is-better entries negated.

    The deviations are one aggregation to a row per group, not a window over its rows. A deviation of 0 counts as 1.
    """
    signs = F.array(*[F.lit(-1.0 if k in LOWER_IS_BETTER else 1.0) for k in keys])
    signed = rows.withColumn("x", F.zip_with("x", signs, lambda v, s: v * s))
    spread = signed.groupBy(group).agg(F.array(*[F.stddev_pop(F.col("x")[i]) for i in range(len(keys))]).alias("__s"))
    return signed.join(spread, group).withColumn("x", F.zip_with("x", "__s", lambda v, s: F.when(s > 0, v / s).otherwise(v))).drop("__s")


def gram(rows: DataFrame, column: str = "x") -> tuple[np.ndarray, int]:
    """Sum of the outer products of the vectors, one small matrix per task, and the number of rows."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy()).astype(np.float64)
                total = x.T @ x if total is None else total + x.T @ x
                n += len(x)
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel()], "n": [n]})

    parts = rows.select(F.col(column).alias("x")).mapInPandas(partial, "m array<double>, n long")
    each = parts.select(F.posexplode("m").alias("i", "v"), "n").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    size = round(len(each) ** 0.5)
    return np.array([r["v"] for r in each]).reshape(size, size), int(each[0]["n"]) if each else 0


def axes(rows: DataFrame, column: str = "x", size: int = VECTOR_SIZE) -> list[list[float]]:
    """The right singular vectors of the row matrix, at most min(size, rows, entries), by falling singular value.

    Each is signed so that its largest entry is positive.
    """
    matrix, n = gram(rows, column)
    if not n:
        return []
    _, vectors = np.linalg.eigh(matrix)
    v = vectors[:, ::-1][:, : min(size, n, len(matrix))]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return v.T.tolist()


def reduced(rows: DataFrame, column: str, name: str, size: int = VECTOR_SIZE) -> DataFrame:
    """Rows with ``name``: ``column`` projected on its ``axes`` and padded with zeros to ``size``."""
    basis = axes(rows, column, size)
    flat = F.array(*[F.aggregate(F.zip_with(F.col(column), F.array(*[F.lit(a) for a in axis]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for axis in basis])
    out = padded(flat, size) if basis else F.array_repeat(F.lit(0.0), size)
    return rows.withColumn(name, out.cast("array<float>"))


def player_vectors(stats: DataFrame, percentile_maps: DataFrame, keys: Sequence[str] = tuple(sorted(METRIC_KEYS)), version: str = "v1") -> DataFrame:
    """player_id, season, style_vec, quality_vec, model_version of rows with all metrics and all percentiles."""
    rows = complete_rows(stats, keys).join(percentile_maps, ["player_id", "season"])
    rows = rows.withColumn("q", F.array(*[F.col("percentiles")[k] / 100.0 for k in keys])).filter(~F.exists("q", lambda v: v.isNull()))
    rows = scaled(rows, keys=keys).select("player_id", "season", unit(F.col("x")).alias("x"), "q")
    rows = cut(rows)  # read by both reductions and the projection
    both = reduced(reduced(rows, "x", "style_vec"), "q", "quality_vec")
    return both.select("player_id", "season", "style_vec", "quality_vec", F.lit(version).alias("model_version"))


def similar_to(vectors: DataFrame, targets: DataFrame, vector: str, k: int, row: str = "player_id") -> DataFrame:
    """``target``, the columns of ``vectors``, ``similarity`` and ``place``: for each row of ``targets`` the k rows of other
    entities most similar to it, by cosine in double precision.

    ``targets`` holds ``row``, once each, and ``vector``. Null, empty and all-zero vectors, those holding NaN or null, and those
    of another length have no similarity and are left out. Similarities equal to nine digits go by ``row``, then season.
    """
    tie = [row, *[c for c in ("season",) if c in vectors.columns]]
    kind = dict(vectors.dtypes)
    keep = lambda df: df.filter((F.size(vector) > 0) & F.col(row).isNotNull())
    asked = keep(targets).select(F.col(row).alias("target"), F.col(vector).alias("v"))
    there = keep(vectors).select(*tie, F.col(vector).alias("v"))

    def matrix(column: pd.Series, size: int) -> np.ndarray:
        out = np.full((len(column), size), np.nan)
        for i, v in enumerate(column):
            if len(v) == size:
                out[i] = v
        with np.errstate(invalid="ignore", divide="ignore"):
            return out / np.sqrt((out * out).sum(axis=1))[:, None]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(tie, kind="stable").reset_index(drop=True)
        ids, size, out = b[row].to_numpy(), a["v"].map(len), []
        for length, part in a.groupby(size):
            there = matrix(b["v"], int(length)).T
            for start in range(0, len(part), 256):
                own = part.iloc[start : start + 256]
                score = np.round(matrix(own["v"], int(length)) @ there, 9)
                score[np.isnan(score) | (own["target"].to_numpy()[:, None] == ids[None, :])] = -np.inf
                i, j = leading(score, k)
                out.append([own["target"].to_numpy()[i], *[b[c].to_numpy()[j] for c in tie], score[i, j]])
        return pd.DataFrame(dict(zip(["target", *tie, "similarity"], map(np.concatenate, zip(*out)), strict=True)))

    found = in_blocks(asked, there, "target", row, compare, ", ".join([f"target {kind[row]}", *[f"{c} {kind[c]}" for c in tie], "similarity double"]))
    return best_of(found, "target", [F.desc("similarity"), *tie], k)


def earliest(vectors: DataFrame) -> DataFrame:
    """The row of every player's first season."""
    columns = [c for c in vectors.columns if c != "player_id"]
    return vectors.groupBy("player_id").agg(F.min_by(F.struct(*columns), "season").alias("__r")).select("player_id", "__r.*")
