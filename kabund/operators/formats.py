"""Summaries of k-mer abundances: run lengths, means, medians, coverage-filtered medians, changepoints, pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kabund.functions.sequences import plain_number
from kabund.operators.lookup import NOWHERE, STRETCH
from kabund.session import ship

ABSENT, NOT_QUERIED = "*", "/"
CELL = ["query_idx", "color_id"]


def per_count(value: Column, count: Column, to: int) -> Column:
    """value for `to` k-mers of a dataset of `count`: (value / count) * to, in that order; null where the count is 0."""
    return F.try_divide(value.cast("double"), F.when(count != 0, count.cast("double"))) * F.lit(float(to))


def symbol(ab: Column, normal: Column | None = None) -> Column:
    """Text of an abundance: * for absent, / for not queried."""
    shown = plain_number(normal) if normal is not None else ab.cast("string")
    return F.when(ab.isNull(), NOT_QUERIED).when(ab == 0, ABSENT).otherwise(shown)


def runs(ab: DataFrame, keys: tuple[str, ...] = tuple(CELL)) -> DataFrame:
    """keys, first, last, ab: maximal runs of equal values (null equals null) along pos.

    Found within stretches of positions first; then those of neighbouring stretches are joined, which is a matter of the runs alone.
    """
    stretch = F.floor(F.col("pos") / STRETCH).alias("_s")
    pieces = _islands(ab.select(*keys, stretch, F.col("pos").alias("first"), F.col("pos").alias("last"), "ab"), (*keys, "_s"))
    return _islands(pieces.select(*keys, "first", "last", "ab"), keys)


def _islands(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy("first")
    changed = F.when(F.row_number().over(along) == 1, 0).otherwise((~F.col("ab").eqNullSafe(F.lag("ab").over(along))).cast("int"))
    islands = rows.select(*keys, "first", "last", "ab", changed.alias("_c")).withColumn("_i", F.sum("_c").over(along))
    return islands.groupBy(*keys, "_i").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("ab").alias("ab")).drop("_i")


def run_length_cells(ab: DataFrame, counts: DataFrame | None = None, to: int | None = None) -> DataFrame:
    """(query_idx, color_id, cell): runs as first-last:value or first:value, comma between. Runs are of raw values, even if printed
    normalised."""
    r = runs(ab)
    normal = None
    if to is not None:  # NOWHERE has no count, and no value that is shown by one
        r = r.join(counts.select("color_id", "kmer_count"), "color_id", "left")
        normal = per_count(F.col("ab"), F.col("kmer_count"), to)
    place = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    r = r.select(*CELL, "first", F.concat(place, F.lit(":"), symbol(F.col("ab"), normal)).alias("run"))
    return r.groupBy(*CELL).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "run"))), lambda s: s["run"]), ",").alias("cell"))


def mean_cells(ab: DataFrame) -> DataFrame:
    """(query_idx, color_id, value): mean over queried k-mers, absent ones as 0; null if none was queried."""
    return ab.groupBy(*CELL).agg(F.avg("ab").alias("value"))


def median_cells(ab: DataFrame) -> DataFrame:
    """(query_idx, color_id, value): exact median over queried k-mers, absent ones as 0; null if none was queried."""
    return ab.groupBy(*CELL).agg(F.median("ab").alias("value"))


def covered_medians(ab: DataFrame, coverage_min: float) -> DataFrame:
    """(query_idx, color_id, value): median of the k-mers that are there, of cells where some are and the share of absent ones
    (of all positions, in single precision) is under coverage_min."""
    g = ab.groupBy(*CELL).agg(F.median(F.when(F.col("ab") > 0, F.col("ab"))).alias("value"), F.sum(F.when(F.col("ab") == 0, 1).otherwise(0)).alias("zeros"), F.count(F.lit(1)).alias("n"))
    share = F.col("zeros").cast("float") / F.col("n").cast("float")
    return g.where(F.col("value").isNotNull() & (share.cast("float") < F.lit(coverage_min).cast("float")) & (F.col("value") > 0)).select(*CELL, "value")


def normalised(cells: DataFrame, counts: DataFrame, to: int | None) -> DataFrame:
    """cells with value for `to` k-mers of their dataset; as they are if to is None."""
    if to is None:
        return cells
    joined = cells.join(counts.select("color_id", "kmer_count"), "color_id", "left")
    return joined.select(*CELL, F.when(F.col("color_id") == NOWHERE, F.col("value")).otherwise(per_count(F.col("value"), F.col("kmer_count"), to)).alias("value"))


def changepoints(values: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments (0 included) that make squared errors plus penalty per changepoint least. Exact, by dynamic
    programming over the last segment's start; starts that can't be best any more are pruned (Killick et al., 2012)."""
    n = len(values)
    if n == 0:
        return []
    s1 = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
    s2 = np.concatenate(([0.0], np.cumsum(np.square(values, dtype=float))))
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    came = np.zeros(n + 1, dtype=np.int64)
    starts = np.array([0])
    for end in range(1, n + 1):
        total = s1[end] - s1[starts]
        cost = best[starts] + (s2[end] - s2[starts] - total * total / (end - starts))
        k = int(cost.argmin())
        best[end], came[end] = cost[k] + penalty, starts[k]
        starts = np.append(starts[cost <= best[end] + 1e-9], end)
    out, at = [], n
    while at > 0:
        at = int(came[at])
        out.append(at)
    return out[::-1]


def changepoint_cells(ab: DataFrame, penalty: float) -> DataFrame:
    """(query_idx, color_id, cell): changepoints of each cell's abundances, comma between. A cell is one query's k-mers."""
    ship(ab.sparkSession)

    @F.pandas_udf("string")
    def of(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for a in arrays:
            yield a.map(lambda x: ",".join(map(str, changepoints(np.asarray(x, dtype=float), penalty))))

    ordered = ab.groupBy(*CELL).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ab"))), lambda s: s["ab"]).alias("values"))
    return ordered.select(*CELL, of("values").alias("cell"))


def pivot_cells(cells: DataFrame, queries: DataFrame, color_ids: list[int], value: str, missing: Column) -> DataFrame:
    """query_idx, query and a column for each dataset, named by its id (names may repeat): one aggregation, then the pivot."""
    wide = cells.groupBy("query_idx").pivot("color_id", color_ids).agg(F.first(value))
    labels = queries.select("query_idx", F.col("id").alias("query"))
    joined = labels.join(wide, "query_idx", "left")
    return joined.select("query_idx", "query", *[F.coalesce(F.col(str(c)), missing).alias(str(c)) for c in color_ids])
