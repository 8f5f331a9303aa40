"""Runs and islands as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: list, starts: Column, name: str = "run") -> DataFrame:
    """Numbers runs from 1 within a group: a row where `starts` holds opens a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.when(F.row_number().over(w) == 1, 1).when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return df.withColumn("__first", first).withColumn(name, F.sum("__first").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__first")


def interval_islands(df: DataFrame, keys: list[str], low: str, high: str, gap: float, order: list, name: str = "island") -> DataFrame:
    """Islands of intervals: a row opens one if it starts more than `gap` behind the largest end so far."""
    w = Window.partitionBy(*keys).orderBy(low, *order)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(low) > reach + gap), 1).otherwise(0))
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def bands(df: DataFrame, keys: list[str], order: list, full: Column, name: str = "band") -> DataFrame:
    """Vertical bands: every full-width row is its own, runs of narrow rows share one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__full", full)
    starts = F.col("__full") | F.lag("__full").over(w)
    return runs(flagged, keys, order, starts, name).drop("__full")


def counting_runs(df: DataFrame, keys: list[str], order: list, number: str, name: str = "run") -> DataFrame:
    """Runs of consecutive numbers n, n+1, ... in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return runs(df, keys, order, F.col(number) != F.lag(number).over(w) + 1, name)

