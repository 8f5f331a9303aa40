"""Ordered operations over groups of any size, done in blocks.

A group (a document, a queue, a file name) may hold a large part of all rows, so it is not sorted in one task. The
order of its rows is cut into blocks by an expression that never falls along the order (a page range, an hour, a
prefix). Each block is one window; what crosses blocks (offsets, last values) comes from a table with one row for
each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(blocks: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, "__block", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(name))


def rank(df: DataFrame, keys: list[str], block: Column, order: list, name: str = "rank") -> DataFrame:
    """row_number() over each group."""
    cut = df.withColumn("__block", block)
    before = _before(cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n")), keys, "__n", "__before")
    inner = cut.withColumn("__k", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(*order)))
    return inner.join(before, [*keys, "__block"]).withColumn(name, F.col("__k") + F.col("__before")).drop("__k", "__before", "__block")


def lag(df: DataFrame, keys: list[str], block: Column, order: list[str], column: str, name: str) -> DataFrame:
    """The value of `column` in the row before, in each group."""
    cut = df.withColumn("__block", block)
    last = cut.groupBy(*keys, "__block").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("__last"))
    carried = last.select(*keys, "__block", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block")).alias("__carried"))
    w = Window.partitionBy(*keys, "__block").orderBy(*order)
    inner = cut.withColumn("__first", F.row_number().over(w) == 1).withColumn("__inner", F.lag(column).over(w))
    joined = inner.join(carried, [*keys, "__block"])
    return joined.withColumn(name, F.when(F.col("__first"), F.col("__carried.v")).otherwise(F.col("__inner"))).drop("__first", "__inner", "__carried", "__block")


def runs(df: DataFrame, keys: list[str], block: Column, order: list[str], starts: Column, name: str = "run") -> DataFrame:
    """Numbers runs from 1: the first row of a group, and every row where `starts` holds, opens one.

    `starts` reads columns of the row itself; use `lag` first to look at the row before.
    """
    cut = df.withColumn("__block", block).withColumn("__s", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0))
    before = _before(cut.groupBy(*keys, "__block").agg(F.sum("__s").alias("__n")), keys, "__n", "__before")
    w = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("__k", F.sum("__s").over(w)).join(before, [*keys, "__block"])
    return summed.withColumn(name, (F.col("__k") + F.col("__before")).cast("long")).drop("__k", "__s", "__before", "__block")


def after_first(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """True for rows behind the first row of their group where `flag` holds: one aggregate and one join, no sort."""
    first = df.where(flag).groupBy(*keys).agg(F.min(F.struct(*order)).alias("__at"))
    return df.join(first, keys, "left").withColumn(name, F.coalesce(F.struct(*order) > F.col("__at"), F.lit(False))).drop("__at")
