"""Joins of boxes. All have document and page as equi-keys, so only boxes of one page meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

PAGE = ["doc_id", "page"]


def _pairs(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Items (key columns and a box `b`) with regions (region_no, a box `rb`) of their page."""
    return items.join(regions, PAGE)


def best_region(items: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Each item with the region it overlaps most and the share it covers; of equal ones the first; null if none."""
    met = _pairs(items, regions).where(G.intersects(F.col("b"), F.col("rb"))).withColumn("inter", G.intersection(F.col("b"), F.col("rb")))
    best = met.groupBy(*PAGE, *key).agg(F.max_by(F.struct("region_no", "inter"), F.struct("inter", -F.col("region_no"))).alias("best"))
    share = F.when(G.area(F.col("b")) > 0, F.col("best.inter") / G.area(F.col("b"))).otherwise(0.0)
    return items.join(best, [*PAGE, *key], "left").select(*PAGE, *key, F.col("best.region_no").alias("region_no"), F.coalesce(share, F.lit(0.0)).alias("share"))


def nearest_region(items: DataFrame, regions: DataFrame, key: list[str], reach: float = 1.5) -> DataFrame:
    """Each item with the vertically nearest region within `reach` item heights and half the item's width; of equal ones the last."""
    b, rb = F.col("b"), F.col("rb")
    gap = F.greatest(rb["y0"] - b["y1"], b["y0"] - rb["y1"], F.lit(0.0))
    near = _pairs(items, regions).withColumn("gap", gap).where((G.x_overlap(b, rb) >= 0.5 * (b["x1"] - b["x0"])) & (F.col("gap") <= F.greatest(b["y1"] - b["y0"], F.lit(1.0)) * reach))
    return near.groupBy(*PAGE, *key).agg(F.min_by(F.struct("region_no", "gap"), F.struct("gap", -F.col("region_no"))).alias("n")).select(*PAGE, *key, F.col("n.region_no").alias("region_no"), F.col("n.gap").alias("gap"))


def region_key(items: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """The region each item overlaps most if it covers half of it, else the nearest one, else -1."""
    best = best_region(items, regions, key).select(*PAGE, *key, F.when(F.col("share") >= 0.5, F.col("region_no")).alias("a"))
    near = nearest_region(items, regions, key).select(*PAGE, *key, F.col("region_no").alias("c"))
    return best.join(near, [*PAGE, *key], "left").select(*PAGE, *key, F.coalesce("a", "c", F.lit(-1)).alias("region_key"))


def first_holding(items: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Each item with the first region that holds its centre; null if none."""
    held = _pairs(items, regions).where(G.centre_inside(F.col("b"), F.col("rb"))).groupBy(*PAGE, *key).agg(F.min("region_no").alias("region_no"))
    return items.select(*PAGE, *key).join(held, [*PAGE, *key], "left")


def smallest_enclosing(items: DataFrame, regions: DataFrame, key: list[str], share: float = 0.5) -> DataFrame:
    """Each item with the smallest region around its centre that covers `share` of its width."""
    b, rb = F.col("b"), F.col("rb")
    around = _pairs(items, regions).where(G.centre_y(b).between(rb["y0"], rb["y1"]) & (G.x_overlap(b, rb) >= share * (b["x1"] - b["x0"])))
    return around.groupBy(*PAGE, *key).agg(F.min_by("region_no", F.struct(G.area(rb), F.col("region_no"))).alias("region_no"))


def with_centre_in(items: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """The items whose centre lies in any region (semi-join)."""
    held = _pairs(items, regions).where(G.centre_inside(F.col("b"), F.col("rb"))).select(*PAGE, *key).distinct()
    return items.join(held, [*PAGE, *key], "left_semi")


def outside(items: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """The items whose centre lies in no region (anti-join)."""
    held = _pairs(items, regions).where(G.centre_inside(F.col("b"), F.col("rb"))).select(*PAGE, *key).distinct()
    return items.join(held, [*PAGE, *key], "left_anti")


def not_shadowed(mentions: DataFrame, key: list[str], same: list[str], dx: float = 1.5, dy: float = 2.0) -> DataFrame:
    """Mentions without a longer one of the same kind that starts at the same place."""
    other = mentions.select(*PAGE, *same, F.col("b").alias("ob"))
    b, ob = F.col("b"), F.col("ob")
    hidden = mentions.join(other, [*PAGE, *same]).where((F.abs(ob["x0"] - b["x0"]) <= dx) & (F.abs(ob["y0"] - b["y0"]) <= dy) & (ob["x1"] > b["x1"] + 0.5)).select(*PAGE, *key).distinct()
    return mentions.join(hidden, [*PAGE, *key], "left_anti")


def zip_by_order(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list) -> DataFrame:
    """Pairs the k-th row of one side with the k-th of the other in each group; surplus rows of either side stay."""
    lw, rw = Window.partitionBy(*keys).orderBy(*left_order), Window.partitionBy(*keys).orderBy(*right_order)
    return left.withColumn("k", F.row_number().over(lw)).join(right.withColumn("k", F.row_number().over(rw)), [*keys, "k"], "full")
