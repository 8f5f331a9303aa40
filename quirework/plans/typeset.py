"""Queries of layout planning: shared scales, leading, fit, widening and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import lines as L
from ..sources.tables import table
from .layout import segs
from .register import query

_BOX = "CAST(from_json(bbox, '[\"DOUBLE\"]') AS DOUBLE[])"
_NEED = f"""base AS (SELECT doc_id, page, seg_id, kind, translated, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1 FROM (SELECT *, {_BOX} AS b FROM (SELECT DISTINCT doc_id, page, seg_id, kind, translated, bbox FROM segments WHERE translated IS NOT NULL AND length(translated) > 0))),
need AS (SELECT *, ((x1 - x0) * (y1 - y0)) / (length(translated) * 81.0::DOUBLE) AS need FROM base)"""


def needs(spark: SparkSession, d: str) -> DataFrame:
    """The share of its room a translation may take: box area over the area of its signs at 9 pt (the width model)."""
    t = table(spark, d, "segments").where("translated IS NOT NULL").where(F.length("translated") > 0).select("doc_id", "page", "seg_id", "kind", "translated", "bbox").distinct()
    b = t.withColumn("b", G.parse_box(F.col("bbox"))).select("*", "b.x0", "b.y0", "b.x1", "b.y1")
    return b.withColumn("need", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / (F.length("translated") * F.lit(81.0)))


@query(f"""WITH {_NEED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY need DESC, seg_id) AS k, count(*) OVER (PARTITION BY doc_id, kind) AS n FROM need)
SELECT doc_id, kind, least(1.0::DOUBLE, greatest(0.65::DOUBLE, need)) AS scale FROM r WHERE k = ceil(0.97::DOUBLE * n)""")
def style_scales(spark: SparkSession, d: str) -> DataFrame:
    """A5, R2: one scale for each style, by the 97th percentile of need."""
    w = Window.partitionBy("doc_id", "kind")
    r = needs(spark, d).withColumn("k", F.row_number().over(w.orderBy(F.col("need").desc(), "seg_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.where(F.col("k") == F.ceil(F.lit(0.97) * F.col("n"))).select("doc_id", "kind", F.least(F.lit(1.0), F.greatest(F.lit(0.65), F.col("need"))).alias("scale"))


@query(f"WITH {_NEED} SELECT doc_id, coalesce(min(CASE WHEN need >= 0.9::DOUBLE THEN need END), 0.9::DOUBLE) AS body_scale FROM need WHERE kind = 'body' GROUP BY doc_id")
def body_scales(spark: SparkSession, d: str) -> DataFrame:
    """The smallest fair fit of a document's texts."""
    return needs(spark, d).where("kind = 'body'").groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("need") >= 0.9, F.col("need"))), F.lit(0.9)).alias("body_scale"))


def _ladder(need: Column) -> Column:
    return F.when(need >= 1.25, "1.25").when(need >= 1.15, "1.15").when(need >= 1.04, "1.04").when(need >= 0.65, "shrink").when(need >= 0.35, "expand").otherwise("overflow")


@query(f"""WITH {_NEED} SELECT doc_id, seg_id, CASE WHEN need >= 1.25 THEN '1.25' WHEN need >= 1.15 THEN '1.15' WHEN need >= 1.04 THEN '1.04' WHEN need >= 0.65 THEN 'shrink' WHEN need >= 0.35 THEN 'expand' ELSE 'overflow' END AS step FROM need""")
def fit_steps(spark: SparkSession, d: str) -> DataFrame:
    """The first leading that fits, else shrinking, expanding and overflow."""
    return needs(spark, d).select("doc_id", "seg_id", _ladder(F.col("need")).alias("step"))


@query(f"""WITH {_NEED} SELECT doc_id, count(*) AS n, count(*) FILTER (need < 0.35) AS n_overflow, count(*) FILTER (need < 1) AS n_scaled, min(x0) AS x0, max(y1) AS y1 FROM need GROUP BY doc_id""")
def placement_report(spark: SparkSession, d: str) -> DataFrame:
    """Overflowing and scaled texts of each document."""
    c = lambda x: F.count(F.when(x, 1))
    return needs(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), c(F.col("need") < 0.35).alias("n_overflow"), c(F.col("need") < 1).alias("n_scaled"), F.min("x0").alias("x0"), F.max("y1").alias("y1"))


_STEPS = "".join(f", s{k + 1} AS (SELECT doc_id, seg_id, chars, room, CASE WHEN ((lo + hi) / 2) * ((lo + hi) / 2) * chars <= room THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN ((lo + hi) / 2) * ((lo + hi) / 2) * chars <= room THEN hi ELSE (lo + hi) / 2 END AS hi FROM s{k})" for k in range(7))


@query(f"WITH {_NEED}, s0 AS (SELECT doc_id, seg_id, length(translated) * 81.0::DOUBLE AS chars, (x1 - x0) * (y1 - y0) AS room, 0.3::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM need){_STEPS} SELECT doc_id, seg_id, CASE WHEN chars <= room THEN 1.0::DOUBLE ELSE lo END AS scale FROM s7")
def fitted_scales(spark: SparkSession, d: str) -> DataFrame:
    """M4: the largest scale that fits, by seven halvings."""
    n = needs(spark, d)
    return n.select("doc_id", "seg_id", G.largest_fit(F.length("translated") * F.lit(81.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("scale"))


@query(f"""WITH b AS (SELECT doc_id, page, seg_id, kind, {_BOX} AS b FROM (SELECT DISTINCT doc_id, page, seg_id, kind, bbox FROM segments)), s AS (SELECT doc_id, page, seg_id, kind, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1 FROM b),
c AS (SELECT doc_id, page, x0 > 306 AS side, max(x1) AS edge FROM s GROUP BY ALL)
SELECT h.doc_id, h.seg_id, CASE WHEN EXISTS (SELECT 1 FROM s o WHERE o.doc_id = h.doc_id AND o.page = h.page AND o.seg_id <> h.seg_id AND least(o.y1, h.y1) > greatest(o.y0, h.y0) AND o.x1 > h.x1 AND o.x0 < edge AND o.x0 >= h.x1) THEN h.x1 ELSE edge END AS widened
FROM s h JOIN c ON h.doc_id = c.doc_id AND h.page = c.page AND (h.x0 > 306) = c.side WHERE h.kind = 'heading'""")
def widened_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings widened to the column's right edge where nothing stands there."""
    s = segs(spark, d).withColumn("side", F.col("x0") > 306)
    c = s.groupBy("doc_id", "page", "side").agg(F.max("x1").alias("edge"))
    h = s.where("kind = 'heading'").join(c, ["doc_id", "page", "side"])
    o = s.select("doc_id", "page", F.col("seg_id").alias("oid"), F.col("x0").alias("ox0"), F.col("y0").alias("oy0"), F.col("x1").alias("ox1"), F.col("y1").alias("oy1"))
    hit = h.join(o, ["doc_id", "page"]).where("oid <> seg_id AND least(oy1, y1) > greatest(oy0, y0) AND ox1 > x1 AND ox0 < edge AND ox0 >= x1").select("doc_id", "page", "seg_id").distinct().withColumn("hit", F.lit(True))
    return h.join(hit, ["doc_id", "page", "seg_id"], "left").select("doc_id", "seg_id", F.when(F.col("hit"), F.col("x1")).otherwise(F.col("edge")).alias("widened"))


@query("""WITH p AS (SELECT DISTINCT doc_id, page, width, height FROM layout_pages)
SELECT doc_id, page, width * 150 / 72 AS width_px, height * 150 / 72 AS height_px, CASE WHEN height - 600 <= 0 THEN 0.0::DOUBLE ELSE 96.0::DOUBLE / (height - 600) * greatest(height * 2 - 600, 0.0) END AS scroll FROM p""")
def page_pixels(spark: SparkSession, d: str) -> DataFrame:
    """M6, M7: pages in pixels at 150 dpi, and the proportional scroll position in a second view."""
    p = table(spark, d, "layout_pages").select("doc_id", "page", "width", "height").distinct()
    return p.select("doc_id", "page", (F.col("width") * 150 / 72).alias("width_px"), (F.col("height") * 150 / 72).alias("height_px"), G.scroll_to(F.lit(96.0), F.col("height"), F.lit(600), F.col("height") * 2, F.lit(600)).alias("scroll"))


@query("""WITH s AS (SELECT DISTINCT doc_id, page, block_no, line_no, span_no, size, x0, y0, x1, y1 FROM spans)
SELECT doc_id, page, block_no, line_no, span_no, floor(size * 2 + 0.5) / 2 AS half_size, floor(x0 * 10 + 0.5) / 10 AS x0, floor(y0 * 10 + 0.5) / 10 AS y0 FROM s""")
def rounded_sizes(spark: SparkSession, d: str) -> DataFrame:
    """M1: sizes to the nearest half, boxes to a tenth, halves up."""
    s = table(spark, d, "spans").select(*L.LINE, "span_no", "size", "x0", "y0", "x1", "y1").distinct()
    up = lambda c, k: F.floor(F.col(c) * k + 0.5) / k
    return s.select(*L.LINE, "span_no", up("size", 2).alias("half_size"), up("x0", 10).alias("x0"), up("y0", 10).alias("y0"))
