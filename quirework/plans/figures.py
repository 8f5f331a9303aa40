"""Queries of captions, figures, mentions and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import cascade, folds, spatial
from ..operators import lines as L
from ..sources.tables import table
from .layout import lines, segs
from .register import query

_CAP = "'(?i)^\\s*(fig(?:ure)?\\.?|table)\\s*([0-9]+)'"
_SEG = "(SELECT DISTINCT doc_id, page, seg_id, kind, source, translated, status, bbox FROM segments)"
_CAPS = f"""caps AS (SELECT doc_id, page, seg_id, source, CASE WHEN lower(regexp_extract(source, {_CAP}, 1)) LIKE 't%' THEN 'table-' ELSE 'figure-' END || regexp_extract(source, {_CAP}, 2) AS key,
  regexp_matches(source, '(?i)^\\s*(?:fig(?:ure)?\\.?|table)\\s*[0-9]+\\s*[.:]') AS strong, CAST(regexp_extract(seg_id, '_s([0-9]+)$', 1) AS INT) AS idx FROM {_SEG} WHERE kind = 'caption' AND regexp_matches(source, {_CAP}))"""


def captions(spark: SparkSession, d: str) -> DataFrame:
    return segs(spark, d).where("kind = 'caption'").withColumn("key", X.caption_key(F.col("source"))).where("key IS NOT NULL").withColumn("ordinal", F.col("idx"))


@query(f"""WITH {_CAPS} SELECT doc_id, key, seg_id, strong FROM caps QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY strong DESC, page, idx) = 1""")
def chosen_captions(spark: SparkSession, d: str) -> DataFrame:
    """The caption of each key; one with a mark behind its number beats others, then the first. The SQL knows decimal numbers only."""
    c = captions(spark, d).withColumn("strong", F.col("source").rlike(f"{X.CAPTION}\\s*[.:]"))
    w = Window.partitionBy("doc_id", "key").orderBy(F.col("strong").desc(), "page", "idx")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("doc_id", "key", "seg_id", "strong")


@query(f"""WITH m AS (SELECT doc_id, seg_id, unnest(regexp_extract_all(source, '(?i)\\b(?:figure|fig\\.) ([0-9]+)', 1)) AS num, 'original' AS side FROM {_SEG} WHERE kind = 'body'
  UNION ALL SELECT doc_id, seg_id, unnest(regexp_extract_all(translated, '그림 ([0-9]+)', 1)), 'translated' FROM {_SEG} WHERE kind = 'body' AND translated IS NOT NULL)
SELECT doc_id, 'figure-' || num AS key, side, count(*) AS n FROM m GROUP BY ALL""")
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of every figure on both sides."""
    s = table(spark, d, "segments").select("doc_id", "seg_id", "kind", "source", "translated").distinct().where("kind = 'body'")
    a = s.select("doc_id", F.explode(F.regexp_extract_all("source", F.lit("(?i)\\b(?:figure|fig\\.) ([0-9]+)"), F.lit(1))).alias("num"), F.lit("original").alias("side"))
    b = s.where("translated IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("translated", F.lit("그림 ([0-9]+)"), F.lit(1))).alias("num"), F.lit("translated").alias("side"))
    return a.unionByName(b).groupBy("doc_id", F.concat(F.lit("figure-"), "num").alias("key"), "side").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT doc_id, CAST(regexp_extract(source, '^\\s*\\[([0-9]+)\\]', 1) AS INT) AS num, min(source) AS entry FROM {_SEG} WHERE kind = 'reference' AND regexp_matches(source, '^\\s*\\[[0-9]+\\]') GROUP BY ALL),
c AS (SELECT doc_id, seg_id, CAST(unnest(regexp_extract_all(source, '\\[([0-9]+)\\]', 1)) AS INT) AS num FROM {_SEG} WHERE kind = 'body')
SELECT doc_id, num, count(*) AS n_cited, min(entry) AS entry FROM c LEFT JOIN r USING (doc_id, num) GROUP BY ALL""")
def cited_entries(spark: SparkSession, d: str) -> DataFrame:
    """Citations with their bibliography entry, if there is one."""
    s = table(spark, d, "segments").select("doc_id", "page", "seg_id", "kind", "source", "translated", "status", "bbox").distinct()
    r = s.where("kind = 'reference'").where(F.col("source").rlike("^\\s*\\[[0-9]+\\]")).groupBy("doc_id", F.regexp_extract("source", "^\\s*\\[([0-9]+)\\]", 1).cast("int").alias("num")).agg(F.min("source").alias("entry"))
    c = s.where("kind = 'body'").select("doc_id", F.explode(F.regexp_extract_all("source", F.lit("\\[([0-9]+)\\]"), F.lit(1))).alias("num")).withColumn("num", F.col("num").cast("int"))
    n = c.groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n_cited"))
    return n.join(r, ["doc_id", "num"], "left")


@query("""WITH RECURSIVE t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS INT)) AS nums FROM documents WHERE doc_kind = 'bibliography' AND text IS NOT NULL),
f AS (SELECT doc_id, nums, 1 AS pos, 1 AS nxt FROM t UNION ALL SELECT doc_id, nums, pos + 1, nxt + CASE WHEN nums[pos] = nxt THEN 1 ELSE 0 END FROM f WHERE pos <= len(nums))
SELECT doc_id, CAST(max(nxt) - 1 AS INT) AS n_entries FROM f GROUP BY doc_id""")
def reference_chains(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose number continues the chain 1, 2, 3, ..."""
    t = table(spark, d, "documents").where("doc_kind = 'bibliography' AND text IS NOT NULL")
    return t.select("doc_id", F.size(folds.reference_chain(F.col("text"))).alias("n_entries"))


@query()
def figure_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The graphic region of every caption."""
    g = segs(spark, d).where(F.col("kind").isin("figure_text", "formula", "algorithm"))
    return folds.claim_figures(captions(spark, d), g)


@query()
def text_tables(spark: SparkSession, d: str) -> DataFrame:
    """Regions of text tables under their captions, else above them."""
    shaped = lines(spark, d).withColumn("heading", F.col("text").rlike(X.HEAD_PREFIX) & X.caps_only(F.col("text"))).join(cascade.line_cells(table(spark, d, "spans")), L.LINE)
    return folds.table_regions(captions(spark, d).where(F.col("key").startswith("table")), shaped)


_BOX = "CAST(from_json(bbox, '[\"DOUBLE\"]') AS DOUBLE[])"


@query(f"""WITH b AS (SELECT doc_id, page, seg_id, kind, {_BOX} AS b FROM {_SEG}), m AS (SELECT doc_id, page, seg_id, kind, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1 FROM b)
SELECT a.doc_id, a.seg_id FROM m a WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = a.doc_id AND o.page = a.page AND o.kind = a.kind AND abs(o.x0 - a.x0) <= 1.5 AND abs(o.y0 - a.y0) <= 2.0 AND o.x1 > a.x1 + 0.5)""")
def unshadowed(spark: SparkSession, d: str) -> DataFrame:
    """Boxes without a longer one that starts at the same place."""
    s = segs(spark, d).select("doc_id", "page", "seg_id", "kind", "b")
    return spatial.not_shadowed(s, ["seg_id"], ["kind"]).select("doc_id", "seg_id")


@query(f"""SELECT count(*) AS n, count(*) FILTER (b[3] > b[1] AND b[4] > b[2]) AS n_solid, min(b[1]) AS x0, max(b[4]) AS y1 FROM (SELECT {_BOX} AS b FROM {_SEG})""")
def box_json(spark: SparkSession, d: str) -> DataFrame:
    """Boxes read from JSON."""
    b = segs(spark, d)
    return b.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(G.area(F.col("b")) > 0, 1).otherwise(0)).alias("n_solid"), F.min("x0").alias("x0"), F.max("y1").alias("y1"))


@query(f"""WITH h AS (SELECT doc_id, page, seg_id, source, {_BOX} AS b FROM {_SEG} WHERE page = 0 AND kind <> 'header_footer'), t AS (SELECT doc_id, max(b[4] - b[2]) AS tall FROM h GROUP BY doc_id)
SELECT doc_id, arg_min(seg_id, seg_id) AS title_seg FROM h JOIN t USING (doc_id) WHERE b[4] - b[2] = tall GROUP BY doc_id""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """O5, and the title that C3 starts from: the tallest box of the first page."""
    h = segs(spark, d).where("page = 0 AND kind <> 'header_footer'").withColumn("tall", F.col("y1") - F.col("y0"))
    t = h.groupBy("doc_id").agg(F.max("tall").alias("most"))
    return h.join(t, "doc_id").where("tall = most").groupBy("doc_id").agg(F.min("seg_id").alias("title_seg"))


@query()
def author_lists(spark: SparkSession, d: str) -> DataFrame:
    """texts that are a bare list of names, particles and affiliation marks allowed."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", cascade.author_list(F.col("text")).alias("is_author_list"))


@query(f"""WITH f AS (SELECT doc_id, page, count(*) AS n_lines FROM (SELECT DISTINCT doc_id, page, line_no FROM ocr_lines) GROUP BY ALL), p AS (SELECT DISTINCT doc_id, page, ocr FROM layout_pages),
s AS (SELECT doc_id, page, sum(length(coalesce(text, ''))) AS n_chars FROM (SELECT DISTINCT * FROM spans) GROUP BY ALL)
SELECT doc_id, page, coalesce(n_chars, 0) <= 40 AS few_signs, coalesce(n_lines, 0) AS n_lines, ocr FROM p LEFT JOIN f USING (doc_id, page) LEFT JOIN s USING (doc_id, page)""")
def scanned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with whether it has next to no text of its own, and its scanned lines. Images are in no table, so their cover is not asked."""
    p = table(spark, d, "layout_pages").select("doc_id", "page", "ocr").distinct()
    f = table(spark, d, "ocr_lines").select("doc_id", "page", "line_no").distinct().groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"))
    s = table(spark, d, "spans").distinct().groupBy("doc_id", "page").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))
    return p.join(f, ["doc_id", "page"], "left").join(s, ["doc_id", "page"], "left").select("doc_id", "page", (F.coalesce("n_chars", F.lit(0)) <= 40).alias("few_signs"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "ocr")


@query("""SELECT doc_id, page, line_no, text, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, line_no, text) AS place FROM (SELECT DISTINCT * FROM ocr_lines) JOIN (SELECT DISTINCT doc_id, page, height FROM layout_pages) USING (doc_id, page)
WHERE score >= 0.5 AND y1 > height * 0.06 AND y0 < height * (1 - 0.06::DOUBLE)""")
def usable_scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines read with a score of a half at least, outside the outer 6 % of the page, in reading order."""
    o = L.with_page(table(spark, d, "ocr_lines").distinct(), table(spark, d, "layout_pages"))
    kept = o.where((F.col("score") >= 0.5) & (F.col("y1") > F.col("height") * 0.06) & (F.col("y0") < F.col("height") * (1 - 0.06)))
    return kept.select("doc_id", "page", "line_no", "text", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "line_no", "text")).cast("long").alias("place"))
