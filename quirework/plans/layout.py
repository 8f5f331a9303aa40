"""Queries of the layout operators, on spans, pages and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import blocks, cascade, folds, islands, spatial
from ..operators import lines as L
from ..sources.tables import table
from .register import query

PAGE_BLOCK = 256  # pages of a document ordered in one window

_SPANS = "(SELECT DISTINCT ON (doc_id, page, block_no, line_no, span_no) * FROM spans)"
_LINES = f"""lines AS (SELECT doc_id, page, block_no, line_no, string_agg(coalesce(text, ''), '' ORDER BY span_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {_SPANS} GROUP BY ALL)"""
_PAGES = "pages AS (SELECT DISTINCT doc_id, page, width, height FROM layout_pages)"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_BOX = "CAST(from_json(bbox, '[\"DOUBLE\"]') AS DOUBLE[])"
_SEGB = f"""segs AS (SELECT doc_id, page, seg_id, kind, source, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1, CAST(regexp_extract(seg_id, '_s([0-9]+)$', 1) AS INT) AS idx
  FROM (SELECT *, {_BOX} AS b FROM (SELECT DISTINCT doc_id, page, seg_id, kind, source, bbox FROM segments)))"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spans")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines_of(spans(spark, d))


def paged(spark: SparkSession, d: str) -> DataFrame:
    return L.with_page(lines(spark, d), table(spark, d, "layout_pages"))


def segs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").select("doc_id", "page", "seg_id", "kind", "source", "bbox").distinct()
    return s.withColumn("b", G.parse_box(F.col("bbox"))).withColumn("idx", F.regexp_extract("seg_id", "_s([0-9]+)$", 1).cast("int")).select("*", "b.x0", "b.y0", "b.x1", "b.y1")


@query(f"WITH {_LINES} SELECT * FROM lines")
def line_boxes(spark: SparkSession, d: str) -> DataFrame:
    """F32, A4: text and union box of every line."""
    return lines(spark, d).select(*L.LINE, "text", "x0", "y0", "x1", "y1")


@query(f"""SELECT doc_id, page, block_no, line_no, span_no,
  regexp_matches(upper(coalesce(font, '')), 'CMMI|CMSY|CMEX|MTMI|MTSY|MTEX|BLEX|MSAM|MSBM') OR (contains(upper(coalesce(font, '')), 'MATH') AND NOT contains(regexp_extract(regexp_replace(upper(coalesce(font, '')), '^.*\\+', ''), '^[^-]*-(.*)$', 1), 'ROMAN')) AS math,
  regexp_full_match(regexp_replace(coalesce(text, ''), '\\s', '', 'g'), '[0-9.,;:!?()\\[\\]{{}}|/\\\\%=<>+±−×÷·∗*≤≥≈≃≅∼~≠≲≳•◦▪]{{1,2}}') AS literal,
  regexp_full_match(regexp_replace(coalesce(text, ''), '\\s', '', 'g'), '\\p{{L}}') AND size >= 20 AS drop_cap,
  (flags & 16) > 0 OR regexp_matches(lower(coalesce(font, '')), 'bold|black|heavy') AS bold, (flags & 2) > 0 OR regexp_matches(lower(coalesce(font, '')), 'ital|obli') AS italic FROM {_SPANS}""")
def span_styles(spark: SparkSession, d: str) -> DataFrame:
    """math fonts, literals, drop caps, bold and italic spans."""
    s = spans(spark, d).dropDuplicates([*L.LINE, "span_no"])
    t, f, z, g = (F.col(c) for c in ("text", "font", "size", "flags"))
    return s.select(*L.LINE, "span_no", L.math_font(f).alias("math"), L.literal(t).alias("literal"), L.drop_cap(t, z).alias("drop_cap"), L.bold(f, g).alias("bold"), L.italic(f, g).alias("italic"))


@query(f"""WITH s AS (SELECT *, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS n, (flags & 16) > 0 OR regexp_matches(lower(coalesce(font, '')), 'bold|black|heavy') AS bold,
  (flags & 2) > 0 OR regexp_matches(lower(coalesce(font, '')), 'ital|obli') AS italic FROM {_SPANS})
SELECT doc_id, page, block_no, line_no, sum(n) > 0 AND sum(CASE WHEN bold THEN n ELSE 0 END) >= 0.6 * sum(n) AS is_bold, sum(n) > 0 AND sum(CASE WHEN italic THEN n ELSE 0 END) >= 0.6 * sum(n) AS is_italic FROM s GROUP BY ALL""")
def line_styles(spark: SparkSession, d: str) -> DataFrame:
    """lines that are bold or italic for the most part."""
    n = F.col("n_signs")
    return lines(spark, d).select(*L.LINE, ((n > 0) & (F.col("n_bold") >= 0.6 * n)).alias("is_bold"), ((n > 0) & (F.col("n_italic") >= 0.6 * n)).alias("is_italic"))


_MAJ = f"""WITH s AS (SELECT *, greatest(length(coalesce(text, '')), 1) AS n, floor(size * 10 + 0.5) / 10 AS majority FROM {_SPANS}),
g AS (SELECT doc_id, page, block_no, line_no, majority, sum(n) AS weight, min(span_no) AS seen FROM s GROUP BY ALL)
SELECT doc_id, page, block_no, line_no, majority FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY weight DESC, seen) = 1"""
_BODY = f"""WITH {_PAGES}, s AS (SELECT *, length(coalesce(text, '')) AS n, floor(size * 10 + 0.5) / 10 AS majority, min(y0) OVER l AS top, max(y1) OVER l AS bottom FROM {_SPANS} WINDOW l AS (PARTITION BY doc_id, page, block_no, line_no)),
i AS (SELECT s.* FROM s JOIN pages USING (doc_id, page) WHERE bottom > height * 0.05::DOUBLE AND top < height * (1 - 0.05::DOUBLE)),
g AS (SELECT doc_id, majority, sum(n) AS weight, min(((page::BIGINT * 1000 + block_no) * 10000 + line_no) * 100 + span_no) AS seen FROM i GROUP BY ALL),
m AS (SELECT doc_id, majority FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seen) = 1)
SELECT doc_id, coalesce(majority, 10.0) AS majority FROM (SELECT DISTINCT doc_id FROM spans) LEFT JOIN m USING (doc_id)"""


@query(_BODY)
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A2: the size most signs of a document have outside the furniture bands."""
    return L.body_sizes(spans(spark, d), table(spark, d, "layout_pages"))


@query(_MAJ)
def line_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A3: the size most signs of a line have."""
    return L.majority_size(spans(spark, d), L.LINE)


@query(f"""WITH {_LINES}, {_PAGES}, p AS (SELECT * FROM lines JOIN pages USING (doc_id, page)),
e AS (SELECT doc_id, page, min(x0) AS text_left, max(x1) AS text_right FROM p WHERE x0 < width * (1 - 0.08::DOUBLE) AND x1 > width * 0.08::DOUBLE GROUP BY ALL)
SELECT doc_id, page, block_no, line_no, y1 <= height * 0.05::DOUBLE OR y0 >= height * (1 - 0.05::DOUBLE) OR (x0 >= width * (1 - 0.08::DOUBLE) AND x0 >= coalesce(text_right, width * (1 - 0.08::DOUBLE)))
  OR (x1 <= width * 0.08::DOUBLE AND x1 <= coalesce(text_left, width * 0.08::DOUBLE)) AS furniture FROM p LEFT JOIN e USING (doc_id, page)""")
def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    """F8: lines in the page's bands, and in the side margins where they lie outside the text."""
    return L.with_extent(paged(spark, d)).select(*L.LINE, L.furniture().alias("furniture"))


@query(f"""WITH {_LINES}, e AS (SELECT doc_id, page, min(x0) AS cx0, max(x1) AS cx1 FROM lines GROUP BY ALL),
f AS (SELECT *, (x1 - x0 > 0.6::DOUBLE * (cx1 - cx0)) OR ((cx0 + cx1) / 2 - x0 >= 0.15::DOUBLE * (cx1 - cx0) AND x1 - (cx0 + cx1) / 2 >= 0.15::DOUBLE * (cx1 - cx0)) AS full_width FROM lines JOIN e USING (doc_id, page)),
p AS (SELECT *, lag(full_width) OVER w AS before, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, block_no, line_no))
SELECT doc_id, page, block_no, line_no, full_width, CAST(sum(CASE WHEN k = 1 OR full_width OR before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, block_no, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM p""")
def column_bands(spark: SparkSession, d: str) -> DataFrame:
    """Full-width lines and the vertical bands they cut."""
    w = Window.partitionBy("doc_id", "page")
    ls = lines(spark, d).withColumn("cx0", F.min("x0").over(w)).withColumn("cx1", F.max("x1").over(w))
    ls = ls.withColumn("full_width", G.full_width(G.box("x0", "y0", "x1", "y1"), F.col("cx0"), F.col("cx1")))
    return islands.bands(ls, ["doc_id", "page"], ["y0", "block_no", "line_no"], F.col("full_width")).select(*L.LINE, "full_width", "band")


@query(f"""WITH {_LINES}, r AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, block_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lines),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, block_no, line_no ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT doc_id, page, CAST(island AS BIGINT) AS island, count(*) AS n_lines, min(y0) AS y0, max(y1) AS y1, bool_or(regexp_matches(text, '⟦EQ[0-9]+⟧|=')) AS has_math FROM i GROUP BY ALL""")
def zone_islands(spark: SparkSession, d: str) -> DataFrame:
    """Vertical zones with gaps of 3 pt at most, and whether one holds math."""
    i = islands.interval_islands(lines(spark, d), ["doc_id", "page"], "y0", "y1", 3.0, ["block_no", "line_no"])
    return i.groupBy("doc_id", "page", "island").agg(F.count(F.lit(1)).alias("n_lines"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max(F.col("text").rlike("⟦EQ[0-9]+⟧|=")).alias("has_math"))


@query(f"""WITH {_SEGB}, r AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM segs WHERE kind IN ('figure_text', 'formula', 'algorithm')),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 > reach + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, seg_id ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT doc_id, page, CAST(island AS BIGINT) AS island, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY ALL""")
def region_growth(spark: SparkSession, d: str) -> DataFrame:
    """Graphic regions grown over gaps of 50 pt at most."""
    s = segs(spark, d).where(F.col("kind").isin("figure_text", "formula", "algorithm"))
    i = islands.interval_islands(s, ["doc_id", "page"], "y0", "y1", 50.0, ["seg_id"])
    return i.groupBy("doc_id", "page", "island").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return segs(spark, d).select("doc_id", "page", F.col("idx").alias("region_no"), F.col("kind").alias("label"), F.col("b").alias("rb"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(*L.LINE, "text", G.box("x0", "y0", "x1", "y1").alias("b"))


_MEET = f"{_LINES}, {_SEGB}, m AS (SELECT l.*, s.idx, s.kind, s.x0 AS sx0, s.y0 AS sy0, s.x1 AS sx1, s.y1 AS sy1 FROM lines l JOIN segs s USING (doc_id, page))"
_INTER = "(least(x1, sx1) - greatest(x0, sx0)) * (least(y1, sy1) - greatest(y0, sy0))"


@query(f"""WITH {_MEET}, o AS (SELECT *, {_INTER} AS inter FROM m WHERE least(x1, sx1) > greatest(x0, sx0) AND least(y1, sy1) > greatest(y0, sy0)),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY inter DESC, idx) = 1)
SELECT l.doc_id, l.page, l.block_no, l.line_no, b.idx AS region_no, CASE WHEN (l.x1 - l.x0) > 0 AND (l.y1 - l.y0) > 0 THEN coalesce(b.inter / ((l.x1 - l.x0) * (l.y1 - l.y0)), 0) ELSE 0 END AS share FROM lines l LEFT JOIN b USING (doc_id, page, block_no, line_no)""")
def best_regions(spark: SparkSession, d: str) -> DataFrame:
    """The region each line overlaps most."""
    return spatial.best_region(_items(spark, d), _regions(spark, d), ["block_no", "line_no"])


@query(f"""WITH {_MEET}, g AS (SELECT *, greatest(sy0 - y1, y0 - sy1, 0.0) AS gap FROM m WHERE least(x1, sx1) - greatest(x0, sx0) >= 0.5 * (x1 - x0))
SELECT doc_id, page, block_no, line_no, idx AS region_no, gap FROM g WHERE gap <= greatest(y1 - y0, 1.0) * 1.5 QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY gap, idx DESC) = 1""")
def nearest_regions(spark: SparkSession, d: str) -> DataFrame:
    """The vertically nearest region of each line."""
    return spatial.nearest_region(_items(spark, d), _regions(spark, d), ["block_no", "line_no"])


@query(f"""WITH {_MEET} SELECT l.doc_id, l.page, l.block_no, l.line_no, r.region_no FROM lines l LEFT JOIN (
  SELECT doc_id, page, block_no, line_no, min(idx) AS region_no FROM m WHERE (x0 + x1) / 2 BETWEEN sx0 AND sx1 AND (y0 + y1) / 2 BETWEEN sy0 AND sy1 GROUP BY ALL) r USING (doc_id, page, block_no, line_no)""")
def holding_regions(spark: SparkSession, d: str) -> DataFrame:
    """The first region that holds the centre of each line."""
    return spatial.first_holding(_items(spark, d), _regions(spark, d), ["block_no", "line_no"])


@query(f"""WITH {_MEET} SELECT doc_id, page, block_no, line_no, idx AS region_no FROM m WHERE (y0 + y1) / 2 BETWEEN sy0 AND sy1 AND least(x1, sx1) - greatest(x0, sx0) >= 0.5 * (x1 - x0)
QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY (sx1 - sx0) * (sy1 - sy0), idx) = 1""")
def enclosing_regions(spark: SparkSession, d: str) -> DataFrame:
    """The smallest region around each line."""
    return spatial.smallest_enclosing(_items(spark, d), _regions(spark, d), ["block_no", "line_no"])


@query(f"""WITH {_MEET} SELECT DISTINCT doc_id, page, block_no, line_no FROM m WHERE kind IN ('figure_text', 'caption') AND (x0 + x1) / 2 BETWEEN sx0 AND sx1 AND (y0 + y1) / 2 BETWEEN sy0 AND sy1""")
def lines_in_figures(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose centre lies in a figure or caption."""
    r = _regions(spark, d).where(F.col("label").isin("figure_text", "caption"))
    return spatial.with_centre_in(_items(spark, d), r, ["block_no", "line_no"]).select(*L.LINE)


@query(f"""WITH {_MEET} SELECT l.doc_id, l.page, count(*) AS n_outside FROM lines l WHERE regexp_matches(l.text, 'Fig') AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = l.doc_id AND m.page = l.page AND m.block_no = l.block_no AND m.line_no = l.line_no
  AND m.kind = 'caption' AND (m.x0 + m.x1) / 2 BETWEEN sx0 AND sx1 AND (m.y0 + m.y1) / 2 BETWEEN sy0 AND sy1) GROUP BY ALL""")
def mentions_outside(spark: SparkSession, d: str) -> DataFrame:
    """Figure mentions outside of captions, by page."""
    items = _items(spark, d).where(F.contains("text", F.lit("Fig")))
    return spatial.outside(items, _regions(spark, d).where("label = 'caption'"), ["block_no", "line_no"]).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_outside"))


_KIND = """CASE WHEN share < 0.2 OR region_no IS NULL THEN CASE WHEN words <= 12 THEN 'figure_text' ELSE 'body' END WHEN share < 0.5 THEN 'body'
  WHEN label = 'header_footer' THEN 'header_footer' WHEN label = 'figure_text' THEN 'figure_text' WHEN label = 'algorithm' THEN 'algorithm' WHEN label = 'reference' THEN 'reference'
  WHEN label = 'formula' THEN CASE WHEN contains(text, '⟦EQ') OR words <= 6 THEN 'formula' ELSE 'body' END
  WHEN label = 'heading' THEN CASE WHEN words <= 20 THEN 'heading' ELSE 'body' END WHEN label = 'caption' THEN CASE WHEN length(trim(text)) <= 2 THEN 'figure_text' ELSE 'caption' END ELSE 'body' END"""


@query(f"""WITH {_MEET}, o AS (SELECT *, {_INTER} AS inter FROM m WHERE least(x1, sx1) > greatest(x0, sx0) AND least(y1, sy1) > greatest(y0, sy0)),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY inter DESC, idx) = 1),
k AS (SELECT l.doc_id, l.page, l.block_no, l.line_no, l.text, b.idx AS region_no, b.kind AS label, len(list_filter(string_split_regex(l.text, '\\s+'), lambda w: w <> '')) AS words,
  CASE WHEN (l.x1 - l.x0) > 0 AND (l.y1 - l.y0) > 0 THEN coalesce(b.inter / ((l.x1 - l.x0) * (l.y1 - l.y0)), 0) ELSE 0 END AS share FROM lines l LEFT JOIN b USING (doc_id, page, block_no, line_no))
SELECT doc_id, page, block_no, line_no, {_KIND} AS kind FROM k""")
def region_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds set by the region a line lies in."""
    items, regions = _items(spark, d), _regions(spark, d)
    best = spatial.best_region(items, regions, ["block_no", "line_no"]).join(regions.select("doc_id", "page", "region_no", "label"), ["doc_id", "page", "region_no"], "left")
    k = items.join(best, L.LINE).withColumn("words", F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")))
    return k.select(*L.LINE, F.expr(_KIND).alias("kind"))


@query(f"""WITH {_LINES}, p AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) >= 15 AND len(list_filter(regexp_extract_all(lower(text), '[A-Za-z]+'), lambda x: x IN ({_STOP}))) >= 2 AS prose FROM lines)
SELECT DISTINCT a.doc_id, a.page, a.block_no, a.line_no FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.page = b.page AND (a.block_no, a.line_no) <> (b.block_no, b.line_no) AND b.prose AND NOT a.prose
WHERE least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)""")
def beside_prose(spark: SparkSession, d: str) -> DataFrame:
    """Lines that share a row with a prose line."""
    p = lines(spark, d).withColumn("prose", (F.length(F.regexp_replace("text", "\\s", "")) >= 15) & (X.stopword_count(F.col("text")) >= 2))
    a, b = p.where("NOT prose").alias("a"), p.where("prose").select("doc_id", "page", F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    met = a.join(b, ["doc_id", "page"]).where(F.least("y1", "by1") - F.greatest("y0", "by0") > 0.5 * F.least(F.col("y1") - F.col("y0"), F.col("by1") - F.col("by0")))
    return met.select(*L.LINE).distinct()


@query(f"""WITH {_SEGB} SELECT doc_id, page, seg_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY (kind = 'header_footer'), (x0 > 306), y0, idx) AS place FROM segs""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Furniture last, then column, then height."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.col("kind") == "header_footer", F.col("x0") > 306, "y0", "idx")
    return segs(spark, d).select("doc_id", "page", "seg_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {_SEGB}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, idx) AS k FROM segs),
p AS (SELECT doc_id, seg_id, lag(source) OVER (PARTITION BY doc_id ORDER BY page, idx) AS before FROM segs WHERE kind NOT IN ('header_footer', 'formula', 'author', 'reference', 'figure_text', 'algorithm'))
SELECT doc_id, seg_id, right(before, 400) AS context FROM p""")
def previous_sources(spark: SparkSession, d: str) -> DataFrame:
    """The end of the translatable text before, as context."""
    s = segs(spark, d).where(~F.col("kind").isin("header_footer", "formula", "author", "reference", "figure_text", "algorithm"))
    b = blocks.lag(s, ["doc_id"], F.floor(F.col("page") / PAGE_BLOCK), ["page", "idx"], "source", "before")
    return b.select("doc_id", "seg_id", F.expr("right(before, 400)").alias("context"))


@query(f"""WITH {_SEGB}, b AS (SELECT *, sum(length(source)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM segs WHERE kind = 'body' AND page = 0)
SELECT doc_id, seg_id, source[1:CAST(2000 - coalesce(used, 0) AS BIGINT)] AS sample FROM b WHERE coalesce(used, 0) < 2000""")
def sample_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """The opening of W15: first-page texts up to a budget of 2000 signs, the last one cut; glossary_samples has the whole sample."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    b = segs(spark, d).where("kind = 'body' AND page = 0").withColumn("used", F.coalesce(F.sum(F.length("source")).over(w), F.lit(0)))
    return b.where("used < 2000").select("doc_id", "seg_id", F.expr("substring(source, 1, cast(2000 - used as int))").alias("sample"))


SAMPLE = 6000  # signs of a glossary sample


@query()
def glossary_samples(spark: SparkSession, d: str) -> DataFrame:
    """One sample for each document: headings, the opening of the first page, the first text behind each heading on later pages, captions."""
    s = segs(spark, d).withColumn("source", F.coalesce("source", F.lit("")))
    block = F.floor(F.col("page") / PAGE_BLOCK)
    part = lambda df, place, size: df.select("doc_id", F.lit(place).alias("place"), "page", "idx", F.substring("source", 1, size).alias("part"))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    opening = s.where("kind = 'body' AND page = 0").withColumn("used", F.coalesce(F.sum(F.length("source")).over(w), F.lit(0))).where("used < 2000")
    opening = opening.withColumn("source", F.expr("substring(source, 1, cast(2000 - used as int))"))
    behind = blocks.lag(s.where("kind IN ('heading', 'body')"), ["doc_id"], block, ["page", "idx"], "kind", "before").where("kind = 'body' AND before = 'heading' AND page > 0")
    parts = part(s.where("kind = 'heading'"), 0, SAMPLE).unionByName(part(opening, 1, 2000)).unionByName(part(behind, 2, 400)).unionByName(part(s.where("kind = 'caption'"), 3, 200))
    # each part takes a sign at least, its line end: no more of them can fit, whatever the document's size
    first = blocks.rank(parts, ["doc_id", "place"], block, ["page", "idx"]).where(F.col("rank") <= SAMPLE)
    joined = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "page", "idx", "part"))).alias("parts"))
    sample = F.substring(F.array_join(F.transform("parts", lambda x: x["part"]), "\n"), 1, SAMPLE)
    return s.select("doc_id").distinct().join(joined.select("doc_id", sample.alias("sample")), "doc_id", "left").select("doc_id", F.coalesce("sample", F.lit("")).alias("sample"))


@query(f"""WITH {_SEGB}, t AS (SELECT *, max(CASE WHEN kind = 'reference' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM segs)
SELECT doc_id, seg_id, coalesce(seen, 0) = 1 AS in_references FROM t""")
def reference_section(spark: SparkSession, d: str) -> DataFrame:
    """Everything behind the first reference."""
    r = blocks.after_first(segs(spark, d), ["doc_id"], ["page", "idx"], F.col("kind") == "reference", "in_references")
    return r.select("doc_id", "seg_id", "in_references")


@query(f"""WITH {_SEGB}, n AS (SELECT doc_id, page, idx, seg_id, CAST(regexp_extract(source, '^([0-9]{{1,2}})[.]', 1) AS INT) AS num FROM segs WHERE regexp_matches(source, '^[0-9]{{1,2}}[.]')),
f AS (SELECT *, CASE WHEN num = lag(num) OVER (PARTITION BY doc_id ORDER BY page, idx) + 1 THEN 0 ELSE 1 END AS first FROM n),
r AS (SELECT *, CAST(sum(first) OVER (PARTITION BY doc_id ORDER BY page, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
SELECT doc_id, seg_id, num, run, count(*) OVER (PARTITION BY doc_id, run) >= 2 AS is_item FROM r""")
def enumeration_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive numbers over columns and pages."""
    n = segs(spark, d).where(F.col("source").rlike("^[0-9]{1,2}[.]")).withColumn("num", F.regexp_extract("source", "^([0-9]{1,2})[.]", 1).cast("int"))
    block = F.floor(F.col("page") / PAGE_BLOCK)
    r = blocks.runs(blocks.lag(n, ["doc_id"], block, ["page", "idx"], "num", "last"), ["doc_id"], block, ["page", "idx"], F.col("num") != F.col("last") + 1)
    sizes = r.groupBy("doc_id", "run").agg((F.count(F.lit(1)) >= 2).alias("is_item"))
    return r.join(sizes, ["doc_id", "run"]).select("doc_id", "seg_id", "num", "run", "is_item")


@query(f"""WITH {_LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_no, line_no) AS pos, regexp_extract(text, '^\\s*(\\(?[0-9]{{1,2}}[.)]|[•◦–▪*])\\s', 1) AS marker FROM lines),
f AS (SELECT *, CASE WHEN regexp_matches(marker, '[0-9]') THEN 'number' WHEN marker <> '' THEN 'bullet' END AS family FROM m)
SELECT a.doc_id, a.page, a.block_no, a.line_no, a.family, EXISTS (SELECT 1 FROM f b WHERE a.doc_id = b.doc_id AND a.page = b.page AND a.family = b.family AND abs(a.pos - b.pos) BETWEEN 1 AND 8 AND abs(a.x0 - b.x0) <= 3) AS has_sibling
FROM f a WHERE a.marker <> ''""")
def marker_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Marker lines with a sibling of their family, 8 lines and 3 pt apart at most."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "block_no", "line_no")
    m = lines(spark, d).withColumn("pos", F.row_number().over(w)).withColumn("marker", F.regexp_extract("text", "^\\s*(\\(?[0-9]{1,2}[.)]|[•◦–▪*])\\s", 1))
    f = m.where("marker <> ''").withColumn("family", F.when(F.col("marker").rlike("[0-9]"), "number").otherwise("bullet"))
    near = Window.partitionBy("doc_id", "page", "family").orderBy("pos").rangeBetween(-8, 8)
    others = F.filter(F.collect_list(F.struct("pos", "x0")).over(near), lambda o: (o["pos"] != F.col("pos")) & (F.abs(o["x0"] - F.col("x0")) <= 3))
    return f.select(*L.LINE, "family", (F.size(others) > 0).alias("has_sibling"))


@query(f"""WITH {_SEGB}, {_PAGES} SELECT doc_id, page, seg_id, greatest(0.0, x0 - 4) AS x0, greatest(0.0, y0 - 4) AS y0, least(width, x1 + 4) AS x1, least(height, y1 + 4) AS y1 FROM segs JOIN pages USING (doc_id, page)""")
def clip_boxes(spark: SparkSession, d: str) -> DataFrame:
    """K9, M5: boxes with a margin, clipped to the page."""
    s = L.with_page(segs(spark, d), table(spark, d, "layout_pages")).withColumn("p", G.pad(F.col("b"), 4, F.col("width"), F.col("height")))
    return s.select("doc_id", "page", "seg_id", "p.x0", "p.y0", "p.x1", "p.y1")


@query(f"""WITH {_SEGB}, {_PAGES}, o AS (SELECT a.doc_id, a.page, a.seg_id, min(b.y0) AS top FROM segs a JOIN segs b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seg_id <> b.seg_id AND b.y0 >= a.y1 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) GROUP BY ALL),
e AS (SELECT s.doc_id, s.page, s.seg_id, s.y1, height, least(coalesce(o.top - 3, height - 2), height - 2) AS reach FROM segs s JOIN pages USING (doc_id, page) LEFT JOIN o ON s.doc_id = o.doc_id AND s.page = o.page AND s.seg_id = o.seg_id)
SELECT doc_id, page, seg_id, CASE WHEN reach - y1 > 0.1 THEN reach END AS expanded, least(y1 + 12, height) AS forced FROM e""")
def expanded_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Room below each segment down to the next obstacle, and the forced growth by one line."""
    s = L.with_page(segs(spark, d), table(spark, d, "layout_pages"))
    o = segs(spark, d).select("doc_id", "page", F.col("seg_id").alias("oid"), F.col("b").alias("ob"))
    tops = s.join(o, ["doc_id", "page"]).where((F.col("seg_id") != F.col("oid")) & (F.col("ob.y0") >= F.col("y1")) & (G.x_overlap(F.col("b"), F.col("ob")) > 0)).groupBy("doc_id", "page", "seg_id").agg(F.min("ob.y0").alias("top"))
    j = s.join(tops, ["doc_id", "page", "seg_id"], "left")
    return j.select("doc_id", "page", "seg_id", G.expand_down(F.col("b"), F.col("top"), F.col("height")).alias("expanded"), G.force_down(F.col("b"), F.lit(12), F.col("height")).alias("forced"))


@query(f"""WITH {_SEGB}, t AS (SELECT doc_id, page, seg_id, unnest(regexp_extract_all(source, '⟦EQ[0-9]+⟧')) AS token, generate_subscripts(regexp_extract_all(source, '⟦EQ[0-9]+⟧'), 1) AS k FROM segs),
r AS (SELECT doc_id, page, seg_id, unnest(regexp_extract_all(translated, '⟦EQ[0-9]+⟧')) AS rendered, generate_subscripts(regexp_extract_all(translated, '⟦EQ[0-9]+⟧'), 1) AS k FROM (SELECT DISTINCT doc_id, page, seg_id, translated FROM segments WHERE translated IS NOT NULL))
SELECT doc_id, page, seg_id, CAST(k AS INT) AS k, token, rendered FROM t FULL JOIN r USING (doc_id, page, seg_id, k)""")
def tokens_by_order(spark: SparkSession, d: str) -> DataFrame:
    """The k-th token of a source with the k-th of its translation, surplus ones kept."""
    s = table(spark, d, "segments").select("doc_id", "page", "seg_id", "source", "translated").distinct()
    pat = "⟦EQ[0-9]+⟧"
    a = s.select("doc_id", "page", "seg_id", F.posexplode(X.all_of(F.col("source"), pat)).alias("at", "token"))
    b = s.where("translated IS NOT NULL").select("doc_id", "page", "seg_id", F.posexplode(X.all_of(F.col("translated"), pat)).alias("bt", "rendered"))
    z = spatial.zip_by_order(a, b, ["doc_id", "page", "seg_id"], ["at"], ["bt"])
    return z.select("doc_id", "page", "seg_id", "k", "token", "rendered")


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, page, block_no, count(*) AS cells, avg(CASE WHEN length(trim(text)) <= 32 THEN 1.0 ELSE 0.0 END) AS short_share,
  CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS BIGINT) AS digits, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS signs, count(DISTINCT CAST(floor(x0 / 3) AS INT)) AS edges FROM lines GROUP BY ALL)
SELECT doc_id, page, block_no, cells, digits, edges, cells >= 4 AND short_share >= 0.6 AND digits >= 0.12 * signs AND edges >= 3 AS is_table FROM c""")
def table_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Counts that tell a table block."""
    c = lines(spark, d).groupBy("doc_id", "page", "block_no").agg(
        F.count(F.lit(1)).alias("cells"), F.avg(F.when(F.length(F.trim("text")) <= 32, 1.0).otherwise(0.0)).alias("short_share"), F.sum(F.length(F.regexp_replace("text", "[^0-9]", ""))).alias("digits"),
        F.sum(F.length(F.regexp_replace("text", "\\s", ""))).alias("signs"), F.count_distinct(F.floor(F.col("x0") / 3).cast("int")).alias("edges"),
    )
    ok = (F.col("cells") >= 4) & (F.col("short_share") >= 0.6) & (F.col("digits") >= 0.12 * F.col("signs")) & (F.col("edges") >= 3)
    return c.select("doc_id", "page", "block_no", "cells", "digits", "edges", ok.alias("is_table"))


def _flow(spark: SparkSession, d: str) -> DataFrame:
    return cascade.flow_of(spans(spark, d), table(spark, d, "layout_pages").dropDuplicates(["doc_id", "page"]))


@query()
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Furniture, band and column of every line but display equations."""
    return _flow(spark, d).select(*L.LINE, "furniture", "band", "col")


@query()
def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one row of running text joined from left to right."""
    return cascade.rows_in_flow(spans(spark, d), _flow(spark, d)).select(*cascade.ROW, "text", *cascade.BOX)


@query()
def formula_zones(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the zone they belong to, and rows that open a list item."""
    return cascade.zoned_rows(spans(spark, d), _flow(spark, d)).select(*cascade.ROW, "text", "cls", "fired", "zone")


@query()
def classified_segments(spark: SparkSession, d: str) -> DataFrame:
    """Spans and pages as classified segments in reading order, all passes in one plan."""
    return cascade.build_segments(spans(spark, d), table(spark, d, "layout_pages"))


# The label of a layout region that the stored segment kinds stand for.
_LABELS = {"body": "text", "heading": "paragraph_title", "caption": "figure_title", "header_footer": "header", "formula": "display_formula", "author": "text", "reference": "reference_content", "figure_text": "chart", "algorithm": "algorithm"}


@query()
def classified_in_regions(spark: SparkSession, d: str) -> DataFrame:
    """As classified_segments, with the stored segments' boxes as the layout model's regions."""
    label = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])[F.col("kind")]
    regions = segs(spark, d).select("doc_id", "page", F.col("idx").alias("region_no"), label.alias("label"), F.lit(0.9).alias("score"), F.col("b").alias("box"))
    return cascade.build_segments(spans(spark, d), table(spark, d, "layout_pages"), regions)


@query()
def edge_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Left edges grouped around a base edge."""
    return folds.edge_clusters(lines(spark, d))


@query()
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The paragraph of each row of a column, and its kind."""
    rows = cascade.zoned_rows(spans(spark, d), _flow(spark, d))
    return folds.paragraph_numbers(rows).select(*cascade.ROW, "para_no", "para_kind", "text")


@query()
def merged_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings broken over lines put together."""
    s = segs(spark, d).where("x0 IS NOT NULL").select("doc_id", "page", "seg_id", "idx", F.lit(0).alias("col"), "kind", F.col("source").alias("text"), (F.col("y1") - F.col("y0")).alias("size"), F.lit(10.0).alias("body_size"), *cascade.BOX)
    return cascade.merged_headings(s, None).select("doc_id", "page", "seg_id", "kind", "text", *cascade.BOX)


@query()
def distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines without those printed again within 1 pt of a kept one."""
    return folds.drop_repeats(lines(spark, d)).select(*L.LINE)


@query()
def kept_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions left by non-maximum suppression and by the overlap filter."""
    s = segs(spark, d).select("doc_id", "page", F.col("idx").alias("region_no"), F.col("kind").alias("label"), (F.lit(1.0) / (F.col("idx") + 1)).alias("score"), "x0", "y0", "x1", "y1")
    return folds.suppress(s)


@query()
def flow_regions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of text in a column broken by fixed boxes, and stacked tops."""
    return folds.flow_regions(L.with_page(segs(spark, d), table(spark, d, "layout_pages")))
