"""Queries of line classes, zone parts, orders, lookups and smaller operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import blocks, spatial
from ..operators import lines as L
from ..sources.tables import table
from ..streaming import events
from .layout import _BOX, _INTER, _LINES, _MEET, _PAGES, _SEGB, _STOP, PAGE_BLOCK, _items, _regions, lines, paged, segs, spans
from .register import query

_SPANS = "(SELECT DISTINCT ON (doc_id, page, block_no, line_no, span_no) * FROM spans)"
_SEG = "(SELECT DISTINCT * FROM segments)"
_MATH = "(regexp_matches(upper(coalesce(font, '')), 'CMMI|CMSY|CMEX|MTMI|MTSY|MTEX|BLEX|MSAM|MSBM') OR (contains(upper(coalesce(font, '')), 'MATH') AND NOT contains(regexp_extract(regexp_replace(upper(coalesce(font, '')), '^.*\\+', ''), '^[^-]*-(.*)$', 1), 'ROMAN')))"
_DENSE = "regexp_replace(coalesce(text, ''), '\\s', '', 'g')"
_MLINES = f"""ml AS (SELECT doc_id, page, block_no, line_no, string_agg(coalesce(text, ''), '' ORDER BY span_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_or({_MATH}) AS has_math FROM {_SPANS} GROUP BY ALL)"""
_WORDS = "regexp_extract_all(regexp_replace(text, '⟦EQ[0-9]+⟧', '', 'g'), '[A-Za-z]+')"
_NSTOP = f"len(list_filter({_WORDS}, lambda w: lower(w) IN ({_STOP})))"
_NLONG = f"len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[a-z]{{5,}}$')))"


@query(f"""SELECT doc_id, page, block_no, line_no, span_no FROM {_SPANS} WHERE {_MATH} AND trim(coalesce(text, '')) <> '' AND NOT (regexp_full_match({_DENSE}, '\\p{{L}}') AND size >= 20)
  AND NOT regexp_full_match({_DENSE}, '[0-9.,;:!?()\\[\\]{{}}|/\\\\%=<>+±−×÷·∗*≤≥≈≃≅∼~≠≲≳•◦▪]{{1,2}}')""")
def masked_spans(spark: SparkSession, d: str) -> DataFrame:
    """spans that are masked as math."""
    s = spans(spark, d).dropDuplicates([*L.LINE, "span_no"])
    return s.where(L.masked_math(F.col("text"), F.col("font"), F.col("size"))).select(*L.LINE, "span_no")


def formula_line(text: Column, has_math: Column) -> Column:
    """A lone (n), or a line with math and neither function words nor long lower-case words."""
    plain = X.visible(text)
    return F.trim(text).rlike("^\\([0-9]+\\)$") | (has_math & (F.trim(text) != "") & (X.stopword_count(plain) == 0) & (X.long_words(plain) == 0))


@query(f"""WITH {_MLINES} SELECT doc_id, page, block_no, line_no, regexp_matches(trim(text), '^\\([0-9]+\\)$') OR (has_math AND trim(text) <> '' AND {_NSTOP} = 0 AND {_NLONG} = 0) AS is_formula FROM ml""")
def formula_lines(spark: SparkSession, d: str) -> DataFrame:
    """display-equation lines."""
    return lines(spark, d).select(*L.LINE, formula_line(F.col("text"), F.col("has_math")).alias("is_formula"))


def detached_long_words(text: Column) -> Column:
    """Long lower-case words that are not glued to a token or behind a hyphen."""
    marked = F.regexp_replace(text, "⟦EQ[0-9]+⟧", "￼")
    return F.size(F.filter(F.regexp_extract_all(marked, F.lit("(?<![A-Za-z￼-])[A-Za-z]+(?![A-Za-z￼])"), F.lit(0)), lambda w: w.rlike("^[a-z]{5,}$")))


@query(f"""WITH m AS (SELECT doc_id, seg_id, regexp_extract_all(regexp_replace(source, '⟦EQ[0-9]+⟧', chr(65532), 'g'), '[-￼]?[A-Za-z]+￼?') AS w FROM {_SEG})
SELECT doc_id, seg_id, len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]{{5,}}'))) AS n_detached FROM m""")
def detached_words(spark: SparkSession, d: str) -> DataFrame:
    """long words that stand free of formula parts."""
    s = table(spark, d, "segments").distinct()
    return s.select("doc_id", "seg_id", detached_long_words(F.col("source")).cast("long").alias("n_detached"))


_CHARS = "length(regexp_replace(regexp_replace(text, '⟦EQ[0-9]+⟧', '', 'g'), '\\s', '', 'g'))"


@query(f"""WITH {_MLINES}, e AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS cx0, max(x1) OVER (PARTITION BY doc_id, page) AS cx1 FROM ml)
SELECT doc_id, page, block_no, line_no, has_math AND x0 - cx0 >= 2 AND {_CHARS} <= 40 AND {_NSTOP} = 0 AS indented_math, regexp_matches(text, '\\([0-9]+\\)\\s*$') AND cx1 - x1 <= 0.05::DOUBLE * (cx1 - cx0) AND {_CHARS} <= 40 AS numbered,
  x0 - cx0 >= 0.15::DOUBLE * (cx1 - cx0) AND cx1 - x1 >= 0.15::DOUBLE * (cx1 - cx0) AND NOT regexp_matches(rtrim(text), '[.!?]$') AS centred, has_math OR ({_CHARS} <= 30 AND NOT regexp_matches(rtrim(text), '[.!?]$')) AS fragment FROM e""")
def zone_parts(spark: SparkSession, d: str) -> DataFrame:
    """seeds, centred candidates and fragments of formula zones."""
    w = Window.partitionBy("doc_id", "page")
    e = lines(spark, d).withColumn("cx0", F.min("x0").over(w)).withColumn("cx1", F.max("x1").over(w))
    t, width = F.col("text"), F.col("cx1") - F.col("cx0")
    n, ends = F.length(X.dense(t)), F.rtrim(t).rlike("[.!?]$")
    return e.select(
        *L.LINE, (F.col("has_math") & (F.col("x0") - F.col("cx0") >= 2) & (n <= 40) & (X.stopword_count(X.visible(t)) == 0)).alias("indented_math"),
        (t.rlike("\\([0-9]+\\)\\s*$") & (F.col("cx1") - F.col("x1") <= 0.05 * width) & (n <= 40)).alias("numbered"),
        ((F.col("x0") - F.col("cx0") >= 0.15 * width) & (F.col("cx1") - F.col("x1") >= 0.15 * width) & ~ends).alias("centred"),
        (F.col("has_math") | ((n <= 30) & ~ends)).alias("fragment"),
    )


_HEADRE = "^\\s*(?:(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*|[A-Z])[.)]|(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*))\\s+\\S"
_REFSRE = "(?i)^\\s*(?:(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*|[A-Z])[.)]?\\s+)?(?:references|bibliography|참고문헌)\\s*:?\\s*$"


@query(f"""WITH {_MLINES} SELECT doc_id, page, block_no, line_no, CASE WHEN regexp_matches(text, '{_REFSRE}') THEN 'refs_title'
  WHEN regexp_matches(trim(text), '^\\([0-9]+\\)$') OR (has_math AND trim(text) <> '' AND {_NSTOP} = 0 AND {_NLONG} = 0) THEN 'formula'
  WHEN regexp_matches(text, '{_HEADRE}') AND length(text) <= 120 THEN 'heading' ELSE 'normal' END AS class, {_CHARS} >= 35 AND {_NSTOP} >= 2 AS table_prose, regexp_matches(text, '(?i)^\\s*(?:fig(?:ure)?\\.?|table)\\s*[0-9]') AS is_caption FROM ml""")
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    """the class of each line, prose beside tables, captions."""
    t = F.col("text")
    cls = F.when(t.rlike(_REFSRE), "refs_title").when(formula_line(t, F.col("has_math")), "formula").when(t.rlike(_HEADRE) & (F.length(t) <= 120), "heading").otherwise("normal")
    prose = (F.length(X.dense(t)) >= 35) & (X.stopword_count(X.visible(t)) >= 2)
    return lines(spark, d).select(*L.LINE, cls.alias("class"), prose.alias("table_prose"), t.rlike("(?i)^\\s*(?:fig(?:ure)?\\.?|table)\\s*[0-9]").alias("is_caption"))


@query(f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+') AS words, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n > 25 AND len(words) > 0 AND len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) >= 0.1::DOUBLE * len(words) AS prose FROM w""")
def prose_documents(spark: SparkSession, d: str) -> DataFrame:
    """long texts with a normal share of function words."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    n, w = F.size(F.filter(F.split("text", "\\s+"), lambda x: x != "")), F.size(X.words(F.col("text")))
    return t.select("doc_id", ((n > 25) & (w > 0) & (X.stopword_count(F.col("text")) >= 0.1 * w)).alias("prose"))


@query("""SELECT doc_id, regexp_full_match(filename, '[A-Za-z0-9._ ()-]{1,120}') AS plain, regexp_matches(lower(filename), '\\.pdf$') AS is_pdf, regexp_matches(filename, '^[a-z]+_[0-9]+') AS keyed FROM (SELECT DISTINCT * FROM jobs)""")
def valid_names(spark: SparkSession, d: str) -> DataFrame:
    """Names checked by pattern."""
    f = F.col("filename")
    return table(spark, d, "jobs").distinct().select("doc_id", f.rlike("^[A-Za-z0-9._ ()-]{1,120}$").alias("plain"), F.lower(f).rlike("\\.pdf$").alias("is_pdf"), f.rlike("^[a-z]+_[0-9]+").alias("keyed"))


@query(f"""WITH {_MEET}, o AS (SELECT *, {_INTER} AS inter FROM m WHERE least(x1, sx1) > greatest(x0, sx0) AND least(y1, sy1) > greatest(y0, sy0)),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY inter DESC, idx) = 1),
g AS (SELECT *, greatest(sy0 - y1, y0 - sy1, 0.0) AS gap FROM m WHERE least(x1, sx1) - greatest(x0, sx0) >= 0.5 * (x1 - x0)),
n AS (SELECT * FROM g WHERE gap <= greatest(y1 - y0, 1.0) * 1.5 QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY gap, idx DESC) = 1)
SELECT l.doc_id, l.page, l.block_no, l.line_no, coalesce(CASE WHEN b.inter >= 0.5 * ((l.x1 - l.x0) * (l.y1 - l.y0)) THEN b.idx END, n.idx, -1) AS region_key
FROM lines l LEFT JOIN b USING (doc_id, page, block_no, line_no) LEFT JOIN n USING (doc_id, page, block_no, line_no)""")
def region_keys(spark: SparkSession, d: str) -> DataFrame:
    """The overlapped region if it covers half of the line, else the nearest, else -1."""
    return spatial.region_key(_items(spark, d), _regions(spark, d), ["block_no", "line_no"])


_SIX = "('header_footer', 'formula', 'author', 'reference', 'figure_text', 'algorithm')"


@query(f"""WITH {_SEGB} SELECT DISTINCT a.doc_id, a.seg_id FROM segs a JOIN segs b ON a.doc_id = b.doc_id AND a.page = b.page AND a.kind IN {_SIX} AND b.kind NOT IN {_SIX} AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)""")
def redaction_hits(spark: SparkSession, d: str) -> DataFrame:
    """Untranslated boxes hit by a box that is written over."""
    s = segs(spark, d)
    a = s.where(f"kind IN {_SIX}").select("doc_id", "page", "seg_id", "b")
    o = s.where(f"kind NOT IN {_SIX}").select("doc_id", "page", F.col("b").alias("ob"))
    return a.join(o, ["doc_id", "page"]).where(G.intersects(F.col("b"), F.col("ob"))).select("doc_id", "seg_id").distinct()


@query(f"""WITH {_SEGB} SELECT a.doc_id, a.seg_id, max(CASE WHEN (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.7::DOUBLE * ((a.x1 - a.x0) * (a.y1 - a.y0)) THEN 1 ELSE 0 END) = 1 AS inside
FROM segs a JOIN segs b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seg_id <> b.seg_id GROUP BY ALL""")
def contained_boxes(spark: SparkSession, d: str) -> DataFrame:
    """boxes of which 70 % lie in another one."""
    s = segs(spark, d).select("doc_id", "page", "seg_id", "b")
    o = s.select("doc_id", "page", F.col("seg_id").alias("oid"), F.col("b").alias("ob"))
    m = s.join(o, ["doc_id", "page"]).where("seg_id <> oid")
    return m.groupBy("doc_id", "seg_id").agg(F.max(G.mostly_inside(F.col("b"), F.col("ob"))).alias("inside"))


@query(f"""WITH {_MLINES}, c AS (SELECT doc_id, page, block_no, line_no, x1 AS cx1, y0 AS cy0, y1 AS cy1 FROM ml WHERE regexp_matches(text, '^[0-9]+[.)]')), n AS (SELECT c.*, l.block_no AS nb, l.line_no AS nl, l.y0 FROM c JOIN ml l USING (doc_id, page)
  WHERE l.x0 >= c.cx1 - 2 AND l.y1 > c.cy0 AND l.y0 < c.cy1)
SELECT doc_id, page, block_no, line_no, nb AS right_block, nl AS right_line FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no, line_no ORDER BY y0, nb, nl) = 1""")
def right_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The topmost line just right of a marked line, as for drop caps."""
    ls = lines(spark, d)
    c = ls.where(F.col("text").rlike("^[0-9]+[.)]")).select(*L.LINE, F.col("x1").alias("cx1"), F.col("y0").alias("cy0"), F.col("y1").alias("cy1"))
    o = ls.select("doc_id", "page", F.col("block_no").alias("nb"), F.col("line_no").alias("nl"), "x0", "y0", "y1")
    m = c.join(o, ["doc_id", "page"]).where("x0 >= cx1 - 2 AND y1 > cy0 AND y0 < cy1")
    return m.groupBy(*L.LINE).agg(F.min_by(F.struct("nb", "nl"), F.struct("y0", "nb", "nl")).alias("n")).select(*L.LINE, F.col("n.nb").alias("right_block"), F.col("n.nl").alias("right_line"))


@query("""SELECT p.doc_id, p.text_form, j.status = 'done' AS ready, CASE WHEN j.status = 'done' THEN 'outputs/' || p.doc_id || '.pdf' END AS path FROM doc_profile p LEFT JOIN (SELECT DISTINCT * FROM jobs) j USING (doc_id)""")
def archive_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with their job; only finished ones have a file."""
    j = table(spark, d, "jobs").distinct().select("doc_id", "status")
    done = F.col("status") == "done"
    return table(spark, d, "doc_profile").join(j, "doc_id", "left").select("doc_id", "text_form", done.alias("ready"), F.when(done, F.concat(F.lit("outputs/"), "doc_id", F.lit(".pdf"))).alias("path"))


@query(f"""SELECT doc_id, seg_id FROM {_SEG} WHERE translated_bbox IS NOT NULL AND translated_bbox <> bbox""")
def changed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose placed box differs from their own."""
    return table(spark, d, "segments").distinct().where("translated_bbox IS NOT NULL AND NOT translated_bbox <=> bbox").select("doc_id", "seg_id")


@query(f"""WITH {_SEGB} SELECT doc_id, seg_id, len(string_split(source, ' ')) AS n_words, array_to_string(string_split(source, ' ')[1:8], ' ') AS head, list_contains(string_split(lower(source), ' '), 'the') AS has_the FROM segs""")
def word_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Array helpers: size, the first eight, membership."""
    w = F.split("source", " ", -1)
    return segs(spark, d).select("doc_id", "seg_id", F.size(w).cast("long").alias("n_words"), F.array_join(F.slice(w, 1, 8), " ").alias("head"), F.array_contains(F.split(F.lower("source"), " ", -1), "the").alias("has_the"))


@query(f"""WITH {_MLINES} SELECT doc_id, page, block_no, line_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_no, line_no) AS place, CASE WHEN has_math THEN row_number() OVER (PARTITION BY doc_id, page, has_math ORDER BY y0, x0, block_no, line_no) END AS math_place FROM ml""")
def line_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines, and those with math, from the top and from the left."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "block_no", "line_no")
    m = Window.partitionBy("doc_id", "page", "has_math").orderBy("y0", "x0", "block_no", "line_no")
    return lines(spark, d).select(*L.LINE, F.row_number().over(w).cast("long").alias("place"), F.when(F.col("has_math"), F.row_number().over(m).cast("long")).alias("math_place"))


@query(f"""WITH {_SEGB} SELECT doc_id, seg_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, kind NOT IN ('body', 'heading'), y0, idx) AS place FROM segs""")
def flow_order(spark: SparkSession, d: str) -> DataFrame:
    """Flowing texts first on each page, then by height; counted in blocks of pages."""
    s = segs(spark, d).withColumn("fixed", ~F.col("kind").isin("body", "heading"))
    return blocks.rank(s, ["doc_id"], F.floor(F.col("page") / PAGE_BLOCK), ["page", "fixed", "y0", "idx"], "place").select("doc_id", "seg_id", F.col("place").cast("long").alias("place"))


@query(f"""SELECT doc_id, list_has_any(list_distinct(string_split(lower(filename), '_')), ['paper.pdf', '논문', 'paper']) AS installed, status IN ('done', 'error', 'cancelled') AS terminal FROM (SELECT DISTINCT * FROM jobs)""")
def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    """Candidate names that meet a list, and membership in a fixed set."""
    parts = F.split(F.lower("filename"), "_", -1)
    return table(spark, d, "jobs").distinct().select("doc_id", F.arrays_overlap(parts, F.array(*map(F.lit, ("paper.pdf", "논문", "paper")))).alias("installed"), F.col("status").isin("done", "error", "cancelled").alias("terminal"))


@query(f"""WITH s AS (SELECT doc_id, seg_id, page, CAST(regexp_extract(seg_id, '_s([0-9]+)$', 1) AS INT) AS idx, CASE WHEN status = 'fallback' THEN NULL ELSE translated END AS t FROM {_SEG} WHERE kind NOT IN {_SIX})
SELECT doc_id, seg_id, lag(t) OVER (PARTITION BY doc_id ORDER BY page, idx) AS previous FROM s""")
def previous_translations(spark: SparkSession, d: str) -> DataFrame:
    """The translation before, null after a fallback."""
    s = table(spark, d, "segments").distinct().where(f"kind NOT IN {_SIX}").withColumn("idx", F.regexp_extract("seg_id", "_s([0-9]+)$", 1).cast("int"))
    s = s.withColumn("t", F.when(F.col("status") != "fallback", F.col("translated")))
    return blocks.lag(s, ["doc_id"], F.floor(F.col("page") / PAGE_BLOCK), ["page", "idx"], "t", "previous").select("doc_id", "seg_id", "previous")


@query(f"""WITH {_SEGB}, f AS (SELECT *, max(CASE WHEN kind = 'algorithm' THEN 1 ELSE 0 END) OVER w AS opened, CASE WHEN kind NOT IN ('algorithm', 'formula', 'body') THEN 1 ELSE 0 END AS stop FROM segs WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx, seg_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, sum(CASE WHEN opened = 1 THEN stop ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY idx, seg_id ROWS UNBOUNDED PRECEDING) AS stops FROM f)
SELECT doc_id, seg_id FROM g WHERE opened = 1 AND stops = 0 AND kind <> 'formula'""")
def algorithm_spans(spark: SparkSession, d: str) -> DataFrame:
    """An algorithm's first segment and what follows on the page until another kind; formulas are passed over."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx", "seg_id").rowsBetween(Window.unboundedPreceding, 0)
    f = segs(spark, d).withColumn("opened", F.max(F.when(F.col("kind") == "algorithm", 1).otherwise(0)).over(w)).withColumn("stop", F.when(~F.col("kind").isin("algorithm", "formula", "body"), 1).otherwise(0))
    g = f.withColumn("stops", F.sum(F.when(F.col("opened") == 1, F.col("stop")).otherwise(0)).over(w))
    return g.where("opened = 1 AND stops = 0 AND kind <> 'formula'").select("doc_id", "seg_id")


@query(f"""WITH {_SEGB}, c AS (SELECT *, position(' ' IN source) AS pos FROM segs) SELECT doc_id, seg_id, x0 + (x1 - x0) * (pos - 1) / length(source) AS cut_x, coalesce(nullif(regexp_extract(source, '"([^"]{{4,}})"', 1), ''), source[1:120]) AS lookup,
  CASE kind WHEN 'body' THEN 'text' WHEN 'heading' THEN 'title' ELSE 'other' END AS engine FROM c WHERE pos > 1""")
def cuts_and_lookups(spark: SparkSession, d: str) -> DataFrame:
    """A box cut at a sign, the lookup text of an entry, names resolved from a map."""
    s = segs(spark, d).withColumn("at", F.instr("source", " ")).where("at > 1")
    title = F.regexp_extract("source", '"([^"]{4,})"', 1)
    names = F.create_map(F.lit("body"), F.lit("text"), F.lit("heading"), F.lit("title"))
    return s.select("doc_id", "seg_id", (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("at") - 1) / F.length("source")).alias("cut_x"), F.coalesce(F.when(title != "", title), F.substring("source", 1, 120)).alias("lookup"), F.coalesce(names[F.col("kind")], F.lit("other")).alias("engine"))


@query("""SELECT doc_id, CASE WHEN status = 'done' THEN 'done' ELSE 'error' END AS event FROM (SELECT DISTINCT * FROM jobs) WHERE status IN ('done', 'error', 'cancelled')""")
def terminal_events(spark: SparkSession, d: str) -> DataFrame:
    """What a late listener gets from the stored status."""
    return events.terminal_events(table(spark, d, "jobs").distinct()).select("doc_id", "event")


@query(f"""WITH {_LINES}, {_SEGB}, c AS (SELECT s.doc_id, s.seg_id, string_agg(trim(l.text), ' ' ORDER BY l.y0, l.x0, l.block_no, l.line_no) AS t FROM segs s JOIN lines l ON s.doc_id = l.doc_id AND s.page = l.page
  AND (l.x0 + l.x1) / 2 BETWEEN s.x0 AND s.x1 AND (l.y0 + l.y1) / 2 BETWEEN s.y0 AND s.y1 GROUP BY ALL)
SELECT s.doc_id, s.seg_id, coalesce(nullif(trim(regexp_replace(c.t, '\\s+', ' ', 'g')), ''), trim(regexp_replace(s.source, '\\s+', ' ', 'g'))) AS text FROM segs s LEFT JOIN c USING (doc_id, seg_id)""")
def region_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of the lines inside a segment's box, else the stored text."""
    s = segs(spark, d)
    l = lines(spark, d).select("doc_id", "page", F.struct("y0", "x0", "block_no", "line_no", F.trim("text").alias("t")).alias("l"), G.box("x0", "y0", "x1", "y1").alias("lb"))
    c = s.join(l, ["doc_id", "page"]).where(G.centre_inside(F.col("lb"), F.col("b"))).groupBy("doc_id", "seg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), " ").alias("t"))
    clean = lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))
    return s.join(c, ["doc_id", "seg_id"], "left").select("doc_id", "seg_id", F.coalesce(F.when(clean("t") != "", clean("t")), clean("source")).alias("text"))


@query(f"""WITH {_SEGB}, n AS (SELECT *, lead(source) OVER w AS after, lead(kind) OVER w AS after_kind FROM segs WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx, seg_id))
SELECT doc_id, seg_id, kind = 'body' AND coalesce(after_kind, '') = 'body' AND NOT regexp_matches(rtrim(source), '[.!?:]["''”’)\\]]*$') AND regexp_matches(coalesce(after, ''), '^\\P{{L}}*\\p{{Ll}}') AS runs_on FROM n""")
def run_on_texts(spark: SparkSession, d: str) -> DataFrame:
    """texts that go on in the next one of the page."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx", "seg_id")
    n = segs(spark, d).withColumn("after", F.coalesce(F.lead("source").over(w), F.lit(""))).withColumn("after_kind", F.coalesce(F.lead("kind").over(w), F.lit("")))
    return n.select("doc_id", "seg_id", ((F.col("kind") == "body") & (F.col("after_kind") == "body") & ~X.ends_paragraph(F.col("source")) & F.col("after").rlike("^\\P{L}*\\p{Ll}")).alias("runs_on"))


@query(f"""WITH new AS (SELECT doc_id, 'v2' AS payload FROM (SELECT DISTINCT doc_id FROM jobs) WHERE doc_id < 'd8'), old AS (SELECT DISTINCT doc_id, filename AS payload FROM jobs), extra AS (SELECT 'new-job' AS doc_id, 'v1' AS payload)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM extra""")
def replaced_payloads(spark: SparkSession, d: str) -> DataFrame:
    """K1, K6: payloads replaced or inserted by key, and a row appended."""
    from ..operators import store

    j = table(spark, d, "jobs").select("doc_id", F.col("filename").alias("payload")).distinct()
    new = j.where("doc_id < 'd8'").select("doc_id", F.lit("v2").alias("payload"))
    extra = spark.createDataFrame([("new-job", "v1")], "doc_id string, payload string")
    return store.upsert(j, new.unionByName(extra), ["doc_id"])


@query(f"""WITH {_MLINES}, {_PAGES}, e AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS px0 FROM ml) SELECT doc_id, page, block_no, line_no, has_math AND x0 - px0 <= 2 AND regexp_matches(rtrim(text), '[.]$') AS body_tail FROM e JOIN pages USING (doc_id, page)""")
def formula_tails(spark: SparkSession, d: str) -> DataFrame:
    """flush lines with math that close a sentence of the body."""
    e = paged(spark, d).withColumn("px0", F.min("x0").over(Window.partitionBy("doc_id", "page")))
    return e.select(*L.LINE, (F.col("has_math") & (F.col("x0") - F.col("px0") <= 2) & F.rtrim("text").rlike("[.]$")).alias("body_tail"))
