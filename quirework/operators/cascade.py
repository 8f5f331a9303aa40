"""The whole way from spans to classified segments in reading order, as one plan.

Text goes through four grains: spans, lines, rows (lines that stand side by side in running text) and paragraphs.
Every step between two grains only gives numbers to rows of the finer one, by windows and array folds inside the JVM;
one aggregate by those numbers makes the next grain. Later passes change kinds by joins. Each grain, and the segments
between passes, are written once (`cut`), since several steps read them. All keys hold document and page, so pages are the unit of work; what crosses pages (body size, enumerations, the reference section) is
aggregated, or ordered in blocks of pages.

Inputs: spans, pages (doc_id, page, width, height), and where they are known regions of a layout model (doc_id, page,
region_no, label, score, box), graphics (doc_id, page, image or drawing in `type`, box). Repeated rows count once;
null texts are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..session import cut
from . import blocks, folds, islands, spatial
from . import lines as L

PAGE = ["doc_id", "page"]
COLUMN = [*PAGE, "band", "col"]
ROW = [*COLUMN, "row_no"]
BOX = ["x0", "y0", "x1", "y1"]
PAGE_BLOCK = 256

# Shapes of lines and segments.
EQ_ONLY = "^(?:\\s|⟦EQ[0-9]+⟧)+$"
NUMBER_ONLY = "^\\([0-9]+\\)$"
NUMBER_TAIL = "\\([0-9]+\\)\\s*$"
THEOREM = "^(?:Theorem|Lemma|Definition|Corollary|Proposition|Assumption|Remark|Proof)(?: [0-9]+)?(?: \\([^)]{1,40}\\))?[.:]"
ABSTRACT = "(?i)^\\s*abstract\\b"
AUTHOR_CUE = "(?i)@|\\buniversit|\\binstitut|\\bdepartment\\b|\\blaborator|\\bschool of\\b|\\bcollege of\\b|\\bieee\\s+(?:member|senior member|student member|fellow)\\b"
BYLINE = "(?i)^\\s*by\\s+[A-Za-z][A-Za-z.'’-]*(?:\\s+(?:and\\s+)?[A-Za-z][A-Za-z.'’-]*){0,5}\\s*$"
ARTICLE = "(?i)https?://doi\\.org/|\\bReceived:\\s|\\bAccepted:\\s|\\bPublished online:"
ALGORITHM = "(?i)^\\s*algorithm\\s+[0-9]+\\b"
ALGORITHM_TITLE = "(?i)^\\s*algorithm\\s+[0-9]+\\s*[:.]"
ALGORITHM_CUE = "(?i)\\b(?:require|ensure|input|output)\\s*:|\\b[0-9]+\\s*:\\s"
STEP = "\\b[0-9]+\\s*:\\s"
REF_HEAD, REF_BODY = "^\\s*\\[[0-9]+\\]\\s", "\\bvol\\.|\\bpp\\.|\\bno\\.\\s*[0-9]|\\b(?:19|20)[0-9]{2}\\b"
ENUM, ENUM_ROMAN = "^\\s*\\(([0-9]{1,2})\\)\\s+(?=[A-Z])", "^\\s*\\((viii|vii|iii|vi|iv|ix|ii|i|v|x)\\)\\s+(?=[A-Z])"
LABEL = "^(ABSTRACT|INDEX TERMS|KEYWORDS)[\\s:;–—]+(?=\\S)"
MATH_SIGNS = "[=+−×÷·∑∏∫√∞≈≠≤≥±→←↔⇒⇐∈∉⊂⊆∪∩∧∨¬∀∃∂∇^_/<>|‖]"
# Labels of layout regions by what they hold.
FURNITURE = ("header", "footer", "number", "header_image", "footer_image", "seal", "vertical_text")
GRAPHICS = ("image", "chart", "table")
TITLES = ("doc_title", "paragraph_title")
CAPTIONS = ("figure_title", "vision_footnote")
PROSE = ("text", "abstract", "content", "footnote", "aside_text")
NAME_PARTICLES = ("de", "van", "der", "von", "da", "di", "la", "le", "du", "del", "dos", "bin", "al")


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))


def _shown(text: Column) -> Column:
    return F.trim(F.regexp_replace(X.visible(text), "\\s+", " "))


def detached_words(text: Column) -> Column:
    """Long lower-case words that are not glued to a token or behind a hyphen."""
    marked = F.regexp_replace(text, "⟦EQ[0-9]+⟧", "￼")
    return F.size(F.filter(X.all_of(marked, "(?<![A-Za-z￼-])[A-Za-z]+(?![A-Za-z￼])"), lambda w: w.rlike("^[a-z]{5,}$")))


def heading_line(text: Column, bold: Column, size: Column, body: Column) -> Column:
    """a numbered line in capitals, bold or larger type; or a bold line of capitals that is no name."""
    t = F.trim(text)
    rest = F.trim(F.regexp_replace(t, X.HEAD_PREFIX, ""))
    numbered = t.rlike(X.HEAD_PREFIX) & (F.length(t) <= 120) & rest.rlike("\\p{L}") & (X.caps_only(rest) | bold | (size - body >= 1.5))
    n = F.size(X.words(t))
    plain = ~t.rlike(X.HEAD_PREFIX) & (t != "") & (F.length(t) <= 80) & ~t.rlike("[.,;:]$") & X.caps_only(t) & bold & (size >= body - 0.5) & n.between(2, 8) & (t.endswith("?") | (X.stopword_count(t) > 0))
    return numbered | plain


def with_facts(df: DataFrame) -> DataFrame:
    """What the rules ask of a line or row: its class, whether it is prose, which part of a formula it may be.

    Needs text, size, body_size, has_math, n_signs, n_bold, n_italic.
    """
    t, shown, size, body = F.col("text"), F.col("shown"), F.col("size"), F.col("body_size")
    df = df.withColumn("shown", _shown(t)).withColumn("n_stop", X.stopword_count(F.col("shown"))).withColumn("n_detached", detached_words(t))
    bold = (F.col("n_signs") > 0) & (F.col("n_bold") >= 0.6 * F.col("n_signs"))
    italic = (F.col("n_signs") > 0) & (F.col("n_italic") >= 0.6 * F.col("n_signs"))
    df = df.withColumn("bold", bold).withColumn("prose", (F.length("shown") >= 15) & (F.col("n_stop") >= 2)).withColumn("heading", heading_line(t, F.col("bold"), size, body))
    refs, caption = F.trim(t).rlike(X.REFS_TITLE), t.rlike(X.CAPTION_START)
    formula = F.trim(t).rlike(NUMBER_ONLY) | (F.col("has_math") & (F.trim(t) != "") & (F.col("n_stop") == 0) & (X.long_words(X.visible(t)) == 0))
    shaped = (F.trim(t) != "") & ~F.col("prose") & ~refs & ~caption & ~F.col("heading") & (F.length("shown") <= 40) & (F.col("n_stop") == 0) & (F.col("n_detached") <= 1)
    ends = shown.rlike("[.!?]$")
    part = F.col("has_math") | (~ends & ((size <= 0.85 * body) | italic | (F.length("shown") <= 30)))
    return df.select(
        "*", refs.alias("refs"), caption.alias("caption"),
        F.when(refs, "refs_title").when(formula, "formula").when(F.col("heading"), "heading").otherwise("normal").alias("cls"),
        (shaped & F.col("has_math") & (size >= 0.85 * body) & ~((F.col("n_detached") > 0) & ends)).alias("math_seed"),
        (shaped & (shown != "") & ~ends).alias("centred_shape"), (shaped & part).alias("fragment"), (t.rlike("⟦EQ[0-9]+⟧") | X.visible(t).rlike(MATH_SIGNS)).alias("evidence"),
        X.ends_paragraph(t).alias("ends"), (F.length(F.regexp_replace("shown", "\\s", "")) <= 20).alias("short"),
    )


# --- lines to rows ---------------------------------------------------------------------------------------------------


def page_flow(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Each line with `furniture`, and for the others band and column; display equations are left out."""
    placed = L.with_page(lines.where(~F.col("text").rlike(EQ_ONLY)), pages)
    placed = L.with_extent(placed).withColumn("furniture", L.furniture())
    content = placed.where(~F.col("furniture"))
    block = content.groupBy(*PAGE, "block_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.first("width").alias("width"))
    page = Window.partitionBy(*PAGE)
    block = block.withColumn("cx0", F.min("x0").over(page)).withColumn("cx1", F.max("x1").over(page))
    block = block.withColumn("full", G.full_width(G.box("x0", "y0", "x1", "y0"), F.col("cx0"), F.col("cx1")))
    banded = islands.bands(block, PAGE, ["y0", "block_no"], F.col("full"))
    cols = folds.column_numbers(banded, [*PAGE, "band"], ["block_no"], "width")
    where = cols.select(*PAGE, "block_no", "band", F.when(F.col("full"), 0).otherwise(F.col("col")).alias("col"))
    return placed.join(where, [*PAGE, "block_no"], "left")


def rows_of(lines: DataFrame, key: str = "region_key") -> DataFrame:
    """The lines of a column with `row_no`; lines side by side in running text share one.

    `lines` has facts. Rows of two regions, rows indented beyond the prose and rows with a heading stay apart.
    """
    col = Window.partitionBy(*COLUMN)
    inner = lines.withColumn("prose_x0", F.min(F.when(F.col("prose"), F.col("x0"))).over(col)).withColumn("indent", F.greatest(F.lit(12.0), 0.08 * (F.max("x1").over(col) - F.min("x0").over(col))))
    grouped = folds.overlap_groups(inner, COLUMN, ["y0", "x0", "block_no", "line_no"], "grp")
    g = Window.partitionBy(*COLUMN, "grp")
    known = F.when(F.col(key) >= 0, F.col(key))
    one = F.coalesce(F.min(known).over(g) == F.max(known).over(g), F.lit(True))
    joined = one & (F.min("x0").over(g) <= F.col("prose_x0") + F.col("indent")) & ~F.max("heading").over(g)
    # each joined group is one row, and each line of the others
    order = Window.partitionBy(*COLUMN).orderBy("grp", "y0", "x0", "block_no", "line_no")
    marked = grouped.withColumn("joined", F.coalesce(joined, F.lit(False)))
    first = F.when(F.col("joined") & (F.lag("grp").over(order) == F.col("grp")), 0).otherwise(1)
    return marked.withColumn("__first", first).withColumn("row_no", F.sum("__first").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__first", "grp", "joined")


def joined_rows(spans: DataFrame, placed: DataFrame) -> DataFrame:
    """The text, box and style of each row, its cells (non-blank spans) and its first sign for markers."""
    s = spans.dropDuplicates([*L.LINE, "span_no"]).withColumn("text", F.coalesce("text", F.lit("")))
    where = placed.select(*L.LINE, *COLUMN[2:], "row_no", F.col("x0").alias("line_x0"), "body_size", "region_key")
    m = s.join(where, L.LINE)
    size = L.majority(m, ROW)
    shown = F.trim(F.col("text")) != ""
    place = F.struct("line_x0", "block_no", "line_no", "span_no")
    n = F.length(F.regexp_replace("text", "\\s", ""))
    share = lambda c: F.sum(F.when(c, n).otherwise(0))
    by_line = m.groupBy(*ROW, "block_no", "line_no").agg(
        F.first("line_x0").alias("line_x0"), F.first("body_size").alias("body_size"), F.min("region_key").alias("region_key"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.sum(n).alias("n_signs"), share(L.bold(F.col("font"), F.col("flags"))).alias("n_bold"), share(L.italic(F.col("font"), F.col("flags"))).alias("n_italic"),
        F.max(L.math_font(F.col("font")) & shown).alias("has_math"), F.min_by(F.struct(L.math_font(F.col("font")).alias("math"), (F.col("x1") - F.col("x0")).alias("width")), F.when(shown, place)).alias("lead"),
        F.collect_list(F.when(shown, F.struct("x0", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text")))).alias("cells"),
    )
    order = F.struct("line_x0", "block_no", "line_no")
    glue = lambda a, t: F.when((a == "") | a.rlike("[ \\t]$") | t.rlike("^[ \\t]"), F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t))
    rows = by_line.groupBy(*ROW).agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("line_x0", "block_no", "line_no", "text"))), F.lit(""), lambda a, x: glue(a, x["text"])).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n_signs").alias("n_signs"), F.sum("n_bold").alias("n_bold"), F.sum("n_italic").alias("n_italic"),
        F.max("has_math").alias("has_math"), F.min_by("lead", order).alias("lead"), F.flatten(F.collect_list("cells")).alias("cells"), F.first("body_size").alias("body_size"), F.max("region_key").alias("region_key"),
    )
    return rows.join(size.withColumnRenamed("majority", "size"), ROW)


# --- markers and zones -----------------------------------------------------------------------------------------------


def enumerated(rows: DataFrame) -> DataFrame:
    """The rows that open an item (n) of a run n, n+1, ... over columns and pages; decimal and Roman runs apart."""
    col = Window.partitionBy(*COLUMN).orderBy("row_no")
    t = F.col("text")
    roman = F.regexp_extract(t, ENUM_ROMAN, 1)
    number = F.when(t.rlike(ENUM), F.regexp_extract(t, ENUM, 1).cast("int")).when(roman != "", X.roman_value(roman))
    stream = F.when(t.rlike(ENUM), "number").otherwise("roman")
    open_ = F.coalesce(F.lag("ends").over(col), F.lit(True))
    found = rows.withColumn("number", number).withColumn("stream", stream).withColumn("open", open_).where("number IS NOT NULL AND open")
    keys, order, block = ["doc_id", "stream"], ["page", "band", "col", "row_no"], F.floor(F.col("page") / PAGE_BLOCK)
    run = blocks.runs(blocks.lag(found.select(*ROW, "stream", "number"), keys, block, order, "number", "last"), keys, block, order, F.col("number") != F.col("last") + 1)
    sizes = run.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*keys, "run")
    return run.join(sizes, [*keys, "run"]).select(*ROW)


def fired_markers(rows: DataFrame) -> DataFrame:
    """Adds `fired`: bullets, enumerated rows, and markers with another of their family within 8 rows at the same edge."""
    family = X.marker_family(X.list_marker(F.col("text"))["marker"])
    narrow = F.col("lead.math") & (F.col("lead.width") <= 0.75 * F.col("size"))
    df = rows.withColumn("family", F.when((family != "eqmark") | narrow, family))
    near = Window.partitionBy(*COLUMN).orderBy("row_no").rowsBetween(-8, 8)
    others = F.collect_list(F.when(F.col("family").isNotNull(), F.struct("row_no", "family", "x0"))).over(near)
    sibling = F.exists(others, lambda o: (o["row_no"] != F.col("row_no")) & (o["family"] == F.col("family")) & (F.abs(o["x0"] - F.col("x0")) <= 3))
    forced = enumerated(rows).withColumn("forced", F.lit(True))
    df = df.join(forced, ROW, "left")
    return df.withColumn("fired", F.coalesce((F.col("family") == "bullet") | (F.col("family").isNotNull() & (sibling | F.col("forced"))), F.lit(False))).drop("forced")


def with_zones(rows: DataFrame) -> DataFrame:
    """Adds `zone`, the number of the formula zone of a row in its column, or null.

    Seeds are math rows indented past the column's edge, lone numbers at its right edge, and chains of centred rows
    with math among them. Islands of seeds and fragments with gaps of 3 pt at most that hold a seed are zones. Fired
    markers and rows beside prose take no part.
    """
    col = Window.partitionBy(*COLUMN)
    prose = F.col("prose")
    df = rows.withColumn("px0", F.min(F.when(prose, F.col("x0"))).over(col)).withColumn("px1", F.max(F.when(prose, F.col("x1"))).over(col))
    df = df.withColumn("cx0", F.min("x0").over(col)).withColumn("edge", F.coalesce("px1", F.max("x1").over(col)))
    lines_of_prose = F.collect_list(F.when(prose, F.struct("y0", "y1"))).over(col)
    beside = F.exists(lines_of_prose, lambda p: F.least("y1", p["y1"]) - F.greatest("y0", p["y0"]) > 0.5 * F.greatest(F.least(F.col("y1") - F.col("y0"), p["y1"] - p["y0"]), F.lit(0.1)))
    df = df.withColumn("free", ~F.col("fired") & ~beside)
    lone = F.trim("text").rlike(NUMBER_ONLY) & (F.col("x1") >= F.col("edge") - 0.05 * F.greatest(F.col("edge") - F.col("cx0"), F.lit(1.0)))
    df = df.withColumn("seed", F.col("free") & F.when(F.trim("text").rlike(NUMBER_ONLY), lone).otherwise(F.col("math_seed") & (F.col("x0") > F.col("cx0") + 2)))
    margin = 0.15 * (F.col("px1") - F.col("px0"))
    df = df.withColumn("centred", F.coalesce(F.col("free") & ~F.col("seed") & F.col("centred_shape") & (F.col("x0") >= F.col("px0") + margin) & (F.col("x1") <= F.col("px1") - margin), F.lit(False)))
    df = _islands_among(df, F.col("centred"), "chain")
    chain = Window.partitionBy(*COLUMN, "chain")
    df = df.withColumn("seed", F.col("seed") | (F.col("centred") & F.max("evidence").over(chain)))
    df = _islands_among(df, F.col("seed") | (F.col("free") & F.col("fragment")), "island")
    zone = Window.partitionBy(*COLUMN, "island")
    return df.withColumn("zone", F.when(F.col("island").isNotNull() & F.max("seed").over(zone), F.col("island"))).drop("chain", "island", "seed", "centred", "cx0", "edge", "free", "px1")


def _islands_among(df: DataFrame, member: Column, name: str) -> DataFrame:
    """Numbers islands of the rows where `member` holds, with gaps of 3 pt at most; null for other rows."""
    w = Window.partitionBy(*COLUMN).orderBy("y0", "row_no")
    df = df.withColumn("__in", member)
    reach = F.max(F.when(F.col("__in"), F.col("y1"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.when(F.col("__in") & (reach.isNull() | (F.col("y0") > reach + 3)), 1).otherwise(0))
    return df.withColumn(name, F.when(F.col("__in"), F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__in", "__new")


# --- rows to segments ------------------------------------------------------------------------------------------------


def first_segments(rows: DataFrame, furniture: DataFrame, regions: DataFrame | None) -> DataFrame:
    """Paragraphs with their first kind in reading order, furniture last: seg_id, idx, col, kind, text, size, box."""
    numbered = folds.paragraph_numbers(rows, regions)
    # rows of a paragraph in their order
    para = [*COLUMN, "para_no"]
    parts = F.array_sort(F.collect_list(F.struct("row_no", "text", "size", "n_signs", "y0")))
    p = numbered.groupBy(*para).agg(
        parts.alias("parts"), F.first("para_kind").alias("first_kind"), F.first("body_size").alias("body_size"), F.max_by("size", F.struct("n_signs", -F.col("row_no"))).alias("size"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    p = p.withColumn("text", X.hyphen_join(F.transform("parts", lambda x: x["text"]))).withColumn("top", F.col("parts")[0]["y0"]).where("text <> ''")
    t = F.col("text")
    tail = F.trim(t).rlike(NUMBER_TAIL) & F.length(X.dense(t)).between(1, 160)
    few = (F.size(F.filter(X.words(X.visible(t)), lambda w: w.rlike("^[a-z]{5,}$") | F.lower(w).isin(*X.STOPWORDS)))) < 2
    signs = F.length(F.regexp_replace(X.dense(t), f"[^{MATH_SIGNS[1:]}", ""))
    looks_formula = tail & few & (t.rlike("⟦EQ[0-9]+⟧") | (signs >= 0.15 * F.length(X.dense(t))))
    forced = F.when(F.col("first_kind") == "list", "body").when(F.col("first_kind") != "body", F.col("first_kind"))
    kind = F.coalesce(forced, F.when(t.rlike(X.CAPTION_START), "caption").when(F.col("size") - F.col("body_size") >= 1.5, "heading").when(looks_formula, "formula").otherwise("body"))
    p = p.withColumn("kind", kind).withColumn("label", F.when(F.col("first_kind") == "body", F.regexp_extract("text", LABEL, 1)).otherwise(""))
    # a label in front of the text of a paragraph is a heading of its own
    height = F.least(F.col("y1") - F.col("y0"), 1.2 * F.col("size"))
    share = F.col("x0") + F.length("label") * 0.6 * F.col("size")
    both = F.when(F.col("label") == "", F.array(F.struct(F.lit(0).alias("piece"), "kind", "text", *BOX))).otherwise(
        F.array(
            F.struct(F.lit(0).alias("piece"), F.lit("heading").alias("kind"), F.col("label").alias("text"), "x0", "y0", F.least(share, "x1").alias("x1"), (F.col("y0") + height).alias("y1")),
            F.struct(F.lit(1).alias("piece"), F.lit("body").alias("kind"), F.regexp_replace("text", LABEL, "").alias("text"), "x0", F.when(F.col("y1") - F.col("y0") > height, F.col("y0") + height).otherwise(F.col("y0")).alias("y0"), "x1", "y1"),
        )
    )
    content = p.select(*para, "top", "size", "body_size", F.explode(both).alias("s")).select(*para, "top", "size", "body_size", "s.*")
    rest = furniture.where(F.trim("text") != "").select(*PAGE, F.lit(1 << 30).cast("long").alias("band"), F.lit(0).alias("col"), F.col("block_no").alias("para_no"), F.col("y0").alias("top"), "size", "body_size", F.col("line_no").alias("piece"), F.lit("header_footer").alias("kind"), F.trim("text").alias("text"), *BOX)
    w = Window.partitionBy(*PAGE).orderBy("band", F.when(F.col("kind") == "header_footer", 0).otherwise(F.col("col")), "top", "para_no", "piece")
    both = content.unionByName(rest).withColumn("idx", F.row_number().over(w) - 1)
    return both.select(*PAGE, F.format_string("p%d_s%d", "page", "idx").alias("seg_id"), "idx", "col", "kind", "text", "size", "body_size", *BOX)


def merged_headings(segs: DataFrame, regions: DataFrame | None) -> DataFrame:
    """Headings that go on in the next segment become one; the first id and size stay."""
    if regions is None:
        segs = segs.withColumn("in_region", F.lit(None).cast("int"))
    else:
        best = spatial.best_region(segs.select(*PAGE, "seg_id", G.box(*BOX).alias("b")), regions.select(*PAGE, "region_no", F.col("box").alias("rb")), ["seg_id"])
        segs = segs.join(best.select(*PAGE, "seg_id", F.when(F.col("share") >= 0.5, F.col("region_no")).alias("in_region")), [*PAGE, "seg_id"])
    numbered = folds.heading_groups(segs)
    out = numbered.groupBy(*PAGE, "grp").agg(
        F.min_by(F.struct("seg_id", "idx", "col", "kind", "size", "body_size"), "idx").alias("h"), X.hyphen_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return out.select(*PAGE, "h.*", "text", *BOX)


# --- passes ----------------------------------------------------------------------------------------------------------


def author_list(text: Column) -> Column:
    """three names or more, and four fifths of all parts; affiliation marks do not count."""
    bare = F.regexp_replace(text, "(?<=[A-Za-z.])[\\d*†‡§¶#✉]+(?:,[\\d*†‡§¶#✉]+)*", "")
    parts = F.filter(F.transform(F.split(bare, ",|&|\\band\\b"), lambda p: F.trim(p)), lambda p: p != "")
    name = lambda p: F.size(F.split(p, "\\s+")).between(2, 5) & ~p.rlike("[0-9]") & F.forall(F.split(p, "\\s+"), lambda w: w.rlike("^\\p{Lu}") | F.lower(w).isin(*NAME_PARTICLES))
    return (F.size(parts) >= 3) & (F.size(F.filter(parts, name)) >= 0.8 * F.size(parts))


def author_pass(segs: DataFrame, pages: DataFrame) -> DataFrame:
    """Body segments of the first page that name authors, affiliations or the article's dates."""
    first = pages.groupBy("doc_id").agg(F.min_by(F.struct(F.col("page").alias("first"), "height"), "page").alias("p")).select("doc_id", "p.*")
    front = segs.join(first, "doc_id").where((F.col("page") == F.col("first")) & (F.col("kind") != "header_footer"))
    marks = front.groupBy("doc_id").agg(
        F.max_by(F.struct("idx", "size", "y0", "y1"), F.struct("size", -F.col("idx"))).alias("title"),
        F.min_by(F.struct("idx", "y0"), F.when(F.col("text").rlike(ABSTRACT), F.col("idx"))).alias("abstract"),
    )
    f = front.join(marks, "doc_id")
    real = (F.col("title.size") >= F.col("body_size") + 2) & (F.col("title.y0") <= 0.5 * F.col("height"))
    below = real & (F.col("y0") >= F.col("title.y1") - 2)
    t, on_top = F.col("text"), F.col("y1") <= 0.45 * F.col("height")
    cues = F.regexp_count(t, F.lit(AUTHOR_CUE))
    is_author = (
        (below & (F.col("y1") <= F.col("abstract.y0") + 2)) | ((cues > 0) & on_top & (~real | below)) | (on_top & author_list(t)) | t.rlike(BYLINE)
        | (t.rlike(ARTICLE) & (F.length(t) < 400)) | ((F.col("size") < F.col("body_size") - 0.5) & (cues >= 2))
    )
    other = ~(real & (F.col("idx") == F.col("title.idx"))) & ~F.coalesce(F.col("idx") == F.col("abstract.idx"), F.lit(False))
    hits = f.where((F.col("kind") == "body") & other & F.coalesce(is_author, F.lit(False))).select(*PAGE, "seg_id")
    return _set_kind(segs, hits, "author")


def _set_kind(segs: DataFrame, hits: DataFrame, kind: str) -> DataFrame:
    marked = hits.distinct().withColumn("__hit", F.lit(True))
    return segs.join(marked, [*PAGE, "seg_id"], "left").withColumn("kind", F.when(F.col("__hit"), kind).otherwise(F.col("kind"))).drop("__hit")


def _inside(segs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Body and heading segments whose centre lies in a box of their page."""
    items = segs.where(F.col("kind").isin("body", "heading")).select(*PAGE, "seg_id", G.box(*BOX).alias("b"))
    return spatial.with_centre_in(items, boxes.select(*PAGE, G.box(*BOX).alias("rb")), ["seg_id"]).select(*PAGE, "seg_id")


def captions_of(segs: DataFrame) -> DataFrame:
    """The caption of each key; a mark behind the number beats others, then the first."""
    c = segs.where("kind = 'caption'").withColumn("key", X.caption_key(F.col("text"))).where("key IS NOT NULL")
    strong = F.col("text").rlike(f"{X.CAPTION}\\s*[.:]")
    best = c.groupBy("doc_id", "key").agg(F.min_by(F.struct("page", "seg_id", "idx", *BOX), F.struct(~strong, "page", "idx")).alias("c"), F.min(F.struct("page", "idx")).alias("o"))
    return best.select("doc_id", "key", "c.*", (F.col("o.page") * 1_000_000 + F.col("o.idx")).alias("ordinal"))


def figure_pass(segs: DataFrame, graphics: DataFrame, pages: DataFrame) -> DataFrame:
    """C4: text inside the graphic regions that captions claim."""
    inner = L.with_page(graphics, pages).where(~G.in_band(G.box(*BOX), F.col("height")))
    return _set_kind(segs, _inside(segs, folds.claim_figures(captions_of(segs), inner)), "figure_text")


def algorithm_pass(segs: DataFrame, lines: DataFrame, drawings: DataFrame | None) -> DataFrame:
    """Segments in the drawn box around an algorithm's header, or the run of indented steps behind the header."""
    heads = lines.where(F.trim("text").rlike(ALGORITHM)).select(*PAGE, "block_no", "line_no", "bold", G.box(*BOX).alias("b"))
    boxed = None
    if drawings is not None:
        key = ["block_no", "line_no"]
        d = drawings.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy(*BOX)).alias("region_no"), G.box(F.col("x0"), F.col("y0") - 2, F.col("x1"), F.col("y1") + 2).alias("rb"))
        around = spatial.smallest_enclosing(heads, d, key).join(d, [*PAGE, "region_no"])
        boxed = around.select(*PAGE, *key)
        hits = _inside(segs, around.select(*PAGE, F.col("rb.x0").alias("x0"), (F.col("rb.y0") + 2).alias("y0"), F.col("rb.x1").alias("x1"), (F.col("rb.y1") - 2).alias("y1")))
        heads = heads.join(boxed, [*PAGE, *key], "left_anti")
    at = segs.where(F.col("kind").isin("body", "heading")).select(*PAGE, F.col("idx").alias("region_no"), G.box(*BOX).alias("rb"))
    held = spatial.first_holding(heads, at, ["block_no", "line_no"]).join(heads, [*PAGE, "block_no", "line_no"]).select(*PAGE, F.col("region_no").alias("head"), "bold").where("head IS NOT NULL")
    opened = held.groupBy(*PAGE, "head").agg(F.max("bold").alias("bold")).join(segs.select(*PAGE, F.col("idx").alias("head"), F.col("text").alias("head_text"), G.box(*BOX).alias("hb")), [*PAGE, "head"])
    opened = opened.where(F.col("head_text").rlike(ALGORITHM_TITLE) | F.col("bold") | F.col("head_text").rlike(ALGORITHM_CUE))
    behind = segs.join(opened, PAGE).where(F.col("idx") >= F.col("head"))
    b = G.box(*BOX)
    fits = (F.col("kind") == "body") & (F.col("y0") >= F.col("hb.y0") - 1) & (G.x_overlap(b, F.col("hb")) > 0) & ((F.col("x0") >= F.col("hb.x0") + 2) | F.substring("text", 1, 12).rlike(STEP))
    w = Window.partitionBy(*PAGE, "head").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max((F.col("idx") > F.col("head")) & (F.col("kind") != "formula") & ~fits).over(w)
    run = behind.withColumn("ended", ended).where(~F.col("ended") & (F.col("kind") != "formula")).select(*PAGE, "seg_id")
    return _set_kind(segs, run if boxed is None else run.unionByName(hits), "algorithm")


def table_pass(segs: DataFrame, rows: DataFrame, drawings: DataFrame | None) -> DataFrame:
    """Text of tables set without graphics, below their caption or else above it."""
    caps = captions_of(segs).where(F.col("key").startswith("table"))
    found = folds.table_regions(caps, rows, drawings)
    return _set_kind(segs, _inside(segs, found), "figure_text")


def reference_pass(segs: DataFrame) -> DataFrame:
    """What follows the references title, and entries of its shape anywhere."""
    t = F.col("text")
    title = (F.col("kind") == "heading") & F.trim(t).rlike(X.REFS_TITLE)
    s = blocks.after_first(segs, ["doc_id"], ["page", "idx"], title, "in_refs")
    entry = (F.col("kind") == "body") & t.rlike(REF_HEAD) & t.rlike(REF_BODY)
    return s.withColumn("kind", F.when((F.col("in_refs") & F.col("kind").isin("body", "caption", "heading")) | entry, "reference").otherwise(F.col("kind"))).drop("in_refs")


def kind_in_region(kind: Column, text: Column, label: Column, score: Column, share: Column) -> Column:
    """The kind a segment takes from the layout region it lies in."""
    n, t = _word_count(text), F.trim(text)
    asked = X.words(text)
    prose = (n > 25) & (F.size(asked) > 0) & (X.stopword_count(text) >= 0.1 * F.size(asked))
    is_in = lambda *k: kind.isin(*k)
    uncovered = label.isNull() | (share < 0.2)
    return (
        F.when(is_in("author", "header_footer"), kind)
        .when(uncovered, F.when((kind == "body") & (n <= 12), "figure_text").otherwise(kind))
        .when(share < 0.5, kind)
        .when(label.isin(*FURNITURE), F.when(is_in("body", "heading", "caption"), "header_footer").otherwise(kind))
        .when(label.isin(*GRAPHICS), F.when(is_in("body", "heading") & ((label != "image") | ~prose), "figure_text").otherwise(kind))
        .when(label == "algorithm", F.when(is_in("body", "heading"), "algorithm").otherwise(kind))
        .when(label == "reference_content", F.when(kind == "body", "reference").otherwise(kind))
        .when(label.isin("display_formula", "formula_number"), F.when((kind == "body") & (F.contains(text, F.lit("⟦EQ")) | (n <= 6)), "formula").otherwise(kind))
        .when(label.isin(*TITLES), F.when((kind == "body") & (n <= 20), "heading").otherwise(kind))
        .when(label.isin(*CAPTIONS), F.when(~is_in("body", "heading", "caption"), kind).when(F.length(t) <= 2, "figure_text").otherwise("caption"))
        .when(label.isin(*PROSE), F.when((kind == "heading") & (n > 20), "body").when((kind == "figure_text") & (n >= 12) & (score >= 0.8), "body").otherwise(kind))
        .otherwise(kind)
    )


def region_pass(segs: DataFrame, regions: DataFrame) -> DataFrame:
    """C8 on all segments of pages that have regions."""
    r = regions.select(*PAGE, "region_no", F.col("box").alias("rb"))
    best = spatial.best_region(segs.select(*PAGE, "seg_id", G.box(*BOX).alias("b")), r, ["seg_id"])
    known = best.join(regions.select(*PAGE, "region_no", "label", "score"), [*PAGE, "region_no"], "left").select(*PAGE, "seg_id", "share", "label", "score")
    have = regions.select(*PAGE).distinct().withColumn("__has", F.lit(True))
    s = segs.join(known, [*PAGE, "seg_id"], "left").join(have, PAGE, "left")
    kind = F.when(F.col("__has"), kind_in_region(F.col("kind"), F.col("text"), F.col("label"), F.col("score"), F.coalesce("share", F.lit(0.0)))).otherwise(F.col("kind"))
    return s.withColumn("kind", kind).drop("share", "label", "score", "__has")


def build_segments(spans: DataFrame, pages: DataFrame, regions: DataFrame | None = None, graphics: DataFrame | None = None) -> DataFrame:
    """Classified segments in reading order: doc_id, page, seg_id, idx, col, kind, text, size, box.

    The passes run in their order: paragraphs, headings, authors, figures, algorithms, text tables, references, regions.
    """
    pages = pages.select(*PAGE, "width", "height").dropDuplicates(PAGE)
    flow = flow_of(spans, pages)
    rows = zoned_rows(spans, flow, regions)
    segs = cut(merged_headings(cut(first_segments(rows, flow.where("furniture"), regions), "paragraphs"), regions), "segments")
    segs = cut(author_pass(segs, pages), "segments")
    drawings = None if graphics is None else graphics.where("type = 'drawing'")
    if graphics is not None:
        segs = cut(figure_pass(segs, graphics, pages), "segments")
    segs = cut(algorithm_pass(segs, flow, drawings), "segments")
    segs = cut(table_pass(segs, flow.join(line_cells(spans), L.LINE), drawings), "segments")
    segs = reference_pass(segs)
    if regions is not None:
        segs = region_pass(cut(segs, "segments"), regions)
    return segs.select(*PAGE, "seg_id", "idx", "col", "kind", "text", "size", *BOX)


def flow_of(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with size, facts, furniture, band and column."""
    sizes = L.majority_size(spans, L.LINE).withColumnRenamed("majority", "size")
    body = L.body_sizes(spans, pages).withColumnRenamed("majority", "body_size")
    lines = cut(L.lines_of(spans).join(sizes, L.LINE).join(body, "doc_id"), "lines")
    return cut(with_facts(page_flow(lines, pages)), "flow")


def rows_in_flow(spans: DataFrame, flow: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """The rows of the columns, with facts."""
    content = flow.where(~F.col("furniture"))
    if regions is None:
        content = content.withColumn("region_key", F.lit(-1))
    else:
        keys = spatial.region_key(content.select(*L.LINE, G.box(*BOX).alias("b")), regions.select(*PAGE, "region_no", F.col("box").alias("rb")), ["block_no", "line_no"])
        content = content.join(keys, L.LINE)
    return cut(with_facts(joined_rows(spans, cut(rows_of(content), "places"))), "rows")


def zoned_rows(spans: DataFrame, flow: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """The rows with markers that open items and formula zones."""
    return cut(with_zones(fired_markers(rows_in_flow(spans, flow, regions))), "zones")


def line_cells(spans: DataFrame) -> DataFrame:
    """The non-blank spans of each line: text and left edge."""
    s = spans.dropDuplicates([*L.LINE, "span_no"]).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return s.groupBy(*L.LINE).agg(F.collect_list(F.struct("x0", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text"))).alias("cells"))
