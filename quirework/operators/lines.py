"""Lines and pages from spans: ordered concatenation, union boxes, majority styles, page extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X

LINE = ["doc_id", "page", "block_no", "line_no"]
# Font-name marks of math fonts; the last one is generic and vetoed by a Roman style name.
MATH_FONTS = ("CMMI", "CMSY", "CMEX", "MTMI", "MTSY", "MTEX", "BLEX", "MSAM", "MSBM", "MATH")
# Signs that stay literal in math fonts.
LITERALS = "0-9.,;:!?()\\[\\]{}|/\\\\%=<>+±−×÷·∗*≤≥≈≃≅∼~≠≲≳•◦▪"
DROP_CAP_SIZE = 20.0


def math_font(font: Column) -> Column:
    """Whether a font name belongs to a math font; null names do not."""
    up = F.upper(F.coalesce(font, F.lit("")))
    named = up.rlike("|".join(MATH_FONTS[:-1]))
    style = F.regexp_extract(F.regexp_replace(up, "^.*\\+", ""), "^[^-]*-(.*)$", 1)
    return named | (up.rlike(MATH_FONTS[-1]) & ~style.rlike("ROMAN"))


def literal(text: Column) -> Column:
    """One or two visible signs, all digits, punctuation or relations."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\\s", "").rlike(f"^[{LITERALS}]{{1,2}}$")


def drop_cap(text: Column, size: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\\s", "").rlike("^\\p{L}$") & (size >= DROP_CAP_SIZE)


def masked_math(text: Column, font: Column, size: Column) -> Column:
    return ~drop_cap(text, size) & (F.trim(F.coalesce(text, F.lit(""))) != "") & math_font(font) & ~literal(text)


def bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(16) > 0) | F.lower(F.coalesce(font, F.lit(""))).rlike("bold|black|heavy")


def italic(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(2) > 0) | F.lower(F.coalesce(font, F.lit(""))).rlike("ital|obli")


def lines_of(spans: DataFrame) -> DataFrame:
    """One row per line: text of its spans in order, union box, shares of bold and italic signs.

    Repeated spans count once; null texts count as empty.
    """
    s = spans.dropDuplicates([*LINE, "span_no"]).withColumn("text", F.coalesce("text", F.lit("")))
    n = F.length(F.regexp_replace("text", "\\s", ""))
    share = lambda c: F.sum(F.when(c, n).otherwise(0))
    return s.groupBy(*LINE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.sum(n).alias("n_signs"), share(bold(F.col("font"), F.col("flags"))).alias("n_bold"), share(italic(F.col("font"), F.col("flags"))).alias("n_italic"),
        F.max(math_font(F.col("font"))).alias("has_math"), F.count(F.lit(1)).alias("n_spans"),
    )


def majority(spans: DataFrame, keys: list[str]) -> DataFrame:
    """A3: the size (one decimal) most signs of a group have, an empty span as one sign; of equal ones the first seen. Spans are distinct."""
    by = spans.withColumn("n", F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))).groupBy(*keys, (F.floor(F.col("size") * 10 + 0.5) / 10).alias("majority"))
    return _most(by.agg(F.sum("n").alias("weight"), F.min(F.struct("page", "block_no", "line_no", "span_no")).alias("seen")), keys)


def _most(by: DataFrame, keys: list[str]) -> DataFrame:
    best = by.groupBy(*keys).agg(F.min_by("majority", F.struct(-F.col("weight"), "seen")).alias("majority"))
    return best.select(*keys, "majority")


def majority_size(spans: DataFrame, keys: list[str]) -> DataFrame:
    """`majority` of spans that may be repeated."""
    return majority(spans.dropDuplicates([*LINE, "span_no"]), keys)


def body_sizes(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """A2: the size most signs of a document have outside the bands of page furniture; 10 if there are none."""
    s = spans.dropDuplicates([*LINE, "span_no"])
    lines = s.groupBy(*LINE).agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.collect_list(F.struct("span_no", "size", F.length(F.coalesce("text", F.lit(""))).alias("n"))).alias("spans"))
    inner = with_page(lines, pages).where((F.col("bottom") > F.col("height") * G.BAND) & (F.col("top") < F.col("height") * (1 - G.BAND)))
    each = inner.select(*LINE, F.inline("spans")).groupBy("doc_id", (F.floor(F.col("size") * 10 + 0.5) / 10).alias("majority"))
    most = _most(each.agg(F.sum("n").alias("weight"), F.min(F.struct("page", "block_no", "line_no", "span_no")).alias("seen")), ["doc_id"])
    return spans.select("doc_id").distinct().join(most, "doc_id", "left").select("doc_id", F.coalesce("majority", F.lit(10.0)).alias("majority"))


def with_page(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds width and height of the page."""
    return lines.join(pages.select("doc_id", "page", "width", "height").dropDuplicates(["doc_id", "page"]), ["doc_id", "page"])


def with_extent(lines: DataFrame) -> DataFrame:
    """Adds text_left and text_right, the extent of the lines of a page that do not lie in its side margins; needs width."""
    inner = (F.col("x0") < F.col("width") * (1 - G.SIDE)) & (F.col("x1") > F.col("width") * G.SIDE)
    page = Window.partitionBy("doc_id", "page")
    left = F.coalesce(F.min(F.when(inner, F.col("x0"))).over(page), F.col("width") * G.SIDE)
    right = F.coalesce(F.max(F.when(inner, F.col("x1"))).over(page), F.col("width") * (1 - G.SIDE))
    return lines.withColumn("text_left", left).withColumn("text_right", right)


def furniture() -> Column:
    """F8: lines in the top and bottom band, or wholly in a side margin outside the text's extent; needs width, height, text_left, text_right."""
    banded = G.in_band(G.box("x0", "y0", "x1", "y1"), F.col("height"))
    right = (F.col("x0") >= F.col("width") * (1 - G.SIDE)) & (F.col("x0") >= F.col("text_right"))
    return banded | right | ((F.col("x1") <= F.col("width") * G.SIDE) & (F.col("x1") <= F.col("text_left")))
