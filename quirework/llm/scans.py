"""Repair of text from scanned pages: running headers, page numbers, broken words and misread characters.

Method: words are grouped by the skeleton of confusable glyphs, and in each group a frequent form replaces rare
ones; of several frequent forms the word before decides. Headers are lines that repeat over pages once
digits are masked and glyphs are reduced to their skeleton; paragraphs are reflowed with SQL windows.

All steps are DataFrame operations. Windows run over one page, or over blocks of at most PAGE_BLOCK pages of a
document, so that a document holding a third of all pages is not sorted in one task.

Defined results: lines without text (null, empty or blank) have no defects and add nothing to a paragraph;
repeated rows count once; a page without lines gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

PAGE_BLOCK = 512  # pages of a document whose order is found in one window
FREQUENT = 3  # least count of a form that replaces others
RARER = 8  # a form is misread if a frequent form of its skeleton occurs so many times as often
TALL = 1.5  # a line so many times as high as the lowest of its page is set as a title
EDGE = 2  # lines at the top and bottom of a page that can be furniture

# Glyph groups that scanners confuse; each maps to one sign of the skeleton.
DIGITS = ("01586", "oisbe")
GLYPH_PAIRS = (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("fi", "h"))
GLYPHS = ("alcfqhéèüöä", "oietgbeeuoo")
_MARKS = "\\-\\u2010\\u2011\\u00ac\\u00ad"
_SURE_MARKS = "\\u00ac\\u00ad"


def skeleton(word: Column) -> Column:
    """The word with confusable glyphs merged."""
    w = F.translate(F.lower(word), *DIGITS)
    for pair, one in GLYPH_PAIRS:
        w = F.replace(w, F.lit(pair), F.lit(one))
    return F.translate(w, *GLYPHS)


def _letters_only(text: Column) -> Column:
    """Header key: case, blanks, digits and punctuation do not count, confusable glyphs are merged."""
    plain = F.regexp_replace(F.lower(text), "^[\\s\\d]+|[\\s\\d]+$", "")
    plain = F.translate(plain, "01l58", "oiisb")
    return F.regexp_replace(F.regexp_replace(plain, "\\d", "#"), "[^\\p{L}#]", "")


def number_of(text: Column) -> Column:
    """The figure of a line that holds nothing but a page number, else null; misread digits are read as digits."""
    bare = F.regexp_replace(F.trim(text), "(?i)^(?:page|p\\.|pp\\.|seite|s\\.|pag\\.)\\s*|^[\\[(\\-–—~\\s]+|[\\])\\-–—~\\s]+$", "")
    bare = F.regexp_replace(bare, "\\s*(?:/|of|von|sur)\\s*[\\dlOoIi]+$", "")
    digits = F.translate(bare, "lIiOoSsB", "11100558")
    arabic = bare.rlike("^[\\dlIiOoSsB]{1,5}$") & bare.rlike("\\d")
    roman_text = F.translate(F.lower(bare), "1", "i")
    roman = roman_text.rlike("^(?=.)m{0,4}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})$")
    return F.when(arabic, F.try_to_number(digits, F.lit("99999")).cast("int")).when(roman, roman_value(roman_text))


def roman_value(text: Column) -> Column:
    """The value of a lower-case Roman numeral."""
    worth = F.create_map(*[F.lit(x) for pair in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair])
    values = F.transform(F.split(text, "(?<=.)(?=.)"), lambda c: worth[c])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    walked = F.aggregate(
        F.reverse(values),
        start,
        lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["last"], -v).otherwise(v)).alias("sum"), F.greatest(acc["last"], v).alias("last")),
    )
    return walked["sum"]


_NAME = "\\p{Lu}[\\p{L}1l0'’-]*"
_AUTHORS = f"^(?:\\d+\\s+)?{_NAME}(?: {_NAME})?(?: (?:&|and|und|et) {_NAME}(?: {_NAME})?|(?:,)? et al\\.?)(?:\\s+\\d+)?$"
_SPACED = "^(?:\\d+\\s+)?(?:[\\p{Lu}\\d&.,'-] ){3,}.*$"


def furniture(lines: DataFrame) -> DataFrame:
    """The lines with `role` (body, title, running_header, page_number) and `seq`, the order on the page.

    `lines` has doc_id, page, line_no, y0, y1, text; repeated rows are merged. Only lines at the edges of a page, and
    tall ones, meet the tables of what their document repeats; all others are body without a join.
    """
    base = lines.select("doc_id", "page", "line_no", "y0", "y1", "text").where(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).dropDuplicates(["doc_id", "page", "line_no", "text"])
    page = Window.partitionBy("doc_id", "page")
    order = page.orderBy("y0", "line_no", "text")
    placed = (
        base.withColumn("seq", F.row_number().over(order))
        .withColumn("count", F.count(F.lit(1)).over(page))
        .withColumn("low", F.min(F.col("y1") - F.col("y0")).over(page))
        .withColumn("edge", (F.col("seq") <= EDGE) | (F.col("seq") > F.col("count") - EDGE))
        .withColumn("tall", F.coalesce((F.col("y1") - F.col("y0")) >= TALL * F.col("low"), F.lit(False)))
        .select("doc_id", "page", "line_no", "text", "seq", "count", "edge", "tall")
    )
    placed = cut(placed, "placed")
    keep = ["doc_id", "page", "line_no", "text", "seq", "role"]
    plain = placed.where(~F.col("edge") & ~F.col("tall")).withColumn("role", F.lit("body")).select(*keep)
    some = placed.where("edge OR tall").withColumn("number", F.when(F.col("edge"), number_of(F.col("text")))).withColumn("key", F.when(F.col("edge"), _letters_only(F.col("text"))))
    # headers: keys on two pages or more of a document, titles, author lines
    running = F.col("edge") & (F.length("key") >= 5) & F.col("number").isNull() & ~F.col("tall")
    keys = some.where(F.col("key").isNotNull()).groupBy("doc_id", "key").agg(F.coalesce(F.min(F.when(running, F.col("page"))) < F.max(F.when(running, F.col("page"))), F.lit(False)).alias("repeats"), F.max("tall").alias("titled")).where("repeats OR titled")
    # page numbers keep their distance to the page; the most frequent distance of a document holds
    offsets = some.where(F.col("number").isNotNull()).groupBy("doc_id", (F.col("number") - F.col("page")).alias("offset")).agg(F.count_distinct("page").alias("pages"))
    usual = offsets.groupBy("doc_id").agg(F.max_by("offset", F.struct("pages", -F.col("offset"))).alias("usual"), F.max("pages").alias("support"))
    joined = some.join(keys, ["doc_id", "key"], "left").join(usual, "doc_id", "left")
    authors = F.col("text").rlike(_AUTHORS) | F.col("text").rlike(_SPACED)
    is_number = ((F.col("seq") == 1) | (F.col("seq") == F.col("count"))) & ~F.col("text").rlike("^\\s*\\(") & F.col("number").isNotNull() & ((F.col("support") < 2) | (F.abs(F.col("number") - F.col("page") - F.col("usual")) <= 2))
    is_header = F.col("edge") & ~F.col("tall") & (authors | F.coalesce("titled", F.lit(False)) | F.coalesce("repeats", F.lit(False)) & ~F.col("text").rlike("^\\p{Ll}|[.,;]$"))
    role = F.when(is_number, "page_number").when(is_header, "running_header").when(F.col("tall") & (F.col("seq") <= EDGE + 1), "title").otherwise("body")
    return plain.unionByName(joined.withColumn("role", role).select(*keep))


_LAST = f"([\\p{{L}}\\d]+)([{_MARKS}])$"
_FIRST = "^([\\p{L}\\d]+)"


def _next_text(roles: DataFrame) -> DataFrame:
    """Body lines with the next body line (`after`: page, line_no, text) and the text of the previous one (`before`).

    Page ends meet the next page that has body lines, found in blocks of pages.
    """
    body = roles.where(F.col("role") == "body").withColumn("me", F.struct("page", "line_no", "text"))
    page = Window.partitionBy("doc_id", "page").orderBy("seq")
    inside = body.withColumn("after", F.lead("me").over(page)).withColumn("before", F.lag("text").over(page))
    ends = body.groupBy("doc_id", "page").agg(F.min_by("me", "seq").alias("top"), F.max_by("text", "seq").alias("bottom")).withColumn("block", F.floor(F.col("page") / PAGE_BLOCK))
    blocks = ends.groupBy("doc_id", "block").agg(F.min_by("top", "page").alias("top"), F.max_by("bottom", "page").alias("bottom"))
    by_block = Window.partitionBy("doc_id").orderBy("block")
    borders = blocks.select("doc_id", "block", F.lead("top").over(by_block).alias("later"), F.lag("bottom").over(by_block).alias("earlier"))
    by_page = Window.partitionBy("doc_id", "block").orderBy("page")
    met = ends.select("doc_id", "block", "page", F.lead("top").over(by_page).alias("over"), F.lag("bottom").over(by_page).alias("under")).join(borders, ["doc_id", "block"])
    met = met.select("doc_id", "page", F.coalesce("over", "later").alias("over"), F.coalesce("under", "earlier").alias("under"))
    return inside.join(met, ["doc_id", "page"], "left").withColumn("after", F.coalesce("after", "over")).withColumn("before", F.coalesce("before", "under")).drop("over", "under", "me")


def _with_breaks(body: DataFrame) -> DataFrame:
    """Adds the halves of a word that may go on: of the line's end, and of the previous line's end."""
    t = F.rtrim(F.col("text"))
    return (
        body.withColumn("left", F.regexp_extract(t, _LAST, 1))
        .withColumn("mark", F.regexp_extract(t, _LAST, 2))
        .withColumn("right", F.regexp_extract(F.ltrim(F.coalesce("after.text", F.lit(""))), _FIRST, 1))
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\d]*\\p{L}[\\p{L}\\d]*"), F.lit(0))


def _vocabulary(roles: DataFrame) -> DataFrame:
    """Counts of words and of hyphenated words inside lines."""
    body = roles.where(F.col("role").isin("body", "title"))
    inner = F.regexp_replace(F.rtrim("text"), f"[\\p{{L}}\\d]+[{_MARKS}]$", " ")
    words = body.select(F.explode(_words(inner)).alias("word"))
    hyphened = body.select(F.explode(F.regexp_extract_all(inner, F.lit("[\\p{L}\\d]+(?:[-‐‑][\\p{L}\\d]+)+"), F.lit(0))).alias("word")).withColumn("word", F.translate("word", "‐‑", "--"))
    return words.unionByName(hyphened).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def misread_candidates(vocabulary: DataFrame) -> DataFrame:
    """Rare forms with every frequent form of their skeleton: word, form, form_n. A few rows per rare word."""
    forms = vocabulary.where((F.length("word") >= 3) & ~F.col("word").contains("-")).withColumn("skel", skeleton(F.col("word")))
    good = forms.where(~F.col("word").rlike("\\d") & (F.col("n") >= FREQUENT)).select("skel", F.col("word").alias("form"), F.col("n").alias("form_n"))
    return forms.join(good, "skel").where((F.col("word") != F.col("form")) & (F.col("form_n") >= RARER * F.col("n"))).select("word", "form", "form_n")


def misread_forms(vocabulary: DataFrame) -> DataFrame:
    """Rare forms with the most frequent form of their skeleton: word, right_form."""
    return misread_candidates(vocabulary).groupBy("word").agg(F.max_by("form", F.struct("form_n", "form")).alias("right_form"))


def _contexts(roles: DataFrame) -> DataFrame:
    """Counts of words with the word before them in the line: prev, form, together."""
    w = _words(F.lower("text"))
    lines = roles.where("role = 'body'").select(w.alias("w")).where(F.size("w") >= 2)
    pairs = F.transform(F.sequence(F.lit(2), F.size("w")), lambda k: F.struct(F.element_at("w", k - 1).alias("prev"), F.element_at("w", k).alias("form")))
    return lines.select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.form").agg(F.count(F.lit(1)).alias("together"))


def line_defects(lines: DataFrame) -> DataFrame:
    """One row per line and defect: doc_id, page, line_no, text, defect."""
    return scan_parts(lines)["defects"]


def scan_parts(lines: DataFrame) -> dict[str, DataFrame]:
    """The stages that several steps read, each written once to the shared folder."""
    roles = cut(furniture(lines), "roles")
    vocab = cut(_vocabulary(roles), "words")
    body = cut(_with_breaks(_next_text(roles)), "body")
    broken = cut(_broken(body, vocab), "broken")
    flagged = roles.where(F.col("role").isin("running_header", "page_number")).select("doc_id", "page", "line_no", "text", F.col("role").alias("defect"))
    return {"roles": roles, "vocab": vocab, "body": body, "broken": broken, "defects": flagged.unionByName(broken).unionByName(_misread(body, broken, vocab))}


def _page_texts(roles: DataFrame, defects: DataFrame) -> DataFrame:
    """Each text of a page once: its defects, how many lines have it, how many of them are body and titles, whether all
    are titles, and whether its furniture stands on top."""
    furniture_ = F.col("role").isin("running_header", "page_number")
    lines = roles.select("doc_id", "page", "text", F.lit(None).cast("string").alias("defect"), F.lit(1).alias("one"), F.when(F.col("role") == "body", 1).otherwise(0).alias("body"), (F.col("role") == "title").alias("title"), F.when(furniture_, F.col("seq")).alias("seq"))
    none = F.lit(None)
    flags = defects.select("doc_id", "page", "text", "defect", F.lit(0).alias("one"), F.lit(0).alias("body"), none.cast("boolean").alias("title"), none.cast("int").alias("seq"))
    found = lines.unionByName(flags).groupBy("doc_id", "page", "text")
    return found.agg(F.struct(F.collect_set("defect").alias("defects"), F.sum("one").alias("lines"), F.sum("body").alias("body"), F.count_if("title").alias("titles"), F.every("title").alias("title"), (F.min("seq") <= EDGE).alias("on_top")).alias("line"))


def _segment_lines(segments: DataFrame, roles: DataFrame, defects: DataFrame) -> DataFrame:
    """Lines of paragraphs (doc_id, seg_id, page, pos, text) with what is known of the scanned line they come from.

    That line has the same text and stands on the paragraph's page or, where the paragraph runs on, on the next one.
    If both pages have the text, the first of the paragraphs' lines, as many as the page has, belong to the page, and
    the others to the next; a title belongs to the start of a paragraph only. The page is part of every key, so a line
    that stands on each page of a document meets its own page only.
    """
    texts = _page_texts(roles, defects)
    near = texts.withColumn("gap", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("page", F.col("page") - F.col("gap"))
    near = near.groupBy("doc_id", "page", "text").agg(F.max(F.when(F.col("gap") == 0, F.col("line"))).alias("here"), F.max(F.when(F.col("gap") == 1, F.col("line"))).alias("next"))
    rows = segments.where(F.col("source").isNotNull()).dropDuplicates(["doc_id", "seg_id", "page", "source"]).select("doc_id", "seg_id", "page", F.posexplode(F.split("source", "\r?\n")).alias("pos", "text"))
    same = Window.partitionBy("doc_id", "page", "text")
    nth = F.row_number().over(same.orderBy(F.regexp_extract("seg_id", "(\\d+)$", 1).try_cast("int"), "seg_id", "pos"))
    met = rows.join(near, ["doc_id", "page", "text"], "left").withColumn("nth", nth).withColumn("times", F.count(F.lit(1)).over(same))
    beyond = F.col("here").isNull() | (F.col("next").isNotNull() & ((F.col("here.title") & (F.col("pos") > 0)) | (F.col("nth") > F.col("here.lines"))))
    return met.select("doc_id", "seg_id", "page", "pos", "text", "nth", "times", F.when(beyond, F.col("next")).otherwise(F.col("here")).alias("line"))


def segment_defects(segments: DataFrame, roles: DataFrame, defects: DataFrame) -> DataFrame:
    """Defects of paragraphs built from the lines: doc_id, seg_id, defect.

    A line of `segments.source` has the defects of the scanned line of that text on the paragraph's page, or else on
    the page it runs on to.
    """
    return _segment_lines(segments, roles, defects).select("doc_id", "seg_id", F.explode("line.defects").alias("defect")).distinct()


def repaired_paragraphs(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Each paragraph (doc_id, seg_id) of scanned documents as continuous text: repaired.

    A line is left out if its text is furniture on its page. Where body lines of the page have that text too, as many
    of the paragraphs' lines stay as the body has: the first ones below furniture at the foot, the last ones below
    furniture on top.
    """
    parts = scan_parts(lines)
    wrong = misread_candidates(parts["vocab"])
    contexts = _contexts(parts["roles"])
    docs = parts["roles"].select("doc_id").distinct()
    known = _segment_lines(segments.join(docs, "doc_id", "left_semi"), parts["roles"], parts["defects"])
    known = known.withColumn("defects", F.coalesce("line.defects", F.array().cast("array<string>")))
    out_of_flow = F.array_contains("defects", "running_header") | F.array_contains("defects", "page_number")
    flow = F.col("line.body") + F.when(F.col("pos") == 0, F.col("line.titles")).otherwise(0)
    stays = (flow > 0) & F.when(F.col("line.on_top"), F.col("nth") > F.col("times") - flow).otherwise(F.col("nth") <= flow)
    kept = cut(known.where(~out_of_flow | stays).select("doc_id", "seg_id", "pos", "text", "defects"), "lines")
    pieces = F.split("text", "(?<=[^\\p{L}\\d])(?=[\\p{L}\\d])|(?<=[\\p{L}\\d])(?=[^\\p{L}\\d])")
    bits = kept.where(F.array_contains("defects", "misread")).select("doc_id", "seg_id", "pos", F.posexplode(pieces).alias("at", "piece"))
    line = Window.partitionBy("doc_id", "seg_id", "pos").orderBy("at")
    bits = bits.withColumn("word", F.lower("piece")).withColumn("prev", F.lower(F.lag("piece", 2).over(line)))
    # of several frequent forms the one most often seen behind the word before, then the most frequent
    met = bits.join(wrong, "word").join(contexts, ["prev", "form"], "left")
    chosen = met.groupBy("doc_id", "seg_id", "pos", "at").agg(F.max_by("form", F.struct(F.coalesce("together", F.lit(0)), "form_n", "form")).alias("right_form"))
    fixed = bits.join(chosen, ["doc_id", "seg_id", "pos", "at"], "left")
    cased = F.when(F.col("right_form").isNull(), F.col("piece")).when(F.col("piece").rlike("^\\p{Lu}"), F.initcap("right_form")).otherwise(F.col("right_form"))
    mended = fixed.groupBy("doc_id", "seg_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", cased.alias("s")))), lambda x: x["s"]), "").alias("mended"))
    out = kept.join(mended, ["doc_id", "seg_id", "pos"], "left").withColumn("line", F.coalesce("mended", "text"))
    w = Window.partitionBy("doc_id", "seg_id").orderBy("pos")
    glued = out.withColumn("line", F.when(F.array_contains("defects", "hyphen_break"), F.regexp_replace(F.rtrim("line"), f"[{_MARKS}]$", "")).otherwise(F.when(F.rtrim("line").rlike("[\\p{L}\\d][-‐‑]$"), F.rtrim("line")).otherwise(F.concat(F.trim("line"), F.lit(" "))))).withColumn("k", F.row_number().over(w))
    return glued.groupBy("doc_id", "seg_id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "")).alias("repaired"))


def _broken(body: DataFrame, vocab: DataFrame) -> DataFrame:
    ends = body.where((F.col("mark") != "") & (F.col("right") != ""))
    ends = ends.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("kept", F.lower(F.concat("left", F.lit("-"), "right"))).withColumn("jskel", skeleton(F.col("joined")))
    plain = vocab.where(~F.col("word").contains("-"))
    by_skel = plain.groupBy(skeleton(F.col("word")).alias("jskel")).agg(F.max("n").alias("n_joined"))
    # the counts of both halves and of the hyphenated word by one join
    key = ["doc_id", "page", "line_no", "text"]
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("as"), F.lower(F.col(c)).alias("word")) for k, c in (("n_kept", "kept"), ("n_left", "left"), ("n_right", "right"))]))
    count = lambda k: F.coalesce(F.max(F.when((F.col("as") == k) & ((F.col("as") == "n_kept") | ~F.col("word").contains("-")), F.col("n"))), F.lit(0)).alias(k)
    counts = ends.select(*key, asked.alias("q")).select(*key, "q.*").join(vocab, "word").groupBy(*key).agg(count("n_kept"), count("n_left"), count("n_right"))
    got = ends.join(by_skel, "jskel", "left").join(counts, key, "left")
    for c in ("n_joined", "n_kept", "n_left", "n_right"):
        got = got.withColumn(c, F.coalesce(c, F.lit(0)))
    sure = F.col("mark").rlike(f"[{_SURE_MARKS}]")
    known = (F.col("n_joined") > 0) | (F.col("n_kept") > 0)
    apart = F.least("n_left", "n_right") >= FREQUENT
    is_break = F.when(sure, F.col("right").rlike("^\\p{L}")).when(known, F.col("n_joined") > F.col("n_kept")).otherwise(F.col("right").rlike("^\\p{Ll}") & ~apart & ~F.col("left").rlike("\\d$"))
    return got.where(is_break).select("doc_id", "page", "line_no", "text", F.lit("hyphen_break").alias("defect"))


def _misread(body: DataFrame, broken: DataFrame, vocab: DataFrame) -> DataFrame:
    """Lines with a word that a frequent word of the same skeleton should replace; a broken word counts whole."""
    key = ["doc_id", "page", "line_no", "text"]
    wrong = misread_forms(vocab)
    t = F.rtrim(F.col("text"))
    marked = body.where(F.col("mark") != "").join(broken.select(*key), key, "left_semi")
    # words that stand whole in a line: without a half at its end or its start
    half_end = F.when(F.col("mark") != "", F.regexp_replace(t, f"[\\p{{L}}\\d]+[{_MARKS}]$", "")).otherwise(t)
    prev_half = F.regexp_extract(F.rtrim(F.coalesce("before", F.lit(""))), _LAST, 2) != ""
    whole = F.when(prev_half, F.regexp_replace(F.ltrim(half_end), _FIRST, "")).otherwise(half_end)
    words = body.select(*key, F.explode(_words(whole)).alias("w"))
    plain = words.withColumn("word", F.lower("w")).join(wrong, "word").select(*key)
    # a word over two lines: the line that holds the first differing sign
    halves = marked.withColumn("word", F.lower(F.concat("left", "right")))
    vocab_words = vocab.where(~F.col("word").contains("-") & ~F.col("word").rlike("\\d"))
    right_of = vocab_words.where(F.col("n") >= FREQUENT).groupBy(skeleton(F.col("word")).alias("skel")).agg(F.max_by("word", F.struct("n", "word")).alias("right_form"))
    split = (
        halves.withColumn("skel", skeleton(F.col("word")))
        .join(right_of, "skel")
        .join(vocab_words.select("word", F.col("n")), "word", "left")
        .where((F.col("word") != F.col("right_form")) & (F.coalesce("n", F.lit(0)) < FREQUENT))
    )
    same = F.size(
        F.filter(
            F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.length("right_form"))), lambda k: F.when(F.substring("word", F.lit(1), k) == F.substring("right_form", F.lit(1), k), k)),
            lambda x: x.isNotNull(),
        )
    )
    located = split.withColumn("at", same)
    first = located.where(F.col("at") < F.length("left")).select(*key)
    second = located.where(F.col("at") >= F.length("left")).select("doc_id", "after.page", "after.line_no", "after.text")
    return plain.unionByName(first).unionByName(second).distinct().withColumn("defect", F.lit("misread"))
