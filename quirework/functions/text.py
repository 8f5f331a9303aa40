"""Text expressions that stay inside the JVM (but for large glossaries): masking, splitting, joining, labels, identifiers, guards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Untranslatable tokens, tried in this order (placeholder, link, e-mail, DOI, preprint id, citation).
MASKABLE = (
    "⟦EQ[0-9]+⟧"
    "|(?:https?://|www\\.)[^\\s⟦⟧]+"
    "|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+"
    "|10\\.[0-9]{4,9}/[^\\s⟦⟧]+"
    "|arXiv:[0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?"
    "|\\[[0-9]+(?:\\s*[,–-]\\s*[0-9]+)*\\]"
)
# Shapes of tokens, and the scripts a Korean text does not hold.
ANY_TOKEN = "⟦[^⟦⟧\\s]{1,12}⟧"
MASK_TOKEN = "⟦M[0-9]+⟧"
FOREIGN = "[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{0400}-\\x{04FF}]"
# White space of every kind, and the place between two rough sentences.
_BLANK = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
SENTENCE_GAP = f"(?<=[.!?]){_BLANK}+(?=[A-Z⟦(\\[])"
# Parts of a prompt that an answer may repeat.
ECHO_MARKERS = (
    "다음 텍스트를 한국어로 번역하라", "이전 문단(문맥 참고용", "번역문만 출력", "플레이스홀더는 번역하지 말고", "용어집(반드시 이 표기를 따르라", "새 문장처럼 시작하지 말고",
    "[번역 예시", "[논문 정보", "이전 문단의 번역(", "우리는 ImageNet으로 GPT-4를 파인튜닝하고", "Kim 등이 보였듯이 제안한 손실",
)
# Function words of running prose.
STOPWORDS = tuple(
    "the a an of and or is are was were be been being this that these those it its we our us in on for with as by to from at into over under between during which where when while then than if because since through denotes denote given let holds defined follows following using implies such".split()
)
# Roman signs, and the shapes of captions and list markers.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
CAPTION = "(?i)^\\s*(fig(?:ure)?\\.?|table)\\s*([0-9]+|[ivxlcdm]+\\b)"
# Numbered headings, the title of a bibliography, and the start of a caption.
HEAD_PREFIX = "^\\s*(?:(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*|[A-Z])[.)]|(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*))\\s+(?=\\S)"
REFS_TITLE = "(?i)^\\s*(?:(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*|[A-Z])[.)]?\\s+)?(?:references|bibliography|참고문헌)\\s*:?\\s*$"
CAPTION_START = "(?i)^\\s*(?:fig(?:ure)?\\.?|table)\\s*(?:[0-9]|[ivxlcdm]+\\b)"
MARKER = "^\\s*(?:[•◦–▪*]|\\(?(?:viii|vii|iii|vi|iv|ix|ii|i|v|x)[.)]|\\(?[0-9]{1,2}[.)]|\\(?[a-z][.)]|⟦EQ[0-9]+⟧)\\s+"


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def mask(text: Column) -> Column:
    """(masked, originals): tokens numbered from 0 in each text; unmask(mask(t)) is t."""
    found = all_of(text, MASKABLE)
    pieces = F.split(text, MASKABLE, -1)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(found), F.concat(F.lit("⟦M"), i.cast("string"), F.lit("⟧"))).otherwise(F.lit("")))), "")
    return F.struct(joined.alias("masked"), found.alias("originals"))


def unmask(masked: Column, originals: Column) -> Column:
    """Puts the originals back, the first number first."""
    numbered = F.transform(originals, lambda o, i: F.struct(F.concat(F.lit("⟦M"), i.cast("string"), F.lit("⟧")).alias("t"), o.alias("o")))
    return F.aggregate(numbered, masked, lambda acc, x: F.replace(acc, x["t"], x["o"]))


def preview(text: Column, size: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "\\s+", " ")), 1, size)


def hyphen_join(lines: Column) -> Column:
    """Lines as one text: a hyphen behind a letter is dropped at a line end, else a blank is put."""

    def add(acc: Column, line: Column) -> Column:
        return F.when(acc == "", line).when(acc.rlike("[A-Za-z]-$"), F.concat(F.regexp_replace(acc, "-$", ""), line)).otherwise(F.concat(acc, F.lit(" "), line))

    clean = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(clean, F.lit("").cast("string"), add)


def list_marker(text: Column) -> Column:
    """(marker, rest): marker + rest is the text; an empty marker if there is none."""
    m = F.regexp_extract(text, f"({MARKER})\\S", 1)
    return F.struct(m.alias("marker"), F.substr(text, F.length(m) + 1).alias("rest"))


def marker_family(marker: Column) -> Column:
    m = F.trim(marker)
    return (
        F.when(m.rlike("^[•◦▪*]$"), "bullet")
        .when(m == "–", "dash")
        .when(m.rlike("^⟦EQ"), "eqmark")
        .when(m.rlike("^\\(?[ivx]+[.)]$"), "roman")
        .when(m.rlike("^\\(?[0-9]+[.)]$"), "number")
        .when(m.rlike("^\\(?[a-z][.)]$"), "alpha")
    )


def roman_value(text: Column) -> Column:
    """The value of a Roman numeral: from the right, smaller signs than the largest so far are subtracted."""
    worth = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    signs = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def add(acc: Column, c: Column) -> Column:
        v = F.coalesce(worth[c], F.lit(0))
        return F.struct(F.when(v < acc["most"], acc["total"] - v).otherwise(acc["total"] + v).alias("total"), F.greatest(acc["most"], v).alias("most"))

    return F.aggregate(F.reverse(signs), start, add)["total"]


def caption_key(text: Column) -> Column:
    """figure-N or table-N of a caption, from a decimal or Roman number; null if it is none."""
    kind, num = F.lower(F.regexp_extract(text, CAPTION, 1)), F.regexp_extract(text, CAPTION, 2)
    value = F.when(num.rlike("^[0-9]+$"), num.cast("int")).otherwise(roman_value(num))
    return F.when(kind != "", F.concat(F.when(kind.startswith("t"), F.lit("table-")).otherwise(F.lit("figure-")), value.cast("string")))


def strip_think(text: Column) -> Column:
    """Drops closed reasoning blocks; an unclosed one stays."""
    return F.regexp_replace(text, "(?s)<think>.*?</think>", "")


def filter_think_stream(text: Column) -> Column:
    """What a stream shows: closed blocks are dropped and an unclosed one swallows the rest."""
    return F.regexp_replace(strip_think(text), "(?s)<think>.*$", "")


def foreign_signs(source: Column, text: Column) -> Column:
    """Han, kana and Cyrillic signs that the source does not hold, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(all_of(text, FOREIGN)), all_of(source, FOREIGN)))


def count_of(text: Column, needle: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def placeholder_errors(source: Column, text: Column) -> Column:
    """Mask tokens of the source not found exactly once, and tokens the source does not have, sorted."""
    own = F.array_distinct(all_of(source, MASK_TOKEN))
    bad = F.filter(own, lambda t: count_of(text, t) != 1)
    alien = F.array_except(all_of(text, ANY_TOKEN), all_of(source, ANY_TOKEN))
    return F.array_sort(F.concat(bad, alien))


_IDENT = "[A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*"


def identifier_forms(text: Column) -> Column:
    """Tokens that must survive letter for letter: digits with letters, or two capitals in a part."""
    found = all_of(F.regexp_replace(text, ANY_TOKEN, " "), f"(?<![\\p{{L}}\\p{{N}}_⟦]){_IDENT}(?![\\p{{L}}\\p{{N}}_⟧])")
    kept = F.filter(found, lambda t: ~t.rlike("^[IVXLCDM]+$") & ~t.rlike("^(?:[A-Za-z]\\.)*[A-Za-z]$") & (t.rlike("[0-9]") | t.rlike("[A-Z][^-.]*[A-Z]")))
    return F.array_distinct(F.transform(kept, lambda t: F.when(t.rlike("^.+[A-Z]s$"), F.regexp_replace(t, "s$", "")).otherwise(t)))


def missing_identifiers(source: Column, text: Column, most: int = 8) -> Column:
    """Identifiers the text lost, in order; none if capitals make up over 60 % of the source's letters, of any script."""
    plain = F.regexp_replace(source, ANY_TOKEN, " ")
    letters, capitals = F.length(F.regexp_replace(plain, "\\P{L}", "")), F.length(F.regexp_replace(plain, "\\P{Lu}", ""))
    lost = F.slice(F.filter(identifier_forms(source), lambda t: ~F.contains(text, t)), 1, most)
    return F.when((letters > 0) & (capitals > 0.6 * letters), F.array().cast("array<string>")).otherwise(lost)


def sanitize(text: Column, word: str) -> Column:
    return F.regexp_replace(text, ANY_TOKEN, word)


def echo_markers(text: Column, markers: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def drop_echo_lines(text: Column, markers: list[str]) -> Column:
    none = lambda x: reduce(lambda a, b: a & b, [~F.contains(x, F.lit(m)) for m in markers])
    return F.array_join(F.filter(F.split(text, "\n", -1), none), "\n")


def strip_blank(text: Column) -> Column:
    """Drops white space of every kind at both ends."""
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+\\z", "")


def strip_leading_label(text: Column, source: Column) -> Column:
    """Drops a first line that is only a label: ends with a colon, 20 signs at most, holds no token or echoed prompt, more lines follow, and the source's first sentence has no colon."""
    lines = F.split(text, "\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]", -1)
    first = strip_blank(lines[0])
    rest = strip_blank(F.array_join(F.slice(lines, 2, 2**31 - 1), "\n"))
    opens = F.split(F.split(strip_blank(source), "\n", 2)[0], SENTENCE_GAP, 2)[0]
    echoed = reduce(lambda a, b: a | b, [F.contains(first, F.lit(m)) for m in ECHO_MARKERS])
    drop = (F.size(lines) >= 2) & first.rlike("[:：]\\z") & (F.length(first) <= 20) & ~first.rlike(MASK_TOKEN) & ~echoed & ~opens.rlike("[:：]") & (rest != "")
    return F.when(drop, rest).otherwise(text)


def rough_sentences(text: Column, plain: bool = False) -> Column:
    """Sentences behind . ! ? before a capital, token or bracket; `plain`: only ASCII blanks divide, and only spaces are cut."""
    gap, strip = ("(?<=[.!?])\\s+(?=[A-Z⟦(\\[])", F.trim) if plain else (SENTENCE_GAP, strip_blank)
    return F.filter(F.transform(F.split(text, gap, -1), lambda s: strip(s)), lambda s: s != "")


def is_continuation(text: Column) -> Column:
    """Whether a text starts inside a sentence."""
    head = F.trim(F.regexp_replace(text, "⟦(?:EQ|M)[0-9]+⟧", " "))
    run = F.regexp_extract(head, "^([^A-Za-z가-힣]+)", 1)
    rest = F.substr(head, F.length(run) + 1)
    letter = head.rlike("^\\p{L}")
    return F.when(head == "", False).when(letter, head.rlike("^\\p{Ll}")).otherwise((rest.rlike("^\\p{Ll}") & ~F.trim(run).rlike("^[0-9]+$")) | F.contains(run, F.lit(".")))


def words(text: Column) -> Column:
    return all_of(text, "[A-Za-z]+")


def stopword_count(text: Column) -> Column:
    return F.size(F.filter(words(F.lower(text)), lambda w: w.isin(*STOPWORDS)))


def long_words(text: Column) -> Column:
    return F.size(F.filter(words(text), lambda w: w.rlike("^[a-z]{5,}$")))


def visible(text: Column) -> Column:
    return F.regexp_replace(text, "⟦EQ[0-9]+⟧", "")


def dense(text: Column) -> Column:
    return F.regexp_replace(visible(text), "\\s", "")


def ends_paragraph(text: Column) -> Column:
    return F.rtrim(text).rlike("[.!?:][\"'”’)\\]]*$")


def caps_only(text: Column) -> Column:
    return text.rlike("\\p{L}") & ~text.rlike("\\p{Ll}")


def safe_member(path: Column) -> Column:
    """A harmless relative path: drive letters, parent steps and unsafe signs removed, .pdf put."""
    parts = F.transform(F.split(F.translate(path, "\\", "/"), "/"), lambda p: F.trim(F.regexp_replace(p, "[<>:\"|?*\\x00-\\x1f]", "_")))
    kept = F.filter(parts, lambda p: (p != "") & (p != ".") & (p != "..") & ~p.rlike("^[A-Za-z]_$"))
    joined = F.array_join(kept, "/")
    named = F.when(joined == "", "document").otherwise(joined)
    return F.when(F.lower(named).endswith(".pdf"), named).otherwise(F.concat(named, F.lit(".pdf")))


def version_parts(tag: Column) -> Column:
    """A version tag as integers; arrays compare part by part."""
    return F.transform(F.split(F.regexp_replace(tag, "^v", ""), "\\."), lambda p: p.cast("int"))


def escape_html(text: Column) -> Column:
    t = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def natural_key(path: Column) -> Column:
    """A sort key in which runs of digits compare as numbers (up to 12 digits)."""
    parts = all_of(F.lower(path), "[0-9]+|[^0-9]+")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def author_line(authors: Column, first: int = 3) -> Column:
    n = F.size(authors)
    return F.when(n > first, F.concat(F.array_join(F.slice(authors, 1, first), ", "), F.lit(" and "), (n - first).cast("string"), F.lit(" more"))).otherwise(F.array_join(authors, ", "))


def quoted_title(entry: Column) -> Column:
    """The first quoted span of four signs or more, double apostrophes first; a trailing , . ; is cut."""
    a = F.regexp_extract(entry, "‘‘\\s*(.{4,}?)\\s*’’", 1)
    b = F.regexp_extract(entry, "[\"“]\\s*([^\"“”]{4,}?)\\s*[\"”]", 1)
    t = F.regexp_replace(F.when(a != "", a).otherwise(b), "[,.;]+$", "")
    return F.when(t != "", t)


def with_terms(docs: DataFrame, column: str, terms: DataFrame, keep: list[str], limit: int = 5_000, block: int = 200_000) -> DataFrame:
    """The terms (term, rendering) that occur anywhere in each text, whatever their case: `keep` columns, term, rendering.

    A glossary of at most `limit` terms, checked, is tried on every text in the JVM. A larger one goes to the workers
    in blocks of about `block` terms and is looked up at every place of a text by its first signs; the rows are the same.
    """
    rows = terms.limit(limit + 1).collect()
    low = F.lower(F.col(column))
    if len(rows) <= limit:
        listed = F.array(*[F.struct(F.lit(r["term"]).alias("term"), F.lit(r["rendering"]).alias("rendering")) for r in rows]) if rows else F.array().cast("array<struct<term:string,rendering:string>>")
        return docs.select(*keep, F.inline(F.filter(listed, lambda x: F.contains(low, F.lower(x["term"])))))
    base = docs.where(F.col(column).isNotNull()).select(*keep, low.alias("__low"))
    schema = StructType([f for f in base.schema.fields if f.name != "__low"]).add("term", StringType()).add("rendering", StringType())
    # case is folded in the JVM on both sides, as for small glossaries
    folded = terms.where("term IS NOT NULL").select("term", "rendering", F.lower("term").alias("__low"))
    n = max(1, -(-folded.count() // block))
    parts = []
    for k in range(n):
        got = folded.where(F.pmod(F.xxhash64("__low"), F.lit(n)) == k).collect()
        parts.append(base.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast([tuple(r) for r in got])), schema))
    return reduce(DataFrame.unionByName, parts)


HEAD = 3  # signs by which terms are looked up


def _finder(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Finds the terms (term, rendering, lower case) in the column __low of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[str, list[tuple[str, str | None]]] = {}
        sizes: dict[str, set[int]] = {}  # lengths of the terms that begin with these signs
        short = []
        for term, rendering, low in shared.value:
            if low not in whole and len(low) < HEAD:
                short.append(low)
            whole.setdefault(low, []).append((term, rendering))
            if len(low) >= HEAD:
                sizes.setdefault(low[:HEAD], set()).add(len(low))
        for batch in batches:
            take, terms, renderings = [], [], []
            for i, text in enumerate(batch.column("__low").to_pylist()):
                found = {x for x in short if x in text}
                for at in range(len(text) - HEAD + 1):
                    for size in sizes.get(text[at : at + HEAD], ()):
                        if text[at : at + size] in whole:
                            found.add(text[at : at + size])
                for x in found:
                    for term, rendering in whole[x]:
                        take.append(i)
                        terms.append(term)
                        renderings.append(rendering)
            part = batch.drop_columns(["__low"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(terms, pa.string()), pa.array(renderings, pa.string())], [*part.schema.names, "term", "rendering"])

    return run
