"""Queries of the text functions, on segments, documents and the glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks, translate
from ..sources.tables import table
from .register import query

# The SQL twins of patterns: the same language, written for the other engine's syntax.
_MASK = r"⟦EQ[0-9]+⟧|(?:https?://|www\.)[^\s⟦⟧]+|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+|10\.[0-9]{4,9}/[^\s⟦⟧]+|arXiv:[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]"
_SEG = "(SELECT DISTINCT * FROM segments)"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_SPLIT = f"""pieces AS (
  SELECT doc_id, seg_id, source, regexp_extract_all(source, '{_MASK}') AS found,
         string_split_regex(source, '{_MASK}') AS parts FROM {_SEG})"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").distinct()


@query(f"""WITH {_SPLIT}
SELECT doc_id, seg_id, list_reduce(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(found) THEN '⟦M' || (i - 1) || '⟧' ELSE '' END), lambda a, b: a || b) AS masked,
       len(found) AS n_tokens FROM pieces""")
def mask_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Untranslatable tokens replaced by numbered ones."""
    s = segments(spark, d).select("doc_id", "seg_id", X.mask(F.col("source")).alias("m"))
    return s.select("doc_id", "seg_id", F.col("m.masked").alias("masked"), F.size("m.originals").cast("long").alias("n_tokens"))


@query(f"SELECT kind, count(*) AS n, count(*) AS restored FROM {_SEG} GROUP BY kind")
def mask_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Unmasking gives every text back."""
    s = segments(spark, d).select("kind", "source", X.mask(F.col("source")).alias("m"))
    back = s.withColumn("back", X.unmask(F.col("m.masked"), F.col("m.originals")))
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("back") == F.col("source"), 1).otherwise(0)).alias("restored"))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(source, '{_MASK}')) AS token FROM {_SEG})
SELECT doc_id, count(*) FILTER (token LIKE '⟦EQ%') AS n_equations, count(*) FILTER (token LIKE '[%') AS n_citations,
       count(*) FILTER (token LIKE 'http%' OR token LIKE 'www.%') AS n_links, count(DISTINCT token) AS n_distinct FROM t GROUP BY doc_id""")
def mask_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each kind of token in a document."""
    t = segments(spark, d).select("doc_id", F.explode(X.all_of(F.col("source"), X.MASKABLE)).alias("token"))
    n = lambda c: F.count(F.when(c, 1))
    return t.groupBy("doc_id").agg(
        n(F.col("token").startswith("⟦EQ")).alias("n_equations"),
        n(F.col("token").startswith("[")).alias("n_citations"),
        n(F.col("token").startswith("http") | F.col("token").startswith("www.")).alias("n_links"),
        F.count_distinct("token").alias("n_distinct"),
    )


@query(f"""WITH l AS (SELECT doc_id, seg_id, list_filter(list_transform(string_split(source, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM {_SEG})
SELECT doc_id, seg_id, coalesce(list_reduce(lines, lambda a, x: CASE WHEN regexp_matches(a, '[A-Za-z]-$') THEN regexp_replace(a, '-$', '') || x ELSE a || ' ' || x END), '') AS joined
FROM l WHERE len(lines) > 0""")
def hyphen_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a segment as one text."""
    s = segments(spark, d).withColumn("joined", X.hyphen_join(F.split("source", "\n", -1)))
    return s.where(F.col("joined") != "").select("doc_id", "seg_id", "joined")


_MARK = r"^(\s*(?:[•◦–▪*]|\(?(?:viii|vii|iii|vi|iv|ix|ii|i|v|x)[.)]|\(?[0-9]{1,2}[.)]|\(?[a-z][.)]|⟦EQ[0-9]+⟧)\s+)\S"


@query(f"""WITH m AS (SELECT doc_id, line_no, line, regexp_extract(line, '{_MARK}', 1) AS marker FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL))
SELECT doc_id, line_no, trim(marker) AS marker, substr(line, length(marker) + 1) AS rest,
  CASE WHEN regexp_matches(trim(marker), '^[•◦▪*]$') THEN 'bullet' WHEN trim(marker) = '–' THEN 'dash' WHEN trim(marker) LIKE '⟦EQ%' THEN 'eqmark'
       WHEN regexp_matches(trim(marker), '^\\(?[ivx]+[.)]$') THEN 'roman' WHEN regexp_matches(trim(marker), '^\\(?[0-9]+[.)]$') THEN 'number'
       WHEN regexp_matches(trim(marker), '^\\(?[a-z][.)]$') THEN 'alpha' END AS family
FROM m WHERE marker <> ''""")
def list_markers(spark: SparkSession, d: str) -> DataFrame:
    """Lines that open with a list marker, and the marker's family."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    m = lines.withColumn("m", X.list_marker(F.col("line"))).where(F.col("m.marker") != "")
    return m.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim("m.marker").alias("marker"), F.col("m.rest").alias("rest"), X.marker_family(F.col("m.marker")).alias("family"))


@query(f"""WITH c AS (SELECT DISTINCT doc_id, seg_id, lower(regexp_extract(source, '(?i)^\\s*(fig(?:ure)?\\.?|table)\\s*([0-9]+|[ivxlcdm]+\\b)', 1)) AS k,
  regexp_extract(source, '(?i)^\\s*(fig(?:ure)?\\.?|table)\\s*([0-9]+|[ivxlcdm]+\\b)', 2) AS num FROM segments)
SELECT doc_id, seg_id, CASE WHEN k LIKE 't%' THEN 'table-' ELSE 'figure-' END || num AS key FROM c WHERE k <> '' AND regexp_matches(num, '^[0-9]+$')""")
def caption_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of every caption; Roman numbers, which the SQL does not know, are covered by tests."""
    s = segments(spark, d).withColumn("key", X.caption_key(F.col("source"))).where("key IS NOT NULL")
    return s.select("doc_id", "seg_id", "key").distinct()


_MARKED = r"regexp_replace(text, '([.!?])\s+([A-Z⟦(\[])', '\1' || chr(1) || '\2', 'g')"


@query(f"""SELECT doc_id, len(list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS n_sentences
FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[.!?]\\s+[A-Z⟦(\\[][.!?]\\s')""")
def rough_sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """X7 on the share that SQL can follow (no lone capital before a mark, as in '. A. ', and ASCII blanks); all_rough_sentence_counts takes every text."""
    t = table(spark, d, "documents").where("text IS NOT NULL").where(~F.col("text").rlike("[.!?]\\s+[A-Z⟦(\\[][.!?]\\s"))
    return t.select("doc_id", F.size(X.rough_sentences(F.col("text"), plain=True)).cast("long").alias("n_sentences"))


@query()
def all_rough_sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rough sentences of every document, as used for retries."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.size(X.rough_sentences(F.col("text"))).cast("long").alias("n_sentences"))


_P = "(SELECT DISTINCT * FROM progress)"


@query(f"""SELECT doc_id, segment_id, regexp_replace('<think>' || source_preview || chr(10) || '</think>' || translated_preview || '<think>rest', '(?s)<think>.*?</think>', '', 'g') AS stripped,
  regexp_replace(regexp_replace('<think>' || source_preview || chr(10) || '</think>' || translated_preview || '<think>rest', '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '') AS streamed FROM {_P}""")
def think_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Reasoning blocks dropped from a whole answer, and from a stream of it."""
    p = table(spark, d, "progress").distinct()
    answer = F.concat(F.lit("<think>"), "source_preview", F.lit("\n</think>"), "translated_preview", F.lit("<think>rest"))
    return p.select("doc_id", "segment_id", X.strip_think(answer).alias("stripped"), X.filter_think_stream(answer).alias("streamed"))


@query(f"""WITH f AS (SELECT doc_id, seg_id, list_sort(list_filter(list_distinct(regexp_extract_all(translated, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}\\x{{0400}}-\\x{{04FF}}]')),
  lambda c: NOT contains(source, c))) AS signs FROM {_SEG} WHERE translated IS NOT NULL)
SELECT doc_id, seg_id, array_to_string(signs, '') AS signs, len(signs) AS n FROM f WHERE len(signs) > 0""")
def foreign_script_signs(spark: SparkSession, d: str) -> DataFrame:
    """Han, kana and Cyrillic signs a translation brought in."""
    s = segments(spark, d).where("translated IS NOT NULL").withColumn("f", X.foreign_signs(F.col("source"), F.col("translated"))).where(F.size("f") > 0)
    return s.select("doc_id", "seg_id", F.array_join("f", "").alias("signs"), F.size("f").cast("long").alias("n"))


_TOK = r"⟦[^⟦⟧\s]{1,12}⟧"


@query(f"""WITH t AS (SELECT doc_id, seg_id, regexp_replace(source, '⟦EQ', '⟦M', 'g') AS s, translated AS r, list_distinct(regexp_extract_all(regexp_replace(source, '⟦EQ', '⟦M', 'g'), '⟦M[0-9]+⟧')) AS own
  FROM {_SEG} WHERE translated IS NOT NULL),
e AS (SELECT doc_id, seg_id, list_sort(list_concat(list_filter(own, lambda k: (length(r) - length(replace(r, k, ''))) // length(k) <> 1),
  list_filter(list_distinct(regexp_extract_all(r, '{_TOK}')), lambda k: NOT list_contains(regexp_extract_all(s, '{_TOK}'), k)))) AS errors FROM t)
SELECT doc_id, seg_id, array_to_string(errors, ' ') AS errors FROM e WHERE len(errors) > 0""")
def placeholder_errors(spark: SparkSession, d: str) -> DataFrame:
    """Lost, repeated and invented tokens, the sources' tokens renumbered."""
    s = segments(spark, d).where("translated IS NOT NULL")
    e = s.withColumn("e", X.placeholder_errors(F.replace("source", F.lit("⟦EQ"), F.lit("⟦M")), F.col("translated"))).where(F.size("e") > 0)
    return e.select("doc_id", "seg_id", F.array_join("e", " ").alias("errors"))


@query(f"""WITH s AS (SELECT doc_id, seg_id, translated, regexp_replace(source, '{_TOK}', ' ', 'g') AS plain FROM {_SEG} WHERE translated IS NOT NULL AND regexp_matches(source, '^[ -~]*$')),
t AS (SELECT *, length(regexp_replace(plain, '[^A-Za-z]', '', 'g')) AS nl, length(regexp_replace(plain, '[^A-Z]', '', 'g')) AS nc,
  list_filter(list_transform(list_filter(string_split_regex(plain, '[^A-Za-z0-9_.-]+'), lambda w: w <> ''), lambda w: regexp_replace(regexp_replace(w, '[-.]+$', ''), '^[-.]+', '')), lambda w: regexp_full_match(w, '[A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*')) AS toks FROM s),
i AS (SELECT *, list_distinct(list_transform(list_filter(toks, lambda w: NOT regexp_full_match(w, '[IVXLCDM]+') AND NOT regexp_full_match(w, '(?:[A-Za-z]\\.)*[A-Za-z]') AND (regexp_matches(w, '[0-9]') OR regexp_matches(w, '[A-Z][^-.]*[A-Z]'))),
  lambda w: CASE WHEN regexp_matches(w, '^.+[A-Z]s$') THEN regexp_replace(w, 's$', '') ELSE w END)) AS ids FROM t)
SELECT doc_id, seg_id, CASE WHEN nl > 0 AND nc > 0.6 * nl THEN '' ELSE array_to_string(list_sort(list_filter(ids, lambda w: NOT contains(translated, w))), ' ') END AS missing
FROM i WHERE NOT list_contains(list_transform(toks, lambda w: contains(w, '..')), true) AND NOT regexp_matches(plain, '_|[0-9][A-Za-z]|--|[.-][A-Za-z0-9]*[.-]|[^A-Za-z0-9][.-][A-Za-z]')""")
def missing_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """X11 and X12 on the share that SQL can follow: plain ASCII sources without doubtful tokens; all_missing_identifiers takes every source."""
    s = segments(spark, d).where("translated IS NOT NULL").where(F.col("source").rlike("^[ -~]*$"))
    plain = F.regexp_replace("source", X.ANY_TOKEN, " ")
    s = s.where(~plain.rlike("_|[0-9][A-Za-z]|--|[.-][A-Za-z0-9]*[.-]|[^A-Za-z0-9][.-][A-Za-z]"))
    lost = X.missing_identifiers(F.col("source"), F.col("translated"), 1000)
    return s.select("doc_id", "seg_id", F.array_join(F.array_sort(lost), " ").alias("missing"))


@query()
def all_missing_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers a translation lost, for every translated segment."""
    s = segments(spark, d).where("source IS NOT NULL AND translated IS NOT NULL")
    return s.select("doc_id", "seg_id", F.array_join(F.array_sort(X.missing_identifiers(F.col("source"), F.col("translated"), 2**31 - 1)), " ").alias("missing"))


@query(f"SELECT doc_id, seg_id, regexp_replace(source, '{_TOK}', '(formula)', 'g') AS context, trim(regexp_replace(source, '\\s+', ' ', 'g'))[1:80] AS preview FROM {_SEG}")
def context_and_preview(spark: SparkSession, d: str) -> DataFrame:
    """The context without tokens, and the preview."""
    return segments(spark, d).select("doc_id", "seg_id", X.sanitize(F.col("source"), "(formula)").alias("context"), X.preview(F.col("source")).alias("preview"))


_ECHO = ["번역:", "원문:", "Translation:"]


@query(f"""WITH s AS (SELECT doc_id, seg_id, translated, list_filter(['번역:', '원문:', 'Translation:'], lambda m: contains(translated, m)) AS found FROM {_SEG} WHERE translated IS NOT NULL)
SELECT doc_id, seg_id, len(found) AS n_found, array_to_string(list_filter(string_split(translated, chr(10)), lambda x: NOT (contains(x, '번역:') OR contains(x, '원문:') OR contains(x, 'Translation:'))), chr(10)) AS kept FROM s""")
def echo_lines(spark: SparkSession, d: str) -> DataFrame:
    """Markers of an echoed prompt, and the text without their lines."""
    s = segments(spark, d).where("translated IS NOT NULL")
    return s.select("doc_id", "seg_id", F.size(X.echo_markers(F.col("translated"), _ECHO)).cast("long").alias("n_found"), X.drop_echo_lines(F.col("translated"), _ECHO).alias("kept"))


@query(f"""WITH s AS (SELECT doc_id, seg_id, '요약:' || chr(10) || translated AS t, source, string_split_regex(string_split(ltrim(source), chr(10))[1], '[.!?]\\s+')[1] AS head FROM {_SEG}
  WHERE translated IS NOT NULL AND regexp_matches(source, '^[ -~]*$') AND regexp_matches(translated, '^\\S(.*\\S)?$') AND NOT regexp_matches(source, '[.!?]\\s+[^A-Z⟦(\\[]'))
SELECT doc_id, seg_id, CASE WHEN contains(head, ':') THEN t ELSE substr(t, 5) END AS text FROM s""")
def leading_labels(spark: SparkSession, d: str) -> DataFrame:
    """X15 on the share that SQL can follow (ASCII sources, translations of one line); all_leading_labels takes every segment."""
    s = segments(spark, d).where("translated IS NOT NULL").where(F.col("source").rlike("^[ -~]*$") & F.col("translated").rlike("^\\S(.*\\S)?$") & ~F.col("source").rlike("[.!?]\\s+[^A-Z⟦(\\[]"))
    return s.select("doc_id", "seg_id", X.strip_leading_label(F.concat(F.lit("요약:\n"), "translated"), F.col("source")).alias("text"))


@query()
def all_leading_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every translation without a label line of its own, and `text`, where one was put before it."""
    s = segments(spark, d).where("source IS NOT NULL AND translated IS NOT NULL")
    strip = lambda t: X.strip_leading_label(t, F.col("source"))
    return s.select("doc_id", "seg_id", strip(F.concat(F.lit("요약:\n"), "translated")).alias("text"), strip(F.col("translated")).alias("cleaned"))


@query("""WITH lines AS (SELECT term_id, '- ' || term || ' = ' || rendering AS line FROM glossary UNION ALL SELECT term_id + 1000, term || ' without sign' FROM glossary UNION ALL SELECT term_id + 2000, term || ' = later ' || rendering FROM glossary WHERE term_id < 3),
parsed AS (SELECT term_id, trim(regexp_extract(c, '^([^=]*)=', 1)) AS term, trim(regexp_extract(c, '^[^=]*=(.*)$', 1)) AS rendering FROM (SELECT term_id, trim(regexp_replace(line, '^\\s*(?:[-*•]|[0-9]+[.)])\\s*', '')) AS c FROM lines) WHERE contains(c, '=')),
last AS (SELECT term, arg_max(rendering, term_id) AS rendering FROM parsed WHERE term <> '' AND rendering <> '' GROUP BY term)
SELECT d.doc_id, l.term, l.rendering FROM documents d JOIN last l ON contains(lower(d.text), lower(l.term)) WHERE d.doc_kind = 'abstract'""")
def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    """X16 and X17 on abstracts, as the SQL has it: term lines are parsed, later ones win, and only terms that occur in the text stay. all_glossary_terms takes every document."""
    return X.with_terms(table(spark, d, "documents").where("doc_kind = 'abstract'"), "text", _parsed_terms(spark, d), ["doc_id"])


@query()
def all_glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of parsed term lines that occur in each document of any kind."""
    return X.with_terms(table(spark, d, "documents"), "text", _parsed_terms(spark, d), ["doc_id"])


def _parsed_terms(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "glossary")
    lines = g.select("term_id", F.concat(F.lit("- "), "term", F.lit(" = "), "rendering").alias("line"))
    lines = lines.unionByName(g.select((F.col("term_id") + 1000).alias("term_id"), F.concat("term", F.lit(" without sign")).alias("line")))
    lines = lines.unionByName(g.where("term_id < 3").select((F.col("term_id") + 2000).alias("term_id"), F.concat("term", F.lit(" = later "), "rendering").alias("line")))
    clean = lines.select("term_id", F.trim(F.regexp_replace("line", "^\\s*(?:[-*•]|[0-9]+[.)])\\s*", "")).alias("c")).where(F.contains("c", F.lit("=")))
    parsed = clean.select("term_id", F.trim(F.regexp_extract("c", "^([^=]*)=", 1)).alias("term"), F.trim(F.regexp_extract("c", "^[^=]*=(.*)$", 1)).alias("rendering")).where("term <> '' AND rendering <> ''")
    return parsed.groupBy("term").agg(F.max_by("rendering", "term_id").alias("rendering"))


@query(f"""WITH s AS (SELECT *, CAST(regexp_extract(seg_id, '_s([0-9]+)$', 1) AS INT) AS idx FROM {_SEG}),
h AS (SELECT doc_id, arg_min(source, page * 100000 + idx) AS title FROM s WHERE kind = 'heading' GROUP BY doc_id),
b AS (SELECT doc_id, arg_min(source, idx) AS abstract FROM s WHERE kind = 'body' AND page = 0 AND length(source) >= 150 GROUP BY doc_id)
SELECT doc_id, title, abstract[1:500] AS abstract FROM h FULL JOIN b USING (doc_id)""")
def document_brief(spark: SparkSession, d: str) -> DataFrame:
    """The first heading and the first long body text of the first page."""
    s = segments(spark, d).withColumn("idx", F.regexp_extract("seg_id", "_s([0-9]+)$", 1).cast("int"))
    h = s.where("kind = 'heading'").groupBy("doc_id").agg(F.min_by("source", F.struct("page", "idx")).alias("title"))
    b = s.where("kind = 'body' AND page = 0").where(F.length("source") >= 150).groupBy("doc_id").agg(F.min_by("source", "idx").alias("abstract"))
    return h.join(b, "doc_id", "full").select("doc_id", "title", F.substring("abstract", 1, 500).alias("abstract"))


@query(f"""SELECT doc_id, seg_id, concat_ws(chr(10), CASE WHEN kind = 'heading' THEN 'Heading' END, 'Text:', source[1:4000], 'Status: ' || status) AS prompt FROM {_SEG}""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that are missing are left out of a prompt."""
    return segments(spark, d).select("doc_id", "seg_id", F.concat_ws("\n", F.when(F.col("kind") == "heading", "Heading"), F.lit("Text:"), F.substring("source", 1, 4000), F.concat(F.lit("Status: "), "status")).alias("prompt"))


@query(f"""WITH r AS (SELECT doc_id, seg_id, regexp_extract(source, '["“]\\s*([^"“”]{{4,}}?)\\s*["”]', 1) AS t FROM {_SEG} WHERE kind = 'reference')
SELECT doc_id, seg_id, nullif(regexp_replace(t, '[,.;]+$', ''), '') AS title FROM r""")
def reference_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of bibliography entries."""
    return segments(spark, d).where("kind = 'reference'").select("doc_id", "seg_id", X.quoted_title(F.col("source")).alias("title"))


@query("""WITH e AS (SELECT filename, doc_id, regexp_replace(regexp_replace('a/../' || filename, '[<>:"|?*]', '_', 'g'), '^a/\\.\\./', 'a/') AS m FROM (SELECT DISTINCT * FROM jobs)),
n AS (SELECT doc_id, CASE WHEN lower(m) LIKE '%.pdf' THEN m ELSE m || '.pdf' END AS member FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(member) ORDER BY doc_id) AS k FROM n)
SELECT doc_id, member, CASE WHEN k = 1 THEN member ELSE regexp_replace(member, '(?i)(\\.pdf)$', ' (' || k || ')\\1') END AS unique_name FROM k""")
def archive_names(spark: SparkSession, d: str) -> DataFrame:
    """Safe member names, made unique by a number."""
    j = table(spark, d, "jobs").distinct().select("doc_id", X.safe_member(F.concat(F.lit("a/../"), "filename")).alias("member"))
    # one name may belong to a large part of all jobs: places are counted in blocks of id prefixes
    k = blocks.rank(j.withColumn("name", F.lower("member")), ["name"], F.substring("doc_id", 1, 3), ["doc_id"], "k")
    stem, ext = F.regexp_replace("member", "(?i)\\.pdf$", ""), F.regexp_extract("member", "(?i)(\\.pdf)$", 1)
    return k.select("doc_id", "member", F.when(F.col("k") == 1, F.col("member")).otherwise(F.concat(stem, F.lit(" ("), F.col("k").cast("string"), F.lit(")"), ext)).alias("unique_name"))


@query("""WITH v AS (SELECT DISTINCT regexp_extract(source, 'v\\. ([0-9]+\\.[0-9]+)', 1) AS v FROM segments),
p AS (SELECT v, list_transform(string_split(v, '.'), lambda x: CAST(x AS INT)) AS parts FROM v WHERE v <> '')
SELECT a.v AS older, count(*) AS n_newer FROM p a JOIN p b ON a.parts < b.parts GROUP BY a.v""")
def versions(spark: SparkSession, d: str) -> DataFrame:
    """Version tags compare as integers, part by part; the rank over distinct tags gives the newer ones."""
    v = table(spark, d, "segments").select(F.regexp_extract("source", "v\\. ([0-9]+\\.[0-9]+)", 1).alias("older")).where("older <> ''").distinct()
    p = v.withColumn("parts", X.version_parts(F.col("older")))
    # distinct tags only; their order is global by nature
    n = p.withColumn("n_newer", F.count(F.lit(1)).over(Window.orderBy(F.col("parts").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count(F.lit(1)).over(Window.partitionBy("parts")))
    return n.where("n_newer > 0").select("older", "n_newer")


@query(f"SELECT doc_id, seg_id, replace(replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS html FROM {_SEG}")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts escaped for HTML."""
    return segments(spark, d).select("doc_id", "seg_id", X.escape_html(F.col("source")).alias("html"))


@query("""WITH a AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z]\\. [A-Z][a-z]+'))) AS names FROM documents WHERE doc_kind = 'bibliography' AND text IS NOT NULL)
SELECT doc_id, CASE WHEN len(names) > 3 THEN array_to_string(names[1:3], ', ') || ' and ' || (len(names) - 3) || ' more' ELSE array_to_string(names, ', ') END AS authors FROM a""")
def author_lines(spark: SparkSession, d: str) -> DataFrame:
    """Three names and the number of the others."""
    t = table(spark, d, "documents").where("doc_kind = 'bibliography' AND text IS NOT NULL")
    names = F.array_sort(F.array_distinct(X.all_of(F.col("text"), "[A-Z]\\. [A-Z][a-z]+")))
    return t.select("doc_id", X.author_line(names).alias("authors"))


@query("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(filename), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(p, 12, '0') ELSE p END), '') AS sort_key FROM (SELECT DISTINCT * FROM jobs)""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """File names in natural order."""
    return table(spark, d, "jobs").distinct().select("doc_id", X.natural_key(F.col("filename")).alias("sort_key"))


@query(f"""WITH h AS (SELECT doc_id, seg_id, trim(regexp_replace(source, '⟦(?:EQ|M)[0-9]+⟧', ' ', 'g')) AS head FROM {_SEG}), r AS (SELECT *, regexp_extract(head, '^([^A-Za-z가-힣]+)', 1) AS run FROM h)
SELECT doc_id, seg_id, CASE WHEN head = '' THEN false WHEN regexp_matches(head, '^\\p{{L}}') THEN regexp_matches(head, '^\\p{{Ll}}')
  ELSE (regexp_matches(substr(head, length(run) + 1), '^\\p{{Ll}}') AND NOT regexp_matches(trim(run), '^[0-9]+$')) OR contains(run, '.') END AS continues FROM r""")
def continuation_starts(spark: SparkSession, d: str) -> DataFrame:
    """texts that start inside a sentence."""
    return segments(spark, d).select("doc_id", "seg_id", X.is_continuation(F.col("source")).alias("continues"))


@query(f"""WITH w AS (SELECT doc_id, seg_id, source, regexp_replace(source, '⟦EQ[0-9]+⟧', '', 'g') AS v FROM {_SEG}),
c AS (SELECT *, len(list_filter(regexp_extract_all(lower(source), '[A-Za-z]+'), lambda x: x IN ({_STOP}))) AS n_stop, len(list_filter(regexp_extract_all(v, '[A-Za-z]+'), lambda x: regexp_matches(x, '^[a-z]{{5,}}$'))) AS n_long,
  length(regexp_replace(v, '\\s', '', 'g')) AS n_visible FROM w)
SELECT doc_id, seg_id, n_stop, n_long, n_visible, n_visible >= 15 AND n_stop >= 2 AS prose, regexp_matches(source, '\\([0-9]+\\)\\s*$') AS numbered,
  regexp_matches(rtrim(source), '[.!?:]["''”’)\\]]*$') AS ends FROM c""")
def line_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Word counts and endings that the line classes are made of."""
    s = F.col("source")
    return segments(spark, d).select(
        "doc_id", "seg_id", X.stopword_count(s).cast("long").alias("n_stop"), X.long_words(X.visible(s)).cast("long").alias("n_long"), F.length(X.dense(s)).cast("long").alias("n_visible"),
        ((F.length(X.dense(s)) >= 15) & (X.stopword_count(s) >= 2)).alias("prose"), s.rlike("\\([0-9]+\\)\\s*$").alias("numbered"), X.ends_paragraph(s).alias("ends"),
    )


@query(f"""SELECT doc_id, seg_id, regexp_matches(source, '(?i)@|universit|institut|department|laborator|school of|college of') AS cue, regexp_matches(source, '(?i)https?://doi\\.org/|Received:\\s|Accepted:\\s|Published online:') AS meta,
  regexp_matches(source, '^\\s*\\[[0-9]+\\]\\s') AND regexp_matches(source, 'vol\\.|pp\\.|no\\.\\s*[0-9]|(?:19|20)[0-9]{{2}}') AS ref_item,
  regexp_matches(source, '(?i)^\\s*(?:(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*|[A-Z])[.)]?\\s+)?(?:references|bibliography|참고문헌)\\s*:?\\s*$') AS refs_title,
  regexp_matches(source, '^\\s*(?:(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*|[A-Z])[.)]|(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*))\\s+\\S') AS head_prefix,
  regexp_matches(source, '\\p{{L}}') AND NOT regexp_matches(source, '\\p{{Ll}}') AS caps FROM {_SEG}""")
def text_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues for authors, metadata, references and headings."""
    s = F.col("source")
    return segments(spark, d).select(
        "doc_id", "seg_id",
        s.rlike("(?i)@|universit|institut|department|laborator|school of|college of").alias("cue"),
        s.rlike("(?i)https?://doi\\.org/|Received:\\s|Accepted:\\s|Published online:").alias("meta"),
        (s.rlike("^\\s*\\[[0-9]+\\]\\s") & s.rlike("vol\\.|pp\\.|no\\.\\s*[0-9]|(?:19|20)[0-9]{2}")).alias("ref_item"),
        s.rlike("(?i)^\\s*(?:(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*|[A-Z])[.)]?\\s+)?(?:references|bibliography|참고문헌)\\s*:?\\s*$").alias("refs_title"),
        s.rlike("^\\s*(?:(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*|[A-Z])[.)]|(?:[IVXLCDM]+|[0-9]+(?:\\.[0-9]+)*))\\s+\\S").alias("head_prefix"),
        X.caps_only(s).alias("caps"),
    )


@query(f"SELECT doc_id, seg_id, 0 AS n_errors, len(regexp_extract_all(source, '{_MASK}')) AS n_tokens FROM {_SEG}")
def stub_translations(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in translations keep every token exactly once."""
    s = segments(spark, d)
    t = translate.translate_stub(s)
    n = F.size(X.all_of(F.col("translated"), X.MASKABLE)).cast("long")
    return t.select("doc_id", "seg_id", "n_errors", n.alias("n_tokens"))


@query("""WITH l AS (SELECT doc_id, text, regexp_extract(text, '^([A-Z][a-z]+(?:[ -][a-z]+)?):', 1) AS label FROM documents WHERE text IS NOT NULL)
SELECT doc_id, label, regexp_replace(substr(text, length(label) + 1), '^[ :;–—]+', '') AS body FROM l WHERE label <> ''""")
def inline_labels(spark: SparkSession, d: str) -> DataFrame:
    """A label that opens a text, and the body behind it."""
    t = table(spark, d, "documents").where("text IS NOT NULL").withColumn("label", F.regexp_extract("text", "^([A-Z][a-z]+(?:[ -][a-z]+)?):", 1)).where("label <> ''")
    return t.select("doc_id", "label", F.regexp_replace(F.substr("text", F.length("label") + 1), "^[ :;–—]+", "").alias("body"))
