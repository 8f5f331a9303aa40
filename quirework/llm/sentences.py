"""Sentence units of texts in any script.

Method: the sentence-break classes of the Unicode character properties (STerm, ATerm, Close, Sp, SContinue, Lower, as
the property Sentence_Break gives them for all scripts) with their rules on full stops before digits, lower-case
letters and continuing marks; suppression after abbreviations of the language; quotations and brackets inside a
sentence do not end it, and closing marks belong to the unit they close. Scripts written without full stops (Thai,
Lao, Khmer, Burmese) break at the blanks between two of their own letters too.

The language is voted in each paragraph, so a text may change it. Delimiters are paired by one pass over a paragraph
with a stack, however far apart they stand; what has no partner in its paragraph is no delimiter.

Offsets count code points, the end is exclusive, blanks around a unit belong to none.
Defined results: null and blank texts have no units.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

# Abbreviations after which a full stop ends no sentence.
_TITLES = "Dr Prof Eng Pr Mag Dra Sra Sres Mgr Maj Sgt Gov Sen Rep Pres Mr Mrs Ms Mme Mlle St Ste Sr Jr Rev Gen Col Capt Lt Hon Messrs Hr Fr Frl Dipl Ing MM Me ดร นพ รศ ผศ ศ डॉ श्री"
_PLACES = "No Nos Nr Apt Bldg Rm Ave Blvd Rd Str Bd Fl bât av boul n° num tél Tel Hl"
_PARTS = "Fig Figs fig figs Eq Eqs eq eqs éq Tab Tabs tab Sec Secs sec sect Sect Ch Chs ch chap Chap App app annexe Ref Refs ref réf Abb Gl Kap Abschn Anh Vol vol Nr Art art par Par p pp P S Bd Th Def Lem Prop Cor Ex"
_LATIN = "cf Cf viz vs resp approx est ca Ca env max min incl excl al et i.e e.g bzw vgl Vgl sog ggf evtl inkl exkl geb gest max Min Max v V ver Ver Vers vers ed Ed eds Eds rev Rev trans repr c.-à-d c-à-d p.ex id ibid op cit jr ff f sq dgl Bsp bspw Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec janv févr juill Mär Okt Dez Mo Di Mi Do Fr Sa So dept Dept Univ Inc Ltd Co Corp"
ABBREVIATIONS = frozenset(f"{_TITLES} {_PLACES} {_PARTS} {_LATIN}".split()) - {"So", "Do", "Mi", "Di", "Mo", "Sa", "et", "f", "ff", "S", "P"}
# Abbreviations that may well end a sentence; a capital after them starts a new one.
_ENDERS = frozenset("etc usw usf a.m p.m m.a al Inc Ltd Co Corp ff f sq ibid jr Jr".split())
# German months, after which a figure with a full stop is a date.
_MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Klasse Ordnung Grades".split())

_ASSIGNED = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))


def _having(value: str) -> str:
    """All characters with a value of the property Sentence_Break."""
    return "".join(regex.findall(rf"\p{{Sentence_Break={value}}}", _ASSIGNED))


def _brackets() -> dict[str, str]:
    """Opening and closing brackets of all scripts; the code charts put the closing one behind the opening one."""
    opening = regex.findall(r"[\p{Sentence_Break=Close}&&\p{Ps}--[‚„]]", _ASSIGNED, flags=regex.V1)
    out = {c: chr(ord(c) + 1) for c in opening if regex.match(r"\p{Pe}", chr(ord(c) + 1))}
    return out | {"[": "]", "{": "}"}


_STOP = _having("ATerm") + "｡"
# an ellipsis and a doubled exclamation mark end sentences too, though the property leaves them out
_TERM = _having("STerm") + "…"
_CONTINUING = frozenset(_having("SContinue"))
_BRACKETS = _brackets()
# Quotation marks, opening and closing.
_QUOTES = {"「": "」", "『": "』", "｢": "｣", "“": "”", "„": "“", "‚": "‘", "«": "»", "‹": "›", "»": "«", '"': '"'}
_PAIR = _BRACKETS | _QUOTES
_CLOSING = frozenset(_BRACKETS.values()) | frozenset("」』｣”’»›")
_RIGHT_BRACKETS = frozenset(_BRACKETS.values()) - frozenset("」』｣》〉⟩⟫")
_DELIMITER = regex.compile("[" + regex.escape("".join(_PAIR) + "".join(_PAIR.values())) + "]")
_EVENT = regex.compile("[" + regex.escape(_STOP + _TERM + "".join(_PAIR) + "".join(_PAIR.values())) + "\n\r\u0085\u2028\u2029]")
_PARAGRAPH = regex.compile("(?:\n\n|\n\r\n|\u2029)")
_SPACELESS = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_SPACELESS_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}ๆฯ])\s+(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])")
_SPACELESS_MARK = regex.compile("[" + regex.escape(_TERM) + r"]+[\"”)]*(?=\s)|(?<=[^\d\s.\p{L}])\.(?=\s+\p{Lu})")
_ENDING = frozenset(_STOP + _TERM)
_DOTS = frozenset(_having("ATerm"))
_LATIN_BEFORE = regex.compile(r"[\p{Latin}\p{M}.°-]+$")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}.-]+$")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_LOWER_AHEAD = regex.compile(r"[^\p{L}\p{M}.．。!?！？।…\n\"“”„«»「」]*\p{Sentence_Break=Lower}")
_CONTINUES = regex.compile(r"\s*(?:また|そして|しかし|のち|やがて|次に|その後|随后|隨後|然后|然後|接着|又|再|但|而|还是|다시|또|그리고|하지만|फिर|और|फ़िर|\p{Ll})")
_SAYING_JA = regex.compile(r"\s*(?:と|って|という|との|を|は|が|の|に|も)")
_SAYING_ZH = regex.compile(r"[^。！？\n]{0,30}?(?:写道|说道|说|问道|问|答道|指出|认为|寫道|說|問)")
_SAYING_HI = regex.compile(r"\s*[^।\n]{0,60}?ने\s+(?:लिखा|कहा|पूछा|बताया)")
_SAYING_KO = regex.compile(r"\s*(?:라고|이라고|라는|이라|하고|고 )")
_RUN_ON_KO = regex.compile(r"[\p{L}⟦\"“]")
_PAUSE_KO = regex.compile(r"[다요까죠네라니]$")


def _script(text: str) -> str:
    best, most = "latin", 0
    counts = {
        "ko": len(regex.findall(r"\p{Hangul}", text)),
        "ja": 3 * len(regex.findall(r"[\p{Hiragana}\p{Katakana}]", text)),
        "zh": len(regex.findall(r"\p{Han}", text)),
        "hi": len(regex.findall(r"\p{Devanagari}", text)),
        "th": len(_SPACELESS.findall(text)),
        "latin": len(regex.findall(r"[\p{Latin}\p{Cyrillic}\p{Greek}]", text)) / 2.5,
    }
    for k, n in counts.items():
        if n > most:
            best, most = k, n
    return best


def _suppressed(text: str, at: int, after: int) -> bool:
    """Whether the full stop at `at` belongs to an abbreviation, initial or number."""
    m = _LATIN_BEFORE.search(text, max(0, at - 24), at) or _WORD_BEFORE.search(text, max(0, at - 24), at)
    word = m.group() if m else ""
    nxt = text[after] if after < len(text) else ""
    if not word:
        if text[at - 1 : at].isdigit():
            d = re.search(r"(?<![\d.,])(\d{1,2})$", text[max(0, at - 6) : at])
            if d:
                w = re.match(r"[^\W\d_]+", text[after : after + 14])
                return bool(w and w.group() in _MONTHS)
        return False
    tail = regex.split(r"[-‐]", word)[-1].lstrip(".")
    if word.lstrip(".-") in _ENDERS or tail in _ENDERS:
        if tail in ("etc", "usw", "usf", "p.m", "a.m"):
            return False
        return not nxt.isupper() or tail == "al"
    if tail in ABBREVIATIONS or word in ABBREVIATIONS:
        return True
    last = tail.rsplit(".", 1)[-1]
    if len(last) == 1 and last.isalpha() and (last.isupper() or "." in tail or tail != word):
        return True
    if len(tail) == 1 and tail.isalpha():
        before = text[at - 2 : at - 1]
        # single letters: initials, and the parts of "z. B.", "p. ex."
        return tail.isupper() or tail in "pvnuizad" and (before == " " or before == "") and at > 2
    return "." in tail and last in ABBREVIATIONS


def delimiters(text: str) -> dict[int, int]:
    """The place of the partner of each paired delimiter, both ways; pairs are nested. One pass with a stack."""
    stack: list[tuple[str, int]] = []
    wanted: Counter[str] = Counter()
    out: dict[int, int] = {}
    for m in _DELIMITER.finditer(text):
        at, c = m.start(), m.group()
        # a straight quote behind a blank and before a letter opens again
        opens = c == '"' and text[at - 1 : at].isspace() and text[at + 1 : at + 2].isalnum()
        if wanted[c] and not (opens and stack[-1][1] < at - 1 and stack[-1][0] == c):
            while True:
                want, start = stack.pop()
                wanted[want] -= 1
                if want == c:
                    break
            out[start], out[at] = at, start
        elif c == "»":
            if at + 1 < len(text) and not text[at + 1].isspace() and (not at or not text[at - 1].isalnum() and text[at - 1] not in ".!?…\xa0\u202f"):
                stack.append(("«", at))
                wanted["«"] += 1
        elif c in _PAIR:
            stack.append((_PAIR[c], at))
            wanted[_PAIR[c]] += 1
    return out


def split_spans(text: str | None, heading: bool = False) -> list[tuple[int, int]]:
    """Start and end of each sentence unit."""
    if not text or text.isspace():
        return []
    n = len(text)
    if heading:
        return _trim(text, [(0, n)])
    out: list[tuple[int, int]] = []
    start = 0
    for m in chain(_PARAGRAPH.finditer(text), (None,)):
        end = m.end() if m else n
        part = text if end - start == n else text[start:end]
        out += [(start + a, start + b) for a, b in _paragraph(part)]
        start = end
    return out


def _paragraph(text: str) -> list[tuple[int, int]]:
    n = len(text)
    kind = _script(text)
    partner = delimiters(text)
    if kind == "th":
        return _spaceless(text, partner)
    cuts: list[int] = []
    start = 0  # of the present unit, blanks included
    i = 0
    until = -1  # the end of the outermost open delimiter
    while i < n:
        m = _EVENT.search(text, i)
        if not m:
            break
        at, c = m.start(), m.group()
        i = at + 1
        if c in "\n\r\u0085\u2028\u2029":
            continue
        mate = partner.get(at)
        if mate is not None and mate > at:
            until = max(until, mate)
            continue
        if mate is not None:
            if at < until:
                continue
            opened = mate
            inner_end = at
            while inner_end > opened + 1 and text[inner_end - 1].isspace():
                inner_end -= 1
            ended = inner_end > opened + 1 and text[inner_end - 1] in _ENDING
            if ended and text[inner_end - 1] == ".":
                ended = not _suppressed(text, inner_end - 1, inner_end)
            if not ended:
                continue
            end = _closers(text, i)
            lead = text[start:opened].strip()
            if _ends_after_quote(text, c, lead, end, kind):
                cuts.append(end)
                start = end
            i = end
            continue
        if c not in _ENDING:
            continue
        # a terminator
        j = at
        while j < n and text[j] in _ENDING:
            j += 1
        run = text[at:j]
        i = j
        if at < until:
            continue
        end = _closers(text, j)
        after = end
        while after < n and text[after].isspace():
            after += 1
        if after >= n:
            break
        gap = after > end
        if kind == "ko" and not gap and run[-1] in ".!?" and _RUN_ON_KO.match(text, end):
            # a blank is missing behind a verb ending or a closed bracket
            if run[-1] != "." or text[at - 1 : at] in ("다", "요", "죠", "까", ")", "]"):
                cuts.append(end)
                start = end
                i = max(i, end)
                continue
        if len(run) == 1 and run in _DOTS:
            if not gap:
                continue
            if text[at - 1 : at].isspace() or at == 0:
                continue
            if _suppressed(text, at, after):
                continue
            if _LOWER_AHEAD.match(text, after):
                continue
        elif set(run) <= {".", "…"}:
            before = text[at - 1 : at]
            if kind in ("zh", "ja"):
                if _CONTINUES.match(text, end):
                    continue
            elif not gap:
                continue
            elif kind == "ko":
                if before.isspace() or not (_PAUSE_KO.search(before) or before in ")]" or before.isdigit()):
                    continue
                if _CONTINUES.match(text, after):
                    continue
            elif _CONTINUES.match(text, after) or (before.isspace() and not text[after].isupper()):
                continue
        elif run[-1] in "!?" and kind != "zh" and kind != "ja":
            if not gap:
                continue
            if text[after].islower():
                continue
        if text[after] in _CONTINUING and not gap:
            continue
        cuts.append(end)
        start = end
        i = max(i, end)
    bounds = [0, *cuts, n]
    return _trim(text, list(zip(bounds, bounds[1:], strict=False)))


def _closers(text: str, at: int) -> int:
    """The position behind closing quotes and brackets; a blank may stand before » only."""
    n = len(text)
    while at < n:
        if text[at] in _CLOSING:
            at += 1
        elif text[at] in "   " and at + 1 < n and text[at + 1] in "»›":
            at += 2
        else:
            break
    return at


def _ends_after_quote(text: str, closer: str, lead: str, end: int, kind: str) -> bool:
    """Whether the sentence is over behind a quotation or bracket that holds a full sentence."""
    n = len(text)
    after = end
    while after < n and text[after].isspace():
        after += 1
    if after >= n:
        return False
    bracket = closer in _RIGHT_BRACKETS
    if bracket:
        if lead:
            return False
        return kind in ("zh", "ja") or after > end
    introduced = lead.endswith((":", "：", ",")) or not lead
    if kind == "zh":
        if lead.endswith(("：", ":")):
            return True
        return not lead and not _SAYING_ZH.match(text, end)
    if kind == "ja":
        return introduced and not _SAYING_JA.match(text, end)
    if after == end:
        return False
    nxt = text[after]
    if kind == "hi":
        return introduced and not _SAYING_HI.match(text, end)
    if kind == "ko":
        return not _SAYING_KO.match(text, end)
    return not _LOWER_AHEAD.match(text, after) or not nxt.isalpha() and not _LOWER_AHEAD.match(text, after)


def _spaceless(text: str, partner: dict[int, int]) -> list[tuple[int, int]]:
    """Scripts that leave the sentence mark out: a blank between two of their letters divides units, outside delimiters."""
    inside, until = [], -1
    for a in sorted(partner):
        if a > until and partner[a] > a and text[a] in '"“”„«「':
            until = partner[a]
            inside.append((a, until))
    starts = [a for a, _ in inside]

    def outside(at: int) -> bool:
        k = bisect_left(starts, at) - 1
        return k < 0 or at >= inside[k][1]

    cuts = {m.start() for m in _SPACELESS_GAP.finditer(text) if outside(m.start())}
    cuts |= {m.end() for m in _SPACELESS_MARK.finditer(text) if outside(m.start())}
    bounds = [0, *sorted(cuts), len(text)]
    return _trim(text, list(zip(bounds, bounds[1:], strict=False)))


def _trim(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def sentence_units(df: DataFrame, column: str, heading: str | None = None) -> DataFrame:
    """One row per sentence unit of `column`, with start_char and end_char; other columns are repeated.

    `heading` names a boolean column: where true the whole text is one unit. Columns called start_char or
    end_char are replaced.
    """
    base = df.select(*[c for c in df.columns if c not in ("start_char", "end_char")]).where(F.col(column).isNotNull())
    keep = [c for c in base.columns if c != column]
    schema = StructType([base.schema[c] for c in keep]).add("start_char", IntegerType()).add("end_char", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            heads = batch.column(batch.schema.get_field_index(heading)).to_pylist() if heading else [False] * len(texts)
            rows, starts, ends = [], [], []
            for k, (t, h) in enumerate(zip(texts, heads, strict=True)):
                for a, b in split_spans(t, bool(h)):
                    rows.append(k)
                    starts.append(a)
                    ends.append(b)
            part = batch.select(keep).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [*keep, "start_char", "end_char"])

    return base.mapInArrow(run, schema)
