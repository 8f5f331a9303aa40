"""Defects of prompt and response pairs.

Method: the suffix automaton of the prompt is traversed with the response to measure how much of it is copied;
refusal cues are found by an Aho-Corasick automaton; a delimiter stack and the ending show truncation; votes of
scripts and stopwords show the language. A pair gets the first defect of: empty, refusal, copy, wrong_language,
truncated.

Every pair goes through the same steps; nothing is sorted out before by a rougher test. What is costly is only done
where it can change the answer: names and tokens are taken out of a text only if its letters do not clearly belong to
one script, and the suffix automaton is built only for a response in the script of the prompt.

The language a response should have is a parameter, a code or a column.

Defined results: a null response is empty; a null or wordless prompt can be neither copied nor truncated.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
COPY_SHARE = 0.8  # of the response's signs must lie in copied stretches
COPY_STRETCH = 12  # shortest stretch that counts as copied
LANGUAGE_SHARE = 0.5
CLEAR_SHARE = 0.85  # of the letters of a text in one script: names and tokens cannot turn the vote

# Refusal cues. o: names the request or text; d: declines; s: the speaker is a model; f: does all at once.
_CUES: dict[str, list[str]] = {
    "o": [
        "이 문단", "이 부분", "이 글", "이 텍스트", "이 내용", "이 요청", "이 문장", "해당 글", "해당 문단", "해당 내용", "해당 텍스트", "해당 요청", "주어진 텍스트", "주어진 글", "주어진 내용", "요청하신", "원문을", "본문을",
        "this passage", "this text", "this one", "this content", "this translation", "that request", "this request", "your request", "this paragraph", "this document", "this segment", "the text", "the request",
        "diesen text", "dieser text", "diese anfrage", "dieser anfrage", "diese passage", "diesen absatz", "ce texte", "cette demande", "ce passage", "cette requête", "ce contenu",
        "この文章", "この文", "このテキスト", "この段落", "ご依頼", "この内容", "这段", "该文本", "此内容", "该请求", "这个请求", "此请求", "该内容", "本段", "ข้อความนี้", "คำขอนี้", "इस पाठ", "यह पाठ", "इस अनुरोध", "यह अनुरोध", "este texto", "esta solicitud", "questo testo",
    ],
    "d": [
        "번역해 드릴 수 없", "번역해드릴 수 없", "번역할 수 없", "번역이 불가", "번역을 거절", "번역하지 않겠", "번역할 수가 없", "번역하기 어렵", "옮기지 않겠", "옮기기 어렵", "옮길 수 없", "도와드릴 수 없", "도와 드릴 수 없", "도움을 드릴 수 없", "답변을 드리지 못", "답변드릴 수 없", "처리할 수 없는", "처리해 드릴 수 없", "제가 다룰 수 있는 범위를 벗어", "응할 수 없", "들어드릴 수 없", "거절하겠습니다", "제공할 수 없", "제공해 드릴 수 없",
        "cannot translate", "can't translate", "can not translate", "unable to help", "unable to translate", "unable to assist", "unable to process", "rather not translate", "have to decline", "must decline", "can't be translated", "cannot be translated", "won't be able to", "will not be able to", "won't translate", "will not translate", "not able to", "cannot help", "can't help", "cannot assist", "can't assist", "cannot process", "can't process", "cannot fulfill", "can't fulfill", "cannot comply", "refuse to", "i decline", "i must decline", "not comfortable", "cannot provide", "can't provide",
        "nicht übersetzen", "nicht helfen", "nicht weiterhelfen", "ablehnen", "nicht bearbeiten", "kann leider nicht", "pas traduire", "pas aider", "refuser", "dois décliner", "pas en mesure", "ne peux pas", "翻訳できません", "翻訳できかね", "お手伝いできません", "お断り", "対応できません", "応じられません", "お答えできません", "翻訳することはできません", "无法翻译", "不能翻译", "无法处理", "无法提供", "无法协助", "无法帮助", "拒绝翻译", "不便翻译", "无法满足", "不翻译", "无法完成",
        "ไม่สามารถแปล", "ไม่สามารถช่วย", "ขอปฏิเสธ", "अनुवाद नहीं कर सकता", "अनुवाद नहीं कर सकती", "सहायता नहीं कर सकता", "मदद नहीं कर सकता", "असमर्थ", "no puedo traducir", "no puedo ayudar", "non posso tradurre",
    ],
    "s": [
        "저는 언어 모델", "저는 인공지능", "저는 ai", "언어 모델이기 때문", "죄송하지만", "죄송합니다", "유감스럽게도", "안타깝지만", "아쉽게도", "미안합니다만", "양해 부탁", "정책에 어긋나",
        "as a language model", "as an ai", "i'm sorry", "i am sorry", "sorry,", "unfortunately", "i apologize", "i am ", "i'm ", "i cannot", "i can't", "i have to", "i'd rather", "i won't", "i will not", "by me", "i must", "please send another",
        "als sprachmodell", "es tut mir leid", "leider", "ich kann", "ich muss", "désolé", "en tant que modèle", "je ne", "je dois", "申し訳", "言語モデル", "残念ながら", "抱歉", "对不起", "语言模型", "很遗憾", "ขออภัย", "ขอโทษ", "क्षमा", "खेद", "भाषा मॉडल", "lo siento", "mi dispiace",
    ],
}
# Endings by which a sentence only reports somebody's refusal.
_REPORTS = re.compile("(?:다고|라고) (?:적었|말했|답했|썼|밝혔|전했)|답한다[.!]?$|\\b(?:wrote|said|reported|noted|stated)\\b|schrieb|sagte|écrivit|a dit|書いた|写道|说道|लिखा")
# Labels a response may open with, and fillers that say nothing.
_LABEL = re.compile(r"^\s*(?:번역문?|원문|translation|translated text|translated|korean|한국어|결과|답변|response|answer|output|übersetzung|traduction|訳文?|翻訳|译文|翻译)\s*(?:[:：]\s*|\n\s*)", re.I)
_FILLERS = frozenset("n/a na none null nil nan 없음 해당없음 내용없음 빈칸 tbd todo - . ... … undefined".split())

# Frequent short words of languages written in Latin letters.
STOPWORDS = {
    "en": frozenset("the of and to in is that it as for on with by at from this be are was were an or not which cannot because only if shows compared whereas we".split()),
    "de": frozenset("der die das und ist nicht von zu den mit auf für im ein eine des dem als auch es an werden aus bei nach gilt wenn nur denn aber wird laut sind wir vor über unter ohne während".split()),
    "fr": frozenset("le la les de des et est un une du en que qui dans pour pas au aux sur par ce il elle plus ne se avec car seulement selon après avant sous sans tandis à".split()),
    "es": frozenset("el la los las de y que en un una es por con para no se su al lo como más pero sus del".split()),
    "it": frozenset("il lo la gli le di e che un una è per con non si da del della nel sono come più ma".split()),
    "pt": frozenset("o a os as de e que em um uma é por com para não se do da no na mais mas ao".split()),
    "nl": frozenset("de het een en van in is dat op te voor met niet zijn aan er maar om ook als bij".split()),
    "vi": frozenset("là của và các có cho không được trong với một những này khi để".split()),
    "tr": frozenset("ve bir bu için ile olarak da de çok daha en gibi kadar sonra ancak".split()),
    "id": frozenset("yang dan di dari untuk dengan pada adalah ini itu tidak dalam akan".split()),
}
# The language of scripts that one language mainly uses; other scripts stand for themselves.
_LANGUAGES = {"HANGUL": "ko", "THAI": "th", "DEVANAGARI": "hi", "CYRILLIC": "ru", "GREEK": "el", "ARABIC": "ar", "HEBREW": "he", "LATIN": "latin", "CJK": "han", "IDEOGRAPHIC": "han", "HIRAGANA": "kana", "KATAKANA": "kana", "KATAKANA-HIRAGANA": "kana"}
# A syllable or a Han character carries as much as two or three Latin letters.
_WEIGHTS = {"ko": 2.2, "kana": 2.2, "han": 2.2, "latin": 1.0}
# Scripts of names and tokens.
_NAMING = frozenset({"latin", "el", "ru"})
# Scripts written without marks at the end of a sentence.
_MARKLESS = frozenset({"th", "lao", "khmer", "myanmar"})
_TOKEN = regex.compile(r"⟦[^⟧]*⟧|https?://\S+|\S+@\S+\.\S+|\[[\d,\s–-]*\]|\bv\.\s*\d[\d.]*")
_LETTER, _SAYING, _WORDS = regex.compile(r"\p{L}"), regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"[\p{L}']+")
_INVISIBLE, _SQUEEZED = regex.compile(r"[\p{Cf}\s]+"), regex.compile(r"[\s\p{Cf}\"'“”‘’«»]+")
_MASK = re.compile(r"⟦[^⟧]*⟧")
_FIGURE = regex.compile(r"\d[\d.,]*\s*(?:%|k?Hz|dB)?")
_NAME = regex.compile(r"(?<![\p{L}\d])(?:\p{Lu}{2,}[\p{L}\d]*(?:-\d+)?|[\p{Latin}\p{Greek}\p{Cyrillic}]+-?\d[\p{Latin}\p{Greek}\p{Cyrillic}\d-]*|\p{Lu}\p{Ll}+(?:\p{Lu}[\p{L}]*)+|\p{L}*\p{Ll}\p{Lu}[\p{L}\d]*)(?![\p{L}\d])")


class SuffixAutomaton:
    """Accepts every substring of the prompt; built and traversed in linear time."""

    __slots__ = ("links", "lengths", "steps")

    def __init__(self, text: str) -> None:
        steps: list[dict[str, int]] = [{}]
        links, lengths, last = [-1], [0], 0
        for c in text:
            cur = len(steps)
            steps.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = cur
                p = links[p]
            if p >= 0:
                q = steps[p][c]
                if lengths[q] == lengths[p] + 1:
                    links[cur] = q
                else:
                    clone = len(steps)
                    steps.append(dict(steps[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = clone
                        p = links[p]
                    links[q] = links[cur] = clone
            last = cur
        self.steps, self.links, self.lengths = steps, links, lengths

    def coverage(self, other: str, stretch: int) -> float:
        """The share of `other` that lies in substrings of the prompt at least `stretch` long."""
        if not other:
            return 0.0
        steps, links, lengths = self.steps, self.links, self.lengths
        state = length = covered = 0
        upto = 0  # signs before it are covered already
        for i, c in enumerate(other):
            while state and c not in steps[state]:
                state = links[state]
                length = lengths[state]
            nxt = steps[state].get(c)
            if nxt is None:
                state = length = 0
            else:
                state, length = nxt, length + 1
            if length >= stretch:
                begin = max(upto, i + 1 - length)
                covered += i + 1 - begin
                upto = i + 1
        return covered / len(other)


@cache
def _refusals(kinds: str) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind in kinds:
        for cue in _CUES[kind]:
            a.add_word(cue, kind)
    a.make_automaton()
    return a


_CLAUSE = regex.compile(r"[^.!?。！？।\n※]*[.!?。！？।\n]*")


def is_refusal(text: str) -> bool:
    """A sentence that declines and speaks of the request or of the speaker, and reports nobody else's words."""
    low = text.lower().replace("’", "'")
    if next(_refusals("d").iter(low), None) is None:
        return False
    automaton = _refusals("ods")
    for m in _CLAUSE.finditer(low):
        part = m.group()
        if not part.strip():
            continue
        kinds = {k for _, k in automaton.iter(part)}
        if "d" in kinds and ("o" in kinds or "s" in kinds) and not _REPORTS.search(part):
            return True
    return False


# more letters and digits than the longest label and filler have together
_SAYS = re.compile(r"(?:[\W_]*[^\W_]){40}")


def says_nothing(text: str | None) -> bool:
    if text is None:
        return True
    if _SAYS.match(text):
        return False
    bare = _INVISIBLE.sub(" ", text).strip()
    bare = _LABEL.sub("", bare + "\n").strip()
    if bare.lower().strip("()[]{}<>\"'“”‘’ .:") in _FILLERS:
        return True
    return not _SAYING.search(bare)


# a plain word between blanks or, of letters without case, between other signs: no name or figure takes it in
_PLAIN_WORD = re.compile(r"(?<!\S)[a-z]{2,}(?!\S)|(?<!\w)[\u0900-\u0dff\u0e00-\u0fff\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]{2,}(?!\w)")


def has_words(text: str) -> bool:
    """Whether a text has words beside tokens, figures, links and identifiers."""
    if "⟦" in text:
        text = _MASK.sub(" ", text)
    if "@" not in text and "/" not in text and _PLAIN_WORD.search(text):
        return True
    return bool(_LETTER.search(words_of(text)))


def words_of(text: str) -> str:
    """The text without tokens, figures, links and identifiers."""
    bare = _TOKEN.sub(" ", text)
    if not text.isupper() or sum(map(str.isalpha, text)) <= 20:
        bare = _NAME.sub(" ", bare)
    return _FIGURE.sub(" ", bare)


@cache
def _script(c: str) -> str:
    """The script of a letter or of a mark that belongs to one; empty for all other characters."""
    if unicodedata.category(c)[0] not in "LM":
        return ""
    name = unicodedata.name(c, "")
    if name.startswith(("FULLWIDTH", "HALFWIDTH", "MODIFIER", "MATHEMATICAL", "COMBINING")):
        folded = unicodedata.normalize("NFKC", c)
        name = unicodedata.name(folded[0], "") if folded != c else ""
    word = name.partition(" ")[0]
    return _LANGUAGES.get(word, word.lower())


class _Scripts:
    """The scripts of characters by code point; a character is looked up when it first occurs."""

    NEW = 255

    def __init__(self) -> None:
        self.of = np.full(sys.maxunicode + 1, self.NEW, np.uint8)
        self.names = [""]

    def counts(self, text: str) -> dict[str, int]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.of[codes]
        if kinds.size and kinds.max() == self.NEW:
            for code in np.unique(codes[kinds == self.NEW]):
                name = _script(chr(code))
                if name not in self.names:
                    self.names.append(name)
                self.of[code] = min(self.names.index(name), self.NEW - 1)
            kinds = self.of[codes]
        found = np.bincount(kinds, minlength=1)
        return {self.names[k]: int(n) for k, n in enumerate(found[1:], 1) if n}


@cache
def _scripts() -> _Scripts:
    return _Scripts()


def _votes(text: str) -> dict[str, float]:
    """The weight of the letters of each script."""
    return {k: n * _WEIGHTS.get(k, 1.2) for k, n in _scripts().counts(text).items()}


def _letters(text: str) -> dict[str, float]:
    """The votes of a text; without names and tokens, where these could turn the vote.

    They are written in Latin, Greek or Cyrillic letters, so they cannot where another script has more than half.
    """
    votes = _votes(text)
    if votes:
        top = max(votes, key=votes.get)
        if votes[top] < sum(votes.values()) * (CLEAR_SHARE if top in _NAMING else 0.5):
            return _votes(words_of(text))
    return votes


def main_script(text: str) -> str:
    """The script most letters are of."""
    votes = _letters(text)
    return max(votes, key=votes.get) if votes else ""


def language(text: str) -> tuple[str, float]:
    """The language most letters speak for, with its share."""
    votes = _letters(text)
    kana, han, latin = (votes.pop(k, 0.0) for k in ("kana", "han", "latin"))
    if kana or han:
        votes["ja" if kana > 0.12 * (kana + han) else "zh"] = kana + han
    if latin:
        words = _WORDS.findall(words_of(text).lower())
        counts = Counter(words)
        scores = {lang: sum(counts[x] for x in stop if x in counts) for lang, stop in STOPWORDS.items()}
        scores["fr"] += 0.5 * sum("'" in x and x.split("'")[0] in ("l", "d", "qu") for x in words)
        lang = max(scores, key=scores.get)
        votes[lang if scores[lang] else "latin"] = latin
    total = sum(votes.values())
    if not total:
        return "", 0.0
    best = max(votes, key=votes.get)
    return best, votes[best] / total


def _squeeze(text: str) -> str:
    return _SQUEEZED.sub("", text).casefold()


_DONE_KO = re.compile("(?:다|요|까|죠|라니)$")
# Marks at the end of a sentence, what may close behind them, and marks no sentence ends with.
_TERMINATORS = frozenset(".!?。！？।॥")
_CLOSERS = "\"”’»)]」』）"
_OPEN_ENDS = frozenset("…,、，;:·-–—‐/([「“«")
# Opening delimiters and what closes them.
_DELIMITERS = {")": "(", "]": "[", "}": "{", "”": "“", "」": "「", "』": "『", "»": "«", "⟧": "⟦", "）": "（", "】": "【", "》": "《", "〉": "〈"}
_OPENERS = frozenset(_DELIMITERS.values())
_DELIMITER = re.compile("[" + re.escape("".join(_DELIMITERS) + "".join(_OPENERS) + '"') + "]")


def _unbalanced(text: str) -> bool:
    """Whether a delimiter stays open at the end; a closing one takes all that opened behind its partner with it."""
    stack: list[str] = []
    open_now: Counter[str] = Counter()
    for c in _DELIMITER.findall(text):
        if c in _OPENERS:
            want = ""
        elif c == '"':
            want = '"' if open_now['"'] else ""
        else:
            want = _DELIMITERS[c]
            if not open_now[want]:
                continue
        if not want:
            stack.append(c)
            open_now[c] += 1
            continue
        while True:
            top = stack.pop()
            open_now[top] -= 1
            if top == want:
                break
    return bool(stack)


def _bare_end(text: str) -> str:
    """The text without blanks and invisible characters at its end."""
    n = len(text)
    while n and (text[n - 1].isspace() or unicodedata.category(text[n - 1]) == "Cf"):
        n -= 1
    return text[:n]


def _open_end(t: str) -> tuple[str, str] | None:
    """The mark a text breaks off with and the text before it."""
    core = t.rstrip("\"”’")
    if core.endswith("..."):
        return "...", core[:-3]
    return (core[-1], core[:-1]) if core and core[-1] in _OPEN_ENDS else None


def _ended(t: str) -> bool:
    core = t.rstrip(_CLOSERS)
    return bool(core) and core[-1] in _TERMINATORS


def breaks_off(text: str, heading: bool) -> bool:
    """Whether the text stops inside a sentence."""
    t = _bare_end(text)
    if not t:
        return False
    if _unbalanced(t):
        return True
    end = _open_end(t)
    if end:
        mark, before = end
        stem = re.sub(r"\s*(?:\[[\d, ]+\]|\([^()]*\))$", "", before.rstrip(" .…"))
        return not (mark[0] in ".…" and (_DONE_KO.search(stem) or not stem))
    if _ended(t) or heading:
        return False
    if re.search("[가-힣]", t):
        return not _DONE_KO.search(t.rstrip(" \t\r\n()[]\"”’0123456789.%<p=") if t[-1] in ")]" else t)
    return main_script(t) not in _MARKLESS


def source_complete(text: str, heading: bool) -> bool:
    t = _bare_end(text)
    if not t:
        return False
    return (_ended(t) and not _open_end(t)) or main_script(t) in _MARKLESS


def defect_of(source: str | None, response: str | None, kind: str | None = "body", target: str | None = "ko") -> str | None:
    """The defect of one pair, or None; `target` is the language the response should have."""
    heading = kind == "heading"
    source, target = source or "", target or ""
    wordy = has_words(source)
    if says_nothing(response):
        if not wordy and response is not None and source.strip() and source.strip() == response.strip():
            return None
        return "empty"
    if is_refusal(response):
        return "refusal"
    if wordy:
        bare = _LABEL.sub("", response)
        # words of different scripts cannot be copies of each other
        said = _letters(bare)
        asked = _letters(source)
        clear = target == "ko" and said.get("ko", 0.0) * 2 > sum(said.values()) and asked.get("ko", 0.0) * 2 <= sum(asked.values())
        if not clear:
            a, b = _squeeze(source), _squeeze(bare)
            if a == b:
                return "copy"
            lang, part = language(bare)
            src = language(source)[0]
            # a response in its own language, other than that of the prompt, shares no stretch of words with it
            if lang != target or src == target:
                if b and len(b) >= min(COPY_STRETCH, len(a)) and _same_script(lang, src):
                    seen = SuffixAutomaton(a)
                    stretch = min(COPY_STRETCH, max(3, len(a) // 2))
                    words = _squeeze(words_of(bare))
                    if seen.coverage(b, stretch) >= COPY_SHARE and seen.coverage(words, min(stretch, 6)) >= COPY_SHARE:
                        return "copy"
                if lang and lang not in (target, "latin") and part >= LANGUAGE_SHARE and lang != src:
                    return "wrong_language"
        if source_complete(source, heading) and breaks_off(response, heading):
            return "truncated"
    return None


def _same_script(a: str, b: str) -> bool:
    group = lambda x: "han" if x in ("ja", "zh") else "latin" if x in STOPWORDS or x in ("", "latin") else x
    return group(a) == group(b)


def flag_pairs(df: DataFrame, source: str = "source", response: str = "translated", kind: str = "kind", *, target: str | Column = "ko", keep: tuple[str, ...] = ("doc_id", "seg_id")) -> DataFrame:
    """One row per defective pair: the `keep` columns and its defect type.

    `target` is the language of the responses, a code for all or a column. Repeated rows give repeated results;
    callers that want cases apply distinct.
    """
    aim = F.lit(target) if isinstance(target, str) else target
    base = df.select(*keep, F.col(source).alias("__s"), F.col(response).alias("__r"), F.col(kind).alias("__k"), aim.alias("__l"))
    schema = StructType([df.schema[c] for c in keep]).add("defect", StringType())
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_pylist()
            got = [defect_of(*x) for x in zip(col("__s"), col("__r"), col("__k"), col("__l"), strict=True)]
            rows = [i for i, d in enumerate(got) if d]
            part = batch.select(names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([got[i] for i in rows], pa.string())], [*names, "defect"])

    return base.mapInArrow(run, schema)
