"""Text decoded with the wrong character encoding: detection and round-trip repair.

Method: re-encode the text under candidate legacy encodings, decode strictly as the intended one, repeat for
nested layers as long as there are any, and accept a step only when the garbling cost drops. The cost drops with each
step, so the steps end by themselves.

Two families are handled:

* UTF-8 bytes read as a single-byte encoding. In every single-byte encoding these show as a lead character
  followed by one to three continuation characters, so in each maximal run of high characters these sequences are
  re-encoded and decoded strictly; sound characters between them stay as they are.
* Double-byte East Asian text read as Latin-1 or Windows-1252, where whole stretches of high characters pair up and
  are decoded strictly. Where a stretch was cut inside a sign, the half that is left becomes U+FFFD.

U+FFFD marks text that was decoded with losses; it counts as garbled though nothing can restore it.

Defined results: null stays null and is not garbled; empty and pure ASCII texts come back as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# The single-byte encodings under which UTF-8 is commonly misread.
SINGLE = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850", "koi8-r", "iso8859-15")
# The double-byte encodings commonly misread as Latin-1 or Windows-1252.
DOUBLE = ("euc_kr", "gb18030", "shift_jis", "euc_jp", "big5")
LOSS = "�"


@cache
def _table(enc: str) -> dict[str, int]:
    """Character to byte for the high half; bytes the encoding leaves open stand for C1 controls."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    return out


def _cls(chars: list[str]) -> str:
    return "[" + "".join("\\u%04x" % ord(c) for c in sorted(chars)) + "]"


@cache
def _utf8_shape(enc: str) -> str:
    """A regular expression, valid in Python and Java, for UTF-8 sequences seen through `enc`."""
    t = _table(enc)
    tail = _cls([c for c, b in t.items() if b < 0xC0])
    two = _cls([c for c, b in t.items() if 0xC2 <= b <= 0xDF])
    three = _cls([c for c, b in t.items() if 0xE0 <= b <= 0xEF])
    four = _cls([c for c, b in t.items() if 0xF0 <= b <= 0xF4])
    return f"(?:{two}{tail}|{three}{tail}{{2}}|{four}{tail}{{3}})"


@cache
def _sequence(enc: str) -> re.Pattern[str]:
    return re.compile(_utf8_shape(enc))


@cache
def _run(enc: str) -> re.Pattern[str]:
    return re.compile(_cls(list(_table(enc))) + "+")


_HIGH = "\\u0080-\\u00ff\\u0152\\u0153\\u0160\\u0161\\u0178\\u017d\\u017e\\u0192\\u02c6\\u02dc\\u2013\\u2014\\u2018-\\u201e\\u2020-\\u2022\\u2026\\u2030\\u2039\\u203a\\u20ac\\u2122"


def suspicious(col: Column) -> Column:
    """The test inside the JVM: garbled text is never pure ASCII. It compares two stored lengths only."""
    return F.coalesce(F.octet_length(col) > F.length(col), F.lit(False))


@cache
def _maybe() -> re.Pattern[str]:
    """What every garbled text has somewhere; one character class in front rules out most places at once."""
    leads = {c for enc in SINGLE for c, b in _table(enc).items() if 0xC2 <= b <= 0xF4}
    shapes = [LOSS, f"[{_HIGH}]{{3}}", f"[{_HIGH}].[{_HIGH}].[{_HIGH}]", *map(_utf8_shape, SINGLE)]
    return re.compile(f"(?=[{_HIGH}{LOSS}]|{_cls(list(leads))})(?:" + "|".join(shapes) + ")", re.S)


# Letters of other scripts that pass for Latin ones: a run of only these is disguise, not garbling.
_PASSING = frozenset("АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵӏ")


def _weight(c: str) -> float:
    """How much a character speaks for garbling."""
    o = ord(c)
    if o < 0x80:
        return 0.0
    if 0x80 <= o < 0xA0 or c == LOSS:
        return 4.0
    if 0xA0 <= o < 0xC0 or c in "×÷‚ƒ„…†‡ˆ‰‹›˜™€":
        return 1.5
    if 0x2500 <= o < 0x2600 or c in "⌐∞≈√∫∆∏∑ΩπªºΓΘΦΣστδφε∩≡±≥≤⌠⌡":
        return 1.5
    if 0xC0 <= o < 0x250 or 0x370 <= o < 0x530:
        return 1.0
    return 0.2


def garbling_cost(text: str) -> float:
    """The sum of character weights; natural text of any script costs little, its garbled form much."""
    return sum(map(_weight, text))


def _credible(text: str) -> bool:
    for c in text:
        o = ord(c)
        if o < 0x20 or 0x7F <= o < 0xA0 or 0xE000 <= o < 0xF900 or o > 0x1FAFF or (0x0250 <= o < 0x0370 and o not in (0x2C6, 0x2DC)) or 0x0700 <= o < 0x0900 or 0x1200 <= o < 0x1E00:
            return False
    return True


def _mend_run(run: str, enc: str, context_latin: bool) -> str | None:
    """The run with its UTF-8 sequences decoded, or None if that makes no sense."""
    t = _table(enc)
    out, pos, covered, pieces = [], 0, 0, 0
    for m in _sequence(enc).finditer(run):
        raw = bytes(t[c] for c in m.group())
        try:
            ch = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not _credible(ch) and not (0x80 <= ord(ch) < 0xA0):
            continue
        out.append(run[pos : m.start()] + ch)
        pos, covered, pieces = m.end(), covered + len(m.group()), pieces + 1
    if not pieces:
        return None
    if covered < len(run) and not (pieces >= 2 and covered >= 0.6 * len(run)):
        return None
    if context_latin and all(c in _PASSING for c in run):
        return None
    mended = "".join(out) + run[pos:]
    return mended if garbling_cost(mended) < garbling_cost(run) else None


def _single_step(text: str) -> str | None:
    best, best_cost = None, garbling_cost(text)
    latin = sum("a" <= c <= "z" or "A" <= c <= "Z" for c in text) > 0
    for enc in SINGLE:
        if not _sequence(enc).search(text):
            continue
        changed = _run(enc).sub(lambda m, e=enc: _mend_run(m.group(), e, latin) or m.group(), text)
        if changed != text and (cost := garbling_cost(changed)) < best_cost:
            best, best_cost = changed, cost
    return best


_STRETCH = re.compile("[\\x20-\\x7e\\n\\u0080-\\u00ff\\u0152\\u0153\\u0160\\u0161\\u0178\\u017d\\u017e\\u0192\\u02c6\\u02dc\\u2013\\u2014\\u2018-\\u201e\\u2020-\\u2022\\u2026\\u2030\\u2039\\u203a\\u20ac\\u2122]+")


def _bytes_of(text: str) -> bytes | None:
    t = _table("cp1252")
    out = bytearray()
    for c in text:
        o = ord(c)
        if o < 0x80:
            out.append(o)
        elif c in t:
            out.append(t[c])
        elif o < 0x100:
            out.append(o)
        else:
            return None
    return bytes(out)


def _strict(raw: bytes, enc: str) -> tuple[str, int, int] | None:
    """A strict decode, and the lone bytes before and behind it that are halves of signs cut away."""
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        if a + b and (len(raw) <= a + b or (a and raw[0] < 0x80) or (b and raw[-1] < 0x80)):
            continue
        try:
            return raw[a : len(raw) - b].decode(enc), a, b
        except UnicodeDecodeError:
            continue
    return None


def _double_step(text: str) -> str | None:
    """East Asian double-byte text seen through a Western encoding."""

    def mend(m: re.Match[str]) -> str:
        stretch = m.group()
        raw = _bytes_of(stretch)
        if raw is None:
            return stretch
        high = sum(b >= 0x80 for b in raw)
        if high < 4:
            return stretch
        paired = sum(len(r) for r in re.findall(rb"[\x80-\xff]{2,}", raw))
        best, best_share = None, 0.0
        for enc in DOUBLE:
            if enc != "shift_jis" and paired < 0.8 * high:
                continue
            whole = _strict(raw, enc)
            if not whole:
                continue
            got, before, behind = whole
            if not got or LOSS in got or any(0xE000 <= ord(c) < 0xF900 for c in got):
                continue
            wide = [c for c in got if ord(c) >= 0x1100]
            if len(wide) < 2 or len(wide) < 0.8 * sum("a" <= c <= "z" for c in got):
                continue
            kana = sum("ぁ" <= c <= "ヾ" for c in wide)
            hangul = sum("가" <= c <= "힣" for c in wide)
            han = sum("一" <= c <= "鿿" for c in wide)
            half = sum("｡" <= c <= "ﾟ" for c in got)
            n = len(wide)
            if enc == "euc_kr":
                share = hangul / n - han / n
            elif enc == "shift_jis":
                share = (kana + 0.4 * han) / n - 2 * half / n if kana >= 0.2 * n else 0.0
            elif enc == "euc_jp":
                share = (kana + 0.4 * han) / n if kana >= 0.2 * n else 0.0
            elif enc == "gb18030":
                common = 0
                for c in wide:
                    b = c.encode("gb18030")
                    common += len(b) == 2 and 0xB0 <= b[0] <= 0xD7 and b[1] >= 0xA1
                share = 0.9 * common / n
            else:
                share = 0.5 * han / n
            if share > best_share:
                best, best_share = LOSS * before + got + LOSS * behind, share
        return best if best is not None and best_share >= 0.45 else stretch

    changed = _STRETCH.sub(mend, text)
    return changed if changed != text and garbling_cost(changed) < garbling_cost(text) else None


def repair(text: str | None) -> tuple[str | None, bool]:
    """The text with every layer of wrong decoding undone where possible, and whether it was garbled."""
    if text is None or text.isascii() or not _maybe().search(text):
        return text, False
    now, garbled = text, LOSS in text
    while True:
        best = now
        while (step := _single_step(best)) is not None:
            best = step
        # a whole repair through single bytes is no chance; half a one may be double-byte text
        if garbling_cost(best) > 0.35 * garbling_cost(now):
            other = _double_step(now)
            if other is not None and garbling_cost(other) < garbling_cost(best):
                best = other
        if best == now:
            break
        now, garbled = best, True
    return now, garbled


def repair_text(df: DataFrame, column: str, *, repaired: str = "repaired", garbled: str = "garbled") -> DataFrame:
    """Adds the repaired text and a flag; rows that cannot be garbled never leave the JVM.

    Extra columns are kept; `repaired` and `garbled` replace columns of the same name.
    """

    @F.pandas_udf("struct<fixed:string,bad:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [repair(t) for t in texts]
        return pd.DataFrame({"fixed": [g[0] for g in got], "bad": [g[1] for g in got]})

    maybe = suspicious(F.col(column))
    done = df.withColumn("__mend", F.when(maybe, run(F.when(maybe, F.col(column)))))
    return done.withColumn(repaired, F.when(maybe, F.col("__mend.fixed")).otherwise(F.col(column))).withColumn(garbled, F.coalesce(F.col("__mend.bad"), F.lit(False))).drop("__mend")


def garbled_rows(df: DataFrame, column: str, *, repaired: str = "repaired") -> DataFrame:
    """Only the garbled rows, with the restored text in `repaired` (a clashing column is replaced)."""
    base = df.select(*[c for c in df.columns if c != repaired])
    schema = StructType([*base.schema.fields]).add(repaired, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            got = [repair(t) for t in texts]
            rows = [i for i, g in enumerate(got) if g[1]]
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([got[i][0] for i in rows], pa.string())], [*part.schema.names, repaired])

    return base.where(suspicious(F.col(column))).mapInArrow(run, schema)
