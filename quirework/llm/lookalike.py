"""Text that looks the same but is made of different characters.

Method: the vocabulary is a trie over look classes; a weighted edit automaton walks it, with cost zero for
look-alikes and ignorable characters and one for every other edit. A text that reaches the end of an entry within the
budget takes that entry's spelling; all others are normalised character by character from the same table. Both queries
walk the same automaton with budget 0, so what is found to look like an entry is also given its spelling.

The look of a text does not change with width, joined or separate accents and letters, invisible characters,
kinds of blank and hyphen, blanks at the ends, and look-alike letters of other scripts. Case, visible accents, raised
or lowered digits and further visible signs do change it.

Defined results: null stays null and matches nothing; a text of invisible characters only has the empty look.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import ClassVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters and signs of other scripts, and the letter each looks like.
_LOOKS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ь": "b",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ѵ": "v", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϳ": "j", "Ϳ": "J", "ϲ": "c", "Ϲ": "C",
    # Armenian, Cherokee, Lisu
    "օ": "o", "ѡ": "w", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓟ": "M", "ꓠ": "N", "ꓢ": "S",
    # Kana that look like Han characters or like each other
    "カ": "力", "エ": "工", "タ": "夕", "ニ": "二", "ハ": "八", "ロ": "口", "ト": "卜", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "リ": "り", "ー": "一", "チ": "千",
    # Hyphens
    "‐": "-", "‑": "-", "﹣": "-", "－": "-", "­": "",
    # Apostrophe-like
    "＇": "'",
}
_WIDTH = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<square>"}
# Compatibility signs that are visibly different from their parts.
_KEEP = frozenset("…‥‼⁇⁈⁉™℠½¼¾⅓⅔№℃℉")


def _is_ignorable(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or o == 0x34F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5)


def look(c: str) -> str:
    """The look class of one character: empty if invisible, else one or several class characters."""
    if c.isascii():
        return " " if c in "\t\n\r\x0b\x0c" else c
    if _is_ignorable(c):
        return ""
    if unicodedata.category(c) in ("Zs", "Zl", "Zp"):
        return " "
    if c in _LOOKS:
        return _LOOKS[c]
    if c in _KEEP:
        return c
    parts = unicodedata.decomposition(c).split()
    if not parts:
        return c
    if parts[0].startswith("<"):
        if parts[0] not in _WIDTH:
            return c
        parts = parts[1:]
        if parts and parts[0] == "0020" and len(parts) > 1:
            return c
    joined = unicodedata.normalize("NFD", "".join(chr(int(p, 16)) for p in parts))
    return "".join(_LOOKS.get(p) if p in _LOOKS else (look(p) if p != c else p) for p in joined)


class Looks:
    """Memo of look classes."""

    def __init__(self) -> None:
        self.memo: dict[str, str] = {}

    def __getitem__(self, c: str) -> str:
        got = self.memo.get(c)
        if got is None:
            # precomposed Hangul and accented letters fall apart into their joined signs
            whole = unicodedata.normalize("NFD", c)
            got = "".join(look(p) for p in whole) if len(whole) > 1 else look(c)
            self.memo[c] = got
        return got

    def steps(self, text: str) -> Iterator[str]:
        """The look classes of a text one by one; stacked accents in canonical order, ignorable characters left out."""
        marks: list[str] = []
        for c in text:
            for k in self[c]:
                if k >= "\u0300" and unicodedata.combining(k):
                    marks.append(k)
                    continue
                if marks:
                    yield from sorted(marks, key=unicodedata.combining)
                    marks = []
                yield k
        yield from sorted(marks, key=unicodedata.combining)

    def of(self, text: str) -> str:
        return "".join(self.steps(text))


Node = dict  # look class -> node; "" -> entries that end here


class LookTrie:
    """A trie of look classes over a vocabulary, walked by the weighted edit automaton."""

    def __init__(self, entries: Iterable[tuple[int, str]]) -> None:
        self.looks = Looks()
        self.root: Node = {}
        for key, text in entries:
            if text is None:
                continue
            node = self.root
            for c in self.looks.of(text).strip(" "):
                node = node.setdefault(c, {})
            if node is not self.root:
                node.setdefault("", []).append((key, text))

    def walk(self, text: str, budget: int = 0) -> list[tuple[int, str, int]]:
        """Entries that `text` reaches within the budget, with their costs.

        The automaton's states are nodes with the least cost to get there. A look-alike and an ignorable sign cost
        nothing, nor do blanks at the ends; another sign in place of an entry's, one too many or one too few costs 1.
        """
        states = self._closed({id(self.root): (self.root, 0)}, budget)
        ended: dict[int, tuple[Node, int]] = {}  # states before the blanks at the end
        begun = False
        for k in self.looks.steps(text):
            if k == " ":
                if not begun:
                    continue
                for at, (node, cost) in states.items():
                    if "" in node and (at not in ended or ended[at][1] > cost):
                        ended[at] = (node, cost)
            else:
                begun, ended = True, {}
            reached: dict[int, tuple[Node, int]] = {}
            for node, cost in states.values():
                nxt = node.get(k)
                if nxt is not None:
                    _put(reached, nxt, cost)
                if cost < budget:
                    _put(reached, node, cost + 1)
                    for other, nxt in node.items():
                        if other and other != k:
                            _put(reached, nxt, cost + 1)
            states = self._closed(reached, budget)
            if not states and not ended:
                return []
        if not begun:
            return []
        best: dict[int, tuple[int, str]] = {}
        for node, cost in [*states.values(), *ended.values()]:
            for key, entry in node.get("", ()):
                best[key] = min((cost, entry), best.get(key, (cost, entry)))
        return sorted((key, entry, cost) for key, (cost, entry) in best.items())

    @staticmethod
    def _closed(states: dict[int, tuple[Node, int]], budget: int) -> dict[int, tuple[Node, int]]:
        """The states with those added that leave signs of entries out."""
        todo = [s for s in states.values() if s[1] < budget]
        while todo:
            node, cost = todo.pop()
            for k, nxt in node.items():
                if k and _put(states, nxt, cost + 1) and cost + 1 < budget:
                    todo.append((nxt, cost + 1))
        return states


def _put(states: dict[int, tuple[Node, int]], node: Node, cost: int) -> bool:
    if id(node) in states and states[id(node)][1] <= cost:
        return False
    states[id(node)] = (node, cost)
    return True


_ALL = Looks()
_BLANKS = str.maketrans("\t\n\r\x0b\x0c", " " * 5)
_CYRILLIC = {v: k for k, v in _LOOKS.items() if "\u0400" <= k <= "\u045f" and len(v) == 1}
_GREEK = {v: k for k, v in _LOOKS.items() if "\u0391" <= k <= "\u03c9" and len(v) == 1}
_OTHER_SCRIPT = re.compile("[\u0370-\u052f]")
_WORD = re.compile("[A-Za-z\u0300-\u036f\u0370-\u052f]+")


def _spelled(m: re.Match[str]) -> str:
    """A word with letters only Greek or Cyrillic has is spelled in that script, if all its letters exist there."""
    word = m.group()
    other = _OTHER_SCRIPT.search(word)
    if not other:
        return word
    table = _GREEK if other.group() < "\u0400" else _CYRILLIC
    if any(c.isascii() and c not in table for c in word):
        return word
    return "".join(table.get(c, c) for c in word)


# Han or hiragana sign -> the katakana that looks like it; such a sign is spelled by its neighbours
_KANA_OF = {v: k for k, v in _LOOKS.items() if "\u30a0" <= k <= "\u30ff" and k not in "ベペ"}
_VOICED = re.compile(".[\u3099\u309a]*")
_EAST_RUN = re.compile("[\u3040-\u309f\u30a0-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]+")


def _kana(m: re.Match[str]) -> str:
    """A run of kana and Han signs in which each sign of two readings is spelled as its nearest sure neighbour.

    Katakana beside katakana, else the Han or hiragana sign; of two neighbours equally near the right one decides if
    both are next to the sign, else the left one. A voicing mark makes a sign sure. The result depends on the look of the run only.
    """
    signs = _VOICED.findall(m.group())  # each with its voicing marks
    n = len(signs)
    sure = [None if c[0] in _KANA_OF and (len(c) == 1 or c[0] in "へり") else c[0] in _KANA_OF or "\u30a1" <= c[0] <= "\u30fa" for c in signs]
    left: list[tuple[int, bool | None]] = []
    seen: tuple[int, bool | None] = (n + 1, None)
    for s in sure:
        seen = (0, s) if s is not None else (seen[0] + 1, seen[1])
        left.append(seen)
    out, seen = [], (n + 1, None)
    for i in range(n - 1, -1, -1):
        seen = (0, sure[i]) if sure[i] is not None else (seen[0] + 1, seen[1])
        katakana = seen[1] if seen[0] < left[i][0] or seen[0] == left[i][0] == 1 else left[i][1]
        out.append(_KANA_OF[signs[i][0]] + signs[i][1:] if katakana and signs[i][0] in _KANA_OF else signs[i])
    return "".join(reversed(out))


def unify(text: str | None) -> str | None:
    """One spelling for every text of the same look, from the table alone; blanks are spaces, none at the ends."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(_BLANKS).strip(" ")
    looked = _ALL.of(text).strip(" ")
    if _OTHER_SCRIPT.search(looked):
        looked = _WORD.sub(_spelled, looked)
    return unicodedata.normalize("NFC", _EAST_RUN.sub(_kana, looked))


def look_of(text: str | None) -> str | None:
    """The look of a whole text as the trie has it; null if there is nothing to see."""
    return _ALL.of(text).strip(" ") or None if text is not None else None


def _entries(vocabulary: DataFrame, key: str, text: str, limit: int) -> list[tuple[int, str]] | None:
    """The vocabulary's entries, or None if there are more than `limit`."""
    rows = vocabulary.select(key, text).where(F.col(text).isNotNull()).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else sorted((r[0], r[1]) for r in rows)


def matches(df: DataFrame, column: str, vocabulary: DataFrame, *, key: str = "ref_id", entry: str = "text", budget: int = 0, limit: int = 200_000) -> DataFrame:
    """Rows of `df` whose whole text looks like a vocabulary entry without being that string.

    Adds `key` and `canonical`; clashing columns of `df` are replaced. A vocabulary of at most `limit` entries
    (checked) is broadcast and built into a trie once in each worker. A larger one, which no worker can hold, is
    joined on the look, which gives the same rows; edits beyond the look (`budget` above 0) need the trie.
    """
    entries = _entries(vocabulary, key, entry, limit)
    if entries is None:
        if budget:
            raise ValueError(f"a budget of edits needs a vocabulary of at most {limit} entries")
        return join_looks(df, column, vocabulary, key=key, entry=entry)
    shared = SharedTrie(df.sparkSession, entries)
    keep = [c for c in df.columns if c not in (key, "canonical")]
    base = df.select(*keep)
    key_type = vocabulary.schema[key].dataType
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*base.schema.fields]).add(key, key_type).add("canonical", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.get()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            take, keys, canon = [], [], []
            for i, t in enumerate(texts):
                if t is None:
                    continue
                for k, e, _ in trie.walk(t, budget):
                    if e != t:
                        take.append(i)
                        keys.append(k)
                        canon.append(e)
            if take:
                part = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, _arrow_int(key_type)), pa.array(canon, pa.string())], [*part.schema.names, key, "canonical"])

    seen = [(e, look_of(e) or "") for _, e in entries]
    if budget or any(k.isascii() and e != k for e, k in seen):
        # a text of ASCII alone may differ from an entry of its look
        return base.where(F.col(column).isNotNull()).mapInArrow(run, schema)
    # blanks apart, nothing made of ASCII alone can look like a different string: those rows stay in the JVM
    return base.where(F.col(column).rlike("[^\\x21-\\x7e ]|^ | $")).mapInArrow(run, schema)


def join_looks(df: DataFrame, column: str, vocabulary: DataFrame, *, key: str = "ref_id", entry: str = "text") -> DataFrame:
    """The same matches for a vocabulary of any size, as an equi-join on the look."""

    @F.pandas_udf("string")
    def seen(texts: pd.Series) -> pd.Series:
        return texts.map(look_of)

    base = df.drop(key, "canonical")
    left = base.withColumn("__look", seen(F.col(column)))
    right = vocabulary.select(F.col(key), F.col(entry).alias("canonical")).distinct().withColumn("__look", seen(F.col("canonical")))
    return left.join(right, "__look").where(F.col(column) != F.col("canonical")).select(*base.columns, key, "canonical")


def _arrow_int(t) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


class SharedTrie:
    """The entries on their way to the workers; each worker builds one trie from them."""

    built: ClassVar[dict[int, LookTrie]] = {}

    def __init__(self, spark: SparkSession, entries: list[tuple[int, str]]) -> None:
        self.entries = spark.sparkContext.broadcast(entries)
        self.name = hash(tuple(entries))

    def get(self) -> LookTrie:
        trie = self.built.get(self.name)
        if trie is None:
            self.built.clear()
            trie = self.built[self.name] = LookTrie(self.entries.value)
        return trie


def unify_column(df: DataFrame, column: str, to: str = "unified", vocabulary: DataFrame | None = None, *, key: str = "ref_id", entry: str = "text", limit: int = 200_000) -> DataFrame:
    """Adds the one form of each text's look: the spelling of the vocabulary's entry it looks like (of several the
    one of the least key), else the form by table.

    A vocabulary above `limit` entries is joined on the look, with the same result. Without a vocabulary ASCII texts
    stay in the JVM.
    """
    entries = None if vocabulary is None else _entries(vocabulary, key, entry, limit)
    if vocabulary is not None and entries is None:

        @F.pandas_udf("string")
        def seen(texts: pd.Series) -> pd.Series:
            return texts.map(look_of)

        best = vocabulary.select(F.col(key).alias("__k"), F.col(entry).alias("__e")).where(F.col("__e").isNotNull())
        best = best.withColumn("__look", seen(F.col("__e"))).where(F.col("__look").isNotNull()).groupBy("__look").agg(F.min(F.struct("__k", "__e")).alias("__best"))
        table = unify_column(df, column, to).withColumn("__look", seen(F.col(column)))
        return table.join(best, "__look", "left").withColumn(to, F.coalesce("__best.__e", to)).drop("__look", "__best")
    shared = None if entries is None else SharedTrie(df.sparkSession, entries)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        trie = shared.get() if shared else None

        def one(text: str | None) -> str | None:
            hits = trie.walk(text) if trie and text is not None else ()
            return min(hits)[1] if hits else unify(text)

        return texts.map(one)

    if shared:
        return df.withColumn(to, run(F.col(column)))
    odd = F.col(column).rlike("[^\\x00-\\x7f]")
    plain = F.trim(F.translate(F.col(column), "\t\n\r\x0b\x0c", " " * 5))
    return df.withColumn(to, F.when(odd, run(F.when(odd, F.col(column)))).otherwise(plain))
