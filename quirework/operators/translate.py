"""Translation as a pluggable step: protocol, stub, guarded attempts, backends by name."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import blocks

# Our own filler sentences of the stub.
FILLER = ("시험용 문장을 넣는다.", "이 줄은 길이를 맞춘다.", "내용은 뜻을 갖지 않는다.")


class Translator(Protocol):
    """A backend. It may take further arguments: previous_translation and glossary are passed if it names them."""

    def translate(self, text: str, context: str | None = None, continuation: bool = False) -> str: ...


def stub(masked: Column, share: float = 0.85) -> Column:
    """A stand-in translation: one filler sentence, all tokens once in order, then filler up to `share` of the length."""
    tokens = X.all_of(masked, X.ANY_TOKEN)
    head = F.concat_ws(" ", F.lit(FILLER[0]), F.array_join(tokens, " "))
    unit = " ".join(FILLER[1:])
    missing = F.greatest(F.ceil((F.length(masked) * share - F.length(head)) / (len(unit) + 1)), F.lit(0)).cast("int")
    return F.trim(F.concat(head, F.repeat(F.lit(" " + unit), missing)))


def translate_stub(segments: DataFrame) -> DataFrame:
    """Masks, stands in and unmasks every segment: doc_id, seg_id, translated, n_errors (token guard, always 0)."""
    m = segments.select("doc_id", "seg_id", X.mask(F.col("source")).alias("m"))
    t = m.withColumn("t", stub(F.col("m.masked")))
    return t.select("doc_id", "seg_id", X.unmask(F.col("t"), F.col("m.originals")).alias("translated"), F.size(X.placeholder_errors(F.col("m.masked"), F.col("t"))).alias("n_errors"))


def guard(source: Column, text: Column, markers: list[str]) -> Column:
    """The hard guards: tokens, echoes and foreign signs."""
    return F.struct(
        X.placeholder_errors(source, text).alias("tokens"), X.echo_markers(text, markers).alias("echoes"), X.foreign_signs(source, text).alias("signs"), X.missing_identifiers(source, text).alias("identifiers"),
    )


CONTEXT = 400  # signs of the text before that go along
TASK_PAGES = 16  # pages of a document that one task translates one after the other
ECHO_LEFT = 0.3  # share of the source that must be left of an answer without its echoed lines

Check = Callable[[str, str], list[str]]
Rescue = Callable[[str, str], str | None]


def without_echo(markers: tuple[str, ...] = X.ECHO_MARKERS) -> Rescue:
    """The answer without lines that repeat the prompt, if enough is left of it."""

    def rescue(source: str, answer: str) -> str | None:
        if not any(m in answer for m in markers):
            return None
        left = "\n".join(line for line in answer.split("\n") if not any(m in line for m in markers)).strip()
        return left if len(left) >= ECHO_LEFT * len(source) else None

    return rescue


def attempt(translator: Translator, check: Check, text: str, tries: int = 3, rescue: Rescue | None = None, context: str | None = None, **kw) -> str | None:
    """The first answer that passes `check`, else the last one rescued from its echo, else None.

    The checks' messages go along with the context of the next try.
    """
    note, got = context, ""
    for _ in range(tries):
        got = translator.translate(text, context=note, **kw)
        wrong = check(text, got)
        if not wrong:
            return got
        note = "; ".join([context, *wrong] if context else wrong)
    saved = rescue(text, got) if rescue else None
    return saved if saved and not check(text, saved) else None


def guarded(translator: Translator, check: Check, split: Callable[[str], list[str]], text: str, rescue: Rescue | None = None, mask: str = X.MASK_TOKEN, **kw) -> tuple[str, str]:
    """(translation, status): the whole text, else its sentences one by one, else the source with status fallback.

    A sentence without tokens gets one last plain call, whose answer is taken if it says anything; a sentence that
    fails stays in its own language.
    """
    got = attempt(translator, check, text, rescue=rescue, **kw)
    if got is not None:
        return got, "done"
    parts = split(text)
    if len(parts) < 2:
        return text, "fallback"
    done: list[str | None] = []
    for p in parts:
        answer = attempt(translator, check, p, rescue=rescue)
        if answer is None and not re.search(mask, p):
            plain = translator.translate(p)
            answer = plain if plain and plain.strip() and not check(p, plain) else None
        done.append(answer)
    if all(d is None for d in done):
        return text, "fallback"
    return " ".join(d if d is not None else p for d, p in zip(done, parts, strict=True)), "done"


def translate_documents(segments: DataFrame, make: Callable[[], Translator], check: Check, split: Callable[[str], list[str]], *, rescue: Rescue | None = None, glossaries: DataFrame | None = None) -> DataFrame:
    """Runs a backend over the segments (doc_id, page, idx, seg_id, source) of each document in order.

    Every segment goes with the end of the text before it, whether it goes on inside a sentence, and the translation
    before it, unless that fell back. A task takes TASK_PAGES pages of a document, so that no document is one task;
    the text before is known across tasks, the translation before is not. `glossaries` (doc_id, glossary: map) is
    joined once for each document. Gives doc_id, seg_id, translated, status.
    """
    block = F.floor(F.col("page") / TASK_PAGES)
    s = blocks.lag(segments.select("doc_id", "page", "idx", "seg_id", F.coalesce("source", F.lit("")).alias("source")), ["doc_id"], block, ["page", "idx"], "source", "before")
    s = s.select("doc_id", "page", "idx", "seg_id", "source", F.expr(f"right(before, {CONTEXT})").alias("context"), X.is_continuation(F.col("source")).alias("goes_on"), block.alias("block"))
    if glossaries is not None:
        s = s.join(glossaries.select("doc_id", F.to_json("glossary").alias("glossary")), "doc_id", "left")
    s = s.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "page", "idx")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        takes = inspect.signature(engine.translate).parameters
        last: tuple = ()
        previous: str | None = None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                previous = previous if (r.doc_id, r.block) == last else None
                last = (r.doc_id, r.block)
                more = {"previous_translation": previous} if "previous_translation" in takes else {}
                if "glossary" in takes and getattr(r, "glossary", None):
                    more["glossary"] = json.loads(r.glossary)
                got, status = guarded(engine, check, split, r.source, rescue, context=r.context or None, continuation=bool(r.goes_on), **more)
                previous = got if status == "done" else None
                out.append((r.doc_id, r.seg_id, got, status))
            yield pd.DataFrame(out, columns=["doc_id", "seg_id", "translated", "status"])

    return s.mapInPandas(run, "doc_id string, seg_id string, translated string, status string")


def document_glossaries(samples: DataFrame, make: Callable[[], Callable[[str], str]], seed: dict[str, str]) -> DataFrame:
    """One glossary for each document (doc_id, sample): doc_id, glossary.

    A blank sample has none. The backend's answer is lines `term = rendering`, of which those hold whose term occurs in
    the sample, 40 at most; where the call fails, the seed's terms alone are left.
    """

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        call = make()

        def one(t: str) -> str:
            try:
                return call(t)
            except Exception:
                return ""

        return texts.map(lambda t: one(t) if t and t.strip() else "")

    s = samples.select("doc_id", F.coalesce("sample", F.lit("")).alias("sample")).withColumn("answer", ask("sample"))
    pairs = F.transform(F.split("answer", "\n"), lambda x: F.struct(F.trim(F.regexp_replace(F.element_at(F.split(x, "=", 2), 1), "^\\s*[-*•]\\s*", "")).alias("key"), F.trim(F.coalesce(F.try_element_at(F.split(x, "=", 2), F.lit(2)), F.lit(""))).alias("value")))
    kept = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "") & F.contains(F.lower("sample"), F.lower(p["key"])))
    first = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, 1, i), lambda q: q["key"] == p["key"]))
    parsed = F.map_from_entries(F.slice(first, 1, 40))
    return s.select("doc_id", F.when(F.trim("sample") == "", F.map_from_entries(F.slice(first, 1, 0))).otherwise(merge_glossary(parsed, seed, F.col("sample"))).alias("glossary"))


_BACKENDS: dict[str, Callable[..., Translator]] = {}


def register_backend(name: str, make: Callable[..., Translator]) -> None:
    _BACKENDS[name] = make


def backend(name: str, **kw) -> Translator:
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend: {name}")
    return _BACKENDS[name](**kw)


def merge_glossary(parsed: Column, seed: dict[str, str], sample: Column) -> Column:
    """The parsed terms with the seed's, which win whatever their case, if they occur in the sample."""
    if not seed:
        return parsed
    entries = [F.when(F.contains(F.lower(sample), F.lit(k.lower())), F.struct(F.lit(k[:1].upper() + k[1:]).alias("key"), F.lit(v).alias("value"))) for k, v in seed.items()]
    own = F.filter(F.map_entries(parsed), lambda e: ~F.lower(e["key"]).isin(*[k.lower() for k in seed]))
    return F.map_from_entries(F.concat(own, F.filter(F.array(*entries), lambda e: e.isNotNull())))
