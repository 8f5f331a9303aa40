"""Operators on inputs that the queries with SQL leave out, against brute force."""

import random
import re

from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.operators import folds
from quirework.plans import catalog

DATA = "/root/testdata/sf0.001"


def lost_identifiers(source, translated):
    plain = re.sub(r"⟦[^⟦⟧\s]{1,12}⟧", " ", source)
    letters = [c for c in plain if c.isalpha()]
    if letters and sum(c.isupper() for c in letters) > 0.6 * len(letters):
        return []
    out = []
    for t in re.findall(r"(?<![\w⟦])[A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*(?![\w⟧])", plain):
        if re.fullmatch("[IVXLCDM]+", t) or re.fullmatch(r"(?:[A-Za-z]\.)*[A-Za-z]", t):
            continue
        if any(c.isdigit() for c in t) or any(sum(c.isupper() for c in p) >= 2 for p in re.split("[-.]", t)):
            t = t[:-1] if len(t) > 2 and t[-1] == "s" and t[-2].isupper() else t
            if t not in translated and t not in out:
                out.append(t)
    return out


def test_identifiers_of_any_source(spark):
    texts = [
        "⟦EQ1⟧ beats BERT — “GPT-4” too", "Le modèle ResNet-50 était évalué, où XLNet échoue", "Das Übermaß von U.S. und e.g. CamelCase", "これはBERTと GPT-3 の比較", "naïveBERT and BERTé, _LLM x_RNN 3DCNN a--B2 A-.B3",
        "ÄÖÜ ÉCOLE BERT", "ЭТО ЗАГОЛОВОК BERT и", "модель BERT лучше чем LLMs", "MIX IV vs. T5", "", "⟦M0⟧⟦BERT⟧", "p. 5 of v2.0, T5-Base.", "हिन्दी BERT मॉडल", "ภาษา GPT2 ไทย", " ".join(f"N{i}" for i in range(1200)) + " and so on in lower case " * 60,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.missing_identifiers(F.col("t"), F.lit("LLM und"), 2**31 - 1).alias("v"))
    for r in df.collect():
        assert r["v"] == lost_identifiers(r["t"], "LLM und"), r["t"]


def test_identifiers_of_all_translated_segments(spark):
    s = spark.read.parquet(f"{DATA}/segments.parquet").where("translated IS NOT NULL").distinct().collect()
    want = sorted((r["doc_id"], r["seg_id"], " ".join(sorted(lost_identifiers(r["source"], r["translated"])))) for r in s)
    assert sorted(map(tuple, catalog.QUERIES["all_missing_identifiers"](spark, DATA).collect())) == want


def without_label(text, source):
    lines = text.splitlines()
    if len(lines) < 2:
        return text
    first, echoes = lines[0].strip(), X.ECHO_MARKERS
    opens = re.split(r"(?<=[.!?])\s+(?=[A-Z⟦(\[])", source.lstrip().split("\n", 1)[0], maxsplit=1)[0]
    if not first.endswith((":", "：")) or len(first) > 20 or re.search(r"⟦M\d+⟧", first) or any(m in first for m in echoes) or ":" in opens or "：" in opens:
        return text
    return "\n".join(lines[1:]).strip() or text


def test_labels_of_any_text(spark):
    texts = ["초록:\n본문\n둘째 줄", "\u3000요약：\u00a0\n 본문 \n", "번역문만 출력:\n본문", "[번역 예시:\nx", "⟦M0⟧:\nx", "요약:\r\n본문\r\n끝", "요약:\u2028본문", "요약:\n \u3000\n", "요약:", "x\n요약:\ny", "아주 긴 줄이라 스무 글자를 넘는 표지입니다:\nx", "요약:\n\n본문\u3000", ""]
    sources = ["Größe — über alles. Next: x", "Überblick: text", "\u3000\nTitle: x", "Ein Satz.\u00a0Zweiter: y", "これは文です。", "⟦EQ1⟧ first. lower: case", "", "Line\nLabel: x", "Note：x"]
    df = spark.createDataFrame([(t, s) for t in texts for s in sources], "t string, s string").select("t", "s", X.strip_leading_label(F.col("t"), F.col("s")).alias("v"))
    for r in df.collect():
        assert r["v"] == without_label(r["t"], r["s"]), (r["t"], r["s"])


def test_labels_of_all_translated_segments(spark):
    s = spark.read.parquet(f"{DATA}/segments.parquet").where("translated IS NOT NULL").distinct().collect()
    want = sorted((r["doc_id"], r["seg_id"], without_label("요약:\n" + r["translated"], r["source"]), without_label(r["translated"], r["source"])) for r in s)
    assert sorted(map(tuple, catalog.QUERIES["all_leading_labels"](spark, DATA).collect())) == want


def rough(text):
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z⟦(\[])", text)) if s]


def test_rough_sentences_of_any_text(spark):
    texts = ["A. B. Smith and C. Doe. J. Res. 12. Next", "See p. 3. (A. Note.) [B. c] ⟦EQ1⟧. ⟦EQ2⟧.", "One.\u00a0Two!\u3000Three? four.\n\nFive", "\u3000. A. ", "Ende. Überall. Ja. Ok", "", " ", "これ。A. B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.rough_sentences(F.col("t")).alias("v"))
    for r in df.collect():
        assert r["v"] == rough(r["t"]), r["t"]


def test_rough_sentences_of_all_documents(spark):
    s = spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").collect()
    assert sorted(map(tuple, catalog.QUERIES["all_rough_sentence_counts"](spark, DATA).collect())) == sorted((r["doc_id"], len(rough(r["text"]))) for r in s)


def test_roman_captions_have_keys(spark, tmp_path):
    rows = [("d", 0, "p0_s0", "caption", "Table IV shows", None, "done", "[0,0,1,1]"), ("d", 1, "p1_s0", "caption", "TABLE IV. Data", None, "done", "[0,0,1,1]"), ("d", 1, "p1_s1", "caption", "Fig. 12: x", None, "done", "[0,0,1,1]")]
    spark.createDataFrame(rows, "doc_id string, page int, seg_id string, kind string, source string, translated string, status string, bbox string").write.parquet(f"{tmp_path}/segments.parquet")
    assert {(r["seg_id"], r["key"]) for r in catalog.QUERIES["caption_keys"](spark, str(tmp_path)).collect()} == {("p0_s0", "table-4"), ("p1_s0", "table-4"), ("p1_s1", "figure-12")}
    assert {tuple(r) for r in catalog.QUERIES["chosen_captions"](spark, str(tmp_path)).collect()} == {("d", "table-4", "p1_s0", True), ("d", "figure-12", "p1_s1", True)}


def test_terms_are_found_alike_whatever_the_glossary_size(spark):
    texts = ["Subgraphs and GRAPHS", "hypergraph", "misstep sizes", "ΣΤΟΧΟΣ λόγος", "그래프이론", "", None, "a–b graph", "ΑΣ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    listed = [("graph", "a"), ("Step Size", "b"), ("step size", "b2"), ("στόχος", "c"), ("이론", "d"), ("–", "e"), ("b", None), ("graphs and graphs", "f"), ("none", "g"), ("Λόγος", "h"), ("ΑΣ", "i")]
    terms = spark.createDataFrame(listed, "term string, rendering string")
    want = sorted(((i, t, r) for i, x in enumerate(texts) if x is not None for t, r in listed if t.lower() in x.lower()), key=repr)
    for sizes in ({}, {"limit": 1}, {"limit": 1, "block": 3}):
        assert sorted(map(tuple, X.with_terms(docs, "text", terms, ["id"], **sizes).collect()), key=repr) == want, sizes


def test_terms_of_all_documents(spark):
    g = spark.read.parquet(f"{DATA}/glossary.parquet").collect()
    last = {r["term"].strip(): f"later {r['rendering']}".strip() if r["term_id"] < 3 else r["rendering"].strip() for r in g}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").collect()
    want = sorted((r["doc_id"], t, v) for r in docs for t, v in last.items() if t.lower() in r["text"].lower())
    assert len({r["doc_kind"] for r in docs}) > 1 and sorted(map(tuple, catalog.QUERIES["all_glossary_terms"](spark, DATA).collect())) == want


def glossary_sample(segs):
    parts = [s for k, _, s in segs if k == "heading"]
    size = 0
    for k, page, s in segs:
        if k == "body" and page == 0 and size < 2000:
            parts.append(s[: 2000 - size])
            size += len(parts[-1])
    after = False
    for k, page, s in segs:
        if k == "heading":
            after = True
        elif k == "body" and after:
            if page > 0:
                parts.append(s[:400])
            after = False
    return "\n".join(parts + [s[:200] for k, _, s in segs if k == "caption"])[:6000]


def test_glossary_samples_hold_all_parts(spark, tmp_path):
    rng = random.Random(5)
    docs = {"empty": [("formula", 0, "x")], "late": [("heading", 3, "H"), ("caption", 3, "Figure 1. " + "c" * 300), ("body", 4, "b" * 500), ("body", 4, "no")]}
    for n in range(12):
        kinds = rng.choices(["heading", "body", "caption", "formula", "header_footer"], k=rng.choice([3, 20, 60]))
        docs[f"d{n}"] = [(k, page, f"{k}{i} " * rng.choice([0, 1, 9, 120])) for i, (k, page) in enumerate(zip(kinds, sorted(rng.choices([0, 0, 1, 2, 300], k=len(kinds))), strict=True))]
    docs["many"] = [("heading", i // 100, "") for i in range(7000)] + [("caption", 80, "gone")]
    rows = [(d, page, f"p{page}_s{i}", k, s, None, "done", "[0,0,1,1]") for d, x in docs.items() for i, (k, page, s) in enumerate(x)]
    spark.createDataFrame(rows, "doc_id string, page int, seg_id string, kind string, source string, translated string, status string, bbox string").write.parquet(f"{tmp_path}/segments.parquet")
    got = {r["doc_id"]: r["sample"] for r in catalog.QUERIES["glossary_samples"](spark, str(tmp_path)).collect()}
    assert got == {d: glossary_sample(x) for d, x in docs.items()}


def test_text_table_above_its_caption(spark):
    box = "doc_id string, page int, {} string, x0 double, y0 double, x1 double, y1 double"
    lines = [("d", 0, f"1.{i} 2.{i}", 100.0, 100.0 + 12 * i, 300.0, 110.0 + 12 * i) for i in range(4)] + [("d", 0, "far", 100.0, 20.0, 300.0, 30.0), ("d", 1, "1 2", 100.0, 60.0, 300.0, 70.0), ("d", 1, "3 4", 100.0, 100.0, 300.0, 110.0)]
    caps = [("d", 0, "table-1", 100.0, 152.0, 300.0, 162.0), ("d", 1, "table-2", 100.0, 80.0, 300.0, 90.0)]
    cells = F.array(*[F.struct(F.lit(100.0 + 60 * k).alias("x0"), F.lit(f"{k}.5").alias("text")) for k in range(3)])
    shaped = spark.createDataFrame(lines, box.format("text")).withColumn("heading", F.lit(False)).withColumn("cells", cells)
    got = folds.table_regions(spark.createDataFrame(caps, box.format("key")), shaped).collect()
    # the second caption has one line on either side: no table
    assert [tuple(r)[2:] for r in got] == [("table-1", "above", 4, 100.0, 100.0, 300.0, 146.0)]
