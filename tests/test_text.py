from pyspark.sql import functions as F

from quirework.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


def test_mask_numbers_tokens_from_zero(spark):
    m = one(spark, X.mask(F.col("t")), t="see ⟦EQ4⟧ in [12], [3, 7] at https://a.example/x and me@b.example")
    assert m["masked"] == "see ⟦M0⟧ in ⟦M1⟧, ⟦M2⟧ at ⟦M3⟧ and ⟦M4⟧"
    assert m["originals"][0] == "⟦EQ4⟧"
    assert one(spark, X.mask(F.col("t")), t="plain")["originals"] == []
    assert one(spark, X.mask(F.col("t")), t=None)["masked"] is None


def test_unmask_gives_text_back(spark):
    texts = ["", "x", "[1][2] ⟦EQ0⟧⟦EQ0⟧", "10.1000/ab c", "arXiv:1234.56789v2!", "[1–3] " * 12]

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.mask(F.col("t")).alias("m"))
    rows = df.select("t", X.unmask(F.col("m.masked"), F.col("m.originals")).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in rows)


def test_list_markers(spark):
    cases = {"• x": ("• ", "x"), "1) x": ("1) ", "x"), "(3) x": ("(3) ", "x"), "a. x": ("a. ", "x"), "⟦EQ7⟧ x": ("⟦EQ7⟧ ", "x"), "(2026) x": ("", "(2026) x"), "123) x": ("", "123) x"), "no. 3": ("", "no. 3")}
    for t, want in cases.items():
        got = one(spark, X.list_marker(F.col("t")), t=t)
        assert (got["marker"], got["rest"]) == want


def test_roman_numbers_and_caption_keys(spark):
    for t, n in {"IV": 4, "IX": 9, "XLII": 42, "MCMXC": 1990}.items():
        assert one(spark, X.roman_value(F.col("t")), t=t) == n
    for t, k in {"TABLE IV. x": "table-4", "Fig. 12: y": "figure-12", "Figure 3": "figure-3", "Figures": None}.items():
        assert one(spark, X.caption_key(F.col("t")), t=t) == k


def test_hyphen_join(spark):
    df = spark.createDataFrame([(["multi-", "line", " text ", "", "end"],)], "a array<string>")
    assert df.select(X.hyphen_join(F.col("a")).alias("v")).first()["v"] == "multiline text end"


def test_think_blocks_differ_in_stream(spark):
    t = "a<think>b</think>c<think>d"
    assert one(spark, X.strip_think(F.col("t")), t=t) == "ac<think>d"
    assert one(spark, X.filter_think_stream(F.col("t")), t=t) == "ac"


def test_identifiers(spark):
    got = one(spark, X.missing_identifiers(F.col("s"), F.col("t")), s="BERT and ResNet-50 on COCO, U.S. part IV, e.g. Multi-Task", t="nothing")
    assert got == ["BERT", "ResNet-50", "COCO"]
    assert one(spark, X.missing_identifiers(F.col("s"), F.col("t")), s="LLMs", t="LLM") == []
    assert one(spark, X.missing_identifiers(F.col("s"), F.col("t")), s="ALL CAPS HEADING", t="") == []


def test_placeholders(spark):
    assert one(spark, X.placeholder_errors(F.col("s"), F.col("t")), s="⟦M0⟧", t="⟦M0⟧ ⟦EQ3⟧") == ["⟦EQ3⟧"]
    assert one(spark, X.placeholder_errors(F.col("s"), F.col("t")), s="⟦M0⟧ ⟦M1⟧", t="⟦M1⟧⟦M1⟧") == ["⟦M0⟧", "⟦M1⟧"]


def test_continuation(spark):
    cases = {"lower": True, "0.949) that did": True, "≈ −0.05. The": True, "2026 marks the": False, "": False, "⟦EQ1⟧": False, "⟦EQ1⟧ then": True, "Upper": False}
    for t, want in cases.items():
        assert one(spark, X.is_continuation(F.col("t")), t=t) is want


def test_safe_member_and_versions(spark):
    assert one(spark, X.safe_member(F.col("t")), t="../../C:/evil<>?.pdf") == "evil___.pdf"
    assert one(spark, X.safe_member(F.col("t")), t="") == "document.pdf"
    assert one(spark, X.version_parts(F.col("t")), t="v1.2.10") == [1, 2, 10]
    assert one(spark, X.natural_key(F.col("t")), t="a2.pdf") < one(spark, X.natural_key(F.col("t")), t="a10.pdf")


def test_leading_label(spark):
    assert one(spark, X.strip_leading_label(F.col("t"), F.col("s")), t="Note:\nbody", s="Plain text.") == "body"
    assert one(spark, X.strip_leading_label(F.col("t"), F.col("s")), t="Note:\nbody", s="Abstract: text.") == "Note:\nbody"


def test_terms_by_list_and_by_join(spark):
    docs = spark.createDataFrame([(1, "The Error Bound and step size."), (2, None), (3, "")], "id int, text string")
    terms = spark.createDataFrame([("error bound", "a"), ("step size", "b"), ("graph", "c")], "term string, rendering string")
    want = [(1, "error bound", "a"), (1, "step size", "b")]
    assert sorted(map(tuple, X.with_terms(docs, "text", terms, ["id"]).collect())) == want
    assert sorted(map(tuple, X.with_terms(docs, "text", terms, ["id"], limit=1).collect())) == want
    assert X.with_terms(docs, "text", terms.limit(0), ["id"]).count() == 0
