import random

from quirework.operators import translate
from quirework.session import ship
from quirework.streaming import events as E


def test_think_filter_over_split_tags():
    f = E.ThinkFilter()
    assert "".join(f.feed(c) for c in ("<thi", "nk>hidden", " more</th", "ink>AB", "C")) + f.flush() == "ABC"
    g = E.ThinkFilter()
    assert g.feed("a<th") + g.feed("is") + g.flush() == "a<this"
    h = E.ThinkFilter()
    assert h.feed("a<think>never closed") + h.flush() == "a"
    rng, text = random.Random(1), "x<think>y</think>z" * 3
    for _ in range(50):
        cuts = sorted(rng.sample(range(len(text)), 5))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        k = E.ThinkFilter()
        assert "".join(map(k.feed, parts)) + k.flush() == "xz" * 3


def test_stream_of_latest_state_equals_batch(spark, tmp_path):
    rows = [(f"j{i % 3}", f"p0_s{i}", i, 20, 0, None, "s", "t", None, None) for i in range(20)]
    df = spark.createDataFrame(rows, E.PROGRESS)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in"), per_trigger=2)
    E.write_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) > 1
    got = {tuple(r) for r in E.read_latest(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in E.latest(df).collect()}


def test_terminal_events(spark):
    jobs = spark.createDataFrame([("a", "done", None), ("b", "cancelled", None), ("c", "uploaded", None)], "doc_id string, status string, error string")
    assert {r["doc_id"]: r["event"] for r in E.terminal_events(jobs).collect()} == {"a": "done", "b": "error"}


def test_stub_keeps_tokens_and_guarded_falls_back(spark):
    df = spark.createDataFrame([("d", "s", "see [1] and ⟦EQ2⟧ " + "word " * 40), ("d", "e", "")], "doc_id string, seg_id string, source string")
    for r in translate.translate_stub(df).collect():
        assert r["n_errors"] == 0

    class Echo:
        def translate(self, text, context=None, continuation=False):
            return text.upper()

    ok = lambda s, t: [] if len(s) < 5 else ["long"]
    assert translate.guarded(Echo(), ok, str.split, "ab") == ("AB", "done")
    assert translate.guarded(Echo(), ok, str.split, "abcdef gh") == ("abcdef GH", "done")
    assert translate.guarded(Echo(), ok, str.split, "abcdef ghijkl") == ("abcdef ghijkl", "fallback")


def test_stream_of_chunks_in_order_with_tail(spark, tmp_path):
    ship(spark)
    parts = [("a", 0, "x<thi"), ("a", 2, "z</think>y"), ("a", 1, "nk>"), ("a", 3, "<th"), ("a", 4, None), ("b", 0, "p<think>never"), ("b", 1, "q"), ("b", 2, None), ("c", 0, "open <")]
    for i, row in enumerate(parts):  # one batch each, so chunk 2 comes before chunk 1
        spark.createDataFrame([row], E.CHUNKS).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={i:02d}"))
    stream = spark.readStream.schema(E.CHUNKS + ", k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("k")
    out = []
    # without it a stream with timeouts runs empty batches for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = E.filter_chunks(stream).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    text = {k: "".join(v for s, _, v in sorted(out) if s == k) for k in "abc"}
    assert text == {"a": "xy<th", "b": "p", "c": "open "}  # stream c goes on: its last sign may open a tag


def test_documents_are_translated_in_order_with_context(spark):
    ship(spark)

    class Told:
        def translate(self, text, context=None, continuation=False, previous_translation=None, glossary=None):
            return f"{text}|{context}|{continuation}|{previous_translation and previous_translation.split('|')[0]}|{glossary}"

    rows = [("d", 0, 1, "s1", "goes on."), ("d", 0, 0, "s0", "First of all"), ("d", 20, 0, "s2", "Far away."), ("e", 0, 0, "t0", None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, idx int, seg_id string, source string")
    terms = spark.sql("SELECT 'd' AS doc_id, map('a', 'b') AS glossary")
    got = {r["seg_id"]: r["translated"] for r in translate.translate_documents(df, Told, lambda s, t: [], str.split, glossaries=terms).collect()}
    g = "{'a': 'b'}"
    assert got == {"s0": f"First of all|None|False|None|{g}", "s1": f"goes on.|First of all|True|First of all|{g}", "s2": f"Far away.|goes on.|False|None|{g}", "t0": "|None|False|None|None"}


def test_echo_is_cut_and_plain_sentences_get_a_last_call():
    class Parrot:
        calls = 0

        def translate(self, text, context=None, continuation=False):
            Parrot.calls += 1
            return "번역문만 출력하라\n" + "옮긴 글이다. " * 5

    check = lambda s, t: ["echo"] if "번역문만 출력" in t else []
    text, status = translate.guarded(Parrot(), check, str.split, "some text of it", translate.without_echo())
    assert status == "done" and text.startswith("옮긴") and Parrot.calls == 3

    class Late:
        calls = 0

        def translate(self, text, context=None, continuation=False):
            Late.calls += 1
            return "ok" if context is None and Late.calls > 6 and text == "b" else "bad"

    assert translate.guarded(Late(), lambda s, t: ["no"] if t == "bad" else [], str.split, "⟦M0⟧ b") == ("⟦M0⟧ ok", "done")


def test_backends_by_name():
    import pytest

    translate.register_backend("late", lambda **kw: kw)
    assert translate.backend("late", a=1) == {"a": 1}
    with pytest.raises(ValueError):
        translate.backend("none of that name")


def test_glossary_of_each_document(spark):
    ship(spark)

    def make():
        def call(text):
            if "fail" in text:
                raise OSError
            return "- tree = 나무\nabsent = 없음\nno sign\nModel =\ntree = 다른\nmodel = 모형"

        return call

    df = spark.createDataFrame([("a", "A tree of the model"), ("b", " "), ("c", "fail of a model"), ("d", None)], "doc_id string, sample string")
    got = {r["doc_id"]: r["glossary"] for r in translate.document_glossaries(df, make, {"model": "모델"}).collect()}
    assert got == {"a": {"tree": "나무", "Model": "모델"}, "b": {}, "c": {"Model": "모델"}, "d": {}}
