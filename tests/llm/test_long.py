import random

import numpy as np
import pyarrow as pa

from quirework.llm import align, lookalike
from quirework.session import ship


def test_long_segments_give_confident_pairs(monkeypatch):
    rng = random.Random(11)
    lines = [(f"Item A{i} weighs {i * 7} now{' and more' * (k := rng.randrange(12))}", f"A{i} 항목 무게 {i * 7}{' 그리고' * k}") for i in range(500)]
    source, target = "\n".join(a for a, _ in lines), "\n".join(b for _, b in lines)
    assert len(align.confident_pairs("en", source, target)) == 500
    # where a part of one side is missing, the band loses nothing against the whole programme
    cut = "\n".join(b for i, (_, b) in enumerate(lines) if not 200 <= i < 230)
    pairs = align.confident_pairs("en", source, cut)
    monkeypatch.setattr(align, "BAND", 10_000)
    assert len(pairs) > 400 and pairs == align.confident_pairs("en", source, cut)


def test_banded_beads_cover_both_sides():
    rng = random.Random(9)
    for n, m in ((0, 500), (500, 0), (1, 900), (900, 1), (600, 250), (450, 450)):
        a, b = [rng.uniform(5, 80) for _ in range(n)], [rng.choice((0.5, 40.0, 4000.0)) for _ in range(m)]
        beads = align.length_beads(a, b)
        assert sum(x[1] for x in beads) == n and sum(x[3] for x in beads) == m


def test_joined_lines_beyond_a_stretch_are_found():
    # line 299 is the last of the first stretch; its rendering stands in the next one, joined to that of line 300
    n = 600
    src = [f"Item A{i}-{i} weighs {i * 7} now" for i in range(n)]
    tgt = [f"A{i}-{i} 항목 {i * 7}" for i in range(n)]
    tgt[299], tgt[300] = "12345 99999", f"{tgt[299]} {tgt[300]}"
    pairs, left, right = align.align_segment(align.Table(), "en", "\n".join(src), "\n".join(tgt))
    assert sorted(pairs) == sorted([(i, i) for i in range(n) if i != 299] + [(299, 300)]) and left == [] and right == [299]


def test_left_over_lines_of_a_giant_segment_equal_the_whole_comparison(monkeypatch):
    rng = random.Random(10)
    src = [f"Item A{i} and B{i * 3} at {i * 7}" for i in range(90)]
    tgt = [f"A{i} B{i * 3} {i * 7} 항목" for i in range(90)]
    tgt[20:22] = [" ".join(tgt[20:22])]
    rng.shuffle(tgt)
    a, b = (align.Side("en", list(enumerate(x)), k) for x, k in ((src, False), (tgt, True)))
    table = align.Table()
    where = {t.split()[0]: j for j, t in enumerate(tgt)}
    given = [(i, where[f"A{i}"]) for i in range(0, 90, 2) if f"A{i}" in where]
    want = align.match_leftovers(table, a, b, given)
    monkeypatch.setattr(align, "LEFTOVER_BLOCK", 16)
    assert align.match_leftovers(table, a, b, given) == want and len(want) + len(given) == 90
    part = align._pick(a, [3, 5])
    assert part.keys == [(3,), (5,)] and np.array_equal(part.flat[part.starts[1] :], align.Side("en", [(5, src[5])], False).flat)


def test_house_texts_give_their_spelling(spark):
    ship(spark)
    house = spark.createDataFrame([(1, "パラメータ表"), (2, "Search tree"), (3, "Façade"), (4, "Search trее")], "ref_id int, text string")
    texts = ["パラメ一夕表", " Search\ttree\n", "Sеarch tree", "Fac\u0327ade ", "データ", "\tplain  text ", "\u200b", "", None, "ﬁne\u3000"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r["unified"] for r in lookalike.unify_column(df, "text", vocabulary=house).orderBy("id").collect()]
    assert got == ["パラメータ表", "Search tree", "Search tree", "Façade", "データ", "plain  text", "", "", None, "fine"]
    table = [r["unified"] for r in lookalike.unify_column(df, "text").orderBy("id").collect()]
    assert table == [lookalike.unify(t) for t in texts] and table[1] == "Search tree"
    # the join finds what the trie finds
    odd = df.where("id NOT IN (1)")  # matches() leaves ASCII without tabs and line ends in the JVM
    for part in (df, odd):
        one = sorted((r["id"], r["ref_id"]) for r in lookalike.matches(part, "text", house).collect())
        two = sorted((r["id"], r["ref_id"]) for r in lookalike.join_looks(part, "text", house).collect())
        assert one == two and (0, 1) in one and (3, 3) in one


def test_word_pairs_beyond_what_is_sent_are_joined(spark, monkeypatch):
    ship(spark)
    rng = random.Random(12)
    words = [("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)), chr(0xAC00 + 20 * i) + chr(0xAC00 + 31 * i)) for i in range(300)]

    def lines(n):
        return [tuple(map(" ".join, zip(*rng.sample(words, 6), strict=True))) for _ in range(n)]

    rows = [("d", i, "s0", "en", "\n".join(a for a, _ in some), "\n".join(b for _, b in some)) for i in range(250) for some in [lines(3)]]
    moved = lines(40)
    # the first segment of a page has the lines, the second their renderings in another order
    rows += [("x", p, s, "en", "\n".join(a for a, _ in some) if s == "s0" else "", "\n".join(b for _, b in some[::-1]) if s == "s1" else "") for p in range(8) for some in [moved[5 * p : 5 * p + 5]] for s in ("s0", "s1")]
    df = spark.createDataFrame(rows, "doc_id string, page int, seg_id string, lang string, source string, translated string")
    whole = sorted(map(tuple, align.align_pages(df).collect()))
    assert [r for r in whole if r[0] == "x"] == sorted([("x", "s0", i, "s1", 4 - i) for i in range(5)] * 8)
    monkeypatch.setattr(align, "MOST_PAIRS", 100)
    monkeypatch.setattr(align, "PART", 2000)
    assert sorted(map(tuple, align.align_pages(df).collect())) == whole

    pairs = [p for r in rows for p in align.confident_pairs("en", r[4], r[5])]
    df = spark.createDataFrame([(*p, 0) for p in pairs], "src array<bigint>, tgt array<bigint>, lang int")
    sent, joined = align.train(df, most=1 << 20), align.train(df, most=100)
    assert sent.shared is not None and joined.shared is None
    want, got = ({(r["kind"], r["a"], r["b"]): r["n"] for r in m.counts.collect()} for m in (sent, joined))
    assert want.keys() == got.keys() and len(want) > 900 and all(abs(got[k] - n) < 1e-3 for k, n in want.items())


def test_rare_words_of_long_lines_are_counted(spark, monkeypatch):
    ship(spark)
    # of the last word every pair is seen once, in a line of 60 words; the other words tell which one is its own
    rows = [(list(range(1, 61)), list(range(101, 161)), 0)] + [([i], [100 + i], 0) for i in range(1, 60)] * 20
    model = align.train(spark.createDataFrame(rows, "src array<bigint>, tgt array<bigint>, lang int"))
    assert {r["b"] for r in model.counts.where("kind = 'p' and a = 60").collect()} == {160}
    # a batch taken in pieces has the same counts
    lists = pa.list_(pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (lists, lists, pa.int32()), strict=True)], ["src", "tgt", "lang"])

    def counted():
        got = pa.Table.from_batches(align._count(align.Table(), iter([batch])))
        return len(got), got.group_by(["kind", "a", "b"]).aggregate([("n", "sum")]).sort_by([("kind", "ascending"), ("a", "ascending"), ("b", "ascending")])["n_sum"].to_numpy()

    n, whole = counted()
    monkeypatch.setattr(align, "PART", 100)
    m, pieces = counted()
    assert m > n == len(whole) == len(pieces) and np.allclose(whole, pieces)


def test_a_table_has_every_count():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3000, 200_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64) << np.uint64(1))
        counts = rng.uniform(0.1, 9, len(keys)).astype(np.float32)
        table = align.Slots(keys, counts)
        assert np.array_equal(table.get(keys), counts)
        assert not table.get(keys + np.uint64(1)).any()
    # keys that fall into one slot
    keys = (np.arange(1, 50, dtype=np.uint64) << np.uint64(40)) | np.uint64(5 << 8)
    assert np.array_equal(align.Slots(keys, np.arange(49) + 1.0).get(keys), np.arange(49) + 1.0)
