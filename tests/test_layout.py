import numpy as np
from pyspark.sql import functions as F

from quirework.functions import geometry as G
from quirework.operators import folds, islands, spatial, store
from quirework.sources.files import components


def test_iou_and_overlap(spark):
    df = spark.sql("SELECT named_struct('x0', 0D, 'y0', 0D, 'x1', 2D, 'y1', 2D) a, named_struct('x0', 1D, 'y0', 1D, 'x1', 3D, 'y1', 3D) b, named_struct('x0', 0D, 'y0', 0D, 'x1', 0D, 'y1', 0D) e")
    r = df.select(G.iou(F.col("a"), F.col("b")).alias("i"), G.overlap_of_smaller(F.col("a"), F.col("b")).alias("o"), G.iou(F.col("e"), F.col("e")).alias("z")).first()
    assert abs(r["i"] - 1 / 7) < 1e-12 and r["o"] == 0.25 and r["z"] == 0.0


def test_largest_fit_is_bounded(spark):
    df = spark.createDataFrame([(100.0, 400.0), (100.0, 50.0), (1e9, 1.0)], "c double, r double")
    got = [r[0] for r in df.select(G.largest_fit(F.col("c"), F.col("r"))).collect()]
    assert got[0] == 1.0 and 0.69 < got[1] <= 0.7072 and got[2] == 0.3


def test_first_and_last_ties(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    items = spark.createDataFrame([("d", 0, 1, (0.0, 0.0, 10.0, 10.0))], f"doc_id string, page int, k int, b {box}")
    regions = spark.createDataFrame([("d", 0, 0, (0.0, 0.0, 5.0, 10.0)), ("d", 0, 1, (5.0, 0.0, 10.0, 10.0)), ("d", 0, 2, (0.0, 12.0, 10.0, 20.0)), ("d", 0, 3, (0.0, 12.0, 10.0, 30.0))], f"doc_id string, page int, region_no int, rb {box}")
    best = spatial.best_region(items, regions, ["k"]).first()
    assert best["region_no"] == 0 and best["share"] == 0.5
    assert spatial.nearest_region(items, regions.where("region_no >= 2"), ["k"]).first()["region_no"] == 3


def naive_islands(intervals, gap):
    groups = []
    for lo, hi in sorted(intervals):
        if groups and lo <= groups[-1][1] + gap:
            groups[-1][1] = max(groups[-1][1], hi)
        else:
            groups.append([lo, hi])
    return len(groups)


def test_islands_equal_the_loop(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(40):
        iv = [(float(a), float(a + b)) for a, b in zip(rng.integers(0, 200, 12), rng.integers(1, 20, 12), strict=True)]
        rows += [(g, i, lo, hi) for i, (lo, hi) in enumerate(iv)]
        want[g] = naive_islands(iv, 3.0)
    df = islands.interval_islands(spark.createDataFrame(rows, "g int, i int, lo double, hi double"), ["g"], "lo", "hi", 3.0, ["hi", "i"])
    got = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.max("island").alias("n")).collect()}
    assert got == want


def test_repeats_do_not_chain(spark):
    rows = [("d", 0, 0, i, "t", x, 0.0, x + 9, 9.0) for i, x in enumerate((0.0, 0.8, 1.6))]
    df = spark.createDataFrame(rows, "doc_id string, page int, block_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["line_no"] for r in folds.drop_repeats(df).collect()) == [0, 2]


def test_components_touch_diagonally():
    m = np.zeros((20, 40), bool)
    m[2:4, 3:8] = m[4:6, 8:16] = True
    m[10:14, 20:35] = True
    assert components(m) == [(3, 2, 16, 6), (20, 10, 35, 14)]
    assert components(np.zeros((3, 3), bool)) == []


def test_claimed_boxes_are_taken_once(spark):
    caps = spark.createDataFrame([("d", 0, "figure-1", 0, 0.0, 100.0, 50.0, 110.0), ("d", 0, "figure-2", 1, 0.0, 130.0, 50.0, 140.0)], "doc_id string, page int, key string, ordinal int, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("d", 0, 0.0, 60.0, 50.0, 98.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r["key"] for r in folds.claim_figures(caps, boxes).collect()] == ["figure-1"]


def test_reference_chain(spark):
    df = spark.createDataFrame([("[1] a [7] b [2] c [2] d [3]",), ("",)], "t string").select(folds.reference_chain(F.col("t")).alias("c"))
    assert [r["c"] for r in df.collect()] == [[1, 2, 3], []]


def test_upsert_keeps_named_columns(spark):
    old = spark.createDataFrame([(1, "a", "box"), (2, "b", None)], "k int, v string, keep string")
    new = spark.createDataFrame([(1, "n"), (3, "m")], "k int, v string")
    got = {r["k"]: (r["v"], r["keep"]) for r in store.upsert(old, new, ["k"], ["keep"]).collect()}
    assert got == {1: ("n", "box"), 2: ("b", None), 3: ("m", None)}


def test_blocks_equal_one_window(spark):
    from pyspark.sql import Window

    from quirework.operators import blocks

    rng = np.random.default_rng(3)
    rows = [(int(g), i, None if v == 3 else int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 4, 300), strict=True))]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    w, block = Window.partitionBy("g").orderBy("o"), F.floor(F.col("o") / 7)
    plain = df.withColumn("k", F.row_number().over(w)).withColumn("b", F.lag("v").over(w))
    both = blocks.lag(blocks.rank(df, ["g"], block, ["o"], "k"), ["g"], block, ["o"], "v", "b").select(plain.columns)
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    starts = F.col("v") == 2
    a = blocks.runs(df, ["g"], block, ["o"], F.coalesce(starts, F.lit(False)) | F.col("o").isin([df.where(f"g = {g}").agg(F.min("o")).first()[0] for g in range(3)]), "r")
    b = islands.runs(df, ["g"], ["o"], starts, "r")
    assert sorted(map(tuple, a.select("g", "o", "r").collect())) == sorted(map(tuple, b.select("g", "o", "r").collect()))
    assert blocks.rank(df.limit(0), ["g"], block, ["o"]).count() == 0


def test_cut_tables_are_released(spark):
    from quirework.session import cut, release

    df = cut(spark.range(5), "t")
    assert df.count() == 5 and release(spark) >= 1 and release(spark) == 0
