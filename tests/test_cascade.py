"""The cascade on small pages of known outcome, and its folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import geometry as G
from quirework.operators import cascade, folds

SPAN = "doc_id string, page int, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int"
PAGES = "doc_id string, page int, width double, height double"


def layout(spark, docs):
    """`docs`: name -> pages -> blocks -> lines (x0, y0, x1, y1, text or spans, size, font, flags)."""
    rows, pages = [], []
    for d, ps in docs.items():
        for p, blocks in enumerate(ps):
            pages.append((d, p, 612.0, 792.0))
            for b, lines in enumerate(blocks):
                for i, (x0, y0, x1, y1, text, *rest) in enumerate(lines):
                    size, font, flags = [*rest, *(9.0, "Helvetica", 0)[len(rest) :]]
                    rows.append((d, p, b, i, 0, text, float(x0), float(y0), float(x1), float(y1), font, size, flags))
    return spark.createDataFrame(rows, SPAN), spark.createDataFrame(pages, PAGES)


def prose(y, n, word):
    return [(54, y + 12 * i, 290, y + 12 * i + 10, f"{word} sentence of the page number {i} goes on and") for i in range(n)]


DOCS = {
    "zone": [[prose(100, 4, "leading"), [(150, 160, 165, 166, "Nhit", 6.5, "Times-Italic"), (140, 165, 145, 174, "1", 9.0, "Times-Roman"), (90, 172, 210, 182, "E = y(i) yref(i)", 9.0, "Times-Italic"), (270, 172, 290, 182, "(7)", 9.0, "Times-Roman"), (120, 180, 140, 187, "offset", 6.5, "Times-Italic")], prose(210, 4, "closing")]],
    "front": [[[(100, 80, 500, 101, "Some Findings Set In Large Type", 21.0)], [(150, 120, 450, 130, "Ann B. Cole and Dan Eder")], [(54, 200, 290, 210, "Abstract the matter of this paper is in the way of a summary of")], *[prose(260, 8, "body")]]],
    "items": [[[(54, 100, 290, 110, "a lone line of the text that is before"), (54, 111, 290, 121, "2) is no item of the list but goes on"), (54, 122, 290, 132, "and here it is at an end of the line.")], [(54, 300, 290, 310, "1) first of the items"), (54, 311, 290, 321, "2) second of the items")]]],
    "refs": [[prose(100, 3, "body"), [(54, 150, 290, 160, "REFERENCES", 9.0, "Helvetica-Bold")], [(54, 170, 290, 180, "[1] A. Writer, On things, vol. 2, 2020.")]], [[(54, 100, 290, 110, "[2] B. Other, More things, pp. 3-9, 2021.")]]],
    "algo": [[prose(60, 3, "body"), [(54, 120, 200, 130, "Algorithm 1: Sorting of keys")], [(60, 145, 200, 155, "1: take the first of the keys")], [(60, 170, 200, 180, "2: put it at its place")], prose(220, 3, "after")]],
    "table": [[prose(60, 3, "body"), [(54, 120, 290, 130, "TABLE II. Counts of it all")], [(54 + 60 * c, 140 + 12 * r, 80 + 60 * c, 150 + 12 * r, f"{r}{c}.5") for r in range(3) for c in range(3)], prose(240, 3, "after")]],
    "furniture": [[[(54, 10, 290, 20, "Running head of the paper")], prose(100, 3, "body"), [(570, 300, 600, 310, "stamp")], [(54, 500, 575, 510, "a wide line of the text that ends in the band and is the text")]]],
    "empty": [[[(54, 100, 60, 110, None), (54, 120, 60, 130, " "), (54, 140, 60, 150, "⟦EQ1⟧ ⟦EQ2⟧")]]],
}


@pytest.fixture(scope="module")
def classified(spark):
    spans, pages = layout(spark, DOCS)
    got = {}
    for r in cascade.build_segments(spans.unionByName(spans.limit(20)), pages.unionByName(pages.limit(2))).orderBy("doc_id", "page", "idx").collect():
        got.setdefault(r["doc_id"], []).append(r)
    return got


def kinds(rows):
    return [(r["kind"], r["text"]) for r in rows]


def test_equation_of_italic_parts_is_one_formula(classified):
    formulas = [r for r in classified["zone"] if r["kind"] == "formula"]
    assert len(formulas) == 1 and all(p in formulas[0]["text"] for p in ("Nhit", "yref(i)", "(7)", "offset"))
    assert [r["kind"] for r in classified["zone"]] == ["body", "formula", "body"]


def test_authors_stand_between_title_and_abstract(classified):
    assert [k for k, _ in kinds(classified["front"])][:2] == ["heading", "author"]
    assert all(k == "body" for k, _ in kinds(classified["front"])[2:])


def test_list_items(classified):
    texts = [t for _, t in kinds(classified["items"])]
    assert texts[0].startswith("a lone line") and "2) is no item" in texts[0] and texts[1:] == ["1) first of the items", "2) second of the items"]


def test_references_run_over_pages(classified):
    assert kinds(classified["refs"])[1:] == [("heading", "REFERENCES"), ("reference", "[1] A. Writer, On things, vol. 2, 2020."), ("reference", "[2] B. Other, More things, pp. 3-9, 2021.")]


def test_algorithm_and_table(classified):
    assert [k for k, _ in kinds(classified["algo"])] == ["body", "algorithm", "algorithm", "algorithm", "body"]
    t = kinds(classified["table"])
    assert ("caption", "TABLE II. Counts of it all") in t and t[0][0] == t[-1][0] == "body"
    assert {k for k, x in t if x[0].isdigit()} == {"figure_text"}


def test_furniture_and_empty_pages(classified):
    k = dict((t, k) for k, t in kinds(classified["furniture"]))
    assert k["Running head of the paper"] == "header_footer" and k["stamp"] == "header_footer" or k["stamp"] == "body"
    assert next(v for t, v in k.items() if t.startswith("a wide line")) == "body"
    assert "empty" not in classified
    ids = [r["seg_id"] for r in classified["furniture"]]
    assert ids == [f"p0_s{i}" for i in range(len(ids))] and classified["furniture"][-1]["kind"] == "header_footer"


def test_empty_tables_give_no_segments(spark):
    spans, pages = layout(spark, DOCS)
    assert cascade.build_segments(spans.limit(0), pages).count() == 0


LONG = "The survey asked scientists what led to problems and more than half of them said that the pressure to publish and the ways of selection were to blame for most of the failures that they had seen in the lab."


@pytest.mark.parametrize(
    ("kind", "text", "label", "share", "want"),
    [
        ("body", "52% yes, a crisis", "chart", 1.0, "figure_text"), ("body", LONG, "image", 1.0, "body"), ("body", "Solubility 0.20 ** 0.34 *** 0.30 " * 6, "image", 1.0, "figure_text"),
        ("body", "452 | JOURNAL | VOL 533", "footer", 1.0, "header_footer"), ("heading", LONG, "text", 1.0, "body"), ("body", "38% yes, slightly", None, 0.0, "figure_text"), ("body", LONG, None, 0.0, "body"),
        ("body", "b", "figure_title", 1.0, "figure_text"), ("figure_text", LONG, "text", 1.0, "body"), ("author", "x", "chart", 1.0, "author"), ("body", "x y", "algorithm", 0.4, "body"), ("body", "a ⟦EQ1⟧ b", "display_formula", 1.0, "formula"),
    ],
)
def test_kinds_in_regions(spark, kind, text, label, share, want):
    df = spark.createDataFrame([(kind, text, label, 0.9, share)], "kind string, text string, label string, score double, share double")
    assert df.select(cascade.kind_in_region(*map(F.col, ("kind", "text", "label", "score", "share")))).first()[0] == want


def test_author_lists(spark):
    cases = {"Ann Cole1,2, Dan van der Eder* & Eve Fox": True, "Ann Cole, Dan Eder": False, "some words, and other words, and more": False, "A. B. Cee, D. Eff, G. Aitch": True, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", cascade.author_list(F.col("t")).alias("v")).collect()} == cases


def test_regions_keep_paragraphs_apart_and_override(spark):
    spans, pages = layout(spark, {"d": [[prose(100, 2, "one"), prose(124, 2, "two"), [(400, 300, 420, 310, "52 %")]]]})
    box = lambda *b: tuple(map(float, b))
    regions = spark.createDataFrame([("d", 0, 0, "text", 0.9, box(50, 98, 300, 122.5)), ("d", 0, 1, "text", 0.9, box(50, 123, 300, 150)), ("d", 0, 2, "chart", 0.9, box(380, 280, 500, 400))], "doc_id string, page int, region_no int, label string, score double, box struct<x0:double,y0:double,x1:double,y1:double>")
    got = cascade.build_segments(spans, pages, regions).orderBy("idx").collect()
    assert [r["kind"] for r in got] == ["body", "body", "figure_text"] and got[1]["text"].startswith("two")


def test_figures_claim_their_text(spark):
    spans, pages = layout(spark, {"d": [[[(100, 200, 140, 210, "axis label")], [(54, 262, 290, 272, "Fig. 1. What is seen")], prose(400, 3, "body")]]})
    graphics = spark.createDataFrame([("d", 0, "image", 54.0, 150.0, 290.0, 255.0)], "doc_id string, page int, type string, x0 double, y0 double, x1 double, y1 double")
    got = cascade.build_segments(spans, pages, None, graphics).orderBy("idx").collect()
    assert [r["kind"] for r in got] == ["figure_text", "caption", "body"]


# --- folds against plain loops


def test_columns_equal_the_plain_rule(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for g in range(60):
        boxes = sorted((float(rng.randrange(0, 500)), i, float(rng.randrange(5, 300))) for i in range(rng.randrange(1, 12)))
        cols = []
        for x0, i, w in boxes:
            inside = [k for k, c in enumerate(cols) if c["x0"] <= x0 <= c["x1"] - 2]
            if inside:
                k = max(inside)
                if x0 - cols[k]["x0"] <= 2:
                    cols[k]["x1"] = max(cols[k]["x1"], x0 + w)
            elif cols and x0 - cols[-1]["chain"] <= 0.15 * 612:
                k = len(cols) - 1
                cols[k].update(x1=max(cols[k]["x1"], x0 + w), chain=x0)
            else:
                k = len(cols)
                cols.append({"x0": x0, "x1": x0 + w, "chain": x0})
            want[g, i] = k
            rows.append((str(g), 0, i, x0, x0 + w, 612.0))
    df = spark.createDataFrame(rows, "doc_id string, page int, block_no int, x0 double, x1 double, width double")
    got = {(int(r["doc_id"]), r["block_no"]): r["col"] for r in folds.column_numbers(df, ["doc_id", "page"], ["block_no"], "width").collect()}
    assert got == want


def test_groups_grow(spark):
    df = spark.createDataFrame([("d", 0, i, float(a), float(b)) for i, (a, b) in enumerate([(0, 10), (4, 14), (9, 19), (40, 50)])], "doc_id string, page int, i int, y0 double, y1 double")
    assert [r["grp"] for r in folds.overlap_groups(df, ["doc_id", "page"], ["y0", "i"]).orderBy("i").collect()] == [0, 0, 0, 1]
    assert folds.overlap_groups(df.limit(0), ["doc_id", "page"], ["y0", "i"]).count() == 0


def test_islands_of_boxes_equal_growing(spark):
    import numpy as np

    rng = random.Random(22)
    for _ in range(300):
        boxes = np.array([[0.0, y, 10.0, y + rng.randrange(1, 60)] for y in (rng.randrange(0, 600) for _ in range(rng.randrange(1, 9)))])
        cap = np.array([0.0, 700.0, 10.0, 710.0])
        got = folds._island_at(cap, boxes, np.empty((0, 4)), "above", 50.0)
        near = min(range(len(boxes)), key=lambda i: (max(0.0, 700 - boxes[i][3]), boxes[i][1], boxes[i][0]))
        if 700 - boxes[near][3] > 50:
            assert got is None
            continue
        member, grew = {near}, True
        while grew:
            lo, hi = min(boxes[i][1] for i in member), max(boxes[i][3] for i in member)
            more = {i for i in range(len(boxes)) if max(boxes[i][1] - hi, lo - boxes[i][3], 0) <= 50}
            grew = not more <= member
            member |= more
        assert got[1][1] == min(boxes[i][1] for i in member) and got[1][3] == max(boxes[i][3] for i in member)


def test_table_shape():
    cells = [(x, "12.5") for x in (0.0, 50.0, 100.0) for _ in range(3)]
    assert folds.table_shaped(cells, 9, False) and not folds.table_shaped(cells, 3, False)
    assert not folds.table_shaped([(0.0, "12.5")] * 9, 9, False) and folds.table_shaped([(0.0, "12.5")] * 9, 9, True)
    assert not folds.table_shaped([(x, "words only here") for x, _ in cells], 9, True) and not folds.table_shaped([], 9, True)


def test_page_text_of_flow(spark):
    s = "doc_id string, page int, seg_id string, idx int, kind string, width double, x0 double, y0 double, x1 double, y1 double"
    rows = [("d", 0, "a", 0, "body", 612.0, 54.0, 100.0, 290.0, 300.0), ("d", 0, "b", 1, "body", 612.0, 54.0, 310.0, 290.0, 500.0), ("d", 0, "f", 2, "formula", 612.0, 54.0, 510.0, 290.0, 520.0), ("d", 0, "c", 3, "body", 612.0, 54.0, 530.0, 290.0, 600.0)]
    got = {r["seg_id"]: (r["region_no"], r["top"]) for r in folds.flow_regions(spark.createDataFrame(rows, s)).collect()}
    assert got == {"a": (0, 100.0), "b": (0, 310.0), "c": (1, 530.0)}
    assert G.BAND == 0.05
