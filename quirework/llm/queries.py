"""Queries of the nine text problems; each takes the session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship, spread
from ..sources.tables import table
from . import align, lookalike, mojibake, packing, pairs, scans, sentences, splitting, tokenizer


def _records(spark: SparkSession, d: str) -> DataFrame:
    """spans.text and segments.source as tbl, doc_id, rec, text."""
    spans = table(spark, d, "spans").select(F.lit("spans").alias("tbl"), "doc_id", F.concat_ws("/", "page", "block_no", "line_no", "span_no").alias("rec"), "text")
    segs = table(spark, d, "segments").select(F.lit("segments").alias("tbl"), "doc_id", F.col("seg_id").alias("rec"), F.col("source").alias("text"))
    return spread(spans.unionByName(segs))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "doc_profile").where("text_form = 'lines'").select("doc_id", F.col("source_lang").alias("lang")).dropDuplicates(["doc_id"])
    segs = table(spark, d, "segments").where("kind = 'body'").join(jobs, "doc_id")
    return align.align_pages(segs).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").where(F.col("status").isin("done", "fallback") & F.col("kind").isin("body", "heading", "caption"))
    return pairs.flag_pairs(spread(s)).distinct()


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The lines of scanned pages, and the segments of scanned jobs."""
    pages = table(spark, d, "layout_pages").where("ocr").select("doc_id", "page").distinct()
    lines = table(spark, d, "ocr_lines").join(pages, ["doc_id", "page"], "left_semi")
    scanned = table(spark, d, "doc_profile").where("text_form = 'scanned'").select("doc_id").distinct()
    return lines, table(spark, d, "segments").select("doc_id", "seg_id", "page", "source").join(scanned, "doc_id", "left_semi")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    lines, segs = _scanned(spark, d)
    parts = scans.scan_parts(lines)
    found = cut(parts["defects"], "defects")
    a = found.select(F.lit("ocr_lines").alias("tbl"), "doc_id", F.concat_ws("/", "page", "line_no").alias("rec"), "defect")
    b = scans.segment_defects(segs, parts["roles"], found).select(F.lit("segments").alias("tbl"), "doc_id", F.col("seg_id").alias("rec"), "defect")
    return a.unionByName(b).distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph of a scanned job as continuous text."""
    return scans.repaired_paragraphs(*_scanned(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    house = table(spark, d, "house_texts").withColumnRenamed("text", "house_text")
    return lookalike.matches(_records(spark, d), "text", house, entry="house_text").select("tbl", "doc_id", "rec", "ref_id").distinct()


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every text in the one form of its look; what looks like a house text takes its spelling."""
    house = table(spark, d, "house_texts").withColumnRenamed("text", "house_text")
    return lookalike.unify_column(_records(spark, d), "text", vocabulary=house, entry="house_text").select("tbl", "doc_id", "rec", "unified").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = mojibake.garbled_rows(_records(spark, d), "text")
    return rows.select("tbl", "doc_id", "rec").distinct()


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled records with the text restored as far as possible."""
    return mojibake.garbled_rows(_records(spark, d), "text").select("tbl", "doc_id", "rec", "repaired").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    running = table(spark, d, "doc_profile").where("text_form = 'running'").select("doc_id").distinct()
    s = spread(table(spark, d, "segments").select("doc_id", "seg_id", "kind", "source", "translated")).join(running, "doc_id", "left_semi")
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("text")) for c in ("source", "translated")])).alias("x")
    flat = s.select("doc_id", "seg_id", (F.col("kind") == "heading").alias("heading"), sides).select("doc_id", "seg_id", "heading", "x.side", "x.text")
    units = sentences.sentence_units(flat, "text", heading="heading")
    return units.select("doc_id", "seg_id", "side", "start_char", "end_char").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(spread(table(spark, d, "documents").select("doc_id", "text")))


def _budget(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    row = table(spark, d, "token_budgets").where(F.col("budget") == name).select("max_tokens", "overlap_tokens").first()
    return row["max_tokens"], row["overlap_tokens"]


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or part of one, with its container."""
    counts = cut(tokenizer.count_column(spread(table(spark, d, "documents").select("doc_id", "text"))), "counts")
    return packing.pack(counts, _budget(spark, d, "container")[0])


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document above the piece budget."""
    limit, overlap = _budget(spark, d, "piece")
    return splitting.split_texts(spread(table(spark, d, "documents").select("doc_id", "text")), limit, overlap)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(ship(spark), d)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (p1_found, p2_found, p3_found, p3_repaired, p4_found, p4_unified, p5_found, p5_repaired, p6_found, p7_ids, p8_containers, p9_pieces)}
ORACLE: dict[str, str] = {}
