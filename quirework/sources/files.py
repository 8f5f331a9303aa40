"""Files as tables: folder walks, PDF layout where a reader is installed, archives, bitmaps, model lists."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def walk(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder tree by natural path order, one per path and size: path, length, modified, sort_key."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return f.select("path", "length", F.col("modificationTime").alias("modified"), X.natural_key(F.col("path")).alias("sort_key")).dropDuplicates(["path", "length"])


def uploads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) PDF files: the head must be that of a PDF, and the file must not be encrypted."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    locked = F.decode(F.col("content"), "ISO-8859-1").contains("/Encrypt")
    checked = f.select("path", "length", F.when(head != "%PDF-", "not a PDF").when(locked, "encrypted").alias("problem"))
    return checked.where("problem IS NULL").drop("problem"), checked.where("problem IS NOT NULL")


def read_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of PDF files, where a PDF library is installed; rotated lines are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the optional library pymupdf") from e
        for f in frames:
            for path, content in zip(f.path, f.content, strict=True):
                rows = []
                with pymupdf.open(stream=bytes(content), filetype="pdf") as doc:
                    for page in doc:
                        for b, block in enumerate(page.get_text("dict")["blocks"]):
                            for n, line in enumerate(block.get("lines", ())):
                                if abs(line["dir"][1]) > 0.2:
                                    continue
                                rows += [(os.path.basename(path), page.number, b, n, k, s["text"], *map(float, s["bbox"]), s["font"], float(s["size"]), int(s["flags"])) for k, s in enumerate(line["spans"])]
                yield pd.DataFrame(rows, columns=_SPAN_COLUMNS)

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")
    return f.mapInPandas(run, "doc_id string, page int, block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int")


_SPAN_COLUMNS = ["doc_id", "page", "block_no", "line_no", "span_no", "text", "x0", "y0", "x1", "y1", "font", "size", "flags"]


def local_models(spark: SparkSession, path: str) -> DataFrame:
    """Usable models of a JSON list: no remote and no embedding models, by name, with their size in GB."""
    m = spark.read.schema("name string, size long, remote_host string, family string").json(path)
    kept = m.where(F.col("remote_host").isNull() & ~F.lower("name").rlike("cloud|embed") & ~F.lower(F.coalesce("family", F.lit(""))).rlike("bert|embed"))
    return kept.select("name", F.round(F.col("size") / 1e9, 1).alias("gb")).orderBy("name")


def zip_rows(members: DataFrame) -> DataFrame:
    """One archive per group from (group, member, content): group, archive. A group is one user's selection."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(f.member, f.content, strict=True)):
                z.writestr(name, bytes(content))
        return pd.DataFrame({"group": [f["group"].iloc[0]], "archive": [out.getvalue()]})

    return members.groupBy("group").applyInPandas(run, "group string, archive binary")


def components(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1; ends exclusive) of 8-neighbour components, by flood fill over runs of set pixels."""
    runs: list[tuple[int, int, int]] = []
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(np.asarray(mask, bool)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        here = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            k = len(runs)
            runs.append((y, int(a), int(b)))
            parent.append(k)
            here.append(k)
            for o in above:
                if runs[o][1] <= b and runs[o][2] >= a:
                    parent[root(k)] = root(o)
        above = here
    boxes: dict[int, list[int]] = {}
    for k, (y, a, b) in enumerate(runs):
        r = boxes.setdefault(root(k), [a, y, b, y + 1])
        r[0], r[1], r[2], r[3] = min(r[0], a), min(r[1], y), max(r[2], b), max(r[3], y + 1)
    return sorted(tuple(b) for b in boxes.values())


def model_regions(raw: DataFrame, labels: dict[int, str], least_score: float = 0.5, least_side: float = 3.0) -> DataFrame:
    """Regions from a layout model's raw boxes: scored, labelled, clamped to the page, without slivers and containers."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    r = raw.where(F.col("score") > least_score).withColumn("label", names[F.col("label_idx")])
    for c, most in (("x0", "width"), ("x1", "width"), ("y0", "height"), ("y1", "height")):
        r = r.withColumn(c, F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(most)))
    return r.where((F.col("label") != "reference") & (F.col("x1") - F.col("x0") >= least_side) & (F.col("y1") - F.col("y0") >= least_side))



def bibliography(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted titles with the details of a local table; a title that is not there gives found = false."""
    k = known.select(F.lower("title").alias("__t"), "authors", "year", "abstract", "url").dropDuplicates(["__t"])
    j = wanted.join(k, F.lower(wanted["title"]) == F.col("__t"), "left")
    return j.withColumn("found", F.col("__t").isNotNull()).drop("__t")
