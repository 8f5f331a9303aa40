"""Cutting texts above a token limit into pieces at natural boundaries, with overlap.

Method: every text, of a column or of a file, is read in ranges with halos; a short one is a single range. The place
where one range hands over to the next is the first sure boundary in the halo, which both neighbours find alike. Each
range tabulates its boundaries with running token sums; the tables are stitched by prefix sums of the ranges' tokens,
and pieces are emitted by offset from sections of the stitched table. No worker needs the whole of a giant text, and
the pieces do not depend on where ranges end.

A stitched table is divided into sections of SECTION limits or more, each ending at the strongest boundary before its
mark; inside a section pieces are cut one behind the other, each at the last of the strongest boundaries in the upper
half of the limit. The numbers of pieces before each section are prefix sums again.

Boundaries by strength: behind a blank line, a line end, a sentence end, a blank, between two pre-tokens, and last,
inside a giant pre-token, between two of its tokens.

Consecutive pieces share at least the overlap, up to the next boundary. A piece's count is that of the piece encoded
on its own. The room beside the overlap must be at least a quarter of the limit and eight tokens, and 24 (checked), so the
overlap always fits; only inside giant pre-tokens, whose parts may count more on their own, is it given up for the
limit.

Defined results: null, empty and small texts give no rows; repeated rows give repeated pieces. In files, each
byte that is no UTF-8 is read as the control sign SUBSTITUTE, which takes one byte too, so offsets hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

from ..session import cut
from .tokenizer import FOLDER, MEMORY, RANK_FILE, Encoder, SharedEncoder

SPAN = 1 << 14  # signs, or bytes, of a range
HALO = 1 << 10  # signs behind a range in which it may hand over to the next
SECTION = 32  # limits of tokens in a section of stitched tables

_SENTENCE = regex.compile(r"[.!?。！？।॥…]+[\"”’»)\]」』]*$")


_ENDS = frozenset(".!?。！？।॥…\"”’»)]」』")


def _strength(before: str, piece: str) -> int:
    """The strength of the boundary between the text that ends with `before` and the pre-token `piece`."""
    if before.endswith("\n\n") or before.endswith("\n\r\n"):
        return 4
    if before[-1] in "\n\r":
        return 3
    tail = before.rstrip(" \t")
    if piece[0].isspace() or tail != before or before[-1] in "。！？।॥」』":
        if piece[0] in "\n\r":
            return 1
        return 2 if _SENTENCE.search(tail) else 1
    return 0


# Places that end a pre-token whatever stands around them: behind a word before white space, else between signs of
# different kinds (an apostrophe may begin a contraction).
_WORD_END = regex.compile(r"[\p{L}\p{N}](?=\s)")
_SEAM = regex.compile(r"[\p{L}\p{N}](?=[^\s\p{L}\p{N}'])|[^\s\p{L}\p{N}'](?=[\p{L}\p{N}])|\p{L}(?=\p{N})|\p{N}(?=\p{L})")


def handover(halo: str) -> tuple[int, int]:
    """Where in the signs behind a range the next one begins, and the strength of that place: -1 if it is not sure."""
    for pattern, mark in ((_WORD_END, 1), (_SEAM, 0)):
        m = pattern.search(halo)
        if m:
            return m.end(), mark
    return len(halo), -1


def _grain(limit: int) -> int:
    """The most tokens between two boundaries: longer pre-tokens are taken apart; one sign takes up to four."""
    return max(4, limit // 16)


def check_room(limit: int, overlap: int) -> None:
    least = 4 * (_grain(limit) + 2)
    if limit - overlap < least or overlap < 0:
        raise ValueError(f"the limit must exceed the overlap by {least} tokens or more")


def sections_of(total: int, limit: int) -> int:
    return max(1, total // (SECTION * limit))


def boundaries(enc: Encoder, text: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, token sums and strengths of all places where a cut may be made, the ends included.

    Short words with their punctuation are not divided; units with line ends, and long ones, are taken apart.
    """
    at, sums, marks = [0], [0], [4]
    giant = _grain(limit)
    simple = enc.simple.setdefault(giant, {})  # words without line ends: their tokens, and the strength behind them
    if len(simple) > MEMORY:
        simple.clear()
    memo = enc.memo
    total = pos = 0
    chunks = text.split(" ")
    last = len(chunks) - 1
    pending = ""
    for i, chunk in enumerate(chunks):
        if i and not pending:
            got = simple.get(chunk)
            if got is not None:  # the usual case: a blank and a known word
                total += got[0]
                pos += len(chunk) + 1
                at.append(pos)
                sums.append(total)
                marks.append(got[1])
                continue
        unit = pending + (" " + chunk if i else chunk)
        if i < last and (not chunk or chunk[-1].isspace()):
            pending = unit
            continue
        word = i and not pending
        pending = ""
        if not unit:
            continue
        if len(unit) <= 24 and "\n" not in unit and "\r" not in unit:
            n = len(enc.encode_unit(unit))
            if n <= giant:
                mark = 2 if unit[-1] in _ENDS and _SENTENCE.search(unit) else 1
                if word:
                    simple[chunk] = (n, mark)
                total += n
                pos += len(unit)
                at.append(pos)
                sums.append(total)
                marks.append(mark)
                continue
        base = pos
        for m in enc.spans(unit):
            piece = m.group()
            s = m.start()
            if s:
                # between two letters or digits there is nothing natural
                marks[-1] = (1 if piece[0] == " " else 0) if unit[s - 1].isalnum() and piece[0] not in "\n\r" else _strength(unit[max(0, s - 8) : s], piece)
            ids = memo.get(piece) or enc.encode_piece(piece)
            if len(ids) > giant and len(piece) > 1:
                for signs, k in _inner(enc, piece, ids):
                    at.append(base + s + signs)
                    sums.append(total + k)
                    marks.append(-1)
            total += len(ids)
            at.append(base + m.end())
            sums.append(total)
            marks.append(1)
        pos += len(unit)
        marks[-1] = 2 if _SENTENCE.search(unit[-8:]) else 1
    marks[-1] = 4
    return np.array(at, np.int32), np.array(sums, np.int32), np.array(marks, np.int8)


def _inner(enc: Encoder, piece: str, ids: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """The places inside a pre-token where a token and a sign end together: signs and tokens before them."""
    sign, upto = 0, len(piece[0].encode("utf-8"))
    done = 0
    for k, i in enumerate(ids[:-1], 1):
        done += len(enc.strings[i])
        while upto < done:
            sign += 1
            upto += len(piece[sign].encode("utf-8"))
        if upto == done:
            yield sign + 1, k


class Section:
    """A stretch of a text with the stitched boundaries of its ranges; sums count from the start of the text."""

    def __init__(self, enc: Encoder, text: str, at: np.ndarray, sums: np.ndarray, marks: np.ndarray) -> None:
        self.enc, self.text, self.at, self.sums, self.marks = enc, text, at, sums, marks
        self.loose = np.concatenate([[0], np.cumsum(marks == -1)])

    @classmethod
    def stitched(cls, enc: Encoder, ranges: list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]) -> Section:
        """`ranges`: text, tokens before it, offsets, sums and marks of consecutive ranges."""
        at, sums, marks, signs = [], [], [], 0
        for k, (text, before, a, s, m) in enumerate(ranges):
            first = 1 if k else 0  # the place where two ranges meet stands in both
            at.append(a[first:].astype(np.int64) + signs)
            sums.append(s[first:].astype(np.int64) + before)
            marks.append(m[first:])
            signs += len(text)
        return cls(enc, "".join(r[0] for r in ranges), np.concatenate(at), np.concatenate(sums), np.concatenate(marks))

    def tokens(self, i: int, j: int) -> int:
        """The tokens of the text between two boundaries when it stands alone.

        Up to its last sign that is not white space it falls apart as it does in the whole text; only a run of
        white space at the end is divided anew, and a pre-token that is cut.
        """
        text, at = self.text, self.at
        if self.loose[j + 1] > self.loose[i]:
            return self.enc.count(text[at[i] : at[j]])
        k = j
        while k > i and text[at[k] - 1].isspace():
            k -= 1
        return int(self.sums[k] - self.sums[i]) + (self.enc.count(text[at[k] : at[j]]) if k < j else 0)

    def pieces(self, total: int, limit: int, overlap: int, number: int = 0) -> list[tuple[int, int, int]]:
        """(start, end, tokens) of the pieces of section `number`; offsets in the stretch at hand."""
        sums, marks, at = self.sums, self.marks, self.at
        done, finish = self._border(number, total, limit), self._border(number + 1, total, limit)
        start = self._shared(done, overlap) if number else done
        out = []
        while done < finish:
            end = min(finish, max(done + 1, int(np.searchsorted(sums, sums[start] + limit, "right")) - 1))
            if end < finish:
                low = max(done + 1, int(np.searchsorted(sums, sums[start] + (limit + overlap) // 2, "left")))
                if low < end:
                    end -= int(np.argmax(marks[low : end + 1][::-1]))
            n = self.tokens(start, end)
            while n > limit and end > done + 1:
                end -= 1
                n = self.tokens(start, end)
            while n > limit and start < done:
                start += 1
                n = self.tokens(start, end)
            out.append((int(at[start]), int(at[end]), n))
            done = end
            start = self._shared(done, overlap)
        return out

    def _shared(self, place: int, overlap: int) -> int:
        """The last boundary with at least `overlap` tokens before `place`."""
        start = max(0, int(np.searchsorted(self.sums, self.sums[place] - overlap, "right")) - 1)
        while start and self.tokens(start, place) < overlap:
            start -= 1
        return start

    def _border(self, number: int, total: int, limit: int) -> int:
        """The boundary before section `number`: the last of the strongest in the two limits of tokens before its mark."""
        count = sections_of(total, limit)
        if number == 0:
            return 0
        if number == count:
            return len(self.sums) - 1
        mark = number * total // count
        i, j = np.searchsorted(self.sums, [mark - 2 * limit, mark], "right")
        return int(j) - 1 - int(np.argmax(self.marks[i:j][::-1]))


_TABLE = StructType().add("__id", LongType()).add("range_no", LongType()).add("base", LongType()).add("text", StringType()).add("at", BinaryType()).add("sums", BinaryType()).add("marks", BinaryType()).add("n", LongType())


def _tabulated(enc: Encoder, own: str, halo: str, first: int, last: bool, limit: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The text of a range, from its first place to that of the next, with its boundaries."""
    stop, mark = (0, 4) if last else handover(halo)
    text = own[first:] + halo[:stop] if not last else own[first:]
    at, sums, marks = boundaries(enc, text, limit)
    if not last:
        marks[-1] = mark
    return text, at, sums, marks


def _lengths(text: str) -> np.ndarray:
    """The offset in UTF-8 bytes before each sign, and behind the last."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))])


def _stitch(tables: DataFrame, keys: DataFrame, key: str, enc: SharedEncoder, limit: int, overlap: int, by_bytes: bool) -> DataFrame:
    """Pieces of texts of several ranges, section by section, from the written tables."""
    sizes = tables.select("__id", "range_no", "n")
    run_up = Window.partitionBy("__id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.withColumn("before", F.coalesce(F.sum("n").over(run_up), F.lit(0))).select("__id", "range_no", "before")
    totals = sizes.groupBy("__id").agg(F.sum("n").alias("total")).where(F.col("total") > limit)
    placed = tables.join(sums, ["__id", "range_no"]).join(totals.withColumn("count", F.greatest(F.floor(F.col("total") / (SECTION * limit)), F.lit(1))), "__id")
    # a section needs the boundaries before its first piece as well; sections are at most 2 * SECTION limits long
    share = F.col("total") / F.col("count")
    low = F.greatest(F.ceil(F.col("before") / share).cast("long") - 1, F.lit(0))
    high = F.least(F.floor((F.col("before") + F.col("n") + 4 * limit) / share), F.col("count") - 1)
    parts = placed.where(low <= high).select("*", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("section"))
    fields = ["range_no", "base", "before", "text", "at", "sums", "marks"]
    grouped = parts.groupBy("__id", "section").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct(*fields))).alias("ranges"))
    schema = StructType().add("__id", LongType()).add("section", LongType()).add("idx", IntegerType()).add("start_char", LongType()).add("end_char", LongType()).add("n_tokens", IntegerType()).add("piece", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = enc.get()
        for b in batches:
            for i in range(b.num_rows):  # one section at a time
                row = {n: b.column(n)[i].as_py() for n in ("__id", "section", "total", "ranges")}
                ranges = row["ranges"]
                section = Section.stitched(e, [(r["text"], r["before"], *(np.frombuffer(r[c], t) for c, t in (("at", np.int32), ("sums", np.int32), ("marks", np.int8)))) for r in ranges])
                offset = _lengths(section.text) if by_bytes else np.arange(len(section.text) + 1)
                base = ranges[0]["base"]
                got = section.pieces(row["total"], limit, overlap, row["section"])
                cols = [
                    pa.array([row["__id"]] * len(got), pa.int64()),
                    pa.array([row["section"]] * len(got), pa.int64()),
                    pa.array(range(len(got)), pa.int32()),
                    pa.array([base + int(offset[g[0]]) for g in got], pa.int64()),
                    pa.array([base + int(offset[g[1]]) for g in got], pa.int64()),
                    pa.array([g[2] for g in got], pa.int32()),
                    pa.array([section.text[g[0] : g[1]] for g in got], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    pieces = cut(grouped.mapInArrow(run, schema), "pieces")
    sections = pieces.groupBy("__id", "section").agg((F.max("idx") + 1).alias("k"))
    numbers = sections.select("__id", "section", F.coalesce(F.sum("k").over(Window.partitionBy("__id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = pieces.join(numbers, ["__id", "section"]).join(keys, "__id")
    return numbered.select(key, (F.col("idx") + F.col("earlier")).cast("int").alias("piece_no"), "start_char", "end_char", "n_tokens", "piece")


def split_texts(df: DataFrame, limit: int, overlap: int, column: str = "text", key: str = "doc_id", *, folder: str = FOLDER, name: str = RANK_FILE, span: int = SPAN) -> DataFrame:
    """Pieces of every text of more than `limit` tokens: key, piece_no, start_char, end_char, n_tokens, piece.

    A text with no more bytes than the limit has no more tokens, and stays in the JVM. Texts are divided into ranges
    there in one pass, so workers get ranges only; where a text is a single range, its table is the stitched one and
    its pieces are emitted at once.
    """
    check_room(limit, overlap)
    enc = SharedEncoder(df.sparkSession, folder, name)
    long = df.select(F.col(key), F.col(column).alias("__t")).where(F.octet_length("__t") > limit).withColumn("__id", F.monotonically_increasing_id())
    short = F.length("__t") <= span
    names = [key, "piece_no", "start_char", "end_char", "n_tokens", "piece"]
    schema = StructType([df.schema[key]]).add("piece_no", IntegerType()).add("start_char", LongType()).add("end_char", LongType()).add("n_tokens", IntegerType()).add("piece", StringType())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = enc.get()
        for b in batches:
            rows, out = [], []
            for i, text in enumerate(b.column("__t").to_pylist()):
                text, *table = _tabulated(e, text, "", 0, True, limit)
                total = int(table[1][-1])
                if total > limit:
                    section = Section(e, text, *table)
                    got = [g for k in range(sections_of(total, limit)) for g in section.pieces(total, limit, overlap, k)]
                    got = [(k, *g, text[g[0] : g[1]]) for k, g in enumerate(got)]
                    rows.extend([i] * len(got))
                    out.extend(got)
            cols = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    one = long.where(short).select(key, "__t").mapInArrow(whole, schema)
    chunks = F.regexp_extract_all("__t", F.lit(f"(?s).{{1,{span}}}"), F.lit(0))
    many = long.where(~short).select(key, "__id", chunks.alias("__c"))
    window = lambda i: F.struct(i.cast("long").alias("range_no"), F.element_at("__c", i + 1).alias("own"), F.substring(F.coalesce(F.try_element_at("__c", i + 2), F.lit("")), 1, HALO).alias("halo"), (i == F.size("__c") - 1).alias("last"))
    ranges = many.select(key, "__id", F.explode(F.transform(F.sequence(F.lit(0), F.size("__c") - 1), window)).alias("r")).select(key, "__id", "r.*")
    written = cut(_tables(ranges, key, enc, limit, span), "tables")
    keys = written.where("range_no = 0").select(key, "__id")
    return one.unionByName(_stitch(written.drop(key), keys, key, enc, limit, overlap, False))


def _tables(ranges: DataFrame, key: str, enc: SharedEncoder, limit: int, span: int) -> DataFrame:
    """The boundary tables of ranges (key, __id, range_no, own, halo, last)."""
    schema = StructType([ranges.schema[key], *_TABLE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = enc.get()
        for b in batches:
            out = []
            for r, own, halo, last in zip(*(b.column(c).to_pylist() for c in ("range_no", "own", "halo", "last")), strict=True):
                first = handover(own[:HALO])[0] if r else 0
                text, at, sums, marks = _tabulated(e, own, halo, first, last, limit)
                out.append((r, r * span + first, text, at.tobytes(), sums.tobytes(), marks.tobytes(), int(sums[-1])))
            cols = zip(*out, strict=True) if out else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("__id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], schema.names)

    return ranges.mapInArrow(run, schema)


def _read(path: str, start: int, size: int) -> bytes:
    """Bytes of a file on any file system that the workers reach."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        return f.read_at(size, start)


def _overhang(before: bytes, after: bytes) -> int:
    """How many bytes of `after` complete a sign that begins in the last bytes `before`."""
    for back, c in enumerate(reversed(before[-3:]), 1):
        if c >= 0xC0:
            k = (2 if c < 0xE0 else 3 if c < 0xF0 else 4) - back
            return k if 0 < k <= len(after) and all(x & 0xC0 == 0x80 for x in after[:k]) else 0
        if c < 0x80:
            break
    return 0


_ESCAPED = regex.compile("[\udc80-\udcff]")


def _signs(raw: bytes) -> str:
    text = raw.decode("utf-8", "surrogateescape")
    return text if text.isascii() else _ESCAPED.sub("\x1a", text)


def split_files(spark: SparkSession, path: str, limit: int, overlap: int, *, folder: str = FOLDER, name: str = RANK_FILE, span: int = 1 << 20) -> DataFrame:
    """Pieces of every text file under `path`: path, piece_no, start_byte, end_byte, n_tokens, piece.

    Only names and lengths are listed; each range of `span` bytes is read by its offset where it is worked on, so a
    file is never loaded whole and its size is not bounded by what a row can hold.
    """
    check_room(limit, overlap)
    if span < 4 * HALO:
        raise ValueError(f"a range must have {4 * HALO} bytes or more")
    enc = SharedEncoder(spark, folder, name)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    listed = files.withColumn("__id", F.xxhash64("path"))
    ranges = listed.select("path", "__id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / span))).alias("range_no"))
    # listings are short and ranges many: one exchange of their names spreads the reading
    ranges = ranges.repartition("path", "range_no")
    schema = StructType([listed.schema["path"], *_TABLE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = enc.get()
        for b in batches:
            for i in range(b.num_rows):
                p, key, length, r = (b.column(c)[i].as_py() for c in ("path", "__id", "length", "range_no"))
                lead = 3 if r else 0
                raw = _read(p, r * span - lead, lead + span + 4 * HALO + 3)
                before, body = raw[:lead], raw[lead:]
                skip, end = _overhang(before, body[:3]), min(span, len(body))
                end += _overhang(body[:end], body[end : end + 3])
                last = (r + 1) * span >= length
                own, rest = _signs(body[skip:end]), _signs(body[end:])[:HALO]
                first = handover(own[:HALO])[0] if r else 0
                text, at, sums, marks = _tabulated(e, own, rest, first, last, limit)
                cols = ([p], [key], [r], [r * span + skip + len(own[:first].encode("utf-8"))], [text], [at.tobytes()], [sums.tobytes()], [marks.tobytes()], [int(sums[-1])])
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema.names)

    written = cut(ranges.mapInArrow(run, schema), "tables")
    keys = written.where("range_no = 0").select("path", "__id")
    got = _stitch(written.drop("path"), keys, "path", enc, limit, overlap, True)
    return got.withColumnsRenamed({"start_char": "start_byte", "end_char": "end_byte"})
