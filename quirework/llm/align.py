"""Sentence alignment of texts in two languages.

Method: lines are aligned by length first (beads of 1-1, 1-2, 2-1, ... with the usual length statistic); on the
confident 1-1 pairs word-translation counts are trained by expectation-maximisation (the first lexical translation
model); then each segment is realigned by dynamic programming on lexical gains. Lines left over are matched across
the page, so moved sentences are found too.

Counts of words and of word pairs are summed exactly, by 63-bit hashes of the words, first in each batch and then in
a shuffle, and all of them are kept. Up to MOST_PAIRS pairs and 2**WORD_BITS words are sent whole to the workers. Of
more, none is dropped: the rows are taken in parts, and each part is joined with the counts that its own words need
(`Model.over`), so both ways give the same rows and what a worker holds is bounded by its part.

Defined results: segments without translation, and empty lines, have no pairs; line numbers count empty lines.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, spread

MOST_PAIRS = 1 << 21  # word pairs sent whole to the workers, all languages together; more are joined
WORD_BITS = 20  # so many words, as a power of two, are sent whole
LANG_BITS = 24
LINKED = 0.3  # expected count from which two words are linked at all
PART = 1 << 20  # word pairs, or signs of text, of the rows that are joined with their counts at once
ROUNDS = 3
THETA = 0.42  # share of a line's weight that must be explained for a pair to pay
WHOLE = 0.72  # share by which a part must be explained to join a line that has a partner
ANCHOR_WEIGHT = 5.0
BAND = 200  # lines of a long side that the alignment by length looks at on either side of the equal share
STRETCH = 300  # lines of a segment aligned by one dynamic programme
LEFTOVER_BLOCK = 400  # left-over lines of a page that are compared at once, block against block

_ANCHOR = regex.compile(r"⟦[^⟧]*⟧|(?<![\p{Latin}\d])(?:\p{Lu}\p{Latin}*[\p{Lu}\d][\p{Latin}\d]*(?:-\d+)?|\p{Latin}+-\d+)(?![\p{Latin}\d])|\d+(?:[.,]\d+)*")
_WORD = regex.compile(r"[\p{Hangul}]+|[\p{Han}\p{Katakana}\p{Hiragana}ー]+|[\p{Thai}]+|[\p{Latin}]+|[\p{L}\p{M}]+")


@lru_cache(maxsize=200_000)
def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8"), digest_size=8).digest(), "big") >> 1


def tokens(line: str, target: bool) -> tuple[list[str], list[str]]:
    """Words and anchors (tokens, names, figures) of a line."""
    anchors = []

    def take(m: regex.Match) -> str:
        g = m.group()
        anchors.append("#" + re.sub(r"[.,](?=\d)", "", g) if g[0].isdigit() else "#" + g.lower())
        return " "

    rest = _ANCHOR.sub(take, line)
    words = []
    for w in _WORD.findall(rest):
        c = w[0]
        if "가" <= c <= "힣":
            words.append(w[:2])
        elif "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or c >= "\U00020000":
            words.extend(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        elif "฀" <= c <= "๿":
            words.extend(w[i : i + 4] for i in range(0, max(1, len(w) - 3), 2))
        elif len(w) > 1 or not w.isascii():
            if target and w.isascii():
                anchors.append("#" + w.lower())
            else:
                words.append(w.lower())
    return list(dict.fromkeys(words)), list(dict.fromkeys(anchors))


def _lines(text: str | None) -> list[tuple[int, str]]:
    return [(i, s) for i, s in enumerate((text or "").split("\n")) if s.strip()]


def _width(line: str) -> float:
    """Length in units comparable between scripts."""
    n = len(line)
    # a sign of the wide scripts takes three bytes
    return n if line.isascii() else n + 0.6 * (len(line.encode("utf-8")) - n)


# Lines on either side of a bead, and its cost beside the length statistic.
_BEADS = ((1, 1, 0.0), (1, 0, 4.5), (0, 1, 4.5), (2, 1, 2.3), (1, 2, 2.3), (2, 2, 4.4))


def length_beads(a: list[float], b: list[float]) -> list[tuple[int, int, int, int]]:
    """Beads (i, di, j, dj) of the cheapest alignment by length; of long sides within a band around equal shares of the length."""
    n, m = len(a), len(b)
    ratio = (sum(b) or 1.0) / (sum(a) or 1.0)
    xs = [0.0, *accumulate(v * ratio for v in a)]
    ys = [0.0, *accumulate(b)]
    far = 1e9
    if not n or max(n, m) <= BAND:
        first, stop = [0] * (n + 1), [m + 1] * (n + 1)
    else:
        middle = [bisect_left(ys, x, 0, m) for x in xs[:-1]] + [m]
        first = [max(0, j - BAND) for j in middle]
        # neighbouring rows meet, however much one line holds
        stop = [min(m, max(j + BAND, first[min(n, i + 1)])) + 1 for i, j in enumerate(middle)]
    cost = [[far] * (v - u) for u, v in zip(first, stop, strict=True)]
    back = [bytearray(v - u) for u, v in zip(first, stop, strict=True)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        if i:
            cost[i - 1] = []
        for j in range(first[i], stop[i]):
            here = cost[i][j - first[i]]
            if here >= far:
                continue
            for k, (di, dj, prior) in enumerate(_BEADS):
                u, v = i + di, j + dj
                if u > n or v < first[u] or v >= stop[u]:
                    continue
                c = here + prior
                if di and dj:
                    x, y = xs[u] - xs[i], ys[v] - ys[j]
                    c += min(12.0, (y - x) ** 2 / (6.8 * max(2.0, x + y)))
                if c < cost[u][v - first[u]]:
                    cost[u][v - first[u]] = c
                    back[u][v - first[u]] = k
    out, i, j = [], n, m
    while i or j:
        di, dj, _ = _BEADS[back[i][j - first[i]]]
        i, j = i - di, j - dj
        out.append((i, di, j, dj))
    return out[::-1]


def confident_pairs(lang: str, source: str | None, target: str | None) -> list[tuple[list[int], list[int]]]:
    """Word hashes of line pairs that length and anchors agree on; words of each language pair count apart."""
    s, t = _lines(source), _lines(target)
    if not s or not t:
        return []
    st = [tokens(x, False) for _, x in s]
    tt = [tokens(x, True) for _, x in t]
    beads = length_beads([_width(x) for _, x in s], [_width(x) for _, x in t])
    even = all(di == dj == 1 for _, di, _, dj in beads)
    out = []
    for i, di, j, dj in beads:
        if di == dj == 1:
            a, b = set(st[i][1]), set(tt[j][1])
            if (a and a == b) or (even and len(a ^ b) <= 1):
                out.append(([_hash(f"{lang}:{w}") for w in st[i][0]], [_hash(f"{lang}>{w}") for w in tt[j][0]]))
    return out


def _key(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """One 64-bit key for each pair of word hashes."""
    x = (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (t.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_MORE = np.uint64(1 << 8)


class Slots:
    """Counts by key, all of them: the first key of a slot lies in it, the others in a sorted list."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.bits = max(10, int(2 * max(1, len(keys)) - 1).bit_length())
        # the lowest bit of the slot's number tells instead whether the list holds keys of the slot; an empty slot
        # holds a key that belongs to another one
        self.keys = ((np.arange(1 << self.bits, dtype=np.uint64) ^ np.uint64(2)) << np.uint64(8)) & ~_MORE
        self.counts = np.zeros(1 << self.bits, np.float32)
        at = self._at(keys)
        _, first = np.unique(at, return_index=True)
        self.keys[at[first]] = keys[first] & ~_MORE
        self.counts[at[first]] = counts[first]
        others = np.ones(len(keys), bool)
        others[first] = False
        self.keys[at[others]] |= _MORE
        order = np.argsort(keys[others])
        self.more, self.more_counts = keys[others][order], counts[others][order].astype(np.float32)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(8)) & np.uint64((1 << self.bits) - 1)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        flat = keys.ravel()
        at = self._at(flat)
        held = self.keys[at]
        same = ((held ^ flat) | _MORE) == _MORE
        out = np.zeros(len(flat), np.float32)
        found = np.flatnonzero(same)
        out[found] = self.counts[at[found]]
        if len(self.more):
            ask = np.flatnonzero((held & _MORE).astype(bool) & ~same)
            where = np.minimum(np.searchsorted(self.more, flat[ask]), len(self.more) - 1)
            out[ask] = np.where(self.more[where] == flat[ask], self.more_counts[where], np.float32(0))
        return out.reshape(keys.shape)


def _lang_slot(lang: str) -> int:
    return zlib.crc32(lang.encode()) & ((1 << LANG_BITS) - 1)


class Table:
    """Expected counts of word pairs, and of words on either side; of rows (kind, a, b, n) as `train` counts them."""

    def __init__(self, rows: pa.Table | None = None, totals: dict[int, float] | None = None) -> None:
        self.trained = rows is not None
        self.totals = totals or {}
        of = {}
        for kind in "pst":
            some = rows.filter(pc.equal(rows["kind"], kind)) if self.trained else None
            a, b, n = (some[c].to_numpy() if some is not None else np.empty(0, x) for c, x in (("a", np.int64), ("b", np.int64), ("n", np.float64)))
            a, b = a.astype(np.uint64), b.astype(np.uint64)
            of[kind] = Slots(_key(a, b) if kind == "p" else a, n)
        self.pairs, self.source, self.target = of["p"], of["s"], of["t"]

    def total(self, lang: str) -> float:
        return max(1.0, self.totals.get(_lang_slot(lang), 1.0))

    def association(self, lang: str, s: np.ndarray, t: np.ndarray, ns: np.ndarray, nt: np.ndarray) -> np.ndarray:
        """How strongly each source word asks for each target word, from 0 to 1; `ns` and `nt` are their counts."""
        out = np.zeros((len(s), len(t)))
        if not self.trained:
            return out
        c = self.pairs.get(_key(s[:, None], t[None, :]))
        i, j = np.nonzero(c >= LINKED)  # few pairs are linked at all
        c, a, b = c[i, j], ns[i], nt[j]
        lift = np.log(c / np.maximum(a * b / self.total(lang), 1e-6))
        p = c / np.maximum(np.maximum(a, b), 1e-6)
        out[i, j] = np.clip(np.maximum(lift / 4.0, 0) * np.minimum(1.0, 0.35 + 2 * p), 0.0, 1.0)
        return out

    def weight(self, lang: str, n: np.ndarray) -> np.ndarray:
        """Weights of words by their counts."""
        return np.clip(np.log(self.total(lang) / np.maximum(n, 1.0)) / 1.6, 0.15, 4.0)


def _summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the sum of the weights of each, and which of them each key is."""
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, weights=weights, minlength=len(found)), where


def _combos(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All source words of a batch and all target words; of every word pair its row and the places of its two words."""
    sl, tl = batch.column(0), batch.column(1)
    sv, so = sl.values.to_numpy(), sl.offsets.to_numpy()
    tv, to = tl.values.to_numpy(), tl.offsets.to_numpy()
    ns, nt = np.diff(so), np.diff(to)
    combos = ns * nt
    pair = np.repeat(np.arange(len(ns)), combos)
    within = np.arange(int(combos.sum())) - np.repeat(np.cumsum(combos) - combos, combos)
    return sv, tv, pair, so[pair] + within // nt[pair], to[pair] + within % nt[pair]


def _expect(table: Table, batch: pa.RecordBatch, sums: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the word pairs of a batch with their expected counts.

    `sums` gets the counts of the batch by kind (s, t: words; n: words of a language), and what they count as `s a`,
    `t a`, `n a`; the words of the pairs as `p a` and `p b`.
    """
    sv, tv, _, spos, tpos = _combos(batch)
    s, t = sv[spos], tv[tpos]
    keys = _key(s, t)
    if table.trained:
        p = table.pairs.get(keys) / np.maximum(table.source.get(sv.astype(np.uint64)), 1e-6)[spos]
    else:
        p = np.ones(len(keys), np.float32)
    share = p / (np.bincount(tpos, weights=p, minlength=len(tv)) + 1e-12)[tpos]
    so, to = batch.column(0).offsets.to_numpy(), batch.column(1).offsets.to_numpy()
    each = np.bincount(spos, weights=share, minlength=len(sv))
    sums["s a"], sums["s"], _ = _summed(sv[so[0] : so[-1]], each[so[0] : so[-1]])
    sums["t a"], sums["t"], _ = _summed(tv[to[0] : to[-1]])
    sums["n a"], sums["n"], _ = _summed(batch.column(2).to_numpy(), np.diff(to))
    found, counts, where = _summed(keys, share)
    one = np.empty(len(found), np.int64)
    one[where] = np.arange(len(keys))
    sums["p a"], sums["p b"] = s[one], t[one]
    return found, counts


_COUNT = "kind string, a bigint, b bigint, n double"


def _rows(kind: str, a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    a, b = a.astype(np.int64), np.zeros(len(a), np.int64) if b is None else b
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(n.astype(np.float64))], ["kind", "a", "b", "n"])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch in pieces of about 4 * PART word pairs, each with the index of its first row; long lines have many."""
    ns, nt = (np.diff(batch.column(i).offsets.to_numpy()).astype(np.int64) for i in (0, 1))
    piece = np.cumsum(ns * nt) // (4 * PART)
    starts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for x, y in zip(starts, starts[1:], strict=False):
        if x < y:
            yield x, batch.slice(x, y - x)


def _count(table: Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, batch in (p for whole in batches for p in _pieces(whole)):
        sums: dict[str, np.ndarray] = {}
        _, n = _expect(table, batch, sums)
        yield _rows("p", sums["p a"], sums["p b"], n)
        for kind in "stn":
            yield _rows(kind, sums[f"{kind} a"], None, sums[kind])


def _parted(rows: DataFrame, weight: Column) -> DataFrame:
    """The rows with the number of their part; a part has rows of one task, up to a weight of about PART."""
    weighed = rows.withColumn("part", weight.cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            w = done + np.cumsum(batch.column("part").to_numpy())
            done = int(w[-1]) if len(w) else done
            yield batch.set_column(batch.num_columns - 1, "part", pa.array(first + w // PART, pa.int64()))

    return cut(weighed.mapInArrow(run, weighed.schema), "parts")


class Model:
    """Counts of words and word pairs for the workers: a table sent whole, or, of many, the counts to join."""

    def __init__(self, spark: SparkSession, counts: DataFrame | None = None, most: int = MOST_PAIRS) -> None:
        self.counts = counts
        self.totals: dict[int, float] = {}
        table = Table()
        whole = True
        if counts is not None:
            self.totals = {r["a"]: r["n"] for r in counts.where("kind = 'n'").collect()}
            size = {r["kind"]: r["count"] for r in counts.groupBy("kind").count().collect()}
            whole = size.get("p", 0) <= most and size.get("s", 0) + size.get("t", 0) <= 1 << WORD_BITS
            table = Table(counts.where("kind <> 'n'").toArrow(), self.totals) if whole else table
        self.shared = spark.sparkContext.broadcast(table) if whole else None

    def release(self) -> None:
        if self.shared is not None:
            self.shared.unpersist()

    def over(self, rows: DataFrame, run: Callable, schema: str, weight: Column, need: Callable, linked: bool) -> DataFrame:
        """`run(table, batches)` over the rows, with a table that holds all counts they need.

        `need(batch)` gives, row by row of a batch, kinds with their words: (index of the row, kind, a, b). With
        `linked` those are single words, and all pairs between them are meant.
        """
        if self.shared is not None:
            shared = self.shared
            return rows.mapInArrow(lambda batches: run(shared.value, batches), schema)
        parted = rows if "part" in rows.columns else _parted(rows, weight)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = batch.column("part").to_numpy()
                for kind, row, a, b in need(batch):
                    of = pa.table({"part": part[row], "a": a, "b": b}).group_by(["part", "a", "b"]).aggregate([]).combine_chunks()
                    of = of.append_column("kind", pa.array([kind] * len(of), pa.string())).select(["part", "kind", "a", "b"])
                    yield from of.to_batches()

        asked = parted.mapInArrow(ask, "part bigint, kind string, a bigint, b bigint").distinct()
        if linked:
            asked = cut(asked, "asked")
        got = asked.join(self.counts, ["kind", "a", "b"])
        if linked:
            source = asked.where("kind = 's'").select("part", "a")
            target = asked.where("kind = 't'").select("part", F.col("a").alias("b"))
            got = got.unionByName(self.counts.where("kind = 'p'").join(source, "a").join(target, ["part", "b"]))
        totals = self.totals

        def joined(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches(run(Table(right, totals), iter(left.combine_chunks().to_batches())))

        return parted.groupBy("part").cogroup(got.select("part", "kind", "a", "b", "n").groupBy("part")).applyInArrow(joined, schema)


def _need_pairs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    for first, piece in _pieces(batch):
        sv, tv, row, spos, tpos = _combos(piece)
        yield "p", first + row, sv[spos], tv[tpos]
        yield "s", first + row, sv[spos], np.zeros(len(row), np.int64)


def train(pairs: DataFrame, rounds: int = ROUNDS, most: int = MOST_PAIRS) -> Model:
    """Expectation-maximisation over `pairs` (src, tgt: arrays of word hashes; lang: slot), one job a round."""
    spark = pairs.sparkSession
    model = Model(spark)
    for k in range(rounds):
        if model.shared is None and "part" not in pairs.columns:
            pairs = _parted(pairs, F.size("src").cast("bigint") * F.size("tgt"))
        counts = model.over(pairs, _count, _COUNT, F.lit(1), _need_pairs, False).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
        if k == rounds - 1:
            counts = counts.where((F.col("kind") != "p") | (F.col("n") >= LINKED))  # others are never looked at
        counts = cut(counts, "counts")
        model.release()
        model = Model(spark, counts, most)
    return model


class Side:
    """The lines of one side with their hashed tokens laid end to end."""

    def __init__(self, lang: str, lines: list[tuple], target: bool) -> None:
        self.lang = lang
        self.keys = [x[:-1] for x in lines]
        toks = [tokens(x[-1], target) for x in lines]
        self.words = [([_hash(f"{lang}>{w}" if target else f"{lang}:{w}") for w in ws], [_hash(a) for a in an]) for ws, an in toks]
        flat, anchor, starts = [], [], []
        for ws, an in self.words:
            starts.append(len(flat))
            flat.extend(ws)
            anchor.extend([False] * len(ws))
            flat.extend(an)
            anchor.extend([True] * len(an))
            if not ws and not an:
                flat.append(1)
                anchor.append(False)
        self.starts = np.array(starts, np.int64)
        self.flat = np.array(flat, np.uint64)
        self.anchor = np.array(anchor, bool)


def gain_matrices(table: Table, a: Side, b: Side) -> dict:
    ns, nt = table.source.get(a.flat), table.target.get(b.flat)
    assoc = table.association(a.lang, a.flat, b.flat, ns, nt)
    if a.anchor.any() or b.anchor.any():
        assoc[a.anchor, :] = 0.0
        assoc[:, b.anchor] = 0.0
        assoc[(a.flat[:, None] == b.flat[None, :]) & a.anchor[:, None] & b.anchor[None, :]] = 1.0
    wa = np.where(a.anchor, ANCHOR_WEIGHT, table.weight(a.lang, ns))
    wb = np.where(b.anchor, ANCHOR_WEIGHT, table.weight(a.lang, nt))
    return {
        "col": np.maximum.reduceat(assoc, a.starts, axis=0),  # source lines x target tokens
        "row": np.maximum.reduceat(assoc, b.starts, axis=1),  # source tokens x target lines
        "wa": wa,
        "wb": wb,
    }


def _gain_col(col: np.ndarray, wb: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat((col - THETA) * wb, starts, axis=1)


def _gain_row(row: np.ndarray, wa: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat((row - THETA) * wa[:, None], starts, axis=0)


def align_sides(table: Table, a: Side, b: Side, keep: dict | None = None) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs of line indexes by dynamic programming, and the lines left over on both sides; `keep` gets the matrices."""
    n, m = len(a.keys), len(b.keys)
    if not n or not m:
        return [], list(range(n)), list(range(m))
    g = gain_matrices(table, a, b)
    if keep is not None:
        keep.update(g)
    col, row, wa, wb = g["col"], g["row"], g["wa"], g["wb"]
    ct, rt = _gain_col(col, wb, b.starts), _gain_row(row, wa, a.starts)
    gains = {(1, 1): ct + rt}
    for k in (2, 3):
        if n >= k:
            c = np.maximum.reduce([col[i : n - k + 1 + i] for i in range(k)])
            gains[k, 1] = _gain_col(c, wb, b.starts) + sum(rt[i : n - k + 1 + i] for i in range(k))
        if m >= k:
            r = np.maximum.reduce([row[:, i : m - k + 1 + i] for i in range(k)])
            gains[1, k] = _gain_row(r, wa, a.starts) + sum(ct[:, i : m - k + 1 + i] for i in range(k))
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    back = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    lists = {k: v.tolist() for k, v in gains.items()}
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            top, how = -1e18, (0, 0)
            if i:
                top, how = best[i - 1][j], (1, 0)
            if j and best[i][j - 1] > top:
                top, how = best[i][j - 1], (0, 1)
            for (di, dj), v in lists.items():
                if i >= di and j >= dj:
                    x = v[i - di][j - dj]
                    if x > 0 and best[i - di][j - dj] + x > top:
                        top, how = best[i - di][j - dj] + x, (di, dj)
            best[i][j], back[i][j] = top, how
    pairs, i, j = [], n, m
    free_a, free_b = set(range(n)), set(range(m))
    while i or j:
        di, dj = back[i][j]
        if di and dj:
            for x in range(i - di, i):
                for y in range(j - dj, j):
                    pairs.append((x, y))
            free_a -= set(range(i - di, i))
            free_b -= set(range(j - dj, j))
        i, j = i - di, j - dj
    return pairs, sorted(free_a), sorted(free_b)


def _slices(side: Side) -> list[slice]:
    ends = np.append(side.starts[1:], len(side.flat))
    return [slice(int(a), int(b)) for a, b in zip(side.starts, ends, strict=True)]


def _pick(side: Side, lines: list[int]) -> Side:
    """Some lines of a side, in their order."""
    if len(lines) == len(side.keys):
        return side
    out = object.__new__(Side)
    ends = np.append(side.starts[1:], len(side.flat))
    spans = [np.arange(side.starts[i], ends[i]) for i in lines]
    at = np.concatenate(spans)
    out.lang, out.keys = side.lang, [side.keys[i] for i in lines]
    out.starts = np.cumsum([0, *map(len, spans[:-1])]).astype(np.int64)
    out.flat, out.anchor = side.flat[at], side.anchor[at]
    return out


def _gains(table: Table, a: Side, b: Side, rows: list[int], cols: list[int], made: dict | None = None) -> Iterator[tuple[float, int, int, np.ndarray, np.ndarray]]:
    """(gain, i, j, row, col) of all pairs of the lines `rows` and `cols` that could pay, block by block."""
    single = max(len(rows), len(cols)) <= LEFTOVER_BLOCK
    for x in range(0, len(rows), LEFTOVER_BLOCK):
        ri = rows[x : x + LEFTOVER_BLOCK]
        pa_ = _pick(a, ri)
        sa = _slices(pa_)
        for y in range(0, len(cols), LEFTOVER_BLOCK):
            ci = cols[y : y + LEFTOVER_BLOCK]
            pb = _pick(b, ci)
            g = made or gain_matrices(table, pa_, pb)
            gains = _gain_col(g["col"], g["wb"], pb.starts) + _gain_row(g["row"], g["wa"], pa_.starts)
            sb = _slices(pb)
            weight = np.add.reduceat(g["wa"], pa_.starts)[:, None] + np.add.reduceat(g["wb"], pb.starts)[None, :]
            for i, j in zip(*np.nonzero(gains > -0.5 * THETA * weight), strict=True):
                row, col = g["row"][sa[i], j], g["col"][i, sb[j]]
                # of several blocks copies, so that no matrix outlives its block
                yield float(gains[i, j]), ri[i], ci[j], row if single else row.copy(), col if single else col.copy()


def match_leftovers(table: Table, a: Side, b: Side, given: list[tuple[int, int]] | None = None, made: dict | None = None) -> list[tuple[int, int]]:
    """Greedy pairs of lines in any order; a line may take several partners while each explains more of it.

    `given` pairs hold already; only pairs with a line that is still free are added. `made` are the matrices of both
    whole sides, where they are at hand.

    Every free line is compared with every line of the other side, block by block; only pairs that could pay are kept.
    """
    if not a.keys or not b.keys:
        return []
    all_a, all_b = list(range(len(a.keys))), list(range(len(b.keys)))
    if max(len(all_a), len(all_b)) <= LEFTOVER_BLOCK or not given:
        found = list(_gains(table, a, b, all_a, all_b, made if max(len(all_a), len(all_b)) <= LEFTOVER_BLOCK else None))
    else:
        # pairs of two taken lines are only asked for where they hold
        used_a, used_b = {i for i, _ in given}, {j for _, j in given}
        found = list(_gains(table, a, b, [i for i in all_a if i not in used_a], all_b))
        found += _gains(table, a, b, sorted(used_a), [j for j in all_b if j not in used_b])
        ordered, pairs = sorted(set(given)), set(given)
        for x in range(0, len(ordered), LEFTOVER_BLOCK):
            some = ordered[x : x + LEFTOVER_BLOCK]
            found += [f for f in _gains(table, a, b, sorted({i for i, _ in some}), sorted({j for _, j in some})) if (f[1], f[2]) in pairs]
    wa = np.where(a.anchor, ANCHOR_WEIGHT, table.weight(a.lang, table.source.get(a.flat)))
    wb = np.where(b.anchor, ANCHOR_WEIGHT, table.weight(a.lang, table.target.get(b.flat)))
    sa, sb = _slices(a), _slices(b)
    seen_a, seen_b = np.zeros(len(a.flat)), np.zeros(len(b.flat))
    held = set(given or ())
    taken_a, taken_b = {i for i, _ in held}, {j for _, j in held}
    for _, i, j, row, col in found:
        if (i, j) in held:
            seen_a[sa[i]] = np.maximum(seen_a[sa[i]], row)
            seen_b[sb[j]] = np.maximum(seen_b[sb[j]], col)
    out = []
    for gain, i, j, row, col in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        if i in taken_a and j in taken_b:
            continue
        u, v = wa[sa[i]], wb[sb[j]]
        if i not in taken_a and j not in taken_b:
            ok = gain > 0 or (len(v) >= 3 and col @ v > WHOLE * v.sum())  # or a part that is rendered wholly
        elif j in taken_b:  # another source line for a joined target line
            ok = row @ u > 0.6 * u.sum() and np.maximum(col - seen_b[sb[j]], 0) @ v > 0.25 * v.sum()
        else:  # another part of a divided source line
            ok = col @ v > (WHOLE if given else 0.6) * v.sum() and np.maximum(row - seen_a[sa[i]], 0) @ u > 0.2 * u.sum()
        if ok:
            out.append((i, j))
            taken_a.add(i)
            taken_b.add(j)
            seen_a[sa[i]] = np.maximum(seen_a[sa[i]], row)
            seen_b[sb[j]] = np.maximum(seen_b[sb[j]], col)
    return out


def align_segment(table: Table, lang: str, source: str | None, target: str | None) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Line pairs of one segment and its left-over line numbers; a line rendered out of order is paired too."""
    s, t = _lines(source), _lines(target)
    pairs: list[tuple[int, int]] = []
    fa: list[int] = []
    fb: list[int] = []
    # a giant segment is aligned in stretches of equal share; what lies beyond its stretch, parts of joined and
    # divided lines too, is left over and met below on the whole sides
    stretches = max(1, -(-max(len(s), len(t)) // STRETCH))
    kept: dict = {}
    a = b = None
    for k in range(stretches):
        i, i2 = len(s) * k // stretches, len(s) * (k + 1) // stretches
        j, j2 = len(t) * k // stretches, len(t) * (k + 1) // stretches
        a, b = Side(lang, s[i:i2], False), Side(lang, t[j:j2], True)
        got, ga, gb = align_sides(table, a, b, kept)
        pairs += [(i + x, j + y) for x, y in got]
        fa += [i + x for x in ga]
        fb += [j + y for y in gb]
    if fa or fb:
        if stretches > 1:
            a, b, kept = Side(lang, s, False), Side(lang, t, True), {}
        pairs += match_leftovers(table, a, b, pairs, kept)
        used_a, used_b = {i for i, _ in pairs}, {j for _, j in pairs}
        fa, fb = [i for i in range(len(s)) if i not in used_a], [j for j in range(len(t)) if j not in used_b]
    return [(s[i][0], t[j][0]) for i, j in pairs], [s[i][0] for i in fa], [t[j][0] for j in fb]


def _need_words(kind: str, texts: list[tuple[str, list[str]]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The words of the lines of one side, for each row of a batch."""
    row, words = [], []
    for i, (lang, some) in enumerate(texts):
        got = set(Side(lang, [line for text in some for line in _lines(text)], kind == "t").flat.tolist())
        row.extend([i] * len(got))
        words.extend(got)
    return kind, np.array(row, np.int64), np.array(words, np.int64), np.zeros(len(words), np.int64)


_PAIR = "doc_id string, src_seg string, src_line int, tgt_seg string, tgt_line int"


def align_pages(segments: DataFrame) -> DataFrame:
    """Aligned lines of `segments` (doc_id, page, seg_id, lang, source, translated).

    Gives doc_id, src_seg, src_line, tgt_seg, tgt_line. Repeated segments count once.
    """
    segs = segments.select("doc_id", "page", "seg_id", "lang", "source", "translated").where(F.col("source").isNotNull() & F.col("translated").isNotNull())
    segs = segs.dropDuplicates(["doc_id", "page", "seg_id"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            got = [(*p, _lang_slot(x[0])) for x in zip(d["lang"], d["source"], d["translated"], strict=True) for p in confident_pairs(*x)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.int32())], ["src", "tgt", "lang"])

    # segments are aligned one by one: how they lie in tasks is left to their size
    segs = spread(cut(segs, "lines"))
    confident = cut(segs.select("lang", "source", "translated").mapInArrow(collect, "src array<bigint>, tgt array<bigint>, lang int"), "confident")
    model = train(confident, most=MOST_PAIRS)

    def inside(tab: Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            out: list[tuple] = []
            for doc, page, seg, lang, src, tgt in zip(d["doc_id"], d["page"], d["seg_id"], d["lang"], d["source"], d["translated"], strict=True):
                pairs, fa, fb = align_segment(tab, lang, src, tgt)
                out.extend((doc, page, seg, i, seg, j, lang, None) for i, j in pairs)
                sl, tl = src.split("\n"), tgt.split("\n")
                out.extend((doc, page, seg, i, None, None, lang, sl[i]) for i in fa)
                out.extend((doc, page, None, None, seg, j, lang, tl[j]) for j in fb)
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["doc_id", "page", "src_seg", "src_line", "tgt_seg", "tgt_line", "lang", "text"])

    def words_inside(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        langs = batch.column("lang").to_pylist()
        yield _need_words("s", [(lang, [x or ""]) for lang, x in zip(langs, batch.column("source").to_pylist(), strict=True)])
        yield _need_words("t", [(lang, [x or ""]) for lang, x in zip(langs, batch.column("translated").to_pylist(), strict=True)])

    signs = F.length("source").cast("bigint") + F.length("translated")
    met = cut(model.over(segs, inside, _PAIR.replace("doc_id string,", "doc_id string, page int,") + ", lang string, text string", signs, words_inside, True), "aligned")
    paired = met.where(F.col("src_seg").isNotNull() & F.col("tgt_seg").isNotNull())
    free = met.where(F.col("text").isNotNull())
    pages = free.groupBy("doc_id", "page", "lang").agg(F.sort_array(F.collect_list(F.struct("src_seg", "src_line", "tgt_seg", "tgt_line", "text"))).alias("rest"))
    both = pages.where(F.exists("rest", lambda x: x["src_seg"].isNotNull()) & F.exists("rest", lambda x: x["tgt_seg"].isNotNull()))

    def across(tab: Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, lang, rest in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("rest").to_pylist(), strict=True):
                src = [(r["src_seg"], r["src_line"], r["text"]) for r in rest if r["src_seg"] is not None]
                tgt = [(r["tgt_seg"], r["tgt_line"], r["text"]) for r in rest if r["tgt_seg"] is not None]
                a, b = Side(lang, src, False), Side(lang, tgt, True)
                out.extend((doc, *a.keys[i], *b.keys[j]) for i, j in match_leftovers(tab, a, b))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], ["doc_id", "src_seg", "src_line", "tgt_seg", "tgt_line"])

    def words_across(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        langs, rests = batch.column("lang").to_pylist(), batch.column("rest").to_pylist()
        for kind, side in (("s", "src_seg"), ("t", "tgt_seg")):
            yield _need_words(kind, [(lang, [r["text"] for r in rest if r[side] is not None]) for lang, rest in zip(langs, rests, strict=True)])

    signs = F.aggregate("rest", F.lit(0).cast("bigint"), lambda n, r: n + F.length(r["text"]))
    moved = model.over(both, across, _PAIR, signs, words_across, True)
    return paired.select("doc_id", "src_seg", "src_line", "tgt_seg", "tgt_line").unionByName(moved)
