"""Byte-level byte-pair encoding with a public vocabulary.

Method: for each pre-token a priority queue of merge ranks over a doubly linked list of symbols, where entries
whose symbols have changed are skipped; decoding concatenates vocabulary strings.

Encoded pre-tokens are remembered. Long runs of letters (scripts without blanks) seldom repeat as a whole, so they
are divided first at character pairs that no vocabulary string spans: no merge can cross such a place, hence the
result is the same, and the short pieces do repeat.

Defined results: null and empty texts give no ids.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
RANK_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMORY = 1 << 19  # remembered pieces of a worker; beyond it the memory starts afresh


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: one base64 string and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.spans = regex.compile(PATTERN).finditer
        self.memo: dict[str, tuple[int, ...]] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.simple: dict[int, dict[str, tuple[int, int]]] = {}
        self.joins: dict[str, bool] = {}
        self.bridges = self._bridges()

    def _bridges(self) -> set[tuple[bytes, bool, bytes, bool]]:
        """Byte neighbourhoods that some vocabulary string spans, for strings beyond ASCII."""
        out = set()
        for t in self.ranks:
            if len(t) < 2 or t.isascii():
                continue
            for i in range(1, len(t)):
                a, b = t[:i], t[i:]
                lefts = [(a, False)] * (len(a) < 4) + [(a[-k:], True) for k in range(1, min(4, len(a)) + 1)]
                rights = [(b, False)] * (len(b) < 4) + [(b[:k], True) for k in range(1, min(4, len(b)) + 1)]
                out.update((*x, *y) for x in lefts for y in rights)
        return out

    def may_join(self, pair: str) -> bool:
        """Whether any vocabulary string spans the border between the two characters."""
        got = self.joins.get(pair)
        if got is None:
            if pair.isascii():
                got = True
            else:
                a, b = pair[0].encode("utf-8"), pair[1].encode("utf-8")
                lefts = [(a[-j:], False) for j in range(1, len(a))] + [(a, True)]
                rights = [(b[:j], False) for j in range(1, len(b))] + [(b, True)]
                got = any((*x, *y) in self.bridges for x in lefts for y in rights)
            self.joins[pair] = got
        return got

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one piece by repeated merging of the pair of lowest rank."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        ends = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once it is swallowed
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                queue.append((r, i, i + 2))
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != stop:
                continue  # stale: one of its symbols has been merged meanwhile
            ends[i], ends[middle] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(word[i : ends[stop]])
                if r is not None:
                    heapq.heappush(queue, (r, i, ends[stop]))
            p = before[i]
            if p >= 0:
                r = ranks.get(word[p:stop])
                if r is not None:
                    heapq.heappush(queue, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def parts(self, piece: str) -> list[str]:
        """The piece divided where no merge can cross."""
        out, start = [], 0
        join = self.may_join
        for i in range(1, len(piece)):
            if not join(piece[i - 1 : i + 1]):
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        memo = self.memo
        if len(memo) > MEMORY:
            memo.clear()
        if piece.isascii():
            got = self.merge(piece.encode("utf-8"))
        else:
            ids: list[int] = []
            for part in self.parts(piece):
                known = memo.get(part)
                if known is None:
                    known = self.merge(part.encode("utf-8"))
                    if len(part) < 64:
                        memo[part] = known
                ids.extend(known)
            got = tuple(ids)
        if len(piece) < 256:
            memo[piece] = got
        return got

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """The ids of a stretch that starts and ends where pre-tokens do."""
        memo, ids = self.memo, []
        for piece in self.pieces(unit):
            got = memo.get(piece)
            ids += got if got is not None else self.encode_piece(piece)
        return tuple(ids)

    def unit_ids(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of the text, unit by unit.

        No pre-token holds a blank behind another sign, so a text falls apart before each single blank; such a
        unit (a blank and a word with its punctuation) is remembered whole. A unit that ends with white space is
        joined with the next, since a run of white space is divided by what follows it.
        """
        units = self.units
        if len(units) > MEMORY:
            units.clear()
        pending: str | None = None
        chunks = iter(text.split(" "))
        head = next(chunks)
        if head:
            if head[-1].isspace():
                pending = head
            else:
                yield self.encode_unit(head)
        for chunk in chunks:
            if pending is None:
                got = units.get(chunk)
                if got is None:
                    if not chunk or chunk[-1].isspace():
                        pending = " " + chunk
                        continue
                    got = self.encode_unit(" " + chunk)
                    if len(chunk) < 32:
                        units[chunk] = got
                yield got
            else:
                pending += " " + chunk
                if chunk and not chunk[-1].isspace():
                    yield self.encode_unit(pending)
                    pending = None
        if pending:
            yield self.encode_unit(pending)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.unit_ids(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.unit_ids(text))) if text else 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


_ENCODERS: dict[int, Encoder] = {}


class SharedEncoder:
    """The rank file on its way to the workers; each worker builds one encoder from it."""

    def __init__(self, spark: SparkSession, folder: str = FOLDER, name: str = RANK_FILE) -> None:
        with open(os.path.join(folder, name), "rb") as f:
            raw = f.read()
        self.key = hash(raw)
        self.shared = spark.sparkContext.broadcast(raw)

    def get(self) -> Encoder:
        got = _ENCODERS.get(self.key)
        if got is None:
            got = _ENCODERS[self.key] = Encoder(read_ranks(self.shared.value))
        return got


def encode_column(df: DataFrame, column: str = "text", key: str = "doc_id", *, folder: str = FOLDER, name: str = RANK_FILE) -> DataFrame:
    """One row for each row of `df`: its key and `ids`."""
    enc = SharedEncoder(df.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = enc.get()
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = batch.slice(part, 512)
                flat: list[int] = []
                offsets = [0]
                for text in rows.column(1).to_pylist():
                    if text:
                        for ids in encoder.unit_ids(text):
                            flat += ids
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), ids], [key, "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType([df.schema[key]]).add("ids", ArrayType(IntegerType()))
    return df.select(F.col(key), F.col(column)).mapInArrow(run, schema)


def count_column(df: DataFrame, column: str = "text", key: str = "doc_id", *, folder: str = FOLDER, name: str = RANK_FILE) -> DataFrame:
    """One row for each row of `df`: its key and `n_tokens`."""
    enc = SharedEncoder(df.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = enc.get()
        for batch in batches:
            counts = [encoder.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [key, "n_tokens"])

    from pyspark.sql.types import LongType, StructType

    return df.select(F.col(key), F.col(column)).mapInArrow(run, StructType([df.schema[key]]).add("n_tokens", LongType()))
