"""Filling containers of a fixed capacity with items of varying size.

Method: dominance reduction, which fixes small sets of items that are at least as good as any alternative, shrinks
the instance; best fit places the rest in order of falling size.

Items count only by their size, and there are at most `capacity` sizes. So the plan is made on the histogram of
sizes, whose length does not depend on the number of items; it is a list of patterns (which sizes share a
container, and how many such containers there are). Every item then finds its container from its rank among the
items of its size. Ranks are found in groups of about BLOCK items: the more often a size occurs, the more groups it
has, so that no frequent size (the full parts of large items, say) is ranked in a few tasks.

An item is divided only if it alone exceeds the capacity: into full containers and one rest. Items of size 0 go to
container 0.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCK = 1 << 16  # items of one size that are ranked in one window, about


def _largest_at_most(sizes: list[int], x: int) -> int | None:
    """The largest of the ascending sizes that is at most x."""
    i = bisect_left(sizes, x + 1)
    return sizes[i - 1] if i else None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Takes fixed sets out of `counts`: (number of containers, sizes in each).

    For the largest size j, with r the room beside it: nothing fits, j stands alone; an item fills r exactly, the
    pair is fixed; no two items fit in r, j and the largest item that fits are fixed; no three fit and the largest
    fitting pair is largest in both members, the three are fixed. In each case any other container with j can be
    exchanged for the fixed one without loss.
    """
    fixed: list[tuple[int, tuple[int, ...]]] = []
    sizes = sorted(s for s, c in counts.items() if c > 0 and s > 0)

    def take(n: int, parts: tuple[int, ...]) -> None:
        fixed.append((n, parts))
        for s in parts:
            counts[s] -= n
            if not counts[s]:
                sizes.pop(bisect_left(sizes, s))

    stuck = 0
    while len(sizes) > stuck:
        j = sizes[-1 - stuck]
        room = capacity - j
        small, second = _two_smallest(sizes, counts, j)
        if small is None or small > room:
            take(counts[j], (j,))
            continue
        k = _largest_at_most(sizes, room)
        if k == j and counts[j] == 1:
            i = bisect_left(sizes, j)
            k = sizes[i - 1] if i else None
        both = counts[j] // 2 if k == j else min(counts[j], counts[k])
        if k == room or second is None or small + second > room:
            take(both, (j, k))
            continue
        # pairs beside j: those dominated by the largest item alone, or by the pair (k, largest item beside k)
        if 2 * small + second > room and k != j:
            beside = _largest_at_most(sizes, room - k)
            widest = _widest_pair(sizes, counts, room, j)
            if widest is not None and widest[0] + widest[1] <= k:
                take(both, (j, k))
                continue
            if beside is not None and beside != j and beside != k and widest is not None and beside >= widest[1] and k >= widest[0]:
                take(min(both, counts[beside]), (j, k, beside))
                continue
        stuck += 1
    return fixed


def _two_smallest(sizes: list[int], counts: dict[int, int], j: int) -> tuple[int | None, int | None]:
    """The two smallest items that one item of size j can be put with."""
    out: list[int] = []
    for s in sizes:
        out += [s] * min(2, counts[s] - (s == j))
        if len(out) >= 2:
            break
    return (out[0] if out else None), (out[1] if len(out) > 1 else None)


def _widest_pair(sizes: list[int], counts: dict[int, int], room: int, j: int) -> tuple[int, int] | None:
    """(largest first member, largest second member) over all pairs that fit in the room."""
    best_sum, big, second = None, 0, 0
    for i, a in enumerate(sizes):
        if a > room - sizes[0]:
            break
        b = _largest_at_most(sizes[: i + 1], room - a)
        if b is None:
            continue
        if b == a and counts[a] < 2:
            b = sizes[i - 1] if i else None
            if b is None:
                continue
        best_sum = max(best_sum or 0, a + b)
        big, second = max(big, a), max(second, b)
    return None if best_sum is None else (big, second)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit by falling size, in bulk: containers with the same content are handled as one group."""
    groups: dict[int, list[list]] = {}  # room -> [[number of containers, sizes]]
    rooms: list[int] = []

    def add(room: int, n: int, parts: tuple[int, ...]) -> None:
        if n <= 0:
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        for g in groups[room]:
            if g[1] == parts:
                g[0] += n
                return
        groups[room].append([n, parts])

    for size in sorted((s for s, c in counts.items() if c > 0 and s > 0), reverse=True):
        left = counts[size]
        at = bisect_left(rooms, size)
        for room in rooms[at:]:
            if not left:
                break
            each = room // size
            kept = []
            for n, parts in groups.pop(room):
                if not left:
                    kept.append([n, parts])
                    continue
                full = min(n, left // each)
                left -= full * each
                add(room - full_size(each, size), full, parts + (size,) * each)
                n -= full
                if n and left:
                    add(room - full_size(left, size), 1, parts + (size,) * left)
                    n, left = n - 1, 0
                if n:
                    kept.append([n, parts])
            i = bisect_left(rooms, room)
            if kept:
                groups.setdefault(room, []).extend(kept)
            if room not in groups and i < len(rooms) and rooms[i] == room:
                rooms.pop(i)
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            add(capacity - each * size, full, (size,) * each)
            if rest:
                add(capacity - rest * size, 1, (size,) * rest)
    return [(n, parts) for room in sorted(groups) for n, parts in groups[room]]


def full_size(k: int, size: int) -> int:
    return k * size


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns that place every item of the histogram: (number of containers, sizes in each)."""
    if any(s > capacity or s < 0 for s in histogram):
        raise ValueError("sizes must lie between 0 and the capacity")
    counts = {s: c for s, c in histogram.items() if s > 0 and c > 0}
    fixed = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(counts, capacity)


class Places:
    """From size and rank to container: for each size the first ranks of stretches, their containers and shares."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        container = 0
        for n, parts in patterns:
            for size in sorted(set(parts)):
                k = parts.count(size)
                start = used.get(size, 0)
                rows.setdefault(size, []).append((start, container, k))
                used[size] = start + n * k
            container += n
        self.containers = container
        self.rows = {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}

    def of(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            if size <= 0:
                continue
            at = np.flatnonzero(sizes == size)
            starts, bases, each = self.rows[int(size)]
            i = np.searchsorted(starts, ranks[at], side="right") - 1
            out[at] = bases[i] + (ranks[at] - starts[i]) // each[i]
        return out


def pack(items: DataFrame, capacity: int, *, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Assigns every item: key, part, start, size of the part (n_tokens), container.

    Part and start are 0 for items that are not divided. Null sizes count as 0.
    """
    base = items.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0)).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int")
    parts = base.select(key, "total", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    parts = parts.withColumn("start", F.col("part").cast("long") * capacity).withColumn("size", F.least(F.col("total") - F.col("start"), F.lit(capacity).cast("long"))).select(key, "part", "start", "size")
    counted = cut(parts.groupBy("size").agg(F.count(F.lit(1)).alias("n")), "sizes")  # at most capacity + 1 rows
    histogram = {r["size"]: r["n"] for r in counted.collect()}
    places = Places(plan(histogram, capacity))
    salts = counted.select("size", F.ceil(F.col("n") / BLOCK).alias("salts"))
    parts = parts.join(F.broadcast(salts), "size").withColumn("salt", F.pmod(F.xxhash64(key, "part"), F.col("salts"))).drop("salts")
    groups = parts.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = groups.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("size", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "part")) - 1).join(offsets, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = places.of(b.column("size").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("part"), b.column("start"), b.column("size"), pa.array(got)], [key, "part", "start", "n_tokens", "container"])

    from pyspark.sql.types import IntegerType, LongType, StructType

    schema = StructType([base.schema[key]]).add("part", IntegerType()).add("start", LongType()).add("n_tokens", LongType()).add("container", LongType())
    return ranked.select(key, "part", "start", "size", "rank").mapInArrow(run, schema)
