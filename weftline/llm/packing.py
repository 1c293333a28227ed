"""Filling containers of fixed capacity with items of varying length.

Large-item matching over the histogram of sizes. Items above a third of the capacity go in
pairs, at most two to a bin, matched greedily: the largest takes the largest partner that
still fits. Smaller items then fill the gaps best-fit: the largest that fits goes first. Sizes are
whole numbers up to the capacity, so the plan works on how many items of each size there
are, not on items, and a pattern that repeats is planned once with its number of repeats. The
plan is therefore bounded by the capacity at any number of items; items find their places by
their exact rank among those of their size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.positions import grouped_positions
from weftline.session import cut, ship


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(pattern, repeats)`` pairs: a pattern maps sizes to how many of them a bin holds.

    ``counts`` maps sizes from 1 to ``capacity`` to their numbers of items; every item is placed
    exactly once.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    sizes = sorted(left)
    large = [s for s in sizes if 3 * s > capacity]
    small = [s for s in sizes if 3 * s <= capacity]
    open_bins: list[tuple[dict[int, int], int, int]] = []  # pattern, gap, repeats

    def take(of: list[int], s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            del of[bisect_left(of, s)]

    while large:
        s = large[-1]
        at = bisect_right(large, capacity - s)
        partner = large[at - 1] if at else None
        if partner is None:
            n = left[s]
            open_bins.append(({s: 1}, capacity - s, n))
            take(large, s, n)
        elif partner == s:
            n = left[s] // 2
            if n:
                open_bins.append(({s: 2}, capacity - 2 * s, n))
                take(large, s, 2 * n)
            else:  # a single one is left; the next smaller is its partner
                partner = large[at - 2] if at > 1 else None
                open_bins.append(({s: 1} | ({partner: 1} if partner else {}), capacity - s - (partner or 0), 1))
                take(large, s, 1)
                if partner:
                    take(large, partner, 1)
        else:
            n = min(left[s], left[partner])
            open_bins.append(({s: 1, partner: 1}, capacity - s - partner, n))
            take(large, s, n)
            take(large, partner, n)

    # Best fit, smallest gaps first, so that tight gaps take the items that close them.
    done: list[tuple[dict[int, int], int]] = []
    gaps: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for pattern, gap, n in open_bins:
        gaps[gap].append((pattern, n))
    order = sorted(gaps)

    def put(pattern: dict[int, int], gap: int, n: int) -> None:
        if gap not in gaps:
            insort(order, gap)
        gaps[gap].append((pattern, n))

    while order:
        gap = order.pop(0)
        for pattern, n in gaps.pop(gap):
            at = bisect_right(small, gap)
            if not at:
                done.append((pattern, n))
                continue
            s = small[at - 1]
            each = min(gap // s, left[s])
            bins = min(n, left[s] // each)
            put({**pattern, s: pattern.get(s, 0) + each}, gap - each * s, bins)
            if n > bins:
                put(pattern, gap, n - bins)
            take(small, s, each * bins)
    while small:  # bins of small items only
        s = small[-1]
        each = min(capacity // s, left[s])
        bins = left[s] // each
        take(small, s, each * bins)
        pending = [({s: each}, capacity - each * s, bins)]
        while pending:
            pattern, gap, n = pending.pop()
            at = bisect_right(small, gap)
            if not at:
                done.append((pattern, n))
                continue
            x = small[at - 1]
            fit = min(gap // x, left[x])
            same = min(n, left[x] // fit)
            pending.append(({**pattern, x: fit}, gap - fit * x, same))
            if n > same:
                pending.append((pattern, gap, n - same))
            take(small, x, fit * same)
    return done


def pack(items: DataFrame, id_column: str, size_column: str, capacity: int) -> DataFrame:
    """``(id, piece, offset, length, bin_id)``: ``pack_each`` for one capacity."""
    return pack_each(items, id_column, size_column, [capacity]).drop("capacity")


def pack_each(items: DataFrame, id_column: str, size_column: str, capacities: Sequence[int]) -> DataFrame:
    """``(capacity, id, piece, offset, length, bin_id)``: where each item, or each piece of a split one, goes, for each capacity.

    Items longer than the capacity are cut into full pieces, each a bin of its own, and a rest
    that is packed like an item. Bins hold at most ``capacity``; every unit of every item is in
    exactly one bin. Items of size null or 0 need no room: they have one row, with length 0 and
    a null ``bin_id``. Repeated ids are items of their own. An empty table gives an empty result, and so does an empty list.
    ``bin_id`` runs from 0 without gaps; repeated capacities are packed once.

    All capacities share one pass: items below the least capacity are ranked among those of their size
    once, whatever the number of capacities; only the pieces of longer ones differ and are ranked for each.
    """
    sizes = sorted(set(capacities))
    if any(c < 1 for c in sizes):
        raise ValueError("capacities must be positive")
    spark = items.sparkSession
    kind = items.schema[id_column].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"capacity long, id {kind}, piece long, offset long, length long, bin_id long")
    sized = items.select(F.col(id_column).alias("id"), F.coalesce(F.col(size_column).cast("long"), F.lit(0)).alias("size"))
    pieces = cut(_pieces(sized, sizes))
    # The histogram has at most the sum of the capacities as rows. Capacity 0 stands for all.
    found = pieces.filter("length > 0").groupBy("capacity", "length").agg(F.count(F.lit(1)).alias("n")).collect()
    common = {r["length"]: r["n"] for r in found if r["capacity"] == 0}
    slots = []  # (capacity, size, first rank, items of the size per bin, first bin)
    for c in sizes:
        own = {r["length"]: r["n"] for r in found if r["capacity"] == c}
        rank: dict[int, int] = defaultdict(int)
        base = 0
        for pattern, n in plan_bins({s: common.get(s, 0) + own.get(s, 0) for s in common.keys() | own.keys()}, c):
            for s, each in pattern.items():
                slots.append((c, s, rank[s], each, base))
                rank[s] += each * n
            base += n
    placed = grouped_positions(pieces.filter("length > 0"), ["capacity", "length"], [F.col("id"), F.col("size"), F.col("piece")])
    # Those ranked for one capacity come after those ranked for all.
    inside = _find_bins(placed.select("capacity", "id", "piece", "offset", "length", "position"), slots, sizes, common)
    none = pieces.filter("length = 0").select(F.explode(F.array(*[F.lit(c).cast("long") for c in sizes])).alias("capacity"), "id", "piece", "offset", "length", F.lit(None).cast("long").alias("bin_id"))
    return inside.unionByName(none)


def _pieces(sized: DataFrame, capacities: list[int]) -> DataFrame:
    """``(capacity, id, size, piece, offset, length)``: items below all capacities once, with capacity 0; for others their full
    pieces and their rest for each capacity."""
    short = F.array(F.struct(F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("offset"), F.col("size").alias("length")))

    def of(capacity: int) -> Column:
        c = F.lit(capacity).cast("long")
        last = F.floor((F.col("size") - 1) / c)  # exact below 2 ** 53
        piece = lambda i: F.struct(c.alias("capacity"), i.alias("piece"), (i * c).alias("offset"), F.least(c, F.col("size") - i * c).alias("length"))
        return F.transform(F.sequence(F.lit(0).cast("long"), last), piece)

    pieces = F.when(F.col("size") < min(capacities), short).otherwise(F.concat(*[of(c) for c in capacities]))
    return sized.select("id", "size", F.explode(pieces).alias("p")).select("p.capacity", "id", "size", "p.piece", "p.offset", "p.length")


def _find_bins(placed: DataFrame, slots: list[tuple[int, int, int, int, int]], capacities: list[int], common: dict[int, int]) -> DataFrame:
    """Each piece's bin by a binary search for its rank among the plan's ranges of its size.

    The plan is broadcast; its size depends on the capacities alone."""
    ship(placed.sparkSession)
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    span = int(table[:, 1].max()) + 1 if len(table) else 1
    plans = {}
    for c in capacities:
        own = table[table[:, 0] == c]
        plans[c] = tuple(own[:, k] for k in (1, 2, 3, 4))
    before = np.zeros(span, np.int64)
    for s, n in common.items():
        before[s] = n
    plan = placed.sparkSession.sparkContext.broadcast((plans, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, before = plan.value
        for batch in batches:
            capacity, length, rank = (batch.column(i).to_numpy() for i in (0, 4, 5))
            for c, (size, first, each, base) in plans.items():
                rows = np.flatnonzero((capacity == c) | (capacity == 0))
                if len(rows):
                    at_rank = rank[rows] - 1 + np.where(capacity[rows] == 0, 0, before[length[rows]])
                    begins = np.searchsorted(size, length[rows])  # where the ranges of the size begin
                    ends = np.searchsorted(size, length[rows], side="right")
                    at = _last_at_most(first, begins, ends, at_rank)
                    bins = base[at] + (at_rank - first[at]) // each[at]
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int64)), *part.columns[1:5], pa.array(bins, pa.int64())], names=["capacity", "id", "piece", "offset", "length", "bin_id"])

    return placed.mapInArrow(run, placed.withColumnRenamed("position", "bin_id").schema)


def _last_at_most(first: np.ndarray, begins: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row the last place from ``begins`` to before ``ends`` where the ascending ``first`` is at most ``wanted``."""
    low, high = begins.copy(), ends - 1
    while (low < high).any():
        middle = (low + high + 1) // 2
        fits = first[middle] <= wanted
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return low
