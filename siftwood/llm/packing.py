"""Filling containers of a fixed capacity with items, by best two fit.

Best two fit fills a container greedily with the largest item that still fits;
then, if that fills it more tightly, it takes the container's smallest item out
and puts two items in that are still unpacked.

Items of one size are alike, so the packing is planned over the counts of the
sizes: a table with at most `capacity` rows, whatever the number of items. A
pattern, once found, repeats until one of its sizes runs short, so the plan has
a few thousand patterns at most. Every item then finds its container from its
rank among the items of its size, by arithmetic; ranks come from counts by size
and block, and no group of items is ever gathered.

Defined results: an item without size (an empty or null text) takes no space and
gets bin_id null; an item above the capacity is cut into full pieces, each of
which fills a container alone, and a rest that is packed like an item; repeated
rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.session import materialize

#: Blocks among which the items of a size are ranked; a hot size is spread over them.
BLOCKS = 64


@dataclass
class Plan:
    """Runs of ranks of one size that share a pattern, in order of size and rank."""

    size: np.ndarray
    first: np.ndarray
    uses: np.ndarray
    bin: np.ndarray
    bins: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container of each item, from its size and its rank among that size."""
        key = (self.size << 44) | self.first
        at = np.searchsorted(key, (size << 44) | rank, side="right") - 1
        return self.bin[at] + (rank - self.first[at]) // self.uses[at]


def best_pair(available: np.ndarray, below: np.ndarray, room: int) -> tuple[int, int]:
    """The two available sizes with the largest sum up to room; (0, 0) if there are none."""
    first = np.flatnonzero(available[: room + 1] > 0)
    first = first[(first > 0) & (first < room)]
    if not len(first):
        return 0, 0
    second = below[room - first]
    same = (second == first) & (available[first] < 2)
    if same.any():
        second = np.where(same, below[np.minimum(room - first, first - 1)], second)
    total = np.where(second > 0, first + second, 0)
    at = int(total.argmax())
    return (int(first[at]), int(second[at])) if total[at] else (0, 0)


def best_two_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Plan containers for counts[s] items of each size s from 1 to capacity."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    index = np.arange(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int]] = []
    bins = 0
    while True:
        below = np.maximum.accumulate(np.where(left > 0, index, 0))
        if not below[capacity]:
            break
        pattern: dict[int, int] = {}
        gap, limit = capacity, capacity
        while gap > 0:
            size = int(below[min(gap, limit)])
            if not size:
                break
            uses = min(int(left[size]), gap // size)
            pattern[size] = uses
            gap -= uses * size
            limit = size - 1
            if limit <= 0:
                break
        if gap and sum(pattern.values()) > 1:
            smallest = min(pattern)
            free = left.copy()
            for size, uses in pattern.items():
                free[size] -= uses
            a, b = best_pair(free, np.maximum.accumulate(np.where(free > 0, index, 0)), gap + smallest)
            if a + b > smallest:
                pattern[smallest] -= 1
                for size in (a, b):
                    pattern[size] = pattern.get(size, 0) + 1
        pattern = {s: u for s, u in pattern.items() if u}
        times = min(int(left[s]) // u for s, u in pattern.items())
        for size, uses in pattern.items():
            runs.append((size, int(taken[size]), uses, bins))
            taken[size] += uses * times
            left[size] -= uses * times
        bins += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], bins)


def first_fit_bound(counts: np.ndarray, capacity: int) -> int:
    """Containers that no packing can do without: the total size by the capacity."""
    return int(-(-int((counts * np.arange(len(counts))).sum()) // capacity))


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """bin_id, the key, piece, start and size: one row per item, or per piece of a cut one.

    start is where the piece begins within its item. Bins are numbered from 0;
    the containers of full pieces come after those of the plan.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    key_field = sizes.schema[key]
    items = sizes.select(
        F.col(f"`{key}`").alias("item"),
        F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("total"),
    )
    items = materialize(items, "pack")
    rest, full = F.col("total") % capacity, F.floor(F.col("total") / capacity).cast("bigint")
    block = F.pmod(F.xxhash64("item", "total"), F.lit(BLOCKS)).cast("int")

    # counts by size and block: capacity x BLOCKS rows at most, whatever the data
    found = (
        items.groupBy(rest.cast("int").alias("s"), block.alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("full"))
        .toPandas()
    )
    table, cut = np.zeros((capacity, BLOCKS), np.int64), np.zeros((capacity, BLOCKS), np.int64)
    table[found.s, found.b], cut[found.s, found.b] = found.n, found.full
    plan = best_two_fit(np.append(table.sum(axis=1), 0), capacity)
    base = np.cumsum(table, axis=1) - table  # rank of the first item of a block within its size
    cut_base = (np.cumsum(cut) - cut.ravel()).reshape(cut.shape) + plan.bins

    fields = [
        T.StructField("bin_id", T.LongType()),
        T.StructField(key, key_field.dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("size", T.LongType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task sees the items of a (size, block) in one stretch, in order
        group, rank, fulls = -1, 0, 0
        for batch in batches:
            total = batch.column(1).to_numpy()
            s, b = total % capacity, batch.column(2).to_numpy().astype(np.int64)
            code = s * BLOCKS + b
            n = len(code)
            if not n:
                continue
            at = np.arange(n)
            start = np.flatnonzero(np.r_[code[0] != group, code[1:] != code[:-1]])
            within, f = at.copy(), total // capacity
            before = np.cumsum(f) - f
            if len(start):
                last = np.maximum.accumulate(np.where(np.isin(at, start), at, -1))
                within = np.where(last >= 0, at - last, at + rank)
                before = np.where(last >= 0, before - before[np.maximum(last, 0)], before + fulls)
            else:
                within, before = at + rank, before + fulls
            group, rank, fulls = int(code[-1]), int(within[-1]) + 1, int(before[-1] + f[-1])
            bins = np.zeros(n, np.int64)
            real = s > 0
            if real.any():
                bins[real] = plan.place(s[real], base[s[real], b[real]] + within[real])
            # the full pieces of item i, then its rest, then items without size
            owner = np.repeat(at, f)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(f) - f, f)
            which = np.concatenate([owner, at[real], at[total == 0]])
            out_bin = np.concatenate([cut_base[s, b][owner] + before[owner] + piece, bins[real], np.zeros(int((total == 0).sum()), np.int64)])
            out_piece = np.concatenate([piece, f[real], np.zeros(int((total == 0).sum()), np.int64)])
            out_size = np.concatenate([np.full(len(owner), capacity), s[real], np.zeros(int((total == 0).sum()), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out_bin, pa.int64(), mask=out_size == 0),
                    batch.column(0).take(pa.array(which)),
                    pa.array(out_piece, pa.int32()),
                    pa.array(out_piece * capacity, pa.int64()),
                    pa.array(out_size, pa.int64()),
                ],
                names=[x.name for x in fields],
            )

    ordered = (
        items.select("item", "total", block.alias("b"))
        .repartition(rest, F.col("b"))
        .sortWithinPartitions(rest, F.col("b"), F.col("total"), F.col("item"))
    )
    return ordered.mapInArrow(run, T.StructType(fields))
