"""Texts put whole into containers of fixed capacity.

Two ways are here.  ``length_buckets`` is dynamic programming over the global
histogram of lengths: the boundaries that minimise padding, with batches of a
token budget inside each bucket.  It keeps like lengths together, so a text of
0.6 capacities leaves 0.4 of its container empty.  ``plan`` is best fit
decreasing over the same histogram, for all texts of one length at a time; it
is what ``pack`` uses.

Both work on the histogram alone, whose size is bounded by the capacity, and
give ranges of ranks within a length; texts are ranked in parallel and find
their container by a join on those ranges.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def items(lengths: DataFrame, key: str, capacity: int, container: str) -> DataFrame:
    """(container, key, part, n_parts, start, tokens): texts, or the parts of texts longer than the capacity.

    A part but the last fills a container.  A text of no token is an item of no
    size.
    """
    n_parts = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    parts = lengths.select(F.lit(container).alias("container"), key, "n_tokens", n_parts.alias("n_parts"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
    start = F.col("part") * capacity
    return parts.select("container", key, "part", "n_parts", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(capacity)).cast("int").alias("tokens"))


def length_buckets(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least padding in total.

    The cost of a bucket is a line in its upper bound, so each row of the
    dynamic program is a lower envelope of lines: O(buckets x lengths).
    """
    sizes = np.array(sorted(k for k in histogram if k > 0), np.int64)
    if not len(sizes):
        return []
    counts = np.array([histogram[k] for k in sizes], np.int64)
    n = np.concatenate([[0], np.cumsum(counts)])
    s = np.concatenate([[0], np.cumsum(counts * sizes)])
    m = len(sizes)
    best = [0] + [None] * m
    back = []
    for _ in range(min(n_buckets, m)):
        row: list = [0 if j == 0 else None for j in range(m + 1)]
        came = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i), slopes falling
        first = 0
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                line = (-int(n[i]), int(best[i] + s[i]), i)
                while len(hull) - first > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            x = int(sizes[j - 1])
            while len(hull) - first > 1 and hull[first + 1][0] * x + hull[first + 1][1] <= hull[first][0] * x + hull[first][1]:
                first += 1
            if len(hull) > first:
                slope, start, i = hull[first]
                row[j] = slope * x + start + x * int(n[j]) - int(s[j])
                came[j] = i
        back.append(came)
        if row[m] is not None and best[m] is not None and row[m] >= best[m]:
            back.pop()
            break
        best = row
    bounds, j = [], m
    for came in reversed(back):
        bounds.append(int(sizes[j - 1]))
        j = came[j]
        if j == 0:
            break
    return bounds[::-1]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(ranges, number of containers): best fit decreasing, all texts of a length at once.

    A range (length, from, to, first) puts the texts of ranks from .. to - 1 of
    that length into the containers first, first + 1, ….  Containers with the
    same room left are one group, so the work depends on the capacity and not
    on the number of texts.
    """
    rooms: list[int] = []  # rooms left that occur, rising
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: runs of containers
    ranges: list[tuple[int, int, int, int]] = []
    n_bins = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append(run)

    for length in sorted((k for k in histogram if k > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                a, b = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                m = min(left, b - a)
                if m < b - a:
                    put(room, (a + m, b))
            else:
                room = capacity
                m = -(-left // (capacity // length))
                a = n_bins
                n_bins += m
            ranges.append((length, rank, rank + m, a))
            put(room - length, (a, a + m))
            rank += m
            left -= m
    return ranges, max(n_bins, 1 if histogram.get(0) else 0)


_RANK_BITS = 40  # ranks within one length stay below 2 ** 40
SLICES = 256  # of a group of equal texts, so that one length may hold any share of all rows


def ranked(df: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """``df`` plus ``rank`` from 0 within ``group``, in no particular but a repeatable order.

    A group is ranked in slices by hash, whose sizes give the offsets, so one
    length may hold any share of all rows.
    """
    df = df.withColumn("__slice", F.pmod(F.xxhash64(*key), F.lit(SLICES)).cast("int"))
    sizes = df.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inner = F.row_number().over(W.partitionBy(*group, "__slice").orderBy(*key)) - 1
    return df.withColumn("__k", inner).join(offsets, [*group, "__slice"]).withColumn("rank", F.col("__k") + F.col("__offset")).drop("__k", "__offset", "__slice")


def pack(all_items: DataFrame, key: str, usable: dict[str, int]) -> DataFrame:
    """``all_items`` plus ``bin_no``: the container each item stands in. Items of no size stand in container 0.

    The plan of a container size goes to the tasks as sorted arrays of (length,
    first rank) with the containers they begin at; an item finds its range by
    binary search.
    """
    plans = {}
    for r in _histograms(all_items):
        ranges = sorted(plan(dict(r["h"]), usable[r["container"]])[0]) or [(0, 0, 0, 0)]
        length, lo, _, first = (np.array(x, np.int64) for x in zip(*ranges))
        plans[r["container"]] = ((length << _RANK_BITS) + lo, lo, first)
    shared = all_items.sparkSession.sparkContext.broadcast(plans)  # bounded by the capacities, not by the number of texts
    placed = ranked(all_items, ["container", "tokens"], [key, "part"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens, rank, names = b["tokens"].to_numpy(np.int64), b.pop("rank").to_numpy(np.int64), b["container"].to_numpy()
            bins = np.zeros(len(b), np.int64)
            for name, (keys, lo, first) in shared.value.items():
                mine = np.flatnonzero((names == name) & (tokens > 0))
                at = np.searchsorted(keys, (tokens[mine] << _RANK_BITS) + rank[mine], "right") - 1
                bins[mine] = first[at] + rank[mine] - lo[at]
            yield b.assign(bin_no=bins)

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in all_items.schema]
    return placed.select(*all_items.columns, F.col("rank").cast("bigint").alias("rank")).mapInPandas(place, ", ".join([*columns, "bin_no bigint"]))


def _histograms(all_items: DataFrame) -> list:
    """Histogram of lengths of each container; its rows are bounded by the capacities."""
    h = all_items.groupBy("container", "tokens").agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("container").agg(F.collect_list(F.struct("tokens", "n")).alias("h")).collect()


def bucket_batches(all_items: DataFrame, key: str, usable: dict[str, int], n_buckets: int = 32) -> DataFrame:
    """``all_items`` plus ``bucket`` (its upper length) and ``batch_no`` within it: as many texts as fit when padded to that length."""
    bucket = None
    for r in _histograms(all_items):
        # Texts of no size belong to the first bucket; where nothing else is, to one of size 0.
        uppers = F.lit(sorted(length_buckets(dict(r["h"]), n_buckets)) or [0])
        inside = F.get(F.filter(uppers, lambda u: u >= F.col("tokens")), F.lit(0))
        bucket = F.when(F.col("container") == r["container"], inside) if bucket is None else bucket.when(F.col("container") == r["container"], inside)
    room = F.create_map(*[F.lit(x) for kv in usable.items() for x in kv])[F.col("container")]
    placed = all_items.withColumn("bucket", (F.lit(0) if bucket is None else bucket).cast("int"))
    per_batch = F.when(F.col("bucket") > 0, F.floor(room / F.col("bucket"))).otherwise(F.lit((1 << 31) - 1))
    return ranked(placed, ["container", "bucket"], [key, "part"]).withColumn("batch_no", F.floor(F.col("rank") / per_batch)).drop("rank")
