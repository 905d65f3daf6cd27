"""Best-fit packing of documents into sequences of several permitted lengths.

The lengths of pieces (documents, or parts of those longer than the largest sequence) are whole numbers up to the largest
capacity, so their histogram has a fixed size however many documents there are. The packing is made on that histogram:

1. For each length from the longest down, the fullest open bins that it fits into take pieces of it (best fit). If none
   fits, bins are opened. The size to open is chosen by all lengths together: of the capacities that hold the piece, the one
   whose filling, the piece and then greedily the longest pieces still there, costs least per token it holds.
2. Bins of equal contents are handled at once, as a pattern with a number of copies, so the work follows the number of
   distinct lengths and not that of the documents.
3. At last each bin is changed for the smallest permitted size that holds its contents.

Spark then gives each piece its place: pieces of one length are numbered across all tasks (a count per length and bucket of
ids, a prefix sum over buckets, and the place within the bucket), and the number finds its slot in the patterns' table.

Defined results: a null text counts as empty; a document of no tokens takes no place and gives no piece; a document longer
than the largest capacity is cut into pieces of that capacity and a rest; equal rows are each packed; ids may be null; an empty table
gives no places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairstrand.llm.common import NO_ID, shuffle_partitions, written

#: Permitted sequence lengths in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, in tokens: what a bin costs by being one more.
BIN_COST = 16


@dataclass
class Pattern:
    """``copies`` bins of equal contents: pieces' lengths in the order of their places."""

    capacity: int
    copies: int
    lengths: list[int] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(self.lengths)


def _opening(length: int, left: np.ndarray, capacities: tuple[int, ...]) -> int:
    """The capacity whose filling costs least per token."""
    best, best_cost = 0, np.inf
    for capacity in capacities:
        if capacity < length:
            continue
        filled, room = length, capacity - length
        have = left.copy()
        have[length] -= 1
        while room > 0:
            fits = np.flatnonzero(have[: room + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            n = min(int(have[longest]), room // longest)
            have[longest] -= n
            filled += n * longest
            room -= n * longest
        smallest = min(c for c in capacities if c >= filled)
        cost = (smallest + BIN_COST) / filled
        if cost < best_cost - 1e-12:
            best, best_cost = capacity, cost
    return best


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> list[Pattern]:
    """Patterns that hold every piece of a histogram (length to number of pieces)."""
    capacities = tuple(sorted(capacities))
    left = np.zeros(capacities[-1] + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacities[-1]:
            raise ValueError(f"a piece of {length} tokens fits into no sequence")
        left[length] += n
    by_room: dict[int, list[Pattern]] = {}
    rooms = np.zeros(capacities[-1] + 1, bool)

    def keep(p: Pattern) -> None:
        room = p.capacity - p.used
        by_room.setdefault(room, []).append(p)
        rooms[room] = True

    for length in range(capacities[-1], 0, -1):
        while left[length]:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                capacity = _opening(length, left, capacities)
                each = min(int(left[length]), capacity // length)
                copies = int(left[length]) // each
                left[length] -= each * copies
                keep(Pattern(capacity, copies, [length] * each))
                continue
            room = int(fits[0]) + length
            p = by_room[room].pop()
            rooms[room] = bool(by_room[room])
            each = min(room // length, int(left[length]))
            copies = min(p.copies, int(left[length]) // each)
            left[length] -= each * copies
            if copies < p.copies:
                keep(Pattern(p.capacity, p.copies - copies, list(p.lengths)))
            keep(Pattern(p.capacity, copies, p.lengths + [length] * each))
    done = [p for ps in by_room.values() for p in ps]
    for p in done:
        p.capacity = min(c for c in capacities if c >= p.used)
    return sorted(done, key=lambda p: (-p.capacity, -p.used, p.lengths))


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """For each length, runs of pieces by their number: length, first, n, bin of the first, bins' step, offset, capacity.

    A run belongs to one place of one pattern: piece ``first + k`` goes to bin ``bin + k``.
    """
    rows, used, base = [], {}, 0
    for p in patterns:
        offset = 0
        for length in p.lengths:
            first = used.get(length, 0)
            rows.append((length, first, p.copies, base, offset, p.capacity))
            used[length] = first + p.copies
            offset += length
        base += p.copies
    return pd.DataFrame(rows, columns=["length", "first", "n", "bin", "offset", "capacity"]).sort_values(["length", "first"], ignore_index=True)


def pieces(lengths: DataFrame, largest: int, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """Cut documents into pieces of at most ``largest`` tokens: id, piece, start, length."""
    rows = lengths.select(F.coalesce(lengths[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(lengths[length_col].cast("long"), F.lit(0)).alias("total")).where("total > 0")
    cut = rows.select("id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {largest}"))).alias("piece"))
    return cut.select("id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("total") - F.col("piece") * largest).cast("int").alias("length"))


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """Pack documents: id, piece, start (in the document), length, bin_id, bin_offset, capacity.

    Only the histogram of lengths (at most the largest capacity's number of rows) comes to the driver, and only the
    patterns' runs go back.
    """
    spark, largest = lengths.sparkSession, max(capacities)
    parts = written(pieces(lengths, largest, id_col, length_col), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = slots(plan(histogram, capacities))
    order = runs["length"].to_numpy(np.int64) << 44 | runs["first"].to_numpy(np.int64)  # ascending: runs are sorted by both
    table = spark.sparkContext.broadcast((order, runs[["first", "bin", "offset", "capacity"]].to_numpy(np.int64)))  # bounded by the capacity, whatever the input

    # pieces of a length are numbered by bucket of ids, then by place in the bucket
    buckets = max(1, shuffle_partitions(spark))
    own = F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = parts.select("*", own)
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece")
    numbered = dealt.withColumn("place", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, run = table.value
        for rows in batches:
            number = rows["number"].to_numpy(np.int64)
            r = np.searchsorted(order, rows["length"].to_numpy(np.int64) << 44 | number, side="right") - 1
            first, bin_id, offset, capacity = run[r].T
            yield rows.drop(columns="number").assign(bin_id=bin_id + number - first, bin_offset=offset, capacity=capacity)

    rows = numbered.select("id", "piece", "start", "length", (F.col("base") + F.col("place")).alias("number"))
    out = rows.mapInPandas(place, "id long, piece long, start long, length int, bin_id long, bin_offset long, capacity long")
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumnRenamed("id", id_col)
