"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted at once. Documents longer than the greatest are cut into pieces of that length
and a rest, so nothing is lost. Pieces are placed longest first, each into the open bin with the least room
that still takes it. Where none does, a new bin is opened, of the size that costs least for each token it is
going to hold (judged by filling it greedily with the lengths still to come). When all is placed, every
bin is cut down to the least-cost size that holds its contents.

Best fit looks only at lengths, and there are at most ``max(capacities)`` of them. So the driver plans with
the *counts* per length, a table whose size does not follow the corpus, and moves whole runs of equal bins at
a time; each piece then finds its bin from its length and its rank among the pieces of that length. Ranks
come from counts per (length, slice of documents), so one very common length makes no single large task.

Defined results: null and negative lengths count as 0, and a document of length 0 takes no room (one row, no bin);
repeated rows are pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._text import slices as text_slices
from tessera.llm._text import spans
from tessera.plans.scratch import Scratch

#: Permitted sequence lengths of the registered query, in words.
CAPACITIES = (512, 1024, 2048, 4096)
#: Slices that the pieces of one length are ranked in.
SLICES = 256


def default_cost(capacity: int) -> float:
    """Cost of one sequence: its length, and a fixed share for handling it."""
    return capacity + 16.0


@dataclass
class Plan:
    """Runs of pieces and of bins. Pieces of ``length`` with ranks from ``rank`` on go to bins ``bin``, ``bin + 1``, ... at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bin_first: np.ndarray
    bin_capacity: np.ndarray
    bin_fill: np.ndarray


def _open_size(length: int, sizes: list[int], cost: Callable[[int], float], lengths: np.ndarray, counts: np.ndarray) -> int:
    """The permitted size of least cost per token for a bin that starts with ``length``; the shorter one in a tie."""
    best, choice = np.inf, sizes[-1]
    for size in sizes:
        if size < length:
            continue
        room, fill = size - length, length
        upto = int(np.searchsorted(lengths, room, "right"))
        while upto:  # greedy look-ahead over the longest lengths that fit, until none does
            one, n = int(lengths[upto - 1]), int(counts[upto - 1])
            take = min(n, room // one)
            fill += take * one
            room -= take * one
            upto = min(upto - 1, int(np.searchsorted(lengths, room, "right")))
        if cost(size) / fill < best:
            best, choice = cost(size) / fill, size
    return choice


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...], cost: Callable[[int], float] = default_cost) -> Plan:
    """Place all pieces of a histogram (length -> pieces) by best fit, longest first."""
    sizes = sorted(capacities)
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    runs: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int, int]]] = {}  # room left -> runs of bins (first, count, size)
    order: list[int] = []  # rooms that hold bins, ascending
    total = 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        heapq.heappush(rooms[room], run)

    for at in range(len(lengths) - 1, -1, -1):
        length, left, rank = int(lengths[at]), int(counts[at]), 0
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                size = _open_size(length, sizes, cost, lengths[: at + 1], _less(counts[: at + 1], left))
                each = size // length  # a new bin goes on taking this length until it is full
                bins = max(1, left // each)
                put(size, (total, bins, size))
                total += bins
                continue
            room = order[i]
            first, bins, size = heapq.heappop(rooms[room])
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            took = min(bins, left)
            runs.append((length, rank, first, size - room))
            put(room - length, (first, took, size))
            if took < bins:
                put(room, (first + took, bins - took, size))
            rank += took
            left -= took
    bins = sorted((first, n, size, size - room) for room, held in rooms.items() for first, n, size in held)
    final = []
    for first, _, size, fill in bins:  # downsizing
        final.append((first, min((c for c in sizes if fill <= c <= size), key=lambda c: (cost(c), c)), fill))
    runs.sort()
    a = np.array(runs, np.int64).reshape(-1, 4)
    b = np.array(final, np.int64).reshape(-1, 3)
    return Plan(a[:, 0], a[:, 1], a[:, 2], a[:, 3], b[:, 0], b[:, 1], b[:, 2])


def _less(counts: np.ndarray, last: int) -> np.ndarray:
    """Counts still to come, with one piece of the last length in hand."""
    out = counts.copy()
    out[-1] = last - 1
    return out


def pack(docs: DataFrame, length: str, *, capacities: tuple[int, ...] = CAPACITIES, doc_id: str = "doc_id", cost: Callable[[int], float] = default_cost) -> DataFrame:
    """One row per piece: ``doc_id, piece, piece_start, piece_length, bin_id, bin_offset, bin_capacity, bin_fill``.

    ``length`` names a whole-number column. ``piece_start`` is where the piece begins in its document.
    """
    spark = docs.sparkSession
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    most = max(capacities)
    scratch = Scratch(spark, "packing")
    size = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    pieces = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / most) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * F.lit(most).cast("long")).alias("piece_start"), F.least(F.lit(most), F.col("size") - F.col("piece") * most).cast("long").alias("piece_length"))
    pieces = scratch.table(pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int")), "pieces")
    # at most max(capacities) x SLICES rows, whatever the corpus
    slices = pieces.where("piece_length > 0").groupBy("piece_length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("piece_length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = scratch.table(slices.withColumn("before", before), "slices")
    histogram = {r[0]: r[1] for r in slices.groupBy("piece_length").agg(F.sum("n")).collect()}
    shared = spark.sparkContext.broadcast(plan_bins(histogram, capacities, cost))
    order = Window.partitionBy("piece_length", "slice").orderBy(F.col("doc_id").asc_nulls_first(), "piece")
    ranked = pieces.where("piece_length > 0").withColumn("own", F.row_number().over(order) - 1).join(F.broadcast(slices.select("piece_length", "slice", "before")), ["piece_length", "slice"])
    ranked = ranked.select("doc_id", "piece", "piece_start", "piece_length", (F.col("own") + F.col("before")).alias("rank"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        key = (plan.length << 44) | plan.rank
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            at = np.searchsorted(key, (n << 44) | rank, "right") - 1
            bin_id = plan.bin[at] + rank - plan.rank[at] if len(at) else np.zeros(0, np.int64)
            of = np.searchsorted(plan.bin_first, bin_id, "right") - 1
            new = [bin_id, plan.offset[at], plan.bin_capacity[of], plan.bin_fill[of]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x) for x in new)], ["doc_id", "piece", "piece_start", "piece_length", "bin_id", "bin_offset", "bin_capacity", "bin_fill"])

    placed = ranked.mapInArrow(place, f"doc_id {kind}, piece int, piece_start long, piece_length long, bin_id long, bin_offset long, bin_capacity long, bin_fill long")
    none = F.lit(None).cast("long")
    return placed.unionByName(pieces.where("piece_length = 0").select("doc_id", "piece", "piece_start", "piece_length", none.alias("bin_id"), none.alias("bin_offset"), none.alias("bin_capacity"), none.alias("bin_fill")))


def pack_documents(docs: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Pack documents by their number of words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(spans(t)[2]) for t in text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["doc_id", "n_words"])

    return pack(docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long"), "n_words", capacities=capacities)
