"""Packing of token pieces into fixed-size sequences by minimum bin slack.

Texts become token ids; longer ones are cut into pieces of the capacity, the first of which may be
shorter. Piece lengths are at most `capacity` different numbers, so the packing problem is a
histogram, whatever the number of documents, and it is solved on the driver: a bin is opened with the
longest length left, a bitset holds all sums that the lengths left can reach (with their counts), and
the fullest sum that fits is taken. The bin is repeated as often as its lengths last, then removed.
Each such pattern uses up a length, so there are about as many patterns as lengths.

Pieces find their place by their rank among the pieces of their length. A rank is the number of such
pieces in earlier partitions (a small table) plus the place within the own partition (counted while
tokenising), so no task ever sees all pieces of a popular length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokens import byte_chunks, chunk_ids, id_bytes, shared_store
from .common import give_back, materialise, small_batches

#: Bytes of text whose chunks are held at once.
SLICE = 1 << 22

Pattern = tuple[int, list[tuple[int, int]]]  # repetitions, (length, how many in a bin)


def fullest(left: np.ndarray, room: int) -> dict[int, int]:
    """Lengths with counts whose sum is the largest possible up to `room`; longer ones preferred."""
    lengths = [int(x) for x in np.flatnonzero(left[: room + 1])][::-1]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        many, k = min(int(left[length]), room // length), 1
        while many > 0:  # a count as sums of 1, 2, 4, ...
            k = min(k, many)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            many -= k
            k *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + k
            total -= length * k
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up all lengths; the sum of their repetitions is the number of bins."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[Pattern] = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            inside = fullest(left, capacity - longest)
            left[longest] += 1
            inside[longest] = inside.get(longest, 0) + 1
            times = min(int(left[length]) // k for length, k in inside.items())
            for length, k in inside.items():
                left[length] -= k * times
            plan.append((times, sorted(inside.items(), reverse=True)))
    return plan


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool
) -> DataFrame:
    """One row per piece: `_id`, `piece`, `start`, `length`, `ids_crc32`, `_part`, `_rank` (among the pieces of this length in this partition)."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = shared_store(vocabulary, id_bytes)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for whole in batches:
            for batch in _slices(whole):
                chunks, firsts = byte_chunks(batch.column(1), store.special)
                ids, begins = chunk_ids(store, chunks)
                raw, bounds, rows = memoryview(ids.tobytes()), begins[firsts].tolist(), []
                for doc, (first, last) in enumerate(zip(bounds, bounds[1:])):
                    n = last - first + 1
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = raw[4 * (first + a) : 4 * min(first + b, last)]
                        crc = zlib.crc32(end, zlib.crc32(own)) if b == n else zlib.crc32(own)
                        rows.append((doc, i, a, b - a, crc, part, seen[b - a], *([np.frombuffer(bytes(own) + end * (b == n), "<u4").tolist()] if with_ids else [])))
                        seen[b - a] += 1
                docs_of, *columns = zip(*rows)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                names = ["_id", "piece", "start", "length", "ids_crc32", "_part", "_rank", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs_of)), *map(pa.array, columns, types)], names)
        give_back()

    return slim.mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long, _part int, _rank long" + ", ids array<long>" * with_ids)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows, some at a time: up to SLICE bytes of text, or one longer text."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        held = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, held + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the id, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset`
    (and `ids` if asked for).

    Every row of the input is packed, repeated ones too. A null or empty text is the end id alone.
    Which of several pieces of one length gets which place depends on the layout of the input; how
    many sequences there are does not.
    """
    pieces = materialise(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids))
    per_part = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_count"))
    counts = {int(r[0]): int(r[1]) for r in per_part.groupBy("length").agg(F.sum("_count")).collect()}  # at most `capacity` rows
    plan = plan_bins(counts, capacity)
    begins, bins, sizes, offsets, firsts = _places(plan, counts)
    before = per_part.select("_part", "length", F.expr("sum(_count) over (partition by length order by _part) - _count").alias("_before"))
    ranked = pieces.join(before, ["_part", "length"])
    spots = pieces.schema["_id"].dataType.simpleString()
    more = ", ids array<long>" * with_ids

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length = pdf["length"].to_numpy(np.int64)
            at = firsts[length] + pdf["_before"].to_numpy(np.int64) + pdf["_rank"].to_numpy(np.int64)
            k = np.searchsorted(begins, at, "right") - 1
            nth = at - begins[k]
            out = pdf[["_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]].copy()
            out["sequence_id"] = bins[k] + nth // sizes[k]
            out["offset"] = offsets[k] + nth % sizes[k] * length
            yield out

    return ranked.mapInPandas(
        placed, f"_id {spots}, piece int, start long, length long, ids_crc32 long{more}, sequence_id long, offset long"
    ).withColumnRenamed("_id", id_col)


def _places(plan: list[Pattern], counts: dict[int, int]) -> tuple[np.ndarray, ...]:
    """The plan as intervals of ranks. All lengths lie on one line, length after length: `firsts` says
    where a length begins; an interval's begin, first bin, pieces per bin and offset in the bin follow."""
    firsts = np.zeros(max(counts, default=0) + 2, np.int64)
    for length in sorted(counts):
        firsts[length + 1 :] = firsts[length] + counts[length]
    used: dict[int, int] = {}
    rows, first_bin = [], 0
    for times, inside in plan:
        offset = 0
        for length, k in inside:
            rows.append((int(firsts[length]) + used.get(length, 0), first_bin, k, offset))
            used[length] = used.get(length, 0) + k * times
            offset += length * k
        first_bin += times
    table = np.array(sorted(rows) or [(0, 0, 1, 0)], np.int64)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3], firsts
