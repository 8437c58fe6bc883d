"""Hierarchical packing of token pieces into windows of several lengths, without padding.

Window lengths are the tiers, powers of two. A text over the longest one gives full windows of it and a rest; every other text
is one piece. Pieces are routed to the smallest tier that holds them. The tiers are packed from the longest one down: a window
begins with the longest piece of its tier, and its gap is filled from the pieces of shorter tiers, two that close it exactly
before the longest one that fits. A gap that no piece fits is closed with the head of the longest piece there is; its rest goes back as
a piece of its own length, to whatever tier that is. So every window is full. Only when fewer tokens are left than a window of
the tier has are the last ones put into windows of smaller powers of two, again by cutting.

Lengths are at most as many as the longest tier, so the whole plan is made on the driver from a histogram, whatever the
number of documents: a window's pattern is repeated as often as its lengths last. A piece finds its place by its rank among
the pieces of its length, which is the number of such pieces in earlier partitions plus its place in its own.

Windows of a tier are then dealt to step groups of `step_tokens` tokens: in the order of their attention cost (the sum of
squared piece lengths), to and fro, so that the groups of a tier have equal numbers of windows and about equal costs.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, utf8
from .word_tokens import word_store

TIERS = (2048, 1024, 512, 256)


@dataclass
class Group:
    """`n` pieces that were `origin` tokens long, from rank `first` on, without their first `offset` tokens."""

    origin: int
    first: int
    n: int
    offset: int


class Pool:
    """The pieces left, by their present length."""

    def __init__(self, counts: dict[int, int], longest: int) -> None:
        self.left = np.zeros(longest + 1, np.int64)
        self.groups: dict[int, deque[Group]] = {}
        for length, n in counts.items():
            self.put(length, Group(length, 0, n, 0))

    def put(self, length: int, group: Group) -> None:
        self.left[length] += group.n
        self.groups.setdefault(length, deque()).append(group)

    def take(self, length: int, n: int) -> list[Group]:
        self.left[length] -= n
        own, out = self.groups[length], []
        while n:
            g = own.popleft()
            if g.n > n:
                own.appendleft(Group(g.origin, g.first + n, g.n - n, g.offset))
                g = Group(g.origin, g.first, n, g.offset)
            out.append(g)
            n -= g.n
        return out


def filling(left: np.ndarray, gap: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None, int]:
    """Lengths and how many of each fill a gap; a length to cut and where, if they don't close it; what stays open. `left` changes."""
    chosen: list[tuple[int, int]] = []
    while gap:
        if left[gap]:
            left[gap] -= 1
            return [*chosen, (gap, 1)], None, 0
        fits = np.flatnonzero(left[:gap])
        if not len(fits):
            longer = np.flatnonzero(left)
            return chosen, (int(longer[-1]), gap) if len(longer) else None, 0 if len(longer) else gap
        pairs = fits[left[gap - fits] > (2 * fits == gap)]
        length = int(pairs[-1] if len(pairs) else fits[-1])
        k = 1 if len(pairs) else min(int(left[length]), gap // length)
        left[length] -= k
        gap -= k * length
        chosen.append((length, k))
    return chosen, None, 0


@dataclass
class Windows:
    """`times` equal windows: (length, how many) in their order, and a length of which the head, so long, comes last."""

    size: int
    times: int
    inside: list[tuple[int, int]]
    cut: tuple[int, int] | None
    first: int = 0

    def cost(self) -> int:
        return sum(k * length**2 for length, k in self.inside) + (self.cut[1] ** 2 if self.cut else 0)


#: Of a row of places: the pieces' line position, how many, tokens cut off in front, length, pattern, pieces a window, offset in the
#: window, and which of the pattern's pieces the first one is.
PLACE = ("at", "n", "skip", "length", "pattern", "k", "offset", "nth")


class Plan:
    def __init__(self, counts: dict[int, int], tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16) -> None:
        self.pool, self.patterns, self.places = Pool(counts, tiers[0]), [], []
        self.firsts = np.zeros(tiers[0] + 2, np.int64)
        for length, n in counts.items():
            self.firsts[length + 1] = n
        self.firsts = np.cumsum(self.firsts)
        for tier, below in zip(tiers, [*tiers[1:], 0]):
            while (self.pool.left[below + 1 : tier + 1]).any() and self._window(tier, below):
                pass
        self._last(tiers[0])
        self._number(step_tokens)

    def _window(self, tier: int, below: int) -> bool:
        left = self.pool.left.copy()
        longest = below + 1 + int(np.flatnonzero(left[below + 1 : tier + 1])[-1])
        left[longest] -= 1
        chosen, cut, open_ = filling(left, tier - longest)
        if open_:  # what is left is less than a window
            return False
        used = Counter({longest: 1})
        for length, k in chosen:
            used[length] += k
        if cut:
            used[cut[0]] += 1
        times = min(int(self.pool.left[length]) // k for length, k in used.items())
        self._place(Windows(tier, times, [(longest, 1), *chosen], cut))
        return True

    def _last(self, size: int) -> None:
        """Fewer tokens than the smallest tier with pieces: windows of smaller powers of two."""
        while size > 1:
            size //= 2
            left = self.pool.left
            while int((left * np.arange(len(left))).sum()) >= size:
                chosen, cut, _ = filling(left.copy(), size)
                self._place(Windows(size, 1, chosen, cut))

    def _place(self, windows: Windows) -> None:
        pattern, offset = len(self.patterns), 0
        self.patterns.append(windows)
        parts = [(length, length, k) for length, k in windows.inside]
        if windows.cut:
            parts.append((*windows.cut, 1))
        for length, own, k in parts:
            nth = 0
            for g in self.pool.take(length, k * windows.times):
                self.places.append((int(self.firsts[g.origin]) + g.first, g.n, g.offset, own, pattern, k, offset, nth))
                nth += g.n
                if own < length:
                    self.pool.put(length - own, Group(g.origin, g.first, g.n, g.offset + own))
            offset += own * k

    def _number(self, step_tokens: int) -> None:
        """Windows of a size get consecutive numbers, the dear ones first; `steps` says where a size begins, and its groups."""
        first, group, self.steps = 0, 0, []
        for size in sorted({w.size for w in self.patterns}, reverse=True):
            own = sorted((w for w in self.patterns if w.size == size), key=Windows.cost, reverse=True)
            begin = first
            for w in own:
                w.first, first = first, first + w.times
            groups = -(-(first - begin) // max(1, step_tokens // size))
            self.steps.append((begin, group, groups))
            group += groups

    def lookup(self) -> Lookup:
        return Lookup(self)


class Lookup:
    """The plan as arrays: elementary intervals of line positions, and the places of each."""

    def __init__(self, plan: Plan) -> None:
        self.firsts = plan.firsts
        rows = np.array(plan.places or np.zeros((0, len(PLACE))), np.int64)
        self.begins = np.unique(np.concatenate(([0], rows[:, 0], rows[:, 0] + rows[:, 1])))
        low, high = np.searchsorted(self.begins, rows[:, 0]), np.searchsorted(self.begins, rows[:, 0] + rows[:, 1])
        which = np.repeat(np.arange(len(rows)), high - low)
        interval = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(len(which))
        by = np.lexsort((rows[which, 2], interval))
        self.rows = rows[which[by]]
        self.first = np.searchsorted(interval[by], np.arange(len(self.begins) + 1))
        self.windows = np.array([w.first for w in plan.patterns], np.int64)
        self.sizes = np.array([w.size for w in plan.patterns], np.int64)
        self.steps = np.array(plan.steps or np.zeros((0, 3)), np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For pieces: which of them each part is of, and the parts' tokens and places."""
        at = self.firsts[length] + rank
        interval = np.searchsorted(self.begins, at, "right") - 1
        counts = self.first[interval + 1] - self.first[interval]
        piece = np.repeat(np.arange(len(at)), counts)
        own = np.repeat(self.first[interval] - (np.cumsum(counts) - counts), counts) + np.arange(len(piece))
        row = dict(zip(PLACE, self.rows[own].T))
        nth = row["nth"] + at[piece] - row["at"]
        sequence = self.windows[row["pattern"]] + nth // row["k"]
        begin, group, groups = self.steps[np.searchsorted(self.steps[:, 0], sequence, "right") - 1].T
        turn, place = (sequence - begin) // np.maximum(groups, 1), (sequence - begin) % np.maximum(groups, 1)
        return piece, {
            "skip": row["skip"],
            "length": row["length"],
            "sequence_id": sequence,
            "offset": row["offset"] + nth % row["k"] * row["length"],
            "window": self.sizes[row["pattern"]],
            "step": group + np.where(turn % 2 == 0, place, groups - 1 - place),
        }


def token_rests(docs: DataFrame, vocabulary: str, longest: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per full window and rest of each text: `_id`, `_part` and `_doc` (which text of which partition), `start`, `length`,
    `ids_crc32`, `doc_tokens`, `_rank` among the pieces of this length in this partition, and `_ids` where it can still be cut."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = ["_doc", "start", "length", "ids_crc32", "doc_tokens", "_rank"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part, doc, seen = word_store(vocabulary), TaskContext.get().partitionId(), 0, [0] * (longest + 1)
        for batch in batches:
            whose, rows, rests = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                ids = store.ids(text) + end
                n = len(ids) // 4
                for a in range(0, n, longest):
                    own = ids[4 * a : 4 * (a + longest)]
                    length = len(own) // 4
                    whose.append(i)
                    rows.append((doc, a, length, zlib.crc32(own), n, seen[length]))
                    rests.append(own if length < longest else None)
                    seen[length] += 1
                doc += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(whose, pa.int64())), pa.array([part] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in np.array(rows, np.int64).reshape(-1, 6).T.copy()), pa.array(rests, pa.binary())],
                ["_id", "_part", *names, "_ids"],
            )

    return slim.mapInArrow(cut, f"_id {kind}, _part int, {', '.join(f'{c} long' for c in names)}, _ids binary")


def pack_tiers(
    docs: DataFrame,
    vocabulary: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 1,
    step_tokens: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: the id, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`, `window` (the length of
    its sequence, a power of two, always full) and `step` (its step group).

    `vocabulary`: a tokenizers JSON file of the kind of `word_tokens`, that every executor can open. `tiers`: falling powers of two. Every
    row is packed, repeated ones too; a null or empty text is the end id alone, no rows give no pieces. Which of
    several pieces of one length gets which place depends on the layout of the input; windows and their patterns
    do not.
    """
    pieces = materialise(token_rests(docs, vocabulary, tiers[0], end_id, id_col, text_col))
    kind = pieces.schema["_id"].dataType.simpleString()
    per_part = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_count"))
    counts = {int(r[0]): int(r[1]) for r in per_part.groupBy("length").agg(F.sum("_count")).collect()}  # one a length
    lookup = Plan(counts, tiers, step_tokens).lookup()
    before = per_part.select("_part", "length", F.expr("sum(_count) over (partition by length order by _part) - _count").alias("_before"))
    ranked = pieces.drop("_ids").join(before, ["_part", "length"])
    longs = ["_doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step", "_skip"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = {c: batch.column(c).to_numpy() for c in ("_doc", "start", "length", "ids_crc32", "doc_tokens", "_before", "_rank")}
            piece, part = lookup.find(have["length"], have["_before"] + have["_rank"])
            whole = have["length"][piece] == part["length"]
            columns = [have["_doc"][piece], have["start"][piece] + part["skip"], part["length"], np.where(whole, have["ids_crc32"][piece], -1), have["doc_tokens"][piece]]
            columns += [part[c] for c in ("sequence_id", "offset", "window", "step", "skip")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(piece)) for c in ("_id", "_part")), *map(pa.array, columns)], ["_id", "_part", *longs]
            )

    parts = materialise(ranked.mapInArrow(placed, f"_id {kind}, _part int, {', '.join(f'{c} long' for c in longs)}"))
    out = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step"]
    # only pieces that were cut need their ids again
    cuts = materialise(parts.where("ids_crc32 < 0"))
    rests = pieces.where("_ids is not null").select("_part", "_doc", "_ids")
    own = F.crc32(F.expr("substring(_ids, cast(4 * _skip + 1 as int), cast(4 * length as int))"))
    again = cuts.join(rests, ["_part", "_doc"]).withColumn("ids_crc32", own)
    return parts.where("ids_crc32 >= 0").select(*out).unionByName(again.select(*out)).withColumnRenamed("_id", id_col)
