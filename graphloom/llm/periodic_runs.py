"""Periodic runs of words, by the linear method of Gusfield and Stoye for tandem repeats.

A run is a stretch of words with smallest period q, at least twice as long as q, that neither neighbour extends.
A square is two equal stretches of q words behind each other; a run is a row of squares of one period that
start at consecutive words. Documents of a task are searched together, in blocks:

1. Words become numbers within their text. A word that occurs once in a stretch can't be in a run and cuts the stretch in
   two, again and again while that helps; stretches shorter than the shortest run leave. No run is lost, as each of
   its words occurs in it twice. What is left is joined, a number of its own between two stretches.
2. Names of all strings of 1, 2, 4, ... words (equal exactly for equal strings) give the suffix array by doubling,
   and the common extension of any two places, forwards and backwards, in as many steps.
3. The text is cut into Lempel-Ziv blocks: each is the longest one that also starts earlier, overlap allowed. A square that
   is the leftmost of its kind crosses the end of the block of its centre, or begins before that block. So
   extensions from each block's end to `1 .. |block|` words before it, and from its begin to
   `1 .. |block| + |next block|` words behind it, give squares that cover the leftmost one of every kind.
4. The vocabulary of squares is completed by walks along suffix links: the square one word further has as its place in the suffix
   tree the suffix link's, followed by the first word, as long as that word is there. Squares are known by
   period and the left end of their interval of the suffix array, which is their place in the tree.
   Squares whose half is itself a repetition are left out, as they are in runs of a shorter period.
5. The places of a square are the suffixes in its interval. All of them, by period and place, merge into runs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

SHORTEST = 12
#: A block ends when it has as many words after step 1, or as many bytes of text.
BLOCK_WORDS, BLOCK_BYTES = 200_000, 1 << 24

Words = list[bytes]


def words_of(text: bytes) -> Words:
    return text.split()  # at \x20 and \x09-\x0D


class Names:
    """Names of the strings of 2^k words at each place, and the sorted suffixes. The text ends with a number that occurs once
    in it, so that all suffixes differ."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        order = np.argsort(text, kind="stable")
        head = np.ones(n, bool)
        head[1:] = text[order[1:]] != text[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.levels, depth = [], 1
        while True:
            self.levels.append(rank.astype(np.int32))
            tied = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(tied):
                break
            place = order[tied]
            key = rank[place] * (n + 1) + rank[place + depth]  # equal strings end before the text does
            by = np.argsort(key, kind="stable")
            key, place = key[by], place[by]
            order[tied] = place
            new = np.ones(len(tied), bool)
            new[1:] = key[1:] != key[:-1]
            head[tied] = new
            rank[place] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
            depth *= 2
        self.order, self.rank = order, rank

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the text has in common from two different places on."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        live = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        a, b, own = a[live], b[live], np.zeros(len(live), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][a] == self.levels[k][b]) * np.int64(1 << k)
            a += same
            b += same
            own += same
        out[live] = own
        return out


def _lowest(x: np.ndarray) -> list[np.ndarray]:
    """Minima of the 2^k numbers from each place on."""
    out, span = [x.astype(np.int32)], 1
    while span * 2 <= len(x):
        out.append(np.minimum(out[-1][:-span], out[-1][span:]))
        span *= 2
    return out


def _left(lowest: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest place from which on up to `at` (exclusive) all numbers are `least` or more."""
    at = at.copy()
    for k in range(len(lowest) - 1, -1, -1):
        before = at - (1 << k)
        at = np.where((before >= 0) & (lowest[k][np.maximum(before, 0)] >= least), before, at)
    return at


def _right(lowest: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest place up to which, from `at` on, all numbers are `least` or more (exclusive)."""
    at, n = at.copy(), len(lowest[0])
    for k in range(len(lowest) - 1, -1, -1):
        ok = at + (1 << k) <= n
        at = np.where(ok & (lowest[k][np.minimum(at, len(lowest[k]) - 1)] >= least), at + (1 << k), at)
    return at


def _counted(begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and `begin, begin + 1, ...`, for all ranges behind each other."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(len(which))


def lempel_ziv(names: Names) -> np.ndarray:
    """The begins of the blocks, and the text's end."""
    order, n = names.order, len(names.order)
    ranks = np.arange(n)
    lowest = _lowest(order)
    earlier = np.zeros(n, np.int64)
    # the nearest suffixes in the array that start earlier in the text
    before = _left(lowest, ranks, order) - 1
    behind = _right(lowest, ranks, order)
    for other in (before, behind):
        ok = np.flatnonzero((other >= 0) & (other < n))
        length = names.extension(order[ok], order[other[ok]])
        earlier[order[ok]] = np.maximum(earlier[order[ok]], length)
    steps, begins, at = np.maximum(earlier, 1).tolist(), [], 0
    while at < n:
        begins.append(at)
        at += steps[at]
    return np.array([*begins, n], np.int64)


def primitive(names: Names, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Whether a square's half is no repetition itself: no prime divisor of its length leaves a shorter period."""
    most = int(periods.max(initial=1))
    divisor = np.zeros(most + 1, np.int64)  # the smallest prime divisor
    for d in range(2, most + 1):
        if d * d > most:
            break
        if not divisor[d]:
            own = divisor[d * d :: d]
            own[own == 0] = d
    divisor[divisor == 0] = np.flatnonzero(divisor == 0)
    ok, rest = np.ones(len(starts), bool), periods.copy()
    live = np.flatnonzero(rest > 1)
    while len(live):
        d = divisor[rest[live]]
        short = periods[live] // d
        ok[live[names.extension(starts[live], starts[live] + short) >= periods[live] - short]] = False
        rest[live] //= d
        live = live[ok[live] & (rest[live] > 1)]
    return ok


def runs_of(text: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period. The last number must occur once, as the numbers between
    stretches do."""
    n = len(text)
    ahead, back = Names(text), Names(np.append(text[::-1], text.max(initial=0) + 1))
    blocks = lempel_ziv(ahead)
    # squares that cover the leftmost ones
    sizes = np.diff(blocks)
    which, k = _counted(np.ones(len(sizes), np.int64), sizes)
    ends = blocks[1:][which]
    which2, k2 = _counted(np.ones(len(sizes), np.int64), sizes + np.append(sizes[1:], 0))
    left, period = np.concatenate((ends - k, blocks[:-1][which2])), np.concatenate((k, k2))
    ok = (left > 0) & (left + period < n)
    left, period = left[ok], period[ok]
    forth, back_by = ahead.extension(left, left + period), back.extension(n - left, n - left - period)
    start = left - np.minimum(back_by, period)
    ok = (forth + back_by >= period) & (start + period <= left + forth)
    start, period, back_by = start[ok], period[ok], back_by[ok]
    ok = primitive(ahead, start, period)
    start, period = start[ok], period[ok]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    # a walk begins where its row of squares does and has at most a square for each rotation
    start = start - back.extension(n - start, n - start - period)
    start, period = np.unique(np.stack((start, period)), axis=1)
    walk = np.minimum(ahead.extension(start, start + period) - period + 1, period)
    which, place = _counted(start, walk)
    period = period[which]
    lowest = _lowest(ahead.extension(ahead.order[:-1], ahead.order[1:]))  # common prefixes of neighbours
    rank = ahead.rank[place]
    low = _left(lowest, rank, 2 * period)
    key, first = np.unique(period * n + low, return_index=True)
    period, low = period[first], low[first]
    high = _right(lowest, rank[first], 2 * period)
    # located squares, merged
    which, at = _counted(low, high - low + 1)
    key = np.sort(period[which] * (n + 1) + ahead.order[at])
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1] + 1
    begin, end = key[new], key[np.append(np.flatnonzero(new)[1:], len(key)) - 1]
    period, start = begin // (n + 1), begin % (n + 1)
    runs = np.stack((start, end % (n + 1) - start + 2 * period, period), axis=1)
    return runs[np.lexsort((period, start))]


def stretches(numbers: np.ndarray, text: np.ndarray, shortest: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words that can be in a run, and the stretch of each. `text` says which text a word is of."""
    place, part = np.arange(len(numbers)), text
    while len(place):
        key = part * most + numbers[place]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(place), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        cut = np.ones(len(place), bool)
        cut[1:] = (part[1:] != part[:-1]) | (place[1:] != place[:-1] + 1) | ~twice[1:] | ~twice[:-1]
        new = np.cumsum(cut) - 1
        keep = twice & (np.bincount(new)[new] >= shortest)
        done = keep.mean() > 0.9
        place, part = place[keep], new[keep]
        if done:
            break
    return place, part


class Block:
    """Texts as numbers, until there are enough of them to be searched together."""

    def __init__(self, shortest: int) -> None:
        self.shortest = shortest
        self.rows: list[Words] = []
        self.ids: list[pa.Array] = []
        self.bytes = self.words = 0
        self.parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # first row; row, place, and number of each word

    def add(self, ids: pa.Array, texts: list[Words]) -> None:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        sizes = np.array([len(t) for t in texts], np.int64)
        numbers = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts)])
        of = np.repeat(np.arange(len(texts)), sizes)
        place, part = stretches(numbers, of, self.shortest, len(number))
        first = np.cumsum(sizes) - sizes
        # a number of its own behind each stretch
        ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(part) else np.zeros(0, np.int64)
        text = np.insert(numbers[place], ends, len(number) + np.arange(len(ends)))
        row = np.insert(of[place], ends, -1)
        at = np.insert(place - first[of[place]], ends, -1)
        self.parts.append((len(self.rows), row, at, text))
        self.rows += texts
        self.ids.append(ids)
        self.words += len(text)

    def runs(self) -> list[list[tuple[int, int, int]]]:
        """The runs of each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.rows]
        offset, rows, ats, texts = 0, [np.array([-1])], [np.array([-1])], [np.array([0])]
        for first, row, at, text in self.parts:  # numbers of one batch have nothing to do with those of another
            rows.append(np.where(row < 0, -1, row + first))
            ats.append(at)
            texts.append(text + offset + 1)
            offset += int(text.max(initial=0)) + 1
        row, at = np.concatenate(rows), np.concatenate(ats)
        if len(row) > 1:
            found = runs_of(np.concatenate(texts))
            found = found[found[:, 1] >= self.shortest]
            starts = at[found[:, 0]].tolist()
            for r, s, length, period in zip(row[found[:, 0]].tolist(), starts, found[:, 1].tolist(), found[:, 2].tolist()):
                out[r].append((s, length, period))
        return out


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words that no run has behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return list(compress(words, np.cumsum(edge[:-1]) == 0))


def periodic_runs(
    docs: DataFrame,
    shortest: int = SHORTEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    change: Callable[[Words, Any], Words] | None = None,
    change_by: Column | None = None,
) -> DataFrame:
    """One row per input row: the id, `n_words`, `runs` (array of start, length and period in words, by start, then period; of
    `shortest` words or more), `collapsed_sha256` and, if asked for, `collapsed`: the words left, one space between
    them, when of each run only the first period is kept.

    `change` takes the words and the row's value of `change_by`, and gives the words to search in their place. A null, empty or
    blank text has no words and no runs. Rows are independent of each other, repeated ones too; no text is
    shuffled. Memory follows the longest text: about 300 bytes for each of its words that occurs twice.
    """
    small_batches(docs.sparkSession)
    by = F.lit(None) if change_by is None else change_by
    slim = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text"), by.cast("string" if change_by is None else "long").alias("_by"))
    kind = slim.schema["_id"].dataType.simpleString()
    struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def result(block: Block) -> pa.RecordBatch:
        found = block.runs()
        texts = [b" ".join(collapsed(words, runs)) for words, runs in zip(block.rows, found)]
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        columns = {
            "_id": pa.concat_arrays(block.ids),
            "n_words": pa.array([len(w) for w in block.rows], pa.int64()),
            "runs": pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(struct))
            ),
            "collapsed_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        }
        if with_text:
            columns["collapsed"] = pa.array([t.decode() for t in texts], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shortest)
        for batch in batches:
            raw = batch.column("_text").to_pylist()
            texts = [words_of(t) for t in raw]
            if change:
                texts = list(map(change, texts, batch.column("_by").to_pylist()))
            block.add(batch.column("_id"), texts)
            block.bytes += sum(map(len, raw))
            if block.words >= BLOCK_WORDS or block.bytes >= BLOCK_BYTES:
                yield result(block)
                block = Block(shortest)
        if block.rows:
            yield result(block)

    schema = f"_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_sha256 string"
    return slim.mapInArrow(searched, schema + ", collapsed string" * with_text).withColumnRenamed("_id", id_col)


def planted_run(words: Words, seed: int | None) -> Words:
    """The words with a run planted in every tenth text: with h the seed and g = h div 10, of n words those from a = g mod n on repeat
    with period 1 + (n - a) div (3 + g mod 8). A null seed changes nothing."""
    n = len(words)
    if seed is None or seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    rest = n - a
    return words[:a] + (words[a : a + period] * (rest // period + 1))[:rest]


def run_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, `n_runs`, the longest run's `start`, `length`, `period` and `exponent_milli` (of equal ones the first; null without
    runs), `runs_sha256` and `collapsed_sha256`."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(text, 256).alias("runs_sha256"), "collapsed_sha256"
    ).select(
        id_col,
        "n_runs",
        (-F.col("_best.s")).alias("start"),
        F.col("_best.l").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("(1000 * _best.l) div -_best.p").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
