"""Benchmark decontamination with an FM-index per shard of documents.

Words are numbered by the benchmark's own vocabulary; a document word outside it cannot be part of
any window and only separates. A shard (a bounded run of documents within a partition) keeps the runs
of numbered words that are long enough for the shortest window, joins them with separators, sorts its
suffixes (prefix doubling), and builds an FM-index: the
Burrows-Wheeler transform in a wavelet tree with rank counts, and suffix positions sampled every
`SAMPLE` places. All windows are searched backwards at once, one word a step; occurrences are located
by walking to the next sampled position; their spans are merged per document.

The windows are sent to all tasks in blocks of items of about `block_bytes` of text. A larger benchmark
is dealt to several blocks, one after the other: a block's windows are destroyed before the next one is
read, so neither a broadcast nor the driver's memory grows with the benchmark. An item is never split.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

SAMPLE = 8
WINDOW = 10
#: Bytes of words: digits, a-z and everything beyond ASCII stay, A-Z are lower-cased, the rest separates.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Windows:
    """The windows of a block of items, as numbers: `ids` numbers the words from 2 (1 separates, 0 ends), `table`
    has a window a row, and window `w` is in the items `items[i]` for `i` in `owners[first[w] : first[w + 1]]`."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        rows, owner = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            words = np.array([self.ids.setdefault(w, len(self.ids) + 2) for w in words_of(text)], np.int32)
            if not len(words):
                continue
            if len(words) < width:  # to the right: the search goes from there
                words = np.concatenate((np.zeros(width - len(words), np.int32), words))
            rows.append(np.lib.stride_tricks.sliding_window_view(words, width))
            owner.append(np.full(len(rows[-1]), number[item], np.int32))
        every, whose = np.ascontiguousarray(np.concatenate(rows)), np.concatenate(owner)
        by = np.lexsort((whose, *every.T[::-1]))
        every, whose = every[by], whose[by]
        fresh = np.ones(len(every), bool)
        fresh[1:] = (every[1:] != every[:-1]).any(axis=1)
        again = ~fresh
        again[1:] &= whose[1:] == whose[:-1]
        self.table = every[fresh]
        self.lengths = (self.table > 0).sum(axis=1)
        self.owners = whose[~again]
        self.first = np.append(np.flatnonzero(fresh[~again]), len(self.owners))

    def items_of(self, windows: np.ndarray) -> list[str]:
        own = np.unique(np.concatenate([self.owners[self.first[w] : self.first[w + 1]] for w in windows]))
        return [self.items[i] for i in own]


class FMIndex:
    """Over numbers 0..sigma-1; 0 occurs once, at the end."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        order = sorted_suffixes(text)
        self.size = len(text)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.first = np.searchsorted(text[order], np.arange(sigma + 1))
        self.ones, self.zeros = [], []  # a wavelet matrix of the transform
        bwt = text[order - 1]
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(bwt) - int(self.ones[-1][-1]))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        self.marked = order % SAMPLE == 0
        self.marks = np.concatenate(([0], np.cumsum(self.marked)))
        self.places = order[self.marked]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place in the transform."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def step(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix one place further to the left."""
        at, symbol = rows.copy(), np.zeros_like(rows)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] > ones[at]
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return self.first[symbol] + self.rank(symbol, rows)

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each pattern; patterns are right-aligned rows."""
        alive = np.arange(len(table))
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), self.size, np.int64)
        for back in range(1, table.shape[1] + 1):
            alive = alive[(lengths[alive] >= back) & (hi[alive] > lo[alive])]
            if not len(alive):
                break
            symbol = table[alive, -back]
            lo[alive], hi[alive] = self.first[symbol] + self.rank(symbol, lo[alive]), self.first[symbol] + self.rank(symbol, hi[alive])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps to the left until one was sampled."""
        at, steps, todo = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo := todo[~self.marked[at[todo]]]):
            at[todo] = self.step(at[todo])
            steps[todo] += 1
        return self.places[self.marks[at]] + steps


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling the sorted prefix length until all names differ."""
    n, done = len(text), 1
    name = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(name, kind="stable")
    while name[order[-1]] < n - 1:
        pair = name * (n + 1)
        pair[: n - done] += name[done:] + 1
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        name[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        done *= 2
    return order


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def scan_shard(texts: list[bytes], windows: Windows) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: number of words, merged spans of hit words, items with occurring windows."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in lists], np.int64)
    out = [(int(n), [], []) for n in sizes]
    if not len(windows.table) or not sizes.sum():
        return out
    flat = np.fromiter((i for w in lists for i in map(windows.ids.get, w, repeat(1))), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    # runs of known words within a text, of the shortest window's length at least
    known = flat > 1
    edge = np.ones(len(flat), bool)
    edge[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(edge)
    length = np.diff(np.append(begin, len(flat)))
    use = known[begin] & (length >= windows.lengths.min())
    begin, length = begin[use], length[use]
    if not len(begin):
        return out
    total = length + 1  # each run and a separator behind it
    base = np.concatenate(([0], np.cumsum(total)))
    where = np.repeat(begin - base[:-1], total) + np.arange(base[-1])
    last = base[1:] - 1
    text = np.append(flat[np.minimum(where, len(flat) - 1)], 0)
    text[last] = 1
    index = FMIndex(text, len(windows.ids) + 2)
    lo, hi = index.search(windows.table, windows.lengths)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return out
    many = hi[hit] - lo[hit]
    which = np.repeat(hit, many)
    rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    at = where[index.locate(rows)]
    owner = doc[at]
    by = np.argsort(owner, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1):
        d = int(owner[part[0]])
        start = at[part] - first[d]
        items = windows.items_of(np.unique(which[part]))
        out[d] = (int(sizes[d]), merged(start, start + windows.lengths[which[part]]), items)
    return out


def blocks_of_items(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20) -> list[DataFrame]:
    """The different items (`item`, `text`) in blocks of about `block_bytes`, dealt by hash."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if total <= block_bytes:
        return [items]
    many = int(total // block_bytes) + 1
    dealt = items.distinct().withColumn("_block", F.pmod(F.xxhash64("item", "text"), F.lit(many)))
    dealt = materialise(dealt.repartition("_block").sortWithinPartitions("_block"))
    return [dealt.where(F.col("_block") == b).select("item", "text") for b in range(many)]


def _scanner(items: DataFrame, width: int, shard_bytes: int) -> tuple[Broadcast, Callable[[Column], Column]]:
    """The windows of a block's items, and a function from a text column to a struct of `n_words`, `spans` and `items`."""
    spark = items.sparkSession
    small_batches(spark)
    windows = spark.sparkContext.broadcast(Windows([(r[0], r[1].encode()) for r in items.collect()], width))

    @F.pandas_udf("n_words long, spans array<struct<start:long,stop:long>>, items array<string>")
    def scan(text: pd.Series) -> pd.DataFrame:
        found: list = []
        shard: list[bytes] = []
        size = 0
        for t in map(str.encode, text):
            shard.append(t)
            size += len(t)
            if size >= shard_bytes:
                found += scan_shard(shard, windows.value)
                shard, size = [], 0
        found += scan_shard(shard, windows.value)
        return pd.DataFrame(
            {
                "n_words": [f[0] for f in found],
                "spans": [[{"start": a, "stop": b} for a, b in f[1]] for f in found],
                "items": [f[2] for f in found],
            }
        )

    return windows, lambda text: scan(F.coalesce(text, F.lit("")))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, shard_bytes: int = 4 << 20, **how
) -> DataFrame:
    """One row per input row: the id, `n_words`, `spans` (merged half-open word spans that lie in
    occurrences of a window) and `items` (ids of the items with occurring windows, as sorted strings).

    A window is `width` consecutive words of an item; an item of fewer words is one window, one
    without words has none. Null texts have no words; a null item id is named ''. Repeated items
    count once. Without items no word is hit.
    """
    blocks = blocks_of_items(benchmark, **how)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if len(blocks) == 1:
        _, scan = _scanner(blocks[0], width, shard_bytes)
        return slim.select(F.col("_id"), scan(F.col("_text")).alias("_b")).select(F.col("_id").alias(id_col), "_b.*")
    # several blocks: rows get numbers, and only the rows that a block hits go on from it
    slim = materialise(slim.withColumn("_row", F.monotonically_increasing_id()))
    hits = []
    for block in blocks:
        windows, scan = _scanner(block, width, shard_bytes)
        found = slim.select("_id", "_row", scan(F.col("_text")).alias("_b")).select("_id", "_row", "_b.*")
        if not hits:
            counted = found = materialise(found)
            hits.append(found.where(F.size("spans") > 0).select("_row", "spans", "items"))
        else:
            hits.append(materialise(found.where(F.size("spans") > 0).select("_row", "spans", "items")))
        windows.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    merged_hits = every.groupBy("_row").agg(  # of one row, from each block once
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"),
    )
    none = counted.select("_id", "_row", "n_words").join(merged_hits, "_row", "left")
    return none.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce(_merged_column("_spans"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")).alias("spans"),
        F.coalesce("_items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW, shard_bytes: int = 4 << 20, **how
) -> DataFrame:
    """The rows of `docs` without a hit word, all columns as they were; no shuffle. Odd input is treated as in
    `find_contamination`. Between two blocks of a larger benchmark the rows that are left are written."""
    blocks = blocks_of_items(benchmark, **how)
    for i, block in enumerate(blocks):
        windows, scan = _scanner(block, width, shard_bytes)
        docs = docs.where(F.size(scan(docs[text_col])["spans"]) == 0)
        if i + 1 < len(blocks):
            docs = materialise(docs)
            windows.destroy()
    return docs


def _merged_column(spans: str):
    """Merges sorted spans of an array column."""
    return F.expr(
        f"""aggregate({spans}, cast(array() as array<struct<start:bigint,stop:bigint>>), (done, s) ->
            if(size(done) > 0 and element_at(done, -1).stop >= s.start,
               concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).stop, s.stop) as stop))),
               concat(done, array(s))))"""
    )


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report of `find_contamination` as counts and a checksum of the item ids."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
