"""Removal of repeated 200-byte passages with suffix arrays.

A passage is any string of `length` bytes that starts at two places, in one document or in two. Every
such string must be seen together with its twin, without bringing all suffixes together:

1. Windows are dealt by content. Of the 32-byte strings in a window the one with the least hash names
   the window; equal windows have equal names. Names that occur at one place only cannot repeat, and
   only the runs of windows with other names go on: as segments, the bytes that such a run covers.
2. Equal segments are counted once. All segments of a name are dealt to one shard; a name with too
   many of them is dealt by whole-window hashes instead, so that no shard grows with a popular name.
3. A shard builds the suffix array of its segments in numpy, refining only what is still tied at each
   doubling (Larsson and Sadakane), up to the window's length, and takes common prefixes of neighbours
   from it in text order (Kasai): a neighbour that stays the same neighbour loses one byte a step. A
   shard over `shard_bytes` is built in blocks, and windows of later blocks are looked up in the
   sorted windows of earlier ones by binary search.
4. Windows with a common prefix of `length` with another one are spans; they are carried back from
   segments to texts, merged, and cut out.

Texts are known by their SHA-256 on the way; a text that is given twice repeats as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, small_batches, utf8

GRAM = 32
_TABLE = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each 32-byte string, by doubling; 1 at least."""
    h, span = _TABLE[data], 1
    while span < GRAM:
        h = h[:-span] * (_ODD + np.uint64(2 * span)) + h[span:]
        span *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def window_names(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the concatenated texts: all bytes, gram hashes, the name of the window at each place (0 where no
    window of one text starts), and the texts' bounds."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    if len(data) < length:
        return data, np.zeros(0, np.uint64), np.zeros(0, np.uint64), bounds
    grams = gram_hashes(data)
    names = _sliding(grams, length - GRAM + 1, np.minimum)
    for end in bounds[1:].tolist():  # windows that cross the end of their text
        names[max(0, end - length + 1) : end] = 0
    return data, grams, names, bounds


def _blocks(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def named_places(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, more than once in it) for the names of all windows of each text."""
    out = []
    for first, part in _blocks(texts):
        _, grams, names, bounds = window_names(part, length)
        width = length - GRAM + 1
        if not len(names):
            continue
        # a gram names a window if its hash is the largest name of the windows that hold it
        reach = _sliding(np.concatenate((np.zeros(width - 1, np.uint64), names, np.zeros(width - 1, np.uint64))), width, np.maximum)
        at = np.flatnonzero(reach[: len(grams)] == grams)
        text = np.searchsorted(bounds, at, "right") - 1
        order = np.lexsort((grams[at], text))
        text, name = text[order], grams[at][order]
        new = np.ones(len(at), bool)
        new[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
        begin = np.flatnonzero(new)
        out.append((text[begin] + first, name[begin], np.diff(np.append(begin, len(at))) > 1))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def segments(text: bytes, wanted: np.ndarray, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, name, bytes) for each run of windows with one of the `wanted` names."""
    data, _, names, _ = window_names([text], length)
    if not len(names):
        return
    edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    keep = np.isin(names[edge], wanted) & (names[edge] > 0)
    ends = np.append(edge[1:], len(names))
    for a, b in zip(edge[keep].tolist(), ends[keep].tolist()):
        yield a, int(names[a].astype(np.int64)), text[a : b + length - 1]


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their first `length` bytes, and the rank of each place (equal for equal strings).

    Ranks begin with 8 bytes. A step doubles the depth: within each group of equal rank, places are
    sorted by the rank of what follows; a place whose rank is its own already is left alone.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        # positions in the order whose rank is shared
        groups = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = groups[1:] == groups[:-1]
        tied[:-1] |= tied[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        places = order[slots]
        after = np.where(places + step < n, rank[np.minimum(places + step, n - 1)] + 1, 0)
        by = np.argsort(rank[places] * (n + 1) + after, kind="stable")
        places, after = places[by], after[by]
        old = rank[places]
        order[slots] = places
        new = np.ones(len(slots), bool)
        new[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
        fresh = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[places] = slots[fresh]
        depth += step
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place the bytes it shares with its predecessor in `order`, up to `most`.

    In text order, a place whose predecessor is one right of the predecessor before shares one byte
    less than the place before (Kasai); where that chain breaks, and behind a place that shares no byte
    (its neighbours in the order begin with different bytes, which says nothing of the next place),
    bytes are compared, 8 at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (data[:-1] == data[before[:-1]])
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    # a chain's length is found once, at its head; its members lose a byte each
    heads = np.flatnonzero(~chained & (before >= 0))
    span = np.diff(np.append(np.flatnonzero(~chained), n))[(before[~chained] >= 0)]
    left, right, share = heads.copy(), before[heads].copy(), np.zeros(len(heads), np.int64)
    todo = np.arange(len(heads))
    limit = np.minimum(n - np.maximum(left, right), span + most)
    while len(todo):
        at = share[todo]
        a, b = left[todo] + at, right[todo] + at
        same = np.ones(len(todo), bool)
        for i in range(8):
            ok = same & (at + i < limit[todo]) & (padded[np.minimum(a + i, n)] == padded[np.minimum(b + i, n)])
            share[todo] += ok
            same = ok
        todo = todo[same]
    out = np.zeros(n, np.int64)
    inside = np.arange(n) - np.maximum.accumulate(np.where(~chained, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[heads] = share
    out = np.maximum(full[np.arange(n) - inside] - inside, 0)
    return np.where(before >= 0, np.minimum(out, most), 0)


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, whether the window at each of its places occurs at another place of any of them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(data)) + length <= ends[owner]
    order, _ = suffix_order(data, length)
    order = order[inside[order]]  # windows within one string, still in order
    hit = np.zeros(len(data), bool)
    if len(order) > 1:
        share = common_prefixes(data, order, length)
        twin = np.flatnonzero(share[order] >= length)
        hit[order[twin]] = True
        hit[order[twin - 1]] = True
    return np.split(hit, ends[:-1])


def _merge_blocks(parts: list[bytes], length: int, shard_bytes: int) -> list[np.ndarray]:
    """`repeated_windows` in blocks, merged by binary search."""
    blocks = list(_blocks(parts, shard_bytes))
    hits = [h for _, block in blocks for h in repeated_windows(block, length)]
    if len(blocks) < 2:
        return hits

    def windows(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(p, np.uint8), length) for p in block]
        rows = np.concatenate([np.ascontiguousarray(v) for v in views]).view(f"V{length}").ravel().view(f"S{length}")
        own = np.repeat(np.arange(len(block)), [len(v) for v in views])
        place = np.concatenate([np.arange(len(v)) for v in views])
        by = np.argsort(rows, kind="stable")
        return rows[by], own[by], place[by]

    for i, (first, block) in enumerate(blocks):
        rows, own, place = windows(block)
        for second, other in blocks[i + 1 :]:
            keys, theirs, where = windows(other)
            lo, hi = np.searchsorted(rows, keys, "left"), np.searchsorted(rows, keys, "right")
            for k in np.flatnonzero(hi > lo):
                hits[second + theirs[k]][where[k]] = True
            # the block's own windows that the other one holds
            lo, hi = np.searchsorted(keys, rows, "left"), np.searchsorted(keys, rows, "right")
            for k in np.flatnonzero(hi > lo):
                hits[first + own[k]][place[k]] = True
    return hits


def _runs(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans that the marked windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(a, b + length - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def repeated_passages(
    docs: DataFrame,
    length: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = 2 << 20,
    hot_segments: int = 5000,
) -> DataFrame:
    """One row per input row: the id, `n_bytes`, `n_removed`, `n_spans` and `kept_sha256`.

    Texts are UTF-8 bytes, null is empty; texts of under `length` bytes lose nothing. Equal texts, in
    repeated rows too, are each other's repeats and lose every byte if they are long enough.
    """
    if length < GRAM:
        raise ValueError(f"passages have {GRAM} bytes at least")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text"))
    source = source.select("_id", F.sha2("_text", 256).alias("_sha"), F.octet_length("_text").cast("long").alias("n_bytes"), "_text")
    source = source.withColumn("_key", F.conv(F.substring("_sha", 1, 15), 16, 10).cast("long"))
    long_ones = source.where(F.col("n_bytes") >= length)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, name, twice = named_places([bytes(t) for t in pdf["_text"]], length)
            yield pd.DataFrame({"_key": pdf["_key"].to_numpy()[text], "_name": name.view(np.int64), "_twice": twice})
            give_back()

    named = materialise(long_ones.select("_key", "_text").mapInPandas(places, "_key long, _name long, _twice boolean"))
    # written, so that the join behind it is one of two tables: the rows of a name that many copies have are dealt to several tasks
    repeated = materialise(
        named.groupBy("_name")
        .agg(F.min("_key").alias("_a"), F.max("_key").alias("_b"), F.max("_twice").alias("_t"))
        .where("_a <> _b or _t")
        .select("_name")
    )
    wanted = named.select("_key", "_name").join(repeated, "_name").groupBy("_key").agg(F.collect_set("_name").alias("_names"))  # of one text
    # names are brought under the texts' own checksums, so that texts are shuffled once only
    wanted = wanted.join(long_ones.select("_key", "_sha").distinct(), "_key").select("_sha", "_names")
    texts = materialise(long_ones.groupBy("_sha").agg(F.first("_text").alias("_text")).join(wanted, "_sha"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (sha, start, name, hashlib.blake2b(own, digest_size=16).digest(), own)
                for sha, text, names in zip(pdf["_sha"], pdf["_text"], pdf["_names"])
                for start, name, own in segments(bytes(text), np.asarray(names, np.int64).view(np.uint64), length)
            ]
            yield pd.DataFrame(rows, columns=["_sha", "_start", "_name", "_segment", "_bytes"])
            give_back()

    placed = materialise(texts.mapInPandas(cut, "_sha string, _start long, _name long, _segment binary, _bytes binary"))
    distinct = materialise(
        placed.groupBy("_segment").agg(F.first("_name").alias("_name"), F.first("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    )
    spans = _segment_spans(distinct, length, shard_bytes, hot_segments)
    per_text = (
        placed.select("_sha", "_start", "_segment")
        .join(spans, "_segment")
        .groupBy("_sha")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("_start") + F.col("_from")).alias("a"), (F.col("_start") + F.col("_to")).alias("b")))).alias("_spans"))  # of one text
    )

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, text, spans_ in zip(pdf["_sha"], pdf["_text"], pdf["_spans"]):
                text, kept, gone, count, at = bytes(text), hashlib.sha256(), 0, 0, 0
                for a, b in ((s["a"], s["b"]) for s in spans_):
                    if a > at or count == 0:
                        kept.update(text[at:a])
                        count += 1
                        gone += b - a
                        at = b
                    elif b > at:
                        gone += b - at
                        at = b
                kept.update(text[at:])
                rows.append((sha, gone, count, kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["_sha", "_gone", "_count", "_kept"])
            give_back()

    cuts = texts.select("_sha", "_text").join(per_text, "_sha").mapInPandas(removed, "_sha string, _gone long, _count long, _kept string")
    rows = source.select("_id", "_sha", "n_bytes")
    copies = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    whole = (F.col("_copies") > 1) & (F.col("n_bytes") >= length)
    return (
        rows.join(copies, "_sha", "left")
        .join(cuts, "_sha", "left")
        .select(
            F.col("_id").alias(id_col),
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("_gone", F.lit(0))).alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("_count", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("_kept", "_sha")).alias("kept_sha256"),
        )
    )


def _segment_spans(distinct: DataFrame, length: int, shard_bytes: int, hot_segments: int) -> DataFrame:
    """(`_segment`, `_from`, `_to`): the byte spans of repeated windows in each distinct segment."""
    whole = distinct.where("_n > 1").select("_segment", F.lit(0).cast("long").alias("_from"), F.octet_length("_bytes").cast("long").alias("_to"))
    total, = distinct.agg(F.sum(F.octet_length("_bytes"))).first()
    shards = max(1, int(total or 0) // shard_bytes + 1)
    hot = materialise(distinct.groupBy("_name").agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > hot_segments).select("_name"))
    mild = distinct.join(hot, "_name", "left_anti").select("_segment", F.pmod(F.xxhash64("_name"), F.lit(shards)).alias("_shard"), F.lit(0).cast("long").alias("_at"), "_bytes")
    # segments of a popular name: every window on its own, dealt by its hash; unique hashes go no further
    starts = F.sequence(F.lit(0), F.octet_length("_bytes") - length)
    each = distinct.join(hot, "_name", "left_semi").select("_segment", F.explode(starts).alias("_at"), "_bytes")
    each = each.select("_segment", F.col("_at").cast("long").alias("_at"), F.expr(f"substring(_bytes, _at + 1, {length})").alias("_bytes"))
    each = each.withColumn("_hash", F.xxhash64("_bytes"))
    again = each.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    each = each.join(again, "_hash").select("_segment", F.pmod("_hash", F.lit(shards)).alias("_shard"), "_at", "_bytes")
    # equal windows of a popular name: one of them, and how many there are
    windows = each.groupBy("_shard", "_bytes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    popular = each.join(windows, ["_shard", "_bytes"]).select("_segment", F.col("_at").alias("_from"), (F.col("_at") + length).alias("_to"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = _merge_blocks([bytes(b) for b in pdf["_bytes"]], length, shard_bytes)
        rows = [(segment, a, b) for segment, hit in zip(pdf["_segment"], hits) for a, b in _runs(hit, length)]
        give_back()
        return pd.DataFrame(rows, columns=["_segment", "_from", "_to"])

    found = mild.groupBy("_shard").applyInPandas(search, "_segment binary, _from long, _to long")
    return found.unionByName(whole).unionByName(popular)
