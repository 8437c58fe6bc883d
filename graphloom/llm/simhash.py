"""Near duplicates by SimHash, found in a grid of segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its segments. Two fingerprints that differ in d
bits have count vectors at a Manhattan distance of at most d, so a range join over the small vectors
under Manhattan distance 2 misses no link of 2 bits. The grid's cells are the vectors; each
fingerprint enters its own cell and the cells one step away, and two vectors are within two steps
exactly if they enter a common cell. Pairs that meet are then verified by counting differing bits.

Only distinct fingerprints take part, so a text that a third of all rows share is one point. A cell
with more than `dense` points is not paired up: its points are embedded again with segments of one
bit, where the Manhattan distance is the number of differing bits itself. All points that enter a
common cell of that grid are within 2 bits of each other, so each is linked to the smallest of them
alone, which keeps every component and needs no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, utf8
from .components import connected_components

SEED = 42
#: Segment width in bits -> mask of alternating segments of that width.
_ALTERNATE = {1: 0x5555555555555555, 2: 0x3333333333333333}


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """SimHash of the text's word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    n = max(1, len(words) - words_each + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(min(words_each, len(words))))))
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """`_id`, `_fp` (the 64 bits as a long) and `_sha` (of the text), one row per input row; null texts count as empty."""
    small_batches(docs.sparkSession)
    slim = docs.select(
        F.col(id_col).alias("_id"), F.sha2(utf8(text_col), 256).alias("_sha"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    kind = slim.schema["_id"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.array([fingerprint(t.encode(), words_each) for t in pdf["_text"]], np.uint64)
            yield pd.DataFrame({"_id": pdf["_id"], "_sha": pdf["_sha"], "_fp": bits.view(np.int64)})

    return slim.mapInPandas(hashed, f"_id {kind}, _sha string, _fp long")


def _const(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def popcounts(fp: Column, width: int) -> Column:
    """The bit counts of all segments of `width` (1, 2 or 4) bits, each in its segment's place."""
    if width == 1:
        return fp
    odd, even = fp.bitwiseAND(_const(_ALTERNATE[1])), F.shiftrightunsigned(fp, 1).bitwiseAND(_const(_ALTERNATE[1]))
    twos = odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))  # a sum that can't overflow
    if width == 2:
        return twos
    mask = _const(_ALTERNATE[2])
    return twos.bitwiseAND(mask) + F.shiftrightunsigned(twos, 2).bitwiseAND(mask)


def cells(vector: Column, width: int) -> Column:
    """The vector's own cell and all cells one step away."""
    if width == 1:
        return F.array(vector, *(vector.bitwiseXOR(_const(1 << i)) for i in range(64)))
    near = []
    for at in range(0, 64, width):
        field = (1 << width) - 1
        count = F.shiftrightunsigned(vector, at).bitwiseAND(_const(field))
        rest = vector.bitwiseAND(_const(((1 << 64) - 1) ^ (field << at)))
        near.append(F.when(count < width, rest.bitwiseOR(F.shiftleft(count + 1, at))))
        near.append(F.when(count > 0, rest.bitwiseOR(F.shiftleft(count - 1, at))))
    return F.array_compact(F.array(vector, *near))


def links(points: DataFrame, bits: int = 2, width: int = 4, dense: int = 16) -> DataFrame:
    """Edges (`a`, `b`) between distinct fingerprints `_fp` that differ in at most `bits` = 2 bits: all of
    them, but for points of dense cells, which are linked to one point of each fine cell."""
    if bits != 2:
        raise ValueError("cells one step away are made for links of 2 bits")
    met = materialise(points.select("_fp", F.explode(cells(popcounts(F.col("_fp"), width), width)).alias("_cell")))
    full = met.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = materialise(met.join(full, "_cell"))
    sparse = shared.where(F.col("_n") <= dense)
    pairs = (
        sparse.select("_cell", F.col("_fp").alias("a"))
        .join(sparse.select("_cell", F.col("_fp").alias("b")), "_cell")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
        .select("a", "b")
    )
    fine = (
        shared.where(F.col("_n") > dense)
        .select("_fp")
        .distinct()
        .select("_fp", F.explode(cells(F.col("_fp"), 1)).alias("_cell"))
    )
    least = fine.groupBy("_cell").agg(F.min("_fp").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    stars = fine.join(least, "_cell").where("_fp > _least").select(F.col("_least").alias("a"), F.col("_fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_each: int = 3,
    width: int = 4,
    dense: int = 16,
    with_root: bool = False,
) -> DataFrame:
    """One row per input row: the id, `fingerprint` (16 hex digits), `component_id` (the smallest id reached
    over links of at most 2 bits, its own without any) and `text_sha256`. `with_root` adds `_root`, the
    smallest fingerprint of the component, which names it whatever its ids are.

    Texts without words have fingerprint 0 and are linked like any other. A null id is never the
    smallest unless all ids of its component are null.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words_each))
    points = materialise(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = connected_components(links(points.select("_fp"), width=width, dense=dense))
    joined = materialise(
        points.join(roots, points["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    )
    smallest = joined.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = joined.join(smallest, "_root").select("_fp", "_root", "component_id")
    return rows.join(named, "_fp").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("_sha").alias("text_sha256"),
        *["_root"] * with_root,
    )


def one_of_each(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`found` with `kept`: of each `_root` the row with the smallest id (of several, the smallest checksum)."""
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    # ids can be null or repeat, so they don't name a component
    first = found.groupBy("_root").agg(F.min(order).alias("_first"))
    return found.join(first, "_root").select(*found.columns, order.eqNullSafe(F.col("_first")).alias("kept"))
