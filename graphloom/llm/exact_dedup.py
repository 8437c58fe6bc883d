"""Exact deduplication by deterministic block naming; DataFrame operations only.

Every text is cut into blocks of `block_bytes` bytes. The distinct blocks are sorted and numbered,
so that a block's integer name stands for its content without any collision. Adjacent names are
then paired, the distinct pairs are sorted and numbered in turn, and so on, until each text is one
name. Texts of one byte length go through the same number of rounds; among them two texts have the
same final name exactly if they are the same bytes. Rounds: log2(longest text / block_bytes).

Scale: blocks are pre-aggregated before the shuffle that names them, so a text that a third of all
rows share costs each task one row. Names are written before they are handed back, so that the join which does it
is one of two tables, whose large partitions Spark splits. It goes by the blocks' checksums instead of their bytes; should two different
blocks ever have one checksum, which is looked for, it goes by the bytes. A round touches only texts that still have several names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, utf8

ROW = ["_row", "_id", "_sha", "_bytes"]


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct values of `keys`, sorted and numbered within their hash partition; the partition
    number is the high part of `_name`, so names differ everywhere."""
    return (
        df.select(*keys)
        .distinct()
        .sortWithinPartitions(*keys)
        .select(*keys, F.monotonically_increasing_id().alias("_name"))
    )


def _handed_back(blocks: DataFrame, check: Column | None = None) -> DataFrame:
    """`blocks` with `_name`, the name of `_block`."""
    check = F.unhex(F.sha2("_block", 256)) if check is None else check
    names = materialise(_named(blocks, ["_block"]).select(check.alias("_check"), "_name"))
    if names.groupBy("_check").count().where("count > 1").isEmpty():
        return blocks.withColumn("_check", check).drop("_block").join(names, "_check")
    return blocks.join(materialise(_named(blocks, ["_block"])), "_block")


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048) -> DataFrame:
    """One row per input row: `_row`, `_id`, `_sha` (hex SHA-256), `_bytes` (length), `_name`.
    Two rows have equal texts exactly if `_bytes` and `_name` are equal."""
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        utf8(text_col).alias("_text"),
    ).select(
        "_row",
        "_id",
        F.sha2("_text", 256).alias("_sha"),
        F.octet_length("_text").alias("_bytes"),
        "_text",
    )
    starts = F.sequence(F.lit(0), F.greatest((F.col("_bytes") - 1) / block_bytes, F.lit(0)).cast("int"))
    blocks = base.select(
        *ROW,
        F.size(starts).alias("_width"),
        F.posexplode(F.transform(starts, lambda i: F.substring(F.col("_text"), i * block_bytes + 1, F.lit(block_bytes)))).alias("_pos", "_block"),
    )
    level = materialise(_handed_back(blocks).select(*ROW, "_width", "_pos", "_name"))
    finished = [level.where("_width = 1")]
    width = level.agg(F.max("_width")).first()[0] or 1
    while width > 1:
        pairs = (
            level.where("_width > 1")
            .groupBy(*ROW, "_width", F.shiftright("_pos", 1).alias("_at"))
            .agg(
                F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_left"),
                F.coalesce(F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name"))), F.lit(-1)).alias("_right"),
            )
        )
        level = materialise(
            pairs.join(materialise(_named(pairs, ["_left", "_right"])), ["_left", "_right"]).select(
                *ROW, F.shiftright(F.col("_width") + 1, 1).alias("_width"), F.col("_at").alias("_pos"), "_name"
            )
        )
        finished.append(level.where("_width = 1"))
        width = (width + 1) // 2
    return reduce(DataFrame.unionByName, finished).select(*ROW, "_name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048) -> DataFrame:
    """One row per input row: the id, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Of equal texts the row with the largest id stays; a null id is the smallest of all. Where the
    largest id repeats, one of its rows stays. A null text equals the empty text.
    """
    rows = block_identities(docs, id_col, text_col, block_bytes)
    groups = materialise(
        rows.groupBy("_bytes", "_name").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    )
    return rows.join(groups, ["_bytes", "_name"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
