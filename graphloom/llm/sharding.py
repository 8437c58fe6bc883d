"""Reproducible shuffle and sharding by a Feistel permutation; DataFrame operations only.

Rows are ordered by id and numbered 0..n-1. A Feistel network over a rectangle of a x b cells, with
a = ceil(sqrt(n)) and b = ceil(n / a), permutes cell numbers; a number that lands at n or beyond
walks on through the permutation until it lands inside (fewer than a cells are outside, so hardly
any row walks). The permuted number p gives shard p mod shards and slot p div shards: shard sizes
differ by one row at most (the law `rows`), and a row's place is computed from its number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, utf8

ROUNDS = 4
_LOCAL_BITS = (1 << 33) - 1


def rectangle(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(seed: int, i: int, half: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(i), half), F.lit(modulus))


def _permuted(df: DataFrame, column: str, a: int, b: int, seed: int) -> DataFrame:
    """`column` in 0..a*b-1 goes through the network once. A column per round keeps each half computed once."""
    df = df.withColumn("_l", F.floor(F.col(column) / F.lit(b)).cast("long")) if a * b < (1 << 52) else df.withColumn("_l", F.expr(f"{column} div {b}"))
    df = df.withColumn("_r", F.col(column) - F.col("_l") * b)
    for i in range(ROUNDS):
        if i % 2 == 0:
            df = df.withColumn("_l", (F.col("_l") + _round(seed, i, F.col("_r"), a)) % a)
        else:
            df = df.withColumn("_r", (F.col("_r") + _round(seed, i, F.col("_l"), b)) % b)
    return df.withColumn(column, F.col("_l") * b + F.col("_r")).drop("_l", "_r")


def longest_walk(spark: SparkSession, n: int, seed: int) -> int:
    """The number of passes after which every row is inside. The outside cells (fewer than sqrt(n)) are sent
    on together: each chain of them that a row can enter loses one cell a pass, and when none is lost,
    what is left are closed cycles, which no row enters."""
    a, b = rectangle(n)
    outside, left, passes = spark.range(n, a * b).withColumnRenamed("id", "_p"), a * b - n, 1
    while left:
        outside = materialise(_permuted(outside, "_p", a, b, seed).where(F.col("_p") >= n))
        passes, before, left = passes + 1, left, outside.count()
        if left == before:
            break
    return passes


def permute(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Replaces row numbers 0..n-1 in `column` by their place in the shuffle, a bijection of 0..n-1."""
    a, b = rectangle(n)
    df = _permuted(df, column, a, b, seed)
    for _ in range(longest_walk(df.sparkSession, n, seed) - 1):
        walked = _permuted(df.withColumn("_w", F.col(column)), "_w", a, b, seed)
        df = walked.withColumn(column, F.when(F.col(column) < n, F.col(column)).otherwise(F.col("_w"))).drop("_w")
    return df


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with `_n`, the row's place 0.. in the order of `keys`; no single task sees all rows.

    A range shuffle orders the rows, each task numbers its own, and one row per partition says how
    many came before. Equal rows are dealt over several ranges by a salt that only breaks ties.
    """
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    ordered = materialise(
        salted.repartitionByRange(*keys, "_salt")
        .sortWithinPartitions(*keys, "_salt")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)))
        .drop("_salt")
    )
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_count"))
    before = counts.select("_part", F.expr("sum(_count) over (order by _part) - _count").alias("_before"))
    return ordered.join(F.broadcast(before), "_part").withColumn("_n", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, `size` (UTF-8 bytes + 1), `text_crc32`, `law` ('rows'),
    `shard`, `slot` (gapless from 0 in each shard), `grown_shard` (null: this law moves rows when
    shards are added), `row_number` and `place`.

    Null ids come first; rows of one id are ordered by size and checksum; fully equal rows are
    interchangeable. The result depends on ids, texts, `shards` and `seed`, not on file layout.
    """
    slim = materialise(
        docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text")).select(
            "_id", (F.octet_length("_text") + 1).cast("long").alias("_size"), F.crc32("_text").alias("_crc")
        )
    )
    n = slim.count()
    rows = numbered(slim, ["_id", "_size", "_crc"]).withColumn("_p", F.col("_n"))
    rows = permute(rows, "_p", n, seed)
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.expr(f"_p div {int(shards)}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_n").alias("row_number"),
        F.col("_p").alias("place"),
    )
