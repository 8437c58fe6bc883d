"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import give_back, materialise, new_folder, shared_dir, small_batches, table

__all__ = ["give_back", "materialise", "new_folder", "shared_dir", "small_batches", "table"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

_HELD: dict[Any, Any] = {}


def held(owner: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, of one owner at a time: a worker that goes on with another
    operator gives back what the one before had stored."""
    if owner not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[owner] = make()
    return _HELD[owner]


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that an operator kept, all columns as they were.

    `decided` has a row per row of `docs`: the id, `text_sha256` and `kept`. Rows are told by id and
    checksum, and those that go are taken out, so that texts aren't shuffled for the many that stay. Where
    such a pair repeats (the same row given twice) and stays, one of its copies is chosen in a branch of
    its own that reads nothing else. Null ids and texts are told like any other; no row, no result.
    """
    this_id, this_sha = free_name(docs, "_keep_id"), free_name(docs, "_keep_sha")
    sha = F.sha2(utf8(text_col), 256)
    keys = materialise(
        decided.groupBy(F.col(id_col).alias(this_id), F.col("text_sha256").alias(this_sha))
        .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_copies"))
        .where("not _kept or _copies > 1")
    )
    same = F.col(this_id).eqNullSafe(docs[id_col]) & (F.col(this_sha) == sha)
    single = docs.join(keys.select(this_id, this_sha), same, "left_anti")
    several = keys.where("_kept").select(this_id, this_sha)
    if several.isEmpty():
        return single
    repeated = docs.join(several, same, "left_semi").withColumn(this_sha, sha).dropDuplicates([id_col, this_sha]).drop(this_sha)
    return single.unionByName(repeated)
