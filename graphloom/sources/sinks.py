"""Sinks: results and dead letters, written once, resumable.

A run of a stage appends its rows as one partition `run=<id>`, which comes into being by one rename when all of it is
written. A run that dies before leaves nothing that a reader sees, and one that is repeated under its id replaces its own rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..tables import materialise
from . import stored

RUN = "run"


def new_run() -> str:
    return uuid.uuid4().hex


def write_new(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Refuses to write where something exists."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_over(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """In place of what is there; `df` must not read it."""
    materialise(df).write.mode("overwrite").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet", run: str | None = None) -> int:
    """Adds the rows of one run, in place of those that an earlier try of it left, and says how many they are. Their
    files and counts go to the table's manifest."""
    spark, run, seen = df.sparkSession, run or new_run(), Observation(uuid.uuid4().hex)
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn(RUN, F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).format(fmt).save(path)
    stored.record(spark, path, fmt, f"{RUN}={run}")
    return int(seen.get["n"])


def replace_failed(failed: DataFrame, attempted: DataFrame, path: str, key: str, fmt: str = "parquet") -> int:
    """The dead letters after a run: what failed now, and what failed earlier and wasn't tried again. An item that succeeds
    is no longer among them. Were the table lost while it is replaced, its items would only be tried again."""
    spark, seen = failed.sparkSession, Observation(uuid.uuid4().hex)
    earlier = stored.load_or_empty(spark, path, failed.schema, fmt)
    kept = earlier.select(failed.columns).join(attempted.select(key).distinct(), key, "left_anti").select(failed.columns)
    both = materialise(failed.observe(seen, F.count(F.lit(1)).alias("n")).unionByName(kept))
    both.write.mode("overwrite").format(fmt).save(path)
    return int(seen.get["n"])


def split_failed(
    results: DataFrame, ok_path: str, failed_path: str, error: str = "error", fmt: str = "parquet", key: str | None = None, run: str | None = None
) -> DataFrame:
    """Good rows to one table, rows with an error to another; returns total, success and failed, counted while they are written.
    `results` should be materialised, as it is read once for each. With a `key`, an item's earlier error goes when
    it was tried again."""
    good = append(results.where(F.col(error).isNull()).drop(error), ok_path, fmt, run)
    bad = results.where(F.col(error).isNotNull())
    failed = replace_failed(bad, results, failed_path, key, fmt) if key else append(bad, failed_path, fmt, run)
    return results.sparkSession.createDataFrame([(good + failed, good, failed)], "total long, success long, failed long")


def still_to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of `wanted` that aren't in `done`: a restart goes on where it stopped."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
