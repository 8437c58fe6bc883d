"""Incremental runs of a batch stage over arriving files, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_on_new_files(
    spark: SparkSession, folder: str, schema: str, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_each: int = 1000
) -> StreamingQuery:
    """Applies `stage` once to all files that came since the last run, and appends its rows to `out`. A batch that
    is repeated after a failure replaces its own output, so every file counts once."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).json(folder)

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
