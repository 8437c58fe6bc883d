"""Reading tables, intermediate tables in the folder that the cluster shares, and the memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; only where none is configured on one machine (tests) an own one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return _LOCAL_DIR[0]


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor
    costs no more than the tasks it was running."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns the memory that a Python worker has freed to the system, as the worker lives on beside the JVM and
    other workers. Allocators keep it otherwise."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches handed to Python hold at most `rows` rows, so that long texts fit; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
