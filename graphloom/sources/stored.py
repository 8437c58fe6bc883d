"""Stored tables of the stages: documents with vectors, the graph, cached questions, and files by name."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import Adjacency
from ..tables import materialise


@dataclass(frozen=True)
class Graph:
    components: DataFrame
    subs: DataFrame
    adjacency: Adjacency

    @property
    def edges(self) -> DataFrame:
        return self.adjacency.edges()


#: The tables of a stored graph: by which column each is dealt to files of its own, so that hops join them as they lie.
BUCKETS = {"components": "component_id", "subs": "component_id", "member_docs": "component_id", "doc_members": "doc", "key_members": "key", "links": "component_id"}


class IncompleteTable(RuntimeError):
    """A stored table lacks files or rows that were written."""


MANIFEST = "name string, rows long, schema string, buckets int, folder string"


def _read(spark: SparkSession, path: str, fmt: str, schema: str | StructType | None, skip: bool = False) -> DataFrame:
    # both kinds of options: a table is never read in part without a word
    reader = spark.read.options(ignoreCorruptFiles=skip, ignoreMissingFiles=False).format(fmt)
    try:
        found = (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(path) from e
        raise
    return found


def _columns(found: DataFrame) -> DataFrame:
    """Without the column of the runs (see `sinks`)."""
    return found.drop("run")


def _counts(found: DataFrame) -> DataFrame:
    return found.select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


def record(spark: SparkSession, path: str, fmt: str = "parquet", folder: str = "", buckets: int | None = None) -> None:
    """Writes the files and their rows of a table, or of one of its folders, to the table's manifest."""
    try:
        written = _read(spark, f"{path}/{folder}".rstrip("/"), fmt, None)
    except FileNotFoundError:  # no rows, no files
        return
    rows = _counts(written).withColumns({"schema": F.lit(written.schema.json()), "buckets": F.lit(buckets), "folder": F.lit(folder or "all")})
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").json(f"{path}/_manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return _read(spark, f"{path}/_manifest", "json", MANIFEST)
    except FileNotFoundError:
        return None


def missing_files(spark: SparkSession, path: str, found: DataFrame) -> list[str]:
    """Files of the manifest that aren't there; names only, as Spark's own listing has them."""
    written = _manifest(spark, path)
    if written is None:
        return []
    there = {unquote(f.rpartition("/")[2]) for f in found.inputFiles()}
    return sorted(r["name"] for r in written.where("rows > 0").select("name").collect() if r["name"] not in there)


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None, counted: bool = False) -> DataFrame:
    """A stored table. FileNotFoundError where there is none, IncompleteTable where files of its manifest are gone (or rows of
    them, if they are `counted`); a file that can't be read fails the query that reads it."""
    found = _read(spark, path, fmt, schema)
    if gone := missing_files(spark, path, found):
        raise IncompleteTable(f"{path}: {len(gone)} files are gone, {gone[0]} among them")
    written = _manifest(spark, path) if counted else None
    if written is not None:
        short = written.join(_counts(found).withColumnRenamed("rows", "there"), "name", "left").where("rows <> coalesce(there, 0)").limit(1).collect()
        if short:
            raise IncompleteTable(f"{path}: {short[0]['name']} has {short[0]['there'] or 0} of {short[0]['rows']} rows")
    return _columns(found)


def load_readable(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of all files that are whole, and (`name`, `error`) of the others: gone, unreadable, or with fewer rows than
    were written. A file counts as a whole, so no item of it is there in part. Without a manifest, as `load`."""
    written = _manifest(spark, path)
    one = written.select("schema").first() if written is not None else None
    if one is None:
        return load(spark, path, fmt, schema), spark.createDataFrame([], "name string, error string")
    found = _read(spark, path, fmt, schema or StructType.fromJson(json.loads(one["schema"])), skip=True)
    there = _counts(found).withColumnRenamed("rows", "there")
    short = written.join(there, "name", "left").where("rows <> coalesce(there, 0)")
    bad = materialise(short.select("name", F.concat(F.lit("rows read: "), F.coalesce("there", F.lit(0)), F.lit(" of "), "rows").alias("error")))
    if bad.isEmpty():
        return _columns(found), bad
    named = found.withColumn("_file", F.col("_metadata.file_name"))
    whole = named.join(bad.select(F.col("name").alias("_file")), "_file", "left_anti").drop("_file")
    return _columns(whole), bad


def load_or_empty(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    try:
        return load(spark, path, fmt, schema)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def _name() -> str:
    return f"graphloom_{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, by: str | None = None, buckets: int | None = None) -> None:
    """A new table with its manifest; refuses to write where something exists. With `by` it is dealt to `buckets` by that column (as many
    as a shuffle has partitions, if not told) and sorted in each."""
    spark = df.sparkSession
    buckets = by and (buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if by is None:
        df.write.mode("errorifexists").parquet(path)
    else:
        name = _name()
        _refuse(spark, path)
        df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).format("parquet").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
    record(spark, path, buckets=buckets)


def _refuse(spark: SparkSession, path: str) -> None:
    try:
        _read(spark, path, "parquet", None)
    except FileNotFoundError:
        return
    raise FileExistsError(f"{path} exists")


def load_bucketed(spark: SparkSession, path: str, by: str) -> DataFrame:
    """A table that `save` dealt by a column: joins on it need no shuffle of this side. Files and rows are checked. The table has a
    name of its own in the session's catalog, which only the frame uses."""
    found, name = load(spark, path, counted=True), _name()
    written = _manifest(spark, path)
    one = written.select("buckets").first() if written is not None else None
    if one is None or one["buckets"] is None:  # no rows, or not dealt
        return found
    schema, buckets = found.schema, one["buckets"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def save_graph(components: DataFrame, adjacency: Adjacency, path: str, buckets: int | None = None) -> None:
    """`components` with `component_id`, `embedding` and `vectors`; refuses to write where a graph exists. The links
    come last, so a graph whose writing was broken off can't be loaded."""
    made = {
        "components": components.drop("vectors"),
        "subs": components.select("component_id", "vectors"),
        "member_docs": adjacency.docs,
        "doc_members": adjacency.members,
        "key_members": adjacency.named,
        "links": adjacency.links,
    }
    for name, by in BUCKETS.items():
        save(made[name], f"{path}/{name}", by, buckets)


def load_graph(spark: SparkSession, path: str) -> Graph:
    """All of a stored graph, files and rows checked: no answer comes from a part of it."""
    found = {name: load_bucketed(spark, f"{path}/{name}", by) for name, by in BUCKETS.items()}
    return Graph(found["components"], found["subs"], Adjacency(found["member_docs"], found["doc_members"], found["key_members"], found["links"]))


def save_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """(`name`, `path`, `error`): each row's content written as a file of its own; done lazily, so materialise it.

    A file gets its name when it is complete. `folder`: a uri of any file system that Arrow knows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            out = []
            for n, c in zip(pdf["name"], pdf["content"]):
                try:
                    part = f"{root}/.{uuid.uuid4().hex}.part"  # Spark's readers don't see names with a dot in front
                    with store.open_output_stream(part) as f:
                        f.write(bytes(c))
                    store.move(part, f"{root}/{n}")
                    out.append((n, f"{folder.rstrip('/')}/{n}", None))
                except Exception as e:  # noqa: BLE001
                    out.append((n, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "path", "error"])

    return rows.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(write, "name string, path string, error string")


def tagged_json(kind: str = "type") -> Column:
    """A component as JSON with its type and the fields of that type only; null for an unknown one."""
    shared = [F.col(c) for c in (kind, "heading_path", "edge")]
    own = {"paragraph": ["paragraph"], "table": ["table"], "image": ["src", "caption"]}
    made = [F.when(F.col(kind) == k, F.to_json(F.struct(*shared, *own[k]), {"ignoreNullFields": "false"})) for k in own]
    return F.coalesce(*made)


def as_pages(components: DataFrame) -> DataFrame:
    """Components (`page_id`, `idx` and their fields) as pages (`title`, `comp_data`)."""
    fields = ["type", "heading_path", "edge", "paragraph", "src", "caption", "table"]
    listed = components.groupBy(F.col("page_id").alias("title")).agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("c")))).alias("_c"))
    return listed.select("title", F.col("_c.c").alias("comp_data"))
