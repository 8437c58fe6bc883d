"""Sources. All go through Spark's readers, so any file system works; schemas are declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import basename


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def qa_benchmark(spark: SparkSession, folder: str, name: str = "MMQA") -> dict[str, DataFrame]:
    """The benchmark's four files: dev questions, texts, images, tables."""
    return {
        kind: jsonl(spark, f"{folder}/{name}_{kind}.jsonl", schema)
        for kind, schema in (("dev", schemas.QA_DEV), ("texts", schemas.QA_TEXTS), ("images", schemas.QA_IMAGES), ("tables", schemas.QA_TABLES))
    }


def questions(dev: DataFrame) -> DataFrame:
    return dev.select(
        "qid",
        "question",
        F.col("answers.answer").alias("answers"),
        F.col("supporting_context.doc_id").alias("gold_ids"),
        F.col("supporting_context.doc_part").alias("gold_types"),
    )


def gold_context(dev: DataFrame, bench: dict[str, DataFrame]) -> DataFrame:
    """(`qid`, `id`, `doc_part`, `url`): every supporting item with the url of the lookup of its kind."""
    gold = dev.select("qid", F.explode("supporting_context").alias("c")).select("qid", F.col("c.doc_id").alias("id"), F.col("c.doc_part").alias("doc_part"))
    for kind in ("text", "image", "table"):
        found = bench[f"{kind}s"].select("id", F.col("url").alias(f"_{kind}")).withColumn("doc_part", F.lit(kind))
        gold = gold.join(found, ["id", "doc_part"], "left")
    return gold.select("qid", "id", "doc_part", F.coalesce("_text", "_image", "_table").alias("url"))


def items_by_id(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def parsed_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    read = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return read.select(basename(F.col("_metadata.file_path")).alias("title"), F.col("value").alias("html"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(`image`, `stem`, `content`), files without an extension left out."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("image"), basename(F.col("path")).alias("stem"), "content").where(F.contains("image", F.lit(".")))


def image_metadata(descriptions: DataFrame, detections: DataFrame) -> DataFrame:
    """Descriptions with their boxes, none being an empty list."""
    boxes = detections.select("image", "bboxes")
    return descriptions.join(boxes, "image", "left").withColumn("bboxes", F.coalesce("bboxes", F.array().cast("array<array<int>>")))


def retrieval_components(results: DataFrame, components: DataFrame) -> DataFrame:
    """Results (`qid`, `final_component_id_list`) as ordered lists of titled components."""
    one = results.select("qid", F.posexplode("final_component_id_list").alias("pos", "component_id"))
    joined = one.join(components, "component_id", "left")
    rest = [c for c in components.columns if c not in ("component_id", "doc_title")]
    return joined.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_title", *rest))).alias("components"))
