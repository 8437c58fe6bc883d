"""Questions asked over retrieved components: evidence blocks with numbered images, prompts, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import processed_name, table_images
from .evaluation import strict_join
from .models import Generator, generated
from .prompts import Templates, first_table_image, image_block, number_images, passage_block, question_prompts, table_block


def evidence(results: DataFrame, components: DataFrame, files: DataFrame) -> DataFrame:
    """(`qid`, `pos`, `block`, `is_image`, `path`) for results (`qid`, `rank`, `component_id`).

    A table shows the first image of a cell whose file is among `files` (`image`, `path`), an image component its
    own; they are numbered through a prompt. `path` is null where nothing is shown.
    """
    shown = results.select("qid", F.col("rank").alias("pos"), "component_id").join(
        components.select("component_id", "doc_title", "idx", "type", "heading_path", "paragraph", "table", "src", "caption"), "component_id"
    )
    asked = shown.where("type = 'table'").select("doc_title", "idx", "table").dropDuplicates(["doc_title", "idx"])
    existing = table_images(asked, files).groupBy("doc_title", "idx").agg(
        F.collect_set("_link").alias("_links"), F.map_from_entries(F.collect_set(F.struct("_link", "path"))).alias("_paths")
    )
    own = files.select(F.col("image").alias("_image"), F.col("path").alias("_own"))
    rows = shown.join(existing, ["doc_title", "idx"], "left").withColumn("_image", F.when(F.col("type") == "image", processed_name(F.col("src")))).join(own, "_image", "left")
    first = F.when(F.col("type") == "table", first_table_image(F.col("table"), F.coalesce("_links", F.array().cast("array<string>"))))
    rows = rows.withColumn("_first", first).withColumn("path", F.coalesce("_own", F.try_element_at("_paths", F.col("_first"))))
    rows = number_images(rows.withColumn("has_image", F.col("path").isNotNull()))
    section = F.coalesce("heading_path", F.array().cast("array<string>"))
    block = (
        F.when(F.col("type") == "paragraph", passage_block(F.col("doc_title"), section, F.coalesce("paragraph", F.lit(""))))
        .when(F.col("type") == "table", table_block(F.col("doc_title"), section, F.col("table"), F.col("_first"), F.col("image_no")))
        .when(F.col("type") == "image", image_block(F.col("doc_title"), section, F.col("caption"), F.col("image_no")))
    )
    return rows.select("qid", "pos", block.alias("block"), (F.col("type") == "image").alias("is_image"), "path")


def ask(
    questions: DataFrame, results: DataFrame, components: DataFrame, files: DataFrame, generator: Generator, templates: Templates = Templates(), max_tokens: int = 4096
) -> DataFrame:
    """(`qid`, `prompt`, `images`, `answer`, `error`): a failed call answers `[Generation Failed]`. A question
    without a result row fails the query. Materialise the answers before they are used twice."""
    questions = strict_join(questions, results.groupBy("qid").agg(F.count("*").alias("_n"))).where("_n > 0").drop("_n")
    blocks = evidence(results, components, files)
    images = blocks.where("path is not null").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("_i")).select("qid", F.col("_i.path").alias("images"))
    prompts = question_prompts(blocks.where("block is not null"), questions, templates).join(images, "qid", "left")
    prompts = prompts.withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
    asked = prompts.withColumn("_g", generated(generator, F.col("prompt"), F.col("images"), max_tokens))
    return asked.select("qid", "prompt", "images", F.col("_g.text").alias("answer"), F.col("_g.error").alias("error"))
