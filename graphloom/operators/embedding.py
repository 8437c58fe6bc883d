"""Component embedding: what of a component is embedded as a whole and in parts, and its vectors.

A component is told by (`doc_title`, `idx`). Files of processed images are rows (`image`, `path`), their
descriptions rows (`image`, `explanation`, `ocr`, `bboxes`); `image` is a cleaned name with `.png`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import component_prefix, flatten_table, image_text, links, remove_newlines, sentences, url_name
from .models import Embedder, each_row

PARTS = "array<struct<text:string,image:string,box:array<int>>>"
KEY = ["doc_title", "idx"]


def processed_name(c: Column) -> Column:
    """The name under which the image of an address is stored after normalising."""
    return F.concat(url_name(c), F.lit(".png"))


def table_images(tables: DataFrame, files: DataFrame) -> DataFrame:
    """(`doc_title`, `idx`, `_row`, `_at`, `_link`, `image`, `path`): the links of each table's rows whose file exists."""
    rows = tables.select(*KEY, F.posexplode("table").alias("_row", "_cells"))
    named = rows.select(*KEY, "_row", F.posexplode(F.flatten(F.transform("_cells", links))).alias("_at", "_link"))
    return named.withColumn("image", processed_name(F.col("_link"))).join(files.select("image", "path"), "image").select(*KEY, "_row", "_at", "_link", "image", "path")


def _part(text: Column, image: Column | None = None, box: Column | None = None) -> Column:
    return F.struct(
        text.alias("text"),
        (F.lit(None).cast("string") if image is None else image).alias("image"),
        (F.lit(None).cast("array<int>") if box is None else box).alias("box"),
    )


def component_parts(components: DataFrame, files: DataFrame, metadata: DataFrame, split: Callable[[Column], Column] = sentences) -> DataFrame:
    """`components` with `parts`: first the whole component, then its sub-components (texts with an image and a box).

    Paragraphs have a part for each sentence, tables for each row under the header, images for each box; an
    image without boxes has no parts, its sub-component is the whole. Left out are empty tables, images
    without a file or a description, and types that aren't known. In a table an image without a
    description has an empty one.
    """
    prefix = component_prefix(F.col("doc_title"), F.coalesce("heading_path", F.array().cast("array<string>")))
    text = F.coalesce("paragraph", F.lit(""))
    own = F.array(_part(remove_newlines(F.concat(prefix, text)))).cast(PARTS)
    subs = F.transform(split(text), lambda s: _part(F.concat(prefix, remove_newlines(s)))).cast(PARTS)
    paragraphs = components.where("type = 'paragraph'").withColumn("parts", F.concat(own, subs))

    tables = components.where("type = 'table' and size(table) > 0")
    described = table_images(tables, files).join(metadata.select("image", "explanation"), "image", "left")
    name = F.regexp_replace("image", r"\.png$", "").alias("name")
    listed = described.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("_row", "_at", name, F.coalesce("explanation", F.lit("")).alias("explanation"), "path"))).alias("_images")
    )
    none = F.array().cast("array<struct<_row:int,_at:int,name:string,explanation:string,path:string>>")

    def lines(rows: Column, images: Column, before: Column) -> Column:
        return _part(remove_newlines(F.concat(before, flatten_table(rows, images))), F.try_element_at(images, F.lit(1))["path"])

    table, images = F.col("table"), F.coalesce("_images", none)
    one = F.array(lines(table, images, prefix)).cast(PARTS)
    several = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(table) - 1, F.lit(1))),
        lambda r: lines(F.array(F.get(table, F.lit(0)), F.get(table, r)), F.filter(images, lambda i: (i["_row"] == 0) | (i["_row"] == r)), prefix),
    ).cast(PARTS)
    whole = F.array(lines(table, images, F.lit(""))).cast(PARTS)
    tables = tables.join(listed, KEY, "left").withColumn("parts", F.concat(whole, F.when(F.size(table) <= 2, one).otherwise(several))).drop("_images")

    known = files.select("image", "path").join(metadata.select("image", "explanation", "ocr", "bboxes"), "image").toDF("_image", "_path", "_explanation", "_ocr", "_boxes")
    pictures = components.where("type = 'image'").withColumn("_image", processed_name(F.col("src"))).join(known, "_image")
    said = image_text(prefix, F.col("caption"), F.col("_explanation"), F.col("_ocr"))
    boxed = F.transform(F.coalesce("_boxes", F.array().cast("array<array<int>>")), lambda b: _part(said, F.col("_path"), b)).cast(PARTS)
    pictures = pictures.withColumn("parts", F.concat(F.array(_part(said, F.col("_path"))).cast(PARTS), boxed)).drop("_image", "_path", "_explanation", "_ocr", "_boxes")
    return paragraphs.unionByName(tables).unionByName(pictures)


def part_vectors(model: Embedder, parts: str = "parts", batch: int = 256) -> Column:
    """A struct of `vectors`, one for each part, and `error` if any of them failed; parts of all rows share calls."""

    @F.pandas_udf("vectors array<array<float>>, error string")
    def embed(texts: pd.Series, images: pd.Series, boxes: pd.Series) -> pd.DataFrame:
        flat = [(t, i, None if b is None else [int(v) for v in b]) for row in zip(texts, images, boxes) for t, i, b in zip(*row)]
        made, errors = {}, {}
        for at in range(0, len(flat), batch):
            rows = list(range(at, min(at + batch, len(flat))))
            one, bad = each_row(lambda ks: list(model.embed([flat[k][0] for k in ks], [flat[k][1] for k in ks], [flat[k][2] for k in ks], None)), rows)
            made |= one
            errors |= bad
        out, at = [], 0
        for ts in texts:
            own = range(at, at + len(ts))
            at += len(ts)
            wrong = next((errors[k] for k in own if k in errors), None)
            out.append((None if wrong else [made[k] for k in own], wrong))
        return pd.DataFrame(out, columns=["vectors", "error"])

    return embed(F.col(f"{parts}.text"), F.col(f"{parts}.image"), F.col(f"{parts}.box"))


def embed_components(components: DataFrame, files: DataFrame, metadata: DataFrame, model: Embedder, split: Callable[[Column], Column] = sentences) -> DataFrame:
    """The components that can be embedded, with `embedding`, `vectors` (of the sub-components) and `error`."""
    made = component_parts(components, files, metadata, split).withColumn("_v", part_vectors(model)).drop("parts")
    whole = F.try_element_at(F.col("_v.vectors"), F.lit(1))
    rest = F.when(F.size("_v.vectors") > 1, F.slice("_v.vectors", F.lit(2), F.size("_v.vectors") - 1)).when(whole.isNotNull(), F.array(whole))
    return made.select("*", whole.alias("embedding"), rest.alias("vectors"), F.col("_v.error").alias("error")).drop("_v")


def stored_documents(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of whole documents, and (`doc_title`, `error`) of documents of which any component failed: those
    are left out as a whole, so that a later run does them again. `embedded` should be materialised."""
    failed = embedded.where("error is not null").groupBy("doc_title").agg(F.min("error").alias("error"))
    return embedded.join(failed.select("doc_title"), "doc_title", "left_anti").drop("error"), failed
