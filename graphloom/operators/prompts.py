"""Prompts as columns: evidence blocks, numbered images, and the whole prompt of a question.

Instruction and demonstration texts are data, handed in as `Templates`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import links, without_links


@dataclass(frozen=True)
class Templates:
    instruction: str = "Answer the question from the passages and tables below. Call f_answers([...]) with a short answer.\n\n"
    instruction_with_images: str = "Answer the question from the passages, tables and images below. Call f_answers([...]) with a short answer.\n\n"
    demonstration: str = ""
    decompose: str = "Split the question into sub-queries, separated by semicolons.\nQuestion: {query}\nOutput: "
    modality: str = "Choose one modality for the sub-query: text, table or image.\nSubquery: {subquery}\nOutput: "


def filled(template: str, name: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{" + name + "}"), value)


def _head(kind: str, title: Column, section: Column) -> Column:
    return F.concat(F.lit(f"/*\n[{kind}]\nTitle: "), title, F.lit("\nSection: "), F.array_join(section, ", "), F.lit("\n\n"))


def passage_block(title: Column, section: Column, text: Column) -> Column:
    """`section`: the heading path, an array."""
    return F.concat(_head("Passage", title, section), text, F.lit("\n*/\n\n"))


def _first_links(table: Column) -> Column:
    """The first link of every cell, row by row; null in cells without one."""
    return F.transform(F.flatten(table), lambda c: F.try_element_at(links(c), F.lit(1)))


def first_table_image(table: Column, existing: Column) -> Column:
    """The first cell's first link that is in the array `existing`; null without one. Cells are looked up by hash."""
    return F.get(F.array_intersect(F.array_compact(_first_links(table)), existing), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often the elements of an array need it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table_block(title: Column, section: Column, table: Column, image: Column | None = None, number: Column | None = None) -> Column:
    """Cells by ` | `, a row a line. The first cell that begins its links with `image` (see `first_table_image`)
    is marked as image `number`; no cell where either is null. Work is in proportion to the cells."""

    def cell(c: Column) -> Column:
        return F.regexp_replace(without_links(c), r"\s*,\s*", " , ")

    def lines(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda r: F.concat(F.array_join(r, " | "), F.lit("\n"))), "")

    def marked(x: Column) -> Column:
        def line(r: Column, i: Column) -> Column:
            marks = F.transform(r, lambda c, j: F.concat(F.when(j == x["place"]["cell"], x["tag"]).otherwise(""), c))
            return F.when(i == x["place"]["row"], marks).otherwise(r)

        return lines(F.transform(x["cells"], line))

    cells = F.transform(table, lambda r: F.transform(r, cell))
    if image is None or number is None:
        body = lines(cells)
    else:
        wanted = F.when(number.isNotNull(), image)
        begins = F.transform(table, lambda r: F.transform(r, lambda c: F.get(links(c), F.lit(0))))

        def found(y: Column) -> Column:
            row = F.array_position(F.transform(y["begins"], lambda r: F.coalesce(F.array_contains(r, y["wanted"]), F.lit(False))), F.lit(True)) - 1
            return bound(F.struct(row.alias("row"), y["begins"].alias("begins"), y["wanted"].alias("wanted")), placed)

        def placed(z: Column) -> Column:
            at = F.array_position(F.get(z["begins"], z["row"].cast("int")), z["wanted"]) - 1
            return F.struct(z["row"].alias("row"), at.alias("cell"))

        # the image's own commas go apart as the cell's do
        tag = F.regexp_replace(F.concat(F.lit("<Image "), F.coalesce(number.cast("string"), F.lit("")), F.lit(">, ")), r"\s*,\s*", " , ")
        place = bound(F.struct(begins.alias("begins"), wanted.alias("wanted")), found)
        body = bound(F.struct(cells.alias("cells"), place.alias("place"), tag.alias("tag")), marked)
    return F.concat(_head("Table", title, section), body, F.lit("*/\n\n"))


def image_block(title: Column, section: Column, caption: Column, number: Column) -> Column:
    """`number` is null where the image's file doesn't exist, which leaves the head alone."""
    body = F.concat(F.lit("<Image "), number.cast("string"), F.lit(">\nCaption: "), F.coalesce(caption, F.lit("")), F.lit("\n"))
    return F.concat(_head("Image", title, section), F.coalesce(body, F.lit("")), F.lit("*/\n\n"))


def number_images(evidence: DataFrame) -> DataFrame:
    """`evidence` (`qid`, `pos`, `has_image`) with `image_no`, counted from 0 in each prompt; null without an image."""
    w = Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return evidence.withColumn("image_no", F.when(F.col("has_image"), F.sum(F.col("has_image").cast("int")).over(w) - 1))


def question_prompts(blocks: DataFrame, questions: DataFrame, templates: Templates = Templates()) -> DataFrame:
    """(`qid`, `prompt`) from blocks (`qid`, `pos`, `block`, `is_image`), in the order of `pos`."""
    body = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"), F.max("is_image").alias("i"))
    head = F.when(F.coalesce("i", F.lit(False)), templates.instruction_with_images).otherwise(templates.instruction)
    return questions.join(body, "qid", "left").select(
        "qid",
        F.concat(
            head,
            F.lit(templates.demonstration + "\n"),
            F.coalesce(F.array_join(F.col("b.block"), "\n"), F.lit("")),
            F.lit("\nQuestion = "),
            F.col("question"),
            F.lit("\nThe answer is: "),
        ).alias("prompt"),
    )
