"""Retrieval and answer metrics. Rates are null over no questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_answer, parse_answers
from .knn import dense_topk


def require_all(results: DataFrame, truth: DataFrame, on: str = "qid") -> None:
    """Every result must have a truth row."""
    missing = results.join(truth, on, "left_anti").select(on).take(1)
    if missing:
        raise KeyError(f"no truth for {on} {missing[0][0]}")


def strict_join(results: DataFrame, truth: DataFrame, on: str = "qid") -> DataFrame:
    """`results` with the other columns of their truth row. A result without one fails the query that reads any of these
    columns: the check is part of the plan and no job of its own."""
    there, missing = "_there", F.col("_there").isNull()
    error = F.raise_error(F.concat(F.lit(f"no truth for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    joined = results.join(truth.withColumn(there, F.lit(True)), on, "left")
    checked = [F.when(missing, error.cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in truth.schema if f.name != on]
    return joined.select(*results.columns, *checked)


def match_rates(joined: DataFrame, gold: str = "gold", found: str = "found") -> DataFrame:
    """One row: `n`, `exists_n`, `exists_rate`, `perfect_n`, `perfect_rate`. An empty gold list is perfect, but doesn't exist."""
    exists = F.coalesce(F.arrays_overlap(gold, found), F.lit(False))
    perfect = F.size(F.array_except(gold, found)) == 0
    return joined.agg(F.count("*").alias("n"), F.count_if(exists).alias("exists_n"), F.count_if(perfect).alias("perfect_n")).select(
        "n", "exists_n", F.try_divide("exists_n", "n").alias("exists_rate"), "perfect_n", F.try_divide("perfect_n", "n").alias("perfect_rate")
    )


def reciprocal_rank(gold: Column, found: Column) -> Column:
    """1 / rank of the first found item that is gold; 0 without any."""
    hits = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(hits) > 0, 1.0 / F.element_at(hits, 1)).otherwise(0.0)


def mean_reciprocal_rank(joined: DataFrame, gold: str = "gold", found: str = "found") -> DataFrame:
    return joined.agg(F.count("*").alias("n"), F.avg(reciprocal_rank(F.col(gold), F.col(found))).alias("mrr"))


def _normal_set(answers: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(answers, normalize_answer)))


def answer_scores(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """(`qid`, `em`, `f1`) of generated outputs (`qid`, `answer`) against `qid`, `answers`. An answer whose question
    isn't in `truth` is an error; questions with an empty truth don't count."""
    joined = strict_join(answers.select("qid", "answer"), truth.select("qid", "answers")).where(F.size("answers") > 0).select(
        "qid", _normal_set(parse_answers(F.col("answer"))).alias("p"), _normal_set(F.col("answers")).alias("t")
    )
    shared = F.size(F.array_intersect("p", "t"))
    # 2PR/(P+R) of sets is 2 * shared / (sizes added)
    f1 = F.when(F.size("p") + F.size("t") > 0, 2.0 * shared / (F.size("p") + F.size("t"))).otherwise(0.0)
    return joined.select("qid", (F.col("p") == F.col("t")).cast("int").alias("em"), f1.alias("f1"))


def em_f1(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: `n`, `em` and `f1` in percent, 0 over no questions."""
    s = answer_scores(answers, truth)
    return s.agg(F.count("*").alias("n"), (F.coalesce(F.avg("em"), F.lit(0.0)) * 100).alias("em"), (F.coalesce(F.avg("f1"), F.lit(0.0)) * 100).alias("f1"))


def batch_summary(results: DataFrame, error: str = "error") -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col(error).isNull()).alias("success"), F.count_if(F.col(error).isNotNull()).alias("failed"))


def dense_baseline(questions: DataFrame, components: DataFrame, gold: DataFrame, k: int = 9) -> DataFrame:
    """(`qid`, `gold`, `found`): the dense search's answer to compare a retriever with. `questions`: `qid`, `embedding`;
    `components`: `component_id`, `embedding`, `uuids`; `gold`: `qid`, `gold`. `found` has the distinct uuids of the k nearest
    components in their order; a question without any near component finds none, one without a gold row is an error."""
    near = dense_topk(questions, components, k).join(components.select("component_id", "uuids"), "component_id")
    listed = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "uuids"))).alias("_r"))
    uuids = F.array_distinct(F.flatten(F.filter(F.col("_r.uuids"), lambda u: u.isNotNull())))
    found = questions.select("qid").join(listed, "qid", "left").select("qid", F.coalesce(uuids, F.array().cast("array<string>")).alias("found"))
    return strict_join(found, gold.select("qid", "gold")).select("qid", "gold", "found")
