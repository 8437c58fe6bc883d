"""Exact dense top-k search: queries in bounded blocks against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import products
from ..tables import materialise

#: So many products are made at once.
TILE = 1 << 17


def dense_topk(
    queries: DataFrame, rows: DataFrame, k: int, block: int = 2048, newest_first: bool = False, vector: str = "embedding"
) -> DataFrame:
    """(`qid`, `component_id`, `score`, `rank` from 1) for the k rows with the largest products.

    Ties go to the smaller id (`newest_first`: to the larger). `queries`: `qid`, `embedding`; `rows`:
    `component_id`, `embedding`. Null vectors are skipped. Queries are sent to the tasks in blocks of at most `block`, and at most
    so many that a block's results fit 2^20 numbers; a block's broadcast is destroyed before the next one is sent, and each
    block reads the rows once. Rows are scored at most 2^17 products at a time, whatever a batch holds, and a task keeps the k best of
    each query over all of its batches, so that at most tasks * queries * k rows leave the tasks and a task's memory depends
    on `block` and k alone. Products are those of `vectors.dot`, so equal vectors have equal scores.
    """
    spark = rows.sparkSession
    block = max(1, min(block, (1 << 20) // k))
    wanted = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding")
    numbered = materialise(wanted.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-wanted.count() // block))))))
    blocks = [r[0] for r in numbered.select("_b").distinct().collect()]
    kinds = {c: t for c, t in [*queries.dtypes, *rows.dtypes] if c in ("qid", "component_id")}
    schema = f"qid {kinds['qid']}, component_id {kinds['component_id']}, score double"
    sign = -1 if newest_first else 1
    slim = rows.select("component_id", F.col(vector).alias("_v")).where("_v is not null")

    def searched(b: int) -> DataFrame:
        some = numbered.where(F.col("_b") == b).select("qid", "embedding").orderBy("qid").collect()
        held = spark.sparkContext.broadcast((pd.Series([r[0] for r in some]).to_numpy(), np.array([r[1] for r in some], float)))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q = held.value
            best = Best(q, k, sign)
            step = max(1, TILE // max(1, len(q)))
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    part = pdf.iloc[at : at + step]
                    best.add(part["component_id"].to_numpy(), np.stack(part["_v"].to_numpy()).astype(float))
            best.settle()
            for at in range(0, len(best.rows), TILE):
                own = slice(at, at + TILE)
                yield pd.DataFrame({"qid": qids[best.rows[own]], "component_id": best.ids[own], "score": best.scores[own]})

        found = materialise(slim.mapInPandas(search, schema))
        held.destroy()
        return found

    if not blocks:
        return spark.createDataFrame([], schema + ", rank int")
    found = reduce(DataFrame.unionByName, map(searched, blocks))
    tie = F.desc("component_id") if newest_first else F.asc("component_id")
    window = Window.partitionBy("qid").orderBy(F.desc("score"), tie)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


class Best:
    """The k best ids of each query so far: the largest scores (a NaN is the largest), of equal ones the smallest `sign * id`.
    What may be one of them is collected until there is as much of it as there are results, then the best are picked."""

    def __init__(self, queries: np.ndarray, k: int, sign: int = 1) -> None:
        self.queries, self.k, self.sign = queries, k, sign
        self.least = np.full(len(queries), -np.inf)  # what a further score has to reach
        self.rows, self.ids, self.scores = np.zeros(0, np.int32), None, np.zeros(0)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = products(self.queries, vectors)
        rows, at = np.nonzero(~(scores < self.least[:, None]))
        self.more.append((rows.astype(np.int32), ids[at], scores[rows, at]))
        self.waiting += len(rows)
        if self.waiting >= max(TILE, len(self.rows)):
            self.settle()

    def settle(self) -> None:
        if not self.more:
            return
        held = [(self.rows, self.ids, self.scores)] if self.ids is not None else []
        rows, ids, scores = (np.concatenate(x) for x in zip(*held, *self.more))
        self.more, self.waiting = [], 0
        order = np.lexsort((self.sign * ids, -scores, ~np.isnan(scores), rows))
        counts = np.bincount(rows, minlength=len(self.queries))
        ends = np.cumsum(counts)
        kept = order[np.arange(len(rows)) - np.repeat(ends - counts, counts) < self.k]
        self.rows, self.ids, self.scores = rows[kept], ids[kept], scores[kept]
        full = counts >= self.k
        worst = self.scores[np.cumsum(np.minimum(counts, self.k))[full] - 1]
        self.least[full] = np.where(np.isnan(worst), np.inf, worst)
