"""Toxicity grades by cumulative-link (proportional odds) regression on words and word stems.

Grades are ordered: 0 not toxic, 1 toxic, 2 toxic and of low quality. One weight per feature is shared
by all thresholds: P(grade > k) = sigmoid(w.x - t_k). The expected severity is the sum of these
probabilities over k. The features of a text are its words and their first 5 and 7 characters; a
feature's value is its count over 1 + words / 100, a rate that a single chance hit in a short text
cannot raise far. Weights have an L1 penalty, so that what carries nothing gets exactly zero.

The model is fitted in one task on at most `max_labels` labelled rows (those whose id hashes lowest),
whatever the size of the tables, on all features of their texts; the driver gets the weights that aren't
zero. All texts are then scored as a whole where they are, without a shuffle. The score is linear in
the counts, so a word's weight is looked up once and remembered. Features go by their hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, held, materialise, small_batches
from .decontamination import words_of

SEED = 7
STEMS = (5, 7)


def features(word: bytes) -> set[int]:
    """Hashes of the word and its stems (marked by a hyphen, which no word has)."""
    from xxhash import xxh64_intdigest

    text = word.decode(errors="replace")
    return {xxh64_intdigest(f, SEED) for f in (word, *(text[:k].encode() + b"-" for k in STEMS if len(text) >= k))}


class SeverityModel:
    def __init__(self, weights: dict[int, float], thresholds: list[float], remember: int = 100_000) -> None:
        self.weights, self.thresholds, self.remember, self.known = weights, thresholds, remember, {}

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        score = np.array([self._score(words_of(t)) for t in texts])
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - score[:, None], -50, 50)))

    def _score(self, words: list[bytes]) -> float:
        if len(self.known) > self.remember:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return sum(map(known.__getitem__, words)) / (1 + len(words) / 100)


class _Features(dict):
    """The features of words, each found once."""

    def __missing__(self, word: bytes) -> set[int]:
        if len(self) > 50_000:
            self.clear()
        self[word] = found = features(word)
        return found


def text_cells(words: list[bytes], known: dict[bytes, set[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text, in order, and their values."""
    counts: Counter[int] = Counter()
    for w, c in Counter(words).items():
        for f in known[w]:
            counts[f] += c
    cols = np.fromiter(counts.keys(), np.uint64, len(counts))
    order = np.argsort(cols)
    return cols[order], np.fromiter(counts.values(), float, len(counts))[order] / (1 + len(words) / 100)


def _numbered(feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features in order, and the place of each feature among them."""
    order = np.argsort(feature).astype(np.int32)
    feature = feature[order]
    new = np.concatenate([np.ones(min(1, len(feature)), bool), feature[1:] != feature[:-1]])
    place = np.empty(len(feature), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return feature[new], place


def fit_severity(
    rows: np.ndarray, cols: np.ndarray, value: np.ndarray, grades: np.ndarray, names: np.ndarray, penalty: float = 1e-3, rounds: int = 200
) -> SeverityModel:
    """Accelerated proximal gradient on the mean log-loss of all thresholds; thresholds are not penalised.
    Cells are (text, feature, value). Without texts, or with one grade only, no feature has a weight and
    the thresholds give the base rates."""
    levels, n, width = max(2, int(grades.max(initial=0))), max(1, len(grades)), len(names)
    value = value.astype(float)
    over = (grades[:, None] > np.arange(levels)[None, :]).astype(float)
    rate = np.clip(over.sum(0) / n, 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    t, w = np.log((1 - rate) / rate), np.zeros(width)
    # columns are centred and scaled, so that steps can be long
    mean = np.bincount(cols, value, width) / n
    scale = 1 / np.sqrt(np.maximum(np.sqrt(np.maximum(np.bincount(cols, value**2, width) / n - mean**2, 0)), 1e-3))
    value = value * scale[cols]
    mean = mean * scale
    step = 4.0 / (levels * _largest(rows, cols, value, mean, n, width) + 4.0)
    look_w, look_t, old_w, old_t, momentum = w, t, w, t, 1.0
    for _ in range(rounds if len(grades) and grades.any() else 0):
        score = np.bincount(rows, value * look_w[cols], n) - mean @ look_w
        err = 1 / (1 + np.exp(np.clip(look_t[None, :] - score[:, None], -50, 50))) - over
        per = err.sum(1)
        w = look_w - step * (np.bincount(cols, value * per[rows], width) - mean * per.sum()) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        t = np.maximum.accumulate(look_t + step * err.sum(0) / n)  # thresholds stay in order
        ahead = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look_w, look_t = w + (momentum - 1) / ahead * (w - old_w), t + (momentum - 1) / ahead * (t - old_t)
        old_w, old_t, momentum = w, t, ahead
    shift = float(mean @ w)
    used = np.flatnonzero(w)
    return SeverityModel({int(names[i]): float(w[i] * scale[i]) for i in used}, [float(x) + shift for x in t])


def _largest(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, centre: np.ndarray, n: int, width: int) -> float:
    """The largest eigenvalue of X'X / n of the centred features, by power iteration."""
    v = np.ones(width)
    size = 0.0
    for _ in range(20):
        v = v / (np.linalg.norm(v) or 1.0)
        s = np.bincount(rows, value * v[cols], n) - centre @ v
        v = (np.bincount(cols, value * s[rows], width) - centre * s.sum()) / n
        size = float(np.linalg.norm(v))
    return 1.2 * size


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_labels: int = 5000,
    id_col: str = "doc_id",
    text_col: str = "text",
    **how,
) -> SeverityModel:
    """Fits on at most `max_labels` labelled rows and all features of their texts. A repeated label counts as
    its worst; rows without an id, without a `toxic` label or without a document don't count; a null
    quality is a good one."""
    graded = (
        labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col(id_col).alias("_label"))
        .agg(F.max(F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1)).alias("_grade"))
        .join(docs.select(F.col(id_col).alias("_label")), "_label", "left_semi")
        .orderBy(F.xxhash64(F.lit(SEED), "_label"), "_label")
        .limit(max_labels)
    )
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(
        F.broadcast(graded), F.col("_id") == F.col("_label")  # at most max_labels pairs of numbers
    )

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held("features", _Features)
        for pdf in batches:
            cells = [text_cells(words_of(t.encode()), known) for t in pdf["_text"]]
            own = {"_cols": [c.tobytes() for c, _ in cells], "_values": [v.tobytes() for _, v in cells]}
            yield pd.DataFrame({"_order": pdf["_order"], "_grade": pdf["_grade"], **own})
        give_back()

    source = found.select(F.xxhash64(F.lit(SEED), "_label", "_text").alias("_order"), "_grade", "_text")
    cells = materialise(source.mapInPandas(emit, "_order long, _grade int, _cols binary, _values binary"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [
            (order, grade, np.frombuffer(cols, np.uint64).copy(), np.frombuffer(values, float).copy())
            for pdf in batches
            for order, grade, cols, values in zip(pdf["_order"], pdf["_grade"], pdf["_cols"], pdf["_values"])
        ]
        texts.sort(key=lambda t: t[:2])  # the sums, and so the model, don't depend on the order of arrival
        grades = np.array([t[1] for t in texts], np.int64)
        rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t[2]) for t in texts])
        value = np.concatenate([np.zeros(0), *(t[3] for t in texts)])
        feature = np.concatenate([np.zeros(0, np.uint64), *(t[2] for t in texts)])
        del texts
        names, cols = _numbered(feature)
        del feature
        model = fit_severity(rows, cols, value, grades, names, **how)
        del rows, cols, value, names
        give_back()
        at, by = np.array(list(model.weights), np.uint64).view(np.int64), list(model.weights.values())
        # thresholds go in front, at the places of their grades
        yield pd.DataFrame({"_threshold": [True] * len(model.thresholds) + [False] * len(at), "_at": [*range(len(model.thresholds)), *at], "_by": [*model.thresholds, *by]})

    made = materialise(cells.repartition(1).mapInPandas(fit, "_threshold boolean, _at long, _by double")).toArrow().to_pydict()
    pairs = list(zip(made["_threshold"], made["_at"], made["_by"]))
    if not pairs:  # no labelled text
        return fit_severity(*(np.zeros(0, t) for t in (int, int, float, int, np.uint64)), **how)
    return SeverityModel({a & (1 << 64) - 1: w for t, a, w in pairs if not t}, [w for t, _, w in pairs if t])


def scorer(spark: SparkSession, model: SeverityModel) -> Callable[[Column], Column]:
    """A function from a text column to a struct of `p_toxic`, `severity` and `grade`."""
    small_batches(spark)

    @F.pandas_udf("p_toxic double, severity double, grade int")
    def score(text: pd.Series) -> pd.DataFrame:
        held("features", _Features)
        above = model.above([t.encode() for t in text])
        return pd.DataFrame({"p_toxic": above[:, 0], "severity": above.sum(1), "grade": (above >= 0.5).sum(1)})

    return lambda text: score(F.coalesce(text, F.lit("")))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, reject_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **how
) -> DataFrame:
    """One row per input row: the id, `p_toxic` (P(grade > 0)), `severity` (expected grade), `grade` (the
    largest k with P(grade >= k) >= 1/2) and `rejected` (p_toxic >= `reject_at`).

    A null or empty text has no words and gets the base rates.
    """
    score = scorer(docs.sparkSession, train(docs, labels, id_col=id_col, text_col=text_col, **how))
    return (
        docs.select(F.col(id_col).alias("_id"), score(F.col(text_col)).alias("_s"))
        .select(F.col("_id").alias(id_col), "_s.*")
        .withColumn("rejected", F.col("p_toxic") >= reject_at)
    )


def without_toxic(docs: DataFrame, labels: DataFrame, reject_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that aren't rejected, all columns as they were; no shuffle."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col=id_col, text_col=text_col, **how))
    return docs.where(score(docs[text_col])["p_toxic"] < reject_at)
