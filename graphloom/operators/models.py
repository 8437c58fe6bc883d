"""Model operators behind small protocols: embedding, generation and detection.

Any object with the protocol's method can be used. Here are deterministic stand-ins that need no
network, and clients of HTTP services. A failing call gives an error column, never a failed job.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import modality, subqueries
from ..tables import materialise
from .prompts import Templates, filled


class Embedder(Protocol):
    def embed(self, texts: list[str], images: list[str | None], boxes: list[list[int] | None], instruction: str | None) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: list[str], images: list[list[str]], max_tokens: int) -> list[str]: ...


class Detector(Protocol):
    def detect(self, images: list[bytes]) -> list[list[tuple[float, list[int]]]]: ...


class HashEmbedder:
    """Unit vectors from hashed words and the image's name; equal input, equal vector."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts, images, boxes, instruction=None):
        out = np.zeros((len(texts), self.size), np.float32)
        for row, text, image, box in zip(out, texts, images, boxes):
            for w in [*(text or "").lower().split(), *([f"image:{image}:{box}"] if image else [])] or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out


class RuleGenerator:
    """Answers from the prompt itself: sub-queries cut at ` and `, a modality by word, else the question's last word."""

    def generate(self, prompts, images, max_tokens=256):
        out = []
        for p in prompts:
            body = p.rpartition("Question: ")[2].partition("\n")[0]
            if "sub-queries" in p:
                out.append(";\n".join(x.strip() for x in body.split(" and ") if x.strip()))
            elif "modality" in p:
                sub = p.rpartition("Subquery: ")[2].lower()
                out.append("image" if "image" in sub or "look" in sub else "table" if "how many" in sub or "table" in sub else "text")
            else:
                words = p.rpartition("Question = ")[2].partition("\n")[0].rstrip("?").split()
                out.append(f'f_answers(["{words[-1] if words else ""}"])')
        return out


class HttpService:
    """Embeds and generates through JSON endpoints, in turn over several servers."""

    def __init__(self, urls: list[str], timeout: float = 15.0) -> None:
        self.urls, self.timeout, self.calls = urls, timeout, 0

    def _post(self, path: str, body: dict) -> Any:
        self.calls += 1
        url = self.urls[self.calls % len(self.urls)].rstrip("/") + path
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def embed(self, texts, images, boxes, instruction=None):
        if instruction is not None:
            made = [self._post("/embed/query", {"instruction": instruction, "text": t or "", "img_path": i or ""}) for t, i in zip(texts, images)]
        else:
            made = [self._post("/embed", {"text": t or "", "img_path": i or "", "bounding_box": b}) for t, i, b in zip(texts, images, boxes)]
        return np.array([m["embedding"] for m in made], np.float32)

    def generate(self, prompts, images, max_tokens=256):
        return [self._post("/generate", {"text": p, "img_paths": i, "max_tokens": max_tokens})["text"] for p, i in zip(prompts, images)]


def each_row(call: Callable[[list[int]], list], rows: list[int]) -> tuple[dict[int, Any], dict[int, str]]:
    """Results and errors by row: of all rows in one call, or row by row if that fails."""
    try:
        return dict(zip(rows, call(rows), strict=True)), {}
    except Exception as e:  # noqa: BLE001
        if len(rows) == 1:
            return {}, {rows[0]: f"{type(e).__name__}: {e}"}
    made, errors = {}, {}
    for r in rows:
        one, bad = each_row(call, [r])
        made |= one
        errors |= bad
    return made, errors


def embedding(model: Embedder, text: Column, image: Column | None = None, box: Column | None = None, instruction: Column | None = None) -> Column:
    """A struct of `vector` and `error`; a query's vector with an instruction. One call for each instruction of a batch."""

    @F.pandas_udf("vector array<float>, error string")
    def embed(t: pd.Series, i: pd.Series, b: pd.Series, how: pd.Series) -> pd.DataFrame:
        boxes = [None if x is None else [int(v) for v in x] for x in b]
        made, errors = {}, {}
        for name in dict.fromkeys(how):
            rows = [k for k, h in enumerate(how) if h == name or h is None and name is None]
            one, bad = each_row(lambda at: list(model.embed([t[k] for k in at], [i[k] for k in at], [boxes[k] for k in at], name)), rows)  # noqa: B023
            made |= one
            errors |= bad
        return pd.DataFrame({"vector": [made.get(k) for k in range(len(t))], "error": [errors.get(k) for k in range(len(t))]})

    def text_or_null(c: Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else c

    return embed(text, text_or_null(image), F.lit(None).cast("array<int>") if box is None else box, text_or_null(instruction))


def generated(model: Generator, prompt: Column, images: Column | None = None, max_tokens: int = 256, failed: str = "[Generation Failed]") -> Column:
    """A struct of `text` and `error`; a failed call has the text `failed`. Sampling models aren't deterministic, so
    materialise the result before it is used twice."""

    @F.pandas_udf("text string, error string")
    def generate(p: pd.Series, i: pd.Series) -> pd.DataFrame:
        files = [list(x) if x is not None else [] for x in i]
        made, errors = each_row(lambda at: model.generate([p[k] for k in at], [files[k] for k in at], max_tokens), list(range(len(p))))
        return pd.DataFrame({"text": [made.get(k, failed) for k in range(len(p))], "error": [errors.get(k) for k in range(len(p))]})

    return generate.asNondeterministic()(prompt, F.array().cast("array<string>") if images is None else images)


def plan_questions(questions: DataFrame, generator: Generator, embedder: Embedder, templates: Templates = Templates(), instructions: dict[str, str] | None = None) -> DataFrame:
    """(`qid`, `i`, `subquery`, `modality`, `embedding`, `error`): sub-queries, where each looks, and their vectors."""
    asked = questions.select("qid", generated(generator, filled(templates.decompose, "query", F.col("question"))).alias("g"))
    subs = asked.select("qid", F.posexplode(subqueries(F.col("g.text"))).alias("i", "subquery"), F.col("g.error").alias("_asked"))
    told = subs.withColumn("_m", generated(generator, filled(templates.modality, "subquery", F.col("subquery"))))
    kind = told.withColumn("modality", modality(F.col("_m.text"))).withColumn("_asked", F.coalesce("_asked", "_m.error")).drop("_m")
    names = {m: (instructions or {}).get(m, m) for m in ("text", "table", "image")}
    how = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("modality"))
    return kind.withColumn("_e", embedding(embedder, F.col("subquery"), instruction=how)).select("*", F.col("_e.vector").alias("embedding"), F.coalesce("_asked", "_e.error").alias("error")).drop("_e", "_asked")


def cache_questions(questions: DataFrame, generator: Generator, embedder: Embedder, templates: Templates = Templates(), instructions: dict[str, str] | None = None) -> DataFrame:
    """(`qid`, `question`, `subqueries`, `embedding`, `vectors`, `error`): a row per question, the vectors of its
    sub-queries stacked in their order. The first failed call of a question is its error, which leaves no vectors."""
    plan = materialise(plan_questions(questions, generator, embedder, templates, instructions))
    stacked = plan.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "subquery", "embedding", "error"))).alias("_s"))
    first_error = F.try_element_at(F.filter(F.col("_s.error"), lambda e: e.isNotNull()), F.lit(1))
    rows = questions.select("qid", "question").withColumn("_e", embedding(embedder, F.col("question"))).join(stacked, "qid", "left")
    rows = rows.withColumn("error", F.coalesce("_e.error", first_error))
    good = F.col("error").isNull()
    return rows.select(
        "qid",
        "question",
        F.coalesce("_s.subquery", F.array().cast("array<string>")).alias("subqueries"),
        F.when(good, F.col("_e.vector")).alias("embedding"),
        F.when(good, F.coalesce("_s.embedding", F.array().cast("array<array<float>>"))).alias("vectors"),
        "error",
    )


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def fold(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return fold(c)


def clean_ocr(c: Column) -> Column:
    """Compatibility forms folded; digits, Latin and Hangul letters kept, all else a space; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfkc(c), r"[^0-9가-힣a-zA-Z\s]", " "), r"\s+", " "))


def detections(images: DataFrame, detector: Detector, keep: int = 3, batch: int = 32) -> DataFrame:
    """(`image`, `bboxes`, `error`) from `image`, `content`: the `keep` surest boxes of each image."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    found = detector.detect([bytes(x) for x in part["content"]])
                    boxes = [[b for _, b in sorted(f, key=lambda x: -x[0])[:keep]] for f in found]
                    yield pd.DataFrame({"image": part["image"], "bboxes": boxes, "error": None})
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"image": part["image"], "bboxes": None, "error": f"{type(e).__name__}: {e}"})

    return images.select("image", "content").mapInPandas(rows, "image string, bboxes array<array<int>>, error string")
