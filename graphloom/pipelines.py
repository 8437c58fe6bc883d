"""The two runs from end to end: a benchmark's pages to images and texts, and those to a graph and answers.

Every stage reads and writes tables below `Paths.root`, leaves what failed in `<table>_failed`, and skips
what an earlier run has done; a run that was broken off is started again as it was.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Paths, Retrieval, tuned
from .functions.text import basename, clean_name, clean_path, image_urls, percent_decode, url_extension, url_name, url_part
from .operators import asking, embedding, evaluation, graph, html, images, labelling, models
from .operators.prompts import Templates
from .tables import materialise
from .sources import readers, sinks, stored, web

# Where pages and images are fetched from.
PAGE_URL = "https://en.wikipedia.org/api/rest_v1/page/html/"
TITLE_PREFIX = "https://en.wikipedia.org/wiki/"
IMAGE_URLS = ("{url}", "https://commons.wikimedia.org/wiki/Special:FilePath/{file}")


@dataclass(frozen=True)
class Models:
    fetcher: web.Fetcher
    detector: models.Detector
    generator: models.Generator
    embedder: models.Embedder
    image_embedder: images.ImageEmbedder


class Timer:
    """Seconds of named steps, `total` over all of them, and the rows that they wrote."""

    def __init__(self) -> None:
        self.seconds: list[tuple[str, float]] = []
        self.rows: dict[str, tuple[int, int]] = {}  # by step: good and failed ones

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds.append((name, time.perf_counter() - start))

    def count(self, name: str, summary: DataFrame) -> None:
        self.rows[name] = tuple(summary.first()[1:])

    @property
    def total(self) -> float:
        return sum(s for _, s in self.seconds)


def crawl_pages(titles: DataFrame, done: DataFrame, fetcher: web.Fetcher, pace: web.Pace = web.Pace()) -> DataFrame:
    """(`title`, `html`, `error`) of the titles without a file in `done` (`title`, cleaned)."""
    wanted = titles.select("title").distinct().withColumn("_name", clean_name(F.col("title")))
    left = sinks.still_to_do(wanted, done.select(F.col("title").alias("_name")), "_name")
    got = web.fetched(left.select(F.concat(F.lit(PAGE_URL), url_part(F.col("title"))).alias("url")), fetcher, pace=pace)
    title = percent_decode(F.substr("url", F.lit(len(PAGE_URL) + 1)))
    return got.select(title.alias("title"), F.decode("content", "UTF-8").alias("html"), "error")


def crawl_images(pages: DataFrame, done: DataFrame, fetcher: web.Fetcher, pace: web.Pace = web.Pace(delay=(0.1, 0.3))) -> DataFrame:
    """(`url`, `name`, `content`, `error`) of the images that pages name, without those in `done` (`name`)."""
    urls = pages.select(F.explode(image_urls(F.col("comp_data"))).alias("url")).distinct()
    name = F.concat(url_name(F.col("url")), F.lit("."), url_extension(F.col("url")))
    left = sinks.still_to_do(urls.withColumn("name", name), done, "name")
    return web.fetched(left, fetcher, IMAGE_URLS, pace).drop("calls").withColumn("name", name)


def _items(bench: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (bench[f"{k}s"].select("id", "url", F.lit(k).alias("kind")) for k in ("text", "image", "table")))


def _titles(bench: dict[str, DataFrame]) -> DataFrame:
    supporting = bench["dev"].select(F.explode("supporting_context").alias("c")).select("c.doc_id")
    return labelling.clean_titles(_items(bench), supporting, TITLE_PREFIX)


def _split(rows: DataFrame, ok: str, key: str, fmt: str = "parquet") -> DataFrame:
    return sinks.split_failed(materialise(rows), ok, f"{ok}_failed", fmt=fmt, key=key)


def _image_table(spark: SparkSession, folder: str) -> DataFrame:
    """(`image`, `path`) of a folder of files; none where the folder isn't there yet."""
    files = stored.load_or_empty(spark, folder, "path string, modificationTime timestamp, length bigint, content binary", "binaryFile").select("path")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("image"), "path").where("image like '%.%'")


def preprocess(spark: SparkSession, paths: Paths, bench: dict[str, DataFrame], tools: Models, pace: web.Pace = web.Pace(delay=(0.1, 0.3)), reference_folder: str | None = None) -> Timer:
    """Titles of a benchmark to `html`, `pages`, `images` (files), `processed` (files), `descriptions`, `detections`,
    `image_vectors` and, with a folder of the benchmark's own images, `reference_vectors`."""
    at, timer = paths.table, Timer()
    with timer.step("pages"):
        done = stored.load_or_empty(spark, at("html"), "title string, html string").select(clean_name(F.col("title")).alias("title"))
        timer.count("pages", _split(crawl_pages(_titles(bench), done, tools.fetcher, pace), at("html"), "title"))
    with timer.step("parse"):
        parsed = stored.load_or_empty(spark, at("pages"), schemas.PAGE, "json").select("title")
        left = sinks.still_to_do(stored.load(spark, at("html")), parsed, "title")
        found = materialise(html.page_components(left, "title"))
        sinks.append(stored.as_pages(found.where("error is null")), at("pages"), "json")
        sinks.replace_failed(found.where("error is not null").select(F.col("page_id").alias("title"), "error"), left, at("pages_failed"), "title")
    with timer.step("images"):
        have = _image_table(spark, at("images")).select(F.col("image").alias("name"))
        got = materialise(crawl_images(stored.load(spark, at("pages"), "json", schemas.PAGE), have, tools.fetcher, pace))
        saved = materialise(stored.save_files(got.where("error is null"), at("images")))
        bad = got.where("error is not null").select("name", "error").unionByName(saved.where("error is not null").select("name", "error"))
        sinks.replace_failed(bad, got, at("images_failed"), "name")
    with timer.step("normalise"):
        have = _image_table(spark, at("processed")).select("image")
        if not _image_table(spark, at("images")).isEmpty():
            raw = images.decoded(spark, at("images")).withColumn("image", F.concat(clean_name(basename(F.col("path"))), F.lit(".png")))
            made = materialise(images.normalised(sinks.still_to_do(raw, have, "image").drop("image")))
            saved = materialise(stored.save_files(made.where("error is null"), at("processed"), "image"))
            bad = made.where("error is not null").select("image", "error").unionByName(saved.where("error is not null").select(F.col("name").alias("image"), "error"))
            sinks.replace_failed(bad, made, at("processed_failed"), "image")
    files = _image_table(spark, at("processed"))
    with timer.step("describe"):
        left = sinks.still_to_do(files.withColumn("image", clean_path(F.col("path"))), stored.load_or_empty(spark, at("descriptions"), schemas.DESCRIPTION, "json"), "image")
        timer.count("describe", _split(images.described(left, tools.generator), at("descriptions"), "image", "json"))
    if files.isEmpty():
        return timer
    with timer.step("detect"):
        left = sinks.still_to_do(readers.image_files(spark, at("processed")), stored.load_or_empty(spark, at("detections"), schemas.DETECTION, "json"), "image")
        timer.count("detect", _split(models.detections(left, tools.detector), at("detections"), "image", "json"))
    with timer.step("vectors"):
        left = sinks.still_to_do(readers.image_files(spark, at("processed")), stored.load_or_empty(spark, at("image_vectors"), "image string, stem string, vector array<float>"), "image")
        timer.count("vectors", _split(images.image_vectors(left, tools.image_embedder), at("image_vectors"), "image"))
        if reference_folder:
            listed = labelling.title_components(_items(bench), _titles(bench), TITLE_PREFIX)
            have = stored.load_or_empty(spark, at("reference_vectors"), "ref_id string, vector array<float>").select(F.col("ref_id").alias("stem"))
            _split(images.reference_vectors(sinks.still_to_do(readers.image_files(spark, reference_folder), have, "stem"), listed, tools.image_embedder), at("reference_vectors"), "ref_id")
    return timer


def flat_components(pages: DataFrame) -> DataFrame:
    """Pages as components (`doc_title`, cleaned, and `idx`); of pages with one cleaned title the first by title."""
    one = pages.groupBy(clean_name(F.col("title")).alias("doc_title")).agg(F.min_by("comp_data", "title").alias("comp_data"))
    return one.select("doc_title", F.posexplode("comp_data").alias("idx", "c")).select("doc_title", "idx", "c.*")


def _documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents with vectors, and the files of them that can't be read: their documents are made again."""
    try:
        return stored.load_readable(spark, path)
    except FileNotFoundError:
        return spark.createDataFrame([], "doc_title string"), spark.createDataFrame([], "name string, error string")


def build_graph(spark: SparkSession, paths: Paths, bench: dict[str, DataFrame], tools: Models, split: object = embedding.sentences, normalize_titles: bool = False) -> stored.Graph:
    """Parsed pages to `documents` (components with vectors), labels, and the stored `graph` of the listed documents. With
    `normalize_titles` a link finds a document by its cleaned title, as documents are named by theirs."""
    at = paths.table
    meta = images.metadata(stored.load_or_empty(spark, at("descriptions"), schemas.DESCRIPTION, "json"), stored.load_or_empty(spark, at("detections"), schemas.DETECTION, "json"))
    flat = flat_components(stored.load(spark, at("pages"), "json", schemas.PAGE))
    have, broken = _documents(spark, at("documents"))
    have = have.select("doc_title")
    made = materialise(embedding.embed_components(sinks.still_to_do(flat, have, "doc_title"), _image_table(spark, at("processed")), meta, tools.embedder, split))
    good, failed = embedding.stored_documents(made)
    sinks.append(good, at("documents"))
    sinks.replace_failed(failed, made, at("documents_failed"), "doc_title")
    sinks.write_over(broken, at("documents_unreadable"))
    listed = labelling.title_components(_items(bench), _titles(bench), TITLE_PREFIX)
    vectors = stored.load_or_empty(spark, at("image_vectors"), "image string, stem string, vector array<float>")
    references = stored.load_or_empty(spark, at("reference_vectors"), "ref_id string, vector array<float>")
    labelled = labelling.label_documents(_documents(spark, at("documents"))[0], listed, labelling.reference_texts(bench["texts"], bench["tables"]), vectors, references)
    numbered = materialise(graph.numbered(labelled).withColumnRenamed("edge", "neighbor_titles").withColumn("neighbor_titles", F.coalesce("neighbor_titles", F.array().cast("array<string>"))))
    stored.save_graph(numbered, graph.build_adjacency(numbered, normalize_titles), at("graph"))
    return stored.load_graph(spark, at("graph"))


QUESTION = "qid string, question string, subqueries array<string>, embedding array<float>, vectors array<array<float>>"


def retrieve_cached(spark: SparkSession, paths: Paths, questions: DataFrame, tools: Models, settings: Retrieval = Retrieval(), templates: Templates = Templates(), instructions: dict[str, str] | None = None) -> DataFrame:
    """(`qid`, `rank`, `component_id`): vectors of new questions go to `questions`, then all are searched together."""
    at = paths.table
    left = sinks.still_to_do(questions, stored.load_or_empty(spark, at("questions"), QUESTION), "qid")
    _split(models.cache_questions(left, tools.generator, tools.embedder, templates, instructions), at("questions"), "qid")
    cached = stored.load(spark, at("questions"), schema=QUESTION).join(questions.select("qid"), "qid", "left_semi")
    g = stored.load_graph(spark, at("graph"))
    return materialise(graph.retrieve(cached, g.components, g.subs, cached.select("qid", "vectors"), g.adjacency, settings))


def answer(spark: SparkSession, paths: Paths, bench: dict[str, DataFrame], tools: Models, settings: Retrieval = Retrieval(), templates: Templates = Templates()) -> dict[str, DataFrame]:
    """Retrieval, its metrics, answers (`answers`, and errors in `answers_failed`) and their scores, over a stored graph.

    A question that has no result because its vectors failed is left out of the answers; it stays in
    `questions_failed`."""
    tuned(spark, settings)
    at, asked = paths.table, readers.questions(bench["dev"])
    results = retrieve_cached(spark, paths, asked, tools, settings, templates)
    g = stored.load_graph(spark, at("graph"))
    listed = materialise(graph.with_payload(results, g.components))
    sinks.write_new(listed, at("retrieval"), "parquet")
    joined = evaluation.strict_join(listed, asked.select("qid", F.col("gold_ids").alias("gold"))).withColumnRenamed("final_component_uuid_list", "found")
    found = written_answers(asked.join(listed.select("qid"), "qid", "left_semi"), results, g.components, _image_table(spark, at("processed")), tools, templates, at("answers"))
    return {
        "match": evaluation.match_rates(joined),
        "mrr": evaluation.mean_reciprocal_rank(joined),
        "answers": found,
        "scores": evaluation.em_f1(found, asked.select("qid", "answers")),
    }


def written_answers(questions: DataFrame, results: DataFrame, components: DataFrame, files: DataFrame, tools: Models, templates: Templates, path: str) -> DataFrame:
    """Answers of all questions, the failed ones as `[Generation Failed]`, written once; errors also to `<path>_failed`."""
    made = materialise(asking.ask(questions, results, components, files, tools.generator, templates))
    sinks.write_new(made.select("qid", "answer"), path)
    sinks.write_new(made.where("error is not null").select("qid", "error"), f"{path}_failed")
    return made
