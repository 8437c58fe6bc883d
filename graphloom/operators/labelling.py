"""Gold labels: which component of a page best matches each annotated item."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_name, label_text, links, table_for_labels, tokens, url_name, wiki_title
from ..functions.vectors import dot
from ..tables import materialise


def reference_texts(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """(`id`, `kind`, `value`): cleaned paragraphs and serialised tables of the benchmark."""
    cells = F.transform("table.table_rows", lambda r: F.transform(r, lambda c: c["text"]))
    return texts.select("id", F.lit("text").alias("kind"), label_text(F.col("text")).alias("value")).unionByName(
        tables.select("id", F.lit("table").alias("kind"), label_text(table_for_labels(cells)).alias("value"))
    )


def clean_titles(items: DataFrame, supporting: DataFrame, prefix: str) -> DataFrame:
    """Distinct page titles of the items (`id`, `url`) that any supporting context (`doc_id`) names."""
    wanted = supporting.where("doc_id is not null and doc_id <> ''").select(F.col("doc_id").alias("id")).distinct()
    urls = items.where("url is not null and url <> ''").join(wanted, "id", "left_semi")
    return urls.select(wiki_title(F.col("url"), prefix).alias("title")).distinct()


def title_components(items: DataFrame, titles: DataFrame, prefix: str) -> DataFrame:
    """All item ids of each title by kind: `title`, `text`, `image`, `table` (sorted lists); titles without items keep empty lists."""
    named = items.where("id is not null and id <> '' and url is not null and url <> ''").select(
        "id", "kind", wiki_title(F.col("url"), prefix).alias("title")
    )

    def ids(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("id")))).alias(kind)

    return titles.select("title").join(named, "title", "left").groupBy("title").agg(*map(ids, ("text", "image", "table")))


def token_recall(references: DataFrame, candidates: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(`ref_id`, `on`, `cand_id`, `score`): the multiset share of a reference's tokens that a candidate has, for all
    pairs that share a token (and the columns `on`). Inputs: id, `value`, `on`.

    Token counts are aggregated before they meet; the references are the small side.
    """
    on = on or []
    ref = references.select("ref_id", *on, F.explode(tokens(F.col("value"))).alias("t")).groupBy("ref_id", *on, "t").agg(F.count("*").alias("n_ref"))
    size = references.select("ref_id", *on, F.size(tokens(F.col("value"))).alias("size"))
    needed = ref.select("t").distinct()
    cand = (
        candidates.select("cand_id", *on, F.explode(tokens(F.col("value"))).alias("t"))
        .join(needed, "t", "left_semi")
        .groupBy("cand_id", *on, "t").agg(F.count("*").alias("n_cand"))
    )
    shared = cand.join(ref, [*on, "t"]).groupBy("ref_id", *on, "cand_id").agg(F.sum(F.least("n_ref", "n_cand")).alias("shared"))
    return shared.join(size, ["ref_id", *on]).select("ref_id", *on, "cand_id", (F.col("shared") / F.col("size")).alias("score"))


@dataclass(frozen=True)
class Bounds:
    """Of a search for best matches by upper bounds: `pairs` (`ref_id`, `on`, `cand_id`, `shared`), all that could be best, with their shared
    tokens exactly; `met`, those that were formed at all; `sizes` of the references."""

    pairs: DataFrame
    met: DataFrame
    sizes: DataFrame


def bounded_pairs(references: DataFrame, candidates: DataFrame, on: list[str] | None = None, probes: int = 3) -> Bounds:
    """The pairs that can be a reference's best match, without forming all that share a token (MaxScore).

    A reference's tokens are ordered by the number of candidates that have them, the rarest first. The candidate that has most of
    the first `probes` tokens, scored exactly, gives a bound. Tokens at the end of the order, which together can't reach it, form
    no pairs; a pair that can't reach it with all of them leaves; for the others the tokens at the end are looked up.
    """
    on = on or []
    ref_key, at = ["ref_id", *on], [*on, "t"]
    ref = references.select(*ref_key, F.explode(tokens(F.col("value"))).alias("t")).groupBy(*ref_key, "t").agg(F.count("*").alias("n_ref"))
    sizes = references.select(*ref_key, F.size(tokens(F.col("value"))).alias("size"))
    cand = materialise(
        candidates.select("cand_id", *on, F.explode(tokens(F.col("value"))).alias("t"))
        .join(ref.select(*at).distinct(), at, "left_semi")
        .groupBy("cand_id", *at).agg(F.count("*").alias("n_cand"))
    )
    common = cand.groupBy(*at).agg(F.count("*").alias("many"))
    order = Window.partitionBy(*ref_key).orderBy("many", "t")  # of one reference's tokens
    left = F.sum("n_ref").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = materialise(ref.join(common, at).withColumns({"rank": F.row_number().over(order), "left": left}))

    def shared(some: DataFrame, name: str) -> DataFrame:
        return some.join(cand, at).groupBy(*ref_key, "cand_id").agg(F.sum(F.least("n_ref", "n_cand")).alias(name))

    first = shared(ranked.where(F.col("rank") <= probes), "n").groupBy(*ref_key).agg(F.max(F.struct("n", (-F.col("cand_id")).alias("c"))).alias("b"))
    asked = first.select(*ref_key, (-F.col("b.c")).alias("cand_id")).join(ranked, ref_key)
    reached = asked.join(cand, [*at, "cand_id"]).groupBy(*ref_key).agg(F.sum(F.least("n_ref", "n_cand")).alias("bound"))
    bounded = materialise(ranked.join(reached, ref_key).withColumn("forms", F.col("left") >= F.col("bound")))
    behind = bounded.groupBy(*ref_key, "bound").agg(F.coalesce(F.sum(F.when(~F.col("forms"), F.col("n_ref"))), F.lit(0)).alias("behind"))
    met = materialise(shared(bounded.where("forms"), "shared"))
    able = met.join(behind, ref_key).where("shared + behind >= bound").select(*ref_key, "cand_id", "shared")
    more = able.join(bounded.where("not forms"), ref_key).join(cand, [*at, "cand_id"]).groupBy(*ref_key, "cand_id").agg(F.sum(F.least("n_ref", "n_cand")).alias("more"))
    exact = able.join(more, [*ref_key, "cand_id"], "left").withColumn("shared", F.col("shared") + F.coalesce("more", F.lit(0))).drop("more")
    return Bounds(exact, met, sizes)


def _best(bounds: Bounds, on: list[str]) -> DataFrame:
    scored = bounds.pairs.join(bounds.sizes, ["ref_id", *on]).withColumn("score", F.col("shared") / F.col("size"))
    return scored.groupBy("ref_id", *on).agg(F.max(F.struct("score", (-F.col("cand_id")).alias("c"))).alias("b"))


def best_match(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """(`ref_id`, `cand_id`, `score`): of each reference (`ref_id`, `value`) the candidate (`cand_id`, `value`) with the largest
    `token_recall`, of equal ones the smallest id; a reference that shares nothing gets the first candidate with score 0."""
    best = _best(bounded_pairs(references, candidates), [])
    first = candidates.agg(F.min("cand_id").alias("first"))
    return references.select("ref_id").join(best, "ref_id", "left").join(F.broadcast(first)).select(
        "ref_id", F.coalesce(-F.col("b.c"), "first").alias("cand_id"), F.coalesce("b.score", F.lit(0.0)).alias("score")
    )


def best_match_within(references: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """As `best_match`, but among the candidates that agree in the columns `on`; no row for a
    reference without any. Of equal candidates the smallest id is taken, also where nothing is shared."""
    best = _best(bounded_pairs(references, candidates, on), on)
    first = candidates.groupBy(*on).agg(F.min("cand_id").alias("first"))
    return references.select("ref_id", *on).join(first, on).join(best, ["ref_id", *on], "left").select(
        "ref_id", *on, F.coalesce(-F.col("b.c"), "first").alias("cand_id"), F.coalesce("b.score", F.lit(0.0)).alias("score")
    )


def best_image(references: DataFrame, candidates: DataFrame, score: Column) -> DataFrame:
    """The image of the same title with the largest product; the first in the list of equal ones.
    `references`: `ref_id`, `title`, `vec`; `candidates`: `cand_id`, `title`, `list_pos` (any order), `cand_vec`."""
    pairs = references.join(candidates, "title").withColumn("score", score)
    best = pairs.groupBy("ref_id", "title").agg(F.min(F.struct((-F.col("score")).alias("s"), "list_pos", "cand_id", "score")).alias("b"))
    return best.select("ref_id", "title", "b.cand_id", "b.score")


def image_candidates(components: DataFrame) -> DataFrame:
    """(`title`, `cand_id`, `list_pos`, `image`): images of documents, of image components and of table cells, by the
    name of their processed file; `cand_id` is the place of the component in its document."""
    own = components.where("type = 'image'").select("doc_title", "idx", F.lit(0).alias("at"), F.col("src").alias("link"))
    cells = F.flatten(F.transform(F.flatten("table"), links))
    inner = components.where("type = 'table'").select("doc_title", "idx", F.posexplode(cells).alias("at", "link"))
    return own.unionByName(inner).select(
        F.col("doc_title").alias("title"), F.col("idx").alias("cand_id"), F.struct("idx", "at").alias("list_pos"), F.concat(url_name(F.col("link")), F.lit(".png")).alias("image")
    )


def label_documents(components: DataFrame, titles: DataFrame, references: DataFrame, images: DataFrame, reference_images: DataFrame) -> DataFrame:
    """The components of the documents that `titles` lists, with `uuids`, the ids of the items found in them.

    `titles`: as of `title_components`; `references`: as of `reference_texts`; `images` (`image`, `vector`) and
    `reference_images` (`ref_id`, `vector`): vectors of processed files and of items. Every item goes to the
    best component of its kind in its own document; an item without any, or without a vector, goes to none.
    """
    listed = titles.withColumn("doc_title", clean_name(F.col("title")))
    found = components.join(listed.select("doc_title").distinct(), "doc_title", "left_semi")
    wanted = reduce(DataFrame.unionByName, (listed.select("doc_title", F.lit(k).alias("kind"), F.explode(k).alias("ref_id")) for k in ("text", "table", "image"))).distinct()
    texts = wanted.join(references.select(F.col("id").alias("ref_id"), "kind", "value"), ["ref_id", "kind"])
    value = F.when(F.col("type") == "paragraph", F.col("paragraph")).otherwise(table_for_labels(F.col("table")))
    kind = F.when(F.col("type") == "paragraph", "text").otherwise("table")
    candidates = found.where("type in ('paragraph', 'table')").select("doc_title", kind.alias("kind"), F.col("idx").alias("cand_id"), label_text(value).alias("value"))
    matched = best_match_within(texts, candidates, ["doc_title", "kind"]).select("doc_title", "kind", "ref_id", F.col("cand_id").alias("idx"))
    asked = wanted.where("kind = 'image'").join(reference_images.select("ref_id", F.col("vector").alias("vec")), "ref_id").withColumnRenamed("doc_title", "title")
    pictures = image_candidates(found).join(images.select("image", F.col("vector").alias("cand_vec")), "image")
    seen = best_image(asked, pictures, dot(F.col("vec"), F.col("cand_vec")))
    matches = matched.unionByName(seen.select(F.col("title").alias("doc_title"), F.lit("image").alias("kind"), "ref_id", F.col("cand_id").alias("idx")))
    return label_components(found, matches, ["doc_title", "idx"])


def labelled_ids(titles: DataFrame) -> DataFrame:
    """One row: `n`, how many ids all titles list."""
    return titles.agg(F.coalesce(F.sum(F.size("text") + F.size("table") + F.size("image")), F.lit(0)).alias("n"))


def label_components(components: DataFrame, matches: DataFrame, key: list[str] = ["component_id"]) -> DataFrame:
    """`components` with `uuids`: the ids matched to each (by `key`), text before table before image."""
    order = F.array(F.lit("text"), F.lit("table"), F.lit("image"))
    ids = matches.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("kind")).alias("k"), "ref_id"))).alias("u")
    ).select(*key, F.col("u.ref_id").alias("uuids"))
    return components.drop("uuids").join(ids, key, "left").withColumn("uuids", F.coalesce("uuids", F.array().cast("array<string>")))
